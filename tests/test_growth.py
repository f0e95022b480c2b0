"""Exact sums, growth on count arrays, resumed runs, samples drawn in the row, site files in order, rules and the SQL scorer."""

import glob
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from grovelight import config, forest, run
from grovelight.functions import exact, scorer
from grovelight.functions.portable import settle, shared_dir
from grovelight.operators import binning, grow, impurity, rules, sampling, score
from grovelight.plans import catalogue
from grovelight.sources import tables
from tests.conftest import SF
from tests.test_forest import grid, rows


def nodes_of(f):
    return sorted(map(tuple, f.nodes.collect()), key=repr)


def test_sums_are_exact_in_any_order(spark):
    rng = random.Random(1)
    data = [(i % 2, i, [rng.uniform(-1, 1) * 10 ** rng.randrange(-8, 9), rng.choice([1, -1]) * 10.0 ** rng.randrange(-150, 150), 0.1, 0.0, 5e-324 * rng.randrange(9)], 0) for i in range(3000)]
    df = rows(spark, data)
    seen = [sorted(map(tuple, binning.moments_partial(df.repartition(n)).collect())) for n in (1, 4, 64)]
    assert seen[0] == seen[1] == seen[2]
    for _, c, f, n, sxx, sx in seen[0]:
        own = [x[2][f] for x in data if x[0] == c]
        assert (n, sx, sxx) == (len(own), math.fsum(own), math.fsum(v * v for v in own))
    edges = [[(r.feature, r.edges, r.mean, r.stddev) for r in binning.edge_table(df.repartition(n), 5, (0, 1)).orderBy("feature").collect()] for n in (1, 64)]
    assert edges[0] == edges[1]


@pytest.mark.parametrize("values,want", [([1.0, float("inf")], math.inf), ([float("inf"), -float("inf")], math.nan), ([float("nan"), 1.0], math.nan), ([None, 2.5], 2.5), ([None], None), ([1e308, 1e308, -1e308], 1e308), ([-0.0], 0.0)])
def test_odd_sums(spark, values, want):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    parts = df.withColumn("q", exact.slot(F.col("x"))).groupBy("q").agg(exact.total_parts(F.col("x"), F.col("q")).alias("p"))
    got = parts.agg(exact.total(F.collect_list("p")).alias("s")).first().s
    assert (got is None) if want is None else (math.isnan(got) if math.isnan(want) else got == want)


def test_many_classes(spark):
    """60 classes and 50 bins: the plan doesn't grow with them, and the counts are those of a plain count."""
    data = [(i % 3, i // 3, [(i * 37) % 101, (i * 53) % 89, i % 7], i % 60) for i in range(1800)]
    df = rows(spark, data)
    f = forest.train(df, config.RunConfig(n_bins=50, n_estimators=2, max_depth=3, max_features=2))
    assert {n.is_leaf for n in f.nodes.collect()} == {True, False}
    binned = binning.bin_rows(df, f.edges, 50)
    sample = binned.select("*", F.lit(0).alias("tree"), F.lit(1).alias("node_id"), F.lit(1).cast("long").alias("mult"))
    features = spark.createDataFrame([(0, 0, 0), (0, 1, 2)], "tree int, pos int, feature int")
    cum = impurity.cumulative(impurity.histogram(sample, features), 50, [float(c) for c in range(60)])
    bins = {(r.client, r.row_id): (r.bins, int(r.y)) for r in binned.collect()}
    for r in cum.collect():
        own = [(b[r.feature], y) for (c, _), (b, y) in bins.items() if c == r.client]
        assert list(r.total) == [sum(y == c for _, y in own) for c in range(60)]
        assert all(list(r.left[t]) == [sum(y == c and b <= t for b, y in own) for c in range(60)] for t in (0, 7, 49))


def test_only_smaller_siblings_are_counted(spark):
    df = rows(spark, [(i % 3, i // 3, [(i * i) % 97, (i * 7) % 31, i % 5], ((i * i) % 97 > 40) ^ (i % 7 == 0)) for i in range(900)])
    edges = binning.edge_table(df, 8)
    binned = settle(binning.bin_rows(df, edges, 8), "binned")
    state = settle(grow.initial_state(binned, sampling.bootstrap(df, 2, 3)), "state")
    features = sampling.feature_subset(spark, 2, 3, 2, 3)
    g = grow.Growth(8, 5, classes=(0.0, 1.0))
    folder = f"{shared_dir(spark)}/half"
    assert grow.grow(state, features, g, folder, stop_after=1) is None
    known = grow.last_level(spark, folder, 5)
    level = spark.read.parquet(known["state"])
    counted, held = grow.unpacked(level).agg(F.sum("mult")).first()[0], level.select(F.explode("at").alias("a")).agg(F.sum("a.mult")).first()[0]
    assert 0 < counted <= held / 2
    # Differences give what counting would have given.
    places = spark.read.parquet(known["frontier"]).select("split", "tree", "slot", "node_id")
    whole = grow.unpacked(level.withColumn("at", F.transform("at", lambda a: a.withField("counted", F.lit(True)))))
    full = impurity.cumulative(impurity.histogram(whole.withColumn("node_id", F.col("slot").cast("long")), features), 8, [0.0, 1.0]).withColumnRenamed("node_id", "slot").join(places, ["split", "tree", "slot"])
    part = impurity.cumulative(impurity.histogram(grow.unpacked(level).withColumn("node_id", F.col("slot").cast("long")), features), 8, [0.0, 1.0]).withColumnRenamed("node_id", "slot").join(places, ["split", "tree", "slot"])
    rest = impurity.without_sibling(spark.read.parquet(known["cumulative"]), part, spark.read.parquet(known["frontier"]).filter(~F.col("counted")).select(*places.columns))
    columns = ["split", "client", "tree", "node_id", "pos", "feature", "left", "total"]
    shown = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert shown(part.unionByName(rest.select(*part.columns))) == shown(full)


def test_a_stopped_run_goes_on(spark):
    df = rows(spark, [(i % 3, i // 3, [(i * i) % 97, (i * 7) % 31, i % 5], (i * 11) % 4) for i in range(600)])
    c = config.RunConfig(n_bins=6, n_estimators=2, max_depth=5, max_features=2)
    whole = nodes_of(forest.train(df, c))
    edges = binning.edge_table(df, 6)
    state = settle(grow.initial_state(settle(binning.bin_rows(df, edges, 6), "binned"), sampling.bootstrap(df, 2, 0)), "state")
    features = sampling.feature_subset(spark, 2, 3, 2, 0)
    g, folder = grow.Growth(6, 5, classes=(0.0, 1.0, 2.0, 3.0)), f"{shared_dir(spark)}/stopped"
    assert grow.grow(state, features, g, folder, stop_after=2) is None
    # Rows of the first level are not needed any more.
    assert sorted(map(tuple, grow.grow(None, features, g, folder).collect()), key=repr) == whole
    assert sorted(map(tuple, grow.grow(None, features, g, folder).collect()), key=repr) == whole
    with pytest.raises(ValueError):
        grow.grow(None, features, grow.Growth(7, 5, classes=(0.0, 1.0, 2.0, 3.0)), folder)
    again = config.RunConfig(n_bins=6, n_estimators=2, max_depth=5, max_features=2, run_folder=f"{shared_dir(spark)}/whole")
    assert nodes_of(forest.train(df, again)) == whole and nodes_of(forest.train(df, again)) == whole


def test_samples_drawn_in_the_row(spark):
    df = rows(spark, [(i % 2, i // 2, [i], 0) for i in range(5000)])
    got = sampling.poisson_bootstrap(df, 4, 7).select(F.explode("sample").alias("s")).groupBy("s.tree").agg(F.sum("s.mult").alias("n"), F.sum(F.col("s.mult") * F.col("s.mult")).alias("nn")).collect()
    for r in got:
        assert abs(r.n - 5000) < 5 * math.sqrt(5000) and abs(r.nn / 5000 - 2) < 0.3  # mean 1, E[k*k] = 2
    f = forest.train(grid(spark), config.RunConfig(n_bins=7, n_estimators=3, max_depth=3, oob=True, bootstrap_method="poisson", max_samples=0.8))
    assert f.trees.count() == 3 and f.trees.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        config.RunConfig(bootstrap_method="poisson", max_samples=5)


def site_files(tmp_path, orders=("a,b,y", "y,b,a")):
    rng, seen = random.Random(4), {}
    for client, header in enumerate(orders, 1):
        for name, n in (("train", 60), ("test", 25)):
            place = tmp_path / f"client{client}" / f"{name}.csv"
            place.parent.mkdir(parents=True, exist_ok=True)
            own = [{"a": rng.randrange(50), "b": rng.randrange(300, 400)} for _ in range(n)]
            for r in own:
                r["y"] = int(r["a"] > 25)
            place.write_text("\n".join([header, *(",".join(str(r[c]) for c in header.split(",")) for r in own[:10]), "", *(",".join(str(r[c]) for c in header.split(",")) for r in own[10:])]) + "\n")
            seen[client, name] = own
    return seen


def test_sites_are_read_by_name_and_answered_line_by_line(spark, tmp_path):
    seen = site_files(tmp_path)
    got = tables.read_csv_sites(spark, f"file://{tmp_path}/client*/train.csv", "y", row_ids="lines")
    assert sorted((r.client, r.row_id, r.features, r.y) for r in got.collect()) == [(c, i, [float(r["a"]), float(r["b"])], float(r["y"])) for c in (1, 2) for i, r in enumerate(seen[c, "train"])]
    run.run(spark, config.RunConfig(label="y", n_bins=10, n_estimators=5, max_depth=4, max_features=2, row_ids="lines"), f"file://{tmp_path}", f"file://{tmp_path}/out")
    for client in (1, 2):
        lines = [x.split(",") for part in sorted(glob.glob(f"{tmp_path}/out/pred.csv/split=0/client={client}/part-*")) for x in open(part).read().split("\n")[1:] if x]
        assert [int(i) for i, _ in lines] == list(range(25))
        truth = [x.split(",") for part in sorted(glob.glob(f"{tmp_path}/out/y_true.csv/split=0/client={client}/part-*")) for x in open(part).read().split("\n")[1:] if x]
        assert [float(y) for _, y in truth] == [float(r["y"]) for r in seen[client, "test"]]
        assert sum(float(p) == r["y"] for (_, p), r in zip(lines, seen[client, "test"])) >= 23


@pytest.mark.parametrize("orders", [("a,b,y", "a,c,y"), ("a,b,y", "a,b"), ("a,b,y", "a,a,y")])
def test_sites_of_other_columns_are_refused(spark, tmp_path, orders):
    for client, header in enumerate(orders, 1):
        (tmp_path / f"client{client}").mkdir()
        (tmp_path / f"client{client}" / "train.csv").write_text(f"{header}\n" + ",".join("1" for _ in header.split(",")) + "\n")
    with pytest.raises(ValueError):
        tables.read_csv_sites(spark, f"file://{tmp_path}/client*/train.csv", "y")


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000])
def test_halving_counts_edges(spark, n):
    edges = [i * 0.5 for i in range(n)]
    xs = [-1.0, 0.0, 0.25, 0.5, n * 0.25, n * 0.5 - 0.5, n * 1.0]
    df = spark.createDataFrame([(x, edges) for x in xs], "x double, e array<double>")
    assert [r.b for r in df.select(binning.edges_below(F.col("e"), F.col("x"), n).alias("b")).collect()] == [sum(e <= x for e in edges) for x in xs]
    same = spark.createDataFrame([(x, [3.0] * n) for x in (2.0, 3.0, 4.0)], "x double, e array<double>")
    assert [r.b for r in same.select(binning.edges_below(F.col("e"), F.col("x"), n).alias("b")).collect()] == [0, n, n]


@pytest.mark.parametrize("n_bins,quantile", [(5, ()), (5, (0, 2)), (100, (1,))])
def test_batches_are_binned_as_rows(spark, n_bins, quantile):
    rng = random.Random(3)
    data = [(i % 3, i // 3, [rng.choice([0.5, rng.uniform(-3, 3)]), 1e16 + i % 9, rng.gauss(0, 1), 7.0], 0) for i in range(400)]
    base = rows(spark, data)
    edges = settle(binning.edge_table(base.unionByName(base.withColumn("split", F.lit("é")).filter("row_id % 3 > 0")), n_bins, quantile), "edges")
    nan, inf = float("nan"), float("inf")
    odd = [("0", 9, 0, None), ("0", 9, 1, []), ("é", 9, 2, [1.0]), ("0", 9, 3, [nan, None, inf, -inf]), ("0", 9, 4, [0.0, 1e16, -0.0, 7.0, 3.0]), ("none", 9, 5, [1.0] * 4), (None, 9, 6, [1.0] * 4)]
    asked = spark.createDataFrame(odd, "split string, client int, row_id bigint, features array<double>").unionByName(base.select("split", "client", "row_id", "features"))
    shown = lambda d: sorted(map(repr, d.drop("features").collect()))
    assert shown(binning.bin_batches(asked, edges, n_bins).filter("row_id <> 4 OR client < 9")) == shown(binning.bin_rows(asked, edges, n_bins).filter("row_id <> 4 OR client < 9"))
    extra = binning.bin_batches(asked, edges, n_bins).filter("row_id = 4 AND client = 9").first().bins
    assert len(extra) == 5 and extra[4] is None and None not in extra[:4]


def test_a_row_satisfies_one_rule_of_a_tree(spark):
    df = rows(spark, [(i % 3, i // 3, [(i * i) % 97, (i * 7) % 31, i % 5], (i * 11) % 4) for i in range(300)])
    f = forest.train(df, config.RunConfig(n_bins=6, n_estimators=3, max_depth=5, max_features=2))
    found = rules.leaf_rules(f.nodes, f.depth).collect()
    assert len(found) == f.nodes.filter("is_leaf").count()
    preds = {(r.client, r.row_id, r.tree): r.pred for r in f.predict_trees(df).collect()}
    for r in binning.bin_rows(df, f.edges, 6).collect():
        for tree in range(3):
            fits = [x for x in found if x.tree == tree and all((p.low is None or r.bins[p.feature] > p.low) and (p.high is None or r.bins[p.feature] <= p.high) for p in x.rule)]
            assert len(fits) == 1 and fits[0].value == preds[r.client, r.row_id, tree]
    leaf = forest.train(df, config.RunConfig(n_bins=6, n_estimators=1, max_depth=1))
    assert [(r.node_id, r.rule) for r in rules.leaf_rules(leaf.nodes, 1).collect()] == [(1, [])]


@pytest.mark.parametrize("settings", [{"oob": True, "quantile": (0,)}, {"mode": "regression"}])
def test_scorer_in_sql(spark, settings):
    base = rows(spark, [(i % 3, i // 3, [(i * i) % 97, (i * 7) % 31], (i * 11) % 4) for i in range(300)])
    df = base.unionByName(base.withColumn("split", F.lit("é")).filter("row_id % 3 > 0"))
    f = forest.train(df, config.RunConfig(n_bins=6, n_estimators=3, max_depth=4, max_features=2, **settings))
    scorer.register_scorer(f, "own_predict")
    odd = spark.createDataFrame([("0", 9, 1, [float("nan"), -5.0]), ("0", 9, 2, [None, 1e9])], "split string, client int, row_id bigint, features array<double>")
    asked = df.select(*odd.columns).unionByName(odd)
    got = spark.sql("SELECT * FROM own_predict(TABLE(SELECT split, client, row_id, features, 1 AS y FROM {rows}))", rows=asked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, f.predict(asked).collect()))
    none = spark.createDataFrame([("unknown", 0, 0, [1.0, 2.0]), ("0", 0, 1, None)], odd.schema)
    assert [r.pred for r in spark.sql("SELECT pred FROM own_predict(TABLE({rows}))", rows=none).collect()] == [None, None]


@pytest.mark.parametrize("m,of", [(None, 1), (0.5, 0.5), (20, None)])
def test_samples_are_the_draws(spark, m, of):
    """Also samples of more draws than a site has rows."""
    df = rows(spark, [(i % 2, i // 2, [i], 0) for i in range(15)])
    want = {}
    for client, n in ((0, 8), (1, 7)):
        for tree in range(2):
            for i in range(max(round(n * of), 1) if of else m):
                key = client, tree, int(hashlib.md5(f"5|b|0|{client}|{tree}|{i}".encode()).hexdigest()[:8], 16) % n
                want[key] = want.get(key, 0) + 1
    assert {(r.client, r.tree, r.row_id): r.mult for r in sampling.bootstrap(df, 2, 5, m).collect()} == want


def test_samples_are_not_taken_for_small(spark):
    """Samples grow with the rows, so a join with one isn't a broadcast because the table of the sites' sizes is small."""
    df = settle(spark.range(0, 60_000, numPartitions=8).selectExpr("'0' AS split", "CAST(id % 2 AS INT) AS client", "id DIV 2 AS row_id"), "rows")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        left = df.join(sampling.bootstrap(df, 1, 3), ["split", "client", "row_id"], "left_anti")
        assert 0.3 < left.count() / 60_000 < 0.45
        left.collect()
        plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "isFinalPlan=true" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "LeftAnti" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 100, 4099])
def test_permutation_is_one(spark, n):
    moved = [r.x for r in spark.range(n).select(sampling.permuted(F.col("id"), F.lit(n).cast("long"), [7, "k"]).alias("x")).collect()]
    assert sorted(moved) == list(range(n)) and (n < 17 or moved != list(range(n)))
    other = [r.x for r in spark.range(n).select(sampling.permuted(F.col("id"), F.lit(n).cast("long"), [8, "k"]).alias("x")).collect()]
    assert n < 17 or other != moved


def test_permuted_labels_are_the_same_labels(spark):
    df = rows(spark, [(i % 2, i // 2, [i], i) for i in range(300)])
    got = sampling.permute_labels(df, 5).collect()
    assert sorted((r.client, r.y) for r in got) == [(c, float(y)) for c in (0, 1) for y in range(c, 300, 2)]
    assert sum(r.features[0] == r.y for r in got) < 20


@pytest.mark.parametrize("settings", [{"oob": True}, {"mode": "regression"}])
def test_large_forests_are_walked_by_joins(spark, settings):
    df = rows(spark, [(i % 3, i // 3, [(i * i) % 97, (i * 7) % 31], (i * 11) % 4) for i in range(200)])
    f = forest.train(df, config.RunConfig(n_bins=6, n_estimators=3, max_depth=4, max_features=2, **settings))
    binned = binning.bin_rows(df, f.edges, f.n_bins)
    shown = lambda d: sorted(map(tuple, d.collect()))
    assert shown(score.predict_trees(binned, f.nodes, f.depth, most=0)) == shown(f.predict_trees(df))
    assert shown(score.predict_rows(binned, f.nodes, f.depth, f.mode, f.trees if f.weighted else None, most=0)) == shown(f.predict(df))


def test_child_assign_reads_its_rows_once(spark, monkeypatch):
    names, plain = [], catalogue.settle
    monkeypatch.setattr(catalogue, "settle", lambda df, name: names.append(name) or plain(df, name))
    catalogue.QUERIES["child_assign"](spark, SF)
    assert names == ["rows", "assign"]


def test_rows_are_binned_and_walked_in_one_pass(spark):
    """Also trees that all weigh nothing: the smallest class that one of them names wins."""
    df = rows(spark, [(i % 3, i // 3, [(i * i) % 97, (i * 7) % 31], (i * 11) % 4) for i in range(200)])
    f = forest.train(df, config.RunConfig(n_bins=6, n_estimators=3, max_depth=4, max_features=2))
    for scored in (f.predict(df), f.predict_trees(df)):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan
    binned, none = settle(binning.bin_rows(df, f.edges, f.n_bins), "binned"), f.trees.withColumn("weight", F.lit(0.0))
    shown = lambda most: sorted(map(tuple, score.predict_rows(binned, f.nodes, f.depth, f.mode, none, most=most).collect()))
    assert shown(score.MOST_NODES) == shown(0)
