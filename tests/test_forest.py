"""Properties and edge cases of growth, bins, settings and readers."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from grovelight import config, evaluate, forest, run
from grovelight.functions import portable
from grovelight.operators import binning, grow, impurity, metrics, sampling, score
from grovelight.sources import tables
from tests.conftest import SF


def rows(spark, data):
    return spark.createDataFrame([("0", c, i, [float(x) for x in f], float(y)) for c, i, f, y in data], "split string, client int, row_id bigint, features array<double>, y double")


def grid(spark):
    return rows(spark, [(i % 3, i // 3, [i % 7, i % 5], (i % 7) > 3) for i in range(210)])


def test_edges_are_right_open_and_constant_feature_is_last(spark):
    df = rows(spark, [(0, 0, [0, 5], 0), (0, 1, [10, 5], 1), (1, 0, [4, 5], 1)])
    e = binning.edge_table(df, 5)
    seen = {(r.client, r.row_id): r.bins for r in binning.bin_rows(df, e, 5).collect()}
    assert seen == {(0, 0): [0, 4], (0, 1): [4, 4], (1, 0): [2, 4]}
    unseen = rows(spark, [(0, 0, [-1, 9], 0), (0, 1, [99, float("nan")], 0)])
    assert [r.bins for r in binning.bin_rows(unseen, e, 5).orderBy("row_id").collect()] == [[-1, 4], [4, 4]]


def test_quantile_edges():
    q = binning.normal_quantiles(4)
    assert q[-1] == math.inf and q[0] == statistics.NormalDist().inv_cdf(0.25) and len(q) == 4
    assert binning.normal_quantiles(1) == [math.inf]


def test_empty_side_and_weighted_gini(spark):
    def gini(l, t, w=None, lengths="lengths"):
        return spark.range(1).select(impurity.gini(F.array(*map(F.lit, l)), F.array(*map(F.lit, t)), 2, w, lengths).alias("g")).first().g

    assert gini([0, 0], [3, 4]) == 1.0
    assert gini([3, 0], [3, 4]) == 0.0
    # A side of y = [0, 1, 1] with weights 3 and 1.5 gives 1 - (1 + 1) = -1 when divided by its length.
    assert gini([1, 2], [2, 4], [3.0, 1.5]) == pytest.approx(-1.0)
    assert gini([1, 2], [2, 4], [3.0, 1.5], "weights") == pytest.approx(0.5)


def test_leaves_depth_and_siblings(spark):
    f = forest.train(grid(spark), config.RunConfig(n_bins=7, n_estimators=4, max_depth=4, max_features=2))
    nodes = f.nodes.collect()
    ids = {(n.tree, n.node_id) for n in nodes}
    assert len(ids) == len(nodes)
    assert all((t, i ^ 1) in ids for t, i in ids if i > 1)
    assert max(n.depth for n in nodes if n.is_leaf) <= 3
    assert all((n.value is not None) == n.is_leaf for n in nodes)
    preds = f.predict_trees(grid(spark)).collect()
    assert len(preds) == 4 * 210 and all(p.pred in (0.0, 1.0) for p in preds)
    right = f.predict(grid(spark)).join(grid(spark), ["split", "client", "row_id"])
    assert metrics.accuracy(right).first().accuracy > 0.9


def test_depth_one_is_a_leaf(spark):
    f = forest.train(grid(spark), config.RunConfig(n_bins=4, n_estimators=2, max_depth=1))
    assert [(n.node_id, n.is_leaf) for n in f.nodes.collect()] == [(1, True)] * 2


def test_same_under_repartition(spark):
    c = config.RunConfig(n_bins=4, n_estimators=2, max_depth=3)
    a, b = (sorted(map(tuple, forest.train(x, c).nodes.collect()), key=repr) for x in (grid(spark), grid(spark).repartition(7)))
    assert a == b


def test_min_samples_leaf_collapses_the_parent(spark):
    f = forest.train(grid(spark), config.RunConfig(n_bins=4, n_estimators=1, max_depth=3, min_samples_leaf=1000))
    assert [(n.node_id, n.is_leaf) for n in f.nodes.collect()] == [(1, True)]


def test_regression_uses_all_rows(spark):
    df = rows(spark, [(i % 2, i // 2, [i % 10], 3.0 * (i % 10 > 4)) for i in range(100)])
    f = forest.train(df, config.RunConfig(mode="regression", n_bins=10, n_estimators=3, max_depth=3, max_features=1))
    out = f.predict(df).join(df, ["split", "client", "row_id"]).agg(F.max(F.abs(F.col("pred") - F.col("y"))).alias("e"), F.count("*").alias("n")).first()
    assert out.n == 100 and out.e < 1e-9


def test_oob_weights_sum_to_one(spark):
    f = forest.train(grid(spark), config.RunConfig(n_bins=4, n_estimators=4, max_depth=3, oob=True))
    assert f.trees.agg(F.sum("weight").alias("s")).first().s == pytest.approx(1)


def test_permuted_labels_carry_no_signal(spark):
    df = sampling.shuffle_labels(rows(spark, [(i % 3, i // 3, [i % 7], (i % 7) > 3) for i in range(2100)]), 5)
    f = forest.train(df, config.RunConfig(n_bins=4, n_estimators=5, max_depth=3, max_features=1))
    mcc = metrics.mcc_binary(f.predict(df).join(df, ["split", "client", "row_id"])).first().mcc
    assert abs(mcc) < 0.15


@pytest.mark.parametrize("value, size", [(None, 10), (0.25, 2), (1.0, 10), (1, 1), (0.01, 1)])
def test_sample_sizes(spark, value, size):
    df = rows(spark, [(0, i, [i], 0) for i in range(10)])
    assert sampling.bootstrap(df, 1, 0, value).agg(F.sum("mult").alias("s")).first().s == size


def test_metrics_of_one_class(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, pred double")
    assert metrics.mcc_binary(df).first().mcc == 0 and metrics.mcc_multiclass(df).first().mcc == 0


def test_config_dialects(tmp_path):
    a = tmp_path / "a.yml"
    a.write_text("x:\n  input:\n  - train: t.csv\n  - test: u.csv\n  format:\n  - sep: ;\n  - label_col: z\n  split:\n  - mode: directory\n  - dir: d\n  mode: regression\n  n_bins: 5\n  quantile: '0,1'\n  max_samples: 0.75\n")
    c = config.read_config(str(a))
    assert (c.train, c.sep, c.label, c.split_mode, c.n_bins, c.quantile, c.max_samples, c.oob) == ("t.csv", ";", "z", "directory", 5, (0, 1), 0.75, False)
    b = tmp_path / "b.yaml"
    b.write_text("y:\n  input: {train: t.csv, test: u.csv}\n  format: {sep: ',', label: q}\n  mode: classification\n  n_bins: 3\n")
    assert config.read_config(str(tmp_path / "b.yml")).label == "q"


@pytest.mark.parametrize("wrong", [{"mode": "x"}, {"max_depth": 0}, {"quantile": (-1,)}, {"mode": "regression", "use_weighted_classes": True}, {"split_mode": "zip"}])
def test_config_refuses(wrong):
    with pytest.raises(ValueError):
        config.RunConfig(**wrong)


def test_csv_sites(spark, tmp_path):
    for client in (1, 2):
        for split in ("s1", "s2"):
            d = tmp_path / f"client{client}" / split
            d.mkdir(parents=True)
            (d / "train.csv").write_text("a (cm),target\n" + "".join(f"{client}.{i},{i % 2}\n" for i in range(3)))
    df = tables.read_csv_sites(spark, f"{tmp_path}/client*/*/train.csv", "target")
    assert {(r.split, r.client, r.n) for r in df.groupBy("split", "client").agg(F.count("*").alias("n")).collect()} == {(s, c, 3) for s in ("s1", "s2") for c in (1, 2)}
    tables.require_sites(df)
    with pytest.raises(RuntimeError):
        tables.require_sites(df.filter("client = 1"))


def test_schema_checks(spark):
    good = spark.createDataFrame([(1.0, 1)], "a double, y int")
    tables.check_schema(good, good, "y")
    for bad in (spark.createDataFrame([("x", 1)], "a string, y int"), spark.createDataFrame([(True, 1)], "a boolean, y int"), spark.createDataFrame([(1.0, 2.0, 1)], "a double, b double, y int"), spark.createDataFrame([(1.0,)], "a double")):
        with pytest.raises(ValueError):
            tables.check_schema(good, bad, "y")


def test_synthetic(spark):
    df = tables.synthetic(spark, 50, 3, [0, 1], 3)
    assert df.columns == ["Feature_1", "Feature_2", "Feature_3", "Target"] and {r.Target for r in df.collect()} == {0, 1}


def test_training_refuses_unusable_rows(spark):
    c = config.RunConfig(n_bins=4, n_estimators=1, max_depth=2)
    for bad, why in ((grid(spark).filter("false"), "no training rows"), (grid(spark).withColumn("y", F.when(F.col("row_id") > 3, F.col("y"))), "no label"), (grid(spark).withColumn("features", F.slice("features", 1, F.col("client") + 1)), "features")):
        with pytest.raises(ValueError, match=why):
            forest.train(bad, c)
    with pytest.raises(ValueError, match="classes"):
        forest.train(grid(spark), config.RunConfig(n_bins=4, n_estimators=1, max_classes=1))


def test_each_split_has_its_own_class_weights(spark):
    df = grid(spark).withColumn("split", F.when(F.col("row_id") < 20, "a").otherwise("b"))
    weights = {r.split: r.weights for r in forest.split_weights(df, (0.0, 1.0, 2.0)).collect()}
    for split, w in weights.items():
        n = {r.y: r.n for r in df.filter(F.col("split") == split).groupBy("y").agg(F.count("*").alias("n")).collect()}
        assert w == pytest.approx([sum(n.values()) / n[0.0], sum(n.values()) / n[1.0], 0.0])
    both = forest.train(df, config.RunConfig(n_bins=4, n_estimators=2, max_depth=3, use_weighted_classes=True)).nodes
    assert {r.split for r in both.collect()} == {"a", "b"}


def test_run_of_files(spark, tmp_path):
    for client in (1, 2):
        d = tmp_path / f"client{client}"
        d.mkdir()
        for name, n in (("train.csv", 40), ("test.csv", 10)):
            (d / name).write_text("a,b,target\n" + "".join(f"{i % 7},{i % 5},{int(i % 7 > 3)}\n" for i in range(n)))
    c = config.RunConfig(n_bins=7, n_estimators=3, max_depth=3, max_features=2, oob=True)
    done = run.run(spark, c, str(tmp_path), str(tmp_path / "out"))
    assert done.predictions.count() == 20 and done.forest.weighted
    pred = spark.read.csv(f"{tmp_path}/out/pred.csv", header=True, inferSchema=True)
    truth = spark.read.csv(f"{tmp_path}/out/y_true.csv", header=True, inferSchema=True)
    assert pred.join(truth, ["split", "client", "row_id"]).filter("pred = y_true").count() == 20
    (tmp_path / "client2" / "train.csv").rename(tmp_path / "client2" / "other.csv")
    with pytest.raises(RuntimeError):
        run.run(spark, c, str(tmp_path))


def test_cross_validation(spark):
    got = evaluate.cross_validate(grid(spark), config.RunConfig(n_bins=7, n_estimators=3, max_depth=3, max_features=2), k=2)
    assert {r.split: r.mcc > 0.8 for r in got.collect()} == {"r0-f0": True, "r0-f1": True}


def test_tasks_of_a_sample_grow_in_number_not_in_size(spark, monkeypatch):
    """However few shuffle partitions the session has, draws and rows out of the bag are dealt to as many tasks as their rows need."""
    df = spark.range(1000).select(F.lit("0").alias("split"), (F.col("id") % 3).cast("int").alias("client"), "id")
    rows = portable.settle(portable.dense_number(df, ["split", "client"], portable.draw(F.col("id")), ["id"], "row_id").drop("id"), "rows")
    drawn = lambda: sampling.bootstrap(rows, 2, 1)
    rows_of = lambda d: sorted(map(tuple, d.collect()))
    want = [rows_of(drawn()), rows_of(score.oob_rows(rows, drawn(), 2))]
    monkeypatch.setattr(portable, "ROWS_A_TASK", 50)
    sample = drawn()
    free = score.oob_rows(rows, sample, 2)
    assert sample.rdd.getNumPartitions() >= 40 and free.rdd.getNumPartitions() >= 40
    assert [rows_of(sample), rows_of(free)] == want


def test_tasks_of_a_numbering_grow_in_number_not_in_size(spark, monkeypatch):
    """Rows are dealt once, by their number, and not shuffled again to the session's few partitions; nor are labels on their way to rows."""
    rows_of = lambda d: sorted(map(tuple, d.collect()))
    made = lambda: [tables.lineitem_rows(spark, SF), tables.embedding_rows(spark, SF, 2, F.concat(F.lit("s"), F.col("vec_id") % 2))]
    want = [rows_of(x) for x in made()]
    base = portable.settle(tables.part_rows(spark, SF), "rows")
    moved = lambda: [sampling.shuffle_labels(base, 1), sampling.permute_labels(base, 1), sampling.kfold(base, 3, 1)]
    want += [rows_of(x) for x in moved()]
    monkeypatch.setattr(portable, "ROWS_A_TASK", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = made() + moved()
        assert [rows_of(x) for x in got] == want
        assert all(x.rdd.getNumPartitions() >= 10 for x in got)
        # Of windows over rows none is behind a second shuffle.
        plan = got[0]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].splitlines()
        at = next(i for i, x in enumerate(plan) if "row_number()" in x)
        assert "Sort" in plan[at + 1] and "REPARTITION_BY_NUM" in plan[at + 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
