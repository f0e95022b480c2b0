"""Queries of the engine's own operators, by name, each with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import evaluate
from .. import forest as forests
from .. import run as runs
from ..config import RunConfig
from ..functions import scorer
from ..functions.portable import settle, shared_dir, spread
from ..operators import binning, grow, impurity, metrics, rules, sampling, score
from ..sources import tables
from ..streaming.scoring import score_stream
from . import oracles as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED, BINS, TREES = 11, 10, 3
#: A shallow forest on lineitem; L_FOREST and its SQL have the same settings.
L_FOREST = RunConfig(n_bins=BINS, n_estimators=TREES, max_depth=3, random_state=SEED, max_samples=0.5, min_samples_leaf=20)
E_FOREST = RunConfig(n_bins=4, n_estimators=TREES, max_depth=3, random_state=SEED)
P_FOREST = RunConfig(mode="regression", n_bins=5, n_estimators=TREES, max_depth=3, random_state=SEED, max_features=2, quantile=())
L_CLASSES = (0.0, 1.0, 2.0)
_L_SQL = o.forest(o.L_ROWS, BINS, 4, TREES, 2, SEED, 2, 3, min_leaf=20, m="greatest(round_even(n * 0.5, 0)::BIGINT, 1)")
_E_SQL = o.forest(o.E_ROWS, 4, 64, TREES, 8, SEED, 2, 10)
_P_SQL = o.forest(o.P_ROWS, 5, 2, TREES, 2, SEED, 2, None)
_PICK = ", ".join(f"f[{i + 1}] AS f{i}" for i in range(4))
_L_QUANTILE = (0, 1)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def r6(c: str):
    return F.round(c, 6).alias(c)


def L(spark, d) -> DataFrame:
    """The test tables' rows are settled: numbering them costs a shuffle and a sort, and most queries read them several times."""
    return settle(tables.lineitem_rows(spark, d), "rows")


def E(spark, d) -> DataFrame:
    return settle(tables.embedding_rows(spark, d), "rows")


def P(spark, d) -> DataFrame:
    return settle(tables.part_rows(spark, d), "rows")


def columns_of(arrays: DataFrame, name: str, prefix: str, n: int = 4) -> list:
    return [F.get(name, F.lit(i)).alias(f"{prefix}{i}") for i in range(n)]


@query(o.with_(o.L_ROWS, select=f"SELECT split, client, row_id, y, {_PICK} FROM rows"))
def scan_rows(spark, d):
    return L(spark, d).select("split", "client", "row_id", "y", *columns_of(None, "features", "f"))


@query("SELECT * EXCLUDE (l_returnflag) FROM lineitem")
def drop_label(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").drop("l_returnflag")


@query(o.with_(o.E_ROWS, select="SELECT client, row_id, i::INTEGER AS feature, round(f[i + 1], 6) AS x FROM rows, range(64) t(i)"))
def wide_to_long(spark, d):
    return binning.long_view(E(spark, d)).select("client", "row_id", "feature", r6("x"))


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL OR isnan({c}))::BIGINT AS {c}" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + " FROM lineitem")
def validate_numeric(spark, d):
    return tables.count_missing(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("SELECT * FROM (VALUES ('same', NULL), ('text', 'train: column p_name is not numeric'), ('width', 'train and test differ in their number of features'), ('no label', 'test: the label column must occur exactly once')) t(pair, refused)")
def validate_schema(spark, d):
    """For pairs of tables, whether they may train and test one forest, and why not."""
    part, lines = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("part", "lineitem"))
    sizes = part.select("p_partkey", "p_size")
    pairs = {"same": (sizes, sizes), "text": (part, part), "width": (sizes, part.select("p_partkey", "p_size", "p_retailprice")), "no label": (sizes, lines.select("l_tax", "l_discount"))}

    def why(train: DataFrame, test: DataFrame) -> str | None:
        try:
            tables.check_schema(train, test, "p_size")
        except ValueError as refused:
            return str(refused)

    return spark.createDataFrame([(name, why(*pair)) for name, pair in pairs.items()], "pair string, refused string")


@query(o.with_(o.E_ROWS, select="SELECT client, count(*) AS n, count(*) FILTER (WHERE y IS NULL OR isnan(y)) AS no_label, count(*) FILTER (WHERE y < 0 OR y <> floor(y)) AS no_class, count(*) FILTER (WHERE len(list_filter(f, lambda x: x IS NULL OR isnan(x))) > 0) AS missing, count(*) FILTER (WHERE len(list_filter(f, lambda x: isinf(x))) > 0) AS infinite, min(len(f))::INTEGER AS least_features, max(len(f))::INTEGER AS most_features FROM rows GROUP BY client"))
def validate_rows(spark, d):
    """Each site's rows that training would refuse or treat as missing."""
    return tables.row_faults(E(spark, d))


_T = o.draw(str(SEED), "'t'", "client", "row_id")
_K = o.draw(str(SEED), "'k'", "'0'", "client", "row_id")
_C = o.draw(str(SEED), "'c'", "client", "row_id")
_LH = o.draw(str(SEED), "'l'", "client", "row_id")


@query(o.with_(o.L_ROWS, select=f"SELECT client, row_id, CASE WHEN {_T} < {int(0.25 * (1 << 32))} THEN 'test' ELSE 'train' END AS role FROM rows"))
def split_train_test(spark, d):
    return sampling.train_test(L(spark, d), 0.25, SEED).select("client", "row_id", "role")


@query(o.with_(o.L_ROWS, select=f"SELECT client, row_id, ((row_number() OVER (ORDER BY {_K}, client, row_id) - 1) % 10)::INTEGER AS fold FROM rows"))
def kfold_assign(spark, d):
    return sampling.kfold(L(spark, d), 10, SEED).select("client", "row_id", "fold")


@query(o.with_(o.L_ROWS, select=f"SELECT client, row_id, floor((row_number() OVER (ORDER BY {_C}, client, row_id) - 1) * 3 / count(*) OVER ())::INTEGER AS dealt FROM rows"))
def client_partition(spark, d):
    return sampling.deal_clients(L(spark, d), 3, SEED).select("client", "row_id", "dealt")


@query(o.with_(o.L_ROWS, f"s AS (SELECT client, y, row_number() OVER (PARTITION BY client ORDER BY {_LH}, row_id) - 1 AS row_id FROM rows)", select="SELECT client, row_id, y FROM s"))
def label_shuffle(spark, d):
    return sampling.shuffle_labels(L(spark, d), SEED).select("client", "row_id", "y")


_HALF = lambda half, x: o.draw(str(SEED), "'y'", "split", "client", f"'{half}'", x)


def _walk(x: str) -> str:
    """SQL: one walk from the expression x, as ``SELECT split, client, i, n, a, b, x FROM`` its source ``src``."""
    return f"""SELECT split, client, i, n, a, b, (l2 * b + (r1 + {_HALF(3, "l2")}) % b)::BIGINT AS x FROM (SELECT *, (l1 + {_HALF(2, "r1")}) % a AS l2 FROM (SELECT *, (r + {_HALF(1, "l1")}) % b AS r1 FROM (
      SELECT *, (l + {_HALF(0, "r")}) % a AS l1 FROM (SELECT *, {x} // b AS l, {x} % b AS r FROM src))))"""


@query(o.with_(o.L_ROWS, "z AS (SELECT split, client, count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM rows GROUP BY ALL)", f"""p AS (WITH RECURSIVE t(split, client, i, n, a, b, x) AS (
  {_walk("i").replace("FROM src", "FROM (SELECT r.split, r.client, row_id AS i, n, a, ceil(n / a)::BIGINT AS b FROM rows r JOIN z ON r.split = z.split AND r.client = z.client) q")}
  UNION ALL {_walk("x").replace("SELECT *, x //", "SELECT * EXCLUDE (x), x //").replace("FROM src", "FROM t WHERE x >= n")}) SELECT * FROM t WHERE x < n)""", select="SELECT p.client, p.x AS row_id, r.y FROM p JOIN rows r ON r.client = p.client AND r.row_id = p.i"))
def label_permutation(spark, d):
    """Labels moved by a keyed permutation of the row numbers."""
    return sampling.permute_labels(L(spark, d), SEED).select("client", "row_id", "y")


@query(o.with_(o.L_ROWS, o.moments(4), select="SELECT client, feature, n, round(sxx, 3) AS sxx, round(sx, 3) AS sx FROM part"))
def moments_partial(spark, d):
    return binning.moments_partial(L(spark, d)).select("client", "feature", "n", F.round("sxx", 3).alias("sxx"), F.round("sx", 3).alias("sx"))


@query("SELECT (l_orderkey % 3)::INTEGER AS client, feature::INTEGER AS feature, count(*) AS n, fsum(x * x) AS sxx, fsum(x) AS sx FROM (SELECT l_orderkey, unnest([0, 1, 2, 3]) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem) GROUP BY ALL")
def moments_exact(spark, d):
    """The sums to their last bit, against compensated sums: both are the exact sum, rounded once."""
    return binning.moments_partial(L(spark, d)).select("client", "feature", "n", "sxx", "sx")


@query(o.with_(o.L_ROWS, o.moments(4), select="SELECT feature, round(mean, 5) AS mean, round(sd, 5) AS stddev FROM stats"))
def moments_global(spark, d):
    return binning.moments_global(binning.moments_partial(L(spark, d))).select("feature", F.round("mean", 5).alias("mean"), F.round("stddev", 5).alias("stddev"))


@query(o.with_(o.L_ROWS, select="SELECT client, i::INTEGER AS feature, min(f[i + 1]) AS mn, max(f[i + 1]) AS mx FROM rows, range(4) t(i) GROUP BY client, i"))
def minmax_partial(spark, d):
    return binning.minmax_partial(L(spark, d)).select("client", "feature", "mn", "mx")


@query(o.with_(o.L_ROWS, o.edges(4, BINS), select="SELECT feature, mn, mx FROM mm"))
def minmax_global(spark, d):
    return binning.minmax_global(binning.minmax_partial(L(spark, d))).select("feature", "mn", "mx")


@query(o.with_(o.L_ROWS, o.edges(4, BINS), select=f"SELECT feature, i::INTEGER AS bin, round(e[i + 1], 6) AS edge FROM edges, range({BINS}) t(i)"))
def bucket_edges(spark, d):
    edges = binning.bucket_edges(binning.minmax_global(binning.minmax_partial(L(spark, d))), BINS)
    return edges.select("feature", F.posexplode("edges").alias("bin", "edge")).select("feature", "bin", r6("edge"))


def binned(rows: DataFrame, n_bins: int, quantile: tuple[int, ...] = ()) -> DataFrame:
    return binning.bin_batches(rows, binning.edge_table(rows, n_bins, quantile), n_bins)


_BINS4 = ", ".join(f"bins[{i + 1}] AS b{i}" for i in range(4))


@query(o.with_(o.L_ROWS, o.binned(4, BINS), select=f"SELECT client, row_id, {_BINS4} FROM binned"))
def bucket_bins(spark, d):
    return binned(L(spark, d), BINS).select("client", "row_id", *columns_of(None, "bins", "b"))


@query(o.with_(o.L_ROWS, o.binned(4, 1000), select=f"SELECT client, row_id, {_BINS4} FROM binned"))
def bucket_bins_fine(spark, d):
    """A thousand edges a feature, searched by halving."""
    return binned(L(spark, d), 1000).select("client", "row_id", *columns_of(None, "bins", "b"))


_Z = "CASE WHEN sd <> 0 THEN (f[feature + 1] - mean) / sd ELSE 0 END"


@query(o.with_(o.L_ROWS, o.moments(4), select=f"SELECT client, row_id, feature, round({_Z}, 4) AS z FROM rows, stats"))
def zscore(spark, d):
    rows = L(spark, d)
    stats = binning.moments_global(binning.moments_partial(rows))
    return binning.long_view(rows).join(F.broadcast(stats), ["split", "feature"]).select("client", "row_id", "feature", F.round(binning.zscore(F.col("x"), F.col("mean"), F.col("stddev")), 4).alias("z"))


_QBINS = ", ".join(f"max(len(list_filter({o.quantile_list(BINS)}, lambda v: v <= {_Z}))) FILTER (WHERE feature = {i})::INTEGER AS b{i}" for i in range(4))
_MIXED = ", ".join([f"max(len(list_filter({o.quantile_list(BINS)}, lambda v: v <= {_Z}))) FILTER (WHERE s.feature = {i})::INTEGER AS b{i}" for i in _L_QUANTILE] + [f"max(len(list_filter(e, lambda v: v <= f[{i + 1}]))) FILTER (WHERE s.feature = {i})::INTEGER - 1 AS b{i}" for i in (2, 3)]).replace("f[feature + 1]", "f[s.feature + 1]")


@query(o.with_(o.L_ROWS, o.moments(4), select=f"SELECT client, row_id, {_QBINS} FROM rows, stats GROUP BY client, row_id"))
def quantile_bins(spark, d):
    return binned(L(spark, d), BINS, (0, 1, 2, 3)).select("client", "row_id", *columns_of(None, "bins", "b"))


@query(o.with_(o.L_ROWS, o.moments(4), o.edges(4, BINS), select=f"SELECT client, row_id, {_MIXED} FROM rows, stats s JOIN edges e2 ON s.feature = e2.feature GROUP BY client, row_id"))
def combined_bins(spark, d):
    return binned(L(spark, d), BINS, _L_QUANTILE).select("client", "row_id", *columns_of(None, "bins", "b"))


@query(o.with_(o.L_ROWS, select="SELECT DISTINCT y FROM rows"))
def classes_distinct(spark, d):
    return L(spark, d).select("y").distinct()


@query(o.with_(o.L_ROWS, select="SELECT client, y, count(*) AS n FROM rows GROUP BY client, y"))
def class_freq(spark, d):
    return metrics.class_frequency(L(spark, d)).select("client", "y", "n")


@query(o.with_(o.L_ROWS, select="SELECT y, round(sum(count(*)) OVER () / count(*), 6)::DOUBLE AS weight FROM rows GROUP BY y"))
def class_weights(spark, d):
    return metrics.class_weights(L(spark, d)).select("y", r6("weight"))


@query(o.with_(o.features(5, 64, 8, SEED), select="SELECT tree, pos, feature FROM tf"))
def feature_subset(spark, d):
    """Features of as many as the table's rows have."""
    return sampling.feature_subset(spark, 5, forests.check_rows(E(spark, d)), 8, SEED)


@query(o.with_(o.L_ROWS, o.bootstrap(TREES, SEED), select="SELECT client, tree, row_id, mult FROM sample"))
def bootstrap_with(spark, d):
    return sampling.bootstrap(L(spark, d), TREES, SEED).select("client", "tree", "row_id", "mult")


_P = o.draw(str(SEED), "'p'", "'0'", "client", "t.i", "row_id")


@query(o.with_(o.L_ROWS, f"r AS (SELECT client, t.i::INTEGER AS tree, row_id, len(list_filter({sampling.poisson_steps(0.7)}, lambda s: s <= {_P}))::BIGINT AS mult FROM rows, range({TREES}) t(i))", select="SELECT client, tree, row_id, mult FROM r WHERE mult > 0"))
def bootstrap_poisson(spark, d):
    """Each row's own copies, drawn without a shuffle."""
    drawn = sampling.poisson_bootstrap(L(spark, d), TREES, SEED, 0.7)
    return drawn.select("client", "row_id", F.explode("sample").alias("s")).select("client", F.col("s.tree").alias("tree"), "row_id", F.col("s.mult").alias("mult"))


_S = o.draw(str(SEED), "'s'", "'0'", "client", "t.i", "row_id")


@query(o.with_(o.L_ROWS, "z AS (SELECT client, greatest(round_even(count(*) * 0.3, 0)::BIGINT, 1) AS m FROM rows GROUP BY client)", f"r AS (SELECT client, t.i::INTEGER AS tree, row_id, row_number() OVER (PARTITION BY client, t.i ORDER BY {_S}, row_id) - 1 AS nth FROM rows, range({TREES}) t(i))", select="SELECT r.client, tree, row_id, 1::BIGINT AS mult FROM r JOIN z ON r.client = z.client WHERE nth < m"))
def bootstrap_without(spark, d):
    return sampling.bootstrap(L(spark, d), TREES, SEED, 0.3, replace=False).select("client", "tree", "row_id", "mult")


def whole_root(spark: SparkSession, rows: DataFrame, n_bins: int, p: int) -> tuple[DataFrame, DataFrame]:
    """Every row once in the root of one tree that uses all features in order."""
    sample = rows.select("split", "client", "row_id", F.lit(0).alias("tree"), F.lit(1).cast("bigint").alias("mult"))
    features = spark.range(p).select(F.lit(0).alias("tree"), F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("feature"))
    return grow.initial_assign(binned(rows, n_bins), sample), features


_ROOT = lambda rows, p, n_bins, k, weights=None, min_leaf=1, lengths="lengths": ",\n".join([rows, o.binned(p, n_bins), f"tf AS (SELECT 0 AS tree, i::INTEGER AS pos, i::INTEGER AS feature FROM range({p}) t(i))", "a1 AS MATERIALIZED (SELECT client, 0 AS tree, 1::BIGINT AS node, 1::BIGINT AS mult, bins, y FROM binned)", o.level(1, n_bins, k, 2, min_leaf, weights, lengths)])
_L_ROOT = _ROOT(o.L_ROWS, 4, BINS, 3)
_P_ROOT = _ROOT(o.P_ROWS, 2, 5, None)
_WEIGHTS = [3.0, 1.5, 2.0]


def l_root(spark, d) -> DataFrame:
    assign, features = whole_root(spark, L(spark, d), BINS, 4)
    return impurity.cumulative(impurity.histogram(assign, features), BINS, list(L_CLASSES))


def p_root(spark, d) -> DataFrame:
    assign, features = whole_root(spark, P(spark, d), 5, 2)
    return impurity.cumulative(impurity.histogram(assign, features), 5, None)


@query(o.with_(_L_ROOT, select="SELECT client, feature, bins[feature + 1] AS bin, y, count(*) AS n FROM a1, tf GROUP BY client, feature, bins[feature + 1], y"))
def histogram(spark, d):
    assign, features = whole_root(spark, L(spark, d), BINS, 4)
    return impurity.histogram(assign, features).select("client", "feature", "bin", "y", "n")


@query(o.with_(_L_ROOT, select="SELECT client, feature, thr, round(score, 6) AS score FROM s1"))
def gini_local(spark, d):
    return impurity.local_scores(l_root(spark, d), BINS, list(L_CLASSES)).select("client", "feature", "thr", r6("score"))


@query(o.with_(_ROOT(o.L_ROWS, 4, BINS, 3, _WEIGHTS), select="SELECT client, feature, thr, round(score, 6) AS score FROM s1"))
def gini_weighted(spark, d):
    return impurity.local_scores(l_root(spark, d), BINS, list(L_CLASSES), _WEIGHTS).select("client", "feature", "thr", r6("score"))


@query(o.with_(_ROOT(o.L_ROWS, 4, BINS, 3, _WEIGHTS, lengths="weights"), select="SELECT client, feature, thr, round(score, 6) AS score FROM s1"))
def gini_weighted_counts(spark, d):
    """The documented form: sides divided by their weighted counts."""
    return impurity.local_scores(l_root(spark, d), BINS, list(L_CLASSES), _WEIGHTS, "weights").select("client", "feature", "thr", r6("score"))


@query(o.with_(_P_ROOT, select="SELECT client, feature, thr, round(score, 4) AS score FROM s1"))
def mse_local(spark, d):
    return impurity.local_scores(p_root(spark, d), 5, None).select("client", "feature", "thr", F.round("score", 4).alias("score"))


_PARENT = "(t2 / t0 - (t1 / t0) * (t1 / t0))"


@query(o.with_(_P_ROOT, select=f"SELECT client, feature, thr, round(CASE WHEN l0 = 0 OR l0 = t0 THEN {_PARENT} ELSE {_PARENT} - ({o.score_sql(None)}) END, 4) AS score FROM h1"))
def mse_reduction(spark, d):
    return impurity.local_scores(p_root(spark, d), 5, None, compat_min_reduction=True).select("client", "feature", "thr", F.round("score", 4).alias("score"))


@query(o.with_(_L_ROOT, select="SELECT feature, thr, round(score, 6) AS score FROM g1"))
def split_scores_global(spark, d):
    return impurity.global_scores(impurity.local_scores(l_root(spark, d), BINS, list(L_CLASSES))).select("feature", "thr", r6("score"))


@query(o.with_(_L_ROOT, select="SELECT pos, feature, thr, round(score, 6) AS score FROM b1"))
def best_split_root(spark, d):
    scores = impurity.global_scores(impurity.local_scores(l_root(spark, d), BINS, list(L_CLASSES)))
    return impurity.best_splits(scores).select("pos", "feature", "thr", r6("score"))


def l_decisions(spark, d, g: grow.Growth | None = None) -> DataFrame:
    g = g or grow.Growth(BINS, 3, classes=L_CLASSES)
    cum = settle(l_root(spark, d), "cumulative")
    best = impurity.best_splits(impurity.global_scores(impurity.local_scores(cum, BINS, list(L_CLASSES))))
    return grow.decide(grow.child_stats(cum, best, g), g)


@query(o.with_(_L_ROOT, select="SELECT a.client, 2 + (bins[feature + 1] > thr)::BIGINT AS node_id, count(*) AS n FROM a1 a, b1 GROUP BY ALL"))
def child_assign(spark, d):
    assign, features = whole_root(spark, L(spark, d), BINS, 4)
    assign = settle(assign, "assign")
    cum = impurity.cumulative(impurity.histogram(assign, features), BINS, list(L_CLASSES))
    best = impurity.best_splits(impurity.global_scores(impurity.local_scores(cum, BINS, list(L_CLASSES)))).select("split", "tree", "feature", "thr")
    node = F.col("node_id") * 2 + (F.get("bins", F.col("feature")) > F.col("thr")).cast("bigint")
    return assign.join(F.broadcast(best), ["split", "tree"]).groupBy("client", node.alias("node_id")).agg(F.count("*").alias("n"))


@query(o.with_(_L_ROOT, select="SELECT ln AS left_n, li AS left_impure, rn AS right_n, ri AS right_impure FROM n1"))
def child_stats(spark, d):
    return l_decisions(spark, d).select(F.col("left.n").alias("left_n"), F.col("left.impure").cast("bigint").alias("left_impure"), F.col("right.n").alias("right_n"), F.col("right.impure").cast("bigint").alias("right_impure"))


@query(o.with_(_L_ROOT, select="SELECT a.client, 2 + (bins[feature + 1] > thr)::BIGINT AS node_id, count(DISTINCT y) <= 1 AS pure FROM a1 a, b1 GROUP BY ALL"))
def local_purity(spark, d):
    """Whether each child of the root has one label at most, site by site."""
    cum = settle(l_root(spark, d), "cumulative")
    best = impurity.best_splits(impurity.global_scores(impurity.local_scores(cum, BINS, list(L_CLASSES))))
    own = cum.join(best.select(*grow.TREE_NODE, "pos", "thr"), [*grow.TREE_NODE, "pos"]).withColumn("l", F.get("left", F.col("thr")))
    sides = F.array(F.struct(F.lit(2).cast("bigint").alias("node_id"), F.col("l").alias("n")), F.struct(F.lit(3).cast("bigint").alias("node_id"), F.zip_with("total", "l", lambda t, x: t - x).alias("n")))
    return own.select("client", F.explode(sides).alias("s")).select("client", F.col("s.node_id").alias("node_id"), impurity.pure(F.col("s.n"), list(L_CLASSES)).alias("pure"))


@query(o.with_(_ROOT(o.L_ROWS, 4, BINS, 3, min_leaf=100), select="SELECT leaf AS is_leaf, lleaf AS left_leaf, rleaf AS right_leaf FROM n1"))
def stopping_rules(spark, d):
    return l_decisions(spark, d, grow.Growth(BINS, 3, min_samples_leaf=100, classes=L_CLASSES)).select("is_leaf", "left_leaf", "right_leaf")


@query(o.with_(_L_ROOT, select="SELECT lv AS left_value, rv AS right_value, tv AS value FROM n1"))
def leaf_class(spark, d):
    return l_decisions(spark, d).select(F.col("left.value").alias("left_value"), F.col("right.value").alias("right_value"), "value")


@query(o.with_(_P_ROOT, select="SELECT round(lv, 4) AS left_value, round(rv, 4) AS right_value, round(tv, 4) AS value FROM n1"))
def leaf_mean(spark, d):
    g = grow.Growth(5, 3)
    cum = settle(p_root(spark, d), "cumulative")
    best = impurity.best_splits(impurity.global_scores(impurity.local_scores(cum, 5, None)))
    return grow.child_stats(cum, best, g).select(F.round("left.value", 4).alias("left_value"), F.round("right.value", 4).alias("right_value"), F.round("value", 4).alias("value"))


_NODES = "SELECT tree, node_id, depth, feature, thr, round(score, 4) AS score, is_leaf, round(value, 4) AS value FROM nodes"


def node_view(nodes: DataFrame, *more: str) -> DataFrame:
    return nodes.select(*more, "tree", "node_id", "depth", "feature", "thr", F.round("score", 4).alias("score"), "is_leaf", F.round("value", 4).alias("value"))


@query(o.with_(_L_SQL, select=_NODES + " WHERE tree = 0"))
def tree_depth3(spark, d):
    return node_view(forests.train(L(spark, d), L_FOREST).nodes).filter("tree = 0")


@query(o.with_(_L_SQL, select=_NODES))
def forest_depth3(spark, d):
    return node_view(forests.train(L(spark, d), L_FOREST).nodes)


@query(o.with_(_E_SQL, select=_NODES))
def forest_multiclass(spark, d):
    return node_view(forests.train(E(spark, d), E_FOREST).nodes)


@query(o.with_(_P_SQL, select=_NODES))
def forest_regression(spark, d):
    return node_view(forests.train(P(spark, d), P_FOREST).nodes)


_FOLDS = " UNION ALL ".join(f"SELECT *, 'fold{f}' AS split FROM ({o.with_(o.forest(o.e_rows(f'fold{f}', f'vec_id % 2 = {f}'), 4, 64, TREES, 8, SEED, 2, 10, split=f'fold{f}'), select=_NODES)})" for f in (0, 1))


@query(_FOLDS)
def forest_multi_split(spark, d):
    """Two splits of different rows, fitted together, each by its own edges, draws and nodes."""
    rows = settle(tables.embedding_rows(spark, d, split=F.concat(F.lit("fold"), (F.col("vec_id") % 2).cast("string"))), "rows")
    return node_view(forests.train(rows, E_FOREST).nodes, "split")


_CW = "cw AS MATERIALIZED (SELECT " + ", ".join(f"max(CASE WHEN y = {c} THEN w END) AS w{c}" for c in range(3)) + " FROM (SELECT y, sum(count(*)) OVER () / count(*)::DOUBLE AS w FROM rows GROUP BY y))"
_W_SQL = o.forest(o.L_ROWS + ",\n" + _CW, BINS, 4, TREES, 2, SEED, 2, 3, min_leaf=20, m="greatest(round_even(n * 0.5, 0)::BIGINT, 1)", weights=[f"(SELECT w{c} FROM cw)" for c in range(3)])


@query(o.with_(_W_SQL, select=_NODES))
def forest_weighted(spark, d):
    return node_view(forests.train(L(spark, d), replace(L_FOREST, use_weighted_classes=True)).nodes)


def l_trained(spark, d) -> tuple[DataFrame, forests.Forest]:
    rows = L(spark, d)
    return rows, forests.train(rows, L_FOREST)


@query(o.with_(_L_SQL, o.predictions(2), select="SELECT client, row_id, tree, pred FROM preds"))
def predict_trees(spark, d):
    rows, forest = l_trained(spark, d)
    return forest.predict_trees(rows).select("client", "row_id", "tree", "pred")


_RULES = f"""up AS (SELECT * FROM (WITH RECURSIVE u(tree, leaf, value, node, step, bit) AS (SELECT tree, node_id, value, node_id // 2, 0, node_id % 2 FROM nodes WHERE is_leaf
  UNION ALL SELECT tree, leaf, value, node // 2, step + 1, node % 2 FROM u WHERE node > 0) SELECT * FROM u))"""


@query(o.with_(_L_SQL, _RULES, select="SELECT u.tree, leaf AS node_id, max(u.value) AS value, n.feature, max(CASE WHEN bit = 1 THEN thr END) AS low, min(CASE WHEN bit = 0 THEN thr END) AS high FROM up u JOIN nodes n ON u.tree = n.tree AND u.node = n.node_id GROUP BY u.tree, leaf, n.feature"))
def leaf_rules(spark, d):
    """Each leaf as intervals of bins, one a feature on its path."""
    _, forest = l_trained(spark, d)
    found = rules.leaf_rules(forest.nodes, forest.depth)
    return found.select("tree", "node_id", "value", F.explode("rule").alias("r")).select("tree", "node_id", "value", "r.feature", "r.low", "r.high")


_MAJORITY = "maj AS (SELECT client, row_id, y, pred FROM preds GROUP BY client, row_id, y, pred QUALIFY row_number() OVER (PARTITION BY client, row_id ORDER BY count(*) DESC, pred) = 1)"


@query(o.with_(_L_SQL, o.predictions(2), _MAJORITY, select="SELECT client, row_id, pred FROM maj"))
def vote_majority(spark, d):
    rows, forest = l_trained(spark, d)
    return forest.predict(rows).select("client", "row_id", "pred")


@query(o.with_(_L_SQL, o.predictions(2), _MAJORITY, select="SELECT client, row_id, pred FROM maj"))
def sql_predict(spark, d):
    """The forest called from SQL as a table function."""
    rows, forest = l_trained(spark, d)
    scorer.register_scorer(forest, "grovelight_predict")
    return spark.sql("SELECT client, row_id, pred FROM grovelight_predict(TABLE(SELECT split, client, row_id, features FROM {rows}))", rows=rows)


_OOB = f"""oob AS (SELECT client, tree, row_id FROM (SELECT client, t.i::INTEGER AS tree, row_id FROM rows, range({TREES}) t(i)) x ANTI JOIN sample s USING (client, tree, row_id)),
acc AS (SELECT p.tree, 1 - sum((pred <> y)::INTEGER)::DOUBLE / (SELECT count(*) FROM rows) AS accuracy FROM preds p JOIN oob USING (client, tree, row_id) GROUP BY p.tree),
tw AS (SELECT tree, accuracy, accuracy / sum(accuracy) OVER () AS weight FROM acc)"""


@query(o.with_(_L_SQL, o.predictions(2), _OOB, "v AS (SELECT client, row_id, pred, list_reduce(list(weight ORDER BY p.tree), lambda a, b: a + b) AS s FROM preds p JOIN tw USING (tree) GROUP BY client, row_id, pred)", select="SELECT client, row_id, pred FROM v QUALIFY row_number() OVER (PARTITION BY client, row_id ORDER BY s DESC, pred) = 1"))
def vote_weighted(spark, d):
    rows = L(spark, d)
    return forests.train(rows, replace(L_FOREST, oob=True)).predict(rows).select("client", "row_id", "pred")


@query(o.with_(_P_SQL, o.predictions(2), select=f"SELECT client, row_id, round(list_reduce(list(pred ORDER BY tree), lambda a, b: a + b) / {TREES}, 4) AS pred FROM preds GROUP BY client, row_id"))
def vote_mean(spark, d):
    rows = P(spark, d)
    return forests.train(rows, P_FOREST).predict(rows).select("client", "row_id", F.round("pred", 4).alias("pred"))


@query(o.with_(_L_SQL, o.predictions(2), _OOB, select="SELECT client, tree, row_id FROM oob"))
def oob_rows(spark, d):
    rows = L(spark, d)
    return score.oob_rows(rows, sampling.bootstrap(rows, TREES, SEED, 0.5), TREES).select("client", "tree", "row_id")


@query(o.with_(_L_SQL, o.predictions(2), _OOB, select="SELECT tree, round(accuracy, 6) AS accuracy, round(weight, 6) AS weight FROM tw"))
def tree_weights(spark, d):
    return forests.train(L(spark, d), replace(L_FOREST, oob=True)).trees.select("tree", r6("accuracy"), r6("weight"))


@query(o.with_(_L_SQL, o.predictions(2), _OOB, select="SELECT p.tree, round(1 - sum((pred <> y)::INTEGER)::DOUBLE / count(*), 6) AS accuracy FROM preds p JOIN oob USING (client, tree, row_id) GROUP BY p.tree"))
def oob_accuracy(spark, d):
    """Errors divided by the out-of-bag rows themselves."""
    return forests.train(L(spark, d), replace(L_FOREST, oob=True, oob_denominator="oob")).trees.select("tree", r6("accuracy"))


def l_pairs(spark, d) -> DataFrame:
    rows, forest = l_trained(spark, d)
    return spread(forest.predict(rows), rows.count(), *score.KEY).join(rows, score.KEY).select("y", "pred")


@query(o.with_(_L_SQL, o.predictions(2), _MAJORITY, select="SELECT y, pred, count(*) AS n FROM maj GROUP BY y, pred"))
def confusion(spark, d):
    return metrics.confusion(l_pairs(spark, d))


@query(o.with_(_L_SQL, o.predictions(2), _MAJORITY, select="SELECT round(avg((y = pred)::INTEGER), 6) AS accuracy FROM maj"))
def accuracy(spark, d):
    return metrics.accuracy(l_pairs(spark, d)).select(r6("accuracy"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1)::DOUBLE AS tp, count(*) FILTER (WHERE quality = 0 AND toxic = 0)::DOUBLE AS tn,
  count(*) FILTER (WHERE quality = 0 AND toxic = 1)::DOUBLE AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0)::DOUBLE AS fn FROM labels)
SELECT CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN round((tp * tn - fp * fn) / (sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)), 6) ELSE 0.0::DOUBLE END AS mcc FROM c""")
def mcc_binary(spark, d):
    return metrics.mcc_binary(spark.read.parquet(f"{d}/labels.parquet"), "quality", "toxic").select(r6("mcc"))


@query(o.with_(_L_SQL, o.predictions(2), _MAJORITY, """t AS (SELECT y, count(*)::DOUBLE AS t FROM maj GROUP BY y), p AS (SELECT pred, count(*)::DOUBLE AS p FROM maj GROUP BY pred),
m AS (SELECT sum(coalesce(t, 0) * coalesce(p, 0)) AS tp, sum(coalesce(t, 0) * coalesce(t, 0)) AS tt, sum(coalesce(p, 0) * coalesce(p, 0)) AS pp FROM t FULL JOIN p ON t.y = p.pred),
s AS (SELECT count(*)::DOUBLE AS s, count(*) FILTER (WHERE y = pred)::DOUBLE AS c FROM maj)""", select="SELECT CASE WHEN s * s - pp > 0 AND s * s - tt > 0 THEN round((c * s - tp) / (sqrt(s * s - pp) * sqrt(s * s - tt)), 6) ELSE 0.0::DOUBLE END AS mcc FROM m, s"))
def mcc_multiclass(spark, d):
    return metrics.mcc_multiclass(l_pairs(spark, d)).select(r6("mcc"))


_TF = o.features(TREES, 64, 8, SEED)


@query(o.with_(_TF, select=f"SELECT t.i::INTEGER AS tree, g.i::INTEGER AS feature FROM range({TREES}) t(i), range(64) g(i) WHERE NOT EXISTS (SELECT 1 FROM tf WHERE tf.tree = t.i AND tf.feature = g.i)"))
def set_difference(spark, d):
    """The features that a tree doesn't use."""
    n = forests.check_rows(E(spark, d))
    every = F.explode(F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.collect_list("feature"))).alias("feature")
    return sampling.feature_subset(spark, TREES, n, 8, SEED).groupBy("tree").agg(every)


@query(o.with_(o.E_ROWS, select="SELECT DISTINCT y FROM rows"))
def set_union(spark, d):
    """The classes of all sites."""
    return E(spark, d).groupBy("client").agg(F.collect_set("y").alias("ys")).agg(F.array_distinct(F.flatten(F.collect_list("ys"))).alias("ys")).select(F.explode("ys").alias("y"))


@query(o.with_(o.L_ROWS, o.bootstrap(1, SEED), select="SELECT client, row_id FROM rows ANTI JOIN sample USING (client, row_id)"))
def anti_members(spark, d):
    rows = L(spark, d)
    return rows.join(sampling.bootstrap(rows, 1, SEED), ["split", "client", "row_id"], "left_anti").select("client", "row_id")


def scratch(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/scratch-{uuid.uuid4().hex}"


@query(o.with_(o.L_ROWS, select="SELECT y AS y_true FROM rows"))
def write_read_roundtrip(spark, d):
    rows = L(spark, d)
    tables.write_truth(rows, path := scratch(rows), ";")
    return spark.read.csv(path, header=True, sep=";", schema="y_true double")


@query(o.with_(_L_SQL, o.predictions(2), _MAJORITY, select="SELECT client, row_id, pred FROM maj"))
def model_roundtrip(spark, d):
    rows, forest = l_trained(spark, d)
    forest.save(path := scratch(rows))
    return forests.Forest.load(spark, path).predict(rows).select("client", "row_id", "pred")


@query(o.with_(_L_SQL, o.predictions(2), _MAJORITY, select="SELECT client, row_id, pred FROM maj"))
def stream_score(spark, d):
    rows, forest = l_trained(spark, d)
    rows.write.parquet(source := scratch(rows))
    stream = spark.readStream.schema(rows.schema).parquet(source)
    target = scratch(rows)
    run = score_stream(stream, forest).writeStream.format("parquet").option("path", target).option("checkpointLocation", scratch(rows)).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(target).select("client", "row_id", "pred")


_CSV = "(p_partkey % 2 + 1)::INTEGER AS client, 'fold' || (p_partkey // 2 % 2) AS split, p_size::DOUBLE AS a, (p_partkey % 50)::DOUBLE AS b, (floor(p_retailprice) % 3)::DOUBLE AS y, p_partkey % 5 = 0 AS is_test FROM part"
_NUMBERED = f"row_number() OVER (PARTITION BY client ORDER BY {o.draw('a::VARCHAR', 'b::VARCHAR', 'y::VARCHAR').replace(chr(39) + '|' + chr(39), chr(39) + ',' + chr(39))}, a, b, y) - 1 AS row_id, [a, b] AS f"


def csv_sites(spark, d, ordered: bool = False) -> str:
    """Parts as CSV files of two sites and two folds, with training and test rows; ``ordered``: lines by key, and the
    second site's columns in another order."""
    part = spark.read.parquet(f"{d}/part.parquet")
    key = F.col("p_partkey")
    rows = part.select((key % 2 + 1).cast("int").alias("client"), F.concat(F.lit("fold"), (F.floor(key / 2) % 2).cast("string")).alias("split"), F.col("p_size").cast("double").alias("size (cm)"), (key % 50).cast("double").alias("b"), (F.floor("p_retailprice") % 3).cast("double").alias("kind"), (key % 5 == 0).alias("is_test"), key.alias("key"))
    rows, root = settle(rows, "parts"), scratch(part)
    for client in (1, 2):
        for fold in ("fold0", "fold1"):
            for name, wanted in (("train", ~F.col("is_test")), ("test", F.col("is_test"))):
                own = rows.filter((F.col("client") == client) & (F.col("split") == fold) & wanted)
                own = own.repartitionByRange(3, "key").sortWithinPartitions("key") if ordered else own
                own.select(*(("kind", "b", "size (cm)") if ordered and client == 2 else ("size (cm)", "b", "kind"))).write.csv(f"{root}/client{client}/{fold}/{name}.csv", sep=";", header=True)
    return root


C_FOREST = RunConfig(sep=";", label="kind", split_mode="directory", n_bins=5, n_estimators=TREES, max_depth=3, random_state=SEED, max_features=2)


@query(f"SELECT split, client, a, b, y FROM (SELECT {_CSV}) WHERE NOT is_test")
def csv_scan(spark, d):
    rows = tables.read_csv_sites(spark, f"{csv_sites(spark, d)}/client*/*/train.csv", "kind", ";")
    return rows.select("split", "client", F.get("features", F.lit(0)).alias("a"), F.get("features", F.lit(1)).alias("b"), "y")


@query(f"SELECT split, client, a, b, y FROM (SELECT {_CSV}) WHERE NOT is_test")
def read_sites(spark, d):
    """Two sites whose files have their columns in different orders."""
    rows = tables.read_csv_sites(spark, f"{csv_sites(spark, d, ordered=True)}/client*/*/train.csv", "kind", ";")
    return rows.select("split", "client", F.get("features", F.lit(0)).alias("a"), F.get("features", F.lit(1)).alias("b"), "y")


_KEYED = _CSV.replace(" FROM part", ", p_partkey AS key FROM part")
_LINE = "row_number() OVER (PARTITION BY split, client ORDER BY key) - 1 AS row_id"


@query(f"SELECT split, client, row_id, a, y FROM (SELECT *, {_LINE} FROM (SELECT {_KEYED}) WHERE NOT is_test) WHERE row_id >= 5 AND row_id < 40")
def file_slice(spark, d):
    """Lines [5, 40) of each site's and fold's training file."""
    rows = tables.read_csv_sites(spark, f"{csv_sites(spark, d, ordered=True)}/client*/*/train.csv", "kind", ";", row_ids="lines")
    return rows.filter((F.col("row_id") >= 5) & (F.col("row_id") < 40)).select("split", "client", "row_id", F.get("features", F.lit(0)).alias("a"), "y")


_MAJ = "SELECT client, row_id, y, pred FROM preds GROUP BY client, row_id, y, pred QUALIFY row_number() OVER (PARTITION BY client, row_id ORDER BY count(*) DESC, pred) = 1"
_DIRECTORY = " UNION ALL ".join(f"""SELECT 'fold{f}' AS split, client, row_id, pred FROM ({o.with_(f"own AS (SELECT * FROM (SELECT {_CSV}) WHERE split = 'fold{f}')", o.forest(f"rows AS MATERIALIZED (SELECT client, {_NUMBERED}, y FROM own WHERE NOT is_test)", 5, 2, TREES, 2, SEED, 2, 3, split=f"fold{f}"), f"tests AS (SELECT client, {_NUMBERED}, y FROM own WHERE is_test)", o.bins_of(2, "tests", "tbinned"), o.predictions(2, "tbinned"), select=_MAJ)})""" for f in (0, 1))


@query(_DIRECTORY)
def run_directory_mode(spark, d):
    """From files to files: the predictions of both folds' test rows, read back from the prediction files."""
    root = csv_sites(spark, d)
    runs.run(spark, C_FOREST, root, f"{root}/out")
    return spark.read.csv(f"{root}/out/{C_FOREST.pred_out}", sep=";", header=True, schema="row_id bigint, pred double, split string, client int")


_BY_LINE = _DIRECTORY.replace(_NUMBERED, "row_number() OVER (PARTITION BY client ORDER BY key) - 1 AS row_id, [a, b] AS f").replace(_CSV, _KEYED)


@query(_BY_LINE)
def run_in_file_order(spark, d):
    """From files to files, rows numbered by their lines: prediction n belongs to line n of the site's test file."""
    root = csv_sites(spark, d, ordered=True)
    runs.run(spark, replace(C_FOREST, row_ids="lines"), root, f"{root}/out")
    return spark.read.csv(f"{root}/out/{C_FOREST.pred_out}", sep=";", header=True, schema="row_id bigint, pred double, split string, client int")


@query()
def cv_mcc(spark, d):
    """Two folds, each fitted without its rows and scored on them. No SQL: as one text it takes DuckDB minutes."""
    return evaluate.cross_validate(E(spark, d), E_FOREST, k=2, repeats=1).select("split", r6("mcc"))
