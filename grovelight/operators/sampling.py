"""Feature subsets, bootstraps, folds and permutations from repeatable draws."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.portable import dense_number, draw, spread


def feature_count(max_features: str | float | int, n_features: int) -> int:
    if max_features == "sqrt":
        return int(math.sqrt(n_features))
    return int(n_features * max_features) if max_features < 1 else int(max_features)


def sample_size(n: Column, max_samples: float | int | None) -> Column:
    """None: n; a float: a share, rounded half to even, 1 at least; an int: a count."""
    if max_samples is None:
        return n
    if isinstance(max_samples, float):
        return F.greatest(F.bround(n * F.lit(max_samples)).cast("bigint"), F.lit(1))
    return F.lit(max_samples).cast("bigint")


def feature_subset(spark: SparkSession, n_trees: int, n_features: int, k: int, seed: int) -> DataFrame:
    """(tree, pos, feature): k features a tree, in order of their draws."""
    grid = spark.range(n_trees).select(F.col("id").cast("int").alias("tree"), F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))).alias("feature"))
    order = Window.partitionBy("tree").orderBy(draw(seed, "f", F.col("tree"), F.col("feature")), "feature")
    return grid.withColumn("pos", F.row_number().over(order) - 1).filter(F.col("pos") < k).select("tree", "pos", "feature")


def bootstrap(rows: DataFrame, n_trees: int, seed: int, max_samples: float | int | None = None, replace: bool = True) -> DataFrame:
    """(split, client, tree, row_id, mult): each site's own sample for each tree. ``row_id`` has to be dense in (split, client)."""
    trees = F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree")
    sizes = rows.groupBy("split", "client").agg(F.count("*").alias("n")).withColumn("m", sample_size(F.col("n"), max_samples))
    if replace:
        # Row i of a site makes the site's draws i, i + n, ...: draws are spread as the rows are, and are known to be as many.
        own = rows.select("split", "client", "row_id").join(F.broadcast(sizes), ["split", "client"]).filter(F.col("row_id") < F.col("m"))
        draws = own.select("split", "client", "n", "m", "row_id", trees).select("split", "client", "tree", "n", F.explode(F.sequence(F.col("row_id"), F.col("m") - 1, F.col("n"))).alias("i"))
        picked = draws.select("split", "client", "tree", (draw(seed, "b", F.col("split"), F.col("client"), F.col("tree"), F.col("i")) % F.col("n")).alias("row_id"))
        dealt = spread(picked, rows.count() * n_trees, "split", "client", "tree", "row_id")
        return dealt.groupBy("split", "client", "tree", "row_id").agg(F.count("*").alias("mult"))
    each = rows.select("split", "client", "row_id", trees).withColumn("h", draw(seed, "s", F.col("split"), F.col("client"), F.col("tree"), F.col("row_id")))
    ranked = dense_number(each, ["split", "client", "tree"], F.col("h"), ["row_id"], "nth")
    return ranked.join(F.broadcast(sizes.select("split", "client", "m")), ["split", "client"]).filter("nth < m").select("split", "client", "tree", "row_id", F.lit(1).cast("bigint").alias("mult"))


def poisson_steps(rate: float) -> list[int]:
    """How many of the draw's 2**32 values give at most 0, 1, 2, ... copies at this mean."""
    p = total = math.exp(-rate)
    steps = []
    while (at := round(total * (1 << 32))) < 1 << 32 and len(steps) < 200:
        steps.append(at)
        p *= rate / len(steps)
        total += p
    return steps


def poisson_bootstrap(rows: DataFrame, n_trees: int, seed: int, rate: float = 1.0) -> DataFrame:
    """``rows`` with ``sample``, array of (tree, mult): each row draws its own number of copies for each tree.

    Numbers are Poisson with mean ``rate``, by inversion of a draw of the row's key, so a sample's size varies a little
    around ``rate`` times the rows and nothing is shuffled. Trees that don't take the row are not in the array.
    """
    steps = F.array(*[F.lit(x).cast("bigint") for x in poisson_steps(rate)])

    def own(tree: Column) -> Column:
        h = F.array(draw(seed, "p", F.col("split"), F.col("client"), tree, F.col("row_id")))
        # The draw is bound once, then compared with every step.
        mult = F.get(F.transform(h, lambda v: F.size(F.filter(steps, lambda s: s <= v)).cast("bigint")), F.lit(0))
        return F.struct(tree.cast("int").alias("tree"), mult.alias("mult"))

    trees = F.transform(F.sequence(F.lit(0), F.lit(n_trees - 1)), own)
    return rows.withColumn("sample", F.filter(trees, lambda x: x["mult"] > 0))


def train_test(rows: DataFrame, share: float, seed: int) -> DataFrame:
    """``role`` by threshold on a draw: about ``share`` of the rows are test rows."""
    return rows.withColumn("role", F.when(draw(seed, "t", F.col("client"), F.col("row_id")) < int(share * (1 << 32)), "test").otherwise("train"))


def kfold(rows: DataFrame, k: int, seed: int, repeat: int = 0) -> DataFrame:
    """``fold``: position in draw order, modulo k, so folds differ by one row at most."""
    drawn = rows.withColumn("h", draw(seed, "k", repeat, F.col("client"), F.col("row_id")))
    return dense_number(drawn, ["split"], F.col("h"), ["client", "row_id"], "nth").withColumn("fold", (F.col("nth") % k).cast("int")).drop("h", "nth")


def deal_clients(rows: DataFrame, n_clients: int, seed: int) -> DataFrame:
    """``dealt``: contiguous slices of the rows in draw order, one for each site."""
    drawn = rows.withColumn("h", draw(seed, "c", F.col("client"), F.col("row_id")))
    ranked = dense_number(drawn, ["split"], F.col("h"), ["client", "row_id"], "nth")
    sizes = rows.groupBy("split").agg(F.count("*").alias("n"))
    return ranked.join(F.broadcast(sizes), "split").withColumn("dealt", F.floor(F.col("nth") * n_clients / F.col("n")).cast("int")).drop("h", "nth", "n")


def shuffle_labels(rows: DataFrame, seed: int) -> DataFrame:
    """Labels permuted within each site: the row at natural position i gets the label at draw position i."""
    drawn = rows.select("split", "client", "row_id", "y").withColumn("h", draw(seed, "l", F.col("client"), F.col("row_id")))
    order = dense_number(drawn, ["split", "client"], F.col("h"), ["row_id"], "nth")
    labels = order.select("split", "client", F.col("nth").alias("row_id"), F.col("y").alias("new_y"))
    key = ["split", "client", "row_id"]
    return rows.join(spread(labels, rows.count(), *key), key).withColumn("y", F.col("new_y")).drop("new_y")


#: Steps outside of the numbers until a walk is given up; up to 4,096 numbers none can be that long.
WALK = 64


def permuted(i: Column, n: Column, key: list[Column | str | int]) -> Column:
    """Where number ``i`` of 0..n-1 goes in a permutation of them that ``key`` chooses.

    Numbers are places (l, r) of a grid of a = ceil(sqrt(n)) rows. Four times, one coordinate is moved around by a draw
    of the other, which can be undone; a place behind the last number walks on until it is a number again. At most a - 1
    places are none, so that walks are short: over ``WALK`` steps have a chance under n ** (-WALK / 2), and give null.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("bigint")

    def start(i: Column, n: Column) -> Column:
        return F.struct(i.alias("x"), n.alias("n"), a.alias("a"), F.ceil(n / a).cast("bigint").alias("b"))

    def turn(half: int, s: Column) -> Column:
        l, r = F.floor(s["x"] / s["b"]), s["x"] % s["b"]
        if half % 2 == 0:
            l = (l + draw(*key, half, r.cast("bigint"))) % s["a"]
        else:
            r = (r + draw(*key, half, l.cast("bigint"))) % s["b"]
        return F.struct((l * s["b"] + r).cast("bigint").alias("x"), s["n"].alias("n"), s["a"].alias("a"), s["b"].alias("b"))

    def once(s: Column) -> Column:
        for half in range(4):
            bound = F.array(s)  # evaluated once, not at each use
            s = F.get(F.transform(bound, lambda v: turn(half, v)), F.lit(0))
        return s

    def walked(first: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.least(first["a"], F.lit(WALK)).cast("int")), first, lambda s, _: F.when(s["x"] < s["n"], s).otherwise(once(s)), lambda s: F.when(s["x"] < s["n"], s["x"]))

    # Only places that are no number walk on; the others, nearly all, have arrived.
    return F.get(F.transform(F.array(once(start(i, n))), lambda s: F.when(s["x"] < s["n"], s["x"]).otherwise(walked(s))), F.lit(0))


def permute_labels(rows: DataFrame, seed: int) -> DataFrame:
    """Labels permuted within each site by ``permuted``: rows keep their places, labels move by one shuffle of keys, and
    nothing is sorted or numbered. ``row_id`` has to be dense in (split, client)."""
    key = ["split", "client", "row_id"]
    sizes = rows.groupBy("split", "client").agg(F.count("*").alias("__n"))
    labels = rows.select(*key, "y").join(F.broadcast(sizes), ["split", "client"])
    moved = labels.select("split", "client", permuted(F.col("row_id"), F.col("__n"), [seed, "y", F.col("split"), F.col("client")]).alias("row_id"), F.col("y").alias("__y"))
    return rows.join(spread(moved, rows.count(), *key), key).withColumn("y", F.col("__y")).drop("__y")
