"""Split scores from per-site histograms: Gini, class-weighted Gini and mean squared error."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = ["split", "client", "tree", "node_id"]


def histogram(assign: DataFrame, tree_features: DataFrame) -> DataFrame:
    """(split, client, tree, node_id, pos, feature, bin, y, n): a level's pass over the data.

    ``assign`` carries each row's bins and label, so rows never move: partial sums are shuffled, nothing else.
    """
    used = assign.join(F.broadcast(tree_features), "tree")
    binned = used.select(*NODE, "pos", "feature", F.get("bins", F.col("feature")).alias("bin"), "y", "mult")
    return binned.groupBy(*NODE, "pos", "feature", "bin", "y").agg(F.sum("mult").alias("n"))


def cumulative(hist: DataFrame, n_bins: int, classes: list[float] | None) -> DataFrame:
    """Per node and feature: ``left[thr]`` and ``total``, arrays of class counts, or of (n, sum y, sum y*y) in regression.

    The bins and classes that occur are gathered by (node, feature), at most bins times classes, and laid out as one
    dense array whose running sums are taken at once: the plan is the same for any number of them.
    """
    key = [*NODE, "pos", "feature"]
    k = len(classes) if classes is not None else 3
    kind, number = ("bigint", np.int64) if classes is not None else ("double", np.float64)
    if classes is not None:
        # Sorted classes: the place is how many are smaller.
        place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in classes]), lambda c: c < F.col("y")))
        cells = hist.select(*key, F.struct((F.col("bin") * k + place).alias("at"), "n").alias("cell"))
        cells = cells.groupBy(*key).agg(F.collect_list("cell").alias("cells"))
    else:
        n, y = F.col("n"), F.col("y")
        # A label is a double: sums go by label in order, so that they don't depend on the order of rows.
        cells = hist.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("bin", "y", "n"))).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, step := max(1, 4_000_000 // (n_bins * k))):
                part = batch.slice(a, step)
                cell, sizes = part.column("cells").flatten(), pc.list_value_length(part.column("cells")).to_numpy()
                row = np.repeat(np.arange(part.num_rows), sizes)
                dense = np.zeros((part.num_rows, n_bins, k), number)
                # Values below the first edge are in bin -1: left of every threshold.
                if classes is not None:
                    at, n = cell.field("at").to_numpy(), cell.field("n").to_numpy()
                    np.add.at(dense, (row, np.maximum(at // k, 0), at % k), n)
                else:
                    at, y, n = cell.field("bin").to_numpy(), cell.field("y").to_numpy(), cell.field("n").to_numpy().astype(number)
                    for i, v in enumerate((n, n * y, n * y * y)):
                        np.add.at(dense, (row, np.maximum(at, 0), i), v)
                left = np.cumsum(dense, axis=1)
                inner = pa.ListArray.from_arrays(pa.array(np.arange(0, left.size + 1, k, dtype=np.int32)), pa.array(left.reshape(-1)))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(0, part.num_rows * n_bins + 1, n_bins, dtype=np.int32)), inner)
                last = pa.ListArray.from_arrays(pa.array(np.arange(0, part.num_rows * k + 1, k, dtype=np.int32)), pa.array(left[:, -1].reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in key), outer, last], [*key, "left", "total"])

    shape = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in key)
    return cells.mapInArrow(run, f"{shape}, left array<array<{kind}>>, total array<{kind}>")


def without_sibling(parent: DataFrame, sibling: DataFrame, nodes: DataFrame) -> DataFrame:
    """Cumulative counts of ``nodes`` (split, tree, slot, node_id): those of their parents less those of their siblings.

    A site without rows of the sibling takes all of the parent's; one without rows of the node itself has no row.
    """
    key = ["split", "client", "tree", "pos"]
    own = parent.drop("slot").withColumnRenamed("node_id", "__up").join(nodes.withColumn("__up", F.shiftright("node_id", 1)), ["split", "tree", "__up"])
    other = sibling.select(*key, F.col("node_id").bitwiseXOR(F.lit(1)).alias("node_id"), F.col("left").alias("__left"), F.col("total").alias("__total"))
    both = own.join(other, [*key, "node_id"], "left")
    less = lambda a, b: F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x - y))
    left = F.when(F.col("__left").isNull(), F.col("left")).otherwise(F.zip_with("left", "__left", lambda x, y: F.zip_with(x, y, lambda p, q: p - q)))
    made = both.select("split", "client", "tree", "slot", "pos", "feature", "node_id", left.alias("left"), less(F.col("total"), F.col("__total")).alias("total"))
    return made.filter(F.exists("total", lambda n: n > 0))


def added(values: Column, start: Column) -> Column:
    """Sum of an array in its order."""
    return F.aggregate(values, start, lambda a, v: a + v)


def gini(left: Column, total: Column, k: int, weights: Column | list[float] | None = None, lengths: str = "lengths") -> Column:
    """Gini of a split from class counts; 1.0 if a side is empty. Weights, one a class, enter the squares; ``lengths`` says
    whether the sides are divided by their row counts (the computed form) or by their weighted counts (the documented form)."""
    w = F.array(*[F.lit(float(x)) for x in weights]) if isinstance(weights, list) else weights
    none, zero = F.lit(0).cast("bigint"), F.lit(0.0)
    right = F.zip_with(total, left, lambda t, c: t - c)

    def scored(s: Column) -> Column:
        def side(counts: Column, n: Column) -> Column:
            if weights is None:
                squares = added(F.transform(counts, lambda c: (c / n) * (c / n)), zero)
                return n / (s["nl"] + s["nr"]) * (1.0 - squares)
            of = F.zip_with(counts, w, lambda c, x: c * x)
            by = n.cast("double") if lengths == "lengths" else added(of, zero)
            # The divisor is bound once, not summed again for each class.
            squares = F.get(F.transform(F.array(F.struct(of.alias("of"), by.alias("by"))), lambda b: added(F.transform(b["of"], lambda v: (v / b["by"]) * (v / b["by"])), zero)), F.lit(0))
            return n / (s["nl"] + s["nr"]) * (1.0 - squares)

        return F.when((s["nl"] == 0) | (s["nr"] == 0), F.lit(1.0)).otherwise(side(s["l"], s["nl"]) + side(s["r"], s["nr"]))

    sized = F.transform(F.array(F.struct(left.alias("l"), right.alias("r"))), lambda s: F.struct(s["l"].alias("l"), s["r"].alias("r"), added(s["l"], none).alias("nl"), added(s["r"], none).alias("nr")))
    return F.get(F.transform(sized, scored), F.lit(0))


def mse(n: Column, s: Column, ss: Column) -> Column:
    return ss / n - (s / n) * (s / n)


def child_mse(left: Column, total: Column) -> Column:
    """Weighted mean squared error of the children; the parent's, if a side is empty."""
    n, s, ss = (F.get(total, F.lit(i)) for i in range(3))
    ln, ls, lss = (F.get(left, F.lit(i)) for i in range(3))
    rn, rs, rss = n - ln, s - ls, ss - lss
    return F.when((ln == 0) | (rn == 0), mse(n, s, ss)).otherwise((ln * mse(ln, ls, lss) + rn * mse(rn, rs, rss)) / n)


def pure(total: Column, classes: list[float] | None) -> Column:
    """At most one distinct label: of class counts, or no variance in regression."""
    if classes is not None:
        return F.size(F.filter(total, lambda x: x > 0)) <= 1
    n, s, ss = (F.get(total, F.lit(i)) for i in range(3))
    return (n == 0) | (n * ss - s * s <= 1e-9 * n * ss)


def local_scores(cum: DataFrame, n_bins: int, classes: list[float] | None, weights: Column | list[float] | None = None, lengths: str = "lengths", compat_min_reduction: bool = False) -> DataFrame:
    """(split, client, tree, node_id, pos, feature, thr, score): each site's own scores; 0 for a node pure at the site, the root excepted."""
    more = [weights.alias("weights")] if isinstance(weights, Column) else []
    each = cum.select(*NODE, "pos", "feature", "total", *more, F.posexplode("left").alias("thr", "left"))
    weights = F.col("weights") if more else weights
    if classes is not None:
        score = gini(F.col("left"), F.col("total"), len(classes), weights, lengths)
    else:
        score = child_mse(F.col("left"), F.col("total"))
        if compat_min_reduction:
            n, s, ss = (F.get("total", F.lit(i)) for i in range(3))
            ln = F.get("left", F.lit(0))
            score = F.when((ln == 0) | (ln == n), mse(n, s, ss)).otherwise(mse(n, s, ss) - score)
    shown = F.when((F.col("node_id") != 1) & pure(F.col("total"), classes), F.lit(0.0)).otherwise(score)
    return each.select(*NODE, "pos", "feature", "thr", shown.alias("score"))


def global_scores(local: DataFrame) -> DataFrame:
    """Sum over sites, folded in order of the site so that equal candidates stay equal to the last bit."""
    parts = F.array_sort(F.collect_list(F.struct("client", "score")))
    return local.groupBy("split", "tree", "node_id", "pos", "feature", "thr").agg(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["score"]).alias("score"))


def best_splits(scores: DataFrame) -> DataFrame:
    """Lowest (score, pos, thr) of every node."""
    best = F.min(F.struct("score", "pos", "thr", "feature")).alias("b")
    return scores.groupBy("split", "tree", "node_id").agg(best).select("split", "tree", "node_id", "b.pos", "b.feature", "b.thr", "b.score")
