"""Scoring: traversal, votes, out-of-bag weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.portable import spread
from . import binning
from .binning import matrices, of_splits

KEY = ["split", "client", "row_id"]


#: Forests of up to so many nodes are broadcast (about 40 bytes a node); larger ones are walked by joins.
MOST_NODES = 2_000_000
#: A bin that no threshold is below.
MISSING = -(1 << 31)


class FlatTrees:
    """All nodes of all splits as flat arrays, for the tasks; children are places in them, a leaf leads to itself.

    ``nodes`` are collected, about 40 bytes a node. Without ``weights`` all trees of a split weigh 1.
    """

    def __init__(self, nodes: DataFrame, depth: int, weights: DataFrame | None = None):
        known = nodes.select("split", "tree", "node_id", "feature", "thr", "value").toPandas().sort_values(["split", "tree", "node_id"], ignore_index=True)
        ids, self.depth = known.node_id.to_numpy(np.int64), max(1, depth)
        self.left, self.right = np.arange(len(ids), dtype=np.int32), np.arange(len(ids), dtype=np.int32)
        self.feature, self.thr = known.feature.fillna(0).to_numpy(np.int32), known.thr.fillna(0).to_numpy(np.int32)
        self.value, self.width = known.value.to_numpy(np.float64), int(self.feature.max(initial=0)) + 1
        by_tree = {} if weights is None else {(r.split, r.tree): r.weight for r in weights.select("split", "tree", "weight").collect()}
        #: By split: the trees' numbers, the places of their roots, their weights.
        self.trees: dict[str, tuple[np.ndarray, np.ndarray, list[float]]] = {}
        begins = np.flatnonzero(ids == 1)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)]):
            own = ids[a:b]
            for bit, side in enumerate((self.left, self.right)):
                at = np.minimum(np.searchsorted(own, 2 * own + bit), b - a - 1)
                side[a:b] = np.where(own[at] == 2 * own + bit, a + at, side[a:b])
        for split, own in known[known.node_id == 1].groupby("split"):
            self.trees[split] = own.tree.to_numpy(), own.index.to_numpy(np.int32), [by_tree.get((split, t), 1.0) for t in own.tree]
        self.most = max(1, 1_000_000 // (max((len(t) for t, *_ in self.trees.values()), default=1) + len(np.unique(self.value))))

    def answers(self, split: str, bins: np.ndarray) -> np.ndarray:
        """(trees, rows): whole batches step down all trees at once. ``MISSING`` bins, and such as rows lack, lead left."""
        if bins.shape[1] < self.width:
            bins = np.pad(bins, ((0, 0), (0, self.width - bins.shape[1])), constant_values=MISSING)
        at, rows = np.repeat(self.trees[split][1][:, None], len(bins), axis=1), np.arange(len(bins))
        for _ in range(self.depth):
            at = np.where(bins[rows, self.feature[at]] > self.thr[at], self.right[at], self.left[at])
        return self.value[at]

    def vote(self, split: str, answers: np.ndarray, regression: bool) -> np.ndarray:
        """Classes: largest sum of weights, added in order of the tree, ties to the smallest class. Regression: mean."""
        if regression:
            total = np.zeros(answers.shape[1])
            for a in answers:
                total = total + a
            return total / len(answers)
        classes = np.unique(answers)
        votes, named = np.zeros((len(classes), answers.shape[1])), np.zeros((len(classes), answers.shape[1]), bool)
        for a, w in zip(answers, self.trees[split][2]):
            own = classes[:, None] == a
            votes += np.where(own, w, 0.0)
            named |= own
        return classes[np.where(named, votes, -np.inf).argmax(0)]

    def walked(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
        """(rows, split, answers) of a batch with ``bins``, a bounded number of answers at a time."""
        flat = batch.column("bins").flatten().fill_null(MISSING).to_numpy(zero_copy_only=False)
        for own, split, at in matrices(batch, "bins"):
            for i in range(0, len(own), self.most):
                yield own[i : i + self.most], split, self.answers(split, flat[at[i : i + self.most]])


def walked_by_joins(binned: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(split, client, row_id, tree, pred) of a forest of any size: a row and tree is a row that joins its next node."""
    trees = nodes.filter("node_id = 1").groupBy("split").agg(F.array_sort(F.collect_set("tree")).alias("trees"))
    at = binned.select(*KEY, "bins").join(trees, "split").select(*KEY, "bins", F.explode("trees").alias("tree")).withColumn("node_id", F.lit(1).cast("bigint"))
    spots = nodes.select("split", "tree", "node_id", "feature", "thr", "value")
    down = F.col("node_id") * 2 + (F.get("bins", F.col("feature")) > F.col("thr")).cast("bigint")
    for _ in range(depth):
        at = at.join(spots, ["split", "tree", "node_id"]).select(*KEY, "bins", "tree", F.when(F.col("feature").isNull(), F.col("node_id")).otherwise(down).alias("node_id"))
    return at.join(spots, ["split", "tree", "node_id"]).select(*KEY, "tree", F.col("value").alias("pred"))


#: What maps the batches of a task.
Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _typed(rows: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*(rows.schema[c] for c in KEY), *(T.StructField(*m) for m in more)])


def predict_trees(rows: DataFrame, nodes: DataFrame, depth: int, most: int = MOST_NODES, before: Step | None = None) -> DataFrame:
    """(split, client, row_id, tree, pred): every row walks down every tree of its split in its own task, unshuffled.

    ``rows`` have bins, or get them from ``before`` in the same pass.
    """
    if nodes.count() > most:
        return walked_by_joins(rows if before is None else rows.mapInArrow(before, binning.binned_schema(rows)), nodes, depth)
    sent = rows.sparkSession.sparkContext.broadcast(FlatTrees(nodes, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if before is None else before(batches):
            batch = of_splits(batch, list(sent.value.trees))
            for own, split, answers in sent.value.walked(batch):
                keys = batch.select(KEY).take(pa.array(np.repeat(own, len(answers))))
                tree = pa.array(np.tile(sent.value.trees[split][0], len(own)), pa.int32())
                yield pa.RecordBatch.from_arrays([*keys.columns, tree, pa.array(answers.T.ravel())], [*KEY, "tree", "pred"])

    return rows.select(*KEY, "bins" if before is None else "features").mapInArrow(run, _typed(rows, ("tree", T.IntegerType()), ("pred", T.DoubleType())))


def predict_rows(rows: DataFrame, nodes: DataFrame, depth: int, mode: str, weights: DataFrame | None = None, most: int = MOST_NODES, before: Step | None = None) -> DataFrame:
    """(split, client, row_id, pred): the trees vote on a row in its own task, so nothing is shuffled, in batch or stream.

    See ``FlatTrees.vote``, and ``predict_trees`` for ``before``.
    """
    if nodes.count() <= most:
        sent = rows.sparkSession.sparkContext.broadcast(FlatTrees(nodes, depth, weights))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches if before is None else before(batches):
                batch = of_splits(batch, list(sent.value.trees))
                pred = np.empty(batch.num_rows)
                for own, split, answers in sent.value.walked(batch):
                    pred[own] = sent.value.vote(split, answers, mode == "regression")
                yield pa.RecordBatch.from_arrays([*batch.select(KEY).columns, pa.array(pred)], [*KEY, "pred"])

        return rows.select(*KEY, "bins" if before is None else "features").mapInArrow(run, _typed(rows, ("pred", T.DoubleType())))
    known = nodes.filter("node_id = 1").select("split", "tree", F.lit(1.0).alias("weight")) if weights is None else weights.select("split", "tree", "weight")
    binned = rows if before is None else rows.mapInArrow(before, binning.binned_schema(rows))
    each = walked_by_joins(binned, nodes, depth).join(known, ["split", "tree"])
    gathered = each.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("tree", "weight", "pred"))).alias("forest"))
    walked = gathered.withColumn("__preds", F.transform("forest", lambda t: t["pred"]))
    if mode == "regression":
        out = F.aggregate("__preds", F.lit(0.0), lambda a, x: a + x) / F.size("__preds")
        return walked.select(*KEY, out.alias("pred"))
    votes = F.zip_with("__preds", "forest", lambda p, t: F.struct(p.alias("pred"), t["weight"].alias("weight")))
    total = lambda c: F.aggregate(votes, F.lit(0.0), lambda a, v: a + F.when(v["pred"] == c, v["weight"]).otherwise(0.0))
    ranked = F.transform(F.array_distinct("__preds"), lambda c: F.struct(total(c).alias("s"), (-c).alias("neg")))
    return walked.select(*KEY, (-F.array_max(ranked)["neg"]).alias("pred"))


def oob_rows(rows: DataFrame, sample: DataFrame, n_trees: int) -> DataFrame:
    """(split, client, tree, row_id) of rows that a tree's sample doesn't hold."""
    grid = rows.select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"))
    return spread(grid, rows.count() * n_trees, *KEY, "tree").join(sample.select(*KEY, "tree"), [*KEY, "tree"], "left_anti").select("split", "client", "tree", "row_id")


def tree_weights(state: DataFrame, nodes: DataFrame, depth: int, denominator: str = "all") -> DataFrame:
    """(split, tree, accuracy, weight): 1 - errors on out-of-bag rows / all rows (or / out-of-bag rows), normalised to sum 1.

    ``state`` is growth's first (see ``grow.initial_state``): a row knows the trees whose samples hold it, walks down
    the others and compares their answers in its own task. Only the sums of errors, one a tree, are shuffled.
    """
    sent = state.sparkSession.sparkContext.broadcast(FlatTrees(nodes, depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = of_splits(batch, list(sent.value.trees))
            held, y = batch.column("held"), batch.column("y").to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(held).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            inside, ends = held.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
            for own, split, answers in sent.value.walked(batch):
                trees = sent.value.trees[split][0]
                free, n = np.ones(answers.shape, bool), lengths[own]
                # Places of the rows' own trees in the flat list.
                at = np.repeat(ends[own] - np.cumsum(n), n) + np.arange(n.sum())
                free[np.searchsorted(trees, inside[at]), np.repeat(np.arange(len(own)), n)] = False
                err = ((answers != y[own]) & free).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array([split] * len(trees), pa.string()), pa.array(trees, pa.int32()), pa.array(err, pa.int64()), pa.array(free.sum(1), pa.int64())], ["split", "tree", "err", "n_oob"])

    parts = state.select("split", "bins", "y", F.transform("at", lambda a: a["tree"]).alias("held")).mapInArrow(run, "split string, tree int, err bigint, n_oob bigint")
    errors = parts.filter("n_oob > 0").groupBy("split", "tree").agg(F.sum("err").alias("err"), F.sum("n_oob").alias("n_oob"))
    sizes = state.groupBy("split").agg(F.count("*").alias("n"))
    trees = nodes.select("split", "tree").distinct().join(errors, ["split", "tree"], "left").join(F.broadcast(sizes), "split")
    n = F.col("n") if denominator == "all" else F.col("n_oob")
    acc = trees.select("split", "tree", F.when(F.coalesce("n_oob", F.lit(0)) == 0, 1.0).otherwise(1 - F.col("err") / n).alias("accuracy"))
    return acc.withColumn("weight", F.col("accuracy") / F.sum("accuracy").over(Window.partitionBy("split").orderBy("tree").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
