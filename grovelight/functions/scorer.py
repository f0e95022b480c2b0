"""A forest as a table function that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import functions as F

from ..operators import binning, score

if TYPE_CHECKING:
    from ..forest import Forest

#: A forest of more nodes isn't sent to the tasks as arrays.
MOST_NODES = 5_000_000
#: What registered functions read, by their names: a broadcast that nobody holds is removed.
_sent: dict[str, Broadcast] = {}


class FlatForest:
    """A forest's trees as flat arrays, with its edges."""

    def __init__(self, forest: Forest):
        if (n := forest.nodes.count()) > MOST_NODES:
            raise ValueError(f"the forest has {n} nodes, more than {MOST_NODES}")
        self.trees = score.FlatTrees(forest.nodes, forest.depth, forest.trees if forest.weighted else None)
        self.edges: dict[str, list] = {}
        for e in forest.edges.select("split", "feature", "kind", "edges", "mean", "stddev").collect():
            self.edges.setdefault(e.split, []).append(e)
        self.edges = {split: binning.edges_by_feature(own) for split, own in self.edges.items()}
        self.n_bins, self.regression = forest.n_bins, forest.mode == "regression"

    def bins(self, split: str, x: np.ndarray) -> np.ndarray:
        return binning.bins_of(x, self.edges[split], self.n_bins)

    def predict(self, split: str, x: np.ndarray) -> np.ndarray:
        return self.trees.vote(split, self.trees.answers(split, self.bins(split, x)), self.regression)


def register_scorer(forest: Forest, name: str = "predict") -> None:
    """``SELECT * FROM name(TABLE(rows))`` gives (split, client, row_id, pred) of rows (split, client, row_id, features).

    Other columns are ignored; null features count as missing ones; a split that the forest lacks, and rows without
    features, have a null prediction. The arrays are broadcast.
    """
    spark = forest.nodes.sparkSession
    sent = _sent[name] = spark.sparkContext.broadcast(FlatForest(forest))

    class Scorer:
        def eval(self, rows: pa.RecordBatch) -> Iterator[pa.Table]:
            flat = sent.value
            split, features = rows.column("split"), rows.column("features")
            names, of = np.unique(np.array([s if s is not None else "" for s in split.to_pylist()]), return_inverse=True)
            full = np.array(features.is_valid())
            pred = np.full(rows.num_rows, np.nan)
            for k, name_of in enumerate(names.tolist()):
                at = np.flatnonzero((of == k) & full)
                if name_of in flat.trees.trees and len(at):
                    own = features.take(pa.array(at)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                    pred[at] = flat.predict(name_of, own.reshape(len(at), -1))
            yield pa.table([split, rows.column("client"), rows.column("row_id"), pa.array(pred, mask=np.isnan(pred))], ["split", "client", "row_id", "pred"])

    made = F.arrow_udtf(Scorer, returnType="split string, client int, row_id bigint, pred double")
    spark.udtf.register(name, made)
