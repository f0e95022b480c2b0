"""Repeated cross-validation: every repeat and fold is a split, and all of them are fitted together."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forest as forests
from .config import RunConfig
from .functions.portable import dense_number, draw, settle, spread
from .operators import metrics, sampling


def folds(rows: DataFrame, k: int, repeats: int, seed: int) -> DataFrame:
    """``rows`` once for each repeat, with ``repeat`` and ``fold``."""
    out = None
    for r in range(repeats):
        one = sampling.kfold(rows, k, seed, r).withColumn("repeat", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return settle(out, "folds")


def cross_validate(rows: DataFrame, config: RunConfig, k: int, repeats: int = 1, seed: int | None = None, shuffled: bool = False) -> DataFrame:
    """(split, mcc): each fold, named r<repeat>-f<fold>, predicted by a forest fitted on the other folds of its repeat.

    ``rows`` are of one split. ``shuffled`` permutes the training labels: the control that should find no signal.
    """
    seed = config.random_state if seed is None else seed
    dealt = folds(rows, k, repeats, seed)
    named = lambda fold: F.concat(F.lit("r"), F.col("repeat").cast("string"), F.lit("-f"), fold.cast("string"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda f: f != F.col("fold"))).alias("without")
    training = dealt.select("repeat", others, "client", "row_id", "features", "y").withColumn("split", named(F.col("without")))
    training = dense_number(training.withColumnRenamed("row_id", "was"), ["split", "client"], draw(F.col("split"), F.col("client"), F.col("was")), ["was"], "row_id").select("split", "client", "row_id", "features", "y")
    training = settle(sampling.shuffle_labels(training, seed) if shuffled else training, "training")
    forest = forests.train(training, config)
    tests = dealt.select(named(F.col("fold")).alias("split"), "client", "row_id", "features", "y")
    key = ["split", "client", "row_id"]
    scored = spread(forest.predict(tests), tests.count(), *key).join(tests, key)
    return metrics.mcc_multiclass(scored, by=("split",))
