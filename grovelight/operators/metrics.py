"""Class counts and weights, confusion, accuracy and Matthews correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def class_frequency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split", "client", "y").agg(F.count("*").alias("n"))


def class_weights(rows: DataFrame) -> DataFrame:
    """(split, y, weight): all rows of the split / rows of the class, over all sites."""
    n = rows.groupBy("split", "y").agg(F.count("*").alias("n"))
    return n.select("split", "y", (F.sum("n").over(Window.partitionBy("split")) / F.col("n")).alias("weight"))


def confusion(pairs: DataFrame, truth: str = "y", pred: str = "pred") -> DataFrame:
    return pairs.groupBy(F.col(truth).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def accuracy(pairs: DataFrame, truth: str = "y", pred: str = "pred") -> DataFrame:
    return pairs.agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def mcc_binary(pairs: DataFrame, truth: str = "y", pred: str = "pred") -> DataFrame:
    """From the four counts; 0 where a margin is empty."""
    both = lambda t, p: F.coalesce(F.sum(((F.col(truth) == t) & (F.col(pred) == p)).cast("bigint")), F.lit(0)).cast("double")
    counts = pairs.agg(both(1, 1).alias("tp"), both(0, 0).alias("tn"), both(0, 1).alias("fp"), both(1, 0).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    scale = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.select(F.when(scale > 0, (tp * tn - fp * fn) / scale).otherwise(0.0).alias("mcc"))


def mcc_multiclass(pairs: DataFrame, truth: str = "y", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """R_K statistic from the confusion counts, for each group ``by``; 0 where all truths or all predictions are one class."""
    n = pairs.groupBy(*by, F.col(truth).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").cast("double").alias("n"))
    # Confusion counts, one row a class pair, are small: margins are sums over the other class.
    t = n.groupBy(*by, F.col("y").alias("c")).agg(F.sum("n").alias("t"))
    p = n.groupBy(*by, F.col("pred").alias("c")).agg(F.sum("n").alias("p"))
    margins = t.join(p, [*by, "c"], "full").select(*by, F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("p", F.lit(0.0)).alias("p"), F.lit(0.0).alias("n"), F.lit(0.0).alias("hit"))
    both = margins.unionByName(n.select(*by, F.lit(0.0).alias("t"), F.lit(0.0).alias("p"), "n", F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0.0).alias("hit")))
    sums = both.groupBy(*by).agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"), F.sum("n").alias("s"), F.sum("hit").alias("c"))
    scale = F.sqrt(F.col("s") * F.col("s") - F.col("pp")) * F.sqrt(F.col("s") * F.col("s") - F.col("tt"))
    return sums.select(*by, F.when(scale > 0, (F.col("c") * F.col("s") - F.col("tp")) / scale).otherwise(0.0).alias("mcc"))
