"""Training and scoring of a forest over sites and splits; the model is a set of small tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RunConfig
from .functions.portable import discard, settle
from .operators import binning, grow, metrics, sampling, score


@dataclass(frozen=True)
class Forest:
    edges: DataFrame
    nodes: DataFrame
    trees: DataFrame
    n_bins: int
    depth: int
    mode: str
    weighted: bool

    def save(self, path: str) -> None:
        for name in ("edges", "nodes", "trees"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        meta = self.edges.sparkSession.createDataFrame([(self.n_bins, self.depth, self.mode, self.weighted)], "n_bins int, depth int, mode string, weighted boolean")
        meta.write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Forest:
        meta = spark.read.parquet(f"{path}/meta").first()
        return Forest(*(spark.read.parquet(f"{path}/{n}") for n in ("edges", "nodes", "trees")), meta.n_bins, meta.depth, meta.mode, meta.weighted)

    def predict_trees(self, rows: DataFrame) -> DataFrame:
        return score.predict_trees(rows.select(*score.KEY, "features"), self.nodes, self.depth, before=binning.binner(self.edges, self.n_bins))

    def predict(self, rows: DataFrame) -> DataFrame:
        """(split, client, row_id, pred) of raw features, of a table or a stream; trees vote by their weights if the forest was fitted so."""
        return score.predict_rows(rows.select(*score.KEY, "features"), self.nodes, self.depth, self.mode, self.trees if self.weighted else None, before=binning.binner(self.edges, self.n_bins))


def check_rows(rows: DataFrame) -> int:
    """Number of features. An empty table, rows of unequal length and missing labels are errors (ValueError)."""
    k = F.size("features")
    seen = rows.agg(F.min(k).alias("least"), F.max(k).alias("most"), F.count_if(F.col("y").isNull() | F.isnan("y")).alias("missing")).first()
    if seen.least is None:
        raise ValueError("there are no training rows")
    if seen.least != seen.most:
        raise ValueError("training rows differ in their number of features")
    if seen.missing:
        raise ValueError(f"{seen.missing} training rows have no label")
    return seen.least


def split_weights(rows: DataFrame, classes: tuple[float, ...]) -> DataFrame:
    """(split, weights): each split's own class weights in order of the classes; 0 for a class that it lacks."""
    by_class = metrics.class_weights(rows).groupBy("split").agg(F.map_from_entries(F.collect_list(F.struct("y", "weight"))).alias("m"))
    return by_class.select("split", F.array(*[F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)).cast("double") for c in classes]).alias("weights"))


def train(rows: DataFrame, config: RunConfig) -> Forest:
    """Fit all trees of all splits on ``rows`` (split, client, row_id, features, y).

    The rows are read several times: settle them first if they cost much. The classes of all splits, one value
    each, are collected; more than ``config.max_classes`` are an error. See ``check_rows`` for tables that are refused.
    """
    spark = rows.sparkSession
    n_features = check_rows(rows)
    edges = settle(binning.edge_table(rows, config.n_bins, config.quantile), "edges")
    binned = settle(binning.bin_batches(rows, edges, config.n_bins).select("split", "client", "row_id", "bins", "y"), "binned")
    classes = weights = None
    if config.mode == "classification":
        classes = tuple(r.y for r in rows.select("y").distinct().orderBy("y").limit(config.max_classes + 1).collect())
        if len(classes) > config.max_classes:
            raise ValueError(f"there are more than {config.max_classes} classes")
        weights = settle(split_weights(rows, classes), "class-weights") if config.use_weighted_classes else None
    features = settle(sampling.feature_subset(spark, config.n_estimators, n_features, sampling.feature_count(config.max_features, n_features), config.random_state), "tree-features")
    g = grow.Growth(config.n_bins, config.max_depth, config.min_samples_split, config.min_samples_leaf, classes, weights, config.weighted_gini, config.compat_min_reduction)
    if config.bootstrap_method == "poisson":
        state = settle(grow.own_state(sampling.poisson_bootstrap(binned, config.n_estimators, config.random_state, 1.0 if config.max_samples is None else config.max_samples)), "state")
    else:
        sample = settle(sampling.bootstrap(rows, config.n_estimators, config.random_state, config.max_samples, config.bootstrap), "bootstrap")
        state = settle(grow.initial_state(binned, sample), "state")
        discard(sample)
    discard(binned)
    nodes = grow.grow(state, features, g, config.run_folder)
    trees = nodes.select("split", "tree").distinct().withColumn("weight", F.lit(1.0))
    if config.oob:
        trees = settle(score.tree_weights(state, nodes, config.max_depth, config.oob_denominator), "trees")
    discard(state)
    return Forest(edges, nodes, trees, config.n_bins, config.max_depth, config.mode, config.oob)
