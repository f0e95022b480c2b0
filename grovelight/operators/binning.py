"""Equal-width and normal-quantile bins from per-site sufficient statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact


#: From so many edges on, a search halves them instead of comparing each.
HALVE_FROM = 64


def long_view(rows: DataFrame) -> DataFrame:
    return rows.select("split", "client", "row_id", "y", F.posexplode("features").alias("feature", "x"))


def site_statistics(rows: DataFrame) -> DataFrame:
    """(split, client, feature, n, sxx, sx, mn, mx) in one pass; the sums are the same in any order of the rows."""
    x = F.col("x")
    slots = long_view(rows).withColumns({"__q": exact.slot(x), "__qq": exact.slot(x * x)})
    parts = slots.groupBy("split", "client", "feature", "__q", "__qq").agg(F.count("*").alias("n"), exact.total_parts(x * x, F.col("__qq")).alias("xx"), exact.total_parts(x, F.col("__q")).alias("x"), F.min("x").alias("mn"), F.max("x").alias("mx"))
    sums = [exact.total(F.collect_list("xx")).alias("sxx"), exact.total(F.collect_list("x")).alias("sx")]
    return parts.groupBy("split", "client", "feature").agg(F.sum("n").alias("n"), *sums, F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def moments_partial(rows: DataFrame) -> DataFrame:
    return site_statistics(rows).select("split", "client", "feature", "n", "sxx", "sx")


def moments_global(partial: DataFrame) -> DataFrame:
    """Mean and population deviation over all sites, whose sums are added in order of the site."""
    ordered = lambda c: F.aggregate(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("client", c)))), F.lit(0.0), lambda a, v: a + v[c])
    sums = partial.groupBy("split", "feature").agg(F.sum("n").alias("n"), ordered("sx").alias("sx"), ordered("sxx").alias("sxx"))
    mean = F.col("sx") / F.col("n")
    return sums.select("split", "feature", mean.alias("mean"), F.sqrt(F.greatest(F.col("sxx") / F.col("n") - mean * mean, F.lit(0.0))).alias("stddev"))


def minmax_partial(rows: DataFrame) -> DataFrame:
    return long_view(rows).groupBy("split", "client", "feature").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))


def minmax_global(partial: DataFrame) -> DataFrame:
    return partial.groupBy("split", "feature").agg(F.min("mn").alias("mn"), F.max("mx").alias("mx"))


def bucket_edges(minmax: DataFrame, n_bins: int) -> DataFrame:
    """n_bins edges a feature; the upper end is left out."""
    edges = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: i * ((F.col("mx") - F.col("mn")) / n_bins) + F.col("mn"))
    return minmax.select("split", "feature", edges.alias("edges"))


def normal_quantiles(n_bins: int) -> list[float]:
    """n_bins - 1 quantiles of the standard normal at equal steps from 1/n to 1 - 1/n, then infinity."""
    lo, hi, k = 1 / n_bins, 1 - 1 / n_bins, n_bins - 1
    at = [lo + i * ((hi - lo) / (k - 1)) if k > 1 else lo for i in range(k)]
    return [NormalDist().inv_cdf(p) for p in at] + [float("inf")]


def zscore(x: Column, mean: Column, stddev: Column) -> Column:
    z = F.when(stddev != 0, (x - mean) / stddev).otherwise(0.0)
    return F.when(F.abs(z) == float("inf"), 0.0).otherwise(z)


def edge_table(rows: DataFrame, n_bins: int, quantile: tuple[int, ...] = ()) -> DataFrame:
    """(split, feature, kind, edges, mean, stddev) of all features, from training rows."""
    sites = site_statistics(rows)
    stats = minmax_global(sites).join(moments_global(sites), ["split", "feature"])
    wide = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: i * ((F.col("mx") - F.col("mn")) / n_bins) + F.col("mn"))
    is_quantile = F.col("feature").isin(list(quantile)) if quantile else F.lit(False)
    return stats.select("split", "feature", F.when(is_quantile, "quantile").otherwise("bucket").alias("kind"), F.when(is_quantile, F.array(*map(F.lit, normal_quantiles(n_bins)))).otherwise(wide).alias("edges"), "mean", "stddev")


def edges_below(edges: Column, value: Column, n_bins: int) -> Column:
    """How many of the ascending edges are at most ``value``: by halving where there are many."""
    if n_bins <= HALVE_FROM:
        return F.size(F.filter(edges, lambda edge: edge <= value))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        up = F.get(edges, middle) <= value
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(up, middle + 1).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(middle).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.size(edges).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n_bins.bit_length())), start, halve, lambda s: s["lo"])


def bin_of(x: Column, e: Column, n_bins: int) -> Column:
    """Bin of one value by one feature's edges (struct of kind, edges, mean, stddev); missing values go to the last."""
    value = F.when(e["kind"] == "quantile", zscore(x, e["mean"], e["stddev"])).otherwise(x)
    below = edges_below(e["edges"], value, n_bins) - F.when(e["kind"] == "quantile", 0).otherwise(1)
    return F.when(x.isNull() | F.isnan(x), F.lit(n_bins - 1)).otherwise(below)


def edges_by_feature(edges: list[Row]) -> list[tuple]:
    """A split's edges in order of the features, for ``bins_of``; edges that are no numbers are never passed."""
    known = [(e.kind, np.array(e.edges, np.float64), e.mean, e.stddev) for e in sorted(edges, key=lambda e: e.feature)]
    return [(kind, np.sort(at[~np.isnan(at)]), mean, stddev) for kind, at, mean, stddev in known]


def bins_of(x: np.ndarray, edges: list[tuple], n_bins: int) -> np.ndarray:
    """Bins of rows of equal length as ``bin_of`` has them, a feature at a time; NaN stands for a missing value."""
    out = np.empty(x.shape, np.int32)
    for f, (kind, at, mean, stddev) in enumerate(edges[: x.shape[1]]):
        v, missing = x[:, f], np.isnan(x[:, f])
        if kind == "quantile":
            with np.errstate(all="ignore"):
                z = (v - mean) / stddev if stddev else np.zeros(len(v))
            out[:, f] = np.searchsorted(at, np.where(np.isinf(z), 0.0, z), side="right")
        else:
            out[:, f] = np.searchsorted(at, v, side="right") - 1
        out[missing, f] = n_bins - 1
    return out


def matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, str, np.ndarray]]:
    """(rows, split, places) of a batch's rows of one split and length: where their values stand in the flat list column.
    Training rows are all of one length. No split may be null."""
    lengths = pc.list_value_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, names = np.cumsum(lengths) - lengths, batch.column("split").dictionary_encode()
    kinds, of = np.unique(names.indices.to_numpy().astype(np.int64) * (1 << 32) + lengths, return_inverse=True)
    for k, kind in enumerate(kinds.tolist()):
        own = np.flatnonzero(of == k)
        yield own, names.dictionary[kind >> 32].as_py(), starts[own][:, None] + np.arange(kind % (1 << 32))


def of_splits(batch: pa.RecordBatch, splits: list[str]) -> pa.RecordBatch:
    return batch.filter(pc.is_in(batch.column("split"), value_set=pa.array(splits, batch.column("split").type)))


def binner(edges: DataFrame, n_bins: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What adds ``bins`` to batches of rows, in a task; the edges are collected and broadcast at once."""
    known: dict[str, list] = {}
    for e in edges.select("split", "feature", "kind", "edges", "mean", "stddev").collect():
        known.setdefault(e.split, []).append(e)
    sent = edges.sparkSession.sparkContext.broadcast({split: edges_by_feature(own) for split, own in known.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = of_splits(batch, list(sent.value))
            features = batch.column("features")
            lengths = pc.list_value_length(features).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = features.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            bins, none = np.empty(len(x), np.int32), np.zeros(len(x), bool)
            for _, split, at in matrices(batch, "features"):
                by = sent.value[split]
                bins[at] = bins_of(x[at], by, n_bins)
                none[at[:, len(by) :]] = True  # features that the forest doesn't know
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(bins, mask=none), mask=pc.is_null(features))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "bins"])

    return run


def binned_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, T.StructField("bins", T.ArrayType(T.IntegerType()))])


def bin_batches(rows: DataFrame, edges: DataFrame, n_bins: int) -> DataFrame:
    """As ``bin_rows``, a batch and feature at a time: for edges that are settled, as their collection is a job of its own."""
    return rows.mapInArrow(binner(edges, n_bins), binned_schema(rows))


def bin_rows(rows: DataFrame, edges: DataFrame, n_bins: int) -> DataFrame:
    """``rows`` with ``bins``: a projection after a broadcast of one row of edges a split (features times bins doubles)."""
    packed = edges.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("feature", "kind", "edges", "mean", "stddev"))).alias("__edges"))
    return rows.join(F.broadcast(packed), "split").withColumn("bins", F.transform("features", lambda x, i: bin_of(x, F.get("__edges", i), n_bins))).drop("__edges")
