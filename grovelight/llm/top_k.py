"""Operator 8: exact top-k inner products by a three-phase uniform threshold.

The vectors are dealt by a hash of their ids to nodes, each of which scores its own rows alone. Phase 1: a node gives a
short list of its best entries for each query, about as many as chance would place there and some more. Phase 2: the
k-th best entry of a query's lists is a safe cutoff, as at least k vectors reach it; it is the same for all nodes.
Entries below it go, and a node whose list ends below it has nothing more to send. Phase 3: only the pairs of a query
and a node whose list may go on above the cutoff are scored again, and give every entry that reaches it.

A node holds at most ``NODE_ROWS`` vectors and a tile at most ``TILE_ROWS`` queries; a vector is sent once for each tile
and a query once for each node, in the narrowest integer type that holds all components.

Equal vectors score alike and ties go to the smaller id, so of equal vectors only the k + 1 smallest ids can matter,
and equal queries share one search for k + 1 results, from which each query's own id is left out.

Defined cases: null vectors, and vectors with null or non-finite components, take no part, nor do rows without id;
vectors of unequal length score over the shorter one's components; an id repeated with an equal vector counts once;
fewer than k others give them all; scores and components beyond 64 bits are held at the nearest 64-bit integer;
without queries or candidates the result is empty; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import settle

NODE_ROWS = 1 << 16
TILE_ROWS = 1 << 14
#: Scores held at once by a task.
CELLS = 1 << 23
LOWEST = -(1 << 63)
WIDTHS = {"tinyint": 1 << 7, "smallint": 1 << 15, "int": 1 << 31}


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of the vectors that take part, each once."""
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(sound).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))


def narrowest(rows: DataFrame) -> str:
    """The smallest integer type that holds every component of ``v``."""
    least, most = rows.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    return next((kind for kind, end in WIDTHS.items() if least is None or -end <= least and most < end), "bigint")


def matrix(column: pa.ChunkedArray, width: int, kind: type) -> np.ndarray:
    """Rows of the lists, zeros beyond their ends."""
    column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths(), np.int64)
    values = np.asarray(column.flatten(), np.int64)
    out = np.zeros((len(lengths), width), kind)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def scored(left: pa.Table, right: pa.Table, cells: int = CELLS) -> Iterator[tuple[slice, np.ndarray]]:
    """(queries, their scores with every vector), some queries at a time.

    Products are exact: of floats while all sums are integers that the floats hold, else of Python's integers.
    """
    sides = [t.column("v") for t in (left, right)]
    width = max(pc.max(pc.list_value_length(v)).as_py() for v in sides)
    ends = [pc.min_max(pc.list_flatten(v)).as_py().values() for v in sides]
    bound = width
    for end in ends:
        bound *= max((abs(x) for x in end if x is not None), default=0)
    kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object
    q, d = (matrix(v, width, kind) for v in sides)
    step = max(1, cells // len(d))
    for a in range(0, len(q), step):
        scores = q[a : a + step] @ d.T
        yield slice(a, a + step), np.clip(scores, -(1 << 63), (1 << 63) - 1).astype(np.int64) if kind is object else scores


LISTS = "query bigint, d int, vec_id bigint, score bigint, floor bigint"


def lists_of(found: list[tuple], d: int) -> pa.Table:
    """Rows of ``LISTS`` from (query, vec_id, score, floor) arrays."""
    query, vec, score, floor = (np.concatenate([f[i] for f in found] or [np.zeros(0)]) for i in range(4))
    whole = lambda x: pa.array(np.asarray(x).astype(np.int64))
    return pa.table({"query": whole(query), "d": pa.array(np.full(len(query), d, np.int32)), "vec_id": whole(vec), "score": whole(score), "floor": whole(floor)})


def search(vectors: DataFrame, is_query: Column, k: int, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, node_rows: int = NODE_ROWS, tile_rows: int = TILE_ROWS, length: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors. ``is_query`` is a condition on vec_id.

    ``length`` is that of phase 1's lists; any length of 1 or more gives the same result.
    """
    rows = settle(integers(vectors, id_col, vector_col, scale), "vectors")
    rows = rows.withColumn("v", F.col("v").cast(f"array<{narrowest(rows)}>"))
    equal = Window.partitionBy("v").orderBy("vec_id")
    data = settle(rows.distinct().withColumn("nth", F.row_number().over(equal)).filter(F.col("nth") <= k + 1).drop("nth"), "candidates")
    asked = rows.filter(is_query).distinct()
    queries = settle(asked.groupBy("v").agg(F.min("vec_id").alias("query")), "queries")
    n, m = data.count(), queries.count()
    # A sixteenth of either side, so that a small table still gives work to many tasks, within the bounds of memory.
    nodes = max(1, -(-n // min(node_rows, max(4096, n // 16))))
    tiles = max(1, -(-m // min(tile_rows, max(1024, m // 16))))
    chance = (k + 1) / nodes
    most = length or min(k + 1, math.ceil(chance + 3 * math.sqrt(chance)) + 1)

    def gather(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            query, vec = left.column("query").to_numpy(), right.column("vec_id").to_numpy()
            take = min(most, len(vec))
            for part, scores in scored(left, right):
                at = np.argpartition(scores, len(vec) - take, axis=1)[:, len(vec) - take :]
                best = np.take_along_axis(scores, at, 1).astype(np.int64)
                # What a node has not sent is at most its list's last score; a list of all its rows ends below any.
                floor = best.min(1) if take < len(vec) else np.full(len(best), LOWEST)
                found.append((np.repeat(query[part], take), vec[at].ravel(), best.ravel(), np.repeat(floor, take)))
        return lists_of(found, key[1].as_py())

    def resolve(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            query, vec, cutoff = left.column("query").to_numpy(), right.column("vec_id").to_numpy(), left.column("cutoff").to_numpy()
            for part, scores in scored(left, right):
                for one, row, least in zip(query[part], scores.astype(np.int64), cutoff[part]):
                    at = np.flatnonzero(row >= least)
                    at = at[np.lexsort((vec[at], ~row[at]))][: k + 1]
                    found.append((np.full(len(at), one), vec[at], row[at], np.full(len(at), LOWEST)))
        return lists_of(found, key[1].as_py())

    place = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt, tiled = data.withColumn("d", place("vec_id", nodes)), queries.withColumn("q", place("query", tiles))
    by = lambda df: df.groupBy("q", "d")
    lists = settle(by(tiled.withColumn("d", each(nodes))).cogroup(by(dealt.withColumn("q", each(tiles)))).applyInArrow(gather, LISTS), "lists")

    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    first = lists.select("query", "vec_id", "score").withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1)
    cutoffs = settle(first.groupBy("query").agg(F.coalesce(F.when(F.count("*") > k, F.min("score")), F.lit(LOWEST)).alias("cutoff")), "cutoffs")
    # Settled, so Spark knows their size and broadcasts them only while that is under the session's threshold.
    judged = lists.join(cutoffs, "query").filter(F.col("score") >= F.col("cutoff"))
    goes_on = (F.col("floor") >= F.col("cutoff")) & (F.col("floor") > LOWEST)
    open_ = settle(judged.filter(goes_on).select("query", "d", "cutoff").distinct().join(tiled, "query"), "open")
    pairs = open_.select(F.col("q").alias("tile"), F.col("d").alias("node")).distinct()
    needed = dealt.join(pairs, F.col("d") == F.col("node")).select("vec_id", "v", F.col("tile").alias("q"), F.col("node").alias("d"))
    again = by(open_).cogroup(by(needed)).applyInArrow(resolve, LISTS)
    found = judged.filter(~goes_on).select("query", "vec_id", "score").unionByName(again.select("query", "vec_id", "score"))
    found = found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).drop("nth")

    ids = asked.join(queries, "v").select(F.col("vec_id").alias("query_id"), "query")
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    results = ids.join(found, "query").filter(F.col("vec_id") != F.col("query_id"))
    return results.select("query_id", F.row_number().over(own).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
