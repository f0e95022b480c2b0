"""Operator 13: Merkle manifest of a dataset, with a proof for every row.

Each row is a leaf. The leaves of a group (a source, say) stand in order and every ``FAN`` consecutive nodes become one
until a single node, the group's subroot, is left; the subroots, in order of the groups, become the root in the same
way. H is lower-case hexadecimal SHA-256 over concatenated texts; nodes enter it as hexadecimal text.

Blocks of 4,096 consecutive nodes are reduced in the tasks, tier after tier, until at most ``TOP`` nodes are left. The
driver builds the small tree over those, and broadcasts each block's suffix path: its siblings from the block's root up.
The tasks then finish each row's path. ``fold`` recomputes a root from a leaf and its path, in the row.

Rows are numbered by a range sort of (group, order, digest); a random column splits runs of equal rows, which can take
each other's places. Texts are digested before anything is shuffled: digests and the ``carried`` columns move, never texts.

Defined cases: a null value enters a leaf as ``-``, an empty one as ``0:``; null groups are one group, the first; rows of
equal order stand in order of their leaves, nulls of the order first; repeated rows are leaves of their own; a run of one
node still becomes its H; a lone leaf is its group's subroot, a lone subroot the root; an empty table has no root (None)
and no proofs. Columns of any name may be carried, but no maps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, settle

FAN = 16
#: Levels that a task reduces at once: FAN ** STEP nodes a block.
STEP = 3
#: Nodes that the driver takes at most; their paths are a few megabytes.
TOP = 4096
PATH = "array<struct<at int, siblings array<string>>>"
SUFFIX = f"struct<path {PATH}, subroot string>"


@dataclass(frozen=True)
class Manifest:
    root: str | None
    #: (the carried columns as ``row``, leaf, subroot, path), one row a leaf.
    proofs: DataFrame


def digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def leaf(*values: Column) -> Column:
    """H of the values: ``-`` for null, else length in bytes, ``:`` and the value as text."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown]), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    join = lambda a, first, n: F.array_join(F.slice(a, first, n), "")
    step = lambda acc, p: F.sha2(F.concat(join(p["siblings"], F.lit(1), p["at"]), acc, join(p["siblings"], p["at"] + 1, F.size(p["siblings"]) - p["at"])), 256)
    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.flatten(F.transform(path, lambda p: p["siblings"]))


def levels(nodes: list[str], steps: int | None = None) -> list[list[str]]:
    """From the nodes up: ``steps`` levels, or as many as leave one node."""
    out = [nodes]
    while len(out) <= steps if steps is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return out


def path_of(tree: list[list[str]], i: int) -> list[dict]:
    out = []
    for level in tree[:-1]:
        run = level[i // FAN * FAN : i // FAN * FAN + FAN]
        out.append({"at": i % FAN, "siblings": run[: i % FAN] + run[i % FAN + 1 :]})
        i //= FAN
    return out


def place(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The settled rows to discard afterwards, and ``nodes`` with ``pos``, their 0-based place in their group g by ``order``, and ``size`` of the group."""
    keys = [F.col(c).asc_nulls_first() for c in ("g", *order, "digest")]
    row = settle(nodes.repartitionByRange(*keys, F.rand(7)).sortWithinPartitions(*keys).withColumn("line", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("line", 33)
    # A group's rows are one run of lines in each partition: partitions plus groups runs at most.
    runs = row.groupBy("g", part.alias("part")).agg(F.min("line").alias("first"), F.count("*").alias("n"))
    own = Window.partitionBy("g")
    before = F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select(F.col("g").alias("sg"), "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(own).alias("size"))
    placed = row.join(starts, F.col("g").eqNullSafe(F.col("sg")) & (part == F.col("part"))).withColumn("pos", F.col("line") + F.col("shift")).drop("sg", "part", "shift", "line")
    return row, placed


def own_tree(nodes: list[str], size: int, step: int) -> list[list[str]]:
    """Levels of one block of a group of ``size`` nodes."""
    return levels(nodes, step if size > FAN**step else None)


def reduced(nodes: DataFrame, tier: int, step: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (g, block, size, members) and their roots (g, block, size, digest), both settled; size is the group's."""
    width = FAN**step
    member = F.struct((F.col("pos") % width).cast("int").alias("at"), "digest", "row")
    blocks = nodes.groupBy("g", F.floor(F.col("pos") / width).alias("block"), "size").agg(F.array_sort(F.collect_list(member)).alias("members"))
    blocks = settle(blocks, f"blocks-{tier}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [own_tree(d, n, step)[-1][0] for d, n in zip(batch.column("digests").to_pylist(), batch.column("size").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("block"), batch.column("size"), pa.array(roots, pa.string())], ["g", "block", "size", "digest"])

    kind = nodes.schema["g"].dataType.simpleString()
    roots = blocks.select("g", "block", "size", F.col("members.digest").alias("digests")).mapInArrow(run, f"g {kind}, block bigint, size bigint, digest string")
    return blocks, settle(roots, f"roots-{tier}")


def top_tree(rows: list, grouped: bool) -> tuple[str, list[tuple]]:
    """The root, and (g, block, suffix) of the driver's nodes. ``grouped``: groups have trees of their own below the root."""
    order = lambda g: (g is not None, g.encode() if isinstance(g, str) else g)
    by: dict = {}
    for r in rows:
        by.setdefault(r.g, []).append(r)
    groups = sorted(by, key=order)
    trees = {g: levels([r.digest for r in sorted(by[g], key=lambda r: r.block)]) for g in groups}
    whole = levels([trees[g][-1][0] for g in groups])
    out = []
    for i, g in enumerate(groups):
        subroot = trees[g][-1][0] if grouped else None
        above = path_of(whole, i)
        out += [(g, b, {"path": path_of(trees[g], b) + above, "subroot": subroot}) for b in range(len(by[g]))]
    return whole[-1][0], out


def finished(blocks: DataFrame, suffixes, step: int) -> DataFrame:
    """(row, leaf, suffix): members' whole paths. ``suffixes``: a broadcast of the driver's, or a table (g, block, suffix)."""
    sent = None if isinstance(suffixes, DataFrame) else suffixes
    parts = blocks
    if sent is None:
        known = suffixes.select(F.col("g").alias("sg"), F.col("block").alias("sblock"), "suffix")
        parts = blocks.join(known, F.col("g").eqNullSafe(F.col("sg")) & (F.col("block") == F.col("sblock"))).drop("sg", "sblock")
    member = blocks.schema["members"].dataType.elementType
    row_type = member["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                members = batch.column("members").slice(k, 1).flatten()
                nodes = members.field("digest").to_pylist()
                tree = own_tree(nodes, batch.column("size")[k].as_py(), step)
                suffix = batch.column("suffix")[k].as_py() if sent is None else sent.value[batch.column("g")[k].as_py(), batch.column("block")[k].as_py()]
                for a in range(0, len(nodes), 512):
                    held = [{"path": path_of(tree, i) + suffix["path"], "subroot": suffix["subroot"]} for i in range(a, min(a + 512, len(nodes)))]
                    hop = pa.struct([("at", pa.int32()), ("siblings", pa.list_(pa.string()))])
                    made = pa.array(held, pa.struct([("path", pa.list_(hop)), ("subroot", pa.string())]))
                    piece = members.slice(a, 512)
                    yield pa.RecordBatch.from_arrays([piece.field("row"), piece.field("digest"), made], ["row", "leaf", "suffix"])

    return parts.mapInArrow(run, f"row {row_type}, leaf string, suffix {SUFFIX}")


def manifest(rows: DataFrame, leaf_of: Column, group: Column, order: list[Column], carried: list[Column | str], top: int = TOP, step: int = STEP) -> Manifest:
    """The manifest of ``rows`` under their leaves, groups and order; ``carried`` columns come back with each proof."""
    spark = rows.sparkSession
    keys = [f"o{i}" for i in range(len(order))]
    ordered, nodes = place(rows.select(group.alias("g"), *[o.alias(k) for o, k in zip(order, keys)], leaf_of.alias("digest"), F.struct(*carried).alias("row")), keys)
    blocks, roots = reduced(nodes, 0, step)
    discard(ordered)
    tiers, grouped, next_size = [(blocks, True)], True, F.ceil(F.col("size") / FAN**step).cast("bigint")
    while roots.count() > top:
        row = F.struct("g", "block", "digest").alias("row")
        if grouped and roots.filter(next_size > 1).isEmpty():  # every group has its subroot: one tree is left
            grouped = False
            _, nodes = place(roots.select(F.lit(0).alias("g"), F.col("g").alias("o0"), "digest", row), ["o0"])
        else:
            nodes = roots.select("g", F.col("block").alias("pos"), next_size.alias("size"), "digest", row)
        blocks, roots = reduced(nodes, len(tiers), step)
        tiers.append((blocks, grouped))
    held = roots.collect()
    discard(roots)
    root, suffixes = top_tree(held, grouped) if held else (None, [])
    out = finished(tiers[-1][0], spark.sparkContext.broadcast({(g, b): s for g, b, s in suffixes}), step)
    for (below, below_grouped), (_, above_grouped) in zip(tiers[-2::-1], tiers[:0:-1]):
        subroot = F.col("row.digest") if below_grouped and not above_grouped else F.col("suffix.subroot")
        suffix = F.struct(F.col("suffix.path").alias("path"), subroot.alias("subroot"))
        out = finished(below, out.select("row.g", "row.block", suffix.alias("suffix")), step)
    return Manifest(root, out.select("row", "leaf", F.col("suffix.subroot").alias("subroot"), F.col("suffix.path").alias("path")))
