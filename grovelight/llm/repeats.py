"""Operator 12: passages that occur earlier in the corpus, found by suffixes of many short strings at once.

A window is ``width`` bytes. Its key is the least hash among its 32-byte seeds, so equal windows have equal keys, and
neighbouring windows mostly share one: runs of starts with one key are cut out as stretches of at most 128 windows. Keys
that occur once can hold no repeat and go first. Copies of whole texts are known by their digests; a bitmap of the first
ones, of bounded size, keeps nearly all copies out of the rest.
Equal stretches become one, under their first occurrence, in batches before the shuffle and again after it; all windows
of the others are repeats. The different stretches of a key meet in one task, which builds the Burrows-Wheeler transform
and the common prefixes of its collection (see ``collection_bwt``), reads off groups of suffixes that share ``width`` bytes,
and returns which windows of a stretch start earlier elsewhere. Keys of very many stretches take in most of the window's
bytes, so that only near-equal windows still meet. A row's windows then become spans of bytes. Equal texts and stretches are
told by 128-bit hashes; no other hash bears on the results.

"Earlier" is a smaller id, or the same row and a smaller start. Defined cases: null ids come first; rows of one id are
ordered by their texts' MD5; of repeated rows one comes first and all bytes of the others are repeats; null and empty
texts, and texts under ``width`` bytes, repeat nothing; an empty table gives none; other columns are ignored. Texts are
read as UTF-8 bytes, and a span may end inside a character. An id has to be of an orderable type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import collection_bwt
from .decontaminate import bitmap
from .shared import discard, fresh, mix, pieces, settle

WIDTH = 100
SEED = 32
#: Windows of a stretch at most.
STRETCH = 128
#: Bytes of stretches that a task builds a transform of, about.
PART_BYTES = 16 << 20
#: Keys of more stretches than this, and than a hundred-thousandth of all, take in more of a window's bytes.
HOT = 100_000
#: The bitmap of repeated keys: 64 bits a key within these bounds (2 to 16 MB).
BITS = (24, 27)
SLICE = 1 << 20
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def seed_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of every 32 bytes."""
    h, s = _LETTERS[raw], 1
    while s < SEED:
        h = h[:-s] * np.uint64(0xD6E8FEB86659FD93 + 2 * s) + h[s:]
        s *= 2
    return mix(h)


def least_seeds(h: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours."""
    s = 1
    while 2 * s <= n:
        h = np.minimum(h[:-s], h[s:])
        s *= 2
    return np.minimum(h[: len(h) - (n - s)], h[n - s :]) if n > s else h


def windows(raw: np.ndarray, width: int, hot: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first start, key of each window, whether its least seed is at another place than the former window's), by slices."""
    for a in range(0, len(raw) - width + 1, SLICE // 2):
        part = raw[a : a + SLICE // 2 + width - 1]
        h = seed_hashes(part)
        at = np.arange(len(h), dtype=np.uint64)
        low = least_seeds((h & ~np.uint64(SLICE - 1)) | at, width - SEED + 1)
        key = low >> np.uint64(20)
        moved = np.append(True, low[1:] != low[:-1])
        if len(hot):
            crowded = np.isin(key, hot)
            ends = [h[i : i + len(key)] for i in (0, (width - SEED) // 2, width - SEED)]
            finer = mix(mix(mix(key + ends[0]) + ends[1]) + ends[2]) >> np.uint64(20)
            key, moved = np.where(crowded, finer, key), moved | crowded
        yield a, key, moved


def joined(piece: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a batch's texts, and where each text begins and ends."""
    text = piece.column("text")
    bounds = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds[:-1] - bounds[0], bounds[1:] - bounds[0]


def wanted(batches: Iterator[pa.RecordBatch], firsts) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches without texts that are surely copies: first ones are all in the bitmap ``firsts``."""
    known, bits = firsts.value
    for piece in pieces(batches):
        top = piece.column("mark").to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        at = np.flatnonzero((known[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8)) & 1)
        if len(at):
            yield piece.take(pa.array(at)) if len(at) < piece.num_rows else piece


def texts_of(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, tie, text binary) of the texts that hold a window."""
    return docs.filter(F.octet_length(text_col) >= width).select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("tie"), F.col(text_col).cast("binary").alias("text"))


def key_counts(texts: DataFrame, width: int, hot: np.ndarray, firsts) -> DataFrame:
    """(hash, n): how often each key begins anew; hash holds the key in its top bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in wanted(batches, firsts):
            raw, begin, end = joined(piece, width)
            inside = np.zeros(len(raw) + 1, np.int32)
            np.add.at(inside, begin, 1), np.add.at(inside, end - width + 1, -1)
            inside = np.cumsum(inside)[:-1] > 0
            inside[begin], own = True, np.zeros(len(raw), bool)
            own[begin] = True
            for a, key, moved in windows(raw, width, hot):
                ok = inside[a : a + len(key)]
                keys, n = np.unique(key[ok & (moved | own[a : a + len(key)])], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((keys << np.uint64(20)).view(np.int64)), pa.array(n)], ["hash", "n"])

    return texts.select("mark", "text").mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))


def first_alike(bodies: pa.Array, order: np.ndarray) -> np.ndarray:
    """For each different value, the row of least ``order``; rows ascend."""
    code = bodies.dictionary_encode().indices.to_numpy()
    by = np.lexsort((order, code))
    return np.sort(by[np.append(True, np.diff(code[by]) != 0)]) if len(by) else by


def stretches(texts: DataFrame, width: int, hot: np.ndarray, held, firsts, bodies: bool) -> DataFrame:
    """(doc_id, tie, start, n) of the runs of windows whose key is in the bitmap; or, with their bytes, (key, twice, doc_id,
    tie, start, n, body), of equal ones in a batch the first. ``twice``: a key may recur inside."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = held.value
        for piece in wanted(batches, firsts):
            raw, begin, end = joined(piece, width)
            table = pa.table([piece.column("doc_id"), piece.column("tie")], ["doc_id", "tie"])
            nth_doc = np.empty(piece.num_rows, np.int64)
            nth_doc[pc.sort_indices(table, [("doc_id", "ascending"), ("tie", "ascending")], null_placement="at_start").to_numpy()] = np.arange(piece.num_rows)
            for a, key, moved in windows(raw, width, hot):
                changed = np.append(True, key[1:] != key[:-1])
                changed[begin[np.searchsorted(begin, a) : np.searchsorted(begin, a + len(key))] - a] = True
                first = np.flatnonzero(changed)
                top = key[first] >> np.uint64(44 - bits)
                held_ = (known[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8)) & 1 > 0
                last = np.append(first[1:], len(key))[held_]
                first = first[held_]
                doc = np.searchsorted(begin, first + a, side="right") - 1
                last = np.minimum(last, end[doc] - width + 1 - a)
                ok = last > first
                first, last, doc = first[ok], last[ok], doc[ok]
                if not len(first):
                    continue
                # Long runs are cut.
                cuts = -(-(last - first) // STRETCH)
                nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                first, last, doc = np.repeat(first, cuts) + nth * STRETCH, np.repeat(last, cuts), np.repeat(doc, cuts)
                last = np.minimum(last, first + STRETCH)
                n, start = (last - first).astype(np.int32), first + a
                place = [piece.column("doc_id"), piece.column("tie")]
                if not bodies:
                    d = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([*(c.take(d) for c in place), pa.array(start - begin[doc]), pa.array(n)], ["doc_id", "tie", "start", "n"])
                    continue
                # A stretch whose least seed moves without a change of key holds that seed more than once.
                moves = np.append(0, np.cumsum(moved))
                twice = moves[last] > moves[first + 1]
                for b in range(0, len(first), 50_000):
                    s, m, d = start[b : b + 50_000], n[b : b + 50_000], doc[b : b + 50_000]
                    length = m + width - 1
                    ends = np.concatenate([[0], np.cumsum(length)])
                    body = raw[np.repeat(s - ends[:-1], length) + np.arange(ends[-1])]
                    made = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(body)])
                    one = first_alike(made, nth_doc[d] * len(raw) + s)
                    for c in range(0, len(one), 10_000):
                        o = one[c : c + 10_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key[first[b + o]].view(np.int64)), pa.array(twice[b + o]), *(x.take(pa.array(d[o])) for x in place), pa.array(s[o] - begin[d[o]]), pa.array(m[o]), made.take(pa.array(o))],
                            ["key", "twice", "doc_id", "tie", "start", "n", "body"],
                        )

    more = ("key bigint, twice boolean, ", ", body binary") if bodies else ("", "")
    return texts.mapInArrow(run, f"{more[0]}doc_id {kind}, tie binary, start bigint, n int{more[1]}")


def shared_runs(raw: np.ndarray, bounds: np.ndarray, width: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Stretches without the windows that nothing here can equal, as a hash of most of their bytes occurs once: the bytes and
    bounds of the runs that are left, in order, and each run's first window and stretch."""
    h = seed_hashes(raw)
    n = len(raw) - width + 1
    mark = mix(mix(h[:n] + h[(width - SEED) // 2 :][:n]) + h[width - SEED :][:n])
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    at = np.flatnonzero(np.arange(n) + width <= bounds[of + 1])
    order = np.argsort(mark[at])
    same = np.diff(mark[at][order]) == 0
    kept = np.zeros(n, bool)
    kept[at[order[np.append(False, same) | np.append(same, False)]]] = True
    at = np.flatnonzero(kept)
    new = np.append(True, (np.diff(at) != 1) | (np.diff(of[at]) != 0))[: len(at)]
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(at))) + width - 1
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    start = at[first]
    return (raw[np.repeat(start - ends[:-1], length) + np.arange(ends[-1])], ends), start - bounds[of[start]], of[start]


def marks(found: DataFrame, width: int, parts: int) -> DataFrame:
    """(doc_id, tie, start, n, bits): for each different stretch, a bit for each window that starts earlier."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        light, bodies, seen = [], [], set()
        for batch in batches:  # in order of the documents: the first of equal stretches comes first
            hashes = [xxhash.xxh3_128_digest(b.as_buffer()) for b in batch.column("body")]
            new = [i for i, h in enumerate(hashes) if not (h in seen or seen.add(h))]
            batch = batch.take(pa.array(new, pa.int64()))
            light.append(batch.drop_columns(["body"]))
            bodies.append(batch.column("body"))
        if not seen:
            return
        rows, body = pa.Table.from_batches(light).combine_chunks().to_batches()[0], pa.chunked_array(bodies).combine_chunks()
        del seen, light, bodies
        keys, place, count = np.unique(rows.column("key").to_numpy(), return_inverse=True, return_counts=True)
        meet = np.flatnonzero((count[place] > 1) | rows.column("twice").to_numpy(zero_copy_only=False))
        bits = np.zeros((rows.num_rows, STRETCH // 8), np.uint8)
        if len(meet):
            own = body.take(pa.array(meet))
            bounds = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
            raw = np.frombuffer(own.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
            text, begin, stretch = shared_runs(raw, bounds - bounds[0], width)
            later = collection_bwt.later_copies(text[0], text[1], width)
            at = begin[later[:, 0]] + later[:, 1]
            np.bitwise_or.at(bits, (meet[stretch[later[:, 0]]], at >> 3), (1 << (at & 7)).astype(np.uint8))
        packed = pa.Array.from_buffers(pa.binary(STRETCH // 8), rows.num_rows, [None, pa.py_buffer(bits)]).cast(pa.binary())
        for a in range(0, rows.num_rows, 50_000):
            yield pa.RecordBatch.from_arrays([*(rows.column(c).slice(a, 50_000) for c in ("doc_id", "tie", "start", "n")), packed.slice(a, 50_000)], ["doc_id", "tie", "start", "n", "bits"])

    sent = found.repartition(parts, "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "start")
    return sent.mapInArrow(run, f"doc_id {kind}, tie binary, start bigint, n int, bits binary")


def spans_of(found: DataFrame, width: int) -> DataFrame:
    """(doc_id, tie, spans) from (doc_id, tie, start, n, bits); a stretch without bits repeats an earlier one."""
    kind = found.schema["doc_id"].dataType.simpleString()
    grouped = found.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("start", "n", "bits")).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("x")).to_numpy())
            for piece in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(ends // 100_000)) + 1):
                if not len(piece):
                    continue
                part = batch.slice(int(piece[0]), len(piece))
                x = part.column("x").flatten()
                doc = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("x")).to_numpy())
                start, n, known = x.field("start").to_numpy(), x.field("n").to_numpy(), np.array(x.field("bits").is_valid())
                bits = np.full((len(x), STRETCH // 8), 255, np.uint8)
                bits[known] = np.frombuffer(b"".join(x.field("bits").drop_null().to_pylist()), np.uint8).reshape(-1, STRETCH // 8)
                # Of the rows of one stretch, the one with bits.
                order = np.lexsort((~known, start, doc))
                new = np.append(True, (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0))
                one = order[new]
                flags = np.unpackbits(bits[one], axis=1, bitorder="little").astype(bool) & (np.arange(STRETCH) < n[one][:, None])
                row, window = np.nonzero(flags)
                at, of = start[one][row] + window, doc[one][row]
                cut = np.append(True, (np.diff(at) > width) | (np.diff(of) != 0))[: len(at)]
                first = np.flatnonzero(cut)
                last = np.append(first[1:], len(at)) - 1 if len(first) else first
                values = pa.StructArray.from_arrays([pa.array(at[first]), pa.array(at[last] + width)], ["start", "stop"])
                sizes = np.bincount(of[first], minlength=part.num_rows)
                made = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), made], ["doc_id", "tie", "spans"])

    return grouped.mapInArrow(run, f"doc_id {kind}, tie binary, spans array<struct<start bigint, stop bigint>>").filter(F.size("spans") > 0)


def later_rows(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, tuple[np.ndarray, int]]:
    """(doc_id, tie, n_bytes) of the texts that are copies of a whole text of a smaller id, settled; and a bitmap of the others."""
    rows = texts_of(docs, id_col, text_col, width).select("doc_id", "tie", F.octet_length("text").cast("long").alias("n_bytes")).distinct()
    rows = settle(rows, "texts")
    firsts = rows.groupBy("tie").agg(F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("none"))
    firsts = settle(firsts.select(F.col("tie").alias("ftie"), F.when(~F.col("none"), F.col("first")).alias("first")), "first-texts")
    copies = settle(rows.join(firsts, (F.col("tie") == F.col("ftie")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_anti"), "copies")
    bits = min(max(BITS[0], (64 * firsts.count()).bit_length()), BITS[1])
    known = bitmap(firsts.select(F.xxhash64("first", "ftie").alias("hash")), bits)
    discard(rows)
    discard(firsts)
    return copies, (known, bits)


def repeated_spans(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, tie, spans array<struct<start, stop>>, whole): bytes covered by windows that start earlier, maximal, in order.

    One row for each different (id, text) with spans; ``tie`` is the text's MD5; ``whole`` says that it is a copy of a whole
    text. See ``repeats`` for repeated rows.
    """
    if not SEED <= width <= 250 - STRETCH + 1:
        raise ValueError(f"width must be from {SEED} to {250 - STRETCH + 1} bytes")
    spark = docs.sparkSession
    copies, known = later_rows(docs, id_col, text_col, width)
    firsts = spark.sparkContext.broadcast(known)
    texts = texts_of(docs, id_col, text_col, width).withColumn("mark", F.xxhash64("doc_id", "tie"))
    none = np.zeros(0, np.uint64)
    counts = settle(key_counts(texts, width, none, firsts).filter("n > 1"), "repeated-keys")
    crowd = max(hot, (counts.agg(F.sum("n")).first()[0] or 0) // 100_000)
    crowded = np.array([r.hash for r in counts.filter(F.col("n") > crowd).select("hash").collect()], np.int64).view(np.uint64) >> np.uint64(20)
    if len(crowded):
        discard(counts)
        counts = settle(key_counts(texts, width, crowded, firsts).filter("n > 1"), "repeated-keys")
    seen = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    bits = min(max(BITS[0], (64 * seen.keys).bit_length()), BITS[1])
    held = spark.sparkContext.broadcast((bitmap(counts.select("hash"), bits), bits))
    discard(counts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen.n * (width + 50) // part_bytes))
    marked = settle(marks(stretches(texts, width, crowded, held, firsts, True), width, parts), "marks")
    every = stretches(texts, width, crowded, held, firsts, False).withColumn("bits", F.lit(None).cast("binary"))
    spans = spans_of(every.unionByName(marked), width).withColumn("whole", F.lit(False))
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    every = spans.unionByName(copies.select("doc_id", "tie", all_of_it.alias("spans"), F.lit(True).alias("whole")))
    # A copy that the bitmap lets through has been found again as repeats of all its windows.
    out = settle(every.groupBy("doc_id", "tie").agg(F.max_by("spans", "whole").alias("spans"), F.max("whole").alias("whole")), "spans")
    discard(marked)
    discard(copies)
    return out


def without(text: Column, spans: Column) -> Column:
    """The bytes of a binary text outside its spans."""

    @F.arrow_udf("binary")
    def cut(texts: pa.Array, parts: pa.Array) -> pa.Array:
        out = []
        for t, p in zip(texts, parts.to_pylist()):
            raw, at, kept = t.as_buffer(), 0, []
            for span in p:
                kept.append(raw.slice(at, span["start"] - at).to_pybytes())
                at = span["stop"]
            out.append(b"".join([*kept, raw.slice(at).to_pybytes()]))
        return pa.array(out, pa.binary())

    return cut(text, spans)


def repeats(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row a row of ``docs``: (doc_id, n_bytes, text_sha256, spans, kept_sha256); kept are the bytes outside the spans.

    Rows without spans are digested where they are read; only the others' texts meet their spans in a join.
    """
    spans = repeated_spans(docs, width=width, id_col=id_col, text_col=text_col, **settings)
    whole = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(whole)).alias("tie"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("text_sha256"))
    alike = rows.groupBy("doc_id", "tie", "n_bytes", "text_sha256").agg(F.count("*").alias("rows"))
    own = spans.filter(~F.col("whole")).withColumnsRenamed({"doc_id": "sid", "tie": "stie"})
    nothing_left = F.sha2(F.lit("").cast("binary"), 256)
    copies = spans.filter("whole").select("doc_id", "tie", "spans", nothing_left.alias("kept_sha256"))
    same = F.col("doc_id").eqNullSafe(F.col("sid")) & (F.col("tie") == F.col("stie"))
    cut = texts_of(docs, id_col, text_col, width).join(own, same).select("doc_id", "tie", "spans", F.sha2(without(F.col("text"), F.col("spans")), 256).alias("kept_sha256"))
    cut = cut.groupBy("doc_id", "tie").agg(F.first("spans").alias("spans"), F.first("kept_sha256").alias("kept_sha256")).unionByName(copies).withColumnsRenamed({"doc_id": "sid", "tie": "stie"})
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("nth")
    each = alike.join(cut, same, "left").select("doc_id", "n_bytes", "text_sha256", "spans", "kept_sha256", nth)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    copy = (F.col("nth") > 1) & (F.col("n_bytes") >= width)
    return each.select("doc_id", "n_bytes", "text_sha256", F.when(copy, all_of_it).otherwise(F.coalesce("spans", F.slice(all_of_it, 2, 1))).alias("spans"), F.when(copy, nothing_left).otherwise(F.coalesce("kept_sha256", "text_sha256")).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` with a binary column ``kept``: each different (id, text) once, its bytes outside the spans."""
    names = docs.columns
    tie, kept, sid, stie, spans_col = (fresh([*names, "doc_id", "tie"], c) for c in ("tie", "kept", "sid", "stie", "spans"))
    spans = repeated_spans(docs, width=width, id_col=id_col, text_col=text_col, **settings).select(F.col("doc_id").alias(sid), F.col("tie").alias(stie), F.col("spans").alias(spans_col))
    whole = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.withColumn(tie, F.unhex(F.md5(whole))).dropDuplicates([id_col, tie])
    own = rows.join(spans, F.col(id_col).eqNullSafe(F.col(sid)) & (F.col(tie) == F.col(stie)), "left")
    return own.withColumn(kept, F.when(F.col(spans_col).isNull(), whole).otherwise(without(whole, F.coalesce(F.col(spans_col), F.array())))).select(*names, kept)
