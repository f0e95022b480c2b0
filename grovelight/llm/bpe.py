"""Operator 1: byte-level BPE encoding and decoding.

Words (matches of the tokenizer's pattern) are counted over the whole corpus. Each frequent distinct word is
encoded once: a Spark higher-order function folds the ranked merges over its byte array, looking ranks up in a
literal map. The frequent words' ids (at most ``table_words`` of them, of ``LONG`` bytes at most, so the broadcast has
a fixed bound) go to the tasks; the distinct remaining words of a document are folded in its own row, each once, so no
text and no word position is ever shuffled. Decoding concatenates the tokens' binary pieces.

Defined cases: a null text is an empty one and gives no ids; equal ids and repeated rows each give their own row;
an empty table gives an empty table; other columns are ignored. A word of over ``LONG`` bytes is merged on a heap
(the fold takes quadratic time), with the same result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .letters import Splitter
from .merges import load_ranks, merge_word
from .shared import BATCH_ROWS, pieces, release_shuffles, settle, small_batches, text_rows  # noqa: F401

#: A word of up to LONG bytes is folded; its pairs' places take PLACE_BITS bits.
LONG = 96
PLACE_BITS = 7
PLACES = 1 << PLACE_BITS
RANK_BITS = 31 - PLACE_BITS
WINDOW = 256
TABLE_WORDS = 500_000
COUNTED_AT_ONCE = 250_000
PIECE = 1 << 18


class RankMap(NamedTuple):
    """The rank of each pair of adjacent pieces, as literal arrays: ``left`` gives a piece's row, the row's start plus
    the right piece's id is a slot, and the slot holds the left piece it belongs to plus one and the merged
    piece's id in one number, or 0. Each task reads literals object by object; all zeros are one object."""

    first: Column  # id of a byte, by the top byte of its crc32 (all 256 differ)
    left: Column
    slots: Column


def rank_map(ranks: dict[bytes, int]) -> RankMap:
    """Rows of pairs laid over each other, the longest first, each at the first start where
    its slots are free; starts that had no room for a longer row aren't tried again."""
    size = max(ranks.values(), default=-1) + 1
    rows: dict[int, dict[int, int]] = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                rows.setdefault(a, {})[b] = rank
    starts, slots = np.zeros(size, np.int64), np.zeros(size, np.int64)
    low = 0
    for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
        right = np.fromiter(sorted(row), np.int64, len(row))
        begin = slots[:0]
        while not len(begin):
            if low + WINDOW + size > len(slots):
                slots = np.concatenate([slots, np.zeros(size + WINDOW, np.int64)])
            begin = np.arange(low, low + WINDOW)
            for r in right:
                begin = begin[slots[begin + r] == 0]
                if not len(begin):
                    break
            low += 0 if len(begin) else WINDOW
        starts[a] = begin[0]
        slots[starts[a] + right] = [(a + 1 << RANK_BITS) + row[b] for b in right.tolist()]
    # Every slot that is asked for, even by a piece that starts no pair, is there.
    slots = np.concatenate([slots, np.zeros(max(0, int(starts.max(initial=0)) + size - len(slots)), np.int64)])
    first = sorted((zlib.crc32(bytes([b])) >> 24, ranks.get(bytes([b]), -1)) for b in range(256))

    def literal(values, kind: str = "int") -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")

    return RankMap(literal([rank for _, rank in first]), literal(starts.tolist()), literal(slots.tolist(), "bigint"))


def fold_merges(word: Column, table: RankMap) -> Column:
    """Ids of a non-empty binary word: fold over its byte array; each step makes the leftmost merge of lowest rank."""
    n = F.octet_length(word)
    start = F.transform(F.sequence(F.lit(1), n), lambda i: F.get(table.first, F.shiftright(F.crc32(F.substring(word, i, F.lit(1))), 24).cast("int")))

    def offer(left: Column, right: Column, k: Column) -> Column:
        slot = F.get(table.slots, F.get(table.left, left) + right)
        # The left piece's bits cancel out only if the slot is its own; any other slot gives a number above all ranks.
        return F.shiftleft(slot.bitwiseXOR(F.shiftleft(left.cast("bigint") + 1, RANK_BITS)), PLACE_BITS) + k

    def step(parts: Column, _: Column) -> Column:
        least = F.array_min(F.transform(parts, lambda left, k: offer(left, F.get(parts, k + 1), k)))

        def merge(found: Column) -> Column:
            i, made = found.bitwiseAND(F.lit(PLACES - 1)).cast("int"), F.shiftright(found, PLACE_BITS).cast("int")
            done = F.filter(F.transform(parts, lambda x, k: F.when(k == i, made).when(k != i + 1, x)), lambda x: x.isNotNull())
            return F.when(found < 1 << RANK_BITS + PLACE_BITS, done).otherwise(parts)

        # An array of one element, so that the least offer is worked out once.
        return F.get(F.transform(F.array(least), merge), F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step)


def count_words(rows: DataFrame, split: Splitter) -> DataFrame:
    """(word, n) of all words of up to ``LONG`` bytes: counted in the tasks first, a bounded number of words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            short = [w for w in counts if 4 * len(w) <= LONG or len(w.encode()) <= LONG]
            return pa.RecordBatch.from_arrays([pa.array(short, pa.string()), pa.array(list(map(counts.get, short)), pa.int64())], ["word", "n"])

        for piece in pieces(batches, most=PIECE):
            for text in piece.column("text"):
                counts.update(split(text.as_py()))
            if len(counts) > COUNTED_AT_ONCE:
                yield out()
                counts.clear()
        yield out()

    return rows.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(counts: DataFrame, table: RankMap, most: int) -> pa.Table:
    """(word, ids) of the most frequent words; how frequent follows from counts over all words, so at most ``most`` rows."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).filter("n > 1").orderBy(F.desc("n"))
    running, least = 0, None
    for row in by_count.toLocalIterator():
        if (running := running + row.words) > most:
            break
        least = row.n
    kept = counts.filter(F.col("n") >= F.lit(least if least is not None else 1 << 62))
    # Settled first: a plan that shuffles is described anew at each step, with all literals of the table.
    kept = settle(kept.select("word").repartition(max(1, kept.sparkSession.sparkContext.defaultParallelism), "word"), "frequent-words")
    return kept.select("word", fold_merges(F.col("word").cast("binary"), table).alias("ids")).toArrow().combine_chunks()


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Plans are described without their functions' arguments: each description would spell out all literals of the
    table once a level of nesting, hundreds of megabytes on the driver. What copies of the literals a plan leaves behind
    is collected before the next plan is made, as both together may not fit."""
    short = {"spark.sql.maxPlanStringLength": "20000", "spark.sql.debug.maxToStringFields": "0"}
    before = {name: spark.conf.get(name) for name in short}
    for name, value in short.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
        release_shuffles(spark)


class Known(dict):
    """word -> its place in the table, -1 for a word outside it."""

    def __missing__(self, word: str) -> int:
        return -1


class Vocabulary:
    """The table's words and their ids; words are put into a dictionary once a worker, not once a task."""

    def __init__(self, table: pa.Table):
        self.words, ids = (table.column(c).combine_chunks() for c in ("word", "ids"))
        self.flat_ids = np.append(np.asarray(ids.flatten(), np.int32), np.int32(0))
        self.starts = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths(), np.int64))])
        self.known: Known | None = None

    def places(self) -> Known:
        if self.known is None:
            self.known, self.words = Known(zip(self.words.to_pylist(), range(len(self.words)))), None
        return self.known


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", table_words: int = TABLE_WORDS) -> DataFrame:
    """(doc_id, ids array<int>): the ids of every whole text, without special tokens."""
    ranks = load_ranks(ranks_path)
    if max(ranks.values(), default=0) >= 1 << 31 - PLACE_BITS:
        raise ValueError("a rank and a place together have to fit in 31 bits")
    table, split = rank_map(ranks), Splitter.of(pattern)
    rows = text_rows(docs, id_col=id_col, text_col=text_col)
    with small_batches(docs.sparkSession):
        counts = settle(count_words(rows, split), "word-counts")
    with short_plans(docs.sparkSession):
        sent = docs.sparkSession.sparkContext.broadcast((Vocabulary(word_table(counts, table, table_words)), ranks))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, by_bytes = sent.value
        flat_ids, starts, place = vocabulary.flat_ids, vocabulary.starts, vocabulary.places().__getitem__
        for piece in pieces(batches, most=PIECE):
            texts = [split(t.as_py()) for t in piece.column("text")]
            doc_end = np.cumsum([len(t) for t in texts])
            flat = [w for t in texts for w in t]
            at = np.fromiter(map(place, flat), np.int64, len(flat))
            lengths = np.where(at >= 0, starts[at + 1] - starts[at], 0)
            lacking = np.flatnonzero(at < 0)
            merged, rare_at = {}, []
            for k in lacking.tolist():
                if len(word := flat[k].encode()) > LONG:
                    merged[k] = [by_bytes[p] for p in merge_word([bytes([c]) for c in word], lambda a, b: by_bytes.get(a + b), lambda a, b: a + b)]
                    lengths[k] = len(merged[k])
                else:
                    rare_at.append(k)
            ends = np.cumsum(lengths)
            source = np.repeat(np.where(at >= 0, starts[at], 0) - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
            values = flat_ids[np.minimum(source, len(flat_ids) - 1)]
            for k, m in merged.items():
                values[ends[k] - len(m) : ends[k]] = m
            # A document is known ids cut at each rare word: one more run of ids than rare words.
            rare_at = np.array(rare_at, np.int64)
            per_doc = np.diff(np.concatenate([[0], np.searchsorted(rare_at, doc_end)]))
            total = np.concatenate([[0], ends])
            cuts = np.sort(np.concatenate([total[rare_at], total[doc_end]]), kind="stable")
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], cuts]).astype(np.int32)), pa.array(values, pa.int32()))
            run_ends = np.concatenate([[0], np.cumsum(per_doc + 1)]).astype(np.int32)
            rare, which = [], []
            for own in np.split(rare_at, np.cumsum(per_doc)[:-1]):
                nth: dict[str, int] = {}
                which.append([nth.setdefault(flat[k], len(nth)) for k in own.tolist()])
                rare.append(list(nth))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.ListArray.from_arrays(pa.array(run_ends), runs), pa.array(rare, pa.list_(pa.string())), pa.array(which, pa.list_(pa.int32()))],
                ["doc_id", "runs", "rare", "which"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    cut = rows.mapInArrow(look_up, f"doc_id {kind}, runs array<array<int>>, rare array<string>, which array<int>")
    folded = F.transform("rare", lambda w: fold_merges(w.cast("binary"), table))
    put = lambda own: F.flatten(F.zip_with("runs", F.col("which"), lambda run, k: F.concat(run, F.coalesce(F.get(own, k), F.array().cast("array<int>")))))
    # An array of one element, so that the rare words are folded once a document.
    joined = F.get(F.transform(F.array(folded), put), F.lit(0))
    # Settled, so that no task keeps the workers that look words up beside those that decode or digest ids.
    with short_plans(docs.sparkSession), small_batches(docs.sparkSession):
        return settle(cut.select("doc_id", F.when(F.size("rare") == 0, F.flatten("runs")).otherwise(joined).alias("ids")), "ids")


def ids_bytes(ids: Column) -> Column:
    """Ids as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def packed(column: pa.Array) -> pa.Array:
        values = np.asarray(column.flatten(), "<i4").tobytes()
        ends = np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64))]) * 4
        return pa.array([values[a:b] for a, b in zip(ends, ends[1:])], pa.binary())

    return packed(ids)


def decode(ids: Column, ranks_path: str) -> Column:
    """Bytes of the ids: the tokens' binary pieces, one after the other. An id outside the vocabulary is an error."""
    ranks = load_ranks(ranks_path)
    by_id = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token

    @F.arrow_udf("binary")
    def joined(column: pa.Array) -> pa.Array:
        pieces = pa.array(by_id, pa.large_binary()).take(column.flatten())
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = memoryview(pieces.buffers()[2] or b"")
        ends = offsets[np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64))])] if len(pieces) else np.zeros(len(column) + 1, np.int64)
        return pa.array([bytes(data[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())

    return joined(ids)
