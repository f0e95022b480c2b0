"""Operator 3: benchmark decontamination by spaced-seed hashing.

Tokens are lower-case words without punctuation at their ends. Fixed masks over ``SPAN`` tokens ignore some
positions; each mask gives a hash at every position of every test item and every whole document. An item of fewer
tokens is one seed of all of them. A bitmap, sized to the number of seeds up to a fixed limit, keeps only document
positions that may match; a join on the hash finds which do. Around a hit, document and item are laid side by side at
the hit's offset and the best run of agreeing tokens is measured, where a substitution costs ``COST`` tokens. A run of
``least`` agreeing tokens (four fifths of an item of under ``least`` / 0.8 tokens, the whole of one under ``SPAN``) is a leak.

Defined cases: null and empty texts hold nothing and leak nothing; items under ``shortest`` tokens say too little and
match nothing; items of the same tokens count as one, under their smallest id; equal texts are verified once and each
of their rows is reported; with an empty table on either side there are no leaks; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WordHash, fresh, mix, pieces, settle, small_batches

#: Fixed masks: 1 is read, 0 is ignored.
MASKS = ("1111111111", "1110111011", "1101101111", "1011110111")
SPAN = 10
LEAST = 13
COST = 3
#: Items under this many tokens match nothing.
SHORTEST = 5
#: The bitmap has 1,024 bits a seed, 2**24 (2 MB) at least and 2**27 (16 MB) at most; a document tries every position.
BITS = (24, 27)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¿¡"


class TokenHash(WordHash):
    """raw word -> hash of its token; 0 for a word of punctuation only."""

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        bare = word.strip(PUNCTUATION)
        h = self[word] = (WordHash.__missing__(WordHash(), bare.encode("utf-8", "surrogatepass")) or 1) if bare else 0
        return h

    def tokens(self, text: str) -> np.ndarray:
        h = self.of(text.lower().split())
        return h[h != 0]


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask's window at every position."""
    n = max(0, len(tokens) - len(mask) + 1)
    h = np.full(n, int(mask, 2), np.uint64)
    for i in range(len(mask)):
        if mask[i] == "1":
            h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + n]
    return mix(h)


def masks_of(n: int) -> tuple[str, ...]:
    """Masks for an item of n tokens."""
    return MASKS if n >= SPAN else ("1" * n,) if n else ()


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def item_tables(items: DataFrame, id_col: str, text_col: str, shortest: int) -> DataFrame:
    """(item_id, tokens array<long>, seeds array<long>, places array<int>), items of equal tokens once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = TokenHash()
        for batch in batches:
            tokens = [words.tokens(t or "") for t in batch.column("text").to_pylist()]
            seeds = [[seed_hashes(t, m).view(np.int64) for m in masks_of(len(t))] for t in tokens]
            joined = lambda own, empty: np.concatenate(own) if own else empty
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array([t.view(np.int64) for t in tokens], pa.list_(pa.int64())), pa.array([joined(s, np.zeros(0, np.int64)) for s in seeds], pa.list_(pa.int64())), pa.array([joined([np.arange(len(x), dtype=np.int32) for x in s], np.zeros(0, np.int32)) for s in seeds], pa.list_(pa.int32()))],
                ["item_id", "tokens", "seeds", "places"],
            )

    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, f"item_id {kind}, tokens array<bigint>, seeds array<bigint>, places array<int>")
    return rows.filter(F.size("tokens") >= shortest).groupBy("tokens").agg(F.min("item_id").alias("item_id"), F.first("seeds").alias("seeds"), F.first("places").alias("places"))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the top ``bits`` bits of the hashes."""
    top = F.shiftrightunsigned("hash", 64 - bits)
    parts = hashes.select(F.bitmap_bucket_number(top).alias("bucket"), F.bitmap_bit_position(top).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    out = np.zeros(1 << bits, np.bool_)
    for part in parts:  # bucket 1 starts at value 1; bucket 0 holds value 0
        set_ = np.unpackbits(np.frombuffer(bytes(part.bits), np.uint8), bitorder="little")
        at = (part.bucket - 1) * 32768 + 1 + np.flatnonzero(set_) if part.bucket > 0 else np.zeros(1, np.int64)
        out[at[at < len(out)]] = True
    return np.packbits(out, bitorder="little")


def best_run(a: np.ndarray, b: np.ndarray) -> int:
    """Agreeing tokens of the best run of two equally long stretches; a substitution costs ``COST``."""
    same = a == b
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -COST))])
    low = np.minimum.accumulate(sums)
    end = int((sums - low).argmax())
    start = int(sums[: end + 1].argmin())
    return int(same[start:end].sum())


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """(key, doc_id, item_id, matched): each document that holds a benchmark item or a large part of one; key is text_key."""
    spark = docs.sparkSession
    test = settle(item_tables(items, item_col, item_text, shortest), "test-items")
    test_seeds = test.select("item_id", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select(F.col("s.seeds").alias("hash"), "item_id", F.col("s.places").alias("item_pos"))
    size = F.size("tokens")
    seen = test.agg(F.max(size).alias("longest"), F.sum(F.size("seeds")).alias("seeds"), F.collect_set(F.when(size < SPAN, size)).alias("short"), F.max(size >= SPAN).alias("long")).first()
    masks = (MASKS if seen.long else ()) + tuple("1" * n for n in sorted(seen.short))
    bits = min(max(BITS[0], (1024 * (seen.seeds or 0)).bit_length()), BITS[1])
    sent = spark.sparkContext.broadcast((bitmap(test_seeds, bits), seen.longest or 0))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, reach = sent.value
        words = TokenHash()
        for piece in pieces(batches):
            docs_tokens = [words.tokens(t) for t in piece.column("text").to_pylist()]
            tokens = np.concatenate([*docs_tokens, np.zeros(0, np.uint64)])
            ends = np.cumsum([len(t) for t in docs_tokens])
            seeds, pos, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for mask in masks:
                h = seed_hashes(tokens, mask)
                top = h >> np.uint64(64 - bits)
                at = np.flatnonzero((held[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8)) & 1)
                own = np.searchsorted(ends, at, side="right")
                inside = at + len(mask) <= ends[np.minimum(own, len(ends) - 1)]
                seeds.append(h[at[inside]]), pos.append(at[inside]), doc.append(own[inside])
            seeds, pos, doc = (np.concatenate(x) for x in (seeds, pos, doc))
            order = np.argsort(doc, kind="stable")
            found, first = np.unique(doc[order], return_index=True)
            rows: list[tuple] = []
            for d, own in zip(found, np.split(order, first[1:])):
                begin = ends[d] - len(docs_tokens[d])
                start, stop = max(0, pos[own].min() - begin - reach), pos[own].max() - begin + SPAN + reach
                rows.append((d, docs_tokens[d][start:stop].view(np.int64), seeds[own].view(np.int64), (pos[own] - begin - start).astype(np.int32)))
            if rows:
                at = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key").take(at), piece.column("doc_id").take(at), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int32()))],
                    ["key", "doc_id", "tokens", "hashes", "positions"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.filter(F.col(text_col).isNotNull()).select(text_key(F.col(text_col)).alias("key"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        found = settle(rows.mapInArrow(scan, f"key binary, doc_id {kind}, tokens array<bigint>, hashes array<bigint>, positions array<int>"), "seed-hits")
    texts = found.groupBy("key").agg(F.first(F.struct("tokens", "hashes", "positions")).alias("x")).select("key", "x.*")
    seeds = texts.select("key", F.explode(F.arrays_zip("hashes", "positions")).alias("s")).select("key", F.col("s.hashes").alias("hash"), F.col("s.positions").alias("pos"))
    pairs = seeds.join(test_seeds, "hash").select("key", "item_id", (F.col("pos") - F.col("item_pos")).alias("offset")).distinct()

    @F.arrow_udf("int")
    def matched(doc: pa.Array, item: pa.Array, offset: pa.Array) -> pa.Array:
        out = []
        for d, i, o in zip(doc, item, offset.to_pylist()):
            d, i = np.asarray(d.values), np.asarray(i.values)
            a, b = max(0, o), min(len(d), o + len(i))
            out.append(best_run(d[a:b], i[a - o : b - o]))
        return pa.array(out, pa.int32())

    side = pairs.join(texts.select("key", "tokens"), "key").join(test.select("item_id", F.col("tokens").alias("item")), "item_id")
    need = F.when(F.size("item") < SPAN, F.size("item")).otherwise(F.least(F.lit(least), F.ceil(F.size("item") * 0.8).cast("int")))
    sure = side.withColumn("matched", matched("tokens", "item", "offset")).filter(F.col("matched") >= need).groupBy("key", "item_id").agg(F.max("matched").alias("matched"))
    return found.select("key", "doc_id").join(sure, "key")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that leak; all columns and all other rows are kept."""
    at = fresh(docs.columns, "__key")
    found = leaks(docs, items, id_col=id_col, text_col=text_col).select(F.col("key").alias(at)).distinct()
    with small_batches(docs.sparkSession):
        bad = settle(found, "leaking-texts")
    return docs.withColumn(at, text_key(F.col(text_col))).join(bad, at, "left_anti").drop(at)
