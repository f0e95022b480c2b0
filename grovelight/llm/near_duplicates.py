"""Operator 10: near-duplicates by MinHash: one-permutation hashing, banded buckets, star-shaped candidates.

A document's set holds its distinct 5-word shingles (words: lower-case A-Z, split at ASCII white space). One hash a
shingle gives the whole signature: the top bits pick a bin, each bin keeps its least hash, and an empty bin copies the
bin that its own hash sequence names first (optimal densification). Documents of equal sets are one class before
anything is compared. Classes that share a band's bucket are linked to the bucket's centre only, so a bucket of n
gives n - 1 candidate pairs and not n(n-1)/2. Each pair is confirmed on the full sets. That alone could lose a link
between two members that both miss the centre, so the members of buckets that still hold several components go
through an exact join: sets ordered by how rare their shingles are can only be similar if they share a shingle among
their first ones, early enough that what follows in both can make up the intersection.

A shingle found in one compared set only can be in no intersection. So a set of n shingles, ``own`` of them its own,
shares n - own at most, and pairs (and members of a bucket) that this bound rules out are never formed. It loses no
link, and leaves little of the pairs that a long shared passage or many edits of one text would give. The centre is
the member with the fewest own shingles: in a group of edited copies, the text nearest to the unedited one.

Defined cases: null and empty texts and texts of white space have an empty set, are linked with nothing and kept;
a text of fewer than five words is one shingle; repeated rows are one class; an empty table gives none; other columns
are ignored. Rows of a null id take part like others, but null is never a component_id while another id is there.
One row of each component is kept: that of the smallest id (null last), of its rows the one numbered first. Rows are
told apart by that number and never by id, so the texts of a repeated id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WordHash, discard, fresh, mix, pieces, settle, text_rows

WORDS = 5
BANDS = 24
ROWS = 5
PERCENT = 80
_BINS = BANDS * ROWS
_TRIES = 4096


def shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word sequences; of all words as one sequence, if they are fewer."""
    n, size = len(words), min(len(words), WORDS)
    if n == 0:
        return np.zeros(0, np.uint64)
    h = np.full(n - size + 1, 0 if size == WORDS else size, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - size + 1 + i]
    return np.unique(mix(h))


def detours() -> np.ndarray:
    """For each try and bin, the bin to borrow from: fixed pseudo-random sequences."""
    cell = np.arange(_TRIES * _BINS, dtype=np.uint64).reshape(_TRIES, _BINS)
    return (mix(cell + np.uint64(1)) % np.uint64(_BINS)).astype(np.int64)


def signature(hashes: np.ndarray, borrow: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of a non-empty sorted set, densified."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, full = np.zeros(_BINS, np.uint64), np.zeros(_BINS, np.bool_)
    out[bins[first]], full[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    at = 0
    source = np.full(len(empty), bins[first[0]])
    left = np.arange(len(empty))
    while len(left) and at < _TRIES:
        tries = borrow[at : at + 16][:, empty[left]]
        ok = full[tries]
        hit = ok.any(0)
        source[left[hit]] = tries[ok.argmax(0), np.arange(len(left))][hit]
        left, at = left[~hit], at + 16
    out[empty] = out[source]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def set_key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def words_of(words: WordHash, text: bytes) -> np.ndarray:
    return words.of(text.lower().split())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, borrow = WordHash(), detours()
    for piece in pieces(batches):
        sets = [shingles(words_of(words, t)) for t in piece.column("text").cast(pa.binary()).to_pylist()]
        keys = [set_key(s) if len(s) else None for s in sets]
        bands = [band_keys(signature(s, borrow)) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays(
            [piece.column("row"), piece.column("doc_id"), piece.column("mark"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["row", "doc_id", "mark", "n_shingles", "key", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHash()
    for piece in pieces(batches):
        sets = [shingles(words_of(words, t)) for t in piece.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["key", "hashes"])


def components(edges: DataFrame) -> DataFrame:
    """(v, comp): the least vertex that each vertex of the edges (a, b) reaches. Neighbour minimum, then pointer jump."""
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = table = settle(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("v"), "comp"), "labels")
    while True:
        seen = both.join(labels.select(F.col("v").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        nearer = labels.join(seen, F.col("v") == F.col("a")).select("v", "comp", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("comp").alias("far"))
        after = settle(nearer.join(jump, "low").select("v", F.least("low", "far").alias("comp"), (F.least("low", "far") != F.col("comp")).alias("moved")), "labels")
        discard(table)
        labels, table = after.select("v", "comp"), after
        if after.filter("moved").isEmpty():
            discard(both)
            return labels


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    full = pairs.join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return full.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def missed_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (key, n, comp) of different components that can be similar, every similar one among them."""
    tokens = settle(sets.join(members, "key").select("key", "n", "comp", F.explode("hashes").alias("hash")), "open-shingles")
    counted = tokens.join(tokens.groupBy("hash").agg(F.count("*").alias("sets")), "hash")
    turn = F.row_number().over(Window.partitionBy("key").orderBy("sets", "hash"))
    needed = F.ceil(F.col("n") * percent / 100)
    first = counted.withColumn("i", turn).filter((F.col("i") <= F.col("n") - needed + 1) & (F.col("sets") > 1))
    first = settle(first.select("hash", "key", "n", "comp", "i"), "first-shingles")
    discard(tokens)
    # From place i on, n - i + 1 shingles are left; they must do for the smallest set that has the shingle.
    able = first.join(first.groupBy("hash").agg(F.min("n").alias("least_n")), "hash").filter((100 + percent) * (F.col("n") - F.col("i") + 1) >= percent * (F.col("n") + F.col("least_n")))
    mixed = able.groupBy("hash").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("hash")
    able = settle(able.join(mixed, "hash", "left_semi").select("hash", "key", "n", "comp", "i"), "able-shingles")
    discard(first)
    other = able.select("hash", F.col("key").alias("c"), F.col("n").alias("cn"), F.col("comp").alias("ccomp"), F.col("i").alias("ci"))
    left = F.least(F.col("n") - F.col("i"), F.col("cn") - F.col("ci")) + 1
    pairs = able.join(other, "hash").filter((F.col("key") < F.col("c")) & (F.col("comp") != F.col("ccomp")) & ((100 + percent) * left >= percent * (F.col("n") + F.col("cn"))))
    return pairs.select(F.col("key").alias("a"), F.col("c").alias("b")).distinct()


def judge(docs: DataFrame, row: Column, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n_shingles, component_id, kept) of every document; ``row`` numbers the rows and is read once."""
    rows = text_rows(docs, row.alias("row"), id_col=id_col, text_col=text_col).withColumn("mark", F.xxhash64("doc_id", "text"))
    kind = docs.schema[id_col].dataType.simpleString()
    signed = settle(rows.mapInArrow(_signatures, f"row bigint, doc_id {kind}, mark bigint, n_shingles bigint, key binary, bands array<bigint>"), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row"))
    classes = signed.filter("key is not null").groupBy("key").agg(least.alias("least"), F.first("mark").alias("mark"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = settle(classes, "classes")

    members = classes.select("key", "n", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min("n").alias("least_n")).filter("size > 1")
    members = settle(members.join(buckets.select("bucket", "least_n"), "bucket"), "bucket-members")
    # One row of each class, found again by the hash of its id and text; a collision only fetches one row more.
    compared = members.select("key").distinct().join(classes.select("key", "mark"), "key").select("mark").distinct()
    sets = settle(rows.select("mark", "text").join(compared, "mark", "left_semi").select("text").filter("text <> ''").mapInArrow(_sets, "key binary, hashes array<bigint>").filter("size(hashes) > 0").groupBy("key").agg(F.first("hashes").alias("hashes")), "full-sets")

    own = sets.select("key", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.min("key").alias("key"), F.count("*").alias("sets")).filter("sets = 1").groupBy("key").agg(F.count("*").alias("own"))
    shared = members.join(own, "key", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # What a member can share must do for the smallest set of its bucket.
    able = shared.filter((100 + percent) * (F.col("n") - F.col("own")) >= percent * (F.col("n") + F.col("least_n"))).drop("least_n")
    able = settle(able, "able-members")
    buckets = able.groupBy("bucket").agg(F.min(F.struct("own", "key")).alias("centre"), F.count("*").alias("size")).filter("size > 1")
    members = settle(able.join(buckets.select("bucket", F.col("centre.key").alias("centre")), "bucket"), "starred-members")

    # Distinct pairs (a, b) of members and centres that can share enough for the similarity.
    star = members.filter("key = centre").select("bucket", F.col("key").alias("c"), F.col("n").alias("cn"), F.col("own").alias("cown"))
    most = F.least(F.col("n") - F.col("own"), F.col("cn") - F.col("cown"))
    star = members.join(star, "bucket").filter((F.col("key") != F.col("c")) & ((100 + percent) * most >= percent * (F.col("n") + F.col("cn"))))
    pairs = settle(star.select(F.least("key", "c").alias("a"), F.greatest("key", "c").alias("b")).distinct(), "pairs")
    links = settle(confirm(pairs, sets, percent), "links")
    comps = components(links)
    labelled = members.join(comps.withColumnRenamed("v", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    open_buckets = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("bucket")
    open_members = settle(labelled.join(open_buckets, "bucket", "left_semi").select("key", "n", "comp").distinct(), "open-members")
    more = settle(confirm(settle(missed_pairs(open_members, sets, percent), "pairs"), sets, percent), "links")
    if not more.isEmpty():
        comps = components(links.unionByName(more))

    joined = comps.join(classes.select(F.col("key").alias("v"), "least"), "v")
    smallest = joined.groupBy("comp").agg(F.min("least").alias("least_of_all"))
    smaller = joined.join(smallest, "comp").select(F.col("v").alias("key"), "least_of_all")
    named = settle(classes.select("key", "least").join(smaller, "key", "left").select("key", F.coalesce("least_of_all", "least").alias("first")), "components")
    # Only ``signed`` and ``named`` are read from here on.
    for superseded in (classes, sets, able, members, pairs, links, open_members, more):
        discard(superseded)
    out = signed.select("row", "doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("row", "doc_id", "n_shingles", component.alias("component_id"), (F.col("key").isNull() | (F.col("row") == F.col("first.row"))).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document."""
    return judge(docs, F.monotonically_increasing_id(), percent, id_col, text_col).drop("row")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that of the smallest id; all columns stay. Repeated rows of it stay once."""
    at = fresh(docs.columns, "__row")
    numbered = settle(docs.withColumn(at, F.monotonically_increasing_id()), "numbered")
    gone = judge(numbered, F.col(at), percent, id_col, text_col).filter(~F.col("kept")).select(F.col("row").alias(at))
    return numbered.join(settle(gone, "near-duplicates"), at, "left_anti").drop(at)
