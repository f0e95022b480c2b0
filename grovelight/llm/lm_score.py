"""Operator 7: log-likelihood of whole documents under a gated recurrent language model.

Words are counted over all training documents. The ``gru.HEAD`` most frequent words (with the end token) are the
model's own; every rarer word is drawn from one class by its smoothed count, an unseen one with half a count, so the
probabilities add up to one over all words. The model is fitted on every token of the training documents: a hash of id
and text deals them to shards of about ``shard_tokens`` tokens, and the shards to rounds. In each round the shards train
in tasks of their own from the same parameters, which are then averaged for the next round. Shards grow with the
corpus, and so do rounds and shards a round, each with the root. A corpus of any size is gone through once. Counting, base scores and model scores cover all documents and whole texts.

Counts of the most frequent words (at most ``table_words``) go to the tasks as Arrow arrays; counts of the others come
by a join on the word, from which only sums a document are needed.

Defined cases: null and empty texts are the end token alone; with no training document every count is 0, N is 0, V is
0, nothing is known but the unseen word, and both scores are 0; repeated rows each give a row; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .shared import pieces, settle, text_rows

SHARD_TOKENS = 500_000
SHARDS = 12
#: About so many steps of the optimiser a shard; its lanes grow with its tokens.
UPDATES = 64
ROUNDS = 2
TABLE_WORDS = 500_000


def count_words(docs: DataFrame) -> DataFrame:
    """(word binary, n) over all texts: counted in the tasks first, a bounded number of words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for piece in pieces(batches):
            for text in piece.column("text").cast(pa.binary()):
                counts.update(text.as_py().lower().split())
            if len(counts) > 1_000_000:
                yield out()
                counts.clear()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def schedule(n_train: int, shard_tokens: int = SHARD_TOKENS) -> tuple[int, int, int]:
    """(passes, rounds of a pass, shards of a round) that cover ``n_train`` tokens, none left out. There is one pass at any size."""
    shards = max(SHARDS * ROUNDS, -(-n_train // shard_tokens))
    width = max(SHARDS, math.isqrt(shards))
    return 1, -(-shards // width), width


def score_documents(docs: DataFrame, held_out: Column, *, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, table_words: int = TABLE_WORDS, fitted_on: Callable[[int], None] = lambda tokens: None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    ``fitted_on`` is told after each round how many tokens its shards trained on.
    """
    spark = docs.sparkSession
    rows = text_rows(docs, F.coalesce(held_out, F.lit(False)).alias("held_out"), id_col=id_col, text_col=text_col)
    training = rows.filter(~F.col("held_out"))
    counts = settle(count_words(training), "lm-counts")
    ends = training.count()
    words, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_train, v = words + ends, types + (ends > 0)
    log_total = float(np.log10(n_train + 0.5 * (v + 1)))

    top = counts.orderBy(F.desc("n"), "word").limit(gru.HEAD - 1).collect()
    head = sorted([(r.n, bytes(r.word)) for r in top] + [(ends, None)], key=lambda x: (-x[0], x[1] or b""))
    end_id = [w for _, w in head].index(None)
    head_mass = np.zeros(gru.HEAD)
    head_mass[: len(head)] = [n + 0.5 for n, _ in head]
    rest = n_train + 0.5 * (v + 1) - head_mass.sum()  # of all rarer words and the unseen one
    running, least = 0, None
    for row in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if (running := running + row.words) > table_words:
            break
        least = row.n
    least = max(1, least if least is not None else 1 << 62)
    table = counts.filter(F.col("n") >= least).toArrow().combine_chunks()
    sent = spark.sparkContext.broadcast((pa.array([w for _, w in head], pa.large_binary()), table.column("word").combine_chunks().cast(pa.large_binary()), table.column("n").combine_chunks()))

    def ids_of(texts: pa.Array) -> tuple[list[np.ndarray], pa.Array]:
        split = [t.lower().split() for t in texts.cast(pa.binary()).to_pylist()]
        flat = pa.array([w for s in split for w in s], pa.large_binary())
        ids = pc.index_in(flat, value_set=sent.value[0]).fill_null(gru.HEAD).to_numpy(zero_copy_only=False).astype(np.int32)
        cuts = np.cumsum([len(s) for s in split])
        return [np.append(x, np.int32(end_id)) for x in np.split(ids, cuts[:-1])] if split else [], flat

    passes, rounds, width = schedule(n_train, shard_tokens)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            ids, _ = ids_of(piece.column("text"))
            yield pa.RecordBatch.from_arrays([piece.column("hash"), pa.array([x.astype(np.int16).tobytes() for x in ids], pa.binary())], ["hash", "ids"])

    coded = training.select("text", F.xxhash64("doc_id", "text").alias("hash")).mapInArrow(encode, "hash bigint, ids binary")
    cell = F.pmod(F.col("hash"), F.lit(rounds * width))
    coded = settle(coded.select("hash", "ids", (cell % width).alias("shard"), F.floor(cell / width).cast("int").alias("round")), "lm-training", "round")
    model = gru.initial(head_mass, rest)
    names = list(model)
    for k in range(passes * rounds):
        start = spark.sparkContext.broadcast(model)

        def fit(key: tuple, shard: pa.Table) -> pa.Table:
            ids = [np.frombuffer(x, np.int16).astype(np.int32) for x in shard.sort_by("hash").column("ids").to_pylist()]
            tokens = sum(map(len, ids))
            learned = gru.train(start.value, ids, most=max(32, tokens // (UPDATES * gru.WINDOW)))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "tokens": pa.array([tokens], pa.int64()), **{k: pa.array([learned[k].tobytes()], pa.binary()) for k in names}})

        fields = "shard bigint, tokens bigint, " + ", ".join(f"{k} binary" for k in names)
        fitted = sorted(coded.filter(F.col("round") == k % rounds).groupBy("shard").applyInArrow(fit, fields).collect(), key=lambda r: r.shard)
        fitted_on(sum(r.tokens for r in fitted))
        if fitted:
            model = gru.average([({k: np.frombuffer(bytes(r[k]), np.float32).reshape(model[k].shape) for k in names}, r.tokens) for r in fitted])
    final = spark.sparkContext.broadcast(model)
    log_rest = float(np.log10(rest)) if ends else 0.0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vocabulary, n = sent.value
        counted = np.append(np.asarray(n, np.float64), 0)
        for piece in pieces(batches):
            ids, flat = ids_of(piece.column("text"))
            lengths = np.array([len(x) - 1 for x in ids])
            owner = np.repeat(np.arange(len(ids)), lengths)
            at = pc.index_in(flat, value_set=vocabulary).fill_null(len(vocabulary)).to_numpy(zero_copy_only=False)
            c, known = counted[at], at < len(vocabulary)
            logs = np.where(known, np.log10(c + 0.5), 0)
            rarer = np.concatenate([x[:-1] for x in ids] or [np.zeros(0)]) == gru.HEAD
            base = np.bincount(owner, logs, len(ids)) + np.log10(ends + 0.5) - (lengths + 1) * log_total
            inside = np.bincount(owner[rarer], logs[rarer] - log_rest, len(ids))
            model_score = gru.score(final.value, ids) / np.log(10) + inside if ends else base
            unknown = np.flatnonzero(~known)
            cut = np.concatenate([[0], np.cumsum(np.bincount(owner[unknown], minlength=len(ids)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [piece.column("row"), piece.column("doc_id"), piece.column("held_out"), pa.array(lengths + 1, pa.int64()), pa.array(np.bincount(owner, known, len(ids)).astype(np.int64) + (ends > 0)), pa.array(base), pa.array(model_score), pa.ListArray.from_arrays(pa.array(cut), flat.take(pa.array(unknown)).cast(pa.binary()))],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "others"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    part = settle(numbered.mapInArrow(score, f"row bigint, doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, others array<binary>"), "lm-scores")
    others = part.select("row", F.explode("others").alias("word")).groupBy("row", "word").agg(F.count("*").alias("times"))
    found = others.join(counts.filter(F.col("n") < least), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sums = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = part.drop("others").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))
