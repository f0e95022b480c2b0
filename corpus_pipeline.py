"""Corpus pipeline: each stage calls one operator on all documents that the stages before it kept."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovelight.llm import bpe, decontaminate, language_id, line_dedup, near_duplicates
from grovelight.llm.shared import discard, discard_recorded, recorded, release_shuffles, settle, small_batches

#: A text's least share of known n-grams; below it no learned language explains the text.
MIN_LANGUAGE_SCORE = 0.2


#: Paths of the tables that the stages so far have settled.
_settled: list[str] = []


def stage(decide):
    """A stage reads what the one before has written, so what that one settled on its way is deleted first. Whole texts go to
    Python a few at once: an executor keeps its two batches a task beside the heap that the stages before have grown."""

    @functools.wraps(decide)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_recorded(_settled, docs)
        release_shuffles(spark)
        with recorded(_settled), small_batches(spark):
            return decide(spark, docs, sf_dir)

    return run_stage


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known to the filters; undetermined ones and those of too low a score go.
    Without a label in the whole table no language is known, and all documents stay."""
    names = docs.columns
    model = language_id.learn(docs)
    if model is None:
        return docs
    judged = language_id.predict(docs, model, F.struct(*[F.col(c) for c in names if c != "text"]).alias("row"), F.col("text").alias("whole"))
    good = judged.filter((F.col("lang_pred") != language_id.UND) & (F.col("score") >= MIN_LANGUAGE_SCORE))
    # Settled, so that texts are judged in the stage's batches.
    return settle(good.select(*[F.col("whole").alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names]), "judged")


@stage
def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(docs, F.col("source"), counts=False).select(docs.columns)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs, percent=80).select(docs.columns)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


@stage
def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document and the digest of the text they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.decode(F.col("ids"), ranks), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_bytes),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    former = None
    for name, decide in STAGES:
        docs = settle(decide(spark, docs, sf_dir), f"stage-{name}")
        if former is not None:
            discard(former)
        former = docs
    discard_recorded(_settled, docs)
    return docs


#: SQL can express neither the language filters nor the merges; the tests hold each stage against a plain version.
ORACLE_SQL = None
