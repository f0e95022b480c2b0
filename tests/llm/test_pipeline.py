"""The pipeline's stages, each against a plain version of its decision."""

import duckdb
import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from grovelight.functions import portable
from grovelight.llm import decontaminate, line_dedup, merges, near_duplicates, queries, shared
from tests.conftest import SF
from tests.llm.test_operators import brute_components, table


def test_stages_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)
    first = kept["language_id"](spark, docs, SF)
    assert first.columns == docs.columns and first.count() == docs.filter("text rlike '[[:alpha:]\\\\p{L}]'").count()
    lines = kept["line_dedup"](spark, first, SF)
    sql = queries.ORACLE_SQL["op5_line_dedup"]
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert {(r.doc_id, r.text) for r in lines.collect()} == set(c.sql(f"SELECT doc_id, text FROM ({sql})").fetchall())
    lines = lines.cache()
    near = kept["near_duplicates"](spark, lines, SF)
    _, comps = brute_components(lines.collect(), 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d, x in comps.items() if d == x)
    clean = kept["decontamination"](spark, near.cache(), SF)
    leaks = {r.doc_id for r in decontaminate.leaks(near, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in near.collect()} - leaks
    clean = clean.cache()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert sorted((r.doc_id, r.ids) for r in kept["byte_bpe"](spark, clean, SF).collect()) == sorted((r.doc_id, enc.encode_ordinary(r.text)) for r in clean.collect())


def test_rejects_and_nulls(spark):
    odd = table(spark, [(1, None, "en", None), (2, "", None, None), (3, "12 34", "en", "a"), (4, "the and of the", "en", "a")])
    out = corpus_pipeline.identify_language(spark, odd, SF)
    assert out.columns == odd.columns and [r.doc_id for r in out.collect()] == [4]
    for stage in (lambda d: corpus_pipeline.drop_boilerplate_lines(spark, d, SF), lambda d: corpus_pipeline.drop_near_duplicates(spark, d, SF), lambda d: corpus_pipeline.drop_contaminated(spark, d, SF)):
        assert stage(odd).columns == odd.columns and stage(odd).count() == 4 and stage(odd.filter("false")).count() == 0
    coded = corpus_pipeline.encode_bytes(spark, odd, SF).collect()
    assert sorted((r.doc_id, r.n_tokens > 0) for r in coded) == [(1, False), (2, False), (3, True), (4, True)]
    assert corpus_pipeline.encode_bytes(spark, odd.filter("false"), SF).count() == 0


def test_without_labels_all_stay(spark):
    docs = table(spark, [(1, "the and of the", None, "a"), (2, None, None, "a")])
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()) == [1, 2]


def test_stages_send_few_texts_at_once(spark, monkeypatch):
    """Also the last pass of a stage over whole texts in Python runs inside of the stage."""
    seen, plain = [], portable.settle
    size = lambda: int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    monkeypatch.setattr(portable, "settle", lambda df, name: seen.append((name, size())) or plain(df, name))
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), size()
    for _, decide in corpus_pipeline.STAGES[:4]:
        docs = decide(spark, docs, SF)
        assert size() == before and "Python" not in (plan := docs._jdf.queryExecution().executedPlan().toString()) and "InArrow" not in plan
    assert {"judged", "signatures", "seed-hits", "leaking-texts"} <= {name for name, _ in seen} and max(n for _, n in seen) <= shared.BATCH_ROWS
    # The operator by itself, too.
    seen.clear()
    decontaminate.leaks(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert dict(seen)["seed-hits"] <= shared.BATCH_ROWS


def test_a_stage_deletes_what_the_former_settled(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    places = []
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, docs, SF).write.parquet(path := f"file://{tmp_path}/{name}")
        places.append(list(corpus_pipeline._settled))
        docs = spark.read.parquet(path)
    assert places[0] and places[1] and places[2] and not {*places[0]} & {*places[1]} and not {*places[1]} & {*places[2]}
    files = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration())
    there = lambda p: files.exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    assert not any(map(there, places[1])) and any(map(there, places[2]))
    # A frame that still needs them keeps them.
    lazy = corpus_pipeline.drop_boilerplate_lines(spark, docs, SF)
    assert corpus_pipeline.drop_near_duplicates(spark, lazy, SF).count() > 0 and lazy.count() > 0
