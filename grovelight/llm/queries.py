"""The operators' queries over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, language_id, license_scan, line_dedup, lm_score, merkle, near_duplicates, repeats, token_counts, top_k, warc
from .shared import remainder, settle, shared_dir

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)
    digests = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.ids_bytes(F.col("ids")), 256).alias("ids_sha256"), F.sha2(bpe.decode(F.col("ids"), RANKS), 256).alias("decoded_sha256"))
    # Settled here, as a batch's whole texts and ids are in memory several times, in Python and in Spark.
    with bpe.small_batches(spark):
        return settle(digests, "digests")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), WORD_TOKENIZER, limit=2048)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "matched")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(read(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    records = warc.read_archive(spark, archive)
    return records.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.drop_boilerplate(read(spark, sf_dir, "documents"), F.col("source"))
    return cleaned.select("doc_id", "text", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(~language_id.held_out()))
    return language_id.predict(docs, model, language_id.held_out().alias("held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(read(spark, sf_dir, "documents"), percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"), longest=3, least=10, percent=50, first=2000)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.repeats(read(spark, sf_dir, "documents"), width=100)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return rows.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], text)
    letters = string.ascii_uppercase, string.ascii_lowercase
    tampered = F.when(remainder("doc_id", 5) == 0, leaf(F.translate("text", *letters)))
    made = merkle.manifest(docs, leaf(F.col("text")), F.col("source"), [F.col("doc_id")], ["doc_id", tampered.alias("tampered")])
    rows = made.proofs.select("row.doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), F.sha2(F.array_join(merkle.siblings(F.col("path")), ""), 256).alias("proof_sha256"), merkle.fold(F.coalesce("row.tampered", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_byte_bpe, op2_token_counts, op3_decontamination, op4_warc, op5_line_dedup, op6_language_id, op7_lm_score, op8_top_k, op9_license_scan, op10_near_duplicates, op11_collocations, op12_suffix_dedup, op13_merkle_manifest)
}

_QUAD = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {0}, 5))::INTEGER >> {1}) & 31) + 1, 1)".format(5 * i + 1, s) for i in range(8) for s in (15, 10, 5, 0)
)

_CUT = "SELECT lang, phrase, a, {k} AS k, array_to_string(ws[:{k}], ' ') AS first, array_to_string(ws[{k} + 1:], ' ') AS rest FROM c WHERE len(ws) > {k}"



def _crc32_sql(text: str) -> str:
    """SQL: CRC-32 of an ASCII text, by its table of bytes."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    letters = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {letters}), lambda c, b: xor(c >> 8, ({table}::BIGINT[])[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


def _climb_sql(first: str, depth: int) -> str:
    """SQL: CTEs of ``depth`` levels over n{first}0 (g, pos, size, h) and over the paths p{first}0 (doc_id, leaf, subroot, sibs, acc, g, pos, size)."""
    out = []
    for k in range(depth):
        n, p, r = f"n{first}{k}", f"p{first}{k}", f"r{first}{k}"
        part = lambda a, b: f"coalesce(array_to_string(list_slice(hs, {a}, {b}), ''), '')"
        left, right = part("1", "p.pos % 16"), part("p.pos % 16 + 2", "17")
        out.append(f"""{r} AS MATERIALIZED (SELECT g, size, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM {n} WHERE size > 1 GROUP BY ALL),
        n{first}{k + 1} AS MATERIALIZED (SELECT g, run AS pos, (size + 15) // 16 AS size, sha256(array_to_string(hs, '')) AS h FROM {r} UNION ALL SELECT g, pos, size, h FROM {n} WHERE size = 1),
        p{first}{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, subroot, CASE WHEN hs IS NULL THEN sibs ELSE sibs || {left} || {right} END AS sibs, CASE WHEN hs IS NULL THEN acc ELSE sha256({left} || acc || {right}) END AS acc,
          p.g, p.pos // 16 AS pos, (p.size + 15) // 16 AS size FROM {p} p LEFT JOIN {r} r ON p.g IS NOT DISTINCT FROM r.g AND p.pos // 16 = r.run)""")
    return ",\n        ".join(out)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_LEVELS = 5  # a million rows a source, and sources

ORACLE_SQL: dict[str, str] = {
    "op13_merkle_manifest": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, source AS g, {_LEAF.format('text')} AS leaf, CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN {_LEAF.format(f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')")} END AS tampered FROM documents),
        l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size FROM d),
        na0 AS (SELECT g, pos, size, leaf AS h FROM l),
        pa0 AS (SELECT doc_id, leaf, NULL::VARCHAR AS subroot, '' AS sibs, coalesce(tampered, leaf) AS acc, g, pos, size FROM l),
        {_climb_sql('a', _LEVELS)},
        s AS MATERIALIZED (SELECT g AS source, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM na{_LEVELS}),
        nb0 AS (SELECT 0 AS g, pos, size, h FROM s),
        pb0 AS (SELECT doc_id, leaf, s.h AS subroot, sibs, acc, 0 AS g, s.pos, s.size FROM pa{_LEVELS} p JOIN s ON p.g IS NOT DISTINCT FROM s.source),
        {_climb_sql('b', _LEVELS)}
        SELECT doc_id, leaf, subroot, n.h AS root, sha256(sibs) AS proof_sha256, acc AS folded_root, acc = n.h AS verified FROM pb{_LEVELS}, nb{_LEVELS} n""",
    "op11_collocations": f"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
        g AS ({" UNION ALL ".join(f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i : i + {k} - 1], ' '))) AS phrase FROM w" for k in (1, 2, 3))}),
        f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM g GROUP BY ALL),
        c AS MATERIALIZED (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND f >= 10),
        u AS ({_CUT.format(k=1)} UNION ALL {_CUT.format(k=2)}),
        s AS (SELECT u.lang, u.phrase, u.a, k, x.f AS l, y.f AS r, (1000000 * u.a::HUGEINT * u.a // (x.f::HUGEINT * y.f))::BIGINT AS score
              FROM u JOIN f x ON x.lang = u.lang AND x.phrase = u.first JOIN f y ON y.lang = u.lang AND y.phrase = u.rest),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        o AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, a AS f, unnest([array_to_string(ws[:2], ' '), array_to_string(ws[2:], ' ')]) AS phrase FROM c WHERE size = 3) GROUP BY ALL),
        k AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.most IS NULL OR 100 * o.most < 50 * b.a),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang)
        SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM k JOIN n ON n.lang = k.lang QUALIFY rank <= 2000""",
    "op4_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
        SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes, {_QUAD} AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM p JOIN f ON p.html = f.html""",
    "op5_line_dedup": f"""
        WITH d AS (SELECT doc_id, text, source, string_split(text, chr(10)) AS ls FROM documents),
        t AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
        u AS (SELECT source, unnest(list_distinct(list_filter(ls, lambda x: trim(x, ' ') <> ''))) AS l FROM d),
        c AS (SELECT source, l, count(*) AS n FROM u GROUP BY source, l),
        b AS (SELECT c.source, list(l) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
              WHERE n >= {line_dedup.MIN_PAGES} AND n > CAST({line_dedup.RATIO} AS DOUBLE) * pages GROUP BY c.source),
        k AS (SELECT doc_id, text, ls, CASE WHEN bad IS NULL THEN ls ELSE list_filter(ls, lambda x: trim(x, ' ') = '' OR NOT list_contains(bad, x)) END AS kept
              FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(array_to_string(kept, chr(10)), '') END AS text,
               coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped
        FROM k""",
    "op8_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
              FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id),
        r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
}
