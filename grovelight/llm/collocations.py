"""Operator 11: phrase collocations: contiguous phrases whose words occur together more often than their parts explain.

Texts are cut into pieces; equal pieces of a language become one with a multiplicity. Tasks turn pieces into windows of ``longest`` words,
add up equal ones in duckdb, and send each hash bucket of theirs, sorted and compressed, as one row. A bucket's task adds
its windows up in a duckdb file, out of core; as a bucket holds all windows of the same first two words, it has the full
count of every phrase of two words or more, and a share of each single word's. Counts of the parts of a candidate are
fetched by lookup requests: requests and counts meet in a shuffled join.

Counts are 64-bit, products are decimals of 38 digits (counts under 10**15), divisions are integer divisions.

Defined cases: A-Z are lower-cased, other letters stay; null languages are ``und``; null and empty texts have no words;
equal scores go by count, then by phrase in order of its bytes; an empty table gives no rows; other columns are ignored. A text may
be of any length, but a piece, which is one row of a task, has to fit into its memory.
"""

from __future__ import annotations

import string
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, pieces, settle

STOPS = r"[.,;:!?\x0A-\x0D]"
BLANKS = r"[\x20\x09]+"
#: Word occurrences a hash bucket gets, about, and the most buckets; beyond that they grow, and duckdb spills.
BUCKET_WORDS = 4_000_000
MOST_BUCKETS = 20_000
#: Shares of a language that are ranked by themselves.
SHARES = 64
#: Windows that a task adds up before it sends them.
SENT_WINDOWS = 500_000
DUCK = {"threads": 1, "memory_limit": "200MB", "preserve_insertion_order": False}


def text_pieces(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, piece, n): different pieces, their words apart by one blank, and how often each occurs."""
    lower = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    piece = F.explode(F.transform(F.split(lower, STOPS), lambda p: F.trim(F.regexp_replace(p, BLANKS, " ")))).alias("piece")
    return docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), piece).filter("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("n"))


def names(longest: int) -> list[str]:
    return [f"w{i}" for i in range(longest)]


def window_table(batch: pa.RecordBatch, longest: int) -> pa.Table:
    """(lang, w0.., n): the words from each word on, null behind the piece's end."""
    words = pc.split_pattern(batch.column("piece"), " ")
    flat, parent = words.flatten(), pc.list_parent_indices(words)
    ends = np.repeat(np.cumsum(pc.list_value_length(words).to_numpy()), pc.list_value_length(words).to_numpy())
    at = np.arange(len(flat))
    columns = [flat.take(pa.array(at + i, mask=at + i >= ends)) for i in range(longest)]
    return pa.table([batch.column("lang").take(parent), *columns, batch.column("n").take(parent)], ["lang", *names(longest), "n"])


def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def windows(counted: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(bucket, rows): windows of the pieces, by hash bucket of language and first two words, as compressed Arrow tables."""
    columns = ", ".join(names(longest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = duckdb.connect(config=DUCK)
        held: list[pa.Table] = []

        def send() -> Iterator[pa.RecordBatch]:
            own = pa.concat_tables(held)  # noqa: F841, read by name
            held.clear()
            summed = db.sql(f"SELECT (hash(lang, w0, w1) % {buckets})::INTEGER AS bucket, lang, {columns}, sum(n)::BIGINT AS n FROM own GROUP BY ALL ORDER BY bucket, lang, {columns}").to_arrow_table().combine_chunks()
            bucket = summed.column("bucket").to_numpy()
            begins = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])).tolist() if len(bucket) else []
            rest = summed.drop_columns(["bucket"])
            for a, b in zip(begins, [*begins[1:], len(bucket)]):
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]], pa.int32()), pa.array([packed(rest.slice(a, b - a))])], ["bucket", "rows"])

        size = 0
        for piece in pieces(batches, "piece"):
            held.append(window_table(piece, longest))
            size += held[-1].num_rows
            if size >= SENT_WINDOWS:
                yield from send()
                size = 0
        if held:
            yield from send()

    return counted.mapInArrow(run, "bucket int, rows binary")


def bucket_counts(sent: DataFrame, longest: int, buckets: int, least: int) -> DataFrame:
    """(lang, size, phrase, n): phrases of two words or more that occur ``least`` times, and each bucket's share of the single words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Scratch of this task alone, gone when it ends; a task that runs again builds its own.
        with tempfile.TemporaryDirectory() as folder, duckdb.connect(f"{folder}/bucket.db", config=DUCK | {"temp_directory": f"{folder}/spill"}) as db:
            db.execute(f"CREATE TABLE x (lang VARCHAR, {', '.join(f'{w} VARCHAR' for w in names(longest))}, n BIGINT)")
            for batch in batches:
                for rows in batch.column("rows"):
                    own = pa.ipc.open_stream(rows.as_buffer()).read_all()  # noqa: F841, read by name
                    db.execute("INSERT INTO x SELECT * FROM own")
            for size in range(1, longest + 1):
                first = ", ".join(names(size))
                full = f"WHERE w{size - 1} IS NOT NULL GROUP BY lang, {first}" + (f" HAVING sum(n) >= {least}" if size > 1 else "")
                yield from db.sql(f"SELECT lang, {size}::INTEGER AS size, concat_ws(' ', {first}) AS phrase, sum(n)::BIGINT AS n FROM x {full}").to_arrow_reader(20_000)

    return sent.repartitionById(buckets, "bucket").mapInArrow(run, "lang string, size int, phrase string, n bigint")


def phrase_counts(docs: DataFrame, longest: int, least: int, lang_col: str = "lang", text_col: str = "text", bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of up to ``longest`` words that occur ``least`` times, settled, and (lang, total)."""
    spark = docs.sparkSession
    counted = settle(text_pieces(docs, lang_col, text_col), "pieces")
    words = counted.agg(F.sum(F.length("piece") - F.length(F.replace("piece", F.lit(" "))) + 1)).first()[0] or 0
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // bucket_words)), MOST_BUCKETS)
    parts = settle(bucket_counts(windows(counted, longest, buckets), longest, buckets, least), "phrase-parts")
    discard(counted)
    single = settle(parts.filter("size = 1").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")), "word-counts")
    totals = settle(single.groupBy("lang").agg(F.sum("f").alias("total")), "word-totals")
    counts = settle(single.filter(F.col("f") >= least).unionByName(parts.filter("size > 1").withColumnRenamed("n", "f")), "phrase-counts")
    discard(parts)
    discard(single)
    return counts, totals


def sub_phrase(phrase: Column, first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), first, n), " ")


#: floor(1000000 * a * a / (l * r)) by integers.
EXACT = """CAST(CAST(1000000 AS DECIMAL(7,0)) * CAST(CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) AS DECIMAL(30,0)) AS DECIMAL(38,0))
  div CAST(CAST(l AS DECIMAL(15,0)) * CAST(r AS DECIMAL(15,0)) AS DECIMAL(38,0))"""


def scored(counts: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, l, r, score) of every phrase of two words or more, at its lowest-scoring cut."""
    phrases = counts.filter("size > 1")
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("lang", "size", "phrase", F.col("f").alias("a"), cut)
    side = F.explode(F.array(F.struct(F.lit("l").alias("side"), sub_phrase(F.col("phrase"), 1, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), sub_phrase(F.col("phrase"), F.col("k") + 1, F.col("size") - F.col("k")).alias("part")))).alias("s")
    requests = cuts.select("lang", "size", "phrase", "a", "k", side).select("lang", "size", "phrase", "a", "k", "s.side", "s.part")
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("f")), ["lang", "part"])
    of = lambda s: F.max(F.when(F.col("side") == s, F.col("f"))).alias(s)
    both = answers.groupBy("lang", "size", "phrase", "a", "k").agg(of("l"), of("r"))
    worst = F.min(F.struct(F.expr(EXACT).cast("long").alias("score"), "k", "l", "r")).alias("w")
    return both.groupBy("lang", "size", "phrase", "a").agg(worst).select("lang", "size", "phrase", "a", "w.l", "w.r", "w.score")


def covered(counts: DataFrame, percent: int) -> DataFrame:
    """(lang, phrase) of phrases that ``percent`` of the time stand inside one longer phrase."""
    longer = counts.filter("size > 2")
    spots = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: sub_phrase(F.col("phrase"), i, n))))
    inside = longer.select("lang", F.col("f").alias("most"), F.explode(F.array_distinct(spots)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    return inside.join(counts.select("lang", "phrase", "f"), ["lang", "phrase"]).filter(100 * F.col("most") >= percent * F.col("f")).select("lang", "phrase")


def mine(docs: DataFrame, *, longest: int = 3, least: int = 10, percent: int = 50, first: int = 2000, lang_col: str = "lang", text_col: str = "text", bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases of 2 to ``longest`` words."""
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words at least and occur once at least")
    counts, totals = phrase_counts(docs, longest, least, lang_col, text_col, bucket_words)
    kept = scored(counts).join(covered(counts, percent), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    # A language's phrases are ranked in shares first: only the first of each share can be among the first of all.
    share = Window.partitionBy("lang", "share").orderBy(*order)
    shared = kept.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    best = shared.withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= first)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
