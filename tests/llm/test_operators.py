"""Each operator against a plain version, with nulls, empty and long texts, repeats, ties, odd columns and no rows."""

import base64
import collections
import hashlib
import random
import struct
import textwrap
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grovelight.llm import bpe, decontaminate, gru, language_id, letters, license_scan, line_dedup, lm_score, merges, near_duplicates, queries, shared, token_counts, top_k, warc
from tests.conftest import SF

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = "it's  'sword' \n\n x\t y　  'll we've 12345 à  z" + "ab" * 300 + " \n"
#: Further columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, key string, n int, words string, bucket int, row int, hash int, tokens int, whole int, v int"
EXTRA = ("k", 1, "w", 2, 3, 4, 5, 6, 7)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA)


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    base = words(rng, 300)
    near = base[:150] + ["changed"] + base[151:]
    out = [(1, " ".join(base), "en", "a"), (2, " ".join(near), "en", "a"), (3, " ".join(base), "en", None), (4, None, "en", "a"), (5, "", None, "b"), (6, " \n\t", "fr", "b"), (7, ODD, "fr", None), (8, "one two", "fr", "b"), (9, "One\nTWO", "fr", "b"), (10, "word " * 5000 + "x" * 3000, "en", "a"), (11, "Σας ΑΣ <|endoftext|> café café <|startoftext|>", "fr", "b")]
    out += [(20 + i, " ".join(words(rng, rng.randrange(1, 60))), "en", f"s{i % 3}") for i in range(30)]
    return table(spark, [*out, out[7], out[7]])


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.filter("false")


def rows_of(docs):
    return docs.select("doc_id", "text").collect()


def test_bpe_memory_of_a_task(spark):
    """Batches of whole texts are small whatever their number, and a worker holds the table's words once."""
    sizes = spark.range(0, 4000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with bpe.small_batches(spark):
        assert max(r.n for r in sizes.collect()) <= bpe.BATCH_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    words = bpe.Vocabulary(pa.table({"word": ["a", "bc"], "ids": pa.array([[1], [2, 3]], pa.list_(pa.int32()))}))
    assert words.places() is words.places() and words.places() == {"a": 0, "bc": 1} and words.starts.tolist() == [0, 1, 3]


def test_bpe_round_trip(docs, nothing):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.load_ranks(RANKS), special_tokens={})
    for most in (bpe.TABLE_WORDS, 5):
        coded = bpe.encode(docs, RANKS, P.PATTERN, table_words=most)
        got = coded.select("doc_id", "ids", bpe.ids_bytes(F.col("ids")).alias("le"), bpe.decode(F.col("ids"), RANKS).alias("b")).collect()
        want = [(r.doc_id, enc.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in rows_of(docs)]
        assert sorted((r.doc_id, r.ids, bytes(r.b)) for r in got) == sorted(want)
        assert all(bytes(r.le) == struct.pack(f"<{len(r.ids)}I", *r.ids) for r in got)
    assert bpe.encode(nothing, RANKS, P.PATTERN).count() == 0


def test_every_letter_splits_as_in_the_libraries():
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.load_ranks(RANKS), special_tokens={})
    split = letters.Splitter.of(P.PATTERN)
    for a in range(0, 0x110000, 0x1000):
        chars = [chr(c) for c in range(a, a + 0x1000) if not 0xD800 <= c < 0xE000]
        text = "".join(f"{c}'s {c}a9{c}b!{c}  " for c in chars)
        assert [t for w in split(text) for t in enc.encode_ordinary(w)] == enc.encode_ordinary(text)
    assert split("") == [] and letters.spelled(r"\p{N}[^\s]", 0x7F).startswith("[\\U00000030-\\U00000039]")


def test_merge_word_is_the_fold(spark):
    ranks = merges.load_ranks(RANKS)
    rng = random.Random(3)
    some = ["".join(rng.choice("aeio tnsé\n=") for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    df = spark.createDataFrame([(w,) for w in some], "w string").withColumn("ids", bpe.fold_merges(F.col("w").cast("binary"), bpe.rank_map(ranks)))
    for r in df.collect():
        parts = merges.merge_word([bytes([c]) for c in r.w.encode()], lambda a, b: ranks.get(a + b), lambda a, b: a + b)
        assert r.ids == [ranks[p] for p in parts]


def test_token_counts(docs, nothing):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = token_counts.count_tokens(docs, P.path("word_bpe_49k.json"), 2048).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(tok.encode(r.text or "", add_special_tokens=False).ids)) for r in rows_of(docs)]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert token_counts.count_tokens(nothing, P.path("word_bpe_49k.json"), 1).count() == 0


def test_decontamination(spark, docs, nothing):
    rng = random.Random(5)
    item = words(rng, 30, 5000)
    bent = list(item)
    bent[12], bent[25] = "other", "thing"
    leak = lambda x: " ".join(words(rng, 40) + x + words(rng, 40))
    more = table(spark, [(100, leak(item), "en", "a"), (101, leak(bent).upper(), "en", "a"), (102, leak(item[:8]), "en", "a"), (103, leak(random.Random(1).sample(item, 30)), "en", "a"), (100, leak(item), "en", "a"), (104, leak("which river runs by the old mill".split()), "en", "a"), (105, leak("which river runs near the old mill".split()), "en", "a")])
    items = spark.createDataFrame([(1, " ".join(item), 0), (2, " ".join(item) + "!", 0), (3, None, 0), (4, "", 0), (5, "too short", 0), (6, "Which river, runs by the old mill?", 0)], "item_id long, text string, key int")
    all_docs = docs.unionByName(more)
    found = decontaminate.leaks(all_docs, items)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(100, 1), (101, 1), (104, 6)}
    left = decontaminate.decontaminate(all_docs, items)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.doc_id for r in all_docs.filter("doc_id not in (100, 101, 104)").collect())
    assert decontaminate.leaks(nothing, items).count() == 0 and decontaminate.decontaminate(docs, items.filter("false")).count() == docs.count()


def test_decontamination_against_brute_force(spark):
    """Every document and item of the smallest tables laid side by side at every offset."""
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    hashed = decontaminate.TokenHash()
    item_tokens = {r.item_id: hashed.tokens(r.text or "") for r in items.collect()}
    want = set()
    for r in rows_of(docs):
        d = hashed.tokens(r.text or "")
        for i, t in item_tokens.items():
            # Only offsets with at least five agreeing tokens can reach the least run.
            a, b = np.nonzero(t[:, None] == d[None, :])
            offsets, n = np.unique(b - a, return_counts=True)
            need = min(decontaminate.LEAST, -(-len(t) * 4 // 5))
            for o in offsets[n >= need].tolist():
                lo, hi = max(0, o), min(len(d), o + len(t))
                if decontaminate.best_run(d[lo:hi], t[lo - o : hi - o]) >= need:
                    want.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert want and got <= want and len(got) >= 0.9 * len(want)


def test_best_run():
    a = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9], np.int64)
    b = a.copy()
    b[4] = 0
    assert decontaminate.best_run(a, b) == 8 and decontaminate.best_run(a, a) == 9 and decontaminate.best_run(a, a + 100) == 0


def test_warc(spark, nothing, monkeypatch):
    pages = [(5, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (9, "u", None), (8, "u", ""), (7, "u", "other"), (7, "u", "other"), (None, "u", "alone"), (None, "u", "other")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, address int")

    def read(**more):
        return warc.read_archive(spark, warc.write_archive(df, f"{shared.shared_dir(spark)}/t-{random.random()}", **more))

    got = read()
    view = sorted(((r.page_id, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in got.collect()), key=repr)
    assert view == sorted([(5, "revisit", 2, "<p>é</p>"), (2, "response", None, "<p>é</p>"), (9, "revisit", 8, ""), (8, "response", None, ""), (7, "response", None, "other"), (7, "response", None, "other"), (None, "response", None, "alone"), (None, "revisit", 7, "other")], key=repr)
    for r in got.withColumn("bytes", warc.record_bytes(F.col("head"), F.col("payload"), F.col("record_type"))).collect():
        digest = base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()
        head, body = bytes(r.bytes).split(b"\r\n\r\n", 1)
        assert r.payload_digest == digest and f"sha1:{digest}".encode() in head
        assert body == (bytes(r.payload) if r.record_type == "response" else b"") + b"\r\n\r\n" and b"\r\nX: y" not in head
    assert {r.record_type for r in read(min_bytes=6).filter("octet_length(payload) < 6").collect()} == {"response"}
    named = spark.createDataFrame([("a>b\r\n", None, "x" * 300_000), ("é/1", None, "x" * 300_000), (None, None, "y")], "page_id string, url string, html string")
    texts = warc.read_archive(spark, warc.write_archive(named, f"{shared.shared_dir(spark)}/t-{random.random()}")).collect()
    assert {(r.page_id, r.record_type, r.refers_to, len(r.payload)) for r in texts} == {("a>b\r\n", "response", None, 300_000), ("é/1", "revisit", "a>b\r\n", 300_000), (None, "response", None, 1)}
    many = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") < 25, F.lit("hot")).otherwise(F.concat(F.lit("cold "), F.floor(F.col("id") / 2).cast("string"))).alias("html"))
    monkeypatch.setattr(warc, "SLOT", 4)
    archive = warc.write_archive(many, f"{shared.shared_dir(spark)}/t-{random.random()}")
    stored = {bytes(r.payload).decode(): r.slots for r in spark.read.parquet(archive.payloads).collect()}
    assert stored == {"hot": 7} | {f"cold {i // 2}": 1 for i in range(25, 40)}
    assert spark.read.parquet(archive.records).filter("slot > 0").count() > 10
    assert sorted((r.page_id, r.refers_to, bytes(r.payload).decode()) for r in warc.read_archive(spark, archive).fillna(-1).collect()) == [(i, 0 if 0 < i < 25 else i - 1 if i > 26 and i % 2 else -1, "hot" if i < 25 else f"cold {i // 2}") for i in range(40)]
    empty = warc.write_archive(df.filter("false"), f"{shared.shared_dir(spark)}/t-{random.random()}")
    assert warc.read_archive(spark, empty).count() == 0


def test_line_dedup(spark, nothing):
    pages = [(i, f"menu\nbody {i}\n\n  \nmenu", "x", "h" if i < 8 else None) for i in range(12)] + [(20, None, "x", "h"), (21, "", "x", "h"), (22, "menu", "x", "other")]
    df = table(spark, pages)
    got = line_dedup.drop_boilerplate(df, F.col("source"), ratio=0.5, min_pages=4).select("doc_id", "text", "n_lines", "n_dropped", "key").collect()
    want = [(i, f"body {i}\n\n  ", 5, 2, "k") for i in range(12)] + [(20, None, 0, 0, "k"), (21, "", 1, 0, "k"), (22, "menu", 1, 0, "k")]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert line_dedup.drop_boilerplate(nothing, F.col("source")).count() == 0


def test_working_columns_do_not_clash(spark, docs):
    names = {"__host": 1, "__lines": 2, "__split": 3, "__kept": 4, "__key": 5, "__row": 6, "__gone": 7}
    odd = docs.withColumns({k: F.lit(v) for k, v in names.items()})
    items = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    for out in (line_dedup.drop_boilerplate(odd, F.col("source"), counts=False), near_duplicates.drop_near_duplicates(odd), decontaminate.decontaminate(odd, items)):
        assert out.columns == odd.columns
        assert [tuple(r) for r in out.select(*names).distinct().collect()] == [tuple(names.values())]


def test_hosts_of_urls(spark):
    urls = {"http://A.example/x": "a.example", "https://u:p@b.org:8080?q": "b.org", "ftp://[::1]:21/": "[::1]", "no url": None, "": None, "http:///x": None}
    df = spark.createDataFrame([(u, h, f"menu\n{i}") for i, (u, h) in enumerate(urls.items())] + [("http://a.example/y", "a.example", "menu\nz"), (None, None, None)], "url string, want string, html string")
    assert all(r.got == r.want for r in df.select("want", line_dedup.host_of(F.col("url")).alias("got")).collect())
    cut = line_dedup.drop_boilerplate(df, line_dedup.host_of(F.col("url")), "html", ratio=0.9, min_pages=2)
    assert {r.html for r in cut.filter("want = 'a.example'").collect()} == {"0", "z"}


def test_language_id(spark, nothing):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(df.filter(~language_id.held_out()))
    seen = language_id.predict(df.filter(language_id.held_out()), model, F.col("lang")).collect()
    assert sum(r.lang == r.lang_pred for r in seen) >= 0.97 * len(seen) and all(0 <= r.score <= 1 for r in seen)
    odd = language_id.predict(table(spark, [(1, None, None, None), (2, "", None, None), (3, "123 !?", None, None), (4, "a", None, None), (5, "漢字", None, None)]), model).collect()
    assert [r.lang_pred for r in odd[:3]] == ["und"] * 3 and all(r.score == 0 for r in odd[:3])
    assert {r.lang_pred for r in odd[3:]} <= set(model.languages)
    assert language_id.learn(nothing) is None
    assert language_id.predict(df.limit(2), None).first().lang_pred == "und"


def test_language_scores_are_corrected():
    held = [np.arange(i * 1000, (i + 1) * 1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for i in range(3)]
    f = language_id.Filter(["a", "b", "c"], [shared.mix(h) for h in held])
    assert all(0 < x < 1e-3 for x in f.false)


def test_language_filter_against_exact_sets():
    """Shares of the filter are those of exact sets, but for false positives."""
    rng = random.Random(4)
    texts = {k: " ".join("".join(rng.choice(a) for _ in range(6)) for _ in range(200)) for k, a in (("a", "abcdef"), ("b", "bcdxyz"), ("c", "mnopqr"))}
    own = {k: np.unique(language_id.grams([t])[0]) for k, t in texts.items()}
    model = language_id.Filter(list(own), list(own.values()))
    for probe in ("abcdef bcdxyz abc", "mnop qrm", "xyz abcd", "zzzzz"):
        h, _, _ = language_id.grams([probe])
        exact = {k: np.isin(h, s).mean() for k, s in own.items()}
        lang, score = (x[0] for x in model.predict([probe]))
        assert exact[lang] == max(exact.values()) and score == pytest.approx(exact[lang], abs=0.01)


def test_no_document_without_an_id_is_held_out(spark):
    df = table(spark, [(None, "word", "en", "a"), (1, "word", "en", "a")])
    assert {r.h for r in df.select(language_id.held_out().alias("h")).collect()} <= {True, False}


def test_language_id_learns_every_label(spark, monkeypatch):
    rng, n = random.Random(13), 66
    own = {f"l{k:02}": ["".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(5)) for _ in range(20)] for k in range(n)}
    df = table(spark, [(k, " ".join(w), lang, "a") for k, (lang, w) in enumerate(own.items())])
    monkeypatch.setattr(language_id, "settle", lambda x, name: x.coalesce(1).cache())
    model = language_id.learn(df)
    assert sorted(model.languages) == sorted(own)
    assert model.predict([" ".join(w[:10]) for w in own.values()])[0] == list(own)


def test_lm_scores(docs, nothing):
    rest = shared.remainder("doc_id", 5) == 1
    got = {r.doc_id: r for r in lm_score.score_documents(docs, rest, table_words=10).collect()}
    tok = lambda t: (t or "").encode().lower().split()
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts, ends = collections.Counter(), 0
    for r in rows_of(docs):
        if not out(r.doc_id):
            counts.update(tok(r.text))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    for r in rows_of(docs):
        x, t = got[r.doc_id], tok(r.text)
        base = sum(np.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in [*(counts[w] for w in t), ends])
        assert x.base_score == pytest.approx(base) and (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (out(r.doc_id), len(t) + 1, sum(counts[w] > 0 for w in t) + 1, n)
        assert x.score < 0
    assert lm_score.score_documents(nothing, rest).count() == 0
    untaught = lm_score.score_documents(docs, F.lit(True)).collect()
    assert all(abs(r.score) < 1e-6 and abs(r.base_score) < 1e-6 and r.n_known == r.train_tokens == 0 for r in untaught)


def test_lm_score_is_the_plain_forward_pass():
    rng = np.random.default_rng(3)
    p = {k: v + 0.1 * rng.standard_normal(v.shape).astype(v.dtype) for k, v in gru.initial(np.ones(gru.HEAD), 9.0).items()}
    docs = [rng.integers(0, gru.HEAD + 1, n).astype(np.int32) for n in (1, 5, 70, 33)]
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for doc, got in zip(docs, gru.score(p, docs)):
        h, last, want = np.zeros(gru.HIDDEN), gru.START, 0.0
        for w in doc.tolist():
            x, g = p["emb"][last] @ p["wx"] + p["b"], h @ p["u"]
            z, r = (sigmoid(x[i : i + gru.HIDDEN] + g[i : i + gru.HIDDEN]) for i in (0, gru.HIDDEN))
            n = np.tanh(x[2 * gru.HIDDEN :] + r * g[2 * gru.HIDDEN :])
            h = z * h + (1 - z) * n
            c, k = divmod(w, gru.PER_CLASS)
            classes = h @ p["wc"] + p["bc"]
            want += classes[c] - np.log(np.exp(classes).sum())
            if w < gru.HEAD:
                inner = h @ p["ww"][c] + p["bw"][c]
                want += inner[k] - np.log(np.exp(inner).sum())
            last = w
        assert got == pytest.approx(want, rel=1e-4)


def test_lm_trains_on_every_token(docs):
    seen = []
    got = lm_score.score_documents(docs, F.col("doc_id") < 5, shard_tokens=100, fitted_on=seen.append).first()
    passes, rounds, width = lm_score.schedule(got.train_tokens, 100)
    assert rounds > 2 and len(seen) == passes * rounds and sum(seen) == passes * got.train_tokens
    for n in (3_000_000, 60_000_000, 4_000_000_000):
        passes, rounds, width = lm_score.schedule(n)
        assert passes == 1 and lm_score.SHARD_TOKENS * rounds * width >= n and rounds <= 2 * max(width, lm_score.SHARDS)


def test_lm_schedule_has_no_switch():
    """Small corpora are trained on as often as large ones; a token more changes nothing below a further shard."""
    seen = [lm_score.schedule(n) for n in (1, 1_999_999, 2_000_000, 11_000_000)]
    assert set(seen) == {(1, 2, 12)}


def test_lm_stretches():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, gru.HEAD + 1, n).astype(np.int32) for n in (1, gru.STRETCH, gru.STRETCH + 1, 5 * gru.STRETCH // 2)]
    parts, firsts = gru.stretches(docs)
    assert np.array_equal(np.concatenate(parts), np.concatenate(docs)) and max(map(len, parts)) == gru.STRETCH
    target, source, begins, owner = gru.lay_out(parts, 3, firsts)
    # Each token is a target once, after the word that it has before it in its document.
    got = sorted(zip(source[target >= 0].tolist(), target[target >= 0].tolist()))
    assert got == sorted((int(d[i - 1]) if i else gru.START, int(w)) for d in docs for i, w in enumerate(d))


def test_lm_is_a_distribution_and_learns():
    rng = np.random.default_rng(0)
    counts = np.zeros(gru.HEAD)
    counts[:40] = np.arange(40, 0, -1)
    p = gru.initial(counts, 5.0)
    text = [np.array(([3, 7, 1] * 20)[: rng.integers(20, 60)], np.int32) for _ in range(60)]
    before, learned = gru.score(p, text).sum(), gru.train(gru.train(p, text), text)
    assert gru.score(learned, text).sum() > before + 100
    after = [np.append(text[0], np.int32(k)) for k in range(gru.HEAD + 1)]
    total = np.exp(gru.score(learned, after) - gru.score(learned, [text[0]])[0]).sum()
    assert total == pytest.approx(1, abs=1e-3)
    assert np.allclose(gru.score(learned, text, most=1), gru.score(learned, text, most=50), rtol=1e-4)


def test_lm_gradient():
    rng = np.random.default_rng(1)
    p = {k: v + 0.1 * rng.standard_normal(v.shape) for k, v in gru.initial(np.ones(gru.HEAD), 1.0).items()}
    doc = [np.array([1, 40, gru.HEAD, 2, 1], np.int32)]
    moved = gru.train(p, doc, rate=1e-4)
    assert gru.score(moved, doc)[0] > gru.score(p, doc)[0]


@pytest.mark.parametrize("rows, length", [(7, None), (7, 1), (1024, None), (1024, 1)])
def test_top_k(spark, rows, length):
    rng = np.random.default_rng(2)
    vecs = [(i, [float(x) for x in rng.standard_normal(8) / 3], "x") for i in range(120)]
    vecs += [(200 + i, vecs[20][1], "x") for i in range(30)] + [(300, None, "x"), (301, [1.0, None], "x"), (302, [float("nan")] * 8, "x"), (303, [float("inf")] * 8, "x"), (None, [9.0] * 8, "x"), (20, vecs[20][1], "x"), (400, [1e6] * 8, "x"), (401, [0.5], "x")]
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>, v string")
    got = collections.defaultdict(list)
    for r in top_k.search(df, F.col("vec_id") % 20 == 0, 5, node_rows=rows, tile_rows=rows, length=length).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    good = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in vecs if i is not None and i not in (300, 301, 302, 303)}
    for q in [i for i in good if i % 20 == 0]:
        best = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert top_k.search(df.filter("false"), F.col("vec_id") % 20 == 0, 5).count() == 0
    assert top_k.search(df.filter("vec_id = 20"), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_top_k_of_large_components(spark):
    vecs = {0: [1e16, 1e16], 1: [1e16, 1e16], 2: [-1e16, -1e16], 3: [2.0**40, 3.0], 4: [2.0**40, 2.0], 20: []}
    df = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<double>")
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in vecs.items()}
    got = top_k.search(df, F.col("vec_id") % 20 == 0, 9).collect()
    for q in (0, 20):
        want = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v)))), i) for i, v in whole.items() if i != q)
        assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]


def test_licenses(spark, nothing):
    texts = {1: "intro\nReleased under the MIT License.\nend", 2: "This work is licensed under the GNU General Public License, version 2.", 3: "Licensed under CC BY-NC 4.0.", 4: "Licensed under CC BY 4.0.", 5: "All rights reserved by me.", 6: "Long " * 300 + ". Licensed under the Apache License, Version 2.0. More.", 7: "Licensed under the Apache License, Version 9.0.", 8: None, 9: "", 10: "no mark here", 11: "licensed under the\n# MIT License"}
    got = license_scan.scan_licenses(table(spark, [(i, t, None, None) for i, t in texts.items()])).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "MIT"), (2, "GPL-2.0"), (3, "CC-BY-NC-4.0"), (4, "CC-BY-4.0"), (6, "Apache-2.0"), (7, None), (11, "MIT")}
    assert {r.doc_id: texts[r.doc_id][r.begin : r.end] for r in got}[1] == "Released under the MIT License"
    assert license_scan.scan_licenses(nothing).count() == 0 and license_scan.scan_licenses(table(spark, [(1, "a b c", None, None)]), {}).count() == 0


def test_wrapped_license_texts():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    for name, own in license_scan.TEMPLATES.items():
        for text in own:
            found = license_scan.word.findall(("Some words. " + "\n * ".join(textwrap.wrap(text, 60)) + "\nand more of them").lower())
            assert [x[0] for a, b in scanner.blocks(found) for x in scanner.confirm(tuple(found[a:b]))] == [name]


def test_license_gate_loses_nothing(spark):
    """Every window of the documents that holds a template's wording, found without the gate, is found with it."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    rows = [r for r in rows_of(spark.read.parquet(f"{SF}/documents.parquet")) if r.text]
    found, brute = set(), set()
    for r in rows:
        own = license_scan.word.findall(r.text.lower())
        found |= {(r.doc_id, x[0]) for a, b in scanner.blocks(own) for x in scanner.of(tuple(own[a:b])) if x[0]}
        for name, template in zip(scanner.names, scanner.words):
            n = len(template)
            brute |= {(r.doc_id, name) for i in range(len(own) - n + 1) if sum(x == y for x, y in zip(own[i : i + n], template)) >= n - max(1, n // 10) and {w for w in template if license_scan.TELLING.search(w)} <= set(own[i : i + n])}
    assert brute and brute <= found


def brute_components(docs, percent):
    sets = {}
    for r in docs:
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return sets, {d: top(d) for d in sets}


def test_near_duplicates(spark, docs, nothing):
    rng = random.Random(9)
    base = words(rng, 120, 3000)
    chain = [(500 + i, " ".join(base[:i] + [f"z{j}" for j in range(i)] + base[i * 2 :]), "en", "a") for i in range(12)]
    copies = []
    for i in range(40):
        own = list(base)
        for _ in range(rng.randrange(3)):
            own[rng.randrange(120)] = f"q{rng.randrange(10**6)}"
        copies.append((600 + i, " ".join(own), "en", "a"))
    df = docs.unionByName(table(spark, chain + copies)).dropDuplicates(["doc_id"])
    for percent in (85, 80):
        sets, comps = brute_components(rows_of(df), percent)
        got = near_duplicates.near_duplicates(df, percent).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((d, len(s), comps[d], comps[d] == d) for d, s in sets.items())
    assert sorted(r.doc_id for r in near_duplicates.drop_near_duplicates(df).collect()) == sorted(d for d in comps if comps[d] == d)
    assert near_duplicates.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    rng = random.Random(11)
    base, alone = words(rng, 200, 5000), words(rng, 200, 5000)
    near = [base[:i] + ["changed"] + base[i + 1 :] for i in (0, 199)]
    bare = words(rng, 200, 5000)
    nameless = [bare, bare[:-1] + ["other"], ["other"] + bare[1:]]
    rows = [(1, base), (1, base), (5, near[0]), (5, alone), (None, base), (None, near[1]), *((None, x) for x in nameless), (7, [])]
    df = table(spark, [(i, " ".join(x), "en", "a") for i, x in rows])
    got = near_duplicates.near_duplicates(df)
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got.collect()), key=repr) == sorted([(1, 1, True), (1, 1, False), (5, 1, False), (5, 5, True), *[(None, 1, False)] * 2, (None, None, True), *[(None, None, False)] * 2, (7, 7, True)], key=repr)
    left = near_duplicates.drop_near_duplicates(df)
    assert left.columns == df.columns
    seen = [(r.doc_id, r.text.split()) for r in left.collect()]
    assert len(seen) == 4 and all(x in seen for x in [(1, base), (5, alone), (7, [])]) and sum(i is None and x in nameless for i, x in seen) == 1


def test_signatures_find_similar_sets():
    rng, borrow, missed = np.random.default_rng(4), near_duplicates.detours(), 0
    for n in [2, 5, 12, 40, 300] * 40:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.append(a[: len(a) - len(a) // 12], rng.integers(0, 2**63, len(a) // 12, dtype=np.uint64)))
        x, y = (near_duplicates.band_keys(near_duplicates.signature(s, borrow)) for s in (a, b))
        missed += not (x == y).any()
    assert missed == 0


def test_queries_match_their_sql(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        assert sorted((tuple(r[k] for k in cols) for r in df.collect()), key=repr) == sorted(c.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=repr), name
