"""Collocations against a plain count, with ties, repeats, nulls, odd blanks and phrases inside longer ones; and the SQL."""

import collections
import random
import re
import string

import duckdb
import pytest

from grovelight.llm import collocations, queries
from tests.conftest import SF

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows, longest, least, percent, first):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = collections.Counter()
    for (lang, w), a in candidates.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                inside[lang, w[i : i + n]] = max(inside[lang, w[i : i + n]], a)
    out = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        score, _, l, r = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        if 100 * inside[lang, w] < percent * a or not inside[lang, w]:
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:first]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = ["New", "york", "new", "city", "é", "Ü", "of", "the", "a b", "日本", "x'y", "|"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(n))
    out = [(rng.choice(["en", "fr", None, "und"]), text(rng.randrange(60))) for _ in range(150)]
    out += [("en", "New York City hall. new york city Hall")] * 20 + [("de", "the the the the the the"), ("de", None), (None, ""), ("de", " \t. ,")]
    return out + [("de", "eins zwei drei, eins zwei drei") for _ in range(7)] + [("long", "go on " * 30_000)]


@pytest.mark.parametrize("longest,least,percent,first,bucket_words", [(3, 10, 50, 2000, 4_000_000), (4, 3, 80, 25, 300), (2, 1, 50, 10, 1000)])
def test_mine(spark, rows, longest, least, percent, first, bucket_words):
    docs = spark.createDataFrame([(*r, 1, "w", 2) for r in rows], "lang string, text string, n int, phrase string, f int").repartition(4)
    got = collocations.mine(docs, longest=longest, least=least, percent=percent, first=first, bucket_words=bucket_words)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, longest, least, percent, first)


def test_large_counts(spark):
    big = [(999_999_999_999_999,) * 3, (10**14 - 3, 10**15 - 1, 10**14)]
    for r in spark.createDataFrame(big, "a long, l long, r long").selectExpr("*", f"{collocations.EXACT} AS score").collect():
        assert r.score == 10**6 * r.a * r.a // (r.l * r.r)


def test_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    with pytest.raises(ValueError):
        collocations.mine(spark.createDataFrame([], "lang string, text string"), longest=1)


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    got = sorted(map(tuple, queries.op11_collocations(spark, SF).collect()))
    assert got and got == plain(docs, 3, 10, 50, 2000)
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(db.sql(queries.ORACLE_SQL["op11_collocations"]).fetchall()) == got
