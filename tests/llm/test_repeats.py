"""Repeated passages against brute force over all windows, and the collection's transform against sorted suffixes."""

import hashlib
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelight.llm import collection_bwt, queries, repeats
from tests.conftest import SF


def collection(rng, letters):
    base = [bytes(rng.randrange(97, 97 + letters) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 12))]
    return [rng.choice(base)[rng.randrange(3) :] or b"z" for _ in range(rng.randrange(1, 30))] + base


def common(a, b, most):
    k = 0
    while k < min(len(a), len(b), most) and a[k] == b[k]:
        k += 1
    return k


@pytest.mark.parametrize("seed", range(12))
def test_transform(seed):
    rng = random.Random(seed)
    strings, width = collection(rng, [1, 2, 3, 20][seed % 4]), [1, 3, 8][seed % 3]
    data, offsets = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0] + [len(s) for s in strings])
    suffixes = sorted((s[i:], j) for j, s in enumerate(strings) for i in range(len(s) + 1))
    seen, later = set(), set()
    for j, s in enumerate(strings):
        for t in range(len(s) - width + 1):
            (later.add((j, t)) if s[t : t + width] in seen else seen.add(s[t : t + width]))
    for size in (1 << 20, 60):
        with tempfile.TemporaryDirectory() as folder:
            *files, n = collection_bwt.build(folder, data, offsets, width, size)
            assert n == len(suffixes)
            sym, lcp = (np.fromfile(file, np.uint8, n).tolist() for file in files)
        assert sym == [strings[j][-len(x) - 1] if len(x) < len(strings[j]) else collection_bwt.END for x, j in suffixes]
        assert lcp == [0] + [common(a[0], b[0], width) for a, b in zip(suffixes, suffixes[1:])]
        assert {tuple(x) for x in collection_bwt.later_copies(data, offsets, width, size).tolist()} == later


def brute(rows, width):
    """rows: (doc_id, text). Per row (doc_id, n_bytes, spans, kept), first of repeated rows first."""
    seen, out = set(), []
    key = lambda r: (r[0] is not None, r[0], hashlib.md5((r[1] or "").encode()).digest())
    for doc_id, text in sorted(rows, key=key):
        raw = (text or "").encode()
        covered = np.zeros(len(raw), bool)
        for t in range(len(raw) - width + 1):
            if raw[t : t + width] in seen:
                covered[t : t + width] = True
            else:
                seen.add(raw[t : t + width])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        spans = tuple(map(tuple, edges.reshape(-1, 2).tolist()))
        out.append((doc_id, len(raw), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~covered].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def shown(df):
    return sorted(((r.doc_id, r.n_bytes, tuple(map(tuple, r.spans)), r.kept_sha256) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(3000)}é" for _ in range(n))
    passage, line = words(60), "All rights are reserved by the owner of this page, and nothing may be copied. "
    out = [(i, words(rng.randrange(5, 80))) for i in range(40)]
    out += [(100 + i, words(20) + " " + passage + " " + words(rng.randrange(30))) for i in range(8)]
    out += [(120 + i, (words(15) + line) * rng.randrange(1, 4)) for i in range(10)]
    near = words(300)
    out += [(140, near), (141, near[:700] + "X" + near[701:]), (142, near), (143, near[1:]), (139, near[300:900])]
    out += [(150, "a" * 700), (151, "ab" * 200), (152, "a" * 99), (153, "a" * 100), (154, None), (155, ""), (156, "x" * 99 + "y")]
    out += [(160, near), (160, near), (160, passage), (None, passage + words(9)), (None, None), (170, "日本語テキスト" * 40), (171, words(3000)), (171, words(2))]
    return out


@pytest.mark.parametrize("hot,part_bytes", [(repeats.HOT, repeats.PART_BYTES), (3, 2000)])
def test_repeats(spark, rows, hot, part_bytes):
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "doc_id long, text string, n int, key string").repartition(5)
    assert shown(repeats.repeats(docs, hot=hot, part_bytes=part_bytes)) == brute(rows, 100)


def test_remove(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows if r[0] != 160], "doc_id long, text string, kept int")
    got = repeats.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "kept", "kept_"]
    assert sorted((repr(r[0]), hashlib.sha256(bytes(r[3])).hexdigest()) for r in got.collect()) == sorted((repr(r[0]), r[3]) for r in brute([x for x in rows if x[0] != 160], 100))


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.repeats(none).count() == 0
    with pytest.raises(ValueError):
        repeats.repeated_spans(none, width=8)


def test_query(spark):
    got = queries.op12_suffix_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, n, sum(b - a for a, b in spans), len(spans), kept) for d, n, spans, kept in brute(docs, 100)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
