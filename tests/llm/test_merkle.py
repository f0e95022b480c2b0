"""The manifest against a plain tree, over one to several tiers, with ties, nulls and lone leaves."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from grovelight.llm import merkle, queries
from tests.conftest import SF


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    shown = [None if v is None else str(v) for v in values]
    return h("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in shown))


def climb(nodes, paths):
    """Root of a list of (digest, members), adding every member's siblings to its path."""
    while len(nodes) > 1:
        after = []
        for a in range(0, len(nodes), 16):
            run = nodes[a : a + 16]
            for k, (_, members) in enumerate(run):
                for m in members:
                    paths[m].append((k, [d for j, (d, _) in enumerate(run) if j != k]))
            after.append((h("".join(d for d, _ in run)), [m for _, ms in run for m in ms]))
        nodes = after
    return nodes[0]


def plain(rows):
    """rows: (source, doc_id, leaf). Per row number: subroot and path; and the root."""
    paths = {i: [] for i in range(len(rows))}
    subroots, tops = {}, []
    for s in sorted({r[0] for r in rows}, key=lambda s: (s is not None, (s or "").encode())):
        own = sorted((i for i, r in enumerate(rows) if r[0] == s), key=lambda i: (rows[i][1] is not None, rows[i][1], rows[i][2]))
        top = climb([(rows[i][2], [i]) for i in own], paths)
        tops.append(top)
        subroots |= {i: top[0] for i in own}
    return subroots, paths, climb(tops, paths)[0]


@pytest.mark.parametrize("step,top", [(3, 4096), (1, 3), (2, 1)])
def test_manifest(spark, step, top):
    rows = [(s, i, f"text {i}") for s, n in (("a", 300), ("b", 17), ("é", 16), ("z", 1), (None, 2), ("", 33)) for i in range(n)]
    rows += [("b", 5, "text 5"), ("b", 5, "text 5"), ("b", 5, "other"), ("a", None, None)] + [(f"s{i}", i, "x") for i in range(40)]
    docs = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "source string, doc_id long, text string, pos int, size string").repartition(5)
    made = merkle.manifest(docs, merkle.leaf(F.col("doc_id"), F.col("text")), F.col("source"), [F.col("doc_id")], ["source", "doc_id", "pos"], top, step)
    subroots, paths, root = plain([(r[0], r[1], leaf(r[1], r[2])) for r in rows])
    assert made.root == root
    got = made.proofs.select("row.*", "leaf", "subroot", "path", merkle.fold(F.col("leaf"), F.col("path")).alias("folded"), F.sha2(F.concat("leaf", F.lit("!")), 256).alias("bad")).withColumn("caught", merkle.fold(F.col("bad"), F.col("path")) != F.lit(root)).collect()
    shown = lambda s, d, l, sub, path: (str(s), str(d), l, sub, str(path))
    assert sorted(shown(r.source, r.doc_id, r.leaf, r.subroot, [(p.at, list(p.siblings)) for p in r.path]) for r in got) == sorted(shown(r[0], r[1], leaf(r[1], r[2]), subroots[i], paths[i]) for i, r in enumerate(rows))
    assert all(r.folded == root and r.caught for r in got)
    assert sorted(r.pos for r in got) == list(range(len(rows)))


def test_one_row_and_none(spark):
    docs = spark.createDataFrame([(1, "A", None)], "doc_id long, text string, source string")
    made = merkle.manifest(docs, merkle.leaf(F.col("text")), F.col("source"), [F.col("doc_id")], ["doc_id"])
    assert made.root == leaf("A") and made.proofs.first().path == []
    none = merkle.manifest(docs.filter("false"), merkle.leaf(F.col("text")), F.col("source"), [F.col("doc_id")], ["doc_id"])
    assert none.root is None and none.proofs.count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    subroots, paths, root = plain([(d.source, d.doc_id, leaf(*d)) for d in docs])
    fold = lambda at, path: at if not path else fold(h("".join(path[0][1][: path[0][0]]) + at + "".join(path[0][1][path[0][0] :])), path[1:])
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = set()
    for i, d in enumerate(docs):
        hit = zlib.crc32(str(d.doc_id).encode()) % 5 == 0 and d.text is not None
        folded = fold(leaf(*d[:4], d.text.translate(lower)) if hit else leaf(*d), paths[i])
        want.add((d.doc_id, leaf(*d), subroots[i], root, h("".join(s for _, p in paths[i] for s in p)), folded, folded == root))
    got = queries.op13_merkle_manifest(spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = {tuple(r) for r in got.collect()}
    assert rows == want and {r[-1] for r in rows} == {True, False}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert set(db.sql(queries.ORACLE_SQL["op13_merkle_manifest"]).fetchall()) == rows
