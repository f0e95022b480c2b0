"""Operator 6: language identification by language-bitmask n-gram filters.

Learning: in a sample of labelled documents (at most about ``sample`` a language, drawn by hash) the tasks count in
how many documents each letter n-gram occurs; each language keeps its ``grams`` most frequent ones. All languages
share one bit-sliced Bloom filter: a slot is a mask with one bit a language, of as many 64-bit words as all labels need,
so ANDing the slots of an n-gram gives every language that holds it. A text's score for a language is its share of n-grams held, corrected for the
filter's false positives: (hits/n - f) / (1 - f). The highest decides; ties go to the language with more documents.

Defined cases: a null text or one without a letter is ``und`` with score 0; with nothing to learn from, all are
``und``; repeated rows each give a row; rows without lang only take no part in learning; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import mix, pieces, remainder, settle

N = 4
SAMPLE = 4000
GRAMS = 40_000
SLOT_BITS = 20
UND = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter; made once a worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000))
    return _letters[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' n-grams around a letter, the text each belongs to, and which texts hold a letter."""
    padded = [f"  {t.lower()}  " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in padded])
    letter = letters()[points]
    points = np.where(letter, points, 32).astype(np.uint64)
    n = len(points) - N + 1
    h = np.zeros(max(n, 0), np.uint64)
    for i in range(N):
        h = h * np.uint64(0x100000001B3) + points[i : i + n]
    use = (letter[1 : 1 + n] | letter[2 : 2 + n]) & (owner[:n] == owner[N - 1 :])
    has = np.zeros(len(texts), np.bool_)
    has[owner[letter]] = True
    return mix(h[use]), owner[:n][use], has


def slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two slots of an n-gram."""
    size = np.uint64((1 << SLOT_BITS) - 1)
    return h & size, (h >> np.uint64(SLOT_BITS)) & size


class Filter:
    """Bit-sliced Bloom filter over all languages, 64 to a word."""

    def __init__(self, languages: list[str], held: list[np.ndarray]):
        self.languages = languages
        self.masks = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), np.uint64)
        for k, h in enumerate(held):
            for s in slots(h):
                self.masks[k // 64, s] |= np.uint64(1 << k % 64)
        share = [np.mean((self.masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(languages))]
        self.false = np.array(share, float) ** 2

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        h, owner, has = grams(texts)
        a, b = slots(h)
        held = [m[a] & m[b] for m in self.masks]
        total = np.bincount(owner, minlength=len(texts))
        hits = np.stack([np.bincount(owner[(held[k // 64] >> np.uint64(k % 64)) & np.uint64(1) != 0], minlength=len(texts)) for k in range(len(self.languages))], 1)
        share = (hits / np.maximum(total, 1)[:, None] - self.false) / (1 - self.false)
        best = share.argmax(1)
        score = np.clip(share[np.arange(len(texts)), best], 0, 1)
        return [self.languages[k] if x else UND for k, x in zip(best, has)], np.where(has, score, 0).tolist()


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Filter | None:
    """The filter of the languages in ``docs``; what reaches the driver is bounded by languages times ``GRAMS``."""
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, sample / n))])
    drawn = labelled.filter(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < F.try_element_at(shares, F.col("lang")) * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, most=1 << 20):
            langs = piece.column("lang").to_pylist()
            h, owner, _ = grams(piece.column("text").to_pylist())
            for lang in sorted(set(langs)):
                mine = np.array([x == lang for x in langs])[owner]
                pairs = np.unique(np.stack([h[mine], owner[mine].astype(np.uint64)], 1), axis=0) if mine.any() else np.zeros((0, 2), np.uint64)
                seen, n = np.unique(pairs[:, 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    held = settle(drawn.select("text", "lang").mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    out = []
    for lang in counts:
        top = held.filter(F.col("lang") == lang).orderBy(F.desc("n"), "gram").limit(GRAMS).select("gram").toArrow()
        out.append(top.column("gram").to_numpy().view(np.uint64))
    return Filter(list(counts), out)


def predict(docs: DataFrame, model: Filter | None, *more: str | Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score[, more]) of every whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *more)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, most=1 << 20):
            texts = [t or "" for t in piece.column("text").to_pylist()]
            langs, scores = sent.value.predict(texts) if sent.value else ([UND] * len(texts), [0.0] * len(texts))
            kept = [piece.column(c) for c in piece.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*(c for c in piece.schema.names if c != "text"), "lang_pred", "score"])

    fields = [f for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """A document without an id is not held out."""
    return F.coalesce(remainder(id_col, 4) == 2, F.lit(False))
