"""Operator 2: token counts of a word-end BPE tokenizer without making the tokens.

Offline, on the driver, every vocabulary string that ends a word is merged from its characters; those that come out
as one token are proven whole. A pre-token in that set counts one; only the rest are merged, each distinct word once
per task while the bounded memory of word counts holds it.

Defined cases: a null text is empty and has 0 tokens; added special strings inside a text are one token each and end
the words around them; repeated rows each give a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .letters import Splitter, ranges
from .merges import merge_word
from .shared import text_rows

#: Capitals whose small letters Unicode 15.1 lacks, and the first of those, by range.
CAPITALS = {"1C89": "1C8A", "A7CB": "264", "A7CC": "A7CD", "A7CE": "A7CF", "A7D2": "A7D3", "A7D4": "A7D5", "A7DA": "A7DB", "A7DC": "19B", "10D50-10D65": "10D70", "16EA0-16EB8": "16EBB"}
#: Combining marks that the tokenizer's normaliser, which is older, takes for starters.
NEWER_MARKS = "7FD 899-89B 8CF-8D3 C3C D3B-D3C EBA 1715 1ABF-1AC0 1AC3-1AC4 1ACA 1DF6-1DFA A82C 10EFD-10EFF 10F46-10F47 10F4B 10F4D-10F50 10F83 10F85 11070 1133B 11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E4EC-1E4EE"
REMEMBERED = 300_000


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCounts(dict):
    """word (str, normalised) -> number of tokens; whole tokens stay, other words are remembered up to a bound."""

    def __init__(self, merges: dict[tuple[str, str], int], end: str, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.merges, self.end, self.whole, self.letters = merges, end, whole, byte_letters()

    def merged(self, word: str) -> list[str]:
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += self.end
        return merge_word(parts, lambda a, b: self.merges.get((a, b)), lambda a, b: a + b)

    def __missing__(self, word: str) -> int:
        if len(self) >= len(self.whole) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = self[word] = len(self.merged(word))
        return n


def whole_tokens(vocabulary: dict[str, int], merges: dict[tuple[str, str], int], end: str) -> frozenset[str]:
    """Words that encode alone as exactly one token, each proven by merging it."""
    back = {c: b for b, c in byte_letters().items()}
    counts, out = WordCounts(merges, end, frozenset()), set()
    for token in vocabulary:
        bare = token.removesuffix(end)
        if token.endswith(end) and bare and all(c in back for c in bare):
            try:
                word = bytes(back[c] for c in bare).decode()
            except UnicodeDecodeError:
                continue
            if counts.merged(word) == [token]:
                out.add(word)
    return frozenset(out)


LOWER = {c: int(small, 16) + c - a for spec, small in CAPITALS.items() for a, b in ranges(spec) for c in range(a, b + 1)}
cut_at_marks = re.compile("([" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges(NEWER_MARKS)) + "])").split
capital = re.compile("[" + "".join(f"\\U{c:08x}" for c in LOWER) + "]").search


def lower(text: str) -> str:
    """Lower case letter by letter: no final-sigma rule, as the tokenizer does it."""
    low = text.lower() if "Σ" not in text else "".join(map(str.lower, text))
    return low.translate(LOWER) if not low.isascii() and capital(low) else low


def composed(text: str) -> str:
    """NFC, where marks newer than the tokenizer's tables neither move nor compose."""
    parts = cut_at_marks(text)
    return unicodedata.normalize("NFC", text) if len(parts) == 1 else "".join(unicodedata.normalize("NFC", x) for x in parts)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    merges = {tuple(pair if isinstance(pair, list) else pair.split(" ")): rank for rank, pair in enumerate(model["merges"])}
    end = model["end_of_word_suffix"]
    specials = [t["content"] for t in spec["added_tokens"]]
    words = Splitter.of(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
    sent = docs.sparkSession.sparkContext.broadcast((merges, end, whole_tokens(model["vocab"], merges, end)))

    def count(batches):
        counts = WordCounts(*sent.value)
        cut = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))).split
        get = counts.__getitem__

        def of(text: str) -> int:
            parts = cut(text) if any(s in text for s in specials) else [text]
            n = len(parts) - 1
            for part in parts:
                n += sum(map(get, words(lower(part if part.isascii() else composed(part)))))
            return n

        for batch in batches:
            texts = batch.column("text")
            n = [of(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return text_rows(docs, id_col=id_col, text_col=text_col).mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
