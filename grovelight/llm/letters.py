"""Letters, numbers and white space as the tokenizers' libraries know them, and splitting by patterns over them.

Python's, Java's and the libraries' Unicode versions differ, so classes are spelled out as ranges of code points.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

#: Letters and numbers of Unicode 16 that Unicode 15.1, the version of Python 3.13, lacks.
LETTERS_16 = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
NUMBERS_16 = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
#: Unicode's White_Space.
SPACES = "9-D 20 85 A0 1680 2000-200A 2028-2029 202F 205F 3000"


def ranges(spec: str) -> list[tuple[int, int]]:
    """'A-C 10' as pairs of first and last code point."""
    pairs = [part.split("-") for part in spec.split()]
    return [(int(p[0], 16), int(p[-1], 16)) for p in pairs]


@lru_cache(8)
def of_category(kind: str, more: str) -> tuple[tuple[int, int], ...]:
    """Runs of code points whose general category starts with ``kind``, and the ranges ``more``."""
    have = [unicodedata.category(chr(c)).startswith(kind) for c in range(sys.maxunicode + 1)]
    for a, b in ranges(more):
        have[a : b + 1] = [True] * (b + 1 - a)
    edges = [c for c in range(len(have)) if have[c] != (c > 0 and have[c - 1])]
    return tuple((a, b - 1) for a, b in zip(edges[::2], [*edges[1::2], len(have)] if len(edges) % 2 else edges[1::2]))


def members(name: str, most: int) -> str:
    r"""The inside of a character class for ``\p{L}``, ``\p{N}`` or ``\s``, up to the code point ``most``."""
    runs = ranges(SPACES) if name == r"\s" else of_category("L", LETTERS_16) if name == r"\p{L}" else of_category("N", NUMBERS_16)
    return "".join(f"\\U{a:08x}-\\U{min(b, most):08x}" for a, b in runs if a <= most)


def spelled(pattern: str, most: int = sys.maxunicode) -> str:
    r"""``pattern`` with ``\p{L}``, ``\p{N}``, ``\s`` and ``\S`` spelled out for texts whose code points are at most ``most``."""
    out, inside = [], False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.DOTALL):
        if part in "[]":
            inside = part == "["
        elif part == r"\S" and not inside:
            part = f"[^{members(r'\s', most)}]"
        elif part in (r"\p{L}", r"\p{N}", r"\s"):
            part = members(part, most) if inside else f"[{members(part, most)}]"
        elif part == r"\S" or part.startswith(r"\p"):
            raise ValueError(f"{part} can't be spelled out")
        out.append(part)
    return "".join(out)


class Splitter:
    """All matches of a pattern of the tokenizers. Texts without supplementary code points need shorter classes."""

    def __init__(self, basic: str, every: str):
        self.patterns = basic, every
        self.basic, self.every = (re.compile(p).findall for p in self.patterns)

    @classmethod
    def of(cls, pattern: str) -> Splitter:
        return cls(spelled(pattern, 0xFFFF), spelled(pattern))

    def __reduce__(self):
        return Splitter, self.patterns

    def __call__(self, text: str) -> list[str]:
        return (self.basic if text.isascii() or len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text) else self.every)(text)
