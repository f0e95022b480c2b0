"""Operator 9: license scan by conditional compression.

Texts are read as words, so line breaks and comment marks don't matter. Three neighbouring words of a template are a
hit; the stretches where hit templates would lie, merged where they overlap, are the candidate blocks. A block is compressed on its
own and once with each template as a zstandard raw dictionary; the templates are ranked by how much that saves. Going
down the ranking, a template is confirmed at each place of its hits where the block really holds its wording: words are
aligned, and every word of the template that is missing, and every further word inside, is a difference. A tenth of the
template's words may be missing and a tenth too many, one at least, but a number or telling word (such as NC) never. All
places that don't overlap are returned. An SPDX-License-Identifier line is read by its own grammar: each license of its expression gives a row.

Defined cases: null and empty texts have no block; a block that no template explains is returned without a license;
repeated rows each give their rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, text_rows

#: Published texts and notices by SPDX identifier.
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons Attribution{0} 4.0 International License."
TEMPLATES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "AGPL-3.0-or-later": [_GNU.format("Affero General Public License", 3)],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", f"{_BSD_HEAD} {_BSD_TAIL}"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"],
    "BSD-4-Clause": [f"{_BSD_HEAD} 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4{_BSD_THIRD[1:]} {_BSD_TAIL}"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", _CC.format("")],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", _CC.format("-NonCommercial")],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", _CC.format("-ShareAlike")],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-2.0-only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License."],
    "GPL-2.0-or-later": [_GNU.format("General Public License", 2)],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "GPL-3.0-or-later": [_GNU.format("General Public License", 3)],
    "ISC": [f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-3.0-or-later": [_GNU.format("Lesser General Public License", 3)],
    "MIT": ["Released under the MIT License.", f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
ALLOWED = 0.1
#: Neighbouring words of a template that make a hit.
GRAM = 3
#: Words without which a wording is another license's.
TELLING = re.compile(r"\d|^(nc|sa|nd|by|cc|mit|bsd|isc|gnu|gpl|lgpl|agpl|mpl|epl|apache|mozilla|affero|lesser|noncommercial|sharealike|attribution|neither|later|advertising)$")

word = re.compile(r"[A-Za-z]+|\d+(?:\.\d+)*")


#: An expression of license identifiers; what follows WITH is an exception, not a license.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*((?:[(][ \t]*)*[A-Za-z0-9.+-]+(?:[ \t()]+(?:AND|OR|WITH)[ \t()]+[A-Za-z0-9.+-]+)*)")
TAG_PART = re.compile(r"(WITH[ \t]+)?([A-Za-z0-9.+-]+)")


def tagged(text: str) -> list[tuple[str, int, int]]:
    """(license, begin, end) of each identifier of the text's SPDX lines."""
    out = []
    for tag in TAG.finditer(text):
        for part in TAG_PART.finditer(text, tag.start(1), tag.end(1)):
            if not part[1] and part[2] not in ("AND", "OR", "WITH"):
                out.append((part[2].rstrip("."), part.start(2), part.start(2) + len(part[2].rstrip("."))))
    return out


def aligned(template: list[str], block: list[str | None]) -> tuple[list[str], list[str], int, int]:
    """After aligning both word by word: words of the template that the block lacks or has elsewhere; words that the block
    has too many between the first and the last that agree; the first of these and the end of the last."""
    ops = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    same = [(a, b) for op, _, _, a, b in ops if op == "equal"]
    first, end = (same[0][0], same[-1][1]) if same else (0, 0)
    more = [w for op, _, _, a, b in ops if op in ("replace", "insert") and first <= a and b <= end for w in block[a:b]]
    return [w for op, a, b, _, _ in ops if op in ("replace", "delete") for w in template[a:b]], more, first, end


class Scanner:
    """Compressors and word triples of all templates, made once a task."""

    def __init__(self, templates: dict[str, list[str]]):
        texts = sorted((name, text) for name, own in templates.items() for text in own)
        self.names = [n for n, _ in texts]
        self.words = [word.findall(t.lower()) for _, t in texts]
        kind = zstandard.DICT_TYPE_RAWCONTENT
        self.with_each = [zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(" ".join(w).encode().ljust(8), dict_type=kind), write_content_size=False, write_dict_id=False) for w in self.words]
        self.alone = zstandard.ZstdCompressor(level=9, write_content_size=False)
        self.ids: dict[str, int] = {}
        self.places: dict[int, list[tuple[int, int]]] = {}
        size = min(GRAM, *map(len, self.words)) if self.words else GRAM
        self.gram = max(1, size)
        for k, own in enumerate(self.words):
            ids = np.array([self.ids.setdefault(w, len(self.ids) + 1) for w in own], np.int64)
            for i, g in enumerate(self.grams(ids).tolist()):
                self.places.setdefault(g, []).append((k, i))
        self.known = np.array(sorted(self.places), np.int64)
        self.of = lru_cache(20_000)(self.confirm)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        n = max(0, len(ids) - self.gram + 1)
        out = np.zeros(n, np.int64)
        for i in range(self.gram):
            out = out << 20 | ids[i : i + n]
        return out

    def places_of(self, found: list[str]) -> dict[int, list[tuple[int, int]]]:
        """For each template with hits, where in the words it would begin: ranges of neighbouring places."""
        get = self.ids.get
        grams = self.grams(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
        if not len(self.known) or not len(grams):
            return {}
        at = np.searchsorted(self.known, grams)
        hits = np.flatnonzero(self.known[np.minimum(at, len(self.known) - 1)] == grams)
        begins: dict[int, set[int]] = {}
        for h in hits.tolist():
            for k, i in self.places[int(grams[h])]:
                begins.setdefault(k, set()).add(h - i)
        out: dict[int, list[tuple[int, int]]] = {}
        for k, own in begins.items():
            ordered, near = sorted(own), len(self.words[k]) // 5
            for d in ordered:
                if k in out and d - out[k][-1][1] <= near:
                    out[k][-1] = out[k][-1][0], d
                else:
                    out.setdefault(k, []).append((d, d))
        return out

    def blocks(self, found: list[str]) -> list[tuple[int, int]]:
        """Candidate stretches of the words, merged where they overlap, with some words around them; they are disjoint."""
        spans = sorted((max(0, low), min(len(found), high + len(self.words[k])), 2 + len(self.words[k]) // 5) for k, own in self.places_of(found).items() for low, high in own)
        out: list[tuple[int, int, int]] = []
        for a, b, slack in spans:
            if out and a < out[-1][1]:
                out[-1] = out[-1][0], max(b, out[-1][1]), max(slack, out[-1][2])
            else:
                out.append((a, b, slack))
        limits = [0, *(a for a, _, _ in out[1:]), len(found)]
        done, wide = 0, []
        for i, (a, b, slack) in enumerate(out):
            wide.append((max(done, a - slack), done := min(limits[i + 1], b + slack)))
        return wide

    def confirm(self, block: tuple[str, ...]) -> list[tuple[str | None, float, list[str], list[str], int, int]]:
        """(license, saved, missing words, further words, first word, end word) of every place where the block holds a
        template; one without a license if none."""
        data = " ".join(block).encode()
        plain = len(self.alone.compress(data))
        saved = [plain - len(c.compress(data)) for c in self.with_each]
        own = self.places_of(list(block))
        left: list[str | None] = list(block)
        out: list[tuple[str | None, float, list[str], list[str], int, int]] = []
        for i in sorted(own, key=lambda i: (-saved[i], i)):
            words, slack = self.words[i], 2 + len(self.words[i]) // 5
            most = max(1, ALLOWED * len(words))
            for low, high in own[i]:
                lo, hi = max(0, low - slack), min(len(block), high + len(words) + slack)
                lacking, more, a, b = aligned(words, left[lo:hi])
                if b > a and len(lacking) <= most and len(more) <= most and None not in more and not any(TELLING.search(w) for w in (*lacking, *more)):
                    out.append((self.names[i], max(saved[i], 0) / plain, lacking, more, lo + a, lo + b))
                    left[lo + a : lo + b] = [None] * (b - a)
        return sorted(out, key=lambda x: x[4]) or [(None, max(0, *saved) / plain if plain and saved else 0.0, [], [], 0, len(block))]


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, block_no, license, saved, differences, surplus, begin, end) of every candidate block; license is null where
    none is confirmed. ``differences`` are missing words, ``surplus`` further ones; ``begin`` and ``end`` are character
    positions in the text. Identifiers of SPDX lines follow the blocks, as they are written, with nothing saved."""
    used = TEMPLATES if templates is None else templates
    rows = text_rows(docs, id_col=id_col, text_col=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(used)
        for piece in pieces(batches):
            at: list[int] = []
            found: list[tuple] = []
            for k, text in enumerate(piece.column("text").to_pylist()):
                own = [w.lower() for w in word.findall(text)]
                blocks = scanner.blocks(own)
                spans = [m.span() for m in word.finditer(text)] if blocks else []
                for no, (a, b) in enumerate(blocks):
                    for name, saved, lacking, more, first, end in scanner.of(tuple(own[a:b])):
                        at.append(k)
                        found.append((no, name, saved, lacking, more, spans[a + first][0], spans[a + end - 1][1]))
                for name, begin, end in tagged(text):
                    at.append(k)
                    found.append((len(blocks), name, 0.0, [], [], begin, end))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32())))],
                ["doc_id", "block_no", "license", "saved", "differences", "surplus", "begin", "end"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, block_no int, license string, saved double, differences array<string>, surplus array<string>, begin int, end int")
