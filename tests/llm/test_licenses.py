"""Names, repeats and surplus words of license texts: precision as well as recall."""

import textwrap

import pytest

from grovelight.llm import license_scan as L
from tests.llm.test_operators import table


def names(spark, texts):
    got = L.scan_licenses(table(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    out = {i: [] for i in range(len(texts))}
    for r in sorted(got, key=lambda r: (r.doc_id, r.block_no, r.begin)):
        out[r.doc_id].append(r.license)
    return out


def test_identifiers_and_repeats(spark):
    bsd4 = L.TEMPLATES["BSD-4-Clause"][0]
    cases = [
        ("SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"]),
        ("// SPDX-License-Identifier: EPL-2.0\n", ["EPL-2.0"]),
        ("SPDX-License-Identifier: LGPL-2.0", ["LGPL-2.0"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0) AND MIT", ["GPL-2.0-or-later", "MIT"]),
        ("Released under the MIT License. " * 2, ["MIT"] * 2),
        ("Released under the MIT License.\n" * 800, ["MIT"] * 800),
        ("/*\n * " + "\n * ".join(textwrap.wrap(bsd4, 60)), ["BSD-4-Clause"]),
        (L.TEMPLATES["GPL-2.0-only"][0], ["GPL-2.0-only"]),
        (L.TEMPLATES["GPL-2.0-or-later"][0], ["GPL-2.0-or-later"]),
        ("Licensed under CC BY-NC-ND 4.0.", [None]),
        ("Released under the MIT License. Licensed under CC BY 4.0.", ["MIT", "CC-BY-4.0"]),
    ]
    got = names(spark, [t for t, _ in cases])
    for i, (text, want) in enumerate(cases):
        assert got[i] == want, text[:60]


def test_every_template_is_itself(spark):
    own = [(name, t) for name, ts in L.TEMPLATES.items() for t in ts]
    got = names(spark, [t for _, t in own])
    assert [got[i] for i in range(len(own))] == [[name] for name, _ in own]


def test_spans_and_surplus(spark):
    text = "First. Released under the very MIT License. Last."
    r = L.scan_licenses(table(spark, [(1, text, None, None)])).first()
    assert (r.license, r.differences, r.surplus, text[r.begin : r.end]) == ("MIT", [], ["very"], "Released under the very MIT License")


@pytest.mark.parametrize("text", ["the license of the software", "permission is hereby granted to nobody", "", "released under the"])
def test_no_wording_no_name(spark, text):
    assert set(names(spark, [text])[0]) <= {None}
