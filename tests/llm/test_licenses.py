"""Recall of the license scan on the wordings that files use, and on the license lines of the test table."""

import os
import re

import pytest

from gridloom.llm import licenses, queries

SMALL = "/root/testdata/sf0.01"
LINES = {
    "All rights reserved.": "Proprietary",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
    "SPDX-License-Identifier: CC-BY-NC-SA-4.0": "CC-BY-NC-SA-4.0",
    "SPDX-License-Identifier: EUPL-1.2": None,
    "SPDX-License-Identifier: Zlib": None,
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
}


def test_common_wordings(spark):
    lines = [*LINES.items()]
    df = spark.createDataFrame([(i, f"d{i}/x", f"some words\n{line}\nmore words") for i, (line, _) in enumerate(lines)], "doc_id long, path string, text string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(df).collect()}
    assert {lines[i][0]: name for i, name in got.items()} == LINES


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_every_license_line_of_the_table_is_found(spark):
    """The table's license lines are found by plain search; the query must name each document's own."""
    wanted = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        named = {LINES[line.strip()] for line in (r.text or "").splitlines() if line.strip() in LINES}
        assert bool(named) == bool(re.search(r"(?i)licen[sc]e|rights reserved", r.text or ""))
        if named:
            wanted[r.doc_id] = named
    got = {r.doc_id: r.license for r in queries.op4_licenses(spark, SMALL).where("origin = 'own'").select("doc_id", "license").collect()}
    assert len(wanted) > 40 and set(got) == set(wanted)
    assert all(got[d] in names for d, names in wanted.items())


def test_statement_within_other_words(spark):
    filler = "foo bar baz qux " * 40
    texts = [f"{filler}Released under the MIT License. {filler}", "Copyright 2020 Foo. Released under the MIT License. See the LICENSE file for the details of it.", f"/* Licensed under the Apache\n * License, Version 2.0.\n */ {filler}", "Copyright 2020 Foo. All rights reserved.\nLicensed under CC BY 4.0.", "Mit.", "It and.", f"mit der {filler} license", filler]
    df = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = [r.license for r in licenses.scan_licenses(df).orderBy("doc_id").collect()]
    assert got == ["MIT", "MIT", "Apache-2.0", "CC-BY-4.0", None, None, None, None]


def test_full_texts_pass_on_their_license(spark):
    texts = {name: text for name, (text,) in licenses.full_texts().items()}
    assert {"MIT", "AGPL-3.0", "GPL-3.0", "Apache-2.0", "BSD-3-Clause"} <= set(texts)
    files = [(name, text.replace("<copyright holders>", "Jane Doe and many others").replace("<year>", "2021")) for name, text in texts.items()]
    files += [("MIT", "Part one is ours, by this license, which we like.\n\n" + texts["MIT"] + "\n\nPart two is under this one.\n\n" + texts["BSD-2-Clause"]), ("CC-BY-NC-4.0", texts["CC-BY-SA-4.0"].replace("ShareAlike", "NonCommercial"))]
    rows = [(2 * i, f"p{i}/LICENSE", text) for i, (_, text) in enumerate(files)] + [(2 * i + 1, f"p{i}/src/code", "x = 1") for i in range(len(files))]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    two = len(files) - 2
    for i, (name, _) in enumerate(files):
        allowed = {"MIT", "BSD-2-Clause", "BSD-3-Clause"} if i == two else {name}
        own, below = got[2 * i], got[2 * i + 1]
        assert own.license in allowed and own.license_file and own.origin == "own", (name, own)
        assert (below.license, below.origin, below.inherited_from) == (own.license, "inherited", f"p{i}/LICENSE")
