import math
import re
from collections import Counter

import duckdb
import pytest

from corvid.llm.license_scan import REPORT_SQL, TEMPLATES, THRESHOLD, Templates, detect, document_paths, inherit, license_report, terms_of


def cosine(segment):
    """Dense cosine in Python: best (score, template number) of the templates whose marks are in the segment."""
    t = Templates.of(TEMPLATES, THRESHOLD)
    idf = dict(zip(t.vocabulary, t.idf, strict=True))
    c = Counter(terms_of(segment))
    x = {term: n * idf.get(term, t.unseen_idf) for term, n in c.items()}
    norm = math.sqrt(sum(v * v for v in x.values())) or 1.0
    spaced = f" {' '.join(terms_of(segment))} "
    marked = [all(re.search(p, spaced) for p in m.has) and not any(re.search(p, spaced) for p in m.lacks) for m in TEMPLATES]
    return max((sum(x.get(term, 0) * w for term, w in zip(t.vocabulary, v, strict=True)) / norm, -i) for i, v in enumerate(t.vectors) if marked[i])


LINES = ["released under the mit license", "Released under the MIT License.", "// Licensed under CC BY-NC 4.0", "all rights reserved (c) 2020", "a license to fish", "", "nothing at all", "GNU GENERAL PUBLIC LICENSE version 3", TEMPLATES[8].text]


def test_scores_equal_dense_cosine(spark):
    df = spark.createDataFrame([(i, f"d/{i}.c", x) for i, x in enumerate(LINES)] + [(90, "d/x", None), (91, None, LINES[1])], "doc_id long, path string, text string")
    got = {r.doc_id: r.own for r in detect(df).collect()}
    for i, line in enumerate(LINES):
        score, k = cosine(line)
        if score >= THRESHOLD:
            assert got[i].name == TEMPLATES[-k].name and got[i].score == pytest.approx(score, abs=1e-6)
        else:
            assert got[i].name is None
    assert got[90].name is None and got[91].name == "MIT"


def test_nearest_ancestor(spark):
    rows = [("a/LICENSE", "Licensed under CC BY 4.0."), ("a/b/COPYING.txt", "Released under the MIT License."), ("a/b/c/x.py", "code"), ("a/y.py", "code"), ("z.py", "code"), ("a/b/own.py", "# Licensed under the Apache License, Version 2.0."), ("ab/q.py", None), ("a/b/c/x.py", "code")]
    df = spark.createDataFrame([(i, p, t, "k") for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string, of_dir string")
    got = {r.doc_id: (r.license, r.via, r.from_dir) for r in inherit(detect(df)).collect()}
    assert got == {
        0: ("CC-BY-4.0", "file", None), 1: ("MIT", "file", None), 2: ("MIT", "inherited", "a/b"), 3: ("CC-BY-4.0", "inherited", "a"),
        4: (None, None, None), 5: ("Apache-2.0", "header", None), 6: (None, None, None), 7: ("MIT", "inherited", "a/b"),
    }
    assert license_report(df.limit(0)).count() == 0


def test_long_line_and_repeats(spark):
    df = spark.createDataFrame([(1, "a/LICENSE", "license " * 30_000), (1, "a/LICENSE", "license " * 30_000), (2, "a/f", " ".join(f"w{k}" for k in range(20_000)) + " license")], "doc_id long, path string, text string")
    assert [r.license for r in license_report(df).collect()].count(None) == 3


def test_sql_agrees(spark):
    texts = [f"word {i}\n{LINES[i // 2 % len(LINES)] if i % 4 < 2 else 'plain'}" for i in range(800)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = sorted((tuple(r) for r in license_report(document_paths(spark, docs)).collect()), key=str)
    documents = docs.toPandas()  # noqa: F841
    want = sorted((tuple(r) for r in duckdb.connect().sql(REPORT_SQL).fetchall()), key=str)
    assert got == want and {r[4] for r in got} >= {"header", "inherited"}


MIT_FILE = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL_HEADER = """/*
 * tool.c - does things
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */
int main(void) { return 0; }
"""
APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
BSD_FILE = """Copyright 2019 The Authors. All of them.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.
"""
GPL_TITLE = """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies.
"""


def test_published_texts_and_wrapped_headers(spark):
    cases = [
        ("LICENSE", MIT_FILE, "MIT"), ("src/tool.c", GPL_HEADER, "GPL-3.0-or-later"), ("a.py", APACHE_HEADER, "Apache-2.0"), ("COPYING", BSD_FILE, None),
        ("COPYING", GPL_TITLE, "GPL-3.0-only"), ("b.rs", "// SPDX-License-Identifier: MIT\nfn main() {}", "MIT"), ("c.rs", "// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
        ("d.rs", "// SPDX-License-Identifier: LicenseRef-Own", None), ("e.txt", "we walked mit the dog under free software", None), ("f.txt", "", None),
    ]
    files = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(cases)], "k int, path string, text string")
    got = {r.k: r.own.name for r in detect(files).collect()}
    assert got == {k: name for k, (_, _, name) in enumerate(cases)}


def _header(name, version, tail, program="program"):
    return f"""/* tool.c
 *
 * This {program} is free software; you can redistribute it and/or
 * modify it under the terms of the GNU {name}General Public
 * License as published by the Free Software Foundation; {version}
 * {tail}
 */
"""


CLAUSES = [t.text for t in TEMPLATES if t.name == "BSD-3-Clause"][1].split(" Redistributions ")
OPENING, COPY, BINARY = CLAUSES[0], f"1. Redistributions {CLAUSES[1]}", f"2. Redistributions {CLAUSES[2].split(' Neither ')[0]}"
NAMES = f"3. Neither {CLAUSES[2].split(' Neither ')[1]}".replace("copyright holder", "Some University")
LATER = "of the License, or (at your option) any later version."
NEIGHBOURS = [
    ("a.c", _header("Lesser ", "either\n * version 2.1", LATER, "library"), "LGPL-2.1-or-later"),
    ("a.c", _header("Lesser ", "either\n * version 3", LATER, "library"), "LGPL-3.0-or-later"),
    ("a.c", _header("Lesser ", "either\n * version 3", LATER, "program"), "LGPL-3.0-or-later"),
    ("a.c", _header("Library ", "either\n * version 2", LATER, "library"), "LGPL-2.0-or-later"),
    ("a.c", _header("", "version 2", "of the License."), "GPL-2.0-only"),
    ("a.c", _header("", "either\n * version 2", LATER), "GPL-2.0-or-later"),
    ("a.c", _header("", "version 3", "of the License."), "GPL-3.0-only"),
    ("a.c", _header("Affero ", "either\n * version 3", LATER), "AGPL-3.0-or-later"),
    ("a.c", _header("", "either\n * version 4", LATER), None),
    ("COPYING", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", "LGPL-3.0-only"),
    ("COPYING", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n", "LGPL-2.1-only"),
    ("COPYING", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n", "AGPL-3.0-only"),
    ("COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n", "GPL-2.0-only"),
    ("COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 1, February 1989\n", None),
    ("LICENSE", f"{OPENING}\n\n{COPY}\n\n{BINARY}\n", "BSD-2-Clause"),
    ("LICENSE", f"{OPENING}\n\n{COPY}\n\n{BINARY}\n\n{NAMES}\n", "BSD-3-Clause"),
    ("x.c", f"/*\n * {OPENING}\n * {COPY}\n * {BINARY}\n */", "BSD-2-Clause"),
    ("x.c", f"/*\n * {OPENING}\n */", None),
    ("b", "Licensed under CC BY 4.0.", "CC-BY-4.0"), ("b", "Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("b", "Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
    ("b", "Licensed under CC BY 3.0.", None), ("b", "Licensed under the Apache License, Version 1.1.", None), ("b", "Mozilla Public License Version 1.1", None),
    ("b", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0BSD"),
    ("b", "SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later"), ("b", "SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("b", "SPDX-License-Identifier: MIT-0", None),
]


def test_each_template_is_its_own_and_not_its_neighbour(spark):
    cases = [*[("x/LICENSE" if k % 2 else "x/y.c", t.text, t.name) for k, t in enumerate(TEMPLATES)], *NEIGHBOURS]
    files = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(cases)], "k int, path string, text string")
    got = {r.k: r.own.name for r in detect(files).collect()}
    assert {k: (cases[k][1], v) for k, v in got.items() if v != cases[k][2]} == {}


def test_sql_agrees_on_neighbours(spark):
    texts = [*[t.text for t in TEMPLATES], *[text for _, text, _ in NEIGHBOURS]]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts * 4)], "doc_id long, text string, lang string, source string")
    got = sorted((tuple(r) for r in license_report(document_paths(spark, docs)).collect()), key=str)
    documents = docs.toPandas()  # noqa: F841
    want = sorted((tuple(r) for r in duckdb.connect().sql(REPORT_SQL).fetchall()), key=str)
    assert got == want
