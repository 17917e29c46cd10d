"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Segments of a file are its lines, its paragraphs (runs of lines with a letter or digit, so comment marks do not
matter and a wrapped header is one segment) and, in a file named like a licence, the whole text. Segments are
compared with the templates by the cosine of TF-IDF vectors; terms are ASCII letters and digits in
lower case, the inverse document frequency comes from the templates, and a term that no template has
weighs most; stop words weigh nothing. The best template at or above ``threshold`` whose marks are in the segment is the file's
own licence: cosine hardly sees one number or word, so the versions, the families and the clauses that tell a template from its
neighbours are patterns that a segment must have or must not have. An opening that licences share, alone, decides nothing.
A file without a licence takes that of the licence file in its nearest ancestor directory. Long licences are known by
their title, notice and grant, as they stand in every copy.

Only segments with an anchor term are scored. Anchors are, per template, terms (function words and terms of
one or two characters last, else the heaviest) without which the rest of the vector is shorter than the threshold, so by Cauchy-Schwarz no segment without
an anchor can reach it. A text is cut into terms once, and only one with an anchor is cut into segments. Detection needs
no shuffle; inheritance joins distinct directories, not
files, to licensed directories over path prefixes. All of it is DataFrame functions.

Defined results: null texts and paths detect and inherit nothing (a null path can still have a
header of its own); ties go to the template first in order, and among licence files of a directory to
the higher score, then the smaller path; repeated rows get equal results; other columns are carried.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import free_column, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def terms_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER)))


THRESHOLD = 0.75
LICENSE_NAME = r"(?i)^(licen[sc]e|copying|notice|unlicense)([._-].*)?$"

_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without '
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:"
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_INCLUDED = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
    "http://www.apache.org/licenses/LICENSE-2.0"
)
_APACHE_REST = (
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
    "express or implied. See the License for the specific language governing permissions and limitations under the License."
)


_COPY = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
_HOLDERS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


class Template(NamedTuple):
    """A licence's name, a text that stands for it, and what a segment must have and must not have.

    ``has`` and ``lacks`` are patterns over a segment's terms, with a space around each.
    """

    name: str
    text: str
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()


def _gnu(license: str, family: str, version: str, titles: list[str], program: str = "program") -> list[Template]:
    """Titles and grants of a GNU licence, the version alone and with later ones."""
    number = " ".join(terms_of(version))
    others = [f" {x} general public " for x in ("lesser", "library", "affero") if x != family.lower()]
    named = f" {family.lower()} general public license " if family else " general public license "
    has, lacks = (named, f" version {number} "), (*others, *([f" version {number} [0-9] "] if " " not in number else []))
    name = " ".join(["GNU", *([family] if family else []), "General Public License"])
    grant = f"This {program} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation"
    return [
        *[Template(f"{license}-only", text, has, (*lacks, " later version ")) for text in (*titles, f"Licensed under the {name}, version {version}.", f"This work is licensed under the {name}, version {version}.")],
        Template(f"{license}-only", f"{grant}; version {version} of the License.", has, (*lacks, " later version ")),
        Template(f"{license}-or-later", f"{grant}, either version {version} of the License, or (at your option) any later version.", (*has, " later version "), lacks),
    ]


def _creative(kind: str, words: str) -> list[Template]:
    """Short and long notices of a Creative Commons licence of version 4.0; ``kind`` and ``words`` tell what it restricts."""
    marks = {"nc": "noncommercial|non commercial", "sa": "sharealike|share alike", "nd": "noderivatives|noderivs|no derivatives"}
    own = terms_of(kind)
    has = tuple(f" (?:{m}|{long}) " for m, long in marks.items() if m in own)
    lacks = tuple(f" (?:{m}|{long}) " for m, long in marks.items() if m not in own)
    return [
        Template(f"CC-BY{kind}-4.0", f"Licensed under CC BY{kind} 4.0.", (" cc by ", " 4 0 ", *has), lacks),
        Template(f"CC-BY{kind}-4.0", f"Licensed under the Creative Commons Attribution{words} 4.0 International License.", (" creative commons attribution ", " 4 0 ", *has), lacks),
    ]


#: Identifiers that stand in SPDX tags.
SPDX = [
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
]
_TWO, _CLAUSES = (" 2 0 ",), (" neither the names? of ", " nor the names ", " endorse or promote ", " advertising materials ")

#: Titles, notices and grants that stand for licences, several for one licence where wordings differ.
TEMPLATES: list[Template] = [
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", _TWO),
    Template("Apache-2.0", _APACHE, _TWO),
    Template("Apache-2.0", f"{_APACHE} {_APACHE_REST}", _TWO),
    Template("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", _TWO),
    Template("MIT", "Released under the MIT License.", (" mit ",), (" mit 0 ", " no attribution ")),
    Template("MIT", _MIT, (" subject to the following ",)),
    Template("MIT", f"{_MIT} {_INCLUDED} {_AS_IS}", (" subject to the following ",)),
    Template("MIT-0", _MIT.replace(", subject to the following conditions:", "."), (), (" subject to the following ",)),
    Template("MIT-0", f"{_MIT.replace(', subject to the following conditions:', '.')} {_AS_IS}", (), (" subject to the following ",)),
    *_gnu("GPL-3.0", "", "3", ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]),
    *_gnu("GPL-2.0", "", "2", ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"]),
    *_gnu("LGPL-3.0", "Lesser", "3", ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"], "library"),
    *_gnu("LGPL-2.1", "Lesser", "2.1", ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"], "library"),
    *_gnu("LGPL-2.0", "Library", "2", ["GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991"], "library"),
    *_gnu("AGPL-3.0", "Affero", "3", ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"]),
    Template("BSD-2-Clause", f"{_BSD} {_COPY} {_BINARY}", (" binary form must reproduce ",), _CLAUSES),
    Template("BSD-2-Clause", f"{_BSD} {_COPY} {_BINARY} {_HOLDERS}", (" binary form must reproduce ",), _CLAUSES),
    Template("BSD-2-Clause", "Licensed under the 2-Clause BSD License.", (" 2 clause ",)),
    Template("BSD-4-Clause", _ADVERTISING, (" advertising materials ",)),
    Template("BSD-4-Clause", f"{_BSD} {_COPY} {_BINARY} {_ADVERTISING} {_NAMES}", (" advertising materials ",)),
    Template("BSD-4-Clause", f"{_BSD} {_COPY} {_BINARY} {_ADVERTISING} {_NAMES} {_HOLDERS}", (" advertising materials ",)),
    Template("BSD-3-Clause", _NAMES, (" endorse or promote ",), (" advertising materials ",)),
    Template("BSD-3-Clause", f"{_BSD} {_COPY} {_BINARY} {_NAMES}", (" endorse or promote ",), (" advertising materials ",)),
    Template("BSD-3-Clause", f"{_BSD} {_COPY} {_BINARY} {_NAMES} {_HOLDERS}", (" endorse or promote ",), (" advertising materials ",)),
    Template("BSD-3-Clause", "Licensed under the 3-Clause BSD License.", (" 3 clause ",)),
    Template("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", (" provided that the above ",)),
    Template("0BSD", f"{_ISC}.", (" hereby granted ",), (" provided that the above ",)),
    Template("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    Template("MPL-2.0", f"{_MPL} If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", _TWO),
    Template("MPL-2.0", _MPL, _TWO),
    Template("MPL-2.0", "Mozilla Public License Version 2.0", _TWO),
    *_creative("-NC", "-NonCommercial"),
    *_creative("", ""),
    *_creative("-SA", "-ShareAlike"),
    *_creative("-ND", "-NoDerivatives"),
    *_creative("-NC-SA", "-NonCommercial-ShareAlike"),
    *_creative("-NC-ND", "-NonCommercial-NoDerivatives"),
    Template("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights; CC0 1.0 public domain dedication."),
    Template("Unlicense", "This is free and unencumbered software released into the public domain."),
    Template("all-rights-reserved", "All rights reserved."),
    *[Template(name, f"SPDX-License-Identifier: {name}", (f" identifier {' '.join(terms_of(name))} ",), (" mit 0 ", " clause (?:clear|patent) ")) for name in SPDX],
]
#: Words that anchor a template only where its other words do not suffice, as they stand in any prose, of other languages too.
FUNCTION_WORDS = set(
    "mit a all an and any are as at be by for from has have in into is it may not of on or that the this to under with you 0 1 2 3 4 was were been do does done no nor only one if other others so see your out can its but either neither name names free general work use used person persons file files form forms kind law met could would should shall whom whether without including included following above action anyone author "
    "authors basis below case change claim code copy copies deal event extent fee issue later language limited made make more most obtain option part place portions possible prior program provided public publish published purpose required same sell several some source specific subject such terms than their them then there these they those time upon us user version way we what when where which while who will within writing "
    "advised business caused contract data developed direct display even features list products related restriction restrictions".split()
)
#: Words without weight on either side.
STOP_WORDS = sorted(
    "a all an and any are as at be been but by can do for from has have in into is it its no nor not of on or other so than that the their them then there these they this those to under was were "
    "what when where which while who will with within without would you your".split()
)

@dataclass
class Templates:
    """Unit TF-IDF vectors of the templates over their common vocabulary."""

    names: list[str]
    vocabulary: list[str]
    idf: list[float]
    unseen_idf: float
    vectors: list[list[float]]
    anchors: list[str]
    marks: list[list[tuple[str, bool]]]

    @staticmethod
    def of(templates: list[Template], threshold: float) -> Templates:
        counts = [Counter(terms_of(t.text)) for t in templates]
        vocabulary = sorted(set().union(STOP_WORDS, *counts))
        n = len(templates)
        idf = {t: 0.0 if t in STOP_WORDS else round(math.log((1 + n) / (1 + sum(t in c for c in counts))) + 1, 9) for t in vocabulary}
        vectors, anchors = [], set()
        for c in counts:
            raw = {t: c[t] * idf[t] for t in c}
            norm = math.sqrt(sum(x * x for x in raw.values()))
            unit = {t: round(x / norm, 9) for t, x in raw.items()}
            vectors.append([unit.get(t, 0.0) for t in vocabulary])
            rest = 1.0
            for t in sorted(unit, key=lambda t: (t in FUNCTION_WORDS or len(t) < 3, -unit[t], t)):
                if math.sqrt(max(rest, 0)) < threshold - 1e-6:
                    break
                anchors.add(t)
                rest -= unit[t] ** 2
        marks = [[*[(p, True) for p in t.has], *[(p, False) for p in t.lacks]] for t in templates]
        return Templates([t.name for t in templates], vocabulary, [idf[t] for t in vocabulary], round(math.log(1 + n) + 1, 9), vectors, sorted(anchors), marks)


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-z0-9]+"), F.lit(0))


#: Between paragraphs: at least one line without a letter or digit.
_BETWEEN = r"\n(?:[^A-Za-z0-9\n]*\n)+"


def _best(terms: Column, t: Templates, threshold: float) -> Column:
    """Struct of the best score (6 decimals) at or above the threshold and the negated number of its template, from a segment's terms.

    Only templates whose marks are in the segment count. Null where no score can reach the threshold: a score is at most the share of the known terms in the segment's
    length, and each distinct unknown term adds its weight to the rest at least once. So prose costs two set operations.
    """
    weighty = [(k, v, w) for k, (v, w) in enumerate(zip(t.vocabulary, t.idf, strict=True)) if w]
    vocabulary = _literal([{"term": v, "idf": w, "at": k} for k, v, w in weighty], "array<struct<term:string,idf:double,at:int>>")
    rows = [{"i": -i, "w": v, "marks": [{"pattern": p, "wanted": w} for p, w in m]} for i, (v, m) in enumerate(zip(t.vectors, t.marks, strict=True))]
    vectors = _literal(rows, "array<struct<i:int,w:array<double>,marks:array<struct<pattern:string,wanted:boolean>>>>")
    spaced = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
    known = _literal(t.vocabulary, "array<string>")
    zero, heavy = F.lit(0.0), t.unseen_idf**2

    def unseen_of(others: Column) -> Column:
        start = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), zero.alias("total"))

        def count(acc: Column, x: Column) -> Column:
            run = F.when(acc["last"] == x, acc["run"] + 1.0).otherwise(F.lit(1.0))
            return F.struct(x.alias("last"), run.alias("run"), (acc["total"] + 2.0 * run - 1.0).alias("total"))

        return F.aggregate(others, start, count, lambda acc: acc["total"]) * heavy

    def with_weights(w: Column) -> Column:
        def with_length(own: Column) -> Column:
            others = F.array_sort(F.filter(terms, lambda x: ~F.array_contains(known, x)))
            norm = F.nullif(F.sqrt(own + unseen_of(others)), zero)
            scored = F.transform(
                vectors,
                lambda v: F.struct(F.round(F.aggregate(w, zero, lambda acc, p: acc + p["x"] * F.get(v["w"], p["at"])) / norm, 6).alias("score"), v["i"].alias("i"), v["marks"].alias("marks")),
            )
            near = F.filter(scored, lambda x: x["score"] >= threshold)
            marked = F.filter(near, lambda x: F.forall(x["marks"], lambda m: F.rlike(spaced, m["pattern"]) == m["wanted"]))
            best = F.array_max(F.transform(marked, lambda x: F.struct(x["score"].alias("score"), x["i"].alias("i"))))
            least = own + F.size(F.array_except(terms, known)) * heavy
            return F.when((own > 0) & (own * (1 + 1e-6) >= threshold**2 * least * (1 - 1e-6)), best)

        return _let(F.aggregate(w, zero, lambda acc, p: acc + p["x"] * p["x"]), with_length)

    def with_held(held: Column) -> Column:
        present = F.filter(vocabulary, lambda v: F.array_contains(held, v["term"]))
        return _let(F.transform(present, lambda v: F.struct(v["at"].alias("at"), (F.size(F.filter(terms, lambda x: x == v["term"])) * v["idf"]).alias("x"))), with_weights)

    return _let(F.array_intersect(terms, known), with_held)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """Path without its last name; empty for a name at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def detect(files: DataFrame, *, text: str = "text", path: str = "path", templates: list[Template] = TEMPLATES, threshold: float = THRESHOLD, out: str = "own") -> DataFrame:
    """``files`` with the struct ``out``: name, score and whether the file is a licence file; null name if none."""
    t = Templates.of(templates, threshold)
    anchors = _literal(t.anchors, "array<string>")
    is_file = F.coalesce(file_name(F.col(path)).rlike(LICENSE_NAME), F.lit(False))
    anchored = lambda pieces: F.filter(F.transform(pieces, _terms), lambda x: F.arrays_overlap(x, anchors))
    # a paragraph of one line is that line
    several = F.filter(F.split(F.col(text), _BETWEEN), lambda p: F.contains(p, F.lit("\n")))
    lines, paragraphs = anchored(F.split(F.col(text), "\n")), anchored(several)
    whole = F.when(is_file, F.array(_terms(F.col(text)))).otherwise(F.array().cast("array<array<string>>"))
    segments = F.concat(lines, paragraphs, whole)
    best = F.when(F.arrays_overlap(_terms(F.col(text)), anchors), F.array_max(F.transform(segments, lambda s: _best(s, t, threshold))))
    hit = free_column(files, "hit")
    found = F.col(hit)["score"] >= threshold
    name = F.get(_literal(t.names, "array<string>"), -F.col(hit)["i"])
    own = F.struct(F.when(found, name).alias("name"), F.when(found, F.col(hit)["score"]).alias("score"), is_file.alias("is_file"))
    return files.withColumn(hit, best).withColumn(out, own).drop(hit)


def inherit(files: DataFrame, *, path: str = "path", own: str = "own") -> DataFrame:
    """``files`` with ``license``, ``score``, ``via`` (file, header, inherited or null) and ``from_dir``."""
    place = directory(F.col(path))
    licensed = (
        files.where(F.col(own)["is_file"] & F.col(own)["name"].isNotNull())
        .groupBy(place.alias("dir"))
        .agg(F.min_by(F.struct(F.col(own)["name"].alias("name"), F.col(own)["score"].alias("score")), F.struct(-F.col(own)["score"], F.col(path))).alias("given"))
    )
    needy = files.where(F.col(own)["name"].isNull() & F.col(path).isNotNull()).select(place.alias("of")).distinct()
    names = F.filter(F.split("of", "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(names, F.lit(1), n), "/").alias("dir")))
    rooted = licensed.withColumn("dir", F.regexp_replace("dir", "^/+", ""))
    nearest = (
        needy.select("of", F.explode(prefixes).alias("p"))
        .select("of", "p.depth", "p.dir")
        .join(rooted, "dir")
        .groupBy("of")
        .agg(F.max_by(F.struct("dir", "given"), "depth").alias("near"))
    )
    at, near = free_column(files, "of_dir"), free_column(files, "near")
    joined = files.join(nearest.select(F.col("of").alias(at), F.col("near").alias(near)), place == F.col(at), "left")
    has, given = F.col(own)["name"].isNotNull(), F.col(near)["given"]
    taken = ~has & F.col(near).isNotNull()
    return joined.select(
        *[F.col(c) for c in files.columns],
        F.coalesce(F.col(own)["name"], F.when(taken, given["name"])).alias("license"),
        F.when(has, F.col(own)["score"]).when(taken, given["score"]).alias("score"),
        F.when(has & F.col(own)["is_file"], "file").when(has, "header").when(taken, "inherited").alias("via"),
        F.when(taken, F.col(near)["dir"]).alias("from_dir"),
    )


def document_paths(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Lays documents out as files: ``source/lang/<1 hex>/<doc_id>.txt``; an id's MD5 puts one in 32 as a
    licence file of its directory and one in 32 as one of the directory above."""
    digest = F.md5(F.col("doc_id").cast("string"))
    pick, top = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 32, F.concat_ws("/", "source", "lang")
    deep = F.concat_ws("/", "source", "lang", F.substring(digest, 3, 1))
    name = F.when(pick < 2, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.withColumn("path", F.concat(F.when(pick == 0, top).otherwise(deep), F.lit("/"), name))


def license_report(files: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """Licence of every file: own, or inherited."""
    # three branches of the inheritance read the detections, so these are made once
    found = materialise(detect(files, **options).select(key, "path", "own"), "licenses")
    return inherit(found).select(key, "path", "license", "score", "via", "from_dir")


def _report_sql() -> str:
    """The same from the templates' texts: SQL makes the terms, frequencies and vectors itself, and scores every segment."""
    quoted = ", ".join("({}, '{}', '{}')".format(i, t.name, t.text.replace("'", "''")) for i, t in enumerate(TEMPLATES))
    marks = ", ".join(f"({i}, '{p}', {w})" for i, t in enumerate(TEMPLATES) for w, patterns in ((True, t.has), (False, t.lacks)) for p in patterns)
    stops = ", ".join(f"('{t}')" for t in STOP_WORDS)
    cut = f"regexp_extract_all(translate({{0}}, '{_UPPER}', '{_LOWER}'), '[a-z0-9]+')"
    return f"""
WITH templates(i, name, body) AS (VALUES {quoted}),
tt AS (SELECT i, name, term, count(*) AS n FROM (SELECT i, name, unnest({cut.format('body')}) AS term FROM templates) GROUP BY ALL),
stop(term) AS (VALUES {stops}),
marks(i, pattern, wanted) AS (VALUES {marks}),
idf AS (SELECT term, CASE WHEN term IN (FROM stop) THEN 0 ELSE round(ln((1 + (SELECT count(*) FROM templates))::DOUBLE / (1 + count(i))) + 1, 9) END AS w FROM (SELECT i, term FROM tt UNION ALL SELECT NULL, term FROM stop) GROUP BY term),
unseen AS (SELECT round(ln(1 + count(*)) + 1, 9) AS w FROM templates),
lengths AS (SELECT i, sqrt(sum(n * w * n * w)) AS norm FROM tt JOIN idf USING (term) GROUP BY i),
vectors AS (SELECT i, name, term, round(n * w / norm, 9) AS w FROM tt JOIN idf USING (term) JOIN lengths USING (i)),
marked AS (
  SELECT row_number() OVER () AS row_id, doc_id, source, lang, text, md5(doc_id::VARCHAR) AS digest,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 2))::INT % 32 AS pick FROM documents
),
files AS (
  SELECT row_id, doc_id, text, pick < 2 AS is_file,
         concat_ws('/', source, lang, CASE WHEN pick <> 0 THEN substr(digest, 3, 1) END) AS dir,
         CASE WHEN pick < 2 THEN 'LICENSE.' || doc_id ELSE doc_id || '.txt' END AS name FROM marked
),
segments AS MATERIALIZED (
  SELECT row_id, row_number() OVER () AS seg, body FROM (
    SELECT row_id, unnest(string_split(text, chr(10))) AS body FROM files
    UNION ALL SELECT row_id, unnest(regexp_split_to_array(text, '\\n(?:[^A-Za-z0-9\\n]*\\n)+')) FROM files
    UNION ALL SELECT row_id, text FROM files WHERE is_file)
),
tf AS (
  SELECT row_id, seg, term, count(*) AS n
  FROM (SELECT row_id, seg, unnest({cut.format('body')}) AS term FROM segments)
  GROUP BY ALL
),
weighted AS (SELECT tf.*, n * coalesce(idf.w, unseen.w) AS x FROM tf CROSS JOIN unseen LEFT JOIN idf USING (term)),
norms AS (SELECT seg, sqrt(sum(x * x)) AS norm FROM weighted GROUP BY seg),
scored AS (
  SELECT row_id, seg, round(sum(x * v.w) / nullif(any_value(norm), 0), 6) AS score, v.i, any_value(v.name) AS name
  FROM weighted JOIN vectors v USING (term) JOIN norms USING (seg) GROUP BY row_id, seg, v.i HAVING score >= {THRESHOLD}
),
spaced AS (SELECT seg, ' ' || array_to_string({cut.format('body')}, ' ') || ' ' AS line FROM segments SEMI JOIN scored USING (seg)),
unmarked AS (SELECT DISTINCT seg, i FROM scored JOIN spaced USING (seg) JOIN marks USING (i) WHERE regexp_matches(line, pattern) <> wanted),
own AS (
  SELECT row_id, score, name FROM scored ANTI JOIN unmarked USING (seg, i)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY score DESC, i) = 1
),
judged AS (SELECT f.*, o.name AS license, o.score FROM files f LEFT JOIN own o USING (row_id)),
licensed AS (
  SELECT dir, license, score FROM judged WHERE is_file AND license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, name) = 1
),
nearest AS (
  SELECT j.row_id, l.dir, l.license, l.score FROM judged j JOIN licensed l
    ON j.license IS NULL AND (j.dir = l.dir OR starts_with(j.dir, l.dir || '/'))
  QUALIFY row_number() OVER (PARTITION BY j.row_id ORDER BY length(l.dir) DESC) = 1
)
SELECT doc_id, j.dir || '/' || j.name AS path, coalesce(j.license, n.license) AS license, coalesce(j.score, n.score) AS score,
       CASE WHEN j.license IS NOT NULL AND is_file THEN 'file' WHEN j.license IS NOT NULL THEN 'header'
            WHEN n.license IS NOT NULL THEN 'inherited' END AS via,
       n.dir AS from_dir
FROM judged j LEFT JOIN nearest n USING (row_id)
"""


#: DuckDB SQL for ``license_report(document_paths(documents))``.
REPORT_SQL = _report_sql()
