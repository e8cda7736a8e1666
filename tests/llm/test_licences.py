import math
import re

import pytest

from basalt.llm import licences
from basalt.llm.queries import QUERIES

APACHE = "Licensed under the Apache License, Version 2.0."
GPL3 = "This work is licensed under the GNU General Public License, version 3."
FILES = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/x.py", "code " * 60), (3, "a/b/y.py", None), (4, "a/b/c/z.py", "word " * 100 + "\n" + APACHE), (5, "a/b/c/w.py", ""),
    (6, "d/e.txt", GPL3), (7, "d/f/g.txt", "nothing here " * 30), (8, "h.txt", "text"), (9, None, APACHE), (10, "a/b/c/d/e.py", "x"), (11, "d/long.txt", "the public work of version general " * 50),
    (12, "k/COPYING.txt", GPL3.replace("3", "2")), (12, "k/COPYING.txt", GPL3.replace("3", "2")), (13, "k/l", "/* SPDX-License-Identifier: MPL-2.0 */\n" + "x " * 100000), (14, "a2/x", "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
]
WANT = {1: ("MIT", "own"), 2: ("MIT", "inherited"), 3: ("MIT", "inherited"), 4: ("Apache-2.0", "own"), 5: ("MIT", "inherited"), 6: ("GPL-3.0", "own"), 7: ("GPL-3.0", "inherited"), 8: (None, None), 9: ("Apache-2.0", "own"), 10: ("MIT", "inherited"), 11: ("GPL-3.0", "inherited"), 12: ("GPL-2.0", "own"), 13: ("MPL-2.0", "own"), 14: ("CC-BY-NC-4.0", "own")}


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(*f, "x") for f in FILES], "id long, path string, text string, licence string")


def test_cases(spark, files):
    got = licences.scan(files).collect()
    assert len(got) == len(FILES)
    assert {r.id: (r.licence, r.origin) for r in got} == WANT
    assert {r.id: r.licence_path for r in got if r.origin == "inherited"} == {2: "a", 3: "a", 5: "a", 7: "d", 10: "a", 11: "d"}


def brute(files):
    idf_n = len(files)
    vocab = licences.vocabulary()
    toks = [set(licences.tokens(t or "")) for _, _, t in files]
    idf = {w: 1 + math.log((1 + idf_n) / (1 + sum(w in t for t in toks))) for w in vocab}
    out = {}
    for i, path, text in files:
        best = None
        text = text or ""
        parts = re.split(r"\r\n|[\n\v\f\r\x85  ]", text)
        parts += [text] if len(re.findall(r"[^ \t\n\v\f\r]+", text)) <= licences.SHORT else []
        for p in parts:
            ws = licences.tokens(p)
            v = {w: ws.count(w) * idf.get(w, 1.0) for w in ws}
            for name, _, t, norm in licences._vectors(idf):
                n = math.sqrt(sum(x * x for x in v.values()))
                cos = round(sum(x * v.get(w, 0) for w, x in t.items()) / n / norm, 9) if n else 0
                if cos >= licences.THRESHOLD and (best is None or (-cos, name) < best):
                    best = (-cos, name)
        if best:
            out[i, path] = (best[1], -best[0])
    return out


def test_own_licences_match_brute_force(spark):
    docs = licences.documents_as_files(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(r.id, r.path, r.text) for r in docs.collect()]
    rows += [(-1, "q/r", APACHE.upper()), (-2, "q/s", "apache license version"), (-3, "q/t", "mit"), (-4, "q/u", "released under the MIT"), (-5, "q/v", "MIT License\n\nCopyright 2020 someone")]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    got = {(r.id, r.path): (r.licence, pytest.approx(r.cosine, abs=2e-9)) for r in licences.scan(df).collect() if r.origin == "own"}
    assert got == brute(rows)


def test_empty(spark):
    assert licences.scan(spark.createDataFrame([], "id long, path string, text string")).count() == 0


def test_query(spark):
    got = QUERIES["op10_licence_scan"](spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and got.columns[0] == "doc_id"


MIT_FILE = """The MIT License (MIT)

Copyright (c) 2019 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
GPL_HEADER = """# This file is part of Thing.
#
# Thing is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 2 of the License, or
# (at your option) any later version.
#
# Thing is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""


def test_real_licences_of_many_lines(spark):
    folder = licences.Path(licences.__file__).parent / "licence_texts"
    texts = {f.stem: f.read_text() for f in folder.glob("*.txt")}
    assert len(texts) == 10
    code = "def f(x):\n    return x + 1\n" * 200
    rows = [(i, f"{n}/LICENSE", "Copyright (c) 2020 Some Body\n\n" + t) for i, (n, t) in enumerate(sorted(texts.items()))]
    rows += [(100 + i, f"{n}/a/b.py", code) for i, n in enumerate(sorted(texts))]
    rows += [(200, "m/COPYING", MIT_FILE), (201, "m/x/y.py", code), (202, "s/g.py", GPL_HEADER + code), (203, "s/h.py", code), (204, "s/m.c", code + "/*\n" + MIT_FILE.replace("\n", "\n * ") + "*/\n" + code)]
    got = {r.id: (r.licence, r.origin) for r in licences.scan(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    want = {i: (n, "own") for i, n in enumerate(sorted(texts))} | {100 + i: (n, "inherited") for i, n in enumerate(sorted(texts))}
    assert got == want | {200: ("MIT", "own"), 201: ("MIT", "inherited"), 202: ("GPL-2.0", "own"), 203: (None, None), 204: ("MIT", "own")}
