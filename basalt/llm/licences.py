"""Licence scan [native]: sparse TF-IDF cosine to templates, and inheritance from the nearest directory.

A file declares a licence where one of its lines (a header) or, if it is short, all of it reaches a cosine of
`threshold` with a statement, or where a stretch of its words reaches it with a licence text or a header of several
lines: all of a licence-named file, at any length, and in every file the stretches of a text's length that share a
run of PHRASE words with it at its place, however its lines are wrapped. Vectors span the templates' words,
weighed by their document frequency over all files; other words of a line count with weight 1 in its
length. A file without a licence of its own inherits from the licence file in the nearest directory
above it, found by joining directory paths.

Everything is DataFrame functions. Null and empty texts declare nothing and inherit; a null path has no
directory, so it inherits nothing. Repeated rows (same path) give a row each. Ties go to the licence
first by name. An empty table gives an empty result. Columns besides id, path and text are not read.
"""
from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import stored

#: Statements by which texts declare a licence.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Released under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0"],
    "ISC": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
}
#: Headers of several lines. Licence texts lie in licence_texts/; of the CC BY licences there are statements only.
HEADERS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; {1} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
for _name, _kind, _v in (("GPL-2.0", "General Public License", 2), ("GPL-3.0", "General Public License", 3), ("LGPL-3.0", "Lesser General Public License", 3)):
    HEADERS[_name] = [_GNU.format(_kind, f"either version {_v} of the License, or (at your option) any later version."), _GNU.format(_kind, f"version {_v} of the License.")]
#: Words of a run that aligns a stretch with a licence text, and runs of each text, spread evenly over it.
PHRASE, RUNS = 4, 8
#: A file with none of these holds no licence text.
_LEGAL = r"(?i)licen[cs]e|permission|redistribut|warrant"
THRESHOLD = 0.75
#: A text of at most so many words is compared as a whole too, and may be a licence file.
SHORT = 40
_TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
LICENCE_NAME = r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$"


def tokens(text: str) -> list[str]:
    return re.findall(_TOKEN, text.lower())


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_TOKEN), F.lit(0))


def long_texts() -> list[tuple[str, list[str]]]:
    """(licence, words) of each licence text and header of several lines."""
    files = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
    return [(f.stem, tokens(f.read_text())) for f in files] + [(name, tokens(t)) for name, ts in sorted(HEADERS.items()) for t in ts]


def vocabulary() -> list[str]:
    return sorted({w for t in TEMPLATES.values() for s in t for w in tokens(s)})


def weights(files: DataFrame, more: set[str] = frozenset()) -> dict[str, float]:
    """Inverse document frequency of each template word, and each in more, over all files: a few thousand rows at most."""
    names = sorted({*vocabulary(), *more})
    there = files.select(F.explode(F.array_intersect(_tokens(F.col("text")), F.split(F.lit(" ".join(names)), " "))).alias("w"))
    n, df = files.count(), {r.w: r["count"] for r in there.groupBy("w").count().collect()}
    return {w: 1 + math.log((1 + n) / (1 + df.get(w, 0))) for w in names}


def _vectors(idf: dict[str, float]) -> list[tuple[str, int, dict[str, float], float]]:
    out = []
    for name, statements in sorted(TEMPLATES.items()):
        for k, s in enumerate(statements):
            v: dict[str, float] = {}
            for w in tokens(s):
                v[w] = v.get(w, 0) + idf[w]
            out.append((name, k, v, math.sqrt(sum(x * x for x in v.values()))))
    return out


def anchors(vectors, threshold: float) -> list[str]:
    """Words of which a line must hold one to reach the threshold: a line of a template's other words
    alone has a cosine of at most their share of the template's length."""
    out = set()
    for _, _, v, norm in vectors:
        light = 0.0
        for w, x in sorted(v.items(), key=lambda e: (e[1], e[0])):
            light += x * x
            if math.sqrt(light) >= threshold * norm * (1 - 1e-9):
                out.add(w)
    return sorted(out)


def _stretches(files: DataFrame, texts: list[tuple[str, list[str]]], idf: dict[str, float], threshold: float) -> DataFrame:
    """key, licence, cosine of the stretches of words that reach the threshold with a licence text. files may have a path."""
    spark = files.sparkSession
    named = F.coalesce(F.col("path").rlike(LICENCE_NAME), F.lit(False)) if "path" in files.columns else F.lit(False)
    read = stored(files.where(F.col("text").rlike(_LEGAL)).select("key", named.alias("named"), _tokens(F.col("text")).alias("t")).where("size(t) > 0"), "legal")
    runs = []
    for k, (_, ws) in enumerate(texts):
        for at in sorted({r * (len(ws) - PHRASE) // (RUNS - 1) for r in range(RUNS)}):
            runs.append((" ".join(ws[at : at + PHRASE]), k, at, len(ws)))
    phrases = spark.createDataFrame(runs, "phrase string, k int, at int, length int")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("t") - (PHRASE - 1), F.lit(1))), lambda p: F.array_join(F.slice("t", p, PHRASE), " "))
    found = read.select("key", F.size("t").alias("size"), F.posexplode(grams).alias("p", "phrase")).join(F.broadcast(phrases), "phrase")
    start = F.greatest(F.col("p") - F.col("at"), F.lit(0))
    cut = found.select("key", "k", start.alias("a"), F.least(F.col("p") - F.col("at") + F.col("length"), F.col("size")).alias("z")).distinct()
    of_texts = spark.createDataFrame([(k,) for k in range(len(texts))], "k int")
    whole = read.where("named").select("key", F.lit(0).alias("a"), F.size("t").alias("z")).crossJoin(F.broadcast(of_texts)).select("key", "k", "a", "z")
    parts = cut.unionByName(whole).distinct().groupBy("key", "a", "z").agg(F.collect_set("k").alias("ks"))
    words = parts.join(read, "key").select("key", "a", "z", "ks", F.explode(F.slice("t", F.col("a") + 1, F.col("z") - F.col("a"))).alias("w"))
    tf = words.groupBy("key", "a", "z", "w").agg(F.count(F.lit(1)).alias("tf"), F.first("ks").alias("ks"))
    known = spark.createDataFrame(sorted(idf.items()), "w string, idf double")
    x = stored(tf.join(F.broadcast(known), "w", "left").select("key", "a", "z", "ks", "w", (F.col("tf") * F.coalesce("idf", F.lit(1.0))).alias("x")), "stretches")
    norm = x.groupBy("key", "a", "z").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    rows = []
    for k, (name, ws) in enumerate(texts):
        v = {w: ws.count(w) * idf[w] for w in set(ws)}
        n = math.sqrt(sum(y * y for y in v.values()))
        rows += [(name, k, w, y / n) for w, y in sorted(v.items())]
    terms = spark.createDataFrame(rows, "licence string, k int, w string, y double")
    dots = x.join(F.broadcast(terms), "w").where(F.array_contains("ks", F.col("k"))).groupBy("key", "a", "z", "licence", "k").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    return dots.join(norm, ["key", "a", "z"]).select("key", "licence", F.least(F.round(F.col("dot") / F.col("norm"), 9), F.lit(1.0)).alias("cosine")).where(F.col("cosine") >= threshold)


def declared(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key, licence, cosine: the best template of each file with one at the threshold."""
    texts = long_texts()
    every = weights(files, {w for _, ws in texts for w in ws})
    idf = {w: every[w] for w in vocabulary()}
    vectors = _vectors(idf)
    spark = files.sparkSession
    wanted = rf"(?i)(?<![a-z0-9])(?:{'|'.join(re.escape(a) for a in anchors(vectors, threshold))})(?![a-z0-9])"
    some = files.where(F.col("text").rlike(wanted)).select("key", "text")
    whole = F.when(F.regexp_count("text", F.lit(r"\S+")) <= SHORT, F.array("text")).otherwise(F.array().cast("array<string>"))
    lines = some.select("key", F.posexplode(F.concat(F.filter(F.split("text", r"\R"), lambda s: s.rlike(wanted)), whole)).alias("line", "s"))
    words = lines.select("key", "line", F.explode(_tokens(F.col("s"))).alias("w")).groupBy("key", "line", "w").agg(F.count(F.lit(1)).alias("tf"))
    known = spark.createDataFrame(sorted(idf.items()), "w string, idf double")  # a few hundred words
    weighed = words.join(F.broadcast(known), "w", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    norm = weighed.groupBy("key", "line").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    terms = spark.createDataFrame([(name, k, w, x / n) for name, k, v, n in vectors for w, x in v.items()], "licence string, k int, w string, y double")
    dots = weighed.join(F.broadcast(terms), "w").groupBy("key", "line", "licence", "k").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    scored = dots.join(norm, ["key", "line"]).select("key", "licence", F.least(F.round(F.col("dot") / F.col("norm"), 9), F.lit(1.0)).alias("cosine")).where(F.col("cosine") >= threshold)
    scored = scored.unionByName(_stretches(files, texts, every, threshold))
    best = F.min(F.struct((-F.col("cosine")).alias("c"), F.col("licence").alias("l")))
    return scored.groupBy("key").agg(best.alias("b")).select("key", F.col("b.l").alias("licence"), (-F.col("b.c")).alias("cosine"))


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """files(id, path, text): id, path, licence, cosine, origin ('own', 'inherited' or null) and licence_path, the
    directory that an inherited licence comes from."""
    keyed = stored(files.select("id", "path", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.xxhash64("id", "path").alias("key")), "files")
    own = stored(declared(keyed, threshold), "declared")
    slim = keyed.select("id", "path", "key", (F.regexp_count("text", F.lit(r"\S+")) <= SHORT).alias("short"), _directory(F.col("path")).alias("dir"))
    found = slim.join(own, "key", "left")
    is_file = F.col("licence").isNotNull() & F.col("dir").isNotNull() & (F.col("short") | F.col("path").rlike(LICENCE_NAME))
    best = F.min(F.struct((~F.col("path").rlike(LICENCE_NAME)).alias("a"), (-F.col("cosine")).alias("b"), F.col("path").alias("c"), F.col("licence").alias("licence")))
    of_dir = found.where(is_file).groupBy("dir").agg(best.alias("best")).select(F.col("dir").alias("above"), F.col("best.licence").alias("dir_licence"))
    dirs = slim.where(F.col("dir").isNotNull()).select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))).alias("u")).select("dir", "u.*")
    last = Window.partitionBy("dir").orderBy(F.col("depth").desc())
    nearest = ups.join(of_dir, "above").withColumn("r", F.row_number().over(last)).where("r = 1").select("dir", "above", "dir_licence")
    out = found.join(nearest, "dir", "left")
    mine, theirs = F.col("licence").isNotNull(), F.col("dir_licence").isNotNull()
    return out.select("id", "path", F.coalesce("licence", "dir_licence").alias("licence"), "cosine", F.when(mine, "own").when(theirs, "inherited").alias("origin"), F.when(~mine, F.col("above")).alias("licence_path"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of their source: the path is source/lang/doc_id.txt."""
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("unknown")), F.coalesce(F.col("lang"), F.lit("unknown")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), path.alias("path"), "text")
