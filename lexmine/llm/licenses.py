"""License scan: MinHash bands over overlapping windows of words retrieve templates, shingle containment decides."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmine.operators.cleaning import once

WORDS = 5
LEAST = 0.8
# Long words that texts of any kind have; they make poor anchors.
_COMMON = {"without", "through", "between", "because", "another", "limitation"}
# The chance that the bands miss a window that holds a match.
MISSED = 1e-4

# Notices and opening passages of public licences, as their authors word them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

_GNU = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public "
        "License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
_VERSIONS = [
    ("GPL-2.0", "", "2"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"),
]
_CC = "This work is licensed under a Creative Commons {} International License."
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and "
        "the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. ")
_BSD_NAME = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
             "derived from this software without specific prior written permission. ")
_BSD_END = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
            "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
            "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
            "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
            "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
            "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
            "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_MIT_END = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
            "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
            "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
            "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")

# Neighbours of the notices above; those of TEMPLATES keep their numbers, on which the expected SQL rests.
NEIGHBOURS = [
    *((license, _GNU.format(name, version)) for license, name, version in _VERSIONS),
    *((license, f"This work is licensed under the GNU {name}General Public License, version {version}.") for license, name, version in _VERSIONS),
    *((f"CC-{kind}-4.0", f"Licensed under CC {kind} 4.0.") for kind in ("BY", "BY-SA", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    *((f"CC-{kind}-4.0", _CC.format(f"{name} 4.0")) for kind, name in (
        ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + "3. " + _BSD_NAME + _BSD_END),
    ("BSD-4-Clause", _BSD + "3. All advertising materials mentioning features or use of this software must display the following "
                     "acknowledgement: This product includes software developed by the organization. 4. " + _BSD_NAME + _BSD_END),
    ("MIT", TEMPLATES[1][1] + ", and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software. " + _MIT_END),
    ("MIT-0", TEMPLATES[1][1] + ", and to permit persons to whom the Software is furnished to do so. " + _MIT_END),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
                "Public License v1.0 which accompanies this distribution, and is available at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                "which is available at"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
             "any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]
# Licences that share wording, by how their names begin; of these, a window speaks for the one of which it holds most.
FAMILIES = [("GPL", "LGPL", "AGPL"), ("CC",), ("BSD",), ("MIT",), ("ISC", "0BSD"), ("EPL",), ("MPL",), ("GFDL",)]


@dataclass(frozen=True)
class Template:
    number: int
    license: str
    words: tuple[str, ...]

    @property
    def shingles(self) -> list[str]:
        return sorted({" ".join(self.words[i:i + WORDS]) for i in range(len(self.words) - WORDS + 1)})


@lru_cache(maxsize=1)
def known() -> list[tuple[str, str]]:
    """TEMPLATES, their neighbours and the whole texts beside this module."""
    files = sorted((f for f in resources.files("lexmine.llm").joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    return [*TEMPLATES, *NEIGHBOURS, *((f.name[:-4], f.read_text("utf-8")) for f in files)]


def family(name: str) -> int | None:
    """The number of the family of a licence."""
    return next((k for k, begins in enumerate(FAMILIES) if name.split("-")[0] in begins), None)


@dataclass(frozen=True)
class Windows:
    """The windows for templates of one length: `size` words every `step`, signed with `bands` minima."""

    size: int
    step: int
    bands: int
    templates: tuple[Template, ...]


def templates(texts: list[tuple[str, str]]) -> list[Template]:
    found = [Template(i, name, tuple(re.findall("[a-z0-9]+", text.lower()))) for i, (name, text) in enumerate(texts)]
    if any(len(t.words) < WORDS for t in found):
        raise ValueError(f"a template needs {WORDS} words")
    return found


def window_plan(found: list[Template]) -> list[Windows]:
    """Windows in which every match lies whole, were a quarter of its words insertions, and the bands they need.

    Let J be the least Jaccard similarity of a window with a template of which it holds the least share. A minimum of
    one random order is the same in both with probability J, so ln(MISSED) / ln(1 - J) bands of one row retrieve the
    template but for a chance of MISSED.
    """
    plan = []
    for length in sorted({len(t.words) for t in found}):
        same = tuple(t for t in found if len(t.words) == length)
        step = max(1, length // 4)
        size = math.ceil(length * 1.25) + step - 1
        least = 1.0
        for t in same:
            n = len(t.shingles)
            held = held_at_least(n)
            least = min(least, held / (size - WORDS + 1 + n - held))
        bands = 1 if least >= 1 else math.ceil(math.log(MISSED) / math.log(1 - least))
        plan.append(Windows(size, step, bands, same))
    return plan


def held_at_least(n: int) -> int:
    return math.ceil(LEAST * n - 1e-9)


def anchors(found: list[Template]) -> list[str]:
    """Words without which a text matches no template.

    A match leaves out fewer shingles of a template than are listed here as having an anchor, so it has one of those
    and its word. Long words that cover many shingles are taken first.
    """
    short = {t.number: len(t.shingles) - held_at_least(len(t.shingles)) + 1 for t in found}
    left = {t.number: list(t.shingles) for t in found}
    chosen = []
    while any(n > 0 for n in short.values()):
        gain: dict[str, int] = {}
        for t in found:
            if short[t.number] > 0:
                for word, n in Counter(w for s in left[t.number] for w in set(s.split(" "))).items():
                    gain[word] = gain.get(word, 0) + min(n, short[t.number])
        usual = max((w for w in gain if gain[w]), key=lambda w: (len(w) > 6 and w not in _COMMON, gain[w], len(w), w))
        chosen.append(usual)
        for t in found:
            kept = [s for s in left[t.number] if usual not in s.split(" ")]
            short[t.number] -= len(left[t.number]) - len(kept)
            left[t.number] = kept
    return chosen


def _signature(shingles: Column, bands: Column) -> Column:
    """The least hash of the shingles in each of `bands` random orders, marked with the order."""

    def least(j: Column) -> Column:
        return F.xxhash64(j, F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, j))))

    return F.transform(F.sequence(F.lit(1), bands), least)


def _template_table(spark: SparkSession, plan: list[Windows]) -> DataFrame:
    """plan_no, template, license, wanted (hashed shingles) and bands of all templates, and rivals.

    The rivals of a template are those of other licences of its family, as (template, wanted).
    """
    rows = [(k, w.bands, t.number, t.license, t.shingles) for k, w in enumerate(plan, 1) for t in w.templates]
    listed = spark.createDataFrame(rows, "plan_no int, n int, template int, license string, shingles array<string>")
    hashed = listed.withColumn("wanted", F.transform("shingles", lambda s: F.xxhash64(s)))
    hashed = hashed.select("plan_no", "template", "license", "wanted", _signature(F.col("wanted"), F.col("n")).alias("bands"))
    every = [t for w in plan for t in w.templates]
    pairs = [(a.number, b.number) for a in every for b in every if a.license != b.license and None is not family(a.license) == family(b.license)]
    others = hashed.select(F.col("template").alias("other"), F.struct("template", "wanted").alias("rival"))
    rivals = spark.createDataFrame(pairs, "template int, other int").join(others, "other").groupBy("template").agg(F.collect_list("rival").alias("rivals"))
    return hashed.join(rivals, "template", "left").withColumn("rivals", F.coalesce("rivals", F.array().cast(rivals.schema["rivals"].dataType)))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """doc_id, license, template, word (place of the first window with the best containment), containment.

    A row for each document and template of which some window of the document holds 0.8 or more of the five-word
    shingles, unless each such window holds more shingles of another licence of the family (or as many of a
    longer template), one that the document matches too: a GPL-2.0 header is no GPL-3.0. Words are runs of a-z and 0-9 after lowering. Whole texts are scanned; those without any anchor word are
    passed over, as they cannot match. Null, empty and short texts have no row. Rows that repeat an id are scanned as
    one document each and merged by id; null ids are one id. The template table is as large as the list that the
    caller holds in memory, so it is broadcast.
    """
    plan = window_plan(templates(known() if texts is None else texts))
    table = _template_table(docs.sparkSession, plan)
    listed = table.select("plan_no", "bands", "wanted").collect()
    # A list in SQL is parsed at once and looked up as a hash set.
    among = lambda values: f"IN ({', '.join(f'{v}L' for v in sorted(values))})"
    keys = among({v for r in listed for v in r["bands"]})
    wanted = among({v for r in listed for v in r["wanted"]})
    of_plans = [among({v for r in listed for v in r["wanted"] if r["plan_no"] == k}) for k in range(1, len(plan) + 1)]
    entries = table.select("plan_no", "template", F.explode("bands").alias("band"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.col(text_col)).alias("text"))
    hit = F.lit(False)
    for word in anchors([t for w in plan for t in w.templates]):
        hit = hit | F.contains(F.col("text"), F.lit(word))
    rows = once(rows.filter(hit), words=F.filter(F.split("text", "[^a-z0-9]+"), lambda w: w != "")).select("doc_id", "words")
    rows = once(rows.filter(F.size("words") >= WORDS), shingles=F.transform(
        F.sequence(F.lit(1), F.size("words") - WORDS + 1), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("words", i, F.lit(WORDS))))))
    # A minimum that a window shares with a template is one of the template's shingles, so others need no signature.
    found = F.expr(f"filter(transform(shingles, (s, i) -> IF(s {wanted}, i + 1, 0)), p -> p > 0)")
    rows = once(rows.select("doc_id", "shingles"), places=found).filter(F.size("places") > 0)

    def of_plan(values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("plan_no"))

    own = [F.expr(f"filter(places, p -> element_at(shingles, p) {v})") for v in of_plans]
    cut = rows.select("doc_id", "shingles", F.posexplode(F.array(*own)).alias("plan_no", "places")).filter(F.size("places") > 0)
    cut = cut.withColumn("plan_no", F.col("plan_no") + 1).withColumn("step", of_plan([w.step for w in plan]))
    cut = cut.withColumn("span", of_plan([w.size - WORDS + 1 for w in plan]))
    # Windows start at 1, 1 + step and so on; those that hold a place p are the ones from the first past p - span.
    near = F.expr("array_distinct(flatten(transform(places, p -> filter(sequence("
                  "1 + step * CAST(ceil(greatest(p - span, 0) / step) AS INT), greatest(p, 1 + step * CAST(ceil(greatest(p - span, 0) / step) AS INT)), step),"
                  " w -> w <= p))))")
    cut = cut.select("doc_id", "plan_no", "shingles", "span", F.explode(near).alias("word"))
    cut = cut.select("doc_id", "plan_no", "word", F.array_distinct(F.slice("shingles", F.col("word"), F.col("span"))).alias("held"))
    found = cut.select("doc_id", "plan_no", "word", "held", _signature(F.col("held"), of_plan([w.bands for w in plan])).alias("bands"))
    found = found.select("doc_id", "plan_no", "word", "held", F.explode(F.expr(f"array_distinct(filter(bands, b -> b {keys}))")).alias("band"))
    n = F.size(F.array_intersect("held", "wanted"))
    n = F.size(F.array_intersect("held", "wanted"))
    asked = found.join(F.broadcast(entries), ["plan_no", "band"]).join(F.broadcast(table.drop("plan_no", "bands")), "template")
    matches = asked.withColumn("n", n).filter(F.col("n") / F.size("wanted") >= LEAST)
    # A window that holds as much of two leaves it to their sizes (ISC has a better claim than 0BSD to the words that
    # both have), and where these are equal, as in a window that ends before the version, to what others hold.
    claim = F.struct("n", F.size("wanted"))
    theirs = lambda r: F.struct(F.size(F.array_intersect(F.col("held"), r["wanted"])), F.size(r["wanted"]))
    numbers = lambda rivals: F.array_sort(F.transform(rivals, lambda r: r["template"]))
    matches = matches.select(
        "doc_id", "license", "template", "word", (F.col("n") / F.size("wanted")).alias("containment"),
        numbers(F.filter("rivals", lambda r: theirs(r) > claim)).alias("better"),
        numbers(F.filter("rivals", lambda r: theirs(r) == claim)).alias("equal"))
    best = F.max(F.struct("containment", (-F.col("word")).alias("back")))
    of_doc = Window.partitionBy("doc_id")
    by_rivals = matches.groupBy("doc_id", "license", "template", "better", "equal").agg(best.alias("best"))
    by_rivals = by_rivals.withColumn("top", F.max("best.containment").over(Window.partitionBy("doc_id", "template")))
    by_rivals = by_rivals.withColumn("matched", F.collect_set(F.struct("template", "top")).over(of_doc))
    beaten = F.exists("matched", lambda m: F.array_contains("better", m["template"]) | F.array_contains("equal", m["template"]) & (
        F.struct(m["top"], -m["template"]) > F.struct("best.containment", -F.col("template"))))
    kept = by_rivals.filter(~beaten).groupBy("doc_id", "license", "template").agg(F.max("best").alias("best"))
    return kept.select("doc_id", "license", "template", (-F.col("best.back")).alias("word"), F.col("best.containment").alias("containment"))


def expected_sql() -> str:
    """The same rows by comparing every window with every template; without bands."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for windows in window_plan(templates(TEMPLATES)):
        for t in windows.templates:
            rows += [f"({t.number}, {quoted(t.license)}, {len(t.shingles)}, {windows.size - WORDS + 1}, {windows.step}, {quoted(s)})" for s in t.shingles]
    return f"""
WITH wanted(template, license, n, span, step, shingle) AS (VALUES {', '.join(rows)}),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
found AS (
    SELECT doc_id, i, array_to_string(w[i:i + {WORDS - 1}], ' ') AS shingle
    FROM words, unnest(range(1, len(w) - {WORDS - 2})) AS t(i)),
hits AS (SELECT doc_id, i, w.* FROM found JOIN wanted w USING (shingle)),
held AS (
    SELECT doc_id, template, license, s.word, count(DISTINCT shingle) / n AS containment
    FROM hits, unnest(range(1 + step * CAST(ceil(greatest(i - span, 0) / step) AS BIGINT), i + 1, step)) AS s(word)
    GROUP BY doc_id, template, license, n, s.word HAVING count(DISTINCT shingle) / n >= {LEAST})
SELECT doc_id, license, template, CAST(arg_max(word, (containment, -word)) AS INTEGER) AS word, max(containment) AS containment
FROM held GROUP BY doc_id, license, template"""
