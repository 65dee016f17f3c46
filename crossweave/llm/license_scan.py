"""Licence scan: word-bigram Dice similarity of parts of a document to licence templates.

Text is normalised to lower-case words of letters and digits. Parts are the lines, the paragraphs (between blank
lines) and the whole text, compared with the templates of a like size, and windows of a template's own number of
words, wherever they are in a line or across lines. A part's similarity to a template is 2c / (a + b) with a and b
the numbers of their distinct bigrams and c of those in both; at a threshold t it needs a and b within a factor of
(2 - t) / t, which leaves few templates to compare. It also needs more than a share of the template's bigrams. So a
text without any of a few words (``guard_words``) that touch the rest of them can't match, and isn't cut up at all;
and one of a few bigrams of the template (``anchors``) has to be in a matching window, which starts so many words
before it as the template does.

All on DataFrame functions, row by row: nothing is shuffled. Defined results: null and empty texts, and those
without a match, have no licence (null), similarity 0.0 and no matches; very long texts are scanned whole; of equally
similar templates the first by name is named; doc_id, of any type or null, is only carried, and repeated rows are
returned as often as they occur; an empty table gives an empty result; columns other than doc_id and text aren't
read, so their names can't clash.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts of common licences and of the notices that name them.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    ),
    "bsd-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "lgpl-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "mit-disclaimer": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND '
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
}
THRESHOLD = 0.8
#: Words that are chosen last to guard a scan: they are in most texts.
COMMON = frozenset("a an and any as at be by for from in is it of on or that the this to under with without you".split())


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bigrams(text: str) -> list[str]:
    own = words(text)
    return sorted({f"{a} {b}" for a, b in zip(own, own[1:])})


def guard_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every match has one: the bigrams without them are too few for any template to be matched. Long words are rare."""
    guards: set[str] = set()
    for text in sorted(templates.values(), key=len):
        own = bigrams(text)
        # c >= threshold (a + b) / 2 and a >= c give c >= b threshold / (2 - threshold).
        needed = threshold / (2 - threshold) * len(own)
        rest = [b for b in own if not guards & set(b.split())]
        while rest and len(rest) >= needed:
            best = max({w for b in rest for w in b.split()}, key=lambda w: (w not in COMMON and not w.isdigit(), min(len(w), 9), sum(w in b.split() for b in rest), len(w), w))
            guards.add(best)
            rest = [b for b in rest if best not in b.split()]
    return sorted(guards)


def anchors(templates: dict[str, str], threshold: float) -> list[tuple[str, str, int]]:
    """(name, bigram, words before it): bigrams of which a window like the template has one; the least usual are taken."""
    made = []
    for name, text in sorted(templates.items()):
        own = words(text)
        pairs = [f"{a} {b}" for a, b in zip(own, own[1:])]
        ranked = sorted(set(pairs), key=lambda b: (sum(w in COMMON for w in b.split()), -len(b), b))
        few = len(ranked) - math.ceil(threshold / (2 - threshold) * len(ranked) - 1e-9) + 1
        made += [(name, b, pairs.index(b)) for b in ranked[:few]]
    return made


def _guarded(text: Column, guards: list[str]) -> Column:
    """Whether a text has one of the words in lower case; long ones may stand inside others."""
    edge = r"[^\p{L}\p{N}]"

    def some(low: Column) -> Column:
        found = F.lit(False)
        for w in guards:
            short = F.lit(True) if len(w) > 4 else low.rlike(rf"(?:^|{edge}){re.escape(w)}(?:{edge}|$)")
            found = found | (F.contains(low, F.lit(w)) & short)
        return found

    return _bound(F.lower(text), some)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _bigrams(part: Column) -> Column:
    """The bigrams of a text in order, with repeats."""
    none = F.array().cast("array<string>")
    return _bound(F.split(_normal(part), " "), lambda w: F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(none))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license (the most similar), similarity, licenses (all found, joined by commas), n_matches (lines, paragraphs and
    texts that match), n_windows (windows that match, by template and start)."""
    templates = TEMPLATES if templates is None else templates
    names = sorted(templates)
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, bigrams(templates[name]))).alias("grams"), F.lit(len(bigrams(templates[name]))).alias("n"), F.lit(len(words(templates[name])) - 1).alias("long")) for name in names])
    places = anchors(templates, threshold)
    anchored = F.array(*[F.struct(F.lit(gram).alias("gram"), F.lit(names.index(name)).alias("t"), F.lit(before).alias("before")) for name, gram, before in places])
    anchor_grams = F.array(*map(F.lit, sorted({gram for _, gram, _ in places})))
    text = F.coalesce(F.col("text"), F.lit(""))
    guards = guard_words(templates, threshold)
    similarity = lambda own, t: 2.0 * F.size(F.array_intersect(own, t["grams"])) / (F.size(own) + t["n"])
    strong = lambda m: m["d"] >= threshold - 1e-9

    def matches(own: Column) -> Column:
        factor = (2 - threshold) / threshold
        sized = F.filter(known, lambda t: (F.size(own) <= t["n"] * factor + 1e-9) & (t["n"] <= F.size(own) * factor + 1e-9))
        return F.filter(F.transform(sized, lambda t: F.struct(similarity(own, t).alias("d"), t["name"].alias("name"))), strong)

    def windows(grams: Column) -> Column:
        def starts(present: Column) -> Column:
            at = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("i"))), lambda x: F.array_contains(present, x["gram"]))
            return F.array_distinct(F.flatten(F.transform(at, lambda x: F.transform(F.filter(anchored, lambda a: a["gram"] == x["gram"]), lambda a: F.struct(a["t"].alias("t"), F.greatest(x["i"] - a["before"], F.lit(0)).alias("start"))))))

        def compared(hit: Column) -> Column:
            return _bound(F.get(known, hit["t"]), lambda t: F.struct(similarity(F.array_distinct(F.slice(grams, hit["start"] + 1, t["long"])), t).alias("d"), t["name"].alias("name")))

        some = _bound(F.array_intersect(grams, anchor_grams), lambda present: F.when(F.size(present) > 0, starts(present)).otherwise(F.array().cast("array<struct<t:int,start:int>>")))
        return F.filter(F.transform(some, compared), strong)

    found = "array<struct<d:double,name:string>>"
    parts = F.concat(F.split(text, "\n"), F.split(text, r"\n[ \t\r]*\n"), F.array(text))
    by_part = F.transform(F.filter(F.array_distinct(parts), lambda p: _guarded(p, guards)), lambda p: _bound(F.array_distinct(_bigrams(p)), matches))
    made = F.when(_guarded(text, guards), F.struct(by_part.cast(f"array<{found}>").alias("parts"), _bound(_bigrams(text), windows).cast(found).alias("windows")))
    rows = docs.select("doc_id", made.alias("found")).select("doc_id", F.coalesce("found.parts", F.array().cast(f"array<{found}>")).alias("parts"), F.coalesce("found.windows", F.array().cast(found)).alias("windows"))
    rows = rows.select("doc_id", F.size(F.filter("parts", lambda m: F.size(m) > 0)).cast("long").alias("n_matches"), F.size("windows").cast("long").alias("n_windows"), F.concat(F.flatten("parts"), F.col("windows")).alias("all"))
    best = F.element_at(F.array_sort(F.transform("all", lambda m: F.struct((-m["d"]).alias("d"), m["name"].alias("name")))), 1)
    some = F.size("all") > 0
    return rows.select(
        "doc_id",
        F.when(some, best["name"]).alias("license"),
        F.round(F.when(some, -best["d"]).otherwise(0.0), 6).alias("similarity"),
        F.when(some, F.array_join(F.array_sort(F.array_distinct(F.transform("all", lambda m: m["name"]))), ",")).alias("licenses"),
        "n_matches",
        "n_windows",
    )
