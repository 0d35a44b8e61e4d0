"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Every line of a whole text with a trigger word is read as sentences and as part of
its paragraph (the run of non-blank lines around it), and the text itself as a whole.
Passages and templates (short notices, file headers and full licence texts) become
sparse TF-IDF vectors; inverse document frequencies of the templates' terms are
counted over all texts, by the same terms, and other terms have the highest. The best
template at or above ``least`` names the licence of a file; ties take the first name.

A file without one inherits from the nearest directory above it that has a licence
file: a file named like LICENSE or COPYING, or one whose text is in the main licence
text (``mainly`` of its terms or more stand in passages that match), whose own text
matches. Directories, not files, are joined with their ancestors. The joins shuffle
unless a side's measured size allows a broadcast.

Edge cases: null and empty texts have no licence of their own; a null path has no
directory and inherits nothing; several licence files in one directory give the
best score, then the first name; rows that repeat are answered once each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bound_batches, checkpointed, map_rows, packed, ship, small, texts_of

LEAST, MAINLY = 0.55, 0.5
TRIGGER = re.compile(r"licen[sc]|copyright|spdx|rights reserved|public domain|redistribut|hereby granted|creative commons|\bcc[- ]?(?:by|0)\b", re.I)
TERM = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]", re.I)
SENTENCE = re.compile(r"(?<=[.;!?])\s+")
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense|notice)([._-].*)?$"

# Public licence texts, headers and notices.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."

TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", _MIT),
    ("MIT", f"{_MIT} {_MIT_NOTICE} {_AS_IS}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", _APACHE),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-2.0", "This program is free software under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", _GPL.format(2)),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", f"{_BSD} {_BSD_1} {_BSD_3}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_1} {_BSD_3} {_BSD_AS_IS}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"{_BSD} {_BSD_1}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_1} {_BSD_AS_IS}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", _ISC),
    ("Unlicense", _UNLICENSE),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Copyright. All rights reserved. Do not redistribute."),
)


def terms(text: str) -> list[str]:
    return [t.rstrip(".") for t in TERM.findall(text.lower())]


def frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Number of texts, and how many of them have each term of the templates (a fixed, small set)."""
    bound_batches(docs.sparkSession)
    ship(docs.sparkSession)

    def run(batches):
        n, found = 0, Counter()
        for batch in batches:
            for t in texts_of(batch, "text"):
                n += 1
                found.update(vocabulary.intersection(terms(t)))
        keys = [None, *found]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n, *(found[k] for k in keys[1:])], pa.int64())], ["term", "n"])

    rows = docs.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each template term
    counts = {r["term"]: r["n"] for r in rows}
    return counts.pop(None, 0), counts


class Matcher:
    """Templates as unit vectors in an inverted index."""

    def __init__(self, n: int, counts: dict[str, int], templates=TEMPLATES):
        self.most = math.log1p(n)
        self.idf = {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1e-3 for _, text in templates for t in terms(text)}
        self.names = [name for name, _ in templates]
        self.index: dict[str, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(templates):
            for t, w in self.vector(terms(text)).items():
                self.index.setdefault(t, []).append((k, w))

    def vector(self, words: list[str]) -> dict[str, float]:
        raw = {t: (1 + math.log(c)) * self.idf.get(t, self.most) for t, c in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / norm for t, w in raw.items()}

    def best(self, passage: str) -> tuple[float, str]:
        scores: dict[int, float] = {}
        for t, w in self.vector(terms(passage)).items():
            for k, v in self.index.get(t, ()):
                scores[k] = scores.get(k, 0.0) + w * v
        return min(((-round(s, 9), self.names[k]) for k, s in scores.items()), default=(0.0, ""))

    def read(self, text: str, least: float) -> tuple[str | None, float, float]:
        """The text's licence, its score, and the share of the text's terms in lines of passages that match."""
        if not TRIGGER.search(text):
            return None, 0.0, 0.0
        lines, top, seen = text.split("\n"), (0.0, ""), {}
        matching = [False] * len(lines)

        def ask(passage: str, first: int, last: int) -> None:
            nonlocal top
            if TRIGGER.search(passage):
                if passage not in seen:
                    seen[passage] = self.best(passage)
                top = min(top, seen[passage])
                if -seen[passage][0] >= least:
                    matching[first:last] = [True] * (last - first)

        start = 0
        for k in range(len(lines) + 1):
            if k < len(lines) and TRIGGER.search(lines[k]):
                for passage in (lines[k], *SENTENCE.split(lines[k])):
                    ask(passage, k, k + 1)
            if k == len(lines) or not lines[k].strip():
                if k - start > 1:
                    ask("\n".join(lines[start:k]), start, k)
                start = k + 1
        ask(text, 0, len(lines))
        if -top[0] < least:
            return None, -top[0], 0.0
        sizes = [len(TERM.findall(x)) for x in lines]
        return top[1], -top[0], sum(n for n, x in zip(sizes, matching, strict=True) if x) / max(1, sum(sizes))


def scan(files: DataFrame, path: str = "path", text: str = "text", least: float = LEAST, mainly: float = MAINLY, templates=TEMPLATES) -> DataFrame:
    """The columns of ``files`` but the text, with license, license_score and license_from ("text", a directory, or null)."""
    vocabulary = {t for _, x in templates for t in terms(x)}
    matcher = Matcher(*frequencies(files.select(F.col(text).alias("text")), vocabulary), templates)

    def make():
        def step(batch):
            found = [matcher.read(t, least) for t in texts_of(batch, "text")]
            return [[x[k] for x in found] for k in range(3)]

        return step

    rows = packed(files, (text, "license", "license_score", "license_from"), path=F.col(path), text=F.col(text))
    own = map_rows(rows, make, [("own", T.StringType()), ("score", T.DoubleType()), ("share", T.DoubleType())], ["row", "path"])
    own = checkpointed(own.withColumn("dir", F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)))
    # The best score, then the first name, by one aggregate: a directory of many licence files isn't sorted in one task.
    told = own.where(F.col("own").isNotNull() & F.col("dir").isNotNull() & (F.col("name").rlike(LICENCE_FILE) | (F.col("share") >= mainly)))
    told = told.groupBy(F.col("dir").alias("above")).agg(F.min(F.struct((-F.col("score")).alias("s"), "own"))["own"].alias("given"))
    told = checkpointed(told)
    # Each directory with all that lie above it, itself included; the longest match is the nearest.
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    dirs = own.where(F.col("own").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    near = dirs.select("dir", F.explode(above).alias("above")).join(small(told, 200), "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "given", "above")).alias("near"))
    near = checkpointed(near.select(F.col("dir").alias("d"), "near.given", "near.above"))
    met = own.join(small(near, 300), (F.col("dir") == F.col("d")) & F.col("own").isNull(), "left")
    told_by = F.when(F.col("own").isNotNull(), "text").otherwise(F.col("above"))
    return met.select("row.*", F.coalesce("own", "given").alias("license"), F.col("score").alias("license_score"), told_by.alias("license_from"))
