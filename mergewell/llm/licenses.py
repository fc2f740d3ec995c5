"""Licence scans: notices and licence files by TF-IDF cosine to templates, inherited down directories.

A file's text is cut into sentences (long ones into overlapping windows of ``WINDOW`` words), and every
sentence is compared with every template. Besides, a window of each template's own length slides over
the words of the whole text, across line breaks, so that wrapped headers, licence texts and notices
inside prose are found; a window inside a sentence that matches as a whole is no notice of its own. A
notice inside one of twice its length is a part of that; of others that overlap the better stands.
Titles of licence texts count as a text's first lines only. A file takes the licence of its best notice.
Document frequencies come from all texts: tasks count the templates' vocabulary only, so what is
shuffled and collected is at most one row a vocabulary word and task. A word that a template lacks
weighs at most as the template's mean word, so that a notice's score doesn't fall as the corpus grows.
Words that a template shares with its identifier (``apache``, ``2``, ``0``) must all be there, and words that
tell licences apart (``TELLING``) must not be there unless the template has them. A notice that says it does
not apply ("not licensed under ...") is none. Sentences
that lack all of a template's rarest words can't reach the threshold, whatever else they hold, and are
passed over.

A licence file - by its name, or because notices make up half of its words - licenses its directory.
A file without a notice inherits from the nearest directory above it that has one.  Directories, not
files, are joined with their ancestors; several licence files of a directory yield the one whose path
sorts first.

Defined results: null and empty texts hold no notice; a null path is a file without directory, which
inherits nothing; a path without ``/`` lies in the root, which is above every directory, whether paths
start with ``/`` or not; repeated rows are returned each; ties between templates go to the first; very
long texts are scanned whole; columns that aren't kept are ignored, and clashing ones are not touched; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergewell.workspace import materialize

#: Notices as they are commonly written, by SPDX identifier.
SENTENCES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "Licensed under the GNU GPL v2"),
    ("GPL-3.0", "Licensed under the GNU GPL v3"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Every licence by its identifier as well.
TEMPLATES = (*SENTENCES, *((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in SENTENCES)))
#: Words that tell licences apart which are worded alike: a notice that holds one matches no template that lacks it.
TELLING = frozenset({"lesser", "affero", "library", "sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives", "noderivs"})
#: What a notice says no to: "not" right before one of these.
DENIED = frozenset({"licensed", "licenced", "released", "distributed", "governed", "dedicated", "available", "subject"})
#: Headers of source files and whole licence texts.
_PERMITTED = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_DISCLAIMED = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
HEADERS = (
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    *((name, f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
      for name, what, kind, version in (("GPL-3.0", "program", "General Public License", 3), ("GPL-2.0", "program", "General Public License", 2), ("LGPL-2.1", "library", "Lesser General Public License", 2.1), ("LGPL-3.0", "library", "Lesser General Public License", 3), ("AGPL-3.0", "program", "Affero General Public License", 3))),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-3-Clause", _PERMITTED + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _DISCLAIMED),
    ("BSD-2-Clause", _PERMITTED + _DISCLAIMED),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
#: First lines of licence files.
TITLES = (
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("ISC", "ISC License"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("Unlicense", "The Unlicense"),
)
THRESHOLD = 0.75
WINDOW = 64
WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^\n]+?(?:[.!?](?=\s)|(?=\n)|$)")
LICENCE_NAME = r"(?i)^(?:un)?licen[sc]e(?:[-._].*)?$|^copying(?:[-._].*)?$"
#: Up to so many directories (a path and a licence each) are broadcast; beyond, the join shuffles.
BROADCAST_DIRECTORIES = 100_000
SCHEMA = "own_license string, own_score double, n_notices int, notice_share double, notices string"


def terms(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Templates:
    """Unit TF-IDF vectors of the templates, and the words one of which a match must hold."""

    def __init__(self, templates, frequencies: dict[str, int], documents: int, threshold: float, titles=()):
        self.threshold, self.n_templates = threshold, len(templates)
        templates = [*templates, *titles]
        self.names, self.lengths = [name for name, _ in templates], [len(terms(text)) for _, text in templates]
        self.weights = {t: self.idf(documents, n) for t, n in frequencies.items()}
        unseen = self.idf(documents, 1)
        self.vectors, self.others, self.needed, self.anchors = [], [], [], set()
        self.strange = [TELLING.difference(terms(text)) for _, text in templates]
        self.spots: dict[str, list[int]] = defaultdict(list)
        for k, (name, text) in enumerate(templates):
            words = terms(text)
            for t in words:
                self.weights.setdefault(t, unseen)
            self.others.append(sum(self.weights[t] for t in words) / len(words))
            self.needed.append(set(terms(name)).intersection(words))
            v = {t: n * self.weights[t] for t, n in Counter(words).items()}
            norm = math.sqrt(sum(w * w for w in v.values()))
            v = {t: w / norm for t, w in v.items()}
            self.vectors.append(v)
            rest = 1.0
            for t, w in sorted(v.items(), key=lambda x: (-self.weights[x[0]], x[0])):
                if rest < (threshold - 1e-6) ** 2:
                    break
                self.anchors.add(t)
                self.spots[t].append(k)
                rest -= w * w

    @staticmethod
    def idf(documents: int, n: int) -> float:
        return math.log((1 + documents) / (1 + n)) + 1

    def weight(self, t: str, v: dict[str, float], other: float) -> float:
        """The weight of a word where it is compared with ``v``, whose mean word weighs ``other``."""
        return self.weights[t] if t in v else min(self.weights.get(t, other), other)

    def best(self, words: list[str]) -> tuple[int, float]:
        """The best template and its cosine."""
        counts = Counter(words)
        scores = [self.cosine(counts, k) for k in range(self.n_templates)]
        top = max(range(len(scores)), key=lambda k: (scores[k], -k))
        return top, scores[top]

    def cosine(self, counts: Counter[str], k: int) -> float:
        """The cosine to template ``k``, 0 where a word is missing that it needs."""
        if not self.needed[k] <= counts.keys() or any(counts.get(t) for t in self.strange[k]):
            return 0.0
        v, other = self.vectors[k], self.others[k]
        dot = squares = 0.0
        for t, n in counts.items():
            w = n * self.weight(t, v, other)
            dot += w * v.get(t, 0.0)
            squares += w * w
        return min(1.0, dot / math.sqrt(squares))

    def sentences(self, text: str, words: list[str], starts: list[int]) -> Iterator[tuple[int, int, int, float]]:
        """(first word, word after the last, template, cosine) of the sentences that match."""
        for m in SENTENCE.finditer(text):
            lo, hi = bisect_left(starts, m.start()), bisect_left(starts, m.end())
            if lo == hi or self.anchors.isdisjoint(words[lo:hi]):
                continue
            end = -1
            for i in range(lo, max(lo + 1, hi - WINDOW // 2), WINDOW // 2):
                part = words[i : min(hi, i + WINDOW)]
                top, score = self.best(part)
                if score >= self.threshold and i >= end:
                    end = i + len(part)
                    yield i, end, top, score

    def windows(self, words: list[str]) -> Iterator[tuple[int, int, int, float]]:
        """The same of the windows of each template's length, less the words at the ends that it lacks."""
        near, have = defaultdict(list), set(words)
        for i, t in enumerate(words):
            for k in self.spots.get(t, ()):
                near[k].append(i)
        for k, anchors in near.items():
            v, other, length = self.vectors[k], self.others[k], self.lengths[k]
            if k >= self.n_templates or not self.needed[k] <= have or sum(w * w for t, w in v.items() if t in have) < (self.threshold - 1e-6) ** 2:
                continue
            weights, lo, hi, seen = {}, 0, 0, set()
            for i, a in enumerate(anchors):
                if a + 1 - length >= hi or not i:
                    lo, counts, dot, squares = max(0, a + 1 - length), Counter(), 0.0, 0.0
                    hi = lo
                # the window that ends at ``hi``, until the anchor has left it
                for hi in range(hi, min(len(words), a + length)):
                    for j, step in ((hi, 1), (hi - length, -1)):
                        if j < lo:
                            continue
                        t = words[j]
                        w = weights.get(t)
                        if w is None:
                            w = weights[t] = self.weight(t, v, other)
                        n = counts[t]
                        counts[t] = n + step
                        dot += step * w * v.get(t, 0.0)
                        squares += w * w * (2 * step * n + 1)
                    if dot > 0 and dot >= (self.threshold - 1e-6) * math.sqrt(max(squares, 0.0)):
                        first, last = max(lo, hi + 1 - length), hi
                        while words[first] not in v:
                            first += 1
                        while words[last] not in v:
                            last -= 1
                        if (first, last) not in seen:
                            seen.add((first, last))
                            score = self.cosine(Counter(words[first : last + 1]), k)
                            if score >= self.threshold:
                                yield first, last + 1, k, score
                hi = min(len(words), a + length)

    def title(self, text: str, words: list[str], starts: list[int]) -> Iterator[tuple[int, int, int, float]]:
        """The same of the titles that are a text's first lines."""
        for k in range(self.n_templates, len(self.names)):
            n = self.lengths[k]
            if len(words) > n and "\n" not in text[starts[n - 1] : starts[n]] or len(words) < n:
                continue
            score = self.cosine(Counter(words[:n]), k)
            if score >= self.threshold:
                yield 0, n, k, score

    def notices(self, text: str) -> Iterator[tuple[int, int, int, int, float]]:
        """(start, end, words, template, cosine) of the notices, none of which overlap."""
        found = list(WORD.finditer(text))  # lower-cased one by one: the length of a text may change
        words, starts = [w[0].lower() for w in found], [w.start() for w in found]
        denied = [i for i, w in enumerate(words[:-1]) if w == "not" and words[i + 1] in DENIED]
        free = lambda a, b: not denied or bisect_left(denied, a - 3) == bisect_left(denied, b)
        whole = list(self.sentences(text, words, starts))
        within = {i: s for s, (a, b, _, _) in enumerate(whole) for i in range(a, b)}
        parts = (
            (a, b, k, score) for a, b, k, score in self.windows(words) if a not in within or within[a] != within.get(b - 1)
        )
        every = [n for n in [*whole, *parts, *self.title(text, words, starts)] if free(n[0], n[1])]
        every.sort(key=lambda x: x[0] - x[1])
        until, longer, left = [0] * len(words), 0, []  # until: where the last ends of those of twice the length around a word
        for a, b, k, score in every:
            while every[longer][1] - every[longer][0] >= 2 * (b - a):
                first, last = every[longer][:2]
                until[first:last] = [max(last, x) for x in until[first:last]]
                longer += 1
            if until[a] < b:
                left.append((a, b, k, score))
        taken, chosen = bytearray(len(words)), []
        for a, b, k, score in sorted(left, key=lambda x: (-round(x[3], 9), x[0] - x[1], x[0], x[2])):
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                chosen.append((a, b, k, score))
        for a, b, k, score in sorted(chosen):
            yield starts[a], found[b - 1].end(), b - a, k, score

    def judge(self, text: str | None) -> tuple:
        words = terms(text or "")
        if self.anchors.isdisjoint(words):
            return None, 0.0, 0, 0.0, ""
        found = list(self.notices(text))
        if not found:
            return None, 0.0, 0, 0.0, ""
        *_, top, score = max(found, key=lambda n: (n[4], -n[3], -n[0]))
        shown = ",".join(f"{self.names[k]}:{s}:{e}" for s, e, _, k, _ in found)
        return self.names[top], round(score, 6), len(found), round(min(1.0, sum(n for _, _, n, _, _ in found) / len(words)), 6), shown


def document_frequencies(files: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """In how many texts each word of the vocabulary occurs, and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            counts[""] += batch.num_rows
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(terms(text or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    rows = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}  # at most one row a word of the vocabulary
    documents = found.pop("", 0)
    return {t: found.get(t, 0) for t in vocabulary}, documents


def _judged(shared, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = shared.value
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = (pa.string(), pa.float64(), pa.int32(), pa.float64(), pa.string())
        for batch in batches:
            found = list(zip(*map(templates.judge, batch.column("text").to_pylist()))) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(v, k) for v, k in zip(found, kinds)]], [*keep, *names]
            )

    return run


def inherited(judged: DataFrame, least_share: float) -> DataFrame:
    """``_directory, inherited_license, inherited_from`` of the directories below a licence file."""
    licensed = judged.filter(
        F.col("own_license").isNotNull() & F.col("_directory").isNotNull()
        & (F.element_at(F.split("path", "/"), -1).rlike(LICENCE_NAME) | (F.col("notice_share") >= least_share))
    )
    sources = licensed.groupBy(F.col("_directory").alias("_ancestor")).agg(
        F.min_by("own_license", "path").alias("inherited_license"), F.min("path").alias("inherited_from")
    )
    directories = judged.select("_directory").filter("_directory is not null").distinct()
    parts = F.split("_directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    each = directories.select("_directory", F.explode(F.array_union(above, F.array(F.lit("")))).alias("_ancestor"))
    found = each.join(sources, "_ancestor").groupBy("_directory").agg(
        F.max_by(F.struct("inherited_license", "inherited_from"), F.char_length("_ancestor")).alias("i")
    )
    return found.select("_directory", "i.*")


def scan(
    files: DataFrame, keep: list[str], templates=TEMPLATES, threshold: float = THRESHOLD, least_share: float = 0.5,
    headers=HEADERS, titles=TITLES,
) -> DataFrame:
    """``keep`` and the licences of every row of ``files (path, text)``: own, inherited and the one that holds."""
    templates = (*templates, *headers)
    vocabulary = {t for _, text in (*templates, *titles) for t in terms(text)}
    rows = files.select(*dict.fromkeys([*keep, "path"]), F.col("text").cast("string").alias("text"))
    model = Templates(templates, *document_frequencies(rows, vocabulary), threshold, titles)
    shared = files.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "text"]
    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    judged = rows.mapInArrow(_judged(shared, names), f"{shape}, {SCHEMA}")
    judged = materialize(judged.withColumn("_directory", F.regexp_extract("path", "(?s)^(.*)/[^/]*$", 1)), "licenses")
    above = materialize(inherited(judged, least_share), "license-directories")
    if above.count() <= BROADCAST_DIRECTORIES:
        above = F.broadcast(above)
    joined = judged.join(above, "_directory", "left")
    return joined.select(
        *keep, "own_license", "own_score", "n_notices", "notices", "inherited_license", "inherited_from",
        F.coalesce("own_license", "inherited_license").alias("license"),
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    """Documents as files ``source/lang/doc_id``."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    path = F.concat_ws("/", name("source"), name("lang"), name("doc_id"))
    return scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), "text"), ["doc_id"])
