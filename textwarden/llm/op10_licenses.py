"""Licence scan by a positional rare-token index over licence templates.

The index holds each template's rarest words with their positions.  A file's words of the index are looked up, and a
template's place is where several of its words stand at one relative position, give or take what edits shift.  The place
counts if enough of the template's weight stands there in order and its mandatory key phrases do.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, folded_words, map_rows, table, utf8

#: Base labels: places where a phrase's words stand consecutively.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_REST = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU"""

# Licence texts and notices as their licences give them, and phrases that must stand in them unbroken.
#: label: (template, mandatory key phrases).
TEMPLATES = {
    "mit-text": (
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software. {_WARRANTY}""",
        ["permission is hereby granted free of charge", "to any person obtaining a copy"],
    ),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "to any person obtaining a copy"],
    ),
    "mit-notice": ("released under the MIT License", ["under the mit license"]),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    "apache-2.0-text": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
        express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ["you may not use this file except in compliance with the license"],
    ),
    "gpl-3.0": ("licensed under the GNU General Public License, version 3", ["gnu general public license version 3"]),
    "gpl-2.0": ("licensed under the GNU General Public License, version 2", ["gnu general public license version 2"]),
    "gpl-text": (
        f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        {_GNU_REST} General Public License for more details. You should have received a copy of the GNU General Public License along with this program.""",
        ["free software foundation", "you can redistribute it and or modify it", "gnu general public license"],
    ),
    "lgpl": ("GNU Lesser General Public License", ["lesser general public license"]),
    "lgpl-text": (
        f"""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library
        {_GNU_REST} Lesser General Public License for more details.""",
        ["you can redistribute it and or modify it", "lesser general public license"],
    ),
    "agpl": ("GNU Affero General Public License", ["affero general public license"]),
    "agpl-text": (
        f"""This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
        {_GNU_REST} Affero General Public License for more details.""",
        ["you can redistribute it and or modify it", "affero general public license"],
    ),
    "bsd-text": (f"{_BSD_START} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}", ["redistribution and use in source and binary forms", "following conditions are met"]),
    "bsd-3-text": (
        f"{_BSD_START} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_WARRANTY}",
        ["redistribution and use in source and binary forms", "following conditions are met", "endorse or promote products derived from this software"],
    ),
    "bsd-grant": (_BSD_START, ["redistribution and use in source and binary forms", "following conditions are met"]),
    "isc-text": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        ["for any purpose with or without fee is hereby granted"],
    ),
    "zlib-text": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must
        not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.""",
        ["permission is granted to anyone to use this software for any purpose", "must not be misrepresented"],
    ),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ["mozilla public license"],
    ),
    "cc-by-nc-4.0": ("licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    "cc-by-sa-4.0": ("licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    "cc-by-4.0": ("licensed under CC BY 4.0", ["cc by 4 0"]),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
        ["free and unencumbered software"],
    ),
}

#: Share of a template's IDF weight that must stand in order at a place.
MIN_SCORE = 0.5
#: Words by which edits may shift what follows against what stands before; starts no further apart are joined.
SLACK = 8
#: IDF weight of licence words at which a file's score is a half.
HALF = 40.0


@dataclass
class Index:
    """Templates and base phrases by words; postings of rare words: (template, position) and (base phrase, position)."""

    words: list[list[bytes]]
    keys: list[list[list[bytes]]]
    labels: list[str]
    base: list[tuple[list[bytes], str]]
    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    anchors: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    weight: list[float] = field(default_factory=list)


def _split(text: str) -> list[bytes]:
    return folded_words(text.encode())


def vocabulary(templates: dict[str, tuple[str, list[str]]] | None = None, base: dict[str, str] | None = None) -> set[bytes]:
    """The words that the index may hold."""
    return {w for t in [*(t for t, _ in (TEMPLATES if templates is None else templates).values()), *(BASE if base is None else base)] for w in _split(t)}


def build_index(templates: dict[str, tuple[str, list[str]]] | None = None, base: dict[str, str] | None = None, df: dict[bytes, int] | None = None, files: int = 0) -> Index:
    """The index, with IDF from ``df``, the number of the ``files`` that hold a word, and from the templates themselves.

    Of a template, the rarest words are posted, until the others weigh less than MIN_SCORE of it: a place of less than that
    doesn't count, so no place that counts lacks all posted words.  Of a base phrase, the rarest word is posted.
    """
    templates, base, df = TEMPLATES if templates is None else templates, BASE if base is None else base, df or {}
    words = [_split(t) for t, _ in templates.values()]
    phrases = [(_split(p), n) for p, n in base.items()]
    own = Counter(w for ws in [*words, *(p for p, _ in phrases)] for w in set(ws))
    total = files + len(words) + len(phrases)
    out = Index(words, [[_split(k) for k in ks] for _, ks in templates.values()], list(templates), phrases, {w: log(1 + total / (n + df.get(w, 0))) for w, n in own.items()})
    for t, ws in enumerate(words):
        out.weight.append(sum(out.idf[w] for w in ws))
        rest, posted = out.weight[t], set()
        for w, n in sorted(Counter(ws).items(), key=lambda x: (-out.idf[x[0]], x[0])):
            if rest < MIN_SCORE * out.weight[t] * (1 - 1e-9):
                break
            posted.add(w)
            rest -= n * out.idf[w]
        for q, w in enumerate(ws):
            if w in posted:
                out.postings[w].append((t, q))
    for k, (ws, _) in enumerate(phrases):
        q = max(range(len(ws)), key=lambda j: out.idf[ws[j]])
        out.anchors[ws[q]].append((k, q))
    return out


def in_order(words: list[bytes], ws: list[bytes], starts: list[int], idf: dict[bytes, float]) -> tuple[float, int, int]:
    """(weight, start, end) of the heaviest choice of template words that stand in order, each at its place from one of ``starts``."""
    n = len(words)
    none = (0.0, starts[0], 0, None)  # weight, start, template place, the one before
    tree: list[tuple] = [none] * (starts[-1] - starts[0] + len(ws) + 1)  # best by last place, as a Fenwick tree
    base, top = starts[0], none
    for q, w in enumerate(ws):
        for start in reversed(starts):  # later places first, so that a template word is taken once
            p = start + q
            if not (0 <= p < n and words[p] == w):
                continue
            before, k = none, p - base
            while k > 0:
                before = max(before, tree[k - 1], key=lambda x: x[0])
                k &= k - 1
            one = (before[0] + idf[w], start, q, before if before[0] else None)
            top = max(top, one, key=lambda x: x[0])
            k = p - base + 1
            while k <= len(tree):
                tree[k - 1] = max(tree[k - 1], one, key=lambda x: x[0])
                k += k & -k
    taken, one = [], top if top[0] else None
    while one:
        taken.append(one)
        one = one[3]
    return sum(idf[ws[x[2]]] for x in reversed(taken)), (taken or [top])[-1][1], top[1] + len(ws)


def scan(text: bytes, index: Index) -> tuple[int, list[tuple[int, str]], list[tuple[str, float, int]], float]:
    """(words, base places (start, label), template places (label, score, start), score) of a text.

    The file's words of the index are looked up; each posting votes for the place where its template would start.  Starts of
    a template that are within SLACK of the next are one place, as edits shift it.  A place is scored by the share of
    the template's IDF weight that stands in order at its positions from one of the place's starts; it counts if that reaches
    MIN_SCORE and each key phrase stands within it, give or take SLACK words.  The text's score grows with the IDF
    weight of what was found.
    """
    words = folded_words(text)
    n = len(words)
    rare = (index.postings.keys() | index.anchors.keys()).intersection(words)
    if not rare:
        return n, [], [], 0.0
    at: dict[bytes, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        if w in rare:
            at[w].append(k)
    places: list[tuple[int, str]] = []
    votes: dict[int, set[int]] = defaultdict(set)
    total = 0.0
    for w, here in at.items():
        for k, q in index.anchors.get(w, ()):
            phrase, label = index.base[k]
            found = [(p - q, label) for p in here if p >= q and words[p - q : p - q + len(phrase)] == phrase]
            places += found
            total += len(found) * sum(index.idf[x] for x in phrase)
        for t, q in index.postings.get(w, ()):
            votes[t].update(p - q for p in here)
    out: list[tuple[str, float, int]] = []
    for t, starts in votes.items():
        ws = index.words[t]
        for near in runs(sorted(starts)):
            weight, begin, _ = in_order(words, ws, near, index.idf)
            if weight < MIN_SCORE * index.weight[t]:
                continue
            low, high = max(0, near[0] - SLACK), min(n, near[-1] + len(ws) + SLACK)
            if all(any(words[p : p + len(key)] == key for p in range(low, high - len(key) + 1)) for key in index.keys[t]):
                out.append((index.labels[t], min(1.0, weight / index.weight[t]), max(0, begin)))
                total += weight
    return n, sorted(places), sorted(out), total / (total + HALF)


def runs(starts: list[int]) -> Iterator[list[int]]:
    """Sorted starts, cut where the next one is more than SLACK away."""
    first = 0
    for k in range(1, len(starts) + 1):
        if k == len(starts) or starts[k] - starts[k - 1] > SLACK:
            yield starts[first:k]
            first = k


def document_frequencies(df: DataFrame, text: str, words: set[bytes]) -> tuple[dict[bytes, int], int]:
    """How many of all texts hold each of ``words``, and the number of texts.  Workers count; only sums are shuffled."""
    bounded_batches(df.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(words.intersection(folded_words(t)))
                found[None] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["w", "n"])

    sums = df.select(utf8(f"`{text}`").alias("t")).mapInArrow(counted, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    df_of = {None if r.w is None else bytes(r.w): r.n for r in sums}
    return df_of, df_of.pop(None, 0)


def find_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict | None = None, base: dict | None = None) -> DataFrame:
    """Base phrases and licence templates in each text.

    Returns ``key``, n_words, places (start word and label of every base phrase), found (label, score and start of every
    place of a template) and score (0 to 1, by the IDF weight of what was found).  IDF is counted over all texts, in a pass
    of its own; only the sums of the index's words reach the driver.  Null and empty texts have no words and nothing
    found; rows of a null key are scanned as others; repeated rows are kept; ties of IDF are ordered by word; an empty
    table gives no rows; other columns are not read, whatever their names.
    """
    index = build_index(templates, base, *document_frequencies(df, text, vocabulary(templates, base)))

    def work(ids, texts):
        for i, t in zip(ids, texts, strict=True):
            n, places, found, score = scan(t, index)
            yield i, n, [{"start": p, "label": x} for p, x in places], [{"label": x, "score": s, "start": p} for x, s, p in found], score

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df.select(F.col(f"`{key}`"), utf8(f"`{text}`").alias("t")), work, f"`{key}` {kind}, n_words bigint, places array<struct<start:bigint,label:string>>, found array<struct<label:string,score:double,start:bigint>>, score double")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(table(spark, sf_dir, "documents"))
    labels = lambda *parts: F.array_join(F.array_sort(F.array_distinct(F.concat(*parts))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        labels("places.label").alias("base_labels"),
        labels("places.label", "found.label").alias("labels"),
        "score",
    )
