"""License scans with a positional rare-token index.

The words of the licence templates get their document frequency from the whole corpus.  Of each
template, the words of highest IDF become keys: so many that the words left out weigh less than ``ACCEPT`` in sum.
An inverted index holds for each key its postings, the templates and positions where it stands.  Every word of a file
is looked up there once, and each posting of a key proposes the place where its template would start.  The postings
that agree on template and place are intersected by summing their weights; a place goes on if its keys and all words
that are no keys could reach ``ACCEPT`` together, and is aligned word by word.  So no place that can be accepted is
missed.  A label is given where the IDF-weighted share of agreeing words reaches ``ACCEPT`` and the mandatory phrase
stands inside the aligned words.  The score is 1 with a base label, else the best share of an accepted place, else
``ACCEPT`` times the best share of agreeing keys.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z.  Null or empty text has no words,
no places, empty label strings and score 0.  Repeated rows get equal rows.  Nothing spans two
documents.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, lean, read, text_chunks, words

#: IDF-weighted share of a template's words that must agree.
ACCEPT = 0.75

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: str


_AS_IS = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."
)
#: Whole texts of the short licences, the notices that the long ones ask for, and one-line forms of either.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", "mit license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "free of charge"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS,
        "free of charge",
    ),
    Template("apache", "Licensed under the Apache License, Version 2.0", "apache license"),
    Template(
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "apache license",
    ),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3.", "general public license"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "general public license"),
    Template("gpl", _GPL.format("General Public License"), "gnu general public license"),
    Template("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser general public license"),
    Template("lgpl", _GPL.format("Lesser General Public License"), "lesser general public license"),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "affero general public license"),
    Template("agpl", _GPL.format("Affero General Public License"), "affero general public license"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "source and binary forms"),
    Template("bsd-2-clause", _BSD + _BSD_END, "source and binary forms"),
    Template("bsd-3-clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END, "endorse or promote products"),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "with or without fee",
    ),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla public license"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", "cc by nc"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    Template("unlicense", "This is free and unencumbered software released into the public domain.", "public domain"),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "public domain",
    ),
)


def _hashes(text: str) -> np.ndarray:
    for _, data, offs in text_chunks(pa.array([text])):
        return words(data, offs, ALNUM_WORDS)[2]
    return np.zeros(0, np.uint64)


def _places(h: np.ndarray, phrase: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Starts of a phrase's consecutive words within one text."""
    n = len(h) - len(phrase) + 1
    if n <= 0 or not len(phrase):
        return np.zeros(0, np.int64)
    found = np.flatnonzero(h[:n] == phrase[0])
    for j in range(1, len(phrase)):
        found = found[h[found + j] == phrase[j]]
    return found[np.searchsorted(by, found, "right") == np.searchsorted(by, found + len(phrase) - 1, "right")]


def document_frequencies(documents: DataFrame, vocabulary: np.ndarray) -> tuple[int, dict[int, int]]:
    """(documents, documents that hold each word) over all rows; one row a task and word is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, df = 0, np.zeros(len(vocabulary), np.int64)
        bits = np.zeros(1 << 16, bool)
        bits[(vocabulary >> np.uint64(48)).astype(np.int64)] = True
        for batch in batches:
            rows += batch.num_rows
            for _, data, offs in text_chunks(batch.column("text")):
                _, _, h, by = words(data, offs, ALNUM_WORDS)
                at = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
                rank = np.minimum(np.searchsorted(vocabulary, h[at]), len(vocabulary) - 1)
                at, rank = at[vocabulary[rank] == h[at]], rank[vocabulary[rank] == h[at]]
                doc = np.searchsorted(by, at, "right") - 1
                df += np.bincount(np.unique(doc * len(vocabulary) + rank) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(vocabulary))], pa.int64()), pa.array([rows, *df.tolist()], pa.int64())], ["word", "df"])

    counts = {r.word: r.df for r in documents.select("text").mapInArrow(lean(run), "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    return counts.get(-1, 0), {k: v for k, v in counts.items() if k >= 0}


def build_index(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> list[dict]:
    """For each template its word hashes, IDF weights, mandatory phrase and label."""
    each = [_hashes(t.text) for t in templates]
    vocabulary = np.unique(np.concatenate(each))
    n, df = document_frequencies(documents, vocabulary)
    idf = np.array([math.log((n + 1) / (df.get(i, 0) + 1)) + 1 for i in range(len(vocabulary))])
    out = []
    for t, h in zip(templates, each, strict=True):
        weight = idf[np.searchsorted(vocabulary, h)]
        out.append({"label": t.label, "words": h, "weight": weight / weight.sum(), "mandatory": _hashes(t.mandatory)})
    return out


def _keys(weight: np.ndarray, accept: float) -> np.ndarray:
    """Positions of the heaviest words, as few as leave less than ``accept`` to the others."""
    order = np.argsort(-weight, kind="stable")
    left = 1 - np.cumsum(weight[order])
    return order[: int(np.count_nonzero(left >= accept - 1e-9)) + 1]


@dataclass(frozen=True)
class Postings:
    """The inverted index: sorted key words, and the postings (template, position, weight) of each from offsets on."""

    words: np.ndarray
    offsets: np.ndarray
    template: np.ndarray
    position: np.ndarray
    weight: np.ndarray
    #: Of each template, what its words weigh that are no keys.
    rest: np.ndarray

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the word, posting) of all postings of the words."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = np.zeros(1 << 16, bool)
        bits[(self.words >> np.uint64(48)).astype(np.int64)] = True
        at = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
        rank = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        hit = self.words[rank] == h[at]
        at, rank = at[hit], rank[hit]
        n = np.diff(self.offsets)[rank]
        return np.repeat(at, n), np.arange(n.sum()) + np.repeat(self.offsets[rank] - np.cumsum(n) + n, n)


def invert(index: list[dict], accept: float = ACCEPT) -> Postings:
    rows = [(int(t["words"][j]), k, int(j), float(t["weight"][j])) for k, t in enumerate(index) for j in _keys(t["weight"], accept)]
    word, template, position, weight = (np.array(x, kind) for x, kind in zip(zip(*sorted(rows), strict=True) if rows else [[]] * 4, (np.uint64, np.int64, np.int64, np.float64), strict=True))
    own, first = np.unique(word, return_index=True)
    keys = np.bincount(template, weight, len(index)) if rows else np.zeros(len(index))
    return Postings(own, np.append(first, len(word)).astype(np.int64), template, position, weight, 1 - keys)


def _proposed(postings: Postings, h: np.ndarray, by: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, template, place, weight of the agreeing keys) of every place that some key proposes; a place may lie
    before or reach behind its text, and each text that holds a key of it counts for itself."""
    at, post = postings.look_up(h)
    text, template = np.searchsorted(by, at, "right") - 1, postings.template[post]
    wide, kinds = len(h) + longest, max(len(postings.rest), 1)
    key, own = np.unique((text * kinds + template) * wide + at - postings.position[post] + longest, return_inverse=True)
    weight = np.bincount(own, postings.weight[post], len(key))
    return key // wide // kinds, key // wide % kinds, key % wide - longest, weight


def scan(documents: DataFrame, index: list[dict], accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of the licences found."""
    shared = documents.sparkSession.sparkContext.broadcast((index, invert(index, accept)))
    base = [(_hashes(p), label) for p, label in BASE.items()]
    longest = max((len(t["words"]) for t in index), default=0)
    ddl = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:int,length:int,share:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, postings = shared.value
        for batch in batches:
            rows = []
            for _, data, offs in text_chunks(batch.column("text")):
                _, _, h, by = words(data, offs, ALNUM_WORDS)
                found: dict[int, dict] = {}
                own = lambda d, found=found: found.setdefault(int(d), {"base": [], "labels": set(), "base_labels": set(), "score": 0.0, "spans": []})
                for phrase, label in base:
                    for at in _places(h, phrase, by).tolist():
                        x = own(np.searchsorted(by, at, "right") - 1)
                        x["base"].append(at)
                        x["base_labels"].add(label)
                        x["score"] = 1.0
                text, template, place, agree = _proposed(postings, h, by, longest)
                best = np.zeros(len(by) - 1)
                np.maximum.at(best, text, np.minimum(agree, 1.0) * accept)
                able = agree + postings.rest[template] >= accept - 1e-9
                for k in np.unique(template[able]).tolist():
                    t, use = templates[k], np.flatnonzero(able & (template == k))
                    n = len(t["words"])
                    for part in np.array_split(use, len(use) * n // (1 << 20) + 1):
                        i = place[part][:, None] + np.arange(n)
                        inside = (i >= by[text[part]][:, None]) & (i < by[text[part] + 1][:, None])
                        shares = np.minimum(1.0, (inside & (h[np.where(inside, i, 0)] == t["words"])) @ t["weight"])
                        for at, d, share in zip(place[part][shares >= accept].tolist(), text[part][shares >= accept].tolist(), shares[shares >= accept].tolist(), strict=True):
                            low, high = max(at, by[d]), min(at + n, by[d + 1])
                            if len(_places(h[low:high], t["mandatory"], np.array([0, high - low]))):
                                x = own(d)
                                x["labels"].add(t["label"])
                                x["spans"].append({"label": t["label"], "start": int(low - by[d]), "length": int(high - low), "share": share})
                                x["score"] = max(x["score"], share)
                for i in range(len(by) - 1):
                    x, n = found.get(i), int(by[i + 1] - by[i])
                    if x is None:
                        rows.append((n, 0, None, None, "", "", float(best[i]), []))
                    else:
                        b = x["base"]
                        rows.append((n, len(b), min(b) - int(by[i]) if b else None, max(b) - int(by[i]) if b else None, ",".join(sorted(x["base_labels"])), ",".join(sorted(x["labels"] | x["base_labels"])), max(x["score"], float(best[i])), sorted(x["spans"], key=lambda s: (s["start"], s["label"], s["length"]))))
            c = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("share", pa.float64())]))]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(c, kinds, strict=True))], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), ddl)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return scan(documents, build_index(documents)).drop("spans")
