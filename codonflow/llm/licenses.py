"""License scan by a positional index of licence words.

A template is a notice and a mandatory phrase of it.  The document frequencies of all template
words are counted over the whole corpus; a file brings up a template by the word of its phrase that has
the highest IDF, so that common words bring up few templates and none is missed.  Then postings
are intersected by relative position: wherever the phrase stands, with a few words more inside at most, the
template is laid so that its own phrase is there, and its words are matched in order around it, words
that the file has more or less of being gaps between runs of matches.  Enough of them have to be there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import cut, small_batches

#: fixed values: phrase and label
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: fixed values: label, notice, mandatory phrase
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", "redistributions of source code must retain the above copyright notice"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "either version 2 of the license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", "either version 3 of the license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "for any purpose with or without fee is hereby granted"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", "to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license version 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "free and unencumbered software"),
)


@dataclass(frozen=True)
class Params:
    least_share: float = 0.5  # of a template's words that must stand in order around its phrase
    least_words: int = 4  # and so many, or all of a shorter template
    slack: int = 2  # words more that may stand between two of a phrase
    gap: int = 24  # words by which what is around the phrase may be displaced, and at most a quarter of the template


class Index:
    """Licence words by hash: positions in each template, IDF, and the templates that each word brings up."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        h = lambda text: np.array([words.word_hash(w.encode()) for w in text.split()], np.uint64)
        self.labels = [t[0] for t in templates]
        bodies, keys = [h(t[1]) for t in templates], [h(t[2]) for t in templates]
        self.phrases = [(label, h(p)) for p, label in phrases]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *bodies, *keys]))
        self.bodies, self.keys = ([np.searchsorted(self.vocabulary, x) for x in xs] for xs in (bodies, keys))
        self.offsets = []  # where each template has its phrase
        for t, (body, key) in enumerate(zip(self.bodies, self.keys, strict=True)):
            at = _places(body, key)
            if not len(at):
                raise ValueError(f"a template does not have its phrase: {templates[t][2]}")
            self.offsets.append(int(at[0]))
        self.weigh({}, 0)

    def weigh(self, counts: dict[int, int], n: int) -> None:
        self.idf = np.array([math.log((n + 1) / (counts.get(k, 0) + 0.5)) for k in range(len(self.vocabulary))])
        self.brings: list[list[int]] = [[] for _ in self.vocabulary]
        for t, key in enumerate(self.keys):
            self.brings[max(key.tolist(), key=lambda k: (self.idf[k], -k))].append(t)


def _places(h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    if not len(phrase) or len(h) < len(phrase):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(h[: len(h) - len(phrase) + 1] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    return at


def _file_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    for at, _, data, offsets in words.slices(texts):
        low = words.lowered(data)
        starts, ends, first = words.spans(low, offsets, words.PLAIN)
        h = words.hashes(low, starts, ends)
        for k in range(len(first) - 1):
            yield at + k, h[first[k] : first[k + 1]]


def _known(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Which licence word each word of a file is, -1 for none."""
    at = np.searchsorted(vocabulary, h)
    at[at == len(vocabulary)] = 0
    return np.where(vocabulary[at] == h, at, -1) if len(vocabulary) else np.full(len(h), -1)


def _loose_places(known: np.ndarray, key: np.ndarray, slack: int) -> np.ndarray:
    """Where the words of a phrase begin to stand in order, with up to slack words more between two; each goes to the next of its kind."""
    starts = at = np.flatnonzero(known == key[0])
    for word in key[1:].tolist():
        own = np.flatnonzero(known == word)
        after = np.searchsorted(own, at, "right")
        there = after < len(own)
        starts, at, after = starts[there], at[there], after[there]
        near = own[after] - at <= slack + 1
        starts, at = starts[near], own[after][near]
    return starts


def _in_order(body: np.ndarray, window: np.ndarray) -> int:
    """How many words of body stand in the window in order: the longest common subsequence."""
    best = np.zeros(len(window) + 1, np.int64)
    for word in body.tolist():
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + (window == word)))
    return int(best[-1])


def _standing(known: np.ndarray, body: np.ndarray, key: np.ndarray, offset: int, params: Params) -> float:
    """The largest share of a template's words that stand in order around its phrase, wherever that is; 0 if too few do."""
    most, gap = 0, min(params.gap, len(body) // 4)
    for start in _loose_places(known, key, params.slack).tolist():
        begin = max(0, start - offset - gap)
        window = known[begin : start - offset + len(body) + gap]
        most = max(most, _in_order(body, window[window >= 0]))
        if most == len(body):
            break
    enough = max(params.least_share * len(body), min(params.least_words, len(body)))
    return most / len(body) if most >= enough else 0.0


def _count(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(index.vocabulary), np.int64), 0
        for b in batches:
            for _, h in _file_hashes(b.column(0)):
                known = _known(h, index.vocabulary)
                total[np.unique(known[known >= 0])] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(total)), -1)), pa.array(np.append(total, n))], ["word", "files"])

    return run


def scan_words(h: np.ndarray, index: Index, params: Params) -> tuple[int, int | None, int | None, set[str], set[str], float]:
    """(base places, first start, last start, base labels, all labels, score) of one file's word hashes."""
    base, count, first, last = set(), 0, None, None
    known = _known(h, index.vocabulary)
    for label, phrase in index.phrases:
        at = _places(h, phrase)
        if len(at):
            base.add(label)
            count += len(at)
            first = int(at[0]) if first is None else min(first, int(at[0]))
            last = int(at[-1]) if last is None else max(last, int(at[-1]))
    labels, score = set(base), float(bool(base))
    for t in sorted(t for k in np.unique(known[known >= 0]).tolist() for t in index.brings[k]):
        share = _standing(known, index.bodies[t], index.keys[t], index.offsets[t], params)
        if share:
            labels.add(index.labels[t])
            score = max(score, share)
    return count, first, last, base, labels, score


def _scan(index: Index, params: Params):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for _, h in _file_hashes(b.column(1)):
                count, first, last, base, labels, score = scan_words(h, index, params)
                out.append((len(h), count, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases=PHRASES, params: Params = Params()) -> DataFrame:
    """Licence labels of every row of docs, over its whole text.

    Words are runs of digits, a-z and anything beyond ASCII after A-Z were
    lower-cased.  base_labels and n_base come from the phrases alone, at all their
    places; labels adds those of the templates.  score: 1 with a base label, else the
    largest share of a template's words in order around its phrase (0 without any label).
    Null and empty texts have no words and no labels; repeated rows and null ids are
    returned each; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    index = Index(templates, phrases)
    rows = docs.select("text").mapInArrow(_count(index), "word long, files long").groupBy("word").agg(F.sum("files").alias("files"))
    counts = {r[0]: r[1] for r in cut(rows).collect()}  # one row per licence word of the templates
    index.weigh(counts, counts.get(-1, 0))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.mapInArrow(_scan(index, params), schema)
