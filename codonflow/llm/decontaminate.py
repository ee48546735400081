"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

Test items are the indexed documents and every passage of every training text is a
query.  Impacts are scaled by an item's score against itself, so that one threshold
holds for all items.  An item's rarest terms that make up most of its score are its
essential ones: a passage below the threshold less the most that other terms can
give is not searched.  The rest go through block-max WAND, and what it retrieves is
verified by the n-grams of question and answer around the passage.  Words are runs of
letters and digits, so that signs or capitals added to a copy don't hide it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import cut, small_batches


@dataclass(frozen=True)
class Params:
    threshold: float = 0.5  # share of an item's own score that retrieves it
    overlap: float = 0.75  # of an item's n-grams
    part_overlap: float = 0.5  # of those of the question, and of the answer, where they have one at least
    size: int = words.SHINGLE
    essential: float = 0.75  # of an item's score is made by essential terms
    block: int = 8  # items of a block
    k1: float = 1.2
    b: float = 0.75
    index_bytes: int = 16 << 20  # text of the items of one index; more items are searched in turns, with the same result


def _grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words, in order."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - size + 1, np.uint64)
        for k in range(size):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[k : len(h) - size + 1 + k]
    return words.mix(out, 17 + size)


def _slice_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes of a slice of rows, words before each row)."""
    for at, _, data, offsets in words.slices(texts):
        low = words.lowered_latin(data)
        starts, ends, first = words.spans(low, offsets, words.PLAIN)
        yield at, words.hashes(low, starts, ends), first


@dataclass(frozen=True)
class Among:
    """Of all items: their number, their words in all, the most of one, and in how many each term is."""

    items: int
    words: int
    longest: int
    held: dict[int, int]


class BlockMaxIndex:
    """Postings by term, ascending by item, with the largest impact of each block of items."""

    def __init__(self, items: list[tuple[int, str]], params: Params = Params(), among: Among | None = None):
        """The question of an item is its first line, the answer the others; an item of one line is both.

        among: the statistics of all items, if these are a part of them.
        """
        self.params = params
        self.ids, self.parts, self.wholes = [], [], []
        bodies = []
        for id_, text in items:
            lines = [x for x in (text or "").split("\n") if x.strip()]
            texts = [" ".join(lines), *([lines[0], " ".join(lines[1:])] if len(lines) > 1 else [])]
            h = [own[first[k] : first[k + 1]] for _, own, first in _slice_hashes(pa.array(texts, pa.string())) for k in range(len(first) - 1)]
            if len(h[0]):
                self.ids.append(id_)
                bodies.append(h[0])
                self.wholes.append(self._ngrams(h[0]))
                self.parts.append([self._ngrams(x) for x in h[1:] if len(x) >= params.size])
        self.lengths = np.array([len(x) for x in bodies], np.int64)
        if among is None:
            own: Counter[int] = Counter()
            for x in bodies:
                own.update(set(x.tolist()))
            among = Among(len(bodies), int(self.lengths.sum()), int(max(self.lengths, default=2)), own)
        n, held = among.items, among.held
        self.stride = -(-among.longest // 2)
        mean = among.words / n if n else 1.0
        self.vocabulary = np.array(sorted(set().union(*(x.tolist() for x in bodies))), np.uint64)
        place = {t: k for k, t in enumerate(self.vocabulary.tolist())}
        postings: list[list[tuple[int, float]]] = [[] for _ in place]
        essential: list[list[tuple[int, float]]] = [[] for _ in place]
        self.rest = np.zeros(len(bodies))  # the most that other terms give to each item
        for i, x in enumerate(bodies):
            impact = {}
            for t, f in Counter(x.tolist()).items():
                idf = math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5))
                impact[place[t]] = idf * f * (params.k1 + 1) / (f + params.k1 * (1 - params.b + params.b * len(x) / mean))
            own, made = sum(impact.values()), 0.0
            for k in sorted(impact, key=lambda k: (held[int(self.vocabulary[k])], k)):
                value = impact[k] / own
                postings[k].append((i, value))
                if made < params.essential:
                    essential[k].append((i, value))
                    made += value
            self.rest[i] = 1 - made
        self.of_term = np.array([len(p) for p in essential], np.int64)
        self.begin = np.cumsum(self.of_term) - self.of_term
        self.essential_items = np.array([i for p in essential for i, _ in p], np.int64)
        self.essential_impacts = np.array([v for p in essential for _, v in p])
        self.items = [np.array([i for i, _ in p], np.int64) for p in postings]
        self.impacts = [np.array([v for _, v in p]) for p in postings]
        self.most = np.array([p.max() for p in self.impacts]) if postings else np.zeros(0)
        self.blocks = []  # for each term {block: largest impact}
        for items_, values in zip(self.items, self.impacts, strict=True):
            of: dict[int, float] = {}
            for b, v in zip((items_ // params.block).tolist(), values.tolist(), strict=True):
                of[b] = max(of.get(b, 0.0), v)
            self.blocks.append(of)

    def _ngrams(self, h: np.ndarray) -> tuple[int, np.ndarray]:
        size = min(self.params.size, len(h))
        return size, np.unique(_grams(h, size)) if size else np.zeros(0, np.uint64)

    def terms(self, h: np.ndarray) -> np.ndarray:
        """Place in the vocabulary of each word, or -1."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == h, at, -1)

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) of at least threshold for a query of distinct terms."""
        at = dict.fromkeys(terms, 0)
        block, out, end = self.params.block, [], 1 << 62
        while True:
            lists = sorted(((int(self.items[t][p]), t) for t, p in at.items() if p < len(self.items[t])))
            total, pivot = 0.0, None
            for k, (item, t) in enumerate(lists):
                total += self.most[t]
                if total >= threshold - 1e-12:
                    pivot = k
                    break
            if pivot is None:
                return out
            target = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == target:
                pivot += 1
            ahead = lists[: pivot + 1]
            shallow = sum(self.blocks[t].get(target // block, 0.0) for _, t in ahead)
            if shallow < threshold - 1e-12:
                # no item of this block, up to the next list, can do it
                following = lists[pivot + 1][0] if pivot + 1 < len(lists) else end
                to = min((target // block + 1) * block, following)
                for _, t in ahead:
                    at[t] = int(np.searchsorted(self.items[t], to))
            elif ahead[0][0] == target:
                score = 0.0
                for _, t in ahead:
                    score += self.impacts[t][at[t]]
                    at[t] += 1
                if score >= threshold - 1e-12:
                    out.append((target, float(score)))
            else:
                for item, t in ahead:
                    if item < target:
                        at[t] = int(np.searchsorted(self.items[t], target))

    def passages(self, known: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, first word in it) of the passages that the essential terms of some item don't rule out.

        Passages are two strides long and begin every stride, up to the one that
        reaches the end of a text; no item is longer than a passage.
        """
        size = np.diff(first)
        many = np.maximum(1, -(-size // self.stride) - 1)
        base = np.cumsum(many) - many
        pos = np.flatnonzero(known >= 0)
        runs = self.of_term[known[pos]]
        pos, runs, term = pos[runs > 0], runs[runs > 0], known[pos[runs > 0]]
        place = np.repeat(self.begin[term] - (np.cumsum(runs) - runs), runs) + np.arange(int(runs.sum()))
        item, impact = self.essential_items[place], self.essential_impacts[place]
        text = np.repeat(np.searchsorted(first, pos, "right") - 1, runs)
        step = (np.repeat(pos, runs) - first[text]) // self.stride
        n = len(self.ids)
        own = [(base[text[ok]] + at[ok]) * n + item[ok] for at in (step, step - 1) for ok in [(at >= 0) & (at < many[text])]]
        weights = [impact[(at >= 0) & (at < many[text])] for at in (step, step - 1)]
        key, back = np.unique(np.concatenate(own), return_inverse=True)
        sums = np.bincount(back, np.concatenate(weights), len(key))
        found = np.unique(key[sums + self.rest[key % max(1, n)] >= self.params.threshold - 1e-9] // max(1, n))
        text = np.searchsorted(base, found, "right") - 1
        return text, (found - base[text]) * self.stride

    def leaks(self, h: np.ndarray, first: np.ndarray) -> dict[int, list[tuple[int, float, float]]]:
        """{text: (item, overlap, score) of all that it leaks} for texts whose word hashes follow each other in h."""
        p, found = self.params, {}
        known = self.terms(h)
        for text, a in zip(*(x.tolist() for x in self.passages(known, first)), strict=True):
            own = known[first[text] : first[text + 1]]
            passage = own[a : a + 2 * self.stride]
            for item, score in self.search(np.unique(passage[passage >= 0]).tolist(), p.threshold):
                reach = int(self.lengths[item])
                near = h[first[text] : first[text + 1]][max(0, a - reach) : a + 2 * self.stride + reach]
                overlap = self._overlap(near, self.wholes[item])
                if overlap >= p.overlap and all(self._overlap(near, part) >= p.part_overlap for part in self.parts[item]):
                    of = found.setdefault(text, {})
                    best = of.get(item, (0.0, 0.0))
                    of[item] = (max(best[0], overlap), max(best[1], score))
        return {text: [(i, o, s) for i, (o, s) in sorted(of.items())] for text, of in found.items()}

    @staticmethod
    def _overlap(h: np.ndarray, part: tuple[int, np.ndarray]) -> float:
        size, grams = part
        return float(np.isin(grams, _grams(h, size)).mean()) if len(grams) else 1.0


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text, n, terms) of items: their words and distinct terms."""
    for b in batches:
        n, terms = np.zeros(len(b), np.int64), [[]] * len(b)
        for at, h, first in _slice_hashes(b.column(1)):
            for k in range(len(first) - 1):
                own = h[first[k] : first[k + 1]]
                n[at + k], terms[at + k] = len(own), np.unique(own).view(np.int64).tolist()
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "text", "n", "terms"])


def indexes(benchmark: DataFrame, params: Params = Params()) -> Iterator[BlockMaxIndex]:
    """One index, or several in turn where the items' text is beyond ``index_bytes``; scores are those of one index of all items.

    For several, lengths and terms are counted over all items first, and each turn gets the counts of its own terms.
    Items without an id or a word are in no index; of equal ones one is.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    turns = max(1, -(-int(size) // params.index_bytes))
    if turns == 1:
        yield BlockMaxIndex(sorted((r.item_id, r.text) for r in items.collect()), params)
        return
    each = items.mapInArrow(_terms, "item_id long, text string, n long, terms array<long>").where("n > 0")
    all_ = each.agg(F.count("*").alias("items"), F.sum("n").alias("words"), F.max("n").alias("longest")).first()
    counts = cut(each.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c")))
    turn = F.pmod(F.xxhash64("item_id"), F.lit(turns))
    for k in range(turns):
        own = each.where(turn == k)
        held = own.select(F.explode("terms").alias("term")).distinct().join(counts, "term").toArrow()
        among = Among(all_["items"] or 0, all_["words"] or 0, all_["longest"] or 2, dict(zip(held["term"].to_numpy().view(np.uint64).tolist(), held["c"].to_pylist(), strict=True)))
        yield BlockMaxIndex(sorted((r.item_id, r.text) for r in own.select("item_id", "text").collect()), params, among)


def _found(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, items, overlaps, scores = [], [], [], []
            for at, h, first in _slice_hashes(b.column(1)):
                for k, leaked in index.value.leaks(h, first).items():
                    for item, overlap, score in leaked:
                        docs.append(b.column(0)[at + k].as_py())
                        items.append(index.value.ids[item])
                        overlaps.append(overlap)
                        scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.column(0).type), pa.array(items, pa.int64()), pa.array(overlaps, pa.float64()), pa.array(scores, pa.float64())], ["doc_id", "item_id", "overlap", "score"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, overlap, score) for every row of docs and every item that it leaks.

    Null and empty texts leak nothing, null, blank or id-less items are not leaked;
    items of one id and text count once.  Repeated rows and null ids have their rows
    each; empty tables give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, overlap double, score double"
    out = None
    for index in indexes(benchmark, params):
        one = rows.mapInArrow(_found(docs.sparkSession.sparkContext.broadcast(index)), schema)
        out = one if out is None else out.unionByName(one)
    return out


def _clean(index, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(len(b), bool)
            for at, h, first in _slice_hashes(b.column(column)):
                for k in index.value.leaks(h, first):
                    keep[at + k] = False
            yield b.filter(pa.array(keep))

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, params: Params = Params(), text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that leak no item; nothing is shuffled.

    Rows with null or empty text, null ids and repeated rows stay; empty tables give no rows, and without items all rows stay.
    """
    small_batches(docs.sparkSession)
    for index in indexes(benchmark, params):
        docs = docs.mapInArrow(_clean(docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text_col)), docs.schema)
    return docs
