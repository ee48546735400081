"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

Statistics are made for every document; trees are fitted on the driver on a bounded
sample of labelled rows (``Fit.most_rows``), flattened into arrays of complete
binary trees, and every document is scored by a vectorised walk over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import cut, small_batches

#: classes of bytes whose shares are statistics
CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\v\f", "\n", ".", ",;:", "!?", "|", "#$%&*@^~=+<>", "()[]{}", "\"'`", "-_/\\")
_CLASS = np.full(256, len(CLASSES) + 1, np.int64)  # other control characters
_CLASS[0x80:] = len(CLASSES)
for _k, _chars in enumerate(CLASSES):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
N_CLASSES = len(CLASSES) + 2
_END = np.zeros(256, bool)
_END[np.frombuffer(b".!?", np.uint8)] = True
_UP = np.zeros(256, bool)
_UP[0x41:0x5B] = True
N_FEATURES = N_CLASSES + 16


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of statistics) for slices of rows; a null or empty text has zeros."""
    for at, to, data, offsets in words.slices(texts):
        n = to - at
        size = np.diff(offsets)
        own = np.repeat(np.arange(n), size)
        shares = np.bincount(own * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
        lines = shares[:, 4] + 1
        starts, ends, first = words.spans(data, offsets, words.SPACED)
        h, length, count = words.hashes(words.lowered(data), starts, ends), ends - starts, np.diff(first)
        doc = np.repeat(np.arange(n), count)
        by_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
        again = np.zeros(len(h), bool)
        again[1:] = h[1:] == h[:-1]
        again[first[:-1][count > 0]] = False
        one = np.maximum(count, 1)
        mean = by_doc(length) / one
        rows = np.zeros((n, N_FEATURES))
        rows[:, :N_CLASSES] = shares / np.maximum(size, 1)[:, None]
        extra = rows[:, N_CLASSES:]
        extra[:, 0] = np.log1p(count)
        extra[:, 1] = mean
        extra[:, 2] = np.sqrt(np.maximum(by_doc(length.astype(float) ** 2) / one - mean**2, 0))
        extra[:, 3] = by_doc(again) / one
        extra[:, 4] = by_doc(_END[data[ends - 1]]) / one
        extra[:, 5] = by_doc(_UP[data[starts]] & _UP[data[ends - 1]]) / one
        extra[:, 6] = by_doc(_UP[data[starts]]) / one
        extra[:, 7] = by_doc(length == 1) / one
        extra[:, 8] = by_doc(length > 20) / one
        extra[:, 9] = np.log1p(count / lines)
        extra[:, 10] = np.log1p(lines)
        pair = h[1:] ^ (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) if len(h) > 1 else np.zeros(0, np.uint64)
        for k in range(n):
            a, z = first[k], first[k + 1]
            if z > a:
                _, c = np.unique(h[a:z], return_counts=True)
                extra[k, 11] = len(c) / (z - a)
                extra[k, 12] = c.max() / (z - a)
                extra[k, 13] = float((c[c > 1]).sum()) / (z - a)
                if z - a > 1:
                    extra[k, 14] = len(np.unique(pair[a : z - 1])) / (z - a - 1)
            raw = data[offsets[k] : offsets[k + 1]]
            if len(raw):
                breaks = np.flatnonzero(raw == 10)
                extra[k, 15] = np.log1p(np.diff(np.concatenate(([-1], breaks, [len(raw)]))).max())
        yield at, rows


@dataclass(frozen=True)
class Fit:
    most_rows: int = 20_000  # labelled rows that trees are fitted on, by hash of the id
    trees: int = 120
    depth: int = 4
    rate: float = 0.12
    bins: int = 64
    least_weight: float = 1.0
    ridge: float = 2.0


class Trees:
    """Complete binary trees of one depth, flattened: node k of a tree has the children 2k+1 and 2k+2."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.bias, self.feature, self.threshold, self.leaf = bias, feature, threshold, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.bias)
        row, inner = np.arange(len(x)), self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[row, f[at]] > t[at])
            margin += leaf[at - inner]
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, how: Fit = Fit()) -> Trees:
    """Logistic boosting on binned statistics.  Without both classes the score is the share of ones (0.5 without rows)."""
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    inner = 2**how.depth - 1
    if len(y) == 0 or y.min() == y.max():
        return Trees(bias, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, how.bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    flat = binned + np.arange(m) * how.bins
    margin = np.full(n, bias)
    trees = []
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)
        at = np.zeros(n, np.int64)
        for level in range(how.depth):
            base, width = 2**level - 1, 2**level
            cell = ((at - base)[:, None] * (m * how.bins) + flat).ravel()
            sums = lambda v: np.bincount(cell, weights=np.repeat(v, m), minlength=width * m * how.bins).reshape(width, m, how.bins).cumsum(2)  # noqa: E731, B023
            gl, hl = sums(g), sums(h)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + how.ridge) + (ga - gl) ** 2 / (ha - hl + how.ridge) - ga**2 / (ha + how.ridge)
            gain[(hl < how.least_weight) | (ha - hl < how.least_weight)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), how.bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[base + k], threshold[base + k] = j, cuts[j][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        end = at - inner
        gs, hs = np.bincount(end, g, inner + 1), np.bincount(end, h, inner + 1)
        leaf = -how.rate * gs / (hs + how.ridge)
        margin += leaf[end]
        trees.append((feature, threshold, leaf))
    return Trees(bias, *(np.stack(c) for c in zip(*trees, strict=True)))


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at, rows in features(b.column(1)):
            held = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), N_FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(rows)], held], ["doc_id", "x"])


def _score(trees: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.score(x))], ["doc_id", "score"])

    return run


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, mod 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(stats: DataFrame, labels: DataFrame, how: Fit = Fit()) -> Trees:
    """Trees fitted on labelled rows of stats(doc_id, x) that aren't held out.

    Null labels teach nothing; several labels of a document count by their mean, 1 from a half on.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    rows = stats.where(~held_out()).join(known, "doc_id").select("doc_id", "x", "y")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    n = rows.count()
    if n > how.most_rows:
        rows = rows.where(place < int(how.most_rows / n * (1 << 20)))
    got = sorted(rows.orderBy(place, "doc_id", "x").limit(how.most_rows + how.most_rows // 10).collect(), key=lambda r: (r.doc_id, list(r.x)))
    x = np.array([r.x for r in got]).reshape(len(got), N_FEATURES)
    return fit(x, np.array([r.y for r in got]), how)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, how: Fit = Fit()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    score is that of the whole text alone: equal texts have equal scores.  Null and
    empty texts are scored as texts of zeros.  Without labels every score is 0.5, with
    one class the share of ones.  Repeated rows and null ids are returned each; an
    empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    stats = cut(docs.mapInArrow(_statistics, f"doc_id {kind}, x array<double>"))
    trees = train(stats, labels, how)
    out = stats.mapInArrow(_score(trees), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(trees: Trees, column: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(column)
            scores = [trees.score(x) for _, x in features(texts)]
            yield b.filter(pa.array(np.concatenate(scores) >= threshold if scores else np.zeros(0, bool)))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, how: Fit = Fit()) -> DataFrame:
    """The rows of docs, with all their columns, that ``classify`` predicts 1 for; texts are not shuffled.

    Null and empty texts are scored as texts of zeros; null ids teach nothing, repeated rows stay or go together;
    an empty table gives no rows, and without labels, where all scores are 0.5, all rows stay.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    stats = cut(rows.mapInArrow(_statistics, f"doc_id {kind}, x array<double>"))
    trees = train(stats, labels, how)
    return docs.mapInArrow(_keep(trees, docs.columns.index(text_col), threshold), docs.schema)
