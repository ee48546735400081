"""Resampling of documents towards a target by hashed n-grams: counts, gains, and a merge of sorted runs.

Both corpora are counted into buckets of crc32 over runs of words, task by task into one array,
so that a task sends at most one row a bucket.  The log ratio of the two is an array again,
by which a second scan scores every document.  A Gumbel number of the id turns
scores into a draw without replacement: the highest ones.

The draw: an exact histogram of scores says how many documents score more than any value,
and so at which score it ends, and cuts the scores into ranges of bounded size.  Every task
sorts what can be drawn into runs, cuts them at the ranges and into blocks.  The
blocks of a range meet in one task ordered by their first keys, as an external merge
would read them: a tournament tree of runs gives out the least, and a block is
read when no open run has a smaller key.  So a task holds a block of each run that overlaps, a
range knows its first rank, and the last one stops at the exact draw count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, parts, small_batches
from .words import PLAIN, lowered, slices, spans

BUCKETS = 10_000
#: rows of a sorted run, of a block of it, and of a range of scores that one task merges
RUN, BLOCK, RANGE = 1 << 18, 4096, 1 << 20
_LAST = np.iinfo(np.int64).max  # where a null id stands
_U32 = np.uint32


def _crc_tables(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(one byte's step, what k zero bytes make of each byte of a crc for k up to most)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ _U32(0xEDB88320), step >> 1)
    shift = np.zeros((most + 1, 4, 256), np.uint32)
    for k in range(4):
        shift[0, k] = np.arange(256, dtype=np.uint32) << _U32(8 * k)
    for k in range(1, most + 1):
        shift[k] = step[shift[k - 1] & 0xFF] ^ (shift[k - 1] >> _U32(8))
    return step, shift


#: bytes of a word from which on it is hashed by itself
LONG = 64
_STEP, _SHIFT = _crc_tables(LONG)
_SPACE = _U32(zlib.crc32(b" "))


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each span: a byte of all that are open at a time."""
    sizes = ends - starts
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    open_, k = np.flatnonzero(sizes <= LONG), 0
    while len(open_ := open_[sizes[open_] > k]):
        now = crc[open_]
        crc[open_] = _STEP[(now ^ data[starts[open_] + k]) & 0xFF] ^ (now >> _U32(8))
        k += 1
    crc ^= _U32(0xFFFFFFFF)
    for w in np.flatnonzero(sizes > LONG).tolist():
        crc[w] = zlib.crc32(data[starts[w] : ends[w]])
    return crc


def _shifted(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """What crcs become by zero bytes, at most LONG."""
    out = _SHIFT[by, 0, crc & 0xFF]
    for k in range(1, 4):
        out = out ^ _SHIFT[by, k, (crc >> _U32(8 * k)) & 0xFF]
    return out


def pair_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc32 of each word, a space and the next word, from those of the words: crc(AB) is crc(A) shifted by B, and crc(B)."""
    if len(crc) < 2:
        return np.zeros(0, np.uint32)
    head = _shifted(crc[:-1], np.ones(len(crc) - 1, np.int64)) ^ _SPACE
    sizes = (ends - starts)[1:]
    out = _shifted(head, np.minimum(sizes, LONG)) ^ crc[1:]
    for w in np.flatnonzero(sizes > LONG).tolist():
        out[w] = zlib.crc32(data[starts[w + 1] : ends[w + 1]], int(head[w]))
    return out


def features(texts: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, buckets of words, row of each, buckets of pairs, row of each) of slices of rows; nulls are empty."""
    for at, to, data, offsets in slices(texts):
        low = lowered(data)
        starts, ends, first = spans(low, offsets, PLAIN)
        crc = word_crcs(low, starts, ends)
        row = np.repeat(np.arange(to - at), np.diff(first))
        inside = row[1:] == row[:-1]
        pair = pair_crcs(low, starts, ends, crc)[inside]
        yield at, to, crc % _U32(buckets), row, pair % _U32(buckets), row[1:][inside]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts.  A task sends its sums, the driver gets one number a bucket."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, one, _, two, _ in features(b.column(0), buckets):
                total += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    sums = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(buckets, np.int64)
    out[sums["bucket"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of how much more likely a bucket is in the target), smoothed by one a bucket."""
    b = float(len(source))
    above, below = float(source.sum()) + b, float(target.sum()) + b
    return np.floor(1000 * np.log((target + 1.0) * above / ((source + 1.0) * below))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's features, 0 without one."""
    given = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = given.value
        for b in batches:
            words, count, total = (np.zeros(len(b), np.int64) for _ in range(3))
            for at, to, one, row, two, row2 in features(b.column(1), len(own)):
                n = to - at
                words[at:to] = np.bincount(row, minlength=n)
                count[at:to] = words[at:to] + np.bincount(row2, minlength=n)
                before = lambda bucket, r: np.diff(np.concatenate(([0], np.cumsum(own[bucket])))[np.searchsorted(r, np.arange(n + 1))])  # noqa: E731, B023
                total[at:to] = before(one, row) + before(two, row2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(count), pa.array(total // np.maximum(count, 1))], names=["doc_id", "n_words", "n_features", "weight"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(id_col, seed: int):
    """floor(1000 g) of a Gumbel number g by the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


# --- the draw
class Bounds:
    """Ranges of keys (-score, id), ascending: where each begins, and into how many slices one of equal keys is dealt."""

    def __init__(self, bounds: list[tuple[int, int]], slices_: list[int]):
        self.keys = [np.array(x, np.int64) for x in zip(*bounds, strict=True)]
        self.slices = np.array(slices_, np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.slices)))  # number of each range's first slice

    def cuts(self, neg: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Where the ranges begin in a sorted run."""
        b_neg, b_id = self.keys
        at, end = np.searchsorted(neg, b_neg, "left"), np.searchsorted(neg, b_neg, "right")
        for k in np.flatnonzero(b_id > np.iinfo(np.int64).min).tolist():
            at[k] += np.searchsorted(ids[at[k] : end[k]], b_id[k], "left")
        return np.concatenate((at, [len(neg)]))


class Tournament:
    """The least head of runs: every inner node of a tree keeps the winner of its two, so that a new head plays its own path only."""

    def __init__(self, seats: int = 1):
        self.seats = seats
        self.heads: list[tuple | None] = [None] * seats
        self.free = list(range(seats))[::-1]
        self._won = [-1] * seats + list(range(seats))

    @property
    def winner(self) -> int:
        return self._won[1]

    def seat(self, head: tuple) -> int:
        """Seats one more run; twice the seats, if none is free."""
        if not self.free:
            heads, n = self.heads, self.seats
            self.__init__(2 * n)
            self.heads[:n], self.free = heads, list(range(n, 2 * n))[::-1]
            for node in range(self.seats - 1, 0, -1):
                self._match(node)
        at = self.free.pop()
        self.replace(at, head)
        return at

    def replace(self, seat: int, head: tuple | None) -> None:
        """The run there has this head now; None: it is at its end."""
        self.heads[seat] = head
        if head is None:
            self.free.append(seat)
        node = (seat + self.seats) // 2
        while node:
            self._match(node)
            node //= 2

    def _match(self, node: int) -> None:
        a, b = self._won[2 * node], self._won[2 * node + 1]
        x, y = self.heads[a], self.heads[b]
        self._won[node] = b if x is None or y is not None and y < x else a


def _merge(blocks: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
    """Entries of sorted blocks in order, in lists; blocks come in order of their first entries.

    A block is opened when the least head of the open ones passes its first entry.
    """
    coming = next(blocks, None)
    tree, opened, live = Tournament(2), {}, 0
    while live or coming is not None:
        while coming is not None and (not live or coming[0] <= tree.heads[tree.winner]):
            opened[tree.seat(coming[0])] = coming, 0
            live += 1
            coming = next(blocks, None)
        out: list[tuple] = []
        while live and len(out) < BLOCK:
            k = tree.winner
            head = tree.heads[k]
            if coming is not None and head >= coming[0]:
                break
            out.append(head)
            block, at = opened[k]
            if at + 1 < len(block):
                opened[k] = block, at + 1
                tree.replace(k, block[at + 1])
            else:
                del opened[k]
                live -= 1
                tree.replace(k, None)
        if out:
            yield out


_FIELDS = ("neg", "id", "n_features", "weight")


def _runs(given, run_rows: int, block: int):
    """Sorted runs of a task's rows, cut at the ranges and into blocks: (part, first_neg, first_id, and a list for each field)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds: Bounds = given.value
        held, n, nth = [], 0, 0

        def sorted_run() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            order = np.lexsort(cols[::-1])
            cols = [c[order] for c in cols]
            edges, spread = bounds.cuts(cols[0], cols[1]), nth * 2_654_435_761 + int(cols[3].sum())
            out = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                part = int(bounds.first[k]) + spread % int(bounds.slices[k])
                for a in range(edges[k], edges[k + 1], block):
                    z = min(a + block, edges[k + 1])
                    out.append((part, a, z))
            part, a, z = (np.array(x, np.int64) for x in zip(*out, strict=True))
            offsets = np.concatenate((a, z[-1:])).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(c)) for c in cols]
            batch = pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(cols[0][a]), pa.array(cols[1][a]), *lists], names=["part", "first_neg", "first_id", *_FIELDS])
            for k in range(0, len(batch), 16):
                yield batch.slice(k, 16)

        for b in batches:
            if len(b):
                held.append([b.column(0).to_numpy(), b.column(1).fill_null(_LAST).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()])
                n += len(b)
            if n >= run_rows:
                yield from sorted_run()
                held, n, nth = [], 0, nth + 1
        if n:
            yield from sorted_run()

    return run


def _ranked(given):
    """Ranks of each part's entries by a merge of its blocks, which come in order of part and first key; null beyond the draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, draw = given.value
        rows = (x for b in batches for x in zip(*(b.column(k).to_pylist() if k == 0 else b.column(k) for k in (0, 3, 4, 5, 6)), strict=True))
        ahead = next(rows, None)

        def own(part: int) -> Iterator[list[tuple]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == part:
                yield list(zip(*(c.values.to_numpy().tolist() for c in ahead[1:]), strict=True))
                ahead = next(rows, None)

        while ahead is not None:
            part = ahead[0]
            at = before[part]
            for entries in _merge(own(part)):
                neg, ids, n, w = (np.array(x, np.int64) for x in zip(*entries, strict=True))
                rank = at + 1 + np.arange(len(ids))
                at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == _LAST), pa.array(n), pa.array(w), pa.array(-neg), pa.array(rank, mask=rank > draw)], names=["doc_id", "n_features", "weight", "score", "rank"])

    return run


def _bounds(rows: DataFrame, counts: dict[int, int]) -> Bounds:
    """Ranges of at most about RANGE rows of the scores in counts; a score with more is cut by ids, and one id with more into slices."""
    keys, slices_, held = [], [], RANGE
    heavy = [s for s, n in counts.items() if n > RANGE]
    inner: dict[int, list[int]] = {}
    for s in heavy:
        share = [k / (counts[s] // RANGE + 1) for k in range(1, counts[s] // RANGE + 1)]
        id_ = F.coalesce(F.col("doc_id"), F.lit(int(_LAST)))
        inner[s] = rows.where(F.col("score") == s).agg(F.percentile_approx(id_, share, 10_000).alias("q")).first()["q"]
    low = int(np.iinfo(np.int64).min)
    for s in sorted(counts, reverse=True):
        if s in inner:
            cuts = [low, *inner[s]]
            for x in dict.fromkeys(cuts):
                keys.append((-s, x))
                slices_.append(cuts.count(x))
            # what has the id of a cut of several stands alone, the next id begins another range
            for x in {x for x in inner[s] if inner[s].count(x) > 1 and x < _LAST}:
                keys.append((-s, x + 1))
                slices_.append(1)
            held = RANGE
        else:
            if held + counts[s] > RANGE:
                keys.append((-s, low))
                slices_.append(1)
                held = 0
            held += counts[s]
    most: dict[tuple[int, int], int] = {}
    for k, n in zip(keys, slices_, strict=True):
        most[k] = max(n, most.get(k, 1))
    return Bounds(sorted(most), [most[k] for k in sorted(most)])


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank of those drawn, from 1, else null.

    Drawn are ``percent`` hundredths (rounded down) of the rows with at least ``least_words``
    words, those of the highest scores, ties to the smaller id, a null id last; rows that
    have score and id alike in order of n_features and weight.

    Null and blank texts have no feature and weight 0.  Repeated rows are drawn each for
    itself.  An empty target makes all buckets equally likely there; empty docs give no
    rows; other columns are ignored.  The driver gets a number a bucket, a number for each
    score that can be drawn (scores are whole thousandths of a logarithm) and one a range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    with Scratch(spark) as scratch:
        rows = weights(docs, gain, id_col, text_col)
        rows = scratch.keep(rows.withColumn("score", F.col("weight") + gumbel("doc_id", seed)))
        eligible = rows.where(F.col("n_words") >= least_words)
        found = {int(r["score"]): int(r["n"]) for r in eligible.groupBy("score").agg(F.count("*").alias("n")).collect()}
        draw, least, seen = sum(found.values()) * percent // 100, None, 0
        for s in sorted(found, reverse=True):
            if seen >= draw:
                break
            least, seen = s, seen + found[s]
        out = ["doc_id", "n_features", "weight", "score"]
        if least is None:
            return scratch.result(rows.select(*out, F.lit(None).cast("long").alias("rank")))
        can = eligible.where(F.col("score") >= least)
        bounds = spark.sparkContext.broadcast(_bounds(can, {s: n for s, n in found.items() if s >= least}))
        kinds = ", ".join(f"{f} array<bigint>" for f in _FIELDS)
        runs = can.select((-F.col("score")).alias("neg"), F.col("doc_id").cast("long").alias("id"), "n_features", "weight")
        blocks = scratch.keep(runs.mapInArrow(_runs(bounds, RUN, BLOCK), f"part int, first_neg long, first_id long, {kinds}"))
        sizes = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum(F.size("id")).alias("n")).collect()}
        before, at = {}, 0
        for part in sorted(sizes):
            before[part], at = at, at + sizes[part]
        given = spark.sparkContext.broadcast((before, draw))
        dealt = blocks.repartition(min(parts(spark), len(sizes)), "part").sortWithinPartitions("part", "first_neg", "first_id")
        ranked = dealt.mapInArrow(_ranked(given), "doc_id long, n_features long, weight long, score long, rank long")
        ranked = ranked.withColumn("doc_id", F.col("doc_id").cast(dict(rows.dtypes)["doc_id"]))
        rest = rows.where((F.col("n_words") < least_words) | (F.col("score") < least)).select(*out, F.lit(None).cast("long").alias("rank"))
        return scratch.result(ranked.unionByName(rest))

