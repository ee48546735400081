"""Search of sequences in genomes: shared words as seeds, and banded gapped alignments of what they point to.

Genomes come in pieces, so no row holds more of a chromosome than a piece.  Equal queries are
searched once.  Words that a genome has more often than ``common`` times are no seeds, so that a
repeat with a third of all places meets nothing; of a query's seeds the diagonals they share are
counted in bands, and the bands with most seeds are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .annotate import place_sequences
from .seeds import chosen_bands

#: what a cell of the traceback says: where the best score comes from, and whether a gap goes on
_STOP, _MATCH, _IN_QUERY, _IN_TARGET = range(4)
_LOW = -(10**8)
#: cells of the grid (candidates x rows x width of the band) that are worked on at once
CELLS = 1 << 24


@dataclass(frozen=True)
class Scoring:
    """A gap of n bases costs ``gap`` + n times ``more``."""

    match: int = 2
    mismatch: int = 3
    gap: int = 5
    more: int = 2


@dataclass(frozen=True)
class Aligned:
    score: int
    begin: int  # on the target, from 0
    row: str  # the target's bases in the columns of the query, - where there are none


def _codes(text: str, size: int, fill: int) -> np.ndarray:
    out = np.full(size, fill, np.uint8)
    raw = np.frombuffer(text.upper().encode("ascii", "replace"), np.uint8)
    out[: len(raw)] = raw
    return out


def align(pairs: list[tuple[str, str]], offsets: list[int], half: int, scoring: Scoring = Scoring()) -> list[Aligned]:
    """The best local alignment of each query in its target, by the diagonals within ``half`` of offset (place on the target less place on the query).

    All pairs advance together, a base of the queries at a time, with the band as a vector.  Bases
    other than A, C, G and T match nothing.  Of equal scores the alignment that ends first counts.
    """
    if not pairs:
        return []
    n, width, many = max(len(q) for q, _ in pairs), 2 * half + 1, len(pairs)
    sizes = np.array([len(q) for q, _ in pairs])
    query = np.stack([_codes(q, n, 0) for q, _ in pairs])
    off = np.array(offsets)
    lengths = np.array([len(t) for _, t in pairs])
    room = n + width + int(np.abs(off).max()) + int(lengths.max())
    target = np.stack([_codes(t, room, 1) for _, t in pairs])
    for x, none in ((query, 0), (target, 1)):
        x[~np.isin(x, np.frombuffer(b"ACGT", np.uint8))] = none
    steps = np.arange(width)
    best, down = np.zeros((many, width), np.int32), np.full((many, width), _LOW, np.int32)
    trace, jump = np.zeros((many, n, width), np.uint8), np.zeros((many, n, width), np.uint8)
    top, where = np.zeros(many, np.int64), np.zeros((many, 2), np.int64)
    open_, more = scoring.gap + scoring.more, scoring.more
    row = np.arange(many)[:, None]
    for i in range(n):
        j = i + off[:, None] - half + steps  # place on the target of each cell
        inside = (j >= 0) & (j < lengths[:, None]) & (i < sizes[:, None])
        same = query[:, i, None] == target[row, np.clip(j, 0, room - 1)]
        match = best + np.where(same, scoring.match, -scoring.mismatch)
        # a base of the query without one of the target: from the cell above, one diagonal up
        above = np.concatenate((best[:, 1:], np.full((many, 1), _LOW, np.int32)), 1) - open_
        longer = np.concatenate((down[:, 1:], np.full((many, 1), _LOW, np.int32)), 1) - more
        new_down = np.maximum(above, longer)
        here = np.where(inside, np.maximum(np.maximum(match, new_down), 0), 0)
        # bases of the target without one of the query: along the row; the best begin of such a gap is a running maximum
        reach = np.maximum.accumulate((here + more * steps).astype(np.int64) * width + steps, 1)
        along = np.concatenate((np.full((many, 1), _LOW), reach[:, :-1] // width - more * steps[1:] - scoring.gap), 1).astype(np.int32)
        jump[:, i, 1:] = reach[:, :-1] % width
        full = np.where(inside, np.maximum(here, along), 0).astype(np.int32)
        kind = np.where(full <= 0, _STOP, np.where(full == match, _MATCH, np.where(full == new_down, _IN_QUERY, _IN_TARGET)))
        trace[:, i] = kind | (longer > above) * 4
        best, down = full, np.where(inside, new_down, _LOW).astype(np.int32)
        at = full.argmax(1)
        better = full[np.arange(many), at] > top
        top = np.where(better, full[np.arange(many), at], top)
        where[better] = np.stack((np.full(many, i), at), 1)[better]
    return [_walk(trace[k], jump[k], int(top[k]), *where[k].tolist(), offsets[k] - half, pairs[k]) for k in range(many)]


def _walk(trace: np.ndarray, jump: np.ndarray, score: int, i: int, d: int, low: int, pair: tuple[str, str]) -> Aligned:
    """The alignment that ends at row i and diagonal d, from its end back."""
    query, target = pair
    row, begin = ["-"] * len(query), 0
    while score > 0 and i >= 0 and (kind := trace[i, d] & 3) != _STOP:
        if kind == _MATCH:
            begin = i + low + d
            row[i] = target[begin].upper()
            i -= 1
        elif kind == _IN_TARGET:
            d = int(jump[i, d])
        else:
            while trace[i, d] & 4:
                i, d = i - 1, d + 1
            i, d = i - 1, d + 1
    return Aligned(score, begin, "".join(row))


def _overlapping(genomes: DataFrame, k: int) -> DataFrame:
    """Pieces with the first k - 1 bases behind them, of however many pieces these are, so that no word is lost where pieces meet."""
    bases = F.least(F.length("seq"), F.lit(k - 1))
    heads = genomes.where("start > 1").select("genome", "chrom", F.explode(F.transform(F.sequence(F.lit(1), bases), lambda i: F.struct((F.col("start") + i - 1).alias("p"), F.substring(F.col("seq"), i, F.lit(1)).alias("b")))).alias("h")).select("genome", "chrom", "h.p", "h.b")
    rows = genomes.withColumn("end", F.col("start") + F.length("seq")).where(F.length("seq") > 0)
    asked = rows.select("genome", "chrom", "start", F.explode(F.sequence(F.col("end"), F.col("end") + k - 2)).alias("p"))
    tails = asked.join(heads, ["genome", "chrom", "p"]).groupBy("genome", "chrom", "start").agg(F.array_sort(F.collect_list(F.struct("p", "b"))).alias("t"))
    tail = F.array_join(F.transform(F.filter("t", lambda x, i: x["p"] == F.col("end") + i), lambda x: x["b"]), "")
    return rows.join(tails, ["genome", "chrom", "start"], "left").select("genome", "chrom", "start", F.concat("seq", F.coalesce(tail, F.lit(""))).alias("seq"))


def _aligned(half: int, scoring: Scoring):
    """Rows (query, genome, chrom, low, offset, seq, target) with the alignment of seq in target, which begins at low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            query, target, low, offset = (b.column(c).to_pylist() for c in (5, 6, 3, 4))
            order = sorted(range(len(b)), key=lambda k: len(query[k]))
            at = 0
            while at < len(order):
                z = at + 1
                while z < len(order) and (z + 1 - at) * len(query[order[z]]) * (2 * half + 1) <= CELLS:
                    z += 1
                lot = order[at:z]
                found = align([(query[k], target[k]) for k in lot], [offset[k] - low[k] for k in lot], half, scoring)
                hit = [(k, a) for k, a in zip(lot, found, strict=True) if a.score > 0]
                take = pa.array([k for k, _ in hit], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(3)), pa.array([low[k] + a.begin for k, a in hit], pa.int64()), pa.array([a.score for _, a in hit], pa.int64()), pa.array([a.row for _, a in hit], pa.string())], names=["query", "genome", "target", "place", "score", "seq"])
                at = z

    return run


def gapped_search(queries: DataFrame, genomes: DataFrame, k: int = 12, least_seeds: int = 2, common: int = 1000, half: int = 32, bands: int = 4, scoring: Scoring = Scoring()) -> DataFrame:
    """hits(query, genome, target, place, score, seq): the best local alignment of each query in each genome.

    queries(query, seq), genomes(genome, chrom, start, seq) in pieces, 1-based.  place, from 0, is where
    the alignment begins; seq has the target's bases in the columns of the query, ``-`` where it has none.

    k, least_seeds: length of a seed, and how many a band of ``half`` diagonals has to have (bands overlap by
    half); common: places in a genome from which on a word is no seed; bands: how many bands of a query and
    genome are aligned, those of most seeds, ties to the smaller chromosome and place.  Alignments
    keep within ``half`` diagonals of the middle of their band.

    Null and short sequences find nothing; bases other than A, C, G and T match nothing.  Repeated
    queries get a hit each; of equal scores the smaller chromosome and place counts.  Empty tables give no rows.
    """
    distinct = queries.where(F.length("seq") >= k).select(F.upper("seq").alias("seq")).distinct()
    distinct = distinct.withColumn("own", F.unhex(F.sha2("seq", 256)))  # seeds carry this, not the sequence
    chosen = chosen_bands(distinct, genomes, _overlapping(genomes, k), k, least_seeds, common, half, bands).join(distinct, "own")
    # bands b and b + 1 of diagonals: the middle is where the second begins
    offset = (F.col("band") + 1) * half
    low = F.greatest(F.lit(0), offset - half)
    places = chosen.select("seq", "genome", "chrom", low.alias("low"), offset.alias("offset"), (low + 1).alias("begin"), (offset + half + F.length("seq")).alias("end")).where("begin <= end")
    pieces = genomes.select(F.struct("genome", "chrom").alias("chrom"), "start", "seq")
    asked = places.select(F.struct("genome", "chrom").alias("chrom"), "begin", "end")
    windows = place_sequences(asked, pieces, 8192).select("chrom.genome", "chrom.chrom", "begin", "end", F.col("seq").alias("target"))
    rows = places.join(windows, ["genome", "chrom", "begin", "end"]).select("seq", "genome", "chrom", "low", "offset", F.col("seq").alias("own"), "target")
    spark = queries.sparkSession  # an alignment takes long for its bytes: rows that would be few tasks by size are dealt over all cores
    rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    kinds = dict(genomes.dtypes)
    hits = rows.mapInArrow(_aligned(half, scoring), f"query string, genome {kinds['genome']}, target string, place long, score long, seq string")
    best = Window.partitionBy("query", "genome").orderBy(F.desc("score"), "target", "place", "seq")
    hits = hits.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r").withColumnRenamed("query", "__q")
    return queries.select("query", F.upper("seq").alias("__q")).join(hits, "__q").select("query", "genome", "target", "place", "score", "seq")
