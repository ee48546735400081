"""Tracks of codon scores: power, raw scores, smoothing, coding regions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonflow.model.genetic import MISSING, base_ids
from codonflow.model.hmm import Hmm, HmmParameters, Pieces, fit_mixture, gap_sums, scan
from codonflow.model.likelihood import DECIBANS, branch_matrices, column_scores
from codonflow.model.species import Model

from .scoring import alignment_scores, branch_scores, dealt

#: codons of a piece of a segment, and cells of the grid (codons of the longest times pieces) that are worked on at once
PIECE, CELLS = 512, 1 << 18
#: positions of a bucket in which runs are looked for
BUCKET = 1_000_000
#: positions of an alignment whose codons are scored at once
STRETCH = 50_000
#: different lengths of gaps that are fitted on the driver
GAPS = 1 << 18
FRAMES = np.array(["+1", "+2", "+3", "-1", "-2", "-3"])


def _owned(alignments: DataFrame, behind: int) -> DataFrame:
    """alignments with ``beyond``: up to where earlier ones of their chromosome, by start and block, go, their last ``behind`` bases left out; null: there are none.

    A place that several alignments have is so the first one's alone.  Only places meet, in buckets of starts; how far
    earlier buckets reach is carried by one row a bucket.
    """
    end = F.col("start") + F.length(F.col("seqs")[0]) - 1 - behind
    rows = alignments.select("file", "block_id", "chrom", "start", end.alias("end")).withColumn("b", F.floor(F.col("start") / BUCKET))
    along = Window.partitionBy("chrom").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("chrom", "b").orderBy("start", "block_id", "file").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy("chrom", "b").agg(F.max("end").alias("r")).select("chrom", "b", F.max("r").over(along).alias("r"))
    reach = rows.join(each, ["chrom", "b"]).select("file", "chrom", "block_id", F.greatest(F.max("end").over(order), F.col("r")).alias("beyond"))
    return dealt(alignments.join(reach, ["file", "chrom", "block_id"]))


def _from(row: np.ndarray, start: int, beyond: float) -> np.ndarray:
    """What of a row that begins at start is behind ``beyond``."""
    return row[max(0, int(beyond) + 1 - start) :] if np.isfinite(beyond) else row


def _lots(b: pa.RecordBatch, model: Model, at: int) -> Iterator[tuple[int, list[str], int, float, np.ndarray]]:
    """(row, seqs, start, beyond, branch-length scores of the bases) of alignments whose last two columns are start and beyond."""
    starts, beyond = b.column(len(b.schema) - 2).to_pylist(), b.column(len(b.schema) - 1).to_pylist()
    for k in range(len(b)):
        seqs = b.column(at)[k].as_py()
        yield k, seqs, starts[k], np.nan if beyond[k] is None else beyond[k], branch_scores(model.tree, seqs)


def power_track(alignments: DataFrame, model: Model) -> DataFrame:
    """(chrom, pos, power): mean branch-length score of the three bases of codons whose first position is a multiple of 3.

    A codon whose bases are all an alignment's own is made where the alignment is read; only the bases at its
    ends, at most two at each, meet those of others.  Of a base that several alignments have the first one's score counts.
    """
    given = alignments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, _, start, beyond, bls in _lots(b, given.value, 1):
                own = _from(bls, start, beyond)
                first = start + len(bls) - len(own)
                ahead = min(-first % 3, len(own))
                n = (len(own) - ahead) // 3
                inner = own[ahead : ahead + 3 * n].reshape(n, 3)
                rest = np.concatenate((np.arange(ahead), np.arange(ahead + 3 * n, len(own))))
                pos = np.concatenate((first + ahead + 3 * np.arange(n), (first + rest) // 3 * 3)).astype(np.int64)
                total = np.concatenate((inner[:, 0] + inner[:, 1] + inner[:, 2], own[rest]))
                size = np.repeat([3, 1], [n, len(rest)])
                if len(pos):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(pos), k))), pa.array(pos), pa.array(total), pa.array(size)], names=["chrom", "pos", "total", "n"])

    rows = _owned(alignments, 0).select("chrom", "seqs", F.col("start").cast("long").alias("start"), F.col("beyond").cast("double").alias("beyond")).mapInArrow(run, "chrom string, pos long, total double, n long")
    whole = rows.where("n = 3").select("chrom", "pos", (F.col("total") / 3).alias("power"))
    met = rows.where("n = 1").groupBy("chrom", "pos").agg(F.avg("total").alias("power"), F.count("*").alias("n")).where("n = 3")
    return whole.unionByName(met.select("chrom", "pos", "power"))


def codon_power(bases: DataFrame) -> DataFrame:
    """(chrom, pos, total): sum of the branch-length scores of three bases from every position on."""
    rows = bases.select("chrom", (F.col("start") + F.col("nth")).alias("pos"), "bls").dropDuplicates(["chrom", "pos"])
    # the bases of one stretch meet in one bucket, with two more of the next
    rows = rows.withColumn("bucket", F.floor(F.col("pos") / 100_000))
    halo = rows.where("pos % 100000 < 2").withColumn("bucket", F.col("bucket") - 1)
    order = Window.partitionBy("chrom", "bucket").orderBy("pos")
    rows = rows.unionByName(halo)
    rows = rows.withColumn("b1", F.lead("bls", 1).over(order)).withColumn("b2", F.lead("bls", 2).over(order)).withColumn("p2", F.lead("pos", 2).over(order))
    return rows.where("p2 = pos + 2 and floor(pos / 100000) = bucket").select("chrom", "pos", (F.col("bls") + F.col("b1") + F.col("b2")).alias("total"))


def raw_tracks(alignments: DataFrame, model: Model, threshold: float = 0.1) -> DataFrame:
    """(chrom, frame, pos, score, power) of all codons with enough power, pos the first base on the forward strand.

    A codon is dropped if the branch-length scores of its bases sum to less than three
    times the threshold.  A codon's bases are all in its alignment, so scores and power are made where the alignment is
    read, STRETCH positions at once; of a codon that several alignments have the first one's counts.
    """
    given = alignments.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        ready = [branch_matrices(m.tree, r) for r in (m.coding, m.noncoding)]
        for b in batches:
            lens = b.column(2).to_pylist()
            for k, seqs, start, beyond, bls in _lots(b, m, 1):
                bases = np.stack([base_ids(s) for s in seqs], 1)
                total = bls[:-2] + bls[1:-1] + bls[2:]
                skip = len(total) - len(_from(total, start, beyond))
                keep = skip + np.flatnonzero(total[skip:] >= 3 * threshold)
                for lot in np.split(keep, range(STRETCH, len(keep), STRETCH)):
                    if not len(lot):
                        continue
                    three = np.stack([bases[lot + j] for j in range(3)], 2).astype(np.int64)
                    back = np.where(three < 4, 3 - three, 4)[..., ::-1]
                    both = np.concatenate([np.where((x == 4).any(2), MISSING, x @ np.array([16, 4, 1])) for x in (three, back)])
                    (lc, _), (ln, _) = (column_scores(m.tree, r, both, matrices=p) for r, p in zip((m.coding, m.noncoding), ready, strict=True))
                    pos = start + lot
                    frame = np.concatenate(((pos - 1) % 3, (lens[k] - pos + 1) % 3 + 3))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(2 * len(lot), k))), pa.array(FRAMES[frame]), pa.array(np.tile(pos, 2)), pa.array(DECIBANS * (lc - ln)), pa.array(np.tile(total[lot] / 3, 2))], names=["chrom", "frame", "pos", "score", "power"])

    rows = _owned(alignments, 2).select("chrom", "seqs", F.col("chrom_len").cast("long").alias("len"), F.col("start").cast("long").alias("start"), F.col("beyond").cast("double").alias("beyond"))
    return rows.mapInArrow(run, "chrom string, frame string, pos long, score double, power double")


def segments(track: DataFrame, keys: tuple[str, ...] = ("chrom", "frame"), step: int = 3, name: str = "segment") -> DataFrame:
    """track with ``segment``: the first pos of the contiguous run, a step apart, that a row is in.

    Runs are found inside buckets of positions; a window over one row a bucket carries
    them from one to the next, so that a chromosome is as many tasks as it has buckets.
    Rows with a null in a key or pos are left out; a place that occurs twice begins a run anew.
    """
    rows = track.withColumn("__b", F.floor(F.col("pos") / BUCKET))
    order = Window.partitionBy(*keys, "__b").orderBy("pos")
    new = F.col("pos") - F.lag("pos").over(order) != step
    rows = rows.withColumn("__own", F.when(new, F.col("pos")))
    rows = rows.withColumn("__own", F.last("__own", ignorenulls=True).over(order))
    each = rows.groupBy(*keys, "__b").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.max("__own").alias("inner"))
    along = Window.partitionBy(*keys).orderBy("__b")
    each = each.withColumn("fresh", F.when(F.coalesce(F.col("lo") - F.lag("hi").over(along) != step, F.lit(True)), F.col("lo")))
    carried = F.last(F.coalesce("inner", "fresh"), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    each = each.select(*keys, "__b", F.coalesce("fresh", carried).alias("__in"))
    return rows.join(each, [*keys, "__b"]).select(*track.columns, F.coalesce("__own", "__in").alias(name))


def _scores(codons: pa.ListArray, compat: bool) -> list[np.ndarray]:
    x = codons.flatten().field("score").to_numpy(zero_copy_only=False).astype(float)
    x = np.round(x, 3) if compat else x
    return np.split(x, np.cumsum(np.diff(codons.offsets.to_numpy()))[:-1]) if len(codons) else []


def _grids(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Pieces, numbered, in lots of like length whose grid has at most CELLS cells."""
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, CELLS // max(1, int(sizes[order[at]])))
        yield order[at : at + n]
        at += n


def _summaries(hmm: Hmm, compat: bool, width: int):
    """Products of pieces: rows (keys, segment, piece, codons) without codons, with the three arrays of 16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = _scores(b.column(width + 2), compat)
            first = b.column(width + 1).to_numpy() == 0
            for lot in _grids(np.array([len(x) for x in scores])):
                pieces = Pieces(hmm, [scores[k] for k in lot], first[lot])
                lists = [pa.array(x.reshape(len(lot), 16).tolist()) for x in (pieces.products(), *pieces.best_products())]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(lot)) for c in range(width + 2)), *lists], names=[*b.schema.names[: width + 2], "products", "best", "place"])

    return run


def _smoothed(hmm: Hmm, compat: bool, width: int):
    """Rows of codons of pieces (keys, segment, piece, codons, before, after, ways, last); without the latter a piece is a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = _scores(b.column(width + 2), compat)
            pos = np.split(b.column(width + 2).flatten().field("pos").to_numpy(), np.cumsum([len(x) for x in scores])[:-1]) if scores else []
            piece = b.column(width + 1).to_numpy()
            known = b.column(width + 3).is_valid().to_numpy(zero_copy_only=False)
            state = [np.tile(np.array(x), (len(b), 1)) for x in ([1.0] * 4, [1.0] * 4, [0] * 4)]
            for c in range(3):
                if known.any():
                    state[c][known] = np.array([x for x in b.column(width + 3 + c).to_pylist() if x is not None])
            last = b.column(width + 6).fill_null(-1).to_numpy()
            for lot in _grids(np.array([len(x) for x in scores])):
                pieces = Pieces(hmm, [scores[k] for k in lot], ~known[lot] | (piece[lot] == 0))
                cut = known[lot].any()
                p = pieces.posteriors(state[0][lot], state[1][lot]) if cut else pieces.posteriors()
                came = pieces.best(state[2][lot]) if cut else pieces.best()
                path = pieces.rows(pieces.paths(came, np.where(last[lot] < 0, pieces.ends.argmax(1), last[lot])))
                odds = [_odds(x) for x in pieces.rows(p)]
                take = pa.array(np.repeat(lot, [len(x) for x in path]))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(width + 1)), pa.array(np.concatenate([pos[k] for k in lot])), pa.array(np.concatenate(odds)), pa.array(np.concatenate(path).astype(np.int32))], names=[*b.schema.names[: width + 1], "pos", "log_odds", "state"])

    return run


def smooth(track: DataFrame, hmm: Hmm, compat: bool = True, keys: tuple[str, ...] = ("chrom", "frame")) -> DataFrame:
    """(keys, segment, pos, log_odds, state) of track(keys, pos, score).

    compat: scores are rounded to three decimals first.  Segments are cut into pieces of PIECE
    codons, and many pieces are worked on side by side.  What a piece of a longer segment needs
    of the others comes from a scan over three small matrices a piece: forward and backward
    values, and the best path's value and state where pieces meet.  So the result is that of
    whole segments, of any length, and paths are the same, ties included.

    Rows with a null in a key, pos or score are left out, which ends a segment there.
    """
    rows = segments(track.where(F.col("score").isNotNull()), keys)
    rows = rows.withColumn("nth", ((F.col("pos") - F.col("segment")) / 3).cast("long")).withColumn("piece", F.floor(F.col("nth") / PIECE))
    own = [*keys, "segment"]
    pieces = rows.groupBy(*own, "piece").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("score").cast("double").alias("score")))).alias("codons"))
    kinds = dict(track.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", segment long, "
    cut = rows.where(F.col("nth") == PIECE).select(*own).distinct()
    sums = pieces.join(cut, own, "left_semi").mapInArrow(_summaries(hmm, compat, len(keys)), f"{head} piece long, products array<double>, best array<long>, place array<long>")

    def along(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("piece", ignore_index=True)
        products, best, place = (np.stack(part[c].to_list()).reshape(-1, 4, 4) for c in ("products", "best", "place"))
        before, after, ways, last = scan(hmm, products, best, place)
        return part[[*own, "piece"]].assign(before=list(before), after=list(after), ways=list(ways), last=last.astype("int32"))

    ends = sums.groupBy(*own).applyInPandas(along, f"{head} piece long, before array<double>, after array<double>, ways array<long>, last int")
    return pieces.join(ends, [*own, "piece"], "left").mapInArrow(_smoothed(hmm, compat, len(keys)), f"{head} pos long, log_odds double, state int")


def regions(smoothed: DataFrame, compat: bool = True, keys: tuple[str, ...] = ("chrom", "frame")) -> DataFrame:
    """(keys, begin, end, log_odds): coding runs of the best path, half-open from 0, with the largest odds in them.

    compat: segments of one codon have none, and neither have those of two, both coding.
    Runs are found like segments, bucket by bucket.
    """
    own = [*keys, "segment"]
    rows = smoothed.where("state = 0")
    if compat:
        short = smoothed.groupBy(*own).agg(F.count("*").alias("n"), F.count_if(F.col("state") == 0).alias("coding")).where("n = 1 or (n = 2 and coding = 2)")
        rows = rows.join(short.select(*own), own, "left_anti")
    runs = segments(rows, tuple(own), name="run").groupBy(*own, "run").agg((F.min("pos") - 1).alias("begin"), (F.max("pos") + 2).alias("end"), F.max("log_odds").alias("log_odds"))
    return runs.select(*keys, "begin", "end", "log_odds")


def mean_smoothed(alignments: DataFrame, model: Model, hmm: Hmm) -> DataFrame:
    """alignments without seqs and with ``phylo``: the mean log odds of an alignment's codons after smoothing; null without a codon.

    An alignment is one segment, scored and smoothed in the task that reads it.
    """
    given = alignments.sparkSession.sparkContext.broadcast(model)
    at = alignments.columns.index("seqs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[float | None] = [None] * len(b)
            for first, scores in alignment_scores(given.value, b.column(at).to_pylist()):
                sizes = np.array([len(x) for x in scores])
                for lot in _grids(sizes):
                    lot = lot[sizes[lot] > 0]
                    if len(lot):
                        pieces = Pieces(hmm, [scores[k] for k in lot])
                        for k, p in zip(lot.tolist(), pieces.rows(pieces.posteriors()), strict=True):
                            found[first + k] = float(_odds(p).mean())
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(b.columns) if k != at), pa.array(found, pa.float64())], names=[*(n for n in b.schema.names if n != "seqs"), "phylo"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in alignments.dtypes if n != "seqs")
    return alignments.mapInArrow(run, f"{kinds}, phylo double" if kinds else "phylo double")


def _odds(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.clip(np.log10(p / (1 - p)), -15, 15)


_EXON = ["chrom", "strand", "phase"]


def _clusters(exons: DataFrame) -> DataFrame:
    """exons with ``cluster``, the start of the first of those that reach into each other, directly or by others.

    Bucket by bucket of starts; how far earlier exons reach, and the cluster that is open, are carried by one row a bucket.
    """
    rows = exons.withColumn("__b", F.floor(F.col("start") / BUCKET))
    order = Window.partitionBy(*_EXON, "__b").orderBy("start", "end")
    along = Window.partitionBy(*_EXON).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*_EXON, "__b").agg(F.max("end").alias("__r")).select(*_EXON, "__b", F.max("__r").over(along).alias("__r"))
    before = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__r"))
    rows = rows.join(reach, [*_EXON, "__b"]).withColumn("__new", F.when(before.isNull() | (F.col("start") > before), F.col("start")))
    rows = rows.withColumn("__own", F.last("__new", ignorenulls=True).over(order))
    opened = rows.groupBy(*_EXON, "__b").agg(F.max("__new").alias("__o")).select(*_EXON, "__b", F.last("__o", ignorenulls=True).over(along).alias("__o"))
    return rows.join(opened, [*_EXON, "__b"]).select(*exons.columns, F.coalesce("__own", "__o").alias("cluster"))


def _longest(exons: DataFrame) -> DataFrame:
    """The longest exon of each chromosome, strand, phase and start; those that end before they start overlap with nothing and all stay."""
    odd = F.when(F.col("end") < F.col("start"), F.col("end"))
    rows = exons.groupBy(*_EXON, "start", odd.alias("odd")).agg(F.max("end").alias("end"), F.count("*").alias("n"))
    times = F.when(F.col("odd").isNull(), F.lit(1)).otherwise(F.col("n"))
    return rows.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*_EXON, "start", "end")


def without_overlaps(exons: DataFrame) -> DataFrame:
    """exons(chrom, strand, phase, start, end) without overlaps by chromosome, strand and phase.

    In order of place, of two that overlap the longer stays, of equal ones the earlier.
    Of exons with one start the longest is what the others leave, so only that goes on.
    Only exons of one cluster meet in a task, which passes over them in order and holds one.
    Rows with a null are left out.
    """
    rows = _clusters(_longest(exons.select(*_EXON, "start", "end").dropna()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = last = None
        for b in batches:
            kept = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, (a, z) = (*row[:3], row[5]), row[3:5]
                if last is not None and key == own and last[4] >= a:
                    last = row if z - a > last[4] - last[3] else last
                else:
                    kept += [last] if last is not None else []
                    own, last = key, row
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(x, c.type) for x, c in zip(list(zip(*kept, strict=True))[:5], b.columns, strict=False)], names=b.schema.names[:5])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], c.type) for x, c in zip(last[:5], b.columns, strict=False)], names=b.schema.names[:5])

    kinds = dict(exons.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*_EXON, "start", "end"])
    return rows.repartition(*_EXON, "cluster").sortWithinPartitions(*_EXON, "cluster", "start", "end").mapInArrow(run, schema)


def exon_gaps(exons: DataFrame, compat: bool = True) -> DataFrame:
    """(gap): bases between neighbours of one chromosome, strand and phase; compat: of every other pair.

    Neighbours meet in buckets of starts; what comes next and how many came before is carried by one row a bucket.
    """
    rows = exons.withColumn("__b", F.floor(F.col("start") / BUCKET))
    order = Window.partitionBy(*_EXON, "__b").orderBy("start", "end")
    along = Window.partitionBy(*_EXON).orderBy("__b")
    each = rows.groupBy(*_EXON, "__b").agg(F.min("start").alias("first"), F.count("*").alias("n"))
    each = each.select(*_EXON, "__b", F.lead("first").over(along).alias("after"), (F.sum("n").over(along) - F.col("n")).alias("before"))
    rows = rows.withColumn("next", F.lead("start").over(order)).withColumn("nth", F.row_number().over(order)).join(each, [*_EXON, "__b"])
    gap = F.coalesce("next", "after") - F.col("end") - 1
    rows = rows.where(gap > 0)
    if compat:
        rows = rows.where("(nth + before) % 2 = 1")
    return rows.select(gap.alias("gap"))


def exon_totals(exons: DataFrame, genome_length: int) -> DataFrame:
    """(bases, exons, prior, codons): coding bases, exons, the share of the six frames that is coding, mean codons of an exon."""
    own = F.col("end") - F.col("start") + 1
    rows = exons.agg(F.coalesce(F.sum(own), F.lit(0)).alias("bases"), F.count("*").alias("exons"))
    return rows.select("bases", "exons", (F.col("bases") / F.lit(float(genome_length)) / 6).alias("prior"), (F.col("bases") / F.col("exons") / 3).alias("codons"))


def _gap_sums(tau: np.ndarray, w: np.ndarray):
    """One row a task: ``gap_sums`` of its rows (gap, n), flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(6)
        for b in batches:
            found += gap_sums(b.column(0).to_numpy().astype(float), b.column(1).to_numpy(), tau, w).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([found.tolist()])], names=["sums"])

    return run


def gap_mixture(gaps: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mean lengths in codons, weights) of the mixture fitted on all gaps, equal ones once with their number.

    Up to GAPS different ones are fitted on the driver; of more, each round adds up six numbers a task.
    """
    each = gaps.groupBy("gap").agg(F.count("*").alias("n")).sortWithinPartitions("gap").persist(StorageLevel.DISK_ONLY)
    different, n = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if different <= GAPS:
        rows = each.toArrow().sort_by("gap")
        here, times = rows["gap"].to_numpy().astype(float), rows["n"].to_numpy()
        found = fit_mixture(lambda tau, w: gap_sums(here, times, tau, w), n)
    else:
        found = fit_mixture(lambda tau, w: np.sum([r.sums for r in each.mapInArrow(_gap_sums(tau, w), "sums array<double>").collect()], 0).reshape(2, 3), n)
    each.unpersist()
    return found


def estimate_hmm(exons: DataFrame, genome_length: int, compat: bool = True) -> HmmParameters:
    """Parameters from coding exons, the mixture from all of their gaps."""
    kept = without_overlaps(exons).persist(StorageLevel.DISK_ONLY)  # read for totals and for gaps
    totals = exon_totals(kept, genome_length).first()
    lengths, weights = gap_mixture(exon_gaps(kept, compat))
    kept.unpersist()
    return HmmParameters(float(totals.prior), float(totals.codons), tuple(weights.tolist()), tuple(lengths.tolist()))
