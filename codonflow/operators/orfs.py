"""Open reading frames of transcripts: enumeration, their exons, phases, scores and choice."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonflow.functions import sequences as S

from .annotate import TRACKS, interval_sums, place_sequences

MODES = ("ALL", "LONGEST", "BEST_SCORE")
_TURN = str.maketrans("ACGT", "TGCA")
_START, _STOP = re.compile("(?=ATG)"), re.compile("(?=TAA|TAG|TGA)")
#: bases of sequences that are searched at once; longer ones, and those with other than ASCII letters, are searched alone
BASES = 1 << 18
#: numbers of the bases by byte, 4 for all else, and of codons by three of them
_BASE = np.full(256, 4, np.uint8)
_BASE[list(b"ACGTacgt")] = [0, 1, 2, 3] * 2
_ATG, _STOPS = 0 * 25 + 3 * 5 + 2, (3 * 25, 3 * 25 + 2, 3 * 25 + 2 * 5)


def reading_frames(seq: str, strand: str, min_codons: int = 25) -> list[tuple[int, int]]:
    """(begin, end), half-open on the given sequence: from every ATG to the first stop in its frame, the stop included."""
    seq = seq.upper()
    if strand == "-":
        seq = seq.translate(_TURN)[::-1]
    after: list[int | None] = [None, None, None]
    found, n = [], len(seq)
    marks = sorted([(m.start(), False) for m in _START.finditer(seq)] + [(m.start(), True) for m in _STOP.finditer(seq)], reverse=True)
    for at, stop in marks:
        if stop:
            after[at % 3] = at + 3
        elif (end := after[at % 3]) is not None and end - at >= 3 * min_codons:
            found.append((at, end) if strand != "-" else (n - end, n - at))
    return sorted(found)


def _frames_of(data: np.ndarray, upto: np.ndarray, back: np.ndarray, min_codons: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the sequence, begin, end) as ``reading_frames`` has them, of ASCII sequences that end at upto, back where they are read backward."""
    upto = np.concatenate(([0], upto))
    first, size = upto[:-1], np.diff(upto)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data))
    turned = back[owner]
    base = _BASE[data[np.where(turned, (2 * first + size - 1)[owner] - at, at)]]
    base[turned & (base < 4)] ^= 3
    codon = base[:-2] * np.uint8(25) + base[1:-1] * np.uint8(5) + base[2:]
    whole = owner[:-2] == owner[2:]
    begins, stops = np.flatnonzero((codon == _ATG) & whole), np.flatnonzero(np.isin(codon, _STOPS) & whole)
    found = [(np.zeros(0, np.int64),) * 2]
    for r in range(3):
        a, z = (x[(x - first[owner[x]]) % 3 == r] for x in (begins, stops))
        k = np.searchsorted(z, a)
        a, z = a[k < len(z)], z[k[k < len(z)]]
        ok = (owner[a] == owner[z]) & (z + 3 - a >= 3 * min_codons)
        found.append((a[ok], z[ok] + 3))
    a, z = (np.concatenate(x) for x in zip(*found, strict=True))
    row = owner[a]
    a, z = a - first[row], z - first[row]
    a, z = np.where(back[row], size[row] - z, a), np.where(back[row], size[row] - a, z)
    order = np.lexsort((z, a, row))
    return row[order], a[order], z[order]


def _frames(strands: list[str | None], seqs: pa.Array, min_codons: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, begin, end) of all reading frames of rows, by lots of rows."""
    seqs = seqs.cast(pa.large_string()).fill_null("")
    upto = np.frombuffer(seqs.buffers()[1], np.int64)[seqs.offset : seqs.offset + len(seqs) + 1]
    data = np.frombuffer(seqs.buffers()[2] or b"", np.uint8)
    back = np.array([s == "-" for s in strands], bool)
    a = 0
    while a < len(seqs):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + BASES, "right")) - 1)
        own = data[upto[a] : upto[z]]
        if len(own) > BASES or (len(own) and own.max() > 127):
            every = [(k, *x) for k in range(a, z) for x in reading_frames(seqs[k].as_py(), strands[k], min_codons)]
            yield tuple(np.array(every, np.int64).reshape(-1, 3).T)
        elif len(own) > 2:
            row, begin, end = _frames_of(own, upto[a + 1 : z + 1] - upto[a], back[a:z], min_codons)
            yield row + a, begin, end
        a = z


def spliced(exons: DataFrame, genome: DataFrame) -> DataFrame:
    """(file, tx_no, chrom, strand, seq) of exons(file, tx_no, chrom, strand, begin, end), 1-based: exons in order of place.

    genome(chrom, seq).  Transcripts without a strand or with an unknown chromosome are left out.
    """
    return spliced_pieces(exons, genome.withColumn("start", F.lit(1).cast("long")))


def spliced_pieces(exons: DataFrame, pieces: DataFrame, chunk: int = 1000) -> DataFrame:
    """The same as ``spliced`` for a genome in pieces(chrom, start, seq), 1-based, that do not overlap, in any number and length.

    Exons that transcripts share are cut out once.
    """
    known = exons.where(F.col("strand").isin("+", "-")).join(pieces.select("chrom").distinct(), "chrom", "left_semi").select("file", "tx_no", "chrom", "strand", "begin", "end")
    return _spliced(known, place_sequences(known, pieces, chunk))


def spliced_places(exons: DataFrame, places: DataFrame) -> DataFrame:
    """The same with what ``place_sequences`` gives for the exons; transcripts with an unknown chromosome are empty."""
    return _spliced(exons.where(F.col("strand").isin("+", "-")).select("file", "tx_no", "chrom", "strand", "begin", "end"), places)


def _spliced(known: DataFrame, places: DataFrame) -> DataFrame:
    rows = known.join(places, ["chrom", "begin", "end"], "left")
    rows = rows.select("file", "tx_no", "chrom", "strand", "begin", F.upper(F.coalesce("seq", F.lit(""))).alias("part"))
    groups = rows.groupBy("file", "tx_no", "chrom", "strand").agg(F.array_sort(F.collect_list(F.struct("begin", "part"))).alias("all"))
    return groups.select("file", "tx_no", "chrom", "strand", F.array_join(F.transform("all", lambda x: x["part"]), "").alias("seq"))


def find_orfs(transcripts: DataFrame, min_codons: int = 25) -> DataFrame:
    """(file, tx_no, strand, orf_begin, orf_end) of transcripts(file, tx_no, strand, seq), half-open from 0 on seq."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, begins, ends in _frames(b.column(2).to_pylist(), b.column(3), min_codons):
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in range(3)), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["file", "tx_no", "strand", "orf_begin", "orf_end"])

    kinds = dict(transcripts.dtypes)
    return transcripts.select("file", "tx_no", "strand", "seq").mapInArrow(run, f"file {kinds['file']}, tx_no {kinds['tx_no']}, strand string, orf_begin long, orf_end long")


def orf_exons(orfs: DataFrame, exons: DataFrame) -> DataFrame:
    """(.., chrom, exon_begin, exon_end, begin, end, phase): the parts of each ORF on its exons, 1-based.

    phase: bases at the 5' end of a part that belong to a codon begun before it.
    """
    order = Window.partitionBy("file", "tx_no").orderBy("begin")
    size = F.col("end") - F.col("begin") + 1
    placed = exons.select("file", "tx_no", "chrom", F.col("begin").alias("exon_begin"), F.col("end").alias("exon_end"), (F.sum(size).over(order) - size).alias("off"))
    rows = orfs.join(placed, ["file", "tx_no"])
    a = F.greatest(F.col("exon_begin"), F.col("exon_begin") + F.col("orf_begin") - F.col("off"))
    z = F.least(F.col("exon_end"), F.col("exon_begin") + F.col("orf_end") - F.col("off") - 1)
    rows = rows.withColumn("begin", a).withColumn("end", z).where("begin <= end").drop("off")
    return with_phases(rows, ["file", "tx_no", "orf_begin", "orf_end"])


def with_phases(cds: DataFrame, keys: list[str]) -> DataFrame:
    """cds(keys, strand, begin, end) with the phase of each part, from the bases of those before it in reading order."""
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("strand") == "-", -F.col("begin")).otherwise(F.col("begin"))).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("end") - F.col("begin") + 1).over(order), F.lit(0))
    return cds.withColumn("phase", F.pmod(3 - before % 3, F.lit(3)).cast("int"))


def score_orfs(parts: DataFrame, tracks: DataFrame, sizes: DataFrame) -> DataFrame:
    """parts with score_mean and power_mean of themselves, and ``orf_score``, ``orf_power`` of their ORF.

    score_mean: sum of score times power where both are known, by the sum of all power.
    Sums are differences of running sums at the ends of parts, whatever their length and however many ORFs share them.
    """
    keys = ["file", "tx_no", "orf_begin", "orf_end"]
    parts = parts.join(sizes.select("chrom", F.col("len").alias("chrom_len")), "chrom")
    number = S.track_frame("strand", "phase", "begin", "end", "chrom_len")
    parts = parts.withColumn("frame", F.element_at(F.array(*[F.lit(t) for t in TRACKS]), number + 1))
    rows = parts.join(interval_sums(parts, tracks), ["chrom", "frame", "begin", "end"]).select(*parts.columns, F.col("weighted").alias("__sp"), F.col("n_both").alias("__n"), F.col("power").alias("__pp"))
    rows = rows.withColumn("__b", F.col("end") - F.col("begin") + 1)
    of = Window.partitionBy(*keys)
    mean = lambda sp, n, pp: F.when(n > 0, F.try_divide(sp, pp))
    rows = rows.withColumn("score_mean", mean(F.col("__sp"), F.col("__n"), F.col("__pp"))).withColumn("power_mean", F.col("__pp") / F.col("__b"))
    rows = rows.withColumn("orf_score", mean(F.sum("__sp").over(of), F.sum("__n").over(of), F.sum("__pp").over(of))).withColumn("orf_power", F.sum("__pp").over(of) / F.sum("__b").over(of))
    return rows.select(*parts.drop("chrom_len").columns, "score_mean", "power_mean", "orf_score", "orf_power")


def choose(parts: DataFrame, mode: str = "LONGEST", min_score: float = 0.0) -> DataFrame:
    """The parts of the chosen ORFs: all with the least score, the longest of them, or that of the best score.

    Ties go to the smaller begin.  Scores are compared to nine decimals, as sums in another
    order differ in the last digits; ORFs without a score are never chosen.
    """
    if mode not in MODES:
        raise ValueError(f"no mode: {mode}")
    score = F.round("orf_score", 9)
    rows = parts.where(score >= min_score)
    if mode == "ALL":
        return rows
    return _ranked(rows, mode).where("__n = 1").drop("__n")


def _ranked(rows: DataFrame, mode: str) -> DataFrame:
    """rows with ``__n``, the number of their ORF among those of the transcript, the best first."""
    first = F.desc(F.col("orf_end") - F.col("orf_begin")) if mode == "LONGEST" else F.desc(F.round("orf_score", 9))
    return rows.withColumn("__n", F.dense_rank().over(Window.partitionBy("file", "tx_no").orderBy(first, "orf_begin", "orf_end")))


def evaluation_of(parts: DataFrame, mode: str, min_score: float, features: DataFrame) -> DataFrame:
    """As ``evaluation`` of what ``choose`` gives by mode and with the least score alone, from one pass over the parts."""
    found = choose(parts, "ALL", min_score)
    if mode != "ALL":
        found = _ranked(found, mode)
    else:
        found = found.withColumn("__n", F.lit(1))
    orfs = found.groupBy("file", "tx_no", "orf_begin", "orf_end").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("parts"), F.min("__n").alias("__n"))
    own = orfs.groupBy("file", "tx_no").agg(F.collect_list("parts").alias("every"), F.collect_list(F.when(F.col("__n") == 1, F.col("parts"))).alias("picked"))
    known = features.where("feature = 'CDS'").groupBy("file", "tx_no").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("known"))
    return _counts(features.where("feature = 'transcript'").select("file", "tx_no").join(known, ["file", "tx_no"], "left").join(own, ["file", "tx_no"], "left"))


def evaluation(chosen: DataFrame, found: DataFrame, features: DataFrame) -> DataFrame:
    """(transcripts, annotated, with_orf, with_choice, same, hit, missed) counts.

    same: the choice is the annotated coding sequence; hit: some ORF with the least score is.
    """
    cds = lambda df, keys: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("parts"))
    known = cds(features.where("feature = 'CDS'"), ["file", "tx_no"]).withColumnRenamed("parts", "known")
    picked = cds(chosen, ["file", "tx_no", "orf_begin", "orf_end"])
    picked = picked.groupBy("file", "tx_no").agg(F.collect_list("parts").alias("picked"))
    every = cds(found, ["file", "tx_no", "orf_begin", "orf_end"]).groupBy("file", "tx_no").agg(F.collect_list("parts").alias("every"))
    rows = features.where("feature = 'transcript'").select("file", "tx_no").join(known, ["file", "tx_no"], "left").join(picked, ["file", "tx_no"], "left").join(every, ["file", "tx_no"], "left")
    return _counts(rows)


def _counts(rows: DataFrame) -> DataFrame:
    same, hit = F.array_contains("picked", F.col("known")), F.array_contains("every", F.col("known"))
    return rows.agg(F.count("*").alias("transcripts"), F.count("known").alias("annotated"), F.count("every").alias("with_orf"), F.count("picked").alias("with_choice"),
        F.count_if(same).alias("same"), F.count_if(hit).alias("hit"), F.count_if(F.col("known").isNotNull() & ~F.coalesce(hit, F.lit(False))).alias("missed"))
