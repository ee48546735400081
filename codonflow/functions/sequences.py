"""Column functions over sequences; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codonflow.model.genetic import AMINO

#: what a sequence may hold besides bases
_MISSING = ".-NnRYSWKMBDHVryswkmbdhv"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base_id(base: Column | str) -> Column:
    """0 to 3 for A, C, G, T in either case, 4 for gaps, N and ambiguous letters; another character raises an error."""
    up = F.upper(col(base))
    known = F.call_function("locate", up, F.lit("ACGT"))
    return F.when(known > 0, known - 1).when(F.call_function("locate", up, F.lit(_MISSING.upper())) > 0, 4).otherwise(
        F.raise_error(F.concat(F.lit("no nucleotide: "), col(base)))).cast("int")


def complement(seq: Column | str) -> Column:
    return F.translate(col(seq), "ACGTacgt", "TGCAtgca")


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(complement(seq))


def codons(seq: Column | str) -> Column:
    """Codons of frame 0 as strings, a rest of one or two bases left out."""
    s = col(seq)
    n = F.floor(F.length(s) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(s, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def codon_id(codon: Column | str) -> Column:
    """16a + 4b + c; 64 if a base is missing."""
    up = F.upper(col(codon))
    ids = [F.call_function("locate", F.substring(up, k + 1, 1), F.lit("ACGT")) for k in range(3)]
    return F.when((F.length(up) < 3) | (F.least(*ids) == 0), 64).otherwise((ids[0] - 1) * 16 + (ids[1] - 1) * 4 + ids[2] - 1).cast("int")


def codon_text(id_: Column | str) -> Column:
    i = col(id_)
    base = lambda x: F.substring(F.lit("ACGT"), x.cast("int") + 1, F.lit(1))
    return F.when(i >= 64, "NNN").otherwise(F.concat(base(F.floor(i / 16)), base(F.floor(i / 4) % 4), base(i % 4)))


def amino(id_: Column | str) -> Column:
    return F.substring(F.lit(AMINO), col(id_) + 1, F.lit(1))


def peptide(seq: Column | str) -> Column:
    return F.array_join(F.transform(codons(seq), lambda c: amino(codon_id(c))), "")


def is_stop(codon: Column | str) -> Column:
    return F.upper(col(codon)).isin("TAA", "TAG", "TGA")


def frame_skip(strand: Column | str, frame, start, length, chrom_len) -> Column:
    """Bases to leave out in front so that codons of a frame (1 to 3) begin; not more than there are."""
    ahead = F.pmod(col(frame) - col(start), F.lit(3))
    back = F.pmod(col(frame) - (col(chrom_len) - (col(start) + col(length)) + 2), F.lit(3))
    return F.least(F.when(col(strand) == "-", back).otherwise(ahead), col(length)).cast("int")


def decibans(coding, noncoding) -> Column:
    return (col(coding) - col(noncoding)) * 10 / F.log(F.lit(10.0))


def log_odds(p, most: float = 15.0) -> Column:
    """log10(p / (1 - p)) within -most and most."""
    x = col(p)
    return F.when(x < 10**-most, -most).when(x > 1 - 10**-most, most).otherwise(F.log10(x / (1 - x)))


def emission(score) -> Column:
    """Likelihood ratio of a score in decibans."""
    return F.pow(F.lit(10.0), col(score) / 10)


def colour(odds) -> Column:
    """Shade of a region: 210 below 1, 0 above 7, darker by 30 a step between."""
    x = col(odds)
    return F.when(x < 1, 210).when(x > 7, 0).otherwise(210 - 30 * F.floor(x)).cast("int")


def transcript_id(attributes) -> Column:
    return F.regexp_extract(col(attributes), r'(transcript_id[ ="]*[A-Za-z0-9/._-]+[";]*)', 1)


def attribute_style(attributes) -> Column:
    """'gtf' if the first of blank and '=' is a blank, else 'gff'."""
    return F.when(F.regexp_extract(col(attributes), "[ =]", 0) == " ", "gtf").otherwise("gff")


def track_frame(strand, phase, begin, end, chrom_len) -> Column:
    """Number, 0 to 5, of the track that a coding exon of 1-based begin and end reads."""
    return F.when(col(strand) == "-", F.pmod(col(chrom_len) - col(end) + col(phase), F.lit(3)) + 3).otherwise(F.pmod(col(phase) + col(begin) - 1, F.lit(3))).cast("int")


def place_key(chrom, begin, end, strand) -> Column:
    return F.concat(col(chrom), F.lit(":"), col(begin).cast("string"), F.lit("-"), col(end).cast("string"), F.lit("#"), col(strand))


def fixed(value, digits: int) -> Column:
    """The number with digits decimals, rounded as exact binary values are: of two equally near ones to the even one.

    Ties are the odd multiples of 2 ** -(digits + 1) alone.
    """
    x = col(value).cast("double")
    tie = (F.abs(x) * 2.0 ** (digits + 1)) % 2 == 1
    below = tie & (F.floor(F.abs(x) * 10.0**digits) % 2 == 0)
    return F.format_string(f"%.{digits}f", F.when(below, x * (1 - 1e-9)).otherwise(x))


def trimmed(value, digits: int = 3) -> Column:
    """The number with digits decimals, from single precision, without trailing zeros but one decimal at least."""
    return F.regexp_replace(fixed(col(value).cast("float"), digits), r"(\.\d+?)0+$", "$1")
