"""Writers of text formats: lines are made by expressions, put in order, and written by Spark's text sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codonflow.functions import sequences as S
from codonflow.operators.tracks import segments

#: what annotations are called in attributes, and who made them
PREFIX, MAKER = "coding", "codonflow"


def number(x, digits: int = 6):
    c = S.col(x)
    return F.when(c.isNull() | F.isnan(c), "nan").otherwise(S.fixed(c, digits))


def output_path(path: str, suffix: str | None = None) -> str:
    """``name.codonflow.ext`` for ``name.ext``; with a suffix, that behind the name."""
    if suffix:
        return f"{path}{suffix}"
    head, dot, tail = path.rpartition(".")
    return f"{head}.{MAKER}.{tail}" if dot and "/" not in tail else f"{path}.{MAKER}"


def score_lines(scores: DataFrame, ancestral: bool = False, phylo: bool = True) -> DataFrame:
    """(line_no, line) of scores(seq, start, end, strand, phylo, anc, bls), a header first."""
    names = ["seq", "start", "end", "strand", *["score"] * phylo, *["anc-score"] * ancestral, "bls-score"]
    cols = [F.col("seq"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("strand"), *[number("phylo")] * phylo, *[number("anc")] * ancestral, number("bls")]
    body = scores.select(F.monotonically_increasing_id().alias("line_no"), F.concat_ws("\t", *cols).alias("line"))
    head = scores.sparkSession.createDataFrame([(-2, f"# scores by {MAKER}"), (-1, "\t".join(names))], "line_no long, line string")
    return head.unionByName(body)


def fixed_step_lines(track: DataFrame, digits: int = 3, runs: bool = False) -> DataFrame:
    """(chrom, pos, nth, line) of track(chrom, pos, score): a header where a run of steps begins, before its first value; runs: and ``segment``, where its run begins."""
    head = F.format_string("fixedStep chrom=%s start=%d step=3 span=3", "chrom", "pos")
    value = S.trimmed("score", digits)
    rows = segments(track.select("chrom", "pos", "score"), ("chrom",))
    return rows.select("chrom", "pos", *["segment"] * runs, F.posexplode(F.when(F.col("pos") == F.col("segment"), F.array(head, value)).otherwise(F.array(value))).alias("nth", "line"))


def bed_lines(regions: DataFrame) -> DataFrame:
    """(chrom, begin, line) of regions(chrom, frame, begin, end) in nine columns; the colour is 0."""
    b, e = F.col("begin").cast("string"), F.col("end").cast("string")
    name = F.concat("chrom", F.lit(":"), (F.col("begin") + 1).cast("string"), F.lit("-"), e)
    return regions.select("chrom", "begin", F.concat_ws("\t", "chrom", b, e, name, F.lit("0"), F.substring("frame", 1, 1), b, e, F.lit("0,0,0")).alias("line"))


def _attribute(style, name: str, value):
    return F.when(style == "gtf", F.concat(F.lit(f' {name} "'), value, F.lit('";'))).otherwise(F.concat(F.lit(f";{name}="), value))


def annotated_lines(annotated: DataFrame, weighted: bool = True, prefix: str = PREFIX) -> DataFrame:
    """(file, line_no, line): original lines, with two attributes on transcripts and coding exons."""
    style = S.attribute_style("attrs")
    score = f"{prefix}_score_weighted_mean" if weighted else f"{prefix}_mean"
    tail = F.concat(_attribute(style, score, number("score_mean", 3)), _attribute(style, f"{prefix}_power_mean", number("power_mean", 3)))
    own = F.col("feature").isin("transcript", "CDS")
    line = F.when(own, F.concat(F.when(style == "gtf", F.col("line")).otherwise(F.regexp_replace("line", r";\s*$", "")), tail)).otherwise(F.col("line"))
    return annotated.select("file", "line_no", line.alias("line"))


def predicted_lines(features: DataFrame, parts: DataFrame, maker: str = MAKER, prefix: str = PREFIX) -> DataFrame:
    """(file, tx_no, line_no, nth, line): the lines of transcripts with a choice, coding exons replaced by the chosen ones."""
    id_ = F.when(F.col("feature") == "transcript", F.coalesce(F.nullif(S.transcript_id("attrs"), F.lit("")), F.col("attrs")))
    own = features.where(F.col("feature").isNull() | (F.col("feature") != "CDS"))
    own = own.select("file", "tx_no", "line_no", "line", id_.alias("id"), (F.col("feature") == "transcript").alias("whole"), F.lit(1).alias("kind"), *(F.lit(None).cast("long").alias(c) for c in ("orf_begin", "orf_end", "begin")), F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("tail"))
    head = F.concat_ws("\t", "chrom", F.lit(maker), F.lit("CDS"), F.col("begin").cast("string"), F.col("end").cast("string"), F.lit("."), "strand", F.col("phase").cast("string"))
    tail = F.concat(F.lit(f";{prefix}_score_weighted_mean="), number("score_mean", 3), F.lit(f";{prefix}_power_mean="), number("power_mean", 3))
    new = parts.select("file", "tx_no", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit(None).cast("string").alias("id"), F.lit(False).alias("whole"), F.lit(0).alias("kind"), *(F.col(c).cast("long").alias(c) for c in ("orf_begin", "orf_end", "begin")), head.alias("head"), tail.alias("tail"))
    # all of a transcript meets once: its lines and its parts, the parts first
    of = Window.partitionBy("file", "tx_no")
    rows = own.unionByName(new).withColumn("nth", F.row_number().over(of.orderBy("kind", "orf_begin", "orf_end", "begin")) + 1_000_000)
    rows = rows.withColumn("first", F.min("kind").over(of)).withColumn("top", F.max(F.when(F.col("whole"), F.col("line_no"))).over(of)).withColumn("id", F.min("id").over(of))
    part = F.col("kind") == 0
    rows = rows.where((F.col("first") == 0) & (~part | F.col("top").isNotNull()))
    line = F.when(part, F.concat_ws("\t", "head", F.concat("id", "tail"))).otherwise(F.col("line"))
    return rows.select("file", "tx_no", F.when(part, F.col("top")).otherwise(F.col("line_no")).alias("line_no"), F.when(part, F.col("nth")).otherwise(0).alias("nth"), line.alias("line"))


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """Text in order: ranges of lines, each sorted and written as one file, whose names ascend."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(path)
