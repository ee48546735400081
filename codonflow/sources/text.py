"""Readers of text formats as DataFrames: alignments, tracks, gene models, genomes and small tables.

Every reader takes a path that Spark can open and splits its input as Spark's text
source does; what lines owe to lines before them, in other splits too, comes from ``splits``.
Rows are told by the byte at which they begin, whatever the splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codonflow.model.rates import Rates, parse_exchange
from codonflow.model.tree import Tree, parse_newick

from .bigwig import read_big_wig
from .splits import marked_lines, sequence_pieces


def whole_text(spark: SparkSession, path: str) -> str:
    """A small file as one string, by Spark's own reader."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one file is needed: {path}")
    return rows[0][0]


def newick(spark: SparkSession, path: str) -> Tree:
    return parse_newick(whole_text(spark, path))


def exchange_model(spark: SparkSession, path: str) -> Rates:
    return parse_exchange(whole_text(spark, path))


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(file, line_no, line); line_no is the byte at which a line begins."""
    return marked_lines(spark, path).select("file", F.col("at").alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def maf_rows(spark: SparkSession, path) -> DataFrame:
    """(file, block_id, row_no, species, chrom, start0, size, strand, src_size, text): the s lines of every block.

    Blocks are the records between lines that begin with ``a``, so a file splits between
    them and a block is never cut.  Other lines are left out; block_id is the byte at which a block begins.
    """
    blocks = marked_lines(spark, path, sep="\na").select("file", F.col("at").alias("block_id"), F.col("line").alias("value"))
    blocks = blocks.select("file", "block_id", F.posexplode(F.split("value", r"\r?\n")).alias("row_no", "line"))
    token = F.split(F.trim("line"), r"[ \t]+")
    rows = blocks.where(F.col("line").rlike(r"^s[ \t]")).select("file", "block_id", "row_no", token.alias("t"))
    return rows.select("file", "block_id", "row_no", F.substring_index(F.col("t")[1], ".", 1).alias("species"),
        F.when(F.instr(F.col("t")[1], ".") > 0, F.expr("substring(t[1], instr(t[1], '.') + 1)")).otherwise("").alias("chrom"),
        F.col("t")[2].cast("long").alias("start0"), F.col("t")[3].cast("long").alias("size"), F.col("t")[4].alias("strand"), F.col("t")[5].cast("long").alias("src_size"), F.col("t")[6].alias("text"))


def _is_value(lines) -> np.ndarray:
    return pc.match_substring_regex(lines, r"^\s*[-+0-9.naNife]").to_numpy(zero_copy_only=False).astype(np.int64)


def track(spark: SparkSession, path, frame: str) -> DataFrame:
    """(chrom, frame, pos, score, span) of a fixedStep file: pos is the first base of a step, counted from 1; a step covers span bases.

    A header holds for the values behind it in its file, in whatever split they are.  Lines
    before the first header, empty lines and others that are no number are left out.
    """
    lines = marked_lines(spark, path, lambda x: pc.starts_with(x, "fixedStep"), _is_value)
    rows = lines.where(F.col("mark").isNotNull() & ~F.col("line").startswith("fixedStep") & F.col("line").rlike(r"^\s*[-+0-9.naNife]"))
    field = lambda name, usual: F.coalesce(F.nullif(F.regexp_extract("mark", rf"\b{name}=(\S+)", 1), F.lit("")), F.lit(usual))
    return rows.select(field("chrom", "").alias("chrom"), F.lit(frame).alias("frame"), (field("start", "1").cast("long") + F.col("since") * field("step", "1").cast("long")).alias("pos"), F.trim(F.regexp_replace("line", "\r$", "")).cast("double").alias("score"), field("span", "1").cast("int").alias("span"))


FRAMES = ("+1", "+2", "+3", "-1", "-2", "-3", "power")


def big_wig_track(spark: SparkSession, path: str, frame: str, **asked) -> DataFrame:
    """(chrom, frame, pos, score, span) of a bigWig file or a folder of them."""
    rows = read_big_wig(spark, path, **asked)
    return rows.select("chrom", F.lit(frame).alias("frame"), (F.col("start") + 1).alias("pos"), F.col("value").cast("double").alias("score"), (F.col("end") - F.col("start")).cast("int").alias("span"))


def track_set(spark: SparkSession, path: str) -> DataFrame:
    """The seven tracks of a set, from the path of the one with ``+1`` in its name: bigWig, Parquet, or fixedStep text."""
    if "+1" not in path:
        raise ValueError("the path of a track set has +1 in it")
    head, _, tail = path.rpartition("+1")
    out = None
    for frame in FRAMES:
        own = f"{head}{frame}{tail}"
        if is_big_wig(path):
            one = big_wig_track(spark, own, frame)
        elif tail.endswith(".parquet"):
            one = spark.read.parquet(own).select("chrom", F.lit(frame).alias("frame"), "pos", "score", F.lit(3).alias("span"))
        else:
            one = track(spark, own, frame)
        out = one if out is None else out.unionByName(one)
    return out


def is_big_wig(path: str) -> bool:
    return path.lower().endswith((".bw", ".bigwig"))


def gene_models(spark: SparkSession, path) -> DataFrame:
    """(file, line_no, tx_no, chrom, feature, begin, end, strand, phase, attrs, line), every line of a file.

    tx_no numbers the transcripts of a file; lines before the first belong to it, others
    to the transcript above them.  Comments have no columns.  line_no is the byte at which a line begins.
    """
    lines = marked_lines(spark, path, lambda x: pc.match_substring_regex(x, r"^[^#\t][^\t]*\t[^\t]*\ttranscript\t([^\t]*\t){5}"), counted=True)
    lines = lines.select("file", F.col("at").alias("line_no"), F.greatest(F.lit(1).cast("long"), "marks").alias("tx_no"), F.regexp_replace("line", "\r$", "").alias("line"))
    t = F.split("line", "\t")
    rows = lines.select("file", "line_no", "tx_no", "line", F.when(~F.col("line").startswith("#") & (F.size(t) >= 9), t).alias("t"))
    return rows.select("file", "line_no", "tx_no", F.col("t")[0].alias("chrom"), F.col("t")[2].alias("feature"), F.col("t")[3].cast("long").alias("begin"), F.col("t")[4].cast("long").alias("end"),
        F.col("t")[6].alias("strand"), F.when(F.col("t")[7].rlike("^[0-9]"), F.col("t")[7].substr(1, 1).cast("int")).alias("phase"), F.col("t")[8].alias("attrs"), "line")


def genome_pieces(spark: SparkSession, path, most: int = 1 << 16) -> DataFrame:
    """(chrom, start, seq), 1-based: sequences in pieces of at most ``most`` bases."""
    return sequence_pieces(spark, path, most)


def genome(spark: SparkSession, path) -> DataFrame:
    """(chrom, seq): whole sequences, for those that are short; long ones are worked on in pieces."""
    groups = genome_pieces(spark, path).groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("all"))
    return groups.select("chrom", F.array_join(F.transform("all", lambda x: x["seq"]), "").alias("seq"))


def genome_sizes(pieces: DataFrame) -> DataFrame:
    """(chrom, len) of pieces(chrom, start, seq)."""
    return pieces.groupBy("chrom").agg(F.max(F.col("start") + F.length("seq") - 1).alias("len"))


def coding_exons(spark: SparkSession, path) -> DataFrame:
    """(chrom, strand, phase, start, end) from columns divided by white space."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(t) >= 5)
    return rows.select(t[0].alias("chrom"), t[1].alias("strand"), t[2].alias("phase"), t[3].cast("long").alias("start"), t[4].cast("long").alias("end"))


def genome_list(spark: SparkSession, path) -> DataFrame:
    """(n, name, path); the first line, n = 0, is the reference."""
    rows = numbered_lines(spark, path).where(F.trim("line") != "")
    t = F.split("line", "\t")
    return rows.select((F.row_number().over(Window.orderBy("line_no")) - 1).alias("n"), F.trim(t[0]).alias("name"), F.trim(t[1]).alias("path"))


def prefixed(genomes: DataFrame, name: str) -> DataFrame:
    """Sequences with the name of their genome before the id."""
    return genomes.withColumn("chrom", F.concat_ws(".", F.lit(name), "chrom"))


def score_file(spark: SparkSession, path) -> DataFrame:
    """(seq, start, end, strand, score) of a score file, without comments and the header."""
    t = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & ~F.col("value").startswith("seq\t") & (F.size(t) >= 5))
    return rows.select(t[0].alias("seq"), t[1].cast("long").alias("start"), t[2].cast("long").alias("end"), t[3].alias("strand"), F.when(F.lower(t[4]).contains("nan"), None).otherwise(t[4].cast("double")).alias("score"))


def name_mapping(spark: SparkSession, path) -> DataFrame:
    """(alias, name) of a table of two columns, in lower case."""
    t = F.split("value", r"\t")
    return spark.read.text(path).where(F.size(t) >= 2).select(F.lower(F.trim(t[0])).alias("alias"), F.lower(F.trim(t[1])).alias("name"))


def hits_to_alignments(hits: DataFrame) -> DataFrame:
    """(query, chrom, start, end, strand, phase, seqs): multiple alignments of a search's result.

    hits(query, hit_no, header, seq): the query itself is number 0, and its header is
    ``chrom:start-end#strand#phase``; zero bytes before a header are dropped.  Queries
    without a hit are left out.
    """
    head = F.regexp_replace("header", "^\x00+", "")
    pattern = r"^(.+):(\d+)-(\d+)#([+-])#(\d)"
    rows = hits.withColumn("header", head)
    part = lambda k: F.regexp_extract("top.header", pattern, k)
    groups = rows.groupBy("query").agg(F.min_by(F.struct("header", "seq"), "hit_no").alias("top"), F.array_sort(F.collect_list(F.struct("hit_no", "header", "seq"))).alias("all"))
    groups = groups.where(F.size("all") > 1)
    return groups.select("query", part(1).alias("chrom"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"), part(4).alias("strand"), part(5).cast("int").alias("phase"), F.transform("all", lambda x: F.struct(x["header"].alias("header"), x["seq"].alias("seq"))).alias("seqs"))


