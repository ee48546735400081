"""The five tools, each from files to files."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codonflow.model.hmm import Hmm, coding_hmm
from codonflow.model.species import Model
from codonflow.operators import alignments as A
from codonflow.operators import annotate as N
from codonflow.operators import orfs as O
from codonflow.operators import scoring as C
from codonflow.operators import tracks as T
from codonflow.operators.search import gapped_search
from codonflow.sources import sinks as K
from codonflow.sources import text as R
from codonflow.sources.bigwig import big_wig_sizes


#: names that one line of a report has
NAMED = 50


def report(what: str, names: DataFrame) -> None:
    """A line on standard error, if there are any names: how many, and the first of them."""
    column = names.columns[0]
    found = [r[0] for r in names.orderBy(column).limit(NAMED).collect()]
    if found:
        print(f"{what} ({names.count()}): {', '.join(map(str, found))}", file=sys.stderr)


def _blocks(spark: SparkSession, paths: list[str], model: Model, mapping: str | None, tracks: bool) -> DataFrame:
    """Blocks of alignments; says which species are not known to the model, and which of the model are in no alignment.

    The reference of all blocks of a file has to be of one species.
    """
    rows = R.maf_rows(spark, paths)
    aliases = R.name_mapping(spark, mapping) if mapping else None
    report("species that the model does not have, left out", A.unresolved(rows, model.leaves, aliases))
    report("species of the model in no alignment", A.never_seen(rows, model.leaves, aliases))
    known = A.resolve_species(rows, model.leaves, aliases)
    mixed = A.references(known).groupBy("file").agg(F.array_sort(F.collect_list("species")).alias("s")).where(F.size("s") > 1).first()
    if mixed is not None:
        raise ValueError(f"blocks of {mixed['file']} have references of several species: {', '.join(mixed['s'])}")
    return A.blocks(known, len(model.leaves), tracks)


def _hmm(spark: SparkSession, exons: str | None, genome_length: int | None) -> Hmm | None:
    if exons is None or genome_length is None:
        return None
    return coding_hmm(T.estimate_hmm(R.coding_exons(spark, exons), genome_length))


def score_msa(spark: SparkSession, model: Model, paths: list[str], output: str, strategy: str = "MLE", phylo: bool = True, ancestral: bool = False, mapping: str | None = None, exons: str | None = None, genome_length: int | None = None) -> DataFrame:
    """A score file of every block of the alignments; also returned as (seq, start, end, strand, phylo, anc, bls)."""
    blocks = _blocks(spark, paths, model, mapping, False)
    keyed = blocks.select("file", "block_id", F.col("chrom").alias("seq"), "start", (F.col("start") + F.length(F.col("seqs")[0]) - 1).alias("end"), "strand", "seqs")
    if strategy == "FIXED_MEAN":
        hmm = _hmm(spark, exons, genome_length)
        if hmm is None:
            raise ValueError("FIXED_MEAN needs coding exons and a genome length")
        means = T.mean_smoothed(keyed, model, hmm).select("file", "block_id", "phylo")
        scores = C.score_alignments(keyed, model, "FIXED").drop("phylo").join(means, ["file", "block_id"])
    else:
        scores = C.score_alignments(keyed, model, strategy, ancestral)
    scores = scores.orderBy("file", "block_id")
    K.write_lines(K.score_lines(scores, ancestral, phylo), output, "line_no")
    return scores.select("seq", "start", "end", "strand", "phylo", "anc", "bls")


@dataclass(frozen=True)
class Tracks:
    power: DataFrame
    raw: DataFrame
    smoothed: DataFrame | None
    regions: DataFrame | None


def build_tracks(spark: SparkSession, model: Model, paths: list[str], output: str, raw: bool = True, smooth: bool = False, regions: bool = False, threshold: float = 0.1, mapping: str | None = None, exons: str | None = None, genome_length: int | None = None) -> Tracks:
    """Power, raw and smoothed tracks as Parquet and fixedStep text, and regions as BED, under output."""
    hmm = _hmm(spark, exons, genome_length)
    if (smooth or regions) and hmm is None:
        raise ValueError("smoothed tracks and regions need coding exons and a genome length")
    blocks = A.stitched(_blocks(spark, paths, model, mapping, True))
    power = T.power_track(blocks, model).withColumnRenamed("power", "score")
    codons = T.raw_tracks(blocks, model, threshold)
    power.write.parquet(f"{output}/power.parquet")
    power = spark.read.parquet(f"{output}/power.parquet")
    codons.write.partitionBy("frame").parquet(f"{output}/raw.parquet")
    codons = spark.read.schema(codons.schema).parquet(f"{output}/raw.parquet")  # else the frame +1 is read as the number 1
    K.write_lines(K.fixed_step_lines(power, 4), f"{output}/power.wig", "chrom", "pos", "nth")
    smoothed = found = None
    if smooth or regions:
        T.smooth(codons, hmm).write.parquet(f"{output}/smoothed.parquet")
        smoothed = spark.read.parquet(f"{output}/smoothed.parquet")
    frames = ("+1", "+2", "+3", "-1", "-2", "-3")
    for frame in frames:
        if raw:
            K.write_lines(K.fixed_step_lines(codons.where(F.col("frame") == frame)), f"{output}/raw{frame}.wig", "chrom", "pos", "nth")
        if smooth:
            K.write_lines(K.fixed_step_lines(smoothed.where(F.col("frame") == frame).withColumnRenamed("log_odds", "score")), f"{output}/smoothed{frame}.wig", "chrom", "pos", "nth")
    if regions:
        found = T.regions(smoothed)
        K.write_lines(K.bed_lines(found), f"{output}/regions.bed", "chrom", "begin")
    return Tracks(power, codons, smoothed, found)


def annotate_with_tracks(spark: SparkSession, tracks: str, sizes: DataFrame | None, paths: list[str], output: str) -> DataFrame:
    """Gene models with the score and power of tracks on transcripts and coding exons.

    bigWig tracks know the lengths of their chromosomes; others need sizes(chrom, len).
    """
    if sizes is None:
        if not R.is_big_wig(tracks):
            raise ValueError("tracks other than bigWig need the lengths of chromosomes")
        sizes = spark.createDataFrame(sorted(big_wig_sizes(tracks).items()), "chrom string, len long")
    features = R.gene_models(spark, paths)
    report("chromosomes without a length, not annotated", N.missing_chromosomes(features, sizes))
    out = N.annotate(features, R.track_set(spark, tracks), sizes)
    K.write_lines(K.annotated_lines(out), output, "file", "line_no")
    return out


def find_cds(spark: SparkSession, genome: str, tracks: str, paths: list[str], output: str, mode: str = "LONGEST", min_score: float = 0.0, min_codons: int = 25, evaluate: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Coding sequences of transcripts by reading frames and tracks; with their evaluation against annotated ones."""
    features, pieces = R.gene_models(spark, paths), R.genome_pieces(spark, genome)
    report("chromosomes that the genome does not have, left out", N.missing_chromosomes(features, pieces))
    exons = features.where("feature = 'exon'")
    parts = O.orf_exons(O.find_orfs(O.spliced_pieces(exons, pieces), min_codons), exons)
    parts = O.score_orfs(parts, R.track_set(spark, tracks), R.genome_sizes(pieces))
    chosen = O.choose(parts, mode, min_score)
    K.write_lines(K.predicted_lines(features, chosen), output, "file", "tx_no", "line_no", "nth")
    return chosen, O.evaluation(chosen, O.choose(parts, "ALL", min_score), features) if evaluate else None


Search = Callable[[DataFrame, DataFrame], DataFrame]


def annotate_with_search(spark: SparkSession, genomes: str, model: Model, paths: list[str], output: str, strategy: str = "FIXED", search: Search = gapped_search, mapping: str | None = None, exons: str | None = None, genome_length: int | None = None) -> DataFrame:
    """Gene models with the scores of alignments that a search of other genomes makes.

    search(queries(query, seq), genomes(genome, chrom, start, seq)) gives hits as ``gapped_search`` does.
    FIXED_MEAN smooths the codons of each alignment, for which it needs coding exons and a genome length.
    """
    hmm = _hmm(spark, exons, genome_length)
    if strategy == "FIXED_MEAN" and hmm is None:
        raise ValueError("FIXED_MEAN needs coding exons and a genome length")
    listed = R.genome_list(spark, genomes).orderBy("n").collect()
    reference = R.genome_pieces(spark, listed[0].path)
    others = None
    for row in listed[1:]:
        one = R.genome_pieces(spark, row.path).select(F.lit(row.name).alias("genome"), "chrom", "start", "seq")
        others = one if others is None else others.unionByName(one)
    features = R.gene_models(spark, paths)
    cds = features.where("feature = 'CDS'").withColumn("phase", F.coalesce("phase", F.lit(0)))
    key = F.concat(F.col("chrom"), F.lit(":"), F.col("begin").cast("string"), F.lit("-"), (F.col("end") - F.col("phase")).cast("string"), F.lit("#"), F.col("strand"), F.lit("#"), F.col("phase").cast("string"))
    queries = N.cds_sequences(N.distinct_places(cds), reference).select(key.alias("query"), "line_no", "seq")
    hits = search(queries.select("query", "seq"), others)
    rows = queries.select("query", "line_no", F.lit(listed[0].name).alias("genome"), "seq").unionByName(hits.join(queries.select("query", "line_no"), "query").select("query", "line_no", "genome", "seq"))
    aliases = R.name_mapping(spark, mapping) if mapping else None
    rows = A.resolve_species(rows.withColumnRenamed("genome", "species"), model.leaves, aliases)
    groups = rows.groupBy("query").agg(F.min("line_no").alias("line_no"), F.map_from_entries(F.collect_list(F.struct("leaf", "seq"))).alias("m"), F.max(F.length("seq")).alias("n")).where(F.size("m") > 1)
    seqs = F.transform(F.sequence(F.lit(0), F.lit(len(model.leaves) - 1)), lambda k: F.coalesce(F.element_at("m", k), F.repeat(F.lit("N"), F.col("n").cast("int"))))
    aligned = groups.select("query", "line_no", seqs.alias("seqs"))
    if strategy == "FIXED_MEAN":
        scores = C.score_alignments(aligned, model, "FIXED").drop("phylo").join(T.mean_smoothed(aligned, model, hmm).select("query", "phylo"), "query")
    else:
        scores = C.score_alignments(aligned, model, strategy)
    scored = N.score_by_place(cds, scores.select(F.col("query").alias("key"), F.col("phylo").alias("score"), "line_no"))
    power = N.score_by_place(cds, scores.select(F.col("query").alias("key"), F.col("bls").alias("score"), "line_no"))
    lines = scored.select("file", "line_no", F.col("score").alias("score_mean")).join(power.select("file", "line_no", F.col("score").alias("power_mean")), ["file", "line_no"])
    whole = N.transcript_means(scored).withColumnRenamed("score", "s").join(N.transcript_means(power).withColumnRenamed("score", "p"), ["file", "tx_no"]).withColumn("feature", F.lit("transcript"))
    out = features.join(lines, ["file", "line_no"], "left").join(whole, ["file", "tx_no", "feature"], "left")
    out = out.select(*features.columns, F.coalesce("score_mean", "s").alias("score_mean"), F.coalesce("power_mean", "p").alias("power_mean"))
    K.write_lines(K.annotated_lines(out, weighted=False), output, "file", "line_no")
    return out
