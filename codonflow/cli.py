"""Command line: ``python -m codonflow.cli TOOL [options] ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from codonflow.model.species import load_model, model_info
from codonflow.plans import pipelines as P
from codonflow.ship import ship
from codonflow.sources.sinks import output_path
from codonflow.sources.text import name_mapping


def switch(text: str) -> bool:
    """1, true, yes, on and their opposites, in any case."""
    low = text.lower()
    if low in ("1", "true", "one", "yes", "on"):
        return True
    if low in ("0", "false", "zero", "no", "off"):
        return False
    raise argparse.ArgumentTypeError(f"neither true nor false: {text}")


def _species(text: str) -> list[str]:
    return [s.strip() for s in text.split(",") if s.strip()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codonflow", description="Scores alignments and gene models for coding potential.")
    tools = top.add_subparsers(dest="tool", required=True)

    def tool(name: str, text: str, model: bool = False, hmm: bool = False) -> argparse.ArgumentParser:
        p = tools.add_parser(name, help=text, description=text)
        p.add_argument("--output", help="path of the result")
        p.add_argument("--threads", type=int, help="cores of a local session")
        if model:
            p.add_argument("--mapping", help="table of two columns: names of species in the input and in the model")
            p.add_argument("--species", type=_species, help="species of the model to use, divided by commas")
            p.add_argument("--model-info", action="store_true", help="show the species of the model and stop")
        if hmm:
            p.add_argument("--genome-length", type=int)
            p.add_argument("--coding-exons", help="chrom, strand, phase, start and end of known coding exons")
        return p

    p = tool("build-tracks", "tracks of codon scores of whole-genome alignments", True, True)
    p.add_argument("--output-raw", type=switch, default=True)
    p.add_argument("--output-smoothed", type=switch, default=False)
    p.add_argument("--output-regions", type=switch, default=False)
    p.add_argument("--power-threshold", type=float, default=0.1)
    p.add_argument("model")
    p.add_argument("alignments", nargs="*")
    p = tool("score-msa", "scores of alignments", True, True)
    p.add_argument("--strategy", choices=("MLE", "FIXED", "OMEGA", "FIXED_MEAN"), default="MLE")
    p.add_argument("--comp-score", type=switch, default=True)
    p.add_argument("--comp-anc", type=switch, default=False)
    p.add_argument("model")
    p.add_argument("alignments", nargs="*")
    p = tool("annotate-with-tracks", "gene models with scores of tracks")
    p.add_argument("--sizes", help="Parquet of chrom and len; bigWig tracks have their own")
    p.add_argument("tracks")
    p.add_argument("genes", nargs="+")
    p = tool("annotate-with-search", "gene models with scores of alignments to other genomes", True, True)
    p.add_argument("--strategy", choices=("MLE", "FIXED", "OMEGA", "FIXED_MEAN"), default="FIXED")
    p.add_argument("genomes")
    p.add_argument("model")
    p.add_argument("genes", nargs="*")
    p = tool("find-cds", "coding sequences of transcripts")
    p.add_argument("--mode", choices=("ALL", "LONGEST", "BEST_SCORE"), default="LONGEST")
    p.add_argument("--min-score", type=float, default=0.0)
    p.add_argument("--min-codons", type=int, default=25)
    p.add_argument("--evaluate", type=switch, default=False)
    p.add_argument("genome")
    p.add_argument("tracks")
    p.add_argument("genes", nargs="+")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = parser()
    a = top.parse_args(arguments)
    if a.tool == "score-msa" and a.strategy == "OMEGA" and a.comp_anc:
        top.error("OMEGA has no ancestral score")
    if spark is None:
        builder = SparkSession.builder.appName("codonflow")
        spark = (builder.master(f"local[{a.threads}]") if a.threads else builder).getOrCreate()
    ship(spark)
    model = load_model(spark, a.model, a.species) if hasattr(a, "model") else None
    if getattr(a, "model_info", False):
        return model_info(spark, model, name_mapping(spark, a.mapping) if a.mapping else None).show(1000, False)
    inputs = getattr(a, "alignments", None) or getattr(a, "genes", None)
    if not inputs:
        top.error("an input is missing")
    if a.tool == "build-tracks":
        P.build_tracks(spark, model, inputs, a.output or f"{inputs[0]}.tracks", a.output_raw, a.output_smoothed, a.output_regions, a.power_threshold, a.mapping, a.coding_exons, a.genome_length)
    elif a.tool == "score-msa":
        P.score_msa(spark, model, inputs, a.output or output_path(inputs[0], ".scores"), a.strategy, a.comp_score, a.comp_anc, a.mapping, a.coding_exons, a.genome_length)
    elif a.tool == "annotate-with-tracks":
        P.annotate_with_tracks(spark, a.tracks, spark.read.parquet(a.sizes) if a.sizes else None, inputs, a.output or output_path(inputs[0]))
    elif a.tool == "annotate-with-search":
        P.annotate_with_search(spark, a.genomes, model, inputs, a.output or output_path(inputs[0]), a.strategy, mapping=a.mapping, exons=a.coding_exons, genome_length=a.genome_length)
    else:
        _, counts = P.find_cds(spark, a.genome, a.tracks, inputs, a.output or output_path(inputs[0]), a.mode, a.min_score, a.min_codons, a.evaluate)
        if counts is not None:
            counts.show(truncate=False)


if __name__ == "__main__":
    main()
