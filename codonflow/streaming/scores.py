"""Streams of alignments: scores as they come, and windowed means of streams of track values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codonflow.model.species import Model
from codonflow.operators.scoring import score_alignments


def score_stream(alignments: DataFrame, model: Model) -> DataFrame:
    """The FIXED scores of a stream of alignments(.., seqs): stateless, one row in and out."""
    return score_alignments(alignments, model, "FIXED")


def windowed_means(values: DataFrame, ts: str = "ts", key: str = "chrom", value: str = "score", window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(key, begin, n, mean) of a stream, by tumbling windows; rows later than ``late`` are left out."""
    groups = values.withWatermark(ts, late).groupBy(F.col(key), F.window(ts, window))
    return groups.agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(key, F.col("window.start").alias("begin"), "n", "mean")
