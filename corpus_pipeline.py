"""Corpus pipeline: quality filter, near-duplicate groups, decontamination, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor
kept; all but the last return the columns of ``documents``, and any others that docs has.

Null and empty texts are scored like texts of zeros, are like no other text, leak nothing, and are not
in the mix, which is made of words.  Rows with a null id stay in each stage like any other; equal rows are one group
of near copies, of which one row of the smallest id stays.  A null source is a source of its own.  Empty documents give
empty results, an empty ``labels`` keeps all documents, an empty ``benchmark`` too.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codonflow.llm.decontaminate import without_leaks
from codonflow.llm.jaccard_join import one_of_each
from codonflow.llm.mixing import mix
from codonflow.llm.quality import keep_good
from codonflow.llm.shared import cleaning, remove, shared_dir, table
from codonflow.llm.token_ids import token_table

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each epoch of a document, cut at the budget of its source."""
    return mix(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids of each row are in the files, with their number and checksum."""
    return token_table(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mixing", source_mixing),
    ("token ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again; what a stage has read and shuffled goes, the last result stays."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        with cleaning(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
