"""The thin queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, url_filter
from .decontaminate import find_leaks
from .fill_middle import MIDDLE_SQL, fill_in_middle, restored
from .importance import resample
from .jaccard_join import jaccard_components
from .licenses import scan_licenses
from .line_dedup import LINE_SQL, dedup_lines
from .mixing import MIX_SQL, mixed
from .neighbors import nearest
from .quality import classify
from .shared import table
from .token_ids import token_table
from .topk import TOP_SQL, top_k


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_html_extraction": op2_html_extraction,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_token_ids": op6_token_ids,
    "op7_exact_topk": op7_exact_topk,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_url_filters": op9_url_filters,
    "op10_license_scans": op10_license_scans,
    "op11_nearest_neighbours": op11_nearest_neighbours,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_fill_in_middle": op13_fill_in_middle,
}

OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS x FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS node, doc_id AS top FROM n UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node WHERE r.top < l.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, CAST(min(r.top) AS BIGINT) AS component_id FROM n JOIN r ON r.node = n.doc_id GROUP BY 1, 2
"""

ORACLE_SQL = {
    "op1_source_mixing": MIX_SQL,
    "op4_ngram_jaccard_join": OP4_SQL,
    "op5_line_dedup": LINE_SQL,
    "op7_exact_topk": TOP_SQL,
    "op9_url_filters": url_filter.judge_sql(),
    "op13_fill_in_middle": MIDDLE_SQL,
}
