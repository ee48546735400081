"""Genomics tables derived from general ones, the same in Spark and in SQL.

dna: bases among the letters of a text.  msa: four neighbouring documents, the first of
which is the reference.  feature: exons from order lines.  track: codon scores
from events, with gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: rows that are numbered in one task
NUMBERED = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("dna"))


def msa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aln_id, seqs): rows cut or filled with N to the length of the first; without a first, none."""
    rows = dna(spark, sf_dir).select(F.floor(F.col("doc_id") / 4).alias("aln_id"), (F.col("doc_id") % 4).cast("int").alias("leaf"), "dna")
    groups = rows.groupBy("aln_id").agg(*[F.max(F.when(F.col("leaf") == k, F.col("dna"))).alias(f"s{k}") for k in range(4)]).where("s0 is not null")
    fit = lambda k: F.rpad(F.coalesce(f"s{k}", F.lit("")), F.length("s0"), F.lit("N"))
    return groups.select("aln_id", F.array(*[fit(k) for k in range(4)]).alias("seqs"))


MSA_SQL = """d AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS dna FROM documents),
g AS (SELECT doc_id // 4 AS aln_id, max(CASE WHEN doc_id % 4 = 0 THEN dna END) AS s0, max(CASE WHEN doc_id % 4 = 1 THEN dna END) AS s1, max(CASE WHEN doc_id % 4 = 2 THEN dna END) AS s2, max(CASE WHEN doc_id % 4 = 3 THEN dna END) AS s3 FROM d GROUP BY 1),
m AS (SELECT aln_id, s0, rpad(coalesce(s1, ''), CAST(length(s0) AS INT), 'N') AS s1, rpad(coalesce(s2, ''), CAST(length(s0) AS INT), 'N') AS s2, rpad(coalesce(s3, ''), CAST(length(s0) AS INT), 'N') AS s3 FROM g WHERE s0 IS NOT NULL)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of coding exons, 30 bases apart, along l_orderkey: (file, line_no, tx_no, chrom, feature, begin, end, strand, phase)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_quantity").cast("long") * 3).alias("len"), F.row_number().over(order).alias("n"),
        F.first("l_returnflag").over(order).alias("chrom"), (F.sum(F.col("l_quantity").cast("long") * 3 + 30).over(order)).alias("upto"))
    begin = F.pmod(F.col("l_orderkey") * 3, F.lit(6000)) + F.col("upto") - F.col("len") - 30 + 1
    return rows.select(F.lit("f").alias("file"), (F.col("l_orderkey") * 100 + F.col("n")).alias("line_no"), F.col("l_orderkey").alias("tx_no"), "chrom", F.lit("CDS").alias("feature"),
        begin.alias("begin"), (begin + F.col("len") - 1).alias("end"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), (F.col("l_orderkey") % 3).cast("int").alias("phase"))


FEATURE_SQL = """x AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) * 3 AS len, row_number() OVER w AS n, first(l_returnflag) OVER w AS chrom, sum(CAST(l_quantity AS BIGINT) * 3 + 30) OVER w AS upto
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
f AS (SELECT l_orderkey * 100 + n AS line_no, l_orderkey AS tx_no, chrom, CAST((l_orderkey * 3) % 6000 + upto - len - 30 + 1 AS BIGINT) AS "begin", CAST((l_orderkey * 3) % 6000 + upto - 30 AS BIGINT) AS "end",
  CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(l_orderkey % 3 AS INT) AS phase FROM x)"""


def numbered(rows: DataFrame, key: str, time: str, *ties: str, size: int | None = None) -> DataFrame:
    """rows with ``rn``, their number by time and ties for each key, from 1: numbers inside stretches of time of about ``size`` rows, NUMBERED unless given, and how many are before them."""
    if dict(rows.dtypes)[time] == "timestamp_ntz":  # as it stands: no time zone puts hours out of order
        at = F.unix_date(F.col(time).cast("date")) * F.lit(86_400).cast("long") + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)
    else:
        at = F.unix_seconds(time)
    low, high, n = rows.agg(F.min(at), F.max(at), F.count("*")).first()
    width = max(1, ((high or 0) - (low or 0)) * (size or NUMBERED) // max(n, 1))
    rows = rows.withColumn("__b", F.floor((at - (low or 0)) / width))
    along = Window.partitionBy(key).orderBy(F.asc_nulls_first("__b")).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy(key, "__b").agg(F.count("*").alias("__n")).withColumn("__n", F.coalesce(F.sum("__n").over(along), F.lit(0)))
    before = before.select(F.col(key).alias("__k"), F.col("__b").alias("__c"), "__n")
    order = Window.partitionBy(key, "__b").orderBy(time, *ties)
    out = rows.withColumn("rn", F.row_number().over(order)).join(F.broadcast(before), F.col(key).eqNullSafe(F.col("__k")) & F.col("__b").eqNullSafe(F.col("__c")))
    return out.withColumn("rn", F.col("rn") + F.col("__n")).drop("__b", "__k", "__c", "__n")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, frame, pos, score) of all seven frames, with gaps, from all events in order of time; chromosomes are A, N and R, by event type."""
    chrom = F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), F.length("event_type") % 3 + 1)
    rows = numbered(table(spark, sf_dir, "events").select(chrom.alias("chrom"), "ts", "event_id", "user_id", "value"), "chrom", "ts", "event_id").where("user_id % 10 <> 0")
    frames = F.array(*[F.struct(F.lit(f).alias("frame"), F.lit(o).alias("off")) for f, o in (("+1", -2), ("+2", -1), ("+3", 0), ("-1", -2), ("-2", -1), ("-3", 0), ("power", 0))])
    rows = rows.withColumn("f", F.explode(frames))
    score = F.when(F.col("f.frame") == "power", F.least(F.col("value") / 500.0, F.lit(1.0))).otherwise((F.col("value") - 40.0) / 10)
    return rows.select("chrom", F.col("f.frame").alias("frame"), (F.col("rn") * 3 + F.col("f.off")).cast("long").alias("pos"), score.alias("score"))


TRACK_SQL = """n AS (SELECT ['A', 'N', 'R'][CAST(length(event_type) % 3 + 1 AS INT)] AS chrom, user_id, value, row_number() OVER (PARTITION BY length(event_type) % 3 ORDER BY ts, event_id) AS rn FROM events),
t AS (SELECT chrom, frame, CAST(rn * 3 + off AS BIGINT) AS pos, CASE WHEN frame = 'power' THEN CASE WHEN value / 500.0 > 1 THEN 1.0 ELSE value / 500.0 END ELSE (value - 40.0) / 10 END AS score
  FROM n, (VALUES ('+1', -2), ('+2', -1), ('+3', 0), ('-1', -2), ('-2', -1), ('-3', 0), ('power', 0)) o(frame, off)
  WHERE user_id % 10 <> 0)"""


def sizes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("A", 30_001), ("N", 30_000), ("R", 30_002)], "chrom string, len long")


SIZE_SQL = "z AS (SELECT * FROM (VALUES ('A', 30001), ('N', 30000), ('R', 30002)) z(chrom, len))"
