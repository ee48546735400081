"""What the operators share: tables, shared folder, cut lineage, links to components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: bytes up to which a table whose size was measured is broadcast
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset and all runs on one machine, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a job go with its end, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


class Scratch:
    """Tables written to the shared folder while an operator runs, gone when it ends, but for its result.

    As each table is written by a job of its own, the shuffle files of a job go with its end.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}"
        self._n, self._at = 0, {}

    def __enter__(self) -> Scratch:
        self._before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        return self

    def __exit__(self, *_) -> None:
        self.spark.conf.set(_CLEAN, self._before)
        remove(self.spark, self.path)

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed once and read again: a lost executor costs nothing that is there."""
        self._n += 1
        path = f"{self.path}/{self._n}"
        out = self._stored(df, path)
        self._at[id(out)] = out, path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a kept table that no later step reads."""
        remove(self.spark, self._at.pop(id(df))[1])

    def result(self, df: DataFrame) -> DataFrame:
        return self._stored(df, f"{shared_dir(self.spark)}/result-{uuid.uuid4().hex}")

    def _stored(self, df: DataFrame, path: str) -> DataFrame:
        schema = df.schema
        df.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)


def if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, to be broadcast if what it holds, measured, is at most ``limit`` bytes; else as it is."""

    def width(name: str, kind: str):
        if kind.startswith("array"):
            return 24 + 8 * F.coalesce(F.array_size(name), F.lit(0))
        if kind in ("string", "binary"):
            return 16 + F.coalesce(F.octet_length(name), F.lit(0))
        return F.lit(8 * max(1, kind.count(":")))

    size = sum((width(n, k) for n, k in df.dtypes), F.lit(16))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= limit else df


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder; a lost executor costs nothing that is there.

    The result also forgets the size that Spark estimated for df: the estimate of a join is
    the product of those of its sides, so over rounds of joins it would grow to numbers of
    millions of digits on the driver.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)._jdf
    fresh = spark._jsparkSession.internalCreateDataFrame(done.queryExecution().toRdd(), done.schema(), False)
    return DataFrame(fresh, spark)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, unless the session says otherwise: texts can be long, and a worker holds a whole batch."""
    for name, usual, own in (("maxRecordsPerBatch", 10_000, 2_000), ("maxBytesPerBatch", 64 << 20, 8 << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        if int(spark.conf.get(name, str(usual)).removesuffix("b") or usual) >= usual:
            spark.conf.set(name, str(own))


def components(links: DataFrame, rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """(node, root): the smallest node that each node of ``links(a, b)`` reaches.

    Contraction: every node goes to that of itself and its neighbours which a hash of the
    round puts first, links are drawn between those, and so on until none is left; as
    the order is random, chains shrink by a constant part a round.  Then the steps
    are joined from the first to the last.  A step takes partial minima and joins, so
    that a hub with a third of all links is split like any skewed join.
    Isolated nodes have no row.  With ``scratch``, what a round has read is removed when it ends, and the result is one of its tables.
    """
    keep, drop = (scratch.keep, scratch.drop) if scratch else (cut, lambda df: None)
    edges = keep(links.where("a <> b").select("a", "b").distinct())
    roots = at = None  # at: the table that roots are read from
    for k in range(rounds):
        if edges.isEmpty():
            break
        place = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.min(place("b")).alias("m"))
        step = keep(step.select("a", F.least(place("a"), F.col("m"))["n"].alias("m")))
        to, before = step.withColumnRenamed("m", "next"), at
        if roots is None:
            at, roots = step, step.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            at = roots = keep(roots.join(to.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
            drop(before)
        ended, edges = edges, edges.join(step.withColumnRenamed("m", "x"), "a").join(step.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        edges = keep(edges.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
        drop(ended)
        if at is not step:
            drop(step)
    else:
        raise RuntimeError("components did not settle")
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return keep(roots.join(least, "root").select("node", F.col("least").alias("root")))
