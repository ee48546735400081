import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from codonflow import fixtures as X


def test_numbers_in_order_of_time(spark):
    rng = random.Random(8)
    start = datetime.datetime(1969, 12, 30, tzinfo=datetime.timezone.utc)
    rows = [(rng.choice("AB"), start + datetime.timedelta(hours=rng.choice((0, rng.randint(0, 99)))), k) for k in range(200)] + [("A", None, 200), ("A", None, 201), (None, start, 202)]
    df = spark.createDataFrame(rows, "chrom string, ts timestamp, event_id long")
    expected, seen = {}, Counter()
    for c, _, k in sorted(rows, key=lambda r: (r[1] is not None, r[1] or start, r[2])):
        seen[c] += 1
        expected[k] = seen[c]
    plain = df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for size in (1, 7, 1000):
        for rows in (df, plain):
            assert {r.event_id: r.rn for r in X.numbered(rows, "chrom", "ts", "event_id", size=size).collect()} == expected
    assert X.numbered(df.where(F.lit(False)), "chrom", "ts", "event_id").count() == 0


def test_no_task_numbers_a_whole_chromosome(spark, sf, monkeypatch):
    monkeypatch.setattr(X, "NUMBERED", 50)
    plan = X.tracks(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("__b" in line.split("row_number() windowspecdefinition(")[1].split(" ASC")[0] for line in windows)
