"""Mixing sources to target weights.

Every document gets a hash-random key; sources are cut into ranges of that key, words
are summed per range, and prefix sums over ranges and inside them (each a window of
bounded size, whatever a source's share) say where in its source's order a document
stands.  Whole epochs are taken while the budget lasts, and the rest is cut at
the exact word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: hexadecimal digits of the key that make a range of the first and of the second level
LEVELS = (3, 6)


def word_count(text: Column) -> Column:
    """Number of runs of other than the six ASCII white spaces; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_key(id_: Column, text: Column, seed: str) -> Column:
    """By the id; where it is null by the text, so that rows without an id are not all in one range of keys."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(id_.cast("string"), F.concat(F.lit("null"), F.coalesce(F.xxhash64(text).cast("string"), F.lit(""))))))


def targets(sizes: DataFrame, weights=WEIGHTS, total: Column | None = None, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) of sizes(source, source_size): one row per source.

    Weights repeat over the sources by code point, null last.  The words of ``total``
    (all words, if None) are shared by weight; no target exceeds most_epochs
    times its source, and what that leaves over goes to the others by weight.  Filling
    by the ratio of that limit to the weight gives the same as sharing anew until none
    is above: sources below the level take their limit, the others the level.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (nth % len(weights)) + 1)
    rows = sizes.withColumn("nth", nth).withColumn("weight", weight).withColumn("most", F.col("source_size") * most_epochs)
    by = Window.orderBy((F.col("most") / F.col("weight")), "nth")
    every = Window.partitionBy()
    rows = (
        rows.withColumn("all", F.sum("source_size").over(every) if total is None else total)
        .withColumn("below", F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("above", F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("all") - F.col("below")) / F.col("above"))
    )
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("nth_by", "level"))).over(every)
    rows = rows.withColumn("nth_by", F.row_number().over(by)).withColumn("level", level["level"])
    share = F.col("level") * F.col("weight")
    return rows.select("source", "source_size", F.when(share.isNull() | (share > F.col("most")), F.col("most").cast("double")).otherwise(share).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) and the columns of ``keep``, of every row.

    taken: the words of the row that the mix holds, repeats counted: size times the
    whole epochs of its source, and its part of the last one.

    Null and blank texts have size 0 and nothing taken.  A null source is one more
    source, the last.  Rows with equal ids are ordered by size,
    so that repeated rows are interchangeable.  A source without words has target 0.
    An empty table gives no rows; other columns are ignored.
    """
    return _placed(docs, id_col, text_col, source_col, weights, most_epochs, seed, keep).drop("key")


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, most_epochs: int, seed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``mixed``, with the keys."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), random_key(F.col(id_col), F.col(text_col), seed).alias("key"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    rows = cut(rows)
    one, two = (F.substring("key", 1, n) for n in LEVELS)
    # a null source keeps its own range: grouping and windows treat null as a value, joins by <=>
    fine = rows.groupBy("source", one.alias("one"), two.alias("two")).agg(F.sum("size").alias("words"))
    fine = cut(fine.withColumn("in_one", F.sum("words").over(Window.partitionBy("source", "one").orderBy("two")) - F.col("words")))
    coarse = fine.groupBy("source", "one").agg(F.sum("words").alias("all_one"))
    coarse = cut(coarse.withColumn("before_one", F.sum("all_one").over(Window.partitionBy("source").orderBy("one")) - F.col("all_one")))
    sizes = coarse.groupBy("source").agg(F.sum("all_one").alias("source_size"))
    plan = cut(targets(sizes, weights, None, most_epochs))
    marks = fine.join(coarse, (fine["source"].eqNullSafe(coarse["source"])) & (fine["one"] == coarse["one"])).select(
        fine["source"], fine["one"], fine["two"], (F.col("in_one") + F.col("before_one")).alias("before"))
    # inside a range of the second level: ordered by the whole key
    inside = Window.partitionBy("source", two).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("two", two).withColumn("in_two", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    m, p = marks.alias("m"), plan.alias("p")
    out = rows.alias("r").join(m, F.col("r.source").eqNullSafe(F.col("m.source")) & (F.col("r.two") == F.col("m.two")))
    out = out.join(p, F.col("r.source").eqNullSafe(F.col("p.source")))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - (F.col("before") + F.col("in_two"))
    taken = F.col("size") * epochs + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select("doc_id", F.col("r.source").alias("source"), "size", "source_size", "target", taken.cast("long").alias("taken"), "key", *[F.col(f"keep_{c}").alias(c) for c in keep])


def _first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, n), "")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: str = "mix", length_col: str | None = None) -> DataFrame:
    """The rows of the mix with the columns of docs: a row for every epoch that holds it.

    Where a budget ends inside a document, the last of its rows has only the words up
    to there (and ``length_col``, if given, their code points).  Rows without words
    aren't in the mix.  The plan is one row per source: epochs, and the document, by
    key, at which the last one is cut; texts are not shuffled.  Repeated rows at
    that cut are all cut alike.
    """
    plan = _placed(docs, id_col, text_col, source_col, weights, most_epochs, seed).where("size > 0")
    epochs = F.floor(F.round("target").cast("long") / F.col("source_size"))
    extra = F.col("taken") - epochs * F.col("size")
    place = F.struct(F.col("key").alias("k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("i"), F.col("size"))
    cuts = plan.groupBy("source").agg(F.max(epochs).alias("__epochs"), F.max(F.when(extra > 0, F.struct(place.alias("at"), extra.alias("words")))).alias("__cut"))
    cuts = cut(cuts.withColumnRenamed("source", "__source"))
    size = word_count(F.col(text_col))
    rows = docs.join(cuts, F.col(source_col).eqNullSafe(F.col("__source")))
    own = F.struct(random_key(F.col(id_col), F.col(text_col), seed).alias("k"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("i"), size.alias("size"))
    at = F.col("__cut.at")
    rows = rows.withColumn("__size", size)
    whole = F.col("__epochs") + F.when(own < at, 1).otherwise(0)
    part = F.when((own == at) & (F.col("__cut.words") > 0), F.col("__cut.words")).otherwise(0)
    rows = rows.withColumn("__part", F.coalesce(part, F.lit(0))).withColumn("__whole", F.coalesce(whole, F.lit(0))).where("__size > 0 and __whole + (case when __part > 0 then 1 else 0 end) > 0")
    lasts = F.when(F.col("__part") > 0, F.array(F.col("__part"))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("__take", F.explode(F.concat(F.array_repeat(F.lit(-1).cast("long"), F.col("__whole").cast("int")), lasts)))
    cut_text = F.when((F.col("__take") > 0) & (F.col("__take") < F.col("__size")), _first_words(F.col(text_col), F.col("__take").cast("int"))).otherwise(F.col(text_col))
    rows = rows.withColumn("__text", cut_text)
    columns = {text_col: F.col("__text")}
    if length_col:
        columns[length_col] = F.when(F.col("__take") > 0, F.length("__text")).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)
    return rows.select(*[columns.get(c, F.col(c)).alias(c) for c in docs.columns])


MIX_SQL = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(concat('mix', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS key FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS nth, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)] AS weight, 3 * source_size AS most FROM z),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(most) OVER (ORDER BY most / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
   / CAST(sum(weight) OVER (ORDER BY most / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level, row_number() OVER (ORDER BY most / weight, nth) AS by_ratio FROM w),
v AS (SELECT level FROM l WHERE level * weight <= most ORDER BY by_ratio LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN v.level IS NULL OR v.level * weight > most THEN CAST(most AS DOUBLE) ELSE v.level * weight END AS target FROM l LEFT JOIN v ON true),
c AS (SELECT s.*, t.source_size, t.target, CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before,
   CAST(round(target) AS BIGINT) AS budget, CASE WHEN t.source_size > 0 THEN CAST(round(target) AS BIGINT) // t.source_size ELSE 0 END AS epochs FROM s JOIN t ON t.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, size, source_size, target, CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken FROM c
"""
