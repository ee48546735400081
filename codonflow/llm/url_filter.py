"""URL filter: curated host and path rules first, association rules from labels for the rest.

DataFrame functions and Spark's FP-growth only; no Python runs on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: (action, host, path)
BASE_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Mining:
    """Support: labelled URLs with the whole combination and the bad label; at least the larger of the two."""

    least_count: int = 5
    least_share: float = 0.002
    confidence: float = 0.6


def host_path(url="url"):
    """(host, path): after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; then up to ``? #``."""
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url="url"):
    """Distinct tokens of a URL: labels of its host, segments of its path and names in its query; digits alone are none."""
    rest = F.translate(F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1), UPPER, LOWER)
    found = F.regexp_extract_all(rest, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x60\x7B-\x7F][^\x00-\x2F\x3A-\x60\x7B-\x7F]*"), F.lit(0))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def base_rule(host, path, rules=BASE_RULES):
    """struct(rule, verdict) of the longest rule that fits, or null."""
    best = F.lit(None)
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("verdict"))).otherwise(best)
    return best


def mine(pages: DataFrame, labels: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """rules(ante array<string>, seen, bad, alike array<array<string>>): combinations of URL tokens that go with documents of quality 0.

    Combinations have any length; those that hold another rule are left out, as they block nothing more.
    Three things keep what is mined small and lose no rule.  Tokens that are rules alone are in no longer one.
    Tokens that stand in the same labelled URLs are one item, the smallest of them, as one adds nothing
    to another; ``alike`` has all of them for each token of ante.  Only URLs of bad documents are mined, and what is
    frequent there is counted over all.  So many equal URLs, however long, are a few items.

    The document of a page is the number that is the last segment of its path, less
    an extension.  Labels that are null teach nothing; of several labels of a
    document one of quality 0 decides.  Null URLs teach nothing, repeated rows count each; empty tables give no rules.
    """
    spark = pages.sparkSession
    _, path = host_path()
    doc = F.regexp_extract(path, r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1)
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = pages.where("url is not null").select(F.array_sort(tokens()).alias("t"), F.when(doc != "", doc.cast("long")).alias("doc_id")).where("doc_id is not null")
    sets = cut(rows.join(known, "doc_id").groupBy("t").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count("*").alias("seen")))
    n = sets.agg(F.sum("seen")).first()[0] or 0
    schema = "ante array<string>, bad long, seen long, alike array<array<string>>"
    if not n:
        return spark.createDataFrame([], schema)
    least = max(mining.least_count, -(-int(n * mining.least_share * 1000) // 1000))
    each = sets.select("*", F.explode("t").alias("token"))
    where = [F.count("*").alias("c"), *[F.bit_xor(F.xxhash64("t", F.lit(k))).alias(f"x{k}") for k in (0, 1)]]
    often = cut(each.groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"), *where).where(F.col("bad") >= least))
    passes = F.col("bad") >= F.col("seen") * mining.confidence
    alone = often.where(passes).select(F.array("token").alias("ante"), "bad", "seen", F.array(F.array("token")).alias("alike"))
    kinds = often.where(~passes).groupBy("c", "x0", "x1").agg(F.array_sort(F.collect_list("token")).alias("alike"), F.max("seen").alias("often"))
    kinds = cut(kinds.select(F.col("alike")[0].alias("item"), "alike", "often"))
    items = each.join(kinds.select("item", F.explode("alike").alias("token")), "token").groupBy("t", "bad", "seen").agg(F.array_sort(F.collect_set("item")).alias("items"))
    items = cut(items.where(F.size("items") > 1))
    bad = items.where("bad > 0").select("items", F.explode(F.sequence(F.lit(1).cast("long"), "bad")).alias("k")).select("items")
    m = bad.count()
    if m < least:
        return cut(alone)
    found = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / m).fit(bad).freqItemsets
    found = cut(found.where(F.size("items") > 1).select(F.array_sort("items").alias("ante"), F.col("freq").alias("bad")))
    # over all labelled URLs, by each combination's rarest item
    rarest = found.select("ante", F.explode("ante").alias("item")).join(kinds.select("item", "often"), "item").groupBy("ante").agg(F.min_by("item", F.struct("often", "item")).alias("item"))
    met = items.select("items", "seen", F.explode("items").alias("item")).join(rarest, "item").where(F.size(F.array_except("ante", "items")) == 0)
    seen = met.groupBy("ante").agg(F.sum("seen").alias("seen"))
    rules = cut(found.join(seen, "ante").where(passes).select("ante", "bad", "seen"))
    longer = rules.select("ante", F.explode("ante").alias("token")).join(_by_rarest(rules).withColumnRenamed("ante", "less"), "token")
    longer = longer.where((F.size("less") < F.size("ante")) & (F.size(F.array_except("less", "ante")) == 0)).select("ante").distinct()
    rules = rules.join(longer, "ante", "left_anti").select("ante", "bad", "seen", F.posexplode("ante").alias("k", "item")).join(kinds.select("item", "alike"), "item")
    rules = rules.groupBy("ante", "bad", "seen").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "alike"))), lambda x: x["alike"]).alias("alike"))
    return cut(alone.unionByName(rules))


def _by_rarest(rules: DataFrame) -> DataFrame:
    """(ante, token): each rule by that of its tokens that the fewest rules have."""
    each = rules.select("ante", F.explode("ante").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("c"))
    return each.join(often, "token").groupBy("ante").agg(F.min_by("token", F.struct("c", "token")).alias("token"))


def matching(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(url): distinct URLs that hold all tokens of a rule, or ones alike, by an inverted index of each rule's rarest token.

    Null URLs match nothing; without rules, or pages, there are no rows.
    """
    if rules.isEmpty():
        return pages.sparkSession.createDataFrame([], "url string")
    index = rules.join(_by_rarest(rules), "ante").select("alike", F.explode(F.element_at("alike", F.array_position("ante", F.col("token")).cast("int"))).alias("token"))
    urls = pages.where("url is not null").select("url").distinct().select("url", tokens().alias("t"))
    hits = urls.select("url", "t", F.explode("t").alias("token")).join(index, "token")
    return hits.where(F.forall("alike", lambda a: F.arrays_overlap(a, F.col("t")))).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules=BASE_RULES, mining: Mining = Mining()) -> DataFrame:
    """(page_id, host, path, rule, verdict, learned) of every row of pages.

    The longest base rule that fits decides; without one, a URL that a mined rule
    matches is blocked (``learned`` true) and any other allowed.  A null URL or one
    without ``://``: host and path empty, allowed.  Repeated rows and null page_ids
    are returned each; empty pages give no rows, empty labels no mined rules;
    columns other than those read are ignored.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    mined = matching(pages, mine(pages, labels, mining)).select("url", F.lit(True).alias("hit"))
    host, path = host_path()
    out = pages.join(mined, "url", "left").select("page_id", host.alias("host"), path.alias("path"), F.coalesce("hit", F.lit(False)).alias("hit"))
    best = base_rule(F.col("host"), F.col("path"), rules)
    out = out.withColumn("best", best)
    learned = F.col("best").isNull() & F.col("hit")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(learned, "block").otherwise("allow")).alias("verdict"), learned.alias("learned"))


def judge_sql(mining: Mining = Mining(), rules=BASE_RULES) -> str:
    """The same in DuckDB, for rules of at most two tokens."""
    fits = "".join(f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}={a}'" for a, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])))
    return rf"""
WITH a AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), ''), '{UPPER}', '{LOWER}') AS low, coalesce(regexp_extract(url, '(?s)^.*?://(.*)$', 1), '') AS rest FROM pages),
b AS (SELECT page_id, url, regexp_extract(low, '^([^/?#]*)', 1) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
  list_distinct(regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x60\x7B-\x7F][^\x00-\x2F\x3A-\x60\x7B-\x7F]*')) AS t FROM a),
k AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
x AS (SELECT row_number() OVER () AS i, t, q FROM b JOIN k ON k.doc_id = TRY_CAST(nullif(regexp_extract(path, '/([0-9]{{1,18}})(?:\.[a-z]+)?/?$', 1), '') AS BIGINT) WHERE url IS NOT NULL),
least AS (SELECT greatest({mining.least_count}, CAST(ceil(floor(count(*) * {mining.least_share} * 1000) / 1000) AS BIGINT)) AS m FROM x),
u AS (SELECT i, q, unnest(t) AS w FROM x),
c AS (SELECT a.w AS w1, b.w AS w2, count(*) AS seen, count(*) FILTER (a.q = 0) AS bad FROM u a JOIN u b ON a.i = b.i AND a.w <= b.w GROUP BY 1, 2),
r AS (SELECT w1, w2 FROM c, least WHERE bad >= m AND bad >= seen * {mining.confidence}),
h AS (SELECT DISTINCT b.url FROM b, r WHERE list_contains(t, w1) AND list_contains(t, w2)),
f AS (SELECT page_id, host, path, h.url IS NOT NULL AS hit, CASE{fits} END AS best FROM b LEFT JOIN h ON h.url = b.url)
SELECT page_id, host, path, split_part(best, '=', 1) AS rule, CASE WHEN best IS NOT NULL THEN split_part(best, '=', 2) WHEN hit THEN 'block' ELSE 'allow' END AS verdict, best IS NULL AND hit AS learned FROM f"""
