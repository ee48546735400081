"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line's tokens are its distinct runs of five words (of fewer words, the one whole
sequence).  Lines of equal text are one line with its first place; the others go at once.

Order of tokens: those in the prefixes of few lines before frequent ones, these by their
count; among the others by the hash of the first word, then by their own.  So the prefix of
a line follows from the hashes of its words, and only runs inside the prefix are
made.  Lines of which a prefix token is frequent get their prefix anew, with the counts.
Two alike lines share a token of their prefixes, which opens a block.

A line goes if any earlier line is like it, so it is settled once one such line is
found: first the earliest line of each of its blocks is tried, and only lines that
none of these settles meet all earlier ones of their blocks.  Before sets are compared
whole, pairs pass the length filter and the positional filter (what can follow the shared
prefix token).  Blocks with many lines are dealt over tasks by salt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, if_small

PERCENT = 75
SIZE = 5
#: a token is frequent from so many lines on that have it in their prefix
FREQUENT_FROM = 16
#: lines of a block that meet in one task
BLOCK = 4096
#: copies of one text that a task may meet; beyond it, and beyond 1/100,000 of all lines, a text is joined by broadcast
COPIES = 50_000
_UPPER = 2**63 - 1
ID = ("doc_id", "line", "v")


def _need(n: Column) -> Column:
    """Tokens that a set of n must share with any set alike."""
    return F.ceil(n * PERCENT / 100).cast("int")


def _low(t: Column) -> Column:
    """A-Z lower-cased, no two different texts becoming equal otherwise.

    Outside ASCII the bytes are taken as characters of ISO 8859-1.  Among these, lower()
    moves the capitals U+00C0 to U+00DE, here the leading bytes of two-byte
    characters, to those of three and four bytes, and as the number of bytes that
    follow a leading byte is kept, nothing falls together.
    """
    return F.lower(F.when(F.length(t) == F.octet_length(t), t).otherwise(F.decode(t.cast("binary"), "ISO-8859-1")))


def _words(low: Column) -> Column:
    """What stands between the white spaces; a line has five kinds of them."""
    odd = reduce(Column.__or__, [F.contains(low, F.lit(c)) for c in "\t\x0b\x0c\r"])
    return F.array_remove(F.when(odd, F.split(low, "[ \t\x0b\x0c\r]")).otherwise(F.split(low, " ")), "")


def _blank(t: Column) -> Column:
    return F.btrim(t, F.lit(" \t\x0b\x0c\r")) == ""


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line, t) of all lines with words."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t")).where(~_blank(F.col("t")))


def _repeated(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, line) of lines of which an earlier one has the same text."""
    at = scratch.keep(_lines(docs).select("doc_id", "line", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(1), "t").alias("g")))
    of_text = at.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "line")).alias("first")).where("c > 1")
    of_text = scratch.keep(of_text.select("h", "g", "c", F.col("first.doc_id").alias("fd"), F.col("first.line").alias("fl")))
    limit = max(COPIES, at.count() // 100_000)  # so at most 100,000 texts are broadcast
    hot, cold = of_text.where(F.col("c") > limit), of_text.where(F.col("c") <= limit)
    later = F.struct("doc_id", "line") > F.struct(F.col("fd").alias("doc_id"), F.col("fl").alias("line"))
    rest = at.join(F.broadcast(hot), ["h", "g"], "left_anti").join(cold, ["h", "g"])
    found = rest.select("doc_id", "line", "fd", "fl").unionByName(at.join(F.broadcast(hot), ["h", "g"]).select("doc_id", "line", "fd", "fl"))
    out = scratch.keep(found.where(later).select("doc_id", "line").distinct())
    scratch.drop(at)
    return out


def _chosen(docs: DataFrame, lines: DataFrame, keep: bool) -> DataFrame:
    """(doc_id, line, t): of docs(doc_id, text) the lines(doc_id, lines array), or all others that have words."""
    rows = docs.join(if_small(lines), "doc_id", "inner" if keep else "left").withColumn("all", F.split("text", "\n"))
    every = F.sequence(F.lit(0), F.size("all") - 1)
    wanted = F.array_intersect(every, "lines") if keep else F.coalesce(F.array_except(every, "lines"), every)
    rows = rows.select("doc_id", "all", F.explode(wanted).alias("line")).select("doc_id", "line", F.get("all", "line").alias("t"))
    return rows if keep else rows.where(~_blank(F.col("t")))


def _worded(lines: DataFrame) -> DataFrame:
    """(doc_id, line, v, h, n) of lines(doc_id, line, v, t): h a hash of each word, n runs."""
    rows = lines.select(*ID, _low(F.col("t")).alias("low"))
    rows = rows.select(*ID, F.transform(_words(F.col("low")), lambda x: F.xxhash64(x)).alias("h"))
    return rows.select(*ID, "h", F.greatest(F.size("h") - (SIZE - 1), F.lit(1)).alias("n"))


def _run(i: Column) -> Column:
    """The token of the run that begins at word i; only of short lines a run ends at the last word."""
    return F.xxhash64(*[F.get("h", i + k) for k in range(SIZE)], F.least(F.size("h"), F.lit(SIZE)))


def _prefixes(lines: DataFrame) -> DataFrame:
    """(doc_id, line, v, hi, lo, x): runs of the prefix, all that begin with one of the first words in the order of hashes.

    Each of these words begins one token at least, so as many words as the prefix needs
    tokens are enough.  hi and lo bound the number of tokens: runs, and words that begin them.
    """
    rows = _worded(lines.withColumn("v", F.xxhash64("t"))).withColumn("first", F.sort_array(F.array_distinct(F.slice("h", F.lit(1), F.col("n")))))
    rows = rows.select(*ID, "h", F.coalesce(F.get("first", F.col("n") - _need(F.col("n"))), F.lit(_UPPER)).alias("to"), F.col("n").alias("hi"), F.size("first").alias("lo"))
    rows = rows.select(*ID, "h", "to", "hi", "lo", F.explode(F.sequence(F.lit(0), F.col("hi") - 1)).alias("i"))
    # never null; but told so, the planner does not ask whether h is, which would make h twice
    return rows.where(F.coalesce(F.get("h", F.col("i")) <= F.col("to"), F.lit(True))).select(*ID, "hi", "lo", _run(F.col("i")).alias("x"))


def _again(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, line, v, h, n) of ids(doc_id, line, v), made again from their documents."""
    by_doc = ids.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    lines = _chosen(docs, by_doc, True).withColumn("v", F.xxhash64("t"))
    return _worded(lines.join(if_small(ids), [*ID], "left_semi"))


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, own) for ids(doc_id, line, v): all tokens of each."""
    both = lambda x, y: F.zip_with(x, y, lambda p, q: F.xxhash64(p, q))
    tail = lambda c, k: F.slice(c, F.lit(k + 1), F.greatest(F.size(c) - k, F.lit(0)))
    head = lambda c, n: F.slice(c, F.lit(1), n)
    # hashes of two words, of four, of five; only those of one kind are compared
    rows = _again(docs, ids).withColumn("two", both(head("h", F.greatest(F.size("h") - 1, F.lit(0))), tail("h", 1)))
    rows = rows.withColumn("four", both(head("two", F.greatest(F.size("two") - 2, F.lit(0))), tail("two", 2)))
    five = both(head("four", F.greatest(F.size("four") - 1, F.lit(0))), tail("h", SIZE - 1))
    each = F.when(F.size("h") < SIZE, F.array(F.xxhash64("h", F.size("h")))).otherwise(five)
    sets = rows.select(F.struct(*ID).alias("id"), F.array_distinct(each).alias("own"))
    return sets.groupBy("id").agg(F.first("own").alias("own"))  # repeated rows


def _salts(c: str) -> Column:
    return F.ceil(F.col(c) / BLOCK).cast("int")


def _salt(c: str) -> Column:
    return F.pmod(F.xxhash64("id"), _salts(c)).cast("int")


def _blocks(docs: DataFrame, dups: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, c, id, hi, lo, pos): prefix tokens that more than one line has, with the number of such lines.

    pos: place of the token in the prefix, 0 where that is not known.
    """
    again = docs.groupBy("doc_id").count().where("count > 1").select("doc_id")
    known = dups.join(if_small(again), "doc_id", "left_anti")  # in rows of one id, a place has more than one text
    by_doc = scratch.keep(known.groupBy("doc_id").agg(F.collect_list("line").alias("lines")))
    rows = scratch.keep(_prefixes(_chosen(docs, by_doc, False)))
    counts = scratch.keep(rows.groupBy("x").agg(F.count("*").alias("c")).where("c > 1"))
    frequent = counts.where(F.col("c") >= FREQUENT_FROM)
    redone = scratch.keep(rows.join(if_small(frequent), "x", "left_semi").select(*ID).distinct())
    # lines are dealt out before their tokens are made, which then stay in the task that chooses among them
    full = _again(docs, redone).repartition(*ID).select(*ID, "h", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    full = full.select(*ID, F.get("h", "i").alias("f"), _run(F.col("i")).alias("x")).join(if_small(frequent), "x", "left")
    full = full.groupBy(*ID).agg(F.sort_array(F.collect_set(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "f", "x"))).alias("t")).withColumn("n", F.size("t"))
    prefix = F.posexplode(F.slice("t", F.lit(1), F.col("n") - _need(F.col("n")) + 1)["x"]).alias("pos", "x")
    anew = scratch.keep(full.select(*ID, F.col("n").alias("hi"), F.col("n").alias("lo"), prefix))
    # what the changed prefixes have may meet tokens that one other line has
    fresh = scratch.keep(counts.select("x").unionByName(anew.select("x")).distinct())
    same = rows.join(if_small(redone), [*ID], "left_anti").join(if_small(fresh), "x", "left_semi").withColumn("pos", F.lit(0)).distinct()
    every = scratch.keep(same.unionByName(anew).select("x", F.struct(*ID).alias("id"), "hi", "lo", "pos"))
    for df in (rows, anew, redone, fresh):
        scratch.drop(df)
    counts = scratch.keep(every.groupBy("x").agg(F.count("*").alias("c")).where("c > 1"))
    hot, cold = if_small(counts.where(F.col("c") > BLOCK)), if_small(counts.where(F.col("c") <= BLOCK))
    joined = every.join(hot, "x").unionByName(every.join(cold, "x"))
    out = scratch.keep(joined.select("x", "c", "id", "hi", "lo", "pos"))
    scratch.drop(every)
    return out


def _before(a: str, b: str) -> Column:
    """Whether the line a is earlier than b."""
    return F.struct(f"{a}.doc_id", f"{a}.line") < F.struct(f"{b}.doc_id", f"{b}.line")


def _fits(a: str, b: str) -> Column:
    """Length and positional filter of two lines and a token that both have, columns of structs (id, hi, lo, pos).

    If it is the first that they share, they share at most what follows it, and each two
    alike lines pass by their first.
    """
    x, y = F.col(a), F.col(b)
    size = (x["hi"] * 100 >= y["lo"] * PERCENT) & (y["hi"] * 100 >= x["lo"] * PERCENT)
    return size & (F.least(x["hi"] - x["pos"], y["hi"] - y["pos"]) * (100 + PERCENT) >= (x["lo"] + y["lo"]) * PERCENT)


def _pairs(met: DataFrame) -> DataFrame:
    """Distinct (a, b) of met(a, b): b earlier than a, filters passed."""
    return met.where(_before("b.id", "a.id")).where(_fits("a", "b")).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _alike(docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(id) of those a of pairs(a, b) that are alike their b, on whole sets."""
    pairs = scratch.keep(pairs)
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().select("id.*"))
    sets = scratch.keep(_sets(docs, ids))
    small = sets.select("id", F.size("own").alias("n"))
    sized = pairs.join(small.toDF("a", "na"), "a").join(small.toDF("b", "nb"), "b").where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT))
    both = sized.join(sets.toDF("a", "own_a"), "a").join(sets.toDF("b", "own_b"), "b")
    both = both.select("a", "na", "nb", F.size(F.array_intersect("own_a", "own_b")).alias("shared"))
    out = scratch.keep(both.where(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * PERCENT).select(F.col("a").alias("id")).distinct())
    scratch.drop(sets)
    return out


def _settled(docs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(id) of lines that an earlier one is like."""
    line = F.struct("id", "hi", "lo", "pos")
    salts = F.explode(F.sequence(F.lit(0), _salts("c") - 1)).alias("s")
    earliest = rows.groupBy("x").agg(F.min(line).alias("b"), F.max("c").alias("c")).select("x", salts, "b")
    found = _alike(docs, _pairs(rows.select("x", _salt("c").alias("s"), line.alias("a")).join(earliest, ["x", "s"])), scratch)
    open_ = rows.join(if_small(found), "id", "left_anti").select("x", salts, line.alias("a"))
    return found.unionByName(_alike(docs, _pairs(open_.join(rows.select("x", _salt("c").alias("s"), line.alias("b")), ["x", "s"])), scratch)).distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line): all lines, counted from 0, that are like an earlier one.

    Earlier: of a smaller doc_id, or further up in the same document.  Alike: a Jaccard of
    0.75 at least between the sets of five-word runs, A-Z lower-cased; equal lines
    have 1.  A line that goes still makes later ones go.  Lines without words stay.
    Rows of one doc_id count as one document: their lines of one number aren't later
    than each other.  Rows with a null doc_id or text take no part.  Tokens are compared
    as 64-bit hashes, equal texts by 128 bits.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    with Scratch(docs.sparkSession) as scratch:
        dups = _repeated(docs, scratch)
        settled = _settled(docs, _blocks(docs, dups, scratch), scratch).select("id.doc_id", "id.line")
        return scratch.result(dups.unionByName(settled).distinct())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, the text without its repeated lines, and ``n_lines``, ``n_removed`` (long).

    Lines are what stands between line feeds; the others keep their order and form.  A
    null text stays null, with no lines; an empty table gives no rows.  Columns of
    docs that are called n_lines or n_removed are replaced.
    """
    gone = repeated_lines(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list("line").alias("__gone"))
    rows = docs.join(if_small(gone), F.col(id_col).cast("long") == F.col("__id"), "left")
    n = F.length(text_col) - F.length(F.replace(text_col, F.lit("\n"), F.lit(""))) + 1
    rows = rows.withColumn("n_lines", F.coalesce(n, F.lit(0)).cast("long"))
    found = F.size(F.filter("__gone", lambda k: k < F.col("n_lines")))  # rows of one id share their places
    rows = rows.withColumn("n_removed", F.coalesce(F.when(F.col("n_lines") > 0, found), F.lit(0)).cast("long"))
    kept = F.array_except(F.sequence(F.lit(0), (F.col("n_lines") - 1).cast("int")), "__gone")
    rows = rows.withColumn("__all", F.when(F.col("n_removed") > 0, F.split(text_col, "\n")))
    left = F.array_join(F.transform(kept, lambda k: F.get("__all", k)), "\n")
    return rows.withColumn(text_col, F.when(F.col("n_removed") > 0, left).otherwise(F.col(text_col))).drop("__id", "__gone", "__all")


LINE_SQL = r"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS t FROM documents),
w AS (SELECT doc_id, line, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l),
k AS (SELECT array_to_string(w, ' ') AS key, min((doc_id, line)) AS first, any_value(w) AS w FROM w WHERE len(w) > 0 GROUP BY 1),
s AS (SELECT key, CASE WHEN len(w) < 5 THEN [key] ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM k),
e AS (SELECT key, len(s) AS n, unnest(s) AS x FROM s),
p AS (SELECT a.key AS a, b.key AS b FROM e a JOIN e b ON a.x = b.x AND a.key <> b.key GROUP BY a.key, b.key, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
m AS (SELECT k.key, least(k.first, coalesce(min(o.first), k.first)) AS least FROM k LEFT JOIN p ON p.a = k.key LEFT JOIN k o ON o.key = p.b GROUP BY k.key, k.first),
g AS (SELECT doc_id, list(line ORDER BY line) AS gone FROM w JOIN m ON m.key = array_to_string(w.w, ' ') WHERE len(w.w) > 0 AND m.least < (doc_id, line) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  CASE WHEN gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""
