"""Queries of the genomics engine over the driver's tables, and their SQL.

Numbers from kernels are rounded in both, as sums in another order differ in the last digits.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import sequences as S
from .model.hmm import HmmParameters, coding_hmm
from .model.likelihood import DECIBANS, branch_matrices
from .model.species import example_model, model_info
from .operators import alignments as A
from .operators import annotate as N
from .operators import orfs as O
from .operators import scoring as C
from .operators import tracks as T
from .operators.annotate import place_sequences
from .operators.kept import Kept
from .operators.search import gapped_search
from .sources import sinks as K
from .sources import text as R
from .sources.bigwig import write_big_wig

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MODEL = example_model()
PAIR = example_model("(a:0.1,b:0.2);")
HMM = coding_hmm(HmmParameters(0.1, 20.0, (0.4, 0.3, 0.3), (60.0, 200.0, 20.0)))
#: the same worked out by hand, for SQL
START = (0.1, 0.24, 0.6, 0.06)
MOVE = ((0.95, 0.02, 0.015, 0.015), (1 / 60, 59 / 60, 0.0, 0.0), (0.005, 0.0, 0.995, 0.0), (0.05, 0.0, 0.0, 0.95))


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_CODONS = "[s[CAST(i * 3 + 1 AS INT):CAST(i * 3 + 3 AS INT)] FOR i IN range(0, length(s) // 3)]".replace("s[", "dna[").replace("length(s)", "length(dna)")
_AMINO = "".join(S.AMINO)
_ID = "(instr('ACGT', c[1:1]) - 1) * 16 + (instr('ACGT', c[2:2]) - 1) * 4 + instr('ACGT', c[3:3]) - 1"
_D = "d AS (SELECT doc_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS dna FROM documents)"


# --- functions (F1-F21, K6)
@query(f"WITH {_D} SELECT doc_id, reverse(translate(dna, 'ACGT', 'TGCA')) AS turned, translate(lower(dna), 'acgt', 'tgca') AS other FROM d")
def fn_reverse_complement(spark, sf):
    return X.dna(spark, sf).select("doc_id", S.reverse_complement("dna").alias("turned"), S.complement(F.lower("dna")).alias("other"))


@query(f"WITH {_D}, c AS (SELECT doc_id, unnest({_CODONS}) AS c FROM d) SELECT c AS codon, CAST({_ID} AS INT) AS id, substr('{_AMINO}', CAST({_ID} AS INT) + 1, 1) AS amino, count(*) AS n, c IN ('TAA', 'TAG', 'TGA') AS stop FROM c GROUP BY c")
def fn_codon_counts(spark, sf):
    rows = X.dna(spark, sf).select(F.explode(S.codons("dna")).alias("codon"))
    rows = rows.groupBy("codon").agg(F.count("*").alias("n"))
    return rows.select("codon", S.codon_id("codon").alias("id"), S.amino(S.codon_id("codon")).alias("amino"), "n", S.is_stop("codon").alias("stop"))


@query(f"WITH {_D} SELECT doc_id, coalesce(array_to_string([substr('{_AMINO}', CAST({_ID} AS INT) + 1, 1) FOR c IN {_CODONS}], ''), '') AS peptide FROM d")
def fn_translate(spark, sf):
    return X.dna(spark, sf).select("doc_id", S.peptide("dna").alias("peptide"))


@query(f"WITH {_D}, c AS (SELECT doc_id, {_CODONS} AS c FROM d) SELECT doc_id, array_to_string([c FOR c IN c], '') AS codons, CAST(len(c) AS INT) AS n FROM c")
def fn_codon_decode(spark, sf):
    """Codons of documents as numbers and back."""
    rows = X.dna(spark, sf).select("doc_id", F.transform(S.codons("dna"), lambda c: S.codon_id(c)).alias("ids"))
    return rows.select("doc_id", F.array_join(F.transform("ids", lambda i: S.codon_text(i)), "").alias("codons"), F.size("ids").alias("n"))


@query(f"WITH {_D} SELECT k AS frame, w AS strand, doc_id, CAST(least(CASE WHEN w = '-' THEN (((k - (50000 - (doc_id + 1 + length(dna)) + 2)) % 3) + 3) % 3 ELSE (((k - doc_id - 1) % 3) + 3) % 3 END, length(dna)) AS INT) AS skip FROM d, (VALUES (1), (2), (3)) k(k), (VALUES ('+'), ('-')) w(w)")
def fn_frame_skip(spark, sf):
    rows = X.dna(spark, sf).select("doc_id", "dna", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("frame")).select("*", F.explode(F.array(F.lit("+"), F.lit("-"))).alias("strand"))
    return rows.select("frame", "strand", "doc_id", S.frame_skip("strand", "frame", F.col("doc_id") + 1, F.length("dna"), F.lit(50000)).alias("skip"))


@query("SELECT event_id, regexp_replace(printf('%.3f', CAST(CAST(value AS FLOAT) AS DOUBLE)), '(\\.[0-9]+?)0+$', '\\1') AS text FROM events")
def fn_number_trim(spark, sf):
    return X.table(spark, sf, "events").select("event_id", S.trimmed("value").alias("text"))


@query("SELECT event_id, CASE WHEN p < 1e-15 THEN -15.0 WHEN p > 1 - 1e-15 THEN 15.0 ELSE round(log10(p / (1 - p)), 6) END AS odds, round(pow(10.0, value / 1000), 6) AS ratio, CAST(CASE WHEN value / 50 < 1 THEN 210 WHEN value / 50 > 7 THEN 0 ELSE 210 - 30 * floor(value / 50) END AS INT) AS shade FROM (SELECT event_id, value, least(value / 400.0, 1.0) AS p FROM events)")
def fn_odds_and_colour(spark, sf):
    rows = X.table(spark, sf, "events").select("event_id", "value", F.least(F.col("value") / 400.0, F.lit(1.0)).alias("p"))
    return rows.select("event_id", F.round(S.log_odds("p"), 6).alias("odds"), F.round(S.emission(F.col("value") / 100), 6).alias("ratio"), S.colour(F.col("value") / 50).alias("shade"))


@query(f"WITH {X.FEATURE_SQL} SELECT line_no, chrom || ':' || \"begin\" || '-' || \"end\" || '#' || strand AS key, CAST(CASE WHEN strand = '-' THEN (((30001 - \"end\" + phase) % 3) + 3) % 3 + 3 ELSE (phase + \"begin\" - 1) % 3 END AS INT) AS frame FROM f")
def fn_place_and_frame(spark, sf):
    f = X.features(spark, sf)
    return f.select("line_no", S.place_key("chrom", "begin", "end", "strand").alias("key"), S.track_frame("strand", "phase", "begin", "end", F.lit(30001)).alias("frame"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'transcript_id \"T' || event_id || '.1\";' ELSE 'transcript_id=T' || event_id || '.1;' END AS id, CASE WHEN event_id % 2 = 0 THEN 'gtf' ELSE 'gff' END AS style FROM events")
def fn_attributes(spark, sf):
    e = X.table(spark, sf, "events")
    name = F.concat(F.lit("T"), F.col("event_id").cast("string"), F.lit(".1"))
    attrs = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('gene_id "g"; transcript_id "'), name, F.lit('"; x "y";'))).otherwise(F.concat(F.lit("ID=g;transcript_id="), name, F.lit(";x=y")))
    return e.select("event_id", attrs.alias("a")).select("event_id", S.transcript_id("a").alias("id"), S.attribute_style("a").alias("style"))


# --- alignments (S3-S9, F8, W1) and their rows
def _maf(spark, sf) -> DataFrame:
    """Alignment rows from the msa: one block an alignment, 700 bases apart on three chromosomes, with gaps in the reference."""
    rows = X.msa(spark, sf).select("aln_id", F.posexplode("seqs").alias("k", "text"))
    names = F.element_at(F.array(*map(F.lit, ("A.one", "b", "C", "other"))), F.col("k") + 1)
    text = F.when((F.col("k") == 0) & (F.length("text") > 9), F.concat(F.substring("text", 1, 3), F.lit("--"), F.expr("substring(text, 6)"))).otherwise(F.col("text"))
    return rows.select(F.lit("f").alias("file"), F.col("aln_id").alias("block_id"), F.col("k").alias("row_no"), F.substring_index(names, ".", 1).alias("species"), F.concat(F.lit("chr"), (F.col("aln_id") % 3).cast("string")).alias("chrom"),
        (F.floor(F.col("aln_id") / 3) * 700).alias("start0"), F.length("text").cast("long").alias("size"), F.lit("+").alias("strand"), F.lit(1_000_000).cast("long").alias("src_size"), text.alias("text"))


_GAPLESS = "CASE WHEN length(s0) > 9 THEN {s}[1:3] || {s}[6:] ELSE {s} END"


@query(f"WITH {X.MSA_SQL} SELECT aln_id AS block_id, 'chr' || aln_id % 3 AS chrom, aln_id // 3 * 700 + 1 AS start, {_GAPLESS.format(s='s0')} AS ref, {_GAPLESS.format(s='s1')} AS second, repeat('N', length({_GAPLESS.format(s='s0')})) AS fourth FROM m")
def maf_blocks(spark, sf):
    groups = A.blocks(A.resolve_species(_maf(spark, sf), MODEL.leaves), 4, tracks=True)
    return groups.select("block_id", "chrom", "start", F.col("seqs")[0].alias("ref"), F.col("seqs")[1].alias("second"), F.col("seqs")[3].alias("fourth"))


@query("""WITH n AS (SELECT lower(n_name) AS name, n_regionkey % 3 = 0 AS mapped FROM nation), l AS (SELECT unnest(['a', 'b', 'c', 'd']) AS leaf, unnest([0, 1, 2, 3]) AS k)
SELECT name, 'unresolved' AS kind FROM n WHERE NOT mapped UNION ALL SELECT leaf, 'never seen' FROM l WHERE k NOT IN (SELECT DISTINCT n_nationkey % 2 FROM nation WHERE n_regionkey % 3 = 0)""")
def species_reports(spark, sf):
    """Rows named after nations, of which a mapping of names knows some: what it does not know, and what no row is."""
    nation = X.table(spark, sf, "nation")
    aliases = nation.where("n_regionkey % 3 = 0").select(F.lower("n_name").alias("alias"), F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("n_nationkey") % 2 + 1).cast("int")).alias("name"))
    rows = nation.select(F.col("n_name").alias("species"))
    unknown = A.unresolved(rows, MODEL.leaves, aliases).select(F.col("species").alias("name"), F.lit("unresolved").alias("kind"))
    return unknown.unionByName(A.never_seen(rows, MODEL.leaves, aliases).select(F.col("leaf").alias("name"), F.lit("never seen").alias("kind")))


@query(f"WITH {X.MSA_SQL}, r AS (SELECT aln_id, unnest([0, 1, 2, 3]) AS k, unnest([s0, s1, s2, s3]) AS s FROM m) SELECT aln_id AS block_id, CAST(k AS INT) AS leaf, length(CASE WHEN k = 0 AND length(s) > 9 THEN s[1:3] || '--' || s[6:] ELSE s END) AS size FROM r")
def species_aliases(spark, sf):
    """Rows by leaf, the fourth species under another name, the first under its own in capitals."""
    aliases = spark.createDataFrame([("other", "d"), ("another", "a")], "alias string, name string")
    return A.resolve_species(_maf(spark, sf), MODEL.leaves, aliases).select("block_id", "leaf", F.length("text").cast("long").alias("size"))


def _whole_blocks(spark, sf) -> DataFrame:
    """All alignments as blocks of their own length, a hundred on a chromosome; those of every sixteenth leave 60 bases free before them."""
    order = Window.partitionBy("chrom").orderBy("aln_id")
    rows = X.msa(spark, sf).withColumn("chrom", F.concat(F.lit("c"), F.floor(F.col("aln_id") / 100).cast("string"))).withColumn("size", F.length(F.col("seqs")[0]))
    end = F.sum(F.col("size") + F.when(F.col("aln_id") % 16 == 0, 60).otherwise(0)).over(order)
    return rows.select(F.lit("f").alias("file"), F.col("aln_id").alias("block_id"), "chrom", (end - F.col("size") + 1).alias("start"), F.lit("+").alias("strand"), F.lit(10_000_000).cast("long").alias("chrom_len"), "seqs")


_BLOCKS = """p AS (SELECT aln_id, 'c' || CAST(aln_id // 100 AS VARCHAR) AS chrom, s0 AS s, length(s0) AS size FROM m),
b AS (SELECT *, sum(size + CASE WHEN aln_id % 16 = 0 THEN 60 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY aln_id) - size + 1 AS start FROM p),
n AS (SELECT *, CASE WHEN lag(start + size) OVER w = start THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY chrom ORDER BY start, aln_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, aln_id) AS island FROM n)"""


@query(f"WITH {X.MSA_SQL}, {_BLOCKS} SELECT chrom, CAST(min(start) AS BIGINT) AS start, string_agg(s, '' ORDER BY start, aln_id) AS ref, CAST(sum(size) AS BIGINT) AS own FROM i GROUP BY chrom, island")
def stitched_blocks(spark, sf):
    return A.stitched(_whole_blocks(spark, sf)).select("chrom", "start", F.col("seqs")[0].alias("ref"), F.col("own").cast("long").alias("own"))


# --- likelihoods (M5-M14)
def _alignments(spark, sf) -> DataFrame:
    return X.msa(spark, sf).select("aln_id", "seqs")


def _pairs(spark, sf) -> DataFrame:
    """The first two and the last two rows of each alignment, over a tree of two leaves."""
    two = F.array(*[F.struct(F.lit(k).alias("pair"), F.slice("seqs", 2 * k + 1, 2).alias("seqs")) for k in (0, 1)])
    return X.msa(spark, sf).select("aln_id", F.explode(two).alias("p")).select("aln_id", "p.pair", "p.seqs")


@query()
def score_msa_fixed(spark, sf):
    """Score, ancestral score and branch-length score of each alignment over the four-leaf tree."""
    s = C.score_alignments(_alignments(spark, sf), MODEL, "FIXED", True)
    return s.select("aln_id", F.round("phylo", 4).alias("phylo"), F.round("anc", 4).alias("anc"), F.round("bls", 6).alias("bls"))


def _pair_sql() -> str:
    """Log ratio of codon pairs over a tree of two leaves, from the matrices as constants."""
    logs = []
    for r in (PAIR.coding, PAIR.noncoding):
        p = branch_matrices(PAIR.tree, r)
        full = np.concatenate((p, p.sum(2, keepdims=True)), 2)
        logs.append(np.log(np.einsum("x,xa,xb->ab", r.prior, full[0], full[1])))
    table = DECIBANS * (logs[0] - logs[1])
    values = ", ".join(repr(float(v)) for v in table.ravel())
    ids = lambda s: f"[CASE WHEN regexp_matches(c, '^[ACGT]{{3}}$') THEN {_ID} ELSE 64 END FOR c IN [{s}[CAST(i * 3 + 1 AS INT):CAST(i * 3 + 3 AS INT)] FOR i IN range(0, length({s}) // 3)]]"
    return f"WITH {X.MSA_SQL}, v AS (SELECT [{values}] AS t), mm AS (SELECT aln_id, 0 AS pair, s0 AS s0, s1 AS s1 FROM m UNION ALL SELECT aln_id, 1, s2, s3 FROM m), k AS (SELECT aln_id, pair, unnest({ids('s0')}) AS a, unnest({ids('s1')}) AS b FROM mm)"


@query(_pair_sql() + ", s AS (SELECT aln_id, pair, sum(t[CAST(a * 65 + b + 1 AS INT)]) AS phylo FROM k, v GROUP BY 1, 2) SELECT mm.aln_id, mm.pair, round(coalesce(s.phylo, 0), 4) + 0.0 AS phylo FROM mm LEFT JOIN s ON s.aln_id = mm.aln_id AND s.pair = mm.pair")
def score_msa_pair(spark, sf):
    s = C.score_alignments(_pairs(spark, sf), PAIR, "FIXED")
    return s.select("aln_id", "pair", (F.round("phylo", 4) + 0.0).alias("phylo"))


@query(_pair_sql() + " SELECT a * 65 + b AS pair, count(*) AS n, round(any_value(t[CAST(a * 65 + b + 1 AS INT)]), 6) + 0.0 AS score FROM k, v GROUP BY 1")
def score_codon_columns(spark, sf):
    rows = C.score_codons(_pairs(spark, sf).select("seqs"), PAIR, codons=True)
    pair = F.col("codons")[0] * 65 + F.col("codons")[1]
    return rows.select(pair.cast("long").alias("pair"), "score").groupBy("pair").agg(F.count("*").alias("n"), (F.round(F.first("score"), 6) + 0.0).alias("score"))


@query()
def score_msa_mle(spark, sf):
    """Maximum-likelihood tree scales over each alignment (a fit an alignment)."""
    return C.score_alignments(_alignments(spark, sf), MODEL, "MLE", True).select("aln_id", F.round("phylo", 3).alias("phylo"), F.round("anc", 3).alias("anc"))


@query()
def score_msa_omega(spark, sf):
    """Mechanistic fits over each alignment."""
    return C.score_alignments(_alignments(spark, sf), MODEL, "OMEGA").select("aln_id", F.round("phylo", 2).alias("phylo"))


def _base_sql() -> str:
    """(aln_id, i, bls) as e: the branch-length score of each base of each alignment, from the six branches of the tree."""
    branches = (("p0", "p1 OR p2 OR p3", 0.1), ("p1", "p0 OR p2 OR p3", 0.2), ("p2", "p0 OR p1 OR p3", 0.15), ("p3", "p0 OR p1 OR p2", 0.1), ("p0 OR p1", "p2 OR p3", 0.05), ("p2 OR p3", "p0 OR p1", 0.08))
    total = " + ".join(f"CASE WHEN ({u}) AND ({v}) THEN {x} ELSE 0 END" for u, v, x in branches)
    seen = ", ".join(f"s{k}[CAST(i AS INT):CAST(i AS INT)] <> 'N' AS p{k}" for k in range(4))
    return f"WITH {X.MSA_SQL}, b AS (SELECT aln_id, unnest(range(1, length(s0) + 1)) AS i, s0, s1, s2, s3 FROM m), p AS (SELECT aln_id, i, {seen} FROM b), e AS (SELECT aln_id, i, CAST({total} AS DOUBLE) / 0.68 AS bls FROM p)"


@query(_base_sql() + ", w AS (SELECT aln_id, avg(bls) AS bls FROM e GROUP BY 1) SELECT m.aln_id, round(coalesce(bls, 0), 6) AS bls FROM m LEFT JOIN w ON w.aln_id = m.aln_id")
def branch_length_scores(spark, sf):
    return C.score_alignments(_alignments(spark, sf), MODEL, "FIXED").select("aln_id", F.round("bls", 6).alias("bls"))


@query(f"WITH {X.MSA_SQL}, s AS (SELECT unnest([s0, s1, s2, s3]) AS dna FROM m), c AS (SELECT unnest({_CODONS}) AS c FROM s), k AS (SELECT c FROM c WHERE regexp_matches(c, '^[ACGT]{{3}}$')), gg AS (SELECT p AS place, c[CAST(p + 1 AS INT):CAST(p + 1 AS INT)] AS base, count(*) AS n FROM k, range(0, 3) r(p) GROUP BY 1, 2) SELECT CAST(x.p AS INT) AS place, y.b AS base, coalesce(n, 0) + 1 AS n FROM range(0, 3) x(p), (VALUES ('A'), ('C'), ('G'), ('T')) y(b) LEFT JOIN gg ON gg.place = x.p AND gg.base = y.b")
def codon_base_counts(spark, sf):
    return C.base_counts(_alignments(spark, sf))


# --- tracks (A1, F11, K2-K5, H1-H4)
@query()
def build_raw_tracks(spark, sf):
    """Six frames of codon scores of stitched blocks, with enough power."""
    return T.raw_tracks(A.stitched(_whole_blocks(spark, sf)), MODEL).select("chrom", "frame", "pos", F.round("score", 4).alias("score"), F.round("power", 6).alias("power"))


_SPANS = "SELECT aln_id, 'c' || CAST(aln_id // 100 AS VARCHAR) AS chrom, sum(length(s0) + CASE WHEN aln_id % 16 = 0 THEN 60 ELSE 0 END) OVER (PARTITION BY aln_id // 100 ORDER BY aln_id) - length(s0) + 1 AS start FROM m"
_POWER = f"""{_base_sql()}, l AS ({_SPANS}), y AS (SELECT chrom, CAST(start + i - 1 AS BIGINT) AS base, bls FROM e JOIN l USING (aln_id))
SELECT chrom, base // 3 * 3 AS pos, round(avg(bls), 6) AS power FROM y GROUP BY 1, 2 HAVING count(*) = 3"""


@query(_POWER)
def build_power_track(spark, sf):
    return T.power_track(A.stitched(_whole_blocks(spark, sf)), MODEL).select("chrom", "pos", F.round("power", 6).alias("power"))


@query(_POWER[: _POWER.index("SELECT chrom, base // 3")].rstrip() + """, k AS (SELECT chrom, base, bls, lead(base, 2) OVER w AS last, lead(bls) OVER w AS b1, lead(bls, 2) OVER w AS b2 FROM y WINDOW w AS (PARTITION BY chrom ORDER BY base))
SELECT chrom, base AS pos, round(bls + b1 + b2, 6) AS total FROM k WHERE last = base + 2 AND bls + b1 + b2 >= 0.3""")
def codon_power(spark, sf):
    """Places of codons with the power that tracks ask for."""
    s = A.stitched(_whole_blocks(spark, sf)).select("file", "block_id", "chrom", "start", "seqs")
    return T.codon_power(C.score_bases(s, MODEL)).where("total >= 0.3").select("chrom", "pos", F.round("total", 6).alias("total"))


@query(f"""WITH {X.MSA_SQL}, l AS ({_SPANS}), a AS (SELECT aln_id, chrom, start, s0, length(s0) AS n FROM m JOIN l USING (aln_id)),
w AS (SELECT *, least(((k - start) % 3 + 3) % 3, n) AS ahead, least(((k - (10000000 - (start + n) + 2)) % 3 + 3) % 3, n) AS back FROM a, (VALUES (1), (2), (3)) k(k))
SELECT chrom, aln_id, '+' || k AS frame, CAST(start + ahead AS BIGINT) AS first, substr(s0, CAST(ahead + 1 AS BIGINT)) AS seq FROM w
UNION ALL SELECT chrom, aln_id, '-' || k, CAST(start + n - 3 - back AS BIGINT), substr(reverse(translate(s0, 'ACGT', 'TGCA')), CAST(back + 1 AS BIGINT)) FROM w""")
def alignment_frames(spark, sf):
    """The reference of every alignment in six frames, with the place of the first codon on the forward strand."""
    rows = A.in_frames(_whole_blocks(spark, sf).withColumn("own", F.length(F.col("seqs")[0])))
    return rows.select("chrom", F.col("block_id").alias("aln_id"), "frame", F.col("first").cast("long").alias("first"), F.col("seqs")[0].alias("seq"))


@query(f"WITH {X.TRACK_SQL}, g AS (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY chrom, frame ORDER BY pos) = pos - 3 THEN 0 ELSE 1 END AS new FROM t), h AS (SELECT *, max(CASE WHEN new = 1 THEN pos END) OVER (PARTITION BY chrom, frame ORDER BY pos) AS segment FROM g) SELECT chrom, frame, segment, count(*) AS n, round(avg(score), 6) AS mean FROM h GROUP BY 1, 2, 3")
def track_segments(spark, sf):
    return T.segments(X.tracks(spark, sf)).groupBy("chrom", "frame", "segment").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"WITH {X.TRACK_SQL}, g AS (SELECT *, coalesce(lag(pos) OVER (PARTITION BY chrom, frame ORDER BY pos) <> pos - 3, true) AS new FROM t) SELECT frame, chrom, pos, CAST(nth AS INT) AS nth, line FROM (SELECT frame, chrom, pos, unnest(CASE WHEN new THEN [0, 1] ELSE [0] END) AS nth, unnest(CASE WHEN new THEN ['fixedStep chrom=' || chrom || ' start=' || pos || ' step=3 span=3', v] ELSE [v] END) AS line FROM (SELECT *, regexp_replace(printf('%.3f', CAST(CAST(score AS FLOAT) AS DOUBLE)), '(\\.[0-9]+?)0+$', '\\1') AS v FROM g))")
def fixed_step_lines(spark, sf):
    out = None
    for frame in R.FRAMES:
        one = K.fixed_step_lines(X.tracks(spark, sf).where(F.col("frame") == frame)).withColumn("frame", F.lit(frame))
        out = one if out is None else out.unionByName(one)
    return out


def _hmm_sql(frames: str) -> str:
    """(chrom, frame, segment, k, n, pos, log_odds) as o: forward and backward passes, a step a codon; nn has the emissions."""
    start, move = START, MOVE
    step = lambda f, e: ", ".join("(" + " + ".join(f"{f}[{i + 1}] * {move[i][j]!r}" for i in range(4)) + f") * {e if j == 0 else '1.0'} AS v{j}" for j in range(4))
    return f"""WITH RECURSIVE {X.TRACK_SQL}, r AS (SELECT chrom, frame, pos, round(score, 3) AS score FROM t WHERE {frames}),
g AS (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY chrom, frame ORDER BY pos) = pos - 3 THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT *, max(CASE WHEN new = 1 THEN pos END) OVER (PARTITION BY chrom, frame ORDER BY pos) AS segment FROM g),
nn AS (SELECT chrom, frame, segment, pos, pow(10.0, score / 10) AS e, row_number() OVER (PARTITION BY chrom, frame, segment ORDER BY pos) AS k, count(*) OVER (PARTITION BY chrom, frame, segment) AS n FROM s),
f AS (SELECT chrom, frame, segment, k, [{start[0]!r} * e, {start[1]!r}, {start[2]!r}, {start[3]!r}] AS v FROM nn n WHERE k = 1
  UNION ALL SELECT chrom, frame, segment, k, [v0 / greatest(v0, v1, v2, v3), v1 / greatest(v0, v1, v2, v3), v2 / greatest(v0, v1, v2, v3), v3 / greatest(v0, v1, v2, v3)] FROM (SELECT n.chrom, n.frame, n.segment, n.k, {step('f.v', 'n.e')} FROM f JOIN nn n ON n.chrom = f.chrom AND n.frame = f.frame AND n.segment = f.segment AND n.k = f.k + 1)),
b AS (SELECT chrom, frame, segment, k, [1.0, 1.0, 1.0, 1.0]::DOUBLE[] AS v FROM nn n WHERE k = n
  UNION ALL SELECT chrom, frame, segment, k, [v0 / greatest(v0, v1, v2, v3), v1 / greatest(v0, v1, v2, v3), v2 / greatest(v0, v1, v2, v3), v3 / greatest(v0, v1, v2, v3)] FROM (SELECT b.chrom, b.frame, b.segment, b.k - 1 AS k, {", ".join("(" + " + ".join(f"{move[i][j]!r} * b.v[{j + 1}]" + (" * n.e" if j == 0 else "") for j in range(4)) + f") AS v{i}" for i in range(4))} FROM b JOIN nn n ON n.chrom = b.chrom AND n.frame = b.frame AND n.segment = b.segment AND n.k = b.k)
  WHERE k > 0),
p AS (SELECT n.chrom, n.frame, n.segment, n.k, n.n, n.pos, f.v[1] * b.v[1] AS c, f.v[1] * b.v[1] + f.v[2] * b.v[2] + f.v[3] * b.v[3] + f.v[4] * b.v[4] AS a FROM nn n JOIN f USING (chrom, frame, segment, k) JOIN b USING (chrom, frame, segment, k)),
o AS (SELECT chrom, frame, segment, k, n, pos, round(CASE WHEN c / a < 1e-15 THEN -15.0 WHEN c / a > 1 - 1e-15 THEN 15.0 ELSE log10((c / a) / (1 - c / a)) END, 4) AS log_odds FROM p)"""


def _region_sql() -> str:
    """(chrom, frame, begin, end, log_odds) as z: runs of coding codons on the best path, found with pointers back."""
    start, move = START, MOVE
    ways = [[f"x.v[{i + 1}] * {move[i][j]!r}" for i in range(4)] for j in range(4)]
    best = ", ".join(f"greatest({', '.join(w)}){' * n.e' if j == 0 else ''} AS v{j}" for j, w in enumerate(ways))
    came = ", ".join(f"list_position([{', '.join(w)}], greatest({', '.join(w)}))" for w in ways)
    most = "greatest(v0, v1, v2, v3)"
    key = "n.chrom = x.chrom AND n.frame = x.frame AND n.segment = x.segment"
    return f"""{_hmm_sql("frame <> 'power'")},
q AS (SELECT chrom, frame, segment, k, [{start[0]!r} * e, {start[1]!r}, {start[2]!r}, {start[3]!r}] AS v, CAST([1, 1, 1, 1] AS INT[]) AS came FROM nn WHERE k = 1
  UNION ALL SELECT chrom, frame, segment, k, [v0 / {most}, v1 / {most}, v2 / {most}, v3 / {most}], came FROM (SELECT n.chrom, n.frame, n.segment, n.k, {best}, CAST([{came}] AS INT[]) AS came FROM q x JOIN nn n ON {key} AND n.k = x.k + 1)),
u AS (SELECT q.chrom, q.frame, q.segment, q.k, CAST(list_position(q.v, list_max(q.v)) AS INT) AS state, q.came FROM q JOIN nn n ON n.chrom = q.chrom AND n.frame = q.frame AND n.segment = q.segment AND n.k = q.k WHERE q.k = n.n
  UNION ALL SELECT n.chrom, n.frame, n.segment, n.k, x.came[x.state], n.came FROM u x JOIN q n ON {key} AND n.k = x.k - 1),
st AS (SELECT o.*, u.state, count(CASE WHEN u.state = 1 THEN 1 END) OVER (PARTITION BY o.chrom, o.frame, o.segment) AS coding FROM o JOIN u USING (chrom, frame, segment, k)),
co AS (SELECT *, row_number() OVER (PARTITION BY chrom, frame, segment ORDER BY pos) AS nth FROM st WHERE state = 1 AND n > 1 AND NOT (n = 2 AND coding = 2)),
z AS (SELECT chrom, frame, min(pos) - 1 AS "begin", max(pos) + 2 AS "end", max(log_odds) AS log_odds FROM co GROUP BY chrom, frame, segment, k - nth)"""


@query(_hmm_sql("frame <> 'power'") + " SELECT chrom, frame, segment, pos, log_odds FROM o")
def smooth_tracks(spark, sf):
    s = T.smooth(X.tracks(spark, sf).where("frame <> 'power'"), HMM)
    return s.select("chrom", "frame", "segment", "pos", F.round("log_odds", 4).alias("log_odds"))


@query(_region_sql() + ' SELECT chrom, frame, "begin", "end", log_odds FROM z')
def coding_regions(spark, sf):
    r = T.regions(T.smooth(X.tracks(spark, sf).where("frame <> 'power'"), HMM))
    return r.select("chrom", "frame", "begin", "end", F.round("log_odds", 4).alias("log_odds"))


@query(_region_sql() + """ SELECT chrom, "begin", concat_ws(chr(9), chrom, "begin", "end", chrom || ':' || ("begin" + 1) || '-' || "end", '0', frame[1:1], "begin", "end", '0,0,0') AS line FROM z""")
def coding_region_lines(spark, sf):
    return K.bed_lines(T.regions(T.smooth(X.tracks(spark, sf).where("frame <> 'power'"), HMM)))


@query()
def score_msa_fixed_mean(spark, sf):
    """Mean log odds of the codons of an alignment after smoothing."""
    return T.mean_smoothed(_alignments(spark, sf), MODEL, HMM).select("aln_id", F.round("phylo", 4).alias("phylo"))


# --- HMM parameters (W2, W3, A8-A10)
def _exons(spark, sf) -> DataFrame:
    return X.features(spark, sf).select("chrom", "strand", F.col("phase").cast("string").alias("phase"), F.col("begin").alias("start"), "end")


_EXONS = f"{X.FEATURE_SQL}, e AS (SELECT chrom, strand, CAST(phase AS VARCHAR) AS phase, \"begin\" AS start, \"end\" FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY chrom, strand, phase ORDER BY start, \"end\") AS k FROM e)"
_KEPT = f"""WITH RECURSIVE {_EXONS}, w AS (SELECT chrom, strand, phase, k, start, "end", CAST(NULL AS BIGINT) AS out_start, CAST(NULL AS BIGINT) AS out_end FROM o WHERE k = 1
  UNION ALL SELECT o.chrom, o.strand, o.phase, o.k, CASE WHEN w."end" >= o.start AND o."end" - o.start <= w."end" - w.start THEN w.start ELSE o.start END, CASE WHEN w."end" >= o.start AND o."end" - o.start <= w."end" - w.start THEN w."end" ELSE o."end" END,
    CASE WHEN w."end" < o.start THEN w.start END, CASE WHEN w."end" < o.start THEN w."end" END FROM w JOIN o ON o.chrom = w.chrom AND o.strand = w.strand AND o.phase = w.phase AND o.k = w.k + 1),
kept AS (SELECT chrom, strand, phase, out_start AS start, out_end AS "end" FROM w WHERE out_start IS NOT NULL UNION ALL SELECT w.chrom, w.strand, w.phase, w.start, w."end" FROM w JOIN (SELECT chrom, strand, phase, max(k) AS k FROM o GROUP BY 1, 2, 3) l USING (chrom, strand, phase, k))"""


@query(_KEPT + ' SELECT chrom, strand, phase, start, "end" FROM kept')
def exons_without_overlaps(spark, sf):
    return T.without_overlaps(_exons(spark, sf))


@query(_KEPT + ', q AS (SELECT *, lead(start) OVER v AS nxt, row_number() OVER v AS k FROM kept WINDOW v AS (PARTITION BY chrom, strand, phase ORDER BY start, "end")) SELECT nxt - "end" - 1 AS gap FROM q WHERE nxt - "end" - 1 > 0 AND k % 2 = 1')
def exon_gap_list(spark, sf):
    return T.exon_gaps(T.without_overlaps(_exons(spark, sf)))


@query(_KEPT + ' SELECT CAST(sum("end" - start + 1) AS BIGINT) AS bases, count(*) AS exons, round(sum("end" - start + 1) / 90000.0 / 6, 9) AS prior, round(sum("end" - start + 1) / count(*) / 3, 6) AS codons FROM kept')
def exon_total_lengths(spark, sf):
    t = T.exon_totals(T.without_overlaps(_exons(spark, sf)), 90_000)
    return t.select("bases", "exons", F.round("prior", 9).alias("prior"), F.round("codons", 6).alias("codons"))


@query()
def hmm_parameters(spark, sf):
    p = T.estimate_hmm(_exons(spark, sf), 90_000)
    rows = [("coding_prior", p.coding_prior), ("coding_length", p.coding_length), *((f"weight_{k}", w) for k, w in enumerate(p.weights)), *((f"length_{k}", x) for k, x in enumerate(p.lengths))]
    return spark.createDataFrame([(n, round(float(v), 6)) for n, v in rows], "name string, value double")


# --- annotation (J1-J3, A2-A4, F20)
_BASES = f"""{X.FEATURE_SQL}, {X.TRACK_SQL}, {X.SIZE_SQL},
c AS (SELECT f.*, CASE WHEN strand = '-' THEN ['-1', '-2', '-3'][CAST((((len - "end" + phase) % 3) + 3) % 3 + 1 AS INT)] ELSE ['+1', '+2', '+3'][CAST((phase + "begin" - 1) % 3 + 1 AS INT)] END AS frame FROM f JOIN z USING (chrom)),
u AS (SELECT line_no, tx_no, chrom, frame, unnest(range("begin", "end" + 1)) AS base FROM c),
tb AS (SELECT chrom, frame, pos + j AS base, score FROM t, range(0, 3) r(j)),
v AS (SELECT u.line_no, u.tx_no, s.score AS s, p.score AS p FROM u LEFT JOIN tb s ON s.chrom = u.chrom AND s.frame = u.frame AND s.base = u.base LEFT JOIN tb p ON p.chrom = u.chrom AND p.frame = 'power' AND p.base = u.base)"""
_MEANS = "round(sum(CASE WHEN s IS NOT NULL AND p IS NOT NULL THEN s * p END) / nullif(sum(CASE WHEN s IS NOT NULL AND p IS NOT NULL THEN p END), 0), 5) AS score_mean, floor(sum(coalesce(p, 0)) / count(*) * 1e8 + 0.37) / 1e8 AS power_mean"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    power = F.floor(F.col("power_mean") * 1e8 + 0.37) / 1e8  # rounded, but not at ties
    score = F.round(F.col("score_mean") + 1e-11 * F.signum("score_mean"), 5)  # ties go away from zero, whatever digits sums have lost
    return df.select(*keys, score.alias("score_mean"), power.alias("power_mean"))


_ANNOTATED = f"WITH {_BASES} SELECT line_no, {_MEANS} FROM v GROUP BY 1"


@query(_ANNOTATED)
def annotate_exons(spark, sf):
    return _rounded(N.annotate(X.features(spark, sf).withColumn("line", F.lit("")), X.tracks(spark, sf), X.sizes(spark)), "line_no")


@query(f"WITH {_BASES} SELECT tx_no, {_MEANS} FROM v GROUP BY 1")
def annotate_transcripts(spark, sf):
    f = X.features(spark, sf).select("file", "line_no", "tx_no", "feature", "chrom", "begin", "end", "strand", "phase")
    tx = f.groupBy("file", "tx_no").agg((F.min("line_no") - 1).alias("line_no"), F.min("chrom").alias("chrom"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("strand").alias("strand"))
    tx = tx.withColumn("feature", F.lit("transcript")).withColumn("phase", F.lit(None).cast("int"))
    out = N.annotate(f.unionByName(tx), X.tracks(spark, sf), X.sizes(spark))
    return _rounded(out.where("feature = 'transcript'"), "tx_no")


@query(f"WITH {X.FEATURE_SQL} SELECT DISTINCT chrom FROM f WHERE chrom NOT IN ('A', 'N')")
def chromosomes_without_size(spark, sf):
    return N.missing_chromosomes(X.features(spark, sf), X.sizes(spark).where("chrom <> 'R'"))


@query(f"WITH {X.FEATURE_SQL}, s AS (SELECT chrom || ':' || \"begin\" || '-' || (\"end\" - phase) || '#' || strand || '#' || phase AS key, min(line_no) AS score FROM f WHERE line_no % 3 <> 0 GROUP BY 1), xx AS (SELECT f.*, s.score FROM f LEFT JOIN s ON s.key = chrom || ':' || \"begin\" || '-' || (\"end\" - phase) || '#' || strand || '#' || phase) SELECT tx_no, round(sum(score * (\"end\" - \"begin\" + 1)) / sum(CASE WHEN score IS NOT NULL THEN \"end\" - \"begin\" + 1 END), 4) AS score FROM xx GROUP BY 1")
def annotate_by_place(spark, sf):
    f = X.features(spark, sf)
    key = F.concat(S.place_key("chrom", "begin", F.col("end") - F.col("phase"), "strand"), F.lit("#"), F.col("phase").cast("string"))
    scores = f.where("line_no % 3 <> 0").select(key.alias("key"), F.col("line_no").cast("double").alias("score"), "line_no")
    return N.transcript_means(N.score_by_place(f, scores)).select("tx_no", F.round("score", 4).alias("score"))


@query(f"WITH {X.FEATURE_SQL} SELECT chrom, \"begin\", \"end\", strand, min(line_no) AS line_no FROM f GROUP BY 1, 2, 3, 4")
def distinct_places(spark, sf):
    return N.distinct_places(X.features(spark, sf)).select("chrom", "begin", "end", "strand", "line_no")


# --- open reading frames (O1, O2, W5, T1-T5)
def _transcripts(spark, sf) -> DataFrame:
    rows = X.dna(spark, sf).select(F.lit("f").alias("file"), F.col("doc_id").alias("tx_no"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("chrom"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("dna").alias("seq"))
    return rows


_ORF = f"""{_D}, q AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END AS strand, CASE WHEN doc_id % 2 = 0 THEN dna ELSE reverse(translate(dna, 'ACGT', 'TGCA')) END AS s FROM d),
i AS (SELECT doc_id, strand, length(s) AS n, i AS p0, s[CAST(i AS INT):CAST(i + 2 AS INT)] AS c FROM q, LATERAL (SELECT unnest(range(1, greatest(length(s) - 1, 1))) AS i)),
o AS (SELECT a.doc_id, a.strand, a.n, a.p0, min(b.p0) AS stop FROM i a JOIN i b ON a.doc_id = b.doc_id AND b.p0 > a.p0 AND (b.p0 - a.p0) % 3 = 0 WHERE a.c = 'ATG' AND b.c IN ('TAA', 'TAG', 'TGA') GROUP BY 1, 2, 3, 4),
r AS (SELECT doc_id AS tx_no, strand, CASE WHEN strand = '+' THEN p0 - 1 ELSE n - (stop + 2) END AS orf_begin, CASE WHEN strand = '+' THEN stop + 2 ELSE n - p0 + 1 END AS orf_end FROM o WHERE stop + 3 - p0 >= 3 * 10)"""


@query(f"WITH {_ORF} SELECT tx_no, strand, orf_begin, orf_end FROM r")
def reading_frames(spark, sf):
    return O.find_orfs(_transcripts(spark, sf), 10).select("tx_no", "strand", "orf_begin", "orf_end")


@query(f"WITH {_ORF}, k AS (SELECT *, row_number() OVER (PARTITION BY tx_no ORDER BY orf_end - orf_begin DESC, orf_begin) AS n FROM r) SELECT tx_no, orf_begin, orf_end FROM k WHERE n = 1")
def longest_reading_frames(spark, sf):
    rows = O.find_orfs(_transcripts(spark, sf), 10).withColumn("orf_score", F.lit(1.0))
    return O.choose(rows, "LONGEST").select("tx_no", "orf_begin", "orf_end")


@query(f"WITH {X.FEATURE_SQL}, w AS (SELECT line_no, tx_no, strand, \"begin\", \"end\", coalesce(sum(\"end\" - \"begin\" + 1) OVER (PARTITION BY tx_no ORDER BY CASE WHEN strand = '-' THEN -\"begin\" ELSE \"begin\" END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM f) SELECT line_no, CAST((3 - b % 3) % 3 AS INT) AS phase FROM w")
def coding_phases(spark, sf):
    return O.with_phases(X.features(spark, sf).drop("phase"), ["file", "tx_no"]).select("line_no", "phase")


def _genome(spark, sf) -> DataFrame:
    """(chrom, start, seq): every document whole, one after the other on three chromosomes; starts by running sums in and over groups of documents."""
    t = X.dna(spark, sf).select(F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("doc_id") % 3).cast("int") + 1).alias("chrom"), "doc_id", F.floor(F.col("doc_id") / 3000).alias("part"), F.col("dna").alias("seq"))
    sums = t.groupBy("chrom", "part").agg(F.sum(F.length("seq")).alias("size"))
    sums = sums.select("chrom", "part", (F.sum("size").over(Window.partitionBy("chrom").orderBy("part")) - F.col("size")).alias("before"))
    inside = F.sum(F.length("seq")).over(Window.partitionBy("chrom", "part").orderBy("doc_id")) - F.length("seq")
    return t.withColumn("inside", inside).join(sums, ["chrom", "part"]).select("chrom", (F.col("before") + F.col("inside") + 1).alias("start"), "seq")


def _gene_parts(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exons, a genome made of documents, and the ORFs' parts of transcripts of one or more exons."""
    genome, exons = _genome(spark, sf), X.features(spark, sf)
    orfs = O.find_orfs(O.spliced_pieces(exons, genome), 10)
    return exons, genome, O.orf_exons(orfs, exons)


_GENES = f"""WITH {X.FEATURE_SQL}, {X.TRACK_SQL}, {X.SIZE_SQL}, {_D},
gn AS (SELECT ['A', 'N', 'R'][CAST(doc_id % 3 + 1 AS INT)] AS chrom, left(string_agg(dna, '' ORDER BY doc_id), (SELECT max("end") FROM f)) AS g FROM d GROUP BY 1),
ts AS (SELECT tx_no, any_value(f.chrom) AS chrom, any_value(strand) AS strand, string_agg(substr(g, "begin", "end" - "begin" + 1), '' ORDER BY "begin") AS seq FROM f JOIN gn ON gn.chrom = f.chrom GROUP BY 1),
tw AS (SELECT tx_no, strand, CASE WHEN strand = '+' THEN seq ELSE reverse(translate(seq, 'ACGT', 'TGCA')) END AS s FROM ts),
co AS (SELECT tx_no, strand, length(s) AS n, i AS p0, s[CAST(i AS INT):CAST(i + 2 AS INT)] AS c FROM tw, LATERAL (SELECT unnest(range(1, greatest(length(s) - 1, 1))) AS i)),
fr AS (SELECT a.tx_no, a.strand, a.n, a.p0, min(b.p0) AS stop FROM co a JOIN co b ON a.tx_no = b.tx_no AND b.p0 > a.p0 AND (b.p0 - a.p0) % 3 = 0 WHERE a.c = 'ATG' AND b.c IN ('TAA', 'TAG', 'TGA') GROUP BY 1, 2, 3, 4),
orf AS (SELECT tx_no, CASE WHEN strand = '+' THEN p0 - 1 ELSE n - (stop + 2) END AS ob, CASE WHEN strand = '+' THEN stop + 2 ELSE n - p0 + 1 END AS oe FROM fr WHERE stop + 3 - p0 >= 30),
ex AS (SELECT tx_no, chrom, strand, "begin" AS eb, "end" AS ee, sum("end" - "begin" + 1) OVER (PARTITION BY tx_no ORDER BY "begin") - ("end" - "begin" + 1) AS off FROM f),
pt AS (SELECT ex.*, ob, oe, greatest(eb, eb + ob - off) AS b, least(ee, eb + oe - off - 1) AS e FROM ex JOIN orf USING (tx_no)),
ph AS (SELECT tx_no, chrom, strand, ob, oe, b, e, (3 - coalesce(sum(e - b + 1) OVER (PARTITION BY tx_no, ob, oe ORDER BY CASE WHEN strand = '-' THEN -b ELSE b END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 3) % 3 AS phase FROM pt WHERE b <= e),
pf AS (SELECT ph.*, CASE WHEN strand = '-' THEN ['-1', '-2', '-3'][CAST((((len - e + phase) % 3) + 3) % 3 + 1 AS INT)] ELSE ['+1', '+2', '+3'][CAST((phase + b - 1) % 3 + 1 AS INT)] END AS frame FROM ph JOIN z USING (chrom)),
tb AS (SELECT chrom, frame, pos + j AS base, score FROM t, range(0, 3) r(j)),
bs AS (SELECT s.chrom, s.frame, s.base, s.score * p.score AS sp FROM tb s JOIN tb p ON p.chrom = s.chrom AND p.base = s.base AND p.frame = 'power' WHERE s.frame <> 'power'),
wp AS (SELECT DISTINCT chrom, frame, b, e FROM pf),
m1 AS (SELECT w.chrom, w.frame, w.b, w.e, sum(sp) AS sp, count(*) AS n FROM wp w JOIN bs ON bs.chrom = w.chrom AND bs.frame = w.frame AND bs.base BETWEEN w.b AND w.e GROUP BY 1, 2, 3, 4),
m2 AS (SELECT w.chrom, w.frame, w.b, w.e, sum(tb.score) AS pp FROM wp w JOIN tb ON tb.chrom = w.chrom AND tb.frame = 'power' AND tb.base BETWEEN w.b AND w.e GROUP BY 1, 2, 3, 4),
sc AS (SELECT pf.*, coalesce(m1.sp, 0) AS sp, coalesce(m1.n, 0) AS n, coalesce(m2.pp, 0) AS pp FROM pf LEFT JOIN m1 USING (chrom, frame, b, e) LEFT JOIN m2 USING (chrom, frame, b, e)),
oo AS (SELECT *, round(CASE WHEN sum(n) OVER w > 0 THEN sum(sp) OVER w / nullif(sum(pp) OVER w, 0) END, 9) AS orf_score, sum(pp) OVER w / sum(e - b + 1) OVER w AS orf_power FROM sc WINDOW w AS (PARTITION BY tx_no, ob, oe))"""


@query(_GENES + """, k AS (SELECT *, dense_rank() OVER (PARTITION BY tx_no ORDER BY orf_score DESC, ob, oe) AS r FROM oo WHERE orf_score >= -1000)
SELECT tx_no, chrom, strand, CAST(b AS BIGINT) AS "begin", CAST(e AS BIGINT) AS "end", CAST(phase AS INT) AS phase, floor(CASE WHEN n > 0 THEN sp / nullif(pp, 0) END * 1e4 + 0.3719) / 1e4 AS score_mean, floor(orf_score * 1e4 + 0.3719) / 1e4 AS orf_score, floor(orf_power * 1e5 + 0.3719) / 1e5 AS orf_power FROM k WHERE r = 1""")
def find_coding_sequences(spark, sf):
    """Best-scoring reading frame of each transcript with its exons, phases and scores."""
    parts = O.score_orfs(_gene_parts(spark, sf)[2], X.tracks(spark, sf), X.sizes(spark))
    best = O.choose(parts, "BEST_SCORE", -1000.0)
    off_ties = lambda c, unit: (F.floor(F.col(c) * unit + 0.3719) / unit).alias(c)  # noqa: E731, rounded, but not at ties
    return best.select("tx_no", "chrom", "strand", "begin", "end", "phase", off_ties("score_mean", 1e4), off_ties("orf_score", 1e4), off_ties("orf_power", 1e5))


@query(_GENES + """, ok AS (SELECT * FROM oo WHERE orf_score >= 0),
lo AS (SELECT *, dense_rank() OVER (PARTITION BY tx_no ORDER BY oe - ob DESC, ob, oe) AS r FROM ok),
kn AS (SELECT tx_no, string_agg("begin" || '-' || "end", ',' ORDER BY "begin", "end") AS parts FROM f GROUP BY 1),
ev AS (SELECT tx_no, ob, oe, any_value(r) AS r, string_agg(b || '-' || e, ',' ORDER BY b, e) AS parts FROM lo GROUP BY 1, 2, 3),
pe AS (SELECT ev.tx_no, bool_or(ev.parts = kn.parts) AS hit, bool_or(r = 1 AND ev.parts = kn.parts) AS same FROM ev JOIN kn USING (tx_no) GROUP BY 1)
SELECT count(*) AS transcripts, count(kn.parts) AS annotated, count(pe.tx_no) AS with_orf, count(pe.tx_no) AS with_choice, count(CASE WHEN same THEN 1 END) AS same, count(CASE WHEN hit THEN 1 END) AS hit, count(CASE WHEN NOT coalesce(hit, false) THEN 1 END) AS missed FROM kn LEFT JOIN pe USING (tx_no)""")
def evaluate_coding_sequences(spark, sf):
    """Counts over all transcripts; exons, reading frames and their parts are made once each, in jobs whose shuffle files go before the next one's come."""
    with Kept(spark, _folder(spark)) as kept:
        exons = kept(X.features(spark, sf).select("file", "tx_no", "chrom", "strand", "begin", "end", "feature"))
        places = kept(place_sequences(exons, _genome(spark, sf)))
        orfs = kept(O.find_orfs(O.spliced_places(exons, places), 10))
        parts = kept(O.orf_exons(orfs, exons).drop("exon_begin", "exon_end"))
        scored = kept(O.score_orfs(parts, X.tracks(spark, sf), X.sizes(spark)).select("file", "tx_no", "orf_begin", "orf_end", "begin", "end", "orf_score"))
        tx = exons.groupBy("file", "tx_no").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).withColumn("feature", F.lit("transcript"))
        counts = O.evaluation_of(scored, "LONGEST", 0.0, exons.select("file", "tx_no", "begin", "end", "feature").unionByName(tx))
        return spark.createDataFrame(counts.collect(), counts.schema)


@query(f"WITH {_D}, x AS (SELECT doc_id, dna, CAST(doc_id % 20 + 1 AS INT) AS b, CAST(doc_id % 20 + 60 AS INT) AS e, CAST(doc_id % 3 AS INT) AS phase, doc_id % 2 = 0 AS ahead FROM d) SELECT doc_id, CASE WHEN ahead THEN dna[b:e] ELSE reverse(translate(dna[b:e], 'ACGT', 'TGCA')) END[phase + 1:] AS seq FROM x")
def coding_exon_sequences(spark, sf):
    d = X.dna(spark, sf)
    g = d.select(F.col("doc_id").cast("string").alias("chrom"), F.col("dna").alias("seq"))
    cds = d.select("doc_id", F.col("doc_id").cast("string").alias("chrom"), (F.col("doc_id") % 20 + 1).alias("begin"), (F.col("doc_id") % 20 + 60).alias("end"), (F.col("doc_id") % 3).cast("int").alias("phase"), F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"))
    return N.cds_sequences(cds, g).select("doc_id", "seq")


@query(f"""WITH {_D}, w AS (SELECT doc_id, i AS at, dna[CAST(i AS INT):CAST(i + 11 AS INT)] AS word FROM d, LATERAL (SELECT unnest(range(1, greatest(length(dna) - 10, 1))) AS i)),
v AS (SELECT q.doc_id AS query, g.doc_id % 2 AS genome, g.doc_id AS doc, g.at - q.at AS place, count(*) AS score FROM w q JOIN w g ON g.word = q.word WHERE q.doc_id % 5 = 0 GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2 AND g.at - q.at >= 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query, genome ORDER BY score DESC, CAST(doc AS VARCHAR), place) AS n FROM v)
SELECT query, genome, CAST(doc AS VARCHAR) AS target, CAST(place AS INT) AS place, score, rpad(substr(g.dna, place + 1, length(q.dna)), CAST(length(q.dna) AS INT), '-') AS seq FROM k JOIN d g ON g.doc_id = doc JOIN d q ON q.doc_id = query WHERE n = 1""")
def search_sequences(spark, sf):
    """Ungapped hits, by shared 12-mers, of every fifth document's whole sequence in all documents' sequences."""
    d = X.dna(spark, sf)
    q = d.select(F.col("doc_id").alias("query"), F.col("dna").alias("seq")).where("query % 5 = 0")
    g = d.select((F.col("doc_id") % 2).alias("genome"), F.col("doc_id").cast("string").alias("chrom"), F.col("dna").alias("seq"))
    return N.seed_search(q, g).select("query", "genome", "target", "place", "score", "seq")


@query()
def search_sequences_gapped(spark, sf):
    """Gapped hits of the whole sequences of documents whose id is divisible by 50 in all documents, a chromosome each, in two genomes."""
    d = X.dna(spark, sf)
    q = d.select(F.col("doc_id").alias("query"), F.col("dna").alias("seq")).where("query % 50 = 0")
    g = d.select((F.col("doc_id") % 2).alias("genome"), F.col("doc_id").cast("string").alias("chrom"), F.lit(1).cast("long").alias("start"), F.col("dna").alias("seq"))
    return gapped_search(q, g)


@query("WITH a AS (SELECT ['a', 'b', 'c', 'd'][CAST(n_regionkey % 4 + 1 AS INT)] AS s, lower(n_name) AS alias FROM nation) SELECT s AS species, string_agg(alias, ',' ORDER BY alias) AS aliases FROM a GROUP BY 1")
def model_species(spark, sf):
    """The species of a model with the names that a mapping of nations to them gives."""
    leaf = F.element_at(F.array(*map(F.lit, MODEL.leaves)), (F.col("n_regionkey") % 4 + 1).cast("int"))
    mapping = X.table(spark, sf, "nation").select(F.lower("n_name").alias("alias"), leaf.alias("name"))
    return model_info(spark, MODEL, mapping).withColumn("aliases", F.array_join("aliases", ","))


# --- text formats: tables are written as text and come back through the readers
def _folder(spark) -> str:
    """A new folder in that of spark.checkpoint.dir; where it is unset and all runs on one machine, as in tests, in one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{found}/text-{uuid.uuid4().hex}"


def _text(lines: DataFrame, *order: str) -> str:
    path = _folder(lines.sparkSession)
    K.write_lines(lines, path, *order)
    return path


@query(f"WITH {X.MSA_SQL}, r AS (SELECT aln_id, unnest([0, 1, 2, 3]) AS k, unnest([s0, s1, s2, s3]) AS s FROM m WHERE s0 <> '') SELECT ['A', 'b', 'C', 'other'][CAST(k + 1 AS INT)] AS species, 'chr' || aln_id % 3 AS chrom, aln_id // 3 * 700 AS start0, length(s) AS size, CAST(1000000 AS BIGINT) AS src_size, '+' AS strand, CASE WHEN k = 0 AND length(s) > 9 THEN s[1:3] || '--' || s[6:] ELSE s END AS text FROM r")
def read_maf(spark, sf):
    """Alignments as a MAF file; those without a base have no block in it."""
    line = F.concat_ws("\t", F.lit("s"), F.concat_ws(".", "species", "chrom"), "start0", "size", "strand", "src_size", "text")
    blocks = _maf(spark, sf).where("text <> ''").groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("row_no", line.alias("line")))).alias("all"))
    lines = blocks.select("block_id", F.concat(F.lit("a score=0\n"), F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("\n")).alias("line"))
    return R.maf_rows(spark, _text(lines, "block_id")).drop("file", "block_id", "row_no")


@query(f"WITH {X.TRACK_SQL} SELECT chrom, frame, pos, CAST(CASE WHEN frame = 'power' THEN printf('%.4f', CAST(CAST(score AS FLOAT) AS DOUBLE)) ELSE printf('%.3f', CAST(CAST(score AS FLOAT) AS DOUBLE)) END AS DOUBLE) AS score FROM t")
def read_track_set(spark, sf):
    """All seven tracks as fixedStep files, power with four decimals, found again by the path of one."""
    folder = _folder(spark)
    for frame in R.FRAMES:
        lines = K.fixed_step_lines(X.tracks(spark, sf).where(F.col("frame") == frame), 4 if frame == "power" else 3, runs=True)
        # a run of steps is never cut, so that every file begins with a header
        lines.repartitionByRange("chrom", "segment").sortWithinPartitions("chrom", "pos", "nth").select("line").write.text(f"{folder}/raw{frame}.wig")
    return R.track_set(spark, f"{folder}/raw+1.wig").drop("span")


def _intervals(spark, sf, frame: str) -> DataFrame:
    """The codons of a track as intervals, half-open from 0, on the chromosome's own axis."""
    rows = X.tracks(spark, sf).where((F.col("frame") == frame) & (F.col("pos") > 0))
    return rows.select("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") + 2).alias("end"), F.col("score").alias("value"))


def _big_wigs(spark, sf) -> str:
    """All seven tracks as bigWig, a folder each; the path of the first."""
    folder = _folder(spark)
    longest = X.tracks(spark, sf).groupBy("chrom").agg(F.max("pos").alias("n")).collect()
    sizes = {r["chrom"]: r["n"] + 3 for r in longest}
    for frame in R.FRAMES:
        write_big_wig(_intervals(spark, sf, frame), sizes, f"{folder}/track{frame}.bw")
    return f"{folder}/track+1.bw"


@query(f"WITH {X.TRACK_SQL} SELECT chrom, frame, pos, CAST(CAST(score AS FLOAT) AS DOUBLE) AS score, 3 AS span FROM t WHERE pos > 0")
def read_big_wig_tracks(spark, sf):
    """All seven tracks written as bigWig files, a file a range of places, and read back."""
    return R.track_set(spark, _big_wigs(spark, sf))


@query(f"WITH {X.TRACK_SQL} SELECT frame, count(*) AS n, round(sum(CAST(CAST(score AS FLOAT) AS DOUBLE)), 4) AS total FROM t WHERE chrom = 'N' AND pos BETWEEN 1001 AND 2500 GROUP BY 1")
def big_wig_ranges(spark, sf):
    """What begins in a range of one chromosome, looked up through the trees of the files."""
    first, out = _big_wigs(spark, sf), None
    for frame in R.FRAMES:
        one = R.big_wig_track(spark, first.replace("+1", frame), frame, chroms=["N"], begin=1000, end=2500).where("pos between 1001 and 2500")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("frame").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


@query(_ANNOTATED.replace("score FROM t, range", "CAST(CAST(score AS FLOAT) AS DOUBLE) AS score FROM t, range"))
def annotate_exons_from_big_wig(spark, sf):
    """Exons with scores and power of tracks that are bigWig files."""
    return _rounded(N.annotate(X.features(spark, sf).withColumn("line", F.lit("")), R.track_set(spark, _big_wigs(spark, sf)), X.sizes(spark)), "line_no")


def _gene_lines(spark, sf) -> DataFrame:
    """Transcripts, those of odd numbers in GTF style, and their exons as (tx_no, begin0, line); a comment before each."""
    f = X.features(spark, sf)
    attrs = F.when(F.col("tx_no") % 2 == 1, F.format_string('gene_id "g"; transcript_id "T%d";', "tx_no")).otherwise(F.format_string("ID=g;transcript_id=T%d;", "tx_no"))
    line = lambda kind, phase: F.concat_ws("\t", "chrom", F.lit("x"), F.lit(kind), "begin", "end", F.lit("."), "strand", phase, attrs)
    exon = F.struct(F.col("begin").alias("at"), line("CDS", F.col("phase").cast("string")).alias("line"))
    whole = f.groupBy("tx_no").agg(F.min("chrom").alias("chrom"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("strand").alias("strand"), F.array_sort(F.collect_list(exon)).alias("exons"))
    lines = F.concat(F.array(F.format_string("# %d", "tx_no"), line("transcript", F.lit("."))), F.transform("exons", lambda x: x["line"]))
    return whole.select("tx_no", F.array_join(lines, "\n").alias("line"))


def _genes(spark, sf) -> DataFrame:
    return R.gene_models(spark, _text(_gene_lines(spark, sf), "tx_no"))


_ATTRS = "CASE WHEN tx_no % 2 = 1 THEN 'gene_id \"g\"; transcript_id \"T' || tx_no || '\";' ELSE 'ID=g;transcript_id=T' || tx_no || ';' END"
_LINES = f"""{X.FEATURE_SQL}, tr AS (SELECT tx_no, any_value(chrom) AS chrom, 'transcript' AS feature, min("begin") AS "begin", max("end") AS "end", any_value(strand) AS strand, CAST(NULL AS INT) AS phase FROM f GROUP BY 1),
al AS (SELECT *, {_ATTRS} AS attrs FROM (FROM tr UNION ALL SELECT tx_no, chrom, 'CDS', "begin", "end", strand, phase FROM f)),
li AS (SELECT *, concat_ws(chr(9), chrom, 'x', feature, "begin", "end", '.', strand, coalesce(CAST(phase AS VARCHAR), '.'), attrs) AS line FROM al)"""


@query(f"WITH {_LINES} SELECT chrom, feature, \"begin\", \"end\", strand, coalesce(phase, -1) AS phase, attrs, line FROM li UNION ALL SELECT NULL, NULL, -1, -1, NULL, -1, NULL, '# ' || tx_no FROM tr")
def read_gene_models(spark, sf):
    number = lambda c: F.coalesce(c, F.lit(-1)).alias(c)  # noqa: E731, -1 for what comments and transcripts do not have
    return _genes(spark, sf).select("chrom", "feature", number("begin"), number("end"), "strand", number("phase"), "attrs", "line")


@query(f"WITH {_LINES} SELECT 'T' || tx_no AS id, count(CASE WHEN feature = 'CDS' THEN 1 END) AS exons, sum(\"end\" - \"begin\" + 1)::BIGINT AS bases FROM li GROUP BY 1")
def transcript_numbers(spark, sf):
    """What has one number in a file: a transcript and its exons."""
    rows = _genes(spark, sf).where("chrom is not null")
    name = F.regexp_extract(F.max(F.when(F.col("feature") == "transcript", F.col("attrs"))), "(T[0-9]+)", 1)
    return rows.groupBy("file", "tx_no").agg(name.alias("id"), F.count_if(F.col("feature") == "CDS").alias("exons"), F.sum(F.col("end") - F.col("begin") + 1).alias("bases")).drop("file", "tx_no")


# sevenths and elevenths, so that no number is at a tie of decimals
_SEVENTHS = "printf('%.3f', \"begin\" / 7.0 + 1 / 11.0)"


@query(f"""WITH {_LINES} SELECT CASE WHEN tx_no % 2 = 1 THEN line ELSE rtrim(line, ';') END || CASE WHEN tx_no % 2 = 1 THEN ' coding_score_weighted_mean "' || {_SEVENTHS} || '"; coding_power_mean "nan";' ELSE ';coding_score_weighted_mean=' || {_SEVENTHS} || ';coding_power_mean=nan' END AS line FROM li UNION ALL SELECT '# ' || tx_no FROM tr""")
def annotated_gene_lines(spark, sf):
    rows = _genes(spark, sf).withColumn("score_mean", F.col("begin") / F.lit(7.0) + F.lit(1 / 11.0)).withColumn("power_mean", F.lit(None).cast("double"))
    return K.annotated_lines(rows).select("line")


@query(f"""WITH {_LINES}, ch AS (SELECT * FROM li WHERE tx_no % 4 < 2), id AS (SELECT tx_no, CASE WHEN tx_no % 2 = 1 THEN 'transcript_id "T' || tx_no || '";' ELSE 'transcript_id=T' || tx_no || ';' END AS id FROM tr)
SELECT line FROM ch WHERE feature <> 'CDS' UNION ALL SELECT concat_ws(chr(9), chrom, 'codonflow', 'CDS', "begin" + 1, "end", '.', strand, phase, id || ';coding_score_weighted_mean=' || {_SEVENTHS} || ';coding_power_mean=nan') FROM ch JOIN id USING (tx_no) WHERE feature = 'CDS'""")
def predicted_gene_lines(spark, sf):
    """Of transcripts with a choice, here two of four, all lines but comments, exons replaced by the chosen ones."""
    rows = _genes(spark, sf).where("chrom is not null")
    number = F.regexp_extract("attrs", "T([0-9]+)", 1).cast("long")
    parts = rows.where((F.col("feature") == "CDS") & (number % 4 < 2)).select("file", "tx_no", "chrom", "strand", (F.col("begin") + 1).alias("begin"), "end", "phase", (F.col("begin") / F.lit(7.0) + F.lit(1 / 11.0)).alias("score_mean"), F.lit(None).cast("double").alias("power_mean"), F.lit(0).alias("orf_begin"), F.lit(0).alias("orf_end"))
    return K.predicted_lines(rows, parts).select("line")


@query(f"WITH {_D} SELECT CAST(doc_id AS VARCHAR) AS chrom, dna AS seq FROM d")
def read_genome(spark, sf):
    """Sequences as a FASTA file, 60 bases a line."""
    lines = X.dna(spark, sf).select("doc_id", F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" more\n"), F.regexp_replace("dna", "(.{60})", "$1\n")).alias("line"))
    return R.genome(spark, _text(lines, "doc_id"))


@query(f"WITH {X.FEATURE_SQL} SELECT chrom, strand, CAST(phase AS VARCHAR) AS phase, \"begin\" AS start, \"end\" FROM f")
def read_coding_exons(spark, sf):
    lines = _exons(spark, sf).withColumn("line", F.concat_ws(" ", "chrom", "strand", "phase", "start", "end"))
    return R.coding_exons(spark, _text(lines, "chrom", "start"))


@query(f"WITH {X.FEATURE_SQL} SELECT chrom AS seq, \"begin\" AS start, \"end\", strand, CASE WHEN tx_no % 5 > 0 THEN CAST(printf('%.6f', \"begin\" / 7.0 + 1 / 11.0) AS DOUBLE) END AS score FROM f")
def read_score_file(spark, sf):
    """A score file, header and failed fits included, written and read."""
    f = X.features(spark, sf)
    scores = f.select(F.col("chrom").alias("seq"), F.col("begin").alias("start"), "end", "strand", F.when(F.col("tx_no") % 5 > 0, F.col("begin") / F.lit(7.0) + F.lit(1 / 11.0)).alias("phylo"), F.lit(None).cast("double").alias("anc"), F.lit(0.5).alias("bls"))
    return R.score_file(spark, _text(K.score_lines(scores, True), "line_no"))


@query("SELECT lower(n_name) AS alias, 'leaf' || n_nationkey AS name FROM nation")
def read_name_mapping(spark, sf):
    lines = X.table(spark, sf, "nation").select("n_name", F.concat(F.col("n_name"), F.lit("\tLeaf"), F.col("n_nationkey").cast("string")).alias("line"))
    return R.name_mapping(spark, _text(lines, "n_name"))


@query("SELECT CAST(row_number() OVER (ORDER BY r_name) - 1 AS INT) AS n, r_name AS name, lower(r_name) || '.fa' AS path FROM region")
def read_genome_list(spark, sf):
    """The list is one small file, a line a genome."""
    lines = X.table(spark, sf, "region").orderBy("r_name").select(F.concat("r_name", F.lit("\t"), F.lower("r_name"), F.lit(".fa")).alias("value"))
    path = _folder(spark)
    lines.coalesce(1).write.text(path)
    return R.genome_list(spark, path)


@query(f"WITH {X.MSA_SQL} SELECT aln_id AS query, 'c' || aln_id % 3 AS chrom, aln_id * 10 + 1 AS start, aln_id * 10 + length(s0) AS \"end\", CASE WHEN aln_id % 2 = 0 THEN '+' ELSE '-' END AS strand, CAST(aln_id % 3 AS INT) AS phase, s0 || '/' || s1 || '/' || s2 || '/' || s3 AS seqs FROM m WHERE aln_id % 7 > 0")
def search_alignments(spark, sf):
    """Multiple alignments of a search's result; queries without a hit, here each seventh, have none."""
    m = X.msa(spark, sf).select("aln_id", F.posexplode("seqs").alias("hit_no", "seq")).where("hit_no = 0 or aln_id % 7 > 0")
    size = F.length("seq")
    header = F.concat(F.when(F.col("aln_id") % 4 == 0, F.lit("\x00")).otherwise(F.lit("")), F.lit("c"), (F.col("aln_id") % 3).cast("string"), F.lit(":"), (F.col("aln_id") * 10 + 1).cast("string"), F.lit("-"), (F.col("aln_id") * 10 + size).cast("string"), F.lit("#"), F.when(F.col("aln_id") % 2 == 0, "+").otherwise("-"), F.lit("#"), (F.col("aln_id") % 3).cast("string"))
    out = R.hits_to_alignments(m.select(F.col("aln_id").alias("query"), "hit_no", header.alias("header"), "seq"))
    return out.withColumn("seqs", F.array_join(F.transform("seqs", lambda x: x["seq"]), "/"))


@query(f"WITH {_D}, b AS (SELECT unnest(string_split(dna, '')) AS b FROM d) SELECT b AS base, CAST(instr('ACGT', b) - 1 AS INT) AS id, count(*) AS n FROM b WHERE b <> '' GROUP BY 1")
def fn_base_id(spark, sf):
    rows = X.dna(spark, sf).select(F.explode(F.split("dna", "")).alias("base")).where("base <> ''").groupBy("base").agg(F.count("*").alias("n"))
    return rows.select("base", S.base_id("base").cast("int").alias("id"), "n")


@query("SELECT event_id, round((value - user_id / 7.0) * 10 / ln(10.0), 6) AS score FROM events")
def fn_decibans(spark, sf):
    return X.table(spark, sf, "events").select("event_id", F.round(S.decibans("value", F.col("user_id") / F.lit(7.0)), 6).alias("score"))
