"""Steps whose work grew faster than what they are about."""

import os
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from codonflow import fixtures as X
from codonflow import queries as core
from codonflow.model import fit, hmm, likelihood
from codonflow.model.likelihood import Patterns, branch_matrices, column_scores, inside
from codonflow.operators import annotate as N
from codonflow.operators import orfs as O
from codonflow.operators import scoring
from codonflow.operators import tracks as T
from codonflow.operators.alignments import columns_of
from codonflow.operators.scoring import branch_scores
from codonflow.queries import MODEL, PAIR
from codonflow.sources import sinks as K


def test_exons_of_one_start_meet_the_pass_once(spark):
    rng = random.Random(11)
    rows = [("c", rng.choice("+-"), "0", a, a + rng.choice((-2, -1, 0, 3, 9, 30))) for a in (rng.randint(1, 40) for _ in range(900))]
    df = spark.createDataFrame(rows, "chrom string, strand string, phase string, start long, end long").repartition(5)
    assert T._longest(df.where("start <= end")).count() == len({r[:4] for r in rows if r[3] <= r[4]})
    expected = []
    for way in "+-":
        own = []
        for a, z in sorted(r[3:] for r in rows if r[1] == way):
            if own and own[-1][1] >= a:
                own[-1] = (a, z) if z - a > own[-1][1] - own[-1][0] else own[-1]
            else:
                own.append((a, z))
        expected += [(way, *x) for x in own]
    assert sorted((r.strand, r.start, r.end) for r in T.without_overlaps(df).collect()) == sorted(expected)


def test_a_search_computes_no_value_twice():
    for peak in (-9.0, 0.3, 5.0, 60.0):  # inside the bounds and beyond both
        asked = []
        fit.maximise(lambda x, p=peak: asked.append(x) or -((x - p) ** 2), 1.0, 0.01, 10.0, fit.Draws())
        assert len(asked) == len(set(asked))


def test_tracks_of_alignments_that_overlap(spark, monkeypatch):
    """A base or codon of several alignments is the first one's, in any buckets, and none is lost or there twice."""
    rng = random.Random(12)
    seq = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    blocks, at = [], 1
    for k in range(40):
        n = rng.randint(0, 40)
        blocks.append(("f", k, "c", at, "+", 5000, [seq(n) for _ in range(4)]))
        at += rng.choice((n, n, n + 5, max(1, n // 3)))
    df = spark.createDataFrame(blocks, "file string, block_id long, chrom string, start long, strand string, chrom_len long, seqs array<string>")
    bases, codons = {}, {}
    for _, _, _, a, _, _, seqs in blocks:  # ascending starts
        bls = branch_scores(MODEL.tree, seqs) if seqs[0] else []
        for j, x in enumerate(bls):
            bases.setdefault(a + j, x)
        for j in range(len(bls) - 2):
            codons.setdefault(a + j, sum(bls[j : j + 3]))
    power = {p: sum(bases[p + j] for j in range(3)) / 3 for p in bases if p % 3 == 0 and p + 1 in bases and p + 2 in bases}
    for size in (1_000_000, 50):
        monkeypatch.setattr(T, "BUCKET", size)
        got = [(r.pos, r.power) for r in T.power_track(df, MODEL).collect()]
        assert len(got) == len(power) and all(abs(power[p] - x) < 1e-9 for p, x in got)
        raw = T.raw_tracks(df, MODEL).collect()
        for way in "+-":
            own = sorted((r.pos, r.power) for r in raw if r.frame[0] == way)
            expected = sorted((p, x / 3) for p, x in codons.items() if x >= 0.3)
            assert [p for p, _ in own] == [p for p, _ in expected] and all(abs(x - y) < 1e-9 for (_, x), (_, y) in zip(own, expected, strict=True))


def test_codons_come_in_short_batches(spark, monkeypatch):
    """What a row carries is repeated for few codons at once, and columns are given as numbers."""
    rng = random.Random(13)
    rows = [[k, ["".join(rng.choice("ACGTN") for _ in range(n)) for _ in range(2)], [n, k]] for k, n in enumerate((0, 7, 300, 2, 90))]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], names=["id", "seqs", "keep"])
    whole = None
    for most, ahead in ((10_000, 1 << 24), (16, 1)):
        monkeypatch.setattr(scoring, "ROWS", most)
        monkeypatch.setattr(scoring, "BYTES", ahead)
        out = list(scoring._codons(SimpleNamespace(value=PAIR), True)(iter([batch])))
        assert all(len(b) <= most for b in out)
        got = [tuple(r.values()) for b in out for r in b.to_pylist()]
        assert [(r[0], r[2]) for r in got] == [(k, j) for k, seqs, _ in rows for j in range(len(seqs[0]) // 3)]
        assert [r[4] for r in got] == [c for _, seqs, _ in rows for c in columns_of(seqs).tolist()]
        whole = whole or got
        assert all(a[:3] == b[:3] and a[4] == b[4] and abs(a[3] - b[3]) < 1e-9 for a, b in zip(whole, got, strict=True))


def test_predicted_lines_read_their_inputs_once(spark):
    """Of a transcript with a choice all lines but exons, then the parts in order; parts without a transcript go."""
    kinds = "file string, tx_no long, line_no long, feature string, attrs string, line string"
    features = [("f", 1, 5, "transcript", 'transcript_id "T1";', "t1"), ("f", 1, 9, "CDS", "x", "c1"), ("f", 1, 12, None, None, "# 1"), ("f", 2, 20, "transcript", 'transcript_id "T2";', "t2"), ("f", 3, 30, "exon", "x", "e3"), ("f", 4, 40, "transcript", None, "t4")]
    parts = [("f", tx, "c", "+", a, a + 8, 0, 1.5, None, 0, z) for tx, a, z in ((1, 40, 3), (1, 10, 3), (1, 70, 2), (3, 1, 1), (4, 1, 1))]
    df = spark.createDataFrame(parts, "file string, tx_no long, chrom string, strand string, begin long, end long, phase int, score_mean double, power_mean double, orf_begin long, orf_end long")
    lines = K.predicted_lines(spark.createDataFrame(features, kinds).repartition(3), df.repartition(3))
    got = [(r.tx_no, r.line_no, r.line) for r in lines.orderBy("tx_no", "line_no", "nth").collect()]
    new = lambda a, name: "\t".join(["c", "codonflow", "CDS", str(a), str(a + 8), ".", "+", "0", *[f"{name};coding_score_weighted_mean=1.500;coding_power_mean=nan"] * bool(name)])
    first = 'transcript_id "T1";'
    assert got == [(1, 5, "t1"), *((1, 5, new(a, first)) for a in (70, 10, 40)), (1, 12, "# 1"), (3, 30, "e3"), (4, 40, "t4"), (4, 40, new(1, ""))]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2


def test_lines_of_a_track_know_their_runs(spark):
    track = spark.createDataFrame([("c", p, 1.0) for p in (1, 4, 7, 20, 23)], "chrom string, pos long, score double")
    got = [(r.pos, r.segment, r.nth, r.line) for r in K.fixed_step_lines(track, runs=True).orderBy("pos", "nth").collect()]
    head = "fixedStep chrom=c start=%d step=3 span=3"
    assert got == [(1, 1, 0, head % 1), (1, 1, 1, "1.0"), (4, 1, 0, "1.0"), (7, 1, 0, "1.0"), (20, 20, 0, head % 20), (20, 20, 1, "1.0"), (23, 20, 0, "1.0")]


def test_what_is_below_a_node_is_computed_once_for_all_columns():
    columns = np.random.default_rng(8).integers(0, 65, (30_000, 4))
    (steps,) = Patterns(MODEL.tree, columns).parts
    assert max(len(steps[0][0]), len(steps[1][0])) <= 65 * 65 and len(steps[2][0]) == 30_000
    plain = np.concatenate([inside(MODEL.tree, branch_matrices(MODEL.tree, MODEL.coding), MODEL.coding.prior, columns[k : k + 1])[0] for k in range(0, 30_000, 997)])
    assert np.allclose(column_scores(MODEL.tree, MODEL.coding, columns)[0][::997], plain)


def test_fits_of_unlike_sequences_ask_for_few_scales(monkeypatch):
    calls, matrices = [], fit.branch_matrices
    monkeypatch.setattr(fit, "branch_matrices", lambda *a: calls.append(1) or matrices(*a))
    columns = [np.random.default_rng(k).integers(0, 64, (80, 4)) for k in range(20)]
    fit.mle_all(MODEL.tree, MODEL.coding, MODEL.noncoding, columns)
    assert len(calls) < 60  # bounds, start and places of two models


def test_rounds_of_a_fit_share_decompositions_and_values(monkeypatch):
    decomposed, matrices, eigh, made = [], [], np.linalg.eigh, fit.branch_matrices
    monkeypatch.setattr(np.linalg, "eigh", lambda a: decomposed.append(1) or eigh(a))
    monkeypatch.setattr(fit, "branch_matrices", lambda *a: matrices.append(a[1:]) or made(*a))
    fit.omega_score(MODEL.tree, np.random.default_rng(3).integers(0, 64, (30, 4)))
    single = [(id(r), x) for r, x in matrices if np.ndim(x) == 0]
    assert len(single) == len(set(single)) and len(matrices) < 120
    assert len(decomposed) == len({id(r) for r, _ in matrices})


def test_reading_frames_of_a_lot_are_searched_at_once(spark, monkeypatch):
    rng, alone, plain = random.Random(5), [], O.reading_frames
    seqs = ["".join(rng.choice("ACGTacgtN") if k % 5 == 0 else rng.choice("ATG") for _ in range(rng.choice((0, 1, 2, 3, 40, 400)))) for k in range(300)] + [None, "\u00e9ATGTAA", "ATGTAA"]
    strands = [rng.choice(("+", "-")) for _ in seqs]
    expected = [(k, *x) for k, (s, way) in enumerate(zip(seqs, strands, strict=True)) for x in plain(s or "", way, 1)]
    monkeypatch.setattr(O, "reading_frames", lambda *a: alone.append(1) or plain(*a))
    for limit in (1 << 18, 500):
        monkeypatch.setattr(O, "BASES", limit)
        alone.clear()
        kept = [k for k in range(len(seqs)) if seqs[k] is None or seqs[k].isascii()]
        got = [tuple(x) for lot in O._frames([strands[k] for k in kept], pa.array([seqs[k] for k in kept]), 1) for x in zip(*(y.tolist() for y in lot), strict=True)]
        assert [(kept[r], a, z) for r, a, z in got] == [x for x in expected if x[0] in kept] and not alone
        mixed = [tuple(x) for lot in O._frames(strands, pa.array(seqs), 1) for x in zip(*(y.tolist() for y in lot), strict=True)]
        assert mixed == expected


def test_an_evaluation_is_one_pass(spark):
    rng = random.Random(2)
    parts = [("f", tx, "c", o, o + n, o + 1, o + n, float(score)) for tx in range(40) for o, n, score in ((rng.randint(0, 9), rng.choice((9, 12)), rng.randint(-2, 2)) for _ in range(4))]
    scored = spark.createDataFrame(sorted(set(parts)), "file string, tx_no long, chrom string, orf_begin long, orf_end long, begin long, end long, orf_score double")
    features = spark.createDataFrame([("f", tx, b + 1, b + 9, kind) for tx in range(45) for b in (tx % 9,) for kind in ("CDS", "transcript")], "file string, tx_no long, begin long, end long, feature string")
    for mode in O.MODES:
        once = O.evaluation_of(scored, mode, 0.0, features)
        assert once.first() == O.evaluation(O.choose(scored, mode, 0.0), O.choose(scored, "ALL", 0.0), features).first()
        plan = once._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("orf_score") and plan.count("LogicalRDD") == 3  # the parts and, twice, the features


def test_tracks_far_from_places_are_not_sorted(spark):
    places = spark.createDataFrame([("c", "+1", 1, 30)], "chrom string, frame string, begin long, end long")
    tracks = spark.createDataFrame([("c", f, at, 0.5) for f in ("+1", "power") for at in (1, 4, 900_000)], "chrom string, frame string, pos long, score double")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = N.interval_sums(places, tracks)
        plan = found._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and not [x for x in plan.split("\n") if "SortMergeJoin" in x and "LeftSemi" in x]
        assert [tuple(r) for r in found.select("weighted", "n_both", "power").collect()] == [(1.5, 6, 3.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_likelihoods_of_small_trees_are_not_scaled(monkeypatch):
    """Scaling at each node, which only large trees need, changes no value, also at the least scale; logs of scales are not kept without it."""
    columns = np.random.default_rng(9).integers(0, 65, (3000, 4))
    for scale in (0.001, 1.0, 10.0):
        matrices = branch_matrices(MODEL.tree, MODEL.coding, scale)
        found = []
        for most in (8, 0):
            monkeypatch.setattr(likelihood, "UNSCALED", most)
            assert all(np.ndim(log) == (most == 0) for _, log in likelihood._upward(MODEL.tree, matrices, Patterns(MODEL.tree, columns)))
            found.append(likelihood.log_likelihoods(MODEL.tree, matrices, MODEL.coding.prior, columns))
        assert np.isfinite(found[0]).all() and np.allclose(*found, rtol=1e-12, atol=1e-11)


def test_gap_mixtures_are_fitted_on_all_gaps(spark, monkeypatch):
    """As a plain fit of every gap, on the driver and a task at a time; exons whose late gaps are long are not told from a part of them."""
    rng = np.random.default_rng(3)
    gaps = np.concatenate((rng.integers(1, 400, 15_000), rng.integers(1, 300_000, 8_000)))
    theta, w = np.log10([3000.0, 80000.0, 100.0]), np.array([30.0, 10.0, 1.0]) / 41
    for _ in range(20):
        like = w / 10**theta * np.exp(-gaps[:, None] / 10**theta)
        share = like / like.sum(1, keepdims=True)
        w = share.mean(0)
        theta = np.array([hmm.simplex(lambda t, a=a, m=m: m / 10**t + a * t * np.log(10), t, 0.1, 1e-4) for t, a, m in zip(theta, share.sum(0), (share * gaps[:, None]).sum(0), strict=True)])
    start = 2 + np.concatenate(([0], np.cumsum(2 * np.ones(len(gaps), int) + gaps)))
    exons = spark.createDataFrame(pa.table({"chrom": ["c"] * len(start), "strand": ["+"] * len(start), "phase": ["0"] * len(start), "start": start, "end": start + 1}).to_pandas()).repartition(5)
    for most in (T.GAPS, 1000):
        monkeypatch.setattr(T, "GAPS", most)
        p = T.estimate_hmm(exons, 10**9, compat=False)
        assert np.allclose(p.weights, w, rtol=1e-6) and np.allclose(p.lengths, 10**theta / 3, rtol=1e-6)


def test_steps_of_an_evaluation_leave_nothing(spark, sf):
    """Its shuffle files add up to many times the input where they stay until all of it is done."""
    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {f for d in folders for _, _, own in os.walk(d) for f in own if f.startswith("shuffle_")}
    before = shuffled()
    got = core.QUERIES["evaluate_coding_sequences"](spark, sf)
    rows = got.collect()
    assert shuffled() <= before
    exons, _, parts = core._gene_parts(spark, sf)
    tx = exons.groupBy("file", "tx_no").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).withColumn("feature", F.lit("transcript"))
    parts = O.score_orfs(parts, X.tracks(spark, sf), X.sizes(spark))
    plain = O.evaluation_of(parts, "LONGEST", 0.0, exons.select("file", "tx_no", "begin", "end", "feature").unionByName(tx))
    assert rows == plain.collect() and rows[0].with_orf > 0 and got.schema == plain.schema
