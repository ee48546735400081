"""Every query against its SQL on the smallest tables."""

import math
import os
import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from codonflow import fixtures as X
from codonflow import queries as core
from codonflow.model import fit
from codonflow.operators import orfs as O
from codonflow.operators.alignments import columns_of
from codonflow.operators.scoring import branch_scores

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return c


def rows(frame):
    plain = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(r) for r in plain[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_against_sql(spark, sf, con, name):
    got, expected = core.QUERIES[name](spark, sf).toPandas(), con.execute(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    a, b = rows(got), rows(expected)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE_SQL) ))
def test_runs(spark, sf, name):
    assert core.QUERIES[name](spark, sf).count() >= 0


def test_entry_has_all_queries(spark):
    names = entry.queries()
    assert set(core.QUERIES) <= set(names) and set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).columns == ["aln_id", "phylo", "anc", "bls"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents of bases, also fewer than 60 and none."""
    rng = random.Random(5)
    folder = str(tmp_path_factory.mktemp("small"))
    rows = [(k, "".join(rng.choice("ACGT") for _ in range((0, 30, 61, 100, 7, 240)[k // 4 % 6]))) for k in range(40)]
    rows = [(k, text if k % 4 == 0 else "".join(c if rng.random() < 0.9 else rng.choice("ACGT") for c in rows[k // 4 * 4][1])) for k, text in rows]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def placed(spark, sf):
    """(chrom, start, seqs) of the blocks, one after the other."""
    ends, out = {}, []
    for r in sorted(X.msa(spark, sf).collect(), key=lambda r: r.aln_id):
        chrom = f"c{r.aln_id // 100}"
        start = ends.get(chrom, 1) + 60 * (r.aln_id % 16 == 0)
        ends[chrom] = start + len(r.seqs[0])
        out.append((chrom, start, r.seqs))
    return out


def test_power_of_all_bases(spark, small):
    bases = {(c, a + k): v for c, a, seqs in placed(spark, small) if seqs[0] for k, v in enumerate(branch_scores(core.MODEL.tree, seqs))}
    power = {(c, p): sum(bases[c, p + j] for j in range(3)) / 3 for c, p in bases if p % 3 == 0 and (c, p + 1) in bases and (c, p + 2) in bases}
    got = {(r.chrom, r.pos): r.power for r in core.QUERIES["build_power_track"](spark, small).collect()}
    assert got.keys() == power.keys() and all(abs(got[k] - power[k]) < 2e-6 for k in got)


def test_raw_tracks_of_all_bases(spark, small):
    bases = {(c, a + k): v for c, a, seqs in placed(spark, small) if seqs[0] for k, v in enumerate(branch_scores(core.MODEL.tree, seqs))}
    places = {(c, p) for c, p in bases if (c, p + 1) in bases and (c, p + 2) in bases and sum(bases[c, p + j] for j in range(3)) >= 0.3}
    rows = core.QUERIES["build_raw_tracks"](spark, small).collect()
    for way in "+-":
        assert sorted((r.chrom, r.pos) for r in rows if r.frame[0] == way) == sorted(places)


def test_fits_of_whole_alignments(spark, small):
    seqs = {r.aln_id: r.seqs for r in X.msa(spark, small).collect()}
    got = {r.aln_id: r.phylo for r in core.QUERIES["score_msa_mle"](spark, small).collect()}
    assert got.keys() == seqs.keys()
    omega = {r.aln_id: r.phylo for r in core.QUERIES["score_msa_omega"](spark, small).collect()}
    assert omega.keys() == seqs.keys()
    assert abs(omega[5] - fit.omega_score(core.MODEL.tree, columns_of(seqs[5]), 42)) < 1e-2
    for k in (2, 5):
        assert abs(got[k] - fit.mle(core.MODEL.tree, core.MODEL.coding, core.MODEL.noncoding, columns_of(seqs[k]), 42)[0]) < 1e-3


def test_hmm_parameters_of_all_exons(spark, sf):
    groups = {}
    for r in X.features(spark, sf).collect():
        groups.setdefault((r.chrom, r.strand, r.phase), []).append((r.begin, r.end))
    kept = []
    for exons in groups.values():
        own = []
        for a, z in sorted(exons):
            if own and own[-1][1] >= a:
                own[-1] = (a, z) if z - a > own[-1][1] - own[-1][0] else own[-1]
            else:
                own.append((a, z))
        kept += own
    bases = sum(z - a + 1 for a, z in kept)
    got = {r.name: r.value for r in core.QUERIES["hmm_parameters"](spark, sf).collect()}
    assert math.isclose(got["coding_prior"], bases / 90_000 / 6, abs_tol=1e-6) and math.isclose(got["coding_length"], bases / len(kept) / 3, abs_tol=1e-6)


def test_genes_over_the_whole_genome(spark, sf):
    genome = dict.fromkeys("ANR", "")
    for r in sorted(X.dna(spark, sf).collect(), key=lambda r: r.doc_id):
        genome["ANR"[r.doc_id % 3]] += r.dna
    exons, pieces, _ = core._gene_parts(spark, sf)
    assert exons.count() == X.features(spark, sf).count()
    rows = pieces.collect()
    assert sum(len(r.seq) for r in rows) == sum(map(len, genome.values()))
    assert all(genome[r.chrom][r.start - 1 : r.start - 1 + len(r.seq)] == r.seq for r in rows)
    expected = {}
    for r in sorted(exons.collect(), key=lambda r: r.begin):
        expected[r.tx_no] = expected.get(r.tx_no, "") + genome[r.chrom][r.begin - 1 : r.end]
    assert {r.tx_no: r.seq for r in O.spliced_pieces(exons, pieces).collect()} == expected


def test_splicing_of_pieces(spark):
    rng = random.Random(6)
    genome = "".join(rng.choice("ACGT") for _ in range(500))
    cuts = [0, 0, 1, 37, 120, 120, 333, 500]
    pieces = spark.createDataFrame([("c", a + 1, genome[a:z]) for a, z in zip(cuts, cuts[1:])], "chrom string, start long, seq string")
    exons = [("f", t, chrom, strand, a, a + rng.randint(0, 90)) for t in range(60) for chrom, strand in [(rng.choice(("c", "c", "c", "x")), rng.choice("+-."))] for a in sorted(rng.sample(range(1, 600, 100), rng.randint(1, 4)))]
    df = spark.createDataFrame(exons, "file string, tx_no long, chrom string, strand string, begin long, end long")
    whole = {(r.tx_no, r.strand): r.seq for r in O.spliced(df, spark.createDataFrame([("c", genome)], "chrom string, seq string")).collect()}
    expected = {}
    for _, t, chrom, strand, a, z in exons:
        if chrom == "c" and strand != ".":
            expected[t, strand] = expected.get((t, strand), "") + genome[a - 1 : z]
    assert whole == expected
    for chunk in (1, 10, 64, 1000):
        assert {(r.tx_no, r.strand): r.seq for r in O.spliced_pieces(df, pieces, chunk).collect()} == whole


def test_search_of_whole_sequences(spark, tmp_path):
    rng = random.Random(7)
    base = "".join(rng.choice("ACGT") for _ in range(400))
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randint(0, 150))) for _ in range(30)]
    for k in range(30):
        a = rng.randint(0, 300)
        texts[k] += base[a : a + rng.randint(0, 100)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = set()
    for query in range(0, 30, 5):
        q = texts[query]
        for genome in (0, 1):
            votes = Counter((str(t), b - a) for t in range(genome, 30, 2) for a in range(len(q) - 11) for b in range(len(texts[t]) - 11) if q[a : a + 12] == texts[t][b : b + 12])
            votes = [(-n, t, p) for (t, p), n in votes.items() if n >= 2 and p >= 0]
            if votes:
                n, t, p = min(votes)
                expected.add((query, genome, t, p, -n, texts[int(t)][p : p + len(q)].ljust(len(q), "-")))
    assert {tuple(r) for r in core.QUERIES["search_sequences"](spark, str(tmp_path)).collect()} == expected
