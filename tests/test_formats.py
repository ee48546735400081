import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

from codonflow.cli import main, parser, switch
from codonflow.functions import sequences as S
from codonflow.model.hmm import HmmParameters, Pieces, best_path, coding_hmm, coding_posterior, scan
from codonflow.model.species import example_model
from codonflow.operators import alignments as A
from codonflow.operators import annotate as N
from codonflow.operators import orfs as O
from codonflow.operators import scoring as C
from codonflow.operators import tracks as T
from codonflow.operators.search import Scoring, align, gapped_search
from codonflow.sources import bigwig as B
from codonflow.sources import sinks as K
from codonflow.sources import text as R
from codonflow.streaming.scores import windowed_means

MODEL = example_model()
MAF = """##maf version=1
a score=1
s A.chr1 0 8 + 100 ATG-AAATA
s b.chr2 5 8 + 100 ATGCAAA-A
i b.chr2 C 0

a score=2
s x.chr9 8 4 + 100 CCCC
s a.chr1 8 6 + 100 GGGTAA
s C.chr1 8 6 - 100 GGATAA

a score=3
s a.chr1 40 3 + 100 ATG
"""


@pytest.fixture()
def maf(tmp_path):
    (tmp_path / "x.maf").write_text(MAF)
    return str(tmp_path / "x.maf")


def test_maf_blocks_species_and_gaps(spark, maf):
    rows = R.maf_rows(spark, maf)
    assert rows.count() == 6
    assert [r.species for r in A.unresolved(rows, MODEL.leaves).collect()] == ["x"]
    assert [r.leaf for r in A.never_seen(rows, MODEL.leaves).collect()] == ["d"]
    aliases = spark.createDataFrame([("x", "d")], "alias string, name string")
    assert A.never_seen(rows, MODEL.leaves, aliases).count() == 0 and A.unresolved(rows, MODEL.leaves, aliases).count() == 0
    got = A.blocks(A.resolve_species(rows, MODEL.leaves), 4).orderBy("start").collect()
    assert [(r.chrom, r.start, r.seqs) for r in got] == [
        ("chr1", 1, ["ATGAAATA", "ATGAAA-A", "N" * 8, "N" * 8]), ("chr1", 9, ["GGGTAA", "N" * 6, "GGATAA", "N" * 6]), ("chr1", 41, ["ATG", "NNN", "NNN", "NNN"])]
    assert got[0].seqs[1] == "ATGAAA-A"
    aliases = spark.createDataFrame([("x", "d")], "alias string, name string")
    assert A.blocks(A.resolve_species(rows, MODEL.leaves, aliases), 4).where("start = 9 and chrom = 'chr9'").first().seqs[3] == "CCCC"


def test_stitching_and_frames(spark, maf):
    s = A.stitched(A.blocks(A.resolve_species(R.maf_rows(spark, maf), MODEL.leaves), 4, tracks=True)).orderBy("start").collect()
    assert [(r.start, r.seqs[0]) for r in s] == [(1, "ATGAAATAGGGTAA"), (41, "ATG")]
    df = spark.createDataFrame([("f", 1, "c", 5, "+", 100, 12, ["ATGAAATTTGCA"] * 4)], "file string, block_id long, chrom string, start long, strand string, chrom_len long, own long, seqs array<string>")
    f = {r.frame: r for r in A.in_frames(df).collect()}
    assert [f[k]["first"] % 3 for k in ("+1", "+2", "+3")] == [1, 2, 0]
    # codons of the backward frames are the bases of the forward strand, turned
    whole = "ATGAAATTTGCA"
    for k in ("-1", "-2", "-3"):
        first = f[k]["first"]
        own = whole[first - 5 : first - 2].translate(str.maketrans("ACGT", "TGCA"))[::-1]
        assert f[k].seqs[0][:3] == own and f[k].step == -3
    assert sorted(sum([[r["first"] % 3] for k, r in f.items() if k[0] == "-"], [])) == [0, 1, 2]


def test_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    rows = [(k, ["".join(rng.choice(list("ACGTN"), 30)) for _ in range(4)]) for k in range(20)] + [(99, ["", "", "", ""])]
    df = spark.createDataFrame(rows, "id long, seqs array<string>")
    a = C.score_alignments(df.repartition(1), MODEL, "FIXED", True).orderBy("id").collect()
    b = C.score_alignments(df.repartition(5), MODEL, "FIXED", True).orderBy("id").collect()
    assert [r.id for r in a] == [r.id for r in b] and np.allclose([r.phylo for r in a], [r.phylo for r in b]) and a[-1].phylo == 0
    per = C.score_codons(df, MODEL).groupBy("id").agg(F.sum("score").alias("s")).collect()
    assert np.allclose(sorted(r.s for r in per), sorted(r.phylo for r in a[:-1]))
    with pytest.raises(ValueError):
        C.score_alignments(df, MODEL, "OMEGA", True)


def test_track_text_round_trip(spark, tmp_path):
    rows = [("c", 1, 1.5), ("c", 4, -2.0), ("c", 10, 0.1234), ("d", 1, 7.0)]
    track = spark.createDataFrame(rows, "chrom string, pos long, score double")
    K.write_lines(K.fixed_step_lines(track), str(tmp_path / "t.wig"), "chrom", "pos", "nth")
    text = "".join(p.read_text() for p in sorted((tmp_path / "t.wig").glob("part*")))
    assert text == "fixedStep chrom=c start=1 step=3 span=3\n1.5\n-2.0\nfixedStep chrom=c start=10 step=3 span=3\n0.123\nfixedStep chrom=d start=1 step=3 span=3\n7.0\n"
    (tmp_path / "one.wig").write_text(text)
    back = R.track(spark, str(tmp_path / "one.wig"), "+1").orderBy("chrom", "pos").collect()
    assert [(r.chrom, r.pos, r.score) for r in back] == [("c", 1, 1.5), ("c", 4, -2.0), ("c", 10, 0.123), ("d", 1, 7.0)]


def test_segments_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(T, "BUCKET", 10)
    pos = [*range(1, 60, 3), *range(70, 90, 3), 100]
    t = spark.createDataFrame([("c", "+1", p, 0.0) for p in pos], "chrom string, frame string, pos long, score double")
    got = {r.pos: r.segment for r in T.segments(t).collect()}
    assert {p: got[p] for p in pos} == {p: 1 if p < 60 else 70 if p < 90 else 100 for p in pos}


HMM = coding_hmm(HmmParameters(0.1, 10.0, (0.5, 0.3, 0.2), (50.0, 100.0, 20.0)))


def one_by_one(hmm, scores):
    """Posteriors and best path, a codon after the other."""
    e, n = np.ones((len(scores), 4)), len(scores)
    e[:, 0] = 10 ** (np.asarray(scores) / 10)
    f, b, v, came = np.zeros((n, 4)), np.ones((n, 4)), np.zeros((n, 4)), np.zeros((n, 4), int)
    with np.errstate(divide="ignore"):
        move, gain = np.log(hmm.move), np.log(e)
        f[0], v[0] = hmm.start * e[0], np.log(hmm.start) + gain[0]
    for k in range(1, n):
        f[k] = (f[k - 1] @ hmm.move) * e[k]
        f[k] /= f[k].max()
        ways = np.round(v[k - 1][:, None] + move, 9)
        came[k], v[k] = ways.argmax(0), ways.max(0) + gain[k]
    for k in range(n - 2, -1, -1):
        b[k] = hmm.move @ (e[k + 1] * b[k + 1])
        b[k] /= b[k].max()
    path = [int(v[-1].argmax())]
    for k in range(n - 1, 0, -1):
        path.append(int(came[k, path[-1]]))
    return (f * b)[:, 0] / (f * b).sum(1), path[::-1]


@pytest.mark.parametrize("size", [1, 7, 50])
@pytest.mark.parametrize("digits", [0, 3])
def test_pieces_of_segments_are_those_of_the_whole(size, digits):
    """Scores of few digits, so that many ways are equally good."""
    rng = np.random.default_rng(digits)
    for n in (1, 2, 3, 60, 700):
        scores = np.round(rng.normal(0, 6, n), digits)
        p, path = one_by_one(HMM, scores)
        assert np.abs(coding_posterior(HMM, scores) - p).max() < 1e-12 and best_path(HMM, scores).tolist() == path
        parts = [scores[k : k + size] for k in range(0, n, size)]
        pieces = Pieces(HMM, parts, np.arange(len(parts)) == 0)
        before, after, ways, last = scan(HMM, pieces.products(), *pieces.best_products())
        assert np.abs(np.concatenate(pieces.rows(pieces.posteriors(before, after))) - p).max() < 1e-12
        assert np.concatenate(pieces.rows(pieces.paths(pieces.best(ways), last))).tolist() == path


def test_smoothing_does_not_depend_on_pieces(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pos = [1 + 3 * k for k in range(3000)] + [20_000 + 3 * k for k in range(49)] + [40_000]
    rows = [(c, f, p, float(v)) for c in ("c", "d") for f in ("+1", "-2") for p, v in zip(pos, rng.normal(0, 6, len(pos)), strict=True)] + [("d", "+1", 50_000, None), (None, "+1", 1, 2.0)]
    t = spark.createDataFrame(rows, "chrom string, frame string, pos long, score double")
    read = lambda: {(r.chrom, r.frame, r.pos): (r.segment, r.log_odds, r.state) for r in T.smooth(t, HMM).collect()}
    found = {}
    for size in (10_000, 512, 50):
        monkeypatch.setattr(T, "PIECE", size)
        found[size] = read()
    whole = found[10_000]
    assert len(whole) == 4 * len(pos)
    for size in (512, 50):
        assert whole.keys() == found[size].keys()
        for k, (segment, odds, state) in whole.items():
            other = found[size][k]
            assert other[0] == segment and other[2] == state and abs(1 / (1 + 10**-other[1]) - 1 / (1 + 10**-odds)) < 1e-9
    p, path = one_by_one(HMM, np.round([r[3] for r in rows[: len(pos)]][:3000], 3))
    assert [whole["c", "+1", x][2] for x in pos[:3000]] == path


GFF = "##gff\nchr1\ts\ttranscript\t1\t30\t.\t+\t.\tID=T1;\nchr1\ts\texon\t1\t30\t.\t+\t.\tParent=T1;\nchr1\ts\tCDS\t1\t9\t.\t+\t0\tParent=T1;\nchrX\ts\ttranscript\t1\t9\t.\t-\t.\tID=T2;\nchrX\ts\tCDS\t1\t9\t.\t-\t2\tParent=T2;\n"


def test_gene_models_and_annotation(spark, tmp_path):
    (tmp_path / "g.gff").write_text(GFF)
    f = R.gene_models(spark, str(tmp_path / "g.gff"))
    assert [(r.tx_no, r.feature, r.phase) for r in f.orderBy("line_no").collect()] == [(1, None, None), (1, "transcript", None), (1, "exon", None), (1, "CDS", 0), (2, "transcript", None), (2, "CDS", 2)]
    tracks = spark.createDataFrame([("chr1", "+1", 1, 2.0), ("chr1", "+1", 4, 4.0), ("chr1", "+2", 2, 99.0), ("chr1", "power", 3, 0.5)], "chrom string, frame string, pos long, score double")
    sizes = spark.createDataFrame([("chr1", 100)], "chrom string, len long")
    out = N.annotate(f, tracks, sizes).orderBy("line_no").collect()
    # power is known at bases 3 to 5, where the scores are 2, 4 and 4
    assert np.isclose(out[3].score_mean, 10 / 3) and np.isclose(out[3].power_mean, 1.5 / 9) and out[1].score_mean == out[3].score_mean
    assert out[5].score_mean is None and [r.chrom for r in N.missing_chromosomes(f, sizes).collect()] == ["chrX"]
    lines = [r.line for r in K.annotated_lines(N.annotate(f, tracks, sizes)).orderBy("line_no").collect()]
    assert lines[3].endswith("Parent=T1;coding_score_weighted_mean=3.333;coding_power_mean=0.167") and lines[2].endswith("Parent=T1;") and "=nan" in lines[5]


def test_reading_frames_of_both_strands():
    seq = "CCATGAAATGTTTTAACC"
    assert O.reading_frames(seq, "+", 1)
    for a, z in O.reading_frames(seq, "+", 1):
        part = seq[a:z]
        assert part[:3] == "ATG" and part[-3:] in ("TAA", "TAG", "TGA") and len(part) % 3 == 0
        assert not any(part[k : k + 3] in ("TAA", "TAG", "TGA") for k in range(0, len(part) - 3, 3))
    turned = seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    n = len(seq)
    assert O.reading_frames(turned, "-", 1) == sorted((n - z, n - a) for a, z in O.reading_frames(seq, "+", 1))
    assert O.reading_frames("ATGTAA", "+", 3) == [] and O.reading_frames("", "+", 1) == []


def test_orfs_over_exons(spark):
    genome = spark.createDataFrame([("c", "GG" + "ATGAA" + "ttttt" + "ATTTTAA" + "GG")], "chrom string, seq string")
    exons = spark.createDataFrame([("f", 1, "c", "+", 3, 7), ("f", 1, "c", "+", 13, 19)], "file string, tx_no long, chrom string, strand string, begin long, end long")
    s = O.spliced(exons, genome)
    assert s.first().seq == "ATGAAATTTTAA"
    parts = O.orf_exons(O.find_orfs(s, 1), exons).orderBy("begin").collect()
    assert [(r.begin, r.end, r.phase) for r in parts] == [(3, 7, 0), (13, 19, 1)]


def test_small_tables(spark, tmp_path):
    (tmp_path / "e.txt").write_text("chr1 + 0 10 20\nchr1 + 0 15 40\nchr1 + 0 50 60\nchr1 + 0 80 90\n")
    kept = T.without_overlaps(R.coding_exons(spark, str(tmp_path / "e.txt"))).orderBy("start").collect()
    assert [(r.start, r.end) for r in kept] == [(15, 40), (50, 60), (80, 90)]
    assert [r.gap for r in T.exon_gaps(T.without_overlaps(R.coding_exons(spark, str(tmp_path / "e.txt")))).collect()] == [9]
    (tmp_path / "g.fa").write_text(">chr1 x\nACGT\nAC\n>chr2\nTT\n")
    assert {r.chrom: r.seq for r in R.genome(spark, str(tmp_path / "g.fa")).collect()} == {"chr1": "ACGTAC", "chr2": "TT"}
    (tmp_path / "l.txt").write_text("ref\ta.fa\nother\tb.fa\n")
    assert [(r.n, r.name) for r in R.genome_list(spark, str(tmp_path / "l.txt")).orderBy("n").collect()] == [(0, "ref"), (1, "other")]
    (tmp_path / "m.tsv").write_text("Human\tA\n")
    assert R.name_mapping(spark, str(tmp_path / "m.tsv")).first().asDict() == {"alias": "human", "name": "a"}


def test_hits_to_alignments(spark):
    hits = spark.createDataFrame([(1, 0, "\x00chr1:3-8#+#1", "ATG"), (1, 1, "h", "ATC"), (2, 0, "chr1:3-8#-#0", "A")], "query long, hit_no int, header string, seq string")
    r = R.hits_to_alignments(hits).collect()
    assert len(r) == 1 and (r[0].chrom, r[0].start, r[0].end, r[0].strand, r[0].phase, len(r[0].seqs)) == ("chr1", 3, 8, "+", 1, 2)


def model_files(folder):
    rng = np.random.default_rng(5)
    (folder / "m.nh").write_text(MODEL.tree.newick())
    for kind, rates in (("coding", MODEL.coding), ("noncoding", MODEL.noncoding)):
        e = rates.exchange + 1e-3 * rng.random()
        pi = rates.prior
        (folder / f"m_{kind}.ECM").write_text("\n".join(" ".join(repr(float(e[i, j])) for j in range(i)) for i in range(1, 64)) + "\n\n" + " ".join(repr(float(x)) for x in pi) + "\n")
    return str(folder / "m")


def test_tools_from_files_to_files(spark, tmp_path, maf):
    m = model_files(tmp_path)
    main(["score-msa", "--strategy", "FIXED", "--comp-anc", "true", "--output", str(tmp_path / "s"), m, maf], spark)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part*"))).splitlines()
    assert lines[1] == "seq\tstart\tend\tstrand\tscore\tanc-score\tbls-score" and len(lines) == 5
    back = R.score_file(spark, str(tmp_path / "s"))
    assert back.count() == 3 and back.where("score is null").count() == 0
    main(["build-tracks", "--power-threshold", "0", "--output", str(tmp_path / "t"), m, maf], spark)
    assert spark.read.parquet(str(tmp_path / "t" / "raw.parquet")).select("frame").distinct().count() == 6
    assert list((tmp_path / "t" / "raw+1.wig").glob("part*"))


def test_options():
    assert switch("TRUE") and not switch("off") and K.output_path("a/b.gff") == "a/b.codonflow.gff"
    assert parser().parse_args(["build-tracks", "--power-threshold", "0.25", "m", "x"]).power_threshold == 0.25
    with pytest.raises(SystemExit):
        parser().parse_args(["find-cds", "--mode", "SHORTEST", "g", "t", "x"])


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("c", 1.0), ("c", 3.0)], "chrom string, score double").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = windowed_means(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.n, r["mean"]) for r in spark.table("means").collect()] == [(2, 2.0)]


# --- splits
@pytest.fixture(params=["128m", "1000", "211"])
def split(spark, request):
    """Files cut every so many bytes."""
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


def test_readers_do_not_depend_on_splits(spark, tmp_path, split):
    """Sequences, tracks, gene models and alignments whose records are longer and shorter than a split."""
    rng = random.Random(1)
    genome = {f"chr{k}": "".join(rng.choice("ACGTn") for _ in range(n)) for k, n in enumerate((0, 1, 59, 60, 61, 2500))}
    (tmp_path / "g.fa").write_text("".join(f">{c} more\n" + "".join(s[k : k + 60] + "\n" for k in range(0, len(s), 60)) for c, s in genome.items()))
    assert {r.chrom: r.seq for r in R.genome(spark, str(tmp_path / "g.fa")).collect()} == genome
    pieces = R.genome_pieces(spark, str(tmp_path / "g.fa"), 100)
    assert all(len(r.seq) <= 100 and genome[r.chrom][r.start - 1 : r.start - 1 + len(r.seq)] == r.seq for r in pieces.collect())
    assert {r.chrom: r.len for r in R.genome_sizes(pieces).collect()} == {c: len(s) for c, s in genome.items()}

    lines, track = ["# no header yet", "7"], []
    for chrom in "ab":
        at = 1
        for k in range(12):
            at, step = at + rng.randint(1, 20), rng.choice([1, 3])
            lines.append(f"fixedStep chrom={chrom} start={at} step={step}" + f" span={step}" * (k % 3 > 0))
            for _ in range(rng.randint(0, 60)):
                track.append((chrom, at, round(rng.gauss(0, 1), 3), step if k % 3 else 1))
                lines.append(str(track[-1][2]))
                at += step
    (tmp_path / "t.wig").write_text("\r\n".join(lines) + "\r\n")
    assert sorted((r.chrom, r.pos, r.score, r.span) for r in R.track(spark, str(tmp_path / "t.wig"), "+1").collect()) == sorted(track)

    genes = ["##gff", "c\ts\tgene\t1\t2\t.\t+\t.\tg"]
    for k in range(40):
        genes += [f"c\ts\ttranscript\t{k}\t9\t.\t+\t.\tT{k}", *[f"c\ts\tCDS\t{k}\t9\t.\t+\t0\tT{k}"] * rng.randint(0, 4)]
    text = "\n".join(genes)
    (tmp_path / "x.gff").write_text(text)
    found = R.gene_models(spark, str(tmp_path / "x.gff")).orderBy("line_no").collect()
    assert [r.line for r in found] == genes and all(text[r.line_no :].startswith(r.line) for r in found)
    assert [r.tx_no for r in found] == [max(1, sum("\ttranscript\t" in x for x in genes[: k + 1])) for k in range(len(genes))]

    blocks = "##maf version=1\n" + "".join(f"a score={k}\n" + "".join(f"s {s}.chr1 {k * 10} 3 + 1000 {s * 3}\n" for s in "ABC"[: k % 3 + 1]) + "\n" for k in range(50))
    (tmp_path / "x.maf").write_text(blocks)
    rows = R.maf_rows(spark, str(tmp_path / "x.maf")).collect()
    assert len(rows) == sum(k % 3 + 1 for k in range(50))
    ids = {r.block_id: r.start0 for r in rows}
    assert len(ids) == 50 and all(f" {start} 3 +" in blocks[at:].split("\na")[0] for at, start in ids.items())


def test_find_cds_does_not_depend_on_splits(spark, tmp_path, split):
    rng = random.Random(3)
    seq = "".join(rng.choice("ACGT") for _ in range(3000))
    (tmp_path / "g.fa").write_text(">c\n" + "".join(seq[k : k + 50] + "\n" for k in range(0, 3000, 50)))
    genes = []
    for k in range(30):
        begin, sign = rng.randint(1, 2500), rng.choice("+-")
        genes += [f"c\ts\ttranscript\t{begin}\t{begin + 400}\t.\t{sign}\t.\ttranscript_id=T{k};", f"c\ts\texon\t{begin}\t{begin + 150}\t.\t{sign}\t.\tx", f"c\ts\texon\t{begin + 200}\t{begin + 400}\t.\t{sign}\t.\tx"]
    (tmp_path / "x.gff").write_text("\n".join(genes) + "\n")
    for f in R.FRAMES:
        off = {"1": 1, "2": 2, "3": 3, "r": 3}[f[-1]]
        (tmp_path / f"t{f}.wig").write_text(f"fixedStep chrom=c start={off} step=3 span=3\n" + "".join(f"{(k * 37 + off) % 19 / 10 - 0.5 * (f != 'power')}\n" for k in range(990)))
    main(["find-cds", "--min-codons", "5", "--min-score", "-9", "--output", str(tmp_path / "o"), str(tmp_path / "g.fa"), str(tmp_path / "t+1.wig"), str(tmp_path / "x.gff")], spark)
    lines = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part*"))).splitlines()
    assert sum("\tCDS\t" in x for x in lines) > 20
    digest = hashlib.md5("\n".join(lines).encode()).hexdigest()
    assert FOUND.setdefault("find-cds", digest) == digest


FOUND: dict[str, str] = {}


# --- exons and tracks by running sums
def test_interval_sums_against_bases(spark, monkeypatch):
    """Rows of any span, gaps, exons over many buckets, beyond tracks and of one base."""
    monkeypatch.setattr(N, "BUCKET", 30)
    rng = random.Random(4)
    rows, known = [], {}
    for frame in ("+1", "-3", "power"):
        at = rng.randint(0, 5)
        while at < 400:
            span = rng.choice([1, 2, 3, 3, 3, 7, 40])
            value = round(rng.uniform(-2, 2), 3) if frame != "power" else round(rng.random(), 3)
            rows.append(("c", frame, at, value, span))
            known.update({(frame, b): value for b in range(at, at + span)})
            at += span + rng.choice([0, 0, 0, 1, 5])
    rows.append(("c", "+1", 900, None, 3))
    tracks = spark.createDataFrame(rows, "chrom string, frame string, pos long, score double, span int")
    places = [("c", rng.choice(["+1", "-3", "+2"]), a := rng.randint(-5, 430), a + rng.choice([0, 1, 5, 29, 30, 31, 100, 500])) for _ in range(150)] + [("d", "+1", 1, 9)]
    df = spark.createDataFrame(places + places[:20], "chrom string, frame string, begin long, end long")
    got = {(r.chrom, r.frame, r.begin, r.end): r for r in N.interval_sums(df, tracks).collect()}
    assert set(got) == set(places)
    for (chrom, frame, a, z), r in got.items():
        s = [(known.get((frame, b)), known.get(("power", b))) for b in range(a, z + 1)] if chrom == "c" else []
        both = [(x, p) for x, p in s if x is not None and p is not None]
        expected = (sum(x * p for x, p in both), sum(p for _, p in both), len(both), sum(p for _, p in s if p is not None))
        assert np.allclose((r.weighted, r.both, r.n_both, r.power), expected, atol=1e-9)


def test_buckets_of_exons_and_blocks(spark, monkeypatch):
    """Overlaps, gaps and stitching over many buckets are those of one."""
    rng = random.Random(5)
    exons = [(rng.choice("ab"), rng.choice("+-"), "0", a := rng.randint(1, 3000), a + rng.choice([2, 10, 60, 400])) for _ in range(160)] + [("a", "+", "0", None, 5)]
    df = spark.createDataFrame(exons, "chrom string, strand string, phase string, start long, `end` long")
    blocks_ = [("f", k, "c", a, a + n) for k, (a, n) in enumerate((sum(25 if j % 7 else 31 for j in range(k)) + 1, 25) for k in range(60))]
    rows = [("f", k, c, a, "+", 9999, ["A" * (z - a), "C" * (z - a)]) for _, k, c, a, z in blocks_]
    groups = spark.createDataFrame(rows, "file string, block_id long, chrom string, start long, strand string, chrom_len long, seqs array<string>")
    found = []
    for size in (1_000_000, 50):
        monkeypatch.setattr(T, "BUCKET", size)
        kept = T.without_overlaps(df)
        found.append((sorted(map(tuple, kept.collect())), sorted(r.gap for r in T.exon_gaps(kept).collect()), sorted(r.gap for r in T.exon_gaps(kept, False).collect())))
    assert found[0] == found[1]
    plain = {}
    for c, s, p, a, z in sorted(e for e in exons if e[3]):
        own = plain.setdefault((c, s, p), [])
        if own and own[-1][1] >= a:
            if z - a > own[-1][1] - own[-1][0]:
                own[-1] = (a, z)
        else:
            own.append((a, z))
    assert found[0][0] == sorted((*k, *e) for k, own in plain.items() for e in own)
    # an island cut every 100 bases, with two bases of the next part
    whole = {r.start: r.seqs for r in A.stitched(groups).collect()}
    monkeypatch.setattr(A, "BREAK", 100)
    parts = {r.start: (r.own, r.seqs) for r in A.stitched(groups).collect()}
    assert len(parts) > len(whole) > 5
    for start, seqs in whole.items():
        inside = sorted(p for p in parts if start <= p < start + len(seqs[0]))
        assert "".join(parts[p][1][1][: parts[p][0]] for p in inside) == seqs[1]
        assert all(len(parts[p][1][0]) == parts[p][0] + (2 if p != inside[-1] else 0) for p in inside)


# --- bigWig
def intervals(rng, n=3000):
    out = []
    for chrom in ("chr1", "chr10", "z"):
        at = 0
        for k in range(n):
            span = 3 if k < n // 2 else rng.randint(1, 9)
            at += 0 if rng.random() < 0.995 else rng.randint(1, 50)
            out.append((chrom, at, at + span, float(np.float32(rng.gauss(0, 1)))))
            at += span + (k > 0.9 * n)
    return out


def test_big_wig_round_trip_and_ranges(spark, tmp_path, monkeypatch):
    """Files of many trees' levels; ranges read few of their bytes."""
    rng = random.Random(6)
    rows = intervals(rng)
    sizes = {"chr1": 10**6, "chr10": 10**6, "z": 10**6, **{f"un{k}": 5 for k in range(40)}}
    df = spark.createDataFrame(rows, "chrom string, start long, end long, value double")
    B.write_big_wig(df, sizes, f"file://{tmp_path}/a.bw")
    (tmp_path / "a.bw" / "part-of-a-lost-task.bw").write_bytes(b"no")
    assert sorted(map(tuple, B.read_big_wig(spark, f"{tmp_path}/a.bw").collect())) == sorted(rows)
    assert B.big_wig_sizes(f"file://{tmp_path}/a.bw") == sizes
    # small nodes and sections make trees of many levels in one file
    monkeypatch.setattr(B, "FAN", 4)
    monkeypatch.setattr(B, "ITEMS", 32)
    by = {c: [r for r in rows if r[0] == c] for c in ("chr1", "chr10", "z")}
    body = B.encode(((c, *(np.array(x) for x in list(zip(*own, strict=True))[1:])) for c, own in by.items()), sizes)
    (tmp_path / "one.bigWig").write_bytes(body)
    path = str(tmp_path / "one.bigWig")
    assert sorted(map(tuple, B.read_big_wig(spark, path, task_bytes=5000).collect())) == sorted(rows)
    reader = B.Reader({"path": path, "taskbytes": "5000"})
    assert len(reader.partitions()) > 4
    asked = B.Reader({"path": path, "taskbytes": "5000", "chrom": "chr10,none", "begin": "2000", "end": "2600"})
    got = sorted(tuple(r.values()) for p in asked.partitions() for b in asked.read(p) for r in b.to_pylist())
    assert got == sorted(r for r in rows if r[0] == "chr10" and r[2] > 2000 and r[1] < 2600) and got
    with B.Tree(path) as tree:
        wanted = [(tree.chromosomes()["chr10"][0], 2000, 2600)]
        tree.reads.clear()
        n = sum(len(b) for node in tree.blocks(tree.root, wanted) for b in [list(tree.data(node))])
        assert n < 20 and sum(size for _, size in tree.reads) < len(body) / 4
    kinds = {raw[20] for own in by.values() for _, _, raw in B.sections(0, *(np.array(x) for x in list(zip(*own, strict=True))[1:]))}
    assert kinds == {B.BED, B.VARYING, B.FIXED}


def test_big_wig_filters_reach_the_tree(spark, tmp_path, monkeypatch):
    rows = intervals(random.Random(7), 800)
    sizes = {"chr1": 10**6, "chr10": 10**6, "z": 10**6}
    B.write_big_wig(spark.createDataFrame(rows, "chrom string, start long, end long, value double"), sizes, f"{tmp_path}/a.bw")
    spark.conf.set(B.PUSHDOWN, "true")
    try:
        got = B.read_big_wig(spark, f"{tmp_path}/a.bw").where("chrom = 'chr1' and start >= 300 and end <= 900")
        assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[0] == "chr1" and r[1] >= 300 and r[2] <= 900)
    finally:
        spark.conf.unset(B.PUSHDOWN)
    pushing = B.PushingReader({"path": f"{tmp_path}/a.bw"})
    list(pushing.pushFilters([EqualTo(("chrom",), "chr1"), GreaterThanOrEqual(("start",), 300), LessThan(("start",), 500)]))
    assert (pushing.asked.chroms, pushing.asked.begin, pushing.asked.end) == ({"chr1"}, 300, 500)
    kept = [r["start"] for p in pushing.partitions() for b in pushing.read(p) for r in b.to_pylist()]
    assert 0 < len(kept) < len(rows) / 3


def test_odd_big_wig(spark, tmp_path):
    """Nulls have no place in the format; nothing written is nothing read; other files are told."""
    df = spark.createDataFrame([("c", 0, 3, 1.5), ("c", 3, 6, None), (None, 0, 3, 1.0)], "chrom string, start long, end long, value double")
    B.write_big_wig(df, {"c": 10}, f"{tmp_path}/a.bw")
    assert [tuple(r) for r in B.read_big_wig(spark, f"{tmp_path}/a.bw").collect()] == [("c", 0, 3, 1.5)]
    B.write_big_wig(df.limit(0), {"c": 10}, f"{tmp_path}/b.bw")
    assert B.read_big_wig(spark, f"{tmp_path}/b.bw").count() == 0
    with pytest.raises(Exception, match="no size for c"):
        B.write_big_wig(df, {"d": 10}, f"{tmp_path}/c.bw")
    (tmp_path / "x.bw").write_bytes(b"fixedStep" * 20)
    with pytest.raises(Exception, match="not a little-endian bigWig file"):
        B.read_big_wig(spark, f"{tmp_path}/x.bw").collect()


def test_annotating_from_big_wig_is_that_from_parquet(spark, tmp_path):
    """Chromosome lengths come from the files themselves."""
    rng = random.Random(8)
    rows = [(c, f, 3 * k + o, float(np.float32(rng.random()))) for c in ("c", "d") for f, o in zip(R.FRAMES, (1, 2, 3, 1, 2, 3, 3), strict=True) for k in range(100) if rng.random() < 0.9]
    tracks = spark.createDataFrame(rows, "chrom string, frame string, pos long, score double")
    for f in R.FRAMES:
        own = tracks.where(F.col("frame") == f)
        own.write.parquet(f"{tmp_path}/t{f}.parquet")
        B.write_big_wig(own.select("chrom", (F.col("pos") - 1).alias("start"), (F.col("pos") + 2).alias("end"), F.col("score").alias("value")), {"c": 310, "d": 311}, f"{tmp_path}/t{f}.bw")
    genes = [f"{c}\ts\t{kind}\t{a}\t{a + 40}\t.\t{s}\t{a % 3}\tID=x" for c in "cd" for s in "+-" for a in (3, 50, 111, 280) for kind in ("transcript", "CDS")]
    (tmp_path / "x.gff").write_text("\n".join(genes) + "\n")
    spark.createDataFrame([("c", 310), ("d", 311)], "chrom string, len long").write.parquet(f"{tmp_path}/sizes")
    out = {}
    for kind, more in (("parquet", ["--sizes", f"{tmp_path}/sizes"]), ("bw", [])):
        main(["annotate-with-tracks", *more, "--output", f"{tmp_path}/out-{kind}", f"{tmp_path}/t+1.{kind}", str(tmp_path / "x.gff")], spark)
        out[kind] = "".join(p.read_text() for p in sorted((tmp_path / f"out-{kind}").glob("part*")))
    assert out["bw"] == out["parquet"] and "mean=0." in out["bw"]


# --- search
def plain_score(q, t, s=Scoring()):
    h, e = [[0] * (len(t) + 1)], [-(10**9)] * (len(t) + 1)
    best = 0
    for a in q:
        row, f, new = [0], -(10**9), [-(10**9)]
        for j, b in enumerate(t, 1):
            f = max(row[j - 1] - s.gap - s.more, f - s.more)
            new.append(max(h[-1][j] - s.gap - s.more, e[j] - s.more))
            row.append(max(0, h[-1][j - 1] + (s.match if a == b and a in "ACGT" else -s.mismatch), f, new[j]))
        h, e = [row], new
        best = max(best, *row)
    return best


def test_alignments_against_dynamic_programming():
    rng, pairs, off = random.Random(2), [], []
    for _ in range(250):
        t = "".join("N" if rng.random() < 0.02 else rng.choice("ACGT") for _ in range(rng.randint(1, 60)))
        a = rng.randint(0, len(t) - 1)
        q = list(t[a : a + rng.randint(1, 40)])
        for _ in range(rng.randint(0, 5)):
            k, way = rng.randint(0, len(q)), rng.random()
            if way < 0.4 and k < len(q):
                q[k] = rng.choice("ACGT")
            elif way < 0.7:
                q[k:k] = [rng.choice("ACGT") for _ in range(rng.randint(1, 4))]
            else:
                del q[k : k + rng.randint(1, 4)]
        pairs.append(("".join(q) or "A", t))
        off.append(a)
    got = align(pairs, off, 100)
    assert [g.score for g in got] == [plain_score(*p) for p in pairs]
    assert all(len(g.row) == len(q) and set(g.row) <= set("ACGTN-") for g, (q, _) in zip(got, pairs, strict=True))


def test_search_over_gaps_and_pieces(spark):
    """A hit across a gap, one over the borders of pieces, a masked repeat, equal queries, and the best of all by brute force."""
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a, b, c = make(200), make(150), make(90)
    g1, g2 = make(300) + a[:100] + "TTGACTTGA" + a[100:] + make(50), make(40) + b[:70] + b[75:] + make(333) + "ACGT" * 400
    genome = [("x", "c1", g1), ("x", "c2", g2), ("y", "c1", make(500))]
    pieces = spark.createDataFrame([(g, ch, k + 1, s[k : k + n]) for g, ch, s in genome for n in (7 if ch == "c2" else 64,) for k in range(0, len(s), n)], "genome string, chrom string, start long, seq string")
    queries = spark.createDataFrame([(1, a), (2, b.lower()), (3, a), (4, c), (5, "ACGT" * 20), (6, None), (7, "ACG")], "query long, seq string")
    hits = {(r["query"], r["genome"]): r for r in gapped_search(queries, pieces, common=50).collect()}
    assert set(hits) == {(1, "x"), (2, "x"), (3, "x")}
    assert (hits[1, "x"].target, hits[1, "x"].place, hits[1, "x"].seq, hits[1, "x"].score) == ("c1", 300, a, plain_score(a, g1))
    assert hits[2, "x"].score == plain_score(b, g2) and hits[2, "x"].place == 40 and hits[2, "x"].seq.replace("-", "") == b[:70] + b[75:]
    assert hits[3, "x"].seq == a
    assert gapped_search(queries.limit(0), pieces).count() == 0 and gapped_search(queries, pieces.limit(0)).count() == 0
    # without a mask the repeat is found
    assert (5, "x") in {(r["query"], r["genome"]) for r in gapped_search(queries, pieces, common=10**6).collect()}


def test_annotating_by_search(spark, tmp_path):
    """From files to files: an exon that two other genomes have, with a gap in one; FIXED and FIXED_MEAN."""
    rng = random.Random(10)
    exon = "".join(rng.choice("ACGT") for _ in range(120))
    own = "".join(rng.choice("ACGT") for _ in range(100)) + exon + "".join(rng.choice("ACGT") for _ in range(80))
    fasta = lambda name, s: (tmp_path / name).write_text(">c1\n" + "".join(s[k : k + 50] + "\n" for k in range(0, len(s), 50)))
    fasta("a.fa", own)
    fasta("b.fa", "ACGTTGCA" * 5 + exon[:60] + exon[63:] + "TTT" * 9)
    fasta("c.fa", exon[:30] + "A" + exon[31:] + "CC" * 30)
    (tmp_path / "genomes").write_text("".join(f"{n}\t{tmp_path}/{n}.fa\n" for n in "abc"))
    (tmp_path / "x.gff").write_text("c1\ts\ttranscript\t101\t220\t.\t+\t.\tID=T\nc1\ts\tCDS\t101\t220\t.\t+\t0\tParent=T\n")
    (tmp_path / "e.txt").write_text("".join(f"c1 + 0 {1000 * k + 1} {1000 * k + 90 + k % 5 * 30}\n" for k in range(1, 60)))
    m = model_files(tmp_path)
    for strategy, more in (("FIXED", []), ("FIXED_MEAN", ["--coding-exons", str(tmp_path / "e.txt"), "--genome-length", "100000"])):
        main(["annotate-with-search", "--strategy", strategy, *more, "--output", str(tmp_path / strategy), str(tmp_path / "genomes"), m, str(tmp_path / "x.gff")], spark)
        lines = "".join(p.read_text() for p in sorted((tmp_path / strategy).glob("part*"))).splitlines()
        assert len(lines) == 2 and all(";coding_mean=" in x and "nan" not in x for x in lines)


def test_numbers_are_rounded_as_exact_values(spark):
    rng = np.random.default_rng(3)
    values = [k / 16 for k in range(-40, 40)] + [k / 32 for k in range(-9, 9)] + rng.normal(0, 3, 200).tolist() + [0.0005, 0.0015, 1e-9, 12345.0625]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[S.fixed("v", d).alias(f"d{d}") for d in (3, 4, 6)]).collect()
    assert all((r.d3, r.d4, r.d6) == tuple(f"{r.v:.{d}f}" for d in (3, 4, 6)) for r in rows)


def test_building_tracks_from_file_to_files(spark, tmp_path, capsys):
    """Raw and smoothed tracks, regions and power, and what the tool says of species."""
    rng = random.Random(12)
    blocks, at = ["##maf version=1"], 0
    for k in range(30):
        n = rng.choice([9, 30, 31])
        seq = "".join(rng.choice("ACGT") for _ in range(n))
        blocks += ["a score=1", *(f"s {s}.chr1 {at} {n} + 5000 {''.join(c if rng.random() < 0.9 else rng.choice('ACGT') for c in seq)}" for s in ("a", "B", "human")), f"s x.chr1 0 {n} + 10 {seq}", ""]
        at += n + (5 if k % 10 == 9 else 0)
    (tmp_path / "x.maf").write_text("\n".join(blocks) + "\n")
    (tmp_path / "names.tsv").write_text("Human\tC\n")
    (tmp_path / "e.txt").write_text("".join(f"chr1 + 0 {1000 * k + 1} {1000 * k + 90 + k % 5 * 30}\n" for k in range(1, 60)))
    m = model_files(tmp_path)
    main(["build-tracks", "--output-smoothed", "1", "--output-regions", "1", "--power-threshold", "0", "--mapping", str(tmp_path / "names.tsv"), "--coding-exons", str(tmp_path / "e.txt"), "--genome-length", "100000", "--output", str(tmp_path / "t"), m, str(tmp_path / "x.maf")], spark)
    said = capsys.readouterr().err
    assert "left out (1): x" in said and "in no alignment (1): d" in said
    read = lambda name: sorted((r.chrom, r.pos, r.score) for r in R.track(spark, f"{tmp_path}/t/{name}.wig", "f").collect())
    stored = spark.read.parquet(f"{tmp_path}/t/smoothed.parquet").collect()
    raw = spark.read.schema("chrom string, pos long, score double, frame string").parquet(f"{tmp_path}/t/raw.parquet").collect()
    for f in ("+1", "-3"):
        own = sorted((r.chrom, r.pos, r.log_odds) for r in stored if r.frame == f)
        assert [x[:2] for x in read(f"smoothed{f}")] == [x[:2] for x in own] == sorted((r.chrom, r.pos) for r in raw if r.frame == f) == [x[:2] for x in read(f"raw{f}")] and own
        assert all(abs(x[2] - y[2]) < 6e-4 for x, y in zip(read(f"smoothed{f}"), own, strict=True))
    assert all(len(x.split("\t")) == 9 for p in (tmp_path / "t" / "regions.bed").glob("part*") for x in p.read_text().splitlines())
    assert len(read("power")) > 200


def test_references_of_one_species(spark, tmp_path):
    (tmp_path / "x.maf").write_text(MAF + "\na score=4\ns b.chr1 60 3 + 100 ATG\ns a.chr1 60 3 + 100 ATG\n")
    with pytest.raises(ValueError, match="references of several species: a, b"):
        main(["score-msa", "--strategy", "FIXED", "--output", str(tmp_path / "s"), model_files(tmp_path), str(tmp_path / "x.maf")], spark)


def test_parts_of_a_folder_are_one_text(spark, tmp_path):
    """Runs of steps and transcripts that the ranges of a writer have cut."""
    track = spark.createDataFrame([(c, 1 + 3 * k + (k > 120) * 30, float(k)) for c in "ab" for k in range(300)], "chrom string, pos long, score double")
    lines = K.fixed_step_lines(track).repartitionByRange(9, "chrom", "pos", "nth").sortWithinPartitions("chrom", "pos", "nth")
    lines.select("line").write.text(f"{tmp_path}/t.wig")
    parts = sorted((tmp_path / "t.wig").glob("part*"))
    assert len(parts) > 5 and sum(not p.read_text().startswith("fixedStep") for p in parts) > 3
    assert sorted((r.chrom, r.pos, r.score) for r in R.track(spark, f"{tmp_path}/t.wig", "+1").collect()) == sorted(map(tuple, track.collect()))
    genes = [f"c\ts\t{kind}\t{k}\t9\t.\t+\t.\tT{k}" for k in range(40) for kind in ("transcript", "CDS", "CDS")]
    spark.createDataFrame(list(enumerate(genes)), "k long, line string").repartitionByRange(7, "k").sortWithinPartitions("k").select("line").write.text(f"{tmp_path}/g.gff")
    found = R.gene_models(spark, f"{tmp_path}/g.gff").orderBy("line_no").collect()
    assert [r.line for r in found] == genes and [r.tx_no for r in found] == [k + 1 for k in range(40) for _ in range(3)]
    assert len({r.file for r in found}) == 1 and len({r.line_no for r in found}) == len(genes)


def test_tracks_need_the_forward_strand(spark, tmp_path):
    (tmp_path / "x.maf").write_text("a score=1\ns a.chr1 0 3 - 100 ATG\ns b.chr1 0 3 + 100 ATG\n")
    rows = A.resolve_species(R.maf_rows(spark, str(tmp_path / "x.maf")), MODEL.leaves)
    assert A.blocks(rows, 4).first().strand == "-"
    with pytest.raises(Exception, match="forward strand"):
        A.blocks(rows, 4, tracks=True).collect()
