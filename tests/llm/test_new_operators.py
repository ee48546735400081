"""Nearest neighbours, importance resampling and fill-in-middle: brute force, round trips and odd rows."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codonflow.llm import fill_middle as M
from codonflow.llm import importance as I
from codonflow.llm import neighbors as N

from test_llm import ODD, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rows_of = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)


# --- fill-in-middle
def plain_middle(id_, text):
    text, id_ = text or "", "null" if id_ is None else id_
    u = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = [int(hashlib.sha256(f"1:{id_}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    p, m = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    a, b, c = "".join(u[:p]), "".join(u[p:m]), "".join(u[m:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(u), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def middle_cases():
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "Zb", "é", "😀", " ", "\n", "<", "<P", "<S", ">", "M>", "P", " "]) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    return list(enumerate(made + ["<P", "P>", "<P>", "x<S>", "<M>y", "<", ">", "<PP>", "<<P>", "<p>"]))


def test_middle_against_regular_expressions(spark):
    rows = [*middle_cases(), *((i, t) for i, t in ODD)]
    out = M.fill_in_middle(docs(spark, rows)).withColumn("back", M.restored()).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr) == sorted(((i, *plain_middle(i, t)) for i, t in rows), key=repr)
    assert Counter((r.doc_id, r.back) for r in out) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("limit", [1, 40, 1 << 19])
def test_scan_does_not_depend_on_slices(monkeypatch, limit):
    from codonflow.llm import words

    monkeypatch.setattr(words, "SLICE_BYTES", limit)
    texts = [t for _, t in middle_cases()]
    got = []
    for _, _, data, offsets in words.slices(pa.array(texts), limit):
        tells, _ = M.scan(data, offsets)
        got += [(int(((tells[a:z] & M.BEGIN) > 0).sum()), bool((tells[a:z] & M.SENTINEL).any())) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [(len(re.findall("[A-Za-z]+|[^A-Za-z]", t)), bool(re.search("<[PSM]>", t))) for t in texts]


def test_middle_of_empty_table(spark):
    assert M.fill_in_middle(docs(spark, [])).count() == 0


# --- importance resampling
def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(w), [zlib.crc32(x.encode()) % 10000 for x in w] + [zlib.crc32(f"{a} {b}".encode()) % 10000 for a, b in zip(w, w[1:], strict=False)]


def plain_resample(rows, target, percent=25, least=20):
    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for *_, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    above, below = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * above / ((s[b] + 1) * below))) for b in range(10000)]
    out = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0], r[2], r[3]))
    drawn = len(order) * percent // 100
    ranked = [(*r[:1], *r[2:], k + 1 if k < drawn else None) for k, r in enumerate(order)]
    return sorted([*ranked, *((*r[:1], *r[2:], None) for r in out if r[1] < least)], key=repr)


@pytest.mark.parametrize(("most", "block", "run"), [(1 << 20, 4096, 1 << 18), (40, 3, 50), (7, 1, 1000)])
def test_resampling_against_brute_force(spark, sf, monkeypatch, most, block, run):
    """Any size of ranges, blocks and runs gives the same draw."""
    for name, value in (("RANGE", most), ("BLOCK", block), ("RUN", run)):
        monkeypatch.setattr(I, name, value)
    d, b = spark.read.parquet(f"{sf}/documents.parquet").repartition(5), spark.read.parquet(f"{sf}/benchmark.parquet")
    expected = plain_resample([(r.doc_id, r.text) for r in d.collect()], [r.text for r in b.collect()])
    assert rows_of(I.resample(d, b)) == expected and sum(r[4] is not None for r in expected) > 20


@pytest.mark.parametrize("most", [1 << 20, 3])
def test_resampling_of_odd_rows(spark, monkeypatch, most):
    """Equal rows by the dozen, null ids, empty and very long texts; ranges smaller than a group of equal keys."""
    monkeypatch.setattr(I, "RANGE", most)
    twenty = " ".join(f"Ab{k}" for k in range(25))
    rows = [*ODD, *[(50, twenty)] * 30, *[(None, twenty)] * 7, (51, "x" * 70 + " " + twenty), (51, twenty + " é"), (52, twenty)]
    target = ["ab1 ab2", None, ""]
    b = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = I.resample(docs(spark, [(i, t) for i, t in rows]).repartition(3), b, percent=60)
    assert rows_of(got) == plain_resample(rows, target, 60)


def test_resampling_of_empty_tables(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert I.resample(docs(spark, []), b).count() == 0
    assert rows_of(I.resample(docs(spark, [(1, "a b"), (2, None)]), b)) == plain_resample([(1, "a b"), (2, None)], [])


def test_crc_of_words_and_pairs():
    rng = random.Random(5)
    words_ = ["".join(rng.choice("abz09é") for _ in range(rng.choice([1, 2, 5, 9, 40, 63, 64, 65, 200]))) for _ in range(60)]
    found = list(I.features(pa.array([", ".join(words_), None, "a", "", "b.c"]), (1 << 32) - 1))
    one, two = np.concatenate([f[2] for f in found]).tolist(), np.concatenate([f[4] for f in found]).tolist()
    assert one == [zlib.crc32(w.encode()) % ((1 << 32) - 1) for w in [*words_, "a", "b", "c"]]
    assert two == [zlib.crc32(f"{a} {b}".encode()) % ((1 << 32) - 1) for a, b in [*zip(words_, words_[1:], strict=False), ("b", "c")]]


def test_merge_holds_overlapping_blocks_only():
    rng = random.Random(6)
    runs = [sorted((rng.randint(0, 99), rng.randint(0, 3)) for _ in range(rng.randint(1, 40))) for _ in range(17)]
    blocks = sorted((r[k : k + 4] for r in runs for k in range(0, len(r), 4)), key=lambda b: b[0])
    assert [e for part in I._merge(iter(blocks)) for e in part] == list(heapq.merge(*runs))


# --- nearest neighbours
def plain_nearest(rows, k=10, every=100):
    ok = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in ok), default=0)
    ok = [(i, v + [0.0] * (width - len(v))) for i, v in ok]
    out = []
    for q in sorted({i for i, _ in ok if i % every == 0}):
        own = min(v for i, v in ok if i == q)
        best = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(own, v, strict=True))), i) for i, v in ok if i != q)[:k]
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 2) for i, v in rows], "vec_id long, embedding array<float>, leaf string, id int, n int")


def test_nearest_on_odd_rows(spark):
    """Copies by the dozen, repeated ids, zeros, nulls, shorter vectors; a small table is searched whole."""
    rng = random.Random(8)
    some = [[float(np.float32(rng.gauss(0, 1))) for _ in range(6)] for _ in range(120)]
    rows = [(k * 10, v) for k, v in enumerate(some)] + [(5000 + k, some[3]) for k in range(40)] + [(100, some[7]), (100, some[7]), (200, None), (300, [0.0] * 6), (400, [1.0, None]), (500, [float("nan")] * 6), (None, some[1]), (600, some[2][:3]), (700, []), (7000, [-0.0, *some[5][1:]]), (7100, [0.0, *some[5][1:]]), (800, [float("inf")] * 6)]
    got = [tuple(r) for r in N.nearest(vectors(spark, rows)).orderBy("query_id", "rank").collect()]
    expected = plain_nearest(rows)
    assert [g[:3] for g in got] == [e[:3] for e in expected]
    assert np.allclose([g[3] for g in got], [e[3] for e in expected], rtol=1e-12)
    assert N.nearest(vectors(spark, [])).count() == 0 and N.nearest(vectors(spark, rows[:1])).count() == 0


@pytest.mark.parametrize(("rows", "queries", "kept"), [(8192, 2048, 50_000), (5, 2, 1)])
def test_groups_of_leaves_do_not_matter(spark, monkeypatch, rows, queries, kept):
    monkeypatch.setattr(N, "ROWS", rows)
    monkeypatch.setattr(N, "QUERIES", queries)
    rng = np.random.default_rng(4)
    some = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(900, 5)).astype(np.float32))]
    tight = N.Search(trees=4, leaf=16, base=60, share=0.05)
    got = [tuple(r) for r in N.nearest(vectors(spark, some), search=tight).orderBy("query_id", "rank").collect()]
    forest_only = [tuple(r) for r in N.nearest(vectors(spark, some).repartition(7), search=tight).orderBy("query_id", "rank").collect()]
    assert got == forest_only and len(got) == 90


def test_recall_over_a_table_larger_than_what_is_looked_at(spark, sf):
    """Random vectors, the hardest; the exact neighbours by brute force."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(6000, 48)).astype(np.float32)
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>")
    exact = []
    for q in range(0, 6000, 100):
        d = N.distances(v[[q]].astype(float), v.astype(float))[0]
        d[q] = np.inf
        exact += [(q, int(i)) for i in np.lexsort((np.arange(6000), d))[:10]]
    found = N.nearest(df)  # with the usual parameters
    assert N.recall(found, spark.createDataFrame(exact, "query_id long, vec_id long")) >= 0.9
    assert found.groupBy("query_id").agg(F.count("*").alias("n")).where("n <> 10").count() == 0


def test_forest_places_and_visits_alike():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 4))
    forest = N.Forest(points, 3, 10, 1)
    leaves = forest.place(points)
    sizes = np.bincount(leaves.ravel(), minlength=forest.leaves)
    assert sizes.max() <= 10 and sizes.min() > 0
    for p, own in zip(points, leaves, strict=True):
        assert forest.visit(p, sizes.tolist(), 1)[0] in own.tolist()
        assert sorted(forest.visit(p, sizes.tolist(), 10**9)) == list(range(forest.leaves))
