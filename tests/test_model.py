import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from codonflow.model import fit
from codonflow.model.genetic import AMINO, MISSING, STOPS, codon, codon_ids, peptide
from codonflow.model.hmm import HmmParameters, best_path, coding_hmm, coding_posterior, coding_runs, fit_gaps, simplex
from codonflow.model.likelihood import column_scores, inside, branch_matrices
from codonflow.model.rates import from_triangle, mechanistic, parse_exchange
from codonflow.model.species import example_model
from codonflow.model.tree import parse_newick

MODEL = example_model()


def test_genetic_code():
    assert len(AMINO) == 65 and AMINO[MISSING] == "-"
    assert [codon(i) for i in STOPS] == ["TAA", "TAG", "TGA"]
    assert peptide("ATGAAATAANNNg") == "MK*-"


@given(st.text("ACGTacgtN-", max_size=60))
def test_codons_are_thirds(seq):
    ids = codon_ids(seq)
    assert len(ids) == len(seq) // 3
    for k, i in enumerate(ids):
        part = seq[3 * k : 3 * k + 3].upper()
        assert codon(i) == (part if set(part) <= set("ACGT") else "NNN")


def test_newick_reads_reduces_and_prints():
    t = parse_newick("(\n ((A:0.1, b:0.2):0.3, C:0.4):0.5, d:0.6 ) ;")
    assert t.labels == ("a", "b", "c", "d") and t.children == ((0, 1), (4, 2), (5, 3))
    assert t.parent == (4, 4, 5, 6, 5, 6, -1)
    r = t.reduced(["A", "d"])
    assert r.labels == ("a", "d") and np.allclose(r.length[:2], (0.9, 0.6))
    assert parse_newick(t.newick()).length == t.length
    assert t.missing(["a", "x"]) == ["x"] and t.overlap(["A", "x"]) == 1
    for bad in ("(a:1,b:1,c:1);", "(a:1,b:1", "(a:x,b:1);", "(,b:1);", "(a:1,b:1);x"):
        with pytest.raises(ValueError):
            parse_newick(bad)


def test_branch_score_counts_branches_between():
    t = parse_newick("((a:1,b:2):3,(c:4,d:5):6);")
    scores = t.branch_score(np.array([[1, 1, 0, 0], [1, 0, 1, 0], [1, 1, 1, 1], [1, 0, 0, 0]], bool))
    assert np.allclose(scores, [3 / 21, 14 / 21, 1, 0])


def test_rates_are_reversible_and_compose():
    for r in (MODEL.coding, MODEL.noncoding):
        assert np.allclose(r.q.sum(1), 0, atol=1e-12)
        assert np.isclose(-(r.pi @ np.diag(r.q)), 1)
        a, b, c = r.p([0.1, 0.2, 0.3])
        assert np.allclose(a @ b, c, atol=1e-10) and np.allclose(a.sum(1), 1)
        assert np.allclose(r.prior @ c, r.prior, atol=1e-9)
        flow = r.prior[:, None] * c
        assert np.allclose(flow, flow.T, atol=1e-10)


def test_exchange_files():
    rng = np.random.default_rng(1)
    lower = [list(rng.random(k)) for k in range(1, 64)]
    pi = rng.random(64)
    pi /= pi.sum()
    text = "\n".join(" ".join(map(repr, map(float, row))) for row in lower) + "\n\n" + " ".join(map(repr, map(float, pi))) + "\nmore"
    r = parse_exchange(text)
    assert r.exchange[5, 3] == lower[4][3] and r.exchange[3, 5] == lower[4][3] and np.allclose(r.pi, pi)
    columnwise = [r.exchange[i, j] for j in range(64) for i in range(j + 1, 64)]
    assert np.array_equal(from_triangle(columnwise, pi).exchange, r.exchange)
    with pytest.raises(ValueError):
        parse_exchange("1\n2")


def brute(tree, p, prior, column):
    """Sum over all states of the inner nodes of a tree of two or three leaves."""
    total = 0.0
    n = tree.nodes - tree.leaves
    for states in np.ndindex(*[64] * n):
        value = prior[states[-1]]
        for node in range(tree.nodes - 1):
            up = states[tree.parent[node] - tree.leaves]
            if node < tree.leaves:
                value *= 1.0 if column[node] == 64 else p[node][up, column[node]]
            else:
                value *= p[node][up, states[node - tree.leaves]]
        total += value
    return total


def test_inside_against_all_states():
    t = parse_newick("((a:0.1,b:0.2):0.05,c:0.3);")
    p = branch_matrices(t, MODEL.coding)
    columns = np.array([[5, 5, 9], [0, 64, 63], [64, 64, 64]])
    log, post = inside(t, p, MODEL.coding.prior, columns)
    assert np.allclose(log, [math.log(brute(t, p, MODEL.coding.prior, c)) for c in columns])
    assert np.isclose(log[2], 0) and np.allclose(post.sum(1), 1)


def test_missing_columns_say_nothing_and_root_place_does_not_matter():
    a, b = parse_newick("((a:0.1,b:0.2):0.1,c:0.3);"), parse_newick("(a:0.05,(b:0.2,c:0.4):0.05);")
    columns = np.array([[1, 2, 3], [10, 10, 64]])
    assert np.allclose(column_scores(a, MODEL.coding, columns)[0], column_scores(b, MODEL.coding, columns)[0], rtol=1e-6)


def test_maximise_finds_a_maximum_and_bounds():
    x, value = fit.maximise(lambda s: -((math.log(s) - 0.7) ** 2), 1.0, 0.01, 10.0, fit.Draws())
    assert abs(math.log(x) - 0.7) < 0.05 and value > -0.01
    assert fit.maximise(lambda s: s, 1.0, 0.01, 10.0, fit.Draws())[0] == 10.0
    assert fit.maximise(lambda s: -s, 1.0, 0.01, 10.0, fit.Draws())[0] == 0.01


def test_draws_are_those_of_the_twister():
    words = np.random.RandomState(42).randint(0, 2**32, 4, dtype=np.uint64).tolist()
    d = fit.Draws(42)
    assert d(2.0) == 2.0 * (words[0] + words[1] * 2**32) / 2**64
    assert d(1.0) == (words[2] + words[3] * 2**32) / 2**64


def test_mle_and_omega_prefer_the_kind_of_sequence():
    rng = np.random.default_rng(3)

    def simulate(rates, n):
        p = branch_matrices(MODEL.tree, rates)
        state = rng.choice(64, n, p=rates.prior)
        at = {MODEL.tree.nodes - 1: state}
        for node in range(MODEL.tree.nodes - 2, -1, -1):
            at[node] = np.array([rng.choice(64, p=p[node][x]) for x in at[MODEL.tree.parent[node]]])
        return np.stack([at[k] for k in range(MODEL.tree.leaves)], 1)

    good, bad = simulate(MODEL.coding, 150), simulate(MODEL.noncoding, 150)
    assert fit.mle(MODEL.tree, MODEL.coding, MODEL.noncoding, good)[0] > 0 > fit.mle(MODEL.tree, MODEL.coding, MODEL.noncoding, bad)[0]
    assert fit.omega_score(MODEL.tree, good) > fit.omega_score(MODEL.tree, bad)
    assert np.allclose(fit.base_ratios(np.array([[0, 64]])), [[2, 1, 1]] * 3)


def test_frequencies_of_stops():
    full, less = mechanistic(2, 1, np.ones((3, 3)), 1.0), mechanistic(2, 1, np.ones((3, 3)), 0.01)
    assert np.isclose(full.pi.sum(), 1) and np.isclose(less.pi[0], (1 / 64) / (1 - 0.99 * 3 / 64))
    assert np.isclose(less.prior.sum(), 1)


HMM = coding_hmm(HmmParameters(0.1, 10.0, (0.5, 0.3, 0.2), (50.0, 100.0, 20.0)))


def test_hmm_against_all_paths():
    assert np.allclose(HMM.move.sum(1), 1) and np.isclose(HMM.start.sum(), 1)
    scores = np.array([-3.0, 5.0, 8.0, -2.0, 1.0])
    e = np.ones((5, 4))
    e[:, 0] = 10 ** (scores / 10)
    weight = {}
    for path in np.ndindex(*[4] * 5):
        w = HMM.start[path[0]] * e[0, path[0]]
        for k in range(1, 5):
            w *= HMM.move[path[k - 1], path[k]] * e[k, path[k]]
        weight[path] = w
    total = sum(weight.values())
    expected = [sum(w for p, w in weight.items() if p[k] == 0) / total for k in range(5)]
    assert np.allclose(coding_posterior(HMM, scores), expected)
    assert tuple(best_path(HMM, scores)) == max(weight, key=weight.get)


def test_coding_runs_and_their_edges():
    runs = lambda *p: coding_runs(np.array(p))
    assert runs(0) == [] and runs(0, 0) == [] and runs(0, 1) == [(0, 0)] and runs(1, 0) == [(1, 1)]
    assert runs(0, 0, 1, 0, 0, 0) == [(0, 1), (3, 5)]
    assert coding_runs(np.array([0, 0]), compat=False) == [(0, 1)]


def test_gap_mixture():
    rng = np.random.default_rng(0)
    gaps = np.concatenate([rng.exponential(2000, 3000), rng.exponential(60000, 1000), rng.exponential(80, 300)])
    lengths, weights = fit_gaps(gaps)
    assert np.isclose(weights.sum(), 1) and lengths[2] < lengths[0] < lengths[1]
    assert abs(simplex(lambda x: (x - 2) ** 2, 0.0, 0.1, 1e-6, 100) - 2) < 1e-3


def test_draws_that_cannot_win_are_not_evaluated():
    for seed in range(6):
        for f in (math.log, lambda x: -x, lambda x: -((math.log(x) - 1.9) ** 2), lambda x: -((math.log(x) + 4.4) ** 2) + 1e-3 * x, lambda x: 0.0):
            calls = []
            plain = fit.Draws(seed)
            screened = fit.Draws(seed)
            a = fit.maximise(f, 1.0, 0.01, 10.0, plain)
            b = fit.maximise(lambda x, f=f: calls.append(x) or f(x), 1.0, 0.01, 10.0, screened, lambda f=f: np.array([f(x) for x in fit.places(0.01, 10.0)]))
            assert a == b and plain(1.0) == screened(1.0)
            if f in (math.log,):
                assert len(calls) < 40


def test_fits_of_many_alignments_are_those_of_each():
    rng = np.random.default_rng(5)
    same = rng.integers(0, 64, (40, 1)).repeat(4, 1)
    near = np.where(rng.random((40, 4)) < 0.1, rng.integers(0, 64, (40, 4)), same)
    columns = [rng.integers(0, 65, (30, 4)), same, np.zeros((0, 4), np.int64), near, np.full((5, 4), 64)]
    got = fit.mle_all(MODEL.tree, MODEL.coding, MODEL.noncoding, columns)
    for own, c in zip(got, columns, strict=True):
        assert np.allclose(own, fit.mle(MODEL.tree, MODEL.coding, MODEL.noncoding, c), atol=1e-6)


def test_omega_fits_look_at_few_scales(monkeypatch):
    calls = []
    plain, matrices = fit.maximise, fit.branch_matrices
    columns = np.random.default_rng(3).integers(0, 64, (30, 4))
    monkeypatch.setattr(fit, "branch_matrices", lambda *a: calls.append(1) or matrices(*a))
    quick, few = fit.omega_score(MODEL.tree, columns), len(calls)
    monkeypatch.setattr(fit, "maximise", lambda f, start, low, high, draw, *_: plain(f, start, low, high, draw))
    assert fit.omega_score(MODEL.tree, columns) == quick and few < 500 < len(calls) - few


def test_likelihoods_in_slices(monkeypatch):
    columns = np.random.default_rng(4).integers(0, 65, (50, 4))
    whole = column_scores(MODEL.tree, MODEL.coding, columns)
    monkeypatch.setattr("codonflow.model.likelihood.SLICE", 7)
    assert np.allclose(whole, column_scores(MODEL.tree, MODEL.coding, columns))
