"""Hidden Markov model of coding and three kinds of noncoding stretches, over scores of codons."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Hmm:
    """State 0 is coding."""

    start: np.ndarray
    move: np.ndarray


@dataclass(frozen=True)
class HmmParameters:
    coding_prior: float
    coding_length: float  # in codons, as all lengths
    weights: tuple[float, float, float]
    lengths: tuple[float, float, float]


def coding_hmm(p: HmmParameters) -> Hmm:
    """Noncoding kinds are left only for coding, and entered by their weights."""
    w, n = np.array(p.weights), np.array(p.lengths)
    start = np.concatenate(([p.coding_prior], (1 - p.coding_prior) * w * n / (w * n).sum()))
    move = np.zeros((4, 4))
    move[0, 1:] = w / p.coding_length
    move[0, 0] = 1 - move[0, 1:].sum()
    move[1:, 0] = 1 / n
    move[range(1, 4), range(1, 4)] = 1 - 1 / n
    return Hmm(start, move)


def _emissions(scores: np.ndarray) -> np.ndarray:
    e = np.ones((len(scores), 4))
    e[:, 0] = 10 ** (np.asarray(scores, float) / 10)
    return e


def coding_posterior(hmm: Hmm, scores: np.ndarray) -> np.ndarray:
    """Posterior probability of coding at each codon of one segment, forward and backward with scaling by the largest."""
    pieces = Pieces(hmm, [np.asarray(scores, float)])
    return pieces.rows(pieces.posteriors())[0]


def best_path(hmm: Hmm, scores: np.ndarray) -> np.ndarray:
    """Viterbi path of one segment; of equal predecessors the first state wins."""
    pieces = Pieces(hmm, [np.asarray(scores, float)])
    return pieces.rows(pieces.paths(pieces.best()))[0]


#: logarithms of path probabilities are whole numbers of this part of a unit, so that sums are exact in any order
UNIT = 1 << 40
_NEVER = -(1 << 61)


def _whole_log(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.rint(np.log(np.where(x > 0, x, 1.0)) * UNIT), _NEVER).astype(np.int64)


def _turned(x: np.ndarray, move: np.ndarray) -> np.ndarray:
    """x @ move for many x, added up from the first state to the last."""
    out = x[..., 0, None] * move[0]
    for i in range(1, 4):
        out = out + x[..., i, None] * move[i]
    return out


class Pieces:
    """Stretches of codons worked on side by side: a step does the k-th codon of all of them.

    A piece is the whole segment or a part of it.  For parts, ``products`` and ``best_products`` say
    what a piece makes of any state before it, so that the states between pieces are found by a scan over
    one small matrix a piece; with them each piece gives what the whole segment would.
    """

    def __init__(self, hmm: Hmm, scores: list[np.ndarray], first: np.ndarray | None = None):
        self.hmm = hmm
        self.order = np.argsort([-len(s) for s in scores], kind="stable")
        self.sizes = np.array([len(scores[k]) for k in self.order], np.int64)
        self.first = np.ones(len(scores), bool) if first is None else np.asarray(first, bool)[self.order]
        most = int(self.sizes.max(initial=0))
        grid = np.zeros((most, len(scores)))
        for c, k in enumerate(self.order):
            grid[: len(scores[k]), c] = scores[k]
        self.ratio = 10 ** (grid / 10)
        self.live = [int((self.sizes > k).sum()) for k in range(most)]

    def rows(self, grid: np.ndarray) -> list[np.ndarray]:
        """A grid (codon, piece) as one array a piece, in the order that the pieces were given in."""
        out: list = [None] * len(self.order)
        for c, k in enumerate(self.order.tolist()):
            out[k] = grid[: self.sizes[c], c]
        return out

    def given(self, x: np.ndarray) -> np.ndarray:
        return x[self.order]

    def _back(self, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        out[self.order] = x
        return out

    def products(self) -> np.ndarray:
        """(piece, 4, 4): the product of moves and emissions of all codons, scaled; a first piece has no move before its first codon."""
        m = np.tile(np.eye(4), (len(self.sizes), 1, 1))
        for k, n in enumerate(self.live):
            x = m[:n] if k == 0 else _turned(m[:n], self.hmm.move)
            if k == 0:
                x = np.where(self.first[:n, None, None], x, _turned(x, self.hmm.move))
            x = x.copy()
            x[:, :, 0] *= self.ratio[k, :n, None]
            m[:n] = x / x.max((1, 2), keepdims=True)
        return self._back(m)

    def posteriors(self, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """(codon, piece): probability of coding; ``before`` are forward values at the codon before a piece, ``after`` backward ones at its last."""
        move, many = self.hmm.move, len(self.sizes)
        forward = np.zeros((len(self.live), many, 4))
        f = np.tile(self.hmm.start, (many, 1))
        if before is not None:
            f = np.where(self.first[:, None], f, _turned(self.given(before), move))
        for k, n in enumerate(self.live):
            f = f[:n] if k == 0 else _turned(f[:n], move)
            f = f.copy()
            f[:, 0] *= self.ratio[k, :n]
            if k:
                f = f / f.max(1, keepdims=True)
            elif before is not None:
                f = np.where(self.first[:n, None], f, f / f.max(1, keepdims=True))
            forward[k, :n] = f
        out = np.zeros((len(self.live), many))
        b = np.ones((many, 4)) if after is None else self.given(after).copy()
        for k in range(len(self.live) - 1, -1, -1):
            n = self.live[k]
            m = self.live[k + 1] if k + 1 < len(self.live) else 0
            if m:
                x = b[:m].copy()
                x[:, 0] *= self.ratio[k + 1, :m]
                x = _turned(x, move.T)
                b[:m] = x / x.max(1, keepdims=True)
            both = forward[k, :n] * b[:n]
            out[k, :n] = both[:, 0] / (both[:, 0] + both[:, 1] + both[:, 2] + both[:, 3])
        return out

    # --- best paths, in whole numbers
    def best_products(self) -> tuple[np.ndarray, np.ndarray]:
        """(piece, 4, 4) twice: the value of the best way from each state before a piece to each at its end, and its place among the ways to that end.

        Of equal ways the one counts whose states are smaller, compared from the end back, as that is
        what taking the first of equal predecessors at every step comes to.
        """
        move, gain = _whole_log(self.hmm.move), _whole_log(self.ratio)
        v = np.where(np.eye(4, dtype=bool), 0, _NEVER)[None].repeat(len(self.sizes), 0)
        place = np.tile(np.arange(4)[:, None], (len(self.sizes), 1, 4))
        for k, n in enumerate(self.live):
            ways = v[:n, :, :, None] + move
            came, x = ways.argmax(2), ways.max(2)
            if k == 0:
                x = np.where(self.first[:n, None, None], v[:n], x)
                came = np.broadcast_to(np.arange(4)[:, None], came.shape)
            key = came * 4 + np.take_along_axis(place[:n], came, 2)
            if k:
                place[:n] = (key[:, :, None, :] > key[:, None, :, :]).sum(2)
            x[:, :, 0] += gain[k, :n, None]
            v[:n] = np.maximum(x, _NEVER)
        return self._back(v), self._back(place)

    def best(self, before: np.ndarray | None = None) -> np.ndarray:
        """(codon, piece, 4): the state that each state was best reached from; keeps the values at the ends of pieces in ``ends``."""
        move, gain, many = _whole_log(self.hmm.move), _whole_log(self.ratio), len(self.sizes)
        came = np.zeros((len(self.live), many, 4), np.int8)
        v = np.tile(_whole_log(self.hmm.start), (many, 1))
        given = None if before is None else self.given(before)
        for k, n in enumerate(self.live):
            if k or given is not None:
                ways = (v if k else np.where(self.first[:, None], v, given))[:n, :, None] + move
                came[k, :n] = ways.argmax(1)
                x = ways.max(1)
                if not k:
                    x = np.where(self.first[:n, None], v[:n], x)
            else:
                x = v[:n].copy()
            x[:, 0] += gain[k, :n]
            v[:n] = np.maximum(x - x.max(1, keepdims=True), _NEVER)
        self.ends = self._back(v)
        return came

    def paths(self, came: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """(codon, piece): the states of the best path that ends in ``last``, or in the best state."""
        at = self.given(self.ends).argmax(1) if last is None else self.given(np.asarray(last))
        out = np.zeros((len(self.live), len(self.sizes)), np.int8)
        for k in range(len(self.live) - 1, -1, -1):
            n = self.live[k]
            out[k, :n] = at[:n]
            at[:n] = np.take_along_axis(came[k, :n], at[:n, None], 1)[:, 0]
        return out


def scan(hmm: Hmm, products: np.ndarray, best: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What each piece of one segment, in order, needs of the others: forward values before it, backward values at its end, values of best paths before it, and the state that the best path is in at its end."""
    n = len(products)
    before, after, ways, last = np.zeros((n, 4)), np.ones((n, 4)), np.zeros((n, 4), np.int64), np.zeros(n, np.int64)
    entry = np.zeros((n, 4), np.int64)
    f, v = hmm.start, _whole_log(hmm.start)
    for k in range(n):
        before[k], ways[k] = f, v
        f = _turned(f, products[k])
        f = f / f.max()
        to = v[:, None] + best[k]
        v = to.max(0)
        entry[k] = np.where(to == v, place[k], 4).argmin(0)
        v = np.maximum(v - v.max(), _NEVER)
    at = int(v.argmax())
    for k in range(n - 1, -1, -1):
        last[k], at = at, int(entry[k, at])
        if k:
            b = _turned(after[k], products[k].T)
            after[k - 1] = b / b.max()
    return before, after, ways, last


def coding_runs(path: np.ndarray, compat: bool = True) -> list[tuple[int, int]]:
    """(first, last) codons of coding runs.

    compat: a segment of one codon has none, and neither has one of two coding codons.
    """
    inside = np.concatenate(([False], path == 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    runs = [(int(a), int(z) - 1) for a, z in zip(edges[::2], edges[1::2], strict=True)]
    if compat and (len(path) == 1 or len(path) == 2 and runs == [(0, 1)]):
        return []
    return runs


def gap_sums(gaps: np.ndarray, times: np.ndarray, tau: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(2, 3): the shares of each kind in gaps that are there so many times, and these shares times the gaps, added up."""
    like = w * np.exp(-gaps[:, None] / tau - np.log(tau))
    total = like.sum(1, keepdims=True)
    share = np.where(total > 0, like / np.where(total > 0, total, 1), 1 / 3) * times[:, None]
    return np.stack((share.sum(0), (share * gaps[:, None]).sum(0)))


def fit_gaps(gaps: np.ndarray, rounds: int = 20, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """``fit_mixture`` of gaps in bases."""
    gaps, times = np.unique(np.asarray(gaps, float), return_counts=True)
    return fit_mixture(lambda tau, w: gap_sums(gaps, times, tau, w), int(times.sum()), rounds, tolerance)


def fit_mixture(sums: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, rounds: int = 20, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """(mean lengths in codons, weights) of a mixture of three exponentials over n gaps in bases, of which ``sums`` gives ``gap_sums``.

    Expectation maximisation from 3000, 80000 and 100 bases with weights 30 : 10 : 1; a
    scale is searched as its decimal logarithm by a simplex of two points.
    """
    theta, w = np.log10([3000.0, 80000.0, 100.0]), np.array([30.0, 10.0, 1.0]) / 41
    for _ in range(rounds):
        weights, moments = sums(10**theta, w)
        w = weights / n
        for j in range(3):
            if theta[j] != 0:
                theta[j] = simplex(lambda t, a=weights[j], m=moments[j]: m / 10**t + a * t * np.log(10), theta[j], 0.1, tolerance)
    return 10**theta / 3, w


def simplex(f, start: float, step: float, tolerance: float, most: int = 30) -> float:
    """Smallest point of f by a Nelder-Mead simplex of two points, until they are within tolerance.

    Whether they are is not asked before the first step, nor after one that went further out or
    drew the worse point in without making it better.
    """
    best, worst = sorted(((start, f(start)), (start + step, f(start + step))), key=lambda p: p[1])
    settled = False
    for _ in range(most + 1):
        if settled and abs(best[0] - worst[0]) < tolerance:
            return best[0]
        turned = 2 * best[0] - worst[0]
        value = f(turned)
        if value < best[1]:
            far = 3 * best[0] - 2 * worst[0]
            further = f(far)
            settled = not further < value
            worst = (turned, value) if settled else (far, further)
        else:
            middle = (best[0] + worst[0]) / 2
            value = f(middle)
            settled, worst = value < worst[1], (middle, value)
        if worst[1] < best[1]:
            best, worst = worst, best
    raise ArithmeticError("the fit of gap lengths did not settle")
