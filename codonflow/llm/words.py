"""Vectorised words and shingles over Arrow string columns.

Everything here works on whole texts.  A batch is cut into slices of about
``SLICE_BYTES`` of UTF-8, so that the arrays made per byte stay small however
many rows a batch has; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 19
SHINGLE = 5

_U = np.uint64

#: bytes of ``[^\x20\x09-\x0D]``: all but the six ASCII white spaces
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and all beyond ASCII
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = True
PLAIN[0x61:0x7B] = True
PLAIN[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of each row and the end in them); a null is an empty text."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1 + texts.offset)[texts.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the number of words before it (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z become a-z; nothing else changes."""
    return _LOWER[data]


def lowered_latin(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of U+00C0 to U+00DE become small."""
    low = _LOWER[data]
    if len(low) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        low[1:][second] += 0x20
    return low


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64 bits (finaliser of the splitmix generator)."""
    with np.errstate(over="ignore"):
        x = x + _U((0x632BE59BD9B4E019 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], _U)
#: bytes of a word from which on it is hashed by itself
LONG_WORD = 512


def eights(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The k-th eight bytes of each span as a number, zeros where the span ends before."""
    at = starts + 8 * k
    left = np.clip(ends - at, 0, 8)
    room = np.concatenate((data, np.zeros(8, np.uint8)))
    every = np.ndarray((len(data) + 1,), "<u8", room, strides=(1,))
    return every[np.minimum(at, len(data))] & _MASKS[left]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span: eight at a time, each followed by a bijection that is not linear."""
    sizes = ends - starts
    h = mix(sizes.astype(_U), 7)
    open_ = np.flatnonzero((sizes > 0) & (sizes <= LONG_WORD))
    k = 0
    while len(open_):
        h[open_] = mix(h[open_] ^ eights(data, starts[open_], ends[open_], k), 1)
        k += 1
        open_ = open_[sizes[open_] > 8 * k]
    for w in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[w] = xxhash.xxh3_64_intdigest(data[starts[w] : ends[w]].tobytes())
    return h


def word_hash(word: bytes) -> int:
    """The hash that ``hashes`` gives to one word."""
    a = np.frombuffer(word, np.uint8)
    return int(hashes(a, np.array([0]), np.array([len(a)]))[0])


def shingles(h: np.ndarray, first: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words inside each text, and for each text the number of runs before it.

    A text with fewer words, but one at least, has its whole sequence as one run.
    """
    counts = np.diff(first)
    runs = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(runs, out=begin[1:])
    out = np.zeros(begin[-1], _U)
    with np.errstate(over="ignore"):
        if len(h) >= size:
            full = np.zeros(len(h) - size + 1, _U)
            for k in range(size):
                full = full * _U(0xD6E8FEB86659FD93) + h[k : len(h) - size + 1 + k]
            long = counts >= size
            keep = np.repeat(first[:-1][long] - begin[:-1][long], runs[long])
            at = np.flatnonzero(np.repeat(long, runs))
            out[at] = full[at + keep]
        for t in np.flatnonzero((counts > 0) & (counts < size)):
            x = _U(0)
            for y in h[first[t] : first[t + 1]]:
                x = x * _U(0xD6E8FEB86659FD93) + y
            out[begin[t]] = mix(np.array([x], _U), 11 + int(counts[t]))[0]
    return mix(out, 3), begin


#: bits of a mark of ``by_row``
MARK = 6


def by_row(x: np.ndarray, row: np.ndarray, rows: int, last: np.ndarray | None = None) -> np.ndarray:
    """Order of x by row, then by the marks ``last``, of MARK bits, smaller ones first, then value.

    One sort of a key of the row and the leading bits of the value; in the rare case that
    these do not tell all values apart, a sort of all keys.
    """
    bits = max(1, rows.bit_length())
    wide = bits + (MARK if last is not None else 0)
    key = (row.astype(_U) << _U(64 - bits)) | (x >> _U(wide))
    if last is not None:
        key |= last.astype(_U) << _U(64 - wide)
    order = np.argsort(key)
    y = x[order]
    tied = key[order[1:]] == key[order[:-1]]
    if (tied & (y[1:] < y[:-1])).any():
        return np.lexsort((x, row) if last is None else (x, last, row))
    return order


def flat_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, distinct shingle hashes by row and value, row of each from 0, how many each row has) of slices of rows.

    Words are divided by white space, A-Z lower-cased.
    """
    for at, to, data, offsets in slices(texts):
        low = lowered(data)
        starts, ends, first = spans(low, offsets, SPACED)
        sh, begin = shingles(hashes(low, starts, ends), first, size)
        row = np.repeat(np.arange(to - at), np.diff(begin))
        order = by_row(sh, row, to - at)
        sh, row = sh[order], row[order]
        if len(sh):
            keep = np.concatenate(([True], (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])))
            sh, row = sh[keep], row[keep]
        yield at, sh, row, np.bincount(row, minlength=to - at)


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for at, sh, _, count in flat_sets(texts, size):
        ends = np.cumsum(count)
        for k, (a, z) in enumerate(zip((ends - count).tolist(), ends.tolist(), strict=True)):
            yield at + k, sh[a:z]


def content_ids(sh: np.ndarray, row: np.ndarray, count: np.ndarray, clash: np.ndarray | None = None, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers of each row's set, 0 for an empty one.

    The first tells sets apart, but for those that meet in it; where it is in the sorted
    ``clash``, it is the second, another hash.  ``bits`` of the first are used.
    """
    ends = np.cumsum(count)
    both = []
    with np.errstate(over="ignore"):
        for seed in (21, 23):
            sums = np.concatenate((np.zeros(1, _U), np.cumsum(mix(sh, seed), dtype=_U)))
            total = sums[ends] - sums[ends - count] + count.astype(_U)
            both.append(np.where(count > 0, mix(total, seed + 1), _U(0)))
    first = (both[0] >> _U(64 - bits)).view(np.int64)
    second = both[1].view(np.int64)
    if clash is not None and len(clash):
        first = np.where(np.isin(first, clash), second, first)
    return first, second
