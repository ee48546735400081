"""Fill-in-middle: texts cut into prefix, middle and suffix by a byte automaton, and put together in another order.

One automaton over classes of bytes tells where units begin (a run of ASCII letters, or
one other code point), passes over UTF-8 continuation bytes, and recognises the sentinels.
Its state depends on the last two bytes only, which ``_window`` proves when it makes the
table, so that a batch is scanned by one table look-up a byte.  The scan counts the
transitions of each text that begin a unit or end a sentinel; a second pass takes the texts
that are cut and finds the bytes at which their units begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches
from .words import slices

#: fixed values: the sentinels of prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# classes of bytes
_OTHER, _LETTER, _NAME, _OPEN, _CLOSE, _CONT = range(6)
_CLASSES = 6
# states: after no letter, in a run of letters, behind "<", behind "<" and a sentinel's letter
_OUT, _RUN, _OPENED, _NAMED = range(4)
BEGIN, SENTINEL = 1, 2


def byte_classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    for mark in (PREFIX, SUFFIX, MIDDLE):
        out[ord(mark[1])] = _NAME
    out[ord("<")], out[ord(">")] = _OPEN, _CLOSE
    out[0x80:0xC0] = _CONT
    return out


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, what the transition tells) by state and class of the byte."""
    to, tells = np.zeros((4, _CLASSES), np.uint8), np.zeros((4, _CLASSES), np.uint8)
    for state in range(4):
        inside = state in (_RUN, _NAMED)
        to[state] = [_OUT, _RUN, _NAMED if state == _OPENED else _RUN, _OPENED, _OUT, _OUT]
        tells[state] = [BEGIN, BEGIN * (not inside), BEGIN * (not inside), BEGIN, BEGIN | SENTINEL * (state == _NAMED), 0]
    return to, tells


def _window() -> np.ndarray:
    """What a byte tells, by the classes of the two bytes before it and its own, from any state that can be there."""
    to, tells = transitions()
    out = np.zeros((_CLASSES, _CLASSES, _CLASSES), np.uint8)
    for a in range(_CLASSES):
        for b in range(_CLASSES):
            ends = {int(to[to[s, a], b]) for s in range(4)}
            if len(ends) > 1:
                raise AssertionError("the automaton remembers more than two bytes")
            out[a, b] = tells[ends.pop()]
    return out.ravel()


_CLASS, _TELLS = byte_classes(), _window()


def scan(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What every byte tells, and the classes, of texts one behind the other; a text begins as if no letter were before it."""
    own = _CLASS[data]
    before, earlier = np.zeros_like(own), np.zeros_like(own)
    before[1:], earlier[2:] = own[:-1], own[:-2]
    first = offsets[:-1][offsets[:-1] < len(own)]
    before[first] = earlier[first] = _OTHER
    second = first[first + 1 < len(own)] + 1
    earlier[second] = _OTHER
    return _TELLS[earlier * np.uint8(36) + before * np.uint8(6) + own], own


def _counted(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _transform(plain_from: int, spm_below: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [b.column(k).to_numpy() for k in range(1, 5)]
            for at, to, data, offsets in slices(b.column(0)):
                tells, classes = scan(data, offsets)
                begins = (tells & BEGIN) > 0
                n = _counted(begins, offsets)
                marked = _counted((tells & SENTINEL) > 0, offsets) > 0
                h1, h2, h3, h4 = (x[at:to] for x in h)
                plain = (n == 0) | marked | (h3 % 100 >= plain_from)
                # second pass: the bytes at which the units of the cut texts begin
                place = np.flatnonzero(begins)
                first = np.searchsorted(place, offsets[:-1])
                low, high = np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))
                ends = np.concatenate((place, [len(data)]))
                cut = lambda k: np.where(k < n, ends[np.minimum(first + k, len(place))], offsets[1:])  # noqa: E731, B023
                p, m = cut(low), cut(high)
                chars = np.concatenate(([0], np.cumsum(classes != _CONT, dtype=np.int64)))
                head, mid = chars[p] - chars[offsets[:-1]], chars[m] - chars[p]
                form = np.where(plain, "plain", np.where(h4 % 100 < spm_below, "spm", "psm"))
                raw, out = data.tobytes(), []
                for k, (a, x, y, z, f) in enumerate(zip(offsets[:-1].tolist(), p.tolist(), m.tolist(), offsets[1:].tolist(), form.tolist(), strict=True)):
                    if f == "plain":
                        out.append(raw[a:z])
                    elif f == "psm":
                        out.append(b"".join((b"<P>", raw[a:x], b"<S>", raw[y:z], b"<M>", raw[x:y])))
                    else:
                        out.append(b"".join((b"<S>", raw[y:z], b"<P>", raw[a:x], b"<M>", raw[x:y])))
                rest = [b.column(k).slice(at, to - at) for k in range(5, b.num_columns)]
                made = [pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(head, mask=plain), pa.array(mid, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*rest, *made], names=[*(f"c{k}" for k in range(len(rest))), "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    n: the units of the text.  Hashes of seed and id place the two cuts between units, each
    place as likely as any other, and choose the form: ``plain`` (the text as it is), ``psm``
    or ``spm``, by hundredths from ``plain_from`` up and below ``spm_below``.  Lengths are
    code points, null if plain.  Whole texts are cut, however long.

    Null texts count as empty; empty texts and those that hold a sentinel are plain, and so
    are never ambiguous.  A null id is hashed as ``null``.  Repeated rows give equal rows.  Empty
    tables give no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256)
    part = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[part(k) for k in range(4)], F.col(id_col).alias("doc_id"))
    kind = dict(rows.dtypes)["doc_id"]
    out = rows.mapInArrow(_transform(plain_from, spm_below), f"c0 {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("c0", "doc_id")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of.

    A text that was cut holds no sentinel, and none can arise where parts meet: each ends in ``>``
    and begins with ``<``.  So an output has its own three only.
    """
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    join = lambda *order: F.concat(*[F.element_at(parts, k) for k in order])
    return F.when(F.col(form) == "psm", join(2, 4, 3)).when(F.col(form) == "spm", join(3, 4, 2)).otherwise(F.col(output))


MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS p, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS m,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
t AS (SELECT doc_id, text, n, form, array_to_string(u[1:p], '') AS a, array_to_string(u[p + 1:m], '') AS b, array_to_string(u[m + 1:], '') AS c FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM t
"""
