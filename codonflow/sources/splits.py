"""Text files read in splits by many tasks, each line with what the lines before it make of it.

What a format carries from line to line (the byte at which a line begins, the last header, what
was counted since, how many headers there were) is found in two passes.  The first
reduces each split to one small row; the driver adds these up in the order of a file; the
second starts every split with what comes before it.  No line is shuffled, no task reads more
than its split, and results do not depend on how a file is split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: whether each line is a mark, and what it counts for
Marks = Callable[[pa.Array], pa.Array]
Weights = Callable[[pa.Array], np.ndarray]


@dataclass(frozen=True)
class State:
    """Before a line: its byte, the last mark, what the lines since then weigh, and the number of marks."""

    at: int = 0
    mark: str | None = None
    since: int = 0
    marks: int = 0

    def then(self, other: State) -> State:
        """The state behind a stretch that, begun from nothing, ends in ``other``."""
        since = other.since if other.mark is not None else self.since + other.since
        return State(self.at + other.at, self.mark if other.mark is None else other.mark, since, self.marks + other.marks)


@dataclass
class Stretch:
    """Lines of one split, and for each of them the state before it; a mark is its own last mark."""

    lines: pa.Array
    at: np.ndarray
    last: np.ndarray  # the line with the last mark, -1: one before the stretch
    since: np.ndarray
    marks: np.ndarray
    before: State
    after: State

    def mark(self) -> pa.Array:
        own = self.lines.take(pa.array(np.maximum(self.last, 0))) if len(self.lines) else self.lines
        return pc.if_else(pa.array(self.last >= 0), own, pa.scalar(self.before.mark, pa.string()))


def stretch(lines: pa.Array, before: State, sep: int, mark: Marks | None, weigh: Weights | None) -> Stretch:
    n = len(lines)
    size = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + sep
    end = before.at + np.cumsum(size)
    is_mark = np.zeros(n, bool) if mark is None else mark(lines).to_numpy(zero_copy_only=False).astype(bool)
    weight = np.zeros(n, np.int64) if weigh is None else np.where(is_mark, 0, weigh(lines)).astype(np.int64)
    last = np.maximum.accumulate(np.where(is_mark, np.arange(n), -1)) if n else np.zeros(0, np.int64)
    total = np.concatenate(([0], np.cumsum(weight)))
    since = np.where(last >= 0, total[:-1] - total[np.maximum(last, 0)], before.since + total[:-1])
    marks = before.marks + np.cumsum(is_mark)
    after = before
    if n:
        after = State(int(end[-1]), lines[int(last[-1])].as_py() if last[-1] >= 0 else before.mark, int(since[-1] + weight[-1]), int(marks[-1]))
    return Stretch(lines, end - size, last, since, marks, before, after)


def _stretches(batches: Iterator[pa.RecordBatch], starts: dict | None, sep: int, mark: Marks | None, weigh: Weights | None) -> Iterator[tuple[tuple[str, int], Stretch]]:
    """Batches of (file, split, line) cut where splits end, each with the state before it: from nothing, or as ``starts`` says."""
    key, state = None, State()
    for b in batches:
        file, split = b.column(0), b.column(1).to_numpy()
        change = np.flatnonzero((split[1:] != split[:-1]) | pc.not_equal(file[1:], file[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(b) else np.zeros(0, np.int64)
        edges = [0, *change.tolist(), len(b)] if len(b) else [0]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            own = (file[a].as_py(), int(split[a]))
            if own != key:
                key = own
                if starts is not None and own not in starts:
                    raise RuntimeError("files, or how the session splits them, have changed between the two passes")
                state = State() if starts is None else starts[own]
            one = stretch(b.column(2).slice(a, z - a), state, sep, mark, weigh)
            state = one.after
            yield key, one


def whole_text_of(file: str) -> str:
    """The file itself, or its folder, if it is one of the parts that Spark has written there."""
    folder, _, name = file.rpartition("/")
    return folder if name.startswith("part-") else file


def marked(spark: SparkSession, path, emit: Callable[[str, Iterator[Stretch]], Iterator[pa.RecordBatch]], schema: str, mark: Marks | None = None, weigh: Weights | None = None, sep: str = "\n") -> DataFrame:
    """What ``emit`` makes of the stretches of each split, of the files at path; rows are lines up to ``sep``.

    ``part-*`` files of one folder, as Spark writes them, are one text in the order of their names,
    which has the folder's name.  The driver gets a row for each split: its last mark and three numbers.
    """
    lines = spark.read.option("lineSep", sep).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))
    width = len(sep.encode())

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        done = []
        for own, one in _stretches(batches, None, width, mark, weigh):
            if own != key and key is not None:
                done.append((*key, state))
            key, state = own, one.after
        if key is not None:
            done.append((*key, state))
        cols = list(zip(*((f, s, x.at, x.mark, x.since, x.marks) for f, s, x in done), strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["file", "split", "at", "mark", "since", "marks"])

    found = lines.mapInArrow(summary, "file string, split long, at long, mark string, since long, marks long").collect()
    starts, state, file = {}, State(), None
    for r in sorted(found, key=lambda r: (whole_text_of(r["file"]), r["file"], r["split"])):
        if whole_text_of(r["file"]) != file:
            file, state = whole_text_of(r["file"]), State()
        starts[r["file"], r["split"]] = state
        state = state.then(State(r["at"], r["mark"], r["since"], r["marks"]))
    given = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = _stretches(batches, given.value, width, mark, weigh)
        ahead = next(every, None)

        def own(key) -> Iterator[Stretch]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                yield ahead[1]
                ahead = next(every, None)

        while ahead is not None:
            key = ahead[0]
            part = own(key)
            yield from emit(whole_text_of(key[0]), part)
            for _ in part:
                pass

    return lines.mapInArrow(run, schema)


def marked_lines(spark: SparkSession, path, mark: Marks | None = None, weigh: Weights | None = None, sep: str = "\n", counted: bool = False) -> DataFrame:
    """(file, at, mark, since, marks, line) of every line: the byte it begins at, the last mark, what lines since weigh, and the number of marks so far.

    Empty files give no rows; lines before the first mark have none.  counted: marks are numbered only, and none is given.
    """

    def emit(file: str, part: Iterator[Stretch]) -> Iterator[pa.RecordBatch]:
        for s in part:
            name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(s.lines), np.int32)), pa.array([file])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([name, pa.array(s.at), pa.nulls(len(s.lines), pa.string()) if counted else s.mark(), pa.array(s.since), pa.array(s.marks), s.lines], names=["file", "at", "mark", "since", "marks", "line"])

    return marked(spark, path, emit, "file string, at long, mark string, since long, marks long, line string", mark, weigh, sep)


def sequence_pieces(spark: SparkSession, path, most: int = 1 << 16) -> DataFrame:
    """(chrom, start, seq) of FASTA files: pieces of at most ``most`` bases, which do not overlap; the id is the first token behind ``>``.

    A piece ends where its split or its record does.  White space inside a sequence is dropped; what
    stands before the first header is left out.  Each record begins with a piece of no bases, so that one without any is known too.
    """
    blank = lambda x: pc.replace_substring_regex(x, r"\s", "")

    def emit(file: str, part: Iterator[Stretch]) -> Iterator[pa.RecordBatch]:
        chrom, start, held, n = None, 0, [], 0

        def flush() -> Iterator[tuple[str, int, str]]:
            seq = "".join(held)
            for k in range(0, len(seq), most):
                yield chrom, start + k, seq[k : k + most]

        for s in part:
            out = []
            names = [None if m is None else (m[1:].split() or [""])[0] for m in s.mark().dictionary_encode().dictionary.to_pylist()]
            codes = s.mark().dictionary_encode().indices.to_pylist()
            for line, last, code, since in zip(blank(s.lines).to_pylist(), s.last.tolist(), codes, s.since.tolist(), strict=True):
                if line.startswith(">"):
                    out += flush()
                    chrom, start, held, n = names[code], 1, [], 0
                    out.append((chrom, 1, ""))
                    continue
                if code is None:
                    continue
                if last >= 0 and since == 0 or names[code] != chrom or not held or n >= most:
                    out += flush()
                    chrom, start, held, n = names[code], since + 1, [], 0
                if line:
                    held.append(line)
                    n += len(line)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["chrom", "start", "seq"])
        out = list(flush())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["chrom", "start", "seq"])

    return marked(spark, path, emit, "chrom string, start long, seq string", lambda x: pc.starts_with(x, ">"), lambda x: pc.utf8_length(blank(x)).to_numpy(zero_copy_only=False))
