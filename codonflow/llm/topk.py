"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Queries go to all tasks in blocks of bounded size, a block after the other; a task takes
its vectors in shards, and sorts a shard by every component once.  For a query, all
lists are read from the end that the query's component favours, a stretch at a
time; vectors met for the first time are scored at once; reading stops when the
bound, the product of the query with the components last read, is below the k-th best score
that the task has, of whatever shard.  The best of all tasks are merged.

Vectors without a few leading components, such as random ones of many dimensions, keep the
bound above all scores: then the lists are read to their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, small_batches

SHARD = 8192
#: bytes of queries that go to all tasks at once
BLOCK_BYTES = 16 << 20
STRETCH = 16  # entries of each list before the bound is looked at again, doubled every time
#: doubles add integers exactly below this
EXACT = 2.0**53
_LONG, _FAR = 2**63 - 1, 10**640  # the latter is beyond products of doubles
Best = list[tuple[int, int]]  # (-score, id), the best first


def _exact(a: np.ndarray, b: np.ndarray) -> int:
    return sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))


class Lists:
    """Vectors of a shard with one order of them per dimension, ascending.  ``read`` counts list entries read."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.sorted = np.argsort(self.vectors, axis=0, kind="stable").T.copy()  # (dimension, rank)
        self.values = np.take_along_axis(self.vectors.T, self.sorted, 1)
        self.largest = np.abs(self.vectors).sum(1)
        self.read = 0

    def _scored(self, rows: np.ndarray, query: np.ndarray, k: int) -> Best:
        """The k best of rows.  Where the sum of sizes passes what doubles add exactly, integers of any size are used."""
        with np.errstate(over="ignore", invalid="ignore"):
            risky = ~(self.largest[rows] * np.abs(query).max(initial=0.0) < EXACT)
            score = self.vectors[rows] @ query
        sure, held = rows[~risky], score[~risky]
        top = np.lexsort((self.ids[sure], -held))[:k]
        best = [(-int(s), int(i)) for s, i in zip(held[top], self.ids[sure[top]], strict=True)]
        return best + [(-_exact(self.vectors[r], query), int(self.ids[r])) for r in rows[risky].tolist()]

    def top(self, query: np.ndarray, own: int | None, k: int, best: Best | None = None) -> Best:
        """The k best of ``best`` and of the rows here but those of id own, ties to the smaller id."""
        n, dims = len(self.ids), np.flatnonzero(query)
        best = list(best or [])
        seen = np.zeros(n, bool) if own is None else self.ids == own
        if not len(dims):
            return sorted(best + [(0, int(i)) for i in self.ids[~seen][:k]])[:k]
        lists, values = self.sorted[dims], self.values[dims]
        up = query[dims] > 0  # the favoured end is the last
        depth, step = 0, STRETCH
        while depth < n:
            to = min(n, depth + step)
            self.read += (to - depth) * len(dims)
            new = np.zeros(n, bool)
            new[lists[up, n - to : n - depth].ravel()] = True
            new[lists[~up, depth:to].ravel()] = True
            new &= ~seen
            seen |= new
            best = sorted(best + self._scored(np.flatnonzero(new), query, k))[:k]
            depth, step = to, 2 * step
            if len(best) == k and depth < n:
                with np.errstate(over="ignore", invalid="ignore"):
                    each = np.where(up, values[:, n - depth], values[:, depth - 1]) * query[dims]
                    bound = each.sum() + 1e-12 * np.abs(each).sum()  # above what rounding takes away
                if bound < -best[-1][0]:
                    break
        return best


def _grid(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy()
    return out


def _search(given, width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = given.value
        best: list[Best] = [[] for _ in ids]
        held, n = [], 0

        def shard() -> None:
            lists = Lists(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
            for j, (q, v) in enumerate(zip(ids, queries, strict=True)):
                best[j] = lists.top(v, q, k, best[j])

        for b in batches:
            held.append((b.column(0).to_numpy(), _grid(b.column(1), width)))
            n += len(b)
            if n >= SHARD:
                shard()
                held, n = [], 0
        if n:
            shard()
        rows = [(q, i, max(-_LONG - 1, min(_LONG, -s))) + (("",) if abs(s) <= _LONG else (str(s + _FAR),)) for q, own in zip(ids, best, strict=True) for s, i in own]
        if rows:
            q, i, s, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.int64()), pa.array(x)], ["query_id", "vec_id", "score", "beyond"])

    return run


def _floor(x: Column) -> Column:
    """floor as a double: floor() itself gives a long, which large doubles are beyond; they have no fraction."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for every row whose id is divisible by ``every``.

    Components become floor(scale * x); the score is the integer inner product, ties go
    to the smaller id.  Scores are exact and so is their order; one beyond a long is given as
    the end of its range.  Vectors that are null or hold a null
    or non-finite component, and rows with a null id, take no part.  Fewer than k others: all
    of them.  A shorter vector counts as padded with zeros, an empty one as zeros.
    Repeated ids: every row is a candidate, a query's own id none, and its smallest vector
    asks.  Empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) != float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: _floor(c.cast("double") * scale)).alias("v"))
    with Scratch(spark) as scratch:
        rows = scratch.keep(rows)
        width = rows.agg(F.max(F.size("v"))).first()[0] or 0
        asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
        asked = scratch.keep(asked)
        blocks = max(1, -(-asked.count() * (width + 1) * 8 // BLOCK_BYTES))
        found = None
        for block in range(blocks):
            own = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()
            ids = own.column("id").to_pylist()
            if not ids:
                continue
            grid = np.concatenate([_grid(c, width) for c in own.column("v").chunks])
            given = spark.sparkContext.broadcast((ids, grid))
            new = scratch.keep(rows.mapInArrow(_search(given, width, k), "query_id long, vec_id long, score long, beyond string"))
            given.unpersist()
            found = new if found is None else found.unionByName(new)
        if found is None:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "beyond", "vec_id")
        return scratch.result(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
