"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: a node divides its points at the median of their
projection on the line between two of them.  Every vector of the table is then placed in one
leaf a tree.  A query walks all trees through one priority queue, nearest parts first (by the sum
of the squared distances to the planes it would have to cross), until the leaves it met hold
as many entries as asked for.  Leaves and the queries that visit them meet by a shuffle on
the leaf; all candidates there are ranked by their exact distances, and the best of all leaves
are merged.  Equal vectors are one entry with as many of their ids, the smallest, as a query can use.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, small_batches
from .topk import _grid


@dataclass(frozen=True)
class Search:
    """trees; rows of the table a leaf is to hold; rows and bytes of the sample, at least so many of which are in a leaf.

    A query looks at ``base`` entries of leaves and ``share`` of the number of different vectors.
    """

    trees: int = 16
    leaf: int = 128
    sample: int = 20_000
    sample_bytes: int = 16 << 20
    least: int = 8
    base: int = 2048
    share: float = 0.6
    seed: int = 11


#: rows and queries of a leaf that one group compares; what is beyond is dealt into more groups
ROWS, QUERIES = 8192, 2048
#: queries whose best a task keeps at a time
KEPT = 50_000


class Forest:
    """Trees as arrays: planes, thresholds and the two parts of each node; a part below 0 is leaf -part - 1, all trees counted through."""

    def __init__(self, points: np.ndarray, trees: int, leaf: int, seed: int):
        self.roots, self.leaves = [], 0
        planes, levels, parts = [], [], []
        rng = np.random.default_rng(seed)

        def grow(rows: np.ndarray) -> int:
            if len(rows) > leaf:
                a, b = points[rng.choice(rows, 2, replace=False)]
                plane = (a - b) / (np.linalg.norm(a - b) or 1.0)
                place = points[rows] @ plane
                level = float(np.median(place))
                low = place <= level
                if 0 < low.sum() < len(rows):
                    me = len(planes)
                    planes.append(plane)
                    levels.append(level)
                    parts.append([0, 0])
                    parts[me] = [grow(rows[low]), grow(rows[~low])]
                    return me
            self.leaves += 1
            return -self.leaves

        for _ in range(trees):
            self.roots.append(grow(np.arange(len(points))))
        width = points.shape[1]
        self.planes = np.array(planes).reshape(-1, width)
        self.levels, self.parts = np.array(levels), np.array(parts, np.int64).reshape(-1, 2)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """(row, tree): the leaf that each vector is in."""
        at = np.tile(np.array(self.roots), (len(vectors), 1))
        for t in range(len(self.roots)):
            open_ = np.flatnonzero(at[:, t] >= 0)
            while len(open_):
                node = at[open_, t]
                beyond = np.einsum("ij,ij->i", vectors[open_], self.planes[node]) > self.levels[node]
                at[open_, t] = self.parts[node, beyond.astype(np.int64)]
                open_ = open_[at[open_, t] >= 0]
        return -at - 1

    def visit(self, query: np.ndarray, sizes: np.ndarray, entries: int) -> list[int]:
        """Leaves that hold ``entries`` in all, of all trees by one queue."""
        off = (self.planes @ query - self.levels).tolist()
        parts = self.parts.tolist()
        queue = [(0.0, r) for r in self.roots]
        heapq.heapify(queue)
        out, n = [], 0
        while queue and n < entries:
            far, at = heapq.heappop(queue)
            while at >= 0:
                side = off[at] > 0
                heapq.heappush(queue, (far + off[at] * off[at], parts[at][not side]))
                at = parts[at][side]
            out.append(-at - 1)
            n += sizes[-at - 1]
        return out


def _placed(given, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = given.value.place(_grid(b.column(0), width)).astype(np.int32)
            offsets = np.arange(len(b) + 1, dtype=np.int32) * leaves.shape[1]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaves.ravel()))], names=[*b.schema.names, "leaves"])

    return run


def _visits(given, width: int, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, sizes = given.value
        for b in batches:
            leaves = [forest.visit(q, sizes, entries) for q in _grid(b.column(0), width)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaves, pa.list_(pa.int32()))], names=[*b.schema.names, "leaves"])

    return run


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences of each component in turn."""
    total = np.zeros((len(queries), len(rows)))
    for q, r in zip(queries.T, rows.T, strict=True):
        d = q[:, None] - r
        total += d * d
    return np.sqrt(total)


Entry = tuple[float, int, int, int]  # score, id, which of several vectors, which of several rows


class _Best:
    """The k best of each query, each entry once, however many trees have found it."""

    def __init__(self, k: int):
        self.k, self.of = k, {}

    def limit(self, query: int) -> float:
        own = self.of.get(query, ())
        return own[-1][0] if len(own) == self.k else np.inf

    def add(self, query: int, found: list[Entry]) -> None:
        self.of[query] = sorted({*self.of.get(query, ()), *found})[: self.k]

    def flush(self) -> Iterator[pa.RecordBatch]:
        rows = [(q, *e) for q, own in self.of.items() for e in own]
        self.of = {}
        for k in range(0, len(rows), 50_000):
            q, s, i, v, n = zip(*rows[k : k + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64()), pa.array(v, pa.int64()), pa.array(n, pa.int32())], names=["query_id", "vec_id", "score", "vec", "nth"])


def _ranked(width: int, k: int):
    """Exact ranking inside groups (leaf, two numbers of slices); a group's queries come before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        group, asked, ids = None, [], []

        def compare(rows: pa.RecordBatch) -> None:
            queries = np.concatenate(asked)
            own = np.concatenate(ids)
            many = rows.column(6)
            size = np.diff(many.offsets.to_numpy())
            entry_id, times = (many.flatten().field(f).to_numpy() for f in ("id", "n"))
            at = np.repeat(np.arange(len(rows)), size)
            vec = rows.column(4).to_numpy()
            score = distances(queries, _grid(rows.column(5), width))
            for q, qid in enumerate(own.tolist()):
                row = score[q]
                near = row <= best.limit(qid)
                if len(row) > 4 * k and near.sum() > 4 * k:
                    near &= row <= np.partition(row, 2 * k)[2 * k]  # rows with the own id only, if ids repeat, are added below
                    if not (near[at] & (entry_id != qid)).sum() >= k:
                        near = row <= best.limit(qid)
                hit = np.flatnonzero(near[at] & (entry_id != qid))
                if len(hit):
                    best.add(qid, [(float(row[at[e]]), int(entry_id[e]), int(vec[at[e]]), n) for e in hit.tolist() for n in range(min(int(times[e]), k))])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in range(4)], 1)
            edges = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(b)])) if len(b) else np.zeros(1, np.int64)
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key, kind = tuple(keys[a, :3].tolist()), keys[a, 3]
                if key != group:
                    group, asked, ids = key, [], []
                    if len(best.of) > KEPT:
                        yield from best.flush()
                part = b.slice(a, z - a)
                if kind == 0:
                    asked.append(_grid(part.column(5), width))
                    ids.append(part.column(4).to_numpy())
                elif asked:
                    for j in range(0, z - a, 1024):
                        compare(part.slice(j, 1024))
        yield from best.flush()

    return run


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", search: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every``, the k nearest found of all other rows.

    score is the Euclidean distance in double precision; nearest first, ties to the smaller id.  A
    query looks at at least ``search.base`` entries, so that small tables are searched whole;
    over large ones recall depends on ``search.share`` and the data.

    Vectors that are null, zero, or hold a null or non-finite component, and rows with a null id, take
    no part.  A shorter vector counts as padded with zeros.  Repeated ids: every row is
    a candidate, a query's own id none, and its smallest vector asks.  Fewer than k others: all
    of them, if found.  Empty tables give no rows; other columns are ignored.

    The driver holds the sample, the forest and one number a leaf; a leaf of a table that
    has outgrown the sample is dealt into groups of ROWS rows and QUERIES queries.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    x = F.col(vector_col)
    kind = dict(vectors.dtypes)[vector_col]
    ok = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))) & F.exists(x, lambda c: c != 0)
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull()).where(ok)
    # -0 and 0 are one number
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.when(c == 0, F.lit(0)).otherwise(c)).cast(kind).alias("v"))
    with Scratch(spark) as scratch:
        rows = scratch.keep(rows)
        width = rows.agg(F.max(F.size("v"))).first()[0] or 0
        each = rows.groupBy("v", "id").agg(F.count("*").alias("n"))
        few = each.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
        points = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", F.least("n", F.lit(k)).alias("n")))).alias("ids"))
        points = scratch.keep(points.select("v", F.xxhash64("v").alias("vec"), "ids"))
        n = points.count()
        most = max(search.least, min(search.sample, search.sample_bytes // (8 * max(1, width))))
        place = F.pmod(F.xxhash64("vec"), F.lit(1 << 30))
        some = points.where(place < int(min(1.0, 1.5 * most / max(1, n)) * (1 << 30)))  # so that no task sorts much more than the sample
        drawn = some.orderBy(place, "vec").limit(most).select("v").toArrow().combine_chunks()
        if not n:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        sample = np.concatenate([_grid(c, width) for c in drawn.column("v").chunks])
        forest = Forest(sample, search.trees, max(search.least, search.leaf * len(sample) // n), search.seed)
        given = spark.sparkContext.broadcast(forest)
        placed = scratch.keep(points.mapInArrow(_placed(given, width), f"v {kind}, vec long, ids array<struct<id:long,n:long>>, leaves array<int>"))
        scratch.drop(points)

        def sizes(df: DataFrame) -> dict[int, int]:
            return {r["leaf"]: r["n"] for r in df.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n")).collect()}

        held = sizes(placed)
        at_leaf = np.array([held.get(leaf, 0) for leaf in range(forest.leaves)])
        both = spark.sparkContext.broadcast((forest, at_leaf.tolist()))
        asks = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).select("v", "id")
        asks = scratch.keep(asks.mapInArrow(_visits(both, width, int(search.base + search.share * n)), f"v {kind}, id long, leaves array<int>"))
        visited = sizes(asks)
        groups = [(leaf, -(-held.get(leaf, 0) // ROWS) or 1, -(-q // QUERIES)) for leaf, q in sorted(visited.items())]
        groups = F.broadcast(spark.createDataFrame(groups, "leaf int, rs int, qs int"))
        own, every_one = lambda c, m: F.pmod(F.xxhash64(c), F.col(m)).cast("int"), lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
        no_ids = F.array().cast("array<struct<id:long,n:long>>")
        q = asks.select("v", "id", F.explode("leaves").alias("leaf")).join(groups, "leaf")
        q = q.select("leaf", every_one("rs").alias("r"), own("id", "qs").alias("q"), F.lit(0).alias("kind"), F.col("id").alias("key"), "v", no_ids.alias("ids"))
        p = placed.select("v", "vec", "ids", F.explode("leaves").alias("leaf")).join(groups, "leaf")
        p = p.select("leaf", own("vec", "rs").alias("r"), every_one("qs").alias("q"), F.lit(1).alias("kind"), F.col("vec").alias("key"), "v", "ids")
        met = q.unionByName(p).repartition("leaf", "r", "q").sortWithinPartitions("leaf", "r", "q", "kind")
        found = met.mapInArrow(_ranked(width, k), "query_id long, vec_id long, score double, vec long, nth int").distinct()
        order = Window.partitionBy("query_id").orderBy("score", "vec_id", "vec", "nth")
        return scratch.result(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found, of (query_id, vec_id) each."""
    total = exact.count()
    return exact.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0
