"""Exact n-gram Jaccard join by pivots in the Jaccard metric space.

Jaccard distance is a metric, but nearly all pairs of documents have distance 1,
where a pivot tells nothing.  So pivots are taken where they do tell something:

1. The set of a document is reduced to a content id; copies share it.
2. All shingles are put in one total order, frequent ones last, the most frequent at the end (``_prefixes``).
   Two sets within the distance share a shingle of their prefixes, so every
   shingle in two prefixes opens a *block*, and only documents of one block can link.
3. Each block takes a pivot; a pivot and the documents of its blocks are its
   region, and a document in the blocks of several pivots is replicated to all of
   them.  Distances to the pivots are exact.  Documents within the distance link.
4. The rest of every block recurses: documents already connected need no further
   look, the next pivot comes from those not connected to a former one.
5. What is left after ``pivot_rounds`` is joined exactly.  Blocks with many open pairs
   are joined by region, within the windows of the triangle inequality around its pivot
   (``_hot_links``).  Elsewhere pairs of a block that are not connected, pass the
   size filter, lie in each other's window for every pivot that both were measured
   against, and share enough of their prefixes are verified on the whole sets.

Links between connected documents that were never measured are counted as
connected, not listed: components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import Scratch, components, parts, small_batches

#: a shingle counts as frequent from so many reported occurrences on; only the most frequent are told apart
FREQUENT_FROM, FREQUENT_MOST = 4, 1 << 19
#: occurrences among so many shingles from which a task reports one; what is not reported counts as rare, and opens blocks that grow with the table
LOCAL_FROM, COUNTED_AT_ONCE = 2, 1 << 22
#: open pairs of a block from which it is joined as part of a region, on whole sets
HOT_PAIRS = 20_000
#: documents of a region that meet in one task: not connected ones, and all; and their shingles
REGION_LEFT, REGION_RIGHT = 512, 2048
REGION_SHINGLES = 1 << 20
#: participants of a verification up to which their ids are broadcast (16 bytes each); a join by shuffle beyond
BROADCAST_ROWS = 1_000_000
SALTS = 16
_U = np.uint64


def _need(n, percent: int):
    """Shingles that a set of n must share with any set that it links with."""
    return -(-n * percent // 100)


def _fingerprints(size: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local, held = [], 0
        for b in batches:
            n, sid, tag = [], [], []
            for _, sh, row, count in words.flat_sets(b.column(1), size):
                n.append(count)
                one, other = words.content_ids(sh, row, count, None, bits)
                sid.append(one)
                tag.append(other)
                local.append(sh)
                held += len(sh)
                if held >= COUNTED_AT_ONCE:
                    yield _often(local)
                    local, held = [], 0
            if n:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(n), pa.int64()), pa.array(np.concatenate(sid)), pa.array(np.concatenate(tag)), pa.nulls(len(b), pa.int64())], ["doc_id", "n", "sid", "tag", "often"])
        if held:
            yield _often(local)

    return run


def _often(local: list[np.ndarray]) -> pa.RecordBatch:
    seen, counts = _runs(np.concatenate(local))
    keep = counts >= LOCAL_FROM
    m = int(keep.sum())
    return pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array(counts[keep], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(seen[keep].view(np.int64))], ["doc_id", "n", "sid", "tag", "often"])


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
    return x[at[:-1]], np.diff(at)


def _mark(counts: np.ndarray) -> np.ndarray:
    """What frequent shingles of so many occurrences are told apart by: a larger number for each quarter more."""
    return np.clip(1 + np.log(counts / FREQUENT_FROM) / np.log(1.25), 1, (1 << words.MARK) - 1).astype(np.uint8)


def _prefixes(frequent: np.ndarray, marks: np.ndarray, percent: int, size: int, clash: np.ndarray, bits: int):
    """(shingle, sid, n, salt) of the prefix of every set, frequent shingles last and the more so the more frequent they are; salt is 0 for rare ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for b in batches:
            for _, sh, row, count in words.flat_sets(b.column(0), size):
                sid, _ = words.content_ids(sh, row, count, clash, bits)
                own, first = np.unique(sid, return_index=True)
                if len(done) > 200_000:
                    done.clear()
                # a copy met in this task has the same prefix
                new = [k for x, k in zip(own.tolist(), first.tolist(), strict=True) if count[k] and x not in done]
                done.update(sid[new].tolist())
                chosen = np.zeros(len(count), bool)
                chosen[new] = True
                keep = chosen[row]
                sh, row, n = sh[keep], row[keep], np.where(chosen, count, 0)
                at = np.searchsorted(frequent, sh)
                at[at == len(frequent)] = 0
                often = np.where(frequent[at] == sh, marks[at], 0) if len(frequent) else np.zeros(len(sh), np.uint8)
                order = words.by_row(sh, row, len(count), often)
                sh, row, often = sh[order], row[order], often[order]
                place = np.arange(len(sh)) - (np.cumsum(n) - n)[row]
                head = place < (n - _need(n, percent) + 1)[row]
                sh, row, often = sh[head], row[head], often[head]
                salt = np.where(often > 0, words.mix(sid[row].view(_U), 5) % _U(SALTS) + _U(1), _U(0)).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(sid[row]), pa.array(n[row].astype(np.int32)), pa.array(salt)], ["shingle", "sid", "n", "salt"])

    return run


def _sets(size: int, clash: np.ndarray, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, sh, row, count in words.flat_sets(b.column(0), size):
                has = count > 0
                ends = np.concatenate(([0], np.cumsum(count[has]) * 8)).astype(np.int32)
                own = pa.Array.from_buffers(pa.binary(), int(has.sum()), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(sh))])
                yield pa.RecordBatch.from_arrays([pa.array(words.content_ids(sh, row, count, clash, bits)[0][has]), own], ["sid", "own"])

    return run


def _alive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle and sid: those whose shingle another sid has too, and all salted ones.  Holds back one row."""
    last = None  # the row held back, and whether the one before it had its shingle
    for b in batches:
        x = [b.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
        if last is not None:
            x = [np.concatenate((last[0][k], x[k])) for k in range(4)]
        if not len(x[0]):
            continue
        new = np.concatenate(([True], (x[0][1:] != x[0][:-1]) | (x[1][1:] != x[1][:-1])))
        x = [c[new] for c in x]
        same = x[0][1:] == x[0][:-1]
        before = np.concatenate(([last is not None and last[1]], same))
        live = (before[:-1] | same) | (x[3][:-1] > 0)
        if live.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][live]) for c in x[:3]], ["shingle", "sid", "n"])
        last = [c[-1:] for c in x], bool(before[-1])
    if last is not None and (last[1] or last[0][3][0] > 0):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in last[0][:3]], ["shingle", "sid", "n"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The intersection size of the two sets of each row."""
    for b in batches:
        left, right = b.column(2), b.column(3)
        common = []
        for k in range(len(b)):
            x, y = np.frombuffer(left[k].as_buffer(), _U), np.frombuffer(right[k].as_buffer(), _U)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            common.append(int((y[at] == x).sum()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(common, pa.int64()), b.column(4), b.column(5)], ["a", "b", "common", "na", "nb"])


def _plausible(pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b, na, nb, c) that share c shingles of their prefixes, those that can still link.

    Up to the smaller of their last prefix shingles, all that two sets share is in
    both prefixes; beyond it the set that ends there has need - 1 shingles left.
    """
    need = lambda n: F.ceil(F.col(n) * percent / 100)
    return pairs.where(_sizes_fit("na", "nb", percent)).where(F.col("c") + F.greatest(need("na"), need("nb")) - 1 >= F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent)))


def _sizes_fit(x: str, y: str, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


class _Measure:
    """Exact intersections of pairs of sets, which are made again from the texts of the pairs' documents."""

    def __init__(self, docs: DataFrame, ids: DataFrame, size: int, clash: np.ndarray, bits: int, scratch: Scratch):
        self.docs, self.sets_of, self.scratch = docs, _sets(size, clash, bits), scratch
        self.of = scratch.keep(ids.where("doc_id is not null and n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))

    def sets(self, sids: DataFrame) -> DataFrame:
        """(sid, own) for each of sids(sid)."""
        wanted = self.scratch.keep(sids.distinct().join(self.of, "sid").select("doc_id").distinct())
        if wanted.count() <= BROADCAST_ROWS:
            wanted = F.broadcast(wanted)
        sets = self.docs.join(wanted, "doc_id").select("text").mapInArrow(self.sets_of, "sid long, own binary")
        return sets.groupBy("sid").agg(F.first("own").alias("own"))

    def __call__(self, pairs: DataFrame) -> DataFrame:
        sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("sid")))
        x = sets.select(F.col("sid").alias("a"), F.col("own").alias("own_a"))
        y = sets.select(F.col("sid").alias("b"), F.col("own").alias("own_b"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "own_a", "own_b", "na", "nb")
        return self.scratch.keep(both.mapInArrow(_shared, "a long, b long, common long, na long, nb long"))


def _labelled(live: DataFrame, comps: DataFrame, scratch: Scratch) -> DataFrame:
    """live with the component of each sid, without the blocks that are of one component."""
    comps = comps.select(F.col("node").alias("sid"), "root")  # a pivot without a link of its own is its root
    rows = live.select("shingle", "sid", "n", "w").join(comps, "sid", "left").select("shingle", "sid", "n", "w", F.coalesce("root", "sid").alias("comp"))
    open_ = rows.groupBy("shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("shingle")
    return scratch.keep(rows.join(open_, "shingle"))


def _nearest(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): for each document linked with pivots the smallest of them, or of those that this one is linked with.

    Documents of one root are connected; connected ones need not have one root yet.
    """
    to = scratch.keep(links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")))
    on = to.select(F.col("node").alias("m"), F.col("m").alias("next"))
    return to.join(on, "m", "left").select("node", F.coalesce("next", "m").alias("root"))


def _blocks(state: DataFrame) -> DataFrame:
    """(shingle, major, pairs): the largest component of each block, and pairs with a document outside it."""
    each = state.groupBy("shingle", "comp").agg(F.count("*").alias("c")).groupBy("shingle")
    each = each.agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"))
    return each.select("shingle", F.col("m.comp").alias("major"), ((F.col("all") - F.col("m.c")) * F.col("all")).alias("pairs"))


def _cold_pairs(state: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs of the other blocks that are not connected, with the number of blocks that they share."""
    own = state.join(blocks.where(F.col("pairs") < HOT_PAIRS), "shingle")
    x = own.where("comp <> major").select("shingle", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("comp_x"))
    y = own.select("shingle", F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("comp_y"), (F.col("comp") == F.col("major")).alias("in_major"))
    pairs = x.join(y, "shingle").where(F.col("comp_x") != F.col("comp_y")).where(F.col("in_major") | (F.col("x") < F.col("y"))).where(_sizes_fit("nx", "ny", percent))
    swap = F.col("x") > F.col("y")
    return pairs.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(
        F.max(F.when(swap, F.col("ny")).otherwise(F.col("nx"))).cast("long").alias("na"), F.max(F.when(swap, F.col("nx")).otherwise(F.col("ny"))).cast("long").alias("nb"), F.count("*").alias("c"))


def _hot_links(state: DataFrame, blocks: DataFrame, measure: _Measure, distances: DataFrame | None, percent: int) -> DataFrame | None:
    """Links of the blocks with many open pairs.

    All these blocks with one largest component are the region of its root, the pivot, and
    its documents are compared on whole sets.  A band holds the distances to the pivot of
    the width of the threshold; a document meets those of its own band and of the two
    beside it, as the triangle inequality allows no others, or of all bands if its
    distance was not measured.  A pair that shares such a block is settled here,
    whatever other blocks it shares.
    """
    hot = blocks.where(F.col("pairs") >= HOT_PAIRS)
    if hot.isEmpty():
        return None
    members = state.join(hot, "shingle").groupBy(F.col("major").alias("p"), "sid").agg(F.max("comp").alias("comp"), F.max("n").cast("long").alias("n"))
    members = members.withColumn("outside", F.col("comp") != F.col("p"))
    width, last = 1 - percent / 100, int(1 / (1 - percent / 100) - 1e-9)
    if distances is not None:
        d = distances.select(F.col("a").alias("sid"), F.col("b").alias("p"), F.least(F.floor((1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))) / (width + 1e-9)), F.lit(last)).cast("int").alias("band")).dropDuplicates(["sid", "p"])
        members = members.join(d, ["sid", "p"], "left").withColumn("band", F.when(F.col("sid") == F.col("p"), 0).otherwise(F.col("band")))
    else:
        members = members.withColumn("band", F.lit(None).cast("int"))
    members = measure.scratch.keep(members)
    parts_of = lambda rows, limit, shingles: F.ceil(F.greatest(rows / limit, shingles / REGION_SHINGLES))
    outside = F.coalesce(F.sum(F.when(F.col("outside"), F.col("n"))), F.lit(0))
    sizes = members.groupBy("p").agg(parts_of(F.count_if("outside"), REGION_LEFT, outside).alias("lefts"), parts_of(F.count("*"), REGION_RIGHT, F.sum("n")).alias("rights"))
    placed = measure.scratch.keep(members.join(sizes, "p").where("lefts > 0"))
    sets = measure.sets(placed.select("sid"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n).cast("int") - 1)
    one_of = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    bands = F.array(*[F.lit(k) for k in range(last + 1)])
    left = placed.where("outside").withColumn("band", F.explode(F.when(F.col("band").isNull(), bands).otherwise(F.array("band"))))
    left = left.select("p", "band", one_of("lefts").alias("i"), F.explode(all_of("rights")).alias("j"), "sid", "comp")
    met = left.select("p", "band").distinct()
    beside = F.explode(F.when(F.col("band").isNull(), bands).otherwise(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    right = placed.withColumn("band", beside).join(met, ["p", "band"], "left_semi")
    right = right.select("p", "band", F.explode(all_of("lefts")).alias("i"), one_of("rights").alias("j"), "sid", "comp")
    left, right = left.join(sets, "sid"), right.join(sets, "sid")
    right = right.select(*[F.col(c).alias(c) for c in ("p", "band", "i", "j", "sid", "comp", "own")])  # a side of its own
    key = ["p", "band", "i", "j"]
    return measure.scratch.keep(left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(_region(percent), "a long, b long").distinct())


def _region(percent: int):
    def run(_, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        if len(left) and len(right):
            sets = [np.frombuffer(x, _U) for x in right["own"]]
            sizes, flat = np.array([len(x) for x in sets]), np.concatenate(sets)
            order = np.argsort(flat, kind="stable")
            holder = np.repeat(np.arange(len(sets)), sizes)[order]
            vocabulary, begin = np.unique(flat[order], return_index=True)
            begin = np.append(begin, len(flat))
            comps, ids = right["comp"].to_numpy(), right["sid"].to_numpy()
            for sid, comp, x in zip(left["sid"], left["comp"], left["own"], strict=True):
                x = np.frombuffer(x, _U)
                at = np.searchsorted(vocabulary, x)
                at[at == len(vocabulary)] = 0
                at = at[vocabulary[at] == x]
                runs = begin[at + 1] - begin[at]
                place = np.repeat(begin[at] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum()) if len(at) else np.zeros(0, np.int64)
                common = np.bincount(holder[place], minlength=len(sets))
                linked = np.flatnonzero((comps != comp) & (100 * common >= percent * (len(x) + sizes - common)))
                for k in linked[np.unique(comps[linked], return_index=True)[1]]:  # one link to each component says all
                    links.append((sid, int(ids[k])))
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = words.SHINGLE, pivot_rounds: int = 2, id_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    A-Z are lower-cased, words are runs of other than the six ASCII white spaces; a
    set holds the distinct runs of ``size`` words, of a text with fewer words the one
    whole sequence.  Sets link from a Jaccard of percent/100 on; component_id is the
    smallest doc_id that links reach.

    Null or blank texts: set size 0, linked with nothing.  A null doc_id: its row has
    component_id null and takes part in no link.  Repeated rows and repeated ids: each
    row returned.  Copies, ties and empty tables need nothing special; columns other
    than the two named are ignored.  Shingles are compared as 64-bit hashes: only two
    different ones of one pair of documents with the same hash could change a result.
    Equal sets are known by 64 bits; sets that meet in them but not in 64 others are
    told apart by those.  With fewer ``id_bits`` more do.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with Scratch(spark) as scratch:
        return scratch.result(_components_of(docs, percent, size, pivot_rounds, id_bits, scratch))


def _components_of(docs: DataFrame, percent: int, size: int, pivot_rounds: int, id_bits: int, scratch: Scratch) -> DataFrame:
    """As ``jaccard_components`` of docs(doc_id, text), read from tables of ``scratch``; of blocks only the latest state is kept."""
    spark = docs.sparkSession
    seen = scratch.keep(docs.mapInArrow(_fingerprints(size, id_bits), "doc_id long, n long, sid long, tag long, often long"))
    ids = seen.where("often is null").select("doc_id", "n", "sid", "tag")
    met = ids.where("n > 0").groupBy("sid").agg(F.min("tag").alias("lo"), F.max("tag").alias("hi")).where("lo <> hi")
    clash = np.sort(np.array([r.sid for r in met.select("sid").collect()], np.int64))  # of 10^10 sets some three
    if len(clash):
        known = F.broadcast(spark.createDataFrame([(int(x),) for x in clash], "__sid long"))
        ids = ids.join(known, F.col("sid") == F.col("__sid"), "left").withColumn("sid", F.when(F.col("__sid").isNull(), F.col("sid")).otherwise(F.col("tag")))
    ids = scratch.keep(ids.select("doc_id", "n", "sid"))
    counted = seen.where("often is not null").groupBy("often").agg(F.sum("n").alias("c")).where(F.col("c") >= FREQUENT_FROM)
    most = counted.orderBy(F.desc("c"), "often").limit(FREQUENT_MOST).toArrow()
    frequent, counts = most["often"].to_numpy().view(_U), most["c"].to_numpy()
    order = np.argsort(frequent)
    frequent, marks = frequent[order], _mark(counts[order])
    scratch.drop(seen)

    rows = docs.where("doc_id is not null").select("text").mapInArrow(_prefixes(frequent, marks, percent, size, clash, id_bits), "shingle long, sid long, n int, salt byte")
    rows = rows.repartition(parts(spark), "shingle", "salt").sortWithinPartitions("shingle", "sid")
    live = scratch.keep(rows.mapInArrow(_alive, "shingle long, sid long, n int"))

    measure = _Measure(docs, ids, size, clash, id_bits, scratch)
    links, distances = None, None
    nothing = spark.createDataFrame([], "node long, root long")
    # w: the part of a set's shingles that is in blocks; it is largest amid a group of near copies
    central = live.groupBy("sid").agg((F.count("*") / F.max("n")).alias("w"))
    state = _labelled(live.join(central, "sid"), nothing, scratch)
    scratch.drop(live)
    for k in range(pivot_rounds):
        if state.isEmpty():
            break
        choice = state.join(_blocks(state), "shingle").where("comp <> major") if k else state
        pivots = choice.groupBy("shingle").agg(F.max(F.struct("w", "sid", "comp", "n")).alias("p")).select("shingle", "p.sid", "p.comp", "p.n").toDF("shingle", "b", "comp_b", "nb")
        pairs = state.join(pivots, "shingle").where("comp <> comp_b").groupBy(F.col("sid").alias("a"), "b").agg(F.max("n").cast("long").alias("na"), F.max("nb").cast("long").alias("nb"), F.count("*").alias("c"))
        found = measure(scratch.keep(_plausible(pairs, percent)))
        distances = found if distances is None else distances.unionByName(found)
        new = _linked(found, percent)
        links = new if links is None else links.unionByName(new)
        before, state = state, _labelled(state, _nearest(links, scratch), scratch)
        scratch.drop(before)
    if not state.isEmpty():
        blocks = scratch.keep(_blocks(state))
        hot = _hot_links(state, blocks, measure, distances, percent)
        if hot is not None:
            links = hot if links is None else links.unionByName(hot)
        pairs = scratch.keep(_plausible(_cold_pairs(state, blocks, percent), percent))
        if distances is not None:
            pairs = _windowed(pairs, distances, percent, scratch)
        new = _linked(measure(pairs), percent)
        links = new if links is None else links.unionByName(new)
    roots = nothing if links is None else components(links, scratch=scratch)

    least = measure.of.select("sid", F.col("doc_id").alias("least"))
    classes = least.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "least")
    tops = classes.groupBy("root").agg(F.min("least").alias("top"))
    classes = classes.join(tops, "root").select("sid", "top")
    return ids.join(classes, "sid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("top")).cast("long").alias("component_id"))


def _linked(measured: DataFrame, percent: int) -> DataFrame:
    return measured.where(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")


def _windowed(pairs: DataFrame, distances: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """pairs without those that the triangle inequality excludes, and without those that were measured."""
    d = distances.select("a", "b", (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("d"))
    to = d.select("a", F.col("b").alias("p"), F.col("d"))
    one = pairs.select("a", "b").join(to.withColumnRenamed("d", "da"), "a")
    both = one.join(to.select(F.col("a").alias("b"), "p", F.col("d").alias("db")), ["b", "p"])
    far = both.where(F.abs(F.col("da") - F.col("db")) > 1 - percent / 100 + 1e-9).select("a", "b").distinct()
    known = d.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return scratch.keep(pairs.join(far, ["a", "b"], "left_anti").join(known, ["a", "b"], "left_anti"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, size: int = words.SHINGLE, pivot_rounds: int = 2) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component; rows without words or id stay.

    Of several rows of one id, all of them the first of a component, one stays.
    """
    comps = jaccard_components(docs, id_col, text_col, percent, size, pivot_rounds)
    out = comps.where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    out = F.broadcast(out) if out.count() <= BROADCAST_ROWS else out
    kept = docs.join(out, F.col(id_col) == F.col("__gone"), "left_anti")
    firsts = comps.where("component_id = doc_id and n_shingles > 0")
    if firsts.count() == firsts.select("doc_id").distinct().count():
        return kept
    again = firsts.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("__again"))
    single = kept.join(again, F.col(id_col) == F.col("__again"), "left_anti")
    doubled = kept.join(again, F.col(id_col) == F.col("__again"), "left_semi")
    return single.unionByName(doubled.dropDuplicates([id_col]))
