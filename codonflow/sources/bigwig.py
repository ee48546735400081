"""bigWig files as a Spark data source, read and written.

Reading: the driver walks the chromosome B+ tree and the inner nodes of the R-tree over data
blocks, from the root down until there are as many subtrees as tasks are wanted; chromosome and
position filters leave out subtrees.  A task reads the rest of its subtrees, the blocks
that overlap the asked range, neighbouring blocks in one go, and gives Arrow batches.

Writing: each task writes a file of its own with its own trees, for its range of
places.  Only files that the commit has listed are read back, so what retried tasks leave counts
for nothing.

Bytes are read by ranges through Arrow's file systems: local paths, and those of stores that
Arrow knows.  The layout is the public one (W. J. Kent et al., BigWig and BigBed, 2010).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

NAME = "big_wig"
SCHEMA = "chrom string, start long, end long, value float"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: compressed bytes of a task, and bytes that are read in one go
TASK_BYTES, READ_BYTES = 8 << 20, 4 << 20
#: items of a section and of a tree's node that is written
ITEMS, FAN = 1024, 256
LISTED = "_committed"

# fixed values of the format
MAGIC, CHROM_MAGIC, TREE_MAGIC = 0x888FFC26, 0x78CA8C91, 0x2468ACE0
HEADER, CHROM_HEADER, TREE_HEADER, SECTION = struct.Struct("<IHHQQQHHQQIQ"), struct.Struct("<IIIIQQ"), struct.Struct("<IIQIIIIQII"), struct.Struct("<IIIIIBBH")
SUMMARY, NODE = struct.Struct("<Qdddd"), struct.Struct("<BBH")
BED, VARYING, FIXED = 1, 2, 3
LEAF = np.dtype([("c0", "<u4"), ("b0", "<u4"), ("c1", "<u4"), ("b1", "<u4"), ("at", "<u8"), ("size", "<u8")])
INNER = np.dtype([("c0", "<u4"), ("b0", "<u4"), ("c1", "<u4"), ("b1", "<u4"), ("at", "<u8")])
BED_ITEM = np.dtype([("start", "<u4"), ("end", "<u4"), ("value", "<f4")])
VARYING_ITEM = np.dtype([("start", "<u4"), ("value", "<f4")])


def _file_system(path: str):
    """(Arrow's file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Asked:
    """Chromosomes (None: all) and the places, half-open from 0, that rows have to touch."""

    chroms: set[str] | None = None
    begin: int = 0
    end: int = (1 << 32) - 1

    def only(self, chroms: set[str]) -> None:
        self.chroms = chroms if self.chroms is None else self.chroms & chroms


@dataclass
class Tree:
    """An open file with its header and chromosomes; ``reads`` counts what was read."""

    path: str
    reads: list[tuple[int, int]] = field(default_factory=list)

    def __enter__(self) -> Tree:
        system, at = _file_system(self.path)
        self.file = system.open_input_file(at)
        head = self._read(0, HEADER.size)
        if len(head) < HEADER.size or HEADER.unpack(head)[0] != MAGIC:
            raise ValueError(f"not a little-endian bigWig file: {self.path}")
        (_, self.version, self.zooms, self.chrom_at, self.data_at, self.tree_at, *_), self.packed = HEADER.unpack(head), HEADER.unpack(head)[10] > 0
        magic, _, self.key, _, _, _ = CHROM_HEADER.unpack(self._read(self.chrom_at, CHROM_HEADER.size))
        tree = TREE_HEADER.unpack(self._read(self.tree_at, TREE_HEADER.size))
        if magic != CHROM_MAGIC or tree[0] != TREE_MAGIC:
            raise ValueError(f"a tree is missing: {self.path}")
        self.fan, self.root = tree[1], self.tree_at + TREE_HEADER.size
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def _read(self, at: int, size: int) -> bytes:
        self.reads.append((at, size))
        return self.file.read_at(size, at)

    def chromosomes(self) -> dict[str, tuple[int, int]]:
        """name: (number, length)."""
        out, open_ = {}, [self.chrom_at + CHROM_HEADER.size]
        while open_:
            at = open_.pop()
            leaf, _, n = NODE.unpack(self._read(at, NODE.size))
            body = self._read(at + NODE.size, n * (self.key + 8))
            for k in range(n):
                item = body[k * (self.key + 8) : (k + 1) * (self.key + 8)]
                if leaf:
                    out[item[: self.key].rstrip(b"\0").decode()] = struct.unpack("<II", item[self.key :])
                else:
                    open_.append(struct.unpack("<Q", item[self.key :])[0])
        return out

    def node(self, at: int) -> tuple[bool, np.ndarray]:
        body = self._read(at, NODE.size + self.fan * LEAF.itemsize)
        leaf, _, n = NODE.unpack(body[: NODE.size])
        return bool(leaf), np.frombuffer(body, LEAF if leaf else INNER, n, NODE.size)

    def blocks(self, at: int, wanted: list[tuple[int, int, int]]) -> Iterator[np.ndarray]:
        """Leaf entries below a node that touch one of ``wanted`` (number of a chromosome, begin, end)."""
        leaf, items = self.node(at)
        items = items[touching(items, wanted)]
        if leaf:
            yield items
        else:
            for child in items["at"].tolist():
                yield from self.blocks(child, wanted)

    def data(self, blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the chromosome, starts, ends, values) of each section, read in the order of the file."""
        blocks = np.sort(blocks, order="at")
        k = 0
        while k < len(blocks):
            z = k + 1
            while z < len(blocks) and blocks["at"][z] == blocks["at"][z - 1] + blocks["size"][z - 1] and blocks["at"][z] + blocks["size"][z] - blocks["at"][k] <= READ_BYTES:
                z += 1
            begin = int(blocks["at"][k])
            body = self._read(begin, int(blocks["at"][z - 1] + blocks["size"][z - 1]) - begin)
            for at, size in zip(blocks["at"][k:z].tolist(), blocks["size"][k:z].tolist(), strict=True):
                raw = body[at - begin : at - begin + size]
                yield section(zlib.decompress(raw) if self.packed else raw)
            k = z


def touching(items: np.ndarray, wanted: list[tuple[int, int, int]]) -> np.ndarray:
    """Which nodes or blocks touch one of the ranges; a node's last place is on its last chromosome."""
    hit = np.zeros(len(items), bool)
    for chrom, begin, end in wanted:
        before = (items["c1"] < chrom) | ((items["c1"] == chrom) & (items["b1"] <= begin))
        after = (items["c0"] > chrom) | ((items["c0"] == chrom) & (items["b0"] >= end))
        hit |= ~before & ~after
    return hit


def section(raw: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    chrom, start, _, step, span, kind, _, n = SECTION.unpack(raw[: SECTION.size])
    if kind == BED:
        x = np.frombuffer(raw, BED_ITEM, n, SECTION.size)
        return chrom, x["start"].astype(np.int64), x["end"].astype(np.int64), x["value"]
    if kind == VARYING:
        x = np.frombuffer(raw, VARYING_ITEM, n, SECTION.size)
        starts, values = x["start"].astype(np.int64), x["value"]
    elif kind == FIXED:
        starts, values = start + step * np.arange(n, dtype=np.int64), np.frombuffer(raw, "<f4", n, SECTION.size)
    else:
        raise ValueError(f"no kind of section: {kind}")
    return chrom, starts, starts + span, values


# --- reading
@dataclass
class Subtrees(InputPartition):
    path: str
    nodes: list[int]
    names: dict[int, str]
    wanted: list[tuple[int, int, int]]

    def __init__(self, path, nodes, names, wanted):
        self.path, self.nodes, self.names, self.wanted = path, nodes, names, wanted


def listed(path: str) -> list[str]:
    """The file of a path, or those of a folder: what commits have listed, or else all that end in .bw or .bigWig."""
    from pyarrow import fs

    system, at = _file_system(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    if system.get_file_info(at).type == fs.FileType.File:
        return [path]
    found = [f.path for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    commits = [f for f in found if f.rpartition("/")[2].startswith(LISTED)]
    if commits:
        found = []
        for c in commits:
            with system.open_input_stream(c) as s:
                found += [f"{at.rstrip('/')}/{name}" for name in json.loads(s.read())]
    else:
        found = [f for f in found if f.lower().endswith((".bw", ".bigwig"))]
    return [head + f for f in sorted(found)]


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.asked = Asked(begin=int(options.get("begin", 0)), end=int(options.get("end", Asked.end)))
        if "chrom" in options:
            self.asked.only(set(options["chrom"].split(",")))

    def partitions(self) -> list[Subtrees]:
        return [p for path in listed(self.path) for p in self._of(path)] or [Subtrees("", [], {}, [])]

    def _of(self, path: str) -> Iterator[Subtrees]:
        with Tree(path) as tree:
            known = tree.chromosomes()
            wanted = [(n, self.asked.begin, min(self.asked.end, size)) for name, (n, size) in known.items() if self.asked.chroms is None or name in self.asked.chroms]
            names = {n: name for name, (n, _) in known.items() if self.asked.chroms is None or name in self.asked.chroms}
            least = -(-max(1, tree.tree_at - tree.data_at) // self.task_bytes)
            nodes, leaves = [tree.root], []
            while nodes and len(nodes) + len(leaves) < least:
                below = []
                for at in nodes:
                    leaf, items = tree.node(at)
                    if leaf:
                        leaves.append(at)
                    else:
                        below += items["at"][touching(items, wanted)].tolist()
                nodes = below
        every = sorted(nodes + leaves)
        size = -(-len(every) // least) or 1
        for k in range(0, len(every), size):
            yield Subtrees(path, every[k : k + size], names, wanted)

    def read(self, partition: Subtrees) -> Iterator[pa.RecordBatch]:
        if not partition.nodes:
            return
        ranges = {c: (a, z) for c, a, z in partition.wanted}
        with Tree(partition.path) as tree:
            for node in partition.nodes:
                for blocks in tree.blocks(node, partition.wanted):
                    for chrom, starts, ends, values in tree.data(blocks):
                        if chrom not in ranges:
                            continue
                        a, z = ranges[chrom]
                        own = (ends > a) & (starts < z)
                        if own.any():
                            name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(int(own.sum()), np.int32)), pa.array([partition.names[chrom]])).cast(pa.string())
                            yield pa.RecordBatch.from_arrays([name, pa.array(starts[own]), pa.array(ends[own]), pa.array(values[own])], names=["chrom", "start", "end", "value"])


class PushingReader(Reader):
    """Takes what filters on chrom, start and end say into the tree; Spark still applies them to the rows."""

    def pushFilters(self, filters):
        asked = self.asked
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("chrom",):
                asked.only({f.value} if isinstance(f, EqualTo) else set(f.value))
            elif isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)) and f.attribute == ("start",):
                asked.begin = max(asked.begin, int(f.value))
                if isinstance(f, EqualTo):
                    asked.end = min(asked.end, int(f.value) + 1)
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("start",):
                asked.end = min(asked.end, int(f.value) + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("end",):
                asked.begin = max(asked.begin, int(f.value) - isinstance(f, GreaterThanOrEqual))
            yield f


# --- writing
@dataclass
class Part(WriterCommitMessage):
    name: str | None

    def __init__(self, name):
        self.name = name


def sections(chrom: int, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(first, last place, bytes) of sections of sorted items of a chromosome: of a fixed step where runs are long, else of one span or as they are."""
    span = ends - starts
    step = np.diff(starts)
    new = np.concatenate(([True], (span[1:] != span[:-1]) | (step != span[:-1]), [True]))
    edges = np.flatnonzero(new)
    k = 0
    while k < len(starts):
        run = int(edges[np.searchsorted(edges, k, "right")]) - k
        if run >= ITEMS // 4 or run == len(starts) - k:
            z = k + min(run, ITEMS)
            head = SECTION.pack(chrom, int(starts[k]), int(ends[z - 1]), int(span[k]), int(span[k]), FIXED, 0, z - k)
            body = values[k:z].astype("<f4").tobytes()
        else:
            z = min(k + ITEMS, len(starts))
            same = (span[k:z] == span[k]).all()
            x = np.zeros(z - k, VARYING_ITEM if same else BED_ITEM)
            x["start"], x["value"] = starts[k:z], values[k:z]
            if not same:
                x["end"] = ends[k:z]
            head = SECTION.pack(chrom, int(starts[k]), int(ends[z - 1]), 0, int(span[k]) if same else 0, VARYING if same else BED, 0, z - k)
            body = x.tobytes()
        yield int(starts[k]), int(ends[z - 1]), head + body
        k = z


def _levels(items: np.ndarray, above) -> list[list[np.ndarray]]:
    """Nodes of FAN items by level, the root first; ``above`` makes the item of a node for the level over it."""
    levels = [[items[k : k + FAN] for k in range(0, len(items), FAN)] or [items]]
    while len(levels[0]) > 1:
        over = np.array([above(node) for node in levels[0]])
        levels.insert(0, [over[k : k + FAN] for k in range(0, len(over), FAN)])
    return levels


def _packed(levels: list[list[np.ndarray]], at: int) -> bytes:
    """Nodes as bytes, level by level from ``at`` on, each with room for FAN items, inner ones pointing to their children."""
    room = [NODE.size + FAN * nodes[0].dtype.itemsize for nodes in levels]
    begin = np.cumsum([at, *(len(nodes) * r for nodes, r in zip(levels, room, strict=True))]).tolist()
    out = []
    for level, nodes in enumerate(levels):
        leaf, child = level == len(levels) - 1, 0
        for node in nodes:
            node = node.copy()
            if not leaf:
                node["at"] = begin[level + 1] + room[level + 1] * np.arange(child, child + len(node))
                child += len(node)
            out.append((NODE.pack(leaf, 0, len(node)) + node.tobytes()).ljust(room[level], b"\0"))
    return b"".join(out)


def _chrom_tree(sizes: dict[str, int], at: int) -> tuple[bytes, dict[str, int]]:
    """The B+ tree of chromosomes for a file in which it begins at ``at``, and their numbers by name."""
    names = sorted(sizes, key=lambda n: n.encode())
    key = max((len(n.encode()) for n in names), default=1)
    leaf, inner = np.dtype([("key", f"S{key}"), ("number", "<u4"), ("size", "<u4")]), np.dtype([("key", f"S{key}"), ("at", "<u8")])
    items = np.array([(n.encode(), k, sizes[n]) for k, n in enumerate(names)], leaf)
    levels = _levels(items, lambda node: np.array((node["key"][0], 0), inner))
    return CHROM_HEADER.pack(CHROM_MAGIC, FAN, key, 8, len(names), 0) + _packed(levels, at + CHROM_HEADER.size), {n: k for k, n in enumerate(names)}


def _range_tree(blocks: np.ndarray, at: int, data_end: int) -> bytes:
    """The R-tree over blocks in the order of places, for a file in which it begins at ``at``."""
    levels = _levels(blocks, lambda node: np.array((node["c0"][0], node["b0"][0], node["c1"][-1], node["b1"][node["c1"] == node["c1"][-1]].max(), 0), INNER))
    first, last = (blocks[0], blocks[-1]) if len(blocks) else (np.zeros((), LEAF), np.zeros((), LEAF))
    head = TREE_HEADER.pack(TREE_MAGIC, FAN, len(blocks), int(first["c0"]), int(first["b0"]), int(last["c1"]), int(last["b1"]), data_end, ITEMS, 0)
    return head + _packed(levels, at + TREE_HEADER.size)


def encode(chroms: Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]], sizes: dict[str, int]) -> bytes:
    """A whole file of (name, starts, ends, values), sorted by name and place."""
    chrom_at = HEADER.size + SUMMARY.size
    tree, numbers = _chrom_tree(sizes, chrom_at)
    data_at = chrom_at + len(tree)
    at, data, entries, most = data_at + 8, [], [], 0
    covered, low, high, total, squares = 0, np.inf, -np.inf, 0.0, 0.0
    for name, starts, ends, values in chroms:
        if name not in numbers:
            raise ValueError(f"no size for {name}")
        x, n = values.astype(float), ends - starts
        covered, total, squares = covered + int(n.sum()), total + float((x * n).sum()), squares + float((x * x * n).sum())
        low, high = min(low, float(x.min())), max(high, float(x.max()))
        for a, z, raw in sections(numbers[name], starts, ends, values):
            most = max(most, len(raw))
            packed = zlib.compress(raw)
            entries.append((numbers[name], a, numbers[name], z, at, len(packed)))
            data.append(packed)
            at += len(packed)
    blocks = np.array(entries, LEAF) if entries else np.zeros(0, LEAF)
    summary = SUMMARY.pack(covered, *((low, high) if covered else (0.0, 0.0)), total, squares)
    head = HEADER.pack(MAGIC, 4, 0, chrom_at, data_at, at, 0, 0, 0, HEADER.size, max(1, most), 0)
    return b"".join((head, summary, tree, struct.pack("<Q", len(entries)), *data, _range_tree(blocks, at, at)))


class Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        if overwrite:
            raise ValueError("big_wig adds files to a folder, it replaces none: use mode append")
        self.path, self.sizes = options["path"], json.loads(options["sizes"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        rows = [b for b in iterator if len(b)]
        if not rows:
            return Part(None)
        t = pa.Table.from_batches(rows).combine_chunks()
        column = lambda c: t.column(c).to_numpy()
        names = t.column("chrom").to_pylist()
        edges = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        starts, ends, values = column("start"), column("end"), column("value")
        body = encode(((names[a], starts[a:z], ends[a:z], values[a:z]) for a, z in zip(edges[:-1], edges[1:], strict=True)), self.sizes)
        name = f"part-{uuid.uuid4().hex}.bw"
        system, at = _file_system(self.path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at.rstrip('/')}/{name}") as s:
            s.write(body)
        return Part(name)

    def commit(self, messages: list[Part | None]) -> None:
        names = [m.name for m in messages if m is not None and m.name]
        system, at = _file_system(self.path)
        system.create_dir(at, recursive=True)
        with system.open_output_stream(f"{at.rstrip('/')}/{LISTED}-{uuid.uuid4().hex}.json") as s:
            s.write(json.dumps(names).encode())

    def abort(self, messages) -> None:
        """Files that no commit lists are not read."""


class BigWig(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return (PushingReader if self.options.get("pushdown") == "true" else Reader)(self.options)

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def read_big_wig(spark: SparkSession, path: str, chroms: list[str] | None = None, begin: int | None = None, end: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(chrom, start, end, value) of a bigWig file, or of a folder of them: intervals, half-open from 0, in no order.

    chroms, begin and end ask for what touches a range only; so do filters on chrom,
    start and end, where the session lets Python sources take them
    (spark.sql.python.filterPushdown.enabled).  Intervals that reach beyond the range are
    given whole.  An empty file or folder gives no rows.
    """
    spark.dataSource.register(BigWig)
    rows = spark.read.format(NAME).option("path", path).option("taskbytes", task_bytes).option("pushdown", spark.conf.get(PUSHDOWN, "false"))
    for name, value in (("chrom", None if chroms is None else ",".join(chroms)), ("begin", begin), ("end", end)):
        if value is not None:
            rows = rows.option(name, value)
    return rows.load()


def big_wig_sizes(path: str) -> dict[str, int]:
    """Lengths of the chromosomes of a file or of all files of a folder, from their B+ trees."""
    out: dict[str, int] = {}
    for one in listed(path):
        with Tree(one) as tree:
            out |= {name: size for name, (_, size) in tree.chromosomes().items()}
    return out


def write_big_wig(intervals: DataFrame, sizes: dict[str, int], path: str) -> None:
    """intervals(chrom, start, end, value), that do not overlap, as a folder of bigWig files, one a range of places.

    Rows with a null are left out, as the format has none; a chromosome without a size is an error.
    """
    spark = intervals.sparkSession
    spark.dataSource.register(BigWig)
    rows = intervals.select("chrom", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("value").cast("float").alias("value")).dropna()
    rows = rows.repartitionByRange("chrom", "start").sortWithinPartitions("chrom", "start")
    rows.write.format(NAME).option("path", path).option("sizes", json.dumps(sizes)).mode("append").save()
