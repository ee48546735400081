"""Token-ID output in directly addressable codes.

A segment holds the ids of consecutive documents.  An id is split into chunks of
eight bits, low ones first: level 0 has the first chunk of every id, a bitmap says
which ids go on, level 1 has the next chunk of those, and so on.  A rank
directory (ones before every 512th bit) leads from an id's place in one level to its
place in the next, so any id is read without decoding its neighbours.

Layout of a segment, little-endian: ``DAC1``, number of levels (u32), for every level
its number of entries (u64); then for every level its chunks, its bitmap (8 bits a
byte, low bit first) and its rank directory (u32 for every 512 bits).
"""

from __future__ import annotations

import itertools
import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, parts, small_batches
from .words import eights, hashes, slices

MAGIC = b"DAC1"
RANK_BITS = 512
END_ID = 0
#: ids after which a segment is closed
SEGMENT_IDS = 1 << 19
#: pieces of texts whose ids a worker remembers, about 30 bytes each
CACHE_PIECES = 1_500_000
#: pieces that a worker takes on to its next task
SETTLED = 200_000
#: text that is encoded at once
TEXT_BYTES = 1 << 20


def encode_segment(ids: np.ndarray) -> bytes:
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little").tobytes()
        ones = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u4") if len(ones) else np.zeros(0, "<u4")
        levels.append((len(rest), (rest & 0xFF).astype(np.uint8).tobytes(), bits, ranks.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> 8
    head = MAGIC + struct.pack("<I", len(levels)) + b"".join(struct.pack("<Q", n) for n, *_ in levels)
    return head + b"".join(x for _, *three in levels for x in three)


class Segment:
    """Reads a segment: ``at(i)`` one id by ranks, ``all()`` every id."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (n,) = struct.unpack_from("<I", data, 4)
        sizes = struct.unpack_from(f"<{n}Q", data, 8)
        at, self.levels = 8 + 8 * n, []
        for size in sizes:
            chunks = np.frombuffer(data, np.uint8, size, at)
            at += size
            bits = np.frombuffer(data, np.uint8, -(-size // 8), at)
            at += len(bits)
            ranks = np.frombuffer(data, "<u4", -(-size // RANK_BITS), at)
            at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not (bits[i >> 3] >> (i & 7)) & 1:
                break
            block = i // RANK_BITS
            between = np.unpackbits(bits[block * RANK_BITS // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_BITS]
            i = int(ranks[block]) + int(between.sum())
        return value

    def all(self) -> np.ndarray:
        value = None
        for chunks, bits, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            if value is not None:
                own[np.unpackbits(bits, count=len(own), bitorder="little").astype(bool)] += value << 8
            value = own
        return value


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each ASCII byte and of each two-byte character of U+00A1 to U+024F, by its bytes.

    1 letter, 2 number, 3 other, 4 white space; 0: not told here.  In this range the
    classes are the same in all versions of Unicode.
    """
    of = lambda c: {"L": 1, "N": 2}.get(unicodedata.category(c)[0], 3)
    one, two = np.zeros(256, np.uint8), np.zeros(1 << 16, np.uint8)
    one[9:14] = one[32] = 4
    for c in range(33, 127):
        one[c] = of(chr(c))
    one[ord("'")] = 0  # may begin a contraction
    for c in range(0xA1, 0x250):
        a, b = chr(c).encode()
        two[a << 8 | b] = of(chr(c))
    return one, two


_ONE, _TWO = _classes()
_LEAD = np.zeros(256, bool)
_LEAD[0xC2:0xCA] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begins of the matches of the byte-level word pattern, for each text the number before it, and whether it was told.

    The pattern takes a run of letters, of numbers or of others with one space before
    it, and of white space all but what the next match takes, or the last one.  A text
    with an apostrophe, a control character or characters outside ``_classes`` is
    not told.
    """
    n = len(data)
    kind = _ONE[data]
    lead = np.flatnonzero(_LEAD[data[:-1]]) if n > 1 else np.zeros(0, np.int64)
    both = _TWO[data[lead].astype(np.int64) << 8 | data[lead + 1]]
    kind[lead] = kind[lead + 1] = both
    bad = np.concatenate(([0], np.cumsum(kind == 0)))
    told = bad[offsets[1:]] == bad[offsets[:-1]]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    white = kind == 4
    begin = change.copy()
    # a run of others begins one earlier, at a space before it
    after_space = np.zeros(n, bool)
    after_space[1:] = (data[:-1] == 32) & ~edge[1:-1]
    begin &= white | ~after_space
    # the last white space before another run, in one text
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~edge[1:-1]
    begin |= last
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, offsets), told


#: texts or pieces that go to the library at once
LIBRARY_TEXTS = 2048


class Encoder:
    """Ids of texts by the tokenizers library, each piece encoded once while it is remembered.

    A byte-level tokenizer encodes the matches of its word pattern one by one, so the
    ids of a text are those of its pieces in turn.  Pieces are found by a 64-bit hash
    and compared byte by byte.  Texts that ``pieces`` does not tell, those with a special
    token, and those with a piece whose hash another piece has, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.count = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.heads = np.zeros((0, 3), np.uint64)
        self.seen = np.zeros(0, np.uint32)  # how often each was met
        self.long: dict[int, bytes] = {}  # pieces of more than 16 bytes by their hash
        self.ids = np.zeros(0, np.uint32)

    def settle(self) -> None:
        """Keeps what was met twice at least, at most SETTLED pieces: a worker goes on to other tasks, and most pieces are met once."""
        often = np.flatnonzero(self.seen > 1)
        if len(often) > SETTLED:
            often = np.sort(often[np.argsort(-self.seen[often].astype(np.int64), kind="stable")[:SETTLED]])
        count = self.count[often].astype(np.int64)
        done = np.cumsum(count)
        ids = self.ids[np.repeat(self.begin[often].astype(np.int64) - (done - count), count) + np.arange(done[-1] if len(done) else 0)]
        self.known, self.count, self.heads, self.seen = (x[often] for x in (self.known, self.count, self.heads, self.seen))
        self.begin, self.ids = (done - count).astype(np.uint32), ids
        self.long = {int(h): self.long[int(h)] for h in self.known[self.heads[:, 2] > 16]}

    def _library(self, texts: list[str]) -> list[list[int]]:
        """Some at a time: what the library returns of a text is many times its ids."""
        return [e.ids for k in range(0, len(texts), LIBRARY_TEXTS) for e in self.tokenizer.encode_batch_fast(texts[k : k + LIBRARY_TEXTS], add_special_tokens=False)]

    def _learn(self, h: np.ndarray, heads: np.ndarray, texts: list[str]) -> None:
        own = self._library(texts)
        count = np.fromiter(map(len, own), np.int64, len(own))
        flat = np.fromiter(itertools.chain.from_iterable(own), np.uint32, int(count.sum()))
        begin = (np.cumsum(count) - count + len(self.ids)).astype(np.uint32)
        order = np.argsort(np.concatenate((self.known, h)), kind="stable")
        self.known = np.concatenate((self.known, h))[order]
        self.begin = np.concatenate((self.begin, begin))[order]
        self.count = np.concatenate((self.count, count.astype(np.uint32)))[order]
        self.heads = np.concatenate((self.heads, heads))[order]
        self.seen = np.concatenate((self.seen, np.zeros(len(h), np.uint32)))[order]
        for k in np.flatnonzero(heads[:, 2] > 16).tolist():
            self.long[int(h[k])] = texts[k].encode()
        self.ids = np.concatenate((self.ids, flat))

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, h)
        at[at == len(self.known)] = 0
        return at, self.known[at] == h if len(self.known) else np.zeros(len(h), bool)

    def _clashes(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Pieces that are not the remembered one, or else the first one here, of their hash."""
        _, where, back = np.unique(h, return_index=True, return_inverse=True)
        at, there = self._find(h[where])
        model = heads[where]
        model[there] = self.heads[at[there]]
        out = (heads != model[back]).any(1)
        for k in np.flatnonzero((heads[:, 2] > 16) & ~out).tolist():
            first = where[back[k]]
            own = self.long.get(int(h[k])) if there[back[k]] else raw[starts[first] : ends[first]]
            out[k] = raw[starts[k] : ends[k]] != own
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each has."""
        starts, first, told = pieces(data, offsets)
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            told &= ~np.array([any(s in raw[a:z] for s in self.special) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], bool)
        ends = np.append(starts[1:], len(data))
        keep = np.repeat(told, np.diff(first))
        starts, ends = starts[keep], ends[keep]
        text = np.repeat(np.arange(len(told)), np.diff(first))[keep]
        if len(self.known) > CACHE_PIECES:
            self._forget()
        h = hashes(data, starts, ends)
        # the first 16 bytes and the length
        heads = np.stack((eights(data, starts, ends, 0), eights(data, starts, ends, 1), (ends - starts).astype(np.uint64)), 1)
        clash = self._clashes(raw, starts, ends, h, heads)
        if clash.any():
            told[text[clash]] = False
            keep = told[text]
            starts, ends, text, h, heads = starts[keep], ends[keep], text[keep], h[keep], heads[keep]
        distinct, where, back = np.unique(h, return_index=True, return_inverse=True)
        at, there = self._find(distinct)
        if not there.all():
            new = where[~there]
            self._learn(distinct[~there], heads[new], [raw[a:z].decode() for a, z in zip(starts[new].tolist(), ends[new].tolist(), strict=True)])
            at, _ = self._find(distinct)
        self.seen[at] += np.bincount(back, minlength=len(distinct)).astype(np.uint32)
        begin, count = self.begin[at][back].astype(np.int64), self.count[at][back].astype(np.int64)
        done = np.cumsum(count)
        ids = self.ids[np.repeat(begin - (done - count), count) + np.arange(done[-1] if len(done) else 0)]
        sizes = np.bincount(text, weights=count, minlength=len(told)).astype(np.int64)
        whole = np.flatnonzero(~told)
        if len(whole):
            parts_ = np.split(ids, np.cumsum(sizes)[:-1])
            for k, own in zip(whole.tolist(), self._library([raw[offsets[k] : offsets[k + 1]].decode() for k in whole.tolist()]), strict=True):
                parts_[k] = np.array(own, np.uint32)
                sizes[k] = len(own)
            ids = np.concatenate(parts_)
        return ids, sizes


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


SEGMENTS = "part int, seg int, n_ids long, doc_ids array<long>, sizes array<long>, codes binary"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seg = _encoder(path), TaskContext.get().partitionId(), 0
        docs, sizes, ids, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            cols = [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([held], pa.int64()), pa.array([docs], pa.list_(pa.int64()))]
            cols += [pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([encode_segment(np.concatenate(ids))], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "seg", "n_ids", "doc_ids", "sizes", "codes"])

        for b in batches:
            for at, to, data, offsets in slices(b.column(1), TEXT_BYTES):
                own, n = encoder(data, offsets)
                own = np.insert(own, np.cumsum(n), END_ID)
                docs += b.column(0)[at:to].to_pylist()
                sizes.append(n + 1)
                ids.append(own)
                held += len(own)
                if held >= SEGMENT_IDS:
                    yield closed()
                    docs, sizes, ids, held, seg = [], [], [], 0, seg + 1
        if docs:
            yield closed()
        encoder.settle()

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(len(b)):
            part, seg, docs, sizes = (b.column(c)[k].as_py() for c in range(4))
            raw = memoryview(Segment(b.column(4)[k].as_buffer().to_pybytes()).all().astype("<u4").tobytes())
            starts = np.concatenate(([0], np.cumsum(sizes)))
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int32()), pa.array([seg] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array(starts[:-1].astype(np.int64)), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                ["part", "seg", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every row of docs, in ascending order of id (null first), to segment files at path.

    A row's ids are those of its whole text (null: of the empty text) and END_ID.
    Rows of equal id follow each other by a hash of their text, so that many of them, or
    of null ids, or equal rows, are dealt to several tasks.  An empty table writes no
    segment.  Codes are stored as they are, so an id is read without unpacking others.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = ["doc_id", "h", "k"]  # k divides equal rows, whose order says nothing
    rows = rows.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("k"))
    rows = rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    rows.select("doc_id", "text").mapInArrow(_encode(tokenizer), SEGMENTS).write.option("compression", "none").parquet(path)


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, seg, first, n_ids): ids before each segment, by prefix sums inside each part and over the parts."""
    segs = spark.read.schema(SEGMENTS).parquet(path).select("part", "seg", "n_ids")
    of_part = segs.groupBy("part").agg(F.sum("n_ids").alias("all"))
    before = of_part.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    inside = segs.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seg")) - F.col("n_ids"))
    return inside.join(before, "part").select("part", "seg", (F.col("inside") + F.col("before")).alias("first"), "n_ids")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files, all ids decoded from them."""
    segs = spark.read.schema(SEGMENTS).parquet(path).select("part", "seg", "doc_ids", "sizes", "codes")
    rows = segs.mapInArrow(_decode, "part int, seg int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(segment_starts(spark, path), ["part", "seg"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_at(spark: SparkSession, path: str, position: int) -> int:
    """The id at a position of the whole output: its segment by the counts alone, then that row, then one path of ranks."""
    starts = segment_starts(spark, path).where((F.col("first") <= position) & (F.col("first") + F.col("n_ids") > position))
    at = starts.first()
    if at is None:
        raise IndexError(position)
    row = spark.read.schema(SEGMENTS).parquet(path).where((F.col("part") == at.part) & (F.col("seg") == at.seg)).select("codes").first()
    return Segment(bytes(row.codes)).at(position - at["first"])


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs to files of their own in the shared folder, reads them back and removes them.

    (doc_id, start, n_tokens, ids_crc32) of every row; nulls, equal ids, repeated rows and
    empty tables as in ``write_token_ids``; other columns are ignored.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        path = f"{scratch.path}/token_ids"
        write_token_ids(docs, path, tokenizer)
        return scratch.result(read_token_ids(spark, path))
