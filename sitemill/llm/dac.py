"""Token ids in directly addressable codes, written in files and read again.

An id is cut into chunks of ``CHUNK`` bits, lowest first; level j holds the
j-th chunk of every id that has one, and a bitmap of each level tells which of
its entries go on to the next. Entry i of level j goes on at entry
rank_j(i) of level j + 1, and a rank directory holds the ones before every
block of 512 bits, so any one id is found by a read of one byte and one rank a
level, without decoding what lies before it.

A file is a segment: a header, document boundaries, then the levels. Integers
are little-endian::

    b"DAC1" | u32 chunk bits | u32 levels | u64 ids | u64 documents
    u64 x (documents + 1)   first id of each document, then the total
    per level: u64 entries | u8 x entries (padded to 8) |
               bitmap u64 words | u64 ones before each block of 8 words
    u32 CRC-32 of all that
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions, text_chunks
from .wordtokens import SPLIT_BYTES, word_tokenizer

CHUNK, BLOCK_WORDS = 8, 8
#: Ids of a segment at which it is closed.
SEGMENT_IDS = 1 << 20
MAGIC = b"DAC1"


def _padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def pack(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A segment of the documents whose ids lie one after the other."""
    ids = np.asarray(ids, np.uint32)
    ends = np.concatenate(([0], np.cumsum(np.asarray(lengths, np.int64)))).astype("<u8")
    levels, rest = [], ids
    while True:
        low, rest = (rest & ((1 << CHUNK) - 1)).astype(np.uint8), rest >> CHUNK
        goes = rest > 0
        bits = np.packbits(goes, bitorder="little").tobytes()
        words = np.frombuffer(bits + bytes(-len(bits) % (8 * BLOCK_WORDS)), "<u8")
        ones = np.bitwise_count(words).reshape(-1, BLOCK_WORDS).sum(1, dtype=np.uint64)
        before = np.concatenate(([0], np.cumsum(ones)[:-1])).astype("<u8") if len(ones) else np.zeros(0, "<u8")
        levels.append(struct.pack("<Q", len(low)) + _padded(low.tobytes()) + words.tobytes() + before.tobytes())
        if not goes.any():
            break
        rest = rest[goes]
    body = MAGIC + struct.pack("<IIQQ", CHUNK, len(levels), len(ids), len(ends) - 1) + ends.tobytes() + b"".join(levels)
    return body + struct.pack("<I", zlib.crc32(body))


class Segment:
    """Reads a segment's bytes; the arrays are views, nothing is copied, so
    opening one costs nothing for its size. ``verify`` goes over all bytes."""

    def __init__(self, raw: bytes):
        if len(raw) < 32 or raw[:4] != MAGIC:
            raise ValueError("not a segment of this format")
        self.raw = raw
        self.chunk, n_levels, self.n_ids, self.n_docs = struct.unpack_from("<IIQQ", raw, 4)
        at = 28
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            low = np.frombuffer(raw, np.uint8, n, at + 8)
            at += 8 + n + (-n % 8)
            n_blocks = -(-n // (64 * BLOCK_WORDS))
            words = np.frombuffer(raw, "<u8", n_blocks * BLOCK_WORDS, at)
            at += 8 * len(words)
            before = np.frombuffer(raw, "<u8", n_blocks, at)
            at += 8 * n_blocks
            self.levels.append((low, words, before))

    def verify(self) -> Segment:
        """Refuses a damaged segment."""
        if zlib.crc32(memoryview(self.raw)[:-4]) != struct.unpack("<I", self.raw[-4:])[0]:
            raise ValueError("not a whole segment of this format")
        return self

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, words, before = self.levels[level]
        block, word = i // (64 * BLOCK_WORDS), i // 64
        total = int(before[block]) + int(np.bitwise_count(words[block * BLOCK_WORDS : word]).sum())
        return total + (int(words[word]) & ((1 << (i % 64)) - 1)).bit_count()

    def get(self, i: int) -> int:
        """Id i alone."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out = 0
        for level, (low, words, _) in enumerate(self.levels):
            out |= int(low[i]) << (self.chunk * level)
            if not int(words[i // 64]) >> (i % 64) & 1:
                break
            i = self._rank(level, i)
        return out

    def ids(self) -> np.ndarray:
        """All ids, level by level from the top."""
        above = np.zeros(0, np.uint32)
        for low, words, _ in reversed(self.levels):
            out = low.astype(np.uint32)
            goes = np.unpackbits(words.view(np.uint8), bitorder="little")[: len(low)].astype(bool)
            out[goes] |= above << np.uint32(self.chunk)
            above = out
        return above

    def documents(self) -> Iterator[np.ndarray]:
        ids = self.ids()
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            yield ids[a:b]


SEGMENT_SCHEMA = "part int, segment int, n_ids long, doc_ids array<long>, content binary"


def write_segments(docs: DataFrame, tokenizer_path: str, end_id: int = 2, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts, each with ``end_id`` behind it, and writes them in
    ascending order of ``id_col`` as files of segments in the shared folder.

    Texts are dealt by ranges of id, so part p holds no greater ids than part
    p + 1 and needs no global sort; the only shuffle is that of the texts. A
    segment goes into one row of an uncompressed Parquet file, whose committer
    keeps a lost task's half-written output out on any file system; ``content``
    alone is a whole file of this format. A task holds one segment at a time.
    Null texts are empty (just the end id) and null ids come first. Rows that
    share an id, or have none, are ordered and dealt by a hash of their texts.
    A very long text is encoded whole and makes a segment longer than the
    others. An empty table gives no segment. Only the id and the text are read,
    so no name can clash.
    """
    parts = shuffle_partitions(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, part = word_tokenizer(tokenizer_path), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        held, names, size, segment = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            lengths = np.fromiter((len(x) // 4 for x in held), np.int64, len(held))
            content = pack(np.frombuffer(b"".join(held), "<u4"), lengths)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([int(lengths.sum())], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([content], pa.binary())],
                ["part", "segment", "n_ids", "doc_ids", "content"],
            )

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for chunk in text_chunks(batch.column(1), SPLIT_BYTES):
                for name, ids in zip(ids_of[chunk.lo : chunk.hi], tokenizer.encode(list(chunk.rows())), strict=True):
                    held.append(ids + end)
                    names.append(name)
                    size += len(ids) // 4 + 1
                    if size >= segment_ids:
                        yield flush()
                        held, names, size, segment = [], [], 0, segment + 1
        if held:
            yield flush()

    return materialize(ordered.mapInArrow(run, SEGMENT_SCHEMA), "dac", "uncompressed")


def _bases(segments: DataFrame) -> DataFrame:
    """``q, s, base, n``: the ids before each segment, and its own. A running
    sum in each part over segments, plus one over parts; the table of parts has
    a row for each shuffle partition at most, so it is broadcast."""
    from pyspark.sql import Window as W

    sizes = segments.select("part", "segment", "n_ids")
    totals = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("part_base"))
    inside = sizes.select(F.col("part").alias("q"), F.col("segment").alias("s"), "n_ids", (F.sum("n_ids").over(W.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("segment_base"))
    return inside.join(F.broadcast(before), F.col("q") == F.col("p")).select("q", "s", (F.col("part_base") + F.col("segment_base")).alias("base"), F.col("n_ids").alias("n"))


def tokens_at(segments: DataFrame, positions: DataFrame, grid: int = SEGMENT_IDS) -> DataFrame:
    """``position, token`` of the ids at ``position`` (counted over all
    documents), each read alone from its segment. Positions outside are left
    out; one asked for twice comes once. Positions find their segments by the
    cells of a grid that both lie in; a segment lies in a few."""
    bases = _bases(segments).where("n > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("base") / grid), F.floor((F.col("base") + F.col("n") - 1) / grid))))
    asked = positions.select(F.col("position").cast("long").alias("position")).distinct().withColumn("own", F.floor(F.col("position") / grid))
    inside = (F.col("own") == F.col("cell")) & (F.col("position") >= F.col("base")) & (F.col("position") < F.col("base") + F.col("n"))
    wanted = asked.join(bases, inside).groupBy("q", "s").agg(F.min("base").alias("base"), F.collect_list("position").alias("places"))
    joined = segments.join(wanted, (F.col("part") == F.col("q")) & (F.col("segment") == F.col("s"))).select("base", "places", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, places, content in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                segment, at = Segment(content.as_py()), places.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([segment.get(p - base.as_py()) for p in at], pa.int64())], ["position", "token"])

    return joined.mapInArrow(run, "position long, token long")


def read_segments(segments: DataFrame) -> DataFrame:
    """Reads written segments back: per document ``doc_id, start`` (ids of all
    documents before it), ``n_tokens`` and ``ids_crc32``. Every segment is
    verified; no segment gives no row."""
    based = _bases(segments).drop("n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, names, content in zip(batch.column(0), batch.column(1), batch.column(2), batch.column(3), strict=True):
                segment = Segment(content.as_py()).verify()
                n = segment.n_docs
                crcs = [zlib.crc32(np.ascontiguousarray(d, "<u4")) for d in segment.documents()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([number.as_py()] * n, pa.int32()), names.values, pa.array(segment.starts[:-1]), pa.array(np.diff(segment.starts)), pa.array(crcs, pa.int64())],
                    ["part", "segment", "doc_id", "inner", "n_tokens", "ids_crc32"],
                )

    rows = segments.select("part", "segment", "doc_ids", "content").mapInArrow(run, "part int, segment int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    joined = rows.join(based, (F.col("part") == F.col("q")) & (F.col("segment") == F.col("s")))
    return joined.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
