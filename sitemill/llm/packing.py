"""Packing of documents into token windows by multiway differencing.

Each document is cut into whole windows and a rest. The rests are balanced, a
bounded group at a time, by the Karmarkar-Karp method for many parts: every
rest begins as a partition of one filled window among k, the two partitions
with the widest spread between their windows are merged, the fullest window of
one with the emptiest of the other, until one partition of k near-equal
windows is left. k begins at the least that can hold the group and rises
whenever a window goes over its capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_chunks
from .wordtokens import SPLIT_BYTES, word_tokenizer

#: Pieces of a group that are balanced together.
GROUP_PIECES = 1024
#: A rest is cut so that no piece passes this; small pieces balance well.
PIECE = 512
#: Low bits of a sequence id that number a group's windows; the rest is the group.
WINDOW_BITS = 24


def differencing(sizes: list[int], k: int) -> list[int]:
    """The window of 0..k-1 of each size, by largest differencing.

    A partition keeps only its filled windows, as (sum, members) ascending;
    the other k minus those are empty.
    """
    heap, links = [], []  # (-spread, order, sums ascending, window nodes)
    for i, size in enumerate(sizes):
        links.append((i, None))
        heap.append((-size if k > 1 else 0, i, [size], [i]))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        both = len(a) + len(b) - k
        # b's filled windows go descending onto a's ascending ones, empty ones first
        met = max(0, both)
        sums, nodes = [], []
        for j in range(met):
            links.append((na[j], nb[met - 1 - j]))
            sums.append(a[j] + b[met - 1 - j])
            nodes.append(len(links) - 1)
        sums += a[met:] + b[met:]
        nodes += na[met:] + nb[met:]
        by = sorted(range(len(sums)), key=sums.__getitem__)
        sums, nodes = [sums[j] for j in by], [nodes[j] for j in by]
        spread = sums[-1] - (sums[0] if len(sums) == k else 0)
        heapq.heappush(heap, (-spread, order, sums, nodes))
        order += 1
    window = [0] * len(sizes)
    for w, node in enumerate(heap[0][3] if heap else []):
        stack = [node]
        while stack:
            x, y = links[stack.pop()]
            if y is None:
                window[x] = w
            else:
                stack += [x, y]
    return window


def windows(sizes: list[int], capacity: int) -> list[int]:
    """A window for each size with no window over ``capacity``, by as few
    near-equal windows as differencing allows."""
    if sizes and max(sizes) > capacity:
        raise ValueError("a piece is longer than a window")
    full = [i for i, n in enumerate(sizes) if n == capacity]
    part = [i for i, n in enumerate(sizes) if n < capacity]
    out = [0] * len(sizes)
    for w, i in enumerate(full):  # a whole window needs no company
        out[i] = w
    if part:
        rests = [sizes[i] for i in part]
        k = -(-sum(rests) // capacity)
        while np.bincount(got := differencing(rests, k), weights=rests).max() > capacity:
            k += 1
        for i, w in zip(part, got, strict=True):
            out[i] = len(full) + w
    return out


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole windows, then the rest in
    near-equal pieces of at most ``piece``."""
    whole, rest = divmod(n, capacity)
    out = [(k * capacity, capacity) for k in range(whole)]
    if rest:
        parts = -(-rest // piece)
        edges = [whole * capacity + rest * j // parts for j in range(parts + 1)]
        out += [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return out


PIECES = "doc_id {kind}, row long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes whole texts with ``end_id`` behind each and cuts them, in one
    narrow map. Null texts are empty and so have the end id alone."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = PIECES.format(kind=kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = word_tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for chunk in text_chunks(batch.column(1), SPLIT_BYTES):
                rows = []
                for k, ids in enumerate(tokenizer.encode(list(chunk.rows()))):
                    ids += end
                    n = len(ids) // 4
                    rows += [(k, a, size, zlib.crc32(ids[4 * a : 4 * (a + size)]), n) for a, size in cuts(n, capacity, piece)]
                of, start, length, crc, total = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + chunk.lo)), batch.column(2).take(pa.array(of + chunk.lo)), *(pa.array(x) for x in (start, length, crc, total))], [x.split()[0] for x in schema.split(", ")])

    return docs.select(id_col, text_col, F.monotonically_increasing_id().alias("row")).mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, piece: int = PIECE, group_pieces: int = GROUP_PIECES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into windows of at most ``capacity`` ids.

    Returns a row a piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. Texts are read once, by a narrow map whose pieces
    (no ids) are written to the shared folder. Only these slim rows are
    shuffled, into about n / ``group_pieces`` groups by a hash of their place,
    so no key of the data can make a group large. A document's row number, not
    its id, tells documents apart: null and repeated ids are safe. Windows are
    near equal and padded to ``capacity`` by the reader. An empty table gives
    no rows.
    """
    written = materialize(pieces(docs, tokenizer_path, end_id, capacity, piece, id_col, text_col), "pieces")
    groups = max(1, -(-written.count() // group_pieces))
    dealt = written.withColumn("pack_group", F.pmod(F.xxhash64("row", "start"), F.lit(groups)))
    kind = dict(written.dtypes)["doc_id"]

    def run(rows: pa.Table) -> pa.Table:
        length, row, start = (rows[c].to_numpy() for c in ("length", "row", "start"))
        by = np.lexsort((start, row, -length))
        window = np.empty(len(by), np.int64)
        window[by] = windows(length[by].tolist(), capacity)
        by = by[np.argsort(window[by], kind="stable")]
        window, size = window[by], length[by]
        ends = np.cumsum(size)
        heads = np.flatnonzero(np.concatenate(([True], window[1:] != window[:-1])))
        base = np.repeat((ends - size)[heads], np.diff(np.append(heads, len(by))))
        out = rows.take(pa.array(by)).select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        sequence = (rows["pack_group"][0].as_py() << WINDOW_BITS) + window
        return out.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(ends - size - base))

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("pack_group").applyInArrow(run, schema)
