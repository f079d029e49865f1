"""SimHash near-duplicates by meet-in-the-middle balls.

Two fingerprints at most ``RADIUS`` = 4 bits apart share a point at most two
bits from either; emitting that ball takes 2,081 points a fingerprint. Here
the 64 bits lie in three blocks. Of at most four differing bits at most two
fall on the best two blocks, so for each pair of blocks a fingerprint emits
the points within half of *that* radius, one bit, of its 42 or 43 bits there:
130 points, each tagged with its pair. Points are shuffled, and fingerprints
that meet in one are verified on all 64 bits.

A point where many meet holds no more than 43 * 2^22 different fingerprints,
since copies are one fingerprint. Up to ``DIRECT`` of them are compared by
rows; beyond that the free block's values are cells of a dense table, and
labels spread through the ball of half the radius around each cell, whatever
the number met. Either way a point gives at most an edge for each member, so
no group's pairs are ever written out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, apart, shuffle_partitions, text_chunks

WORDS, RADIUS, SEED = 4, 4, 42
#: Bits of the three blocks, from the lowest.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints at one point that are compared directly.
DIRECT = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The words of a text are runs outside these bytes.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_hashes(text: bytes, words: int = WORDS) -> tuple[np.ndarray, bytes, list[int], list[int]]:
    """XXH64 of each run of ``words`` words of a UTF-8 text in lower case (of
    all of them, if they are fewer), the words joined by spaces, and where in
    that each run begins and ends."""
    import xxhash

    parts = text.translate(_LOWER).split()  # bytes split at exactly those six
    if not parts:
        return np.zeros(0, np.uint64), b"", [], []
    whole = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()[:n]
    stops = ends.tolist()[min(words, len(parts)) - 1 :]
    one = xxhash.xxh64_intdigest
    return np.array([one(whole[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64), whole, starts, stops


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; 0 for none."""
    counts, n = np.zeros(64, np.int64), len(hashes)
    for lo in range(0, n, 1 << 16):
        part = hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The fingerprint of a UTF-8 text by its runs of ``words`` words."""
    return majority(shingle_hashes(text, words)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of whole texts; null and
    blank texts have 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), operator="simhash"):
                got = np.array([fingerprint(t, words) for t in chunk.rows()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


def _mask(bits: int, shift: int) -> int:
    return ((1 << bits) - 1) << shift


def _pairs() -> list[tuple[int, list[int], tuple[int, int]]]:
    """(mask, bit places, free block) of each pair of blocks."""
    out = []
    for free in range(3):
        held = [BLOCKS[b] for b in range(3) if b != free]
        mask = sum(_mask(n, s) for s, n in held)
        out.append((mask, [s + i for s, n in held for i in range(n)], BLOCKS[free]))
    return out


PAIRS = _pairs()


def balls(distinct: DataFrame) -> DataFrame:
    """``pair, point, fp``: the points of every fingerprint."""

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    flips = [(p, mask, flip) for p, (mask, places, _) in enumerate(PAIRS) for flip in [0, *[1 << i for i in places]]]
    table = F.array(*[F.struct(F.lit(p).cast("byte").alias("pair"), F.lit(signed(mask)).cast("long").alias("mask"), F.lit(signed(flip)).cast("long").alias("flip")) for p, mask, flip in flips])
    points = distinct.select("fp", F.explode(table).alias("x"))
    return points.select(F.col("x.pair").alias("pair"), F.col("fp").bitwiseAND(F.col("x.mask")).bitwiseXOR(F.col("x.flip")).alias("point"), "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _direct(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints at one point, as a forest: each to the first
    of its component, components found by comparing rows."""
    n = len(fps)
    label = np.arange(n)
    todo, left = np.zeros(n, bool), np.ones(n, bool)
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        queue = [i]
        while queue:
            j = queue.pop()
            rest = np.flatnonzero(left)
            near = rest[_popcount(fps[rest] ^ fps[j]) <= RADIUS]
            label[near] = i
            left[near] = False
            queue += near.tolist()
    todo = label != np.arange(n)
    return fps[label[todo]], fps[todo]


def _dilate(cells: np.ndarray, bits: int) -> np.ndarray:
    """The least label at most one bit away."""
    out = cells.copy()
    for b in range(bits):
        both = cells.reshape(-1, 2, 1 << b)
        np.minimum(out.reshape(-1, 2, 1 << b), both[:, ::-1], out=out.reshape(-1, 2, 1 << b))
    return out


def _dense(fps: np.ndarray, point: int, mask: int, free: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The same for any number of fingerprints, in time and memory that the
    free block's 2^22 cells bound. A ball around a cell reaches two bits from
    the point itself and one from its neighbours; all in it are linked."""
    shift, bits = free
    cell = ((fps >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    off = _popcount((fps ^ np.uint64(point)) & np.uint64(mask)) > 0
    never = np.int32(2**31 - 1)
    label = np.arange(len(fps), dtype=np.int32)
    while True:
        near, far = np.full(1 << bits, never), np.full(1 << bits, never)
        np.minimum.at(near, cell[~off], label[~off])
        np.minimum.at(far, cell[off], label[off])
        ball = np.minimum(_dilate(_dilate(near, bits), bits), _dilate(far, bits))
        out = _dilate(ball, bits)
        back = np.where(off, out[cell], _dilate(out, bits)[cell])
        new = np.minimum(label, back)
        new = new[new]
        if (new == label).all():
            break
        label = new
    todo = label != np.arange(len(fps))
    return fps[label[todo]], fps[todo]


def _meet(fps: np.ndarray, pair: int, point: int) -> tuple[np.ndarray, np.ndarray]:
    if len(fps) <= DIRECT:
        return _direct(fps)
    mask, _, free = PAIRS[pair]
    return _dense(fps, point & ((1 << 64) - 1), mask, free)


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: edges that join just the fingerprints that links join; at each
    point a member is tied to the first of those that its links reach. One
    shuffle of 17-byte rows, 130 for each fingerprint; fingerprints are dealt
    out before that, so that few small partitions don't make all of them."""
    parts = shuffle_partitions(distinct.sparkSession)
    met = balls(distinct.repartition(parts, apart("fp"))).repartition(parts, "pair", "point").sortWithinPartitions("pair", "point", "fp")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def close(out: list) -> None:
            if last is not None:
                fps = np.concatenate(held)
                if len(fps) > 1:
                    out.append(_meet(fps, *last))
            held.clear()

        def emit(out: list) -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            both = np.unique(np.stack([a, b], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].view(np.int64)), pa.array(both[:, 1].view(np.int64))], ["a", "b"])

        for batch in batches:
            pair, point, fp = (batch.column(i).to_numpy() for i in range(3))
            fp = fp.view(np.uint64)
            if not len(fp):
                continue
            cut = np.concatenate(([0], np.flatnonzero((pair[1:] != pair[:-1]) | (point[1:] != point[:-1])) + 1, [len(fp)]))
            out: list = []
            key = (int(pair[0]), int(point[0]))
            if key != last:
                close(out)
            # the first run may go on from the batch before, the last one into the next
            first, final = 0, len(cut) - 2
            sizes = np.diff(cut)
            if final == 0:
                held.append(fp)
                last = key
            else:
                held.append(fp[: cut[1]])
                last = key
                close(out)
                two = cut[1:final][sizes[1:final] == 2] if final > 1 else np.zeros(0, np.int64)
                if len(two):
                    ok = _popcount(fp[two] ^ fp[two + 1]) <= RADIUS
                    out.append((fp[two[ok]], fp[two[ok] + 1]))
                for k in (np.flatnonzero(sizes[1:final] > 2) + 1).tolist() if final > 1 else []:
                    a, b = int(cut[k]), int(cut[k + 1])
                    out.append(_meet(fp[a:b], int(pair[a]), int(point[a])))
                a = int(cut[final])
                held.append(fp[a:])
                last = (int(pair[a]), int(point[a]))
            if out:
                yield emit(out)
        out = []
        close(out)
        if out:
            yield emit(out)

    return met.mapInArrow(run, "a long, b long").distinct()


def _joined_by(rows: DataFrame, least: DataFrame) -> DataFrame:
    """``rows`` (u, v) with the ``m`` that ``least`` (u, m), aggregated, has for u."""
    return rows.join(least.select(apart("u").alias("c"), "m"), apart("u") == F.col("c")).select("u", "v", "m")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``node, root``: the least node of each component of ``edges`` (a, b),
    for every node with an edge.

    Alternating stars: every node links its greater neighbours to its least
    one, then its lesser ones and itself to their least. Each half is a
    combined minimum and an equi-join between plain exchanges, so a hub is
    split by the skewed join and nothing is gathered; every round is written
    to the shared folder. Ends when a round changes nothing.
    """
    scratch = scratch or Scratch()
    now = scratch.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")

    def key(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        return row["n"], row["h"]

    seen = key(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = _joined_by(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = scratch.write(large, "large")
        joined = _joined_by(large, large.groupBy("u").agg(F.min("v").alias("m")))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = scratch.write(small, "small")
        new = key(now)
        if new == seen:
            break
        seen = new
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(roots.select("node"), "node", "left_anti"))


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    The component is the least ``doc_id`` reachable over links of at most four
    differing bits. Documents without words have fingerprint 0 and link like
    any other; rows that repeat an id give a row each; a null id is a member
    but never a component's name, unless all of it are null. A very long text
    is read whole, its hashes in memory; an empty table gives none. Only the
    id and the text are read, so no name can clash. Texts are read once; only
    (id, fingerprint) goes on.
    """
    scratch = Scratch()
    own = scratch.write(fingerprints(docs, words, id_col, text_col), "fp")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(distinct.select("fp")), scratch)
    rooted = scratch.write(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "roots")
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id")).select(apart("root").alias("of_root"), "component_id")
    of = scratch.write(rooted.join(named, apart("root") == F.col("of_root")).select(F.col("fp").alias("of_fp"), "component_id"), "names")
    scratch.remove(own, of)
    return own.join(of, F.col("fp") == F.col("of_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
