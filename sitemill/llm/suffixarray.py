"""Removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else goes. A suffix array of the whole corpus would be one sort of all its
bytes, so suffixes are first dealt by a value that equal strings share: the
least hash of the ``GRAM``-byte pieces inside a string's ``LENGTH`` bytes.
Neighbouring starts share it, so a text falls into regions of some 170 starts;
regions whose value occurs once, and whose least hash has one place in them,
cannot hold a repeat and go no further, and equal
regions are one region with a count. What is left of a value's regions is
joined into one text whose suffix array is built by two-stage sorting:
suffixes smaller than their successors are sorted directly, the others are
induced by a scan over the buckets of first bytes, and neighbours with a common
prefix of ``LENGTH`` bytes are repeats.

A shorter length may be asked for too (passages of fewer bytes). Then regions
are those of the shorter one, and its repeats that a suffix array finds are
told apart by the bytes that follow as far as the longer length.

A value with more than ``MOST_REGIONS`` different regions (the edges of a
passage that very many documents share) is not given to one task: its starts
are dealt once more, by the digest of their own bytes, and counted. What
repeats is the same either way, but that path sorts digests, not suffixes.

Texts are told apart by their MD5, so null and repeated ids do no harm, and
copies of a text are counted and then treated once. Regions and strings with
equal 128-bit digests count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, release, shuffle_partitions, text_chunks

LENGTH, GRAM = 400, 64
#: Starts of a region at which it is cut, regions of a value that go to one task, and bytes sorted together.
MOST_STARTS, MOST_REGIONS, TOGETHER = 1024, 512, 1 << 17
#: Digests of strings that one bucket of a hot value's count holds, about.
BUCKET = 1 << 20
#: Regions whose strings are compared before they are dealt, up to 2^16.
BLOCK = 2048
_BYTES = np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64)
_ODD = np.random.default_rng(11).integers(1 << 63, size=16, dtype=np.uint64) | np.uint64(1)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place; gram is a power of 2."""
    h, span, level = _BYTES[data], 1, 0
    while span < gram:
        h = h[:-span] * _ODD[level] + h[span:]
        span, level = 2 * span, level + 1
    h ^= h >> np.uint64(32)
    h *= _ODD[15]
    h ^= h >> np.uint64(29)
    return h


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    m, span = h, 1
    while 2 * span <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return np.minimum(m[: len(m) - (width - span)], m[width - span :]) if width > span else m


def regions(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM, most: int = MOST_STARTS) -> tuple[np.ndarray, ...]:
    """(row, lo, hi, value, inner): runs of starts lo..hi, relative to their
    text, whose strings share a least hash; inner, if it has several places
    there, so that a run may repeat within itself."""
    if len(data) < length:
        return *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), np.zeros(0, bool)
    hashes, width = gram_hashes(data, gram), length - gram + 1
    value = window_minima(hashes, width)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(value)]
    inside = np.arange(len(value)) + length <= offsets[1:][row]
    cut = np.ones(len(value), bool)
    cut[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    cut[1:] |= inside[1:] != inside[:-1]
    heads = np.flatnonzero(cut)
    at = np.arange(len(value)) - np.repeat(heads, np.diff(np.append(heads, len(value))))
    heads = np.flatnonzero(at % most == 0)
    tails = np.append(heads[1:], len(value)) - 1
    keep = inside[heads]
    heads, tails = heads[keep], tails[keep]
    base = offsets[:-1][row[heads]]
    # places that are least in some string: the greatest of their strings' values is their own
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(~window_minima(~np.concatenate([edge, value, edge]), width) == hashes)
    names, at = np.unique(hashes[places], return_inverse=True)
    n = len(hashes) + 1
    keys = np.sort(at * n + places)
    name = np.minimum(np.searchsorted(names, value[heads]), len(names) - 1) * n
    inner = np.searchsorted(keys, name + np.minimum(tails + width, n - 1)) - np.searchsorted(keys, name + heads) > 1
    return row[heads], heads - base, tails - base, value[heads], inner


def two_stage(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in the order of at least their first ``depth``
    bytes; suffixes equal so far are neighbours."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    # small: less than its successor; runs of one byte follow what comes behind them
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    nearest = np.where(step != 0, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    small = step[nearest] > 0
    raw = data.tobytes()
    direct = np.array(sorted(np.flatnonzero(small).tolist(), key=lambda i: raw[i : i + depth]), np.int64)
    byte = data[direct]
    ends = np.searchsorted(byte, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[data[-1]].append(np.array([n - 1]))
    out = []

    def before(places: np.ndarray) -> np.ndarray:
        p = places[places > 0] - 1
        return p[~small[p]]

    for c in range(256):
        induced = waiting[c]
        wave = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        scan = []
        while len(wave):  # those of the same byte follow in the same bucket
            scan.append(wave)
            p = before(wave)
            wave = p[data[p] == c]
        scan.append(direct[ends[c] : ends[c + 1]])
        bucket = np.concatenate(scan)
        if not len(bucket):
            continue
        out.append(bucket)
        p = before(bucket)
        p = p[data[p] > c]
        by = np.argsort(data[p], kind="stable")
        p = p[by]
        if not len(p):
            continue
        heads = np.flatnonzero(np.diff(data[p].astype(np.int16), prepend=-1))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(p)], strict=True):
            waiting[data[p[a]]].append(p[a:b])
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Of each suffix in ``order`` and the next: the bytes in common, up to ``cap``."""
    padded = np.concatenate([data, np.zeros(cap + 8, np.uint8)])
    words = np.empty(len(padded) - 7, np.uint64)
    raw = padded.tobytes()
    for o in range(8):
        part = words[o::8]
        part[:] = np.frombuffer(raw, ">u8", len(part), o)
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for j in range(0, cap, 8):
        differ = words[a[live] + j] ^ words[b[live] + j]
        ended = differ != 0
        top = np.frexp((differ[ended] >> np.uint64(32)).astype(np.float64))[1]
        low = np.frexp((differ[ended] & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
        zeros = np.where(top > 0, 32 - top, 64 - low)
        out[live[ended]] = j + zeros // 8
        live = live[~ended]
        if not len(live):
            break
    out[live] = cap
    return np.minimum(np.minimum(out, cap), len(data) - np.maximum(a, b))


def repeated_starts(texts: list[bytes], lengths: tuple[int, ...], starts: list[int]) -> list[list[np.ndarray]]:
    """For each of ``lengths`` (one, or a shorter and a longer one) and each
    text: which of its first ``starts`` places begin a string of that length
    that another of them begins too. Sorted are suffixes as far as the shorter
    length needs; its repeats are told apart by the digest of what follows."""
    import xxhash

    least, length = lengths[0], lengths[-1]
    sizes = np.array(starts, np.int64) + least - 1
    data = np.frombuffer(b"".join([t[:n] for t, n in zip(texts, sizes.tolist(), strict=True)]), np.uint8)
    ends = np.cumsum(sizes)
    order = two_stage(data, least)
    order = order[(np.repeat(ends, sizes) - np.arange(len(data)) >= least)[order]]
    same = common_prefixes(data, order, least) >= least
    hit = np.zeros(len(data), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    out = [np.split(hit, ends[:-1])]
    if length > least:
        group = np.concatenate(([0], np.cumsum(~same)))[hit[order]]
        places = order[hit[order]]
        own = np.searchsorted(ends, places, "right")
        at = places - (ends - sizes)[own]
        whole = at + length <= np.fromiter(map(len, texts), np.int64, len(texts))[own]
        group, places, own, at = group[whole], places[whole], own[whole], at[whole]
        tails = np.frombuffer(b"".join([xxhash.xxh3_128_digest(texts[t][p + least : p + length]) for t, p in zip(own.tolist(), at.tolist(), strict=True)]), "<u8").reshape(-1, 2)
        by = np.lexsort((tails[:, 1], tails[:, 0], group))
        same = (tails[by[1:]] == tails[by[:-1]]).all(1) & (group[by[1:]] == group[by[:-1]])
        hit = np.zeros(len(data), bool)
        hit[places[by[:-1][same]]] = True
        hit[places[by[1:][same]]] = True
        out.append(np.split(hit, ends[:-1]))
    return out


def _intervals(hit: np.ndarray) -> tuple[list[int], list[int]]:
    """Runs of hits: first and last places."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()


#: Of a region: first and last places of runs of repeated starts, of the shorter and of the full length.
_SPANS = "value long, digest binary, first array<int>, last array<int>, first_full array<int>, last_full array<int>"


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    value, digest, *places = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(digest, pa.binary()), *(pa.array(x, pa.list_(pa.int32())) for x in places)], [x.split()[0] for x in _SPANS.split(", ")])


def _gram(length: int) -> int:
    """The greatest power of two up to a quarter of ``length``: longer pieces
    tell unlike texts apart, shorter ones make longer regions."""
    return 1 << max(0, (length // 4).bit_length() - 1)


def _anchors(texts: DataFrame, length: int, reach: int) -> DataFrame:
    """Regions of each different text. A digest is of all bytes that strings
    of ``reach`` bytes from a region's starts cover, and of its size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[bytes] = set()  # 16 bytes for each different text of the task
        for batch in batches:
            cids = batch.column(0)
            for chunk in text_chunks(batch.column(1), 1 << 20, "suffix array"):
                row, lo, hi, value, inner = regions(chunk.data, chunk.offsets, length, _gram(length))
                if not len(row):
                    continue
                names = cids.slice(chunk.lo, len(chunk)).to_pylist()
                fresh = np.ones(len(chunk), bool)
                for r in np.unique(row).tolist():
                    fresh[r] = names[r] not in seen
                    seen.add(names[r])
                keep = fresh[row]
                row, lo, hi, value, inner = row[keep], lo[keep], hi[keep], value[keep], inner[keep]
                raw, base = chunk.data.tobytes(), chunk.offsets[row]
                stop = np.minimum(base + hi + reach, chunk.offsets[row + 1])
                digests = [xxhash.xxh3_128_digest(raw[a:b], n) for a, b, n in zip((base + lo).tolist(), stop.tolist(), (hi - lo).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([names[r] for r in row.tolist()], pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(value.view(np.int64)), pa.array(digests, pa.binary()), pa.array(inner)], ["cid", "lo", "hi", "value", "digest", "inner"])
        release()

    return texts.mapInArrow(run, "cid binary, lo int, hi int, value long, digest binary, inner boolean")


def _extract(joined: DataFrame, reach: int) -> DataFrame:
    """Bytes of the wanted regions, once for each text of a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for cid, text, want in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                if cid.as_py() in seen:
                    continue
                seen.add(cid.as_py())
                raw = text.as_py().encode()
                rows = [(w["value"], w["digest"], w["hot"], w["hi"] - w["lo"] + 1, raw[w["lo"] : w["hi"] + reach]) for w in want.as_py()]
                value, digest, hot, starts, body = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(digest, pa.binary()), pa.array(hot), pa.array(starts, pa.int32()), pa.array(body, pa.binary())], ["value", "digest", "hot", "starts", "body"])

    return joined.mapInArrow(run, "value long, digest binary, hot boolean, starts int, body binary")


def _sorted_spans(bodies: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """Repeats among the regions of each value, by suffix arrays of values
    taken together up to ``TOGETHER`` bytes."""
    dealt = bodies.select("value", "digest", "starts", "body").repartition(shuffle_partitions(bodies.sparkSession), "value").sortWithinPartitions("value", "digest")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> list[tuple]:
            hits, rows = repeated_starts([h[3] for h in held], lengths, [h[2] for h in held]), []
            for k, (value, digest, _, _) in enumerate(held):
                if hits[0][k].any():
                    rows.append((value, digest, *_intervals(hits[0][k]), *_intervals(hits[-1][k])))
            held.clear()
            return rows

        for batch in batches:
            for value, digest, starts, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if last is not None and (value, digest) == last:
                    continue  # the same region again, from a copy of its text
                if held and size >= TOGETHER and value != last[0]:
                    if rows := flush():
                        yield _span_batch(rows)
                    size = 0
                held.append((value, digest, starts, body))
                size += len(body)
                last = (value, digest)
        if held and (rows := flush()):
            yield _span_batch(rows)

    return dealt.mapInArrow(run, _SPANS)


def _window_digests(body: bytes, starts: int, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the strings of each length from the first ``starts`` places
    of a body, and which string it is: its place times the lengths, plus the
    number of its length."""
    import xxhash

    found, names, n = [], [], len(lengths)
    for k, length in enumerate(lengths):
        count = min(starts, len(body) - length + 1)
        found += [xxhash.xxh3_128_digest(body[i : i + length]) for i in range(count)]
        names.append(np.arange(max(count, 0), dtype=np.uint32) * n + k)
    return np.frombuffer(b"".join(found), "<u8").reshape(-1, 2), np.concatenate(names)


def _same(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests in order, and of each in that order whether it begins a group
    of equal ones and whether it has an equal."""
    by = np.lexsort((strings[:, 1], strings[:, 0]))
    first = np.ones(len(by), bool)
    first[1:] = (strings[by[1:]] != strings[by[:-1]]).any(1)
    alone = first & np.append(first[1:], True)
    return by, first, ~alone


def _counted_spans(bodies: DataFrame, lengths: tuple[int, ...], scratch: Scratch) -> DataFrame:
    """Repeats among the regions of hot values, by counts of every start's
    own strings; no task gets a whole value.

    Digests of strings travel in blocks, a row for each bucket of digests and
    run of ``BLOCK`` regions, so rows don't grow with the strings. What repeats
    within a run is known there, and one of its copies goes on, so a bucket
    gets at most a digest a run of any one string. Buckets are as many as keep
    one at about ``BUCKET`` digests.
    """
    spark, n_lengths = bodies.sparkSession, len(lengths)
    once = scratch.write(bodies.select("value", "digest", "starts", "body").dropDuplicates(["value", "digest"]), "hot")
    total = once.agg(F.coalesce(F.sum("starts"), F.lit(0)).alias("n")).first()["n"] * n_lengths
    buckets = max(1, -(-total // BUCKET))
    block = "bucket int, value array<long>, digest array<binary>, region binary, start binary, strings binary"

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                held = [_window_digests(body, n, lengths) for n, body in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                strings, start = (np.concatenate(x) for x in zip(*held, strict=True))
                region = np.repeat(np.arange(len(held)), [len(x) for x, _ in held])
                by, first, several = _same(strings)
                bucket = (strings[:, 0] % np.uint64(buckets)).astype(np.int64)
                cuts: dict[int, list[np.ndarray]] = {}
                for rows, k in ((by[first], 0), (by[several], 1)):  # those to count, and those known to repeat
                    rows = rows[np.argsort(bucket[rows], kind="stable")]
                    names, heads = np.unique(bucket[rows], return_index=True)
                    for name, own in zip(names.tolist(), np.split(rows, heads[1:]) if len(rows) else [], strict=True):
                        cuts.setdefault(name, [rows[:0], rows[:0]])[k] = own
                both = [np.concatenate(x) for x in cuts.values()]
                columns = [pa.array([part.column(i).to_pylist()] * len(cuts), kind) for i, kind in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.binary())))]
                columns += [pa.array([region[c].astype("<u2").tobytes() for c in both], pa.binary()), pa.array([start[c].astype("<u4").tobytes() for c in both], pa.binary()), pa.array([strings[c[0]].tobytes() for c in cuts.values()], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(list(cuts), pa.int32()), *columns], [x.split()[0] for x in block.split(", ")])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> list[tuple]:
            strings = np.concatenate([np.frombuffer(h["strings"], "<u8").reshape(-1, 2) for h in held])
            by, _, several = _same(strings)
            hit = np.zeros(len(strings), bool)
            hit[by[several]] = True
            rows, at = [], 0
            for h in held:
                region, start = np.frombuffer(h["region"], "<u2"), np.frombuffer(h["start"], "<u4")
                counted = len(h["strings"]) // 16
                own = np.concatenate([hit[at : at + counted], np.ones(len(region) - counted, bool)])
                at += counted
                region, start = region[own], start[own]
                for r in np.unique(region).tolist():
                    rows.append((h["value"][r], h["digest"][r], start[region == r].astype("<u4").tobytes()))
            held.clear()
            return rows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            value, digest, starts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(value, pa.int64()), pa.array(digest, pa.binary()), pa.array(starts, pa.binary())], ["value", "digest", "starts"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and row["bucket"] != held[0]["bucket"] and (rows := close()):
                    yield batch_of(rows)
                held.append(row)
        if held and (rows := close()):
            yield batch_of(rows)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, digest, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                starts = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
                hit = np.zeros((n_lengths, int(starts.max()) // n_lengths + 1), bool)
                hit[starts % n_lengths, starts // n_lengths] = True
                rows.append((value, digest, *_intervals(hit[0]), *_intervals(hit[-1])))
            if rows:
                yield _span_batch(rows)

    dealt = once.mapInArrow(deal, block).repartition(shuffle_partitions(spark), "bucket").sortWithinPartitions("bucket")
    hits = dealt.mapInArrow(count, "value long, digest binary, starts binary")
    return hits.groupBy("value", "digest").agg(F.collect_list("starts").alias("starts")).mapInArrow(join, _SPANS)


def repeated_spans(texts: DataFrame, scratch: Scratch, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """``cid, cuts, passages``: for each text (``cid, text``) the byte ranges
    [lo, hi) of repeated strings of ``length`` bytes, as far as they lie within
    the text, and of ``passage`` bytes (if none is given: the same), not yet
    merged. Texts without any are absent."""
    least = passage or length
    lengths = (least,) if least == length else (least, length)
    found = scratch.write(_anchors(texts, least, length), "anchors")
    again = found.groupBy("value").agg(F.count("*").alias("n"), F.max("inner").alias("inner")).where("n > 1 OR inner").select("value")
    again = scratch.write(again, "again")  # so that a hot value's rows can be split in the join
    held = scratch.write(found.join(again, "value", "left_semi").dropDuplicates(["cid", "lo"]), "regions")
    scratch.remove(held)
    kinds = scratch.write(held.groupBy("value", "digest").agg(F.count("*").alias("n"), F.max("inner").alias("inner"), F.min(F.struct("cid", "lo", "hi")).alias("at")), "kinds")
    several = kinds.groupBy("value").agg(F.count("*").alias("kinds"), F.max("inner").alias("any_inner")).where("kinds > 1 OR any_inner").select("value", (F.col("kinds") > MOST_REGIONS).alias("hot"))
    several = scratch.write(several, "several")
    wanted = kinds.join(several, "value").groupBy(F.col("at.cid").alias("of")).agg(F.collect_list(F.struct("value", "digest", "hot", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"))).alias("want"))
    wanted = scratch.write(wanted, "wanted")
    bodies = scratch.write(_extract(texts.join(wanted, F.col("cid") == F.col("of")).select("cid", "text", "want"), length), "bodies")
    scratch.remove(held, kinds, bodies)
    first, last = F.array(F.lit(0)), F.array(F.col("at.hi") - F.col("at.lo"))
    whole = kinds.where("n > 1").select("value", "digest", first.alias("first"), last.alias("last"), first.alias("first_full"), last.alias("last_full"))
    some = _sorted_spans(bodies.where("not hot"), lengths).union(_counted_spans(bodies.where("hot"), lengths, scratch))
    spans = scratch.write(whole.union(some).select(F.col("value").alias("v"), F.col("digest").alias("d"), "first", "last", "first_full", "last_full"), "spans")
    scratch.remove(held, spans)
    hit = held.join(spans, (F.col("value") == F.col("v")) & (F.col("digest") == F.col("d")))

    def ranges(first: str, last: str, size: int) -> F.Column:
        return F.transform(F.arrays_zip(F.col(first).alias("a"), F.col(last).alias("b")), lambda x: F.struct((F.col("lo") + x["a"]).alias("lo"), (F.col("lo") + x["b"] + size).alias("hi")))

    hit = hit.select("cid", ranges("first_full", "last_full", length).alias("cuts"), ranges("first", "last", least).alias("passages"))
    return hit.groupBy("cid").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("cuts", "passages")])


def _merged(lo: list[int], hi: list[int], size: int, length: int) -> list[list[int]]:
    """The union of ranges of starts of ``length`` bytes in a text of ``size``."""
    out: list[list[int]] = []
    for a, b in sorted((a, min(b, size)) for a, b in zip(lo, hi, strict=True) if a + length <= size):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_repeats(docs: DataFrame, result: str = "bytes", length: int = LENGTH, passage: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Removes every byte covered by a repeated string of ``length`` bytes.

    Returns ``doc_id, n_bytes, n_removed, n_spans`` and, by ``result``, the
    ``bytes`` left as ``kept`` (a cut may part a character), their ``text`` as
    ``kept_text`` (a parted character goes whole), or their SHA-256 as
    ``kept_sha256`` (``digest``). With ``passage``, a shorter length, follows
    ``passage_bytes``: the bytes covered by repeated strings of that length,
    which stay. Columns of ``keep`` are carried along under their names; no
    others are read, so no name can clash. Null texts are empty; texts of fewer
    bytes keep all. All copies of a text are repeats of one another, and rows
    that repeat a text each count, so there are no ties to break. A very long
    text is read alone, in memory some hundred times ``2^20`` or a few dozen
    times its own size; its regions go their own ways. An empty table gives
    none.
    """
    extra = keep or []
    least = passage or length
    if not 0 < least <= length:
        raise ValueError("a passage is not longer than the strings that go")
    text = F.coalesce(F.col(text_col), F.lit(""))
    cid = F.unhex(F.md5(F.encode(text, "UTF-8")))
    texts = docs.select(cid.alias("cid"), text.alias("text")).where(F.octet_length("text") >= least)
    scratch = Scratch()
    spans = repeated_spans(texts, scratch, length, passage)
    all_of_it = F.array(F.struct(F.lit(0).alias("lo"), F.lit(2**31 - 1).alias("hi")))
    copies = texts.groupBy("cid").agg(F.count("*").alias("n")).where("n > 1").select("cid", all_of_it.alias("cuts"), all_of_it.alias("passages"))
    cuts = spans.union(copies).groupBy("cid").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("cuts", "passages")])
    cuts = cuts.select(F.col("cid").alias("of"), F.col("cuts.lo").alias("lo"), F.col("cuts.hi").alias("hi"), *([F.col("passages.lo").alias("from"), F.col("passages.hi").alias("to")] if passage else []))
    cuts = scratch.write(cuts, "cuts")  # so that many copies of a text can be split in the join
    scratch.remove(cuts)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), cid.alias("cid"), F.struct(*([F.col(c) for c in extra] or [F.lit(0).alias("none")])).alias("extra"))
    joined = rows.join(cuts, F.col("cid") == F.col("of"), "left").select("doc_id", "text", "extra", "lo", "hi", *(["from", "to"] if passage else []))
    tail = {"bytes": "kept binary", "text": "kept_text string", "digest": "kept_sha256 string"}[result]
    form = {"bytes": bytes, "text": lambda raw: raw.decode("utf-8", "ignore"), "digest": lambda raw: hashlib.sha256(raw).hexdigest()}[result]
    schema = T.StructType([joined.schema["doc_id"], *T.StructType.fromDDL(f"n_bytes long, n_removed long, n_spans long, {tail}{', passage_bytes long' if passage else ''}"), joined.schema["extra"]])
    kinds = [pa.int64()] * 3 + [pa.binary() if result == "bytes" else pa.string()] + [pa.int64()] * bool(passage)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [batch.column(i) for i in range(3, batch.num_columns)]
            for chunk in text_chunks(batch.column(1), 1 << 20, "suffix array"):
                out = []
                for k, raw in enumerate(chunk.rows()):
                    found = [m[chunk.lo + k].as_py() or [] for m in marks]
                    merged = _merged(found[0], found[1], len(raw), length)
                    kept, at = [], 0
                    for a, b in merged:
                        kept.append(raw[at:a])
                        at = b
                    row = (len(raw), sum(b - a for a, b in merged), len(merged), form(b"".join([*kept, raw[at:]])))
                    out.append((*row, sum(b - a for a, b in _merged(found[2], found[3], len(raw), least))) if passage else row)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), *(pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)), batch.column(2).slice(chunk.lo, len(chunk))], schema.names)

    out = joined.mapInArrow(run, schema)
    return out.select(*schema.names[:-1], *[F.col(f"extra.`{c}`").alias(c) for c in extra])
