"""Near copies of documents: SimHash links, widened to a stated similarity.

Fingerprints at most four bits apart find copies with very few edits. Copies
down to a Jaccard similarity of ``SIMILARITY`` of their sets of runs of
``WORDS`` words may differ by twenty bits, too far for any ball; they are found
by prefix filtering, which loses none: if runs have one order everywhere, two
sets of the similarity s share a run among the first n - ceil(s n) + 1 of each.
Runs that a sample of the documents holds most often come last in the order, so
that common lines meet few documents; any order is exact. A pair that meets in a run
with so many others before it, in either set, that what is left can't reach the
similarity is passed over (the run may be shared, but not be the first that
is), so copies edited at many places of their own don't make pairs.

All other pairs that meet are compared, but for those that the sizes or
parities of run hashes (256, then one or two a run) prove too unlike, and those
joined by other links already. Where
over ``SMALL`` sets meet, they are first tied to one of them, and only pairs
that this leaves in different groups are compared afterwards, so a large group
of copies gives an edge for each, not its pairs. Sets are known by 64-bit
digests, runs by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, TextChunk, apart, text_chunks
from .simhash import components, links, majority, shingle_hashes

WORDS, SIMILARITY = 5, 0.8
#: Sets that meet in a run and are compared pair by pair at once.
SMALL = 32
#: Documents of the sample that orders runs, and the most runs that it puts last.
SAMPLE, COMMON = 8192, 1 << 16
#: Longs of parities.
MARKS = 4


def prefix(runs: np.ndarray, similarity: float, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first of the sorted ``runs``, of which two sets of the similarity
    share one: those in no ``common`` first, then by count, then by hash."""
    n = len(runs)
    if not n:
        return runs
    size = n - ceil(similarity * n - 1e-9) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, runs), len(common) - 1)
        rank = np.where(common[at] == runs, counts[at], 0)
        if rank.any():
            runs = runs[np.argsort(rank, kind="stable")]
    return runs[:size]


def marks(runs: np.ndarray) -> np.ndarray:
    """The parity of the number of runs by the lowest bits of their hash."""
    odd = np.bincount((runs & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_marks(runs: np.ndarray) -> bytes:
    """The same with as many parities as the next power of two over the runs."""
    width = max(64 * MARKS, 1 << len(runs).bit_length())
    odd = np.bincount((runs & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """How many runs only one of two sets has, at least, by their wide marks."""
    x, y = sorted((np.frombuffer(v, np.uint8) for v in (a, b)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _prints(similarity: float, common: np.ndarray, counts: np.ndarray) -> object:
    import xxhash

    def work(chunk: TextChunk) -> list[pa.Array]:
        fps, digests, sizes, parities, wide, first = [], [], [], [], [], []
        for text in chunk.rows():
            hashes = shingle_hashes(text, WORDS)[0]
            runs = np.unique(hashes)
            fps.append(majority(hashes))
            digests.append(xxhash.xxh64_intdigest(runs.tobytes()))
            sizes.append(len(runs))
            parities.append(marks(runs))
            wide.append(wide_marks(runs))
            first.append(prefix(runs, similarity, common, counts).view(np.int64))
        return [*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, digests)), pa.array(sizes, pa.int64()), *(pa.array(x) for x in np.stack(parities, 1)), pa.array(wide, pa.binary()), pa.array(first, pa.list_(pa.int64()))]

    return work


def _shingles(chunk: TextChunk) -> list[pa.Array]:
    return [pa.array([np.unique(shingle_hashes(t, WORDS)[0]).tobytes() for t in chunk.rows()], pa.binary())]


def _sampled(chunk: TextChunk) -> list[pa.Array]:
    return [pa.array([np.unique(shingle_hashes(t, WORDS)[0]).view(np.int64) for t in chunk.rows()], pa.list_(pa.int64()))]


def _mapped(docs: DataFrame, keep: list[str], schema: str, work: object) -> DataFrame:
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL(schema)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(len(keep)), operator="near copies"):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(chunk.lo, len(chunk)) for i in range(len(keep))), *work(chunk)], out.names)

    return rows.mapInArrow(run, out)


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs that a sample of the documents repeats most, by hash, and their
    counts: ``COMMON`` rows at most."""
    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0)
    counted = _mapped(some, [], "runs array<long>", _sampled).select(F.explode("runs").alias("run")).groupBy("run").count().where("count > 2")
    rows = counted.orderBy(F.desc("count"), "run").limit(COMMON).collect()
    runs, counts = np.array([r["run"] for r in rows], np.int64).view(np.uint64), np.array([r["count"] for r in rows], np.int64)
    order = np.argsort(runs)
    return runs[order], counts[order]


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose sets of runs reach the similarity, verified exactly."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both >= similarity * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _screened(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs but for those that sizes and wide marks prove too unlike."""
    most = (1 - similarity) / (1 + similarity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [least_apart(x.as_py(), y.as_py()) <= n.as_py() * most + 1e-6 for n, x, y in zip(*(batch.column(i) for i in (2, 3, 4)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n", "x", "y").mapInArrow(run, "a long, b long")


def _near(similarity: float) -> Column:
    """Whether sizes, parities and the run that they meet in let sets ``a`` and
    ``b`` reach the similarity: each run that only one of them has turns one
    parity, and runs before the first that both have are in one of them."""
    odd = sum((F.bit_count(F.col(f"a.m{k}").bitwiseXOR(F.col(f"b.m{k}"))) for k in range(MARKS)), F.lit(0))
    sizes = F.least("a.n", "b.n") >= similarity * F.greatest("a.n", "b.n") - 1e-9
    share = similarity / (1 + similarity)
    behind = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return sizes & (behind >= (F.col("a.n") + F.col("b.n")) * share - 1e-6) & (odd <= (F.col("a.n") + F.col("b.n")) * ((1 - similarity) / (1 + similarity)) + 1e-6)


def near_copies(docs: DataFrame, key: str, similarity: float = SIMILARITY) -> DataFrame:
    """``key, component_key`` of every document: the least key of those that
    links reach. ``key`` may be of any type with an order; texts are in
    ``text``. Documents link if their fingerprints differ by four bits at most,
    or if their sets of runs reach the similarity.

    Texts are read for their prints, a sample of them before that for the order
    of runs, and those with a candidate once more. Null texts are empty; texts
    without words are copies of each other.
    """
    spark, scratch = docs.sparkSession, Scratch()
    keyed = docs.select(F.col(key).alias("key"), "text")
    names = [f"m{k}" for k in range(MARKS)]
    own = scratch.write(_mapped(keyed, ["key"], f"fp long, sid long, n long, {', '.join(f'{m} long' for m in names)}, wide binary, prefix array<long>", _prints(similarity, *_common(keyed))), "prints")
    distinct = scratch.write(own.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    # of a set of runs one document is read again; its fingerprint, the least, stands for it
    sets = scratch.write(own.groupBy("sid").agg(F.min("fp").alias("fp"), F.min(F.struct("key")).alias("wanted"), *[F.max(c).alias(c) for c in ("n", *names, "wide", "prefix")]), "sets")
    same = own.select("sid", F.col("fp").alias("b")).distinct().join(sets.where("n > 0").select("sid", F.col("fp").alias("a")), "sid").where("a != b").select("a", "b")
    near = scratch.write(links(distinct.select("fp")).union(same), "links")
    # copies are one set; runs are counted on the map side first, so that a run of very many sets is split in the join
    posts = sets.select("sid", F.posexplode("prefix").alias("pos", "run"))
    counts = posts.groupBy("run").agg(F.count("*").alias("k")).where("k > 1").select(apart("run").alias("of_run"), "k")
    met = scratch.write(posts.join(counts, apart("run") == F.col("of_run")).select("run", "sid", "pos", "k"), "met")
    slim = scratch.write(own.select("key", "fp"), "keys")
    scratch.drop(own)
    scratch.free(spark)
    held = scratch.write(met.join(sets.select("sid", "fp", "n", *names), "sid"), "held")
    scratch.drop(met)
    few, many = held.where(F.col("k") <= SMALL), held.where(F.col("k") > SMALL)
    close = _near(similarity)

    def candidates(left: DataFrame, right: DataFrame, also: Column) -> DataFrame:
        return left.alias("a").join(right.alias("b"), (F.col("a.run") == F.col("b.run")) & also & close).select(F.least("a.sid", "b.sid").alias("a"), F.greatest("a.sid", "b.sid").alias("b")).distinct()

    def screened(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("sid").alias(f"of_{c}"), F.col("n").alias(f"n_{c}"), F.col("wide").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        both = scratch.write(pairs, "candidates").join(left, F.col("a") == F.col("of_a")).join(right, F.col("b") == F.col("of_b"))
        return scratch.write(_screened(both.withColumn("n", F.col("n_a") + F.col("n_b")), similarity), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()
        wanted = scratch.write(sets.join(asked, F.col("sid") == F.col("of")).select("sid", F.col("wanted.key").alias("wanted")), "wanted")
        texts = keyed.join(wanted, F.col("key").eqNullSafe(F.col("wanted"))).select("sid", "text")
        runs = scratch.write(_mapped(texts, ["sid"], "runs binary", _shingles).dropDuplicates(["sid"]), "runs")
        left, right = (runs.select(F.col("sid").alias(f"of_{c}"), F.col("runs").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        found = _similar(pairs.join(left, F.col("a") == F.col("of_a")).join(right, F.col("b") == F.col("of_b")), similarity)
        for c in ("a", "b"):
            found = found.join(sets.select(F.col("sid").alias(f"s_{c}"), F.col("fp").alias(f"f_{c}")), F.col(c) == F.col(f"s_{c}"))
        out = scratch.write(found.select(F.col("f_a").alias("a"), F.col("f_b").alias("b")).where("a != b"), "verified")
        scratch.drop(wanted, runs, pairs)
        scratch.free(spark)
        return out

    # a few choices over all runs, so that a pair tied in many of them is one pair
    chosen = many.groupBy("run").agg(F.min_by(F.struct("sid", "n", "pos", *names), F.xxhash64(F.pmod("run", F.lit(4)), "sid")).alias("c")).select("run", "c.*")
    ahead, differ = F.col("a.sid") < F.col("b.sid"), F.col("a.sid") != F.col("b.sid")
    chosen = scratch.write(chosen, "chosen")
    pairs = screened(candidates(few, few, ahead).union(candidates(many, chosen, differ)).distinct())
    edges = near.union(verified(pairs))
    roots = scratch.write(components(edges, scratch), "first-roots")
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    if not many.isEmpty():
        placed = scratch.write(many.join(roots, F.col("fp") == F.col("node"), "left").select("run", "sid", "pos", "n", *names, F.coalesce("root", "fp").alias("root")), "placed")
        # sets of a run that all lie in one group are done
        unlike = placed.groupBy("run").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("run")
        unlike = scratch.write(placed.join(scratch.write(unlike, "unlike"), "run"), "open")
        rest = screened(candidates(unlike, unlike, ahead & (F.col("a.root") != F.col("b.root"))))
        if not rest.isEmpty():
            # links between groups, and the groups of those
            between = verified(rest)
            for c in ("a", "b"):
                between = between.join(roots.select("node", "root"), F.col(c) == F.col("node"), "left").withColumn(c, F.coalesce("root", c)).drop("node", "root")
            over = components(between, scratch).select(F.col("node").alias("of_group"), F.col("root").alias("group"))
            rooted = rooted.join(over, F.col("root") == F.col("of_group"), "left").select("fp", "least", F.coalesce("group", "root").alias("root"))
    rooted = scratch.write(rooted, "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_key")).select(apart("root").alias("of_root"), "component_key")
    of = scratch.write(rooted.join(named, apart("root") == F.col("of_root")).select(F.col("fp").alias("of_fp"), "component_key"), "names")
    out = scratch.write(slim.join(of, F.col("fp") == F.col("of_fp")).select(F.col("key").alias(key), "component_key"), "groups")
    scratch.remove(out)
    scratch.free(spark)
    return out
