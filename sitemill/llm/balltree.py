"""Centroid clustering by filtering ball trees.

Vectors are turned into whole numbers and put into trees of at most ``TREE``
vectors, each made in the task that scans them and written once: a row a tree,
with its vectors in tree order and its balls. A ball is a run of those vectors
and holds their count, whole-number sum and radius; its centre is sum / count.

A round sends the centroids (k rows, a parameter) to all trees. From the root
down, a ball keeps the centroids that may be nearest to some vector in it: by
the triangle inequality those whose distance to the centre, less the radius, is
not beyond the least such distance plus the radius. A ball with one of them
left gives its count and sum to it whole; a leaf finds the nearest of those
left vector by vector in exact whole numbers, ties going to the lowest number.
Distances between centres and centroids are floating; the margin ``SLACK``
covers their error, so no ball is ever given away wrongly.

Each tree gives a row a centroid that it meets, added up by (cluster) on the
map side first; k rows of sums reach the driver a round. Nothing is dealt by a
key of the data, so equal vectors, hot labels or sources cannot make a task
large: a tree is made from whatever its scan yields next.

Vectors that are null, of another length, or with a null or non-finite
component are left out. A null id counts as an empty text where ids are hashed;
rows that repeat an id are vectors of their own, and where they all are among
the first centroids, they come in order of their components. Fewer vectors than
``k`` give as many centroids; an empty table gives no rows. Only the columns
named are read, so others may have any name. Components beyond 2^26 / scale are
refused, since a squared distance would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, enter, materialize

#: Vectors of a tree and of a leaf at most.
TREE, LEAF = 4096, 32
#: Part of a distance by which floating sums of 64 whole numbers may be off, many times over.
SLACK = 1e-9
#: Whole numbers up to this have exact sums in floating point.
EXACT = 1 << 53
#: Components are less than this, so that squared distances stay in 64 bits.
MOST = 1 << 26


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x @ y.T in exact whole numbers, by floating arithmetic where that is exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if most * most * max(1, x.shape[1]) < EXACT:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and rows of y."""
    return (x * x).sum(1)[:, None] - 2 * products(x, y) + (y * y).sum(1)[None, :]


class Tree:
    """Balls over ``points`` (whole numbers, a row a vector). Ball i covers
    rows ``lo[i]`` to ``hi[i]``; its halves are balls ``child[i]`` and the next
    (-1: a leaf)."""

    __slots__ = ("child", "hi", "lo", "points", "radius", "sums")

    def __init__(self, points, lo, hi, child, radius, sums):
        self.points, self.lo, self.hi, self.child, self.radius, self.sums = points, lo, hi, child, radius, sums

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the order into which it brought the rows."""
        order = np.arange(len(points))
        lo, hi, child, radius, sums = [0], [len(points)], [], [], []
        at = 0
        while at < len(lo):
            own = points[order[lo[at] : hi[at]]]
            total = own.sum(0)
            apart = own - total / len(own)
            radius.append(float(np.sqrt((apart * apart).sum(1).max())))
            sums.append(total)
            if len(own) > LEAF and (own != own[0]).any():
                middle, part = cls._halves(own, apart)
                order[lo[at] : hi[at]] = order[lo[at] : hi[at]][part]
                child.append(len(lo))
                lo += [lo[at], lo[at] + middle]
                hi += [lo[at] + middle, hi[at]]
            else:
                child.append(-1)
            at += 1
        return cls(points[order], np.array(lo), np.array(hi), np.array(child), np.array(radius), np.array(sums)), order

    @staticmethod
    def _halves(own: np.ndarray, apart: np.ndarray) -> tuple[int, np.ndarray]:
        """Where to cut, and the order: by the nearer of two vectors that lie
        far apart, so that groups stay whole; at the median where that would
        leave a side with less than a tenth."""
        first = own[(apart * apart).sum(1).argmax()]
        second = own[((own - first) ** 2).sum(1).argmax()]
        along = (2 * products(own, (second - first)[None, :])[:, 0] - (second @ second - first @ first)).astype(np.float64)
        middle = int((along < 0).sum())
        if min(middle, len(own) - middle) * 10 < len(own):
            middle = len(own) // 2
        return middle, np.argpartition(along, middle)

    def assign(self, centroids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | int, np.ndarray | None]]:
        """Runs of rows and their centroid: ``lo, hi, number, sum`` of a whole
        ball, or ``lo, hi, numbers, None`` of a leaf's vectors."""
        floating, k = centroids.astype(np.float64), len(centroids)
        balls, open_to = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(balls):
            centres = self.sums[balls] / (self.hi - self.lo)[balls][:, None]
            # differences, not products: no digits cancel out, however far from zero
            apart = np.empty((len(balls), k))
            for j in range(k):
                gap = centres - floating[j]
                apart[:, j] = np.sqrt((gap * gap).sum(1))
            margin = SLACK * (1 + np.abs(centres).sum(1) + apart.max(1) + self.radius[balls])
            reach = self.radius[balls] + margin
            open_to &= apart - reach[:, None] <= (np.where(open_to, apart, np.inf).min(1) + reach)[:, None]
            alone = open_to.sum(1) == 1
            for i in np.flatnonzero(alone):
                b = balls[i]
                yield int(self.lo[b]), int(self.hi[b]), int(open_to[i].argmax()), self.sums[b]
            leaf = ~alone & (self.child[balls] < 0)
            for i in np.flatnonzero(leaf):
                lo, hi, those = int(self.lo[balls[i]]), int(self.hi[balls[i]]), np.flatnonzero(open_to[i])
                yield lo, hi, those[squared(self.points[lo:hi], centroids[those]).argmin(1)], None
            inner = ~alone & ~leaf
            balls, open_to = np.repeat(self.child[balls[inner]], 2), np.repeat(open_to[inner], 2, axis=0)
            balls[1::2] += 1


TREE_DDL = "points array<int>, lo array<int>, hi array<int>, child array<int>, radius array<double>, sums array<bigint>"


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).reshape(-1), kind)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``vec_id, point``: floor(scale * x) of every component of the vectors that count."""
    v = F.col(vector_col)
    fit = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    most = F.lit(float(MOST))
    return vectors.where(fit).select(F.col(id_col).alias("vec_id"), F.transform(v, lambda x: F.when(F.abs(x.cast("double") * scale) < most, F.floor(x.cast("double") * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for whole-number distances")).cast("int"))).alias("point"))


def build_trees(points: DataFrame, dims: int) -> DataFrame:
    """A row a tree: ``ids`` and the columns of ``TREE_DDL``, from ``vec_id, point``."""
    kind = points.schema["vec_id"].dataType.simpleString()

    def tree(ids: pa.Array, flat: np.ndarray) -> pa.RecordBatch:
        built, order = Tree.build(flat.reshape(-1, dims).astype(np.int64))
        own = ids.take(pa.array(order))
        columns = [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), _list(built.points, pa.int32()), *[_list(x, pa.int32()) for x in (built.lo, built.hi, built.child)], _list(built.radius, pa.float64()), _list(built.sums, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["ids", "points", "lo", "hi", "child", "radius", "sums"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("balltree")
        held: list[tuple[pa.Array, np.ndarray]] = []
        n = 0
        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, TREE - n)
                held.append((part.column(0), part.column(1).flatten().to_numpy()))
                n, at = n + len(part), at + len(part)
                if n == TREE:
                    yield tree(pa.concat_arrays([x for x, _ in held]), np.concatenate([x for _, x in held]))
                    held, n = [], 0
        if n:
            yield tree(pa.concat_arrays([x for x, _ in held]), np.concatenate([x for _, x in held]))

    return points.mapInArrow(run, f"ids array<{kind}>, {TREE_DDL}")


def _trees(batches: Iterable[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array | None, Tree]]:
    """Stored trees, one after the other; ids where they were read."""
    for batch in batches:
        enter("balltree")
        names = batch.schema.names
        for row in range(len(batch)):
            x = {c: batch.column(names.index(c))[row].values for c in names}
            whole = {c: x[c].to_numpy() for c in names if c != "ids"}
            yield x.get("ids"), Tree(whole["points"].reshape(-1, dims).astype(np.int64), whole["lo"], whole["hi"], whole["child"], whole["radius"], whole["sums"].reshape(-1, dims))


def first_centroids(vectors: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The k vectors whose ids hash lowest, in order of the hashes."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(text, 256), "point").select("point").limit(k).collect()
    return np.array([r["point"] for r in rows], np.int64).reshape(-1, dims)


def move(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of each centroid's vectors; a centroid without any stays."""
    dims = centroids.shape[1]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, tree in _trees(batches, dims):
            for lo, hi, number, whole in tree.assign(centroids):
                if whole is not None:
                    total[number] += whole
                    count[number] += hi - lo
                else:
                    np.add.at(total, number, tree.points[lo:hi])
                    count += np.bincount(number, minlength=len(centroids))
        met = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(count[met]), pa.ListArray.from_arrays(pa.array(np.arange(len(met) + 1) * dims, pa.int32()), pa.array(total[met].reshape(-1)))], ["cluster", "n", "total"])

    parts = trees.drop("ids").mapInArrow(sums, "cluster int, n bigint, total array<bigint>")
    summed = parts.groupBy("cluster").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.col("total")[j].cast("decimal(38,0)")).alias(f"t{j}") for j in range(dims)])
    out = centroids.copy()
    for r in summed.collect():  # k rows at most
        out[r["cluster"]] = [int(r[f"t{j}"]) // int(r["n"]) for j in range(dims)]
    return out


def assigned(trees: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector."""
    dims = centroids.shape[1]
    kind = trees.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, dims):
            number = np.zeros(len(tree.points), np.int64)
            for lo, hi, own, _ in tree.assign(centroids):
                number[lo:hi] = own
            gap = tree.points - centroids[number]
            yield pa.RecordBatch.from_arrays([ids, pa.array(number, pa.int32()), pa.array((gap * gap).sum(1))], ["vec_id", "cluster", "distance"])

    return trees.select("ids", *(c for c in trees.columns if c != "ids")).mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int, rounds: int, dims: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, seed: int = 2) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia,
    centroid_sha256``: each vector's nearest centroid after ``rounds`` rounds
    from the k vectors that come first, as this module's head says."""
    if k < 1 or rounds < 0 or dims < 1:
        raise ValueError("k and dims must be positive, rounds not negative")
    spark, own = vectors.sparkSession, Scratch()
    whole = whole_vectors(vectors, id_col, vector_col, dims, scale)
    trees = own.write(build_trees(whole, dims), "trees")
    centroids = first_centroids(whole, k, seed, dims)
    for _ in range(rounds if len(centroids) else 0):
        moved = move(trees, centroids)
        if (moved == centroids).all():  # nothing can change any more
            break
        centroids = moved
    rows = materialize(assigned(trees, centroids), "assigned")
    own.remove()
    sums = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    named = [(i, sums.get(i, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    about = spark.createDataFrame(named, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """The same for DuckDB: all distances of all rounds."""
    steps = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS point FROM embeddings
       WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, point) - 1 AS cluster, point FROM (SELECT sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, point FROM kept ORDER BY h, point LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""d{i} AS (SELECT row, v.vec_id, v.point, cluster, CAST(list_sum(list_transform(list_zip(v.point, c.point), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS distance FROM kept AS v CROSS JOIN c{i} AS c),
a{i} AS MATERIALIZED (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""m{i} AS (SELECT cluster, list(total ORDER BY j) AS point FROM (SELECT cluster, j, CAST(floor(sum(point[j]) / count(*)) AS BIGINT) AS total FROM a{i}, range(1, {dims + 1}) AS r(j) GROUP BY cluster, j) GROUP BY cluster),
c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.point, c.point) AS point FROM c{i} AS c LEFT JOIN m{i} AS m USING (cluster))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.point, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN c{rounds} AS c ON a.cluster = c.cluster
"""
