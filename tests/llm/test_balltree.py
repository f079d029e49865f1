"""Ball trees against plain clustering in whole numbers."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pytest

from sitemill.llm import balltree, queries

SCHEMA = "id long, vec array<float>, cluster string, distance string, ids string, points string"


def plain(rows, k, rounds, dims, scale=256, seed=2):
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, own, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, j in found:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for i, d, j in found)


def got(spark, rows, **how):
    frame = spark.createDataFrame([(i, v, "c", "d", "i", "p") for i, v in rows], SCHEMA).repartition(3)
    found = balltree.cluster(frame, id_col="id", vector_col="vec", **how)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return Counter(tuple(r) for r in found.collect())


def vectors(n, dims, rng):
    centres = rng.normal(0, 1, (6, dims))
    return [(i, [float(x) for x in np.float32(centres[rng.integers(6)] + rng.normal(0, 0.1, dims))]) for i in range(n)]


@pytest.mark.parametrize("dims", [1, 3, 64])
def test_odd_vectors_against_plain_clustering(spark, dims):
    rng = np.random.default_rng(dims)
    rows = vectors(150, dims, rng)
    rows += [(1, None), (2, []), (3, [0.0] * (dims + 1)), (4, [float("nan")] * dims), (5, [float("inf")] * dims), (6, [None] * dims), (None, rows[0][1]), (None, rows[1][1])]
    rows += [(1000 + i, rows[7][1]) for i in range(80)]  # a hot vector
    rows += [(9, rows[20][1]), rows[9], rows[9], (2000, [-1.0] * dims), (2001, [0.001] * dims), (2002, [-0.001] * dims), (2003, [3e3] * dims)]
    assert got(spark, rows, k=7, rounds=5, dims=dims) == plain(rows, 7, 5, dims)


def test_ties_go_to_the_lowest_number(spark):
    rows = [(i, [float(x)]) for i, x in enumerate([0, 2, 4, 6, 1, 3, 5, 1, 3, 5])]
    assert got(spark, rows, k=4, rounds=0, dims=1, scale=1) == plain(rows, 4, 0, 1, 1)
    assert got(spark, rows, k=10, rounds=3, dims=1, scale=1) == plain(rows, 10, 3, 1, 1)
    same = [(i, [1.0, 1.0]) for i in range(30)]
    assert got(spark, same, k=5, rounds=3, dims=2) == plain(same, 5, 3, 2)
    assert got(spark, same, k=50, rounds=1, dims=2) == plain(same, 50, 1, 2)


def test_empty_tables_and_refusals(spark):
    assert not got(spark, [], k=3, rounds=2, dims=2)
    assert not got(spark, [(1, None), (2, [1.0])], k=3, rounds=2, dims=2)
    for bad in ({"k": 0, "rounds": 1, "dims": 1}, {"k": 1, "rounds": -1, "dims": 1}, {"k": 1, "rounds": 1, "dims": 0}):
        with pytest.raises(ValueError):
            got(spark, [], **bad)
    with pytest.raises(Exception, match="too large"):
        got(spark, [(1, [3e30, 0.0])], k=1, rounds=1, dims=2)


def test_large_whole_numbers_stay_exact(spark):
    rows = [(i, [float(x), -float(x)]) for i, x in enumerate([2**17, 2**17 + 1, 2**17 - 1, 0, 1, 2**16])]
    assert got(spark, rows, k=3, rounds=4, dims=2) == plain(rows, 3, 4, 2)
    x = np.array([[balltree.MOST - 1] * 64, [1 - balltree.MOST] * 64])
    assert balltree.squared(x, x)[0, 1] == 64 * (2 * balltree.MOST - 2) ** 2


def test_balls_are_given_whole():
    """On grouped vectors most distances are never computed; the balls' counts,
    sums and radii are those of their vectors, and all rows are met once."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-3000, 3000, (12, 64))
    points = (centres[rng.integers(0, 12, 4096)] + rng.integers(-40, 40, (4096, 64))).astype(np.int64)
    tree, order = balltree.Tree.build(points)
    assert (tree.points == points[order]).all() and sorted(order.tolist()) == list(range(4096))
    for lo, hi, radius, total in zip(tree.lo, tree.hi, tree.radius, tree.sums, strict=True):
        own = tree.points[lo:hi]
        assert (own.sum(0) == total).all()
        assert np.isclose(radius, np.sqrt(((own - total / len(own)) ** 2).sum(1)).max())
    number, whole = np.full(4096, -1), 0
    for lo, hi, own, total in tree.assign(centres.astype(np.int64)):
        assert (number[lo:hi] == -1).all()
        number[lo:hi] = own
        if total is not None:
            whole += hi - lo
            assert (tree.points[lo:hi].sum(0) == total).all()
    assert (number == balltree.squared(tree.points, centres.astype(np.int64)).argmin(1)).all()
    assert whole > 4000


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    path = f"{folder}/embeddings.parquet"
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = queries.op11_ball_tree(spark, folder)
    want = con.sql(queries.ORACLES["op11_ball_tree"])
    order = [want.columns.index(c) for c in found.columns]
    assert Counter(map(tuple, found.collect())) == Counter(tuple(r[i] for i in order) for r in want.fetchall())
