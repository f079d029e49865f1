"""Decompositions in blocks against numpy."""

import numpy as np
import pyarrow as pa
import pytest

from sitemill.operators import aggregation, wide
from sitemill.storage import cut


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("EDGE", 24), ("COMPONENTS", 8), ("FAN", 2)):
        monkeypatch.setattr(wide, name, value)


def clients(spark, sides, decay=1.0, seed=0):
    """Factor rows, weights and the mean update of each base."""
    rng, rows, mean = np.random.default_rng(seed), [], {}
    total = sum(range(1, 7))
    for base, (m, n, rank) in sides.items():
        mean[base] = np.zeros((m, n))
        for c in range(6):
            k = rank + c % 3
            b, a = rng.normal(size=(m, k)), rng.normal(size=(k, n)) * (decay ** (np.arange(k) + k * c))[:, None]
            mean[base] += (c + 1) / total * b @ a
            rows += [(c, base, "A", r, a[r].tolist()) for r in range(k)] + [(c, base, "B", r, b[:, r].tolist()) for r in range(k)]
    frame = spark.createDataFrame(rows, "client int, base string, factor string, r int, vec array<double>").repartition(4)
    return frame, spark.createDataFrame([(c, float(c + 1)) for c in range(6)], "client int, w double"), mean


def sides_of(found, base):
    sides = {f: [r["vec"] for r in sorted((r for r in found if r["base"] == base and r["factor"] == f), key=lambda r: r["r"])] for f in "AB"}
    return np.array(sides["B"]).T, np.array(sides["A"])


def check(found, mean, target):
    for base, m in mean.items():
        b, a = sides_of(found, base)
        assert b.shape == (m.shape[0], target) and a.shape == (target, m.shape[1])
        u, s, vt = np.linalg.svd(m, full_matrices=False)
        k = min(target, len(s))
        assert np.allclose(b @ a, u[:, :k] * s[:k] @ vt[:k], atol=1e-6 * s[0])
        kept = int((s[:k] > 1e-9 * s[0]).sum())
        assert np.allclose(b[:, :kept].T @ b[:, :kept], np.eye(kept), atol=1e-9)
        assert np.allclose(np.linalg.norm(a, axis=1)[:kept], s[:kept], rtol=1e-8)


def test_whole_rank_beside_a_narrow_base(spark, small_blocks):
    """Ranks of x and y add up to more than a task takes; z goes the other way."""
    factors, weights, mean = clients(spark, {"x": (70, 50, 3), "y": (30, 95, 2), "z": (20, 20, 1)})
    found = aggregation.reconstruct(factors, weights, "base", 30, 12).collect()
    check(found, mean, 30)
    exact = {base: sides_of(found, base) for base in mean}
    assert all(np.allclose(b @ a, mean[base], atol=1e-9 * np.abs(mean[base]).max()) for base, (b, a) in exact.items())


def test_the_best_of_less_rank(spark, small_blocks):
    factors, weights, mean = clients(spark, {"x": (61, 47, 4)}, decay=0.7, seed=1)
    check(aggregation.reconstruct(factors, weights, "base", 5, 10).collect(), mean, 5)


def test_zero_products_and_lost_partners(spark, small_blocks):
    rows = [(c, "x", f, r, [0.0] * 40) for c in range(4) for f in "AB" for r in range(4)]
    frame = spark.createDataFrame(rows, "client int, base string, factor string, r int, vec array<double>")
    weights = spark.createDataFrame([(c, 1.0) for c in range(4)], "client int, w double")
    b, a = sides_of(aggregation.reconstruct(frame, weights, "base", 6, 8).collect(), "x")
    assert b.shape == (40, 6) and a.shape == (6, 40) and not b.any() and not a.any()
    with pytest.raises(Exception, match="without their partner"):
        aggregation.reconstruct(frame.where("NOT (client = 2 AND factor = 'B' AND r = 1)"), weights, "base", 6, 8).collect()


def test_a_tree_of_triangles(spark, small_blocks):
    """The triangle of a thin matrix of 9 blocks, and an orthonormal form of
    one whose columns depend on each other."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(9 * 24, 5))
    x[:, 4] = x[:, 0] - 2 * x[:, 1]
    x[:, 3] = x[:, 2] + 1e-9 * x[:, 3]
    rows = [("x", i, 0, x[i * 24 : (i + 1) * 24].reshape(-1).tolist()) for i in range(9)]
    thin = spark.createDataFrame(rows, "base string, at bigint, tag bigint, mat array<double>").repartition(3)
    (r,) = wide.triangles(thin, 5).collect()
    t = np.array(r["mat"]).reshape(5, 5)
    assert r["blocks"] == 9 and np.allclose(t.T @ t, x.T @ x)
    q = np.vstack([np.array(r["mat"]).reshape(-1, 5) for r in sorted(wide.orthonormal(thin, 5).collect(), key=lambda r: r["at"])])
    gram = q.T @ q
    kept = np.diag(gram) > 0.5
    assert kept.sum() == 4 and np.allclose(gram[np.ix_(kept, kept)], np.eye(4), atol=1e-9) and not q[:, ~kept].any()
    assert np.allclose(q @ (q.T @ x), x, atol=1e-6)


def chained(plan):
    """Python processes that a task of this stage has at once; 0 where a stage ends."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return chained(plan.executedPlan())
    below = plan.children()
    held = sum(chained(below.apply(k)) for k in range(below.size())) + ("InArrow" in name)
    assert held <= 1, plan.toString()
    return 0 if "Exchange" in name else held


def test_a_task_has_one_python_process(spark):
    a = spark.createDataFrame([("x", 0, 0, 5, [1.0, 2.0, 3.0, 4.0])], "base string, g bigint, b bigint, tag bigint, mat array<double>")
    thin = spark.createDataFrame([("x", 0, 5, [1.0, 0.0, 1.0, 2.0])], "base string, at bigint, tag bigint, mat array<double>")
    a, thin = cut(a, "a"), cut(thin, "thin")  # so small that Spark would broadcast them
    twice = wide.multiply(a, wide.multiply(a, thin, 2, False), 2, True)
    chained(twice._jdf.queryExecution().executedPlan())
    block, right = np.array([[1, 2], [3, 4]]), np.array([[1, 0], [1, 2]])
    assert np.allclose(twice.first()["mat"], (block.T @ block @ right).reshape(-1))
    turned = wide.turned(thin, wide.triangles(thin, 2, wide._whitening), 2)
    chained(turned._jdf.queryExecution().executedPlan())
    q = np.array(turned.first()["mat"]).reshape(2, 2)
    assert np.allclose(q.T @ q, np.eye(2))


def test_results_go_on_in_small_batches(monkeypatch):
    monkeypatch.setattr(wide, "RESULTS", 100)
    schema = wide._schema(pa.string(), "at")
    found = list(wide._batches(schema.names, (("x", k, np.full(8, float(k))) for k in range(5)), schema))
    assert [b.num_rows for b in found] == [2, 2, 1]
    assert [x for b in found for x in b.column("at").to_pylist()] == list(range(5))
