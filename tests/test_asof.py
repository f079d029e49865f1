"""As-of joins against a loop, with hot keys over many parts."""

import random
from collections import Counter

import pytest

from sitemill.operators.asof import asof_join

LEFT, RIGHT = "k string, j int, t int, v int", "k string, j int, at int, seq int, x string"


def by_hand(left, right, strict):
    out = []
    for k, j, t, v in left:
        met = [r for r in right if None not in (k, j, t, r[2]) and r[:2] == (k, j) and (r[2] < t or (r[2] == t and not strict))]
        best = max(met, key=lambda r: (r[2], r[3] is not None, r[3] or 0), default=(None,) * 5)
        out.append((k, j, t, v, best[4], best[3]))
    return Counter(out)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("seed", range(3))
def test_against_a_loop(spark, strict, seed):
    rng = random.Random(seed)
    pick = lambda n: (rng.choice(["hot"] * 6 + ["a", "", None]), rng.choice([1, 1, 1, None]), rng.choice([None, *range(n)]))
    left = [(*pick(400), i) for i in range(500)]
    used, right = set(), []
    for i in range(90 if seed else 3):
        k, j, at = pick(400)
        seq = rng.choice([None, rng.randint(0, 9)])
        if (k, j, at, seq) not in used:
            used.add((k, j, at, seq))
            right.append((k, j, at, seq, f"x{i}" if i % 9 else None))
    got = asof_join(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(2), ["k", "j"], "t", "at", ["x", "seq"], ["seq"], strict)
    assert got.columns == ["k", "j", "t", "v", "x", "seq"]
    assert Counter(tuple(r) for r in got.collect()) == by_hand(left, right, strict)


def test_one_newest_row_for_parts_without_any(spark):
    """All rows have one key; the only other row lies before them all."""
    left = spark.range(5000).selectExpr("'k' AS k", "1 AS j", "CAST(id AS INT) AS t", "CAST(id AS INT) AS v")
    right = spark.createDataFrame([("k", 1, -5, 0, "old"), ("k", 1, 4990, 0, "new"), ("other", 1, 10, 0, "no")], RIGHT)
    got = asof_join(left, right, ["k", "j"], "t", "at", ["x"])
    assert {tuple(r) for r in got.groupBy("x").count().collect()} == {("old", 4990), ("new", 10)}


def test_empty_sides_and_clashes(spark):
    left, right = spark.createDataFrame([("k", 1, 1, 1)], LEFT), spark.createDataFrame([], RIGHT)
    assert [tuple(r) for r in asof_join(left, right, ["k", "j"], "t", "at", ["x"]).collect()] == [("k", 1, 1, 1, None)]
    assert asof_join(left.limit(0), right, ["k", "j"], "t", "at", ["x"]).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        asof_join(left, right, ["k", "j"], "t", "at", ["k"])
