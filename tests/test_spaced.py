"""Spaced selection in rounds against the greedy order."""

import math
import random
from collections import defaultdict

import pytest

from sitemill.operators import features

SCHEMA = "slide string, score double, x double, y double, _p int"


def greedy(rows, width, most):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    out = set()
    for g, own in groups.items():
        def order(r):
            lacks = r[1] is None or math.isnan(r[1])
            return (lacks, 0.0 if lacks else -r[1], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or 0)

        own = sorted(own, key=order)
        far, rest = [], []
        for r in own:
            if len(far) < most and r[2] is not None and r[3] is not None and all((r[2] - q[2]) ** 2 + (r[3] - q[3]) ** 2 >= (2 * width) ** 2 for q in far):
                far.append(r)
            else:
                rest.append(r)
        for i, r in enumerate(far + rest[: most - len(far)]):
            out.add((g, i + 1, *map(repr, r[1:4])))
    return out


def got(frame, width, most):
    return {(r["slide"], r["chosen"], *map(repr, (r["score"], r["x"], r["y"]))) for r in features.spaced(frame, "slide", "score", "x", "y", width, most).collect()}


@pytest.mark.parametrize(("width", "most"), [(0.5, 16), (4.0, 5), (3.0, 40)])
def test_rounds_choose_as_the_order_does(spark, width, most):
    rng = random.Random(width)
    rows = []
    for i in range(500):
        slide = rng.choice(["hot", "hot", "a", None, ""])
        rows.append((slide, rng.choice([None, float(rng.randint(0, 30)), rng.random()]), rng.choice([None, *[float(rng.randint(-10, 10)) for _ in range(30)]]), float(rng.randint(-10, 10)) + rng.choice([0.0, 0.25]), 1))
    rows += [("same", 1.0, 2.0, 2.0, 1)] * 60 + [("few", 3.0, 0.0, 0.0, 1), ("few", 2.0, 1e6, -1e6, 1), ("few", float("nan"), 5.0, 5.0, 1), ("placeless", 9.0, None, 1.0, 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(frame, width, most) == greedy(rows, width, most)


def test_a_slope_takes_no_more_rounds_than_tiles(spark):
    """Scores that fall along a line settle one cell after the other."""
    rows = [("s", -float(i), i / 4, 0.0, 1) for i in range(300)]
    assert got(spark.createDataFrame(rows, SCHEMA), 1.0, 6) == greedy(rows, 1.0, 6)


def test_exactly_two_widths_are_apart(spark):
    rows = [("s", float(-i), 20.0 * i, 0.0, 1) for i in range(4)] + [("s", 10.0, 19.999, 0.0, 1)]
    assert got(spark.createDataFrame(rows, SCHEMA), 10.0, 4) == greedy(rows, 10.0, 4)


def test_empty_and_refused(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert features.spaced(empty, "slide", "score", "x", "y", 1.0).count() == 0
    for bad in ((0, 4), (1.0, 0)):
        with pytest.raises(ValueError):
            features.spaced(empty, "slide", "score", "x", "y", *bad)
