"""Rows with null keys are kept, and bounds hold."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitemill.operators import evaluation, sampling, splits
from sitemill.sources import sinks


@pytest.fixture(scope="module")
def keyed(spark):
    """400 rows, 40 of them without a key."""
    return spark.range(400).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("key"), (F.col("id") % 5).cast("int").alias("label"), F.col("id").alias("row"))


def test_ranks_count_null_keys(spark, keyed):
    for n in (None, 400, 1000):
        got = sampling.sample(keyed, "key", n, 1).collect()
        assert sorted(r["pos"] for r in got) == list(range(1, 401)) and {r["row"] for r in got} == set(range(400))
    assert [r["pos"] for r in sampling.sample(keyed, "key", 30, 1).orderBy("pos").collect()] == list(range(1, 31))
    inside = sampling.hash_rank(keyed, "key", 3, "pos", ["label"]).collect()
    assert Counter((r["label"], r["pos"]) for r in inside) == Counter((k, p) for k in range(5) for p in range(1, 81))
    assert sampling.round_subset(keyed, "key", 0, 2).count() == 400


@pytest.mark.parametrize("strategy", ["random", "heterogeneous"])
def test_splits_keep_null_keys(keyed, strategy):
    if strategy == "random":
        got = splits.split_random(keyed, "key", 3, 20).collect()
    else:
        got = splits.split_quota(keyed, "key", "label", 5, 3, 20).collect()
    assert len(got) == 400 and sum(r["key"] is None for r in got) == 40
    assert sorted(Counter(r["site"] for r in got).values()) == [133, 133, 134]
    assert Counter(r["split"] for r in got)["validation"] == 60


def test_progress_counts_null_items(spark, keyed):
    parsed = keyed.select(F.lit("m").alias("model"), F.col("key").alias("item"), "label", (F.col("row") % 5).cast("int").alias("pred"))
    ordered = sampling.hash_rank(parsed, "item", 42, "idx", ["model"])
    rows = evaluation.progress(ordered, "model", "idx", 100).orderBy("idx").collect()
    assert [(r["idx"], r["correct_so_far"]) for r in rows] == [(1, 1), (100, 100), (200, 200), (300, 300), (400, 400)]


@pytest.mark.parametrize("most", [1, 7, 1000])
def test_arrays_are_never_longer(spark, tmp_path, most):
    """Also where all records are equal, or the group is null."""
    same = spark.range(3000 if most > 1 else 20).selectExpr("'a' AS image", "1 AS label", "CAST(NULL AS string) AS raw_label")
    sinks.write_arrays(same.union(spark.createDataFrame([("b", 2, "X")], "image string, label int, raw_label string")), str(tmp_path / "out"), F.col("raw_label"), most)
    arrays = [json.loads(line) for p in (tmp_path / "out").glob("part-*") for line in p.read_text().splitlines()]
    assert max(map(len, arrays)) <= most and sum(map(len, arrays)) == (3001 if most > 1 else 21)
    assert all(len({r.get("raw_label") for r in a}) == 1 for a in arrays)
    with pytest.raises(ValueError):
        sinks.write_arrays(same, str(tmp_path / "none"), F.col("raw_label"), 0)


def test_weighted_choices(spark):
    """Draws fall to candidates as often as their weights say, and to none of weight 0."""
    def picked(weights, u):
        return spark.range(1).select(splits.weighted_choice(F.array(*[F.lit(float(w)) for w in weights]).cast("array<double>"), F.lit(u)).alias("x")).first()["x"]

    assert [picked([1, 0, 3], u) for u in (0.0, 0.25, 0.2500001, 0.999)] == [0, 0, 2, 2]
    assert [picked([0, 0], u) for u in (0.0, 0.49, 0.5, 1.0)] == [0, 0, 1, 1] and picked([], 0.5) is None
    many = spark.range(20_000).select(splits.weighted_choice(F.array(F.lit(1.0), F.lit(0.0), F.lit(4.0)), splits.uniform(F.col("id"), 7)).alias("x")).groupBy("x").count()
    shares = {r["x"]: r["count"] / 20_000 for r in many.collect()}
    assert set(shares) == {0, 2} and abs(shares[0] - 0.2) < 0.01
