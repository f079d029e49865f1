"""Rounds and answers as joins of streams, over several batches; sketches."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from sitemill.operators import sketches
from sitemill.streaming import rounds as streams

START = dt.datetime(2024, 1, 1)


def files_of(spark, folder, schema, batches):
    """A stream that reads one batch after the other."""
    kinds = [part.split()[1] for part in schema.split(", ")]
    for rows in batches:
        made = [tuple(START + dt.timedelta(minutes=x) if kind == "timestamp" and x is not None else x for x, kind in zip(r, kinds, strict=True)) for r in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_doubled_and_missing_clients(spark, tmp_path):
    asked = files_of(spark, tmp_path / "asked", "round long, client string, opens timestamp", [[(1, "a", 0.0), (1, "b", 0.0), (1, "c", 0.0), (1, "d", 0.0)], [(2, "a", 60.0)], [(3, "a", 300.0)], [(4, "a", 600.0)], [(5, "a", 900.0)]])
    sent = files_of(spark, tmp_path / "sent", "round long, client string, ts timestamp, weight double", [
        [(1, "a", 5.0, 1.0), (1, "a", 6.0, 9.0), (1, "b", 45.0, 2.0), (9, "x", 5.0, 1.0)],
        [(1, "d", 29.0, 4.0), (2, "a", 61.0, 5.0), (1, "a", 7.0, 9.0)],
        [(3, "a", 301.0, 6.0)],
        [(4, "a", 601.0, 7.0), (2, "a", 62.0, 9.0), (1, "c", 10.0, 3.0)],  # c's comes hours behind the newest
        [(5, "a", 901.0, 8.0)],
    ])
    stream = streams.attended(asked, sent, "30 MINUTES", "20 minutes")
    out = tmp_path / "out"
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(((r["round"], r["client"], r["weight"]) for r in spark.read.parquet(str(out)).collect()), key=str)
    settled = [r for r in got if r[0] < 4]
    # b sent after the end, c too late, a twice; the others once
    assert settled == [(1, "a", 1.0), (1, "b", None), (1, "c", None), (1, "d", 4.0), (2, "a", 5.0), (3, "a", 6.0)]
    assert set(got) - set(settled) <= {(4, "a", 7.0), (5, "a", 8.0)}
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 6 and held[-1] <= 6  # rounds that are over are not held any more


def test_answers_within_a_time(spark, tmp_path):
    asked = files_of(spark, tmp_path / "q", "client long, ts timestamp", [[(1, 0.0), (2, 0.0), (None, 0.0)], [(1, 100.0)]])
    answers = files_of(spark, tmp_path / "r", "client long, ts timestamp", [[(1, 0.0), (1, 10.0), (2, 11.0), (None, 1.0)], [(1, 105.0), (1, 9.0)]])
    found = streams.run_available(streams.answered(asked, answers, "10 MINUTES", "200 minutes"), "answers").collect()
    minutes = lambda t: (t - START).total_seconds() / 60
    assert sorted((r["client"], minutes(r["asked_at"]), minutes(r["answered_at"])) for r in found) == [(1, 0, 9), (1, 0, 10), (1, 100, 105)]


def test_sketches_of_parts_are_those_of_all(spark):
    rows = spark.range(200_000).select((F.col("id") % 7).alias("part"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 1000 == 1, None).otherwise("b").alias("g"), F.when(F.col("id") % 10 > 0, (F.col("id") * 7919 % 200_003).cast("double")).alias("x"), (F.col("id") % 5000).alias("k"))
    parts = sketches.sketched(rows, ["part", "g"], "x", "k")
    assert parts.selectExpr("max(octet_length(quantiles))").first()[0] < 40_000
    whole = sketches.merged(parts, ["g"])
    for share in (0.0, 0.1, 0.5, 0.99, 1.0):
        errors = sketches.rank_errors(rows, ["g"], "x", whole.select("g", sketches.quantile(share).alias("estimate")), share).collect()
        assert len(errors) == 3 and all(r["error"] <= 2 * sketches.RANK_ERROR for r in errors)
    exact = {r["g"]: r for r in rows.groupBy("g").agg(F.count("x").alias("n"), F.count_if(F.isnull("x")).alias("lost"), F.countDistinct("k").alias("k")).collect()}
    for r in whole.withColumn("keys", sketches.distinct()).collect():
        assert (r["n"], r["lost"]) == (exact[r["g"]]["n"], exact[r["g"]]["lost"])
        assert abs(r["keys"] - exact[r["g"]]["k"]) <= 2 * sketches.COUNT_ERROR * exact[r["g"]]["k"]


def test_sketches_without_values(spark):
    odd = spark.createDataFrame([("a", None, 1), ("a", float("nan"), 2), ("b", 1.0, None)], "g string, x double, part int")
    parts = sketches.sketched(odd, ["g", "part"], "x")
    got = {r["g"]: (r["n"], r["lost"], r["q"], r["k"]) for r in sketches.merged(parts, ["g"]).select("g", "n", "lost", sketches.quantile(0.5).alias("q"), sketches.distinct().alias("k")).collect()}
    assert got == {"a": (0, 2, None, 1), "b": (1, 0, 1.0, 1)}
    assert sketches.merged(sketches.sketched(odd.limit(0), ["g", "part"], "x"), ["g"]).count() == 0
    with pytest.raises(ValueError):
        sketches.quantile(1.5)
