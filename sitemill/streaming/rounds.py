"""Streams: metrics by time window, and the barrier of a round."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from ..storage import own_path


def windowed_metrics(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start, event_type, n, total`` of each window, for streams and tables."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def complete_rounds(updates: DataFrame, n_clients: int, late: str = "1 day") -> DataFrame:
    """``round, clients, weight`` of each round once all of its clients have
    sent. ``updates`` has ``round, client, weight`` and the time ``ts``. A round
    is held as its clients and the sum of their weights (factors stay in
    storage) until the watermark passes its last update; one that is not
    complete by then is never given, and what comes later is dropped."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        clients, weight, done, last = (set(state.get[0]), *state.get[1:]) if state.exists else (set(), 0.0, False, 0)
        for rows in batches:
            last = max(last, int(rows["ts"].max().timestamp() * 1000))
            for c, w in zip(rows["client"], rows["weight"], strict=True):
                if c not in clients:
                    clients.add(c)
                    weight += w
        full = len(clients) >= n_clients
        state.update((sorted(clients), weight, done or full, last))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        if full and not done:
            yield pd.DataFrame({"round": [key[0]], "clients": [len(clients)], "weight": [weight]})

    return updates.withWatermark("ts", late).groupBy("round").applyInPandasWithState(step, "round long, clients int, weight double", "clients array<string>, weight double, done boolean, last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that is there now and gives its result. Batches
    are written to the shared folder, not gathered. With ``keys`` a batch gives
    the rows that it changes, and of each key the last batch's row stands, so
    state older than the watermark need not be held."""
    spark: SparkSession = stream.sparkSession
    base = own_path(spark, name)
    numbered = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{base}/out/{number}")

    spark.createDataFrame([], numbered).write.parquet(f"{base}/out/start")
    stream.writeStream.outputMode("update" if keys else "append").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(numbered).option("recursiveFileLookup", True).parquet(f"{base}/out")
    if not keys:
        return out.drop("_batch")
    newest = W.Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return out.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "_batch")


def attended(announced: DataFrame, updates: DataFrame, open_for: str, late: str = "10 minutes") -> DataFrame:
    """``round, client, opens, sent_at, weight`` of every client that a round
    was announced to: its update while the round was open (from ``opens`` for
    ``open_for``), or nulls once the watermark says that none can come any more.

    ``announced`` has ``round, client, opens``, ``updates`` have ``round,
    client, ts, weight``; both are streams. An update that comes twice within
    ``late`` counts once; one that is later than ``late`` behind the newest, or
    outside its round's time, counts for none. Both sides' state goes as the
    watermark passes what they could meet.
    """
    once = updates.select("round", "client", F.col("ts").alias("sent_at"), "weight").withWatermark("sent_at", late).dropDuplicatesWithinWatermark(["round", "client"])
    asked = announced.select("round", "client", "opens").withWatermark("opens", late)
    u, a = once.alias("u"), asked.alias("a")
    met = (F.col("a.round") == F.col("u.round")) & (F.col("a.client") == F.col("u.client")) & (F.col("u.sent_at") >= F.col("a.opens")) & (F.col("u.sent_at") < F.col("a.opens") + F.expr(f"INTERVAL {open_for}"))
    return a.join(u, met, "left_outer").select("a.round", "a.client", "a.opens", "u.sent_at", "u.weight")


def answered(asked: DataFrame, answers: DataFrame, within: str, late: str = "10 minutes") -> DataFrame:
    """``client, asked_at, answered_at`` of all answers of a client within a
    time of what it was asked: an interval join of streams of ``client, ts``."""
    q = asked.select("client", F.col("ts").alias("asked_at")).withWatermark("asked_at", late).alias("q")
    r = answers.select("client", F.col("ts").alias("answered_at")).withWatermark("answered_at", late).alias("r")
    met = (F.col("q.client") == F.col("r.client")) & (F.col("r.answered_at") > F.col("q.asked_at")) & (F.col("r.answered_at") <= F.col("q.asked_at") + F.expr(f"INTERVAL {within}"))
    return q.join(r, met).select("q.client", "q.asked_at", "r.answered_at")
