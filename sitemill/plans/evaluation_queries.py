"""Queries on predictions, resource logs, feature tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import evaluation, features, sampling, sketches
from ..storage import cut
from ..streaming import rounds as streams
from . import fixtures as X
from . import predict
from .federated_queries import exact


def parse_label(spark: SparkSession, d: str) -> DataFrame:
    return predict.predictions(X.responses(spark, d)).select("model", "item", "label", "pred")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return predict.predictions(X.responses(spark, d)).select("model", "item", "label", "response", "pred", "pred_label")


def preview(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"))


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.accuracy(parse_label(spark, d), ["model"]).select("model", exact("accuracy").alias("accuracy"), "correct", "total", "unparsed")


def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Totals of both models, told by the job that writes the predictions."""
    rows, run = evaluation.observed(predict.predictions(X.responses(spark, d)))
    cut(rows, "predictions")
    return spark.createDataFrame([tuple(run.get[c] for c in ("correct", "total", "unparsed", "longest"))], "correct long, total long, unparsed long, longest int")


def accuracy_delta(spark: SparkSession, d: str) -> DataFrame:
    both = evaluation.accuracy(parse_label(spark, d), ["model"])
    return evaluation.accuracy_delta(both, 0, 1).select(*[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("base", "tuned", "delta")])


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hash_rank(cut(parse_label(spark, d), "parsed"), "item", 42, "idx", ["model"])


def progress(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.progress(_ordered(spark, d), "model", "idx", 50)


def show_examples(spark: SparkSession, d: str) -> DataFrame:
    return _ordered(spark, d).where("idx <= 5").select("model", "idx", "item", "pred")


def batch_ids(spark: SparkSession, d: str) -> DataFrame:
    return _ordered(spark, d).select("model", "item", evaluation.batch_of(F.col("idx"), 16).alias("batch"))


def batched_inference(spark: SparkSession, d: str) -> DataFrame:
    """Two models as batch functions on the same records, then accuracy."""

    def model(shift: int):  # noqa: ANN202
        from ..vocab import LABELS

        return lambda: lambda items: [LABELS[(i * (1 + shift)) % 9] if i % 4 else "Unsure." for i in items]

    records = X.records(spark, d).select("vec_id", "label")
    return evaluation.accuracy(predict.evaluate(records, {"base": model(0), "tuned": model(1)}, "vec_id"), ["model"]).select("model", exact("accuracy").alias("accuracy"), "correct", "total", "unparsed")


def loss_metrics(spark: SparkSession, d: str) -> DataFrame:
    by = X.table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("a"), F.avg("value").alias("b"))
    return by.select("user_id", *evaluation.loss_metrics(F.col("a"), F.col("b"))).select("user_id", *[F.when(F.isnan(c), F.lit(None)).otherwise(F.round(c, 6)).alias(c) for c in ("loss", "eval_loss", "neg_eval_loss")])


def peak_delta(spark: SparkSession, d: str) -> DataFrame:
    by = X.table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("peak"), F.avg("value").alias("start"))
    return by.withColumn("value", evaluation.peak_delta(F.col("peak") - 100, F.col("start"))).select("user_id", exact("value").alias("value"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    labels = X.table(spark, d, "labels")
    return labels.join(X.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") % 1000).alias("score"))


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.roc_auc(_scored(spark, d), "score", "label").select(exact("value").alias("value"))


def pr_auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.pr_auc(_scored(spark, d), "score", "label").select(exact("value").alias("value"))


def class_recall(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.class_recall(parse_label(spark, d)).select("label", exact("recall").alias("recall"))


def balanced_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.balanced_accuracy(parse_label(spark, d)).select(exact("value").alias("value"))


def mask_drop_impute(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "events")
    p = F.col("event_id") % 100
    masked = features.masked(F.col("value"), F.when(p == 0, F.lit(0.5)).when((p < 20) & (F.col("event_type") == "click"), F.lit(0.02)).otherwise(F.lit(0.001)))
    long = e.select("event_id", "event_type", masked.alias("value"), (F.col("event_id") % 3 != 0).alias("train"))
    return features.mask_drop_impute(long, "event_id", "event_type", "value", "train").select("event_id", "event_type", exact("value").alias("value"))


def top_fraction(spark: SparkSession, d: str) -> DataFrame:
    by = X.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("score"))
    return features.top_fraction(by, "l_partkey", "score", 0.01)


def traffic_summary(spark: SparkSession, d: str) -> DataFrame:
    log = X.table(spark, d, "events").select((F.col("user_id") % 3).alias("site"), F.round("value", 2).alias("seconds"), F.length("props").cast("long").alias("upload"), F.col("value").alias("peak"))
    out = features.traffic(log, "site", ["seconds", "upload"], ["peak"])
    return out.select("site", "rounds", F.round("seconds", 2).alias("seconds"), "upload", exact("peak").alias("peak"))


def crosstab(spark: SparkSession, d: str) -> DataFrame:
    e = X.table(spark, d, "embeddings").select((F.col("vec_id") % 4).alias("grp"), "label")
    wide = features.crosstab(e, "grp", "label", list(range(10)))
    return wide.select("grp", *[F.col(str(k)).alias(f"label_{k}") for k in range(10)])


def spaced_select(spark: SparkSession, d: str) -> DataFrame:
    tiles = X.table(spark, d, "embeddings").select((F.col("vec_id") % 5).alias("slide"), F.get("embedding", F.lit(0)).cast("double").alias("score"), ((F.col("vec_id") * 37) % 100).cast("double").alias("x"), ((F.col("vec_id") * 91) % 100).cast("double").alias("y"))
    return features.spaced(tiles, "slide", "score", "x", "y", 10.0)


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts and sums by event type, as a stream over the event files."""
    schema = X.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    done = streams.run_available(streams.windowed_metrics(stream), "windows", ["start", "event_type"])
    return done.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def stream_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds (days) for which all twenty clients have sent, as a stream."""
    schema = X.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    updates = stream.select(F.unix_date(F.to_date("ts")).cast("long").alias("round"), (F.col("user_id") % 20).cast("string").alias("client"), F.lit(1.0).alias("weight"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.run_available(streams.complete_rounds(updates, 20), "rounds")


def stream_answers(spark: SparkSession, d: str) -> DataFrame:
    """Purchases within ten hours of a client's view, as a join of two streams."""
    schema = X.table(spark, d, "events").schema

    def of(kind: str) -> DataFrame:
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
        return stream.where(F.col("event_type") == kind).select(F.col("user_id").alias("client"), F.col("ts").cast("timestamp").alias("ts"))

    found = streams.run_available(streams.answered(of("view"), of("purchase"), "10 HOURS"), "answers")
    return found.select("client", F.unix_micros("asked_at").alias("asked_at"), F.unix_micros("answered_at").alias("answered_at"))


def sketch_medians(spark: SparkSession, d: str) -> DataFrame:
    """Medians and numbers of parts by return flag, merged from sketches of
    each line number; whether they are as near as stated."""
    lines = X.table(spark, d, "lineitem")
    parts = cut(sketches.sketched(lines, ["l_returnflag", "l_linenumber"], "l_extendedprice", "l_partkey"), "sketches")
    of = cut(sketches.merged(parts, ["l_returnflag"]).select("l_returnflag", "n", "lost", sketches.quantile(0.5).alias("estimate"), sketches.distinct().alias("parts")), "merged")
    errors = sketches.rank_errors(lines, ["l_returnflag"], "l_extendedprice", of, 0.5).select(F.col("l_returnflag").alias("flag"), "error")
    exact_parts = lines.groupBy(F.col("l_returnflag").alias("other")).agg(F.count_distinct("l_partkey").alias("k"))
    both = of.join(errors, F.col("l_returnflag") == F.col("flag")).join(exact_parts, F.col("l_returnflag") == F.col("other"))
    return both.select("l_returnflag", "n", "lost", (F.col("error") <= sketches.RANK_ERROR).alias("near_median"), (F.abs(F.col("parts") - F.col("k")) <= sketches.COUNT_ERROR * F.col("k")).alias("near_parts"))


_P = f"WITH {X.PARSED}"
_O = f"{_P}, o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY md5('42:' || item), item) AS idx FROM parsed)"
_ACC = f"{_P}, acc AS (SELECT model, CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, CAST(sum(CASE WHEN pred < 0 THEN 1 ELSE 0 END) AS BIGINT) AS unparsed FROM parsed GROUP BY model)"
_S = "WITH s AS (SELECT l.quality AS label, d.n_chars % 1000 AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id), c AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY score), k AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM c)"

_SPACED = """WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY score DESC, x, y) AS i
  FROM (SELECT vec_id % 5 AS slide, CAST(embedding[1] AS DOUBLE) AS score, CAST((vec_id * 37) % 100 AS DOUBLE) AS x, CAST((vec_id * 91) % 100 AS DOUBLE) AS y FROM embeddings)),
g AS (SELECT DISTINCT slide, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, x DOUBLE, y DOUBLE)[]) AS far FROM t
  UNION ALL SELECT g.slide, t.i, CASE WHEN len(far) < 16 AND len(list_filter(far, lambda f: (f.x - t.x) * (f.x - t.x) + (f.y - t.y) * (f.y - t.y) < 400)) = 0 THEN list_append(far, {'i': t.i, 'x': t.x, 'y': t.y}) ELSE far END
  FROM g JOIN t ON t.slide = g.slide AND t.i = g.i + 1),
e AS (SELECT slide, arg_max(far, i) AS far FROM g GROUP BY slide),
m AS (SELECT t.*, list_contains(list_transform(far, lambda f: f.i), t.i) AS is_far FROM t JOIN e ON e.slide = t.slide)
SELECT slide, score, x, y, chosen FROM (SELECT *, CAST(row_number() OVER (PARTITION BY slide ORDER BY CASE WHEN is_far THEN 0 ELSE 1 END, i) AS INTEGER) AS chosen FROM m) WHERE chosen <= 16"""

QUERIES = {
    "parse_label": (parse_label, f"{_P} SELECT model, item, label, pred FROM parsed"),
    "predictions": (predictions, f"{_P} SELECT p.model, p.item, p.label, p.response, p.pred, coalesce(c.canonical, '<unparsed>') AS pred_label FROM parsed p LEFT JOIN classes c ON c.idx = p.pred"),
    "preview": (preview, "SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '...' ELSE text END AS preview FROM documents"),
    "accuracy": (accuracy, f"{_ACC} SELECT model, round(correct / CAST(total AS DOUBLE), 6) + 0.0 AS accuracy, correct, total, unparsed FROM acc"),
    "run_metrics": (run_metrics, f"{_P} SELECT CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, CAST(sum(CASE WHEN pred < 0 THEN 1 ELSE 0 END) AS BIGINT) AS unparsed, CAST(max(length(response)) AS INTEGER) AS longest FROM parsed"),
    "accuracy_delta": (accuracy_delta, f"{_ACC}, b AS (SELECT max(CASE WHEN model = 0 THEN correct / CAST(total AS DOUBLE) END) AS base, max(CASE WHEN model = 1 THEN correct / CAST(total AS DOUBLE) END) AS tuned FROM acc) SELECT round(base, 4) + 0.0 AS base, round(tuned, 4) + 0.0 AS tuned, round(tuned - base, 4) + 0.0 AS delta FROM b"),
    "progress": (progress, f"{_O}, r AS (SELECT model, idx, CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) OVER w AS BIGINT) AS correct_so_far, CAST(sum(CASE WHEN pred < 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS unparsed, max(idx) OVER (PARTITION BY model) AS last FROM o WINDOW w AS (PARTITION BY model ORDER BY idx)) SELECT model, idx, correct_so_far, unparsed FROM r WHERE idx = 1 OR idx = last OR idx % 50 = 0"),
    "show_examples": (show_examples, f"{_O} SELECT model, idx, item, pred FROM o WHERE idx <= 5"),
    "batch_ids": (batch_ids, f"{_O} SELECT model, item, (idx - 1) // 16 AS batch FROM o"),
    "batched_inference": (batched_inference, f"WITH {X.RECORDS}, p AS (SELECT m.model, r.label, CASE WHEN r.vec_id % 4 = 0 THEN -1 ELSE (r.vec_id * m.k) % 9 END AS pred FROM rec r CROSS JOIN (VALUES ('base', 1), ('tuned', 2)) m(model, k)) SELECT model, round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy, CAST(sum(CASE WHEN pred = label THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total, CAST(sum(CASE WHEN pred < 0 THEN 1 ELSE 0 END) AS BIGINT) AS unparsed FROM p GROUP BY model"),
    "loss_metrics": (loss_metrics, "SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS loss, round(avg(value), 6) AS eval_loss, round(-avg(value), 6) AS neg_eval_loss FROM events GROUP BY user_id"),
    "peak_delta": (peak_delta, "SELECT user_id, round(greatest(0.0, max(value) - 100 - avg(value)), 6) + 0.0 AS value FROM events GROUP BY user_id"),
    "roc_auc": (roc_auc, f"{_S} SELECT round(sum(neg * (tp - pos) + CAST(neg * pos AS DOUBLE) / 2) / (sum(pos) * sum(neg)), 6) + 0.0 AS value FROM k"),
    "pr_auc": (pr_auc, f"{_S} SELECT round(sum(CAST(pos * tp AS DOUBLE) / (tp + fp)) / sum(pos), 6) + 0.0 AS value FROM k"),
    "class_recall": (class_recall, f"{_P} SELECT label, round(avg(CASE WHEN pred = label THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) + 0.0 AS recall FROM parsed GROUP BY label"),
    "balanced_accuracy": (balanced_accuracy, f"{_P} SELECT round(avg(x), 6) + 0.0 AS value FROM (SELECT avg(CASE WHEN pred = label THEN CAST(1 AS DOUBLE) ELSE 0 END) AS x FROM parsed GROUP BY label)"),
    "mask_drop_impute": (mask_drop_impute, "WITH l AS (SELECT event_id, event_type, CASE WHEN event_id % 100 = 0 OR (event_id % 100 < 20 AND event_type = 'click') THEN NULL ELSE value END AS value, event_id % 3 <> 0 AS train FROM events), f AS (SELECT event_type, avg(CASE WHEN value IS NULL THEN CAST(1 AS DOUBLE) ELSE 0 END) AS lost, quantile_cont(value, 0.5) AS median FROM l WHERE train GROUP BY event_type) SELECT l.event_id, l.event_type, round(coalesce(l.value, f.median), 6) + 0.0 AS value FROM l JOIN f ON f.event_type = l.event_type WHERE f.lost <= 0.05"),
    "top_fraction": (top_fraction, "WITH s AS (SELECT l_partkey, round(sum(l_quantity), 2) AS score FROM lineitem GROUP BY l_partkey) SELECT l_partkey, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, l_partkey) AS n, count(*) OVER () AS t FROM s) WHERE n <= ceil(t * CAST(0.01 AS DOUBLE))"),
    "traffic_summary": (traffic_summary, "SELECT user_id % 3 AS site, count(*) AS rounds, round(sum(round(value, 2)), 2) AS seconds, CAST(sum(length(props)) AS BIGINT) AS upload, round(max(value), 6) + 0.0 AS peak FROM events GROUP BY ROLLUP (user_id % 3)"),
    "crosstab": (crosstab, "SELECT vec_id % 4 AS grp, " + ", ".join(f"count(*) FILTER (label = {k}) AS label_{k}" for k in range(10)) + " FROM embeddings GROUP BY vec_id % 4"),
    "spaced_select": (spaced_select, _SPACED),
    "stream_windows": (stream_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"),
    "stream_answers": (stream_answers, "SELECT a.user_id AS client, epoch_us(a.ts) AS asked_at, epoch_us(b.ts) AS answered_at FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 HOURS"),
    "sketch_medians": (sketch_medians, "SELECT l_returnflag, count(*) AS n, CAST(0 AS BIGINT) AS lost, true AS near_median, true AS near_parts FROM lineitem GROUP BY 1"),
    "stream_rounds": (stream_rounds, "SELECT date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS round, CAST(20 AS INTEGER) AS clients, CAST(20.0 AS DOUBLE) AS weight FROM events GROUP BY 1 HAVING count(DISTINCT user_id % 20) = 20"),
}
