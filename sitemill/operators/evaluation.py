"""Evaluation of predictions: accuracy, deltas, progress, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..storage import cut


def accuracy(predictions: DataFrame, by: list[str]) -> DataFrame:
    """``by, accuracy, correct, total, unparsed``; -1 never matches."""
    right = F.count_if(F.col("pred") == F.col("label"))
    return predictions.groupBy(*by).agg(F.coalesce(F.try_divide(right, F.count("*")), F.lit(0.0)).alias("accuracy"), right.alias("correct"), F.count("*").alias("total"), F.count_if(F.col("pred") < 0).alias("unparsed"))


def observed(predictions: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """The predictions and what a tracker wants of them, counted while they are
    used: ``correct``, ``total``, ``unparsed`` and ``longest`` response come
    with the first job that reads all rows, at no second pass. ``get`` waits
    for that job."""
    run = Observation(name)
    counted = [F.count_if(F.col("pred") == F.col("label")).alias("correct"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("pred") < 0).alias("unparsed")]
    longest = [F.max(F.length("response")).alias("longest")] if "response" in predictions.columns else []
    return predictions.observe(run, *counted, *longest), run


def accuracy_delta(accuracies: DataFrame, base: object, tuned: object) -> DataFrame:
    """``base, tuned, delta`` of two models' accuracies; no row without both."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("accuracy")))
    return accuracies.agg(pick(base).alias("base"), pick(tuned).alias("tuned")).where("base IS NOT NULL AND tuned IS NOT NULL").withColumn("delta", F.col("tuned") - F.col("base"))


#: Rows whose running counts one task makes.
BLOCK = 1 << 16


def progress(predictions: DataFrame, by: str, order: str, every: int) -> DataFrame:
    """Running counts at the first, each ``every``-th and the last row of each
    model. ``order`` is the rows' place from 1, which the caller has ranked.

    Places are cut into blocks; counts run inside a block and add those of the
    blocks before, a table of a row for each ``BLOCK`` rows.
    """
    rows = cut(predictions.select(by, order, (F.col("pred") == F.col("label")).cast("long").alias("hit"), (F.col("pred") < 0).cast("long").alias("lost"), F.floor((F.col(order) - 1) / BLOCK).alias("block")), "progress")
    sums = rows.groupBy(by, "block").agg(F.sum("hit").alias("h"), F.sum("lost").alias("l"), F.max(order).alias("top"))
    before = W.Window.partitionBy(by).orderBy("block").rowsBetween(W.Window.unboundedPreceding, -1)
    bases = sums.select(F.col(by).alias("of"), F.col("block").alias("b"), F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"), F.coalesce(F.sum("l").over(before), F.lit(0)).alias("l0"), F.max("top").over(W.Window.partitionBy(by)).alias("last"))
    inside = W.Window.partitionBy(by, "block").orderBy(order)
    counted = rows.withColumn("h", F.sum("hit").over(inside)).withColumn("l", F.sum("lost").over(inside))
    joined = counted.join(bases, (F.col(by).eqNullSafe(F.col("of"))) & (F.col("block") == F.col("b")))
    shown = (F.col(order) == 1) | (F.col(order) == F.col("last")) | (F.col(order) % every == 0)
    return joined.where(shown).select(by, F.col(order).alias("idx"), (F.col("h") + F.col("h0")).alias("correct_so_far"), (F.col("l") + F.col("l0")).alias("unparsed"))


def batch_of(place: Column, size: int) -> Column:
    if size < 1:
        raise ValueError("a batch has a row at least")
    return F.floor((place - 1) / size).cast("long")


def loss_metrics(loss: Column, eval_loss: Column) -> list[Column]:
    """Loss and evaluation loss, absent ones NaN, and the latter's negative."""
    nan = F.lit(float("nan"))
    return [F.coalesce(loss, nan).alias("loss"), F.coalesce(eval_loss, nan).alias("eval_loss"), (-F.coalesce(eval_loss, nan)).alias("neg_eval_loss")]


def peak_delta(peak: Column, start: Column) -> Column:
    return F.greatest(F.lit(0.0), peak - start)


def score_counts(scored: DataFrame, score: str, label: str) -> DataFrame:
    """``score, pos, neg``, combined on the map side: ties are one row."""
    return scored.groupBy(F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))


def _cumulated(counts: DataFrame) -> DataFrame:
    """Rows with positives and negatives strictly above each score. Scores are
    dealt to ranges by the sort itself; sums of ranges are a small table."""
    buckets = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = counts.repartitionByRange(buckets, F.col("score").desc())
    marked = dealt.withColumn("part", F.spark_partition_id())
    marked = cut(marked, "scores")
    w = W.Window.partitionBy("part").orderBy(F.col("score").desc()).rowsBetween(W.Window.unboundedPreceding, 0)
    inner = marked.withColumn("tp", F.sum("pos").over(w)).withColumn("fp", F.sum("neg").over(w))
    sums = marked.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    base = sums.select(F.col("part").alias("q"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    return inner.join(F.broadcast(base), F.col("part") == F.col("q")).select("score", "pos", "neg", (F.col("tp") + F.col("p0")).alias("tp"), (F.col("fp") + F.col("n0")).alias("fp"))


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """The share of (positive, negative) pairs in the right order, ties half;
    null without both kinds."""
    rows = _cumulated(score_counts(scored, score, label))
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2)
    return rows.agg((won / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("value"))


def pr_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Average precision: precision at each score, weighted by recall gained."""
    rows = _cumulated(score_counts(scored, score, label))
    return rows.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.sum("pos"), F.lit(0))).alias("value"))


def class_recall(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label").agg((F.count_if(F.col("pred") == F.col("label")) / F.count("*")).alias("recall"))


def balanced_accuracy(predictions: DataFrame) -> DataFrame:
    return class_recall(predictions).agg(F.avg("recall").alias("value"))
