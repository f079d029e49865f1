"""Label counts by site, with zeros, and the rows of a chart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def label_histogram(split: DataFrame, label: str, classes: DataFrame, site_names: DataFrame) -> DataFrame:
    """``site, idx, cnt`` of every site and class, absent ones with 0. The
    grid is sites times classes; rows are combined before they are shuffled."""
    counts = split.groupBy("site", label).agg(F.count("*").alias("cnt")).select(F.col("site").alias("s"), F.col(label).alias("l"), "cnt")
    grid = site_names.select("site").crossJoin(F.broadcast(classes.select("idx")))
    return grid.join(counts, (F.col("site") == F.col("s")) & (F.col("idx") == F.col("l")), "left").select("site", "idx", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def histogram_text(histogram: DataFrame, classes: DataFrame) -> DataFrame:
    """``site, summary``: ``label=count`` of every class in class order."""
    named = histogram.join(F.broadcast(classes.select(F.col("idx").alias("i"), "code")), F.col("idx") == F.col("i"))
    items = F.sort_array(F.collect_list(F.struct("idx", F.concat_ws("=", "code", F.col("cnt").cast("string")).alias("t"))))
    return named.groupBy("site").agg(F.array_join(F.transform(items, lambda x: x["t"]), ", ").alias("summary"))


def chart_rows(histogram: DataFrame, width: float = 470.0) -> DataFrame:
    """``site, idx, cnt, bar``: bar lengths against the greatest count of any
    site (1 at least), to one decimal."""
    most = F.greatest(F.max("cnt").over(W.Window.partitionBy()), F.lit(1))
    return histogram.select("site", "idx", "cnt", F.round(F.col("cnt") / most * width, 1).alias("bar"))
