"""Sketches of columns that are kept by part (a file, a day, a site) and merged.

A sketch is a few KB whatever it has seen, so medians and distinct counts of new
data come from the sketches of its parts without reading old rows again.
Quantile sketches (KLL) of ``K`` miss a rank by ``RANK_ERROR`` at most with a
chance of 99 %, distinct ones (HLL) of 2^``BITS`` registers a count by
``COUNT_ERROR`` with a chance of 95 %.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of quantile sketches, and by how much a rank may be off.
K, RANK_ERROR = 800, 0.005
#: Registers of distinct sketches (a power of two), and by what share a count may be off.
BITS, COUNT_ERROR = 14, 0.02


def sketched(rows: DataFrame, by: list[str], value: str, key: str | None = None) -> DataFrame:
    """``by, n, lost, quantiles, keys`` of each group: rows with and without a
    value (null or NaN), and sketches of values and of distinct keys (of the
    values' text, where no key is named). Groups without any value have a null
    ``quantiles``."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return rows.groupBy(*by).agg(F.count(x).alias("n"), F.count_if(x.isNull()).alias("lost"), F.when(F.count(x) > 0, F.kll_sketch_agg_double(x, K)).alias("quantiles"), F.hll_sketch_agg(F.col(key or value).cast("string"), BITS).alias("keys"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The same for fewer columns, from sketches of parts."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"), F.when(F.sum("n") > 0, F.kll_merge_agg_double("quantiles", K)).alias("quantiles"), F.hll_union_agg("keys").alias("keys"))


def quantile(share: float) -> Column:
    """About the value under which ``share`` of the rows lie; null without any."""
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    return F.when(F.col("quantiles").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(float(share))))


def distinct() -> Column:
    """About the number of different keys."""
    return F.hll_sketch_estimate("keys")


def rank_errors(rows: DataFrame, by: list[str], value: str, estimates: DataFrame, share: float) -> DataFrame:
    """``by, error`` of each group: how far the ranks of an estimate (column
    ``estimate``) are from ``share`` in the rows themselves."""
    x = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    named = estimates.select(*[F.col(c).alias(f"_{c}") for c in by], "estimate")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    counted = rows.withColumn("_x", x).where("_x IS NOT NULL").join(named, same).groupBy(*by).agg((F.count_if(F.col("_x") < F.col("estimate")) / F.count("*")).alias("lo"), (F.count_if(F.col("_x") <= F.col("estimate")) / F.count("*")).alias("hi"))
    return counted.select(*by, F.greatest(F.lit(0.0), F.col("lo") - share, share - F.col("hi")).alias("error"))
