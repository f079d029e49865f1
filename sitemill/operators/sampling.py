"""Samples in hash order, and ranks that no single task has to make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.scalars import hash_order
from ..storage import cut

#: Hex digits of the hash that deal rows to 65,536 even buckets.
DIGITS = 4


def hash_rank(df: DataFrame, key: str, seed: int, name: str = "pos", within: list[str] | None = None) -> DataFrame:
    """Adds each row's place, from 1, in hash order, in all or in each group
    of ``within`` (whose groups are few, such as sites or classes).

    The hash's first digits deal rows evenly to buckets; a row's place is its
    place in its bucket plus the rows of the buckets before, from a table of
    a count for each bucket and group. So a group of any size is ranked by many
    tasks. A null key counts as an empty text in the order, so no row is lost;
    rows of one key have one hash, so a key that very many rows share is ranked
    in one task (keys are meant to tell rows apart).
    """
    group = within or []
    hashed = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_b", F.substring("_h", 1, DIGITS))
    counts = hashed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_c"), (F.sum("_n").over(W.Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).alias("_o"))
    same = F.col("_b") == F.col("_c")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = F.row_number().over(W.Window.partitionBy(*group, "_b").orderBy("_h", key))
    offsets = before if group else F.broadcast(before)  # 65,536 rows, or that for each group
    return hashed.withColumn("_r", inside).join(offsets, same).withColumn(name, (F.col("_o") + F.col("_r")).cast("long")).drop("_h", "_b", "_c", "_o", "_r", *[f"_g{i}" for i in range(len(group))])


def ordered_rank(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in the order of ``order``, without a
    single-task sort: rows are dealt by ranges and sorted there, and a place is
    that in its range plus the rows of the ranges before."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(W.Window.orderBy("_p")) - F.col("_n")).alias("_o"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), part == F.col("_p")).withColumn(name, F.col("_o") + inside + 1).drop("_at", "_p", "_o")


def medians(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group, median``: exact medians of the values that are not null. Groups
    of any size are ranked by many tasks; whether their counts are few enough
    for a broadcast is left to the planner."""
    ranked = ordered_rank(df.where(F.col(value).isNotNull()).select(group, value), [group, value], "_k")
    spans = ranked.groupBy(group).agg(F.min("_k").alias("_lo"), F.count("*").alias("_n")).select(F.col(group).alias("_g"), "_lo", "_n")
    at = F.col("_k") - F.col("_lo")
    middle = ranked.join(spans, F.col(group) == F.col("_g")).where((at == F.expr("(_n - 1) div 2")) | (at == F.expr("_n div 2")))
    return middle.groupBy(group).agg(F.avg(value).alias("median"))


def sample(df: DataFrame, key: str, most: int | None, seed: int) -> DataFrame:
    """The first ``most`` rows in hash order with their ``pos``; all of them
    if it is none or not positive. A bounded sample is a top-k, not a sort."""
    if most is None or most <= 0:
        return hash_rank(df, key, seed)
    top = df.withColumn("_h", hash_order(F.col(key), seed)).orderBy("_h", key).limit(most)
    return top.withColumn("pos", F.row_number().over(W.Window.orderBy("_h", key)).cast("long")).drop("_h")


def round_subset(df: DataFrame, key: str, size: int, round_no: int, seed: int = 42) -> DataFrame:
    """The rows a round evaluates: a sample of seed 42 + round, only where the
    size is positive and there are more rows than that; else all."""
    if size <= 0 or len(df.select(key).limit(size + 1).take(size + 1)) <= size:
        return sample(df, key, None, seed + round_no)
    return sample(df, key, size, seed + round_no)


def first_rows(df: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows; none for 0, and negative numbers are refused."""
    if n < 0:
        raise ValueError("the number of rows must not be negative")
    return df.orderBy(*order).limit(n)
