"""As-of join: each row with the newest row of another table before it.

Both sides become one table, dealt by ranges of (key, time) and written, so a
key with very many rows lies in many parts. Inside a part the newest row of the
other side is a running last value; what a part must know of those before it is
one row: the newest of the other side with the key that it begins with. Of
those there is one a part at most, found from a row a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..storage import cut


def asof_join(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, take: list[str], order: list[str] | None = None, strict: bool = False) -> DataFrame:
    """All rows and columns of ``left``, and ``take`` of the row of ``right``
    with the same ``by``, the greatest ``right_time`` not after ``time`` (before
    it, if ``strict``), and of several at that time the greatest ``order``.

    Rows whose key or time is null, or that nothing comes before, get nulls;
    rows of ``right`` with a null key or time are never met, nulls in ``order``
    come first. Of right rows alike in all these any one is met. Columns of
    ``take`` must not be among those of ``left``.
    """
    if clash := set(take) & set(left.columns):
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    spark = left.sparkSession
    whole = F.lit(True)
    for c in by:
        whole = whole & F.col(c).isNotNull()
    own, other = F.struct(*[F.col(c) for c in left.columns]), F.struct(*[F.col(c) for c in take])
    rank = F.struct(F.lit(0).alias("none"), *[F.col(c) for c in order or []])
    kinds = {"own": left.select(own.alias("x")).schema["x"].dataType, "other": right.select(other.alias("x")).schema["x"].dataType, "rank": right.select(rank.alias("x")).schema["x"].dataType}

    def side(df: DataFrame, at: str, number: int, held: str) -> DataFrame:
        fields = {"own": own, "other": other, "rank": rank}
        mine = [held, *(["rank"] if held == "other" else [])]
        return df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(at).alias("_time"), F.lit(number).alias("_side"), *[(fields[n] if n in mine else F.lit(None).cast(kinds[n])).alias(f"_{n}") for n in kinds])

    keys = [f"_k{i}" for i in range(len(by))]
    # at one time the other side comes first, unless it must be before
    timed = side(left.where(whole & F.col(time).isNotNull()), time, 0 if strict else 1, "own").union(side(right.where(whole & F.col(right_time).isNotNull()), right_time, 1 if strict else 0, "other"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    along = [*keys, "_time", "_side", "_rank"]
    placed = cut(timed.repartitionByRange(parts, *along).sortWithinPartitions(*along).withColumn("_at", F.monotonically_increasing_id()), "asof")
    part = F.shiftright("_at", 33)
    key = F.struct(*keys)
    # of every part: its first key, its last, and the newest other row of the last
    ends = placed.groupBy(part.alias("_p")).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    newest = placed.where("_other IS NOT NULL").groupBy(part.alias("_p")).agg(F.max_by(F.struct(key.alias("key"), F.col("_other").alias("other")), "_at").alias("_new"))
    told = ends.join(newest, "_p", "left").withColumn("_new", F.when(F.col("_new.key") == F.col("_last"), F.col("_new.other")))
    before = W.Window.partitionBy("_last").orderBy("_p").rowsBetween(W.Window.unboundedPreceding, 0)
    carried = told.withColumn("_carried", F.last("_new", ignorenulls=True).over(before)).select(F.col("_last").alias("_of"), F.col("_p").alias("_q"), "_carried").where("_carried IS NOT NULL")
    brought = told.select("_p", "_first").join(carried, (F.col("_first") == F.col("_of")) & (F.col("_q") < F.col("_p"))).groupBy("_p").agg(F.max_by("_carried", "_q").alias("_carried"), F.first("_first").alias("_first"))
    so_far = F.last("_other", ignorenulls=True).over(W.Window.partitionBy("_p", *keys).orderBy("_at").rowsBetween(W.Window.unboundedPreceding, 0))
    inside = placed.withColumn("_p", part).withColumn("_met", so_far).where("_own IS NOT NULL")
    # a row a part
    joined = inside.join(F.broadcast(brought.select(F.col("_p").alias("_r"), "_carried", "_first")), (F.col("_p") == F.col("_r")) & (key == F.col("_first")), "left")
    met = joined.withColumn("_met", F.coalesce("_met", "_carried")).select(*[F.col("_own")[c].alias(c) for c in left.columns], *[F.col("_met")[c].alias(c) for c in take])
    rest = left.where(~F.coalesce(whole & F.col(time).isNotNull(), F.lit(False)))
    return met.unionByName(rest.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in take]))
