"""Training batches of token lists: padded, with labels that pass over what is
not to be learned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import mask_tokens, pad_tokens


def collate(examples: DataFrame, batch: str | Column, ids: str, pad: int | None, ignored: list[int], left: bool = False) -> DataFrame:
    """Adds ``input_ids`` (``ids`` filled to the longest of its batch),
    ``attention_mask`` (0 where filled) and ``labels`` (the filled ids without
    the filler and the ``ignored`` ids, such as those that stand for an image).

    Batches hold few rows each; their longest lengths are joined back, so no
    batch is gathered. Without a filler id batches must be of one length.
    """
    rows = examples.withColumn("_batch", batch if isinstance(batch, Column) else F.col(batch))
    longest = rows.groupBy("_batch").agg(F.max(F.size(ids)).alias("_most")).withColumnRenamed("_batch", "_of")
    joined = rows.join(longest, F.col("_batch").eqNullSafe(F.col("_of")))
    size, most = F.size(ids), F.col("_most")
    if pad is None:
        filled = F.when(size == most, F.col(ids)).otherwise(F.raise_error(F.lit("a batch without a filler id has texts of several lengths")).cast("array<int>"))
    else:
        filled = pad_tokens(F.col(ids), most, pad, left)
    ones, zeros = F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), most - size)
    hidden = sorted({*ignored, *([] if pad is None else [pad])})
    out = joined.withColumn("input_ids", filled)
    out = out.withColumn("attention_mask", F.concat(zeros, ones) if left else F.concat(ones, zeros))
    return out.withColumn("labels", mask_tokens(F.col("input_ids"), hidden) if hidden else F.col("input_ids")).drop("_batch", "_of", "_most")
