"""Feature tables: masks, imputation, panels, cross-tables, spaced selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..storage import cut, discard
from .sampling import medians, ordered_rank


def masked(value: Column, p: Column, most: float = 0.01) -> Column:
    """The value, or null where its quality test's p is over ``most``."""
    return F.when(p <= most, value)


def mask_drop_impute(long: DataFrame, row: str, feature: str, value: str, train: str, most_missing: float = 0.05) -> DataFrame:
    """``row, feature, value`` of the features that at most ``most_missing`` of
    the training rows lack, missing values filled with the training median."""
    training = long.where(F.col(train))
    lost = training.groupBy(feature).agg(F.avg(F.col(value).isNull().cast("double")).alias("lost")).where(F.col("lost") <= most_missing)
    kept = lost.join(medians(training, feature, value), feature, "left").select(F.col(feature).alias("_kept"), "median")
    return long.join(kept, F.col(feature) == F.col("_kept")).select(row, feature, F.coalesce(F.col(value), F.col("median")).alias(value))


def top_fraction(scores: DataFrame, name: str, score: str, fraction: float) -> DataFrame:
    """The ceil(fraction * n) names of the highest scores, ties by name."""
    ranked = ordered_rank(scores, [F.col(score).desc(), F.col(name)])
    most = ranked.agg(F.ceil(F.count("*") * F.lit(float(fraction))).alias("most"))
    return ranked.crossJoin(F.broadcast(most)).where("place <= most").drop("place", "most")


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().fillna(0)


def traffic(log: DataFrame, site: str, sums: list[str], peaks: list[str]) -> DataFrame:
    """Sums and peaks of each site and, with a null site, of all."""
    return log.rollup(site).agg(F.count("*").alias("rounds"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in peaks])


#: A cell's side in tile widths: any two tiles of a cell are less than two widths apart.
CELL = 1.4
#: Cells on each side in which a tile nearer than two widths may lie.
REACH = 2


def _first(df: DataFrame, group: str, most: int) -> DataFrame:
    """The ``most`` best of each group with their ``_n``; Spark cuts groups to
    so many on the map side already."""
    return df.withColumn("_n", F.row_number().over(W.Window.partitionBy(group).orderBy("_p"))).where(F.col("_n") <= most)


def _around(df: DataFrame) -> DataFrame:
    """Each row in all cells within reach of its own, as ``_i, _j``."""
    steps = F.sequence(F.lit(-REACH), F.lit(REACH))
    return df.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps)).withColumn("_i", F.col("_cx") + F.col("_dx")).withColumn("_j", F.col("_cy") + F.col("_dy")).drop("_dx", "_dy", "_cx", "_cy")


def spaced(tiles: DataFrame, group: str, score: str, x: str, y: str, width: float, most: int = 16) -> DataFrame:
    """``group, score, x, y, chosen``: of each group the best-scored tiles at
    least two widths apart, each chosen where no better chosen one is nearer,
    filled up to ``most`` with the next best.

    The order of scores decides, but no task takes a group: tiles lie in cells,
    and in each round a tile is chosen if it is the best left in its own and
    the cells around it, since nothing left can speak against it any more;
    tiles near it drop out. A group's best tile left is chosen in every round,
    so ``most`` rounds settle all that can count; tiles worse than ``most``
    chosen ones drop out too. Cells give one row each to the rounds'
    comparisons, and a tile meets the chosen ones of 25 cells, one a cell.

    Ties go by x, then y; of repeated rows one is chosen first. A null or NaN
    score comes last. A tile without a place is only taken to fill up. A null
    group is a group; an empty table gives no rows.
    """
    if width <= 0 or most < 1:
        raise ValueError("the width and the number must be positive")
    there = F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y")
    worth = F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))
    named = tiles.select(F.col(group).alias("_g"), F.col(score).alias("_s"), F.col(x).alias("_a"), F.col(y).alias("_b"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), worth.alias("_w"), F.monotonically_increasing_id().alias("_t"))
    key = F.struct(F.col("_g").isNull().alias("null"), F.coalesce(F.col("_g").cast("string"), F.lit("")).alias("name"))
    ranked = F.struct(F.col("_w").isNull().alias("lacks"), (-F.coalesce("_w", F.lit(0.0))).alias("worth"), F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_t").alias("t"))
    cells = [F.when(there, F.floor(F.col(c) / (width * CELL))).alias(n) for c, n in (("_x", "_cx"), ("_y", "_cy"))]
    all_tiles = cut(named.select(key.alias("_k"), "_g", "_s", "_a", "_b", "_x", "_y", ranked.alias("_p"), *cells), "tiles")

    left = all_tiles.where("_cx IS NOT NULL").select("_k", "_x", "_y", "_p", "_cx", "_cy")
    chosen: DataFrame | None = None
    written: list[DataFrame] = []
    for _ in range(most):
        best = left.groupBy("_k", "_cx", "_cy").agg(F.min("_p").alias("_p"))
        near = _around(best).groupBy("_k", "_i", "_j").agg(F.min("_p").alias("_least"))
        new = best.join(near.select(F.col("_k").alias("_l"), "_i", "_j", "_least"), (F.col("_k") == F.col("_l")) & (F.col("_cx") == F.col("_i")) & (F.col("_cy") == F.col("_j")))
        new = cut(new.where("_p = _least").select("_k", "_cx", "_cy", "_p"), "chosen")
        written.append(new)
        if not new.take(1):
            break
        chosen = new if chosen is None else chosen.union(new)
        enough = _first(chosen, "_k", most).where(F.col("_n") == most).select(F.col("_k").alias("_l"), F.col("_p").alias("_last"))
        met = _around(new).select(F.col("_k").alias("_l"), "_i", "_j", F.col("_p.x").alias("_ox"), F.col("_p.y").alias("_oy"))
        apart = (F.col("_x") - F.col("_ox")) * (F.col("_x") - F.col("_ox")) + (F.col("_y") - F.col("_oy")) * (F.col("_y") - F.col("_oy"))
        kept = left.join(met, (F.col("_k") == F.col("_l")) & (F.col("_cx") == F.col("_i")) & (F.col("_cy") == F.col("_j")) & (apart < 4.0 * width * width), "left_anti")
        left = cut(kept.join(enough, F.col("_k") == F.col("_l"), "left").where("_last IS NULL OR _p < _last").select("_k", "_x", "_y", "_p", "_cx", "_cy"), "left")
        written.append(left)
    none = left.limit(0).select("_k", "_cx", "_cy", "_p")
    far = _first(none if chosen is None else chosen, "_k", most).select(F.col("_p").alias("_f"))
    # the others that can fill up are among the best 2 * most of a group
    columns = ["_k", "_g", "_s", "_a", "_b", "_p"]
    fill = _first(all_tiles.select(*columns), "_k", 2 * most).select(*columns)
    marked = fill.join(far, F.col("_p") == F.col("_f"), "left")
    apart_ones = all_tiles.select(*columns).join(far, F.col("_p") == F.col("_f"))
    both = marked.where("_f IS NULL").withColumn("_rest", F.lit(1)).drop("_f").union(apart_ones.withColumn("_rest", F.lit(0)).drop("_f"))
    place = F.row_number().over(W.Window.partitionBy("_k").orderBy("_rest", "_p"))
    out = cut(both.withColumn("chosen", place.cast("int")).where(F.col("chosen") <= most).select(F.col("_g").alias(group), F.col("_s").alias(score), F.col("_a").alias(x), F.col("_b").alias(y), "chosen"), "spaced")
    discard(all_tiles, *written)
    return out
