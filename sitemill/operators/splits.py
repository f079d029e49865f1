"""Records split into sites, each with rows for training and validation."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.scalars import hash_order
from ..storage import cut, discard
from .sampling import hash_rank


def client_counts(total: Column, n: Column, idx: Column, per_client: Column | int | None = None) -> Column:
    """Rows of client ``idx``: an even share, the remainder going to the lowest
    clients; or ``per_client`` where that is less than an even share."""
    if per_client is None:
        return F.floor(total / n).cast("long") + (idx < total % n).cast("long")
    return F.least(F.lit(per_client).cast("long") if isinstance(per_client, int) else per_client, F.floor(total / n).cast("long"))


def check_counts(total: int, n: int, per_client: int | None, validation: int) -> list[int]:
    """The same on the driver, with every refusal."""
    if n <= 0:
        raise ValueError("there must be a client")
    if validation < 0:
        raise ValueError("the validation size must not be negative")
    if per_client is not None and per_client <= 0:
        raise ValueError("samples per client must be positive")
    if per_client is not None and total // n == 0:
        raise ValueError("fewer rows than clients")
    counts = [total // n + (i < total % n) for i in range(n)] if per_client is None else [min(per_client, total // n)] * n
    if min(counts) <= validation:
        raise ValueError("a client has no rows left for training")
    return counts


def dominant(n: Column, labels: int, idx: Column, label: Column) -> Column:
    """Whether a label is among those of a client: contiguous blocks, earlier
    clients getting the remainder, or one label each where clients are more."""
    size, extra = F.floor(F.lit(labels) / n), F.lit(labels) % n
    start = idx * size + F.least(idx, extra)
    return F.when(n > labels, label == idx % labels).otherwise((label >= start) & (label < start + size + (idx < extra).cast("int")))


def preference(n: Column, labels: int, idx: Column, label: Column, fraction: float) -> Column:
    """A client's wish for a label: ``fraction`` shared by its dominant labels
    and the rest by the others; uniform where all labels are dominant."""
    if not 0 <= fraction <= 1:
        raise ValueError("the fraction lies between 0 and 1")
    mine = F.when(n > labels, F.lit(1)).otherwise(F.floor(F.lit(labels) / n) + (idx < F.lit(labels) % n).cast("int"))
    f = F.lit(float(fraction))
    return F.when(mine == labels, F.lit(1.0) / labels).when(dominant(n, labels, idx, label), f / mine).otherwise((F.lit(1.0) - f) / (labels - mine))


def sites(spark: SparkSession, n: int) -> DataFrame:
    """``idx, site``: site-1 to site-n."""
    return spark.range(n).select(F.col("id").cast("int").alias("idx"), F.concat(F.lit("site-"), (F.col("id") + 1).cast("string")).alias("site"))


def _ranges(counted: DataFrame, by: list[str], count: str) -> DataFrame:
    """[lo, hi) of each row of counts, one after the other in site order."""
    w = W.Window.partitionBy(*by).orderBy("idx")
    return counted.withColumn("hi", F.sum(count).over(w)).withColumn("lo", F.col("hi") - F.col(count))


def split_random(df: DataFrame, key: str, n: int, validation: int, seed: int = 42, per_client: int | None = None) -> DataFrame:
    """``key, site, split``: rows in hash order cut into sites; the first
    ``validation`` rows of a site are for validation. Sites are as large as
    ``check_counts`` says, the larger ones first, so a row's site follows from
    its place; rows beyond the last site are dropped. Too few rows are refused."""
    counts = check_counts(df.count(), n, per_client, validation)
    size, more = counts[-1], sum(c > counts[-1] for c in counts)
    at, head = F.col("pos") - 1, more * (size + 1)
    site = F.when(at < head, F.floor(at / (size + 1))).otherwise(more + F.floor((at - head) / size))
    inside = F.when(at < head, at % (size + 1)).otherwise((at - head) % size)
    placed = hash_rank(df.select(key), key, seed).withColumn("_site", site).where(F.col("_site") < n)
    return placed.select(key, F.concat(F.lit("site-"), (F.col("_site") + 1).cast("string")).alias("site"), F.when(inside < validation, "validation").otherwise("train").alias("split"))


def split_quota(df: DataFrame, key: str, label: str, labels: int, n: int, validation: int, fraction: float = 0.8, seed: int = 42, per_client: int | None = None) -> DataFrame:
    """``key, label, site, split``: sites skewed to their dominant labels.

    Each site's quota of a label is its capacity times its preference, scaled
    down where the label has fewer rows than all sites want; rows of a label go
    to sites in hash order. Rows left over fill the sites' remaining capacity,
    in hash order over all labels; a surplus is dropped. All ranks are made by
    many tasks, and quotas and ranges are tables of sites times labels. Counts
    that ``check_counts`` refuses are refused.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key), F.col(label))
    supply = cut(rows.groupBy(label).agg(F.count("*").alias("supply")), "supply")
    check_counts(supply.agg(F.coalesce(F.sum("supply"), F.lit(0)).alias("n")).first()["n"], n, per_client, validation)
    total = supply.agg(F.sum("supply").alias("total"))
    grid = sites(spark, n).crossJoin(spark.range(labels).select(F.col("id").cast("int").alias("l"))).crossJoin(F.broadcast(total))
    grid = grid.withColumn("cap", client_counts(F.col("total"), F.lit(n), F.col("idx"), per_client))
    wish = F.floor(F.col("cap") * preference(F.lit(n), labels, F.col("idx"), F.col("l"), fraction))
    grid = grid.withColumn("wish", wish).join(F.broadcast(supply), F.col("l") == F.col(label), "left").drop(label).fillna({"supply": 0})
    wanted = F.sum("wish").over(W.Window.partitionBy("l"))
    scale = F.least(F.lit(1.0), F.col("supply") / wanted)
    grid = cut(grid.withColumn("quota", F.when(wanted > 0, F.floor(F.col("wish") * scale)).otherwise(F.lit(0)).cast("long")), "quota")
    spans = _ranges(grid, ["l"], "quota").select("l", "site", "lo", "hi")
    ranked = hash_rank(rows, key, seed, "rank", [label])
    first = cut(ranked.join(F.broadcast(spans), (F.col(label) == F.col("l")) & (F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi")), "left").select(key, label, "site"), "first")
    free = grid.groupBy("idx", "site").agg((F.first("cap") - F.sum("quota")).alias("free"))
    gaps = _ranges(free, [], "free").select(F.col("site").alias("gap_site"), "lo", "hi")
    rest = hash_rank(first.where("site IS NULL").drop("site"), key, seed, "rank").join(F.broadcast(gaps), (F.col("rank") > F.col("lo")) & (F.col("rank") <= F.col("hi"))).select(key, label, F.col("gap_site").alias("site"))
    placed = cut(first.where("site IS NOT NULL").union(rest), "placed")
    return hash_rank(placed, key, seed, "rank", ["site"]).select(key, label, "site", F.when(F.col("rank") <= validation, "validation").otherwise("train").alias("split"))


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that a key draws, the same on every engine: 52 bits
    of its hash."""
    return F.conv(F.substring(hash_order(key, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)


def weighted_choice(weights: Column, u: Column) -> Column:
    """The place, from 0, of the candidate that a draw ``u`` falls to: the first
    at which the weights so far reach ``u`` times their sum, or the last. Where
    no weight is over 0 all candidates are alike; null without candidates."""
    n = F.size(weights)
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    goal = u * total
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("found"), F.lit(0).alias("at"))
    met = F.aggregate(weights, start, lambda s, w: F.struct((s["sum"] + w).alias("sum"), F.when((s["found"] < 0) & (s["sum"] + w >= goal), s["at"]).otherwise(s["found"]).alias("found"), (s["at"] + 1).alias("at")), lambda s: s["found"])
    alike = F.least(F.floor(u * n).cast("int"), n - 1)
    return F.when(n > 0, F.when(total > 0, F.when(met >= 0, met).otherwise(n - 1)).otherwise(alike))


#: Rows of the sequential rule that one task takes at a time.
SEQUENCE = 1 << 20


def _fold(wish: list[list[float]], room: list[int]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sites of rows in turn, from the room that is left at their start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = list(room)
        for batch in batches:
            out = []
            for x, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if x is None or not 0 <= x < len(wish[0]):
                    raise ValueError(f"no class {x}")
                free = [i for i, k in enumerate(left) if k]
                if not free:
                    out.append(None)
                    continue
                weights = [wish[i][x] * left[i] for i in free]
                total = sum(weights)
                if total > 0:
                    sums = list(accumulate(weights))
                    at = free[min(bisect_left(sums, u * total), len(free) - 1)]
                else:
                    at = free[min(int(u * len(free)), len(free) - 1)]
                left[at] -= 1
                out.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], [*batch.schema.names[:2], "_at"])

    return run


def split_sequential(df: DataFrame, key: str, label: str, labels: int, n: int, validation: int, fraction: float = 0.8, seed: int = 42, per_client: int | None = None, block: int = SEQUENCE) -> DataFrame:
    """The order-dependent rule: each row in hash order goes to a site drawn by
    preference times the room it has left; a surplus is dropped.

    One row's choice depends on all before it, so blocks of ``block`` rows go
    through a task each, one block after the other; what a block leaves to the
    next is a number a site. Draws are by the rows' own hashes, so blocks do
    not change the outcome. It takes as long as one core needs for all rows;
    ``split_quota`` has no such bound. A label that is no class is refused.
    """
    rows = df.select(key, label)
    total = rows.count()
    counts = check_counts(total, n, per_client, validation)
    size, extra = divmod(labels, n)
    own = [{i % labels} if n > labels else set(range(i * size + min(i, extra), (i + 1) * size + min(i + 1, extra))) for i in range(n)]
    wish = [[1 / labels if len(o) == labels else fraction / len(o) if x in o else (1 - fraction) / (labels - len(o)) for x in range(labels)] for o in own]
    drawn = hash_rank(rows, key, seed, "_pos").withColumn("_u", uniform(F.col(key), seed + 1))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ordered = cut(drawn.repartitionByRange(parts, "_pos").sortWithinPartitions("_pos"), "sequence")  # so that a block is read alone
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed, room = [], list(counts)
    for first in range(0, total, block):
        here = ordered.where((F.col("_pos") > first) & (F.col("_pos") <= first + block)).select(key, label, "_u", "_pos")
        placed.append(cut(here.repartition(1).sortWithinPartitions("_pos").mapInArrow(_fold(wish, room), f"{kind}, _at int"), "placed"))
        for r in placed[-1].where("_at IS NOT NULL").groupBy("_at").count().collect():  # a row a site
            room[r["_at"]] -= r["count"]
        if not any(room):
            break
    discard(ordered)
    whole = reduce(DataFrame.union, placed).where("_at IS NOT NULL").select(key, label, F.concat(F.lit("site-"), (F.col("_at") + 1).cast("string")).alias("site"))
    return hash_rank(whole, key, seed, "_rank", ["site"]).select(key, label, "site", F.when(F.col("_rank") <= validation, "validation").otherwise("train").alias("split"))


def per_client(samples: int | None) -> int | None:
    """Samples a client as a user asks for them: 0 or less means all."""
    return None if samples is None or samples <= 0 else samples


def split_records(df: DataFrame, key: str, label: str, labels: int, n: int, strategy: str = "heterogeneous", samples_per_client: int | None = None, **options: object) -> DataFrame:
    """Splits by ``heterogeneous`` quotas, the ``sequential`` rule, or at
    ``random``; ``samples_per_client`` of 0 or less means all. Every strategy
    refuses what ``check_counts`` refuses."""
    options["per_client"] = per_client(samples_per_client)
    if strategy == "random":
        return split_random(df, key, n, **options)
    if strategy == "heterogeneous":
        return split_quota(df, key, label, labels, n, **options)
    if strategy == "sequential":
        return split_sequential(df, key, label, labels, n, **options)
    raise ValueError(f"no split strategy {strategy}")


def dominant_labels(n: int, labels: tuple[str, ...]) -> Iterator[tuple[str, list[str]]]:
    """Each site and its dominant labels, for charts and reports."""
    block, extra = divmod(len(labels), n)
    for i in range(n):
        start = i * block + min(i, extra)
        yield f"site-{i + 1}", [labels[i % len(labels)]] if n > len(labels) else list(labels[start : start + block + (i < extra)])
