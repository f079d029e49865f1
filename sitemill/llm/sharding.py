"""Shards along a Hilbert curve through several metadata dimensions.

Every dimension is quantised to equally filled bins, a row's bins give its
place on the curve, rows are ordered by it and the order is cut into runs.
Files cut so hold a small box of every dimension, so a filter on any of them
prunes most. Only DataFrame functions; texts are read once, for two small
columns, and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import Scratch, shuffle_partitions

#: Bits of each dimension's bin, and codes that a dimension is counted in.
BITS, CODES = 5, 1 << 16
#: Names that the result has anyway; as dimensions they mean its columns.
OWN = ("doc_id", "size", "text_crc32")


def hilbert_index(bins: list[Column], bits: int = BITS) -> Column:
    """Place on the Hilbert curve of a point of ``bins`` of ``bits`` bits.

    The transposed form: rotations and reflections are undone from the top bit
    down, axes are Gray-coded, and the axes' bits are interleaved.
    """
    n = len(bins)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        low, mine, first = s["q"] - 1, F.get(x, s["i"]), F.get(x, F.lit(0))
        flip = mine.bitwiseAND(s["q"]) != 0
        mask = F.when(flip, low).otherwise(first.bitwiseXOR(mine).bitwiseAND(low))
        return F.transform(x, lambda v, j: v.bitwiseXOR(F.when((j == 0) | (~flip & (j == s["i"])), mask).otherwise(F.lit(0))))

    def gray(x: Column) -> Column:
        return F.transform(x, lambda v, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, y: a.bitwiseXOR(y)))

    def last(x: Column) -> Column:
        q = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
        return F.aggregate(q, F.lit(0), lambda t, s: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(s) != 0, t.bitwiseXOR(s - 1)).otherwise(t))

    def interleave(x: Column) -> Column:
        order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        t = last(x)
        return F.aggregate(order, F.lit(0).cast("long"), lambda a, s: a * 2 + F.call_function("shiftright", F.get(x, s["i"]).bitwiseXOR(t), s["b"]).bitwiseAND(1).cast("long"))

    start = F.array(*[b.cast("int") for b in bins])
    turned = F.aggregate(steps, start, turn) if bits > 1 else start
    # an array of one element keeps each step's value by name
    stepped = F.transform(F.array(turned), gray)
    return F.get(F.transform(stepped, interleave), F.lit(0))


def _common_prefix(a: bytes, b: bytes) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _codes(slim: DataFrame, dims: list[str]) -> dict[str, Column]:
    """A column of codes 0..``CODES`` - 1 in each dimension's own order.

    Numbers are coded on a logarithmic scale; strings by the two bytes behind
    the prefix that all values share (the one that the least and the greatest
    share). Nulls are 0.
    """
    strings = [d for d in dims if isinstance(slim.schema[d].dataType, T.StringType)]
    shared = {}
    if strings:
        ends = slim.agg(*[f(F.left(F.col(d), F.lit(256))).alias(f"{k}_{d}") for d in strings for k, f in (("lo", F.min), ("hi", F.max))]).first()
        shared = {d: _common_prefix((ends[f"lo_{d}"] or "").encode(), (ends[f"hi_{d}"] or "").encode()) for d in strings}
    out = {}
    for d in dims:
        c = F.col(d)
        if d in shared:
            two = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), shared[d] + 1, 2)), 4, "0")
            code = F.conv(two, 16, 10).cast("int")
        else:
            code = F.floor(F.log2(F.greatest(c.cast("double"), F.lit(0.0)) + 1) * 1000).cast("int")
        out[d] = F.when(c.isNull(), 0).otherwise(F.least(F.lit(CODES - 1), code + 1))  # least passes over nulls
    return out


def _bins(slim: DataFrame, codes: dict[str, Column], bits: int) -> list[Column]:
    """Each dimension's bin: the share of all rows below the row's code, in
    ``1 << bits`` steps. Exact counts, at most ``CODES`` a dimension."""
    coded = slim.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), c.alias("code")) for d, c in codes.items()])).alias("x"))
    counts = coded.groupBy("x.dim", "x.code").count().collect()
    out = []
    for d, code in codes.items():
        own = sorted((r["code"], r["count"]) for r in counts if r["dim"] == d)
        total, seen, cuts, values = sum(n for _, n in own), 0, [], [0]
        for at, n in own:
            if (value := (seen << bits) // total) > values[-1]:
                cuts.append(at)
                values.append(value)
            seen += n
        out.append(_step(code, cuts, values))
    return out


def _step(code: Column, cuts: list[int], values: list[int]) -> Column:
    points = F.array(*[F.lit(x) for x in cuts]).cast("array<int>")
    return F.get(F.array(*[F.lit(v) for v in values]), F.size(F.filter(points, lambda x: x <= code)))


def hilbert_shards(docs: DataFrame, shards: int, dims: list[str], law: str = "rows", id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """Cuts ``docs`` along the curve through ``dims`` into ``shards`` runs.

    ``dims`` names columns of ``docs``, ``doc_id``, or ``size`` for a text's
    bytes plus 16 (a column of that name in ``docs`` is not read).
    By law ``rows`` the runs' counts are at most one apart; by law ``bytes``
    every row goes to the run in which the middle of its bytes falls, so a run
    is off an equal share by at most one row at either end. Returns ``doc_id,
    size, text_crc32, law, shard, slot, grown_shard, curve`` and the dims;
    ``slot`` counts from 0 in each shard without gaps.

    The slim rows are written once, each with a number of its own, ordered by
    ranges of (curve, id, CRC, number), so a third of all rows in one cell, or
    alike in everything, is spread over many tasks, and written again; ranks add a row's place in its part to the parts before it. The
    table of parts has a row for each shuffle partition, so it is broadcast.
    Null texts have no bytes (CRC 0), nulls in a dimension come first, repeated
    rows get a slot each, and an empty table gives no rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    scratch = Scratch()
    slim = scratch.write(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), *[F.col(d) for d in dims if d not in OWN], F.monotonically_increasing_id().alias("_tie")), "slim")
    codes = _codes(slim, dims)
    bins = _bins(slim, codes, bits)
    order = ["curve", "doc_id", "text_crc32", "_tie"]
    placed = slim.withColumn("curve", hilbert_index(bins, bits)).repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    placed = scratch.write(placed.withColumn("place", F.monotonically_increasing_id()), "curve")
    scratch.remove(placed)
    part = F.shiftright("place", 33)
    totals = placed.groupBy(part.alias("p")).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    one = W.Window.orderBy("p")
    every = W.Window.partitionBy()
    bases = totals.select("p", (F.sum("n").over(one) - F.col("n")).alias("n0"), (F.sum("b").over(one) - F.col("b")).alias("b0"), F.sum("n").over(every).alias("all_n"), F.sum("b").over(every).alias("all_b"))
    rows = placed.join(F.broadcast(bases), part == F.col("p"))
    rank = F.col("n0") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    if law == "rows":
        # shard = floor(rank * shards / n); its first rank is ceil(shard * n / shards)
        shard = F.expr(f"(n0 + (place & {(1 << 33) - 1})) * {shards} div all_n")
        rows = rows.withColumn("shard", shard.cast("int"))
        slot = rank - F.expr(f"(shard * all_n + {shards - 1}) div {shards}")
    else:
        inner = W.Window.partitionBy("p").orderBy("place")
        before = F.col("b0") + F.sum("size").over(inner) - F.col("size")
        rows = rows.withColumn("before", before).withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"(2 * before + size) * {shards} div (2 * all_b)")).cast("int"))
        firsts = rows.groupBy("shard").agg(F.min(rank).alias("r0")).withColumnRenamed("shard", "s")
        rows = rows.join(F.broadcast(firsts), F.col("shard") == F.col("s"))
        slot = rank - F.col("r0")
    return rows.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *[d for d in dims if d not in OWN])


def zone_map(shards: DataFrame, dims: list[str]) -> DataFrame:
    """The least and greatest value of each dimension in each shard, by which
    a reader skips files."""
    return shards.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))])


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes whole rows as Parquet, a folder ``shard=k`` each in slot order.

    ``assigned`` is what ``hilbert_shards`` gave for ``docs``. Rows are matched
    by id, size and CRC; those that agree in all three take the slots of that
    kind in any order, and no row is lost or doubled. A column of ``docs`` that
    is named shard or slot is written as it is inside ``row``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = ["k_id", "k_size", "k_crc"]
    nth = F.row_number().over(W.Window.partitionBy(*kind).orderBy(*kind))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("k_id"), (F.octet_length(text).cast("long") + 16).alias("k_size"), F.crc32(F.encode(text, "UTF-8")).alias("k_crc")).withColumn("k_nth", nth)
    slots = assigned.select(F.col("doc_id").alias("k_id"), F.col("size").alias("k_size"), F.col("text_crc32").alias("k_crc"), "shard", "slot").withColumn("k_nth", nth).select(*[F.col(k).alias(f"s{k}") for k in [*kind, "k_nth"]], "shard", "slot")
    same = F.lit(True)
    for k in [*kind, "k_nth"]:
        same = same & F.col(k).eqNullSafe(F.col(f"s{k}"))
    placed = rows.join(slots, same).select("shard", "slot", "row")
    placed.repartitionByRange(shuffle_partitions(docs.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
