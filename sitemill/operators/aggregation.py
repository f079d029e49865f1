"""Aggregation of client updates: weights, checks, means of tensors, factors
and metrics.

Sums run in double over exploded components with partial aggregation on the
map side, so a shuffle carries one row a cell and task, whatever the clients
number. Products of factors are summed in tiles, one at a time in a task. The
truncated decomposition is a group a base key, with matrices as small as the
sum of the clients' ranks, merged by groups of clients where that is much.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..storage import cut
from . import wide


def client_weight(meta: Column, key: str = "num_examples", steps: str = "num_steps") -> Column:
    """``num_examples`` where the key is there (1 if null), else the step
    count, else 1."""
    return F.when(F.map_contains_key(meta, key), F.coalesce(F.element_at(meta, key), F.lit(1.0))).otherwise(F.coalesce(F.element_at(meta, steps), F.lit(1.0)))


def check_updates(updates: DataFrame, expected: int | None = None) -> None:
    """Refuses updates that are not full, have no positive weight, or too few."""
    seen = updates.withColumn("w", client_weight(F.col("meta"))).agg(F.count_if(~F.col("params_type").eqNullSafe("FULL")).alias("partial"), F.count_if(F.col("w") <= 0).alias("weightless"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("total"), F.countDistinct("client").alias("clients")).first()
    if seen["partial"]:
        raise ValueError("updates must be full weights")
    if seen["weightless"]:
        raise ValueError("a weight must be positive")
    if seen["total"] == 0:
        raise ValueError("the total weight is zero")
    if expected is not None and seen["clients"] != expected:
        raise ValueError(f"{seen['clients']} of {expected} clients sent an update")


def key_mismatches(keys: DataFrame, first: str) -> DataFrame:
    """``client, key, side``: keys that a client has and the first client does
    not (``extra``), or the other way round (``missing``)."""
    own = keys.select("client", "key").distinct()
    wanted = own.where(F.col("client") == first).select("key", F.lit(1).alias("is_wanted"))
    marked = own.join(wanted, "key", "left")
    extra = marked.where("is_wanted IS NULL").select("client", "key", F.lit("extra").alias("side"))
    # a row a client that lacks something, with its keys, against one row with the keys of a model
    everything = F.broadcast(wanted.agg(F.collect_set("key").alias("all"), F.count("*").alias("n")))
    held = marked.groupBy("client").agg(F.collect_set(F.when(F.col("is_wanted") == 1, F.col("key"))).alias("mine"))
    lacked = held.crossJoin(everything).where(F.size("mine") < F.col("n")).select("client", F.explode(F.array_except("all", "mine")).alias("key"))
    return extra.union(lacked.select("client", "key", F.lit("missing").alias("side")))


def require_same_keys(keys: DataFrame) -> None:
    """Refuses updates of which one has other keys than the first client's."""
    first = keys.agg(F.min("client").alias("c")).first()["c"]
    if bad := key_mismatches(keys, first).orderBy("client", "key").take(3):
        raise ValueError(f"clients' keys differ: {[(r['client'], r['side'], r['key']) for r in bad]}")


def _total(weights: DataFrame) -> DataFrame:
    return weights.agg(F.sum("w").alias("total"))


def dense_mean(tensors: DataFrame, weights: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """``by, pos, value``: the weighted mean of every cell over clients."""
    weighted = tensors.join(weights, "client").select(*by, "w", F.posexplode(vec).alias("pos", "x"))
    sums = weighted.groupBy(*by, "pos").agg(F.sum(F.col("w") * F.col("x").cast("double")).alias("s"))
    return sums.crossJoin(F.broadcast(_total(weights))).select(*by, "pos", (F.col("s") / F.col("total")).alias("value"))


def factor_mean(factors: DataFrame, weights: DataFrame, by: list[str], target: int) -> DataFrame:
    """``by, factor, r, pos, value``: factors averaged each for itself. A client
    without a component counts as zeros there: the divisor is the weight of all
    clients. Components no client has are zeros up to ``target``; those zeros
    are added to the one sum, so filling needs no join."""
    cell = [*by, "factor", "r", "pos"]
    weighted = factors.where(F.col("r") < target).join(weights, "client").select(*by, "factor", "r", "w", F.posexplode("vec").alias("pos", "x"))
    terms = weighted.select(*cell, (F.col("w") * F.col("x").cast("double")).alias("term"))
    widths = factors.groupBy(*by, "factor").agg(F.max(F.size("vec")).alias("width"))
    zeros = widths.select(*by, "factor", F.explode(F.sequence(F.lit(0), F.lit(target - 1))).alias("r"), "width").select(*by, "factor", "r", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("pos"), F.lit(0.0).alias("term"))
    sums = terms.unionByName(zeros).groupBy(*cell).agg(F.sum("term").alias("s"))
    return sums.crossJoin(F.broadcast(_total(weights))).select(*cell, (F.col("s") / F.col("total")).alias("value"))


class _Tile:
    """Sums of a tile of a product. Terms with a null count for nothing; a cell
    of nothing else is null, and one no component reaches is not there."""

    def __init__(self, edge: int) -> None:
        self.sums, self.given, self.ends = np.zeros((edge, edge)), np.zeros((edge, edge), bool), np.zeros(edge, np.int32)

    def multiply(self, left: pa.ListArray, right: pa.ListArray) -> None:
        """Adds the products of slices of columns and of rows."""
        (x, has_x, high), (y, has_y, wide_) = _filled(left), _filled(right)
        h, w = x.shape[1], y.shape[1]
        for m, n in np.unique(np.stack([high, wide_]), axis=1).T:
            self.ends[:m] = np.maximum(self.ends[:m], n)
        with np.errstate(invalid="ignore", over="ignore"):
            if left.values.null_count or right.values.null_count or (high < h).any() or (wide_ < w).any() or not (np.isfinite(x).all() and np.isfinite(y).all()):
                for a, b, has_a, has_b in zip(x, y, has_x, has_y, strict=True):
                    both = np.outer(has_a, has_b)
                    self.sums[:h, :w] += np.where(both, np.outer(a, b), 0)
                    self.given[:h, :w] |= both
            else:
                self.sums[:h, :w] += x.T @ y
                self.given[:h, :w] = True

    def add(self, at: np.ndarray, rows: pa.ListArray) -> None:
        """Adds rows of other sums of the tile."""
        x, has_x, long = _filled(rows)
        with np.errstate(invalid="ignore", over="ignore"):
            np.add.at(self.sums[:, : x.shape[1]], at, x)
        np.logical_or.at(self.given[:, : x.shape[1]], at, has_x)
        np.maximum.at(self.ends, at, long.astype(np.int32))

    def batch(self, key: tuple[pa.Scalar, ...], names: list[str]) -> pa.RecordBatch:
        """``key``, the row in the tile and its cells."""
        at = np.flatnonzero(self.ends)
        there = np.arange(self.sums.shape[1]) < self.ends[at, None]
        cells = pa.array(self.sums[at][there], mask=~self.given[at][there])
        rows = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(self.ends[at])]).astype(np.int32), cells)
        return pa.RecordBatch.from_arrays([*[pa.repeat(k, len(at)) for k in key], pa.array(at.astype(np.int32)), rows], names)


def _filled(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists as rows of a matrix, which of its cells are no nulls, and lengths."""
    lengths, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
    inside = np.arange(lengths.max()) < lengths[:, None]
    values, given = np.zeros(inside.shape), np.zeros(inside.shape, bool)
    values[inside], given[inside] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False), flat.is_valid().to_numpy(zero_copy_only=False)
    return values, given, lengths


def update_mean(factors: DataFrame, weights: DataFrame, by: list[str], edge: int | None = None, most: int | None = None) -> DataFrame:
    """``by, i, j, value``: the weighted mean of the clients' products of
    factors. It fills a whole matrix; for large ones use ``reconstruct``.

    Components are dealt to tiles of ``edge`` by ``edge`` cells, and a task
    holds one tile at a time, however many cells it makes: only components are
    shuffled and no map of cells is kept. Bases of over ``most`` components have
    several sums a tile, which are added up by tiles."""
    edge, most = edge or wide.EDGE, most or MOST_COMPONENTS
    a = factors.where("factor = 'A'").select("client", *by, "r", F.col("vec").alias("a"))
    b = factors.where("factor = 'B'").select("client", *by, "r", F.col("vec").alias("b"))
    both = b.join(a, ["client", *by, "r"]).join(weights, "client").where("size(a) > 0 AND size(b) > 0")
    groups = a.groupBy(*by).agg(F.ceil(F.count("*") / most).alias("_groups"))
    is_much = (groups.agg(F.max("_groups").alias("n")).first()["n"] or 0) > 1
    both = both.join(groups, by).withColumn("_g", F.pmod(F.xxhash64("client", "r"), F.col("_groups"))) if is_much else both.withColumn("_g", F.lit(0))
    tiles = both.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(size(b) - 1) DIV {edge}"))).alias("_bi")).select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(size(a) - 1) DIV {edge}"))).alias("_bj"))
    piece = lambda vec, at: F.slice(vec, F.col(at).cast("int") * edge + 1, edge)
    dealt = tiles.select(*by, "_bi", "_bj", "_g", F.transform(piece("b", "_bi"), lambda x: F.col("w") * x.cast("double")).alias("left"), F.transform(piece("a", "_bj"), lambda y: y.cast("double")).alias("right"))
    names = [*by, "_bi", "_bj", "_at", "_row"]
    kinds = dict(dealt.dtypes)
    ddl = ", ".join([*[f"`{c}` {kinds[c]}" for c in names[:-2]], "_at int", "_row array<double>"])

    def products(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _Tile(edge)
        for batch in batches:
            tile.multiply(batch.column("left"), batch.column("right"))
        yield tile.batch(key[: len(names) - 2], names)

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = _Tile(edge)
        for batch in batches:
            tile.add(batch.column("_at").to_numpy(), batch.column("_row"))
        yield tile.batch(key, names)

    rows = dealt.groupBy(*by, "_bi", "_bj", "_g").applyInArrow(products, ddl)
    if is_much:
        rows = rows.groupBy(*by, "_bi", "_bj").applyInArrow(added, ddl)
    cells = rows.select(*by, (F.col("_bi") * edge + F.col("_at")).cast("int").alias("i"), F.col("_bj"), F.posexplode("_row").alias("_pos", "s"))
    return cells.crossJoin(F.broadcast(_total(weights))).select(*by, "i", (F.col("_bj") * edge + F.col("_pos")).cast("int").alias("j"), (F.col("s") / F.col("total")).alias("value"))


def truncated(left: np.ndarray, right: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """B (m, target) with orthonormal columns and A (target, n), descending, of
    the best approximation of ``left @ right`` of that rank; zero-filled."""
    b, a = np.zeros((left.shape[0], target)), np.zeros((target, right.shape[1]))
    if left.shape[1] and left.shape[0] and right.shape[1]:
        ql, rl = np.linalg.qr(left)
        qr, rr = np.linalg.qr(right.T)
        u, s, vt = np.linalg.svd(rl @ rr.T, full_matrices=False)
        k = min(target, len(s))
        b[:, :k], a[:k] = ql @ u[:, :k], s[:k, None] * (vt[:k] @ qr.T)
    return b, a


def merged(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factors (m, k), (k, n) of the same product with k at most the lesser of
    m and n: fewer, where several clients' ranks add up to more."""
    k = min(left.shape[0], right.shape[1])
    if left.shape[1] <= k:
        return left, right
    b, a = truncated(left, right, k)
    return b, a


#: Components of a base that one task takes, about.
MOST_COMPONENTS = 4096


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(m, k) and (k, n) of the rows of a base, weighted by their shares."""
    sides = {}
    for f in ("A", "B"):
        part = table.filter(pc.equal(table["factor"], f)).sort_by([("client", "ascending"), ("r", "ascending")])
        keys = list(zip(part["client"].to_pylist(), part["r"].to_pylist(), strict=True))
        width = len(part["vec"][0]) if part.num_rows else 0
        vecs = part["vec"].combine_chunks().flatten().to_numpy().astype(np.float64).reshape(-1, width) if width else np.zeros((0, 0))
        sides[f] = keys, vecs * part["share"].to_numpy()[:, None] if width else vecs
    if sides["A"][0] != sides["B"][0]:
        raise ValueError("factors without their partner")
    return sides["B"][1].T, sides["A"][1]


def _bank(base: object, kind: pa.DataType, b: np.ndarray, a: np.ndarray, **more: object) -> pa.Table:
    k = b.shape[1]
    vecs = [*b.T.astype(np.float64).tolist(), *a.tolist()]
    table = pa.table({"base": [base] * len(vecs), "factor": ["B"] * k + ["A"] * k, "r": list(range(k)) * 2, "vec": vecs}, schema=pa.schema([("base", kind), ("factor", pa.string()), ("r", pa.int32()), ("vec", pa.list_(pa.float64()))]))
    for name, value in more.items():
        table = table.append_column(name, pa.array([value] * len(vecs)))
    return table


def reconstruct(factors: DataFrame, weights: DataFrame, by: str, target: int, most: int | None = None, edge: int | None = None) -> DataFrame:
    """``by, factor, r, vec``: the mean of the clients' products, truncated to
    ``target`` components, without ever filling the product.

    Where the clients' ranks of a base add up to over ``most``, clients are
    merged in groups of about so many first, again and again: a group's product
    needs no more components than its lesser side has, so no task takes all
    clients. Nothing is cut off before the last step. A base whose sides are
    wider than that too is decomposed in blocks of ``edge`` values
    (``wide.decompose``).
    """
    most = most or MOST_COMPONENTS
    total = _total(weights)
    rows = factors.join(weights, "client").crossJoin(F.broadcast(total)).select(F.col(by).alias("base"), F.xxhash64("client").alias("client"), "factor", F.col("r").cast("int").alias("r"), F.col("vec").cast("array<double>").alias("vec"), F.sqrt(F.col("w") / F.col("total")).alias("share"))
    kind = dict(rows.dtypes)["base"]

    def width(rows: DataFrame) -> int:
        counted = rows.groupBy("base").agg(F.count_if(F.col("factor") == "A").alias("n"))
        return counted.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first()["n"]

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        b, a = merged(*_sides(table))
        return _bank(table["base"][0].as_py(), table.schema.field("base").type, b, a, client=key[1].as_py(), share=1.0)

    def last(table: pa.Table) -> pa.Table:
        return _bank(table["base"][0].as_py(), table.schema.field("base").type, *truncated(*_sides(table), target))

    held = width(rows)
    while held > most:
        groups = -(-held * 2 // most)
        # a component's number stays unique where several clients become one
        place = F.row_number().over(W.Window.partitionBy("base", "client", "factor").orderBy("own", "r"))
        dealt = rows.withColumn("own", F.col("client")).withColumn("client", F.pmod(F.xxhash64("client"), F.lit(groups))).withColumn("r", place.cast("int")).drop("own")
        rows = cut(dealt.groupBy("base", "client").applyInArrow(merge, f"base {kind}, factor string, r int, vec array<double>, client long, share double"), "merged")
        now = width(rows)
        if now >= held:  # sides wider than all the ranks: there is nothing to merge
            break
        held = now
    out = f"base {kind}, factor string, r int, vec array<double>"
    if held <= most:
        return rows.groupBy("base").applyInArrow(last, out).withColumnRenamed("base", by)
    sizes = rows.groupBy("base").agg((F.count_if(F.col("factor") == "A") > most).alias("is_wide"))
    marked = cut(rows.join(sizes, "base"), "marked")
    few = marked.where("NOT is_wide").drop("is_wide").groupBy("base").applyInArrow(last, out)
    return few.union(wide.decompose(marked.where("is_wide").drop("is_wide"), target, edge)).withColumnRenamed("base", by)


def metric_mean(updates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by, metric, value``: each metric over the clients that sent it, in all
    or in each group (a round). Where any client sent none at all, there are no
    metrics. Groups are told by a mark on their rows, so that nothing is joined."""
    by = by or []
    weighted = updates.withColumn("_w", client_weight(F.col("meta"))).withColumn("_silent", F.col("metrics").isNull())
    # a client without any metrics gives one row for its group, with no name
    each = weighted.select(*by, "_w", "_silent", F.explode_outer("metrics").alias("metric", "_x"))
    sums = each.where("_silent OR _x IS NOT NULL").groupBy(*by, "metric", "_silent").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("value"))
    silent = F.max(F.col("_silent")).over(W.Window.partitionBy(*by))
    return sums.withColumn("_none", silent).where("NOT _none").select(*by, "metric", "value")  # a row a metric and group


class Aggregator(Protocol):
    """What a plug-in gives: the new bank from clients' factors and weights."""

    def __call__(self, factors: DataFrame, weights: DataFrame, by: str, target: int) -> DataFrame: ...


def naive(factors: DataFrame, weights: DataFrame, by: str, target: int) -> DataFrame:
    """``factor_mean`` as a bank of vectors."""
    cells = factor_mean(factors, weights, [by], target)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "value")))
    return cells.groupBy(by, "factor", "r").agg(F.transform(ordered, lambda x: x["value"]).alias("vec"))


AGGREGATORS: dict[str, Aggregator] = {"naive": naive, "reconstructed": reconstruct}
