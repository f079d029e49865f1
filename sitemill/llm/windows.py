"""Rolling windows over time: counts, sums, distinct kinds and exact ranks.

Time is cut into units of ``step`` seconds. A node of level l covers 2^l units
of one group, and holds the number of its events, the sum of their sizes, its
kinds and its sorted run of sizes, each size once with its count. Runs are made
by Spark: events are counted by (group, unit, size, kind) before anything is
shuffled, then added up along all levels. A window is the union of at most
2 log2(W / step) nodes that do not overlap; each node goes to the blocks of
``2 ** BLOCK_BITS`` units in which some window may take it (which lie side by
side, as ``_range`` says), and the windows of a block are answered together: sums
over nodes, unions of kinds, and the rank-k size by bisection of the block's
sizes, counting in all sorted runs at once.

What a task holds grows with the *different* sizes in the nodes of one block of
one group, not with rows: a third of all rows in one source, or at one moment,
is a third of all rows only before the first, map-side count. Nothing goes to
the driver or into a broadcast.

A null group is a group of its own. An event without a time lies in no window
and has empty ones (no events, sum 0, ranks null). A null size counts as an
event, but not in sum and ranks; a null kind is no kind. Repeated rows and ids
are events of their own with a row a window each; ties in size are kept, ties
in time leave an event out of its own window. An empty table gives no rows.
Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import enter, materialize

#: Windows that end in 128 units of a group are answered together.
BLOCK_BITS = 7
#: name, p, q: the element number ceil(p * m / q) of m sizes in ascending order.
RANKS = (("median_chars", 1, 2), ("high_chars", 90, 100))


def _range(width: int) -> tuple[Column, Column]:
    """First and last end of a window of ``width`` units that takes a node: the
    node lies in the window and its parent does not."""
    own = F.expr("shiftleft(node, level)")
    size = F.expr("shiftleft(1L, level)")
    left = F.expr("node & 1") == 0
    first = F.when(left, own + size).otherwise(F.greatest(own + size, own - size + width + 1))
    last = F.when(left, F.least(own + size * 2 - 1, own + width)).otherwise(own + width)
    return first, last


def rollup(units: DataFrame, levels: int) -> DataFrame:
    """``grp, level, node, events, total, sizes, counts, kinds`` of every node
    with an event, from ``grp, unit, size, kind``; sizes ascend."""
    counted = units.groupBy("grp", "unit", "size", "kind").agg(F.count("*").alias("n"))
    lifted = counted.select("grp", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"), "unit", "size", "kind", "n").withColumn("node", F.expr("shiftright(unit, level)"))
    runs = lifted.groupBy("grp", "level", "node", "size").agg(F.sum("n").alias("n"), F.collect_set("kind").alias("kinds"))
    entry = F.when(F.col("size").isNotNull(), F.struct("size", "n"))
    nodes = runs.groupBy("grp", "level", "node").agg(F.sum("n").alias("events"), F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0)).alias("total"), F.array_sort(F.collect_list(entry)).alias("run"), F.array_distinct(F.flatten(F.collect_list("kinds"))).alias("kinds"))
    return nodes.select("grp", "level", "node", "events", "total", F.col("run.size").alias("sizes"), F.col("run.n").alias("counts"), "kinds")


def pieces(ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window (its place in ``ends``), level and node of the nodes that make up
    [end - width, end)."""
    lo, hi, of = ends - width, ends.copy(), np.arange(len(ends))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    level = 0
    while len(of):
        for odd, node in (((lo & 1) == 1, lo), ((hi & 1) == 1, hi - 1)):
            out.append((of[odd], np.full(int(odd.sum()), level), node[odd]))
        lo, hi = (lo + 1) >> 1, hi >> 1
        on = lo < hi
        lo, hi, of, level = lo[on], hi[on], of[on], level + 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (of, of, of)


def select_ranks(of: np.ndarray, node: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each window the least size at or below which its runs hold
    ``wanted`` elements (0: not asked for, 0 returned).

    ``of`` and ``node`` say which windows take which runs; run i lies from
    ``starts[i]`` to ``starts[i + 1]`` in ``sizes`` (ascending) and ``counts``.
    """
    axis, code = np.unique(sizes, return_inverse=True)
    if not len(axis):
        return np.zeros(len(wanted), np.int64)
    run = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    keys = run * len(axis) + code
    below = np.concatenate([[0], np.cumsum(counts)])
    lo, hi = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(axis) - 1)
    hi[wanted == 0] = 0
    base, before = node * len(axis), below[starts[node]]
    while (lo < hi).any():
        middle = (lo + hi) >> 1
        held = np.zeros(len(wanted), np.int64)
        np.add.at(held, of, below[np.searchsorted(keys, base + middle[of], "right")] - before)
        enough = held >= wanted
        lo, hi = np.where(enough | (lo >= hi), lo, middle + 1), np.where(enough & (lo < hi), middle, hi)
    return np.where(wanted > 0, axis[lo], 0)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins (one more than rows), and all elements."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], lists.values.slice(int(ends[0]), int(ends[-1] - ends[0]))


def _answer(table: pa.Table, widths: Sequence[int]) -> pa.Table:
    """Statistics of all windows that end in one block of one group."""
    asked = table["ask"].to_numpy()
    ends = np.sort(table["node"].to_numpy()[asked])
    nodes = table.filter(pa.array(~asked))
    known = nodes["level"].to_numpy().astype(np.int64) << 56 ^ nodes["node"].to_numpy() + (1 << 54)
    order = np.argsort(known)
    known = known[order]
    n = len(ends) * len(widths)
    of, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, width in enumerate(widths):
        window, level, node = pieces(ends, width)
        key = level << 56 ^ node + (1 << 54)
        place = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        there = known[place] == key if len(known) else np.zeros(len(key), bool)
        of.append(window[there] * len(widths) + i)
        at.append(order[place[there]])
    window, node = np.concatenate(of), np.concatenate(at)

    def added(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.add.at(out, window, values[node])
        return out

    starts, sizes = _flat(nodes["sizes"])
    _, counts = _flat(nodes["counts"])
    sizes, counts = sizes.to_numpy().astype(np.int64), counts.to_numpy().astype(np.int64)
    below = np.concatenate([[0], np.cumsum(counts)])
    m = added(below[starts[1:]] - below[starts[:-1]])
    first, kinds = _flat(nodes["kinds"])
    codes = kinds.dictionary_encode()
    different = max(1, len(codes.dictionary))
    code, each = codes.indices.to_numpy().astype(np.int64), np.diff(first)[node]
    # the kinds of every node of every window, one after the other
    place = np.repeat(first[:-1][node] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
    met = np.unique(np.repeat(window, each) * different + code[place])
    fields = {"n_events": added(nodes["events"].to_numpy()), "sum_chars": added(nodes["total"].to_numpy()), "n_langs": np.bincount(met // different, minlength=n)}
    columns = [pa.array(np.asarray(x, np.int64)) for x in fields.values()]
    for name, p, q in RANKS:
        fields[name] = select_ranks(window, node, starts, sizes, counts, -(-m * p // q))
        columns.append(pa.array(fields[name], mask=m == 0))
    stats = pa.StructArray.from_arrays(columns, list(fields))
    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1, dtype=np.int32) * len(widths)), stats)
    return pa.table({"grp": pa.repeat(table["grp"][0], len(ends)), "unit": pa.array(ends), "stats": rows})


def rolling(events: DataFrame, windows: Sequence[int], step: int = 60, id_col: str = "doc_id", group_col: str = "source", time_col: str = "event_s", size_col: str = "size", kind_col: str = "lang") -> DataFrame:
    """``doc_id, window_s, event_s, n_events, sum_chars, n_langs, median_chars,
    high_chars``: for each event and each of ``windows`` (seconds) what the
    events of its group hold whose time t has event_s - W <= t < event_s.

    Times and windows are whole multiples of ``step`` (1 will always do) of
    less than 2^53 units; others are refused.
    """
    if not windows or any(w <= 0 or w % step for w in windows):
        raise ValueError("windows must be positive multiples of the step")
    widths = [w // step for w in windows]
    time = F.col(time_col).cast("long")
    unit = F.when(time.isNull(), F.lit(None).cast("long")).when(F.pmod(time, F.lit(step)) == 0, F.expr(f"CAST(`{time_col}` AS BIGINT) DIV {step}")).otherwise(F.raise_error(F.lit("a time is no multiple of the step")).cast("long"))
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    keyed = events.select(F.col(id_col).alias("doc_id"), group.alias("grp"), unit.alias("unit"), F.col(size_col).cast("long").alias("size"), F.col(kind_col).cast("string").alias("kind"))
    nodes = rollup(keyed.where("unit IS NOT NULL"), max(widths).bit_length())

    none = F.array().cast("array<bigint>")
    blocks = none
    for width in widths:
        first, last = _range(width)
        blocks = F.concat(blocks, F.when(first <= last, F.sequence(F.shiftright(first, BLOCK_BITS), F.shiftright(last, BLOCK_BITS))).otherwise(none))
    # a unit with events also asks for the windows that end there
    own = F.when(F.col("level") == 0, F.array(F.struct(F.lit(True).alias("ask"), F.shiftright("node", BLOCK_BITS).alias("block"))))
    to = F.concat(F.transform(F.array_distinct(blocks), lambda b: F.struct(F.lit(False).alias("ask"), b.alias("block"))), F.coalesce(own, F.array().cast("array<struct<ask:boolean,block:bigint>>")))
    dealt = nodes.withColumn("to", F.explode(to)).select("grp", F.col("to.block").alias("block"), F.col("to.ask").alias("ask"), "level", "node", "events", "total", *[F.when(~F.col("to.ask"), F.col(c)).otherwise(F.array().cast(t)).alias(c) for c, t in (("sizes", "array<bigint>"), ("counts", "array<bigint>"), ("kinds", "array<string>"))])

    def answer(table: pa.Table) -> pa.Table:
        enter("windows")
        return _answer(table, widths)

    names = ["n_events", "sum_chars", "n_langs", *(r[0] for r in RANKS)]
    struct = ", ".join(f"{c}: bigint" for c in names)
    answered = materialize(dealt.groupBy("grp", "block").applyInArrow(answer, f"grp string, unit long, stats array<struct<{struct}>>"), "windows")
    empty = F.struct(*[F.lit(0 if c in names[:3] else None).cast("long").alias(c) for c in names])
    joined = keyed.select("doc_id", "grp", "unit").join(answered, ["grp", "unit"], "left")
    each = joined.select("doc_id", (F.col("unit") * step).alias("event_s"), F.posexplode(F.coalesce("stats", F.array(*[empty] * len(widths)))).alias("i", "stats"))
    return each.select("doc_id", F.element_at(F.array(*[F.lit(w).cast("long") for w in windows]), F.col("i") + 1).alias("window_s"), "event_s", *[F.col(f"stats.{c}").alias(c) for c in names])


def document_times(docs: DataFrame) -> DataFrame:
    """The time that each document is given: ``doc_id, event_s, source, lang,
    size`` with 60 * floor((doc_id + (h mod 10000)) / 6), h the CRC-32 of the
    id in decimal, and the code points of its text (null: none)."""
    late = F.col("doc_id").cast("long") + F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10000
    return docs.select("doc_id", late.alias("late"), "source", "lang", F.length("text").alias("size")).select("doc_id", F.expr("60L * ((late - pmod(late, 6L)) DIV 6L)").alias("event_s"), "source", "lang", "size")


#: DuckDB has no CRC-32, so it is folded over the digits with a table of bytes.
SQL = """
WITH bytes AS (SELECT list(c ORDER BY i) AS t FROM (
       SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS c FROM range(256) AS r(i))),
hashed AS (SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM documents AS d, bytes),
timed AS (SELECT doc_id, source, lang, length(text) AS size, 60 * CAST(floor((doc_id + h % 10000) / 6) AS BIGINT) AS event_s FROM hashed),
asked AS (SELECT DISTINCT source, event_s, w AS window_s FROM timed, (VALUES (600), (43200)) AS v(w)),
stats AS (SELECT a.source, a.event_s, a.window_s, count(b.event_s) AS n_events, coalesce(sum(b.size), 0) AS sum_chars, count(DISTINCT b.lang) AS n_langs, list_sort(list(b.size) FILTER (WHERE b.size IS NOT NULL)) AS sizes
          FROM asked AS a LEFT JOIN timed AS b ON a.source IS NOT DISTINCT FROM b.source AND b.event_s >= a.event_s - a.window_s AND b.event_s < a.event_s GROUP BY ALL)
SELECT d.doc_id, s.window_s::BIGINT AS window_s, d.event_s, s.n_events, s.sum_chars::BIGINT AS sum_chars, s.n_langs, sizes[(len(sizes) + 1) // 2] AS median_chars, sizes[(90 * len(sizes) + 99) // 100] AS high_chars
FROM timed AS d JOIN stats AS s ON d.source IS NOT DISTINCT FROM s.source AND d.event_s = s.event_s
"""
