"""Truncated decompositions of products too wide for one task.

A base is the product L R of many components: L holds a column for each (m
values), R a row (n values). Here neither side is ever whole anywhere. Both are
dealt in blocks of at most about ``COMPONENTS`` components by ``EDGE`` values,
and the product meets only thin matrices of target + ``SPARE`` columns:

- ``multiply`` joins blocks with the matching rows of a thin matrix and adds up
  the products by block, so L (R V) takes two shuffles of thin rows.
- ``orthonormal`` is a QR in a tree: every block of a thin matrix gives its
  small triangle, triangles are stacked ``FAN`` at a time and reduced again, and
  the last one turns every block into columns of an orthonormal matrix. It goes
  twice, so that columns that were nearly dependent are orthogonal too.
- ``decompose`` passes a thin matrix back and forth (subspace iteration) until
  the singular values that are wanted stand still to ``TOLERANCE`` of the
  greatest, or the product has no more of them than columns; then it is exact
  after the first pass.

A task holds a block, or a few thin blocks of one place; the driver sees the
singular values of each base, which are as many as the bank has components.
Joins are by shuffles (``merge``), so that a stage ends between two steps in
Python: a task has one Python process, and a batch of results few blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, discard

EDGE, COMPONENTS, FAN, SPARE = 512, 512, 8, 8
#: Bytes of results that a task gathers before it hands them on, about.
RESULTS = 4 << 20
TOLERANCE, MOST_ROUNDS = 1e-13, 100


def _mat(x: pa.Scalar, width: int) -> np.ndarray:
    return x.values.to_numpy().reshape(-1, width)


def _rows(names: list[str], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array([x.reshape(-1) if isinstance(x, np.ndarray) else x for x in c], schema.field(n).type) for n, c in zip(names, columns, strict=True)], names)


def _batches(names: list[str], rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows that end with a matrix or numbers, in batches of about ``RESULTS`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += row[-1].nbytes
        if size >= RESULTS:
            yield _rows(names, held, schema)
            held, size = [], 0
    if held:
        yield _rows(names, held, schema)


def _schema(kind: pa.DataType, *longs: str) -> pa.Schema:
    return pa.schema([("base", kind), *[(n, pa.int64()) for n in longs], ("mat", pa.list_(pa.float64()))])


def _ddl(kind: str, *longs: str) -> str:
    return ", ".join([f"base {kind}", *[f"{n} bigint" for n in longs], "mat array<double>"])


def blocks(rows: DataFrame, factor: str, groups: DataFrame, edge: int) -> DataFrame:
    """``base, g, b, tag, mat``: components of group g by values of block b.
    ``tag`` tells which components a group has."""
    kind = dict(rows.dtypes)["base"]
    own = rows.where(F.col("factor") == factor).join(groups, "base").withColumn("g", F.pmod(F.xxhash64("client", "r"), F.col("groups")))
    starts = F.sequence(F.lit(0), F.expr(f"(size(vec) - 1) DIV {edge}"))
    cells = own.where(F.size("vec") > 0).select("base", "g", "client", "r", "vec", "share", F.explode(starts).alias("b"))
    slices = cells.select("base", "g", "client", "r", F.col("b").cast("bigint").alias("b"), F.transform(F.slice("vec", F.col("b") * edge + 1, edge), lambda x: x * F.col("share")).alias("part"))

    def stack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("client", "ascending"), ("r", "ascending")])
        tag = zlib.crc32(np.stack([table["client"].to_numpy(), table["r"].to_numpy().astype(np.int64)]).tobytes())
        schema = _schema(table.schema.field("base").type, "g", "b", "tag")
        mat = table["part"].combine_chunks().flatten().to_numpy()
        return pa.Table.from_batches([_rows(schema.names, [(table["base"][0].as_py(), table["g"][0].as_py(), table["b"][0].as_py(), tag, mat)], schema)])

    return cut(slices.groupBy("base", "g", "b").applyInArrow(stack, _ddl(kind, "g", "b", "tag")), f"wide-{factor}")


def multiply(left: DataFrame, thin: DataFrame, columns: int, back: bool) -> DataFrame:
    """Blocks times the rows of a thin matrix (``base, at, tag, mat``) at
    their values; or, if ``back``, turned blocks times its rows at their
    components."""
    kind = dict(left.dtypes)["base"]
    over, into = ("g", "b") if back else ("b", "g")
    met = left.select("base", F.col(over).alias("at"), F.col(into).alias("to"), F.col("tag").alias("own"), F.col("mat").alias("block")).join(thin.select("base", "at", "tag", F.col("mat").alias("thin")).hint("merge"), ["base", "at"])

    def product(base: pa.Scalar, to: pa.Scalar, own: pa.Scalar, block: pa.Scalar, tag: pa.Scalar, right: pa.Scalar) -> tuple:
        v = _mat(right, columns)
        if back:
            if own.as_py() != tag.as_py():
                raise ValueError("factors without their partner")
            x = block.values.to_numpy().reshape(len(v), -1).T
        else:
            x = block.values.to_numpy().reshape(-1, len(v))
        return base.as_py(), to.as_py(), 0 if back else own.as_py(), x @ v

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _schema(batch.schema.field("base").type, "at", "tag")
            yield from _batches(schema.names, map(product, *[batch.column(n) for n in ("base", "to", "own", "block", "tag", "thin")]), schema)

    def add(table: pa.Table) -> pa.Table:
        schema = _schema(table.schema.field("base").type, "at", "tag")
        total = np.zeros(len(table["mat"][0]))
        for x in table["mat"]:
            total += x.values.to_numpy()
        return pa.Table.from_batches([_rows(schema.names, [(table["base"][0].as_py(), table["at"][0].as_py(), table["tag"][0].as_py(), total)], schema)])

    ddl = _ddl(kind, "at", "tag")
    return met.select("base", "to", "own", "block", "tag", "thin").mapInArrow(products, ddl).groupBy("base", "at").applyInArrow(add, ddl)


def triangles(thin: DataFrame, columns: int, work: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """``base, blocks, mat``: the small triangle of a QR of each base's whole
    thin matrix, by a tree, and its number of blocks; or ``work`` on the
    triangle, where it is made."""
    kind = dict(thin.dtypes)["base"]
    ddl = _ddl(kind, "at", "blocks")

    def reduce(rows: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(rows, mode="r")
        return np.vstack([r, np.zeros((columns - len(r), columns))]) if len(r) < columns else r

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _schema(batch.schema.field("base").type, "at", "blocks")
            yield from _batches(schema.names, ((b.as_py(), a.as_py(), a.as_py() + 1, reduce(_mat(m, columns))) for b, a, m in zip(batch.column("base"), batch.column("at"), batch.column("mat"), strict=True)), schema)

    def stacked(table: pa.Table, done: Callable[[np.ndarray], np.ndarray]) -> pa.Table:
        schema = _schema(table.schema.field("base").type, "at", "blocks")
        below = np.vstack([_mat(m, columns) for m in table["mat"]])
        return pa.Table.from_batches([_rows(schema.names, [(table["base"][0].as_py(), table["at"][0].as_py(), max(table["blocks"].to_pylist()), done(reduce(below)))], schema)])

    def join(table: pa.Table) -> pa.Table:
        return stacked(table, lambda r: r)

    def root(table: pa.Table) -> pa.Table:
        return stacked(table, work or (lambda r: r))

    out = thin.select("base", "at", "mat").mapInArrow(leaves, ddl)
    most = thin.agg(F.coalesce(F.max("at"), F.lit(0)).alias("m")).first()["m"]
    while most >= FAN:
        most //= FAN
        out = out.withColumn("at", F.expr(f"at DIV {FAN}")).groupBy("base", "at").applyInArrow(join, ddl)
    return out.withColumn("at", F.lit(0).cast("bigint")).groupBy("base", "at").applyInArrow(root, ddl).select("base", "blocks", "mat")


def turned(thin: DataFrame, turns: DataFrame, columns: int) -> DataFrame:
    """Every block of a thin matrix times its base's ``turns`` (``base,
    blocks, mat``), which go to the blocks' own places."""
    kind = dict(thin.dtypes)["base"]
    placed = turns.select("base", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("at"), F.col("mat").alias("turn"))
    met = thin.select("base", "at", "mat").join(placed.hint("merge"), ["base", "at"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = _schema(batch.schema.field("base").type, "at", "tag")
            yield from _batches(schema.names, ((b.as_py(), a.as_py(), 0, _mat(m, columns) @ t.values.to_numpy().reshape(columns, -1)) for b, a, m, t in zip(*[batch.column(n) for n in ("base", "at", "mat", "turn")], strict=True)), schema)

    return met.mapInArrow(run, _ddl(kind, "at", "tag"))


def _of_triangles(found: DataFrame, columns: int, work, name: str = "mat") -> DataFrame:  # noqa: ANN001
    """``work`` on each base's small triangle."""
    ddl = f"base {dict(found.dtypes)['base']}, blocks bigint, {name} array<double>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([("base", batch.schema.field("base").type), ("blocks", pa.int64()), (name, pa.list_(pa.float64()))])
            yield from _batches(schema.names, ((b.as_py(), n.as_py(), work(_mat(m, columns))) for b, n, m in zip(*[batch.column(c) for c in ("base", "blocks", "mat")], strict=True)), schema)

    return found.mapInArrow(run, ddl)


def _whitening(r: np.ndarray) -> np.ndarray:
    _, s, vt = np.linalg.svd(r)
    kept = s > (s[0] if len(s) else 0) * 1e-13
    return vt.T * np.where(kept, 1 / np.where(kept, s, 1), 0)


def orthonormal(thin: DataFrame, columns: int, passes: int = 2) -> DataFrame:
    """A thin matrix whose columns are orthonormal, or zero, and span the same."""
    for _ in range(passes):
        thin = cut(thin, "thin")
        thin = turned(thin, triangles(thin, columns, _whitening), columns)
    return cut(thin, "thin")


def decompose(rows: DataFrame, target: int, edge: int | None = None, components: int | None = None, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """``base, factor, r, vec`` of the best approximation of rank ``target`` of
    each base's product, from ``base, client, factor, r, vec, share``: B has
    orthonormal columns, A descending rows, both zero where the product has no
    such component."""
    edge, columns = edge or EDGE, target + SPARE
    kind = dict(rows.dtypes)["base"]
    groups = cut(rows.where("factor = 'A'").groupBy("base").agg(F.ceil(F.count("*") / (components or COMPONENTS)).cast("bigint").alias("groups")), "groups")
    a, b = blocks(rows, "A", groups, edge), blocks(rows, "B", groups, edge)

    def start(table: pa.Table) -> pa.Table:
        base, at, width = (table[c][0].as_py() for c in ("base", "b", "width"))
        rng = np.random.default_rng(zlib.crc32(f"{base} {at}".encode()))
        schema = _schema(table.schema.field("base").type, "at", "tag")
        return pa.Table.from_batches([_rows(schema.names, [(base, at, 0, rng.normal(size=(width, columns)))], schema)])

    widths = rows.where("factor = 'A' AND size(vec) > 0").groupBy("base").agg(F.max(F.size("vec")).cast("bigint").alias("n"))
    places = widths.select("base", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) DIV {edge}"))).alias("b")).select("base", "b", F.least(F.lit(edge), F.col("n") - F.col("b") * edge).alias("width"))
    right = places.groupBy("base", "b").applyInArrow(start, _ddl(kind, "at", "tag"))
    before: dict[object, np.ndarray] = {}
    for _ in range(most_rounds):
        left = orthonormal(multiply(b, multiply(a, right, columns, False), columns, True), columns)
        right = cut(multiply(a, multiply(b, left, columns, False), columns, True), "thin")
        small = cut(triangles(right, columns), "triangles")
        values = _of_triangles(small, columns, lambda r: np.linalg.svd(r, compute_uv=False), "s")
        now = {r["base"]: np.array(r["s"]) for r in values.collect()}  # as many numbers as the bank has components
        if all(s[-1] <= s[0] * 1e-12 or (k in before and np.abs(s - before[k])[:target].max() <= TOLERANCE * s[0]) for k, s in now.items()):
            break
        before, right = now, orthonormal(right, columns, 1)  # a start needs no more
    turns = _of_triangles(small, columns, lambda r: np.linalg.svd(r)[2][:target].T)

    def components_of(thin: DataFrame, turns: DataFrame, factor: str) -> DataFrame:
        parts = turned(thin, turns, columns).select("base", "at", F.posexplode("mat").alias("i", "x"))
        cells = parts.groupBy("base", F.expr(f"CAST(i % {target} AS INT)").alias("r"), "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("part"))
        whole = cells.groupBy("base", "r").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda c: c["part"])).alias("vec"))
        return whole.select("base", F.lit(factor).alias("factor"), "r", "vec")

    # the left side has blocks of its own number
    for_left = left.groupBy("base").agg((F.max("at") + 1).alias("n")).join(turns, "base").select("base", F.col("n").alias("blocks"), "mat")
    out = cut(components_of(left, for_left, "B").union(components_of(right, turns, "A")), "wide")
    discard(a, b, groups)
    return out
