"""Table functions for SQL; rows travel in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegralType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class FitRank:
    """Factors cut or filled to a rank: ``fit_rank(TABLE(factors), k)``.

    The table has components ``r, vec`` and any columns that tell factors
    apart; the result has the same columns, whatever they are. Each factor keeps
    its components below k, and those up to k that it lacks come as zeros of its
    own width. Spark deals rows by the other columns and orders them by ``r``,
    as ``analyze`` asks it to, so a factor is met by one task, a component at a
    time, and only the last one is kept. Gaps in ``r`` are filled; a doubled,
    null or negative one, a null vector and vectors of different widths are
    refused. Null keys are keys.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, rank: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("fit_rank takes a table")
        if not rank.isConstantExpression or not isinstance(rank.value, int) or rank.value <= 0:
            raise ValueError("fit_rank takes a positive constant rank")
        kinds = {f.name: f.dataType for f in table.dataType.fields}
        if not isinstance(kinds.get("r"), IntegralType) or not isinstance(kinds.get("vec"), ArrayType):
            raise ValueError("fit_rank takes a table with a whole-number r and an array vec")
        keys = [n for n in kinds if n not in ("r", "vec")]
        return AnalyzeResult(schema=table.dataType, withSinglePartition=not keys, partitionBy=[PartitioningColumn(f"`{n}`") for n in keys], orderBy=[OrderingColumn("r")])

    def __init__(self):
        self.last: Row | None = None
        self.next = self.rank = 0

    def _zeros(self, like: Row, end: int) -> Iterator[tuple]:
        """The components before ``end`` that the factor of a row lacks."""
        filled = like.asDict() | {"vec": [0.0] * len(like["vec"])}
        for r in range(self.next, end):
            yield tuple((filled | {"r": r})[n] for n in like.__fields__)

    def eval(self, row: Row, rank: int) -> Iterator[tuple]:
        self.rank, r, vec = rank, row["r"], row["vec"]
        if r is None or vec is None or r < 0:
            raise ValueError(f"a component without a number or a vector: {r}")
        if self.last is not None and (r == self.last["r"] or len(vec) != len(self.last["vec"])):
            raise ValueError(f"component {r} is there twice or has another width")
        self.last = row
        if r < rank:
            yield from self._zeros(row, r)
            yield tuple(row)
            self.next = r + 1

    def terminate(self) -> Iterator[tuple]:
        if self.last is not None:
            yield from self._zeros(self.last, self.rank)


def register(spark: SparkSession) -> None:
    """Makes ``fit_rank`` known to SQL."""
    spark.udtf.register("fit_rank", udtf(FitRank, useArrow=True))
