"""What the operators of this subpackage share: the folder that the cluster
shares, written tables that cut lineage, and Arrow text buffers as numpy."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut, discard, free_shuffles

#: Text bytes that a Python worker handles at a time.
CHUNK_BYTES = 1 << 21


def materialize(df: DataFrame, label: str, compression: str | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back, so
    that a lost executor costs a reread and no operator runs twice."""
    return cut(df, f"llm-{label}", compression, options)


class Scratch:
    """Tables that an operator writes on its way and that go once a later one
    that it returns has been written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def write(self, df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
        self.tables.append(materialize(df, label, compression))
        return self.tables[-1]

    def drop(self, *tables: DataFrame) -> None:
        """Removes these now."""
        self.remove(*[t for t in self.tables if not any(t is x for x in tables)])

    def remove(self, *but: DataFrame) -> None:
        """Removes all that it has written, but for these."""
        kept = [t for t in self.tables if any(t is b for b in but)]
        discard(*[t for t in self.tables if not any(t is k for k in kept)])
        self.tables = kept

    def free(self, spark: SparkSession) -> None:
        """Frees shuffle files of what has been written by now."""
        free_shuffles(spark)


def apart(key: str) -> Column:
    """A long key as another expression. A side that was just aggregated by
    ``key`` is shuffled once more when it is joined on this, as a plain
    exchange, and only between two of those does Spark split a hot key."""
    return F.bitwise_not(F.col(key))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


_owner: list = ["", None]


def enter(name: str, leave: Callable[[], None] | None = None) -> None:
    """Says which operator a Python worker now works for.

    Spark reuses workers, so what one operator keeps between tasks (tables of
    words) would stay while another runs. On a change the former's ``leave`` is
    called and freed memory goes back to the system.
    """
    if _owner[0] == name:
        return
    if _owner[1] is not None:
        _owner[1]()
    _owner[:] = name, leave
    release()


def release() -> None:
    """Gives freed memory back to the system: a worker that waits for its next
    task shouldn't hold what the last one needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


class TextChunk:
    """Consecutive rows of a text column: their UTF-8 bytes without copying.

    ``data`` holds the rows' bytes one after the other, ``offsets`` where each
    begins (one more than rows), ``lo``/``hi`` the rows of the batch. Null
    texts have no bytes; ``valid`` tells them from empty ones.
    """

    __slots__ = ("data", "hi", "lo", "offsets", "valid")

    def __init__(self, data, offsets, valid, lo, hi):
        self.data, self.offsets, self.valid, self.lo, self.hi = data, offsets, valid, lo, hi

    def __len__(self) -> int:
        return self.hi - self.lo

    def rows(self) -> Iterator[bytes]:
        whole = self.data.tobytes()
        at = self.offsets.tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield whole[a:b]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES, operator: str | None = None) -> Iterator[TextChunk]:
    """Cuts a string column into runs of rows of about ``most`` bytes; a longer
    text is a run of its own and is never cut."""
    if operator is not None:
        enter(operator)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, where, held = column.buffers()
    ends = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    valid = np.asarray(column.is_valid())
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
        hi = min(hi, n)
        a, b = int(ends[lo]), int(ends[hi])
        yield TextChunk(data[a:b], (ends[lo : hi + 1] - a).astype(np.int64), valid[lo:hi], lo, hi)
        lo = hi
