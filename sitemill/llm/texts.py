"""Counts of whole texts that the classifier and the rules are built on."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TextChunk, text_chunks

SYMBOLS = b"#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _CONTINUED, _SPACES = bytes(range(48, 58)), bytes(range(0x80, 0xC0)), b" \t\n\v\f\r"
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LATIN_UPPER = re.compile(rb"\xc3[\x80-\x9e]").findall


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` that are found twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(raw: bytes, words: list[bytes]) -> tuple[int, ...]:
    """Words are runs outside the six ASCII white-space bytes."""
    spaces = _count(raw, _SPACES)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(words), len(raw) - _count(raw, _CONTINUED) - spaces, _count(raw, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words)


def upper_count(raw: bytes) -> int:
    return _count(raw, _UPPER) + (len(_LATIN_UPPER(raw)) if b"\xc3" in raw else 0)


FEATURES = ("log_bytes", "log_words", "word_length", "symbols", "bangs", "pipes", "upper", "digits", "punctuation", "lines", "dup_lines", "distinct", "next_same", "spaces", "non_ascii", "endings")


def features(raw: bytes) -> tuple[float, ...]:
    """Numbers about a text's form; all finite, also for an empty text."""
    from math import log1p

    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    lines = raw.split(b"\n")
    upper, lower = upper_count(raw), _count(raw, _LOWER)
    return (
        log1p(len(raw)), log1p(len(words)), size / n, _count(raw, SYMBOLS) / size, raw.count(b"!") / n, raw.count(b"|") / n,
        upper / max(1, upper + lower), _count(raw, _DIGITS) / size, _count(raw, _PUNCTUATION) / size, len(lines) / n,
        1 - len(set(lines)) / len(lines), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, _count(raw, _SPACES) / size,
        1 - len(raw.translate(None, bytes(range(128, 256)))) / size, (raw.count(b". ") + raw.count(b".\n")) / n,
    )


def map_texts(docs: DataFrame, keep: list[str], schema: str, work: Callable[[TextChunk], list[pa.Array]], text_col: str = "text") -> DataFrame:
    """``work`` over runs of whole texts, in one narrow map.

    Returns a column ``kept`` (a struct of the columns of ``keep``, so no name
    can clash) and those of ``schema``, which ``work`` gives in its order.
    """
    kept = F.struct(*[F.col(c) for c in keep])
    rows = docs.select(kept.alias("kept"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = T.StructType([rows.schema["kept"], *T.StructType.fromDDL(schema)])
    names = ["kept", *(x.split()[0] for x in schema.split(", "))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(1), operator="texts"):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), *work(chunk)], names)

    return rows.mapInArrow(run, out)


def held_out(id_col: str) -> F.Column:
    """Whether the CRC-32 of the id as text leaves 2 on division by 4; a null
    id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 4 == 2
