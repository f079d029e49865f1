"""Removal of repeated runs of sentences.

A text is cut into sentences behind full stops, question and exclamation marks
of any script and line feeds, each with the white space behind it, so that they
join to the same text. A word is a run without white space, or one character of
a script that is written without spaces. A sentence of over ``LONG`` words (a
list, prose without stops, a word over and over) is cut into pieces, which count
as sentences: between two words that say so by their own letters and lengths, one
pair in ``RATE`` by chance, so a passage is cut alike wherever it stands; and
every ``LONG`` words from there, where none does.

From every sentence a run goes over the fewest sentences, two at least, that
hold ``LEAST`` words. Runs are hashed, and the first run of a hash in the order
of (doc_id, place) stays; every sentence in any later run of it goes. Runs are
measured in words since short lines are alike by chance, while a passage of over
50 words may hold two or three long sentences, the first grown together with what
stands before it. A text of fewer words is one run, if it has two sentences.

Runs are compared by a 128-bit hash of their trimmed sentences, so only
fixed-size keys are shuffled: once to find hashes that occur twice, combined on
the map side, and once to join them back. Sides of joins are written first, so
that a hot run, or many rows of one id and text, is split by the skewed join.
Texts come back only in the last join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, TextChunk, text_chunks

#: Words of a run, most words of a sentence, and one pair of words in so many by chance that cuts a longer one.
LEAST, LONG, RATE = 20, 16, 6
# Marks that end a sentence.
ENDS = ".!?\n。！？｡．؟۔।॥…"
# First and last characters of scripts without spaces (Thai and Lao, Burmese, Khmer, Chinese and Japanese).
UNSPACED = "".join(f"{a}-{b}" for a, b in (("\u0e00", "\u0eff"), ("\u1000", "\u109f"), ("\u1780", "\u17ff"), ("\u2e80", "\u2fdf"), ("\u3005", "\u3007"), ("\u3040", "\u30ff"), ("\u3400", "\u4dbf"), ("\u4e00", "\u9fff"), ("\uf900", "\ufaff"), ("\U00020000", "\U0003ffff")))
SPACE = r"\x20\x09-\x0D"
PATTERN = rf"[^{ENDS}]*[{ENDS}]+[ \n\t\r]*|[^{ENDS}]+".replace("\n", r"\n")
WORDS = rf"[{UNSPACED}]|[^{SPACE}{UNSPACED}]+"
#: Words with the white space around them, which join to any text that has one.
SPACED = rf"[{SPACE}]*(?:{WORDS})[{SPACE}]*"

_find = re.compile(PATTERN).findall
_LONE = [(ord(a), ord(b)) for a, b in re.findall("(.)-(.)", UNSPACED)]


def sentences(text: str) -> tuple[list[str], np.ndarray]:
    """The sentences of a text, which join to it, and their words: all words of
    a text are told at once, in arrays of its code points."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(code):
        return [], np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum([len(p) for p in _find(text)])))[:-1]
    solid, lone = ~((code == 32) | ((code >= 9) & (code <= 13))), np.zeros(len(code), bool)
    if code.max() >= _LONE[0][0]:
        for a, b in _LONE:
            lone |= (code >= a) & (code <= b)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | lone[1:] | lone[:-1]
    begins[starts] = solid[starts]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | begins[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    of = np.searchsorted(starts, first, "right") - 1
    is_long = np.bincount(of, minlength=len(starts)) > LONG
    cut = np.zeros(len(first), bool)
    if is_long.any():
        opens = np.ones(len(first), bool)
        opens[1:] = of[1:] != of[:-1]
        size, x, y = last - first + 1, code[first].astype(np.int64), code[last].astype(np.int64)
        says = np.zeros(len(first), bool)
        says[1:] = (31 * x[1:] + 17 * y[:-1] + 7 * size[1:] + 3 * size[:-1]) % RATE == 0
        says &= is_long[of] & ~opens
        at = np.arange(len(first))
        since = at - np.maximum.accumulate(np.where(opens | says, at, 0))
        cut = says | (is_long[of] & (since > 0) & (since % LONG == 0))
    bounds = np.sort(np.concatenate((starts, first[cut], [len(code)])))
    words = np.diff(np.searchsorted(first, bounds))
    at = bounds.tolist()
    return [text[a:b] for a, b in zip(at, at[1:], strict=False)], words


def runs(words: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """[first, end) of the run from each sentence that has one."""
    n = len(words)
    upto = np.concatenate(([0], np.cumsum(words)))
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + least), np.arange(n) + 2)
    found = np.flatnonzero(ends <= n)
    return list(zip(found.tolist(), ends[found].tolist(), strict=True)) or ([(0, n)] if n > 1 else [])


def run_keys(raw: bytes, least: int = LEAST) -> tuple[list[int], list[bytes]]:
    """Where runs begin, and a 128-bit key of the trimmed sentences of each."""
    import xxhash

    parts, words = sentences(raw.decode())
    found = runs(words, least)
    bare = [p.strip(" \n\t\r").encode() for p in parts]
    return [a for a, _ in found], [xxhash.xxh3_128_digest(b"\n".join(bare[a:b])) for a, b in found]


def without(raw: bytes, places: list[int], least: int = LEAST) -> tuple[int, int, bytes]:
    """Sentences, those removed, and the text without the runs at ``places``."""
    parts, words = sentences(raw.decode())
    if not places:
        return len(parts), 0, raw
    ends = dict(runs(words, least))
    gone = {i for p in places for i in range(p, ends[p])}
    return len(parts), len(gone), "".join([p for i, p in enumerate(parts) if i not in gone]).encode()


def remove_repeated_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_sentences, n_removed, kept_text`` of every document.

    Null texts are empty and stay so; blank texts of several rows are copies.
    Rows that agree in id and text count as one occurrence (nothing tells them
    apart), ties of id are broken by text digest, and a null id comes first. A
    long text is handled alone, in memory a few times its size. Other columns
    are not read, so their names don't matter; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("cid"), text.alias("text"))

    def runs_of(chunk: TextChunk) -> tuple[np.ndarray, list[pa.Array]]:
        found = [run_keys(t, least) for t in chunk.rows()]
        of = np.repeat(np.arange(len(found)), [len(places) for places, _ in found])
        return of, [pa.array([p for places, _ in found for p in places], pa.int32()), pa.array([k for _, keys in found for k in keys], pa.binary())]

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column(2), 1 << 20, "sentences"):
                of, own = runs_of(chunk)
                at = pa.array(of + chunk.lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *own], ["doc_id", "cid", "place", "key"])

    names = [rows.schema["doc_id"], rows.schema["cid"]]
    scratch = Scratch()
    found = scratch.write(rows.mapInArrow(emit, T.StructType([*names, *T.StructType.fromDDL("place int, key binary")])), "runs")
    first = found.groupBy("key").agg(F.min(F.struct("doc_id", "cid", "place")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("k"), "first")
    first = scratch.write(first, "first")  # so that a hot run's rows can be split in the join
    later = found.join(first, F.col("key") == F.col("k")).where(~F.struct("doc_id", "cid", "place").eqNullSafe(F.col("first")))
    marks = later.groupBy("doc_id", "cid").agg(F.collect_set("place").alias("places")).select(F.col("doc_id").alias("of_id"), F.col("cid").alias("of_cid"), "places")
    marks = scratch.write(marks, "marks")
    scratch.remove(marks)
    joined = rows.join(marks, (F.col("cid") == F.col("of_cid")) & F.col("doc_id").eqNullSafe(F.col("of_id")), "left").select("doc_id", "text", "places")

    def rebuild(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            for chunk in text_chunks(batch.column(1), 1 << 20, "sentences"):
                n, gone, kept = zip(*(without(t, places[chunk.lo + k].as_py() or [], least) for k, t in enumerate(chunk.rows())), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.lo, len(chunk)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], ["doc_id", "n_sentences", "n_removed", "kept_text"])

    return joined.mapInArrow(rebuild, T.StructType([names[0], *T.StructType.fromDDL("n_sentences long, n_removed long, kept_text string")]))


#: The same in DuckDB over the table ``documents``.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS cid FROM documents),
u AS (SELECT DISTINCT cid, text FROM d),
a AS (SELECT cid, unnest(l) AS part, unnest(range(1, len(l) + 1)) AS i FROM (SELECT cid, regexp_extract_all(text, '{PATTERN}') AS l FROM u)),
b AS (SELECT *, len(regexp_extract_all(part, '{WORDS}')) AS n FROM a),
k AS (
  SELECT cid, i, unnest(l) AS spaced, unnest(range(1, len(l) + 1)) AS j
  FROM (SELECT cid, i, regexp_extract_all(part, '{SPACED}') AS l FROM b WHERE n > {LONG})),
k2 AS (SELECT *, trim(spaced, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM k),
k3 AS (SELECT *, lag(bare) OVER (PARTITION BY cid, i ORDER BY j) AS before FROM k2),
k4 AS (
  SELECT *, sum(CASE WHEN before IS NOT NULL AND (31 * ord(bare[1]) + 17 * ord(before[-1]) + 7 * length(bare) + 3 * length(before)) % {RATE} = 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY cid, i ORDER BY j) AS piece FROM k3),
k5 AS (SELECT *, (row_number() OVER (PARTITION BY cid, i, piece ORDER BY j) - 1) // {LONG} AS again FROM k4),
k6 AS (SELECT cid, i, min(j) AS j, string_agg(spaced, '' ORDER BY j) AS part, count(*) AS n FROM k5 GROUP BY cid, i, piece, again),
s0 AS (SELECT cid, part, n, row_number() OVER (PARTITION BY cid ORDER BY i, j) AS i
  FROM (SELECT cid, i, 0 AS j, part, n FROM b WHERE n <= {LONG} UNION ALL SELECT cid, i, j, part, n FROM k6)),
t AS (
  SELECT cid, list(part ORDER BY i) AS parts, list(trim(part, chr(32) || chr(10) || chr(9) || chr(13)) ORDER BY i) AS bare FROM s0 GROUP BY cid),
s AS (SELECT cid, i, n AS own, sum(n) OVER (PARTITION BY cid ORDER BY i) AS upto FROM s0),
e AS (SELECT cid, upto, min(i) AS stop FROM s GROUP BY cid, upto),
p AS (
  SELECT s.cid, s.i - 1 AS place, greatest(e.stop, s.i + 1) AS stop
  FROM s ASOF JOIN e ON s.cid = e.cid AND e.upto >= s.upto - s.own + {LEAST}),
p2 AS (SELECT p.* FROM p JOIN t USING (cid) WHERE stop <= len(bare)),
w AS (
  SELECT cid, place, stop FROM p2
  UNION ALL SELECT cid, 0, len(bare) FROM t WHERE len(bare) > 1 AND NOT EXISTS (SELECT 1 FROM p2 WHERE p2.cid = t.cid)),
r AS (
  SELECT w.cid, place, stop, md5(array_to_string(list_slice(bare, place + 1, stop), chr(10))) AS key
  FROM w JOIN t USING (cid)),
m AS (
  SELECT doc_id, cid, place, stop FROM (
    SELECT doc_id, cid, place, stop, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, cid, place) AS nth
    FROM r JOIN (SELECT DISTINCT doc_id, cid FROM d) USING (cid)) WHERE nth > 1),
g AS (SELECT DISTINCT doc_id, cid, unnest(range(place, stop)) AS s FROM m),
l AS (SELECT doc_id, cid, list(s) AS gone FROM g GROUP BY doc_id, cid)
SELECT d.doc_id, CAST(coalesce(len(t.parts), 0) AS BIGINT) AS n_sentences, CAST(coalesce(len(l.gone), 0) AS BIGINT) AS n_removed,
       CASE WHEN l.gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(t.parts) + 1), lambda i: NOT list_contains(l.gone, i - 1)), lambda i: t.parts[i]), ''), '') END AS kept_text
FROM d LEFT JOIN t USING (cid) LEFT JOIN l ON d.cid = l.cid AND d.doc_id IS NOT DISTINCT FROM l.doc_id
"""
