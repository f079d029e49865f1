"""Rolling windows against brute force: odd rows, dense moments, hot groups."""

import os
import random
from collections import Counter

import duckdb
import pytest

from sitemill.llm import queries, windows

SCHEMA = "id long, grp string, at long, size long, lang string, unit string, node string, stats string"


def brute(rows, widths):
    out = []
    for i, group, at, *_ in rows:
        for w in widths:
            inside = [] if at is None else [r for r in rows if r[1] == group and r[2] is not None and at - w <= r[2] < at]
            sizes = sorted(r[3] for r in inside if r[3] is not None)
            m = len(sizes)
            ranks = [sizes[-(-m * p // q) - 1] if m else None for _, p, q in windows.RANKS]
            out.append((i, w, at, len(inside), sum(sizes), len({r[4] for r in inside} - {None}), *ranks))
    return Counter(out)


def got(frame, widths, step):
    columns = ["doc_id", "window_s", "event_s", "n_events", "sum_chars", "n_langs", "median_chars", "high_chars"]
    found = windows.rolling(frame, widths, step, "id", "grp", "at", "size", "lang")
    assert found.columns == columns
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("step", [1, 60])
def test_windows_against_brute_force(spark, step):
    rng = random.Random(step)
    rows = []
    for i in range(400):
        group = rng.choice(["hot", "hot", "a", "", None, "="])
        at = rng.choice([None, *[step * rng.randint(-300, 900) for _ in range(8)], 7 * step, 7 * step])
        rows.append((i if i % 9 else None, group, at, rng.choice([None, 0, 5, 5, rng.randint(0, 10**12)]), rng.choice(["en", "de", "", None]), "u", "n", "s"))
    rows += rows[:5] + [(1000, "alone", 0, 3, "en", "u", "n", "s"), (1001, "bare", 5 * step, None, None, "u", "n", "s"), (1002, "bare", 6 * step, None, None, "u", "n", "s")]
    widths = [step, 10 * step, 720 * step, 1023 * step]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(frame, widths, step) == brute(rows, widths)


def test_one_moment_with_most_rows(spark):
    """Rows of one group and moment are one run, whatever their number."""
    frame = spark.range(60_000).selectExpr("id", "'g' AS grp", "IF(id % 3 = 0, id DIV 3 % 50, 40) AS at", "id % 100 AS size", "'en' AS lang")
    nodes = windows.rollup(frame.selectExpr("grp", "at AS unit", "size", "lang AS kind"), 4)
    assert nodes.selectExpr("max(size(sizes))").first()[0] <= 100
    rows = [tuple(r) for r in frame.where("at <= 41").collect()]
    found = windows.rolling(frame, [30], 1, "id", "grp", "at", "size", "lang").where("event_s = 41").first()
    sizes = sorted(r[3] for r in rows if 11 <= r[2] < 41)
    assert (found["n_events"], found["sum_chars"], found["median_chars"], found["high_chars"]) == (len(sizes), sum(sizes), sizes[-(-len(sizes) // 2) - 1], sizes[-(-90 * len(sizes) // 100) - 1])


def test_every_window_is_covered_once():
    import numpy as np

    for width in (1, 2, 7, 10, 63, 64, 720):
        ends = np.arange(-50, 900)
        window, level, node = windows.pieces(ends, width)
        covered = Counter()
        for w, lv, k in zip(window.tolist(), level.tolist(), node.tolist(), strict=True):
            covered.update((w, u) for u in range(k << lv, (k + 1) << lv))
        assert covered == Counter((i, u) for i, end in enumerate(ends.tolist()) for u in range(end - width, end))
        assert max(Counter(window.tolist()).values()) <= 2 * width.bit_length()


def test_refusals_and_empty_tables(spark, none):
    empty = spark.createDataFrame([], SCHEMA)
    assert windows.rolling(empty, [60], 60, "id", "grp", "at", "size", "lang").count() == 0
    assert windows.rolling(windows.document_times(none), queries.WINDOWS).count() == 0
    for bad in ([], [0], [90]):
        with pytest.raises(ValueError):
            windows.rolling(empty, bad, 60, "id", "grp", "at", "size", "lang")
    odd = spark.createDataFrame([(1, "g", 61, 1, "en", "", "", "")], SCHEMA)
    with pytest.raises(Exception, match="no multiple of the step"):
        windows.rolling(odd, [60], 60, "id", "grp", "at", "size", "lang").collect()


def test_documents_with_nulls(odd):
    """Two rows a document, also without an id; those have no time and empty windows."""
    rows = windows.rolling(windows.document_times(odd), queries.WINDOWS).collect()
    assert len(rows) == 2 * odd.count()
    bare = [r for r in rows if r["event_s"] is None]
    assert len(bare) == 2 * odd.where("doc_id IS NULL").count()
    assert all((r["n_events"], r["sum_chars"], r["n_langs"], r["median_chars"]) == (0, 0, 0, None) for r in bare)
    timed = [tuple(r) for r in windows.document_times(odd).select("doc_id", "source", "event_s", "size", "lang").collect()]
    assert Counter(tuple(r) for r in rows) == brute(timed, queries.WINDOWS)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    path = f"{folder}/documents.parquet"
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    found = queries.op12_windows(spark, folder)
    want = con.sql(windows.SQL)
    order = [want.columns.index(c) for c in found.columns]
    assert Counter(map(tuple, found.collect())) == Counter(tuple(r[i] for i in order) for r in want.fetchall())
