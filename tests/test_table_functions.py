"""The table function over SQL: schemas, gaps, refusals."""

import pytest

from sitemill.functions import tables


@pytest.fixture(scope="module")
def factors(spark):
    tables.register(spark)
    rows = [("a", None, 0, [1.0, 2.0]), ("a", None, 2, [3.0, 4.0]), ("b", 1, 5, [7.0]), (None, 1, 1, [1.0]), (None, 1, 0, [2.0])]
    return spark.createDataFrame(rows, "`key of it` string, c int, r int, vec array<float>").repartition(3)


def test_any_schema_is_cut_and_filled(spark, factors):
    got = spark.sql("SELECT * FROM fit_rank(TABLE({f}), 3)", f=factors)
    assert got.schema == factors.schema
    zero = [0.0, 0.0]
    want = {("a", None, 0, (1.0, 2.0)), ("a", None, 1, (0.0, 0.0)), ("a", None, 2, (3.0, 4.0)), *[("b", 1, r, (0.0,)) for r in range(3)], (None, 1, 0, (2.0,)), (None, 1, 1, (1.0,)), (None, 1, 2, (0.0,))}
    assert len(zero) == 2 and {(a, c, r, tuple(v)) for a, c, r, v in got.collect()} == want and got.count() == len(want)
    one = spark.sql("SELECT * FROM fit_rank(TABLE(SELECT CAST(r AS BIGINT) AS r, CAST(vec AS array<double>) AS vec FROM {f} WHERE c IS NULL), 1)", f=factors)
    assert [tuple(r) for r in one.collect()] == [(0, [1.0, 2.0])] and dict(one.dtypes) == {"r": "bigint", "vec": "array<double>"}
    assert spark.sql("SELECT * FROM fit_rank(TABLE(SELECT * FROM {f} WHERE r > 9), 4)", f=factors).count() == 0


@pytest.mark.parametrize(("sql", "match"), [("TABLE({f}), 0", "positive"), ("TABLE({f}), 'x'", "positive"), ("1, 2", "takes a table"), ("TABLE(SELECT c, vec FROM {f}), 2", "whole-number r"), ("TABLE(SELECT r, c AS vec FROM {f}), 2", "array vec")])
def test_bad_calls_are_refused(spark, factors, sql, match):
    with pytest.raises(Exception, match=match):
        spark.sql(f"SELECT * FROM fit_rank({sql})", f=factors).collect()


@pytest.mark.parametrize("rows", [[(0, [1.0]), (0, [2.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(None, [1.0])], [(0, None)], [(-1, [1.0])]])
def test_bad_components_are_refused(spark, factors, rows):
    bad = spark.createDataFrame([("k", r, v) for r, v in rows], "k string, r int, vec array<double>")
    with pytest.raises(Exception, match="without a number|is there twice"):
        spark.sql("SELECT * FROM fit_rank(TABLE({f}), 4)", f=bad).collect()
