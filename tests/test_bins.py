import math

from pyspark.sql import functions as F

from retentio.functions import bins as B


def _eval(spark, values, expr, typ="double"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_risk_level_edges(spark):
    vals = [0.0, 0.3, 0.30000001, 0.6, 1.0, None, float("nan"), 1.5]
    got = _eval(spark, vals, B.risk_level)
    low, mid, high = B.RISK_LEVELS
    assert got == [None, low, mid, mid, high, None, None, None]


def test_risk_level_include_lowest(spark):
    got = _eval(spark, [0.0], lambda c: B.risk_level(c, include_lowest=True))
    assert got == [B.RISK_LEVELS[0]]


def test_change_category_edges(spark):
    got = _eval(spark, [-1.0, -0.2, -0.05, 0.05, 0.2, 1.0], B.change_category)
    c = B.CHANGE_CATEGORIES
    assert got == [None, c[0], c[1], c[2], c[3], c[4]]


def test_change_class3_differs_at_minus_005(spark):
    got = _eval(spark, [-0.05, -0.0500001, 0.05, 0.0500001, 0.15 - 0.10], B.change_class3)
    imp, same, worse = B.CHANGE_CLASSES
    assert got == [same, imp, same, worse, same]


def test_age_groups(spark):
    got = _eval(spark, [0, 18, 21, 25, 30, 100, 101, None], B.age_group, "int")
    g = B.AGE_GROUPS
    assert got == [None, g[0], g[1], g[2], g[3], g[4], None, None]


def test_low_performance_and_rate(spark):
    df = spark.createDataFrame([(2.9, 3, 0), (3.0, 1, 4), (None, 2, None)], "gpa double, a int, t int")
    rows = df.select(B.low_performance("gpa"), B.absence_rate("a", "t")).collect()
    assert [r[0] for r in rows] == [1, 0, 0]
    assert rows[0][1] is None and math.isclose(rows[1][1], 0.25) and rows[2][1] is None


def test_faculty_year_null(spark):
    df = spark.createDataFrame([("Law", 2), (None, 3)], "f string, y int")
    assert [r[0] for r in df.select(B.faculty_year("f", "y")).collect()] == ["Law_2", None]
