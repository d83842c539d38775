import datetime

from pyspark.sql import functions as F

from plumbline.functions import measures as ms, text as tx


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r["out"] for r in df.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_numbers(spark):
    given = ["$1,234.50", "450.0 USD", "€80.00", "45kg", "120mmHg", "3,144 SQ FT", "usdt 5", "free", "1e3", "12d", "0x1p3",
             "Infinity", "NaN", "15%", "-3", ".5", "5.", "", None, "1.2.3"]
    want = [1234.5, 450.0, 80.0, 45.0, 120.0, 3144.0, None, None, 1000.0, None, None, None, None, 15.0, -3.0, 0.5, 5.0, None, None, None]
    assert values(spark, given, tx.to_number) == want
    assert values(spark, ["15%", "0.15"], lambda c: tx.to_number(c, True)) == [0.15, 0.15]


def test_null_tokens(spark):
    given = ["N/A", " null ", "$ - ", "Pending...", "0000-00-00", "\t", "nano", "0"]
    assert values(spark, given, tx.is_null_token) == [True] * 6 + [False] * 2


def test_dates(spark):
    day = datetime.datetime(2023, 1, 5)
    given = ["2023-01-05", "01/05/2023", "05-Jan-2023", "2023/01/05 00:00:00", "Jan 05, 2023", "1/5/2023", "2023-99-99", "13/40/2023", "soon", None]
    assert values(spark, given, tx.to_timestamp) == [day] * 6 + [None] * 4


def test_title_case_matches_python(spark):
    given = ["new york", "e-commerce", "o'brien", "a1b", "élan vital", "NY", "x", ""]
    assert values(spark, given, tx.title_case) == [g.title() for g in given]
    assert values(spark, ["  a \t b  "], tx.collapse_spaces) == ["a b"]


def test_measures_on_no_rows(spark):
    empty = spark.createDataFrame([], "v double")
    v = F.col("v")
    row = empty.agg(
        ms.total(v).alias("total"), ms.average(v).alias("avg"), ms.minimum(v).alias("min"), ms.maximum(v).alias("max"),
        ms.divide(F.sum(v), F.count(v), 7).alias("alt"), ms.ratio(F.sum(v), F.count(v)).alias("ratio"),
    ).first()
    assert list(row) == [0.0, 0.0, 0.0, 0.0, 7.0, None]


def test_measures_coerce_text(spark):
    df = spark.createDataFrame([("1",), ("x",), ("3",), (None,)], "v string")
    row = df.agg(ms.total(F.col("v")).alias("a"), ms.average(F.col("v")).alias("b"), ms.count(F.col("v")).alias("c")).first()
    assert list(row) == [4.0, 2.0, 3]


def test_totals_keep_hundredths_beside_large_numbers(spark):
    """A plain sum in this order is off by 0.98."""
    rows = spark.range(0, 100_001, 1, 1).select(F.when(F.col("id") == 0, 1e12).otherwise(0.01).alias("v"))
    row = rows.agg(ms.total(F.col("v")).alias("total"), ms.average(F.col("v")).alias("mean")).first()
    assert abs(row["total"] - (1e12 + 1000)) < 1e-3
    assert abs(row["mean"] - (1e12 + 1000) / 100_001) < 1e-6
    odd = spark.createDataFrame([(float("inf"),), (None,), (1.5,), (2.0**60,)], "v double")
    assert odd.agg(ms.total(F.col("v"))).first()[0] == float("inf")
    assert odd.filter("v < 1e30").agg(ms.total(F.col("v"))).first()[0] == 2.0**60 + 1.5
