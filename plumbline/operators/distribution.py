"""The value distribution of a table: every column's distinct values with their frequencies.

Column statistics (types, distinct counts, outliers, medians, modes) depend on a column's values and
how often each occurs, nothing else. So one scan combines equal values on the map side and shuffles
the distinct ones; everything after that works on the distribution, which is far smaller than the
table wherever values repeat, and parses each distinct text once instead of once per row.

A column of many different values gains nothing by this: its distribution is as large as itself. So a first
scan estimates the distinct values of every column. Only columns of few enter the distribution; the others
are measured row by row with partial aggregates, and where their values must be told apart, 16 bytes of hash
are shuffled instead of the value. The figures are the same either way.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.text import is_null_token, to_number, to_timestamp
from plumbline.operators.columns import numeric_columns, quoted, text_columns
from plumbline.session import stage

# Columns of more distinct values than this, which repeat less than so often on average (as estimated), stay out of the
# distribution: it would be as large as they are. A distribution is at most 40 MB a column below the bound.
FEW_VALUES = 1_000_000
REPEATS = 2.0

# The pseudo column that carries the row count, so that it needs no scan of its own.
ROWS = "\0rows"


def _entry(index: int, text: Column | None = None, whole: Column | None = None, real: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(index).alias("index"),
        (null if text is None else text).cast("string").alias("text"),
        (null if whole is None else whole).cast("bigint").alias("whole"),
        (null if real is None else real).cast("double").alias("real"),
    )


def _entry_for(index: int, f: T.StructField) -> Column:
    c = quoted(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return _entry(index, real=F.when(~F.isnan(c), c))
    if isinstance(f.dataType, (T.IntegralType, T.BooleanType)):
        return _entry(index, whole=c)
    if isinstance(f.dataType, T.TimestampType):
        return _entry(index, whole=F.unix_micros(c))
    if isinstance(f.dataType, T.DateType):
        return _entry(index, whole=F.unix_date(c))
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return _entry(index, text=F.to_json(c))
    return _entry(index, text=c)


def _cells(df: DataFrame, *more: str) -> DataFrame:
    """``index, text, whole, real`` of every non-null value and the columns ``more`` of its row; columns travel as numbers."""
    entries = [_entry(0, whole=F.lit(1)), *[_entry_for(i, f) for i, f in enumerate(df.drop(*more).schema, 1)]]
    return df.select(*more, F.inline(F.array(*entries))).filter(
        F.col("text").isNotNull() | F.col("whole").isNotNull() | F.col("real").isNotNull()
    )


def _named(df: DataFrame, counts: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(n) for n in [ROWS, *df.columns]])
    return counts.select(names[F.col("index")].alias("column"), "text", "whole", "real", "count")


def distribution(df: DataFrame) -> DataFrame:
    """``column, text, whole, real, count`` for every non-null value, plus the ``ROWS`` entry.

    Integers stay 64-bit and texts stay texts, so distinct values stay distinct. Columns travel as
    numbers through the shuffle and get their names after it.
    """
    return _named(df, _cells(df).groupBy("index", "text", "whole", "real").agg(F.count(F.lit(1)).alias("count")))


def without_rows(values: DataFrame, removed: DataFrame, weight: str) -> DataFrame:
    """What ``read_values`` gives once the rows ``removed`` are gone, each as often as its column ``weight`` says.

    ``values`` has the entries of the columns of ``removed``, with these rows among those it counts.
    """
    cells = _cells(removed, weight).groupBy("index", "text", "whole", "real").agg((-F.sum(weight)).alias("count"))
    both = values.unionByName(_named(removed.drop(weight), cells), allowMissingColumns=True)
    read = [F.max(c).alias(c) for c in ("number", "time", "token")]
    return both.groupBy("column", "text", "whole", "real").agg(F.sum("count").alias("count"), *read).filter("count > 0")


def _read(df: DataFrame, counts: DataFrame) -> DataFrame:
    numeric = numeric_columns(df)
    texts = text_columns(df)
    is_text = F.col("column").isin(*texts) if texts else F.lit(False)
    is_numeric = F.col("column").isin(*numeric) if numeric else F.lit(False)
    text = F.when(is_text, F.col("text"))
    own = F.coalesce(F.col("real"), F.col("whole").cast("double"), F.col("text").try_cast("double"))
    return counts.select(
        "*",
        F.when(is_numeric, own).otherwise(to_number(text)).alias("number"),
        to_timestamp(text).alias("time"),
        F.coalesce(is_null_token(text), F.lit(False)).alias("token"),
    )


def read_values(df: DataFrame) -> DataFrame:
    """The distribution with each value read as a number and as a time.

    ``number`` holds the value of a numeric column or the number a text spells, ``time`` the timestamp
    a text spells, ``token`` whether a text only says that the value is missing.
    """
    return _read(df, distribution(df))


def read_cells(df: DataFrame) -> DataFrame:
    """Like ``read_values``, but a row per cell, each with count 1: nothing is combined or shuffled."""
    return _read(df, _named(df, _cells(df).withColumn("count", F.lit(1).cast("bigint"))))


@dataclass
class Values:
    """A table's values in the form that suits each column.

    ``few``: the distribution of columns with few distinct values. The other columns come by row: ``many`` has the
    ``numbers`` among them as doubles, ``prose`` the ``texts``. A bare distribution counts as all ``few``.
    """

    few: DataFrame
    many: DataFrame | None = None
    numbers: list[str] = field(default_factory=list)
    prose: DataFrame | None = None
    texts: list[str] = field(default_factory=list)

    @staticmethod
    def of(values: DataFrame | Values) -> Values:
        return values if isinstance(values, Values) else Values(values)


def distinguished(f: T.StructField) -> Column:
    """A column's values as the distribution tells them apart: NaN is missing, nested values are texts."""
    c = quoted(f.name)
    if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return F.to_json(c) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c


def wide_columns(df: DataFrame, bound: int = FEW_VALUES) -> dict[str, int]:
    """Columns of more than ``bound`` distinct values that hardly repeat, by a sketch of every column in one scan, and its estimates.

    A table of no more rows than that has none, which its row count tells without a scan of values.
    """
    if not df.columns or df.count() <= bound:
        return {}
    exprs = [e for i, f in enumerate(df.schema) for e in (F.approx_count_distinct(distinguished(f)).alias(f"d{i}"), F.count(distinguished(f)).alias(f"n{i}"))]
    row = df.agg(*exprs).first()
    found = {c: (row[f"d{i}"], row[f"n{i}"]) for i, c in enumerate(df.columns)}
    return {c: d for c, (d, n) in found.items() if d > bound and n < REPEATS * d}


def hashes(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: one alone is exact for numbers and times, both tell texts apart."""
    return F.xxhash64(c), F.xxhash64(F.lit("second"), c)


def hashed_distinct(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Distinct non-null values of every expression by 128 bits of hash: 20 bytes a value are shuffled, whatever its length."""
    if not values:
        return {}
    entries = [F.struct(F.lit(i).alias("i"), v.isNotNull().alias("is"), *[h.alias(n) for h, n in zip(hashes(v), ("a", "b"))]) for i, v in enumerate(values.values())]
    cells = df.select(F.inline(F.array(*entries))).filter("is").select("i", "a", "b")
    counts = {r["i"]: r["count"] for r in cells.distinct().groupBy("i").count().collect()}
    return {n: counts.get(i, 0) for i, n in enumerate(values)}


def sketched_distinct(df: DataFrame, values: dict[str, Column]) -> dict[str, int]:
    """Estimates of the distinct values of every expression from one scan; nothing but the sketches is shuffled."""
    if not values:
        return {}
    row = df.agg(*[F.approx_count_distinct(v, 0.02).alias(f"d{i}") for i, v in enumerate(values.values())]).first()
    return {n: row[f"d{i}"] for i, n in enumerate(values)}


def hashed_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The smallest of the most frequent texts of every column, counted by hash.

    Only texts whose hash has the highest count are compared as texts, per task before the shuffle.
    """
    if not columns:
        return {}
    entries = [F.struct(F.lit(i).alias("i"), quoted(c).alias("text"), *[h.alias(n) for h, n in zip(hashes(quoted(c)), ("a", "b"))]) for i, c in enumerate(columns)]
    cells = df.select(F.inline(F.array(*entries))).filter(F.col("text").isNotNull())
    counts = stage(cells.groupBy("i", "a", "b").agg(F.count(F.lit(1)).alias("n")), "hash-counts")
    most = {r["i"]: r["most"] for r in counts.groupBy("i").agg(F.max("n").alias("most")).collect()}
    if not most:
        return {}
    found = {}
    for i in [i for i, n in most.items() if n == 1]:  # no text repeats: the smallest of all
        found[columns[i]] = df.agg(F.min(quoted(columns[i])).alias("text")).first()["text"]
    if any(n > 1 for n in most.values()):
        wanted = F.coalesce(*[F.when(F.col("i") == i, F.lit(n)) for i, n in most.items() if n > 1])
        top = counts.filter(F.col("n") == wanted).select("i", "a", "b")
        best = cells.join(top, ["i", "a", "b"], "left_semi").groupBy("i").agg(F.min("text").alias("text"))
        found |= {columns[r["i"]]: r["text"] for r in best.collect()}
    return found


def of_column(name: str, value: str = "number") -> Column:
    """A distribution's values of one column, null in the rows of the others."""
    return F.when(F.col("column") == name, F.col(value))


def total_rows(values: DataFrame) -> int:
    row = values.filter(F.col("column") == ROWS).agg(F.sum("count").alias("n")).first()
    return row["n"] or 0


def number_counts(values: DataFrame | Values) -> dict[str, tuple[int, int]]:
    """Numbers and distinct numbers of every column, from one pass; of a column by row at most its numbers are distinct."""
    values = Values.of(values)
    found = values.few.filter(F.col("number").isNotNull()).groupBy("column").agg(
        F.sum("count").alias("n"), F.count_distinct("number").alias("distinct")
    )
    counts = {r["column"]: (r["n"], r["distinct"]) for r in found.collect()}
    if values.numbers:
        exprs = [e for i, c in enumerate(values.numbers) for e in (F.count(quoted(c)).alias(f"n{i}"), F.approx_count_distinct(quoted(c)).alias(f"d{i}"))]
        row = values.many.agg(*exprs).first()
        counts |= {c: (row[f"n{i}"], row[f"d{i}"]) for i, c in enumerate(values.numbers) if row[f"n{i}"]}
    return counts
