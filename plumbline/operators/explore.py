"""Filters, search, paging, and the small grouped results that charts and reports show."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from plumbline.functions.text import coerce_number, display
from plumbline.operators.columns import number, quoted
from plumbline.operators.quantiles import exact_quantiles, grouped_median

TOP_GROUPS, TREND_POINTS, BREAKDOWN, SCATTER_POINTS = 16, 15, 6, 300
# Rows that a task may hold to find a page.
IN_TASK = 100_000


def _is_number(value) -> bool:
    try:
        float(value)
        return True
    except (TypeError, ValueError):
        return False


def _literal(value) -> Column:
    """A whole number as an integer, so that comparing it with an integer column needs no cast."""
    number_ = float(value)
    return F.lit(int(number_) if number_.is_integer() else number_)


def predicate(df: DataFrame, column: str, op: str, value) -> Column:
    """A comparison on one column.

    Equality ignores case; order comparisons read the column as numbers. A numeric column is compared
    as it is, so that the condition reaches the scan. As in a table view, ``<>`` keeps missing values.
    """
    c, dtype = quoted(column), df.schema[column].dataType
    numeric = isinstance(dtype, T.NumericType)
    text = F.lower(c.cast("string"))
    if op in ("=", "==", "!=", "<>"):
        if numeric and _is_number(value):
            equal = c == _literal(value)
        else:
            equal = text == F.lit(str(value).lower())
        return equal if op in ("=", "==") else ~F.coalesce(equal, F.lit(False))
    if op.lower() == "in":
        if numeric and all(_is_number(v) for v in value):
            return c.isin(*[_literal(v) for v in value])
        return text.isin(*[str(v).lower() for v in value])
    left = c if numeric else coerce_number(c, dtype.simpleString())
    bound = _literal(value)
    compare = {">": left > bound, "<": left < bound, ">=": left >= bound, "<=": left <= bound}
    if op not in compare:
        raise ValueError(f"operator {op!r}")
    return compare[op]


def compare(df: DataFrame, column: str, op: str, value) -> DataFrame:
    return df.filter(predicate(df, column, op, value))


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows with ``text`` in any column, taken literally and in any case."""
    needle = text.strip().lower()
    if not needle:
        return df
    hits = [F.coalesce(F.lower(quoted(c).cast("string")).contains(needle), F.lit(False)) for c in df.columns]
    return df.filter(reduce(Column.__or__, hits))


def cross_filter(df: DataFrame, value, dimension: str | None = None) -> DataFrame:
    """Rows of one chart segment; a search in all columns when no dimension is given."""
    return df.filter(quoted(dimension) == F.lit(value)) if dimension else search(df, str(value))


def sort_rows(df: DataFrame, by: str, ascending: bool = True, tie_break: list[str] = ()) -> DataFrame:
    """Rows by one column, missing values last in both directions."""
    first = quoted(by).asc_nulls_last() if ascending else quoted(by).desc_nulls_last()
    return df.orderBy(first, *[quoted(c) for c in tie_break if c != by])


def page(
    df: DataFrame, number_: int = 1, size: int = 15, sort_by: str | None = None, ascending: bool = True,
    tie_break: list[str] | None = None, in_task: int = IN_TASK,
) -> DataFrame:
    """One page of rows in a stated order; ties are broken by all columns unless ``tie_break`` is given.

    Spark keeps offset + limit rows per task to find a page. Where these are more than ``IN_TASK``, the rows before the page
    are skipped by exact ranks first, as far as the sort columns are numbers or times. To go through all pages,
    ``page_after`` needs neither.
    """
    if number_ < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    tie_break = list(df.columns) if tie_break is None else tie_break
    sort_by, offset = sort_by or tie_break[0], (number_ - 1) * size
    if offset + size > in_task:
        df, offset = _skip(df, [(sort_by, ascending), *[(c, True) for c in tie_break if c != sort_by]], offset)
    return sort_rows(df, sort_by, ascending, tie_break).offset(offset).limit(size)


def page_after(
    df: DataFrame, after: Row | None, size: int = 15, sort_by: str | None = None, ascending: bool = True,
    tie_break: list[str] | None = None,
) -> DataFrame:
    """The page that follows the row ``after`` (none: the first page), in the order of ``page``.

    A filter on the sort key of the last row seen, for columns of any type and missing values, so every page costs the
    same and takes ``size`` rows per task. Rows that equal the last one in all sort columns count as seen.
    """
    tie_break = list(df.columns) if tie_break is None else tie_break
    sort_by = sort_by or tie_break[0]
    if after is not None:
        keys = [sort_by, *[c for c in tie_break if c != sort_by]]
        same, later = F.lit(True), F.lit(False)
        for i, name in enumerate(keys):
            c, value = quoted(name), F.lit(after[name]).cast(df.schema[name].dataType)
            if i:  # further columns ascend, missing values first
                beyond = c.isNotNull() if after[name] is None else c > value
            else:
                beyond = F.lit(False) if after[name] is None else c.isNull() | (c > value if ascending else c < value)
            later = later | (same & F.coalesce(beyond, F.lit(False)))
            same = same & c.eqNullSafe(value)
        df = df.filter(later)
    return sort_rows(df, sort_by, ascending, tie_break).limit(size)


def _skip(df: DataFrame, keys: list[tuple[str, bool]], offset: int) -> tuple[DataFrame, int]:
    """``df`` without rows that precede the offset, and the offset that remains.

    Works through the sort columns while they are numbers or times: the value at the rank is found
    exactly, smaller ones are counted and dropped, and ties go on to the next column.
    """
    keep, tied = F.lit(False), F.lit(True)
    for i, (name, ascending) in enumerate(keys):
        key = _sort_number(df, name)
        if not offset or key is None:
            break
        key = key if ascending else -key
        rows = df.filter(tied)
        n = rows.agg(F.count(key).alias("n")).first()["n"]
        # Missing values come last in the first column only; elsewhere they are left to the final sort.
        if offset > n or (i > 0 and n < rows.count()):
            break
        value = exact_quantiles(rows, {"key": key}, [max(0, offset - 1) / max(1, n - 1)])["key"].values[0]
        offset -= rows.agg(F.count_if(key < F.lit(value)).alias("below")).first()["below"]
        keep = keep | (tied & ((key > F.lit(value)) | key.isNull()))
        tied = tied & (key == F.lit(value))
        if isinstance(df.schema[name].dataType, (T.LongType, T.DecimalType)):
            break  # as doubles, different values may tie: the final sort tells them apart
    return df.filter(keep | tied), offset


def _sort_number(df: DataFrame, name: str) -> Column | None:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(quoted(name)).cast("double")
    if isinstance(dtype, T.TimestampNTZType):
        # By its fields: a cast to a timestamp would reorder hours that the session's time zone skips.
        c = quoted(name)
        seconds = F.unix_date(c.cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
        return (seconds * 1_000_000 + F.extract(F.lit("SECOND"), c) * 1_000_000).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(quoted(name)).cast("double")
    return quoted(name).cast("double") if isinstance(dtype, T.NumericType) else None


def page_info(df: DataFrame, size: int = 15) -> DataFrame:
    """``total_rows, total_pages`` in one row."""
    if size < 1:
        raise ValueError("page size starts at 1")
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.greatest(F.lit(1), F.ceil(F.col("total_rows") / size)).cast("bigint").alias("total_pages")
    )


def display_rows(df: DataFrame) -> DataFrame:
    """Rows as shown in a listing: numbers rounded to 2, timestamps as dates, everything as text."""
    return df.select(*[display(quoted(f.name), f.dataType.simpleString()).alias(f.name) for f in df.schema])


def preview(df: DataFrame, rows: int = 15, columns: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first rows and columns, in a stated order."""
    shown = df.columns[:columns]
    return df.orderBy(*[quoted(c) for c in (order_by or shown)]).select(*[quoted(c) for c in shown]).limit(rows)


# The aggregations a grouped metric offers.
AGGREGATIONS = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def grouped_metric(
    df: DataFrame, by: str, metric: str | None = None, agg: str = "mean", top: int = TOP_GROUPS
) -> DataFrame:
    """One aggregated metric per group, largest first: ``label, value``."""
    groups = df.filter(quoted(by).isNotNull())
    if agg == "count" or metric is None:
        result = groups.groupBy(quoted(by).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    elif agg == "median":
        keyed = groups.select(quoted(by).alias("label"), number(df, metric).alias("v"))
        result = grouped_median(keyed, ["label"], F.col("v"), "value")
    elif agg in AGGREGATIONS:
        value = AGGREGATIONS[agg](number(df, metric))
        result = groups.groupBy(quoted(by).alias("label")).agg(value.alias("value"))
    else:
        raise ValueError(f"aggregation {agg!r}")
    shown = result.select(F.col("label").cast("string").alias("label"), F.round("value", 2).alias("value"))
    return shown.orderBy(F.desc_nulls_last("value"), "label").limit(top)


def leader_laggard(grouped: DataFrame) -> DataFrame:
    """First and last of a grouped metric and the ratio between them, in one row."""
    return grouped.agg(
        F.max_by("label", F.struct("value", F.col("label"))).alias("leader"),
        F.max("value").alias("leader_value"),
        F.min_by("label", F.struct("value", F.col("label"))).alias("laggard"),
        F.min("value").alias("laggard_value"),
        F.count(F.lit(1)).alias("groups"),
    ).select("*", F.round(F.col("leader_value") / (F.col("laggard_value") + 1e-6), 1).alias("spread"))


def scatter(df: DataFrame, x: str, y: str, order_by: list[str] | None = None, points: int = SCATTER_POINTS) -> DataFrame:
    """The points a scatter plot shows: the first complete rows in a stated order."""
    complete = df.filter(number(df, x).isNotNull() & number(df, y).isNotNull())
    order = [quoted(c) for c in (order_by or [x, y])]
    return complete.orderBy(*order).limit(points).select(number(df, x).alias("x"), number(df, y).alias("y"))


def scatter_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson r over all complete rows; 0 for fewer than three."""
    a, b = number(df, x), number(df, y)
    both = F.count_if(a.isNotNull() & b.isNotNull())
    r = F.corr(F.when(b.isNotNull(), a), F.when(a.isNotNull(), b))
    return df.agg(both.alias("n"), F.when(both > 2, F.coalesce(r, F.lit(0.0))).otherwise(0.0).alias("r"))


def key_figures(df: DataFrame, metric: str) -> DataFrame:
    """Total, average and number of values of a metric."""
    v = number(df, metric)
    return df.agg(
        F.coalesce(F.sum(v), F.lit(0.0)).alias("total"), F.coalesce(F.avg(v), F.lit(0.0)).alias("average"),
        F.count(v).alias("records"),
    )


def trend(df: DataFrame, date: str, metric: str, last: int = TREND_POINTS) -> DataFrame:
    """Daily sums of the last dates, oldest first: ``date, value``."""
    day = F.to_date(quoted(date))
    sums = df.filter(quoted(date).isNotNull()).groupBy(day.alias("date")).agg(F.round(F.sum(number(df, metric)), 2).alias("value"))
    return sums.orderBy(F.desc("date")).limit(last).orderBy("date")


def breakdown(df: DataFrame, category: str, metric: str | None = None, top: int = BREAKDOWN) -> DataFrame:
    """The largest categories by metric sum, or by count: ``category, value, share_pct`` (of those shown)."""
    value = F.sum(number(df, metric)) if metric else F.count(F.lit(1)).cast("double")
    grouped = df.filter(quoted(category).isNotNull()).groupBy(quoted(category).cast("string").alias("category"))
    shown = grouped.agg(F.round(value, 2).alias("value")).orderBy(F.desc_nulls_last("value"), "category").limit(top)
    # At most ``top`` rows are left.
    share = F.col("value") * 100 / F.sum("value").over(Window.partitionBy(F.lit(0)))
    return shown.select("*", F.round(share, 1).alias("share_pct"))


def anomaly_profile(top_anomalies: DataFrame, profile: DataFrame, features: list[str]) -> DataFrame:
    """The most anomalous row against the column means, each as a share of the column maximum.

    ``feature, anomaly_pct, baseline_pct``; both are capped at 100. Of ``profile``, ``column``, ``mean`` and ``max`` are read.
    """
    first = top_anomalies.orderBy(F.desc("anomaly_score"), *[F.desc(c) for c in features]).limit(1)
    values = per_feature(first, features)
    most = F.greatest(F.lit(1.0), F.col("max"))
    pct = lambda v: F.least(F.lit(100.0), F.round(v / most * 100))
    return values.join(profile, values["feature"] == profile["column"]).select(
        "feature", pct(F.col("value")).alias("anomaly_pct"), pct(F.col("mean")).alias("baseline_pct")
    )


def per_feature(df: DataFrame, features: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("feature"), quoted(c).cast("double").alias("value")) for c in features]
    return df.select(F.inline(F.array(*entries)))


