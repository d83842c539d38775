"""Statistical profile: moments, histograms, frequencies, correlations, group summaries."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.numbers import half_up
from plumbline.operators.columns import (
    dimension_columns, metric_columns, number, numeric_columns, per_column, quoted, text_columns,
)
from plumbline.operators.quantiles import exact_quantiles, grouped_median
from plumbline.operators.ranks import average_ranks, with_ranks

# Shape and strength thresholds, histogram bin range, list lengths.
HIGH_SKEW, SOME_SKEW = 1.0, 0.5
STRONG, MODERATE = 0.7, 0.4
FEWEST_BINS, MOST_BINS = 6, 20
TOP_FREQUENCIES, TOP_PAIRS, TOP_SEGMENTS = 10, 8, 10

PROFILE_SCHEMA = (
    "column string, count bigint, missing bigint, mean double, median double, std double, variance double, "
    "min double, q25 double, q75 double, max double, iqr double, skewness double, kurtosis double, shape string"
)


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, moments and quantiles of each numeric column, one row per column.

    One pass of partial aggregation for the moments, the exact quantiles, and one row per column built
    from both. Columns without values are left out.
    """
    columns = numeric_columns(df) if columns is None else columns
    values = {c: number(df, c) for c in columns}
    kinds = {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp, "variance": F.var_samp,
        "min": F.min, "max": F.max, "skew": F.skewness, "kurt": F.kurtosis,
    }
    row = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(values[c]).alias(f"{kind}{i}") for i, c in enumerate(columns) for kind, f in kinds.items()],
    ).first()
    quantiles = exact_quantiles(df, values, [0.25, 0.5, 0.75])
    rows = []
    for i, c in enumerate(columns):
        n = row[f"count{i}"]
        if not n:
            continue
        std, variance = row[f"std{i}"] or 0.0, row[f"variance{i}"] or 0.0
        q1, median, q3 = quantiles[c].values
        skew, kurt = corrected_moments(n, std, row[f"skew{i}"], row[f"kurt{i}"])
        figures = [row[f"mean{i}"], median, std, variance, row[f"min{i}"], q1, q3, row[f"max{i}"], q3 - q1]
        rows.append((c, n, row["rows"] - n, *[half_up(x, 2) for x in figures], half_up(skew, 3), half_up(kurt, 3), shape(skew)))
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def means_and_maxima(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, mean, max`` as in the numeric profile, in one pass without its quantiles."""
    row = df.agg(*[f(number(df, c)).alias(f"{kind}{i}") for i, c in enumerate(columns) for kind, f in (("mean", F.avg), ("max", F.max))]).first()
    rows = [(c, half_up(row[f"mean{i}"], 2), half_up(row[f"max{i}"], 2)) for i, c in enumerate(columns) if row[f"mean{i}"] is not None]
    return df.sparkSession.createDataFrame(rows, "column string, mean double, max double")


def corrected_moments(n: int, std: float, skew: float | None, kurt: float | None) -> tuple[float, float]:
    """Bias-corrected skewness and excess kurtosis from the population ones; 0 for flat or tiny data."""
    if n <= 3 or std <= 1e-4 or skew is None or not math.isfinite(skew):
        return 0.0, 0.0
    g1 = skew * math.sqrt(n * (n - 1)) / (n - 2)
    g2 = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * kurt + 6)
    return g1, g2


def shape(skew: float) -> str:
    if abs(skew) > HIGH_SKEW:
        return "Highly Skewed (Right/Positive)" if skew > 0 else "Highly Skewed (Left/Negative)"
    return "Moderately Skewed" if abs(skew) > SOME_SKEW else "Normal / Symmetrical"


def histogram(df: DataFrame, columns: list[str] | None = None, bins: int | None = None) -> DataFrame:
    """Equal-width bins of each column: ``column, bin, low, high, label, count``, empty bins included.

    The number of bins follows the root of the count unless given. Columns with under 4 values or a
    single value have none.
    """
    columns = numeric_columns(df) if columns is None else columns
    values = {c: number(df, c) for c in columns}
    row = df.agg(
        *[f(values[c]).alias(f"{kind}{i}") for i, c in enumerate(columns) for kind, f in
          (("n", F.count), ("low", F.min), ("high", F.max))]
    ).first()
    spans = []
    for i, c in enumerate(columns):
        n, low, high = row[f"n{i}"], row[f"low{i}"], row[f"high{i}"]
        if n >= 4 and low < high:
            k = bins or min(MOST_BINS, max(FEWEST_BINS, math.isqrt(n)))
            spans.append((c, low, high, k))
    spark = df.sparkSession
    edges = spark.createDataFrame(
        [(c, b, low + (high - low) * b / k, low + (high - low) * (b + 1) / k) for c, low, high, k in spans for b in range(k)],
        "column string, bin int, low double, high double",
    )
    if not spans:
        return edges.select("*", F.lit("").alias("label"), F.lit(0).cast("bigint").alias("count"))
    entries = [
        F.struct(
            F.lit(c).alias("column"),
            F.least(F.floor((values[c] - low) * k / (high - low)), F.lit(k - 1)).cast("int").alias("bin"),
        )
        for c, low, high, k in spans
    ]
    counts = df.select(F.inline(F.array(*entries))).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("count"))
    label = F.concat(F.round("low", 1).cast("string"), F.lit(" - "), F.round("high", 1).cast("string"))
    return edges.join(counts, ["column", "bin"], "left").select(
        "column", "bin", "low", "high", label.alias("label"), F.coalesce("count", F.lit(0)).alias("count")
    )


def histogram_summary(df: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """Records, mean, median and the fullest bin of a fixed-bin histogram, in one row."""
    v = {column: number(df, column)}
    median = exact_quantiles(df, v, [0.5])[column].values[0]
    peak = histogram(df, [column], bins).agg(
        F.max_by(F.struct("bin", "label"), F.struct(F.col("count"), -F.col("bin"))).alias("peak")
    )
    figures = df.agg(F.count(v[column]).alias("records"), F.round(F.avg(v[column]), 2).alias("mean"))
    return figures.join(peak).select(
        F.lit(column).alias("metric"), "records", "mean", F.round(F.lit(median), 2).alias("median"),
        F.col("peak.bin").alias("peak_bin"), F.col("peak.label").alias("peak_label"),
    )


def category_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct and missing counts and the most frequent value of each text column."""
    columns = text_columns(df) if columns is None else columns
    counts = value_counts(df, columns, keep_nulls=True)
    best = F.min(F.when(F.col("value").isNotNull(), F.struct(-F.col("count"), F.col("value").alias("value"))))
    return counts.groupBy("column").agg(
        F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing"),
        best.alias("best"),
    ).filter("best is not null").select(
        "column", "unique_count", "missing", F.col("best.value").alias("top_category"),
        (-F.col("best.col1")).alias("top_category_count"),
    )


def frequencies(df: DataFrame, columns: list[str] | None = None, top: int = TOP_FREQUENCIES) -> DataFrame:
    """The most frequent values of each text column with shares and running shares.

    The rank filter limits each task to ``top`` rows per column before the shuffle, so a column of many
    distinct values is never sorted in one place.
    """
    columns = text_columns(df) if columns is None else columns
    counts = value_counts(df, columns)
    totals = counts.groupBy("column").agg(F.sum("count").alias("total"))
    best_first = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    leaders = counts.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= top)
    shares = leaders.join(totals, "column").withColumn("percentage", F.round(F.col("count") * 100 / F.col("total"), 1))
    running = Window.partitionBy("column").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return shares.select(
        "column", "rank", F.col("value").alias("category"), "count", "percentage",
        F.round(F.sum("percentage").over(running), 1).alias("cumulative_pct"),
    )


def value_counts(df: DataFrame, columns: list[str], keep_nulls: bool = False) -> DataFrame:
    """Values of several columns with their frequencies: ``column, value, count``; one scan for all."""
    pairs = [F.struct(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.inline(F.array(*pairs)))
    if not keep_nulls:
        long = long.filter(F.col("value").isNotNull())
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))


def correlation(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Correlation of every pair of columns over the complete rows: ``feature_a, feature_b, r``.

    Empty for fewer than two columns or five complete rows; an undefined coefficient is 0.
    """
    columns = metric_columns(df, 5) if columns is None else columns
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, r double")
    complete = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    names = [f"x{i}" for i in range(len(columns))]
    if method == "spearman":
        complete = with_ranks(complete, average_ranks(complete, names), names)
    elif method != "pearson":
        raise ValueError(f"method: {method!r}")
    pairs = list(combinations(range(len(columns)), 2))
    row = complete.agg(
        F.count(F.lit(1)).alias("rows"), *[F.corr(f"x{i}", f"x{j}").alias(f"r{i}_{j}") for i, j in pairs]
    ).filter("rows >= 5")

    def coefficient(i, j):
        if i == j:
            return F.lit(1.0)
        r = F.col(f"r{min(i, j)}_{max(i, j)}")
        return F.round(F.coalesce(F.when(~F.isnan(r), r), F.lit(0.0)), 3)

    fields = [
        [F.lit(a), F.lit(b), coefficient(i, j)] for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    return per_column(row, fields, ["feature_a", "feature_b", "r"])


def top_pairs(df: DataFrame, columns: list[str] | None = None, top: int = TOP_PAIRS) -> DataFrame:
    """The most strongly correlated pairs with both coefficients, strength and direction."""
    columns = metric_columns(df, 5) if columns is None else columns
    order = {c: i for i, c in enumerate(columns)}
    pairs = [(a, b) for a, b in combinations(columns, 2)]
    wanted = df.sparkSession.createDataFrame(
        [(a, b, order[a], order[b]) for a, b in pairs] or [], "feature_a string, feature_b string, i int, j int"
    )
    pearson = correlation(df, columns, "pearson").withColumnRenamed("r", "pearson_r")
    spearman = correlation(df, columns, "spearman").withColumnRenamed("r", "spearman_rho")
    size = F.abs("pearson_r")
    strength = F.when(size >= STRONG, "Strong").when(size >= MODERATE, "Moderate").otherwise("Weak")
    direction = F.when(F.col("pearson_r") > 0, "Positive").otherwise("Negative")
    ranked = wanted.join(pearson, ["feature_a", "feature_b"]).join(spearman, ["feature_a", "feature_b"])
    return (
        ranked.orderBy(size.desc(), "i", "j").limit(top)
        .select("feature_a", "feature_b", "pearson_r", "spearman_rho", strength.alias("strength"), direction.alias("direction"))
    )


def groupby_insights(
    df: DataFrame, dimensions: list[str] | None = None, metric: str | None = None, top: int = TOP_SEGMENTS
) -> DataFrame:
    """Count, sum, mean and median of the first metric by the first small text columns.

    All dimensions share one scan: each row is counted once per dimension and combined on the map side.
    """
    if dimensions is None:
        first = text_columns(df)[:3]
        dimensions = [c for c in dimension_columns(df.select(*[quoted(c) for c in first]), 2, 15)]
    if metric is None:
        metrics = metric_columns(df, 5)
        metric = metrics[0] if metrics else None
    schema = "dimension string, metric string, segment string, count bigint, sum double, mean double, median double"
    if not dimensions or metric is None:
        return df.sparkSession.createDataFrame([], schema)
    entries = [
        F.struct(F.lit(c).alias("dimension"), quoted(c).cast("string").alias("segment"), number(df, metric).alias("v"))
        for c in dimensions
    ]
    long = df.select(F.inline(F.array(*entries))).filter(F.col("segment").isNotNull())
    keys = ["dimension", "segment"]
    sums = long.groupBy(*keys).agg(F.count("v").alias("count"), F.sum("v").alias("sum"), F.avg("v").alias("mean"))
    medians = grouped_median(long, keys, F.col("v"))
    order = Window.partitionBy("dimension").orderBy(F.desc_nulls_last("sum"), "segment")
    ranked = sums.join(medians, keys, "left").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= top).select(
        "dimension", F.lit(metric).alias("metric"), "segment", "count",
        *[F.round(c, 2).alias(c) for c in ("sum", "mean", "median")],
    )
