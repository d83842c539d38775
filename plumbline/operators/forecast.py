"""Trend of a metric over time: daily or weekly means, moving average, linear projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.operators.columns import number, quoted

# Fewest periods, moving-average width, forecast length, band width in deviations.
FEWEST_DAYS, FEWEST_PERIODS = 8, 6
ROLLING, STEPS, BAND = 7, 14, 1.28


def series(df: DataFrame, date: str, metric: str, step: str | None = None) -> DataFrame:
    """Mean of the metric per period: ``period, value``; periods without rows are absent.

    Daily, or weekly (labelled by the week's Sunday) where there are fewer than eight days, unless
    ``step`` is given.
    """
    rows = df.select(F.to_date(quoted(date)).alias("day"), number(df, metric).alias("v")).dropna()
    if step is None:
        step = step_of(df, date, metric)
    period = F.col("day") if step == "day" else F.date_add(F.date_trunc("week", F.col("day")).cast("date"), 6)
    return rows.groupBy(period.alias("period")).agg(F.avg("v").alias("value"))


def step_of(df: DataFrame, date: str, metric: str) -> str:
    days = df.filter(number(df, metric).isNotNull()).agg(F.count_distinct(F.to_date(quoted(date))).alias("n")).first()["n"]
    return "day" if days >= FEWEST_DAYS else "week"


def _in_order():
    """A series has one row per calendar period, so a window over all of it stays small."""
    return Window.partitionBy(F.lit(0)).orderBy("period")


def rolling_mean(periods: DataFrame) -> DataFrame:
    """``period, value, rolling``: the mean of up to seven periods that end here."""
    window = _in_order().rowsBetween(1 - ROLLING, 0)
    return periods.withColumn("rolling", F.avg("value").over(window))


def fit_trend(periods: DataFrame) -> DataFrame:
    """Least-squares line over the period index, spread and mean of the series, in one row."""
    x = (F.row_number().over(_in_order()) - 1).cast("double")
    return periods.withColumn("x", x).agg(
        F.count(F.lit(1)).alias("periods"),
        F.regr_slope("value", "x").alias("slope"),
        F.regr_intercept("value", "x").alias("intercept"),
        F.coalesce(F.stddev_samp("value"), F.lit(10.0)).alias("std"),
        F.avg("value").alias("mean"),
        F.max("period").alias("last_period"),
    )


def trend_summary(periods: DataFrame) -> DataFrame:
    """Slope, direction and growth per period in percent of the mean."""
    growth = F.col("slope") / F.greatest(F.lit(1e-5), F.abs("mean")) * 100
    return fit_trend(periods).filter(F.col("periods") >= FEWEST_PERIODS).select(
        "periods", "slope", "intercept",
        F.when(F.col("slope") > 0, "Upward").otherwise("Downward").alias("direction"),
        F.round(growth, 2).alias("growth_rate_pct"),
    )


def forecast(periods: DataFrame, step: str = "day", steps: int = STEPS) -> DataFrame:
    """The line continued: ``step, period, value, lower, upper``; nothing for under six periods.

    The band is 1.28 deviations of the series wide on either side and starts at 0 at the lowest.
    """
    ahead = fit_trend(periods).filter(F.col("periods") >= FEWEST_PERIODS)
    ahead = ahead.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    value = F.col("slope") * (F.col("periods") + F.col("step") - 1) + F.col("intercept")
    days = F.col("step") * (1 if step == "day" else 7)
    point = F.round(value, 2)
    return ahead.select(
        "step",
        F.date_add("last_period", days.cast("int")).alias("period"),
        point.alias("value"),
        F.round(F.greatest(F.lit(0.0), point - BAND * F.col("std")), 2).alias("lower"),
        F.round(point + BAND * F.col("std"), 2).alias("upper"),
    )
