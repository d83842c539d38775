"""Findings in words: one row per result that exists (``kind, badge, headline, detail``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def _row(frame: DataFrame, kind: str, badge: str, headline, detail) -> DataFrame:
    return frame.select(
        F.lit(kind).alias("kind"), F.lit(badge).alias("badge"), headline.alias("headline"), detail.alias("detail")
    )


def overview(df: DataFrame) -> DataFrame:
    counted = df.agg(F.count(F.lit(1)).alias("n"))
    headline = F.concat(F.lit("Rows: "), F.col("n").cast("string"), F.lit(f", columns: {len(df.columns)}"))
    return _row(counted, "overview", "Size", headline, F.lit("All figures below are over these rows."))


def segment_insight(personas: DataFrame, silhouette: float) -> DataFrame:
    """Number of segments and the largest by size."""
    top = personas.agg(F.count(F.lit(1)).alias("k"), F.max_by(F.struct("name", "percentage"), F.struct("size", -F.col("cluster_id"))).alias("p"))
    headline = F.concat(F.lit("Segments: "), F.col("k").cast("string"), F.lit(f", silhouette {silhouette:.3f}"))
    detail = F.concat(F.lit("Most rows ("), F.col("p.percentage").cast("string"), F.lit("%) are in "), F.col("p.name"))
    return _row(top, "clustering", "Segments", headline, detail)


def driver_insight(drivers: DataFrame) -> DataFrame:
    top = drivers.orderBy(F.desc("importance"), "feature").limit(1)
    headline = F.concat(F.col("target"), F.lit(" follows "), F.col("feature"), F.lit(" most: weight "), F.col("importance").cast("string"), F.lit("%"))
    return _row(top, "driver", "Driver", headline, F.concat(F.lit("Weights of all features for "), F.col("target"), F.lit(" add up to 100%.")))


def anomaly_insight(summary: DataFrame) -> DataFrame:
    headline = F.concat(
        F.lit("Flagged rows: "), F.col("total_anomalies").cast("string"), F.lit(", "), F.col("anomaly_pct").cast("string"), F.lit("% of all")
    )
    return _row(summary, "anomaly", "Outliers", headline, F.lit("Random splits part these rows from the rest soonest."))


def trend_insight(trend: DataFrame, metric: str) -> DataFrame:
    headline = F.concat(F.lit(f"{metric} goes "), F.col("direction"), F.lit(": "), F.col("growth_rate_pct").cast("string"), F.lit("% per period"))
    return _row(trend, "forecast", "Trend", headline, F.lit("The forecast prolongs the fitted line within its band."))


def combine(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
