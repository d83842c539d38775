"""The whole analysis of one table in one call."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from plumbline.operators import anomalies, cleaning, drivers, forecast, insights, profile, segments
from plumbline.operators.audit import alerts, audit, compare_audits
from plumbline.operators.cleaning import CleaningConfig, CleaningPlan
from plumbline.operators.columns import time_columns
from plumbline.operators.distinct import part_suspects


@dataclass
class CleanReport:
    cleaned: DataFrame
    plan: CleaningPlan
    comparison: DataFrame
    raw_columns: DataFrame
    cleaned_columns: DataFrame
    log: DataFrame
    alerts: DataFrame


def clean_with_report(df: DataFrame, config: CleaningConfig | None = None) -> CleanReport:
    """Clean a table and audit it before and after.

    The cleaning works with the repeated rows and the value distribution that the first audit has found.
    """
    parts = part_suspects(df)
    before = audit(df, parts=parts)
    cleaned, plan = cleaning.clean(df, config, parts, before)
    after = audit(cleaned)
    spark = df.sparkSession
    return CleanReport(
        cleaned, plan, compare_audits(before, after), before.columns_frame(), after.columns_frame(),
        plan.log_frame(spark), alerts(after.table_frame()),
    )


def explore(df: DataFrame) -> dict[str, DataFrame]:
    """All sections of the statistical profile."""
    return {
        "numeric_stats": profile.numeric_profile(df),
        "categorical_stats": profile.category_summary(df),
        "frequencies": profile.frequencies(df),
        "distributions": profile.histogram(df),
        "pearson": profile.correlation(df, method="pearson"),
        "spearman": profile.correlation(df, method="spearman"),
        "top_correlations": profile.top_pairs(df),
        "groupby_insights": profile.groupby_insights(df),
    }


def learn(df: DataFrame, key: list[str], target: str | None = None) -> dict[str, DataFrame]:
    """All sections of the machine-learning report that the table has data for."""
    found: dict[str, DataFrame] = {}
    notes = [insights.overview(df)]
    features = segments.feature_columns(df)
    if len(features) >= 2:
        if segmentation := segments.segment(df, features):
            found["personas"] = segments.personas(segmentation)
            found["silhouettes"] = segmentation.scores_frame()
            projected, _ = segments.projection(segmentation)
            found["projection"] = segments.projection_sample(projected, key)
            notes.append(insights.segment_insight(found["personas"], segmentation.silhouette))
        found["drivers"] = drivers.key_drivers(df, target, features)
        notes.append(insights.driver_insight(found["drivers"]))
        detected = anomalies.detect_anomalies(df, key, features)
        if detected is not None:
            found["anomalies"] = anomalies.top_anomalies(detected, key, features)
            found["anomaly_summary"] = anomalies.anomaly_summary(detected)
            notes.append(insights.anomaly_insight(found["anomaly_summary"]))
        metric = drivers.choose_target(features, target if target in df.columns else None)
        if times := time_columns(df):
            step = forecast.step_of(df, times[0], metric)
            periods = forecast.series(df, times[0], metric, step)
            found["series"] = forecast.rolling_mean(periods)
            found["trend"] = forecast.trend_summary(periods)
            found["forecast"] = forecast.forecast(periods, step)
            notes.append(insights.trend_insight(found["trend"], metric))
    found["insights"] = insights.combine(notes)
    return found
