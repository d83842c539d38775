"""Which features move a target metric: importances of a distributed random forest."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame

from plumbline.operators.columns import metric_columns, number
from plumbline.session import spread, stage

# Name parts of a likely target in order of preference, forest size, fewest rows.
TARGET_NAMES = ("revenue", "price", "amount", "charge", "sales", "mrr", "cost", "score", "days", "bmi")
TREES, DEPTH, SEED = 60, 6, 42
FEWEST_ROWS = 15
# Rows of one task: the forest keeps each with its draws for all trees (about 360 bytes) and reads them once per level.
TASK_ROWS = 500_000


def choose_target(features: list[str], wanted: str | None = None) -> str | None:
    """The wanted column, else the first one with a telling name, else the last feature."""
    if wanted:
        return wanted
    for part in TARGET_NAMES:
        for c in features:
            if part in c.lower():
                return c
    return features[-1] if features else None


def in_tasks(staged: DataFrame, rows: int) -> DataFrame:
    """A staged table over all cores, and over as many tasks as hold at most ``TASK_ROWS`` rows each."""
    if rows <= TASK_ROWS:
        return spread(staged)
    return staged.repartition(max(-(-rows // TASK_ROWS), staged.sparkSession.sparkContext.defaultParallelism))


def key_drivers(df: DataFrame, target: str | None = None, features: list[str] | None = None) -> DataFrame:
    """``target, feature, importance`` (percent, rounded 1), the most important first.

    Empty for fewer than two features or 15 complete rows.
    """
    features = metric_columns(df, 4) if features is None else features
    target = choose_target(features, target if target in df.columns else None)
    spark, schema = df.sparkSession, "target string, feature string, importance double"
    predictors = [c for c in features if c != target]
    if target is None or not predictors:
        return spark.createDataFrame([], schema)
    rows = df.select(*[number(df, c).alias(c) for c in [*predictors, target]]).dropna()
    rows = stage(rows, "driver-rows")
    found = rows.count()
    if found < FEWEST_ROWS:
        return spark.createDataFrame([], schema)
    rows = in_tasks(rows, found)
    vectors = VectorAssembler(inputCols=predictors, outputCol="features").transform(rows)
    forest = RandomForestRegressor(
        labelCol=target, featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED, maxMemoryInMB=1024
    ).fit(vectors)
    weights = forest.featureImportances.toArray()
    ranked = sorted(zip(predictors, weights), key=lambda x: -x[1])
    return spark.createDataFrame([(target, c, round(float(w) * 100, 1)) for c, w in ranked], schema)
