"""Average ranks over whole columns without sorting a column in one task."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.session import stage

# Distinct values per bucket, and the most boundaries that are sketched.
_BUCKET_VALUES, _BUCKETS = 200_000, 20_000


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """The average rank of every distinct value: ``column, value, rank``.

    Equal values combine first. The distinct values are spread over buckets by sketched boundaries, as many
    as there are values for; ranks run inside a bucket, after the exact number of rows in the buckets before it (a
    running sum over at most ``_BUCKETS`` rows per column).
    """
    entries = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]
    counts = (
        df.select(F.inline(F.array(*entries)))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = stage(counts, "value-counts")
    sizes = {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}
    buckets = min(_BUCKETS, math.ceil(max(sizes.values(), default=0) / _BUCKET_VALUES))
    edges = {c: [] for c in sizes}
    if buckets > 1:
        grid = F.percentile_approx("value", [i / buckets for i in range(1, buckets)], max(2000, 4 * buckets))
        edges = {r["column"]: sorted(set(r["edges"])) for r in counts.groupBy("column").agg(grid.alias("edges")).collect()}
    if not edges:
        return counts.select("column", "value", F.lit(0.0).alias("rank"))
    bucketed = _bucketed(counts, edges)
    totals = bucketed.groupBy("column", "bucket").agg(F.sum("n").alias("total"))
    earlier = Window.partitionBy("column").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("column", "bucket", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("column", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = bucketed.withColumn("upto", F.sum("n").over(within))
    # At most _BUCKETS rows per column.
    ranked = ranked.join(F.broadcast(totals), ["column", "bucket"])
    return ranked.select("column", "value", (F.col("offset") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))


def _bucketed(counts: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``counts`` with a ``bucket`` column: the number of its column's boundaries at or below a value."""
    parts = []
    for column, bounds in edges.items():
        if not bounds:
            parts.append(counts.filter(F.col("column") == column).withColumn("bucket", F.lit(0.0)))
            continue
        splitter = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="value", outputCol="bucket")
        parts.append(splitter.transform(counts.filter(F.col("column") == column)))
    return reduce(DataFrame.unionByName, parts)


def with_ranks(df: DataFrame, ranks: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the values of ``columns`` replaced by their ranks.

    One equi-join per column. A value that fills much of a column makes its partition large; the
    adaptive skew join splits it, as the rank side has one row per value.
    """
    ranks = stage(ranks, "ranks")
    for c in columns:
        own = ranks.filter(F.col("column") == c).select(F.col("value").alias(c), F.col("rank").alias(f"{c}_rank"))
        df = df.join(own, c).drop(c).withColumnRenamed(f"{c}_rank", c)
    return df
