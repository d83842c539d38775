"""Customer-style segments: k-means with the best number of clusters, projection and descriptions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.operators.columns import metric_columns, number, quoted
from plumbline.session import spread, stage

# Sweep, seed, fewest rows, trait threshold and how many traits to name and keep.
CLUSTER_RANGE = (2, 3, 4, 5)
SEED = 42
FEWEST_ROWS = 15
TRAIT_PCT = 15
NAMED_TRAITS, KEPT_TRAITS = 2, 4
SCATTER_POINTS = 300
# Rows from which starting centers are drawn, most passes over all rows, and the move of a center that counts as none.
START_ROWS = 10_000
JUDGED_ROWS = 2_000
PASSES, STILL = 8, 1e-3


@dataclass
class Segmentation:
    """``assigned`` holds the complete rows with ``cluster`` and the standardized ``scaled`` vector."""

    features: list[str]
    k: int
    silhouette: float
    scores: list[tuple[int, float]]
    assigned: DataFrame

    def scores_frame(self) -> DataFrame:
        return self.assigned.sparkSession.createDataFrame(
            [(k, round(s, 3)) for k, s in self.scores], "k int, score double"
        )


def feature_columns(df: DataFrame) -> list[str]:
    """Numeric columns that describe a row: no keys or calendar flags, over 4 values."""
    return metric_columns(df, 4)


def standardized(df: DataFrame, features: list[str]) -> DataFrame:
    """Complete rows with the features scaled to mean 0 and deviation 1 in ``scaled``."""
    complete = df.withColumns({c: number(df, c) for c in features}).dropna(subset=features)
    assembled = VectorAssembler(inputCols=features, outputCol="raw_vector").transform(complete)
    scaler = StandardScaler(inputCol="raw_vector", outputCol="scaled", withMean=True, withStd=True)
    return scaler.fit(assembled).transform(assembled).drop("raw_vector")


def start_centers(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centers spread by k-means++ over a bounded sample and settled on it."""
    draw = np.random.default_rng(seed)
    centers = points[draw.integers(len(points))][None]
    while len(centers) < k:
        away = ((points[:, None] - centers[None]) ** 2).sum(axis=2).min(axis=1)
        total = away.sum()
        at = draw.choice(len(points), p=away / total) if total > 0 else draw.integers(len(points))
        centers = np.vstack([centers, points[at]])
    for _ in range(60):
        nearest = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([points[nearest == j].mean(axis=0) if (nearest == j).any() else centers[j] for j in range(k)])
        if np.allclose(moved, centers, atol=1e-9):
            break
        centers = moved
    return centers


def _distances(x: list[Column], centers: np.ndarray) -> Column:
    """Squared distances to all centers as an array."""
    parts = []
    for center in centers.tolist():
        total = F.lit(0.0)
        for v, c in zip(x, center):
            total = total + (v - F.lit(c)) * (v - F.lit(c))
        parts.append(total)
    return F.array(*parts)


def nearest(x: list[Column], centers: np.ndarray) -> Column:
    """Number of the nearest center, the first of several."""
    away = _distances(x, centers)
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])


def _cluster_sums(vectors: DataFrame, models: list[np.ndarray]) -> list[np.ndarray]:
    """Per model a row per cluster: size, sum of squared norms, cost, sums of the coordinates. One scan for all models.

    Every task assigns its rows by all models in Arrow batches and hands on one row per cluster.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(m), 3 + m.shape[1])) for m in models]
        for batch in batches:
            x = _matrix(batch)
            norm = (x * x).sum(axis=1)
            for m, total in zip(models, totals):
                away = ((x[:, None] - m[None]) ** 2).sum(axis=2)
                own = away.argmin(axis=1)
                columns = [np.ones(len(x)), norm, away.min(axis=1), *x.T]
                total += np.column_stack([np.bincount(own, c, len(m)) for c in columns])
        rows = [(i, j, list(map(float, r))) for i, t in enumerate(totals) for j, r in enumerate(t) if r[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.list_(pa.float64())))] if rows else
            [pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.float64()))], names=["model", "cluster", "sums"])

    width = 3 + models[0].shape[1]
    parts = vectors.mapInArrow(run, "model int, cluster int, sums array<double>")
    found = parts.groupBy("model", "cluster").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    sums = [np.zeros((len(m), width)) for m in models]
    for r in found.collect():
        sums[r["model"]][r["cluster"]] = [r[f"s{i}"] for i in range(width)]
    return sums


def sweep(vectors: DataFrame, sizes: list[int], restarts: int = 1) -> list[tuple[np.ndarray, float]]:
    """Centers of the best run and mean silhouette for every number of clusters, all fitted together.

    Each pass over the rows moves the centers of every model that has not settled; a last one takes all silhouettes,
    which need only sizes, sums and squared norms of the clusters. Starting centers come from the ``START_ROWS`` rows
    of smallest hash; where they start has no bearing on what the passes cover. Clusters are numbered by their centers.
    """
    sample = vectors.orderBy(F.xxhash64(*vectors.columns), *vectors.columns).limit(START_ROWS).toPandas().to_numpy(float)
    runs = [(k, start_centers(sample, k, SEED + r)) for k in sizes for r in range(restarts)]
    models = [centers for _, centers in runs]
    sums = _cluster_sums(vectors, models)
    open_ = list(range(len(models)))
    for _ in range(PASSES):
        still = []
        for i in open_:
            size = sums[i][:, :1]
            moved = np.where(size > 0, sums[i][:, 3:] / np.maximum(size, 1), models[i])
            if np.sqrt(((moved - models[i]) ** 2).sum(axis=1)).max() > STILL:
                still.append(i)
            models[i] = moved
        open_ = still
        if not open_:
            break
        for i, found in zip(open_, _cluster_sums(vectors, [models[i] for i in open_])):
            sums[i] = found
    best = {}
    for i, (k, _) in enumerate(runs):
        if k not in best or sums[i][:, 2].sum() < sums[best[k]][:, 2].sum():
            best[k] = i
    chosen = [models[best[k]][np.lexsort(models[best[k]].T[::-1])] for k in sizes]
    return list(zip(chosen, silhouettes(vectors, chosen)))


def silhouettes(vectors: DataFrame, models: list[np.ndarray]) -> list[float]:
    """Mean silhouette (squared Euclidean) of every model, over all rows in two scans.

    The mean squared distance of a row to a cluster follows from the cluster's size, sums and squared norms. A row that
    is alone in its cluster counts 0.
    """
    known = list(zip(models, _cluster_sums(vectors, models)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known))
        for batch in batches:
            x = _matrix(batch)
            norm = (x * x).sum(axis=1)[:, None]
            for i, (centers, sums) in enumerate(known):
                size = np.maximum(sums[:, 0], 1)
                own = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
                mean = np.where(sums[:, 0] > 0, norm + sums[:, 1] / size - 2 * x @ (sums[:, 3:] / size[:, None]).T, np.inf)
                at = np.arange(len(x))
                a = mean[at, own] * size[own] / np.maximum(size[own] - 1, 1)
                mean[at, own] = np.inf
                b = mean.min(axis=1)
                widest = np.maximum(np.maximum(a, b), 1e-300)
                total[i] += np.where((size[own] <= 1) | (widest <= 1e-12) | np.isinf(b), 0.0, (b - a) / widest).sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(known)), pa.int32()), pa.array(total)], names=["model", "total"])

    found = vectors.mapInArrow(run, "model int, total double").groupBy("model").agg(F.sum("total").alias("total")).collect()
    total = {r["model"]: r["total"] for r in found}
    return [float(total.get(i, 0.0) / max(1.0, sums[:, 0].sum())) for i, (_, sums) in enumerate(known)]


def sampled_silhouettes(vectors: DataFrame, models: list[np.ndarray], rows: int = JUDGED_ROWS) -> list[float]:
    """Mean silhouette by plain Euclidean distance of every model, over the ``rows`` rows of smallest hash.

    Plain distances need every pair, so this form is only offered for a sample of stated size.
    """
    x = vectors.orderBy(F.xxhash64(*vectors.columns), *vectors.columns).limit(rows).toPandas().to_numpy(float)
    apart = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * x @ x.T))
    np.fill_diagonal(apart, 0)
    scores, at = [], np.arange(len(x))
    for centers in models:
        own = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        size = np.bincount(own, minlength=len(centers))
        mean = np.column_stack([apart[:, own == j].sum(axis=1) for j in range(len(centers))])
        a = mean[at, own] / np.maximum(size[own] - 1, 1)
        other = np.where(size[None] > 0, mean / np.maximum(size, 1)[None], np.inf)
        other[at, own] = np.inf
        b = other.min(axis=1)
        widest = np.maximum(a, b)
        single = (size[own] == 1) | (widest == 0) | np.isinf(b)
        scores.append(float(np.where(single, 0.0, (b - a) / np.where(single, 1.0, widest)).mean()))
    return scores


def segment(df: DataFrame, features: list[str] | None = None, restarts: int = 1, euclidean: bool = False) -> Segmentation | None:
    """K-means for each k in the sweep, over all complete rows; more ``restarts`` keep the best run.

    The k with the highest silhouette wins, the smaller on ties: squared Euclidean over all rows, or with ``euclidean``
    plain Euclidean over a sample of ``JUDGED_ROWS``. None for fewer than two features or 15 complete rows.
    """
    features = feature_columns(df) if features is None else features
    if len(features) < 2:
        return None
    rows = standardized(df, features)
    scaled = vector_to_array("scaled")
    vectors = stage(rows.select(*[scaled[i].alias(f"x{i}") for i in range(len(features))]), "vectors")
    n = vectors.count()
    if n < FEWEST_ROWS:
        return None
    sizes = [k for k in CLUSTER_RANGE if k < n - 1]
    found = sweep(spread(vectors), sizes, restarts)
    judged = sampled_silhouettes(vectors, [c for c, _ in found]) if euclidean else [score for _, score in found]
    scores = list(zip(sizes, judged))
    k, score = max(scores, key=lambda s: (s[1], -s[0]))
    centers = found[sizes.index(k)][0]
    assigned = rows.withColumn("cluster", nearest([scaled[i] for i in range(len(features))], centers))
    return Segmentation(features, k, score, scores, assigned)


def projection(segmentation: Segmentation) -> tuple[DataFrame, list[float]]:
    """Two principal components ``x, y`` of every row, and the variance each explains in percent.

    Signs are fixed so that each component's largest loading is positive.
    """
    rows = segmentation.assigned
    model = PCA(k=2, inputCol="scaled", outputCol="pca").fit(rows)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    parts = vector_to_array("pca")
    projected = model.transform(rows).withColumns(
        {axis: parts[j] * F.lit(signs[j]) for j, axis in enumerate(("x", "y"))}
    )
    return projected.drop("pca", "scaled"), [round(float(v) * 100, 1) for v in model.explainedVariance]


def projection_sample(projected: DataFrame, key: list[str], points: int = SCATTER_POINTS) -> DataFrame:
    """Points for a scatter plot: the rows with the smallest hashed keys, so a re-run draws the same."""
    return projected.orderBy(F.xxhash64(*key), *key).limit(points).select(
        F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), "cluster"
    )


def personas(segmentation: Segmentation) -> DataFrame:
    """Size, share and distinguishing traits of each cluster.

    A trait is a feature whose cluster mean lies more than 15 % off the overall mean. One aggregation
    by cluster gives sizes, sums and means; the overall means follow from the k rows it leaves.
    """
    features, rows = segmentation.features, segmentation.assigned
    per_cluster = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(quoted(c)).alias(f"m{i}") for i, c in enumerate(features)]
    )
    overall = per_cluster.agg(
        F.sum("size").alias("rows"),
        *[(F.sum(F.col(f"m{i}") * F.col("size")) / F.sum("size")).alias(f"all{i}") for i in range(len(features))],
    )
    traits = []
    for i, c in enumerate(features):
        mean, base = F.col(f"m{i}"), F.col(f"all{i}")
        off = (mean - base) / F.when(base == 0, F.lit(1.0)).otherwise(base) * 100
        label = F.concat(
            F.when(off > 0, F.lit("High ")).otherwise(F.lit("Low ")), F.lit(f"{c} ("), F.round(mean, 1).cast("string"), F.lit(")")
        )
        traits.append(F.when(F.abs(off) > TRAIT_PCT, label))
    # Both sides are as small as the number of clusters.
    table = per_cluster.join(F.broadcast(overall)).withColumn("traits", F.array_compact(F.array(*traits)))
    named = F.array_join(F.slice("traits", 1, NAMED_TRAITS), ", ")
    name = F.when(F.size("traits") > 0, named).otherwise(F.lit("Balanced Group"))
    return table.select(
        F.col("cluster").alias("cluster_id"),
        F.concat(F.lit("Cluster "), F.col("cluster").cast("string"), F.lit(": "), name).alias("name"),
        "size",
        F.round(F.col("size") * 100 / F.col("rows"), 1).alias("percentage"),
        F.slice("traits", 1, KEPT_TRAITS).alias("key_traits"),
    )
