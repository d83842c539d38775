"""Isolation forest: rows that random splits separate early.

Spark ML has none, so three Spark steps make one: a reproducible row sample per tree, one small tree
fitted per group, and scoring in Arrow batches against the (bounded) forest.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.operators.columns import metric_columns, number, quoted
from plumbline.operators.quantiles import first_rows
from plumbline.session import spread, stage

# Forest size, rows per tree, rows to flag of a thousand, seed, fewest rows, list lengths.
TREES, TREE_ROWS, DEPTH = 100, 256, 8
FLAGGED_OF_1000 = 35
SEED = 42
FEWEST_ROWS = 20
TOP_ANOMALIES, SHOWN_FEATURES = 10, 5
_DRAWS = 1_024  # rows drawn per tree on average, of which the first TREE_ROWS are kept
_BLOCK, _TOP = 16_384, 3  # points that walk a tree together, levels walked by comparing all of their nodes

_TREE_SCHEMA = "tree int, feature array<int>, split array<double>, length array<double>"


def tree_samples(df: DataFrame, key: list[str], features: list[str], rows: int) -> DataFrame:
    """``tree`` and features of up to 256 rows per tree.

    One hash of the key picks the rows that any tree may use, about ``TREES * _DRAWS`` of them, and each of these joins
    every tree with the same probability, so that a tree draws ``_DRAWS`` rows on average; of each tree's rows those with the
    smallest hashes are kept. Draws depend on the hashed key alone, so they repeat exactly and ignore partitioning, and a
    row outside the pool costs one hash.
    """
    pool = TREES * _DRAWS
    drawable = df.filter(F.pmod(F.xxhash64(*key, F.lit(-1)), F.lit(rows)) < pool)
    draws = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(*key, t).alias("draw")))
    joins = F.filter(draws, lambda d: F.pmod(d["draw"], F.lit(min(rows, pool))) < _DRAWS)
    drawn = drawable.select(*dict.fromkeys([*key, *features]), F.inline(joins))
    first = Window.partitionBy("tree").orderBy("draw", *key)
    return drawn.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= TREE_ROWS).select(
        "tree", "place", *features
    )


def fit_forest(samples: DataFrame, features: list[str]) -> pd.DataFrame:
    """One row per tree: the split of every inner node and the path length of every leaf position."""

    def grow(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("place")
        tree = int(batch["tree"].iloc[0])
        return pd.DataFrame([(tree, *grow_tree(batch[features].to_numpy(float), tree))], columns=["tree", "feature", "split", "length"])

    # 100 rows, whatever the table's size.
    return samples.groupBy("tree").applyInPandas(grow, _TREE_SCHEMA).orderBy("tree").toPandas()


def grow_tree(points: np.ndarray, tree: int) -> tuple[list[int], list[float], list[float]]:
    """Random splits in heap order (children of i: 2i+1 and 2i+2), to depth 8.

    A node that stops early passes its path length down to all leaf positions under it, so scoring
    always walks eight levels.
    """
    draw = np.random.default_rng(SEED + tree)
    inner = 2**DEPTH - 1
    feature, split, length = [0] * inner, [0.0] * inner, [0.0] * (inner + 1)
    todo = [(0, 0, np.arange(len(points)))]
    while todo:
        node, depth, members = todo.pop()
        spread = np.ptp(points[members], axis=0) if len(members) > 1 else np.zeros(points.shape[1])
        if depth == DEPTH or not spread.any():
            first = (node + 1) * 2 ** (DEPTH - depth) - 1 - inner
            for leaf in range(first, first + 2 ** (DEPTH - depth)):
                length[leaf] = depth + average_path(len(members))
            continue
        f = int(draw.choice(np.flatnonzero(spread)))
        values = points[members, f]
        cut = float(draw.uniform(values.min(), values.max()))
        cut = cut if cut > values.min() else float(values.max())
        feature[node], split[node] = f, cut
        todo += [(2 * node + 1, depth + 1, members[values < cut]), (2 * node + 2, depth + 1, members[values >= cut])]
    return feature, split, length


def average_path(n: int) -> float:
    """Mean depth of an unsuccessful search among ``n`` points."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def path_lengths(points: np.ndarray, feature: np.ndarray, split: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sum of each point's path lengths in all trees.

    The nodes of the top levels are few: each is compared with all points of a block, and the bits give the node below
    them. Further down every point looks up its own node.
    """
    nodes = 2**_TOP - 1
    bits, below = np.arange(2**nodes), np.zeros(2**nodes, np.intp)
    for _ in range(_TOP):
        below = 2 * below + 1 + (bits >> below & 1)
    total = np.zeros(len(points))
    for begin in range(0, len(points), _BLOCK):
        columns = np.ascontiguousarray(points[begin:begin + _BLOCK].T)
        n, values, sums = columns.shape[1], columns.ravel(), total[begin:begin + _BLOCK]
        every = np.arange(n)
        for used, cut, leaf in zip(feature, split, length):
            first, code = used * n, np.zeros(n, np.uint8)
            for i in reversed(range(nodes)):
                code += code
                code += columns[used[i]] >= cut[i]
            node = below.take(code)
            for _ in range(DEPTH - _TOP):
                at = first.take(node)
                at += every
                right = values.take(at) >= cut.take(node)
                node += node
                node += 1
                node += right
            node -= 2**DEPTH - 1
            sums += leaf.take(node)
    return total


def score(df: DataFrame, features: list[str], forest: pd.DataFrame, rows: int) -> DataFrame:
    """``df`` with ``score`` in 0…1, higher for rows that are isolated sooner."""
    trees = df.sparkSession.sparkContext.broadcast(
        (
            np.array(forest["feature"].tolist()),
            np.array(forest["split"].tolist()),
            np.array(forest["length"].tolist()),
        )
    )
    norm = average_path(min(rows, TREE_ROWS))

    @F.pandas_udf("double")
    def isolation(columns: pd.DataFrame) -> pd.Series:
        total = path_lengths(columns.to_numpy(float), *trees.value)
        return pd.Series(2.0 ** (-total / len(trees.value[0]) / norm))

    return df.withColumn("score", isolation(F.struct(*[quoted(c) for c in features])))


def detect_anomalies(df: DataFrame, key: list[str], features: list[str] | None = None) -> DataFrame | None:
    """Complete rows with ``score``, ``anomaly_score`` (score over threshold) and ``is_anomaly``.

    ``key`` must identify a row. 3.5 % of the rows are flagged, rounded down: those of highest score, and where several
    share the last of these scores, those of smallest hashed key. The threshold lies between the last flagged row and the next.
    Scores are staged, as finding the threshold and using it both read them. None for fewer than two features or 20 complete rows.
    """
    features = metric_columns(df, 4) if features is None else features
    if len(features) < 2:
        return None
    complete = df.select(*[quoted(c) for c in key if c not in features], *[number(df, c).alias(c) for c in features])
    complete = spread(stage(complete.dropna(subset=features), "complete-rows"))
    rows = complete.count()
    if rows < FEWEST_ROWS:
        return None
    forest = fit_forest(tree_samples(complete, key, features, rows), features)
    scored = stage(score(complete, features, forest, rows), "scores")
    hashed = F.xxhash64(*[quoted(c) for c in key])
    # Halves of the hash, as a double holds only 53 bits.
    order = [-F.col("score"), F.shiftrightunsigned(hashed, 32), hashed.bitwiseAND(F.lit(0xFFFFFFFF))]
    flagged, (cut, *_) = first_rows(scored, order, rows * FLAGGED_OF_1000 // 1000)
    return scored.withColumns({"anomaly_score": F.col("score") + F.lit(cut), "is_anomaly": flagged})


def anomaly_summary(detected: DataFrame) -> DataFrame:
    """Number and share of flagged rows, in one row."""
    flagged = F.count_if("is_anomaly")
    return detected.agg(
        flagged.alias("total_anomalies"), F.round(flagged * 100 / F.count(F.lit(1)), 2).alias("anomaly_pct")
    )


def top_anomalies(detected: DataFrame, key: list[str], features: list[str], top: int = TOP_ANOMALIES) -> DataFrame:
    """The flagged rows with the highest scores and their first features that are not part of the key."""
    shown = [c for c in features if c not in key][:SHOWN_FEATURES]
    return (
        detected.filter("is_anomaly").orderBy(F.desc("anomaly_score"), *key).limit(top)
        .select(
            *key, F.round("anomaly_score", 3).alias("anomaly_score"),
            *[F.round(quoted(c), 2).alias(c) for c in shown],
        )
    )
