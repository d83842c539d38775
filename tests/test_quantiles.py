import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import quantiles as qu
from plumbline.operators.ranks import average_ranks

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.965, 1.0]


def shapes():
    rng = np.random.default_rng(1)
    yield "normal", rng.normal(size=4000)
    yield "one value holds almost all", np.concatenate([np.full(3900, 7.0), rng.normal(size=100) * 100])
    yield "third is zero", np.concatenate([np.zeros(1300), rng.lognormal(0, 3, 2700)])
    yield "constant", np.full(500, 2.5)
    yield "few", np.array([3.0, 1.0, 2.0])
    yield "huge range", np.concatenate([[-1e300, 1e300], rng.normal(size=1000)])


@pytest.mark.parametrize("limit", [20, 10**6])
@pytest.mark.parametrize("weighted", [False, True])
def test_exact_on_any_shape(spark, limit, weighted):
    """A tiny limit forces the narrowing passes; results must not change."""
    data = dict(shapes())
    rows = [(name, float(x)) for name, xs in data.items() for x in xs]
    df = spark.createDataFrame(rows, "name string, v double").repartition(6)
    weight = None
    if weighted:
        df = df.groupBy("name", "v").agg(F.count(F.lit(1)).alias("w"))
        weight = F.col("w")
    values = {name: F.when(F.col("name") == name, F.col("v")) for name in data}
    found = qu.exact_quantiles(df, values, PROBS, limit, weight)
    for name, xs in data.items():
        assert found[name].count == len(xs)
        np.testing.assert_allclose(found[name].values, np.quantile(xs, PROBS), rtol=1e-9, atol=1e-12, err_msg=name)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert qu.exact_quantiles(df, {"v": F.col("v")}, [0.5])["v"].values == [None]


@pytest.mark.parametrize("limit", [30, 10**6])
def test_grouped_median_with_hot_groups(spark, limit):
    rng = np.random.default_rng(2)
    groups = {"hot": rng.normal(size=2000), "tied": np.repeat([1.0, 2.0], [700, 701]), "small": np.array([5.0, 1.0]), None: np.array([9.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs], "g string, v double").repartition(5)
    found = {r["g"]: r["median"] for r in qu.grouped_median(df, ["g"], F.col("v"), limit=limit).collect()}
    assert found.keys() == groups.keys()
    for g, xs in groups.items():
        assert found[g] == pytest.approx(np.median(xs), rel=1e-12)


def test_average_ranks_match_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(3)
    xs = np.concatenate([np.zeros(500), rng.integers(0, 50, 500), rng.normal(size=3000)])
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    found = {r["value"]: r["rank"] for r in average_ranks(df, ["x"]).collect()}
    want = dict(zip(xs, pd.Series(xs).rank()))
    assert found == want


def test_first_rows_are_counted_out_exactly(spark):
    rows = [(i % 7, i % 11, i) for i in range(700)]
    df = spark.createDataFrame(rows, "a int, b int, c int").repartition(5)
    for wanted in (0, 1, 99, 100, 101, 350, 699, 700):
        keep, _ = qu.first_rows(df, [F.col("a"), F.col("b"), F.col("c")], wanted)
        assert sorted(tuple(r) for r in df.filter(keep).collect()) == sorted(rows)[:wanted]


def test_brackets_of_hot_groups_are_broadcast(spark):
    """A join that shuffles would bring all rows of a group into one task."""
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 1999).cast("double").alias("v"))
    plan = qu.grouped_median(df, ["g"], F.col("v"), limit=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
