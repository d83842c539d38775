import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import anomalies as an, drivers, explore as ex, forecast as fc, insights, profile as pr, segments
from plumbline.plans.analysis import learn


def test_moments_match_pandas(spark):
    rng = np.random.default_rng(5)
    xs = rng.exponential(3, 400)
    df = spark.createDataFrame([(float(x),) for x in xs], "v double")
    row = pr.numeric_profile(df).first()
    s = pd.Series(xs)
    assert row["skewness"] == pytest.approx(s.skew(), abs=6e-4) and row["kurtosis"] == pytest.approx(s.kurt(), abs=6e-4)
    assert row["std"] == pytest.approx(s.std(), abs=6e-3) and row["median"] == pytest.approx(s.median(), abs=6e-3)
    assert row["shape"] == "Highly Skewed (Right/Positive)"
    counts = [r["count"] for r in pr.histogram(df).orderBy("bin").collect()]
    assert counts == list(np.histogram(xs, bins=20)[0])


def test_small_and_flat_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (1.0, 5.0, None), (1.0, 9.0, None)], "flat double, few double, none double")
    rows = {r["column"]: r for r in pr.numeric_profile(df).collect()}
    assert set(rows) == {"flat", "few"} and rows["flat"]["skewness"] == 0.0 and rows["few"]["kurtosis"] == 0.0
    assert pr.histogram(df).count() == 0


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 8, 300).astype(float)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + rng.normal(size=300), "c": np.exp(a / 3), "d": rng.normal(size=300)})
    pdf.loc[:20, "d"] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in r) for r in pdf.to_numpy()], "a double, b double, c double, d double")
    for method in ("pearson", "spearman"):
        want = pdf.dropna().corr(method=method).round(3)
        for r in pr.correlation(df, list("abcd"), method).collect():
            assert r["r"] == pytest.approx(want.loc[r["feature_a"], r["feature_b"]], abs=1.1e-3)
    first = pr.top_pairs(df, list("abcd")).first()
    assert first["strength"] == "Strong" and first["direction"] == "Positive"
    assert pr.correlation(df.limit(4), ["a", "b"]).count() == 0


def test_rest_of_exploration(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 10.0), (None, 4.0)], "g string, v double")
    assert [tuple(r) for r in ex.grouped_metric(df, "g", "v").collect()] == [("y", 10.0), ("x", 2.0)]
    row = ex.leader_laggard(ex.grouped_metric(df, "g", "v", "sum")).first()
    assert row["leader"] == "y" and row["laggard"] == "x" and row["spread"] == 2.5
    assert ex.compare(df, "g", "<>", "X").count() == 2  # a missing value is not x
    assert ex.search(df, "10").count() == 1 and ex.cross_filter(df, "y", "g").count() == 1
    assert [r["v"] for r in ex.sort_rows(df, "g", False).collect()][-1] == 4.0  # missing last
    assert ex.page_info(df, 1).first()["total_pages"] == 4
    with pytest.raises(ValueError):
        ex.page(df, 1, 0)


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("number", [1, 9, 21, 29, 33, 40])
def test_pages_cut_the_sorted_rows(spark, number, ascending):
    rng = np.random.default_rng(11)
    rows = [(None if i % 10 == 0 else float(rng.integers(0, 3)), int(rng.integers(0, 40)), f"r{i:03}") for i in range(200)]
    df = spark.createDataFrame(rows, "v double, k int, name string")
    whole = ex.sort_rows(df, "v", ascending, df.columns).collect()
    for in_task in (0, 100_000):
        assert ex.page(df, number, 5, "v", ascending, in_task=in_task).collect() == whole[5 * number - 5:5 * number]
    texts = df.withColumn("name", F.when(F.col("k") % 3 > 0, F.col("name"))).select("name", "v", "k").distinct()
    rows = ex.sort_rows(texts, "name", ascending, texts.columns).collect()
    for at in (0, number, len(rows) - 2):
        assert ex.page_after(texts, rows[at], 4, "name", ascending).collect() == rows[at + 1:at + 5]
    assert ex.page_after(texts, None, 4, "name", ascending).collect() == rows[:4]


def test_pages_skip_by_times_without_zone(spark):
    """Rows before a page are skipped by rank, also in an hour that the session's time zone leaves out."""
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        texts = spark.createDataFrame([(f"2024-03-31 {1 + i % 3:02}:{i % 60:02}:07.5", i) for i in range(300)], "t string, k int")
        df = texts.select(F.col("t").cast("timestamp_ntz").alias("t"), "k")
        _, left = ex._skip(df, [("t", True), ("k", True)], 200)
        assert left <= 1
        whole = ex.sort_rows(df, "t", True, ["k"]).collect()
        assert ex.page(df, 41, 5, "t", True, ["k"], in_task=0).collect() == whole[200:205]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_driver_rows_are_spread_by_number(spark, monkeypatch):
    monkeypatch.setattr(drivers, "TASK_ROWS", 100)
    df = spark.range(0, 3000, 1, 1).toDF("k")
    parts = drivers.in_tasks(df, 3000)
    assert max(parts.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 101


def test_isolation_forest(spark):
    rng = np.random.default_rng(7)
    points = [(i, *map(float, rng.normal(size=3))) for i in range(1000)] + [(2000 + i, 30.0 + i, -30.0, 30.0) for i in range(5)]
    df = spark.createDataFrame(points, "k int, a double, b double, c double")
    one = an.detect_anomalies(df.repartition(3), ["k"], ["a", "b", "c"])
    two = an.detect_anomalies(df.repartition(11), ["k"], ["a", "b", "c"])
    scores = lambda d: {r["k"]: r["score"] for r in d.collect()}
    assert scores(one) == scores(two)
    top = [r["k"] for r in an.top_anomalies(one, ["k"], ["a", "b", "c"]).collect()]
    assert set(top[:5]) == {2000, 2001, 2002, 2003, 2004}
    assert an.anomaly_summary(one).first()["anomaly_pct"] == pytest.approx(3.5, abs=0.1)
    assert an.detect_anomalies(df.limit(10), ["k"], ["a", "b"]) is None


def test_flags_the_stated_share_of_equal_rows(spark):
    """Every row occurs eight times, so scores tie; still 3.5 % are flagged, rounded down, whatever the partitions."""
    rng = np.random.default_rng(3)
    rows = [(8 * i + j, *p) for i, p in enumerate(rng.normal(size=(130, 2)).tolist()) for j in range(8)]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    flagged = lambda d: sorted(r["k"] for r in an.detect_anomalies(d, ["k"], ["a", "b"]).filter("is_anomaly").collect())
    assert len(flagged(df)) == 1040 * 35 // 1000
    assert flagged(df.repartition(7)) == flagged(df)


def test_tree_paths_are_consistent():
    feature, split, length = an.grow_tree(np.array([[0.0], [1.0], [100.0]]), 1)
    assert len(feature) == 255 and len(length) == 256 and max(length) <= 8 + an.average_path(256)
    assert an.average_path(2) == 1.0 and an.average_path(1) == 0.0


def test_segments(spark):
    rng = np.random.default_rng(8)
    centers = [(0, 0), (20, 0), (0, 20)]
    rows = [(i, float(cx + rng.normal()), float(cy + rng.normal()), datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i % 30))
            for i, (cx, cy) in enumerate(centers * 60)]
    df = spark.createDataFrame(rows, "row_id int, price double, size double, day timestamp")
    found = segments.segment(df, ["price", "size"])
    assert found.k == 3
    table = segments.personas(found).collect()
    assert [r["size"] for r in table] == [60, 60, 60] and all(r["percentage"] == 33.3 for r in table)
    projected, variance = segments.projection(found)
    assert sum(variance) == pytest.approx(100, abs=0.2) and segments.projection_sample(projected, ["row_id"]).count() == 180
    report = learn(df, ["row_id"])
    assert {"personas", "drivers", "anomalies", "forecast", "insights"} <= set(report)
    assert report["insights"].count() == 5 and report["drivers"].first()["target"] == "price"


def test_sweep_equals_plain_lloyd(spark):
    rng = np.random.default_rng(12)
    points = np.vstack([rng.normal(c, 1.0, (n, 3)) for c, n in (((0, 0, 0), 90), ((9, 0, 3), 40), ((0, 9, 9), 1), ((8, 8, 0), 60))])
    vectors = spark.createDataFrame([tuple(map(float, p)) for p in points], "x0 double, x1 double, x2 double").repartition(5)
    found = segments.sweep(vectors, [2, 3, 4, 5], restarts=2)
    for k, (centers, score) in zip([2, 3, 4, 5], found):
        away = ((points[:, None] - centers[None]) ** 2).sum(axis=2)
        own = away.argmin(axis=1)
        assert centers.shape == (k, 3) and centers.tolist() == sorted(centers.tolist())
        for j in range(k):  # a fixed point: every center is the mean of its rows
            assert np.allclose(points[own == j].mean(axis=0), centers[j], atol=1e-3)
        between = np.stack([((points[:, None] - points[own == j][None]) ** 2).sum(axis=2).sum(axis=1) for j in range(k)], axis=1)
        sizes = np.bincount(own, minlength=k)
        each = []
        for i, j in enumerate(own):
            a = between[i, j] / max(1, sizes[j] - 1)
            b = min(between[i, m] / sizes[m] for m in range(k) if m != j)
            each.append(0.0 if sizes[j] == 1 or max(a, b) == 0 else (b - a) / max(a, b))
        assert score == pytest.approx(np.mean(each), abs=1e-9)
        plain = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
        each = []
        for i, j in enumerate(own):
            a = plain[i, own == j].sum() / max(1, sizes[j] - 1)
            b = min(plain[i, own == m].mean() for m in range(k) if m != j)
            each.append(0.0 if sizes[j] == 1 else (b - a) / max(a, b))
        assert segments.sampled_silhouettes(vectors, [centers]) == [pytest.approx(np.mean(each), abs=1e-6)]
    same = spark.createDataFrame([(1.0, 2.0)] * 30, "x0 double, x1 double")
    assert [s for _, s in segments.sweep(same, [2, 3])] == [0.0, 0.0]


def test_drivers(spark):
    rng = np.random.default_rng(9)
    rows = [(float(a), float(b), float(3 * a + 0.01 * b)) for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, revenue double")
    found = drivers.key_drivers(df).collect()
    assert found[0]["feature"] == "a" and found[0]["target"] == "revenue" and found[0]["importance"] > 80
    assert insights.driver_insight(drivers.key_drivers(df)).first()["headline"].startswith("revenue follows a most: weight ")
    assert drivers.choose_target(["days", "unit_price"]) == "unit_price" and drivers.choose_target(["x", "y"]) == "y"


def test_forecast_matches_numpy(spark):
    rng = np.random.default_rng(10)
    start = datetime.datetime(2024, 1, 1)
    days = [d for d in range(30) if d not in (4, 5)]
    rows = [(start + datetime.timedelta(days=d, hours=h), float(10 + d + rng.normal())) for d in days for h in (1, 13)]
    df = spark.createDataFrame(rows, "t timestamp, v double")
    pdf = pd.DataFrame(rows, columns=["t", "v"]).set_index("t")["v"].resample("D").mean().dropna()
    series = fc.series(df, "t", "v")
    assert [r["value"] for r in series.orderBy("period").collect()] == pytest.approx(list(pdf))
    rolling = [r["rolling"] for r in fc.rolling_mean(series).orderBy("period").collect()]
    assert rolling == pytest.approx(list(pdf.rolling(7, min_periods=1).mean()))
    slope, intercept = np.polyfit(np.arange(len(pdf)), pdf.values, 1)
    got = fc.forecast(series).orderBy("step").collect()
    assert [r["value"] for r in got] == pytest.approx([slope * (len(pdf) + i) + intercept for i in range(14)], abs=0.006)
    assert got[0]["period"] == datetime.date(2024, 1, 31)
    few = df.filter(F.col("t") < "2024-01-04")
    assert fc.step_of(few, "t", "v") == "week" and fc.series(few, "t", "v").first()["period"] == datetime.date(2024, 1, 7)
    assert fc.forecast(fc.series(few, "t", "v"), "week").count() == 0


def test_path_lengths_equal_plain_walks():
    rng = np.random.default_rng(5)
    points = np.column_stack([rng.integers(0, 5, 20_000), rng.normal(size=20_000), np.where(rng.random(20_000) < 0.9, 0, 7)]).astype(float)
    points[0] = np.nan
    trees = [an.grow_tree(points[rng.integers(1, 20_000, size)], t) for t, size in enumerate((256, 256, 3, 1))]
    arrays = [np.array([t[i] for t in trees]) for i in range(3)]
    got = an.path_lengths(points, *arrays)
    for row in [0, 1, 16_383, 16_384, 19_999, *rng.integers(0, 20_000, 300)]:
        want = 0.0
        for feature, split, length in trees:
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + bool(points[row][feature[node]] >= split[node])
            want += length[node - len(feature)]
        assert got[row] == want


def test_anomaly_profile_seeks_no_quantiles(spark, monkeypatch):
    """The profile's quantiles, several scans for each, were sought and not read."""
    from catalog.queries import QUERIES

    def sought(*args, **kwargs):
        raise AssertionError("quantiles")

    rows = [("a", 4.0, 9.0), ("b", 0.12, 0.5)]
    df = spark.createDataFrame([(-1.0, 0.5), (9.0, None), (4.0, -0.25), (None, 0.1)], "a double, b double")
    full = {r["column"]: (r["mean"], r["max"]) for r in pr.numeric_profile(df).collect()}
    monkeypatch.setattr(pr, "exact_quantiles", sought)
    assert {r["column"]: (r["mean"], r["max"]) for r in pr.means_and_maxima(df, ["a", "b"]).collect()} == full == {c: (m, x) for c, m, x in rows}
    assert len(QUERIES["anomaly_profile_given"](spark, "/root/testdata/sf0.001").collect()) == 4
