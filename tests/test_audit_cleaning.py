import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cleaning as cl
from plumbline.operators.audit import alerts, audit, compare_audits, tukey_outliers
from plumbline.operators.distinct import duplicate_rows, part_suspects
from plumbline.operators.distribution import hashed_distinct, hashed_modes, read_values, wide_columns

SCHEMA = "order_id string, city string, price string, when string, reading string, qty int, refund_amount double, note string"


@pytest.fixture
def messy(spark):
    rows = []
    for i in range(40):
        rows.append((
            f"ORD-{i}",
            ["new york", " NEW YORK", "Boston ", "n/a"][i % 4],
            "free" if i == 5 else f"${1000 + i},500.00" if i % 2 else f"{100 + i}.5 USD",
            ["2023-01-07", "01/08/2023", "09-Jan-2023", "2023/01/10 00:00:00", "Jan 11, 2023"][i % 5] if i else "pending",
            f"{110 + i}/{60 + i}" if i % 3 else f"{110 + i} / {60 + i} mmHg",
            9999 if i == 7 else i % 11,
            float(i) if i % 3 == 0 else None,
            f"line {i}" if i % 2 else f"Line  {i}",
        ))
    return spark.createDataFrame(rows + rows[:3], SCHEMA)


def test_audit(messy):
    found = audit(messy)
    by = {c.column: c for c in found.columns}
    assert found.duplicate_rows == 3 and found.total_rows == 43
    assert by["price"].detected_type == "dirty_numeric" and by["price"].missing_count == 1
    assert by["when"].detected_type == "datetime" and by["when"].is_dirty_datetime
    assert by["city"].casing_variations == 1 and by["city"].missing_count == 10
    assert by["qty"].outlier_count == 1 and by["refund_amount"].missing_count == 28
    table = found.table_frame().first()
    assert table["dirty_type_cols"] == 2 and 5 <= table["health_score"] <= 100


def test_audit_ignores_partitioning(messy):
    assert audit(messy.repartition(7)).columns == audit(messy.coalesce(1)).columns


@pytest.mark.parametrize("bound", [0, 12])
def test_columns_by_row_give_the_same_figures(messy, bound):
    """Whatever columns stay out of the value distribution, audit, decisions and log are the same."""
    assert audit(messy, bound).columns == audit(messy).columns
    for config in (cl.CleaningConfig(), cl.CleaningConfig(numeric_impute_strategy="mean", outlier_strategy="clip_iqr")):
        one, _ = cl.fit(messy, config)
        two, base = cl.fit(messy, config, bound)
        assert (one.composite, one.numbers, one.dates, one.titles, one.log) == (two.composite, two.numbers, two.dates, two.titles, two.log)
        assert one.clips.keys() == two.clips.keys() and all(one.clips[c] == pytest.approx(two.clips[c]) for c in one.clips) and one.fills == two.fills
        assert two.apply(base).count() == 40


def test_sampled_and_approximate_audit(spark):
    df = spark.range(4000).selectExpr("id as k", "concat('t', id) as name", "cast(id % 7 as int) as v")
    part = audit(df, fraction=0.25)
    assert 800 < part.total_rows < 1200 and part.columns[1].unique_count == part.total_rows and part == audit(df, fraction=0.25)
    exact, rough = audit(df, 100), audit(df, 100, approximate=True)
    for a, b in zip(exact.columns, rough.columns):
        assert a.unique_count in (4000, 7) and abs(a.unique_count - b.unique_count) <= 0.08 * a.unique_count
        assert (a.missing_count, a.outlier_count, a.detected_type) == (b.missing_count, b.outlier_count, b.detected_type)


def test_hashed_figures(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("b", float("nan")), ("a", None), (None, -0.0), ("c", 0.0)], "t string, v double")
    assert hashed_distinct(df, {"t": F.col("t"), "v": F.col("v")}) == {"t": 3, "v": 3}
    assert hashed_modes(df, ["t"]) == {"t": "a"}
    assert hashed_modes(df.select("t").distinct(), ["t"]) == {"t": "a"} and hashed_modes(df.limit(0), ["t"]) == {}
    assert wide_columns(df, 2).keys() == {"t"} and wide_columns(df, 9) == {}  # numbers repeat


def test_suspects(spark):
    rows = [(i % 50, f"r{i % 50}", None if i % 7 else 1.0) for i in range(200)] + [(900 + i, None, 0.0) for i in range(30)] + [(None, None, None)] * 3
    df = spark.createDataFrame(rows, "k int, __hash string, v double").repartition(4)
    want = sorted({repr(r) for r in df.collect()})
    for bound in (0, 1 << 20):
        alone, suspects = part_suspects(df, bound)
        assert (alone is None) == (bound == 0)
        assert bound == 0 or alone.count() == sum(rows.count(r) == 1 for r in rows)
    assert sorted(repr(r) for r in cl.deduplicate(df).collect()) == want and duplicate_rows(df) == len(rows) - len(want)
    assert duplicate_rows(df.filter("k >= 900")) == 0 and cl.deduplicate(df.limit(0)).count() == 0


def test_audit_of_empty_table(spark):
    row = audit(spark.createDataFrame([], "a int, b string")).table_frame().first()
    assert row["health_score"] == 0 and row["total_rows"] == 0


def test_type_threshold_is_strict(spark):
    df = spark.createDataFrame([(x, y) for x, y in zip(["1", "2", "3", "x"], ["1", "2", "3", "4"])], "three_quarters string, all string")
    assert [c.detected_type for c in audit(df).columns] == ["string", "dirty_numeric"]


def test_no_outliers_below_four_values(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (99.0,)], "v double")
    assert tukey_outliers(df, {"v": F.col("v")}) == {}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "v double")
    assert audit(df).columns[0].missing_count == 2


def test_clean(messy):
    cleaned, plan = cl.clean(messy)
    rows = {r["order_id"]: r for r in cleaned.collect()}
    assert len(rows) == 40
    assert plan.composite == "reading" and plan.numbers == ["price"] and plan.dates == ["when"]
    assert {r["city"] for r in rows.values()} == {"New York", "Boston"}  # n/a takes the mode
    assert rows["ORD-1"]["price"] == 1001500.0 and rows["ORD-3"]["reading_Systolic"] == 113
    assert rows["ORD-1"]["when"] == datetime.datetime(2023, 1, 8) and rows["ORD-1"]["when_DayOfWeek"] == "Sunday"
    assert rows["ORD-1"]["when_IsWeekend"] == 1 and rows["ORD-0"]["when"] is None and rows["ORD-0"]["when_IsWeekend"] == 0
    assert rows["ORD-7"]["qty"] < 9999  # winsorized
    assert rows["ORD-1"]["refund_amount"] == 0.0  # sparse optional amount
    assert "reading" not in cleaned.columns and rows["ORD-2"]["note"] == "Line 2"
    steps = {(r["step"], r["column"]): r["affected"] for r in plan.log_frame(messy.sparkSession).collect()}
    assert steps["deduplicate", None] == 3 and steps["null_tokens", "price"] == 1 and steps["outliers", "qty"] == 1


def test_clean_twice_changes_nothing(messy):
    once, _ = cl.clean(messy, cl.CleaningConfig(treat_outliers=False))
    twice, _ = cl.clean(once, cl.CleaningConfig(treat_outliers=False))
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


def test_clean_ignores_partitioning(messy):
    one, two = cl.clean(messy.repartition(9))[0], cl.clean(messy.coalesce(1))[0]
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_steps_can_be_switched_off(messy):
    off = cl.CleaningConfig(*([False] * 6), treat_outliers=False, decompose_composites=False)
    cleaned, plan = cl.clean(messy, off)
    assert cleaned.count() == 43 and cleaned.columns == messy.columns and not plan.fills


def test_unknown_strategy_is_refused():
    with pytest.raises(ValueError):
        cl.CleaningConfig(numeric_impute_strategy="drop")


def test_imputation_rules(spark):
    rows = [(None if i < 3 else float(i), None if i < 3 else f"k{i}", None if i < 5 else 1.0, None if i == 0 else "ab"[i % 2]) for i in range(10)]
    df = spark.createDataFrame(rows, "partner_id double, sku_code string, bonus double, kind string")
    values = read_values(df)
    fills, _ = cl.numeric_fills(values, ["partner_id", "bonus"], 10)
    assert fills == {}  # a key, and a sparse column that is no optional amount
    fills, _ = cl.categorical_fills(values, ["sku_code", "kind"], 10)
    assert fills == {"kind": "b"}
    tied = spark.createDataFrame([("y",), ("x",), (None,)], "kind string")
    assert cl.categorical_fills(read_values(tied), ["kind"], 3)[0] == {"kind": "x"}


def test_flat_column_has_no_outliers(spark):
    df = spark.createDataFrame([(5.0,)] * 20 + [(float(i),) for i in range(100, 105)], "v double")
    assert cl.find_outliers(read_values(df), ["v"]).clips == {}  # interquartile range 0


def test_plan_runs_on_a_stream(messy, spark, tmp_path):
    cleaned, plan = cl.clean(messy, cl.CleaningConfig(remove_duplicates=False))
    path = str(tmp_path / "in")
    messy.write.parquet(path)
    stream = plan.apply(spark.readStream.schema(messy.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("cleaned_stream").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("cleaned_stream").collect()
    assert sorted(map(str, got)) == sorted(map(str, cleaned.collect()))


def test_compare_and_alerts(messy):
    before = audit(messy)
    cleaned, _ = cl.clean(messy)
    row = compare_audits(before, audit(cleaned)).first()
    assert row["initial_total_rows"] == 43 and row["cleaned_total_rows"] == 40 and row["health_score_delta"] > 0
    assert alerts(before.table_frame()).collect() == [] or row["initial_health_score"] < 85


def test_report_shares_what_the_audit_found(messy, spark, monkeypatch):
    """The rows are searched for duplicates once before the cleaning, and it makes no second distribution of them."""
    from plumbline.operators import distinct
    from plumbline.plans.analysis import clean_with_report

    nothing = spark.createDataFrame([(None,) * 8] * 3, SCHEMA)
    rows = messy.unionByName(nothing)
    want, plan = cl.clean(rows)
    labels, scans, staged, read = [], [], distinct.stage, cl.read_values
    monkeypatch.setattr(distinct, "stage", lambda df, label: labels.append(label) or staged(df, label))
    monkeypatch.setattr(cl, "read_values", lambda df: scans.append(df) or read(df))
    report = clean_with_report(rows)
    assert labels.count("repeated") == 2 and not scans
    assert report.plan == plan and plan.few
    assert sorted(map(str, report.cleaned.collect())) == sorted(map(str, want.collect())) and report.cleaned.count() == 41
    assert sorted(map(str, plan.apply(rows.distinct()).collect())) == sorted(map(str, want.collect()))
    assert report.comparison.collect() == compare_audits(audit(rows), audit(want)).collect()
    parts = part_suspects(rows)
    by_row, base = cl.fit(rows, parts=parts, audited=audit(rows, 5, parts=parts))
    assert by_row == plan and base.count() == 41
    kept = cl.CleaningConfig(remove_duplicates=False)
    assert clean_with_report(rows, kept).plan == cl.clean(rows, kept)[1]


def test_repeated_hashes_are_sent_packed(spark):
    df = spark.range(1000).union(spark.range(900)).selectExpr("id", "concat('x', id) as s")
    alone, suspects = part_suspects(df)
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" in plan and "BroadcastHashJoin" in plan
    assert alone.count() == 100 and suspects.count() == 1800 and duplicate_rows(df) == 900


def test_staging_compiles_large_projections(spark, monkeypatch):
    """While a table is staged, generated methods stay within what the JVM compiles; the session's setting returns."""
    from pyspark.sql import DataFrameWriter

    from plumbline.session import stage

    seen, write, key = [], DataFrameWriter.parquet, "spark.sql.codegen.hugeMethodLimit"
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append(spark.conf.get(key)) or write(self, path))
    before = spark.conf.get(key)
    assert stage(spark.range(3)).count() == 3
    assert seen == ["8000"] and spark.conf.get(key) == before
