import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from plumbline.operators.profile import numeric_profile
from plumbline.operators.audit import audit
from plumbline.plans.model import Model
from plumbline.sources import files, sinks, tables


def test_delimited_text(spark, tmp_path):
    path = tmp_path / "semi.csv"
    path.write_text('id;name;price\n1;a;"1,5"\n2;b\n3;c;2;too long\n4;d;7\n', encoding="utf-8")
    rows = [tuple(r) for r in files.read_delimited(spark, str(path), sep=";").collect()]
    assert rows == [("1", "a", "1,5"), ("2", "b", None), ("4", "d", "7")]


def test_encoding_and_delimiter_rules(spark, tmp_path):
    path = tmp_path / "latin.tsv"
    path.write_bytes("id\tcity\n1\tKöln\n".encode("latin1"))
    assert files.read_delimited(spark, str(path)).first()["city"] == "Köln"
    path = tmp_path / "late.csv"
    path.write_bytes(("id;city\n" + "".join(f"{i};x\n" for i in range(100)) + "101;Köln\n").encode("latin1"))
    assert "Köln" in {r["city"] for r in files.read_delimited(spark, str(path)).collect()}
    found = lambda *lines: files.describe_lines(spark.createDataFrame([(x,) for x in lines], "value string"), lines[0])[0]
    assert found("a;b;c", "1;2;3", "4;5;6;7") == ";" and found("a;b;c", "1;2", "4;5;6;7") == ","  # most lines disagree
    assert found("a,b;c", "d,e;f") == "," and found("one", "two") == "," and found("a|b|c", "", "d|e|f") == "|"
    assert found('a;b', '"x,y";1', '"z,w";2') == ";"


def test_over_long_rows(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text('a;b;c\n1;2;3\n2;b;3;;x\n3;b;3;\n4;"x;y";z\n5;b\n')
    assert {r["a"] for r in files.read_delimited(spark, str(path), sep=";").collect()} == {"1", "4", "5"}
    assert files.read_delimited(spark, str(path), sep=";").count() == 3


def test_json_both_forms(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(map(json.dumps, rows)))
    for name in ("array.json", "lines.json"):
        assert files.read_json(spark, str(tmp_path / name)).agg(F.sum("a"), F.count("b")).first() == (3, 1)


def test_ingest(spark, tmp_path):
    (tmp_path / "my orders.csv").write_text("order_no,customer_id\n" + "\n".join(f"{i},{i % 3}" for i in range(9)))
    (tmp_path / "customers.json").write_text("\n".join(json.dumps({"customer_id": i}) for i in range(3)))
    model, edges = files.ingest(spark, [str(tmp_path / "my orders.csv"), str(tmp_path / "customers.json")])
    assert list(model.tables) == ["my_orders", "customers"]
    assert edges.first()["to_table"] == "customers"


def test_read_only_guard(spark):
    assert tables.check_read_only(spark, "select 1 -- drop") is None
    assert tables.check_read_only(spark, "with a as (select 'drop; table' as comment) select * from a") is None
    spark.range(6000).createOrReplaceTempView("guard_rows")
    for bad in (
        "", "drop table x", "select 1; select 2", "insert into x select 1", "selection", "create table y as select 1", "set a = b",
        "from guard_rows insert into x select id", "begin select 1; end", "cache table guard_rows", "show tables",
    ):
        assert tables.check_read_only(spark, bad), bad
        with pytest.raises(ValueError):
            tables.run_sql(spark, bad)
    assert tables.run_sql(spark, "select * from guard_rows where 'no limit' is not null;").count() == 6000
    assert tables.run_sql(spark, "select * from guard_rows", 7).count() == 7
    with pytest.raises(ValueError):
        tables.load_table(spark, "guard_rows; drop")
    assert tables.load_table(spark, "guard_rows").count() == 6000 and tables.load_table(spark, "guard_rows", 10).count() == 10


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert sinks.run_history(spark, path, 0).collect() == []
    with ThreadPoolExecutor(4) as pool:  # appended side by side
        list(pool.map(lambda i: sinks.record_run(spark, path, i % 2, f"d{i}", i, 90.06), range(6)))
    latest = sinks.run_history(spark, path, 0).collect()
    assert sorted(r["dataset"] for r in latest) == ["d0", "d2", "d4"] and latest[0]["health_score"] == 90.1
    assert [r["created_at"] for r in latest] == sorted((r["created_at"] for r in latest), reverse=True)
    files = {f: f.stat().st_mtime_ns for f in (tmp_path / "log").rglob("*.parquet")}
    left = sinks.clear_history(spark, path, 0)
    assert sorted(r["dataset"] for r in left.collect()) == ["d1", "d3", "d5"]
    assert all(f.stat().st_mtime_ns == t for f, t in files.items())  # nothing is rewritten
    sinks.record_run(spark, path, 0, "later", 1, 50.0)
    assert [r["dataset"] for r in sinks.run_history(spark, path, 0).collect()] == ["later"]
    assert sinks.run_history(spark, path, 1, 2).count() == 2
    target = str(tmp_path / "log2")
    sinks.compact_log(spark, path, target)
    assert sorted(r["dataset"] for r in sinks.read_runs(spark, target).collect()) == ["d1", "d3", "d5", "later"]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v {i}, \"quoted\"") for i in range(12)], "id int, text string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r["text"] for r in back.collect()} == {r["text"] for r in df.collect()}
    summary = sinks.export_summary(str(tmp_path / "sum"), "T", df, numeric_profile(df), audit(df).table_frame())
    assert summary.first()["total_records"] == 12
    manifest = sinks.export_model(Model().add("t", df), str(tmp_path / "model"))
    assert {(r["table"], r["rows"]) for r in manifest.collect()} == {("t", 12), ("unified_model", 12)}
    assert sinks.cleaned_or_unified(None, df, None) is df


def test_raw_summary_sorts_no_rows_for_distinct_texts(spark):
    from catalog.queries import _raw_summary

    df = spark.createDataFrame([("a", "1", "d2", "x"), ("a", "2", "d1", "y"), (None, "3", None, "x")], "order_id string, line_number string, ship_date string, price string")
    summary = _raw_summary(df)
    assert tuple(summary.first()) == (3, 1, 2, "d1", 6)
    assert "Expand" not in summary._jdf.queryExecution().optimizedPlan().toString()
