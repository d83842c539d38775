"""Compare registered queries with their SQL counterparts: ``python tests/verify.py [name ...]``."""

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_connection(sf):
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ("null",)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return ("num", float(f"{float(value):.9g}") + 0.0)
    return ("str", str(value))


def difference(got, want_columns, want_rows):
    """None if both results hold the same rows, else a description."""
    columns = sorted(got.columns)
    if columns != sorted(want_columns):
        return f"columns {columns} != {sorted(want_columns)}"
    order = [want_columns.index(c) for c in columns]
    ours = sorted(tuple(canonical(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(canonical(r[i]) for i in order) for r in want_rows)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(wrong)} of {len(ours)} rows differ, first: {wrong[0]}" if wrong else None


def check(spark, con, name, sf):
    from catalog.queries import ORACLES, QUERIES
    from plumbline.session import scratch_path

    got = QUERIES[name](spark, sf)
    # As written: Parquet refuses what a count would not see, such as two columns of one name.
    path = scratch_path(spark, "result")
    got.write.parquet(path)
    got = spark.read.parquet(path)
    if name not in ORACLES:
        return None if got.count() > 0 else "no rows"
    relation = con.sql(ORACLES[name])
    return difference(got, relation.columns, relation.fetchall())


if __name__ == "__main__":
    from catalog.queries import QUERIES
    from plumbline.session import get_session

    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark = get_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf)
    bad = 0
    for name in sys.argv[1:] or QUERIES:
        start = time.time()
        try:
            problem = check(spark, con, name, sf)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
