"""Reading registered or database tables, and read-only SQL."""

from __future__ import annotations

import re
from functools import reduce

from py4j.java_gateway import is_instance_of
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession, functions as F

_PLANS = "org.apache.spark.sql.catalyst.plans.logical."
# Kinds of plan nodes that change something or run a script.
_ACTS = tuple(_PLANS + kind for kind in ("Command", "ParsedStatement", "CompoundBody"))


def load_table(spark: SparkSession, name: str, limit: int | None = None, url: str | None = None, **options: str) -> DataFrame:
    """A registered table, or with ``url`` a database table over JDBC; all rows unless a ``limit`` is given.

    JDBC partitioning options pass through.
    """
    if not re.fullmatch(r"[A-Za-z0-9_]+", name):
        raise ValueError(f"table name {name!r}")
    if url:
        df = spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    else:
        df = spark.table(name)
    return df if limit is None else df.limit(limit)


def list_tables(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Table names with exact row counts, sorted by name."""
    names = sorted(t.name for t in spark.catalog.listTables()) if names is None else sorted(names)
    if not names:
        return spark.createDataFrame([], "name string, rows bigint")
    counts = [spark.table(n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows") for n in names]
    return reduce(DataFrame.unionByName, counts).orderBy("name")


def check_read_only(spark: SparkSession, query: str) -> str | None:
    """Why a text is not one query that only reads, or None if it is: Spark's own parser decides."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query or "")
    except ParseException as e:
        return f"not one statement that can be parsed: {e.getCondition()}"
    gateway, todo = spark.sparkContext._gateway, [plan]
    while todo:
        node = todo.pop()
        if any(is_instance_of(gateway, node, kind) for kind in _ACTS):
            return f"{node.nodeName()} is not a query"
        children = node.children().iterator()
        while children.hasNext():
            todo.append(children.next())
    return None


def run_sql(spark: SparkSession, query: str, limit: int | None = None) -> DataFrame:
    """A read-only query over the registered tables; all rows unless a ``limit`` is given."""
    query = query.strip().rstrip(";")
    problem = check_read_only(spark, query)
    if problem:
        raise ValueError(problem)
    df = spark.sql(query)
    return df if limit is None else df.limit(limit)
