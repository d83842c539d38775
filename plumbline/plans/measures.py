"""Queries over a relational model: grouped measures and the automatically chosen ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.measures import average, divide, row_count, total
from plumbline.operators.columns import dimension_columns, numeric_columns, per_column, quoted, resolve, text_columns
from plumbline.plans.model import Model, unify, unify_named

# Name parts that exclude a column from the metrics ("id" as a word of its own: paid is a metric), and
# name parts that mark money, profit, sales and cost.
NOT_A_METRIC, NOT_A_DIMENSION = r"(^|_)id($|_)|code|key|index", r"(^|_)id($|_)|code"
MONEY = ("sales", "revenue", "profit", "price", "amount", "cost")
PROFIT, SALES, COST = ("profit", "margin"), ("sales", "revenue"), ("cost", "expense", "spend")
TOP_GROUPS, METRICS, DIMENSIONS_PER_TABLE = 20, 4, 2


def summarize(
    model: Model,
    table: str | None,
    by: list[str | tuple[str, str]],
    measures: dict[str, Column] | None = None,
    top: int | None = TOP_GROUPS,
) -> DataFrame:
    """Measures per group of the unified model, the largest first measure on top.

    ``by`` names columns of the unified view, or (table, column) where a name occurs twice. Groups
    without a value are left out; measures are rounded to 2. Filters belong into the measures
    (``calculate``), and every measure sees its group's rows only.
    """
    unified, places = unify_named(model, table)
    pairs = [b if isinstance(b, tuple) else (None, b) for b in by]
    names = [places.get((owner, column)) or resolve(unified, column, owner) for owner, column in pairs]
    measures = measures or {"Count": row_count()}
    grouped = (
        unified.dropna(subset=names)
        .groupBy(*[quoted(n) for n in names])
        .agg(*[F.round(m, 2).alias(label) for label, m in measures.items()])
    )
    first = next(iter(measures))
    ordered = grouped.orderBy(quoted(first).desc_nulls_last(), *[quoted(n) for n in names])
    return ordered.limit(top) if top else ordered


def evaluate(model: Model, measures: dict[str, Column], table: str | None = None) -> DataFrame:
    """Measures over the whole unified model, in one row."""
    return unify(model, table).agg(*[m.alias(label) for label, m in measures.items()])


def metric_names(df: DataFrame) -> list[str]:
    numeric = numeric_columns(df)
    return [c for c in numeric if not re.search(NOT_A_METRIC, c.lower())] or numeric


def _title(name: str) -> str:
    return name.replace("_", " ").title()


def auto_measures(model: Model, fact: str | None = None) -> DataFrame:
    """Totals and averages of the first metrics, row volume and ratios of the fact table.

    ``id, name, category, value, formatted``; one scan evaluates all of them.
    """
    fact = fact or model.fact_table()
    df = model.tables[fact]
    metrics = metric_names(df)
    wanted: list[tuple[str, str, str, Column, str]] = []
    for c in metrics[:METRICS]:
        style = "money" if any(word in c.lower() for word in MONEY) else "number"
        wanted.append((f"sum_{c}", f"Total {_title(c)}", "Core Aggregation", total(quoted(c)), style))
        wanted.append((f"avg_{c}", f"Average {_title(c)}", "Core Aggregation", average(quoted(c)), style))
    wanted.append(("count_records", f"Total {fact} Volume", "Volume", row_count().cast("double"), "records"))

    def first_named(words):
        return next((c for c in metrics if any(w in c.lower() for w in words)), None)

    profit, sales, cost = first_named(PROFIT), first_named(SALES), first_named(COST)
    for id_, name, part in (
        ("profit_margin", "Gross Profit Margin %", profit),
        ("cost_ratio", "Cost-to-Sales Ratio %", cost),
    ):
        if part and sales:
            share = divide(F.sum(quoted(part)), F.sum(quoted(sales)))
            wanted.append((id_, name, "Financial Ratio", share, "percent"))

    row = df.agg(*[m.alias(f"m{i}") for i, (*_, m, _) in enumerate(wanted)])
    formats = {
        "money": lambda v: F.concat(F.lit("$"), F.format_number(v, 2)),
        "number": lambda v: F.format_number(v, 2),
        "records": lambda v: F.concat(F.format_number(v.cast("bigint"), 0), F.lit(" Records")),
        "percent": lambda v: F.format_string("%.2f%%", v * 100),
    }
    fields = [
        [F.lit(id_), F.lit(name), F.lit(category), F.col(f"m{i}"), formats[style](F.col(f"m{i}"))]
        for i, (id_, name, category, _, style) in enumerate(wanted)
    ]
    return per_column(row, fields, ["id", "name", "category", "value", "formatted"])


def auto_breakdowns(model: Model, fact: str | None = None, top: int | None = TOP_GROUPS) -> DataFrame:
    """The first metric of the fact table by up to two dimensions of every linked table.

    ``dimension_table, dimension, segment, total``, each dimension's ``top`` largest totals first. A dimension
    has 2 to 30 different values; a table without one adds nothing. All dimensions share one pass over one unified
    view: a row contributes to each of its segments and is combined on the map side.
    """
    fact = fact or model.fact_table()
    metric = metric_names(model.tables[fact])[0]
    unified, places = unify_named(model, fact)
    dimensions: list[tuple[str, str]] = []
    for r in model.relationships:
        table = r.to_table if r.from_table == fact else r.from_table
        df = model.tables[table]
        texts = [c for c in text_columns(df) if not re.search(NOT_A_DIMENSION, c.lower())]
        chosen = dimension_columns(df.select(*[quoted(c) for c in texts]), 2, 30) if texts else []
        for c in chosen[:DIMENSIONS_PER_TABLE]:
            if (table, c) not in dimensions:
                dimensions.append((table, c))
    entries = []
    for t, c in dimensions:
        entries.append(
            F.struct(
                F.lit(t).alias("dimension_table"), F.lit(c).alias("dimension"),
                quoted(places[t, c]).cast("string").alias("segment"),
            )
        )
    if not entries:
        return unified.sparkSession.createDataFrame(
            [], "dimension_table string, dimension string, segment string, total double"
        )
    long = unified.select(quoted(metric).alias("__m"), F.inline(F.array(*entries))).filter(F.col("segment").isNotNull())
    totals = long.groupBy("dimension_table", "dimension", "segment").agg(F.round(total(F.col("__m")), 2).alias("total"))
    order = [F.desc_nulls_last("total"), F.col("segment")]
    if top:
        rank = F.row_number().over(Window.partitionBy("dimension_table", "dimension").orderBy(*order))
        totals = totals.withColumn("__rank", rank).filter(F.col("__rank") <= top).drop("__rank")
    return totals.orderBy("dimension_table", "dimension", *order)
