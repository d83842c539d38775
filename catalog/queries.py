"""Every registered query with its SQL counterpart.

Queries take the session and the folder of the given tables. All of them read whole tables; where one
has no SQL counterpart (iterative learning), a test checks it on a small fixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from catalog import sql as q
from catalog.dirty import LINEITEM
from plumbline.functions import measures as ms, text as tx
from plumbline.operators import (
    anomalies, audit as au, cleaning as cl, columns as co, distinct as di, distribution as ds, drivers, explore as ex,
    forecast as fc, insights, profile as pr, segments,
)
from plumbline.plans import analysis, measures as pm
from plumbline.plans.model import Model, data_dictionary, discover, model_of, sample_rows, schema_summary, unify, unify_named
from plumbline.session import scratch_path, stage
from plumbline.sources import files, sinks, tables as tb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

PREFIXES = {
    "region": "r_", "nation": "n_", "customer": "c_", "supplier": "s_", "part": "p_", "orders": "o_", "lineitem": "l_",
}
COLUMNS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    ],
}
SALES = ("lineitem", "orders", "customer", "nation", "region")
_staged: dict[tuple[str, str, str], DataFrame] = {}


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """The messy view of lineitem, written once per session as the raw input of the cleaning queries."""
    key = (spark.sparkContext.applicationId, sf, "dirty")
    if key not in _staged:
        _staged[key] = stage(spark.sql(LINEITEM, lineitem=table(spark, sf, "lineitem")), "dirty")
    return _staged[key]


def plain(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table with the prefix of its column names removed, so that key names match."""
    df, n = table(spark, sf, name), len(PREFIXES[name])
    return df.toDF(*[c[n:] for c in df.columns])


def sales_model(spark: SparkSession, sf: str, names=SALES) -> Model:
    model = model_of((n, plain(spark, sf, n)) for n in names)
    discover(model)
    return model


def plain_sql(name: str) -> str:
    return q.clean_names(name, PREFIXES[name], COLUMNS[name])


UNIFIED = f"""
(select l.*, o.custkey, o.orderstatus, o.totalprice, o.orderdate, o.orderpriority,
        c.name, c.nationkey, c.acctbal, c.mktsegment, n.name as nation_name, n.regionkey, r.name as region_name
 from {plain_sql('lineitem')} l
 left join {plain_sql('orders')} o on l.orderkey = o.orderkey
 left join {plain_sql('customer')} c on o.custkey = c.custkey
 left join {plain_sql('nation')} n on c.nationkey = n.nationkey
 left join {plain_sql('region')} r on n.regionkey = r.regionkey)
"""

# ---------------------------------------------------------------- model and measures


@register(
    "summarize_region",
    f"""select region_name, {q.rnd('sum(extendedprice)', 2)} as revenue,
        {q.rnd('sum(extendedprice * discount) / sum(extendedprice)', 2)} as discount_share, cast(count(*) as bigint) as records
        from {UNIFIED} where region_name is not null group by region_name order by revenue desc limit 20""",
)
def summarize_region(spark, sf):
    measures = {
        "revenue": ms.total(F.col("extendedprice")),
        "discount_share": ms.divide(F.sum(F.col("extendedprice") * F.col("discount")), F.sum("extendedprice")),
        "records": ms.row_count(),
    }
    return pm.summarize(sales_model(spark, sf), "lineitem", [("region", "name")], measures)


@register(
    "summarize_default_count",
    f"select mktsegment, orderpriority, cast(count(*) as bigint) as \"Count\" from {UNIFIED} group by 1, 2 order by 3 desc, 1, 2 limit 20",
)
def summarize_default_count(spark, sf):
    return pm.summarize(sales_model(spark, sf), "lineitem", ["mktsegment", "orderpriority"])


@register(
    "measure_aggregates",
    f"""select {q.rnd('sum(extendedprice)', 2)} as total, {q.rnd('avg(quantity)', 6)} as average, min(discount) as least,
        max(tax) as most, count(returnflag) as values_, count(distinct mktsegment) as segments, count(*) as row_count,
        {q.rnd('sum(extendedprice) / 2 - sum(quantity) * 3', 2)} as arithmetic,
        {q.rnd('sum(quantity) / sum(discount)', 6)} as quotient, cast(-1 as double) as guarded,
        cast(null as double) as unguarded from {UNIFIED}""",
)
def measure_aggregates(spark, sf):
    col = F.col
    measures = {
        "total": F.round(ms.total(col("extendedprice")), 2),
        "average": F.round(ms.average(col("quantity")), 6),
        "least": ms.minimum(col("discount")),
        "most": ms.maximum(col("tax")),
        "values_": ms.count(col("returnflag")),
        "segments": ms.distinct_count(col("mktsegment")),
        "row_count": ms.row_count(),
        "arithmetic": F.round(ms.total(col("extendedprice")) / 2 - ms.total(col("quantity")) * 3, 2),
        "quotient": F.round(ms.ratio(ms.total(col("quantity")), ms.total(col("discount"))), 6),
        "guarded": ms.divide(ms.total(col("quantity")), ms.total(col("quantity")) * 0, -1),
        "unguarded": ms.ratio(ms.total(col("quantity")), ms.total(col("quantity")) * 0),
    }
    return pm.evaluate(sales_model(spark, sf), measures, "lineitem")


@register(
    "calculate_filter",
    f"""select nation_name, {q.rnd("coalesce(sum(extendedprice) filter (where lower(mktsegment) = 'building'), 0)", 2)} as building,
        {q.rnd("coalesce(sum(extendedprice) filter (where lower(mktsegment) = 'building' and quantity > 25), 0)", 2)} as large_building,
        count(*) filter (where orderstatus in ('O', 'P')) as open_lines
        from {UNIFIED} group by 1 order by 2 desc, 1 limit 20""",
)
def calculate_filter(spark, sf):
    model = sales_model(spark, sf)
    unified = unify(model, "lineitem")
    building = ex.predicate(unified, "mktsegment", "=", "Building")
    measures = {
        "building": ms.calculate(ms.total, F.col("extendedprice"), building),
        "large_building": ms.calculate(ms.total, F.col("extendedprice"), building, ex.predicate(unified, "quantity", ">", 25)),
        "open_lines": ms.calculate(ms.count, F.col("orderstatus"), ex.predicate(unified, "orderstatus", "in", ["o", "p"])),
    }
    return pm.summarize(model, "lineitem", [("nation", "name")], measures)


@register(
    "unify_rows",
    f"""select count(*) as row_count, count(custkey) as with_order, count(region_name) as with_region,
        cast(sum(custkey) as bigint) as custkeys, {q.rnd('sum(acctbal)', 2)} as balances from {UNIFIED}""",
)
def unify_rows(spark, sf):
    return unify(sales_model(spark, sf), "lineitem").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("custkey").alias("with_order"),
        F.count("region_name").alias("with_region"), F.sum("custkey").alias("custkeys"),
        F.round(F.sum("acctbal"), 2).alias("balances"),
    )


@register(
    "unify_backwards",
    f"""select o.orderkey, o.orderstatus, l.partkey, l.suppkey, l.linenumber, l.quantity, l.extendedprice
        from {plain_sql('orders')} o left join (
          select *, row_number() over (partition by orderkey order by partkey, suppkey, linenumber, quantity, extendedprice,
                    discount, tax, returnflag, linestatus, shipdate) as place from {plain_sql('lineitem')}) l
        on o.orderkey = l.orderkey and l.place = 1""",
)
def unify_backwards(spark, sf):
    model = sales_model(spark, sf, ("lineitem", "orders"))
    return unify(model, "orders").select(
        "orderkey", "orderstatus", "partkey", "suppkey", "linenumber", "quantity", "extendedprice"
    )


@register(
    "unify_same_key",
    """select count(*) as row_count, count(n_name) as with_nation, cast(sum(n_regionkey) as bigint) as regions, cast(sum(c_nationkey) as bigint) as customer_nations
       from lineitem left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey
       left join orders on l_orderkey = o_orderkey left join customer on o_custkey = c_custkey""",
)
def unify_same_key(spark, sf):
    """Two tables hold nationkey; only the supplier's leads to the nation. Names differ in the case of letters only, too."""
    model = model_of((n, plain(spark, sf, n)) for n in ("lineitem", "orders", "customer", "supplier"))
    model.add("nation", plain(spark, sf, "nation").withColumnRenamed("name", "Name"))
    for edge in (("lineitem", "orderkey", "orders", "orderkey"), ("orders", "custkey", "customer", "custkey"), ("lineitem", "suppkey", "supplier", "suppkey"), ("supplier", "nationkey", "nation", "nationkey")):
        model.relate(*edge)
    unified, places = unify_named(model, "lineitem")
    at = lambda t, c: F.col(places[t, c])
    return unified.agg(
        F.count(F.lit(1)).alias("row_count"), F.count(at("nation", "Name")).alias("with_nation"),
        F.sum(at("nation", "regionkey")).cast("bigint").alias("regions"), F.sum(at("customer", "nationkey")).cast("bigint").alias("customer_nations"),
    )


@register(
    "key_normalization",
    """select count(*) as row_count, count(c_name) as matched, cast(sum(c_custkey) as bigint) as keys from (
         select o_orderkey, case when o_custkey % 10 = 0 then null else o_custkey end as k from orders) o
       left join (select c_custkey, c_name from customer) c on o.k = c.c_custkey""",
)
def key_normalization(spark, sf):
    key = F.col("o_custkey")
    text = F.when(key % 10 == 0, F.lit(" ")).when(key % 3 == 0, F.concat(F.lit(" "), key.cast("string"), F.lit(".0"))).otherwise(key.cast("string"))
    orders = table(spark, sf, "orders").select("o_orderkey", text.alias("customer_id"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_custkey", "c_name")
    model = Model().add("Orders", orders).add("Customers", customers)
    model.relate("Orders", "customer_id", "Customers", "id")
    return unify(model, "Orders").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("c_name").alias("matched"), F.sum("c_custkey").alias("keys")
    )


ALL_TABLES = ("lineitem", "orders", "customer", "nation", "region", "supplier", "part")


def _discovery_sql() -> str:
    pairs = []
    names = {t: [c[2:] for c in COLUMNS[t]] for t in ALL_TABLES}
    for t1 in ALL_TABLES:
        for t2 in ALL_TABLES:
            if t1 != t2:
                pairs += [(t1, c, t2) for c in names[t1] if c in names[t2] and c.endswith("key")]
    parts = []
    for i, (t1, c, t2) in enumerate(pairs):
        a, b = f"(select distinct {PREFIXES[t1]}{c} as k from {t1})", f"(select distinct {PREFIXES[t2]}{c} as k from {t2})"
        parts.append(
            f"select {i} as i, '{t1}' as from_table, '{c}' as from_col, '{t2}' as to_table, (select count(*) from {t2}) as n2,"
            f" (select count(*) from {a}) as d1, (select count(*) from {b}) as d2,"
            f" (select count(*) from {a} x join {b} y on x.k = y.k) as both_"
        )
    return f"""with pairs as ({q.union(parts)}), good as (
      select * from pairs where d2 / n2 >= 0.4 and both_ / least(d1, d2) >= 0.15)
    select from_table, from_col, to_table, from_col as to_col,
      case when d2 = n2 then 'many_to_one' else 'many_to_many' end as cardinality,
      {q.rnd('both_ / least(d1, d2)', 2)} as overlap_ratio, 2 as match_priority
    from good g where not exists (select 1 from good e where e.i < g.i and e.from_table = g.to_table
      and e.to_table = g.from_table and e.from_col = g.from_col)"""


@register("fk_discovery", _discovery_sql())
def fk_discovery(spark, sf):
    return discover(model_of((n, plain(spark, sf, n)) for n in ALL_TABLES))


SMALL = ("customer", "nation", "region", "supplier", "orders")
TYPE_NAMES = {"name": "STRING", "acctbal": "DECIMAL", "mktsegment": "STRING", "orderstatus": "STRING",
              "totalprice": "DECIMAL", "orderdate": "DATETIME", "orderpriority": "STRING"}


def _schema_sql() -> str:
    foreign = {("customer", "nationkey"), ("nation", "regionkey"), ("supplier", "nationkey"), ("orders", "custkey")}
    primary = {("nation", "nationkey"), ("region", "regionkey"), ("customer", "custkey")}
    parts = []
    for t in SMALL:
        for c in COLUMNS[t]:
            short = c[2:]
            parts.append(
                f"select '{t}' as table_name, '{short}' as column_name, '{TYPE_NAMES.get(short, 'INTEGER')}' as type,"
                f" {(t, short) in foreign} as is_fk, {(t, short) in primary} as is_pk, count(*) - count({c}) as null_count,"
                f" count(*) as total_rows, {len(COLUMNS[t])} as total_cols from {t}"
            )
    return q.union(parts)


@register("schema_summary", _schema_sql())
def schema_summary_query(spark, sf):
    return schema_summary(sales_model(spark, sf, SMALL))


def _dictionary_sql() -> str:
    types = {"regionkey": "int", "nationkey": "int", "name": "string", "custkey": "bigint", "suppkey": "bigint",
             "acctbal": "double", "mktsegment": "string"}
    return q.union([
        f"select '{t}' as table_name, '{c}' as column_name, '{types[c[2:]]}' as data_type, count({c}) as non_null_count,"
        f" count(*) - count({c}) as null_count, cast(min({c}) as varchar) as sample_value from {t}"
        for t in ("customer", "nation", "region", "supplier") for c in COLUMNS[t]
    ])


@register("data_dictionary", _dictionary_sql())
def data_dictionary_query(spark, sf):
    return data_dictionary(model_of((n, table(spark, sf, n)) for n in ("customer", "nation", "region", "supplier")))


def _auto_sql() -> str:
    parts = []
    for c in ("linenumber", "quantity", "extendedprice", "discount"):
        money = "'$' || " if "price" in c else ""
        for f, label in (("sum", "Total"), ("avg", "Average")):
            value = q.rnd(f"{f}(l_{c})", 6)
            parts.append(
                f"select '{f}_{c}' as id, '{label} {c.title()}' as name, 'Core Aggregation' as category, {value} as value,"
                f" {money}format('{{:,.2f}}', {q.rnd(value, 2)}) as formatted from lineitem"
            )
    parts.append(
        "select 'count_records' as id, 'Total lineitem Volume' as name, 'Volume' as category, cast(count(*) as double) as value,"
        " format('{:,}', count(*)) || ' Records' as formatted from lineitem"
    )
    return q.union(parts)


@register("auto_measures", _auto_sql())
def auto_measures(spark, sf):
    return pm.auto_measures(sales_model(spark, sf)).withColumn("value", F.round("value", 6))


@register(
    "auto_ratios",
    f"""select 'profit_margin' as id, {q.rnd('sum(o_totalprice * 0.25) / sum(o_totalprice)', 6)} as value from orders
        union all select 'cost_ratio', {q.rnd('sum(o_totalprice * 0.75) / sum(o_totalprice)', 6)} from orders""",
)
def auto_ratios(spark, sf):
    price = F.col("o_totalprice")
    orders = table(spark, sf, "orders").select(
        price.alias("sales"), (price * 0.25).alias("profit"), (price * 0.75).alias("cost")
    )
    found = pm.auto_measures(Model().add("orders", orders))
    return found.filter(F.col("category") == "Financial Ratio").select("id", F.round("value", 6).alias("value"))


def _breakdown_sql() -> str:
    dims = [("orders", "orderstatus"), ("orders", "orderpriority"), ("customer", "mktsegment"),
            ("nation", "nation_name")]
    totals = q.union([
        f"select '{t}' as dimension_table, '{c.removeprefix(t + '_')}' as dimension, {c} as segment,"
        f" cast(sum(linenumber) as double) as total from {UNIFIED} where {c} is not null group by {c}"
        for t, c in dims
    ])
    return f"select * from ({totals}) qualify row_number() over (partition by dimension_table, dimension order by total desc, segment) <= 20"


@register("auto_breakdowns", _breakdown_sql())
def auto_breakdowns(spark, sf):
    return pm.auto_breakdowns(sales_model(spark, sf))


# ---------------------------------------------------------------- columns


@register(
    "column_roles",
    q.union([
        f"select '{c}' as \"column\", '{kind}' as kind, {key} as is_key, {metric} as is_metric, {dim} as is_dimension"
        for c, kind, key, metric, dim in (
            [(c, "numeric", False, True, False) for c in COLUMNS["lineitem"][:8]]
            + [(c, "categorical", False, False, True) for c in ("l_returnflag", "l_linestatus")]
            + [("l_shipdate", "datetime", False, False, False)]
        )
    ]),
)
def column_roles(spark, sf):
    return co.column_roles(table(spark, sf, "lineitem"))


@register("narrow_integers", "select cast(o_orderkey as integer) as o_orderkey, cast(o_custkey as integer) as o_custkey, o_totalprice from orders")
def narrow_integers(spark, sf):
    return co.narrow_integers(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"))


@register("standardize_names", f"select order_id, trim(status) as ship_status, count(*) as n from ({q.DIRTY}) group by 1, 2")
def standardize_names(spark, sf):
    df = dirty(spark, sf).select(F.col("order_id").alias(" Order ID "), F.col("status").alias("Ship Status"))
    return co.standardize_names(co.trim_names(df)).groupBy("order_id", "ship_status").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- audit

DIRTY_KINDS = {
    "order_id": "string", "line_number": "int", "ship_date": "datetime", "status": "string", "quantity": "number",
    "price": "number", "discount_rate": "number", "reading": "string", "tax": "double",
}


def _audit_columns_sql() -> str:
    parts = []
    for c, kind in DIRTY_KINDS.items():
        text = kind not in ("int", "double")
        value = q.num(c) if kind == "number" else f"cast({c} as double)"
        detected = {"number": "dirty_numeric", "int": "numeric", "double": "numeric"}.get(kind, kind)
        missing = f"count(*) - count({c})" + (f" + count(*) filter (where {q.token(c)})" if text else "")
        outliers = "cast(0 as bigint)"
        if kind in ("number", "int", "double"):
            outliers = (
                f"(select count(*) from (select {value} as v, quantile_cont({value}, 0.25) over () as q1,"
                f" quantile_cont({value}, 0.75) over () as q3 from dirty)"
                " where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1))"
            )
        casing = f"count(distinct {c}) - count(distinct lower({q.trim(c)}))" if kind == "string" else "cast(0 as bigint)"
        parts.append(
            f"select '{c}' as \"column\", '{detected}' as detected_type, '{'string' if text else kind}' as raw_type,"
            f" {missing} as missing_count, {q.rnd(f'({missing}) * 100.0 / count(*)', 2)} as missing_pct,"
            f" count(distinct {c}) as unique_count, {outliers} as outlier_count, {kind == 'number'} as is_dirty_numeric,"
            f" {kind == 'datetime'} as is_dirty_datetime, {casing} as casing_variations from dirty"
        )
    return f"with dirty as ({q.DIRTY})\n" + q.union(parts)


AUDIT_COLUMNS = _audit_columns_sql()


@register("audit_columns", AUDIT_COLUMNS)
def audit_columns(spark, sf):
    return au.audit(dirty(spark, sf)).columns_frame()


@register("audit_columns_by_row", AUDIT_COLUMNS)
def audit_columns_by_row(spark, sf):
    """The same audit with prices, which hardly repeat, kept out of the value distribution."""
    return au.audit(dirty(spark, sf), bound=1000).columns_frame()


def _table_sql(columns: str, rows: str) -> str:
    """The table-level record from a column audit and a relation of raw rows."""
    return f"""
    select {q.rnd('greatest(5.0, least(100.0, round(cast(100 - 40.0 * missing_cells / total_cells - 20.0 * duplicate_rows / total_rows - 25.0 * dirty_type_cols / total_cols - 15.0 * total_outliers / total_cells as decimal(38,12)), 1)))', 1)} as health_score,
      total_rows, cast(total_cols as bigint) as total_cols, cast(total_cells as bigint) as total_cells, cast(duplicate_rows as bigint) as duplicate_rows,
      {q.rnd('duplicate_rows * 100.0 / total_rows', 2)} as duplicate_pct, missing_cells,
      {q.rnd('missing_cells * 100.0 / total_cells', 2)} as missing_cell_pct, total_outliers, dirty_type_cols, casing_anomaly_cols
    from (select (select count(*) from ({rows})) as total_rows, (select count(*) from ({rows})) - (select count(*) from (select distinct * from ({rows}))) as duplicate_rows,
      count(*) as total_cols, count(*) * (select count(*) from ({rows})) as total_cells, cast(sum(missing_count) as bigint) as missing_cells,
      cast(sum(outlier_count) as bigint) as total_outliers, count(*) filter (where is_dirty_numeric or is_dirty_datetime) as dirty_type_cols,
      count(*) filter (where casing_variations > 0) as casing_anomaly_cols from ({columns}))"""


AUDIT_TABLE = _table_sql(AUDIT_COLUMNS, q.DIRTY)


@register("audit_table", AUDIT_TABLE)
def audit_table(spark, sf):
    return au.audit(dirty(spark, sf)).table_frame()


@register(
    "alerts",
    f"""select rule, level from (select 'Health Score Critical' as rule, 'danger' as level, health_score < 85 as hit from ({AUDIT_TABLE})
        union all select 'High Outlier Density', 'warning', total_outliers > 50 from ({AUDIT_TABLE})
        union all select 'High Imputation Count', 'info', missing_cells > 100 from ({AUDIT_TABLE})) where hit""",
)
def alerts(spark, sf):
    return au.alerts(au.audit(dirty(spark, sf)).table_frame()).select("rule", "level")


@register(
    "duplicate_rows",
    f"select (select count(*) from ({q.DIRTY})) - (select count(*) from (select distinct * from ({q.DIRTY}))) as duplicates",
)
def duplicate_rows(spark, sf):
    return spark.createDataFrame([(di.duplicate_rows(dirty(spark, sf)),)], "duplicates bigint")


@register(
    "value_distribution",
    f"""with dirty as ({q.DIRTY}) """ + q.union([
        f"select '{c}' as \"column\", cast({c} as varchar) as value, count(*) as count from dirty where {c} is not null group by {c}"
        for c in ("status", "line_number", "ship_date", "quantity")
    ]),
)
def value_distribution(spark, sf):
    found = ds.distribution(dirty(spark, sf).select("status", "line_number", "ship_date", "quantity"))
    value = F.coalesce("text", F.col("whole").cast("string"))
    return found.filter(F.col("column") != ds.ROWS).select("column", value.alias("value"), "count")


# ---------------------------------------------------------------- cleaning


@register("clean_deduplicate", f"select distinct * from ({q.DIRTY})")
def clean_deduplicate(spark, sf):
    return cl.deduplicate(dirty(spark, sf))


@register(
    "clean_null_tokens",
    f"select order_id, line_number, {', '.join(f'{q.no_token(c)} as {c}' for c in ('ship_date', 'status', 'quantity', 'price', 'discount_rate'))} from ({q.DIRTY})",
)
def clean_null_tokens(spark, sf):
    return cl.standardize_nulls(dirty(spark, sf)).drop("reading", "tax")


@register(
    "clean_composite",
    rf"""select order_id, reading, try_cast(regexp_extract(reading, '([0-9]{{2,3}})\s*/\s*([0-9]{{2,3}})', 1) as integer) as "reading_Systolic",
         try_cast(regexp_extract(reading, '([0-9]{{2,3}})\s*/\s*([0-9]{{2,3}})', 2) as integer) as "reading_Diastolic" from ({q.DIRTY})""",
)
def clean_composite(spark, sf):
    return dirty(spark, sf).select("order_id", "reading", *cl.split_composite(F.col("reading"), "reading"))


@register(
    "clean_numbers",
    f"select order_id, line_number, {q.num('quantity')} as quantity, {q.num('price')} as price, {q.num('discount_rate')} as discount_rate from ({q.DIRTY})",
)
def clean_numbers(spark, sf):
    df = dirty(spark, sf)
    return df.select("order_id", "line_number", *[tx.to_number(F.col(c)).alias(c) for c in ("quantity", "price", "discount_rate")])


@register(
    "clean_percent_as_fraction",
    f"select order_id, line_number, case when discount_rate like '%\\%%' escape '\\' then {q.num('discount_rate')} / 100 else {q.num('discount_rate')} end as discount_rate from ({q.DIRTY})",
)
def clean_percent_as_fraction(spark, sf):
    return dirty(spark, sf).select("order_id", "line_number", tx.to_number(F.col("discount_rate"), True).alias("discount_rate"))


_WEEKEND = "coalesce(cast(isodow(d) in (6, 7) as integer), 0)"


@register(
    "clean_dates",
    f"""select order_id, d as ship_date, cast(year(d) as integer) as "ship_date_Year", cast(month(d) as integer) as "ship_date_Month",
        dayname(d) as "ship_date_DayOfWeek", {_WEEKEND} as "ship_date_IsWeekend" from (select order_id, {q.ts('ship_date')} as d from ({q.DIRTY}))""",
)
def clean_dates(spark, sf):
    df = dirty(spark, sf).select("order_id", tx.to_timestamp(F.col("ship_date")).alias("ship_date"))
    return df.withColumns(cl.temporal_features("ship_date"))


@register(
    "clean_text",
    f"select order_id, {q.no_token(q.title(q.spaced(q.no_token('status'))))} as status from ({q.DIRTY})",
)
def clean_text(spark, sf):
    status = cl.normalize_text(tx.without_null_tokens(F.col("status")), True)
    return dirty(spark, sf).select("order_id", status.alias("status"))


_TYPED = f"(select order_id, line_number, {q.num('quantity')} as quantity, {q.num('price')} as price, tax from ({q.DIRTY}))"


def _typed(spark, sf) -> DataFrame:
    return dirty(spark, sf).select(
        "order_id", "line_number", tx.to_number(F.col("quantity")).alias("quantity"),
        tx.to_number(F.col("price")).alias("price"), "tax",
    )


def _bounds_sql(c: str, low: str, high: str) -> str:
    """Clip a column where it has outliers; ``s`` holds its quantiles and outlier count."""
    return f"case when s.{c}_out > 0 and {c} is not null then least(greatest({c}, {low}), {high}) else {c} end"


def _stats_sql(columns: list[str], source: str) -> str:
    quant = ", ".join(
        f"quantile_cont({c}, {p}) as {c}_{name}" for c in columns
        for name, p in (("p01", 0.01), ("q1", 0.25), ("q2", 0.5), ("q3", 0.75), ("p99", 0.99))
    )
    outs = ", ".join(
        f"count(*) filter (where {c}_q3 > {c}_q1 and ({c} < {c}_q1 - 2.5 * ({c}_q3 - {c}_q1) or {c} > {c}_q3 + 2.5 * ({c}_q3 - {c}_q1))) as {c}_out"
        for c in columns
    )
    return f"(select any_value(columns(s.*)), {outs} from {source} t cross join (select {quant} from {source}) s)"


@register(
    "clean_winsorize",
    f"""with t as {_TYPED}, s as {_stats_sql(['quantity', 'price', 'tax'], 't')}
        select order_id, line_number, {', '.join(f"{_bounds_sql(c, f's.{c}_p01', f's.{c}_p99')} as {c}" for c in ('quantity', 'price', 'tax'))} from t cross join s""",
)
def clean_winsorize(spark, sf):
    df = _typed(spark, sf)
    found = cl.find_outliers(stage(ds.read_values(df)), ["quantity", "price", "tax"], "winsorize")
    return cl.clip_outliers(df, found.clips)


@register(
    "clean_clip_iqr",
    f"""with t as {_TYPED}, s as {_stats_sql(['quantity', 'price', 'tax'], 't')}
        select order_id, line_number, {', '.join(f"{q.rnd(_bounds_sql(c, f's.{c}_q1 - 2.5 * (s.{c}_q3 - s.{c}_q1)', f's.{c}_q3 + 2.5 * (s.{c}_q3 - s.{c}_q1)'), 9)} as {c}" for c in ('quantity', 'price', 'tax'))} from t cross join s""",
)
def clean_clip_iqr(spark, sf):
    df = _typed(spark, sf)
    found = cl.find_outliers(stage(ds.read_values(df)), ["quantity", "price", "tax"], "clip_iqr")
    return cl.clip_outliers(df, found.clips).withColumns({c: F.round(c, 9) for c in ("quantity", "price", "tax")})


def _impute(strategy):
    def run(spark, sf):
        df = _typed(spark, sf)
        values = stage(ds.read_values(df))
        fills, _ = cl.numeric_fills(values, ["line_number", "quantity", "price", "tax"], ds.total_rows(values), strategy)
        return cl.fill_missing(df, fills)

    return run


for _strategy, _fill in (("median", "quantile_cont({c}, 0.5)"), ("mean", q.rnd("avg({c})", 2)), ("zero", "max(cast(0 as double))")):
    register(
        f"clean_impute_{_strategy}",
        f"with t as materialized (select * from {_TYPED}), f as materialized (select "
        + ", ".join(f"{_fill.format(c=c)} as {c}" for c in ("quantity", "price", "tax"))
        + " from t) select order_id, line_number, "
        + ", ".join(f"coalesce(t.{c}, f.{c}) as {c}" for c in ("quantity", "price", "tax"))
        + " from t, f",
    )(_impute(_strategy))


@register(
    "clean_impute_sparse",
    """select o_orderkey, coalesce(case when o_custkey % 2 = 0 then o_totalprice end, 0.0) as refund_amount,
       case when o_custkey % 2 = 0 then o_totalprice end as bonus, case when o_custkey % 9 > 0 then cast(o_custkey as double) end as partner_id from orders""",
)
def clean_impute_sparse(spark, sf):
    even = F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice"))
    df = table(spark, sf, "orders").select(
        "o_orderkey", even.alias("refund_amount"), even.alias("bonus"),
        F.when(F.col("o_custkey") % 9 > 0, F.col("o_custkey").cast("double")).alias("partner_id"),
    )
    values = stage(ds.read_values(df))
    fills, _ = cl.numeric_fills(values, ["refund_amount", "bonus", "partner_id"], ds.total_rows(values))
    return cl.fill_missing(df, fills)


_STATUS = f"(select order_id, {q.no_token('status')} as status from ({q.DIRTY}))"


@register(
    "clean_impute_mode",
    f"with t as {_STATUS} select order_id, coalesce(status, (select status from t where status is not null group by status order by count(*) desc, status limit 1)) as status from t",
)
def clean_impute_mode(spark, sf):
    df = cl.standardize_nulls(dirty(spark, sf).select("order_id", "status"))
    values = stage(ds.read_values(df))
    fills, _ = cl.categorical_fills(values, ["order_id", "status"], ds.total_rows(values))
    return cl.fill_missing(df, fills)


@register("clean_impute_unknown", f"with t as {_STATUS} select order_id, coalesce(status, 'Unknown') as status from t")
def clean_impute_unknown(spark, sf):
    df = cl.standardize_nulls(dirty(spark, sf).select("order_id", "status"))
    values = stage(ds.read_values(df))
    fills, _ = cl.categorical_fills(values, ["order_id", "status"], ds.total_rows(values), "unknown")
    return cl.fill_missing(df, fills)


def _clean_sql() -> str:
    """The whole cleaning of the messy view; every decision that depends on the data is in the SQL."""
    typed = f"""select {q.spaced('order_id')} as order_id, cast(line_number as double) as line_number, d as ship_date,
        {q.no_token(q.title(q.spaced(q.no_token('status'))))} as status, {q.num(q.no_token('quantity'))} as quantity,
        {q.num(q.no_token('price'))} as price, {q.num(q.no_token('discount_rate'))} as discount_rate, tax,
        cast(regexp_extract(reading, '([0-9]+)/([0-9]+)', 1) as double) as systolic, cast(regexp_extract(reading, '([0-9]+)/([0-9]+)', 2) as double) as diastolic,
        cast(year(d) as double) as y, cast(month(d) as double) as m, dayname(d) as dow, {_WEEKEND} as weekend
        from (select *, {q.ts(q.no_token('ship_date'))} as d from (select distinct * from ({q.DIRTY})))"""
    clipped = ["line_number", "quantity", "price", "discount_rate", "tax", "systolic", "diastolic", "m"]
    value = {c: _bounds_sql(c, f"s.{c}_p01", f"s.{c}_p99") for c in clipped}
    filled = {c: f"coalesce({value[c]}, s.{c}_q2)" for c in clipped}
    mode = lambda c: f"coalesce({c}, (select {c} from t where {c} is not null group by {c} order by count(*) desc, {c} limit 1))"
    return f"""with t as ({typed}), s as {_stats_sql([*clipped, 'y'], 't')}
      select order_id, cast({filled['line_number']} as integer) as line_number, ship_date, {mode('status')} as status,
        {filled['quantity']} as quantity, {filled['price']} as price, {filled['discount_rate']} as discount_rate, {filled['tax']} as tax,
        cast({filled['systolic']} as integer) as "reading_Systolic", cast({filled['diastolic']} as integer) as "reading_Diastolic",
        coalesce(y, s.y_q2) as "ship_date_Year", {filled['m']} as "ship_date_Month", {mode('dow')} as "ship_date_DayOfWeek",
        weekend as "ship_date_IsWeekend" from t cross join s"""


@register("clean_all_steps", _clean_sql())
def clean_all_steps(spark, sf):
    return cl.clean(dirty(spark, sf))[0]


@register("clean_all_steps_by_row", _clean_sql())
def clean_all_steps_by_row(spark, sf):
    """The same cleaning with prices, which hardly repeat, kept out of the value distribution."""
    plan, base = cl.fit(dirty(spark, sf), bound=1000)
    return stage(plan.apply(base), "cleaned")


@register(
    "clean_log",
    f"""with d as (select distinct * from ({q.DIRTY})) """
    + q.union(
        [f"select 'deduplicate' as step, cast(null as varchar) as \"column\", (select count(*) from ({q.DIRTY})) - count(*) as affected from d"]
        + [f"select 'null_tokens', '{c}', count(*) filter (where {q.token(c)}) from d" for c in ("ship_date", "status", "quantity", "price", "discount_rate")]
        + [f"select 'number', '{c}', count({q.num(q.no_token(c))}) from d" for c in ("quantity", "price", "discount_rate")]
        + [f"select 'date', 'ship_date', count({q.ts(q.no_token('ship_date'))}) from d", "select 'composite', 'reading', count(reading) from d"]
    ),
)
def clean_log(spark, sf):
    plan, _ = cl.fit(dirty(spark, sf))
    log = plan.log_frame(spark).filter(F.col("step").isin("deduplicate", "null_tokens", "number", "date", "composite"))
    return log.select("step", "column", "affected")


@register(
    "before_after",
    f"""with b as ({AUDIT_TABLE}), c as ({_clean_sql()})
        select b.health_score as initial_health_score, b.total_rows as initial_total_rows, (select count(*) from c) as cleaned_total_rows,
          b.missing_cells as initial_missing_cells, (select count(*) filter (where ship_date is null) from c) as cleaned_missing_cells,
          b.missing_cells - (select count(*) filter (where ship_date is null) from c) as missing_cells_handled,
          b.duplicate_rows as initial_duplicate_rows, (select count(*) from c) - (select count(*) from (select distinct * from c)) as cleaned_duplicate_rows from b""",
)
def before_after(spark, sf):
    report = analysis.clean_with_report(dirty(spark, sf))
    return report.comparison.select(
        "initial_health_score", "initial_total_rows", "cleaned_total_rows", "initial_missing_cells", "cleaned_missing_cells",
        "missing_cells_handled", "initial_duplicate_rows", "cleaned_duplicate_rows",
    )


# ---------------------------------------------------------------- profile

MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _profile_sql() -> str:
    parts = []
    for c in ("l_linenumber", "l_quantity", "l_discount", "l_tax"):
        v = f"cast({c} as double)"
        two = lambda e: q.rnd(e, 2)
        parts.append(
            f"select '{c}' as \"column\", count({c}) as count, count(*) - count({c}) as missing, {two(f'avg({v})')} as mean, {two(f'median({v})')} as median,"
            f" {two(f'stddev_samp({v})')} as std, {two(f'var_samp({v})')} as variance, {two(f'min({v})')} as min, {two(f'quantile_cont({v}, 0.25)')} as q25,"
            f" {two(f'quantile_cont({v}, 0.75)')} as q75, {two(f'max({v})')} as max, {two(f'quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)')} as iqr,"
            f" {q.rnd(f'skewness({v})', 3)} as skewness, {q.rnd(f'kurtosis({v})', 3)} as kurtosis,"
            f" case when abs(skewness({v})) > 1 then case when skewness({v}) > 0 then 'Highly Skewed (Right/Positive)' else 'Highly Skewed (Left/Negative)' end"
            f" when abs(skewness({v})) > 0.5 then 'Moderately Skewed' else 'Normal / Symmetrical' end as shape from lineitem"
        )
    return q.union(parts)


@register("numeric_profile", _profile_sql())
def numeric_profile(spark, sf):
    df = pr.numeric_profile(table(spark, sf, "lineitem"), ["l_linenumber", "l_quantity", "l_discount", "l_tax"])
    return df.withColumns({c: F.col(c) + 0.0 for c in ("skewness", "kurtosis")})


def _histogram_sql(c: str, source: str, k: str) -> str:
    return (
        f"select '{c}' as \"column\", cast(b as integer) as bin, {q.rnd('lo + (hi - lo) * b / k', 6)} as low, {q.rnd('lo + (hi - lo) * (b + 1) / k', 6)} as high,"
        f" (select count(*) from {source} where least(cast(floor((cast({c} as double) - lo) * k / (hi - lo)) as bigint), k - 1) = b) as count"
        f" from (select cast(min({c}) as double) as lo, cast(max({c}) as double) as hi, {k} as k, unnest(range({k})) as b from {source})"
    )


@register("histogram", q.union([_histogram_sql(c, "lineitem", "cast(least(20, greatest(6, floor(sqrt(count(*))))) as bigint)") for c in MEASURED]))
def histogram(spark, sf):
    found = pr.histogram(table(spark, sf, "lineitem"), MEASURED)
    return found.select("column", "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@register("histogram_fixed_bins", _histogram_sql("o_totalprice", "orders", "cast(12 as bigint)").replace("unnest(range(cast(12 as bigint)))", "unnest(range(12))"))
def histogram_fixed_bins(spark, sf):
    found = pr.histogram(table(spark, sf, "orders"), ["o_totalprice"], 12)
    return found.select("column", "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@register(
    "histogram_summary",
    f"""select 'o_totalprice' as metric, count(*) as records, {q.rnd('avg(o_totalprice)', 2)} as mean, {q.rnd('median(o_totalprice)', 2)} as median,
        (select cast(b as integer) from (select least(cast(floor((o_totalprice - lo) * 12 / (hi - lo)) as bigint), 11) as b, count(*) as n
          from orders cross join (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders) group by 1) order by n desc, b limit 1) as peak_bin from orders""",
)
def histogram_summary(spark, sf):
    return pr.histogram_summary(table(spark, sf, "orders"), "o_totalprice").drop("peak_label")


def _frequency_sql(columns: list[str], source: str) -> str:
    return q.union([
        f"""(with c as (select {c} as category, count(*) as count, row_number() over (order by count(*) desc, {c}) as rank from {source} where {c} is not null group by {c}),
           p as (select *, {q.rnd(f'count * 100.0 / (select count({c}) from {source})', 1)} as percentage from c where rank <= 10)
           select '{c}' as "column", cast(rank as integer) as rank, category, count, percentage, {q.rnd('sum(percentage) over (order by rank)', 1)} as cumulative_pct from p)"""
        for c in columns
    ])


@register("frequencies", _frequency_sql(["p_name", "p_brand", "p_type"], "part"))
def frequencies(spark, sf):
    return pr.frequencies(table(spark, sf, "part"))


@register(
    "category_summary",
    f"with d as (select {q.no_token('status')} as status, order_id from ({q.DIRTY})) " + q.union([
        f"select '{c}' as \"column\", count(distinct {c}) as unique_count, count(*) - count({c}) as missing,"
        f" (select {c} from d where {c} is not null group by {c} order by count(*) desc, {c} limit 1) as top_category,"
        f" (select count(*) as n from d where {c} is not null group by {c} order by n desc limit 1) as top_category_count from d"
        for c in ("status", "order_id")
    ]),
)
def category_summary(spark, sf):
    return pr.category_summary(cl.standardize_nulls(dirty(spark, sf).select("status", "order_id")))


def _matrix_sql(value: Callable[[str], str], source: str) -> str:
    return q.union([
        f"select '{a}' as feature_a, '{b}' as feature_b, " + ("cast(1 as double)" if a == b else q.rnd(f"corr({value(a)}, {value(b)})", 3)) + f" as r from {source}"
        for a in MEASURED for b in MEASURED
    ]).replace("cast(1 as double) as r from", "cast(1 as double) as r from (select 1) --")


_RANKED = "(select " + ", ".join(
    f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in MEASURED
) + " from lineitem)"
_PEARSON, _SPEARMAN = _matrix_sql(str, "lineitem"), f"with ranked as {_RANKED} " + _matrix_sql(str, "ranked")


@register("pearson", _PEARSON)
def pearson(spark, sf):
    return pr.correlation(table(spark, sf, "lineitem"), MEASURED).withColumn("r", F.col("r") + 0.0)


@register("spearman", _SPEARMAN)
def spearman(spark, sf):
    return pr.correlation(table(spark, sf, "lineitem"), MEASURED, "spearman").withColumn("r", F.col("r") + 0.0)


_PART = ["p_partkey", "p_size", "p_retailprice"]
_PART_RANKED = "(select " + ", ".join(
    f"{c}, rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}_rank" for c in _PART
) + " from part)"


@register(
    "top_pairs",
    f"""with r as {_PART_RANKED}, p as ({q.union([
        f"select {i} as i, {j} as j, '{a}' as feature_a, '{b}' as feature_b, {q.rnd(f'corr({a}, {b})', 3)} as pearson_r, {q.rnd(f'corr({a}_rank, {b}_rank)', 3)} as spearman_rho from r"
        for i, a in enumerate(_PART) for j, b in enumerate(_PART) if i < j])})
      select feature_a, feature_b, pearson_r, spearman_rho, case when abs(pearson_r) >= 0.7 then 'Strong' when abs(pearson_r) >= 0.4 then 'Moderate' else 'Weak' end as strength,
        case when pearson_r > 0 then 'Positive' else 'Negative' end as direction from p order by abs(pearson_r) desc, i, j limit 8""",
)
def top_pairs(spark, sf):
    return pr.top_pairs(table(spark, sf, "part"), _PART)


@register(
    "groupby_insights",
    q.union([
        f"""select * from (select '{c}' as dimension, 'l_extendedprice' as metric, {c} as segment, count(*) as count, {q.rnd('sum(l_extendedprice)', 2)} as sum,
            {q.rnd('avg(l_extendedprice)', 2)} as mean, {q.rnd('median(l_extendedprice)', 2)} as median from lineitem group by {c} order by 5 desc limit 10)"""
        for c in ("l_returnflag", "l_linestatus")
    ]),
)
def groupby_insights(spark, sf):
    return pr.groupby_insights(table(spark, sf, "lineitem"), metric="l_extendedprice")


# ---------------------------------------------------------------- exploration


def _grouped(agg):
    return lambda spark, sf: ex.grouped_metric(plain(spark, sf, "part"), "brand", "retailprice", agg)


for _agg, _f in (("mean", "avg"), ("sum", "sum"), ("count", "count"), ("median", "median"), ("max", "max"), ("min", "min")):
    register(
        f"grouped_metric_{_agg}",
        f"select p_brand as label, {q.rnd(f'{_f}(p_retailprice)', 2)} as value from part group by 1 order by 2 desc, 1 limit 16",
    )(_grouped(_agg))


@register(
    "leader_laggard",
    f"""with g as (select p_brand as label, {q.rnd('sum(p_retailprice)', 2)} as value from part group by 1 order by 2 desc, 1 limit 16)
        select (select label from g order by value desc, label desc limit 1) as leader, max(value) as leader_value,
          (select label from g order by value, label limit 1) as laggard, min(value) as laggard_value, count(*) as groups,
          {q.rnd('max(value) / (min(value) + 1e-6)', 1)} as spread from g""",
)
def leader_laggard(spark, sf):
    return ex.leader_laggard(_grouped("sum")(spark, sf))


@register("scatter_points", "select l_quantity as x, l_extendedprice as y from lineitem order by l_orderkey, l_linenumber, l_extendedprice limit 300")
def scatter_points(spark, sf):
    return ex.scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_orderkey", "l_linenumber", "l_extendedprice"])


@register("scatter_r", f"select count(*) as n, {q.rnd('corr(p_size, p_retailprice)', 6)} as r from part")
def scatter_r(spark, sf):
    return ex.scatter_correlation(table(spark, sf, "part"), "p_size", "p_retailprice").withColumn("r", F.round("r", 6))


@register("key_figures", f"select {q.rnd('sum(o_totalprice)', 2)} as total, {q.rnd('avg(o_totalprice)', 6)} as average, count(*) as records from orders")
def key_figures(spark, sf):
    return ex.key_figures(table(spark, sf, "orders"), "o_totalprice").select(
        F.round("total", 2).alias("total"), F.round("average", 6).alias("average"), "records"
    )


@register("trend_last15", f"select * from (select cast(o_orderdate as date) as date, {q.rnd('sum(o_totalprice)', 2)} as value from orders group by 1 order by 1 desc limit 15)")
def trend_last15(spark, sf):
    return ex.trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice")


def _breakdown_top(value: str, source: str, by: str, top: int) -> str:
    return f"""with b as (select {by} as category, {value} as value from {source} group by 1 order by 2 desc, 1 limit {top})
        select category, value, {q.rnd('value * 100 / sum(value) over ()', 1)} as share_pct from b"""


@register("breakdown_top6", _breakdown_top(q.rnd("sum(p_retailprice)", 2), "part", "p_brand", 6))
def breakdown_top6(spark, sf):
    return ex.breakdown(table(spark, sf, "part"), "p_brand", "p_retailprice")


@register("breakdown_counts", _breakdown_top("cast(count(*) as double)", "documents", "lang", 5))
def breakdown_counts(spark, sf):
    return ex.breakdown(table(spark, sf, "documents"), "lang", None, 5)


_COMPACT = ("case when abs(v) >= 1e6 then format('{:.1f}M', v / 1e6) when abs(v) >= 1e3 then format('{:.1f}K', v / 1e3) "
            "else format('{:.1f}', v) end")


@register("compact_numbers", f"select n, {_COMPACT} as shown from (select n_nationkey as n, cast(n_nationkey as double) * n_nationkey * n_nationkey * 137 + 7 as v from nation)")
def compact_numbers(spark, sf):
    n = F.col("n_nationkey")
    return table(spark, sf, "nation").select(n.alias("n"), tx.compact_number(n.cast("double") * n * n * 137 + 7).alias("shown"))


@register(
    "predicates",
    q.union([
        f"select '{name}' as test, count(*) as n from ({q.DIRTY}) where {condition}" for name, condition in (
            ("equals", "lower(status) = 'returned'"), ("differs", "lower(status) is distinct from 'returned'"),
            ("above", "line_number > 3"), ("below", "line_number < 3"), ("at_least", "tax >= 0.05"), ("at_most", "tax <= 0.05"),
            ("text_above", "try_cast(quantity as double) > 40"), ("in_list", "lower(status) in ('returned', 'new order')"),
        )
    ]),
)
def predicates(spark, sf):
    df = dirty(spark, sf)
    tests = {
        "equals": ("status", "=", "RETURNED"), "differs": ("status", "<>", "returned"), "above": ("line_number", ">", 3),
        "below": ("line_number", "<", 3), "at_least": ("tax", ">=", 0.05), "at_most": ("tax", "<=", 0.05),
        "text_above": ("quantity", ">", 40), "in_list": ("status", "in", ["Returned", "New Order"]),
    }
    counts = df.agg(*[F.count_if(ex.predicate(df, *t)).alias(name) for name, t in tests.items()])
    fields = [[F.lit(name), F.col(name)] for name in tests]
    return co.per_column(counts, fields, ["test", "n"])


@register("compare_filter", "select * from orders where o_totalprice >= 250000")
def compare_filter(spark, sf):
    return ex.compare(table(spark, sf, "orders"), "o_totalprice", ">=", 250000)


@register("search", "select * from customer where lower(c_name) like '%00012%' or lower(c_mktsegment) like '%00012%' or cast(c_custkey as varchar) like '%00012%' or cast(c_nationkey as varchar) like '%00012%' or cast(c_acctbal as varchar) like '%00012%'")
def search(spark, sf):
    return ex.search(table(spark, sf, "customer"), " 00012 ")


@register("search_text", "select doc_id, lang from documents where contains(lower(text), 'the') or contains(lower(source), 'the') or contains(lang, 'the')")
def search_text(spark, sf):
    return ex.search(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), "The").select("doc_id", "lang")


@register("cross_filter", "select * from part where p_type = 'ECONOMY'")
def cross_filter(spark, sf):
    return ex.cross_filter(table(spark, sf, "part"), "ECONOMY", "p_type")


@register("page", "select * from part order by p_retailprice desc, p_partkey limit 15 offset 30")
def page(spark, sf):
    return ex.page(table(spark, sf, "part"), 3, 15, "p_retailprice", False, ["p_partkey"])


@register("page_deep", "select * from orders order by o_orderdate, o_orderkey limit 3 offset (select cast(count(*) // 2 as bigint) // 3 * 3 from orders)")
def page_deep(spark, sf):
    """A page of three rows in the middle of the table."""
    orders = table(spark, sf, "orders")
    return ex.page(orders, orders.count() // 2 // 3 + 1, 3, "o_orderdate", True, ["o_orderkey"], in_task=1000)


@register("page_after", "select * from customer order by c_mktsegment desc, c_name, c_custkey limit 40 offset (select count(*) from customer where c_mktsegment > 'BUILDING') ")
def page_after(spark, sf):
    """The page of texts that follows the last customer of another segment, found by that row alone."""
    customers = table(spark, sf, "customer")
    last = customers.filter(F.col("c_mktsegment") > "BUILDING").orderBy("c_mktsegment", F.desc("c_name"), F.desc("c_custkey")).first()
    return ex.page_after(customers, last, 40, "c_mktsegment", False, ["c_name", "c_custkey"])


@register("page_info", "select count(*) as total_rows, cast(greatest(1, ceil(count(*) / 15)) as bigint) as total_pages from part")
def page_info(spark, sf):
    return ex.page_info(table(spark, sf, "part"), 15)


@register("sorted_rows", "select o_orderkey, o_totalprice from orders")
def sorted_rows(spark, sf):
    return ex.sort_rows(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", False, ["o_orderkey"])


@register(
    "display_rows",
    f"select cast(o_orderkey as varchar) as o_orderkey, cast({q.rnd('o_totalprice / 3', 2)} as varchar) as third, strftime(o_orderdate, '%Y-%m-%d') as o_orderdate from orders",
)
def display_rows(spark, sf):
    return ex.display_rows(table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 3).alias("third"), "o_orderdate"))


@register("preview", "select p_partkey, p_name, p_brand from part order by p_partkey limit 12")
def preview(spark, sf):
    return ex.preview(table(spark, sf, "part"), 12, 3, ["p_partkey"])


# ---------------------------------------------------------------- time series

_DAILY = "(select cast(ts as date) as period, avg(value) as value from events group by 1)"
_WEEKLY = "(select cast(date_trunc('week', o_orderdate) + interval 6 day as date) as period, avg(o_totalprice) as value from orders group by 1)"
_LINE = """(select count(*) as n, regr_slope(value, x) as slope, regr_intercept(value, x) as intercept, stddev_samp(value) as std, avg(value) as mean,
  max(period) as last_period from (select *, cast(row_number() over (order by period) - 1 as double) as x from {source}))"""


@register("daily_series", f"select period, {q.rnd('value', 6)} as value from {_DAILY}")
def daily_series(spark, sf):
    return fc.series(table(spark, sf, "events"), "ts", "value").withColumn("value", F.round("value", 6))


@register("weekly_series", f"select period, {q.rnd('value', 4)} as value from {_WEEKLY}")
def weekly_series(spark, sf):
    return fc.series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "week").withColumn("value", F.round("value", 4))


@register("rolling7", f"select period, {q.rnd('avg(value) over (order by period rows between 6 preceding and current row)', 6)} as rolling from {_DAILY}")
def rolling7(spark, sf):
    return fc.rolling_mean(fc.series(table(spark, sf, "events"), "ts", "value")).select("period", F.round("rolling", 6).alias("rolling"))


@register(
    "trend_fit",
    f"""select n as periods, {q.rnd('slope', 6)} as slope, {q.rnd('intercept', 4)} as intercept, case when slope > 0 then 'Upward' else 'Downward' end as direction,
        {q.rnd('slope / greatest(1e-5, abs(mean)) * 100', 2)} as growth_rate_pct from {_LINE.format(source=_WEEKLY)}""",
)
def trend_fit(spark, sf):
    weekly = fc.series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "week")
    return fc.trend_summary(weekly).withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 4)})


def _forecast_sql(source: str, days: int) -> str:
    point = q.rnd("slope * (n + step - 1) + intercept", 2)
    return f"""select cast(step as integer) as step, cast(last_period + cast(step * {days} as integer) as date) as period, {point} as value,
      {q.rnd(f'greatest(0.0, {point} - 1.28 * std)', 2)} as lower, {q.rnd(f'{point} + 1.28 * std', 2)} as upper
      from {_LINE.format(source=source)} cross join (select unnest(range(1, 15)) as step)"""


@register("forecast14", _forecast_sql(_DAILY, 1))
def forecast14(spark, sf):
    return fc.forecast(fc.series(table(spark, sf, "events"), "ts", "value", "day"), "day")


@register("forecast14_weeks", _forecast_sql(_WEEKLY, 7))
def forecast14_weeks(spark, sf):
    return fc.forecast(fc.series(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", "week"), "week")


# ---------------------------------------------------------------- learning (no SQL counterpart)

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _segmentation(spark, sf) -> segments.Segmentation:
    return segments.segment(table(spark, sf, "lineitem"), MEASURED)


@register("kmeans_silhouettes")
def kmeans_silhouettes(spark, sf):
    return _segmentation(spark, sf).scores_frame()


@register("personas")
def personas(spark, sf):
    return segments.personas(_segmentation(spark, sf))


@register("pca_projection")
def pca_projection(spark, sf):
    return segments.projection_sample(segments.projection(_segmentation(spark, sf))[0], KEY)


# Orders moved into three groups far from each other, so that the clusters are known.
_PLANTED = """(select o_orderkey, o_orderkey % 3 as grp, 10 + 40 * (o_orderkey % 3) + (o_custkey % 100) / 5.0 as spend,
  5 + 30 * ((o_orderkey % 3) * 2 % 3) + (o_orderkey % 97) / 6.0 as volume from orders)"""


def _planted(spark, sf) -> segments.Segmentation:
    group = (F.col("o_orderkey") % 3).cast("double")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        (10 + 40 * group + (F.col("o_custkey") % 100) / 5.0).alias("spend"),
        (5 + 30 * (group * 2 % 3) + (F.col("o_orderkey") % 97) / 6.0).alias("volume"),
    )
    return segments.segment(rows, ["spend", "volume"])


@register("kmeans_planted", "select o_orderkey, cast(o_orderkey % 3 as integer) as cluster from orders")
def kmeans_planted(spark, sf):
    """The sweep finds the three groups, and their order by center gives them their numbers."""
    return _planted(spark, sf).assigned.select("o_orderkey", "cluster")


@register(
    "silhouette_planted",
    f"""with s as (select avg(spend) as ms, stddev_samp(spend) as ds, avg(volume) as mv, stddev_samp(volume) as dv from {_PLANTED}),
      z as (select o_orderkey, grp, (spend - ms) / ds as x, (volume - mv) / dv as y from {_PLANTED}, s),
      c as (select grp as other, count(*) as n, sum(x * x + y * y) as sq, sum(x) as sx, sum(y) as sy from z group by grp),
      d as (select o_orderkey, grp, other, n, x * x + y * y + sq / n - 2 * (x * sx + y * sy) / n as away from z, c),
      e as (select o_orderkey, sum(case when grp = other then away * n / (n - 1) end) as a, min(case when grp <> other then away end) as b from d group by o_orderkey)
      select 3 as k, {q.rnd("avg((b - a) / greatest(a, b))", 3)} as score from e""",
)
def silhouette_planted(spark, sf):
    """Mean silhouette of the chosen number of clusters."""
    found = _planted(spark, sf)
    return found.scores_frame().filter(F.col("k") == found.k)


def _personas_sql() -> str:
    names = ("spend", "volume")
    off = {c: f"(m.{c} - w.{c}) / w.{c} * 100" for c in names}
    label = lambda c: f"case when abs({off[c]}) > 15 then case when {off[c]} > 0 then 'High ' else 'Low ' end || '{c} (' || cast({q.rnd('m.' + c, 1)} as varchar) || ')' end"
    return f"""with m as (select grp, count(*) as size, avg(spend) as spend, avg(volume) as volume from {_PLANTED} group by grp),
      w as (select count(*) as n, avg(spend) as spend, avg(volume) as volume from {_PLANTED}),
      t as (select grp, size, n, list_filter([{label('spend')}, {label('volume')}], lambda x: x is not null) as traits from m, w)
      select cast(grp as integer) as cluster_id, 'Cluster ' || grp || ': ' || case when len(traits) > 0 then array_to_string(traits, ', ') else 'Balanced Group' end as name,
        size, {q.rnd('size * 100.0 / n', 1)} as percentage, array_to_string(traits, '; ') as key_traits from t"""


@register("personas_planted", _personas_sql())
def personas_planted(spark, sf):
    return segments.personas(_planted(spark, sf)).withColumn("key_traits", F.array_join("key_traits", "; "))


@register(
    "pca_planted",
    f"""with r as (select abs(corr(spend, volume)) as r from {_PLANTED})
      select 1 as component, {q.rnd('(1 + r) * 50', 1)} as explained_pct from r union all select 2, {q.rnd('(1 - r) * 50', 1)} from r""",
)
def pca_planted(spark, sf):
    """Of two standardized features the components explain (1 + |r|) / 2 and (1 - |r|) / 2."""
    shares = segments.projection(_planted(spark, sf))[1]
    return spark.createDataFrame(list(enumerate(shares, 1)), "component int, explained_pct double")


@register(
    "projection_planted",
    f"""with s as (select avg(spend) as ms, stddev_samp(spend) as ds, avg(volume) as mv, stddev_samp(volume) as dv, sign(corr(spend, volume)) as r from {_PLANTED}),
      p as (select grp, ((spend - ms) / ds + r * (volume - mv) / dv) / sqrt(2) as x, ((spend - ms) / ds - r * (volume - mv) / dv) / sqrt(2) as y from {_PLANTED}, s)
      select cast(grp as integer) as cluster, count(*) as points, round(avg(abs(x)), 4) as far_x, round(avg(abs(y)), 4) as far_y from p group by grp""",
)
def projection_planted(spark, sf):
    """All rows on two components: distances along each, whose signs are a convention."""
    projected = segments.projection(_planted(spark, sf))[0]
    return projected.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.avg(F.abs("x")), 4).alias("far_x"), F.round(F.avg(F.abs("y")), 4).alias("far_y"))


def _standard_sql() -> str:
    z = lambda c: f"({c} - m) / s"
    return q.union([
        f"select '{c}' as feature, abs(round(avg({z(c)}), 6)) as mean, round(stddev_samp({z(c)}), 6) as std, round(min({z(c)}), 6) as low, round(max({z(c)}), 6) as high, "
        f"round(sum(abs({z(c)})) / count(*), 6) as spread from lineitem, (select avg({c}) as m, stddev_samp({c}) as s from lineitem)" for c in MEASURED
    ])


@register("feature_standardize", _standard_sql())
def feature_standardize(spark, sf):
    from pyspark.ml.functions import vector_to_array

    scaled = segments.standardized(table(spark, sf, "lineitem"), MEASURED).select(vector_to_array("scaled").alias("v"))
    figures = (("mean", F.avg), ("std", F.stddev_samp), ("low", F.min), ("high", F.max), ("spread", lambda v: F.avg(F.abs(v))))
    row = scaled.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(len(MEASURED)) for n, f in figures])
    fields = [[F.lit(c), F.abs(F.round(F.col(f"mean{i}"), 6)), *[F.round(F.col(f"{n}{i}"), 6) for n, _ in figures[1:]]] for i, c in enumerate(MEASURED)]
    return co.per_column(row, fields, ["feature", *[n for n, _ in figures]])


@register("anomalies")
def anomalies_query(spark, sf):
    return anomalies.top_anomalies(anomalies.detect_anomalies(table(spark, sf, "lineitem"), KEY, MEASURED), KEY, MEASURED)


@register("anomalies_planted", "select count(*) as planted, count(*) as flagged from lineitem where l_orderkey % 40 = 0")
def anomalies_planted(spark, sf):
    """Rows put far out of the others, one in forty: all of them must be among the 3.5 % that are flagged."""
    far = F.when(F.col("l_orderkey") % 40 == 0, 1000.0).otherwise(1.0)
    moved = table(spark, sf, "lineitem").withColumns({c: F.col(c) * far for c in MEASURED})
    detected = anomalies.detect_anomalies(moved, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], MEASURED)
    planted = F.col("l_orderkey") % 40 == 0
    return detected.agg(F.count_if(planted).alias("planted"), F.count_if(planted & F.col("is_anomaly")).alias("flagged"))


@register("anomaly_summary", f"select cast(floor(count(*) * 0.035) as bigint) as total_anomalies, {q.rnd('floor(count(*) * 0.035) * 100 / count(*)', 2)} as anomaly_pct from lineitem")
def anomaly_summary(spark, sf):
    return anomalies.anomaly_summary(anomalies.detect_anomalies(table(spark, sf, "lineitem"), KEY, MEASURED))


@register("anomaly_profile")
def anomaly_profile(spark, sf):
    df = table(spark, sf, "lineitem")
    top = anomalies.top_anomalies(anomalies.detect_anomalies(df, KEY, MEASURED), ["l_orderkey"], MEASURED)
    return ex.anomaly_profile(top, pr.means_and_maxima(df, MEASURED), MEASURED)


_SCORE = "round(l_extendedprice * l_quantity / 1000, 6)"
_WORST = "order by anomaly_score desc, " + ", ".join(f"{c} desc" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def _scored(spark, sf) -> DataFrame:
    """Rows with a given score in place of the forest's, so that what follows from scores can be compared."""
    score = F.round(F.col("l_extendedprice") * F.col("l_quantity") / 1000, 6)
    return table(spark, sf, "lineitem").withColumn("anomaly_score", score).withColumn("is_anomaly", F.col("anomaly_score") > 100)


@register("top_anomalies_given", f"""select {', '.join(KEY)}, round({_SCORE}, 3) as anomaly_score, round(l_quantity, 2) as l_quantity, round(l_discount, 2) as l_discount, round(l_tax, 2) as l_tax
    from lineitem where {_SCORE} > 100 order by {_SCORE} desc, {', '.join(KEY)} limit 10""")
def top_anomalies_given(spark, sf):
    return anomalies.top_anomalies(_scored(spark, sf), KEY, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@register("anomaly_profile_given", q.union([
    f"""select '{c}' as feature, least(100.0, round((select {c} from (select *, {_SCORE} as anomaly_score from lineitem) {_WORST} limit 1) / greatest(1.0, max({c})) * 100)) as anomaly_pct,
        least(100.0, round(avg({c}) / greatest(1.0, max({c})) * 100)) as baseline_pct from lineitem""" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]))
def anomaly_profile_given(spark, sf):
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return ex.anomaly_profile(_scored(spark, sf), pr.means_and_maxima(table(spark, sf, "lineitem"), features), features)


@register("key_drivers")
def key_drivers(spark, sf):
    return drivers.key_drivers(table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ), "o_totalprice", ["o_totalprice", "c_acctbal", "c_nationkey", "o_orderkey"])


_MADE = "(select o_custkey % 101 as visits, o_orderkey % 89 as weight, o_orderkey % 7 as weekday, 20 * (o_custkey % 101) + 4 * (o_orderkey % 89) as revenue from orders)"


@register("drivers_planted", f"""select 'revenue' as target, feature, cast(row_number() over (order by strength desc) as integer) as place from (
    select 'visits' as feature, abs(corr(visits, revenue)) as strength from {_MADE} union all select 'weight', abs(corr(weight, revenue)) from {_MADE}
    union all select 'weekday', abs(corr(weekday, revenue)) from {_MADE})""")
def drivers_planted(spark, sf):
    """The target is found by its name, and features rank as they were put into it."""
    made = table(spark, sf, "orders").select(
        (F.col("o_custkey") % 101).cast("double").alias("visits"), (F.col("o_orderkey") % 89).cast("double").alias("weight"),
        (F.col("o_orderkey") % 7).cast("double").alias("weekday"))
    found = drivers.key_drivers(made.withColumn("revenue", 20 * F.col("visits") + 4 * F.col("weight")), features=["visits", "weight", "weekday", "revenue"])
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("importance"), "feature"))
    return found.select("target", "feature", place.alias("place"))


@register("insights")
def insights_query(spark, sf):
    orders, segmented = table(spark, sf, "orders"), _segmentation(spark, sf)
    found = [insights.overview(orders)]
    found.append(insights.segment_insight(segments.personas(segmented), segmented.silhouette))
    found.append(insights.driver_insight(key_drivers(spark, sf)))
    found.append(insights.anomaly_insight(anomaly_summary(spark, sf)))
    weekly = fc.series(orders, "o_orderdate", "o_totalprice", "week")
    found.append(insights.trend_insight(fc.trend_summary(weekly), "o_totalprice"))
    return insights.combine(found)


@register("insights_planted", f"""with p as ({_personas_sql()}), s as ({ORACLES['silhouette_planted']}), a as ({ORACLES['anomaly_summary']})
    select 'overview' as kind, 'Size' as badge, 'Rows: ' || count(*) || ', columns: {len(COLUMNS['orders'])}' as headline, 'All figures below are over these rows.' as detail from orders
    union all select 'clustering', 'Segments', 'Segments: ' || (select count(*) from p) || ', silhouette ' || printf('%.3f', s.score),
      (select 'Most rows (' || percentage || '%) are in ' || name from p order by size desc, cluster_id limit 1) from s
    union all select 'anomaly', 'Outliers', 'Flagged rows: ' || total_anomalies || ', ' || anomaly_pct || '% of all', 'Random splits part these rows from the rest soonest.' from a""")
def insights_planted(spark, sf):
    """The findings in words, where the figures behind them are known."""
    planted = _planted(spark, sf)
    return insights.combine([
        insights.overview(table(spark, sf, "orders")), insights.segment_insight(segments.personas(planted), planted.silhouette),
        insights.anomaly_insight(anomaly_summary(spark, sf))])


# ---------------------------------------------------------------- sources and sinks

_RAW_SUMMARY = """select count(*) as row_count, count(distinct order_id) as orders, count(distinct price) as prices, min(ship_date) as first_date,
  cast(sum(cast(line_number as bigint)) as bigint) as lines from ({source})"""


def _raw_summary(df: DataFrame) -> DataFrame:
    """Texts are told apart by 128 bits of hash: beside the least text, Spark would sort every row of a task for the distinct ones."""
    distinct = ds.hashed_distinct(df, {"orders": F.col("order_id"), "prices": F.col("price")})
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), *[F.lit(n).cast("bigint").alias(c) for c, n in distinct.items()],
        F.min("ship_date").alias("first_date"), F.sum(F.col("line_number").cast("bigint")).alias("lines"),
    )


_RAW = ["order_id", "line_number", "ship_date", "price"]


@register("source_delimited", _RAW_SUMMARY.format(source=q.DIRTY))
def source_delimited(spark, sf):
    path = scratch_path(spark, "raw-text")
    dirty(spark, sf).select(*_RAW).write.option("header", True).option("sep", ";").csv(path)
    return _raw_summary(files.read_delimited(spark, path))


@register("source_json_lines", _RAW_SUMMARY.format(source=q.DIRTY))
def source_json_lines(spark, sf):
    path = scratch_path(spark, "raw-json")
    dirty(spark, sf).select(*_RAW).write.json(path)
    return _raw_summary(files.read_json(spark, path))


@register("source_lines", "select count(*) as row_count, cast(sum(c_custkey) as bigint) as keys from customer")
def source_lines(spark, sf):
    rows = table(spark, sf, "customer").select(
        (F.col("c_custkey") + 1).alias("position"), F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment").alias("value")
    )
    header = rows.limit(1).select(F.lit(0).cast("bigint").alias("position"), F.lit("key|name|segment").alias("value"))
    parsed = files.read_lines(stage(header.unionByName(rows), "lines"))
    return parsed.agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("key").cast("bigint")).alias("keys"))


@register("source_ingest", "select 'orders' as from_table, 'custkey' as from_col, 'customer' as to_table, 'custkey' as to_col, 'many_to_one' as cardinality")
def source_ingest(spark, sf):
    root = scratch_path(spark, "ingest")
    paths = []
    for name, kind in (("orders", "csv"), ("customer", "json")):
        paths.append(f"{root}/{name}.{kind}")
        writer = plain(spark, sf, name).write
        writer.option("header", True).csv(paths[-1]) if kind == "csv" else writer.json(paths[-1])
    _, edges = files.ingest(spark, paths)
    return edges.select("from_table", "from_col", "to_table", "to_col", "cardinality")


def _views(spark, sf, names=("region", "nation", "customer")):
    for n in names:
        table(spark, sf, n).createOrReplaceTempView(f"plumb_{n}")


@register(
    "sql_query",
    "select n_name, count(*) as customers from customer join nation on c_nationkey = n_nationkey group by n_name order by customers desc, n_name",
)
def sql_query(spark, sf):
    _views(spark, sf)
    return tb.run_sql(
        spark,
        "select n_name, count(*) as customers from plumb_customer join plumb_nation on c_nationkey = n_nationkey "
        "group by n_name order by customers desc, n_name;",
    )


@register("model_drop", """select r_name as region_name, count(*) as customers, round(sum(c_acctbal), 2) as balance, cast(sum(c_nationkey) as bigint) as nations,
    cast(0 as bigint) as order_columns from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey group by r_name""")
def model_drop(spark, sf):
    """A table and an edge removed from a model: the view of the rest neither holds their columns nor counts them."""
    model = model_of((n, plain(spark, sf, n)) for n in ("orders", "customer", "nation", "region", "supplier"))
    for edge in (("orders", "custkey", "customer", "custkey"), ("customer", "nationkey", "nation", "nationkey"),
                 ("supplier", "nationkey", "nation", "nationkey"), ("nation", "regionkey", "region", "regionkey")):
        model.relate(*edge)
    model.drop("orders").unrelate("supplier", "nationkey", "nation", "nationkey")
    view, names = unify_named(model, "customer")
    gone = sum(t in ("orders", "supplier") for t, _ in names)
    return view.groupBy(F.col(names["region", "name"]).alias("region_name")).agg(
        F.count(F.lit(1)).alias("customers"), F.round(F.sum("acctbal"), 2).alias("balance"), F.sum("nationkey").alias("nations"),
        F.lit(gone).cast("bigint").alias("order_columns"))


@register("schema_samples", q.union([
    f"select '{t}' as \"table\", cast(row_number() over (order by {', '.join(COLUMNS[t])}) as integer) as row, {pairs} as data from {t} qualify row <= 3"
    for t, pairs in (
        ("region", """'{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}'"""),
        ("nation", """'{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}'"""),
    )]))
def schema_samples(spark, sf):
    return sample_rows(model_of((n, table(spark, sf, n)) for n in ("region", "nation")))


@register("run_log_clear", "select user_id, count(*) as runs from events where user_id <> (select min(user_id) from events) group by user_id")
def run_log_clear(spark, sf):
    """Runs appended to a log, those of one user cleared, the rest read back."""
    events = table(spark, sf, "events")
    path = scratch_path(spark, "log")
    runs = events.select(
        F.col("event_id").cast("string").alias("run_id"), "user_id", F.col("event_type").alias("dataset"), F.lit(1).cast("bigint").alias("records"),
        F.col("value").alias("health_score"), F.lit("Analyzed Dataset").alias("action"), F.col("ts").alias("created_at"),
    )
    sinks.append_runs(runs, path)
    first = events.agg(F.min("user_id")).first()[0]
    left = sinks.clear_history(spark, path, first)
    return left.groupBy(F.col("user_id").cast("bigint").alias("user_id")).agg(F.count(F.lit(1)).alias("runs"))


@register("table_list", q.union([f"select 'plumb_{n}' as name, count(*) as rows from {n}" for n in ("customer", "nation", "region")]))
def table_list(spark, sf):
    _views(spark, sf)
    return tb.list_tables(spark, ["plumb_region", "plumb_nation", "plumb_customer"])


@register("table_load", "select * from lineitem")
def table_load(spark, sf):
    _views(spark, sf, ("lineitem",))
    return tb.load_table(spark, "plumb_lineitem")


@register("sql_query_whole", "select o_orderkey, o_orderdate from orders")
def sql_query_whole(spark, sf):
    """Without a limit of its own a query returns all rows, whatever words its texts hold."""
    _views(spark, sf, ("orders",))
    return tb.run_sql(spark, "select o_orderkey, o_orderdate from plumb_orders where o_orderpriority <> 'no limit'")


_LATIN = "select c_custkey, case when c_custkey = (select max(c_custkey) from customer) then 'Köln' else c_name end as city, c_mktsegment from customer"


@register("source_latin", _LATIN)
def source_latin(spark, sf):
    """One byte in the last line decides the encoding, and all lines the delimiter."""
    rows = table(spark, sf, "customer")
    last = rows.agg(F.max("c_custkey")).first()[0]
    city = F.when(F.col("c_custkey") == last, F.lit("Köln")).otherwise(F.col("c_name"))
    path = scratch_path(spark, "latin")
    out = rows.select("c_custkey", city.alias("city"), "c_mktsegment").orderBy("c_custkey")
    out.write.option("header", True).option("sep", "|").option("encoding", "ISO-8859-1").csv(path)
    return files.read_delimited(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@register("source_overlong", "select c_custkey, c_name from customer where c_custkey % 5 not in (1, 2)")
def source_overlong(spark, sf):
    """Rows with more fields than the header are left out, also where the first or all further ones are empty."""
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name")
    more = F.when(F.col("c_custkey") % 5 == 1, F.concat(line, F.lit(";;x"))).when(F.col("c_custkey") % 5 == 2, F.concat(line, F.lit(";"))).otherwise(line)
    path = scratch_path(spark, "overlong")
    header = spark.range(1).select(F.lit("c_custkey;c_name").alias("value"), F.lit(0).alias("p"))
    lines = table(spark, sf, "customer").select(more.alias("value"), F.lit(1).alias("p"))
    header.unionByName(lines).coalesce(1).sortWithinPartitions("p").select("value").write.text(path)
    return files.read_delimited(spark, path, sep=";").withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@register("sink_csv", "select * from part")
def sink_csv(spark, sf):
    """A table exported as CSV and read back with its types."""
    df = table(spark, sf, "part")
    path = scratch_path(spark, "csv")
    sinks.write_csv(df, path)
    return files.read_delimited(spark, path, sep=",", encoding="UTF-8").select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in df.schema.fields])


@register(
    "run_log_latest",
    f"""select user_id, cast(place as integer) as place, dataset, {q.rnd('health_score', 1)} as health_score from (select user_id, value as health_score, event_type as dataset,
        row_number() over (partition by user_id order by ts desc, event_id desc) as place from events) where place <= 30""",
)
def run_log_latest(spark, sf):
    runs = table(spark, sf, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("run_id"), "user_id", F.col("event_type").alias("dataset"),
        F.lit(1).cast("bigint").alias("records"), F.col("value").alias("health_score"), F.lit("Analyzed Dataset").alias("action"),
        F.col("ts").alias("created_at"),
    )
    return sinks.latest_runs(runs).select("user_id", "place", "dataset", "health_score")


@register(
    "sink_model",
    q.union([f"select '{t}' as \"table\", count(*) as rows from (select distinct * from {t})" for t in ("orders", "customer")])
    + " union all select 'unified_model', count(*) from orders",
)
def sink_model(spark, sf):
    model = sales_model(spark, sf, ("orders", "customer"))
    return sinks.export_model(model, scratch_path(spark, "export")).select("table", "rows")


@register("sink_summary", "select 'Orders' as title, count(*) as total_records, 6 as columns, 3 as metrics from orders")
def sink_summary(spark, sf):
    df = table(spark, sf, "orders")
    path = scratch_path(spark, "summary")
    sinks.export_summary(path, "Orders", df, pr.numeric_profile(df), au.audit(df).table_frame())
    back = spark.read.json(path)
    return back.select("title", "total_records", F.size("columns").alias("columns"), F.size("numeric_stats").alias("metrics"))
