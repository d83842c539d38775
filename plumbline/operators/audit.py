"""Data-quality audit: what is missing, duplicated, mistyped or out of range, and a 0-100 score."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.numbers import half_up
from plumbline.functions.text import trimmed
from plumbline.operators.columns import numeric_columns, quoted, text_columns, time_columns
from plumbline.operators.distinct import duplicate_rows
from plumbline.operators.distribution import FEW_VALUES, ROWS, distinguished, hashed_distinct, of_column, read_cells, read_values, sketched_distinct, wide_columns
from plumbline.operators.quantiles import exact_quantiles
from plumbline.session import stage

# Share of values that must parse, fence width, weights and bounds of the score.
TYPE_SHARE = 0.75
FENCE = 1.5
WEIGHT_MISSING, WEIGHT_DUPLICATE, WEIGHT_DIRTY, WEIGHT_OUTLIER = 40.0, 20.0, 25.0, 15.0
LOWEST_SCORE, HIGHEST_SCORE = 5.0, 100.0

COLUMN_SCHEMA = (
    "column string, detected_type string, raw_type string, missing_count bigint, missing_pct double, "
    "unique_count bigint, outlier_count bigint, is_dirty_numeric boolean, is_dirty_datetime boolean, "
    "casing_variations bigint"
)
TABLE_SCHEMA = (
    "health_score double, total_rows bigint, total_cols bigint, total_cells bigint, duplicate_rows bigint, "
    "duplicate_pct double, missing_cells bigint, missing_cell_pct double, total_outliers bigint, "
    "dirty_type_cols bigint, casing_anomaly_cols bigint"
)


@dataclass
class ColumnAudit:
    column: str
    detected_type: str
    raw_type: str
    missing_count: int
    missing_pct: float
    unique_count: int
    outlier_count: int
    is_dirty_numeric: bool
    is_dirty_datetime: bool
    casing_variations: int


@dataclass
class Audit:
    """The audit's figures, one entry per column plus the table's own; tiny, whatever the data."""

    spark: SparkSession
    total_rows: int
    total_cols: int
    duplicate_rows: int
    columns: list[ColumnAudit]
    # For a cleaning of the same rows: the staged distribution, and the columns that are not in it.
    values: DataFrame | None = field(default=None, compare=False, repr=False)
    wide: tuple[str, ...] = field(default=(), compare=False, repr=False)

    def columns_frame(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(asdict(c).values()) for c in self.columns], COLUMN_SCHEMA)

    def table_frame(self) -> DataFrame:
        """One row: the table-level record with its health score."""
        dirty = F.col("is_dirty_numeric") | F.col("is_dirty_datetime")
        sums = self.columns_frame().agg(
            F.coalesce(F.sum("missing_count"), F.lit(0)).alias("missing_cells"),
            F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("total_outliers"),
            F.count_if(dirty).alias("dirty_type_cols"),
            F.count_if(F.col("casing_variations") > 0).alias("casing_anomaly_cols"),
        )
        rows, cols = F.lit(self.total_rows).cast("bigint"), F.lit(self.total_cols).cast("bigint")
        table = sums.select(
            "*",
            rows.alias("total_rows"),
            cols.alias("total_cols"),
            (rows * cols).alias("total_cells"),
            F.lit(self.duplicate_rows).cast("bigint").alias("duplicate_rows"),
        )
        return table.select(
            health_score().alias("health_score"), "total_rows", "total_cols", "total_cells", "duplicate_rows",
            percentage(F.col("duplicate_rows"), F.col("total_rows")).alias("duplicate_pct"),
            "missing_cells",
            percentage(F.col("missing_cells"), F.col("total_cells")).alias("missing_cell_pct"),
            "total_outliers", "dirty_type_cols", "casing_anomaly_cols",
        )


def percentage(part: Column, whole: Column) -> Column:
    return F.round(part * 100 / F.greatest(whole, F.lit(1)), 2)


def health_score() -> Column:
    """Score from the table-level counts: completeness, uniqueness, type consistency, value range."""
    cells, rows, cols = (F.greatest(F.col(c), F.lit(1)) for c in ("total_cells", "total_rows", "total_cols"))
    score = (
        F.lit(HIGHEST_SCORE)
        - WEIGHT_MISSING * F.col("missing_cells") / cells
        - WEIGHT_DUPLICATE * F.col("duplicate_rows") / rows
        - WEIGHT_DIRTY * F.col("dirty_type_cols") / cols
        - WEIGHT_OUTLIER * F.least(F.lit(1.0), F.col("total_outliers") / cells)
    )
    bounded = F.greatest(F.lit(LOWEST_SCORE), F.least(F.lit(HIGHEST_SCORE), F.round(score, 1)))
    return F.when(F.col("total_rows") == 0, F.lit(0.0)).otherwise(bounded)


def audit(
    df: DataFrame, bound: int = FEW_VALUES, fraction: float | None = None, seed: int = 42, approximate: bool = False,
    parts: tuple[DataFrame | None, DataFrame | None] | None = None,
) -> Audit:
    """Audit all rows of ``df``, or with ``fraction`` a staged row sample, whose own figures are then reported.

    ``approximate`` takes distinct and casing counts of columns that hardly repeat from a sketch of all rows (2 %
    standard error), which saves shuffling their hashes; all else stays exact.

    A sketch scan parts columns of few values from those of more than ``bound``. The former become a staged
    value distribution; types, missing and distinct counts, casing and outliers come from it. The latter are
    parsed once, row by row, and told apart by hashes. Last,
    duplicates are counted over whole rows, among the suspects of ``parts`` if the caller has parted ``df`` already.
    """
    if fraction is not None:
        df, parts = stage(df.sample(fraction, seed), "sample"), None
    wide = wide_columns(df, bound)
    many = df.select(*[quoted(c) for c in wide])
    few = stage(read_values(df.select(*[quoted(c) for c in df.columns if c not in wide])), "values")
    tallies = lambda values: values.groupBy("column").agg(
        F.sum("count").alias("present"),
        F.count(F.lit(1)).alias("distinct"),
        F.sum(F.when(F.col("token"), F.col("count")).otherwise(0)).alias("tokens"),
        F.sum(F.when(F.col("number").isNotNull(), F.col("count")).otherwise(0)).alias("numbers"),
        F.count("number").alias("number_rows"),
        F.sum(F.when(F.col("time").isNotNull(), F.col("count")).otherwise(0)).alias("times"),
    )
    per_column = tallies(few)
    if wide:
        # Parsed once, without the texts; the numbers are read again for the quantiles.
        cells = stage(read_cells(many).filter(F.col("column") != ROWS).select("column", "count", "number", "time", "token"), "cells")
        per_column = per_column.unionByName(tallies(cells))
    seen = {r["column"]: r for r in per_column.collect()}
    if ROWS not in seen:
        return Audit(df.sparkSession, 0, len(df.columns), 0, [])
    rows = seen[ROWS]["present"]

    texts, numbers, times = text_columns(df), numeric_columns(df), time_columns(df)
    detected = {c: "string" for c in df.columns}
    for c in set(df.columns) & set(seen):
        if c in numbers:
            detected[c] = "numeric"
        elif c in times:
            detected[c] = "datetime"
        elif c in texts and seen[c]["numbers"] > TYPE_SHARE * seen[c]["present"]:
            detected[c] = "dirty_numeric"
        elif c in texts and seen[c]["times"] > TYPE_SHARE * seen[c]["present"]:
            detected[c] = "datetime"

    measured = [c for c in df.columns if detected[c] in ("numeric", "dirty_numeric")]
    known = {c: (seen[c]["numbers"], seen[c]["number_rows"]) for c in measured}
    outliers = tukey_outliers(few, {c: of_column(c) for c in measured if c not in wide}, weight=F.col("count"), known=known)
    by_row = [c for c in measured if c in wide]
    if by_row:
        outliers |= tukey_outliers(cells, {c: of_column(c) for c in by_row}, weight=F.col("count"), known=known)
    strings = [c for c in texts if detected[c] == "string" and c in seen]
    folded = folded_distinct(few, [c for c in strings if c not in wide])
    count = sketched_distinct if approximate else hashed_distinct
    exact = count(many, {("all", c): distinguished(df.schema[c]) for c in wide} | {("folded", c): F.lower(trimmed(quoted(c))) for c in strings if c in wide})
    folded |= {c: n for (kind, c), n in exact.items() if kind == "folded"}

    columns = []
    for f in df.schema:
        c = f.name
        present, tokens = (seen[c]["present"], seen[c]["tokens"]) if c in seen else (0, 0)
        distinct = exact["all", c] if c in wide else seen[c]["distinct"] if c in seen else 0
        missing = min(rows, rows - present + tokens)
        columns.append(
            ColumnAudit(
                c,
                detected[c],
                f.dataType.simpleString(),
                missing,
                half_up(missing * 100 / rows, 2),
                distinct,
                outliers.get(c, 0),
                detected[c] == "dirty_numeric",
                detected[c] == "datetime" and c in texts,
                max(0, distinct - folded[c]) if c in strings else 0,
            )
        )
    return Audit(df.sparkSession, rows, len(df.columns), duplicate_rows(df, parts), columns, few, tuple(wide))


def folded_distinct(values: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values per text column once trimmed and lower-cased."""
    if not columns:
        return {}
    folded = values.filter(F.col("column").isin(*columns)).select("column", F.lower(trimmed(F.col("text"))).alias("folded"))
    return {r["column"]: r["count"] for r in folded.distinct().groupBy("column").count().collect()}


def tukey_outliers(
    df: DataFrame, values: dict[str, Column], fence: float = FENCE, at_least: int = 4,
    weight: Column | None = None, known: dict[str, tuple[int, int]] | None = None,
) -> dict[str, int]:
    """Values outside the quartiles by more than ``fence`` interquartile ranges, per column."""
    quartiles = exact_quantiles(df, values, [0.25, 0.75], weight=weight, known=known)
    bounds = {c: fences(*q.values, fence) for c, q in quartiles.items() if q.count >= at_least}
    return count_outside(df, values, bounds, weight)


def count_outside(
    df: DataFrame, values: dict[str, Column], bounds: dict[str, tuple[float, float]], weight: Column | None = None
) -> dict[str, int]:
    """How many values lie outside their column's bounds."""
    if not bounds:
        return {}
    one = F.lit(1) if weight is None else weight
    exprs = [
        F.sum(F.when(~values[c].between(F.lit(low), F.lit(high)), one).otherwise(0)).alias(f"o{i}")
        for i, (c, (low, high)) in enumerate(bounds.items())
    ]
    row = df.agg(*exprs).first()
    return {c: row[f"o{i}"] or 0 for i, c in enumerate(bounds)}


def fences(q1: float, q3: float, width: float) -> tuple[float, float]:
    return q1 - width * (q3 - q1), q3 + width * (q3 - q1)


def compare_audits(before: Audit, after: Audit) -> DataFrame:
    """Before/after figures and their differences in one row."""
    kept = ["health_score", "total_rows", "total_cols", "missing_cells", "duplicate_rows", "total_outliers"]
    one = before.table_frame().select(F.lit(1).alias("k"), *[F.col(c).alias(f"initial_{c}") for c in kept])
    two = after.table_frame().select(F.lit(1).alias("k"), *[F.col(c).alias(f"cleaned_{c}") for c in kept])
    return one.join(two, "k").select(
        *[F.col(f"{when}_{c}") for c in kept for when in ("initial", "cleaned")],
        F.round(F.col("cleaned_health_score") - F.col("initial_health_score"), 1).alias("health_score_delta"),
        (F.col("initial_missing_cells") - F.col("cleaned_missing_cells")).alias("missing_cells_handled"),
    )


# Alert rules (name, measured figure, direction, threshold, level).
ALERT_RULES = (
    ("Health Score Critical", "health_score", "below", 85.0, "danger"),
    ("High Outlier Density", "total_outliers", "above", 50.0, "warning"),
    ("High Imputation Count", "missing_cells", "above", 100.0, "info"),
)


def alerts(table: DataFrame) -> DataFrame:
    """The alert rules that a table-level audit record triggers: ``rule, detail, level``."""
    checks = []
    for rule, figure, direction, threshold, level in ALERT_RULES:
        value = F.col(figure)
        hit = value < threshold if direction == "below" else value > threshold
        detail = F.format_string(f"{figure} is %s, {direction} the threshold of {threshold:g}", value.cast("string"))
        checks.append(F.struct(hit.alias("hit"), F.lit(rule).alias("rule"), detail.alias("detail"), F.lit(level).alias("level")))
    return table.select(F.inline(F.array(*checks))).filter("hit").drop("hit")
