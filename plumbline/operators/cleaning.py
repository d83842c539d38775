"""Automatic cleaning: measure the table, decide, then clean it in one projection.

``fit`` runs the statistics (small results only) and records every decision in a ``CleaningPlan``;
``CleaningPlan.apply`` is lazy, row-wise and free of shuffles, so it also runs on a stream. Steps, in
order: duplicates, null tokens, composite split, numbers, dates, text, outliers, missing values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions.text import collapse_spaces, is_null_token, title_case, to_number, to_timestamp, without_null_tokens
from plumbline.operators.audit import Audit, count_outside, fences
from plumbline.operators.columns import DERIVED_SUFFIXES, is_key_name, number, numeric_columns, quoted, text_columns
from plumbline.operators.distinct import extra_rows, part_suspects
from plumbline.operators.distribution import (
    FEW_VALUES, ROWS, Values, hashed_distinct, hashed_modes, number_counts, of_column, read_cells, read_values, wide_columns,
    without_rows,
)
from plumbline.operators.quantiles import exact_quantiles
from plumbline.session import stage

# Decision thresholds, the composite pattern and the names of optional amounts.
TYPE_SHARE = 0.70
COMPOSITE_SHARE = 0.60
COMPOSITE_PATTERN = r"^\s*([0-9]{2,3})\s*/\s*([0-9]{2,3})(?:\s*[A-Za-z]+)?\s*$"
COMPOSITE_SUFFIXES = ("_Systolic", "_Diastolic")
CATEGORY_SHARE = 0.5
FENCE = 2.5
SPARSE_SHARE = 0.4
# Text columns of at most so many values and bytes are cleaned value by value, and looked up for each row.
LOOKUP_VALUES, LOOKUP_BYTES = 50_000, 1 << 21
OPTIONAL_AMOUNTS = ("refund", "discount", "fee", "penalty", "tax")


@dataclass
class CleaningConfig:
    remove_duplicates: bool = True
    clean_dirty_numerics: bool = True
    standardize_text: bool = True
    parse_dates: bool = True
    extract_temporal_features: bool = True
    impute_missing: bool = True
    numeric_impute_strategy: str = "median"  # median / mean / zero
    categorical_impute_strategy: str = "mode"  # mode / unknown
    treat_outliers: bool = True
    outlier_strategy: str = "winsorize"  # winsorize / clip_iqr / none
    decompose_composites: bool = True
    percent_as_fraction: bool = False

    def __post_init__(self):
        if self.numeric_impute_strategy not in ("median", "mean", "zero"):
            raise ValueError(f"numeric_impute_strategy: {self.numeric_impute_strategy!r}")
        if self.categorical_impute_strategy not in ("mode", "unknown"):
            raise ValueError(f"categorical_impute_strategy: {self.categorical_impute_strategy!r}")
        if self.outlier_strategy not in ("winsorize", "clip_iqr", "none"):
            raise ValueError(f"outlier_strategy: {self.outlier_strategy!r}")


@dataclass
class LogEntry:
    step: str
    column: str | None
    detail: str
    affected: int | None


@dataclass
class CleaningPlan:
    """Every decision the cleaning needs, as plain values."""

    config: CleaningConfig
    texts: list[str]
    composite: str | None = None
    numbers: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    titles: list[str] = field(default_factory=list)
    clips: dict[str, tuple[float, float]] = field(default_factory=dict)
    fills: dict[str, float | str] = field(default_factory=dict)
    log: list[LogEntry] = field(default_factory=list)
    # ``column, text``: all texts of the columns of few values in the rows that the plan was made for.
    known: DataFrame | None = field(default=None, compare=False, repr=False)
    few: list[str] = field(default_factory=list, compare=False, repr=False)

    def apply(self, df: DataFrame) -> DataFrame:
        """The row-wise steps on ``df`` (duplicates are a matter of ``deduplicate``)."""
        return fill_missing(clip_outliers(self.typed(df), self.clips), self.fills)

    def apply_fitted(self, base: DataFrame) -> DataFrame:
        """``apply`` on the rows that the plan was made for: columns of few values are cleaned once per value and looked up."""
        return fill_missing(clip_outliers(self._looked_up(base), self.clips), self.fills)

    def _looked_up(self, base: DataFrame) -> DataFrame:
        """``typed``, by broadcast joins with the cleaned values of the columns of few values; null finds none."""
        keys = {c: f"__key{i}" for i, c in enumerate(self.few)}
        typed = self.typed(base.select(*[quoted(c).alias(keys.get(c, c)) for c in base.columns]))
        for c, key in keys.items():
            texts = self.known.filter(F.col("column") == c).select(F.col("text").alias(f"{key}_text"), F.col("text").alias(c))
            typed = typed.join(F.broadcast(self.typed(texts)), F.col(key) == F.col(f"{key}_text"), "left")
        flags = [c + "_IsWeekend" for c in self.few if c in self.dates and self.config.extract_temporal_features]
        return typed.select(*[F.coalesce(quoted(c), F.lit(0)).alias(c) if c in flags else quoted(c) for c in self.typed(base).columns])

    def typed(self, df: DataFrame) -> DataFrame:
        """The steps before outlier treatment: tokens, composite, numbers, dates, text."""
        out: list[Column] = []
        for c in df.columns:
            value = without_null_tokens(quoted(c)) if c in self.texts else quoted(c)
            if c == self.composite:
                continue
            if c in self.numbers:
                out.append(to_number(value, self.config.percent_as_fraction).alias(c))
            elif c in self.dates:
                out.append(to_timestamp(value).alias(c))
            elif c in self.texts and self.config.standardize_text:
                out.append(normalize_text(value, c in self.titles).alias(c))
            else:
                out.append(value.alias(c))
        if self.composite in df.columns:
            out += split_composite(without_null_tokens(quoted(self.composite)), self.composite)
        typed = df.select(*out)
        if self.config.extract_temporal_features:
            typed = typed.withColumns({n: e for c in self.dates if c in df.columns for n, e in temporal_features(c).items()})
        return typed

    def log_frame(self, spark) -> DataFrame:
        rows = [(i, e.step, e.column, e.detail, e.affected) for i, e in enumerate(self.log)]
        return spark.createDataFrame(rows, "position int, step string, column string, detail string, affected bigint")


Parts = tuple[DataFrame | None, DataFrame | None]


def deduplicate(df: DataFrame, parts: Parts | None = None) -> DataFrame:
    """One row of each group of equal rows; only rows whose hash occurs twice are shuffled."""
    alone, suspects = parts or part_suspects(df)
    if suspects is None:
        return alone
    return suspects.dropDuplicates() if alone is None else alone.unionByName(suspects.dropDuplicates())


def standardize_nulls(df: DataFrame) -> DataFrame:
    """Null tokens of all text columns as null."""
    return df.withColumns({c: without_null_tokens(quoted(c)) for c in text_columns(df)})


def split_composite(c: Column, name: str) -> list[Column]:
    """Both numbers of a value such as ``120/80 mmHg`` as two integer columns."""
    return [
        F.regexp_extract(c, COMPOSITE_PATTERN, i + 1).try_cast("int").alias(name + suffix)
        for i, suffix in enumerate(COMPOSITE_SUFFIXES)
    ]


def temporal_parts(c: Column) -> dict[str, Column]:
    """Calendar parts by column suffix; a missing date counts as no weekend."""
    return {
        "_Year": F.year(c),
        "_Month": F.month(c),
        "_DayOfWeek": F.date_format(c, "EEEE"),
        "_IsWeekend": F.coalesce(F.weekday(c) >= 5, F.lit(False)).cast("int"),
    }


def temporal_features(name: str) -> dict[str, Column]:
    """New columns with the calendar parts of a timestamp column."""
    return {name + suffix: part for suffix, part in temporal_parts(quoted(name)).items()}


def normalize_text(c: Column, as_title: bool) -> Column:
    """Whitespace collapsed, title case for category-like columns, null tokens removed."""
    text = collapse_spaces(c)
    return F.when(~is_null_token(text), title_case(text)) if as_title else without_null_tokens(text)


def clip_outliers(df: DataFrame, clips: dict[str, tuple[float, float]]) -> DataFrame:
    """Values held within the given bounds; null stays null. Whole bounds leave an integer column in its type."""
    return df.withColumns({c: _clip(df, c, *bounds) for c, bounds in clips.items()})


def _keeps_type(df: DataFrame, c: str, *values: float) -> bool:
    """Whether whole numbers are to be put into an integer column, whose large values a double would round."""
    return isinstance(df.schema[c].dataType, T.IntegralType) and all(float(v).is_integer() and abs(v) < 2**63 for v in values)


def _clip(df: DataFrame, name: str, low: float, high: float) -> Column:
    # least and greatest skip nulls, so a null must be kept apart.
    if _keeps_type(df, name, low, high):
        c = quoted(name).cast("bigint")
        held = F.least(F.greatest(c, F.lit(int(low)).cast("bigint")), F.lit(int(high)).cast("bigint"))
        return F.when(c.isNotNull(), held).cast(df.schema[name].dataType)
    c = number(df, name)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def fill_missing(df: DataFrame, fills: dict[str, float | str]) -> DataFrame:
    """Missing values replaced; an integer column takes a fractional fill as a double column, a whole one in its type."""
    out = {}
    for c, value in fills.items():
        if isinstance(value, str):
            out[c] = F.coalesce(quoted(c), F.lit(value))
        elif _keeps_type(df, c, value):
            out[c] = F.coalesce(quoted(c), F.lit(int(value)).cast(df.schema[c].dataType))
        else:
            out[c] = F.coalesce(number(df, c), F.lit(float(value)))
    return df.withColumns(out)


def outlier_scope(counts: dict[str, tuple[int, int]], columns: list[str]) -> list[str]:
    """Columns whose outliers may be treated: no keys or calendar flags, over 3 values."""
    named = [c for c in columns if not is_key_name(c) and not c.lower().endswith(DERIVED_SUFFIXES)]
    return [c for c in named if c in counts and counts[c][1] > 3]


@dataclass
class Outliers:
    """What outlier treatment found: bounds to clip to, outlier counts, every column's median and size.

    Clipping keeps the middle of a column in place, so the medians hold after it as well.
    """

    clips: dict[str, tuple[float, float]]
    counts: dict[str, int]
    medians: dict[str, float]
    present: dict[str, int]


def _by_form(values: Values, columns: list[str]) -> list[tuple[DataFrame, dict[str, Column], Column | None]]:
    """The numeric ``columns`` as expressions over the distribution (with its weight) and over the rows."""
    few = {c: of_column(c) for c in columns if c not in values.numbers}
    many = {c: quoted(c) for c in columns if c in values.numbers}
    return [(values.few, few, F.col("count")), (values.many, many, None)]


def find_outliers(values: DataFrame | Values, columns: list[str], strategy: str = "winsorize") -> Outliers:
    """Outliers of the numeric ``columns`` of a table's values."""
    values = Values.of(values)
    counted = number_counts(values)
    forms = _by_form(values, [c for c in columns if c in counted])
    quantiles = {}
    for frame, numbers, weight in forms:
        quantiles |= exact_quantiles(frame, numbers, [0.01, 0.25, 0.5, 0.75, 0.99], weight=weight, known=counted)
    bounds = {}
    for c in outlier_scope(counted, columns):
        p01, q1, _, q3, p99 = quantiles[c].values
        if quantiles[c].count >= 10 and q3 > q1:
            bounds[c] = fences(q1, q3, FENCE)
    counts = {}
    for frame, numbers, weight in forms:
        found = count_outside(frame, numbers, {c: b for c, b in bounds.items() if c in numbers}, weight)
        counts |= {c: n for c, n in found.items() if n}
    counts = {c: counts[c] for c in bounds if c in counts}
    clips = {}
    if strategy == "winsorize":
        clips = {c: (quantiles[c].values[0], quantiles[c].values[4]) for c in counts}
    elif strategy == "clip_iqr":
        clips = {c: bounds[c] for c in counts}
    medians = {c: q.values[2] for c, q in quantiles.items()}
    return Outliers(clips, counts, medians, {c: q.count for c, q in quantiles.items()})


def numeric_fills(
    values: DataFrame | Values, columns: list[str], rows: int, strategy: str = "median", outliers: Outliers | None = None
) -> tuple[dict[str, float], dict[str, int]]:
    """Fill values of the numeric columns that may be imputed, and how many values each fills.

    Keys are never filled. A column with over 40 % missing is filled with 0 if its name says that it
    holds an optional amount, and left alone otherwise. After outlier treatment, its findings save
    counting again, and means are those of the clipped values.
    """
    values = Values.of(values)
    names = [c for c in columns if not is_key_name(c)]
    if outliers is None:
        present = {c: n for c, (n, _) in number_counts(values).items()}
    else:
        present = outliers.present
    missing = {c: rows - present.get(c, 0) for c in names if present.get(c, 0) < rows}
    sparse = [c for c in missing if missing[c] > SPARSE_SHARE * rows]
    dense = [c for c in missing if c not in sparse]
    fills = {c: 0.0 for c in sparse if any(word in c.lower() for word in OPTIONAL_AMOUNTS)}
    if strategy == "zero":
        fills |= {c: 0.0 for c in dense}
    elif strategy == "mean":
        fills |= _means(values, dense, outliers.clips if outliers else {})
    elif outliers is not None:
        fills |= {c: outliers.medians[c] for c in dense}
    else:
        for frame, numbers, weight in _by_form(values, dense):
            fills |= {c: q.values[0] for c, q in exact_quantiles(frame, numbers, [0.5], weight=weight).items()}
        fills = {c: fills[c] for c in [*(c for c in fills if c not in dense), *dense]}
    return fills, {c: missing[c] for c in fills}


def _means(values: Values, columns: list[str], clips: dict[str, tuple[float, float]]) -> dict[str, float]:
    """Means rounded to 2, of the clipped values where a column is clipped."""
    found = {}
    for frame, numbers, weight in _by_form(values, columns):
        weight, means = F.lit(1) if weight is None else weight, []
        for i, (c, v) in enumerate(numbers.items()):
            if c in clips:
                v = F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(clips[c][0])), F.lit(clips[c][1])))
            means.append(F.round(F.sum(v * weight) / F.sum(F.when(v.isNotNull(), weight)), 2).alias(f"m{i}"))
        if means:
            row = frame.agg(*means).first()
            found |= {c: row[f"m{i}"] for i, c in enumerate(numbers)}
    return {c: found[c] for c in columns}


def categorical_fills(
    values: DataFrame | Values, columns: list[str], rows: int, strategy: str = "mode"
) -> tuple[dict[str, str], dict[str, int]]:
    """Fill values of the text columns with missing values, and how many values each fills.

    The mode is the smallest of the most frequent values; ``values`` may list a text several times.
    """
    values = Values.of(values)
    names = [c for c in columns if not is_key_name(c)]
    if not names:
        return {}, {}
    by_row = [c for c in names if c in values.texts]
    if by_row:
        row = values.prose.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(by_row)]).first()
        gaps = {c: rows - row[f"n{i}"] for i, c in enumerate(by_row) if row[f"n{i}"] < rows}
        modes = hashed_modes(values.prose, list(gaps)) if strategy == "mode" else {}
        fills, filled = categorical_fills(values.few, [c for c in names if c not in by_row], rows, strategy)
        fills, filled = fills | {c: modes.get(c, "Unknown") for c in gaps}, filled | gaps
        return {c: fills[c] for c in names if c in fills}, {c: filled[c] for c in names if c in filled}
    counts = values.few.filter(F.col("column").isin(*names) & F.col("text").isNotNull())
    counts = counts.groupBy("column", "text").agg(F.sum("count").alias("n"))
    found = counts.groupBy("column").agg(
        F.sum("n").alias("present"), F.min(F.struct(-F.col("n"), F.col("text").alias("text"))).alias("best")
    )
    seen = {r["column"]: r for r in found.collect()}
    missing = {c: rows - (seen[c]["present"] if c in seen else 0) for c in names}
    missing = {c: n for c, n in missing.items() if n}
    mode = lambda c: seen[c]["best"]["text"] if strategy == "mode" and c in seen else "Unknown"
    return {c: mode(c) for c in missing}, missing


def category_like(values: DataFrame, columns: list[str], rows: int) -> list[str]:
    """Text columns with fewer distinct values, whitespace collapsed, than half the rows."""
    if not columns:
        return []
    spaced = values.filter(F.col("column").isin(*columns) & ~F.col("token"))
    spaced = spaced.select("column", collapse_spaces(F.col("text")).alias("text")).distinct()
    counts = {r["column"]: r["count"] for r in spaced.groupBy("column").count().collect()}
    return [c for c in columns if counts.get(c, 0) < CATEGORY_SHARE * rows]


def category_like_by_row(df: DataFrame, columns: list[str], rows: int) -> list[str]:
    """``category_like`` for columns of many values: by estimate where it is far off half the rows, else by hash."""
    if not columns:
        return []
    spaced = {c: collapse_spaces(without_null_tokens(quoted(c))) for c in columns}
    row = df.agg(*[F.approx_count_distinct(v, 0.02).alias(f"d{i}") for i, v in enumerate(spaced.values())]).first()
    estimate = {c: row[f"d{i}"] / max(1.0, CATEGORY_SHARE * rows) for i, c in enumerate(columns)}
    close = {c: spaced[c] for c in columns if 0.8 < estimate[c] < 1.25}  # ten standard errors on either side
    exact = hashed_distinct(df, close)
    return [c for c in columns if (exact[c] < CATEGORY_SHARE * rows if c in close else estimate[c] < 1)]


def _cleaned_values(values: DataFrame, df: DataFrame, plan: CleaningPlan) -> DataFrame:
    """The distribution of the cleaned columns (before outliers and imputation).

    Every step so far maps one value to one value, so it can be applied to the distribution: an entry
    of a raw column becomes the entries of the columns made from it.
    """
    def entry(name, number=None, text=None):
        return F.struct(
            F.lit(name).alias("column"),
            (F.lit(None) if number is None else number).cast("double").alias("number"),
            (F.lit(None) if text is None else text).cast("string").alias("text"),
        )

    made: list[tuple[str, list[Column]]] = []
    text = F.when(~F.col("token"), F.col("text"))
    for c in df.columns:
        if c == plan.composite:
            parts = split_composite(text, c)
            made.append((c, [entry(c + suffix, part) for suffix, part in zip(COMPOSITE_SUFFIXES, parts)]))
        elif c in plan.dates and plan.config.extract_temporal_features:
            parts = temporal_parts(F.col("time"))
            made.append((c, [entry(c + "_Year", parts["_Year"]), entry(c + "_Month", parts["_Month"]),
                             entry(c + "_DayOfWeek", text=parts["_DayOfWeek"])]))
        elif c in plan.numbers:
            number = to_number(text, True) if plan.config.percent_as_fraction else F.when(~F.col("token"), F.col("number"))
            made.append((c, [entry(c, number)]))
        elif c in plan.texts and c not in plan.dates:
            value = normalize_text(text, c in plan.titles) if plan.config.standardize_text else text
            made.append((c, [entry(c, text=value)]))
        elif c in numeric_columns(df):
            made.append((c, [entry(c, F.col("number"))]))
    entries = F.when(F.lit(False), F.array(entry("")))
    for c, structs in made:
        entries = entries.when(F.col("column") == c, F.array(*structs))
    return (
        values.select("count", F.inline(entries))
        .filter(F.col("number").isNotNull() | F.col("text").isNotNull())
        .groupBy("column", "number", "text")
        .agg(F.sum("count").alias("count"))
    )


def _base(df: DataFrame, plan: CleaningPlan, bound: int, parts: Parts | None, audited: Audit | None) -> tuple[DataFrame, tuple[str, ...], DataFrame]:
    """The rows to clean, the columns that stay out of their value distribution, and the distribution, staged.

    The distribution of an audit of ``df`` serves again, less the rows that were removed. Then the rows themselves are
    not needed for any decision, so those that have no equal are not staged unless columns are measured row by row.
    """
    dedupe = plan.config.remove_duplicates
    known = audited is not None and audited.values is not None
    if known and not dedupe:
        return df, audited.wide, audited.values
    if not known or parts is None or parts[0] is None:
        base = stage(deduplicate(df, parts), "deduplicated") if dedupe else df
        wide = tuple(wide_columns(base, bound))
        return base, wide, stage(read_values(base.select(*[quoted(c) for c in base.columns if c not in wide])), "values")
    alone, suspects = parts
    if suspects is None:
        return alone, audited.wide, audited.values
    base = alone.unionByName(stage(suspects.dropDuplicates(), "deduplicated"))
    removed = extra_rows(suspects).drop(*audited.wide)
    values = stage(without_rows(audited.values, removed, "__extra"), "values")
    return stage(base, "deduplicated") if audited.wide else base, audited.wide, values


def fit(
    df: DataFrame, config: CleaningConfig | None = None, bound: int = FEW_VALUES, parts: Parts | None = None, audited: Audit | None = None
) -> tuple[CleaningPlan, DataFrame]:
    """Decide how to clean ``df``; returns the plan and the (deduplicated) rows to apply it to.

    Duplicates go first; the result is staged. Columns of at most ``bound`` values (as estimated) then enter the value
    distribution, the others are measured row by row, and every decision follows from the two. A caller that has them
    already passes the ``parts`` of ``part_suspects`` and an audit of all of ``df`` with its value distribution.
    """
    config = config or CleaningConfig()
    plan = CleaningPlan(config, text_columns(df))
    base, wide, values = _base(df, plan, bound, parts, audited)
    thin, thick = (base.select(*[quoted(c) for c in base.columns if (c in wide) == is_wide]) for is_wide in (False, True))
    filled = ~F.col("token")
    tally = lambda condition: F.sum(F.when(condition, F.col("count")).otherwise(0))
    tallies = lambda cells: cells.groupBy("column").agg(
        F.sum("count").alias("all"),
        tally(F.col("token")).alias("tokens"),
        tally(filled).alias("present"),
        tally(filled & F.col("text").rlike(COMPOSITE_PATTERN)).alias("composite"),
        tally(filled & F.col("number").isNotNull()).alias("number"),
        tally(filled & F.col("time").isNotNull()).alias("time"),
        F.count("text").alias("texts"),
        F.sum(F.octet_length("text")).alias("bytes"),
    )
    per_column = tallies(values)
    if by_row := [c for c in thick.columns if c in plan.texts]:
        per_column = per_column.unionByName(tallies(read_cells(thick.select(*[quoted(c) for c in by_row]))).filter(F.col("column") != ROWS))
    seen = {r["column"]: r for r in per_column.collect()}
    rows = seen[ROWS]["all"] if ROWS in seen else 0
    if config.remove_duplicates and (removed := df.count() - rows):
        plan.log.append(LogEntry("deduplicate", None, "removed duplicate rows", removed))

    def share(kind, c):
        return seen[c][kind] / seen[c]["present"] if c in seen and seen[c]["present"] else 0.0

    for c in plan.texts:
        if c in seen and seen[c]["tokens"]:
            plan.log.append(LogEntry("null_tokens", c, "null tokens set to null", seen[c]["tokens"]))
    for c in plan.texts:
        if config.decompose_composites and plan.composite is None and share("composite", c) > COMPOSITE_SHARE:
            plan.composite = c
            plan.log.append(LogEntry("composite", c, "split into two numbers", seen[c]["composite"]))
        elif config.clean_dirty_numerics and share("number", c) > TYPE_SHARE:
            plan.numbers.append(c)
            plan.log.append(LogEntry("number", c, "text converted to numbers", seen[c]["number"]))
        elif config.parse_dates and share("time", c) > TYPE_SHARE:
            plan.dates.append(c)
            plan.log.append(LogEntry("date", c, "text converted to timestamps", seen[c]["time"]))
    if config.standardize_text:
        rest = [c for c in plan.texts if c != plan.composite and c not in plan.numbers and c not in plan.dates]
        named = [c for c in rest if not is_key_name(c)]  # keys must go on matching other tables
        likes = category_like(values, [c for c in named if c not in wide], rows) + category_like_by_row(thick, [c for c in named if c in wide], rows)
        plan.titles = [c for c in named if c in likes]
        for c in rest:
            detail = "whitespace collapsed, title case" if c in plan.titles else "whitespace collapsed"
            plan.log.append(LogEntry("text", c, detail, None))

    plan.few = [c for c in plan.texts if c in thin.columns and c in seen and seen[c]["texts"] <= LOOKUP_VALUES and seen[c]["bytes"] <= LOOKUP_BYTES]
    plan.known = stage(values.filter(F.col("column").isin(*plan.few)).select("column", "text"), "known") if plan.few else None

    out = plan.typed(base)
    by_row = plan.typed(thick)
    kept = [c for c in by_row.columns if c in numeric_columns(by_row)]
    texts = [c for c in text_columns(by_row) if not is_key_name(c)] if config.impute_missing else []
    many = stage(by_row.select(*[number(by_row, c).alias(c) for c in kept]), "cleaned-rows") if kept else None
    cleaned = Values(stage(_cleaned_values(values, thin, plan), "cleaned-values"), many, kept, by_row.select(*[quoted(c) for c in texts]), texts)
    # A missing date is no weekend, so the weekend flag has no gaps and is outside the outlier scope.
    numbers = [c for c in numeric_columns(out) if not c.endswith("_IsWeekend") or c in df.columns]
    found = None
    if config.treat_outliers:
        found = find_outliers(cleaned, numbers, config.outlier_strategy)
        plan.clips = found.clips
        for c, n in found.counts.items():
            plan.log.append(LogEntry("outliers", c, config.outlier_strategy, n))
    if config.impute_missing and rows:
        fills, filled_in = numeric_fills(cleaned, numbers, rows, config.numeric_impute_strategy, found)
        more, more_filled = categorical_fills(cleaned, text_columns(out), rows, config.categorical_impute_strategy)
        plan.fills = {**fills, **more}
        for c, n in {**filled_in, **more_filled}.items():
            plan.log.append(LogEntry("impute", c, f"missing values set to {plan.fills[c]}", n))
    return plan, base


def clean(
    df: DataFrame, config: CleaningConfig | None = None, parts: Parts | None = None, audited: Audit | None = None
) -> tuple[DataFrame, CleaningPlan]:
    """The cleaned table (staged) and the plan that produced it; ``fit`` alone gives the plan."""
    plan, base = fit(df, config, parts=parts, audited=audited)
    return stage(plan.apply_fitted(base), "cleaned"), plan
