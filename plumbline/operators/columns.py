"""Column metadata: names, roles, lookup, schema and dictionary listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.operators.distinct import small_cardinalities

# Names that mark a surrogate or foreign key.
KEY_SUFFIXES = ("_id", "_key", "_code", "_uuid", "_fk", "_pk")
KEY_WORDS = ("id", "key", "code", "uuid", "fk", "pk")
DERIVED_SUFFIXES = ("_year", "_isweekend")


def is_key_name(name: str) -> bool:
    """True for a column that identifies rows: ``order_id``, ``id``, ``customer_id_old``."""
    low = name.lower()
    return low.endswith(KEY_SUFFIXES) or low in KEY_WORDS or "_id_" in low


def quoted(name: str) -> Column:
    """A column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def standardize_names(df: DataFrame) -> DataFrame:
    """Lower-case snake names and trimmed text."""
    renamed = df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])
    return renamed.withColumns({c: F.trim(quoted(c)) for c in text_columns(renamed)})


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def time_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as a double, with NaN read as missing."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    return c.cast("double")


def is_missing(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def metric_columns(df: DataFrame, more_than: int) -> list[str]:
    """Numeric columns that measure something: no keys, no calendar parts, more than a few values."""
    candidates = [
        c for c in numeric_columns(df) if not is_key_name(c) and not c.lower().endswith(DERIVED_SUFFIXES)
    ]
    counts = small_cardinalities(df, {c: number(df, c) for c in candidates}, more_than)
    return [c for c in candidates if counts[c] > more_than]


def dimension_columns(df: DataFrame, at_least: int = 2, at_most: int = 30) -> list[str]:
    """Text columns with few enough values to group by."""
    candidates = [c for c in text_columns(df) if not is_key_name(c)]
    counts = small_cardinalities(df, {c: quoted(c) for c in candidates}, at_most)
    return [c for c in candidates if at_least <= counts[c] <= at_most]


def column_roles(df: DataFrame, more_than: int = 4, at_most: int = 30) -> DataFrame:
    """One row per column: name, kind (numeric / categorical / datetime / other), metric and dimension flags."""
    metrics, dimensions = metric_columns(df, more_than), dimension_columns(df, 2, at_most)
    numeric, text, time = numeric_columns(df), text_columns(df), time_columns(df)

    def kind(c):
        return "numeric" if c in numeric else "categorical" if c in text else "datetime" if c in time else "other"

    rows = [(c, kind(c), is_key_name(c), c in metrics, c in dimensions) for c in df.columns]
    return df.sparkSession.createDataFrame(
        rows, "column string, kind string, is_key boolean, is_metric boolean, is_dimension boolean"
    )


def narrow_integers(df: DataFrame) -> DataFrame:
    """64-bit integer columns as 32-bit ones where every value fits."""
    longs = [f.name for f in df.schema if isinstance(f.dataType, T.LongType)]
    if not longs:
        return df
    row = df.agg(
        *[F.min(quoted(c)).alias(f"low{i}") for i, c in enumerate(longs)],
        *[F.max(quoted(c)).alias(f"high{i}") for i, c in enumerate(longs)],
    ).first()
    fits = [
        c
        for i, c in enumerate(longs)
        if row[f"low{i}"] is not None and row[f"low{i}"] >= -(2**31) and row[f"high{i}"] < 2**31
    ]
    return df.withColumns({c: quoted(c).cast("int") for c in fits})


def resolve(df: DataFrame, name: str, table: str | None = None) -> str:
    """The column of a joined model that ``name`` means.

    Order: ``table_name`` where the join renamed a clash, the exact name, the name in any case, a
    single column ending in ``_name``. Several such endings are an error.
    """
    columns = df.columns
    if table and f"{table}_{name}".lower() in [c.lower() for c in columns]:
        return next(c for c in columns if c.lower() == f"{table}_{name}".lower())
    if name in columns:
        return name
    same = [c for c in columns if c.lower() == name.lower()]
    if same:
        return same[0]
    endings = [c for c in columns if c.lower().endswith("_" + name.lower())]
    if len(endings) == 1:
        return endings[0]
    if endings:
        raise ValueError(f"column {name!r} is ambiguous: {', '.join(endings)}")
    raise ValueError(f"column {name!r} not found")


# Type names shown to users.
def type_name(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "INTEGER"
    if isinstance(dtype, T.FractionalType):
        return "DECIMAL"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "DATETIME"
    if isinstance(dtype, T.BooleanType):
        return "BOOLEAN"
    return "STRING"


def per_column(row: DataFrame, fields: list[list[Column]], names: list[str]) -> DataFrame:
    """Turn a one-row aggregate into one row per column, ``fields`` giving each row's values."""
    structs = [F.struct(*[value.alias(n) for value, n in zip(values, names)]) for values in fields]
    return row.select(F.inline(F.array(*structs)))


def schema_of(name: str, df: DataFrame, foreign: set[str] = frozenset(), primary: set[str] = frozenset()) -> DataFrame:
    """Column listing of one table with null counts, from one scan."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    fields = [
        [
            F.lit(name), F.lit(f.name), F.lit(type_name(f.dataType)), F.lit(f.name in foreign),
            F.lit(f.name in primary), F.col(f"n{i}"), F.col("rows"), F.lit(len(df.columns)),
        ]
        for i, f in enumerate(df.schema)
    ]
    names = ["table_name", "column_name", "type", "is_fk", "is_pk", "null_count", "total_rows", "total_cols"]
    return per_column(counted, fields, names)


def dictionary_of(name: str, df: DataFrame) -> DataFrame:
    """Data dictionary of one table; the sample value is the smallest, so that it is reproducible."""
    counted = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[_sample(f).alias(f"s{i}") for i, f in enumerate(df.schema)],
    )
    fields = [
        [
            F.lit(name), F.lit(f.name), F.lit(f.dataType.simpleString()), F.col("rows") - F.col(f"n{i}"),
            F.col(f"n{i}"), F.col(f"s{i}"),
        ]
        for i, f in enumerate(df.schema)
    ]
    names = ["table_name", "column_name", "data_type", "non_null_count", "null_count", "sample_value"]
    return per_column(counted, fields, names)


def _sample(f: T.StructField) -> Column:
    if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.min(F.to_json(quoted(f.name)))
    return F.min(quoted(f.name)).cast("string")
