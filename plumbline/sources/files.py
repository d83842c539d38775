"""Reading delimited text and JSON, and several files as one model."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.plans.model import Model, discover

# Delimiters in order of preference.
DELIMITERS = (",", "\t", ";", "|")
_RAW = "__raw"


def _held(sep: str, line: Column) -> Column:
    """How often a one-character separator stands in a line outside double quotes."""
    bare = F.regexp_replace(line, '"(?:[^"]|"")*"', "")
    return F.length(bare) - F.length(F.translate(bare, sep, ""))


def describe_lines(lines: DataFrame, header: str | None) -> tuple[str, str]:
    """Delimiter and encoding of a text table, from one aggregation over all of its lines (``value``).

    The encoding is UTF-8 if every line is valid in it, else ISO-8859-1, in which every byte is a character. A delimiter must
    stand in the header and, as often as there, in at least half of the non-blank lines; the one with most such lines
    wins, then the one most frequent in the header, then the order of preference. Default: comma.
    """
    value = F.col("value")
    wanted = {d: len(re.sub(r'"(?:[^"]|"")*"', "", header or "").split(d)) - 1 for d in DELIMITERS}
    filled = F.trim(value) != ""
    found = lines.agg(
        F.count_if(~F.is_valid_utf8(value)).alias("invalid"), F.count_if(filled).alias("lines"),
        *[F.count_if(filled & (_held(d, value) == n)).alias(f"d{i}") for i, (d, n) in enumerate(wanted.items())],
    ).first()
    agreeing = {d: found[f"d{i}"] for i, d in enumerate(wanted) if wanted[d] and 2 * found[f"d{i}"] >= found["lines"]}
    best = max(agreeing, key=lambda d: (agreeing[d], wanted[d]), default=DELIMITERS[0])
    return best, "ISO-8859-1" if found["invalid"] else "UTF-8"


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None, multi_line: bool = False
) -> DataFrame:
    """A text table with a header, every column as string.

    Delimiter and encoding come from all lines unless given (see ``describe_lines``). Rows with more fields than the
    header are left out, also if the further fields are empty; short rows are padded with nulls. ``multi_line`` allows
    line breaks inside quotes; such a file cannot be split among tasks.
    """
    if sep is None or encoding is None:
        lines = spark.read.text(path)
        first = lines.first()
        found = describe_lines(lines, first["value"] if first else None)
        sep, encoding = sep or found[0], encoding or found[1]
    reader = spark.read.option("sep", sep).option("encoding", encoding).option("multiLine", multi_line)
    names = reader.option("header", True).csv(path).columns
    # A row whose number of fields differs from the header's comes with its text; to see that, whole rows are parsed.
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _RAW]])
    rows = reader.option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", _RAW).option("columnPruning", False).schema(schema).csv(path)
    fits = F.col(_RAW).isNull() | (_held(sep, F.col(_RAW)) < len(names))
    some = F.length(F.coalesce(F.col(f"`{names[0]}`"), F.lit(""))) >= 0  # a scan of the text alone is refused
    return rows.filter(fits & some).drop(_RAW).toDF(*[n.lstrip("\ufeff") for n in names])


def read_lines(lines: DataFrame, sep: str | None = None) -> DataFrame:
    """A text table from a DataFrame of lines (``value``) whose ``position`` 0 is the header."""
    header = lines.filter(F.col("position") == 0).first()["value"]
    sep = sep or describe_lines(lines, header)[0]
    names = [n.strip() for n in header.split(sep)]
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = lines.filter((F.col("position") > 0) & (_held(sep, F.col("value")) < len(names)))
    return rows.select(F.from_csv("value", F.lit(schema), {"sep": sep}).alias("row")).select("row.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array document, or one JSON object per line."""
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    return spark.read.json(path, multiLine=first is not None and first["value"].strip().startswith("["))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """Read by file extension: JSON, Parquet, or delimited text."""
    low = path.lower().rstrip("/")
    if low.endswith(".json"):
        return read_json(spark, path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_delimited(spark, path)


def table_name(path: str) -> str:
    stem = os.path.basename(path.rstrip("/"))
    return re.sub(r"\.[A-Za-z0-9]+$", "", stem).replace(" ", "_")


def ingest(
    spark: SparkSession, paths: list[str], model: Model | None = None, clear: bool = False, relate: bool = True
) -> tuple[Model, DataFrame | None]:
    """Register files as tables of a model and look for relationships once at the end.

    With ``relate=False`` (more files to come) the search is left to a later call. Empty files add no
    table.
    """
    model = Model() if model is None else model
    if clear:
        model.clear()
    for path in paths:
        df = read_file(spark, path)
        if df.columns and not df.isEmpty():
            model.add(table_name(path), df)
    return model, discover(model) if relate and model.tables else None
