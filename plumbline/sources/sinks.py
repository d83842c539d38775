"""Writing cleaned tables, whole models, summaries and the run log."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F, types as T

from plumbline.operators.cleaning import clean
from plumbline.operators.columns import type_name
from plumbline.plans.model import Model, unify

RUN_LOG_SCHEMA = (
    "run_id string, user_id bigint, dataset string, records bigint, health_score double, action string, "
    "created_at timestamp"
)
HISTORY_LENGTH = 30


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers, written by all executors."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def cleaned_or_unified(cleaned: DataFrame | None, raw: DataFrame | None, model: Model | None) -> DataFrame:
    """What an export holds: the cleaned table, else the raw one, else the model unified and cleaned."""
    if cleaned is not None:
        return cleaned
    if raw is not None:
        return raw
    if model is None or not model.tables:
        raise ValueError("nothing to export")
    return clean(unify(model))[0]


def _write_counted(df: DataFrame, path: str) -> tuple[T.StructType, int]:
    seen = Observation()
    write_csv(df.observe(seen, F.count(F.lit(1)).alias("rows")), path)
    return df.schema, seen.get["rows"]


def export_model(model: Model, path: str, name: str = "model") -> DataFrame:
    """Every table cleaned, the unified table cleaned, and a manifest of all of them.

    Layout: ``tables/cleaned_<name>``, ``unified_model``, ``manifest``. Returns the manifest: one row
    per table with its row count, columns and types, and the relationships. Rows are counted while they are
    written.
    """
    spark = next(iter(model.tables.values())).sparkSession
    root = path.rstrip("/")
    written = {}
    for table, df in model.tables.items():
        written[table] = _write_counted(clean(df)[0], f"{root}/tables/cleaned_{table}")
    written["unified_model"] = _write_counted(clean(unify(model))[0], f"{root}/unified_model")

    edges = [f"{r.from_table}.{r.from_col} -> {r.to_table}.{r.to_col} ({r.cardinality})" for r in model.relationships]
    rows = []
    for table, (schema, count) in written.items():
        types = {f.name: type_name(f.dataType) for f in schema}
        rows.append((name, table, count, [f.name for f in schema], types, edges))
    manifest = spark.createDataFrame(
        rows,
        "dataset string, table string, rows bigint, columns array<string>, types map<string,string>, "
        "relationships array<string>",
    )
    manifest.coalesce(1).write.mode("overwrite").json(f"{root}/manifest")
    return manifest


def export_summary(
    path: str, title: str, df: DataFrame, numeric_stats: DataFrame, table_audit: DataFrame, model: Model | None = None
) -> DataFrame:
    """An analytical summary as one JSON document: counts, columns, health, numeric statistics, model."""
    stats = numeric_stats.agg(F.collect_list(F.struct(*numeric_stats.columns)).alias("numeric_stats"))
    head = table_audit.select(
        F.lit(title).alias("title"),
        F.col("total_rows").alias("total_records"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        "health_score",
        F.array(*[F.lit(t) for t in (model.tables if model else {})]).cast("array<string>").alias("tables"),
    )
    # One row on either side: the statistics hold a row per column.
    summary = head.join(stats)
    summary.coalesce(1).write.mode("overwrite").json(path)
    return summary


def record_run(
    spark: SparkSession, path: str, user_id: int, dataset: str, records: int, health_score: float,
    action: str = "Analyzed Dataset",
) -> None:
    """Append one entry to the run log."""
    row = (uuid.uuid4().hex, user_id, dataset, records, health_score, action)
    entry = spark.createDataFrame([row], RUN_LOG_SCHEMA.rsplit(",", 1)[0]).withColumn("created_at", F.current_timestamp())
    append_runs(entry.coalesce(1), path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Append entries (columns of the run log) as one batch.

    The log is two folders of immutable files: ``runs``, each row with the batch that brought it, and ``cleared``, which
    names users and batches that no longer count. Every write has a folder of its own in them, so appends and
    clearings may run side by side.
    """
    columns = [part.split()[0] for part in RUN_LOG_SCHEMA.split(",")]
    batch = uuid.uuid4().hex
    runs.select(*columns, F.lit(batch).alias("batch")).write.parquet(f"{path}/runs/part={batch}")


def read_runs(spark: SparkSession, path: str, user_id: int | None = None) -> DataFrame:
    """The entries that count, of one user or of all."""
    log = _log_part(spark, f"{path}/runs", f"{RUN_LOG_SCHEMA}, batch string")
    gone = _log_part(spark, f"{path}/cleared", "user_id bigint, batch string")
    if user_id is not None:
        log, gone = (part.filter(F.col("user_id") == user_id) for part in (log, gone))
    return log.join(gone, ["user_id", "batch"], "left_anti")


def _log_part(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).drop("part")


def run_history(spark: SparkSession, path: str, user_id: int, limit: int = HISTORY_LENGTH) -> DataFrame:
    """A user's latest runs. The filter reaches the files, whose statistics leave out most of them after ``compact_log``."""
    latest = read_runs(spark, path, user_id).orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)
    return latest.select("run_id", "dataset", "records", F.round("health_score", 1).alias("health_score"), "action", "created_at")


def latest_runs(log: DataFrame, limit: int = HISTORY_LENGTH) -> DataFrame:
    """The latest runs of every user: the rank filter keeps ``limit`` rows per user and task."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    ranked = log.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= limit)
    return ranked.select("user_id", "place", "run_id", "dataset", "records", F.round("health_score", 1).alias("health_score"), "action")


def clear_history(spark: SparkSession, path: str, user_id: int) -> DataFrame:
    """Take a user's runs out of the log; returns what is left.

    Only the batches of that user are noted, so nothing is rewritten, and runs that arrive meanwhile stay.
    """
    seen = read_runs(spark, path, user_id).select("user_id", "batch").distinct()
    seen.write.parquet(f"{path}/cleared/part={uuid.uuid4().hex}")
    return read_runs(spark, path).drop("batch")


def compact_log(spark: SparkSession, path: str, target: str) -> None:
    """The log's entries that count in a new folder: few large files, sorted by user, nothing cleared.

    Batches keep their names, so a clearing that was noted in the old log meanwhile can be noted in the new one.
    """
    kept = read_runs(spark, path).repartitionByRange("user_id", "created_at").sortWithinPartitions("user_id", "created_at")
    kept.write.parquet(f"{target}/runs/part={uuid.uuid4().hex}")
