"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
# Largest generated method in bytes that the JVM still compiles; beyond it, Spark's generated code would be interpreted.
_COMPILED, _LIMIT = "8000", "spark.sql.codegen.hugeMethodLimit"


def get_session(master: str | None = None, app: str = "plumbline", **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew-join splitting)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, shared by all executors.

    Only a local session without that setting gets a temporary folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so the setting is required there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_scratch:
        _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="plumbline-")
    return _local_scratch[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the scratch folder that no other call will be given."""
    return f"{scratch_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the scratch folder and read it back.

    Used where several passes follow an expensive shuffle: lineage is cut, a lost executor costs no
    recomputation, and each later pass reads only the columns it needs. While it is written, projections too large for one
    compiled method run as many small ones: a cleaning's takes less than half the time.
    """
    path, conf = scratch_path(df.sparkSession, label), df.sparkSession.conf
    before = conf.get(_LIMIT)
    conf.set(_LIMIT, _COMPILED)
    try:
        df.write.parquet(path)
    finally:
        conf.set(_LIMIT, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(staged: DataFrame) -> DataFrame:
    """A staged table over at least as many partitions as there are cores.

    For compute-heavy iterations over few input splits; a large table has more splits than cores and
    is returned as it is.
    """
    cores = staged.sparkSession.sparkContext.defaultParallelism
    return staged if staged.rdd.getNumPartitions() >= cores else staged.repartition(cores)
