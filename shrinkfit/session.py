"""Session defaults and the shared scratch location for materialised tables.

Nothing here creates a cluster-specific setting behind the user's back: the
only session values we set are the ones the engine's semantics depend on
(UTC session time zone, ANSI stays on) and a checkpoint directory *only when
the session has none* (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession

_CHECKPOINT_CONF = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings the engine relies on; idempotent."""
    # Date parts (rating_year, %w, %W) are defined in UTC, like the oracle.
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # AQE re-plans joins (broadcast / skew split) from runtime sizes.
    if spark.conf.get("spark.sql.adaptive.enabled", "true") != "true":
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get(_CHECKPOINT_CONF, None) or sc.getConf().get(_CHECKPOINT_CONF, None)
    if not conf:
        # Unset: local mode / tests only; executors elsewhere would each write their own disk.
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError(f"{_CHECKPOINT_CONF} must name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="shrinkfit-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


#: Compression of written tables as long as the ratings and as wide: less to write than the session's, read often.
WIDE_CODEC = "zstd"

#: Folders that ``materialize`` wrote, by application.
_WRITTEN: dict[str, list[str]] = {}


def register_written(spark: SparkSession, path: str) -> None:
    """Have ``delete_written`` delete this folder too."""
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)


def written(spark: SparkSession) -> list[str]:
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def delete_written(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete folders that this application's ``materialize`` wrote (all of them by default), on whatever file system they
    are. Frames that read them can't be used afterwards."""
    own = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in [p for p in own if paths is None or p in paths]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        own.remove(path)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None, codec: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Cuts lineage (executor loss no longer replays the chain that built it),
    and the re-read relation has exact file sizes, column pruning and
    filter pushdown. ``partition_by`` turns a later filter on those columns
    into partition pruning (whole directories skipped). ``codec`` replaces the session's Parquet compression.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark)
    path = os.path.join(base, "shrinkfit", f"{name}-{uuid.uuid4().hex[:12]}")
    register_written(spark, path)
    writer = df.write.mode("overwrite")
    write_partitioned(writer.option("compression", codec) if codec else writer, spark, path, partition_by)
    # The schema is known: nothing is inferred, a table without rows (no partition folder) reads back too.
    out = spark.read.schema(df.schema).parquet(path)
    return out.select(*df.columns) if partition_by else out


_WRITERS_CONF = "spark.sql.maxConcurrentOutputFileWriters"
#: Partition folders that a task writes at once, before it sorts its rows by them.
WRITERS = 8


def write_partitioned(writer: DataFrameWriter, spark: SparkSession, path: str, partition_by: list[str] | None) -> None:
    """Write Parquet; for partition columns of few values a task holds a file open for each, so its rows needn't be sorted in memory."""
    if not partition_by:
        writer.parquet(path)
        return
    before = spark.conf.get(_WRITERS_CONF, None)
    spark.conf.set(_WRITERS_CONF, str(max(WRITERS, int(before or 0))))
    try:
        writer.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.unset(_WRITERS_CONF) if before is None else spark.conf.set(_WRITERS_CONF, before)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "shrinkfit", event_log_dir: str | None = None) -> SparkSession:
    """Session for tests, bench and local runs (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SHRINKFIT_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
