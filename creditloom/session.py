"""Spark session defaults for the engine.

On a cluster the session and its settings come from the launcher, and
``ensure_defaults`` only sees to the checkpoint folder; SESSION_DEFAULTS are
what ``build_session`` sets for local runs, and what launchers are advised to set.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC text/time semantics and AQE so joins
# against aggregated (data-derived) sides are re-planned from measured sizes.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # AQE converts a sort-merge join to a broadcast join only when the
    # shuffle stage of one side actually measured below this size.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # keyed state with timers (streaming admission) lives in RocksDB
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "creditloom") -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CREDITLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_defaults(spark)
    return spark


def ensure_defaults(spark: SparkSession) -> SparkSession:
    """Prepare a caller's session without overriding its settings: results do
    not depend on the session time zone (wall-clock columns are
    TIMESTAMP_NTZ and converted zone-free), so only the checkpoint folder
    is ensured."""
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster configured.

    Only in local mode, where driver and executors are one process, a private
    scratch folder is made if none is configured. On a cluster each executor
    would write such a folder to its own disk, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="creditloom-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table that :func:`cut_lineage` or a stage wrote; one that is gone is no error."""
    files, where = _file_system(spark, path)
    files.delete(where, True)


def new_table_path(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder, removed when the driver ends."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/creditloom-tables/{uuid.uuid4().hex}"
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    return path


def cut_lineage(df, compression: str = "snappy"):
    """Materialise ``df`` as a parquet table under the cluster's shared
    checkpoint folder (``spark.checkpoint.dir``) and return a DataFrame that
    reads it back.

    Compared with an RDD checkpoint the copy is columnar and compressed, and
    later readers get column pruning and filter push-down; lost executors
    re-read the files instead of recomputing the lineage. Never local. The
    table is removed when the driver ends. Tables of whole texts take
    ``compression="zstd"`` to spare disk.
    """
    spark = df.sparkSession
    path = new_table_path(spark)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
