"""Spark session defaults and the shared checkpoint folder.

The engine never picks a machine-local folder on a cluster: the checkpoint
folder comes from ``spark.checkpoint.dir`` (set by the cluster). Only a
local-mode session without that setting (tests, a laptop) gets a fresh
folder under /tmp.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Parquet codec of the load step's stored and staged rows (about 60 % of the default's size).
COMPRESSION = "zstd"

# Settings every session of the engine wants. AQE re-plans joins and
# coalesces small shuffle partitions at runtime; skew-join splits hot keys.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files go once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def scale_conf(input_bytes: float, executor_cores: int = 4, executors: int = 1000,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings sized to the data, for a cluster session.

    Scan splits of ``target_partition_bytes``; an initial shuffle width that
    gives every shuffle partition about that much data at the largest stage
    (the whole input, conservatively), never fewer than the cluster's task
    slots; AQE then coalesces small partitions to the advisory size and
    splits skewed ones."""
    slots = executor_cores * executors
    width = max(slots, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(width),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(width),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    }


def get_session(master: str | None = None, app_name: str = "vitrine",
                shuffle_partitions: int | None = None,
                conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting it only when unset.

    Order: the folder already on the SparkContext, then the
    ``spark.checkpoint.dir`` setting, then (local mode only) a new /tmp
    folder. A cluster session without the setting is an error, because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif is_local(spark):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="vitrine-ckpt-", dir="/tmp"))
    else:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS, S3, ...) so checkpoints survive executor loss")
    return sc.getCheckpointDir()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A folder for intermediate tables, inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/vitrine/{name}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder, on whatever store it lies (nothing if it is absent)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)
