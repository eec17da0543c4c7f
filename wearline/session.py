"""SparkSession construction and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "wearline", cpus: int | str = "*", shuffle_partitions: int | None = None,
              extra: dict | None = None, master: str | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC time and the UI off.

    ``master`` names the cluster; without it, and where the submit environment names none, the
    session is local on ``cpus`` threads."""
    conf = dict(DEFAULT_CONF)
    conf.update(extra or {})
    builder = SparkSession.builder.appName(app)
    if master or "PYSPARK_GATEWAY_PORT" not in os.environ:  # set where spark-submit started this program
        builder = builder.master(master or f"local[{cpus}]")
        if not master:
            conf.setdefault("spark.sql.shuffle.partitions", str(shuffle_partitions or (8 if cpus == "*" else cpus)))
            conf.setdefault("spark.driver.memory", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared ``spark.checkpoint.dir``.

    On a cluster the setting names a shared folder and must be set. Only a local session
    (tests, single machine) gets a fresh scratch folder when it is unset.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        spark.sparkContext.setCheckpointDir(current)
        return current
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
    path = tempfile.mkdtemp(prefix="wearline-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


#: folders that this program has staged, by application, until they are cleared
_STAGED: dict[str, list[str]] = {}


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: one computation, cut lineage, files that
    survive a lost executor. Results that read it need the files; ``clear_staged`` removes them."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wearline-{label}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_so_far(spark: SparkSession) -> int:
    """A mark for ``clear_staged``: how many folders this application has staged."""
    return len(_STAGED.get(spark.sparkContext.applicationId, []))


def clear_staged(spark: SparkSession, since: int = 0) -> int:
    """Remove the folders staged by this application after the mark ``since``, once the results that read them have been written;
    returns their number. Nothing else in the shared folder is touched."""
    held = _STAGED.get(spark.sparkContext.applicationId, [])
    gone, held[since:] = held[since:], []
    for path in gone:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(gone)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on its own file system (the default one for a path without scheme)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scale_conf(input_bytes: int, executor_cores: int = 4, executor_memory_gb: int = 16,
               target_partition_mb: int = 256) -> dict:
    """Configuration sized for the input volume (e.g. 100 TB on a 1000-executor cluster).

    * shuffle partitions: input / target size, so a reducer holds ~``target_partition_mb``
      of shuffled data, capped at 200k (the driver tracks map output per reducer; at
      100 TB a reducer then holds ~0.5 GB); AQE coalesces small partitions and splits
      skewed ones at run time;
    * scan splits: ``maxPartitionBytes`` at the same target, so a task never reads more
      than that from parquet;
    * a task's share of execution memory (~60 % of the heap over the cores) is kept at
      several times the target size, so sorts and aggregations spill rarely;
    * skew join: a partition 5x the median and above 4x the target is split.
    """
    target = target_partition_mb * 1024 * 1024
    partitions = max(200, min(200_000, -(-int(input_bytes) // target)))
    per_task_mb = executor_memory_gb * 1024 * 0.6 / max(executor_cores, 1)
    if per_task_mb < 3 * target_partition_mb:
        target_partition_mb = max(64, int(per_task_mb // 3))
        target = target_partition_mb * 1024 * 1024
        partitions = max(200, min(200_000, -(-int(input_bytes) // target)))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": f"{target_partition_mb}m",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_partition_mb}m",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * target_partition_mb}m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
    }
