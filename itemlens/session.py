"""Session helpers.

Library functions never create sessions: the caller owns the session.
``build_session`` exists for tests and the bench; the command line takes the
session that ``spark-submit`` configures.  Shared scratch space (for round
trips, artefacts and lineage cuts) lives under the cluster's
``spark.checkpoint.dir``; a local one is only created on a local master that
has none configured.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF: dict[str, str] = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = "local[*]",
    shuffle_partitions: int | None = 8,
    app_name: str = "itemlens",
    driver_memory: str | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the library's settings; ``master`` and ``shuffle_partitions``
    None leave both to the environment (``spark-submit``, ``spark-defaults``)."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder.

    With none configured, a temporary one is set on a local master; on a
    cluster this fails, since executors would write to their own disks.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not _one_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="itemlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _scratch_root(spark: SparkSession) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/itemlens-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """(path object, its file system): the driver's view of a shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def clear_scratch(spark: SparkSession) -> None:
    """Delete this session's scratch tables (call once no result reads them)."""
    path, fs = hadoop_path(spark, _scratch_root(spark))
    fs.delete(path, True)


#: Rows that a task holds at once in a sort or a hash table.
TASK_ROWS = 1_000_000


def partitions_for(spark: SparkSession, rows: int, task_rows: int = TASK_ROWS) -> int | None:
    """The number of partitions (more than the session's shuffle partitions) by which
    ``rows`` fit their tasks; None if they fit one.

    For steps whose shuffled bytes are small against what a task makes of them: there
    the session's partitions are too few on large tables, or are put together (with
    the session's own number Spark would take a shuffle before it instead, and do so).
    """
    if rows <= task_rows:
        return None
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")) + 1, -(-rows // task_rows))


def materialize(df, name: str):
    """Write ``df`` once as parquet under the shared checkpoint folder and
    return a DataFrame reading it back.

    This cuts lineage like ``checkpoint()`` but computes the input only once
    (an eager checkpoint of an unpersisted plan computes it twice), and later
    reads get column pruning and filter pushdown.  Lost executors re-read the
    files instead of recomputing upstream stages.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
