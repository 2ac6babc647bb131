"""Spark session and shared scratch locations.

Every job in this package is a lazy DataFrame plan; the session only sets
the knobs that matter for those plans (AQE, UTC, Arrow) and never starts
the web UI.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # 256 MiB input splits and post-shuffle partitions: at 100 TB about
    # 400k scan tasks, each far below executor memory; AQE coalesces small
    # shuffle partitions and splits skewed ones around this size
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoints of pinned top-k results are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "vaultline",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is; without it a job can't start, since executors could not read what
    the driver's disk holds. Only a local master (tests) gets a folder here.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="vaultline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


_SCRATCH: dict[str, set[str]] = {}  # by application, so that nothing outlives its session


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never-reused folder under the shared checkpoint root."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/vaultline/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return path


def cleanup_scratch(spark: SparkSession) -> int:
    """Delete every scratch folder this application made. Call it when no
    result that reads one is needed any more; returns how many there were."""
    paths = _SCRATCH.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


__all__ = ["get_session", "ensure_checkpoint_dir", "scratch_path", "cleanup_scratch"]
