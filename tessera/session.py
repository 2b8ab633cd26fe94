"""Session construction and the shared scratch location.

On a cluster the scratch location is the folder named by ``spark.checkpoint.dir``
(shared storage such as HDFS or an object store), which Spark applies when the context
starts.  We only set our own when the session has none, as in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


BATCH_BYTES = 2 << 20


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tessera") -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    AQE is on so that partition counts coalesce at run time and skewed joins are split;
    the session time zone is UTC because stored timestamps are naive UTC.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # Many shuffle partitions, coalesced at run time by AQE, rather than a small fixed number.
    parts = shuffle_partitions or int(os.environ.get("TESSERA_SHUFFLE_PARTITIONS", "200"))
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Text stages are CPU-heavy per byte: keep coalesced partitions small enough to use all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Rows can carry whole documents: bound Arrow batches by bytes as well as by rows.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if os.environ.get("TESSERA_DRIVER_MEMORY"):   # else as the cluster sets it
        builder = builder.config("spark.driver.memory", os.environ["TESSERA_DRIVER_MEMORY"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on an Arrow batch to ``BATCH_BYTES``: a Python worker holds its batch several times over (as
    Arrow, as objects, as the result), in every Python step of a task.  A lower bound that the session has stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).lower().rstrip("b")
    if not held.lstrip("-").isdigit() or not 0 < int(held) <= BATCH_BYTES:   # "64m" and -1 (no bound) are above it
        spark.conf.set(name, str(BATCH_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; create a local one only when the session has none."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if not current:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
        if not configured:
            if not sc.master.startswith("local"):
                # A machine-local folder is not shared by executors: refuse rather than guess.
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
            _delete_at_exit(spark, configured)
        sc.setCheckpointDir(configured)
        current = sc.getCheckpointDir()
    return current


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Remove ``path`` and all below it when the application ends."""
    jvm = spark._jvm  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001
    fs.mkdirs(where)
    fs.deleteOnExit(where)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def make_folder(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)  # noqa: SLF001


_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local on a cluster).  All scratch
    folders of an application lie in one folder that goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessera-scratch-{uuid.uuid4().hex[:12]}"
        _delete_at_exit(spark, root)
        _SCRATCH[app] = root
    return f"{_SCRATCH[app]}/{name}-{uuid.uuid4().hex[:12]}"
