"""Session helpers: one place that knows how a tillsight job wants Spark configured."""

from __future__ import annotations

import os
import tempfile
import threading
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every tillsight job relies on.  ANSI mode stays on: all coercions use try_*.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tillsight") -> SparkSession:
    """A local session for tests and the bench; clusters pass their own builder."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TILLSIGHT_DRIVER_MEMORY", "16g"))
        # single-host sizing: small row groups in written intermediates so scans use every core
        .config("spark.tillsight.materialize.rowGroupBytes", str(1 << 20))
        .config("spark.sql.files.openCostInBytes", str(1 << 20))
        # coalesce tiny shuffles into few tasks, keep several for large ones
        .config("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(4 << 20))
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    A local session (tests, bench) without one gets a scratch folder; on a cluster a
    machine-local folder would be lost to the other executors, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by the driver and the executors")
        configured = tempfile.mkdtemp(prefix="tillsight-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


_REMOVAL = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_REMOVING: dict[int, list] = {}  # per session: writes under way, and the setting before them


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, Spark removes the shuffle files of a query as it ends, and not when the driver's garbage is collected.

    It is for writes, whose files stand in for what was shuffled.  A query that does read removed files again runs the
    stages that wrote them again.
    """
    key = id(spark._jsparkSession)
    with _LOCK:
        held = _REMOVING.setdefault(key, [0, spark.conf.get(_REMOVAL, None)])
        held[0] += 1
        spark.conf.set(_REMOVAL, "true")
    try:
        yield
    finally:
        with _LOCK:
            held[0] -= 1
            if held[0] == 0:
                del _REMOVING[key]
                spark.conf.unset(_REMOVAL) if held[1] is None else spark.conf.set(_REMOVAL, held[1])


def scratch_table_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for an intermediate written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}"
