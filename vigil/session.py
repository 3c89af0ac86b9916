"""Session helpers.

Configuration a job needs regardless of cluster size: UTC session time zone
(timestamps are rendered as ISO-8601 UTC strings), AQE on (runtime
re-planning of joins, partition coalescing, skew splitting) and Arrow for the
few pandas-backed operators.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM never compiles a method of more than 8000 bytes: a span that needs one runs operator by operator instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # shuffle files go when the query that made them ends; stages are written tables, nothing reads them again
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # partitioned stages (a few partition values) are written without sorting the rows first
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "vigil", driver_memory: str | None = "8g") -> SparkSession:
    """Create (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable parts of SESSION_CONF to an existing session."""
    for key, value in SESSION_CONF.items():
        if key.startswith("spark.sql."):
            spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application: Python workers import it."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or any(f.endswith("/vigil-package.zip") for f in sc.listFiles):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="vigil-"), "vigil-package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("vigil", os.path.relpath(full, root)))
    sc.addPyFile(path)


_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new folder name under ``spark.checkpoint.dir`` for a table that only this run reads."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    for paths in _SCOPES:
        paths.append(path)
    return path


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete at the end the scratch tables made within; what is needed afterwards must be written elsewhere by then."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.pop()
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when it is unset on a local master (tests) do we pick a
    scratch folder: executors of a cluster do not share one.
    """
    configured = (spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
                  or spark.conf.get("spark.checkpoint.dir", None))
    if configured:
        spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local = tempfile.mkdtemp(prefix="vigil-ckpt-", dir=os.environ.get("VIGIL_SCRATCH", "/tmp"))
    spark.sparkContext.setCheckpointDir(local)
    return local
