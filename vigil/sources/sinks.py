"""Stage sinks and readers (SNK1, SNK2, SRC6).

Every write of a stage goes to a folder of its own, ``<root>/<stage>/v000007``.
The stage changes only when the write is done and its manifest, a small file
``<root>/_manifest/<stage>/v000007.json`` that appears by a rename, names that
folder: a write that is killed half-way leaves the former version readable, and
readers of the former version are not disturbed.  ``release`` deletes
superseded versions and what unfinished writes left.

A counted stage also gets a side table of row counts, one per data file and
partition value, written before the manifest.  They are read from the files
that Spark's writer committed, so a retried or speculative task counts once.

Alerts are partitioned by ``alert_level`` so level-filtered reads prune
partitions.  Reads raise typed errors for a missing or empty stage; any other
error passes through.  One writer per stage at a time is assumed.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = ("normalized_logs", "integrity_summary", "alerts", "metrics", "graph_logs", "graph_nodes",
          "graph_edges", "fingerprints", "node_fingerprint_counts", "command_node")
PARTITIONING = {"alerts": ["alert_level"], "normalized_logs": ["dropped"]}
COUNTS = "file string, part_values map<string,string>, rows long"


class StageMissing(LookupError):
    """The stage was never written (run the pipeline first)."""


class StageEmpty(LookupError):
    """The stage exists but holds no rows."""


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, hadoop = _file_system(spark, path)
    fs.delete(hadoop, True)


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, hadoop = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(hadoop)) if fs.exists(hadoop) else []


def _stage_root(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}"


def _manifest_root(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/_manifest/{name}"


def _numbers(names: list[str], ending: str = "") -> list[int]:
    return sorted(int(m.group(1)) for n in names if (m := re.fullmatch(rf"v(\d{{6,}}){ending}", n)))


def stage_versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """Finished versions of a stage, oldest first."""
    return _numbers(_children(spark, _manifest_root(root, name)), r"\.json")


def _version_path(root: str, name: str, version: int) -> str:
    return f"{_stage_root(root, name)}/v{version:06d}"


def stage_path(spark: SparkSession, root: str, name: str) -> str:
    """Folder of the stage's latest version."""
    versions = stage_versions(spark, root, name)
    if not versions:
        raise StageMissing(f"{name}: not found under {root}")
    return _version_path(root, name, versions[-1])


def _publish(spark: SparkSession, path: str, content: dict) -> None:
    """A small file that appears whole or not at all."""
    fs, target = _file_system(spark, path)
    _, draft = _file_system(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if not fs.rename(draft, target):
        raise FileExistsError(f"{path}: another writer made this version")


def write_stage(df: DataFrame, root: str, name: str, counted: bool = False) -> str:
    """Write the next version of a stage; it is the one read once this returns."""
    spark = df.sparkSession
    manifests = _manifest_root(root, name)
    # a folder that an unfinished write left is not used again
    version = max([0, *_numbers(_children(spark, _stage_root(root, name))), *stage_versions(spark, root, name)]) + 1
    path = _version_path(root, name, version)
    by = [c for c in PARTITIONING.get(name, []) if c in df.columns]
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    if counted:
        values = F.create_map(*[x for c in by for x in (F.lit(c), F.col(c).cast("string"))]) if by else F.lit(None)
        (spark.read.schema(df.schema).parquet(path).groupBy(F.col("_metadata.file_name").alias("file"), *by)
         .agg(F.count(F.lit(1)).alias("rows")).select("file", values.cast("map<string,string>").alias("part_values"), "rows")
         .write.parquet(f"{manifests}/v{version:06d}.counts"))
    _publish(spark, f"{manifests}/v{version:06d}.json", {"version": version, "folder": path, "partition_by": by, "counted": counted})
    return path


def read_stage(spark: SparkSession, root: str, name: str, require_rows: bool = False, version: int | None = None) -> DataFrame:
    """The latest version of a stage, or a given one."""
    path = stage_path(spark, root, name) if version is None else _version_path(root, name, version)
    try:
        df = spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise StageMissing(f"{name}: not found under {root}") from exc
        raise
    if require_rows and df.isEmpty():
        raise StageEmpty(f"{name}: no rows")
    return df


def stage_counts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The side table of a counted stage's latest version: file, part_values, rows."""
    version = int(stage_path(spark, root, name).rsplit("/v", 1)[1])
    return spark.read.schema(COUNTS).parquet(f"{_manifest_root(root, name)}/v{version:06d}.counts")


def release(spark: SparkSession, root: str, name: str, keep: int = 1) -> list[str]:
    """Delete all but the ``keep`` latest versions of a stage and what unfinished writes left; the deleted paths."""
    kept = {f"v{v:06d}" for v in stage_versions(spark, root, name)[-max(1, keep):]}
    gone = []
    for base in (_manifest_root(root, name), _stage_root(root, name)):  # a manifest never names a deleted folder
        for child in _children(spark, base):
            if child.split(".")[0] not in kept:
                delete_folder(spark, f"{base}/{child}")
                gone.append(f"{base}/{child}")
    return gone


def total_nodes(registry: DataFrame) -> DataFrame:
    """Registry row count (SRC6)."""
    return registry.agg(F.count(F.lit(1)).alias("total_nodes"))
