"""Versioned stages: whole or not at all, typed errors, counts of committed files, release."""

import os
import subprocess
import sys

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from vigil.sources.sinks import (StageEmpty, StageMissing, delete_folder, read_stage, release, stage_counts, stage_path,
                                 stage_versions, write_stage)

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _alerts(spark, n, level="ATTACK"):
    return spark.range(n, numPartitions=3).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "CLEAN").otherwise(level).alias("alert_level"))


def test_a_broken_write_leaves_the_former_version(spark, tmp_path):
    root = str(tmp_path)
    write_stage(_alerts(spark, 10), root, "alerts")
    first = read_stage(spark, root, "alerts")
    broken = _alerts(spark, 20).withColumn("x", F.raise_error(F.concat(F.lit("row "), F.col("seq").cast("string"))))
    with pytest.raises(Exception, match="row"):
        write_stage(broken, root, "alerts")
    assert read_stage(spark, root, "alerts").count() == 10
    # files without a manifest (a driver that died before the end) are no version either
    _alerts(spark, 99).write.parquet(f"{root}/alerts/v000007")
    assert read_stage(spark, root, "alerts").count() == 10 and stage_versions(spark, root, "alerts") == [1]
    write_stage(_alerts(spark, 30), root, "alerts")
    assert stage_versions(spark, root, "alerts") == [1, 8] and read_stage(spark, root, "alerts").count() == 30
    assert first.count() == 10 and read_stage(spark, root, "alerts", version=1).count() == 10
    gone = release(spark, root, "alerts")
    assert sorted(os.listdir(f"{root}/alerts")) == ["v000008"] and len(gone) >= 3
    assert read_stage(spark, root, "alerts").count() == 30 and release(spark, root, "alerts") == []


def test_missing_is_told_from_other_errors(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(StageMissing):
        read_stage(spark, root, "graph_nodes")
    write_stage(_alerts(spark, 0), root, "graph_nodes")
    with pytest.raises(StageEmpty):
        read_stage(spark, root, "graph_nodes", require_rows=True)
    assert read_stage(spark, root, "graph_nodes").count() == 0
    write_stage(_alerts(spark, 4), root, "alerts")
    path = stage_path(spark, root, "alerts")
    for folder, _, files in os.walk(path):
        for f in files:
            if f.endswith(".parquet"):
                with open(os.path.join(folder, f), "wb") as out:
                    out.write(b"no parquet")
    with pytest.raises(Exception) as error:  # a damaged stage is not a missing one
        read_stage(spark, root, "alerts").count()
    assert not isinstance(error.value, StageMissing)
    delete_folder(spark, path)
    with pytest.raises(StageMissing):
        read_stage(spark, root, "alerts")
    assert issubclass(AnalysisException, Exception)


def test_counts_of_a_written_stage(spark, tmp_path):
    root = str(tmp_path)
    write_stage(_alerts(spark, 31), root, "alerts", counted=True)
    counts = stage_counts(spark, root, "alerts")
    got = counts.groupBy(F.col("part_values")["alert_level"].alias("v")).agg(F.sum("rows").alias("n")).collect()
    assert {r.v: r.n for r in got} == {"CLEAN": 11, "ATTACK": 20}
    assert counts.count() == len({(r.file, str(r.part_values)) for r in counts.collect()}) == 6
    write_stage(spark.range(5), root, "plain", counted=True)
    assert stage_counts(spark, root, "plain").agg(F.sum("rows")).first()[0] == 5


def test_scratch_tables_go_with_their_scope(spark):
    from vigil.operators.sizing import written_table
    from vigil.session import scratch_scope
    with scratch_scope(spark):
        inner = written_table(spark.range(7), "scope-test")
        path = inner.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
        assert inner.count() == 7 and os.path.isdir(path)
    assert not os.path.exists(path)
    kept = written_table(spark.range(3), "scope-test")
    assert kept.count() == 3


FAILING = """
import sys
sys.path.insert(0, {root!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.functions import udf
from vigil.session import build_session
spark = build_session("local[2,3]", 2, driver_memory="1g")
from vigil.plans.pipeline import integrity_counts
from vigil.operators.normalize import normalize
from vigil.sources.sinks import read_stage, write_stage
from vigil.sources.telemetry import telemetry

t = telemetry(spark, "/root/testdata/sf0.001")

@udf("string")
def fail_once(x):
    c = TaskContext.get()
    if c.attemptNumber() == 0 and x == "LOG-000777" and {fail}:
        raise RuntimeError("lost")
    return None if x == "LOG-000005" else x

logs = t.logs.withColumn("log_id", fail_once("log_id"))
write_stage(normalize(logs, t.registry, t.schema_versions).marked, {out!r}, "normalized_logs", counted=True)
print("COUNTS", tuple(integrity_counts(spark, {out!r}).first()), read_stage(spark, {out!r}, "normalized_logs").count())
"""


def test_a_retried_task_counts_once(tmp_path):
    """A task that fails after most of its rows, and is run again, changes no count."""
    got = []
    for fail in (False, True):
        code = FAILING.format(root=ROOT, out=str(tmp_path / str(fail)), fail=fail)
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
        lines = [x for x in out.stdout.splitlines() if x.startswith("COUNTS")]
        assert lines, out.stderr[-2000:]
        assert ("lost" in out.stderr) == fail
        got += lines
    assert got[0] == got[1] == "COUNTS (1000, 999, 1) 1000"
