"""Pipeline stages over the driver tables, with lineage cut at each boundary.

``Stages(spark, sf_dir)`` exposes every intermediate DataFrame of the
pipeline (normalized -> detected -> graph logs -> edges/nodes -> clusters ->
candidates -> command node).  Inside a stage the plan is declarative, so
Catalyst prunes columns and pushes filters into the parquet scans.

Stages read by several downstream branches are written as parquet tables
under ``spark.checkpoint.dir`` (shared storage on a cluster) and read back.
That keeps every downstream plan small -- a self-joined or subqueried stage
is a leaf instead of a copy of the whole upstream tree -- and a lost
executor only re-reads checkpoint files instead of recomputing the
pipeline.  A written stage belongs to its ``Stages`` object: another object
reads its inputs anew.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from vigil.operators import attribution as att
from vigil.operators import fingerprint as fpr
from vigil.operators import graph as grf
from vigil.operators.detect import alerts as alert_projection
from vigil.operators.detect import detect
from vigil.operators.metrics import detection_metrics
from vigil.operators.normalize import normalize
from vigil.session import scratch_path
from vigil.sources.telemetry import telemetry

def write_stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    The read-back frame is a plain parquet scan: a leaf for every downstream
    plan, with column pruning and filter pushdown, that survives executor loss.
    """
    path = scratch_path(spark, f"stages/{spark.sparkContext.applicationId}/{name}")
    df.write.parquet(path)
    return spark.read.parquet(path)


class Stages:
    def __init__(self, spark: SparkSession, sf_dir: str, materialize: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self._materialize = materialize
        self._written: dict[str, DataFrame] = {}

    def _cut(self, name: str, build) -> DataFrame:
        if not self._materialize:
            return build()
        if name not in self._written:
            self._written[name] = write_stage(self.spark, build(), name)
        return self._written[name]

    @cached_property
    def telemetry(self):
        return telemetry(self.spark, self.sf_dir)

    @cached_property
    def normalized_result(self):
        t = self.telemetry
        return normalize(t.logs, t.registry, t.schema_versions)

    @cached_property
    def normalized(self) -> DataFrame:
        return self.normalized_result.logs

    @cached_property
    def detected(self) -> DataFrame:
        return self._cut("detected", lambda: detect(self.normalized))

    @cached_property
    def alerts(self) -> DataFrame:
        return alert_projection(self.detected)

    @cached_property
    def metrics(self) -> DataFrame:
        return detection_metrics(self.detected, self.normalized)

    @cached_property
    def graph_logs(self) -> DataFrame:
        return self._cut("graph_logs", lambda: grf.graph_ready_logs(self.detected, self.telemetry.registry))

    @cached_property
    def edges_full(self) -> DataFrame:
        return self._cut("edges", lambda: grf.graph_edges(self.graph_logs))

    @cached_property
    def edges(self) -> DataFrame:
        return grf.public_edges(self.edges_full)

    @cached_property
    def nodes(self) -> DataFrame:
        return self._cut("nodes", lambda: grf.graph_nodes(self.edges_full))

    @cached_property
    def usage(self) -> DataFrame:
        return self._cut("usage", lambda: fpr.fingerprint_usage(self.graph_logs))

    @cached_property
    def clusters(self) -> DataFrame:
        return self._cut("clusters", lambda: fpr.fingerprint_clusters(self.usage))

    @cached_property
    def members(self) -> DataFrame:
        return self._cut("members", lambda: fpr.cluster_members(self.clusters, self.usage))

    @cached_property
    def candidates(self) -> DataFrame:
        return self._cut("candidates", lambda: att.candidates(self.nodes, self.edges, self.members))

    @cached_property
    def command(self) -> DataFrame:
        return att.command_node(self.nodes, self.candidates)
