"""Rows that name every attacked node, and tables whose rows lie in one row group."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from tests.conftest import SF001
from pyspark.sql import functions as F

from vigil.operators.metrics import attacked_nodes
from vigil.operators.sizing import spread
from vigil.plans.catalog import QUERIES
from vigil.plans.stages import Stages


def test_metrics_and_summary_name_the_attacked_nodes(spark):
    nodes = [r.node_id for r in attacked_nodes(Stages(spark, SF001, materialize=False).detected).orderBy("node_id").collect()]
    assert len(nodes) > 1
    for name in ("detection_metrics", "summary_view"):
        assert QUERIES[name](spark, SF001).first().nodes_under_attack == ",".join(nodes), name


def test_one_row_group_in_many_splits_is_spread(spark, tmp_path):
    n, rng = 40_000, np.random.default_rng(1)
    table = pa.table({"id": np.arange(n), "x": rng.random(n)})
    pq.write_table(table, str(tmp_path / "one.parquet"), row_group_size=n)
    conf = {"spark.sql.files.maxPartitionBytes": "65536", "spark.sql.files.openCostInBytes": "0"}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        df = spark.read.parquet(str(tmp_path / "one.parquet"))
        assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        out = spread(df, ["id"])
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == n and max(sizes) < n / 2
        plan = out.where(F.sqrt("x") < 0.5)._jdf.queryExecution().optimizedPlan().toString()
        assert "SQRT" in plan and "SQRT" not in plan.split("Repartition")[1]  # computed after the rows are dealt
    finally:
        for key in conf:
            spark.conf.unset(key)
