"""Global detection metrics (AGG1-5) as single-pass aggregates.

Each metric is a partial aggregate (count_if / sum / avg), so the whole
metrics row costs one map-side combine per partition plus a one-row final
merge.  The row holds the number of attacked nodes and their sorted ids; who
wants no such row takes the table (``attacked_nodes``) or arrays of a fixed
size (``attacked_node_chunks``).  The versions seen are an array: there are as
many as rows of the version table, which people write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.prefix import chunked
from vigil.operators.rules import PRIORITY_ORDER


def percentage(count: Column, total: Column) -> Column:
    """round(count / total * 100, 2), 0.0 when total is 0 (AGG5)."""
    return F.when(total > 0, F.round(count / total * 100, 2)).otherwise(F.lit(0.0))


def detection_metrics(detected: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """One-row metrics over the scored logs (AGG1-4).

    ``processed``: the rows given to detection; those it left out (blank ids)
    count as skipped.  Without it all scored rows are all rows.

    Figures are added up per attacked node and version first, so the task that
    makes the row meets each of them once, however many logs name them.
    """
    total = processed.agg(F.count(F.lit(1))).scalar() if processed is not None else F.col("_logs")
    lvl = F.col("alert_level")
    rt = F.col("response_time_ms")
    sv = F.col("schema_version")
    per_node = detected.groupBy(F.when(lvl == "ATTACK", F.col("node_id")).alias("_node"), F.when(sv != -1, sv).alias("_version")).agg(
        F.count(F.lit(1)).alias("_logs"),
        *[F.count_if(lvl == level).alias(level) for level in PRIORITY_ORDER],
        F.count_if(F.col("ml_detected")).alias("_ml"),
        F.sum(F.when(rt != -1, rt.cast("double"))).alias("_rt_sum"), F.count(F.when(rt != -1, rt)).alias("_rt_count"),
        F.count_if(~F.coalesce(F.col("hardware_id_valid"), F.lit(True))).alias("_invalid_hw"),
    )
    return per_node.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per_node.columns if c not in ("_node", "_version", "_rt_sum")],
        F.sum("_rt_sum").alias("_rt_sum"),
        F.sort_array(F.collect_set("_node")).alias("attacked_node_ids"),
        F.sort_array(F.collect_set("_version")).alias("schema_versions_seen"),
    ).select(
        total.alias("total_logs_processed"),
        F.col("_logs").alias("total_alerts"),
        (total - F.col("_logs")).alias("skipped"),
        F.col("ATTACK").alias("attack_count"),
        F.col("HIGH_RISK").alias("high_risk_count"),
        F.col("SUSPICIOUS").alias("suspicious_count"),
        F.col("CLEAN").alias("clean_count"),
        F.col("_ml").alias("ml_detection_count"),
        F.coalesce(F.round(F.col("_rt_sum") / F.nullif(F.col("_rt_count"), F.lit(0)), 1), F.lit(0.0)).alias("avg_response_time_ms"),
        F.col("_invalid_hw").alias("invalid_hw_count"),
        F.size("attacked_node_ids").cast("bigint").alias("nodes_under_attack"),
        "schema_versions_seen", "attacked_node_ids",
    )


def attacked_nodes(detected: DataFrame) -> DataFrame:
    """Distinct nodes with an ATTACK alert, as a table (AGG3 table form)."""
    return detected.filter(F.col("alert_level") == "ATTACK").select("node_id").distinct()


def attacked_node_chunks(detected: DataFrame, size: int = 1000) -> DataFrame:
    """(chunk, members): the attacked nodes, sorted, at most ``size`` a row (AGG3, VW3)."""
    return chunked(attacked_nodes(detected), [], "node_id", size, "attacked-nodes")


def metrics_view(metrics: DataFrame, total_nodes: Column) -> DataFrame:
    """Metrics plus percentages and the registry size (AGG5, VW4)."""
    total = F.col("total_logs_processed")
    threats = F.col("attack_count") + F.col("high_risk_count") + F.col("suspicious_count")
    return metrics.select(
        total.alias("total_logs"), "total_alerts", "attack_count", "high_risk_count",
        "suspicious_count", "clean_count", "ml_detection_count",
        percentage(F.col("attack_count"), total).alias("attack_percentage"),
        percentage(F.col("high_risk_count"), total).alias("high_risk_percentage"),
        percentage(F.col("suspicious_count"), total).alias("suspicious_percentage"),
        percentage(threats, total).alias("threat_percentage"),
        total_nodes.alias("total_nodes"),
        "invalid_hw_count", "avg_response_time_ms", "nodes_under_attack", "schema_versions_seen", "attacked_node_ids",
    )
