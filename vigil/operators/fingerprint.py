"""Behavioural fingerprint clusters (FPR4-9).

The cluster key hashes (headers, user agent, interval bucket), so user agent
and bucket are constant inside a cluster and their "mode" is simply the
cluster's value.  One hash aggregate over the graph logs, per (cluster, raw
agent, node) with a count and the first row, is all that reads them: totals,
agent shares, clusters and members roll up from it.  Members are a
(cluster, node) table; an array of them exists only in ``with_nodes``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.graphfn import fingerprint_key, interval_bucket, is_common_user_agent
from vigil.functions.scalars import py_strip
from vigil.operators.prefix import chunked

DEFAULT_MIN_FREQUENCY = 2
DEFAULT_COMMON_UA_CUTOFF = 0.1


def keyed_logs(graph_logs: DataFrame, renormalize: bool = False) -> DataFrame:
    """Graph logs with the cluster key, bucket and cleaned UA/headers.

    Headers from ``graph_ready_logs`` are already trimmed, lower-cased and
    non-blank; ``renormalize=True`` re-applies that cleaning for other inputs.
    """
    headers = F.coalesce(F.col("headers"), F.array().cast("array<string>"))
    if renormalize:
        headers = F.filter(F.transform(headers, lambda h: F.lower(py_strip(F.coalesce(h, F.lit("None"))))),
                           lambda h: h != "")
    ua = py_strip(F.coalesce(F.col("user_agent").cast("string"), F.lit("UNKNOWN-UA")))
    ua = F.when(ua == "", F.lit("UNKNOWN-UA")).otherwise(ua)
    bucket = interval_bucket(F.coalesce(F.col("interval"), F.lit(-1)))
    df = graph_logs.select(
        py_strip(F.coalesce(F.col("source_node"), F.lit(""))).alias("source_node"),
        headers.alias("headers"), ua.alias("user_agent"), bucket.alias("interval_bucket"),
        F.coalesce(F.col("user_agent").cast("string"), F.lit("UNKNOWN-UA")).alias("_raw_ua"), "seq")
    return df.withColumn("fingerprint_key", fingerprint_key(F.col("headers"), F.col("user_agent"),
                                                           F.col("interval_bucket")))


CLUSTER = ["fingerprint_key", "headers", "user_agent", "interval_bucket"]


def fingerprint_usage(graph_logs: DataFrame) -> DataFrame:
    """Logs and first row per cluster, raw agent and node: the one pass over the graph logs."""
    return keyed_logs(graph_logs).groupBy(*CLUSTER, "_raw_ua", "source_node").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


def fingerprint_clusters(usage: DataFrame, min_frequency: int = DEFAULT_MIN_FREQUENCY,
                         common_ua_cutoff_ratio: float = DEFAULT_COMMON_UA_CUTOFF) -> DataFrame:
    """Filtered clusters of a usage table, with confidence and number of nodes (``ordered_clusters`` gives the order)."""
    total = usage.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    ua_share = usage.groupBy(F.col("_raw_ua").alias("user_agent")).agg(F.sum("n").alias("_ua_count"))
    # a node counts once, whatever its raw agents: per node first, then per cluster
    clusters = (usage.groupBy(*CLUSTER, "source_node").agg(F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))
                .groupBy(*CLUSTER).agg(F.sum("n").alias("occurrences"), F.min("first_seq").alias("first_seq"),
                                       F.count_if(F.col("source_node") != "").alias("node_count"))
                .filter(F.col("occurrences") >= max(1, min_frequency)))
    clusters = clusters.join(ua_share, "user_agent", "left")
    share = F.when(total > 0, F.coalesce(F.col("_ua_count"), F.lit(0)) / total).otherwise(F.lit(0.0))
    clusters = clusters.filter(~(is_common_user_agent(F.col("user_agent")) & (share >= common_ua_cutoff_ratio)))
    dominant_ratio = F.lit(1.0)
    confidence = F.least(F.lit(0.99), F.round(
        F.lit(0.45) + F.lit(0.05) * F.col("occurrences") + F.lit(0.08) * F.col("node_count")
        + F.lit(0.1) * dominant_ratio, 2))
    return clusters.select(
        F.concat(F.lit("fp_"), F.substring("fingerprint_key", 1, 12)).alias("fingerprint_id"),
        "fingerprint_key", "occurrences", "node_count", "headers", "user_agent", "interval_bucket",
        confidence.alias("confidence"), "first_seq",
    )


def ordered_clusters(clusters: DataFrame) -> DataFrame:
    """Publication order (FPR8)."""
    return clusters.orderBy(F.desc("occurrences"), F.desc("confidence"), F.asc("first_seq"))


def cluster_members(clusters: DataFrame, usage: DataFrame) -> DataFrame:
    """A row per cluster and member node, with the cluster's figures."""
    nodes = usage.filter(F.col("source_node") != "").select("fingerprint_key", F.col("source_node").alias("node_id")).distinct()
    return nodes.join(clusters.select("fingerprint_key", "fingerprint_id", "occurrences", "confidence", "first_seq"),
                      "fingerprint_key")


def with_nodes(clusters: DataFrame, members: DataFrame, size: int = 1000) -> DataFrame:
    """Clusters with their nodes, sorted, at most ``size`` a row (``chunk`` counts a cluster's rows), for presentation."""
    rows = chunked(members.select(F.col("fingerprint_key").alias("_key"), "node_id"), ["_key"], "node_id", size, "cluster-nodes")
    return (clusters.join(rows, F.col("fingerprint_key") == F.col("_key"), "left").drop("_key")
            .withColumn("chunk", F.coalesce("chunk", F.lit(0)).cast("long"))
            .withColumn("nodes", F.coalesce("members", F.array().cast("array<string>"))).drop("members"))


def node_fingerprint_counts(graph_logs: DataFrame) -> DataFrame:
    """Logs per source node before any filtering (FPR9)."""
    return (graph_logs.select(py_strip(F.coalesce(F.col("source_node"), F.lit(""))).alias("node_id"))
            .groupBy("node_id").agg(F.count(F.lit(1)).alias("log_count")))
