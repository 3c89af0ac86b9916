"""Interaction graph: graph-ready logs, edges, nodes, adjacency (GRF3-15).

Shuffle budget: one shuffle of the log table for the inter-arrival interval
(partitioned by (source, seq block), see ``intervals``) and one for the edge
aggregation (partial aggregate, so a hot edge is combined map-side).  Node
statistics are rolled up from the much smaller edge table.  The registry is
only touched as a dimension: a size-checked broadcast for user agents and
the target index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.graphfn import iso_to_seconds, iso_utc_timestamp, normalize_headers
from vigil.functions.scalars import py_strip, safe_str
from vigil.operators.indexing import dense_index
from vigil.operators.intervals import previous_in_group
from vigil.operators.prefix import chunked
from vigil.operators.rules import LEVEL_RANK
from vigil.operators.sizing import materialize_dimension

UNKNOWN_UA = "UNKNOWN-UA"


def level_rank(col: Column) -> Column:
    out = F.lit(0)
    for level, rank in LEVEL_RANK.items():
        out = F.when(col == level, F.lit(rank)).otherwise(out)
    return out


def rank_level(col: Column) -> Column:
    out = F.lit("CLEAN")
    for level, rank in LEVEL_RANK.items():
        out = F.when(col == rank, F.lit(level)).otherwise(out)
    return out


def target_index(registry: DataFrame) -> tuple[DataFrame, Column]:
    """(idx, node_id, next_node_id, n) over sorted registry ids, and the id count as a scalar.

    Dimension-sized and written once for the plan that uses it.
    """
    ids = registry.select(safe_str("node_id", None).alias("node_id")).filter(F.col("node_id").isNotNull())
    idx = dense_index(ids, "node_id")
    n = idx.agg(F.count(F.lit(1))).scalar()
    nxt = idx.select(F.col("idx").alias("_nidx"), F.col("node_id").alias("next_node_id"))
    table = materialize_dimension(idx.withColumn("_nidx", F.when(n > 0, F.pmod(F.col("idx") + 1, n)))
                                  .join(nxt, "_nidx").drop("_nidx").withColumn("n", n), "targets")
    return table.drop("n"), table.agg(F.coalesce(F.max("n"), F.lit(0).cast("bigint"))).scalar()


def hash_slot(log_id: Column, n: Column) -> Column:
    """int(md5(log_id)[:8], 16) % n (GRF6)."""
    h = F.conv(F.substring(F.md5(log_id), 1, 8), 16, 10).cast("bigint")
    return F.when(n > 0, F.pmod(h, n))


def graph_ready_logs(logs: DataFrame, registry: DataFrame, alerts: DataFrame | None = None,
                     block_rows: int | None = None) -> DataFrame:
    """Strict graph records (GRF8) from normalized or detected logs.

    Optional input columns ``headers``, ``user_agent``, ``target_node`` are
    used when present, otherwise the reference fallbacks apply.  Alert
    severity/level come from ``alerts`` (joined on log_id, last wins) or,
    when ``alerts`` is None, from ``severity_score``/``alert_level`` columns
    carried on ``logs``.
    """
    cols = set(logs.columns)
    src = py_strip(F.coalesce(F.col("node_id").cast("string"), F.lit("")))
    lid = py_strip(F.coalesce(F.col("log_id").cast("string"), F.lit("")))
    base = logs.withColumn("source_node", src).withColumn("log_id", lid) \
        .filter((F.col("source_node") != "") & (F.col("log_id") != ""))

    ts_iso = iso_utc_timestamp(F.col("timestamp"))
    base = base.withColumn("_ts_iso", ts_iso).withColumn("_ts", iso_to_seconds(F.col("_ts_iso")))

    reg = (registry.select(safe_str("node_id", None).alias("source_node"),
                           F.col("user_agent").cast("string").alias("_reg_ua"), "seq")
           .filter(F.col("source_node").isNotNull()))
    reg = materialize_dimension(reg.groupBy("source_node").agg(F.max_by("_reg_ua", "seq").alias("_reg_ua")),
                                "registry_ua")
    base = base.join(reg, "source_node", "left")
    log_ua = F.nullif(F.col("user_agent").cast("string"), F.lit("")) if "user_agent" in cols else F.lit(None)
    ua = py_strip(F.coalesce(log_ua, F.nullif(F.col("_reg_ua"), F.lit("")), F.lit(UNKNOWN_UA)))
    ua = F.when(ua == "", F.lit(UNKNOWN_UA)).otherwise(ua)

    fallback = F.array(
        F.concat(F.lit("x-node:"), F.lower(F.col("source_node"))),
        F.concat(F.lit("x-region:"), F.lower(F.coalesce(F.col("region").cast("string"), F.lit("unknown")))),
        F.concat(F.lit("x-schema:v"), F.coalesce(F.col("schema_version").cast("bigint"), F.lit(-1)).cast("string")),
    )
    # The fallback is already trimmed, lower-case and sorted (x-node < x-region
    # < x-schema), so only explicit headers go through normalize_headers.
    headers = (F.when(F.col("headers").isNotNull(), normalize_headers(F.col("headers"))).otherwise(fallback)
               if "headers" in cols else fallback)
    # text that is not digits after an optional minus counts as missing: no plus, no spaces
    rt = F.coalesce(F.col("response_time_ms").try_cast("bigint"), F.lit(-1).cast("bigint"))
    if dict(logs.dtypes).get("response_time_ms") == "string":
        rt = F.when(F.col("response_time_ms").rlike(r"\A-?[0-9]+\z"), rt).otherwise(F.lit(-1).cast("bigint"))

    base = base.select(
        "log_id", "source_node", "seq", "_ts_iso", "_ts", ua.alias("user_agent"),
        headers.alias("headers"), rt.alias("response_time_ms"),
        (py_strip(F.col("target_node").cast("string")) if "target_node" in cols else F.lit(None).cast("string"))
        .alias("_explicit_target"),
        *([F.col("severity_score"), F.col("alert_level")] if alerts is None and "alert_level" in cols else []),
    )
    base = previous_in_group(base, "source_node", "seq", "_ts", "_prev_ts", block_rows)
    interval = F.when(F.col("_prev_ts").isNull(), F.lit(0)).otherwise(
        F.greatest(F.col("_ts") - F.col("_prev_ts"), F.lit(0))).cast("bigint")
    base = base.withColumn("interval", interval)
    base = _with_targets(base, registry)

    if alerts is not None:
        a = (alerts.select(py_strip(F.col("log_id").cast("string")).alias("log_id"),
                           F.col("severity_score"), F.col("alert_level"), "seq")
             .filter(F.col("log_id") != "")
             .groupBy("log_id").agg(F.max_by(F.struct("severity_score", "alert_level"), "seq").alias("_a"))
             .select("log_id", "_a.*"))
        base = base.join(a, "log_id", "left")
    elif "severity_score" not in base.columns:
        base = base.withColumn("severity_score", F.lit(None)).withColumn("alert_level", F.lit(None))

    return base.select(
        "log_id", "source_node", "target_node", F.col("_ts_iso").alias("timestamp"), "headers",
        "user_agent", "response_time_ms", "interval",
        F.coalesce(F.col("severity_score").cast("double"), F.lit(0.0)).alias("severity_score"),
        F.coalesce(F.col("alert_level").cast("string"), F.lit("CLEAN")).alias("alert_level"),
        "seq",
    )


def _with_targets(base: DataFrame, registry: DataFrame) -> DataFrame:
    table, n = target_index(registry)
    table = table.withColumnRenamed("node_id", "_t1")
    with_slot = base.withColumn("_slot", hash_slot(F.col("log_id"), n))
    joined = with_slot.join(table, with_slot["_slot"] == table["idx"], "left")
    derived = (F.when(~(n > 0), F.col("source_node"))
               .when((F.col("_t1") == F.col("source_node")) & (n > 1), F.col("next_node_id"))
               .otherwise(F.col("_t1")))
    explicit = F.nullif(F.col("_explicit_target"), F.lit(""))
    return (joined.withColumn("target_node", F.coalesce(explicit, derived))
            .drop("_slot", "idx", "_t1", "next_node_id", "_explicit_target"))


def graph_edges(graph_logs: DataFrame) -> DataFrame:
    """Edge table (GRF9/GRF10): count, attributes of the first log, mean latency.

    ``avg_response_time_ms`` is the mean of the non-negative latencies, rounded
    to 2 places; the incremental, order-dependent one is ``running_mean.edge_running_mean``.

    The figures and the number of the first log are one hash aggregate of
    fixed-width values; the first log's text columns are fetched for the
    winners only, by a join on edge and ``seq`` (unique).  The logs are read
    twice and never sorted for the aggregate: pass a written stage.
    """
    gl = graph_logs.filter((F.col("source_node") != "") & (F.col("target_node") != ""))
    rt = F.col("response_time_ms")
    figures = gl.groupBy(F.col("source_node").alias("source"), F.col("target_node").alias("target")).agg(
        F.count(F.lit(1)).alias("count"), F.min("seq").alias("_first_seq"),
        F.coalesce(F.round(F.avg(F.when(rt >= 0, rt)), 2), F.lit(0.0)).alias("avg_response_time_ms"),
        F.max("severity_score").alias("_max_sev"),
        F.max(level_rank(F.col("alert_level"))).alias("_max_rank"),
    )
    first = gl.select("source_node", "target_node", F.col("seq").alias("_seq"), "interval", "user_agent", "headers")
    same = ((F.col("source") == F.col("source_node")) & (F.col("target") == F.col("target_node"))
            & (F.col("_first_seq") == F.col("_seq")))
    return first.join(figures, same).select(
        "source", "target", "count", F.col("count").alias("weight"), "interval", "user_agent", "headers",
        "avg_response_time_ms", "_max_sev", "_max_rank",
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Node table (GRF11-14): out-degree, centrality, severity, type."""
    out = edges.groupBy(F.col("source").alias("node_id")).agg(
        F.count(F.lit(1)).alias("out_degree"),
        F.max("_max_sev").alias("_sev"),
        F.max("_max_rank").alias("_rank"),
    )
    targets = edges.select(F.col("target").alias("node_id")).distinct()
    all_nodes = out.select("node_id").union(targets).distinct()
    total = all_nodes.agg(F.count(F.lit(1))).scalar()
    nodes = all_nodes.join(out, "node_id", "left")
    deg = F.coalesce(F.col("out_degree"), F.lit(0)).cast("bigint")
    return nodes.select(
        F.col("node_id").alias("id"), "node_id", deg.alias("out_degree"),
        F.when(total > 0, F.round(deg / total, 4)).otherwise(F.lit(0.0)).alias("centrality"),
        F.round(F.greatest(F.coalesce(F.col("_sev"), F.lit(0.0)), F.lit(0.0)), 2).alias("severity_score"),
        rank_level(F.coalesce(F.col("_rank"), F.lit(0))).alias("node_type"),
    )


def public_edges(edges: DataFrame) -> DataFrame:
    """Edge list as published (GRF15): drops the node roll-up helpers."""
    return edges.drop("_max_sev", "_max_rank")


def adjacency(edges: DataFrame, nodes: DataFrame, size: int = 1000) -> DataFrame:
    """(node_id, chunk, neighbors): sorted distinct targets, at most ``size`` a row; nodes without out-edges get one [] (GRF15).

    A hub is as many rows as its targets need, never one giant array.
    """
    rows = chunked(edges.select(F.col("source").alias("_source"), "target"), ["_source"], "target", size, "adjacency")
    return nodes.select("node_id").join(rows, F.col("node_id") == F.col("_source"), "left").select(
        "node_id", F.coalesce("chunk", F.lit(0)).cast("long").alias("chunk"),
        F.coalesce("members", F.array().cast("array<string>")).alias("neighbors"))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1))).scalar()
    return edges.agg(F.count(F.lit(1)).alias("total_edges")).select(
        n.alias("total_nodes"), "total_edges")
