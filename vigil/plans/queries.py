"""Registered queries: one per operator family of the survey inventory.

Each entry takes ``(spark, sf_dir)`` and returns a flat DataFrame whose
columns carry the same names as the matching DuckDB oracle in
``plans.oracle``.  Arrays are rendered with ``array_join`` so results hash
identically in both engines; ``ingestion_time`` (wall clock) is excluded.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators import views as vw
from vigil.operators.metrics import metrics_view
from vigil.operators.normalize import integrity_summary
from vigil.operators import graph as grf
from vigil.operators import fingerprint as fpr
from vigil.operators import attribution as att
from vigil.plans.stages import Stages

SEP = " | "


def _s(spark: SparkSession, sf_dir: str) -> Stages:
    """Stages cut at boundaries: for plans that read a stage from several branches."""
    return Stages(spark, sf_dir)


def _one_pass(spark: SparkSession, sf_dir: str) -> Stages:
    """Uncut stages: for queries that consume the scored logs once (an aggregate
    or a top-k), so the plan is a single scan -> normalize -> detect -> reduce,
    with nothing log-sized written on the way."""
    return Stages(spark, sf_dir, materialize=False)


def alerts_by_region_level(spark, sf_dir) -> DataFrame:
    """Flagship: alert count and severity by region and level."""
    d = _one_pass(spark, sf_dir).detected
    return d.groupBy("region", "alert_level").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.round(F.avg("severity_score"), 4).alias("avg_severity"),
        F.max("severity_score").alias("max_severity"),
        F.count_if(F.col("confidence_score") >= 50).alias("multi_rule_alerts"),
    )


def normalized_logs(spark, sf_dir) -> DataFrame:
    n = _one_pass(spark, sf_dir).normalized
    return n.select(
        "log_id", "node_id", "node_name", "region", "schema_version", "schema_known", "reported_status",
        "http_status", "response_time_ms", "hardware_id_b64", "hardware_id_valid", "hardware_id_decoded",
        "hardware_id_reason", "timestamp", F.array_join("parse_warnings", SEP).alias("parse_warnings"))


def integrity(spark, sf_dir) -> DataFrame:
    return integrity_summary(_s(spark, sf_dir).normalized_result.flagged)


def alerts(spark, sf_dir) -> DataFrame:
    a = _one_pass(spark, sf_dir).alerts
    return a.select(
        "log_id", "node_id", "node_name", "region", "timestamp", "alert_level", "severity_score",
        "confidence_score", "is_anomaly", "primary_reason", F.array_join("reasons", SEP).alias("reasons"),
        F.array_join("rule_ids", ",").alias("rule_ids"),
        F.col("source_data.reported_status").alias("reported_status"),
        F.col("source_data.http_status").alias("http_status"),
        F.col("source_data.response_time_ms").alias("response_time_ms"),
        F.col("source_data.hardware_id_valid").alias("hardware_id_valid"),
        F.col("source_data.hardware_id_decoded").alias("hardware_id_decoded"),
        F.col("source_data.schema_version").alias("schema_version"),
        F.col("source_data.schema_known").alias("schema_known"))


def rule_hits(spark, sf_dir) -> DataFrame:
    d = _one_pass(spark, sf_dir).detected
    return (d.select("alert_level", F.explode("rule_ids").alias("rule_id"))
            .groupBy("rule_id", "alert_level").agg(F.count(F.lit(1)).alias("hits")))


def detection_metrics(spark, sf_dir) -> DataFrame:
    m = _one_pass(spark, sf_dir).metrics
    return m.select(
        *[c for c in m.columns if c not in ("nodes_under_attack", "schema_versions_seen", "attacked_node_ids")],
        F.array_join("attacked_node_ids", ",").alias("nodes_under_attack"),
        F.array_join(F.transform("schema_versions_seen", lambda v: v.cast("string")), ",")
        .alias("schema_versions_seen"))


def metrics(spark, sf_dir) -> DataFrame:
    st = _one_pass(spark, sf_dir)
    total_nodes = st.telemetry.registry.agg(F.count(F.lit(1))).scalar()
    mv = metrics_view(st.metrics, total_nodes)
    return mv.drop("nodes_under_attack", "schema_versions_seen", "attacked_node_ids")


def registry_count(spark, sf_dir) -> DataFrame:
    return _one_pass(spark, sf_dir).telemetry.registry.agg(F.count(F.lit(1)).alias("total_nodes"))


def _alert_cols(df: DataFrame) -> DataFrame:
    return df.select("log_id", "node_id", "region", "alert_level", "severity_score", "timestamp")


def alert_query(spark, sf_dir) -> DataFrame:
    a = _one_pass(spark, sf_dir).alerts
    top = vw.alert_query(a, level="attack", limit=500)
    return top.select("rank", "log_id", "node_id", "region", "alert_level", "severity_score", "timestamp")


def alert_page(spark, sf_dir) -> DataFrame:
    a = _s(spark, sf_dir).alerts
    page = vw.alert_page(a, region="europe", page=2, limit=100)
    return page.select("log_id", "node_id", "region", "alert_level", "severity_score", "page", "limit", "total")


def alert_page_cursor(spark, sf_dir) -> DataFrame:
    """The page behind the cursor (90, 1000)."""
    return _alert_cols(vw.alerts_after(_s(spark, sf_dir).alerts, after=(90, 1000), limit=100))


def summary_critical(spark, sf_dir) -> DataFrame:
    a = _one_pass(spark, sf_dir).alerts
    return vw.critical_alerts(a).select("rank", "log_id", "node_id", "alert_level", "severity_score", "timestamp")


def alert_envelope(spark, sf_dir) -> DataFrame:
    a = _s(spark, sf_dir).alerts
    e = vw.alert_envelope(a, level="high_risk", limit=900)
    return e.select("total", "limit", F.col("last_generated").isNotNull().alias("generated"))


def summary_view(spark, sf_dir) -> DataFrame:
    st = _s(spark, sf_dir)
    total_nodes = st.telemetry.registry.agg(F.count(F.lit(1))).scalar()
    out = vw.summary(metrics_view(st.metrics, total_nodes), st.alerts)
    return out.select(*[c for c in out.columns if c not in ("critical_alerts", "nodes_under_attack", "attacked_node_ids")],
                      F.array_join(F.transform("critical_alerts", lambda x: x["log_id"]), ",").alias("critical_log_ids"),
                      F.array_join("attacked_node_ids", ",").alias("nodes_under_attack"))


def attacked_nodes(spark, sf_dir) -> DataFrame:
    from vigil.operators.metrics import attacked_nodes as table
    return table(_s(spark, sf_dir).detected)


def graph_logs_explicit(spark, sf_dir) -> DataFrame:
    """Logs with headers, agents and targets of their own, and alerts joined by log id.

    By log number: those divisible by 3 have headers, by 4 an agent, by 5 a target; alerts exist for the even ones.
    """
    st = _s(spark, sf_dir)
    s = F.col("seq")
    odd = F.array(F.lit(" X-Trace:B "), F.lit(""), F.lit("Accept:A"), F.concat(F.lit("x-n:"), F.col("node_id")))
    logs = (st.detected.drop("severity_score", "alert_level")
            .withColumn("headers", F.when(s % 3 == 0, odd))
            .withColumn("user_agent", F.when(s % 4 == 0, F.lit(" Mozilla/5.0 probe ")))
            .withColumn("target_node", F.when(s % 5 == 0, F.lit(" NODE-EXT ")).when(s % 5 == 1, F.lit("  "))))
    found = st.detected.where(s % 2 == 0).select("log_id", "severity_score", "alert_level", "seq")
    g = grf.graph_ready_logs(logs, st.telemetry.registry, alerts=found)
    return g.select("log_id", "source_node", "target_node", F.array_join("headers", ",").alias("headers"), "user_agent",
                    "interval", "severity_score", "alert_level")


def alert_search(spark, sf_dir) -> DataFrame:
    a = _one_pass(spark, sf_dir).alerts
    return _alert_cols(vw.search_alerts(a, "NODE-01"))


def alert_search_indexed(spark, sf_dir) -> DataFrame:
    """Several searches answered from trigram postings."""
    from vigil.operators.search import build_search_index, search_indexed
    a = _s(spark, sf_dir).alerts
    found = search_indexed(a, build_search_index(a), ["NODE-01", "000000012", "log-0007", "east", "Zz", "no such text"])
    return found.select("query", "log_id", "node_id", "region", "alert_level", "severity_score")


def alert_search_page(spark, sf_dir) -> DataFrame:
    a = _one_pass(spark, sf_dir).alerts
    return _alert_cols(vw.search_page(vw.search_alerts(a, "europe"), page=3))


def latest_alert_per_node(spark, sf_dir) -> DataFrame:
    a = _s(spark, sf_dir).alerts
    cols = ["log_id", "timestamp", "alert_level", "severity_score", "response_time_ms"]
    return vw.latest_per_node(a, cols).select("node_id", *cols)


def latency_top10(spark, sf_dir) -> DataFrame:
    return vw.latency_top(_s(spark, sf_dir).alerts)


def status_class_4xx(spark, sf_dir) -> DataFrame:
    latest = vw.latest_per_node(_s(spark, sf_dir).alerts, ["severity_score"])
    return vw.status_class_filter(latest, "4XX").select("node_id", "severity_score", "status_code")


def level_distribution(spark, sf_dir) -> DataFrame:
    return vw.level_distribution(_s(spark, sf_dir).alerts)


def ml_rule_split(spark, sf_dir) -> DataFrame:
    return vw.ml_rule_split(_one_pass(spark, sf_dir).metrics)


def sanitized_alerts(spark, sf_dir) -> DataFrame:
    return vw.sanitize_alerts(_one_pass(spark, sf_dir).alerts).drop("seq")


def detection_quality(spark, sf_dir) -> DataFrame:
    st = _one_pass(spark, sf_dir)
    return vw.detection_quality(st.detected, st.telemetry.registry)


def detection_scores(spark, sf_dir) -> DataFrame:
    st = _one_pass(spark, sf_dir)
    return vw.detection_scores(vw.detection_quality(st.detected, st.telemetry.registry))


def graph_logs(spark, sf_dir) -> DataFrame:
    g = _s(spark, sf_dir).graph_logs
    return g.select("log_id", "source_node", "target_node", "timestamp", F.array_join("headers", ",").alias("headers"),
                    "user_agent", "response_time_ms", "interval", "severity_score", "alert_level")


def graph_edges(spark, sf_dir) -> DataFrame:
    e = _s(spark, sf_dir).edges
    return e.select("source", "target", "count", "weight", "interval", "user_agent",
                    F.array_join("headers", ",").alias("headers"), "avg_response_time_ms")


def graph_nodes(spark, sf_dir) -> DataFrame:
    return _s(spark, sf_dir).nodes


def adjacency(spark, sf_dir) -> DataFrame:
    st = _s(spark, sf_dir)
    adj = grf.adjacency(st.edges, st.nodes, size=16)
    return adj.select("node_id", "chunk", F.array_join("neighbors", ",").alias("neighbors"))


def attacked_node_chunks(spark, sf_dir) -> DataFrame:
    from vigil.operators.metrics import attacked_node_chunks as chunks
    return chunks(_s(spark, sf_dir).detected, size=10).select("chunk", F.array_join("members", ",").alias("members"))


def edge_running_mean(spark, sf_dir) -> DataFrame:
    """The running mean of every edge beside the plain one."""
    from vigil.operators.running_mean import edge_running_mean as running
    st = _s(spark, sf_dir)
    plain = st.edges.select("source", "target", "avg_response_time_ms")
    return running(st.graph_logs).join(plain, ["source", "target"])


def alert_page_deep(spark, sf_dir) -> DataFrame:
    """A page far down the listing of all alerts."""
    return vw.alert_page(_s(spark, sf_dir).alerts, page=91, limit=7).select("log_id", "alert_level", "severity_score", "page", "limit", "total")


def asof_scan(spark, sf_dir) -> DataFrame:
    """Every event's latest boundary at or before its number, over as many boundaries as suppliers."""
    from vigil.operators.asof import asof_lookup
    starts = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        (F.col("s_suppkey") * 97).alias("start"), F.col("s_nationkey").cast("long").alias("nation"), F.col("s_suppkey").alias("seq"))
    keys = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id")
    return asof_lookup(keys, "event_id", starts, "start", "nation", "nation", default=-1, few=0)


def _faulty_logs(st):
    """Telemetry logs, some with a blank id or an infinite latency: rows that normalization drops."""
    s = F.col("seq")
    endless = F.transform_values("fields", lambda k, v: F.when(k.isin("latency", "response_ms") & (s % 89 == 3), F.lit("inf")).otherwise(v))
    return (st.telemetry.logs.withColumn("log_id", F.when(s % 97 == 5, F.lit("  ")).otherwise(F.col("log_id")))
            .withColumn("node_id", F.when(s % 101 == 7, F.lit(None)).otherwise(F.col("node_id"))).withColumn("fields", endless))


def stage_round_trip(spark, sf_dir) -> DataFrame:
    """The alerts written as a stage, replaced by a second version and read back by level; integrity counts of the written logs."""
    from vigil.operators.normalize import normalize
    from vigil.plans.pipeline import integrity_counts
    from vigil.session import scratch_path
    from vigil.sources.sinks import read_stage, release, write_stage
    st, root = _s(spark, sf_dir), scratch_path(spark, "round-trip")
    write_stage(st.alerts.where("alert_level = 'ATTACK'"), root, "alerts")
    write_stage(st.alerts, root, "alerts")
    release(spark, root, "alerts")
    marked = normalize(_faulty_logs(st), st.telemetry.registry, st.telemetry.schema_versions).marked
    write_stage(marked, root, "normalized_logs", counted=True)
    levels = read_stage(spark, root, "alerts", require_rows=True).groupBy(F.col("alert_level").alias("item")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("severity_score").cast("long").alias("severity"))
    counts = integrity_counts(spark, root).unpivot([], ["total_rows", "valid_rows", "dropped_rows"], "item", "n")
    return levels.unionByName(counts.select("item", "n", F.lit(None).cast("long").alias("severity")))


def graph_summary(spark, sf_dir) -> DataFrame:
    st = _s(spark, sf_dir)
    return grf.graph_summary(st.nodes, st.edges)


def degree_histogram(spark, sf_dir) -> DataFrame:
    return vw.degree_histogram(_s(spark, sf_dir).nodes)


def fingerprints(spark, sf_dir) -> DataFrame:
    st = _s(spark, sf_dir)
    c = fpr.with_nodes(st.clusters, st.members)
    return c.select("fingerprint_id", "fingerprint_key", "occurrences", "chunk", F.array_join("nodes", ",").alias("nodes"),
                    F.array_join("headers", ",").alias("headers"), "user_agent", "interval_bucket", "confidence")


def cluster_members(spark, sf_dir) -> DataFrame:
    return _s(spark, sf_dir).members.select("fingerprint_id", "node_id", "occurrences", "confidence")


def node_fingerprint_counts(spark, sf_dir) -> DataFrame:
    return fpr.node_fingerprint_counts(_s(spark, sf_dir).graph_logs)


def top_clusters(spark, sf_dir) -> DataFrame:
    return vw.top_clusters(_s(spark, sf_dir).clusters)


def cluster_confidence_tiers(spark, sf_dir) -> DataFrame:
    return vw.cluster_confidence_tiers(_s(spark, sf_dir).clusters)


def attribution_candidates(spark, sf_dir) -> DataFrame:
    c = _s(spark, sf_dir).candidates
    return c.select("node_id", "score", "out_degree", "fingerprint_matches", "centrality",
                    F.array_join("reasons", SEP).alias("reasons"))


def command_node(spark, sf_dir) -> DataFrame:
    c = _s(spark, sf_dir).command
    return c.select(
        "command_node", "confidence_score", F.array_join("reasons", SEP).alias("reasons"),
        F.array_join(F.transform("candidates", lambda x: x["node_id"]), ",").alias("candidates"),
        F.array_join(F.transform("top_candidates", lambda x: F.concat(x["node"], F.lit(":"),
                                                                        x["score"].cast("string"))), ",")
        .alias("top_candidates"))


def candidate_ranking(spark, sf_dir) -> DataFrame:
    st = _s(spark, sf_dir)
    r = vw.candidate_ranking(att.ranked(st.candidates))
    return r.select("rank", "node_id", "score", "out_degree", "fingerprint_matches", "centrality",
                    F.round("percentage", 4).alias("percentage"), "gap_to_top")


def node_overlay(spark, sf_dir) -> DataFrame:
    st = _s(spark, sf_dir)
    return vw.node_overlay(st.nodes, st.edges, st.members, st.command)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "alerts_by_region_level": alerts_by_region_level,
    "normalized_logs": normalized_logs,
    "integrity_summary": integrity,
    "alerts": alerts,
    "rule_hits": rule_hits,
    "detection_metrics": detection_metrics,
    "metrics_view": metrics,
    "registry_count": registry_count,
    "alert_query": alert_query,
    "alert_page": alert_page,
    "summary_critical": summary_critical,
    "alert_page_cursor": alert_page_cursor,
    "alert_envelope": alert_envelope,
    "summary_view": summary_view,
    "attacked_nodes": attacked_nodes,
    "graph_logs_explicit": graph_logs_explicit,
    "alert_search": alert_search,
    "alert_search_page": alert_search_page,
    "alert_search_indexed": alert_search_indexed,
    "latest_alert_per_node": latest_alert_per_node,
    "latency_top10": latency_top10,
    "status_class_4xx": status_class_4xx,
    "level_distribution": level_distribution,
    "ml_rule_split": ml_rule_split,
    "sanitized_alerts": sanitized_alerts,
    "detection_quality": detection_quality,
    "detection_scores": detection_scores,
    "graph_logs": graph_logs,
    "graph_edges": graph_edges,
    "graph_nodes": graph_nodes,
    "adjacency": adjacency,
    "attacked_node_chunks": attacked_node_chunks,
    "edge_running_mean": edge_running_mean,
    "alert_page_deep": alert_page_deep,
    "asof_scan": asof_scan,
    "stage_round_trip": stage_round_trip,
    "graph_summary": graph_summary,
    "degree_histogram": degree_histogram,
    "fingerprints": fingerprints,
    "cluster_members": cluster_members,
    "node_fingerprint_counts": node_fingerprint_counts,
    "top_clusters": top_clusters,
    "cluster_confidence_tiers": cluster_confidence_tiers,
    "attribution_candidates": attribution_candidates,
    "command_node": command_node,
    "candidate_ranking": candidate_ranking,
    "node_overlay": node_overlay,
}


# --- CSV import path (SRC1, ING1-11) -------------------------------------------------

def _imported(spark, sf_dir):
    from vigil.sources.csv_import import import_tables
    from vigil.sources.csv_shapes import log_csv_rows, registry_csv_rows, schema_csv_rows
    return import_tables(log_csv_rows(spark, sf_dir), registry_csv_rows(spark, sf_dir), schema_csv_rows(spark))


def imported_registry(spark, sf_dir) -> DataFrame:
    reg = _imported(spark, sf_dir).registry
    return reg.select("node_id", "node_name", "ip_address", "hardware_id_b64", "region", "registered_at",
                      "is_infected", "user_agent")


def imported_logs(spark, sf_dir) -> DataFrame:
    logs = _imported(spark, sf_dir).logs
    f = F.col("fields")
    return logs.select("log_id", "node_id", "schema_version", "hardware_id_b64", "timestamp",
                       *[F.try_element_at(f, F.lit(k)).alias(k) for k in
                         ("status", "http_code", "latency", "node_status", "response_code", "response_ms")])


def imported_pipeline_levels(spark, sf_dir) -> DataFrame:
    """Imported tables through normalize + detect: alert counts per level and version."""
    from vigil.operators.detect import detect
    from vigil.operators.normalize import normalize
    imp = _imported(spark, sf_dir)
    d = detect(normalize(imp.logs, imp.registry, imp.schema_versions).logs)
    return d.groupBy("alert_level", "schema_version").agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("severity_score").cast("bigint").alias("severity_sum"))


def csv_registry_rows(spark, sf_dir) -> DataFrame:
    """The registry written as CSV text and parsed back: ordinal and fields of every row."""
    from vigil.sources.csv_import import read_csv_rows
    from vigil.sources.csv_shapes import registry_csv_file
    rows = read_csv_rows(spark, registry_csv_file(spark, sf_dir))
    return rows.select("seq", F.array_join("values", SEP).alias("fields"))


def csv_log_rows(spark, sf_dir) -> DataFrame:
    """The logs written as CSV text and parsed back by header names."""
    from vigil.sources.csv_import import named, read_csv_rows
    from vigil.sources.csv_shapes import log_csv_file
    cols = ["log_id", "node_id", "json_status", "http_response_code", "response_time_ms"]
    return named(read_csv_rows(spark, log_csv_file(spark, sf_dir)), cols).select("seq", *cols)


def validated_records(spark, sf_dir) -> DataFrame:
    """The logs written as NDJSON and read back: order, kept records, rejected ones with the keys they lack."""
    from vigil.session import scratch_path
    from vigil.sources import json_shapes as shapes
    from vigil.sources import json_source as js
    path = scratch_path(spark, "json/logs")
    shapes.log_files(_one_pass(spark, sf_dir).telemetry.logs, path)
    records = js.read_json_records(spark, path, layout="ndjson")
    kept = js.validate_records(records, js.REQUIRED_LOG_KEYS).select(
        "seq", F.col("record")["log_id"].alias("log_id"), F.col("record")["schema_version"].alias("schema_version"), F.lit("").alias("missing"))
    rejected = js.rejected_records(records, js.REQUIRED_LOG_KEYS).select(
        "seq", F.col("record")["log_id"].alias("log_id"), F.lit(None).cast("string").alias("schema_version"),
        F.array_join("missing_keys", ",").alias("missing"))
    return kept.unionByName(rejected)


def loaded_levels(spark, sf_dir) -> DataFrame:
    """The three tables written as JSON files, loaded together, normalized and scored: alerts per region and level."""
    from vigil.operators.detect import detect
    from vigil.operators.normalize import normalize
    from vigil.session import scratch_path
    from vigil.sources import json_shapes as shapes
    from vigil.sources.json_source import load_all
    t, root = _one_pass(spark, sf_dir).telemetry, scratch_path(spark, "json/tables")
    shapes.log_files(t.logs, f"{root}/system_logs.json", whole=True)
    shapes.registry_files(t.registry, f"{root}/node_registry.json")
    shapes.version_files(t.schema_versions, f"{root}/schema_versions.json")
    d = detect(normalize(*load_all(spark, root, layout="ndjson")).logs)
    return d.groupBy("region", "alert_level").agg(F.count(F.lit(1)).alias("alerts"), F.sum("severity_score").cast("bigint").alias("severity_sum"))


QUERIES.update({
    "validated_records": validated_records,
    "loaded_levels": loaded_levels,
    "csv_registry_rows": csv_registry_rows,
    "csv_log_rows": csv_log_rows,
    "imported_registry": imported_registry,
    "imported_logs": imported_logs,
    "imported_pipeline_levels": imported_pipeline_levels,
})


# --- Model channels (DET8, ATT6): no SQL oracle, rows-only check --------------------

def anomaly_levels(spark, sf_dir) -> DataFrame:
    """Isolation-forest scores feeding the ML detection channel; counts per level and ML rule."""
    from vigil.operators.anomaly import fit_isolation_forest
    from vigil.operators.detect import detect
    st = _s(spark, sf_dir)
    model = fit_isolation_forest(st.normalized, n_trees=50, seed=7)
    d = detect(model.score(st.normalized))
    ml_id = F.try_element_at(F.filter("rule_ids", lambda r: F.startswith(r, F.lit("ml_"))), F.lit(1))
    return d.groupBy("alert_level", F.coalesce(ml_id, F.lit("none")).alias("ml_rule")).agg(
        F.count(F.lit(1)).alias("alerts"), F.round(F.min("anomaly_score"), 4).alias("min_score"))


def infection_scores(spark, sf_dir) -> DataFrame:
    """Boosted-tree infection probability per node, out of fold, blended into the attribution score."""
    from vigil.operators.infection_model import out_of_fold_probability
    st = _s(spark, sf_dir)
    probs = out_of_fold_probability(st.detected, st.telemetry.registry)
    cands = att.candidates(st.nodes, st.edges, st.members, ml_probability=probs)
    return cands.select("node_id", F.round("ml_probability", 4).alias("ml_probability"), "score",
                        F.array_join("reasons", SEP).alias("reasons"))


#: Three small trees over http status (0) and latency (1): tree, node, feature, threshold, left, right, rows, depth.
SMALL_FOREST = [
    (0, 0, 0, 400.0, 1, 2, 256, 0), (0, 1, -1, 0.0, -1, -1, 200, 1), (0, 2, 1, 1500.0, 3, 4, 56, 1),
    (0, 3, -1, 0.0, -1, -1, 20, 2), (0, 4, -1, 0.0, -1, -1, 1, 2),
    (1, 0, 1, 2500.0, 1, 2, 256, 0), (1, 1, -1, 0.0, -1, -1, 250, 1), (1, 2, 0, 450.0, 3, 4, 6, 1),
    (1, 3, -1, 0.0, -1, -1, 4, 2), (1, 4, -1, 0.0, -1, -1, 1, 2),
    (2, 0, 0, 0.0, 1, 2, 256, 0), (2, 1, -1, 0.0, -1, -1, 6, 1), (2, 2, 1, 2900.0, 3, 4, 250, 1),
    (2, 3, -1, 0.0, -1, -1, 240, 2), (2, 4, -1, 0.0, -1, -1, 2, 2),
]


def _forest_scored(spark, sf_dir) -> DataFrame:
    from vigil.operators.anomaly import forest_of
    from vigil.operators.detect import detect
    return detect(forest_of(SMALL_FOREST, 256).score_in_plan(_one_pass(spark, sf_dir).normalized))


def small_forest_levels(spark, sf_dir) -> DataFrame:
    """A given forest feeding the ML channel: alerts per level and ML rule."""
    ml_id = F.try_element_at(F.filter("rule_ids", lambda r: F.startswith(r, F.lit("ml_"))), F.lit(1))
    return _forest_scored(spark, sf_dir).groupBy("alert_level", F.coalesce(ml_id, F.lit("none")).alias("ml_rule")).agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("severity_score").cast("bigint").alias("severity_sum"),
        F.round(F.min("anomaly_score"), 6).alias("min_score"))


def small_forest_split(spark, sf_dir) -> DataFrame:
    """ML and rule detections of a run in which the ML channel fires."""
    from vigil.operators.metrics import detection_metrics as row
    return vw.ml_rule_split(row(_forest_scored(spark, sf_dir)))


QUERIES.update({
    "small_forest_levels": small_forest_levels,
    "small_forest_split": small_forest_split,
    "anomaly_levels": anomaly_levels,
    "infection_scores": infection_scores,
})
