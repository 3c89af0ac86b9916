"""Read views over the scored alerts, graph, clusters and attribution (VW1-18).

Filters run before ordering so they push down into the stage scan; every
bounded listing is ``orderBy(...).limit(k)`` (TakeOrderedAndProject: a
per-partition top-k merged on the driver, never a full sort) and carries a
unique tie-breaker (``seq``) so results are deterministic.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.prefix import running_in_order

LEVELS = ("ATTACK", "HIGH_RISK", "SUSPICIOUS", "CLEAN")
DEFAULT_LIMIT = 50
MAX_LIMIT = 500
PAGE_MAX_LIMIT = 100
SEARCH_PAGE_ROWS = 50
PAGE_BLOCK = 4096  # input rows whose alerts of one severity are counted together


def _clamp(value: int, lo: int, hi: int) -> int:
    return min(max(int(value), lo), hi)


def filter_alerts(alerts: DataFrame, level: str | None = None, region: str | None = None,
                  node_id: str | None = None) -> DataFrame:
    """Level (validated, case-insensitive), region (case-insensitive), exact node id."""
    out = alerts
    if level and level.strip().upper() in LEVELS:
        out = out.filter(F.col("alert_level") == level.strip().upper())
    if region:
        out = out.filter(F.upper(F.coalesce(F.col("region"), F.lit(""))) == region.strip().upper())
    if node_id:
        out = out.filter(F.col("node_id") == node_id.strip())
    return out


def alert_query(alerts: DataFrame, level: str | None = None, region: str | None = None,
                node_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Top alerts by severity desc, timestamp desc, input order (VW1)."""
    k = DEFAULT_LIMIT if limit is None else _clamp(limit, 1, MAX_LIMIT)
    top = (filter_alerts(alerts, level, region, node_id)
           .orderBy(F.desc("severity_score"), F.desc("timestamp"), F.asc("seq")).limit(k))
    return top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("severity_score"), F.desc("timestamp"), F.asc("seq"))))


def last_generated(alerts: DataFrame) -> DataFrame:
    """Latest ingestion time over the unfiltered alerts (VW1 envelope)."""
    return alerts.agg(F.max("ingestion_time").alias("last_generated"))


def alert_envelope(alerts: DataFrame, level: str | None = None, region: str | None = None,
                   node_id: str | None = None, limit: int | None = None) -> DataFrame:
    """One row beside the listed alerts: how many are listed, the limit in force, the latest ingestion time (VW1)."""
    k = DEFAULT_LIMIT if limit is None else _clamp(limit, 1, MAX_LIMIT)
    listed = filter_alerts(alerts, level, region, node_id).limit(k).agg(F.count(F.lit(1)).alias("total"))
    return listed.select("total", F.lit(k).alias("limit"), last_generated(alerts).scalar().alias("last_generated"))


def page_ranks(alerts: DataFrame) -> DataFrame:
    """(severity_score, block, n, before): alerts per severity and block of ``seq``, and those listed before them.

    The order is severity desc, ``seq`` asc.  A row per severity and PAGE_BLOCK
    of input, made in one pass; any page of the same alerts can then be found.
    """
    counts = alerts.groupBy("severity_score", F.floor(F.col("seq") / PAGE_BLOCK).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return running_in_order(counts, [F.desc("severity_score"), F.asc("block")], "n", "before", "page-ranks")


def page_rows(alerts: DataFrame, ranks: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` .. ``offset + limit - 1`` of the listing, read from the blocks that hold them.

    At most ``limit`` blocks overlap a page, and at most PAGE_BLOCK rows of the
    first are skipped, however deep the page lies.
    """
    blocks = ranks.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("before").collect()
    if not blocks:
        return alerts.limit(0)
    seq, inside = F.col("seq"), F.lit(False)
    for b in blocks:
        inside = inside | ((F.col("severity_score") == b["severity_score"]) & (seq >= b["block"] * PAGE_BLOCK) & (seq < (b["block"] + 1) * PAGE_BLOCK))
    return alerts.where(inside).orderBy(F.desc("severity_score"), F.asc("seq")).offset(offset - blocks[0]["before"]).limit(limit)


def alert_page(alerts: DataFrame, level: str | None = None, region: str | None = None,
               node_id: str | None = None, page: int = 1, limit: int = 50, ranks: DataFrame | None = None) -> DataFrame:
    """Page of alerts ordered by severity desc (stable), with the pre-paging total (VW2).

    ``ranks``: ``page_ranks`` of the filtered alerts, kept by who reads several pages; made here otherwise.
    """
    lim = _clamp(limit, 1, PAGE_MAX_LIMIT)
    pg = max(int(page), 1)
    filtered = filter_alerts(alerts, level, region, node_id)
    ranks = page_ranks(filtered) if ranks is None else ranks
    total = ranks.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    return page_rows(filtered, ranks, (pg - 1) * lim, lim).select("*", F.lit(pg).alias("page"), F.lit(lim).alias("limit"), total.alias("total"))


def alerts_after(alerts: DataFrame, after: tuple[int, int] | None = None, limit: int = 50) -> DataFrame:
    """The page behind a cursor ``(severity_score, seq)``, the last row of the page before (VW2).

    The same order as ``alert_page``; the rows held never exceed one page, however deep it lies.
    """
    lim = _clamp(limit, 1, PAGE_MAX_LIMIT)
    if after is not None:
        sev, seq = after
        alerts = alerts.filter((F.col("severity_score") < sev) | ((F.col("severity_score") == sev) & (F.col("seq") > seq)))
    return alerts.orderBy(F.desc("severity_score"), F.asc("seq")).limit(lim)


def critical_alerts(alerts: DataFrame, k: int = 5) -> DataFrame:
    """Top ATTACK/HIGH_RISK alerts for the summary (VW3)."""
    return alert_query(alerts.filter(F.col("alert_level").isin("ATTACK", "HIGH_RISK")), limit=k)


def summary(metrics_row: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: the figures of the metrics view, the top critical alerts (at most five) with their count, attacked nodes and their number (VW3)."""
    top = F.sort_array(F.collect_list(F.struct("rank", "log_id", "node_id", "alert_level", "severity_score", "timestamp")))
    critical = critical_alerts(alerts).agg(top.alias("critical_alerts"))
    return metrics_row.select(
        "total_logs", "total_alerts", "attack_count", "high_risk_count", "suspicious_count", "clean_count",
        "ml_detection_count", "attack_percentage", "threat_percentage", "total_nodes",
        critical.scalar().alias("critical_alerts"), "nodes_under_attack", "attacked_node_ids",
    ).withColumn("critical_count", F.size("critical_alerts").cast("bigint"))


def search_alerts(alerts: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring search over node id/name, region, log id (VW5)."""
    q = query.lower()
    hit = F.lit(False)
    for c in ("node_id", "node_name", "region", "log_id"):
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(q))
    return alerts.filter(hit)


def search_page(found: DataFrame, page: int = 1, rows: int = SEARCH_PAGE_ROWS, ranks: DataFrame | None = None) -> DataFrame:
    """One 50-row page of search hits, severity desc then input order (VW5); ``ranks`` as in ``alert_page``."""
    return page_rows(found, page_ranks(found) if ranks is None else ranks, (max(int(page), 1) - 1) * rows, rows)


def _time_then_order(timestamp: Column, seq: Column) -> Column:
    """One fixed-width number that grows with the time and falls with ``seq``; text that is no time comes before all times."""
    micros = F.coalesce(F.unix_micros(F.try_to_timestamp(timestamp)), F.lit(-(10 ** 18)))
    return (micros.cast("decimal(19,0)") * F.lit(Decimal(10 ** 19))
            + (F.lit(2 ** 63 - 1).cast("decimal(19,0)") - seq.cast("decimal(19,0)"))).cast("decimal(38,0)")


def latest_per_node(alerts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Most recent alert per node, by time; equal times keep the earlier input row (VW6).

    Two steps, neither of which sorts the alerts: a hash aggregate of one number
    per node (a hot node is combined map-side), then the winners' other columns
    by a join on node and number.  ``seq`` is unique.  Pass ``columns`` to carry
    only what the view needs, so the scan stays pruned.
    """
    keep = columns or [c for c in alerts.columns if c != "node_id"]
    keep = [c for c in dict.fromkeys(list(keep) + ["timestamp", "seq"]) if c != "node_id"]
    at = _time_then_order(F.col("timestamp"), F.col("seq"))
    last = alerts.groupBy(F.col("node_id").alias("_node")).agg(F.max(at).alias("_last"))
    return (alerts.select("node_id", *keep, at.alias("_at"))
            .join(last, F.col("node_id").eqNullSafe(F.col("_node")) & (F.col("_at") == F.col("_last")))
            .select("node_id", *keep))


def latency_band(rt: Column) -> Column:
    return (F.when(rt >= 3000, "critical").when(rt >= 1500, "high")
            .when(rt >= 800, "elevated").otherwise("normal"))


def latency_top(alerts: DataFrame, k: int = 10) -> DataFrame:
    """Top-k nodes by their latest latency (> 0), with colour bands (VW7)."""
    latest = latest_per_node(alerts, ["response_time_ms", "alert_level"]).filter(F.col("response_time_ms") > 0)
    order = [F.desc("response_time_ms"), F.desc("timestamp"), F.asc("seq")]
    top = latest.orderBy(*order).limit(k)
    return top.select("node_id", "response_time_ms", "alert_level",
                      latency_band(F.col("response_time_ms")).alias("band"),
                      F.row_number().over(Window.orderBy(*order)).alias("rank"))


def status_class(severity: Column) -> Column:
    """Severity -> display status code 200/401/403/500 (VW8)."""
    return (F.when(severity < 30, 200).when(severity < 60, 401).when(severity < 80, 403)
            .otherwise(500))


def status_class_filter(latest: DataFrame, flt: str = "ALL") -> DataFrame:
    code = status_class(F.col("severity_score"))
    df = latest.withColumn("status_code", code)
    if flt == "2XX":
        df = df.filter(F.col("status_code") == 200)
    elif flt == "4XX":
        df = df.filter(F.col("status_code").isin(401, 403))
    elif flt == "5XX":
        df = df.filter(F.col("status_code") >= 500)
    return df


def level_distribution(alerts: DataFrame) -> DataFrame:
    """Count and share of each level (VW9)."""
    total = alerts.agg(F.count(F.lit(1))).scalar()
    return alerts.groupBy("alert_level").agg(F.count(F.lit(1)).alias("alerts")).select(
        "alert_level", "alerts",
        F.when(total > 0, F.round(F.col("alerts") / total * 100, 2)).otherwise(F.lit(0.0)).alias("share_pct"))


def ml_rule_split(metrics: DataFrame) -> DataFrame:
    """ML vs rule detections and the ML rate (VW10)."""
    total = F.col("total_logs_processed")
    return metrics.select(
        F.col("ml_detection_count").alias("ml_detections"),
        (F.col("total_alerts") - F.col("ml_detection_count")).alias("rule_detections"),
        F.when(total > 0, F.round(F.col("ml_detection_count") / total * 100, 2)).otherwise(F.lit(0.0))
        .alias("ml_rate_pct"))


def degree_bucket(deg: Column) -> Column:
    return (F.when(deg < 5, "1-5").when(deg < 10, "5-10").when(deg < 20, "10-20")
            .when(deg < 50, "20-50").otherwise("50+"))


def degree_histogram(nodes: DataFrame) -> DataFrame:
    """Out-degree histogram (VW11); degree 0 lands in the first bucket."""
    return nodes.groupBy(degree_bucket(F.col("out_degree")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("nodes"))


def top_clusters(clusters: DataFrame, k: int = 10) -> DataFrame:
    """Largest clusters by member count (VW12); ties in publication order."""
    order = [F.desc("size"), F.desc("occurrences"), F.desc("confidence"), F.asc("first_seq")]
    c = clusters.withColumn("size", F.col("node_count"))
    return c.orderBy(*order).limit(k).select(
        "fingerprint_id", "size", "confidence", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def confidence_tier(conf: Column) -> Column:
    return F.when(conf >= 0.8, "high").when(conf >= 0.5, "medium").otherwise("low")


def cluster_confidence_tiers(clusters: DataFrame) -> DataFrame:
    """Cluster counts per confidence tier (VW13)."""
    return clusters.groupBy(confidence_tier(F.col("confidence")).alias("tier")).agg(
        F.count(F.lit(1)).alias("clusters"))


def candidate_ranking(ranked: DataFrame) -> DataFrame:
    """Rank, share of the top score (floor 1, cap 100) and runner-up gap (VW14)."""
    top = F.greatest(F.max("score").over(Window.partitionBy(F.lit(1))), F.lit(1.0))
    first = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(Window.partitionBy(F.lit(1)))
    pct_top = F.round(F.col("score") / F.coalesce(F.nullif(first, F.lit(0.0)), F.lit(1.0)) * 100)
    return ranked.select(
        "rank", "node_id", "score", "out_degree", "fingerprint_matches", "centrality",
        F.least(F.lit(100.0), F.col("score") / top * 100).alias("percentage"),
        F.when(F.col("rank").between(2, 4), F.lit(100) - pct_top.cast("bigint")).alias("gap_to_top"))


def node_overlay(nodes: DataFrame, edges: DataFrame, members: DataFrame, command: DataFrame) -> DataFrame:
    """Per node: first cluster (publication order), outgoing requests, command flag (VW15)."""
    w_order = F.struct(F.col("occurrences"), F.col("confidence"), (-F.col("first_seq")).alias("_s"))
    first_fp = members.groupBy("node_id").agg(F.max_by("fingerprint_id", w_order).alias("fingerprint_id"))
    outgoing = edges.groupBy(F.col("source").alias("node_id")).agg(
        F.sum("count").cast("bigint").alias("outgoing_requests"))
    cmd = command.select(F.col("command_node").alias("node_id"), F.lit(True).alias("is_command_node")) \
        .filter(F.col("node_id").isNotNull())
    return (nodes.select("node_id", "out_degree", "severity_score", "node_type")
            .join(first_fp, "node_id", "left").join(outgoing, "node_id", "left")
            .join(cmd, "node_id", "left")
            .select("node_id", "out_degree", "severity_score", "node_type", "fingerprint_id",
                    F.coalesce("outgoing_requests", F.lit(0)).cast("bigint").alias("outgoing_requests"),
                    F.coalesce("is_command_node", F.lit(False)).alias("is_command_node")))


def sanitize_alerts(alerts: DataFrame) -> DataFrame:
    """Read-side guards: unknown level -> CLEAN, scores clamped 0..100, latency floored at 0 (VW16)."""
    lvl = F.coalesce(F.col("alert_level"), F.lit(""))
    return alerts.select(
        "log_id", "node_id",
        F.when(lvl.isin(*LEVELS), lvl).otherwise(F.lit("CLEAN")).alias("alert_level"),
        F.least(F.greatest(F.coalesce(F.col("severity_score"), F.lit(0)), F.lit(0)), F.lit(100))
        .cast("bigint").alias("severity_score"),
        F.least(F.greatest(F.coalesce(F.col("confidence_score"), F.lit(0)), F.lit(0)), F.lit(100))
        .cast("bigint").alias("confidence_score"),
        F.greatest(F.floor(F.coalesce(F.col("response_time_ms"), F.lit(0))), F.lit(0))
        .cast("bigint").alias("response_time_ms"),
        "seq")


def detection_quality(detected: DataFrame, registry: DataFrame) -> DataFrame:
    """Confusion counts of flagged nodes vs the registry's infection label (VW18).

    A node is flagged when any of its logs is an ATTACK; nodes without logs
    count as not flagged.  Output: one row per (is_infected, flagged).
    """
    flagged = detected.groupBy("node_id").agg(F.max(F.col("alert_level") == "ATTACK").alias("flagged"))
    reg = registry.select("node_id", F.coalesce(F.col("is_infected"), F.lit(False)).alias("is_infected"))
    joined = reg.join(flagged, "node_id", "left").select(
        "is_infected", F.coalesce(F.col("flagged"), F.lit(False)).alias("flagged"))
    return joined.groupBy("is_infected", "flagged").agg(F.count(F.lit(1)).alias("nodes"))


def detection_scores(quality: DataFrame) -> DataFrame:
    """Precision / recall of the flag against the label (VW18)."""
    tp = F.sum(F.when(F.col("is_infected") & F.col("flagged"), F.col("nodes")).otherwise(0))
    fp = F.sum(F.when(~F.col("is_infected") & F.col("flagged"), F.col("nodes")).otherwise(0))
    fn = F.sum(F.when(F.col("is_infected") & ~F.col("flagged"), F.col("nodes")).otherwise(0))
    agg = quality.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return agg.select(
        "tp", "fp", "fn",
        F.when(F.col("tp") + F.col("fp") > 0, F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 4))
        .otherwise(F.lit(0.0)).alias("precision"),
        F.when(F.col("tp") + F.col("fn") > 0, F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 4))
        .otherwise(F.lit(0.0)).alias("recall"))
