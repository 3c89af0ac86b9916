"""Command-node attribution (ATT1-5, ATT7-11).

Per-node signals come from the edge and cluster tables (both far smaller
than the logs), so attribution never rescans logs.  Ranking uses a
distributed top-k (``orderBy().limit()`` -> TakeOrderedAndProject); only the
top five candidates are gathered, into one result row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.scalars import present_in_order

# Heuristic weights and blend ratios.
W_OUT_DEGREE = 0.4
W_FINGERPRINT_MATCHES = 0.35
W_CENTRALITY = 0.25
ML_WEIGHT = 0.6
HEURISTIC_WEIGHT = 0.4
TOP_CANDIDATES = 5
TOP_SUMMARY = 3

# Explanation texts.
NO_GRAPH = "No graph data available"
NO_SIGNAL = "No strong command node signal found"
FALLBACK_REASON = "Elevated network activity relative to baseline"


def fingerprint_matches(members: DataFrame) -> DataFrame:
    """node -> sum of occurrences of the clusters containing it (ATT1)."""
    return (members.groupBy("node_id").agg(F.sum("occurrences").cast("bigint").alias("fingerprint_matches")))


def outgoing_stats(edges: DataFrame) -> DataFrame:
    """Interval statistics over a node's edges with interval >= 0 (ATT2)."""
    iv = F.when(F.col("interval") >= 0, F.col("interval").cast("double"))
    return edges.groupBy(F.col("source").alias("node_id")).agg(
        F.count(iv).alias("n_intervals"), F.min(iv).alias("min_interval"),
        F.max(iv).alias("max_interval"), F.avg(iv).alias("avg_interval"),
        F.sum("count").cast("bigint").alias("outgoing_requests"))


def node_features(detected: DataFrame) -> DataFrame:
    """Per-node model features: mean/max latency, log count, errors (ATT5)."""
    return detected.groupBy("node_id").agg(
        F.avg("response_time_ms").alias("avg_response_time"),
        F.max("response_time_ms").cast("double").alias("max_response_time"),
        F.count(F.lit(1)).cast("double").alias("log_count"),
        F.count_if(F.col("http_status") >= 400).cast("double").alias("error_count"))


def _fmt1(x: Column) -> Column:
    """Python-like '{:.1f}' text (half-even on the decimal value)."""
    return F.bround(x, 1).cast("decimal(38,1)").cast("string")


def explain_reasons(has_model: bool = False) -> Column:
    """Ordered explanation list with the fallback text (ATT7)."""
    deg, fp, cent = F.col("out_degree"), F.col("fingerprint_matches"), F.col("centrality")
    prob = F.col("ml_probability")
    pct = F.format_string("%d%%", F.round(prob * 100).cast("bigint"))
    ml = (F.when(F.lit(has_model) & (prob > 0.85), F.concat(F.lit("[ML] High C2 confidence: "), pct,
                                                          F.lit(" match to known attack patterns")))
          .when(F.lit(has_model) & (prob > 0.75), F.concat(F.lit("[ML] Elevated C2 probability: "), pct,
                                                         F.lit(" behavioral similarity")))
          .when(F.lit(has_model) & (prob > 0.65), F.concat(F.lit("[ML] Moderate C2 signal: "), pct,
                                                         F.lit(" pattern match"))))
    centrality = (F.when(cent >= 0.3, "Extremely high network centrality — primary communication hub")
                  .when(cent >= 0.2, "High centrality — significant control over network traffic")
                  .when(cent >= 0.1, "Moderate centrality — notable influence in graph")
                  .when(cent >= 0.05, "Elevated centrality position"))
    fps = (F.when(fp >= 20, F.format_string(
               "Repeated fingerprint cluster (%d matches) — strong automation signature", fp))
           .when(fp >= 10, F.format_string("Multiple fingerprint matches (%d) — consistent behavioral pattern", fp))
           .when(fp >= 5, F.format_string("Fingerprint pattern detected (%d matches)", fp))
           .when(fp >= 3, F.lit("Multiple fingerprint occurrences")))
    span = F.col("max_interval") - F.col("min_interval")
    timing = F.when(F.col("n_intervals") >= 3, (
        F.when(span <= 2, F.concat(F.lit("Highly regular timing (±"), _fmt1(span),
                                   F.lit("s variance) — automated beacon behavior")))
        .when(span <= 5, F.concat(F.lit("Consistent timing pattern (avg: "), _fmt1(F.col("avg_interval")),
                                  F.lit("s) — scripted activity")))
        .when(span <= 15, F.lit("Moderately consistent request intervals"))))
    volume = (F.when(deg >= 50, F.format_string(
                  "Extremely high connection volume (%d outgoing) — command distribution hub", deg))
              .when(deg >= 25, F.format_string("High outgoing connections (%d) — significant target reach", deg))
              .when(deg >= 15, F.format_string("Significant connection count (%d targets)", deg))
              .when(deg >= 8, F.lit("Notable outgoing connection activity")))
    reasons = present_in_order([ml, centrality, fps, timing, volume])
    return F.when(F.size(reasons) == 0, F.array(F.lit(FALLBACK_REASON))).otherwise(reasons)


def candidates(nodes: DataFrame, edges: DataFrame, members: DataFrame,
               ml_probability: DataFrame | None = None) -> DataFrame:
    """Scored candidate nodes after the weak-signal filter (ATT3, ATT4, ATT7)."""
    df = (nodes.select("node_id", "out_degree", "centrality")
          .join(fingerprint_matches(members), "node_id", "left")
          .join(outgoing_stats(edges), "node_id", "left")
          .withColumn("fingerprint_matches", F.coalesce(F.col("fingerprint_matches"), F.lit(0)).cast("bigint"))
          .withColumn("n_intervals", F.coalesce(F.col("n_intervals"), F.lit(0))))
    df = df.filter(~((F.col("out_degree") <= 0) & (F.col("fingerprint_matches") <= 1)))
    heuristic = (F.col("out_degree") * W_OUT_DEGREE + F.col("fingerprint_matches") * W_FINGERPRINT_MATCHES
                 + F.col("centrality") * W_CENTRALITY)
    has_model = ml_probability is not None
    if has_model:
        df = df.join(ml_probability.select("node_id", "ml_probability"), "node_id", "left") \
            .withColumn("ml_probability", F.coalesce(F.col("ml_probability"), F.lit(0.0)))
        score = F.col("ml_probability") * ML_WEIGHT + heuristic * HEURISTIC_WEIGHT
    else:
        df = df.withColumn("ml_probability", F.lit(0.0))
        score = heuristic
    return df.select(
        "node_id", F.round(score, 4).alias("score"), "out_degree", "fingerprint_matches",
        F.round("centrality", 4).alias("centrality"), explain_reasons(has_model).alias("reasons"),
        "ml_probability",
    )


def ranked(cands: DataFrame, k: int = TOP_CANDIDATES) -> DataFrame:
    """Top-k by score desc, node id asc, with 1-based rank (ATT8)."""
    top = cands.orderBy(F.desc("score"), F.asc("node_id")).limit(k)
    # numbering window over the k kept rows only
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc("node_id"))))


def command_node(nodes: DataFrame, cands: DataFrame) -> DataFrame:
    """The one-row attribution result (ATT9-11)."""
    n_nodes = nodes.agg(F.count(F.lit(1))).scalar()
    top = ranked(cands)
    cand = F.struct("rank", "node_id", "score", "out_degree", "fingerprint_matches", "centrality", "reasons")
    agg = top.agg(
        F.sort_array(F.collect_list(cand)).alias("_c"),
    )
    c = F.col("_c")
    m = F.try_element_at(c, F.lit(1))["score"]
    s = F.coalesce(F.try_element_at(c, F.lit(2))["score"], F.lit(0.0))
    gap = F.when(m > 0, (m - s) / m).otherwise(F.lit(0.0))
    conf = F.least(F.lit(0.99), F.round(F.lit(0.55) + m / (m + F.lit(3.0)) + gap * 0.15, 2))
    empty = F.size(c) == 0
    fixed = F.when(n_nodes == 0, F.lit(NO_GRAPH)).otherwise(F.lit(NO_SIGNAL))
    candidates_out = F.transform(c, lambda x: x.dropFields("rank"))
    top3 = F.transform(F.slice(c, 1, TOP_SUMMARY), lambda x: F.struct(
        x["node_id"].alias("node"), x["score"].alias("score")))
    return agg.select(
        F.when(empty, F.lit(None).cast("string")).otherwise(F.try_element_at(c, F.lit(1))["node_id"])
        .alias("command_node"),
        F.when(empty, F.lit(0.0)).otherwise(conf).alias("confidence_score"),
        F.when(empty, F.array(fixed)).otherwise(F.try_element_at(c, F.lit(1))["reasons"]).alias("reasons"),
        candidates_out.alias("candidates"),
        top3.alias("top_candidates"),
    )
