"""Detection: rule hits -> level, severity, confidence, alert row (DET1-7, DET10).

All rules are evaluated in one projection into an ordered array of hit
structs; level, severity and confidence are higher-order functions over that
array.  No explode, no join, no shuffle: detection is a map-only stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.graphfn import ISO_OUT_FORMAT
from vigil.functions.scalars import present_in_order, safe_float
from vigil.operators.rules import PRIORITY_ORDER, SEVERITY_BASE, Rule, default_rules, ml_rules

ALERT_COLUMNS = [
    "log_id", "node_id", "node_name", "region", "timestamp", "ingestion_time", "alert_level",
    "severity_score", "confidence_score", "is_anomaly", "primary_reason", "reasons", "rule_ids",
    "source_data", "parse_warnings",
]


def rule_flags(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One boolean column per rule (``_r<i>``), evaluated once (DET1)."""
    return df.select("*", *[F.coalesce(r.condition(), F.lit(False)).alias(f"_r{i}")
                            for i, r in enumerate(rules)])


def alert_level(rules: list[Rule]) -> Column:
    """Highest level among fired rules; INFO rules never raise it (DET3)."""
    out = F.lit("CLEAN")
    for level in reversed(PRIORITY_ORDER[:-1]):
        fired = [F.col(f"_r{i}") for i, r in enumerate(rules) if r.level == level]
        if fired:
            cond = fired[0]
            for c in fired[1:]:
                cond = cond | c
            out = F.when(cond, F.lit(level)).otherwise(out)
    return out


def severity(level: Column, rules: list[Rule]) -> Column:
    """min(base(level) + sum(bonus of fired rules), 100) (DET4)."""
    base = F.lit(0)
    for lv, points in SEVERITY_BASE.items():
        base = F.when(level == lv, F.lit(points)).otherwise(base)
    bonus = F.lit(0)
    for i, r in enumerate(rules):
        bonus = bonus + F.when(F.col(f"_r{i}"), F.lit(r.bonus)).otherwise(F.lit(0))
    return F.least(base + bonus, F.lit(100)).cast("bigint")


def _n_fired(rules: list[Rule]) -> Column:
    n = F.lit(0)
    for i, _ in enumerate(rules):
        n = n + F.col(f"_r{i}").cast("int")
    return n


def _ml_fired(rules: list[Rule]) -> Column:
    out = F.lit(False)
    for i, r in enumerate(rules):
        if r.ml:
            out = out | F.col(f"_r{i}")
    return out


def confidence(rules: list[Rule]) -> Column:
    """min(25 * #reasons, 100), +25 when the ML channel fired (DET5)."""
    plain = F.least(_n_fired(rules) * 25, F.lit(100))
    return F.when(_ml_fired(rules), F.least(plain + 25, F.lit(100))).otherwise(plain).cast("bigint")


def detect(normalized: DataFrame, rules: list[Rule] | None = None, with_ml: bool | None = None) -> DataFrame:
    """Score every normalized log; keeps the input columns and adds the alert columns.

    Rules become boolean columns, level/severity/confidence are CASE and
    arithmetic over them, and reasons/rule ids are the
    fired entries in rule order (DET2: rule channel first, then ML), built
    without lambdas so the projection stays in whole-stage codegen.
    ``with_ml`` defaults to "an ``anomaly_score`` column is present" -- the
    model-less branch (DET8 no-op) when it is absent.
    """
    rules = list(rules) if rules is not None else default_rules()
    if with_ml is None:
        with_ml = "anomaly_score" in normalized.columns
    df = normalized
    if with_ml:
        rules = rules + ml_rules()
        df = df.withColumn("_ml_http", safe_float("http_status")).withColumn("_ml_rt", safe_float("response_time_ms"))
    valid_ids = (F.coalesce(F.trim(F.col("log_id")), F.lit("")) != "") & \
                (F.coalesce(F.trim(F.col("node_id")), F.lit("")) != "")
    df = rule_flags(df.filter(valid_ids), rules)
    reasons = present_in_order([F.when(F.col(f"_r{i}"), r.reason()) for i, r in enumerate(rules)])
    rule_ids = present_in_order([F.when(F.col(f"_r{i}"), F.lit(r.id)) for i, r in enumerate(rules)])
    df = df.withColumn("alert_level", alert_level(rules))
    out = df.select(
        "*",
        severity(F.col("alert_level"), rules).alias("severity_score"),
        confidence(rules).alias("confidence_score"),
        (F.col("alert_level") != "CLEAN").alias("is_anomaly"),
        reasons.alias("reasons"),
        rule_ids.alias("rule_ids"),
        _ml_fired(rules).alias("ml_detected"),
        F.date_format(F.current_timestamp(), ISO_OUT_FORMAT).alias("ingestion_time"),
    ).withColumn("primary_reason", F.try_element_at(F.col("reasons"), F.lit(1)))
    drop = [f"_r{i}" for i in range(len(rules))] + (["_ml_http", "_ml_rt"] if with_ml else [])
    return out.drop(*drop)


def source_data() -> Column:
    return F.struct(
        F.coalesce(F.col("reported_status"), F.lit("UNKNOWN")).alias("reported_status"),
        F.coalesce(F.col("http_status"), F.lit(-1)).alias("http_status"),
        F.coalesce(F.col("response_time_ms"), F.lit(-1)).alias("response_time_ms"),
        F.col("hardware_id_b64"),
        F.coalesce(F.col("hardware_id_valid"), F.lit(False)).alias("hardware_id_valid"),
        F.col("hardware_id_decoded"),
        F.coalesce(F.col("schema_version"), F.lit(-1)).alias("schema_version"),
        F.coalesce(F.col("schema_known"), F.lit(False)).alias("schema_known"),
    )


def alerts(detected: DataFrame) -> DataFrame:
    """The alert projection with nested ``source_data`` (DET6).

    ``response_time_ms`` is also kept as a flat column (a copy of
    ``source_data.response_time_ms``) so latency views prune to one column.
    """
    cols = [c for c in ALERT_COLUMNS if c != "source_data"]
    return detected.select(*cols[:13], source_data().alias("source_data"), "parse_warnings", "seq",
                           F.coalesce(F.col("response_time_ms"), F.lit(-1)).alias("response_time_ms"))
