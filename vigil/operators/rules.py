"""Detection rules as configuration (RUL1-8).

A rule is data: an id, the level it raises, the severity bonus it adds, a
boolean Column and a reason Column.  Rules are evaluated together in one
projection (no explode), so adding a rule adds one ``CASE`` to the generated
code.  Users extend detection by appending ``Rule`` objects to
``default_rules()`` and passing the list to ``detect``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (thresholds, levels, bonuses) -- must equal the reference.
HTTP_ATTACK_THRESHOLD = 400
HTTP_SERVER_ERROR_THRESHOLD = 500
LATENCY_HIGH_RISK_MS = 3000
LATENCY_SUSPICIOUS_MS = 1500
SENTINEL_INT = -1

SEVERITY_BASE = {"ATTACK": 80, "HIGH_RISK": 50, "SUSPICIOUS": 25, "CLEAN": 0}
PRIORITY_ORDER = ["ATTACK", "HIGH_RISK", "SUSPICIOUS", "CLEAN"]
LEVEL_RANK = {"CLEAN": 0, "SUSPICIOUS": 1, "HIGH_RISK": 2, "ATTACK": 3}

# Anomaly-score thresholds of the ML channel (score <= threshold fires).
ML_ATTACK_SCORE = -0.65
ML_HIGH_RISK_SCORE = -0.62
ML_SUSPICIOUS_SCORE = -0.56


@dataclass(frozen=True)
class Rule:
    id: str
    level: str                      # ATTACK | HIGH_RISK | SUSPICIOUS | INFO
    bonus: int
    condition: Callable[[], Column]
    reason: Callable[[], Column]
    ml: bool = field(default=False)


def _http() -> Column:
    return F.coalesce(F.col("http_status").cast("bigint"), F.lit(SENTINEL_INT).cast("bigint"))


def _rt() -> Column:
    return F.coalesce(F.col("response_time_ms").cast("bigint"), F.lit(SENTINEL_INT).cast("bigint"))


def _status() -> Column:
    return F.coalesce(F.upper(F.trim(F.col("reported_status"))), F.lit(""))


def default_rules(http_attack: int = HTTP_ATTACK_THRESHOLD, http_server: int = HTTP_SERVER_ERROR_THRESHOLD,
                  latency_high: int = LATENCY_HIGH_RISK_MS, latency_suspicious: int = LATENCY_SUSPICIOUS_MS) -> list[Rule]:
    """The seven reference rules, in evaluation (= reason) order."""
    return [
        Rule("status_contradiction", "ATTACK", 10,
             lambda: (_http() != SENTINEL_INT) & (_status() == "OPERATIONAL") & (_http() >= http_attack),
             lambda: F.format_string(f"Deceptive node: reports OPERATIONAL but HTTP=%d (>= {http_attack})", _http())),
        Rule("server_error", "ATTACK", 10,
             lambda: (_http() != SENTINEL_INT) & (_http() >= http_server),
             lambda: F.format_string(f"Server failure: HTTP=%d (>= {http_server})", _http())),
        Rule("invalid_hardware_id", "ATTACK", 15,
             lambda: ~F.coalesce(F.col("hardware_id_valid"), F.lit(False)),
             lambda: F.concat(F.lit("Invalid hardware ID: "), F.coalesce(
                 F.nullif(F.col("hardware_id_reason"), F.lit("")),
                 F.lit("hardware_id_b64 is missing or failed validation")))),
        Rule("unknown_http_status", "ATTACK", 8,
             lambda: _http() == SENTINEL_INT,
             lambda: F.lit("HTTP status is missing (field not found in log) — node health unverifiable")),
        Rule("extreme_latency", "HIGH_RISK", 8,
             lambda: (_rt() != SENTINEL_INT) & (_rt() >= latency_high),
             lambda: F.format_string(f"Extreme latency: %dms (>= {latency_high}ms threshold)", _rt())),
        Rule("elevated_latency", "SUSPICIOUS", 5,
             lambda: (_rt() != SENTINEL_INT) & (_rt() >= latency_suspicious) & (_rt() < latency_high),
             lambda: F.format_string(
                 f"Elevated latency: %dms (>= {latency_suspicious}ms, < {latency_high}ms)", _rt())),
        Rule("schema_unknown", "INFO", 3,
             lambda: ~F.coalesce(F.col("schema_known"), F.lit(True)),
             lambda: F.format_string("Unknown schema version=%s — field mapping may be incomplete",
                                     F.coalesce(F.col("schema_version").cast("string"), F.lit("None")))),
    ]


def _ml_reason(label: str) -> Callable[[], Column]:
    return lambda: F.format_string(f"[ML] {label} (score=%.3f, http=%.0f, rt=%.0fms)",
                                   F.col("anomaly_score"), F.col("_ml_http"), F.col("_ml_rt"))


def ml_rules(attack: float = ML_ATTACK_SCORE, high: float = ML_HIGH_RISK_SCORE,
             suspicious: float = ML_SUSPICIOUS_SCORE) -> list[Rule]:
    """Anomaly-channel rules over an ``anomaly_score`` column (DET8 thresholds)."""
    s = lambda: F.col("anomaly_score")
    return [
        Rule("ml_anomaly_critical", "ATTACK", 20, lambda: s() <= attack,
             _ml_reason("Critical anomaly detected"), ml=True),
        Rule("ml_anomaly_high", "HIGH_RISK", 12, lambda: (s() > attack) & (s() <= high),
             _ml_reason("High-risk anomaly detected"), ml=True),
        Rule("ml_anomaly_suspicious", "SUSPICIOUS", 6, lambda: (s() > high) & (s() <= suspicious),
             _ml_reason("Suspicious behavior detected"), ml=True),
    ]
