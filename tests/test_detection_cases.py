"""The reference's nine detection cases plus two of our own, exact values (FIXTURES §2)."""

from pyspark.sql import functions as F

from vigil.operators.detect import detect
from vigil.operators.metrics import attacked_nodes, detection_metrics

SCHEMA = ("log_id string, node_id string, node_name string, region string, schema_version bigint, "
          "schema_known boolean, reported_status string, http_status bigint, response_time_ms bigint, "
          "hardware_id_b64 string, hardware_id_valid boolean, hardware_id_decoded string, "
          "hardware_id_reason string, timestamp string, parse_warnings array<string>, seq bigint")

# (status, http, rt, hw_valid, known) -> (level, severity, confidence, rule ids)
CASES = [
    (("OPERATIONAL", 200, 290, True, True), ("CLEAN", 0, 0, [])),
    (("OPERATIONAL", 200, 1800, True, True), ("SUSPICIOUS", 30, 25, ["elevated_latency"])),
    (("OPERATIONAL", 200, 3500, True, True), ("HIGH_RISK", 58, 25, ["extreme_latency"])),
    (("OPERATIONAL", 500, 4200, False, True), ("ATTACK", 100, 100, [
        "status_contradiction", "server_error", "invalid_hardware_id", "extreme_latency"])),
    (("OPERATIONAL", 502, 2700, False, True), ("ATTACK", 100, 100, [
        "status_contradiction", "server_error", "invalid_hardware_id", "elevated_latency"])),
    (("MAINTENANCE", -1, -1, True, True), ("ATTACK", 88, 25, ["unknown_http_status"])),
    (("OPERATIONAL", 200, 290, False, True), ("ATTACK", 95, 25, ["invalid_hardware_id"])),
    (("UNKNOWN", -1, -1, True, False), ("ATTACK", 91, 50, ["unknown_http_status", "schema_unknown"])),
    (("OPERATIONAL", 200, 3000, True, True), ("HIGH_RISK", 58, 25, ["extreme_latency"])),
    (("OPERATIONAL", 200, 290, True, False), ("CLEAN", 3, 25, ["schema_unknown"])),
    (("OPERATIONAL", 200, 290, None, True), ("ATTACK", 95, 25, ["invalid_hardware_id"])),
]


def _frame(spark, cases):
    data = []
    for i, ((status, http, rt, hw, known), _) in enumerate(cases):
        data.append((f"LOG-{i}", "NODE-001", "n", "US-EAST", 1 if known else 9, known, status, http, rt,
                     "U04tOTI4MA==", hw, "SN-9280", None if hw else "bad", "2024-03-01T12:05:00Z", [], i))
    return spark.createDataFrame(data, SCHEMA)


def test_reference_cases(spark):
    out = detect(_frame(spark, CASES)).orderBy("seq").collect()
    for row, (_, (level, sev, conf, ids)) in zip(out, CASES):
        assert (row.alert_level, row.severity_score, row.confidence_score, list(row.rule_ids)) == (level, sev, conf, ids), row.log_id
        assert row.is_anomaly == (level != "CLEAN")
        assert row.primary_reason == (row.reasons[0] if ids else None)


def test_elevated_not_at_3000(spark):
    row = detect(_frame(spark, [CASES[8]])).collect()[0]
    assert "elevated_latency" not in row.rule_ids


def test_batch_of_four(spark):
    cases = [CASES[0], CASES[1], CASES[2], CASES[3]]
    df = _frame(spark, cases).withColumn("schema_version", F.col("seq") % 3 + 1)
    m = detection_metrics(detect(df)).collect()[0]
    assert (m.total_logs_processed, m.attack_count, m.high_risk_count, m.suspicious_count, m.clean_count) == (4, 1, 1, 1, 1)
    assert m.avg_response_time_ms == 2447.5
    assert m.invalid_hw_count == 1
    assert m.nodes_under_attack == 1
    assert [r.node_id for r in attacked_nodes(detect(df)).collect()] == ["NODE-001"]
    assert list(m.schema_versions_seen) == [1, 2, 3]


def test_reason_texts(spark):
    row = detect(_frame(spark, [CASES[3]])).collect()[0]
    assert row.reasons[0] == "Deceptive node: reports OPERATIONAL but HTTP=500 (>= 400)"
    assert row.reasons[1] == "Server failure: HTTP=500 (>= 500)"
    assert row.reasons[3] == "Extreme latency: 4200ms (>= 3000ms threshold)"
