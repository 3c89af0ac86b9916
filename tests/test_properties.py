"""Property tests: Python cast semantics, partitioning invariance, graph invariants."""

import random


from tests.conftest import SF001


def _py_int(s, default=-1):
    """The semantics being matched: int(float(str(v).strip())), failures -> default."""
    try:
        return int(float(s.strip()))
    except (ValueError, OverflowError):
        return default


def test_safe_int_matches_python_on_random_text(spark):
    from vigil.functions import safe_int
    rng = random.Random(7)
    alphabet = "0123456789._eE+- "
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    words += ["inf", "-inf", "nan", "Infinity", "1e400", "0x10", "1_000", "1__0", "_1", "1_", ".5", "5.", "."]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = dict((r.w, r.v) for r in df.select("w", safe_int("w", -1).alias("v")).collect())
    bad = {w: (got[w], _py_int(w)) for w in words
           if got[w] != _py_int(w) and abs(_py_int(w)) < 2 ** 62}
    assert not bad, list(bad.items())[:10]


def test_detection_independent_of_partitioning(spark):
    from vigil.operators.detect import detect
    from vigil.operators.normalize import normalize
    from vigil.sources.telemetry import telemetry
    t = telemetry(spark, SF001)
    cols = ["log_id", "alert_level", "severity_score", "confidence_score", "rule_ids"]
    a = detect(normalize(t.logs, t.registry, t.schema_versions).logs).select(*cols)
    b = detect(normalize(t.logs.repartition(7, "node_id"), t.registry.repartition(3),
                         t.schema_versions).logs).select(*cols)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_graph_independent_of_partitioning_and_blocks(spark):
    from vigil.operators import graph as grf
    from vigil.plans.stages import Stages
    st = Stages(spark, SF001, materialize=False)
    cols = ["log_id", "source_node", "target_node", "interval", "headers", "user_agent"]
    a = grf.graph_ready_logs(st.detected, st.telemetry.registry).select(*cols)
    b = grf.graph_ready_logs(st.detected.repartition(5), st.telemetry.registry, block_rows=37).select(*cols)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_alert_join_last_wins(spark):
    from vigil.operators import graph as grf
    logs = spark.createDataFrame([("L1", "A", "2024-01-01T00:00:00Z", "r", 1, 5, 0)],
                                 "log_id string, node_id string, timestamp string, region string, "
                                 "schema_version bigint, response_time_ms bigint, seq bigint")
    alerts = spark.createDataFrame([("L1", 10, "SUSPICIOUS", 0), ("L1", 95, "ATTACK", 1)],
                                   "log_id string, severity_score bigint, alert_level string, seq bigint")
    reg = spark.createDataFrame([("A", "ua", 0), ("B", "ua", 1)], "node_id string, user_agent string, seq bigint")
    r = grf.graph_ready_logs(logs, reg, alerts=alerts).collect()[0]
    assert (r.severity_score, r.alert_level) == (95.0, "ATTACK")
