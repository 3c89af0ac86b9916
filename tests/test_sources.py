"""JSON loader key validation, stage sinks, streaming, entry contract."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001


def _write(path, data):
    with open(path, "w") as f:
        f.write(data if isinstance(data, str) else json.dumps(data))


@pytest.fixture(scope="module")
def json_dir():
    d = tempfile.mkdtemp(prefix="vigil-json-")
    _write(f"{d}/system_logs.json", [
        {"log_id": "L1", "node_id": "NODE-001", "schema_version": 1, "timestamp": "2024-03-01T12:05:00Z",
         "status": "OPERATIONAL", "http_code": 200, "latency": 290},
        {"log_id": "L2", "node_id": "NODE-001", "timestamp": "2024-03-01T12:05:00Z"},
        {"log_id": "L3", "node_id": "NODE-001", "schema_version": None, "status": "x"},
        {"log_id": "L4", "node_id": " ", "schema_version": 1},
        {"log_id": "L5", "node_id": "NODE-001", "schema_version": 1, "http_code": "inf"},
        "not an object",
    ])
    _write(f"{d}/node_registry.json", [{"node_id": "NODE-001", "node_name": "A", "region": "US-EAST",
                                        "hardware_id_b64": "U04tOTI4MA=="}])
    _write(f"{d}/schema_versions.json", [{"version": 1, "field_map": {
        "reported_status": "status", "http_status": "http_code", "response_time_ms": "latency"}}])
    return d


def test_loader_keys_and_integrity(spark, json_dir):
    from vigil.operators.normalize import integrity_summary, normalize
    from vigil.sources.json_source import REQUIRED_LOG_KEYS, load_all, read_json_records, rejected_records
    logs, reg, sv = load_all(spark, json_dir)
    assert sorted(r.log_id for r in logs.collect()) == ["L1", "L3", "L4", "L5"]
    rej = rejected_records(read_json_records(spark, f"{json_dir}/system_logs.json"), REQUIRED_LOG_KEYS).collect()
    assert len(rej) == 2 and ["schema_version"] in [list(r.missing_keys) for r in rej]
    n = normalize(logs, reg, sv)
    s = integrity_summary(n.flagged).collect()[0]
    assert (s.total_rows, s.valid_rows, s.dropped_rows) == (4, 2, 2)
    l3 = n.logs.filter("log_id = 'L3'").collect()[0]
    assert (l3.schema_version, l3.schema_known, l3.reported_status) == (-1, False, "X")


def test_missing_and_non_array_files(spark, json_dir):
    from vigil.sources.json_source import read_json_records
    assert read_json_records(spark, f"{json_dir}/nope.json").count() == 0
    _write(f"{json_dir}/obj.json", {"a": 1})
    assert read_json_records(spark, f"{json_dir}/obj.json").count() == 0


def test_stage_sink_roundtrip(spark):
    from vigil.sources.sinks import StageMissing, read_stage, write_stage
    root = tempfile.mkdtemp(prefix="vigil-stage-")
    df = spark.createDataFrame([("A", "ATTACK"), ("B", "CLEAN")], "log_id string, alert_level string")
    write_stage(df, root, "alerts")
    assert os.path.isdir(f"{root}/alerts/v000001/alert_level=ATTACK")
    assert read_stage(spark, root, "alerts").filter("alert_level = 'ATTACK'").count() == 1
    with pytest.raises(StageMissing):
        read_stage(spark, root, "graph_nodes")


def test_streaming_matches_batch(spark):
    from vigil.operators.detect import detect
    from vigil.operators.normalize import normalize
    from vigil.sources.telemetry import telemetry
    from vigil.streaming.detect_stream import raw_log_stream, scored_stream, start_level_counts
    t = telemetry(spark, SF001)
    d = tempfile.mkdtemp(prefix="vigil-stream-")
    t.logs.repartition(3).write.parquet(f"{d}/in")
    q = start_level_counts(scored_stream(raw_log_stream(spark, f"{d}/in", 1), t.registry, t.schema_versions),
                           "vigil_levels", f"{d}/ck", available_now=True)
    q.awaitTermination()
    streamed = {r.alert_level: r.alerts for r in spark.sql("select * from vigil_levels").collect()}
    batch = {r.alert_level: r["count"] for r in
             detect(normalize(t.logs, t.registry, t.schema_versions).logs).groupBy("alert_level").count().collect()}
    assert streamed == batch


def test_entry_contract(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"alert_count", "avg_severity", "region", "alert_level"} <= set(df.columns)


def test_isolation_forest_planted_outliers(spark):
    from vigil.operators.anomaly import fit_isolation_forest
    rows = [(i, 200, 100 + (i % 20), None, None) for i in range(2000)]
    rows += [(5000 + i, 503, 90000 + i, None, None) for i in range(5)]
    df = spark.createDataFrame(rows, "seq bigint, http_status bigint, response_time_ms bigint, load_val string, L_V1 string")
    model = fit_isolation_forest(df, n_trees=40, sample_size=128, seed=3)
    scored = model.score(df)
    outlier = scored.filter("seq >= 5000").agg(F.max("anomaly_score")).collect()[0][0]
    normal = scored.filter("seq < 5000").agg(F.percentile_approx("anomaly_score", 0.5)).collect()[0][0]
    assert outlier < normal and outlier < -0.6


def test_ndjson_layout(spark, tmp_path):
    from vigil.sources.json_source import REQUIRED_LOG_KEYS, logs_from_records, read_json_records, validate_records
    lines = [
        json.dumps({"log_id": "A", "node_id": "N1", "schema_version": 2, "response_code": 503, "extra": "x"}),
        json.dumps({"log_id": "B", "node_id": "N2"}),
        "[1, 2]",
        "{broken",
    ]
    (tmp_path / "logs.ndjson").write_text("\n".join(lines) + "\n")
    recs = read_json_records(spark, str(tmp_path / "logs.ndjson"), layout="ndjson")
    assert recs.count() == 4
    logs = logs_from_records(validate_records(recs, REQUIRED_LOG_KEYS)).collect()
    assert [r.log_id for r in logs] == ["A"]
    # the whole record: a field map may name any key, reserved ones too
    assert dict(logs[0].fields) == {"log_id": "A", "node_id": "N1", "schema_version": "2", "response_code": "503", "extra": "x"}


def test_every_tree_is_full_and_layout_does_not_matter(spark):
    from vigil.operators.anomaly import fit_isolation_forest
    rows = [(i, float(i * 37 % 500), float(i * i % 911), None, None) for i in range(2000)]
    df = spark.createDataFrame(rows, "seq bigint, http_status double, response_time_ms double, load_val string, L_V1 string")
    one = fit_isolation_forest(df.coalesce(1), n_trees=40, seed=3).trees
    assert set(one[one["node"] == 0]["size"]) == {256} and one["tree"].nunique() == 40
    other = fit_isolation_forest(df.repartition(7, "response_time_ms"), n_trees=40, seed=3).trees
    key = ["tree", "node"]
    assert one.sort_values(key).reset_index(drop=True).equals(other.sort_values(key).reset_index(drop=True))


@pytest.mark.parametrize("layout", ["ndjson", "array"])
def test_path_order_decides_which_row_is_last(spark, tmp_path, layout):
    """Files of unequal size: Spark packs the largest first, the order of the paths counts."""
    from vigil.operators.normalize import registry_lookup
    from vigil.sources.json_source import read_json_records, registry_from_records
    rows = {"a.json": [{"node_id": "N1", "region": "OLD"}],
            "b.json": [{"node_id": f"X{k}", "region": "r" * 200} for k in range(300)] + [{"node_id": "N1", "region": "NEW"}],
            "c.json": [{"node_id": "Z"}]}
    for name, records in rows.items():
        text = "\n\n".join(json.dumps(r) for r in records) + "\n" if layout == "ndjson" else json.dumps(records)
        (tmp_path / name).write_text(text)
    records = read_json_records(spark, str(tmp_path), layout)
    got = [r.id for r in records.orderBy("seq").select(F.col("record")["node_id"].alias("id")).collect()]
    assert got == [r["node_id"] for name in sorted(rows) for r in rows[name]]
    last = registry_lookup(registry_from_records(records)).where("node_id = 'N1'").first()
    assert last.region == "NEW"


def test_forest_as_an_expression_scores_alike(spark):
    from vigil.operators.anomaly import fit_isolation_forest, forest_of
    from vigil.plans.queries import SMALL_FOREST
    rows = [(i, [200, 404, 500, -1][i % 4], (i * 37) % 4000, str(i % 5) if i % 3 else None, "x") for i in range(900)]
    df = spark.createDataFrame(rows, "seq bigint, http_status bigint, response_time_ms bigint, load_val string, L_V1 string")
    for model in (forest_of(SMALL_FOREST, 256), fit_isolation_forest(df, n_trees=6, sample_size=64, seed=5)):
        plan = model.score_in_plan(df)
        assert "Python" not in plan._jdf.queryExecution().toString()
        own = {r.seq: r.anomaly_score for r in plan.collect()}
        udf = {r.seq: r.anomaly_score for r in model.score(df).collect()}
        assert own.keys() == udf.keys() and all(abs(own[k] - udf[k]) < 1e-12 for k in own)
    with pytest.raises(ValueError):
        fit_isolation_forest(df, n_trees=60, sample_size=256, seed=5).score_in_plan(df)
