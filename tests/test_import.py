"""CSV import: as-of version, registry repair layouts, log shaping (FIXTURES §3)."""


from vigil.operators.asof import asof_lookup
from vigil.sources.csv_import import import_logs, orphan_nodes, repair_registry, schema_starts, version_table


def _starts(spark, rows):
    return spark.createDataFrame(rows, "version bigint, time_start bigint, seq bigint")


def test_asof_version(spark):
    logs = spark.createDataFrame([(0,), (4999,), (5000,), (-5,), (12000,)], "n bigint")
    out = asof_lookup(logs, "n", _starts(spark, [(1, 0, 0), (2, 5000, 1)]), "time_start", "version", "v")
    assert dict((r.n, r.v) for r in out.collect()) == {0: 1, 4999: 1, 5000: 2, -5: 1, 12000: 2}


def test_asof_empty_and_ties(spark):
    logs = spark.createDataFrame([(10,)], "n bigint")
    empty = _starts(spark, [])
    assert asof_lookup(logs, "n", empty, "time_start", "version", "v").collect()[0].v == 1
    ties = _starts(spark, [(3, 0, 0), (4, 0, 1)])
    assert asof_lookup(logs, "n", ties, "time_start", "version", "v").collect()[0].v == 4


def test_registry_layouts(spark):
    rows = spark.createDataFrame([
        (0, ["0", "AEGIS-Node/2.0 (Linux) U04tOTI4MA==", "False"]),
        (1, ["7", "Agent/1.0", "U04tNw==", "True"]),
        (2, ["U04tOTI4MA==", "Agent/3.0", "true"]),
        (3, ["only-one"]),
    ], "seq bigint, values array<string>")
    out = {r.node_id: r for r in repair_registry(rows).collect()}
    a = out["NODE-000"]
    assert (a.user_agent, a.hardware_id_b64, a.region, a.ip_address, a.is_infected) == (
        "0 AEGIS-Node/2.0 (Linux)", "U04tOTI4MA==", "US-EAST", "10.42.0.0", False)
    assert a.registered_at == "2026-03-01T00:00:00Z"
    b = out["NODE-007"]
    assert (b.user_agent, b.hardware_id_b64, b.is_infected, b.region) == ("Agent/1.0", "U04tNw==", True, "US-WEST")
    assert out["NODE-002"].hardware_id_b64 == "U04tOTI4MA==" and out["NODE-002"].is_infected
    d = out["NODE-003"]
    assert (d.user_agent, d.hardware_id_b64) == ("AEGIS-Node/2.0", "U04tMw==")


def test_log_shaping_and_orphans(spark):
    reg = repair_registry(spark.createDataFrame([(0, ["0", "AEGIS-Node/2.0 (Linux) U04tOTI4MA==", "False"])],
                                                "seq bigint, values array<string>"))
    logs = spark.createDataFrame([
        (0, "4999", "0", "Operational", "500", "120.7"),
        (1, "5000", "3", None, "", "x"),
    ], "seq bigint, log_id string, node_id string, json_status string, http_response_code string, "
       "response_time_ms string")
    starts = schema_starts(spark.createDataFrame([("1", "0", 0), ("2", "5000", 1)], "version string, time_start string, seq bigint"))
    out = {r.log_id: r for r in import_logs(logs, starts, reg).collect()}
    a = out["LOG-004999"]
    assert (a.node_id, a.schema_version, a.hardware_id_b64, a.timestamp) == (
        "NODE-000", "1", "U04tOTI4MA==", "2026-03-01T01:23:19Z")
    assert dict(a.fields) == {"status": "Operational", "http_code": "500", "latency": "120"}
    b = out["LOG-005000"]
    assert b.schema_version == "2" and b.hardware_id_b64 is None
    assert dict(b.fields) == {"node_status": "UNKNOWN", "response_code": "-1", "response_ms": "-1"}
    orphans = orphan_nodes(import_logs(logs, starts, reg), reg).collect()
    assert [o.node_id for o in orphans] == ["NODE-003"] and orphans[0].user_agent == "AEGIS-Node/2.0"


def test_version_table(spark):
    vt = version_table(spark.createDataFrame([("2", "5000", 1), ("1", "0", 0)], "version string, time_start string, seq bigint"))
    rows = {r.version: r for r in vt.collect()}
    assert rows["1"].deprecated and not rows["2"].deprecated
    assert rows["2"].active_since == "t=5000" and dict(rows["2"].field_map)["http_status"] == "response_code"


def test_csv_files_end_to_end(spark, tmp_path):
    from vigil.sources.csv_import import import_csv
    (tmp_path / "logs.csv").write_text(
        "log_id,node_id,json_status,http_response_code,response_time_ms\n"
        "1,0,Operational,500,4200.5\n"
        "5001,12,,200,90\n"
        "7,0,\"Operational, degraded\",404,10,extra\n")
    (tmp_path / "reg.csv").write_text(
        "node_uuid,user_agent,is_infected\n"
        "0,AEGIS-Node/2.0 (Linux) U04tOTI4MA==,False\n"
        "1,AEGIS-Node/2.0 (Linux) U04tNjEyNA==,True\n")
    (tmp_path / "schema.csv").write_text("version,time_start,active_column\n1,0,load_val\n2,5000,L_V1\n")
    imp = import_csv(spark, str(tmp_path / "logs.csv"), str(tmp_path / "reg.csv"), str(tmp_path / "schema.csv"))
    logs = {r.log_id: r for r in imp.logs.collect()}
    assert dict(logs["LOG-000001"].fields) == {"status": "Operational", "http_code": "500", "latency": "4200"}
    assert logs["LOG-005001"].schema_version == "2" and logs["LOG-005001"].hardware_id_b64 is None
    assert dict(logs["LOG-000007"].fields)["status"] == "Operational, degraded"
    reg = {r.node_id: r for r in imp.registry.collect()}
    assert set(reg) == {"NODE-000", "NODE-001", "NODE-012"}
    assert reg["NODE-001"].is_infected and reg["NODE-001"].hardware_id_b64 == "U04tNjEyNA=="
    assert reg["NODE-012"].registered_at == "2026-03-01T00:00:00Z"
    assert sorted(r.version for r in imp.schema_versions.collect()) == ["1", "2"]


def test_asof_with_as_many_boundaries_as_rows(spark):
    logs = spark.createDataFrame([(n,) for n in range(-5, 400)] + [(None,)], "n bigint")
    starts = [(i, i * 7 % 390, i) for i in range(390)]
    out = asof_lookup(logs, "n", _starts(spark, starts), "time_start", "version", "v", few=0, partitions=7)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    value = {s: v for v, s, _ in starts}
    for r in out.collect():
        at = 0 if r.n is None else max((s for s in value if s <= r.n), default=0)
        assert r.v == value[at]


def test_a_changed_registry_is_seen(spark, tmp_path):
    from vigil.operators.normalize import registry_lookup
    from vigil.operators.sizing import materialize_dimension
    path = str(tmp_path / "registry")
    for region in ("OLD", "NEW"):
        spark.createDataFrame([("N1", region, 0)], "node_id string, region string, seq bigint").write.mode("overwrite").parquet(path)
        got = materialize_dimension(registry_lookup(spark.read.parquet(path)), "registry").first()
        assert got.region == region


def test_csv_rows_as_python_reads_them(spark, tmp_path):
    import csv

    from vigil.sources.csv_import import named, read_csv_rows
    texts = {
        "a.csv": 'log_id,node_id,note\n1,1,OPERATIONAL\n\n2,1,"OPER\nATIONAL"\n3,"x ""y"", z"\n,,\n4,5,6,extra,,more\n',
        "b.csv": 'log_id,node_id,note\n"7",,""\n\n\n8\n',
    }
    expected = []
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
        expected += [r for r in csv.reader(text.splitlines(keepends=True)) if r][1:]
    rows = sorted(read_csv_rows(spark, str(tmp_path)).collect())
    assert [r.seq for r in rows] == list(range(len(expected)))
    for got, want in zip(rows, expected):
        want = [v or None for v in want] + [None] * (len(got["values"]) - len(want))
        assert got["values"] == want
    notes = named(read_csv_rows(spark, str(tmp_path / "a.csv")), ["note", "absent"]).orderBy("seq").collect()
    assert [r.note for r in notes] == ["OPERATIONAL", "OPER\nATIONAL", None, None, "6"]
    assert all(r.absent is None for r in notes)


def test_csv_empty_and_split_files(spark, tmp_path):
    from vigil.sources.csv_import import read_csv_rows
    (tmp_path / "empty.csv").write_text("")
    assert read_csv_rows(spark, str(tmp_path / "empty.csv")).count() == 0
    (tmp_path / "head.csv").write_text("a,b\n")
    assert read_csv_rows(spark, str(tmp_path / "head.csv")).count() == 0
    (tmp_path / "long.csv").write_text("a,b\n" + "".join(f"{i},{'x' * (i % 37)}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        rows = sorted(read_csv_rows(spark, str(tmp_path / "long.csv"), multi_line=False).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.seq, r["values"][0]) for r in rows] == [(i, str(i)) for i in range(5000)]


def test_asof_prefix_scan_of_a_hot_key(spark):
    """One key holds a third of the rows; no window runs in a single task; both ways agree."""
    import bisect
    import random
    rng = random.Random(11)
    starts = sorted(rng.sample(range(-500, 5000), 90))
    keys = [rng.randrange(-900, 5500) for _ in range(2000)] + [777] * 1000 + [None] * 5
    logs = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "n bigint, i bigint")
    table = _starts(spark, [(v, s, v) for v, s in enumerate(starts)])
    scan = asof_lookup(logs, "n", table, "time_start", "version", "v", partitions=9)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan.split("Subquery")[0]
    want = [(i, 0 if k is None else max(bisect.bisect_right(starts, k) - 1, 0)) for i, k in enumerate(keys)]
    assert sorted((r.i, r.v) for r in scan.collect()) == want
    few = asof_lookup(logs, "n", table, "time_start", "version", "v", few=90)
    assert sorted((r.i, r.v) for r in few.collect()) == want


def test_places_over_ranges(spark):
    import random

    from vigil.operators.prefix import with_ordinal
    rng = random.Random(2)
    data = [(rng.choice([None, 1, 1, 1, 2, 5]), i) for i in range(700)]
    df = spark.createDataFrame(data, "a bigint, b bigint").repartition(5)
    got = {(r.a, r.b): r.at for r in with_ordinal(df, ["a", "b"], "at", "test", partitions=6).collect()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(got.values()) == list(range(700))
    assert with_ordinal(df.limit(0), ["a", "b"], "at", "test").collect() == []
