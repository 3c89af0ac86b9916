"""Large sets in bounded rows, pages at bounded cost, the running mean, out-of-fold probabilities."""

import random
import re

from pyspark.sql import functions as F

from vigil.operators import views as vw
from vigil.operators.graph import adjacency
from vigil.operators.running_mean import edge_running_mean


def test_a_hub_is_many_rows(spark):
    pairs = [("hub", f"T{k:05d}") for k in range(2500)] * 2 + [("b", "hub"), ("b", "T00001"), ("é", "b")]
    edges = spark.createDataFrame(pairs, "source string, target string").repartition(4)
    nodes = spark.createDataFrame([(n,) for n in sorted({x for p in pairs for x in p})], "node_id string")
    rows = adjacency(edges, nodes, size=1000).collect()
    hub = sorted((r.chunk, r.neighbors) for r in rows if r.node_id == "hub")
    assert [(c, len(n)) for c, n in hub] == [(0, 1000), (1, 1000), (2, 500)]
    assert [t for _, n in hub for t in n] == [f"T{k:05d}" for k in range(2500)]
    others = {r.node_id: (r.chunk, r.neighbors) for r in rows if r.node_id != "hub"}
    assert others["b"] == (0, ["T00001", "hub"]) and others["é"] == (0, ["b"]) and others["T00007"] == (0, [])
    assert len(others) == 2502


def test_any_page_from_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(vw, "PAGE_BLOCK", 16)
    rng = random.Random(4)
    data = [(s, rng.choice([0, 3, 25, 80, 95, 100]), rng.choice(["EUROPE", "ASIA"])) for s in rng.sample(range(5000), 700)]
    alerts = spark.createDataFrame(data, "seq bigint, severity_score bigint, region string").repartition(3)
    ordered = sorted((r for r in data if r[2] == "EUROPE"), key=lambda r: (-r[1], r[0]))
    kept = vw.filter_alerts(alerts, region="europe")
    ranks = vw.page_ranks(kept)
    for page, limit in [(1, 10), (2, 33), (7, 50), (len(ordered) // 10 + 1, 10), (10_000, 50), (1_000_000, 100)]:
        got = vw.alert_page(alerts, region="europe", page=page, limit=limit, ranks=ranks)
        numbers = [int(x) for x in re.findall(r"(?:limit=|LocalLimit |GlobalLimit |Offset )(\d+)", got._jdf.queryExecution().toString())]
        assert all(n <= 16 + 100 for n in numbers)  # neither limit nor offset grows with the page
        rows = got.collect()
        assert [(r.seq, r.severity_score, r.region) for r in rows] == ordered[(page - 1) * limit:page * limit]
        assert all((r.total, r.page, r.limit) == (len(ordered), page, limit) for r in rows)
    assert [r.seq for r in vw.search_page(kept, page=3).collect()] == [r[0] for r in ordered[100:150]]
    assert vw.alert_page(alerts.limit(0)).collect() == []


def _replay(rows):
    edges = {}
    for s, t, _, rt in sorted(rows, key=lambda r: r[2]):
        n, mean = edges.get((s, t), (0, 0.0))
        n += 1
        if rt is not None and rt >= 0:
            mean = round(((mean * (n - 1)) + rt) / n, 2)
        edges[(s, t)] = (n, mean)
    return edges


def test_running_mean_in_order(spark):
    assert _replay([("a", "b", 0, 100), ("a", "b", 1, -1), ("a", "b", 2, 200)])[("a", "b")] == (3, 133.33)
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.choice("xyz"), s, rng.choice([-1, None, rng.randrange(9000)])) for s in range(600)]
    rows += [("hot", "hot", s, rng.randrange(5000)) for s in range(600, 1500)] + [("", "x", 2000, 5), ("a", "", 2001, 5)]
    rng.shuffle(rows)
    logs = spark.createDataFrame(rows, "source_node string, target_node string, seq bigint, response_time_ms bigint")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "7")  # an edge goes on over many batches
        got = {(r.source, r.target): (r["count"], r.running_mean) for r in edge_running_mean(logs).collect()}
    finally:
        spark.conf.set(key, before)
    assert got == _replay([r for r in rows if r[0] and r[1]])


def _auc(pairs):
    good, bad = [p for p, y in pairs if y], [p for p, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_no_node_is_scored_by_its_own_label(spark):
    from vigil.operators.infection_model import fold_of, out_of_fold_probability
    rng = random.Random(6)
    nodes = [f"N{k}" for k in range(400)]
    logs = [(n, float(rng.randrange(5000)), rng.choice([200, 404, 500])) for n in nodes for _ in range(3)]
    detected = spark.createDataFrame(logs, "node_id string, response_time_ms double, http_status bigint")
    label = {n: rng.random() < 0.5 for n in nodes}

    def scores(labels):
        reg = spark.createDataFrame(list(labels.items()), "node_id string, is_infected boolean")
        return {r.node_id: r.ml_probability for r in out_of_fold_probability(detected, reg, max_iter=4, max_depth=3).collect()}
    first = scores(label)
    assert set(first) == set(nodes) and all(0 <= p <= 1 for p in first.values())
    assert 0.38 < _auc([(first[n], label[n]) for n in nodes]) < 0.62  # nothing to learn, nothing leaks
    folds = {r.node_id: r.f for r in spark.createDataFrame([(n,) for n in nodes], "node_id string").select("node_id", fold_of("node_id", 3).alias("f")).collect()}
    flipped = scores({n: (not y) if folds[n] == 0 else y for n, y in label.items()})
    assert all(flipped[n] == first[n] for n in nodes if folds[n] == 0)
    assert any(flipped[n] != first[n] for n in nodes if folds[n] != 0)


def test_one_class_and_no_labels(spark):
    from vigil.operators.infection_model import out_of_fold_probability
    detected = spark.createDataFrame([(f"N{k}", 1.0 * k, 200) for k in range(30)], "node_id string, response_time_ms double, http_status bigint")
    clean = spark.createDataFrame([(f"N{k}", None) for k in range(30)], "node_id string, is_infected boolean")
    assert {r.ml_probability for r in out_of_fold_probability(detected, clean).collect()} == {0.0}
    nobody = out_of_fold_probability(detected, clean.limit(0)).agg(F.count("ml_probability"), F.count(F.lit(1))).first()
    assert tuple(nobody) == (0, 30)


def test_latest_by_time_without_a_sort(spark):
    rows = [("a", "2024-03-01T12:00:00Z", 5), ("a", "2024-03-01T12:00:00Z", 3), ("a", "UNKNOWN", 9), ("a", "2024-02-29T23:59:59Z", 1),
            ("b", "UNKNOWN", 7), ("b", "xx 2024", 2), ("c", "1969-12-31T00:00:00Z", 4), ("c", "UNKNOWN", 0), (None, "2024-01-01T00:00:00Z", 11),
            ("d", "2024-03-01T13:00:00+02:00", 20), ("d", "2024-03-01T11:30:00Z", 21)]
    alerts = spark.createDataFrame([(*r, f"L{r[2]}") for r in rows], "node_id string, timestamp string, seq bigint, log_id string")
    latest = vw.latest_per_node(alerts, ["log_id"])
    assert "SortAggregate" not in latest._jdf.queryExecution().executedPlan().toString()
    assert {r.node_id: r.log_id for r in latest.collect()} == {"a": "L3", "b": "L2", "c": "L4", None: "L11", "d": "L21"}


def test_edges_without_a_sort(spark):
    from vigil.operators.graph import graph_edges
    rng = random.Random(9)
    rows = [(rng.choice("abc"), rng.choice("xyz"), s, s * 10, f"UA{s}", [f"h{s}"], rng.choice([-1, 50, 70]), float(s % 90), "CLEAN") for s in range(400)]
    rng.shuffle(rows)
    logs = spark.createDataFrame(rows, "source_node string, target_node string, seq bigint, interval bigint, user_agent string, "
                                       "headers array<string>, response_time_ms bigint, severity_score double, alert_level string")
    edges = graph_edges(logs)
    assert "SortAggregate" not in edges._jdf.queryExecution().executedPlan().toString()
    for r in edges.collect():
        own = sorted(x for x in rows if x[:2] == (r.source, r.target))
        own.sort(key=lambda x: x[2])
        assert (r["count"], r.interval, r.user_agent, r.headers) == (len(own), own[0][3], own[0][4], own[0][5])
        assert r._max_sev == max(x[7] for x in own)
    assert edges.count() == 9


def test_indexed_search_equals_the_scan(spark):
    from vigil.operators.search import build_search_index, search_indexed
    rng = random.Random(13)
    texts = ["NODE-%03d" % k for k in range(40)] + ["Straße 7", "ÉCLAIR", "aaaaaa", "ab", "", None, "x.y*z%"]
    data = [(s, *(rng.choice(texts) for _ in range(4))) for s in rng.sample(range(3000), 500)]
    alerts = spark.createDataFrame(data, "seq bigint, node_id string, node_name string, region string, log_id string").repartition(3)
    words = [t for t in texts if t]
    queries = {"aaaa", "aaaaaaa", "é", "b", "%", "STRASSE", "straße"}
    while len(queries) < 100:
        w = rng.choice(words)
        a = rng.randrange(len(w))
        queries.add(rng.choice([str.lower, str.upper, str])(w[a:a + rng.randint(1, 7)]) + rng.choice(["", "", "", "q"]))
    got = sorted((r.query, r.seq) for r in search_indexed(alerts, build_search_index(alerts), sorted(queries)).collect())
    assert got == sorted((q, r[0]) for q in queries for r in data if any(q.lower() in (t or "").lower() for t in r[1:]))
    one = search_indexed(alerts, build_search_index(alerts), ["node-01"]).drop("query")
    assert sorted(one.collect()) == sorted(vw.search_alerts(alerts, "node-01").collect())
    assert search_indexed(alerts.limit(0), build_search_index(alerts.limit(0)), ["abc", "x"]).collect() == []
