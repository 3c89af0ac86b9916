"""Graph, interval, fingerprint and attribution edge cases (FIXTURES §3) and pipeline properties."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigil.functions import interval_bucket
from vigil.operators import attribution as att
from vigil.operators import fingerprint as fpr
from vigil.operators import graph as grf
from vigil.operators.intervals import previous_in_group
from tests.conftest import SF001

LOG_SCHEMA = ("log_id string, node_id string, timestamp string, region string, schema_version bigint, "
              "response_time_ms bigint, seq bigint, severity_score bigint, alert_level string")


def _registry(spark, ids, ua="agent/1"):
    return spark.createDataFrame([(i, ua, n) for n, i in enumerate(ids)], "node_id string, user_agent string, seq bigint")


def test_interval_input_order_and_bad_time(spark):
    logs = spark.createDataFrame([
        ("L1", "A", "2024-01-01T00:00:00Z", "r", 1, 10, 0, 0, "CLEAN"),
        ("L2", "A", "2024-01-01T00:00:10Z", "r", 1, 10, 1, 0, "CLEAN"),
        ("L3", "A", "2024-01-01T00:00:05Z", "r", 1, 10, 2, 0, "CLEAN"),
        ("L4", "A", "UNKNOWN", "r", 1, 10, 3, 0, "CLEAN"),
        ("L5", "A", "2024-01-01T00:00:20Z", "r", 1, 10, 4, 0, "CLEAN"),
    ], LOG_SCHEMA)
    g = grf.graph_ready_logs(logs, _registry(spark, ["A", "B"]), block_rows=2)
    out = {r.log_id: r for r in g.collect()}
    assert [out[k].interval for k in ("L1", "L2", "L3", "L4")] == [0, 10, 0, 0]
    assert out["L4"].timestamp == "1970-01-01T00:00:00Z"
    assert out["L5"].interval == 1704067220  # the bad row reset "last seen" to 1970
    assert all(r.target_node == "B" for r in out.values())  # self-hits move to the next registry node


def test_latency_text(spark):
    texts = {"5": 5, "-7": -7, "+5": -1, " 5": -1, "5\n": -1, "1.5": -1, "": -1, "007": 7}
    logs = spark.createDataFrame([(f"L{k}", "A", "2024-01-01T00:00:00Z", "r", 1, t, k, 0, "CLEAN") for k, t in enumerate(texts)],
                                 LOG_SCHEMA.replace("response_time_ms bigint", "response_time_ms string"))
    got = {r.seq: r.response_time_ms for r in grf.graph_ready_logs(logs, _registry(spark, ["A", "B"])).select("seq", "response_time_ms").collect()}
    assert [got[k] for k in range(len(texts))] == list(texts.values())


def test_blocked_lag_equals_plain_lag(spark):
    df = spark.range(0, 500).select(
        F.col("id").alias("seq"), (F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7 % 101).alias("v"))
    blocked = previous_in_group(df, "g", "seq", "v", "p", block=16)
    plain = df.withColumn("p", F.lag("v").over(Window.partitionBy("g").orderBy("seq")))
    cols = ["seq", "g", "v", "p"]
    assert sorted(blocked.select(*cols).collect()) == sorted(plain.select(*cols).collect())


def test_interval_buckets(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 1, 5, 6, 30, 31, 120, 121)], "v bigint")
    got = [r[0] for r in df.select(interval_bucket("v")).collect()]
    assert got == ["unknown", "zero", "1_5s", "1_5s", "6_30s", "6_30s", "31_120s", "31_120s", "121s_plus"]


def _graph_logs(spark, rows):
    return spark.createDataFrame(rows, "source_node string, headers array<string>, user_agent string, "
                                       "interval bigint, seq bigint")


def _clusters(spark, rows):
    usage = fpr.fingerprint_usage(_graph_logs(spark, rows))
    clusters = fpr.fingerprint_clusters(usage)
    return fpr.with_nodes(clusters, fpr.cluster_members(clusters, usage)).collect()


def _members(spark, rows):
    return spark.createDataFrame([(n, node) for n, nodes in rows for node in nodes], "occurrences bigint, node_id string")


def test_members_count_once_whatever_their_agents(spark):
    rows = [("P", ["k"], "bot", 7, 0), ("P", ["k"], " bot ", 7, 1), ("Q", ["k"], "bot", 7, 2), ("", ["k"], "bot", 7, 3)]
    c = _clusters(spark, rows)[0]
    assert (c.occurrences, c.node_count, list(c.nodes), c.first_seq) == (4, 2, ["P", "Q"], 0)


def test_fingerprint_filters_and_confidence(spark):
    rows = []
    seq = 0
    for _ in range(10):   # common UA at share 10/100 = 0.1 -> dropped
        rows.append(("A", ["h"], "Mozilla/5.0", 0, seq)); seq += 1
    for _ in range(9):    # rare UA, cluster of 9
        rows.append(("B", ["h"], "rare-agent", 0, seq)); seq += 1
    rows.append(("C", ["h"], "single", 0, seq)); seq += 1   # count 1 -> dropped
    for i in range(80):
        rows.append((f"N{i}", ["x", f"{i}"], "filler", 3, seq)); seq += 1
    clusters = {r.user_agent: r for r in _clusters(spark, rows)}
    assert "Mozilla/5.0" not in clusters and "single" not in clusters
    assert clusters["rare-agent"].occurrences == 9
    assert clusters["rare-agent"].confidence == 0.99


def test_common_ua_below_cutoff_kept_and_multinode(spark):
    rows = [("A", ["h1"], "Mozilla/5.0", 0, i) for i in range(9)]
    rows += [("B", ["h1"], "Mozilla/5.0", 0, 100)]  # share 10/100 -> would drop; make it 9 of 100
    rows = rows[:9]
    rows += [("P", ["k"], "bot", 7, 200), ("Q", ["k"], "bot", 7, 201)]
    rows += [(f"Z{i}", [f"z{i}"], f"u{i}", 0, 300 + i) for i in range(89)]
    clusters = {r.user_agent: r for r in _clusters(spark, rows)}
    assert clusters["Mozilla/5.0"].occurrences == 9
    bot = clusters["bot"]
    assert list(bot.nodes) == ["P", "Q"] and bot.confidence == 0.81 and bot.interval_bucket == "6_30s"


def test_cluster_confidence_two(spark):
    rows = [("A", ["h"], "ua", 0, 0), ("A", ["h"], "ua", 0, 1)]
    c = _clusters(spark, rows)[0]
    assert c.confidence == 0.73


def test_edge_mean_and_counts(spark):
    gl = spark.createDataFrame([
        ("L1", "A", "B", "t", ["h"], "ua", 100, 0, 0.0, "CLEAN", 0),
        ("L2", "A", "B", "t", ["h"], "ua", -1, 5, 95.0, "ATTACK", 1),
        ("L3", "A", "B", "t", ["h"], "ua", 200, 9, 30.0, "SUSPICIOUS", 2),
    ], "log_id string, source_node string, target_node string, timestamp string, headers array<string>, "
       "user_agent string, response_time_ms bigint, interval bigint, severity_score double, alert_level string, "
       "seq bigint")
    e = grf.graph_edges(gl).collect()[0]
    assert (e["count"], e.avg_response_time_ms, e.interval) == (3, 150.0, 0)
    nodes = {r.node_id: r for r in grf.graph_nodes(grf.graph_edges(gl)).collect()}
    assert (nodes["A"].out_degree, nodes["A"].centrality, nodes["A"].severity_score, nodes["A"].node_type) == (1, 0.5, 95.0, "ATTACK")
    assert (nodes["B"].out_degree, nodes["B"].severity_score, nodes["B"].node_type) == (0, 0.0, "CLEAN")


def test_attribution_score_and_confidence(spark):
    nodes = spark.createDataFrame([("X", 33, 0.066), ("Y", 30, 0.066)], "node_id string, out_degree bigint, centrality double")
    edges = spark.createDataFrame([], "source string, target string, count bigint, interval bigint")
    clusters = _members(spark, [(30, ["X"]), (25, ["Y"])])
    c = {r.node_id: r for r in att.candidates(nodes, edges, clusters).collect()}
    assert c["X"].score == 23.7165
    cmd = att.command_node(nodes, att.candidates(nodes, edges, clusters)).collect()[0]
    assert cmd.command_node == "X" and cmd.confidence_score == 0.99
    assert [x.node for x in cmd.top_candidates] == ["X", "Y"]


def test_attribution_empty_outcomes(spark):
    nodes = spark.createDataFrame([], "node_id string, out_degree bigint, centrality double")
    edges = spark.createDataFrame([], "source string, target string, count bigint, interval bigint")
    clusters = _members(spark, [])
    r = att.command_node(nodes, att.candidates(nodes, edges, clusters)).collect()[0]
    assert r.command_node is None and r.confidence_score == 0.0 and list(r.reasons) == ["No graph data available"]
    weak = spark.createDataFrame([("W", 0, 0.0)], "node_id string, out_degree bigint, centrality double")
    r = att.command_node(weak, att.candidates(weak, edges, clusters)).collect()[0]
    assert r.command_node is None and list(r.reasons) == ["No strong command node signal found"]


def test_pipeline_properties(spark):
    from vigil.plans.stages import Stages
    st = Stages(spark, SF001, materialize=False)
    total = st.detected.count()
    levels = st.detected.groupBy("alert_level").count().agg(F.sum("count")).collect()[0][0]
    assert levels == total
    assert st.edges.agg(F.sum("count")).collect()[0][0] == st.graph_logs.count() == total
    assert st.edges.filter(F.col("source") == F.col("target")).count() == 0


def test_empty_registry_targets_self(spark):
    logs = spark.createDataFrame([("L1", "A", "2024-01-01T00:00:00Z", "r", 1, 10, 0, 0, "CLEAN")], LOG_SCHEMA)
    empty = spark.createDataFrame([], "node_id string, user_agent string, seq bigint")
    r = grf.graph_ready_logs(logs, empty).collect()[0]
    assert (r.target_node, r.user_agent) == ("A", "UNKNOWN-UA")


def test_fingerprint_listing_matches_python_repr(spark):
    import hashlib
    from vigil.functions.graphfn import fingerprint_key, py_list_repr
    cases = [[], ["a"], ["x-node:node-1", "x-region:eu"], ["it's"], ['say "hi"'], ["both ' and \""],
             ["back\\slash"], ["tab\there", "nl\nx"], ["", "a"], ["''", "'"], ["a'b", "c", 'd"e']]
    df = spark.createDataFrame([(c,) for c in cases], "h array<string>")
    got = [(r.l, r.k) for r in df.select(py_list_repr("h").alias("l"),
                                          fingerprint_key("h", F.lit("ua"), F.lit("zero")).alias("k")).collect()]
    for c, (listing, key) in zip(cases, got):
        assert listing == str(c), (c, listing)
        assert key == hashlib.sha256((str(c) + "ua" + "zero").encode()).hexdigest()


def test_attribution_blend_and_ties(spark):
    nodes = spark.createDataFrame([("NODE-037", 33, 0.066), ("NODE-271", 10, 0.05), ("NODE-177", 10, 0.05)],
                                  "node_id string, out_degree bigint, centrality double")
    edges = spark.createDataFrame([], "source string, target string, count bigint, interval bigint")
    clusters = _members(spark, [(30, ["NODE-037"]), (5, ["NODE-177", "NODE-271"])])
    # a model that knows none of the nodes: score = 0.6 * 0 + 0.4 * heuristic
    probs = spark.createDataFrame([("OTHER", 0.9)], "node_id string, ml_probability double")
    c = att.candidates(nodes, edges, clusters, ml_probability=probs)
    scores = {r.node_id: r.score for r in c.collect()}
    assert scores["NODE-037"] == 9.4866
    ranked = [r.node_id for r in att.ranked(c).orderBy("rank").collect()]
    assert ranked == ["NODE-037", "NODE-177", "NODE-271"]  # equal scores: node id order
    two = spark.createDataFrame([("A", 9.4866), ("B", 9.1662)], "node_id string, score double") \
        .withColumn("out_degree", F.lit(1).cast("bigint")).withColumn("fingerprint_matches", F.lit(0).cast("bigint")) \
        .withColumn("centrality", F.lit(0.0)).withColumn("reasons", F.array(F.lit("r")))
    assert att.command_node(two, two).collect()[0].confidence_score == 0.99
