"""DuckDB oracle SQL for every registered query.

The oracle re-derives each stage independently in plain SQL, specialised to
the telemetry view (the field-map resolution collapses to "the row's layout
matches the resolved version", the registry is joined directly).  Shared
stages are CTE blocks; each query is ``WITH <blocks> SELECT ...``.
"""

from __future__ import annotations

# The keywords, in the order in which they are tried.
_KEYWORDS = ("MALWARE", "PAYLOAD", "EXPLOIT", "INJECT", "SHELL", "CMD", "EXEC", "BACKDOOR", "ROOTKIT", "TROJAN", "RANSOMWARE", "KEYLOG")

_KW_CASE = "CASE " + " ".join(
    f"WHEN contains(upper(hw_text), '{k}') THEN '{k}'" for k in _KEYWORDS) + " END"

BASE = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
reg AS (
  SELECT printf('NODE-%03d', s.s_suppkey) AS node_id, s.s_name AS node_name, upper(r.r_name) AS region,
         CASE WHEN s.s_suppkey % 20 = 7 THEN to_base64(encode('MALWARE-SN-' || CAST(s.s_suppkey AS VARCHAR)))
              WHEN s.s_suppkey % 20 = 13 THEN '!!SN-' || CAST(s.s_suppkey AS VARCHAR) || '##'
              ELSE to_base64(encode('SN-' || CAST(s.s_suppkey AS VARCHAR))) END AS reg_hw,
         (s.s_suppkey % 20 IN (7, 13) OR s.s_acctbal < 0) AS is_infected,
         printf('%d node-agent/2.0 (Linux)', s.s_suppkey) AS reg_ua
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey),
raw AS (
  SELECT event_id AS seq, printf('LOG-%06d', event_id) AS log_id, printf('NODE-%03d', user_id) AS node_id,
         CASE WHEN k = 99 THEN 99 WHEN event_id < 5000 THEN 1 ELSE 2 END AS schema_version,
         (k <> 99 OR event_id < 5000) AS mapped,
         to_base64(encode('SN-' || CAST(user_id AS VARCHAR))) AS log_hw,
         strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
         CAST(floor(epoch(ts)) AS BIGINT) AS ts_sec,
         CASE WHEN event_type = 'error' AND k % 2 = 1 THEN 'DEGRADED' ELSE 'OPERATIONAL' END AS status,
         CASE WHEN k = 98 THEN NULL WHEN event_type = 'error' THEN 400 + (k % 3) * 50 ELSE 200 END AS http,
         CASE WHEN k = 96 THEN NULL ELSE CAST(floor(value * 20) AS BIGINT) END AS latency
  FROM ev),
n0 AS (
  SELECT raw.seq, raw.log_id, raw.node_id, raw.ts_sec,
         CASE WHEN reg.node_id IS NOT NULL THEN reg.node_name ELSE 'UNKNOWN' END AS node_name,
         CASE WHEN reg.node_id IS NOT NULL THEN reg.region ELSE 'UNKNOWN' END AS region,
         CAST(raw.schema_version AS BIGINT) AS schema_version,
         raw.schema_version IN (1, 2) AS schema_known,
         CASE WHEN raw.mapped THEN upper(raw.status) ELSE 'UNKNOWN' END AS reported_status,
         CAST(CASE WHEN raw.mapped AND raw.http IS NOT NULL THEN raw.http ELSE -1 END AS BIGINT) AS http_status,
         CAST(CASE WHEN raw.mapped AND raw.latency IS NOT NULL THEN raw.latency ELSE -1 END AS BIGINT)
           AS response_time_ms,
         CASE WHEN reg.node_id IS NOT NULL AND reg.reg_hw <> '' THEN reg.reg_hw ELSE raw.log_hw END AS hw_raw,
         raw.timestamp, reg.node_id IS NOT NULL AS hit, reg.reg_ua, reg.is_infected
  FROM raw LEFT JOIN reg ON raw.node_id = reg.node_id),
n1 AS (SELECT *, replace(replace(replace(trim(hw_raw), chr(10), ''), chr(13), ''), ' ', '') AS hw_clean FROM n0),
n2 AS (SELECT *, try(from_base64(hw_clean || repeat('=', CAST((4 - length(hw_clean) % 4) % 4 AS INTEGER))))
          AS hw_bytes FROM n1),
n3 AS (SELECT *, try(decode(hw_bytes)) AS hw_text FROM n2),
n4 AS (SELECT *, {_KW_CASE} AS hw_kw,
         CASE WHEN hw_raw IS NULL OR trim(hw_raw) = '' THEN 'missing'
              WHEN NOT regexp_full_match(hw_clean, '[A-Za-z0-9+/]+=*') THEN 'format'
              WHEN hw_bytes IS NULL THEN 'decode'
              WHEN hw_text IS NULL THEN 'utf8' END AS hw_fail FROM n3),
normalized AS (
  SELECT seq, log_id, node_id, node_name, region, schema_version, schema_known, reported_status, http_status,
         response_time_ms, ts_sec, reg_ua, hit,
         CASE WHEN hw_raw IS NULL OR hw_raw = '' THEN NULL ELSE trim(hw_raw) END AS hardware_id_b64,
         (hw_fail IS NULL AND hw_kw IS NULL) AS hardware_id_valid,
         CASE WHEN hw_fail IS NULL THEN hw_text END AS hardware_id_decoded,
         CASE WHEN hw_fail = 'missing' THEN 'hardware_id_b64 is missing or null'
              WHEN hw_fail = 'format' THEN 'Invalid Base64 format — contains illegal characters: '
                                           || substr(trim(hw_raw), 1, 30)
              WHEN hw_fail = 'decode' THEN 'Base64 decode error: invalid padding or length'
              WHEN hw_fail = 'utf8' THEN 'Decoded bytes are not valid UTF-8 — possible binary payload'
              WHEN hw_kw IS NOT NULL THEN 'Malicious pattern detected: ''' || hw_kw
                                          || ''' found in decoded hardware ID' END AS hardware_id_reason,
         timestamp
  FROM n4),
flags AS (
  SELECT *,
    (http_status <> -1 AND reported_status = 'OPERATIONAL' AND http_status >= 400) AS r1,
    (http_status <> -1 AND http_status >= 500) AS r2,
    (NOT hardware_id_valid) AS r3,
    (http_status = -1) AS r4,
    (response_time_ms <> -1 AND response_time_ms >= 3000) AS r5,
    (response_time_ms <> -1 AND response_time_ms >= 1500 AND response_time_ms < 3000) AS r6,
    (NOT schema_known) AS r7
  FROM normalized),
texts AS (
  SELECT *,
    CASE WHEN r1 THEN 'Deceptive node: reports OPERATIONAL but HTTP=' || http_status || ' (>= 400)' END AS t1,
    CASE WHEN r2 THEN 'Server failure: HTTP=' || http_status || ' (>= 500)' END AS t2,
    CASE WHEN r3 THEN 'Invalid hardware ID: ' || coalesce(nullif(hardware_id_reason, ''),
                      'hardware_id_b64 is missing or failed validation') END AS t3,
    CASE WHEN r4 THEN 'HTTP status is missing (field not found in log) — node health unverifiable' END AS t4,
    CASE WHEN r5 THEN 'Extreme latency: ' || response_time_ms || 'ms (>= 3000ms threshold)' END AS t5,
    CASE WHEN r6 THEN 'Elevated latency: ' || response_time_ms || 'ms (>= 1500ms, < 3000ms)' END AS t6,
    CASE WHEN r7 THEN 'Unknown schema version=' || schema_version || ' — field mapping may be incomplete' END AS t7,
    CASE WHEN r1 OR r2 OR r3 OR r4 THEN 'ATTACK' WHEN r5 THEN 'HIGH_RISK' WHEN r6 THEN 'SUSPICIOUS'
         ELSE 'CLEAN' END AS alert_level,
    CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER) + CAST(r3 AS INTEGER) + CAST(r4 AS INTEGER)
      + CAST(r5 AS INTEGER) + CAST(r6 AS INTEGER) + CAST(r7 AS INTEGER) AS n_hits,
    10 * CAST(r1 AS INTEGER) + 10 * CAST(r2 AS INTEGER) + 15 * CAST(r3 AS INTEGER) + 8 * CAST(r4 AS INTEGER)
      + 8 * CAST(r5 AS INTEGER) + 5 * CAST(r6 AS INTEGER) + 3 * CAST(r7 AS INTEGER) AS bonus
  FROM flags),
detected AS (
  SELECT *,
    CAST(least(CASE alert_level WHEN 'ATTACK' THEN 80 WHEN 'HIGH_RISK' THEN 50 WHEN 'SUSPICIOUS' THEN 25
                ELSE 0 END + bonus, 100) AS BIGINT) AS severity_score,
    CAST(least(25 * n_hits, 100) AS BIGINT) AS confidence_score,
    alert_level <> 'CLEAN' AS is_anomaly,
    coalesce(t1, t2, t3, t4, t5, t6, t7) AS primary_reason,
    concat_ws(' | ', t1, t2, t3, t4, t5, t6, t7) AS reasons,
    concat_ws(',', CASE WHEN r1 THEN 'status_contradiction' END, CASE WHEN r2 THEN 'server_error' END,
              CASE WHEN r3 THEN 'invalid_hardware_id' END, CASE WHEN r4 THEN 'unknown_http_status' END,
              CASE WHEN r5 THEN 'extreme_latency' END, CASE WHEN r6 THEN 'elevated_latency' END,
              CASE WHEN r7 THEN 'schema_unknown' END) AS rule_ids
  FROM texts)"""

GRAPH = """,
ids AS (SELECT node_id, row_number() OVER (ORDER BY node_id) - 1 AS idx FROM (SELECT DISTINCT node_id FROM reg)),
nids AS (SELECT count(*) AS n FROM ids),
gl0 AS (
  SELECT d.seq, d.log_id, d.node_id AS source_node, d.timestamp, d.ts_sec, d.response_time_ms,
         CAST(d.severity_score AS DOUBLE) AS severity_score, d.alert_level,
         'x-node:' || lower(d.node_id) AS h1, 'x-region:' || lower(d.region) AS h2,
         'x-schema:v' || d.schema_version AS h3,
         CASE WHEN d.hit AND d.reg_ua <> '' THEN d.reg_ua ELSE 'UNKNOWN-UA' END AS user_agent,
         CAST(CASE WHEN lag(d.ts_sec) OVER (PARTITION BY d.node_id ORDER BY d.seq) IS NULL THEN 0
              ELSE greatest(d.ts_sec - lag(d.ts_sec) OVER (PARTITION BY d.node_id ORDER BY d.seq), 0) END
              AS BIGINT) AS interval,
         CAST('0x' || substr(md5(d.log_id), 1, 8) AS BIGINT) % nids.n AS slot, nids.n AS n
  FROM detected d CROSS JOIN nids),
graph_logs AS (
  SELECT g.*, h1 || ',' || h2 || ',' || h3 AS headers,
         CASE WHEN t1.node_id = g.source_node AND g.n > 1 THEN t2.node_id ELSE t1.node_id END AS target_node,
         CASE g.alert_level WHEN 'ATTACK' THEN 3 WHEN 'HIGH_RISK' THEN 2 WHEN 'SUSPICIOUS' THEN 1 ELSE 0 END
           AS level_rank
  FROM gl0 g LEFT JOIN ids t1 ON t1.idx = g.slot LEFT JOIN ids t2 ON t2.idx = (g.slot + 1) % g.n),
edges AS (
  SELECT source_node AS source, target_node AS target, count(*) AS count, count(*) AS weight,
         arg_min(interval, seq) AS interval, arg_min(user_agent, seq) AS user_agent,
         arg_min(headers, seq) AS headers,
         coalesce(round(avg(CASE WHEN response_time_ms >= 0 THEN response_time_ms END), 2), 0.0)
           AS avg_response_time_ms,
         max(severity_score) AS max_sev, max(level_rank) AS max_rank
  FROM graph_logs GROUP BY source_node, target_node),
node_out AS (SELECT source AS node_id, count(*) AS out_degree, max(max_sev) AS sev, max(max_rank) AS rnk
             FROM edges GROUP BY source),
all_nodes AS (SELECT source AS node_id FROM edges UNION SELECT target FROM edges),
tot AS (SELECT count(*) AS total FROM all_nodes),
nodes AS (
  SELECT a.node_id AS id, a.node_id, CAST(coalesce(o.out_degree, 0) AS BIGINT) AS out_degree,
         round(coalesce(o.out_degree, 0) / tot.total, 4) AS centrality,
         round(greatest(coalesce(o.sev, 0.0), 0.0), 2) AS severity_score,
         CASE coalesce(o.rnk, 0) WHEN 3 THEN 'ATTACK' WHEN 2 THEN 'HIGH_RISK' WHEN 1 THEN 'SUSPICIOUS'
              ELSE 'CLEAN' END AS node_type
  FROM all_nodes a CROSS JOIN tot LEFT JOIN node_out o ON a.node_id = o.node_id)"""

FINGERPRINT = """,
fk AS (
  SELECT *, CASE WHEN interval < 0 THEN 'unknown' WHEN interval = 0 THEN 'zero' WHEN interval <= 5 THEN '1_5s'
                 WHEN interval <= 30 THEN '6_30s' WHEN interval <= 120 THEN '31_120s' ELSE '121s_plus' END AS bucket
  FROM graph_logs),
fk2 AS (
  SELECT *, sha256('[''' || h1 || ''', ''' || h2 || ''', ''' || h3 || ''']' || user_agent || bucket) AS fp_key
  FROM fk),
ua_share AS (SELECT user_agent, count(*) AS ua_count FROM graph_logs GROUP BY user_agent),
gl_total AS (SELECT count(*) AS total FROM graph_logs),
clusters0 AS (
  SELECT fp_key, count(*) AS occurrences, string_agg(DISTINCT source_node, ',' ORDER BY source_node) AS nodes,
         count(DISTINCT source_node) AS n_nodes, arg_min(headers, seq) AS headers,
         arg_min(user_agent, seq) AS user_agent, arg_min(bucket, seq) AS interval_bucket, min(seq) AS first_seq
  FROM fk2 GROUP BY fp_key HAVING count(*) >= 2),
clusters AS (
  SELECT 'fp_' || substr(c.fp_key, 1, 12) AS fingerprint_id, c.fp_key AS fingerprint_key, c.occurrences,
         c.nodes, c.n_nodes, c.headers, c.user_agent, c.interval_bucket, c.first_seq,
         least(0.99, round(0.45 + 0.05 * c.occurrences + 0.08 * c.n_nodes + 0.1 * 1.0, 2))::DOUBLE AS confidence
  FROM clusters0 c LEFT JOIN ua_share u ON c.user_agent = u.user_agent CROSS JOIN gl_total t
  WHERE NOT ((lower(c.user_agent) LIKE '%mozilla/%' OR lower(c.user_agent) LIKE '%chrome/%'
              OR lower(c.user_agent) LIKE '%safari/%' OR lower(c.user_agent) LIKE '%edge/%'
              OR lower(c.user_agent) LIKE '%aegis-node/2.0%')
             AND coalesce(u.ua_count, 0) / t.total >= 0.1)),
members AS (SELECT DISTINCT fp_key, source_node AS node_id FROM fk2)"""

ATTRIBUTION = """,
fpm AS (SELECT m.node_id, CAST(sum(c.occurrences) AS BIGINT) AS fingerprint_matches
        FROM members m JOIN clusters c ON m.fp_key = c.fingerprint_key GROUP BY m.node_id),
ostat AS (SELECT source AS node_id, count(CASE WHEN interval >= 0 THEN interval END) AS n_int,
                 min(CASE WHEN interval >= 0 THEN interval END) AS min_i,
                 max(CASE WHEN interval >= 0 THEN interval END) AS max_i,
                 avg(CASE WHEN interval >= 0 THEN interval END) AS avg_i
          FROM edges GROUP BY source),
cand0 AS (
  SELECT n.node_id, n.out_degree, n.centrality, coalesce(f.fingerprint_matches, 0) AS fingerprint_matches,
         coalesce(o.n_int, 0) AS n_int, o.min_i, o.max_i, o.avg_i
  FROM nodes n LEFT JOIN fpm f ON n.node_id = f.node_id LEFT JOIN ostat o ON n.node_id = o.node_id
  WHERE NOT (n.out_degree <= 0 AND coalesce(f.fingerprint_matches, 0) <= 1)),
cand1 AS (
  SELECT *, round(out_degree * 0.4 + fingerprint_matches * 0.35 + centrality * 0.25, 4) AS score,
    concat_ws(' | ',
      CASE WHEN centrality >= 0.3 THEN 'Extremely high network centrality — primary communication hub'
           WHEN centrality >= 0.2 THEN 'High centrality — significant control over network traffic'
           WHEN centrality >= 0.1 THEN 'Moderate centrality — notable influence in graph'
           WHEN centrality >= 0.05 THEN 'Elevated centrality position' END,
      CASE WHEN fingerprint_matches >= 20 THEN 'Repeated fingerprint cluster (' || fingerprint_matches
                || ' matches) — strong automation signature'
           WHEN fingerprint_matches >= 10 THEN 'Multiple fingerprint matches (' || fingerprint_matches
                || ') — consistent behavioral pattern'
           WHEN fingerprint_matches >= 5 THEN 'Fingerprint pattern detected (' || fingerprint_matches || ' matches)'
           WHEN fingerprint_matches >= 3 THEN 'Multiple fingerprint occurrences' END,
      CASE WHEN n_int >= 3 THEN
        CASE WHEN max_i - min_i <= 2 THEN 'Highly regular timing (±'
                  || CAST(CAST(round_even(max_i - min_i, 1) AS DECIMAL(38, 1)) AS VARCHAR)
                  || 's variance) — automated beacon behavior'
             WHEN max_i - min_i <= 5 THEN 'Consistent timing pattern (avg: '
                  || CAST(CAST(round_even(avg_i, 1) AS DECIMAL(38, 1)) AS VARCHAR) || 's) — scripted activity'
             WHEN max_i - min_i <= 15 THEN 'Moderately consistent request intervals' END END,
      CASE WHEN out_degree >= 50 THEN 'Extremely high connection volume (' || out_degree
                || ' outgoing) — command distribution hub'
           WHEN out_degree >= 25 THEN 'High outgoing connections (' || out_degree || ') — significant target reach'
           WHEN out_degree >= 15 THEN 'Significant connection count (' || out_degree || ' targets)'
           WHEN out_degree >= 8 THEN 'Notable outgoing connection activity' END) AS reasons0
  FROM cand0),
candidates AS (
  SELECT node_id, score, out_degree, fingerprint_matches, round(centrality, 4) AS centrality,
         CASE WHEN reasons0 = '' THEN 'Elevated network activity relative to baseline' ELSE reasons0 END AS reasons
  FROM cand1),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY score DESC, node_id ASC) AS rank FROM candidates
  QUALIFY row_number() OVER (ORDER BY score DESC, node_id ASC) <= 5),
top2 AS (
  SELECT max(CASE WHEN rank = 1 THEN score END) AS m, coalesce(max(CASE WHEN rank = 2 THEN score END), 0.0) AS s,
         count(*) AS c FROM ranked)"""

ALL = BASE + GRAPH + FINGERPRINT + ATTRIBUTION


def _q(body: str, blocks: str = BASE) -> str:
    return "WITH " + blocks + "\n" + body


ORACLE: dict[str, str] = {
    "alerts_by_region_level": _q("""
SELECT region, alert_level, count(*) AS alert_count, round(avg(severity_score), 4) AS avg_severity,
       max(severity_score) AS max_severity, count(*) FILTER (WHERE confidence_score >= 50) AS multi_rule_alerts
FROM detected GROUP BY region, alert_level"""),
    "normalized_logs": _q("""
SELECT log_id, node_id, node_name, region, schema_version, schema_known, reported_status, http_status,
       response_time_ms, hardware_id_b64, hardware_id_valid, hardware_id_decoded, hardware_id_reason, timestamp,
       concat_ws(' | ',
         CASE WHEN NOT schema_known THEN 'Unknown schema_version=' || schema_version
              || ' — fields may not map correctly' END,
         CASE WHEN http_status = -1 THEN 'http_status is missing or null — defaulted to -1' END,
         CASE WHEN response_time_ms = -1 THEN 'response_time_ms is missing or null — defaulted to -1' END,
         CASE WHEN timestamp = 'UNKNOWN' THEN 'timestamp is missing or invalid — set to UNKNOWN' END,
         CASE WHEN NOT hit THEN 'node_id=''' || node_id || ''' not found in node_registry — using defaults' END,
         CASE WHEN NOT hardware_id_valid THEN 'hardware_id issue: ' || hardware_id_reason END) AS parse_warnings
FROM normalized"""),
    "integrity_summary": _q("""
SELECT count(*) AS total_rows, count(*) AS valid_rows, CAST(0 AS BIGINT) AS dropped_rows FROM raw"""),
    "alerts": _q("""
SELECT log_id, node_id, node_name, region, timestamp, alert_level, severity_score, confidence_score, is_anomaly,
       primary_reason, reasons, rule_ids, reported_status, http_status, response_time_ms, hardware_id_valid,
       hardware_id_decoded, schema_version, schema_known
FROM detected"""),
    "rule_hits": _q("""
SELECT rule_id, alert_level, count(*) AS hits
FROM (SELECT alert_level, unnest(string_split(rule_ids, ',')) AS rule_id FROM detected WHERE rule_ids <> '')
GROUP BY rule_id, alert_level"""),
    "detection_metrics": _q("""
SELECT count(*) AS total_logs_processed, count(*) AS total_alerts, CAST(0 AS BIGINT) AS skipped,
       count(*) FILTER (WHERE alert_level = 'ATTACK') AS attack_count,
       count(*) FILTER (WHERE alert_level = 'HIGH_RISK') AS high_risk_count,
       count(*) FILTER (WHERE alert_level = 'SUSPICIOUS') AS suspicious_count,
       count(*) FILTER (WHERE alert_level = 'CLEAN') AS clean_count,
       CAST(0 AS BIGINT) AS ml_detection_count,
       coalesce(round(avg(CASE WHEN response_time_ms <> -1 THEN response_time_ms END), 1), 0.0)
         AS avg_response_time_ms,
       count(*) FILTER (WHERE NOT hardware_id_valid) AS invalid_hw_count,
       coalesce(string_agg(DISTINCT CASE WHEN alert_level = 'ATTACK' THEN node_id END, ',' ORDER BY
         CASE WHEN alert_level = 'ATTACK' THEN node_id END), '') AS nodes_under_attack,
       coalesce(string_agg(DISTINCT CAST(CASE WHEN schema_version <> -1 THEN schema_version END AS VARCHAR), ','
         ORDER BY CAST(CASE WHEN schema_version <> -1 THEN schema_version END AS VARCHAR)), '')
         AS schema_versions_seen
FROM detected"""),
    "metrics_view": _q("""
SELECT count(*) AS total_logs, count(*) AS total_alerts,
       count(*) FILTER (WHERE alert_level = 'ATTACK') AS attack_count,
       count(*) FILTER (WHERE alert_level = 'HIGH_RISK') AS high_risk_count,
       count(*) FILTER (WHERE alert_level = 'SUSPICIOUS') AS suspicious_count,
       count(*) FILTER (WHERE alert_level = 'CLEAN') AS clean_count,
       CAST(0 AS BIGINT) AS ml_detection_count,
       round(count(*) FILTER (WHERE alert_level = 'ATTACK') / count(*) * 100, 2) AS attack_percentage,
       round(count(*) FILTER (WHERE alert_level = 'HIGH_RISK') / count(*) * 100, 2) AS high_risk_percentage,
       round(count(*) FILTER (WHERE alert_level = 'SUSPICIOUS') / count(*) * 100, 2) AS suspicious_percentage,
       round(count(*) FILTER (WHERE alert_level <> 'CLEAN') / count(*) * 100, 2) AS threat_percentage,
       (SELECT count(*) FROM reg) AS total_nodes,
       count(*) FILTER (WHERE NOT hardware_id_valid) AS invalid_hw_count,
       coalesce(round(avg(CASE WHEN response_time_ms <> -1 THEN response_time_ms END), 1), 0.0)
         AS avg_response_time_ms
FROM detected"""),
    "registry_count": _q("SELECT count(*) AS total_nodes FROM reg"),
    "alert_query": _q("""
SELECT row_number() OVER (ORDER BY severity_score DESC, timestamp DESC, seq ASC) AS rank,
       log_id, node_id, region, alert_level, severity_score, timestamp
FROM detected WHERE alert_level = 'ATTACK'
QUALIFY row_number() OVER (ORDER BY severity_score DESC, timestamp DESC, seq ASC) <= 500"""),
    "alert_page": _q("""
SELECT log_id, node_id, region, alert_level, severity_score, 2 AS page, 100 AS limit,
       count(*) OVER () AS total
FROM detected WHERE upper(region) = 'EUROPE'
QUALIFY row_number() OVER (ORDER BY severity_score DESC, seq ASC) BETWEEN 101 AND 200"""),
    "summary_critical": _q("""
SELECT row_number() OVER (ORDER BY severity_score DESC, timestamp DESC, seq ASC) AS rank,
       log_id, node_id, alert_level, severity_score, timestamp
FROM detected WHERE alert_level IN ('ATTACK', 'HIGH_RISK')
QUALIFY row_number() OVER (ORDER BY severity_score DESC, timestamp DESC, seq ASC) <= 5"""),
    "alert_page_cursor": _q("""
SELECT log_id, node_id, region, alert_level, severity_score, timestamp FROM detected
WHERE severity_score < 90 OR (severity_score = 90 AND seq > 1000)
QUALIFY row_number() OVER (ORDER BY severity_score DESC, seq ASC) <= 100"""),
    "alert_envelope": _q("""
SELECT least(count(*) FILTER (WHERE alert_level = 'HIGH_RISK'), 500) AS total, 500 AS limit, count(*) > 0 AS generated
FROM detected"""),
    "summary_view": _q("""
, top AS (
  SELECT log_id, row_number() OVER (ORDER BY severity_score DESC, timestamp DESC, seq ASC) AS rank FROM detected
  WHERE alert_level IN ('ATTACK', 'HIGH_RISK') QUALIFY rank <= 5)
SELECT count(*) AS total_logs, count(*) AS total_alerts,
       count(*) FILTER (WHERE alert_level = 'ATTACK') AS attack_count,
       count(*) FILTER (WHERE alert_level = 'HIGH_RISK') AS high_risk_count,
       count(*) FILTER (WHERE alert_level = 'SUSPICIOUS') AS suspicious_count,
       count(*) FILTER (WHERE alert_level = 'CLEAN') AS clean_count, CAST(0 AS BIGINT) AS ml_detection_count,
       round(count(*) FILTER (WHERE alert_level = 'ATTACK') / count(*) * 100, 2) AS attack_percentage,
       round(count(*) FILTER (WHERE alert_level <> 'CLEAN') / count(*) * 100, 2) AS threat_percentage,
       (SELECT count(*) FROM reg) AS total_nodes, (SELECT count(*) FROM top) AS critical_count,
       (SELECT coalesce(string_agg(log_id, ',' ORDER BY rank), '') FROM top) AS critical_log_ids,
       (SELECT coalesce(string_agg(node_id, ',' ORDER BY node_id), '')
        FROM (SELECT DISTINCT node_id FROM detected WHERE alert_level = 'ATTACK')) AS nodes_under_attack
FROM detected"""),
    "attacked_nodes": _q("SELECT DISTINCT node_id FROM detected WHERE alert_level = 'ATTACK'"),
    "graph_logs_explicit": _q("""
SELECT log_id, source_node, CASE WHEN seq % 5 = 0 THEN 'NODE-EXT' ELSE target_node END AS target_node,
       CASE WHEN seq % 3 = 0 THEN 'accept:a,x-n:' || lower(source_node) || ',x-trace:b' ELSE headers END AS headers,
       CASE WHEN seq % 4 = 0 THEN 'Mozilla/5.0 probe' ELSE user_agent END AS user_agent, interval,
       CASE WHEN seq % 2 = 0 THEN severity_score ELSE 0.0 END AS severity_score,
       CASE WHEN seq % 2 = 0 THEN alert_level ELSE 'CLEAN' END AS alert_level
FROM graph_logs""", BASE + GRAPH),
    "alert_search": _q("""
SELECT log_id, node_id, region, alert_level, severity_score, timestamp FROM detected
WHERE contains(lower(node_id), 'node-01') OR contains(lower(node_name), 'node-01')
   OR contains(lower(region), 'node-01') OR contains(lower(log_id), 'node-01')"""),
    "alert_search_indexed": _q("""
SELECT q.query, d.log_id, d.node_id, d.region, d.alert_level, d.severity_score
FROM detected d JOIN (VALUES ('NODE-01'), ('000000012'), ('log-0007'), ('east'), ('Zz'), ('no such text')) q(query)
  ON contains(lower(d.node_id), lower(q.query)) OR contains(lower(d.node_name), lower(q.query))
     OR contains(lower(d.region), lower(q.query)) OR contains(lower(d.log_id), lower(q.query))"""),
    "alert_search_page": _q("""
SELECT log_id, node_id, region, alert_level, severity_score, timestamp FROM detected
WHERE contains(lower(node_id), 'europe') OR contains(lower(node_name), 'europe')
   OR contains(lower(region), 'europe') OR contains(lower(log_id), 'europe')
QUALIFY row_number() OVER (ORDER BY severity_score DESC, seq ASC) BETWEEN 101 AND 150"""),
    "latest_alert_per_node": _q("""
SELECT node_id, log_id, timestamp, alert_level, severity_score, response_time_ms FROM detected
QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC, seq ASC) = 1"""),
    "latency_top10": _q("""
WITH_LATEST
SELECT node_id, response_time_ms, alert_level,
       CASE WHEN response_time_ms >= 3000 THEN 'critical' WHEN response_time_ms >= 1500 THEN 'high'
            WHEN response_time_ms >= 800 THEN 'elevated' ELSE 'normal' END AS band,
       row_number() OVER (ORDER BY response_time_ms DESC, timestamp DESC, seq ASC) AS rank
FROM latest WHERE response_time_ms > 0
QUALIFY row_number() OVER (ORDER BY response_time_ms DESC, timestamp DESC, seq ASC) <= 10"""),
    "status_class_4xx": _q("""
WITH_LATEST
SELECT node_id, severity_score, CASE WHEN severity_score < 30 THEN 200 WHEN severity_score < 60 THEN 401
       WHEN severity_score < 80 THEN 403 ELSE 500 END AS status_code
FROM latest WHERE severity_score >= 30 AND severity_score < 80"""),
    "level_distribution": _q("""
SELECT alert_level, count(*) AS alerts, round(count(*) / (SELECT count(*) FROM detected) * 100, 2) AS share_pct
FROM detected GROUP BY alert_level"""),
    "ml_rule_split": _q("""
SELECT CAST(0 AS BIGINT) AS ml_detections, count(*) AS rule_detections, CAST(0.0 AS DOUBLE) AS ml_rate_pct
FROM detected"""),
    "sanitized_alerts": _q("""
SELECT log_id, node_id, alert_level, severity_score, confidence_score,
       CAST(greatest(response_time_ms, 0) AS BIGINT) AS response_time_ms FROM detected"""),
    "detection_quality": _q("""
SELECT r.is_infected, coalesce(f.flagged, false) AS flagged, count(*) AS nodes
FROM reg r LEFT JOIN (SELECT node_id, bool_or(alert_level = 'ATTACK') AS flagged FROM detected GROUP BY node_id) f
  ON r.node_id = f.node_id
GROUP BY r.is_infected, coalesce(f.flagged, false)"""),
    "detection_scores": _q("""
, q AS (
SELECT r.is_infected AS inf, coalesce(f.flagged, false) AS fl
FROM reg r LEFT JOIN (SELECT node_id, bool_or(alert_level = 'ATTACK') AS flagged FROM detected GROUP BY node_id) f
  ON r.node_id = f.node_id),
c AS (SELECT count(*) FILTER (WHERE inf AND fl) AS tp, count(*) FILTER (WHERE NOT inf AND fl) AS fp,
             count(*) FILTER (WHERE inf AND NOT fl) AS fn FROM q)
SELECT tp, fp, fn,
       CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 4) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 4) ELSE 0.0 END AS recall
FROM c""".replace("\n, q AS", "q AS"), BASE + ","),
    "graph_logs": _q("""
SELECT log_id, source_node, target_node, timestamp, headers, user_agent, response_time_ms, interval,
       severity_score, alert_level FROM graph_logs""", BASE + GRAPH),
    "graph_edges": _q("""
SELECT source, target, count, weight, interval, user_agent, headers, avg_response_time_ms FROM edges""",
                      BASE + GRAPH),
    "graph_nodes": _q("SELECT id, node_id, out_degree, centrality, severity_score, node_type FROM nodes",
                      BASE + GRAPH),
    "adjacency": _q("""
SELECT n.node_id, coalesce(e.chunk, 0) AS chunk, coalesce(string_agg(e.target, ',' ORDER BY e.target), '') AS neighbors
FROM nodes n LEFT JOIN (SELECT source, target, (row_number() OVER (PARTITION BY source ORDER BY target) - 1) // 16 AS chunk FROM edges) e
     ON n.node_id = e.source GROUP BY n.node_id, e.chunk""", BASE + GRAPH),
    "attacked_node_chunks": _q("""
SELECT chunk, string_agg(node_id, ',' ORDER BY node_id) AS members
FROM (SELECT node_id, (row_number() OVER (ORDER BY node_id) - 1) // 10 AS chunk
      FROM (SELECT DISTINCT node_id FROM detected WHERE alert_level = 'ATTACK')) GROUP BY chunk"""),
    "edge_running_mean": "WITH RECURSIVE " + BASE + GRAPH + """,
step AS (
  SELECT source_node AS source, target_node AS target, response_time_ms AS rt,
         row_number() OVER (PARTITION BY source_node, target_node ORDER BY seq) AS k FROM graph_logs),
fold(source, target, k, mean) AS (
  SELECT source, target, CAST(0 AS BIGINT), CAST(0.0 AS DOUBLE) FROM edges
  UNION ALL
  SELECT f.source, f.target, s.k, CASE WHEN s.rt >= 0 THEN CAST(printf('%.2f', (f.mean * (s.k - 1) + s.rt) / s.k) AS DOUBLE) ELSE f.mean END
  FROM fold f JOIN step s ON s.source = f.source AND s.target = f.target AND s.k = f.k + 1)
SELECT e.source, e.target, e.count, f.mean AS running_mean, e.avg_response_time_ms
FROM edges e JOIN fold f ON f.source = e.source AND f.target = e.target AND f.k = e.count""",
    "alert_page_deep": _q("""
SELECT log_id, alert_level, severity_score, 91 AS page, 7 AS limit, count(*) OVER () AS total FROM detected
QUALIFY row_number() OVER (ORDER BY severity_score DESC, seq ASC) BETWEEN 631 AND 637"""),
    "validated_records": _q("""
SELECT row_number() OVER (ORDER BY seq) - 1 AS seq, CASE WHEN seq % 50 <> 2 THEN log_id END AS log_id,
       CASE WHEN seq % 50 > 2 THEN CAST(schema_version AS VARCHAR) END AS schema_version,
       CASE seq % 50 WHEN 0 THEN 'schema_version' WHEN 2 THEN 'log_id,node_id,schema_version' ELSE '' END AS missing
FROM raw"""),
    "loaded_levels": _q("""
SELECT region, alert_level, count(*) AS alerts, CAST(sum(severity_score) AS BIGINT) AS severity_sum FROM detected
GROUP BY region, alert_level"""),
    "asof_scan": """
WITH b AS (SELECT s_suppkey * 97 AS start, CAST(s_nationkey AS BIGINT) AS nation FROM supplier)
SELECT e.event_id, coalesce(b.nation, (SELECT arg_min(nation, start) FROM b)) AS nation
FROM events e ASOF LEFT JOIN b ON e.event_id >= b.start""",
    "stage_round_trip": _q("""
, faulty AS (
  SELECT event_id % 97 = 5 OR event_id % 101 = 7 OR (event_id % 89 = 3 AND mapped) AS dropped
  FROM raw JOIN ev ON event_id = seq)
SELECT alert_level AS item, count(*) AS n, CAST(sum(severity_score) AS BIGINT) AS severity FROM detected GROUP BY alert_level
UNION ALL SELECT 'total_rows', count(*), NULL FROM faulty
UNION ALL SELECT 'valid_rows', count(*) FILTER (WHERE NOT dropped), NULL FROM faulty
UNION ALL SELECT 'dropped_rows', count(*) FILTER (WHERE dropped), NULL FROM faulty"""),
    "graph_summary": _q("SELECT (SELECT count(*) FROM nodes) AS total_nodes, count(*) AS total_edges FROM edges",
                        BASE + GRAPH),
    "degree_histogram": _q("""
SELECT CASE WHEN out_degree < 5 THEN '1-5' WHEN out_degree < 10 THEN '5-10' WHEN out_degree < 20 THEN '10-20'
            WHEN out_degree < 50 THEN '20-50' ELSE '50+' END AS bucket, count(*) AS nodes
FROM nodes GROUP BY 1""", BASE + GRAPH),
    "fingerprints": _q("""
SELECT fingerprint_id, fingerprint_key, occurrences, CAST(0 AS BIGINT) AS chunk, nodes, headers, user_agent, interval_bucket, confidence
FROM clusters""", BASE + GRAPH + FINGERPRINT),
    "cluster_members": _q("""
SELECT c.fingerprint_id, m.node_id, c.occurrences, c.confidence
FROM members m JOIN clusters c ON m.fp_key = c.fingerprint_key""", BASE + GRAPH + FINGERPRINT),
    "node_fingerprint_counts": _q("""
SELECT source_node AS node_id, count(*) AS log_count FROM graph_logs GROUP BY source_node""", BASE + GRAPH),
    "top_clusters": _q("""
SELECT fingerprint_id, n_nodes AS size, confidence,
       row_number() OVER (ORDER BY n_nodes DESC, occurrences DESC, confidence DESC, first_seq ASC) AS rank
FROM clusters
QUALIFY row_number() OVER (ORDER BY n_nodes DESC, occurrences DESC, confidence DESC, first_seq ASC) <= 10""",
                       BASE + GRAPH + FINGERPRINT),
    "cluster_confidence_tiers": _q("""
SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS tier,
       count(*) AS clusters FROM clusters GROUP BY 1""", BASE + GRAPH + FINGERPRINT),
    "attribution_candidates": _q("""
SELECT node_id, score, out_degree, fingerprint_matches, centrality, reasons FROM candidates""", ALL),
    "command_node": _q("""
SELECT r.node_id AS command_node,
       least(0.99, round(0.55 + t.m / (t.m + 3.0) + CASE WHEN t.m > 0 THEN (t.m - t.s) / t.m ELSE 0 END * 0.15, 2))
         AS confidence_score,
       r.reasons,
       (SELECT string_agg(node_id, ',' ORDER BY rank) FROM ranked) AS candidates,
       (SELECT string_agg(node_id || ':' || CAST(score AS VARCHAR), ',' ORDER BY rank) FROM ranked WHERE rank <= 3)
         AS top_candidates
FROM ranked r CROSS JOIN top2 t WHERE r.rank = 1""", ALL),
    "candidate_ranking": _q("""
SELECT rank, node_id, score, out_degree, fingerprint_matches, centrality,
       round(least(100.0, score / greatest(max(score) OVER (), 1.0) * 100), 4) AS percentage,
       CASE WHEN rank BETWEEN 2 AND 4 THEN 100 - CAST(round(score / max(CASE WHEN rank = 1 THEN score END) OVER ()
            * 100) AS BIGINT) END AS gap_to_top
FROM ranked""", ALL),
    "node_overlay": _q("""
, first_fp AS (
  SELECT m.node_id, c.fingerprint_id FROM members m JOIN clusters c ON m.fp_key = c.fingerprint_key
  QUALIFY row_number() OVER (PARTITION BY m.node_id ORDER BY c.occurrences DESC, c.confidence DESC,
                             c.first_seq ASC) = 1),
outgoing AS (SELECT source AS node_id, CAST(sum(count) AS BIGINT) AS outgoing_requests FROM edges GROUP BY source),
cmd AS (SELECT node_id FROM ranked WHERE rank = 1)
SELECT n.node_id, n.out_degree, n.severity_score, n.node_type, f.fingerprint_id,
       coalesce(o.outgoing_requests, 0) AS outgoing_requests, c.node_id IS NOT NULL AS is_command_node
FROM nodes n LEFT JOIN first_fp f ON n.node_id = f.node_id LEFT JOIN outgoing o ON n.node_id = o.node_id
     LEFT JOIN cmd c ON n.node_id = c.node_id""".replace("\n, first_fp", "first_fp"), ALL + ","),
}

_LATEST = """, latest AS (SELECT * FROM detected
  QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY timestamp DESC, seq ASC) = 1)"""
for _k in ("latency_top10", "status_class_4xx"):
    ORACLE[_k] = ORACLE[_k].replace("\nWITH_LATEST", _LATEST)

FOREST = BASE + """,
x AS (SELECT *, CAST(http_status AS DOUBLE) AS h, CAST(response_time_ms AS DOUBLE) AS rt FROM detected),
c(n, v) AS (SELECT n, CASE WHEN n < 2 THEN 0.0 WHEN n = 2 THEN 1.0 ELSE 2 * (ln(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n END
            FROM (VALUES (1), (2), (4), (6), (20), (200), (240), (250), (256)) t(n)),
p AS (SELECT *, (CASE WHEN h < 400 THEN 1 + (SELECT v FROM c WHERE n = 200) WHEN rt < 1500 THEN 2 + (SELECT v FROM c WHERE n = 20) ELSE 2.0 END
  + CASE WHEN rt < 2500 THEN 1 + (SELECT v FROM c WHERE n = 250) WHEN h < 450 THEN 2 + (SELECT v FROM c WHERE n = 4) ELSE 2.0 END
  + CASE WHEN h < 0 THEN 1 + (SELECT v FROM c WHERE n = 6) WHEN rt < 2900 THEN 2 + (SELECT v FROM c WHERE n = 240) ELSE 3.0 END) / 3 AS path FROM x),
scored AS (SELECT *, -pow(2, -path / (SELECT v FROM c WHERE n = 256)) AS score FROM p),
ml AS (SELECT *, CASE WHEN score <= -0.65 THEN 'ml_anomaly_critical' WHEN score <= -0.62 THEN 'ml_anomaly_high'
                      WHEN score <= -0.56 THEN 'ml_anomaly_suspicious' ELSE 'none' END AS ml_rule FROM scored),
final AS (SELECT *, CASE WHEN alert_level = 'ATTACK' OR ml_rule = 'ml_anomaly_critical' THEN 'ATTACK'
                         WHEN alert_level = 'HIGH_RISK' OR ml_rule = 'ml_anomaly_high' THEN 'HIGH_RISK'
                         WHEN alert_level = 'SUSPICIOUS' OR ml_rule = 'ml_anomaly_suspicious' THEN 'SUSPICIOUS' ELSE 'CLEAN' END AS level,
                 CASE ml_rule WHEN 'ml_anomaly_critical' THEN 20 WHEN 'ml_anomaly_high' THEN 12 WHEN 'ml_anomaly_suspicious' THEN 6 ELSE 0 END
                   AS ml_bonus FROM ml)
"""

ORACLE.update({
    "small_forest_levels": "WITH " + FOREST + """
SELECT level AS alert_level, ml_rule, count(*) AS alerts, round(min(score), 6) AS min_score,
       CAST(sum(least(CASE level WHEN 'ATTACK' THEN 80 WHEN 'HIGH_RISK' THEN 50 WHEN 'SUSPICIOUS' THEN 25 ELSE 0 END + bonus + ml_bonus, 100))
            AS BIGINT) AS severity_sum
FROM final GROUP BY level, ml_rule""",
    "small_forest_split": "WITH " + FOREST + """
SELECT count(*) FILTER (WHERE ml_rule <> 'none') AS ml_detections, count(*) FILTER (WHERE ml_rule = 'none') AS rule_detections,
       round(count(*) FILTER (WHERE ml_rule <> 'none') / count(*) * 100, 2) AS ml_rate_pct FROM final""",
})

IMPORT = """
ev AS (
  SELECT event_id, user_id, event_type, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events),
rr AS (
  SELECT s AS seq, CAST(s AS VARCHAR) AS sid, to_base64(encode('SN-' || CAST(s AS VARCHAR))) AS token,
         CASE WHEN s % 11 = 0 THEN 'short' WHEN s % 7 = 3 THEN 'four' WHEN s % 7 = 5 THEN 'u04' ELSE 'common' END
           AS layout,
         CASE WHEN s_acctbal < 0 THEN 'True' ELSE 'False' END AS flag
  FROM (SELECT s_suppkey AS s, s_acctbal FROM supplier)),
r1 AS (
  SELECT seq,
         CASE layout WHEN 'four' THEN CAST(sid AS BIGINT) ELSE seq END AS num,
         CASE layout WHEN 'short' THEN 'AEGIS-Node/2.0' WHEN 'common' THEN sid ELSE 'AEGIS-Node/2.0 (Linux)' END
           AS agent,
         CASE layout WHEN 'short' THEN '' WHEN 'common' THEN 'AEGIS-Node/2.0 (Linux) ' || token ELSE token END
           AS uuid,
         CASE layout WHEN 'short' THEN 'False' ELSE flag END AS infected
  FROM rr),
r2 AS (SELECT *, trim(agent || ' ' || uuid) AS combined,
              ((uuid = '' OR contains(uuid, 'AEGIS-Node')) AND agent <> '') AS packed FROM r1),
r3 AS (SELECT *, regexp_extract(combined, '([A-Za-z0-9+/]{8,}={0,2})$', 1) AS tok FROM r2),
r4 AS (
  SELECT seq, num, infected,
         CASE WHEN packed AND tok <> '' THEN tok ELSE uuid END AS uuid2,
         CASE WHEN packed AND tok <> '' THEN coalesce(nullif(trim(regexp_replace(combined,
              '([A-Za-z0-9+/]{8,}={0,2})$', '')), ''), 'AEGIS-Node/2.0') ELSE agent END AS agent2
  FROM r3),
reg_main AS (
  SELECT num, CASE WHEN uuid2 = '' THEN to_base64(encode('SN-' || CAST(num AS VARCHAR))) ELSE uuid2 END
           AS hardware_id_b64,
         agent2 AS user_agent, lower(infected) = 'true' AS is_infected,
         TIMESTAMP '2026-03-01 00:00:00' + to_minutes(num) AS reg_ts
  FROM r4 QUALIFY row_number() OVER (PARTITION BY num ORDER BY seq DESC) = 1),
orphans AS (
  SELECT DISTINCT user_id AS num, to_base64(encode('SN-' || CAST(user_id AS VARCHAR))) AS hardware_id_b64,
         'AEGIS-Node/2.0' AS user_agent, false AS is_infected, TIMESTAMP '2026-03-01 00:00:00' AS reg_ts
  FROM ev WHERE user_id >= 0 AND user_id NOT IN (SELECT num FROM reg_main)),
reg_all AS (SELECT * FROM reg_main UNION ALL SELECT * FROM orphans),
imp_registry AS (
  SELECT printf('NODE-%03d', num) AS node_id, printf('Node %03d', num) AS node_name,
         printf('10.42.%d.%d', num // 256, num % 256) AS ip_address, hardware_id_b64,
         (['US-EAST', 'US-WEST', 'EU-WEST', 'EU-NORTH', 'AP-SOUTH', 'AP-EAST'])[num % 6 + 1] AS region,
         strftime(reg_ts, '%Y-%m-%dT%H:%M:%SZ') AS registered_at, is_infected, user_agent, num
  FROM reg_all),
imp0 AS (
  SELECT e.event_id AS log_num, e.user_id AS node_num,
         CASE WHEN e.event_id >= 5000 THEN 2 ELSE 1 END AS schema_version,
         CASE WHEN e.k = 97 THEN 'UNKNOWN' WHEN e.event_type = 'error' AND e.k % 2 = 1 THEN 'DEGRADED'
              ELSE 'OPERATIONAL' END AS status,
         CAST(CASE WHEN e.k = 98 THEN -1 WHEN e.event_type = 'error' THEN 400 + (e.k % 3) * 50 ELSE 200 END
              AS BIGINT) AS http,
         CAST(trunc(CAST(printf('%.1f', e.value * 20) AS DOUBLE)) AS BIGINT) AS latency,
         m.hardware_id_b64 AS hw
  FROM ev e LEFT JOIN reg_main m ON e.user_id = m.num),
imp_logs AS (
  SELECT printf('LOG-%06d', log_num) AS log_id, printf('NODE-%03d', node_num) AS node_id,
         CAST(schema_version AS VARCHAR) AS schema_version, hw AS hardware_id_b64,
         strftime(TIMESTAMP '2026-03-01 00:00:00' + to_seconds(log_num), '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
         CASE WHEN schema_version = 1 THEN status END AS status,
         CASE WHEN schema_version = 1 THEN CAST(http AS VARCHAR) END AS http_code,
         CASE WHEN schema_version = 1 THEN CAST(latency AS VARCHAR) END AS latency,
         CASE WHEN schema_version <> 1 THEN status END AS node_status,
         CASE WHEN schema_version <> 1 THEN CAST(http AS VARCHAR) END AS response_code,
         CASE WHEN schema_version <> 1 THEN CAST(latency AS VARCHAR) END AS response_ms,
         upper(status) AS rs, http, latency AS rt, node_num, schema_version AS ver
  FROM imp0)"""

ORACLE.update({
    "csv_registry_rows": """
WITH s AS (SELECT s_suppkey AS s, CAST(s_suppkey AS VARCHAR) AS sid, to_base64(encode('SN-' || CAST(s_suppkey AS VARCHAR))) AS token,
                  CASE WHEN s_acctbal < 0 THEN 'True' ELSE 'False' END AS flag,
                  row_number() OVER (ORDER BY s_suppkey) - 1 AS seq FROM supplier)
SELECT seq, CASE WHEN s % 11 = 0 THEN concat_ws(' | ', sid, 'AEGIS-Node/2.0 (Linux)')
                 WHEN s % 7 = 3 THEN concat_ws(' | ', sid, 'AEGIS-Node/2.0 (Linux)', token, flag)
                 WHEN s % 7 = 5 THEN concat_ws(' | ', token, 'AEGIS-Node/2.0 (Linux)', flag)
                 ELSE concat_ws(' | ', sid, 'AEGIS-Node/2.0 (Linux) ' || token, flag) END
            || CASE WHEN s % 13 = 4 THEN ' | rack "A",' || chr(10) || 'row 2' ELSE '' END
            || CASE WHEN s % 6 = 1 THEN ' | extra' ELSE '' END AS fields
FROM s""",
    "csv_log_rows": """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, row_number() OVER (ORDER BY event_id) - 1 AS seq
           FROM events),
t AS (SELECT *, CASE WHEN k = 97 THEN '' WHEN event_type = 'error' AND k % 2 = 1 THEN 'DEGRADED' ELSE 'OPERATIONAL' END AS st
      FROM e)
SELECT seq, CAST(event_id AS VARCHAR) AS log_id, CAST(user_id AS VARCHAR) AS node_id,
       nullif(st || CASE WHEN event_id % 9 = 0 THEN ', "late"' || chr(10) || 'report' ELSE '' END, '') AS json_status,
       CASE WHEN k = 98 THEN NULL WHEN event_type = 'error' THEN CAST(400 + (k % 3) * 50 AS VARCHAR) ELSE '200' END
         AS http_response_code,
       CASE WHEN event_id % 14 <> 0 THEN string_split(printf('%.1f', value * 20), '.')[1] END AS response_time_ms
FROM t""",
    "imported_registry": "WITH " + IMPORT + """
SELECT node_id, node_name, ip_address, hardware_id_b64, region, registered_at, is_infected, user_agent
FROM imp_registry""",
    "imported_logs": "WITH " + IMPORT + """
SELECT log_id, node_id, schema_version, hardware_id_b64, timestamp, status, http_code, latency, node_status,
       response_code, response_ms FROM imp_logs""",
    "imported_pipeline_levels": "WITH " + IMPORT + """,
j AS (
  SELECT l.*, coalesce(nullif(r.hardware_id_b64, ''), l.hardware_id_b64) AS hw_raw
  FROM imp_logs l LEFT JOIN imp_registry r ON l.node_id = r.node_id),
v AS (
  SELECT *, replace(trim(hw_raw), ' ', '') AS c FROM j),
v2 AS (
  SELECT *, (hw_raw IS NOT NULL AND trim(hw_raw) <> '' AND regexp_full_match(c, '[A-Za-z0-9+/]+=*')
             AND try(decode(try(from_base64(c || repeat('=', CAST((4 - length(c) % 4) % 4 AS INTEGER))))))
                 IS NOT NULL) AS ok FROM v),
f AS (
  SELECT ver,
    (http <> -1 AND rs = 'OPERATIONAL' AND http >= 400) AS r1, (http <> -1 AND http >= 500) AS r2,
    (NOT ok) AS r3, (http = -1) AS r4, (rt <> -1 AND rt >= 3000) AS r5,
    (rt <> -1 AND rt >= 1500 AND rt < 3000) AS r6
  FROM v2),
s AS (
  SELECT ver,
    CASE WHEN r1 OR r2 OR r3 OR r4 THEN 'ATTACK' WHEN r5 THEN 'HIGH_RISK' WHEN r6 THEN 'SUSPICIOUS'
         ELSE 'CLEAN' END AS alert_level,
    10 * CAST(r1 AS INTEGER) + 10 * CAST(r2 AS INTEGER) + 15 * CAST(r3 AS INTEGER) + 8 * CAST(r4 AS INTEGER)
      + 8 * CAST(r5 AS INTEGER) + 5 * CAST(r6 AS INTEGER) AS bonus
  FROM f)
SELECT alert_level, CAST(ver AS BIGINT) AS schema_version, count(*) AS alerts,
       CAST(sum(least(CASE alert_level WHEN 'ATTACK' THEN 80 WHEN 'HIGH_RISK' THEN 50
                WHEN 'SUSPICIOUS' THEN 25 ELSE 0 END + bonus, 100)) AS BIGINT) AS severity_sum
FROM s GROUP BY alert_level, ver""",
})
