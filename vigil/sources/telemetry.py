"""Telemetry view over the driver's TPC-H-style tables.

``events`` becomes the raw node-log table, ``supplier`` (joined to
``nation`` and ``region``) the node registry.  Every log row keeps its
physical field names in a ``fields`` map whose keys drift with the schema
version; normalization resolves them through the version table, exactly as it
would for logs arriving from the JSON or CSV loaders.

Derivation (k = the integer in ``events.props``):

* ``seq`` = ``event_id``; ``log_id`` = ``LOG-%06d``; ``node_id`` = ``NODE-%03d`` of ``user_id``.
* layout: v1 field names when ``event_id < 5000``, v2 names otherwise;
  declared ``schema_version`` 99 (unknown) when ``k = 99``, else 1 / 2.
* status ``DEGRADED`` for errors with odd k, else ``OPERATIONAL``;
  http code NULL when ``k = 98``, ``400 + (k % 3) * 50`` for errors, else 200;
  latency NULL when ``k = 96``, else ``floor(value * 20)``.
* registry: one node per supplier; hardware id is Base64 of a MALWARE string
  when ``s_suppkey % 20 = 7``, illegal text when ``= 13``, else ``b64("SN-n")``.
  Users without a supplier are orphans and fall back to their log's own id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.graphfn import ISO_OUT_FORMAT
from vigil.operators.sizing import spread

V1_FIELDS = {"reported_status": "status", "http_status": "http_code", "response_time_ms": "latency"}
V2_FIELDS = {"reported_status": "node_status", "http_status": "response_code", "response_time_ms": "response_ms"}
V2_START = 5000
UNKNOWN_VERSION_K = 99
NULL_HTTP_K = 98
NULL_LATENCY_K = 96
REGISTRY_EPOCH = "2026-03-01 00:00:00"

RAW_LOG_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("log_id", T.StringType()),
    T.StructField("node_id", T.StringType()),
    T.StructField("schema_version", T.StringType()),
    T.StructField("hardware_id_b64", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("load_val", T.StringType()),
    T.StructField("L_V1", T.StringType()),
])


@dataclass(frozen=True)
class Telemetry:
    logs: DataFrame
    registry: DataFrame
    schema_versions: DataFrame


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _field_map(mapping: dict) -> F.Column:
    return F.create_map(*[x for kv in mapping.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])


def schema_versions_table(spark: SparkSession) -> DataFrame:
    """Version table: (version, field_map, active_since, deprecated, seq).

    Built as an inline SQL table (a JVM-side local relation): a Python-side
    ``createDataFrame`` would route every scan of it through Python workers.
    """
    def entry(version: int, fields: dict, since: int, seq: int) -> str:
        pairs = ", ".join(f"'{k}', '{v}'" for k, v in fields.items())
        return f"('{version}', map({pairs}), 't={since}', {str(version == 1).lower()}, CAST({seq} AS BIGINT))"
    rows = ", ".join([entry(1, V1_FIELDS, 0, 0), entry(2, V2_FIELDS, V2_START, 1)])
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(version, field_map, active_since, deprecated, seq)")


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    ev = spread(ev.select("event_id", "ts", "user_id", "event_type", "value", "props"), ["event_id", "ts"])
    ev = ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    v1 = F.col("event_id") < V2_START
    status = F.when((F.col("event_type") == "error") & (F.col("k") % 2 == 1), "DEGRADED").otherwise("OPERATIONAL")
    http = (F.when(F.col("k") == NULL_HTTP_K, F.lit(None).cast("bigint"))
            .when(F.col("event_type") == "error", F.lit(400) + (F.col("k") % 3) * 50)
            .otherwise(F.lit(200)))
    latency = F.when(F.col("k") == NULL_LATENCY_K, F.lit(None).cast("bigint")).otherwise(
        F.floor(F.col("value") * 20))
    values = [status, http.cast("string"), latency.cast("string")]
    fields_v1 = F.create_map(*[x for name, v in zip(V1_FIELDS.values(), values) for x in (F.lit(name), v)])
    fields_v2 = F.create_map(*[x for name, v in zip(V2_FIELDS.values(), values) for x in (F.lit(name), v)])
    version = (F.when(F.col("k") == UNKNOWN_VERSION_K, F.lit(UNKNOWN_VERSION_K))
               .when(v1, F.lit(1)).otherwise(F.lit(2)))
    return ev.select(
        F.col("event_id").alias("seq"),
        F.format_string("LOG-%06d", "event_id").alias("log_id"),
        F.format_string("NODE-%03d", "user_id").alias("node_id"),
        version.cast("string").alias("schema_version"),
        F.base64(F.encode(F.concat(F.lit("SN-"), F.col("user_id").cast("string")), "UTF-8")).alias("hardware_id_b64"),
        F.date_format("ts", ISO_OUT_FORMAT).alias("timestamp"),
        F.when(v1, fields_v1).otherwise(fields_v2).alias("fields"),
        F.lit(None).cast("string").alias("load_val"),
        F.lit(None).cast("string").alias("L_V1"),
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    reg = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    n = F.col("s_suppkey")
    cls = n % 20
    sn = F.concat(F.lit("SN-"), n.cast("string"))
    hw = (F.when(cls == 7, F.base64(F.encode(F.concat(F.lit("MALWARE-"), sn), "UTF-8")))
          .when(cls == 13, F.concat(F.lit("!!"), sn, F.lit("##")))
          .otherwise(F.base64(F.encode(sn, "UTF-8"))))
    joined = (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
              .join(reg, F.col("n_regionkey") == F.col("r_regionkey")))
    return joined.select(
        F.format_string("NODE-%03d", n).alias("node_id"),
        F.col("s_name").alias("node_name"),
        F.format_string("10.42.%d.%d", F.floor(n / 256).cast("bigint"), n % 256).alias("ip_address"),
        hw.alias("hardware_id_b64"),
        F.upper("r_name").alias("region"),
        F.date_format(F.timestamp_add("MINUTE", n, F.lit(REGISTRY_EPOCH).cast("timestamp")),
                      ISO_OUT_FORMAT).alias("registered_at"),
        (cls.isin(7, 13) | (F.col("s_acctbal") < 0)).alias("is_infected"),
        F.format_string("%d node-agent/2.0 (Linux)", n).alias("user_agent"),
        n.alias("seq"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> Telemetry:
    return Telemetry(raw_logs(spark, sf_dir), registry(spark, sf_dir), schema_versions_table(spark))
