"""CSV-shaped input derived from the driver tables, for the import path.

The importer consumes three raw CSV tables.  These views render the driver
tables in those layouts (string fields, row ordinal ``seq``), so the import
operators run over data that grows with the tables:

* registry rows from ``supplier``: the common "n, agent + token, flag" layout,
  plus a four-field layout (``s % 7 = 3``), a token-first layout (``= 5``) and
  a short row (``s % 11 = 0``) that falls back to defaults;
* log rows from ``events``: blank status when k = 97, blank code when k = 98,
  fractional latency text;
* the two-row schema boundary table (version 2 from log 5000).

``registry_csv_file`` and ``log_csv_file`` write the first two as CSV text
(quoted fields with commas, quotes and line breaks, blank lines, rows of
uneven width, one file with a header per block of rows), to be parsed back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.sizing import spread
from vigil.session import ensure_checkpoint_dir
from vigil.sources.csv_import import DEFAULT_AGENT
from vigil.sources.telemetry import read_table

AGENT_TEXT = f"{DEFAULT_AGENT} (Linux)"  # agent text as it appears in registry CSV rows


def registry_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    s = F.col("s_suppkey")
    sid = s.cast("string")
    token = F.base64(F.encode(F.concat(F.lit("SN-"), sid), "UTF-8"))
    flag = F.when(F.col("s_acctbal") < 0, F.lit("True")).otherwise(F.lit("False"))
    values = (F.when(s % 11 == 0, F.array(sid, F.lit(AGENT_TEXT)))
              .when(s % 7 == 3, F.array(sid, F.lit(AGENT_TEXT), token, flag))
              .when(s % 7 == 5, F.array(token, F.lit(AGENT_TEXT), flag))
              .otherwise(F.array(sid, F.concat(F.lit(AGENT_TEXT + " "), token), flag)))
    return sup.select(s.alias("seq"), values.alias("values"))


def log_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    ev = spread(ev.select("event_id", "user_id", "event_type", "value", "props"), ["event_id"])
    ev = ev.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    status = (F.when(F.col("k") == 97, F.lit(""))
              .when((F.col("event_type") == "error") & (F.col("k") % 2 == 1), F.lit("DEGRADED"))
              .otherwise(F.lit("OPERATIONAL")))
    code = (F.when(F.col("k") == 98, F.lit(""))
            .when(F.col("event_type") == "error", (F.lit(400) + (F.col("k") % 3) * 50).cast("string"))
            .otherwise(F.lit("200")))
    latency = F.format_string("%.1f", F.col("value") * 20)
    return ev.select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("log_id"),
                     F.col("user_id").cast("string").alias("node_id"), status.alias("json_status"),
                     code.alias("http_response_code"), latency.alias("response_time_ms"))


def schema_csv_rows(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('1', '0', 'load_val', CAST(0 AS BIGINT)), "
                     "('2', '5000', 'L_V1', CAST(1 AS BIGINT)) AS t(version, time_start, active_column, seq)")


def quoted(field: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(field, F.lit('"'), F.lit('""')), F.lit('"'))


def write_csv_text(lines: DataFrame, header: str, block_rows: int) -> str:
    """Write (seq, line) as text files in the order of ``seq``, one per block of rows; return the folder."""
    path = f"{ensure_checkpoint_dir(lines.sparkSession).rstrip('/')}/csv-text/{uuid.uuid4().hex}"
    part = F.lpad(F.floor(F.col("seq") / block_rows).cast("string"), 12, "0")
    body = lines.select(part.alias("part"), "seq", F.col("line").alias("value"))
    heads = body.select("part").distinct().select("part", F.lit(None).cast("bigint").alias("seq"), F.lit(header).alias("value"))
    (body.unionByName(heads).repartition("part").sortWithinPartitions("part", F.asc_nulls_first("seq"))
     .select("part", "value").write.partitionBy("part").text(path))
    return path


def registry_csv_file(spark: SparkSession, sf_dir: str, block_rows: int = 1000) -> str:
    """Registry rows as CSV: every fourth row quoted, every tenth followed by a blank line, every sixth with extra fields."""
    rows = registry_csv_rows(spark, sf_dir)
    s = F.col("seq")
    note = F.when(s % 13 == 4, F.array(F.lit('rack "A",\nrow 2'))).otherwise(F.array().cast("array<string>"))
    extra = F.when(s % 6 == 1, F.array(F.lit(""), F.lit("extra"))).otherwise(F.array().cast("array<string>"))
    fields = F.transform(F.concat("values", note, extra), lambda f: F.when(
        (s % 4 == 0) | f.contains(",") | f.contains('"') | f.contains("\n"), quoted(f)).otherwise(f))
    line = F.concat(F.array_join(fields, ","), F.when(s % 10 == 9, F.lit("\n")).otherwise(F.lit("")))
    return write_csv_text(rows.select("seq", line.alias("line")), "node_uuid,user_agent,is_infected", block_rows)


def log_csv_file(spark: SparkSession, sf_dir: str, block_rows: int = 50_000) -> str:
    """Log rows as CSV: the status of log numbers divisible by 9 has a quoted line break, those by 14 lack the latency."""
    rows = log_csv_rows(spark, sf_dir)
    s = F.col("seq")
    status = F.when(s % 9 == 0, quoted(F.concat("json_status", F.lit(', "late"\nreport')))).otherwise(F.col("json_status"))
    latency = F.when(s % 14 == 0, F.lit("")).otherwise(F.concat(F.lit(","), F.split_part("response_time_ms", F.lit("."), F.lit(1))))
    line = F.concat("log_id", F.lit(","), "node_id", F.lit(","), status, F.lit(","), "http_response_code", latency,
                    F.when(s % 50 == 7, F.lit("\n\n")).otherwise(F.lit("")))
    return write_csv_text(rows.select("seq", line.alias("line")),
                          "log_id,node_id,json_status,http_response_code,response_time_ms", block_rows)
