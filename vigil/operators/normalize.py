"""Normalization: schema-drift resolution, registry lookup, Base64 scan (NRM1-10).

Input is the canonical raw-log frame (see ``sources.telemetry.RAW_LOG_SCHEMA``):
physical fields travel in a ``fields`` map, so a version table decides at run
time which physical name feeds each canonical column -- no field name is
compiled into the plan.  Both lookups (registry, versions) are dimension
joins; Spark broadcasts them by their size in bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.hardware import with_hardware_check
from vigil.functions.scalars import (
    is_py_infinity, normalize_timestamp, present_in_order, safe_int, safe_str, safe_str_upper,
)
from vigil.operators.sizing import materialize_dimension

DEFAULT_HTTP_STATUS = -1
DEFAULT_RESPONSE_TIME = -1
DEFAULT_STATUS = "UNKNOWN"
DEFAULT_REGION = "UNKNOWN"
DEFAULT_NODE_NAME = "UNKNOWN"
FALLBACK_VERSION = 1

# Soft-warning texts, emitted in this order.
WARN_SCHEMA = "Unknown schema_version=%s — fields may not map correctly"
WARN_HTTP = "http_status is missing or null — defaulted to -1"
WARN_LATENCY = "response_time_ms is missing or null — defaulted to -1"
WARN_TIMESTAMP = "timestamp is missing or invalid — set to UNKNOWN"
WARN_NODE = "node_id='%s' not found in node_registry — using defaults"
WARN_HARDWARE = "hardware_id issue: "

NORMALIZED_COLUMNS = [
    "log_id", "node_id", "node_name", "region", "schema_version", "schema_known",
    "reported_status", "http_status", "response_time_ms", "hardware_id_b64",
    "hardware_id_valid", "hardware_id_decoded", "hardware_id_reason", "timestamp",
    "parse_warnings", "load_val", "L_V1", "seq",
]


def _last_per_key(df: DataFrame, key: str) -> DataFrame:
    """Keep the row with the greatest ``seq`` per key ("last one wins").

    ``max_by`` is a partial aggregate, so a duplicated key is combined
    map-side instead of being gathered into one window partition.
    """
    others = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*others), F.col("seq")).alias("_r"))
            .select(key, "_r.*"))


def registry_lookup(registry: DataFrame) -> DataFrame:
    """Trimmed, non-blank node ids, last duplicate wins (NRM1)."""
    reg = registry.withColumn("node_id", safe_str("node_id", None)).filter(F.col("node_id").isNotNull())
    return _last_per_key(reg, "node_id")


def schema_lookup(schema_versions: DataFrame) -> DataFrame:
    """Integer versions with a field map, last duplicate wins (NRM2).

    A JSON number such as ``2.0`` is the version 2; text that is no integer is none.
    """
    ver_text = safe_str(F.col("version").cast("string"), None)
    vers = (schema_versions
            .withColumn("version", F.when(ver_text.rlike(r"^[+-]?[0-9](?:_?[0-9])*(?:\.0+)?$"),
                                          F.regexp_replace(ver_text, r"_|\.0+$", "").try_cast("bigint")))
            .filter(F.col("version").isNotNull() & F.col("field_map").isNotNull())
            .select("version", "field_map", "seq"))
    return _last_per_key(vers, "version").select("version", "field_map")


def _extract(fields: Column, field_map: Column, canonical: str) -> Column:
    """Value of the physical field the map names for ``canonical`` (NRM3)."""
    physical = F.try_element_at(field_map, F.lit(canonical))
    return F.when(physical.isNotNull(), F.try_element_at(fields, physical))


@dataclass(frozen=True)
class Normalized:
    logs: DataFrame        # the canonical rows (NORMALIZED_COLUMNS)
    flagged: DataFrame     # every input row (ids, raw fields) with a boolean ``_skip``
    marked: DataFrame      # the canonical columns of every input row and ``dropped``: what a written stage counts


def _integrity_aggs():
    return [F.count(F.lit(1)).alias("total_rows"), F.count_if(~F.col("_skip")).alias("valid_rows"),
            F.count_if(F.col("_skip")).alias("dropped_rows")]


def normalize(raw_logs: DataFrame, registry: DataFrame, schema_versions: DataFrame) -> Normalized:
    """Raw logs -> canonical normalized logs (NRM3-9).

    Rows that cannot be normalized (blank ids, an infinite number) are
    flagged right after field extraction.  ``logs`` drops them there, before the
    registry join and the Base64 stages; ``marked`` carries them along, so that
    one written stage holds kept and dropped rows and its files give the
    integrity counts (NRM10).
    """
    versions = materialize_dimension(schema_lookup(schema_versions).withColumn("_known", F.lit(True)), "versions")
    v1_map = versions.filter(F.col("version") == FALLBACK_VERSION).select("field_map").scalar()
    reg = materialize_dimension(registry_lookup(registry).select(
        "node_id", F.col("node_name").alias("_r_name"), F.col("region").alias("_r_region"),
        F.col("hardware_id_b64").alias("_r_hw"), F.lit(True).alias("_r_hit")), "registry")

    logs = raw_logs.select(
        "seq",
        safe_str("log_id", "").alias("log_id"),
        safe_str("node_id", "").alias("node_id"),
        F.col("schema_version").cast("string").alias("_ver_raw"),
        safe_int(F.col("schema_version").cast("string"), -1).alias("_ver"),
        F.col("hardware_id_b64").alias("_log_hw"),
        F.col("timestamp").alias("_ts_raw"),
        "fields", "load_val", "L_V1",
    )
    logs = logs.join(versions, logs["_ver"] == versions["version"], "left").drop("version")
    known = F.coalesce(F.col("_known"), F.lit(False))
    fmap = F.when(known, F.col("field_map")).otherwise(v1_map)
    status_raw = _extract(F.col("fields"), fmap, "reported_status")
    http_raw = _extract(F.col("fields"), fmap, "http_status")
    rt_raw = _extract(F.col("fields"), fmap, "response_time_ms")
    logs = logs.select(
        "*", known.alias("schema_known"),
        status_raw.alias("_status_raw"), http_raw.alias("_http_raw"), rt_raw.alias("_rt_raw"),
    )
    skip = ((F.col("log_id") == "") | (F.col("node_id") == "")
            | is_py_infinity("_ver_raw") | is_py_infinity("_http_raw") | is_py_infinity("_rt_raw"))
    flagged = logs.withColumn("_skip", skip)
    kept = _canonical(flagged.filter(~F.col("_skip")), reg).drop("_skip")
    return Normalized(kept, flagged, _canonical(flagged, reg).withColumnRenamed("_skip", "dropped"))


def _canonical(logs: DataFrame, reg: DataFrame) -> DataFrame:
    """NORMALIZED_COLUMNS and ``_skip`` of the extracted rows."""
    logs = logs.join(reg, "node_id", "left")
    hit = F.coalesce(F.col("_r_hit"), F.lit(False))
    r_hw_present = F.col("_r_hw").isNotNull() & (F.col("_r_hw") != "")
    hw_raw = F.when(hit & r_hw_present, F.col("_r_hw")).otherwise(F.col("_log_hw"))
    logs = with_hardware_check(logs.withColumn("_hw_raw", hw_raw), "_hw_raw", "_hw")

    http = safe_int("_http_raw", DEFAULT_HTTP_STATUS)
    rt = safe_int("_rt_raw", DEFAULT_RESPONSE_TIME)
    ts = normalize_timestamp("_ts_raw")
    warnings = present_in_order([
        F.when(~F.col("schema_known"), F.format_string(WARN_SCHEMA, F.coalesce(F.col("_ver_raw"), F.lit("None")))),
        F.when(http == DEFAULT_HTTP_STATUS, F.lit(WARN_HTTP)),
        F.when(rt == DEFAULT_RESPONSE_TIME, F.lit(WARN_LATENCY)),
        F.when(ts == "UNKNOWN", F.lit(WARN_TIMESTAMP)),
        F.when(~hit, F.format_string(WARN_NODE, F.col("node_id"))),
        F.when(~F.col("_hw.valid"), F.concat(F.lit(WARN_HARDWARE), F.col("_hw.reason"))),
    ])
    hw_out = F.when(F.col("_hw_raw").isNull() | (F.col("_hw_raw") == ""), F.lit(None).cast("string")) \
        .otherwise(safe_str("_hw_raw", ""))
    return logs.select(
        "log_id", "node_id",
        F.when(hit, safe_str("_r_name", DEFAULT_NODE_NAME)).otherwise(F.lit(DEFAULT_NODE_NAME)).alias("node_name"),
        F.when(hit, safe_str("_r_region", DEFAULT_REGION)).otherwise(F.lit(DEFAULT_REGION)).alias("region"),
        F.col("_ver").alias("schema_version"),
        "schema_known",
        safe_str_upper("_status_raw", DEFAULT_STATUS).alias("reported_status"),
        http.alias("http_status"),
        rt.alias("response_time_ms"),
        hw_out.alias("hardware_id_b64"),
        F.col("_hw.valid").alias("hardware_id_valid"),
        F.col("_hw.decoded").alias("hardware_id_decoded"),
        F.col("_hw.reason").alias("hardware_id_reason"),
        ts.alias("timestamp"),
        warnings.alias("parse_warnings"),
        "load_val", "L_V1", "seq", "_skip",
    )


def integrity_summary(flagged: DataFrame) -> DataFrame:
    """total / valid / dropped rows, one pass (NRM10)."""
    return flagged.agg(*_integrity_aggs())
