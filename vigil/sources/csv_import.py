"""CSV import: raw CSV rows -> canonical logs, repaired registry, version table (SRC1, ING1-11).

Every step is a DataFrame transform.  Row ordinals (``seq``) come from the
reader, because the importer's node numbers and "last row wins" rules
depend on input order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.graphfn import ISO_OUT_FORMAT
from vigil.functions.scalars import PY_FLOAT_RE, py_strip
from vigil.operators.asof import asof_lookup
from vigil.operators.sizing import materialize_dimension, written_table
from vigil.session import scratch_path

# Fixed values (must equal the reference for identical imports).
REGIONS = ["US-EAST", "US-WEST", "EU-WEST", "EU-NORTH", "AP-SOUTH", "AP-EAST"]
DEFAULT_AGENT = "AEGIS-Node/2.0"
AGENT_MARKER = "AEGIS-Node"
UUID_PREFIX = "U04"
TOKEN_RE = r"([A-Za-z0-9+/]{8,}={0,2})$"
IMPORT_EPOCH = "2026-03-01 00:00:00"
V1_FIELDS = {"reported_status": "status", "http_status": "http_code", "response_time_ms": "latency"}
V2_FIELDS = {"reported_status": "node_status", "http_status": "response_code", "response_time_ms": "response_ms"}
NODE_NAME_FORMAT = "Node %03d"


def import_int(col: Column, default) -> Column:
    """The importer's cast: ``int(float(str(v).strip()))``, anything failing -> default."""
    s = py_strip(col.cast("string"))
    value = F.when(s.rlike(PY_FLOAT_RE), F.regexp_replace(s, "_", "").try_cast("double").try_cast("bigint"))
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(value, d.cast("bigint"))


def read_csv_rows(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV files with a header each -> ``seq``, ``values`` (every field, extras included), ``_names`` (SRC1).

    Quoted fields may hold commas, doubled quotes and line breaks; blank lines
    are no rows; rows may have fewer or more fields than the header.  An empty
    field and a missing one are both null.  ``seq`` is the 0-based row ordinal
    over all files in path order.  ``multi_line=False`` lets Spark split large
    files, for inputs without line breaks inside quotes.

    The parsed rows are written once under ``spark.checkpoint.dir``; a row's
    ordinal is its place in its scan split plus the rows of the splits before,
    so only one record per split (rows, first id) is gathered.
    """
    width = _widest(spark, path, multi_line)
    cols = [f"c{i}" for i in range(width)]
    wide = _csv(spark, path, ", ".join(f"{c} string" for c in cols), multi_line)
    target = scratch_path(spark, "csv/rows")
    (wide.select(F.array(*cols).alias("values"), F.col("_metadata.file_path").alias("file"),
                 F.col("_metadata.file_block_start").alias("split"))
     .withColumn("at", F.monotonically_increasing_id()).write.parquet(target))
    rows = spark.read.schema("values array<string>, file string, split bigint, at bigint").parquet(target)
    splits = sorted(rows.groupBy("file", "split").agg(F.min("at"), F.count(F.lit(1))).collect())
    heads = {}
    for file, _, first, _ in splits:
        heads.setdefault(file, first)
    if not splits:
        return rows_schema_empty(spark)
    head_rows = spark.createDataFrame([(at,) for at in heads.values()], "at bigint")
    names = {r.file: r["values"] for r in rows.join(head_rows, "at").collect()}
    table, before = [], 0
    for file, split, first, n in splits:
        header = heads[file] == first
        table.append((file, split, first, before - header, header, names[file]))
        before += n - header
    places = spark.createDataFrame(
        table, "file string, split bigint, first bigint, before bigint, header boolean, _names array<string>")
    return (rows.join(places, ["file", "split"]).where(~F.col("header") | (F.col("at") > F.col("first")))
            .select((F.col("before") + F.col("at") - F.col("first")).alias("seq"), "values", "_names"))


def _csv(spark: SparkSession, path: str, schema: str, multi_line: bool) -> DataFrame:
    return (spark.read.schema(schema).options(header=False, quote='"', escape='"', multiLine=multi_line, mode="PERMISSIVE",
                                              columnNameOfCorruptRecord="_raw", columnPruning=False, maxColumns=1_000_000)
            .csv(path))


def _widest(spark: SparkSession, path: str, multi_line: bool) -> int:
    """An upper bound of the fields of a row: a row of several fields does not fit one column, so its text is at hand."""
    one = _csv(spark, path, "c0 string, _raw string", multi_line)
    commas = F.length("_raw") - F.length(F.replace(F.col("_raw"), F.lit(",")))
    return (one.agg(F.max(F.coalesce(commas, F.length("c0") * 0)).alias("n")).first()["n"] or 0) + 1


def rows_schema_empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "seq bigint, values array<string>, _names array<string>")


def named(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Project header-named columns out of ``read_csv_rows`` output."""
    out = [F.col("seq"), F.col("values")]
    for c in columns:
        pos = F.array_position(F.col("_names"), F.lit(c))
        out.append(F.when(pos > 0, F.try_element_at(F.col("values"), pos.cast("int"))).alias(c))
    return rows.select(*out)


def schema_starts(schema_rows: DataFrame) -> DataFrame:
    """(version, time_start, seq) with the importer's defaults (ING1)."""
    return schema_rows.select(import_int(F.col("version"), 1).alias("version"),
                              import_int(F.col("time_start"), 0).alias("time_start"), "seq")


def repair_registry(rows: DataFrame, name_format: str = NODE_NAME_FORMAT) -> DataFrame:
    """Registry CSV rows -> canonical registry, last duplicate node number wins (ING3-6).

    ``rows`` has ``seq`` (row index) and ``values`` (all fields in order).
    """
    vals = F.filter(F.transform("values", lambda v: py_strip(v)), lambda v: v.isNotNull() & (v != ""))
    df = rows.select("seq", vals.alias("v"))
    v = F.col("v")
    n = F.size(v)
    v0, v1, v2, v3 = (F.try_element_at(v, F.lit(i)) for i in (1, 2, 3, 4))
    four = (n >= 4) & v0.rlike("^[0-9]+$")
    three = (n >= 3) & ~four
    u04 = three & F.startswith(v0, F.lit(UUID_PREFIX))
    num = F.when(four, import_int(v0, F.col("seq"))).otherwise(F.col("seq"))
    agent = F.when(four, v1).when(u04, v1).when(three, v0).otherwise(F.lit(DEFAULT_AGENT))
    uuid = F.when(four, v2).when(u04, v0).when(three, v1).otherwise(F.lit(""))
    infected = F.when(four, v3).when(three, v2).otherwise(F.lit("False"))
    df = df.select("seq", num.alias("num"), agent.alias("agent"), uuid.alias("uuid"), infected.alias("infected"))

    combined = py_strip(F.concat_ws(" ", F.col("agent"), F.col("uuid")))
    token = F.regexp_extract(combined, TOKEN_RE, 1)
    packed = ((F.col("uuid") == "") | F.contains(F.col("uuid"), F.lit(AGENT_MARKER))) & (F.col("agent") != "")
    has_token = packed & (token != "")
    head = py_strip(F.regexp_replace(combined, TOKEN_RE, ""))
    df = df.select(
        "seq", "num", "infected",
        F.when(has_token, token).otherwise(F.col("uuid")).alias("uuid"),
        F.when(has_token, F.when(head == "", F.lit(DEFAULT_AGENT)).otherwise(head)).otherwise(F.col("agent"))
        .alias("agent"))
    hw = F.when(F.col("uuid") == "", F.base64(F.encode(F.concat(F.lit("SN-"), F.col("num").cast("string")),
                                                       "UTF-8"))).otherwise(F.col("uuid"))
    df = df.select("seq", "num", hw.alias("hardware_id_b64"), F.col("agent").alias("user_agent"),
                   (F.lower(F.col("infected")) == "true").alias("is_infected"),
                   F.timestamp_add("MINUTE", F.col("num"), F.lit(IMPORT_EPOCH).cast("timestamp")).alias("_reg"))
    last = df.groupBy("num").agg(F.max_by(F.struct("hardware_id_b64", "user_agent", "is_infected", "_reg", "seq"),
                                          "seq").alias("r")).select("num", "r.*")
    return node_rows(last, name_format)


def region_of(num: Column) -> Column:
    regions = F.array(*[F.lit(r) for r in REGIONS])
    return F.element_at(regions, (F.pmod(num, F.lit(len(REGIONS))) + 1).cast("int"))


def node_rows(df: DataFrame, name_format: str = NODE_NAME_FORMAT) -> DataFrame:
    """Derived registry columns from a node number (ING6)."""
    n = F.col("num")
    return df.select(
        F.format_string("NODE-%03d", n).alias("node_id"),
        F.format_string(name_format, n).alias("node_name"),
        F.format_string("10.42.%d.%d", F.floor(n / 256).cast("bigint"), F.pmod(n, F.lit(256))).alias("ip_address"),
        "hardware_id_b64", region_of(n).alias("region"),
        F.date_format("_reg", ISO_OUT_FORMAT).alias("registered_at"),
        "is_infected", "user_agent", "num", "seq")


def import_logs(rows: DataFrame, starts: DataFrame, registry: DataFrame) -> DataFrame:
    """System-log CSV rows -> canonical raw logs with version-specific field names (ING2, ING7, ING8).

    ``rows``: seq, log_id, node_id, json_status, http_response_code, response_time_ms.
    ``registry``: output of :func:`repair_registry` (``num``, ``hardware_id_b64``).
    """
    df = rows.select(
        "seq",
        import_int(F.col("log_id"), F.col("seq")).alias("log_num"),
        import_int(py_strip(F.coalesce(F.col("node_id").cast("string"), F.lit(""))), 0).alias("node_num"),
        py_strip(F.coalesce(F.nullif(F.col("json_status"), F.lit("")), F.lit("UNKNOWN"))).alias("status"),
        import_int(F.col("http_response_code"), -1).alias("http"),
        import_int(F.col("response_time_ms"), -1).alias("latency"))
    df = asof_lookup(df, "log_num", starts, "time_start", "version", "schema_version")
    reg = registry.select(F.col("num").alias("node_num"), F.col("hardware_id_b64").alias("_hw"))
    df = df.join(reg, "node_num", "left")
    v1 = F.col("schema_version") == 1
    values = [F.col("status"), F.col("http").cast("string"), F.col("latency").cast("string")]

    def fmap(names):
        return F.create_map(*[x for name, val in zip(names, values) for x in (F.lit(name), val)])

    return df.select(
        "seq",
        F.format_string("LOG-%06d", "log_num").alias("log_id"),
        F.format_string("NODE-%03d", "node_num").alias("node_id"),
        F.col("schema_version").cast("string").alias("schema_version"),
        F.col("_hw").alias("hardware_id_b64"),
        F.date_format(F.timestamp_add("SECOND", F.col("log_num"), F.lit(IMPORT_EPOCH).cast("timestamp")),
                      ISO_OUT_FORMAT).alias("timestamp"),
        F.when(v1, fmap(V1_FIELDS.values())).otherwise(fmap(V2_FIELDS.values())).alias("fields"),
        F.lit(None).cast("string").alias("load_val"), F.lit(None).cast("string").alias("L_V1"),
        "node_num")


def orphan_nodes(logs: DataFrame, registry: DataFrame, name_format: str = NODE_NAME_FORMAT) -> DataFrame:
    """Registry rows for log nodes missing from the registry (ING9)."""
    nums = logs.select(F.col("node_num").alias("num")).filter(F.col("num") >= 0).distinct()
    missing = nums.join(registry.select("num"), "num", "left_anti")
    filled = missing.select(
        "num", F.base64(F.encode(F.concat(F.lit("SN-"), F.col("num").cast("string")), "UTF-8")).alias("hardware_id_b64"),
        F.lit(DEFAULT_AGENT).alias("user_agent"), F.lit(False).alias("is_infected"),
        F.lit(IMPORT_EPOCH).cast("timestamp").alias("_reg"), F.lit(-1).cast("bigint").alias("seq"))
    return node_rows(filled, name_format)


def version_table(schema_rows: DataFrame) -> DataFrame:
    """Version table with field maps, ``active_since`` text, v1 deprecated (ING10)."""
    def fmap(m):
        return F.create_map(*[x for kv in m.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    ver = import_int(F.col("version"), 1)
    return schema_rows.select(
        ver.cast("string").alias("version"),
        F.when(ver == 1, fmap(V1_FIELDS)).otherwise(fmap(V2_FIELDS)).alias("field_map"),
        F.concat(F.lit("t="), import_int(F.col("time_start"), 0).cast("string")).alias("active_since"),
        (ver == 1).alias("deprecated"), "seq")


@dataclass(frozen=True)
class Imported:
    logs: DataFrame
    registry: DataFrame
    schema_versions: DataFrame


def import_tables(log_rows: DataFrame, registry_rows: DataFrame, schema_rows: DataFrame,
                  name_format: str = NODE_NAME_FORMAT) -> Imported:
    """End-to-end import (ING11): logs, registry completed with orphans, version table."""
    reg = materialize_dimension(repair_registry(registry_rows, name_format), "repaired-registry")
    # parsed once: the orphans and every later stage read the typed table, not the parsing expressions
    logs = written_table(import_logs(log_rows, schema_starts(schema_rows), reg), "imported-logs")
    full_reg = materialize_dimension(reg.unionByName(orphan_nodes(logs, reg, name_format)), "imported-registry")
    return Imported(logs.drop("node_num"), full_reg, version_table(schema_rows))


def import_csv(spark: SparkSession, logs_path: str, registry_path: str, schema_path: str) -> Imported:
    """Read the three CSV files and import them (SRC1 + ING11)."""
    logs = named(read_csv_rows(spark, logs_path),
                 ["log_id", "node_id", "json_status", "http_response_code", "response_time_ms"])
    reg = read_csv_rows(spark, registry_path)
    schema = named(read_csv_rows(spark, schema_path), ["version", "time_start", "active_column"])
    return import_tables(logs, reg, schema)
