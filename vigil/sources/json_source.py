"""JSON table loader with required-key validation (SRC2-5).

Rows are read as ``map<string,string>`` so *key presence* survives: a key
present with a null value is kept (and later defaulted), a missing key
rejects the row.  Two layouts:

* NDJSON (one object per line, blank lines skipped) -- splittable, the layout to use at scale;
* a single JSON array per file (the reference's layout) -- read as one
  VARIANT per file, cast to ``array<variant>`` and exploded; each file is one
  task, which is inherent to the array format.

``seq`` follows the order of the file paths and of the records in a file, so
"last one wins" means the same for any layout of the scan.

A missing path, unparsable JSON or a non-array document yields an empty
table, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vigil.operators.prefix import running_in_order, with_ordinal
from vigil.operators.sizing import written_table
from vigil.sources.telemetry import RAW_LOG_SCHEMA

# Required keys per dataset.
REQUIRED_LOG_KEYS = ["log_id", "node_id", "schema_version"]
REQUIRED_NODE_KEYS = ["node_id"]
REQUIRED_SCHEMA_KEYS = ["version", "field_map"]

RECORD_SCHEMA = "seq bigint, record map<string,string>"


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RECORD_SCHEMA)


def read_json_records(spark: SparkSession, path: str, layout: str = "array") -> DataFrame:
    """(seq, record map<string,string>) per JSON object; non-objects give a NULL record."""
    try:
        if layout == "ndjson":
            return _numbered_lines(spark.read.text(path)).select("seq", F.from_json("value", "map<string,string>").alias("record"))
        docs = (spark.read.option("multiLine", "true").option("singleVariantColumn", "v")
                .option("mode", "PERMISSIVE").json(path))
        if "v" not in docs.columns:
            return _empty(spark)
        docs = (docs.withColumn("_file", F.input_file_name())
                .withColumn("_arr", F.col("v").try_cast("array<variant>"))
                .filter(F.col("_arr").isNotNull()))  # non-array documents -> no rows
        exploded = docs.select("_file", F.posexplode("_arr").alias("pos", "value"))
        # file rank (a row per file) x 2^40 + position inside the array; a file is a task of its own
        ranks = with_ordinal(docs.select("_file").distinct(), ["_file"], "_frank", "json-files")
        exploded = exploded.join(ranks, "_file")
        seq = F.col("_frank") * F.lit(1 << 40) + F.col("pos")
        return exploded.select(seq.alias("seq"), F.from_json(F.to_json("value"), "map<string,string>")
                               .alias("record"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return _empty(spark)


def _numbered_lines(lines: DataFrame) -> DataFrame:
    """(seq, value) of a text scan: the place of each line over all files in path order.

    The lines are written once.  A line's place is its place in its split of a
    file plus the lines of the splits before, a running sum with a row per split.
    """
    rows = written_table(lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                                      F.monotonically_increasing_id().alias("at")).where("trim(value) <> ''"), "json/lines")
    splits = rows.groupBy("file", "split").agg(F.min("at").alias("first"), (F.max("at") - F.min("at") + 1).alias("n"))
    splits = running_in_order(splits, ["file", "split"], "n", "before", "json/splits")
    return rows.join(splits, ["file", "split"]).select((F.col("before") + F.col("at") - F.col("first")).alias("seq"), "value")


def validate_records(records: DataFrame, required: list[str]) -> DataFrame:
    """Rows that are objects holding every required key (SRC4)."""
    keys = F.array(*[F.lit(k) for k in required])
    ok = F.col("record").isNotNull() & (F.size(F.array_except(keys, F.map_keys("record"))) == 0)
    return records.filter(ok)


def rejected_records(records: DataFrame, required: list[str]) -> DataFrame:
    """Rejected rows with the keys they lack (SRC5); non-objects list every key."""
    keys = F.array(*[F.lit(k) for k in required])
    missing = F.when(F.col("record").isNull(), keys).otherwise(F.array_except(keys, F.map_keys("record")))
    return records.select("seq", "record", missing.alias("missing_keys")).filter(F.size("missing_keys") > 0)


def logs_from_records(records: DataFrame) -> DataFrame:
    """Canonical raw-log frame from validated log records."""
    r = F.col("record")
    return records.select(
        "seq", r["log_id"].alias("log_id"), r["node_id"].alias("node_id"),
        r["schema_version"].alias("schema_version"), r["hardware_id_b64"].alias("hardware_id_b64"),
        r["timestamp"].alias("timestamp"), r.alias("fields"),
        r["load_val"].alias("load_val"), r["L_V1"].alias("L_V1"),
    ).select(*[F.col(f.name).cast(f.dataType) for f in RAW_LOG_SCHEMA.fields])


def registry_from_records(records: DataFrame) -> DataFrame:
    r = F.col("record")
    return records.select(
        r["node_id"].alias("node_id"), r["node_name"].alias("node_name"), r["ip_address"].alias("ip_address"),
        r["hardware_id_b64"].alias("hardware_id_b64"), r["region"].alias("region"),
        r["registered_at"].alias("registered_at"),
        (F.lower(r["is_infected"]) == "true").alias("is_infected"), r["user_agent"].alias("user_agent"), "seq")


def schemas_from_records(records: DataFrame) -> DataFrame:
    """Version rows; ``field_map`` must be a JSON object (else NULL -> skipped by NRM2)."""
    r = F.col("record")
    return records.select(
        r["version"].alias("version"), F.from_json(r["field_map"], "map<string,string>").alias("field_map"),
        r["active_since"].alias("active_since"), (F.lower(r["deprecated"]) == "true").alias("deprecated"), "seq")


def load_all(spark: SparkSession, data_dir: str, layout: str = "array",
             names=("system_logs", "node_registry", "schema_versions")):
    """(logs, registry, schema_versions) loaded and validated (SRC3)."""
    ext = "json"
    logs, nodes, schemas = (read_json_records(spark, f"{data_dir.rstrip('/')}/{n}.{ext}", layout) for n in names)
    return (logs_from_records(validate_records(logs, REQUIRED_LOG_KEYS)),
            registry_from_records(validate_records(nodes, REQUIRED_NODE_KEYS)),
            schemas_from_records(validate_records(schemas, REQUIRED_SCHEMA_KEYS)))
