"""JSON files derived from the driver tables, for the JSON loader.

``log_files`` writes the telemetry logs as NDJSON, several files in log order
and of unequal size: lines with ``seq % 50`` = 0 lack ``schema_version``, with
1 it is null, with 2 they are no object.  ``registry_files`` writes every node
twice, the first time with another region.  ``version_files`` writes the
version table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def _write_lines(df: DataFrame, path: str, files: int) -> None:
    """``line`` in ``seq`` order, dealt to files whose names follow that order."""
    df.repartitionByRange(files, "seq").sortWithinPartitions("seq").select("line").write.text(path)


def _object(entries: Column) -> Column:
    return F.to_json(entries, KEEP_NULLS)


def log_files(logs: DataFrame, path: str, files: int = 7, whole: bool = False) -> None:
    """``whole``: all lines as they are, none faulty."""
    seq = F.col("seq")
    ids = F.create_map(*[x for c in ("log_id", "node_id", "schema_version", "hardware_id_b64", "timestamp")
                         for x in (F.lit(c), F.col(c).cast("string"))])
    padding = F.when(seq % 1000 < 400, F.create_map(F.lit("note"), F.repeat(F.lit("x"), 300))).otherwise(F.create_map().cast("map<string,string>"))
    record = F.map_concat(ids, "fields", padding)
    if whole:
        line = _object(record)
    else:
        line = (F.when(seq % 50 == 0, _object(F.map_filter(record, lambda k, v: k != "schema_version")))
                .when(seq % 50 == 1, _object(F.transform_values(record, lambda k, v: F.when(k != "schema_version", v))))
                .when(seq % 50 == 2, F.lit("[1, 2]")).otherwise(_object(record)))
    _write_lines(logs.select("seq", line.alias("line")), path, files)


def registry_files(registry: DataFrame, path: str) -> None:
    cols = ("node_id", "node_name", "ip_address", "hardware_id_b64", "region", "is_infected", "user_agent")
    text = lambda c, old: F.lit("OLD") if old and c == "region" else F.col(c).cast("string")
    row = lambda old: _object(F.create_map(*[x for c in cols for x in (F.lit(c), text(c, old))]))
    older = registry.select(F.col("seq"), row(True).alias("line"))
    newer = registry.select((F.col("seq") + (1 << 40)).alias("seq"), row(False).alias("line"))
    _write_lines(older.unionByName(newer), path, 3)


def version_files(versions: DataFrame, path: str) -> None:
    line = F.to_json(F.struct("version", "field_map", "active_since", "deprecated"))
    _write_lines(versions.select("seq", line.alias("line")), path, 1)
