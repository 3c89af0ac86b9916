"""Command line: ``python -m vigil <command>``.

  import-csv LOGS REGISTRY SCHEMA OUT   CSV import (three CSV files) -> parquet tables under OUT
  run INPUT OUT [--layout parquet|json|ndjson]
                                        the batch pipeline over imported tables, every stage written under OUT
  alerts STAGES [--level L] [--region R] [--node N] [--limit K]
                                        the alert query view over a pipeline output
"""

from __future__ import annotations

import argparse
import json

from vigil.session import build_session


def _tables(spark, path: str, layout: str):
    if layout == "parquet":
        return (spark.read.parquet(f"{path}/system_logs"), spark.read.parquet(f"{path}/node_registry"),
                spark.read.parquet(f"{path}/schema_versions"))
    from vigil.sources.json_source import load_all
    return load_all(spark, path, layout="array" if layout == "json" else "ndjson")


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="vigil")
    sub = ap.add_subparsers(dest="cmd", required=True)
    imp = sub.add_parser("import-csv")
    for name in ("logs", "registry", "schema", "out"):
        imp.add_argument(name)
    run = sub.add_parser("run")
    run.add_argument("input")
    run.add_argument("out")
    run.add_argument("--layout", default="parquet", choices=["parquet", "json", "ndjson"])
    al = sub.add_parser("alerts")
    al.add_argument("stages")
    al.add_argument("--level")
    al.add_argument("--region")
    al.add_argument("--node")
    al.add_argument("--limit", type=int, default=50)
    args = ap.parse_args(argv)
    spark = build_session(driver_memory=None)

    if args.cmd == "import-csv":
        from vigil.sources.csv_import import import_csv
        imported = import_csv(spark, args.logs, args.registry, args.schema)
        imported.logs.write.mode("overwrite").parquet(f"{args.out}/system_logs")
        imported.registry.write.mode("overwrite").parquet(f"{args.out}/node_registry")
        imported.schema_versions.write.mode("overwrite").parquet(f"{args.out}/schema_versions")
    elif args.cmd == "run":
        from vigil.plans.pipeline import run_pipeline
        logs, registry, versions = _tables(spark, args.input, args.layout)
        result = run_pipeline(spark, logs, registry, versions, args.out)
        summary = {"ran": result.ran, "stages": sorted(result.stages), "stage_write_sec": result.timings}
        if result.ran:
            summary["metrics"] = result.stages["metrics"].first().asDict(recursive=True)
            summary["command_node"] = result.stages["command_node"].select(
                "command_node", "confidence_score").first().asDict()
        print(json.dumps(summary, default=str))
    else:
        from vigil.operators.views import alert_query
        from vigil.sources.sinks import read_stage
        top = alert_query(read_stage(spark, args.stages, "alerts"), args.level, args.region, args.node, args.limit)
        for row in top.select("rank", "log_id", "node_id", "region", "alert_level", "severity_score",
                              "primary_reason").collect():
            print(json.dumps(row.asDict()))


if __name__ == "__main__":
    main()
