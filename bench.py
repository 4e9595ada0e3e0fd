"""Time the headline queries; one JSON line on standard output.

Each query runs whole and its rows are produced but not kept. One warm-up per session, then the best of
``BENCH_RUNS`` (default 1) runs per query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from salvage.plans.queries import QUERIES
from salvage.session import build_session

HEADLINE = (
    "table_inventory", "column_inventory", "dump_siblings", "link_resolution", "preflight",
    "normalize_events", "normalize_embeddings", "stringify_orders", "slug_parts", "redact_documents",
    "csv_roundtrip", "json_roundtrip", "parquet_roundtrip", "export_ledger", "fingerprint_saved_queries",
    "query_types", "query_warnings", "query_dependencies", "dependency_edges", "query_translations",
    "query_models", "sql_workbench", "key_audit", "relationship_audit", "property_rows",
    "coverage_ledger", "coverage_summary", "run_summary", "db_info", "unpack",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["query_models"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["key_audit"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(min(taken), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
