"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR  folder of Parquet tables   (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores                (default: all)
"""

from __future__ import annotations

import json
import os
import time

from veilspark.queries import queries
from veilspark.session import local_session

HEADLINE = (
    "detect_payment_card", "scan_documents", "scan_conversations", "scan_pages", "document_chunks",
    "table_shapes", "session_log_records", "embedded_records", "bulk_personal", "sanitise_snippets",
    "collapse_repeats", "sightings", "people_table", "survey", "severity_trend", "latest_with_state",
    "score_recall", "remote_assets", "stream_scan",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = local_session(cores, partitions=cores)
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times, run = {}, queries()
    run[HEADLINE[0]](spark, folder).write.format("noop").mode("overwrite").save()  # the JVM's start-up belongs to no query
    for name in HEADLINE:
        start = time.perf_counter()
        run[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline queries, one run each", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": cores,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
