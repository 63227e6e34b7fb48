"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codestrata import queries as registered  # noqa: E402
from codestrata.session import local_session  # noqa: E402

HEADLINE = (
    "line_explode", "security_scan", "function_metrics", "dead_code", "magic_numbers",
    "code_duplication", "unused_imports", "ai_signals", "quality_scan", "file_report",
    "gate_verdict", "directory_rollup", "json_report", "file_churn",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        registered.release_shared()  # no query profits from the corpus of another
        start = time.perf_counter()
        registered.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    registered.release_shared()
    print(json.dumps({
        "metric": "headline queries, wall clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
