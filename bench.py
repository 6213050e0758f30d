"""Wall time of the headline queries, median of three runs on a warm session; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "dedup_ratio", "chunk_fixed", "dedup_first_seen", "snapshot_diff", "incremental_manifest", "refcounts", "missing_chunks", "orphan_chunks", "gc_candidates", "retention_gfs", "retention_smart",
    "restore_point_asof", "version_chain", "verify_layers", "manifest_hash", "pass_rate_grid", "alert_suppressed", "stability_verdicts", "sliding_peak_avg", "replica_placement", "redact_messages", "tree_ancestors", "next_run",
)
RUNS = 3


def main() -> None:
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = session(f"local[{cpus}]", cpus, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    facts = {"spark": spark.version, "cpus": cpus, "shuffle_partitions": cpus, "runs": RUNS}
    spark.stop()
    print(json.dumps({"metric": "sum of median wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), **facts}))


if __name__ == "__main__":
    main()
