"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables, default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every
query runs once on the smallest tables first, so the figures leave out JVM start and class loading.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from verification.queries import QUERIES  # noqa: E402
from wiretide.session import local_session  # noqa: E402

HEADLINE = (
    "flow_records",
    "flow_intervals",
    "connection_profiles",
    "port_scan_pairs",
    "dns_profiles",
    "http_top_paths",
    "ftp_summary",
    "smtp_summary",
    "traffic_baseline",
    "traffic_deviations",
    "top_talkers",
    "protocol_distribution",
    "traffic_timeline",
    "live_talkers",
    "alert_timeline",
    "rule_stats",
    "findings_all",
    "overall_risk_scores",
    "confusion_matrix",
    "sliding_flow_counts",
    "session_flows",
    "adaptive_scores",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    small = Path(folder).parent / "sf0.001"
    spark = local_session(cores, "wiretide-bench", **{"spark.driver.memory": "20g"})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, tables: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - started
        spark.catalog.clearCache()
        return round(took, 3)

    seconds = {}
    for name in HEADLINE:
        if small.exists():
            run(name, str(small))
        seconds[name] = run(name, folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
