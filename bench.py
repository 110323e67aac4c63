"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from echoledger.plans.queries import QUERIES
from echoledger.session import build_session

HEADLINE = (
    "daily_summary",
    "session_metrics",
    "running_totals",
    "cost_by_model",
    "canonical_hash",
    "exact_repeat_attribution",
    "assemble_message",
    "guard_safe",
    "confusion_sweep",
    "similarity_best",
    "tiered_resolution",
    "replay_attribution",
    "stream_session_metrics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if list(names) == ["all"]:
        names = list(QUERIES)
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["hit_rate"](spark, sf_dir).collect()  # start the JVM side once
    times = {}
    for name in names:
        runs = []
        for _ in range(3):  # the median leaves out a cold first run
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(sorted(runs)[1], 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(f"{name:32s} {times[name]:8.2f}", file=sys.stderr, flush=True)
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
