"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

import workload  # noqa: E402

HEADLINE = [
    "a1_monthly_volume", "a2_activity_duration", "a4_cycle_time", "a5_waiting_time",
    "a6_variant_summary", "a7_directly_follows", "a7_end_activities", "a8_duration_summary",
    "m7_process_measures", "m8_log_report", "m10_user_report", "m11_savings",
    "s3_records_table", "p7_normalize_convert", "p20_atomic_actions", "a18_telemetry",
    "g2_cyclic_workflows", "g4_reachable", "g6_repaired_edges", "u1_classify_steps",
    "v4_diagnosis_violations", "v6_workflow_violations", "v8_advisor_violations",
    "k3_representatives", "k2_vector_clusters", "k2_text_clusters",
]

# Timed, but no part of the total.
LATER = ["j12_neighbour_counts", "k2_density_hierarchy", "s3_awkward_names", "p6_timestamp_forms"]


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracemill-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    workload.load()

    def timed(queries: dict, names: list[str]) -> dict[str, float]:
        times = {}
        for name in names:
            start = time.perf_counter()
            queries[name](spark, d).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
            print(name, times[name], file=sys.stderr)
        return times

    times = timed(workload.QUERIES, HEADLINE)
    later = timed(workload.QUERIES, LATER)
    try:  # the optional subpackage and its pipeline
        import corpus_pipeline
        from tracemill import llm

        llm.load()
        later |= timed({**llm.QUERIES, "pipeline": corpus_pipeline.run}, [*sorted(llm.QUERIES), "pipeline"])
    except ImportError:
        pass
    print(json.dumps({
        "metric": "total headline query time",  # of the same queries in every round; "queries" has the others too
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times | later,
        "sf": Path(d).name,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
