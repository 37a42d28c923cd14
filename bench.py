"""Times the headline queries and prints one JSON line.

The model tables are mapped and written once (reported as ``prepare``), as a
deployment would have them on disk; every query then runs whole against them,
result rows included, through the ``noop`` sink.  Best of ``BENCH_RUNS`` runs in
a warm session.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohort_ledger.plans import registry  # noqa: E402
from cohort_ledger.plans.dataset import Model  # noqa: E402
from cohort_ledger.session import build_session, run_folder  # noqa: E402

HEADLINE = [
    "active_assays",
    "exclusion_breakdown",
    "rerun_missing",
    "joined",
    "status_by_analysis",
    "status_by_patient",
    "cohort_summary",
    "pair_by",
    "pair_by_assay_type",
    "completion_matrix",
    "next_up",
    "fill_only",
    "append_results",
    "append_project",
    "upsert_level",
    "validate_sheet",
    "classify_columns",
    "register_cohort",
    "derive_status",
    "censor_batch",
    "replay_qc_log",
    "input_staleness",
    "all_stale_outputs",
    "derived_staleness",
    "derived_reasons",
    "find_cycles",
    "status_mismatch",
    "lineage_orphans",
    "methylation_summary",
    "sv_summary",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.load()
    mapped = tempfile.mkdtemp(prefix="bench-model-")
    started = time.perf_counter()
    Model(spark, folder).snapshot(mapped)
    prepare = time.perf_counter() - started
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            with run_folder(spark):
                started = time.perf_counter()
                registry.run(name, spark, folder, mapped).write.format("noop").mode("overwrite").save()
                spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        seconds[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "prepare": round(prepare, 3),
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
