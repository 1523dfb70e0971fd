"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS``. Each query is built and fully
computed (written to the ``noop`` sink, so nothing passes through Python);
the value is the median of ``BENCH_RUNS`` runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pairscape.checks import QUERIES  # noqa: E402
from pairscape.session import build_session  # noqa: E402

HEADLINE = [
    "F1_parse_raster_name", "A1_monthly_to_seasonal", "J4_forward_pairs", "F15_J6_J7_pair_features", "A3_train_stats",
    "A4_impute_scale", "J2_alignment", "J3_matched_inventory", "X3_patch_index", "W4_spatial_sample", "X4_label_arrays",
    "X5_label_pixels", "W10_final_selection", "A5_regression_metrics", "A10_group_summary", "A11_error_comparison",
    "A14_importance_summary", "X11_ablate_bands", "X13_occlusion", "W16_representative_samples", "W17_handoff_samples",
    "J10_merge_predictions", "R6_pair_report", "R13_label_report", "A19_column_profile", "W13_constrained_pairs",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false",
           # small local inputs: keep one task per core after a shuffle
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in wanted:
        times = []
        for i in range(runs + 1):
            started = time.time()
            QUERIES[name].spark(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.time() - started)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
