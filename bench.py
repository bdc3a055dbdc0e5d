"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from voxtable.plans import all_queries  # noqa: E402
from voxtable.session import build_session  # noqa: E402

HEADLINES = [
    "localisation_report", "contrast_volumes", "annotated_volumes", "intensity_normalise", "painted_masks",
    "voxel_box_range_join", "bilinear_resize", "case_evaluation", "cohort_report", "ranking_metrics", "case_auc",
    "localise", "volume_rules", "volume_sink", "budgeted_selection", "series_box_match", "phase_pairs", "case_split",
    "balanced_sample", "smoothed_curve", "impute_mean", "standardise", "clean_vectors", "class_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "voxtable-bench", partitions=int(cpus) if cpus.isdigit() else None,
                          spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__sql__execution__arrow__maxRecordsPerBatch="1024")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()[0]
    only = sys.argv[1:]
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in only or HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
