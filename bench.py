"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default the 0.1 tables) on local[BENCH_CPUS]. Every query is run in full, its
result written to the no-op sink: once untimed, so that code is compiled, and once timed.
"""

from __future__ import annotations

import json
import os
import time

from saleslens import catalog
from saleslens.session import local_session

HEADLINE = [
    "a17_monthly_rollup",
    "spend_trend",
    "j03_transaction_features_v12",
    "product_features_v12",
    "c02_raw_features",
    "c01_generate_features",
    "c07_boosted_matrix",
    "j05_a26_income_range_by_category",
    "a28_median_amount_by_category",
    "a32_buyer_profile",
    "a34_describe",
    "d01_kpi_summary",
    "d03_probability_histogram",
    "d06_banded_heatmap_probability",
    "d08_contact_progress",
    "d11_status_update_clients",
    "d12_priority_list",
    "s06_prediction_upsert",
    "m04_stratified_split",
    "m12_m13_areas",
    "m14_best_threshold",
    "m20_precision_at_top",
    "m03_random_forest_on_test_rows",
    "f11_label_table",
    "t01_streamed_status_changes",
    "t02_late_contacts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
