"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans import CATALOGUE, Tables, views  # noqa: E402
from plumbline.session import intermediates, local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "c01_builtin_scorer", "d02_composition_curve_lineitem", "d04_certify", "d04_certify_events", "d07_certified_selection",
    "d10_certify_stratified", "d12_certification_rate", "d13_pr_certify", "d14_label_complexity", "e02_select_top_fraction",
    "e08_select_decile", "e12_length_matched", "p01_build_pool_lineitem", "p02_sample_exact_large", "p04_dedup_exclude",
    "p06_label_by_membership", "c05_spectral_scores", "f01_auroc_lineitem", "f05_arm_mean_se", "f08_rouge_l",
    "f10_judge_agreement", "f12_spearman_lineitem", "f14_harmset_rates", "f15_category_rates", "f25_group_kde",
    "h03_flatten_json", "h04_extract_numbers", "h05_trace",
)
SHARED = {"build_pool": views.pool, "build_pool_huge": views.pool_huge, "build_verdicts": views.verdicts}


def main() -> None:
    spark = local_session("bench", CPUS, shuffle=int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    tables = Tables(spark, FOLDER)
    for name, build in SHARED.items():  # tables that several queries read are timed apart
        t0 = time.perf_counter()
        build(tables).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        t0 = time.perf_counter()
        # the whole result is produced, none of it is pulled to the driver
        with intermediates(spark):
            CATALOGUE[name].frame(spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
