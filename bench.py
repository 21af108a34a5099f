"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4) select data and cores;
BENCH_QUERIES, a comma-separated list, replaces the default choice.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfsight.plans.catalogue import QUERIES
from shelfsight.session import build_session

HEADLINE = [
    "prj_7_catalog_cards", "flt_4_ranges", "srt_1_review_score", "win_2_release_changes", "agg_1_approved_stats", "agg_7_weighted_average",
    "sco_16_signal_summary", "sco_14_coverage_grade", "sco_17_theme_reconciliation", "sco_10_review_intelligence", "sum_1_release_summaries",
    "cmp_3_differences", "txt_5_derive_sentiment", "txt_7_infer_themes", "ext_2_page_body", "jn_8_match_documents", "jn_9_first_duplicate",
    "snk_9_review_upsert_ids", "edt_4_apply_moderation", "pln_4_work_plan",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)) if cpus.isdigit() else "16", "spark.driver.memory": "5g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/part.parquet").selectExpr("sum(p_partkey)").collect()
    timings = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()
