"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and BENCH_QUERIES
(comma-separated names, or "all") choose data, cores and queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evidentia.registry import load  # noqa: E402
from evidentia.session import local_session  # noqa: E402

HEADLINE = [
    "enrichment_by_universe", "fisher_two_sided", "overlap_report", "left_join_sources", "drop_all_duplicates",
    "keep_first", "entity_table_build", "harmonize_symbols", "format_profile", "collapse_lists", "flatten_nested",
    "grouped_programs", "association_scores", "pivot_metrics", "column_regression_scan", "matrix_regression_scan",
    "regression_pvalues_fdr", "bh_fdr", "average_rank", "qq_points", "contiguous_rank", "stouffer_score",
    "rank_sum_test", "nearest_anchor", "nearest_anchor_hubs", "histogram_by_group", "group_distribution",
    "gap_ranking", "best_stage", "arm_tallies", "feature_matrix", "grouped_folds", "pu_fold_membership",
    "ranked_metrics", "average_precision", "pu_out_of_fold", "pu_nominations", "pu_attribution", "pu_ablation",
    "pu_tree_ablation", "burden_wide", "signature_components",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    queries, _ = load()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, cpus)
    # Start the JVM code paths and the Python workers outside the timings.
    queries["column_regression_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    queries["rank_sum_test"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
