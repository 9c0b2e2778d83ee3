"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) come from the environment.
Every query is planned and executed in full into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "prior_mean_zero_filled", "prior_rolling_means", "era_to_date_mean", "prior_windows_few_large_keys",
    "latest_snapshot", "ladder_collapse", "equal_count_bins", "quantile_bins", "team_event_measures",
    "rival_side_self_join", "on_field_exposure", "opportunity_by_location", "asof_forward_by_group",
    "asof_nearest_with_tolerance", "interval_join_modal_period", "bin_lookup_with_clamp",
    "entity_history_block", "rival_cohort_block", "group_tendency_block", "feature_build", "feature_build_all", "project_future_period",
    "compare_lines_with_projections", "grade_lines", "ratio_quantile_table", "error_quantiles",
    "json_feed_to_rows", "board_text_to_rows",
]


def main() -> None:
    from pitpanel.queries import load_all
    from pitpanel.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    registry = load_all()
    wanted = sys.argv[1:] or HEADLINE
    # Start-up cost (JVM, code paths) is not part of any query.
    registry["value_distribution"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in wanted:
        t = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec",
                "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
