"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``$BENCH_RUNS`` times; its time is the median, from building
the plan (fitting passes included) to the last row, which is thrown away.
"""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import time

HEADLINE = (
    "sql_pricing_summary", "sql_region_revenue", "sql_top_customers", "query_chained", "drop_nans", "fill_nans_zero",
    "merge_outer", "upsert_orders", "append_union", "summarize_moments", "group_histogram", "profile_columns",
    "chart_box", "session_features", "confusion_matrix", "regression_scores", "roc_points", "ks_drift", "var_es",
    "encode_label", "onehot", "hash_encode", "target_encode", "scale_standard", "scale_robust", "split_train_test",
    "rate_gap", "window_avg_time", "ts_autocorr", "cooldown_alerts", "metric_rules", "parse_log_rules", "text_vocab",
    "iou_pairs", "nms_boxes", "io_csv_roundtrip", "stream_gap", "linear_attribution", "isolation_scores", "permutation_importance",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from millrace.plans import QUERIES
    from millrace.session import local_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="millrace-bench")
    spark.sparkContext.setLogLevel("OFF")

    def once(key: str) -> float:
        start = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    with contextlib.redirect_stdout(sys.stderr):
        for key in wanted.split(",") if wanted else HEADLINE:
            once(key)
            seconds[key] = round(statistics.median(once(key) for _ in range(runs)), 3)
            print(key, seconds[key], flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
