"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Queries run in workflow order in one session (later steps reuse the
materialised splits, as a user session would); each timing covers its own
work only and ends with a full action (the ``noop`` sink: every row is
computed, none is shipped to Python).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shrinkfit.plans.queries import QUERIES  # noqa: E402
from shrinkfit.session import local_session  # noqa: E402

HEADLINE = [
    "feature_table",        # scan + join + release year + date parts, materialised
    "edx_train_test",       # two exact stratified splits + seen-key guards
    "genre_indicators",     # one-hot over the whole ratings table
    "model_sequence",       # fit Model 6 at λ=0, score Models 1-6 in one pass
    "ablation_rating_date",  # four candidate effects on the Model 4 residual
    "lambda_grid",          # 41 regularised fits as wide columns
    "leaderboard",          # + Model 7 at the best λ
    "final_holdout_rmse",   # refit on edx, score the holdout
    "corr_genres",          # correlation matrix, rating + all genre indicators
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")))
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        # The noop sink runs the whole plan without shipping rows to Python.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
