"""Print the physical-plan facts behind the scale claims in README.md.

    python tools/plans.py [sf_dir]  > PLANS.md

For each key operator: the formatted plan's scan schema / filters, join
strategies, aggregate phases and shuffle exchanges, and whether any Python
evaluation or Cartesian product appears.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from shrinkfit.operators import lambda_grid, predict, stratified_split  # noqa: E402
from shrinkfit.operators.effects import _subtract, fit_effect  # noqa: E402
from shrinkfit.plans.experiment import experiment, feature_table  # noqa: E402
from shrinkfit.session import local_session  # noqa: E402


def facts(title: str, df) -> None:
    plan = df._jdf.queryExecution().executedPlan().toString()
    formatted = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(formatted)
    print(f"## {title}\n")
    ops = re.findall(r"^\(\d+\) (\w[\w ]*?)(?: \[codegen id : \d+\])?$", text, re.M)
    counts: dict[str, int] = {}
    for op in ops:
        counts[op.strip()] = counts.get(op.strip(), 0) + 1
    print("operators: " + ", ".join(f"{k} ×{v}" for k, v in counts.items()) + "\n")
    for key in ("ReadSchema", "PushedFilters", "PartitionFilters"):
        for line in sorted(set(re.findall(rf"^{key}: .*$", text, re.M)))[:4]:
            print(f"    {line[:160]}")
    for line in sorted(set(re.findall(r"^(?:Left|Right) keys \[\d+\]: .*$|^Join type: .*$", text, re.M)))[:6]:
        print(f"    {line[:160]}")
    bad = [b for b in ("EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin") if b in plan]
    print(f"\nPython evaluation / Cartesian product / nested-loop join: {', '.join(bad) if bad else 'none'}\n")


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    e = experiment(spark, sf_dir)
    print(f"# Physical plans (Spark {spark.version}, {sf_dir}, AQE on; initial plans before runtime re-planning)\n")
    facts("Feature table: lineitem ⋈ orders ⋈ part, release year per item, date parts per row",
          feature_table(spark, sf_dir))
    facts("Reading one side of a written, guarded split", e.edx_train.select("rk", "userId", "rating"))
    facts("Exact stratified split (histogram-located boundary bucket)",
          stratified_split(e.features.select("rk", "rating"), 0.1, 1))
    flagged = e.edx_split
    facts("Seen-key guard: one GROUPING SETS aggregate for both keys",
          flagged.groupingSets([["movieId"], ["userId"]], "movieId", "userId").agg(
              (F.count_if(~F.col("is_test")) > 0).alias("_seen"), F.count(F.lit(1)).alias("_seen_w")))
    cur = e.edx_train.select("movieId", "userId", "rating").withColumns(
        {"_n": F.lit(1).cast("long"), "_s0": F.col("rating") - F.lit(3.0)})
    eff = fit_effect(cur, e.model0.effects[0].spec, [0.0], True, "plans")
    step = _subtract(cur, eff, [0.0], True)
    facts("One effect step: carried residual joined to the item effect, grouped by user",
          step.groupBy("userId").agg(F.sum("_n"), F.sum("_s0")))
    facts("Scoring: Model 6 at λ = 0 on edx_test (5 effect joins + genre terms)",
          predict(e.model0, e.edx_test))
    facts("λ grid scoring: 41 λ as wide columns, one pass over edx_test",
          lambda_grid(e.edx_train, e.edx_test, e.lambdas, vocabulary=e.vocabulary, name="plans-grid"))


if __name__ == "__main__":
    main()
