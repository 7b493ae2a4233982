"""The whole reference workflow as one call and one command.

    python -m shrinkfit.plans.workflow --ratings ratings.dat --movies movies.dat --out results/
    python -m shrinkfit.plans.workflow --tables /root/testdata/sf0.1 --out results/

Writes, under ``--out``: ``split_share``, ``leaderboard`` (Models 1-7 with the
relative drop), ``ablation``, ``lambda_grid``, ``best_lambda``, ``final_holdout``
(own intercept and the reference's edx_train intercept) and the fitted final
model (``save_model`` layout), each as Parquet.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.effects import predict, save_model
from ..operators.evaluate import ablation, best_lambda, model_sequence, rmse, with_drop_pct
from ..operators.split import split_share
from .experiment import DATE_CANDIDATES, Experiment


def run_workflow(e: Experiment) -> dict[str, DataFrame]:
    """Every result table of the reference script, from one Experiment."""
    seq = model_sequence(e.model0, e.edx_test)
    m7 = rmse(predict(e.model7, e.edx_test)).select(
        F.lit(7).alias("seq"), F.lit("Model 7: regularised Model 6").alias("method"), "rmse")
    final_own = rmse(predict(e.final_model, e.holdout)).withColumn("intercept", F.lit("edx"))
    final_ref = rmse(predict(e.final_model, e.holdout, intercept=e.mu_train)).withColumn(
        "intercept", F.lit("edx_train"))
    return {
        "split_share": split_share(e.holdout_split).withColumn("split", F.lit("holdout")).unionByName(
            split_share(e.edx_split).withColumn("split", F.lit("edx_test"))),
        "leaderboard": with_drop_pct(seq.unionByName(m7)),
        "ablation": ablation(e.model0, e.edx_train, e.edx_test, list(DATE_CANDIDATES)),
        "lambda_grid": e.grid,
        "best_lambda": best_lambda(e.grid),
        "final_holdout": final_own.unionByName(final_ref).withColumn("lambda", F.lit(e.best[0])),
    }


def write_results(e: Experiment, out: str) -> None:
    for name, df in run_workflow(e).items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{out}/{name}")
    if e.rejected is not None:
        e.rejected.write.mode("overwrite").parquet(f"{out}/rejected_lines")
    save_model(e.final_model, f"{out}/final_model")


def main(argv: list[str] | None = None) -> None:
    from ..session import local_session
    from .experiment import experiment, experiment_from_files

    ap = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("--ratings")
    ap.add_argument("--movies")
    ap.add_argument("--tables", help="folder with lineitem/orders/part Parquet (test view)")
    ap.add_argument("--out", required=True)
    ap.add_argument("--seed", type=int, default=1)
    ap.add_argument("--exclude-genres", default="", help="comma-separated genres left out of the model")
    a = ap.parse_args(argv)
    spark = local_session()
    params = {"seed": a.seed, "exclude_genres": tuple(g for g in a.exclude_genres.split(",") if g)}
    if a.tables:
        e = experiment(spark, a.tables, **params)
    else:
        e = experiment_from_files(spark, a.ratings, a.movies, **params)
    write_results(e, a.out)
    for row in spark.read.parquet(f"{a.out}/leaderboard").orderBy("seq").collect():
        print(f"{row['seq']}  {row['method']:<40} {row['rmse']:.6f}")


if __name__ == "__main__":
    main()
