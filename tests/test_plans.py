"""Registered queries vs the DuckDB oracle on the smallest tables, and plan checks."""

import math
from collections import Counter

import pytest

import __spark_entry__ as se
from shrinkfit.operators import predict
from shrinkfit.plans.experiment import experiment

TABLES = ["part", "orders", "lineitem"]
FAST = ["ratings_enriched", "release_year", "rating_date_parts", "genre_indicators", "regroup_first_sum",
        "stratified_split", "guarded_train_test", "seen_key_removed", "split_share", "edx_train_test",
        "movie_effect", "genre_effects", "model_sequence", "ablation_rating_date", "lambda_grid",
        "best_lambda", "leaderboard", "final_holdout_rmse_ref_intercept", "corr_ids", "corr_genres",
        "correlated_pairs", "delimited_roundtrip", "head_sample", "movies_roundtrip", "malformed_lines",
        "csv_roundtrip", "regularised_effects", "candidate_effects", "genre_effects_excluded",
        "model_sequence_excluded", "copartitioned_predictions", "excluded_genres", "quarantined_lines", "sql_features",
        "sql_predictions", "dense_row_id", "prefix_columns", "seen_key_semi", "price_quantiles", "price_strata"]


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.fixture(scope="module")
def duck(small_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small_dir}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle():
    from shrinkfit.plans.oracle import oracle_queries
    from shrinkfit.plans.queries import QUERIES
    assert set(QUERIES) == set(oracle_queries()) and set(QUERIES) <= set(se.queries())


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, small_dir, name):
    sdf = se.queries()[name](spark, small_dir)
    rel = duck.execute(se.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(sdf.columns) == sorted(dcols)
    si = sorted(range(len(sdf.columns)), key=lambda i: sdf.columns[i])
    di = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = Counter(tuple(_norm(r[i]) for i in si) for r in sdf.collect())
    b = Counter(tuple(_norm(r[i]) for i in di) for r in rel.fetchall())
    assert a == b


def test_entry_smoke(spark):
    df = se.entry(spark)
    assert df.columns == ["rk", "userId", "movieId", "rating", "pred"]
    assert df.count() > 0 and df.where("pred IS NULL").isEmpty()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_predict_plan_has_no_python_and_no_cartesian(spark, small_dir):
    e = experiment(spark, small_dir)
    plan = _plan(predict(e.model0, e.edx_test))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_all_registered_plans_are_python_free(spark, small_dir):
    for name in ("model_sequence", "lambda_grid", "corr_date_parts", "genre_indicators"):
        plan = _plan(se.queries()[name](spark, small_dir))
        assert "EvalPython" not in plan and "CartesianProduct" not in plan, name


def test_scan_pushdown_on_materialized_split(spark, small_dir):
    e = experiment(spark, small_dir)
    plan = _plan(e.edx_train.select("rk"))
    assert "PushedFilters" in plan and "is_test" in plan
