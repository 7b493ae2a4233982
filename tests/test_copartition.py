"""Tables laid out by one key: joins and sums on it without an Exchange, hot and NULL keys apart."""

import re

import pytest

from shrinkfit.operators import EffectSpec, fit_effects, load_model, predict, save_model
from shrinkfit.operators.copartition import lay_out

CHAIN = (EffectSpec("b_i", "movieId"), EffectSpec("b_u", "userId"), EffectSpec("b_y", "year"))


def _ratings(spark, n=3000):
    """User 7 holds a third of the rows, NULL a twentieth; ``n`` is a column of the caller's."""
    rows = [(i, None if i % 20 == 1 else 7 if i % 3 == 0 else i % 211, i % 37, (i * 13 % 9) / 2 + 0.5, 2000 + i % 5, "a|b" if i % 2 else "b", "mine")
            for i in range(n)]
    return spark.createDataFrame(rows, "rk long, userId long, movieId long, rating double, year int, genres string, n string")


def _both(spark, train, test, lam=1.5):
    plain = fit_effects(train, lam, CHAIN, vocabulary=["a", "b"])
    laid = fit_effects(train, lam, CHAIN, vocabulary=["a", "b"], layout=lay_out(train, "userId", 8))
    to = lay_out(test, "userId", 8)
    return predict(plain, test), predict(laid, to.df, layout=to), to


def test_same_model_and_predictions(spark):
    df = _ratings(spark)
    test = df.where("rk % 4 = 0").unionByName(spark.createDataFrame([(9999, 5000, 1, 2.0, 2001, "a", "new user")], df.schema))
    want, got, to = _both(spark, df.where("rk % 4 <> 0"), test)
    assert to.rest.where("userId = 7").count() == test.where("userId = 7").count() and to.cold.df.where("userId = 7 OR userId IS NULL").isEmpty()
    a = {r.rk: r.pred for r in want.collect()}
    b = {r.rk: (r.pred, r.n) for r in got.collect()}
    assert set(a) == set(b) and len(a) == test.count()
    assert b[9999] == (None, "new user") and a[9999] is None
    assert all(b[k][0] == pytest.approx(a[k], abs=1e-12) and b[k][1] == "mine" for k in a if k != 9999)


def test_scored_side_has_no_exchange(spark, tmp_path):
    df = _ratings(spark)
    train, layout = lay_out(df, "userId", 8), lay_out(df.where("rk % 4 = 0"), "userId", 8)
    save_model(fit_effects(df, 1.0, CHAIN, genres=False, layout=train), str(tmp_path / "model"))
    model = load_model(spark, str(tmp_path / "model"))     # plain tables: the plan holds the scoring alone
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = predict(model, layout.df, layout=layout)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert not re.search(r"(?<!Broadcast)Exchange (hash|range|RoundRobin|single)", plan)


def test_empty_test_table(spark):
    df = _ratings(spark, 200)
    want, got, _ = _both(spark, df, df.where("rk < 0"))
    assert got.count() == 0 and sorted(got.columns) == sorted(want.columns)


def test_other_bucket_counts_are_aligned_again(spark):
    df = _ratings(spark, 600)
    model = fit_effects(df, 1.0, CHAIN, genres=False, layout=lay_out(df, "userId", 8))
    to = lay_out(df, "userId", 4)
    a = {r.rk: r.pred for r in predict(model, df).collect()}
    assert {r.rk: r.pred for r in predict(model, to.df, layout=to).collect()} == pytest.approx(a)
