"""Exact stratified split and seen-key guard."""

import bisect
import math

import pytest
from pyspark.sql import functions as F

from shrinkfit.operators import (natural_anti_join, quantile_breaks, seen_key_guard, split_share,
                                 stratified_split, stratum_expr)
from shrinkfit.operators import quantiles
from shrinkfit.session import written


def _ratings(spark, n=2000):
    rows = [(f"k{i}", i % 37, i % 53, float(((i * 7919) % 10) + 1) / 2) for i in range(n)]
    return spark.createDataFrame(rows, "rk string, userId long, movieId long, rating double")


def test_percentiles_match_spark(spark):
    df = _ratings(spark)
    exact = df.selectExpr("percentile(rating, array(0.0, 0.25, 0.5, 0.75, 1.0)) q").first()["q"]
    assert quantile_breaks(df) == [float(x) for x in exact]


def test_exact_share_per_stratum(spark):
    df = _ratings(spark)
    for p in (0.1, 0.2, 0.9):
        out = stratified_split(df, p, seed=7, keep_stratum=True)
        assert out.count() == df.count()
        for r in out.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
            assert r["t"] == math.ceil(r["n"] * p)


def test_split_selects_smallest_hashes(spark):
    df = _ratings(spark, 500)
    out = stratified_split(df, 0.3, seed=3, keep_stratum=True, bucket_rows=1)  # force several buckets
    ranked = out.withColumn("h", F.md5(F.concat(F.lit("3:"), "rk")))
    for s in [r["stratum"] for r in ranked.select("stratum").distinct().collect()]:
        part = sorted((r["h"], r["rk"], r["is_test"]) for r in ranked.where(F.col("stratum") == s).collect())
        k = sum(1 for x in part if x[2])
        assert all(x[2] for x in part[:k]) and not any(x[2] for x in part[k:])


def test_duplicate_breaks_merge(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 1, 1, 2, 3]], "rating double")
    breaks = quantile_breaks(df)
    assert breaks[0] == breaks[1] == 1.0
    labels = {r["rating"]: r["s"] for r in df.select("rating", stratum_expr("rating", breaks).alias("s")).distinct().collect()}
    assert labels[1.0] == 1   # the minimum stays in the first bin (include.lowest)


def test_guard_moves_unseen_keys(spark):
    df = spark.createDataFrame([
        ("a", 1, 10, True), ("b", 1, 10, False), ("c", 2, 10, True),   # user 2 only in test
        ("d", 1, 20, True),                                            # movie 20 only in test
        ("e", 3, 30, False), ("f", 3, 30, True),
    ], "rk string, userId long, movieId long, is_test boolean")
    out = {r["rk"]: (r["is_test"], r["moved_to_train"]) for r in seen_key_guard(df).collect()}
    assert out["c"] == (False, True) and out["d"] == (False, True)
    assert out["a"] == (True, False) and out["f"] == (True, False) and out["b"] == (False, False)


def test_guard_complement_equals_natural_anti_join(spark):
    df = _ratings(spark, 800)
    s = stratified_split(df, 0.9, seed=1)
    g = seen_key_guard(s)
    temp = s.where("is_test").drop("is_test")
    train = s.where("NOT is_test")
    kept = (temp.join(train.select("movieId").distinct(), "movieId", "left_semi")
            .join(train.select("userId").distinct(), "userId", "left_semi"))
    removed = natural_anti_join(temp, kept)
    moved = g.where("moved_to_train").select("rk")
    assert sorted(r["rk"] for r in removed.collect()) == sorted(r["rk"] for r in moved.collect())
    assert moved.count() > 0
    assert g.where("is_test").count() == kept.count()
    # Property: every test key is seen on the train side; sides partition the input.
    tr = g.where("NOT is_test")
    te = g.where("is_test")
    assert te.join(tr.select("movieId").distinct(), "movieId", "left_anti").count() == 0
    assert te.join(tr.select("userId").distinct(), "userId", "left_anti").count() == 0
    assert tr.count() + te.count() == df.count()


def test_natural_anti_join_null_safe(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None)], "k int, v string")
    assert [tuple(r) for r in natural_anti_join(a, b).collect()] == [(2, "x")]


def test_split_share(spark):
    df = spark.createDataFrame([(True,), (False,), (False,), (False,)], "is_test boolean")
    r = split_share(df).first()
    assert (r["n_total"], r["n_test"], r["n_train"], r["test_pct"]) == (4, 1, 3, 25.0)


def test_guard_single_key(spark):
    df = spark.createDataFrame([("a", 1, 10, True), ("b", 2, 10, False), ("c", 3, 20, True)],
                               "rk string, userId long, movieId long, is_test boolean")
    out = {r["rk"]: r["is_test"] for r in seen_key_guard(df, keys=("movieId",)).collect()}
    assert out == {"a": True, "b": False, "c": False}


def test_null_key_rows_take_part(spark):
    rows = [(None if i % 2 else f"k{i}", float(i % 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "rk string, rating double")
    out = stratified_split(df, 0.2, 1, keep_stratum=True).groupBy("stratum").agg(
        F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert out and all(r["t"] == math.ceil(r["n"] * 0.2) for r in out)


def test_null_rating_raises(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "rk string, rating double")
    with pytest.raises(ValueError):
        stratified_split(df, 0.2)


def test_breaks_of_many_values(spark):
    df = spark.range(150_001).select((F.col("id") / 7).alias("rating"))
    assert quantile_breaks(df) == pytest.approx([0.0, 37500 / 7, 75000 / 7, 112500 / 7, 150000 / 7])


def test_order_statistics_equal_percentile(spark, monkeypatch):
    """Continuous, heavy, signed and infinite values; a small limit makes the search go on, narrow brackets make it miss."""
    wave = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7.25).when(F.col("id") == 1, float("-inf")).when(F.col("id") == 2, float("inf"))
                                      .otherwise(F.sin(F.col("id").cast("double")) * F.pow(F.lit(10.0), F.col("id") % 9)).alias("rating")).repartition(7)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    values = sorted(r["rating"] for r in wave.collect())
    for slack in (quantiles.SLACK, 1e-9):
        monkeypatch.setattr(quantiles, "SLACK", slack)
        wanted = {k for p in probs for k in (math.floor(29_999 * p), math.ceil(29_999 * p))}
        got, rows = quantiles.order_statistics(wave, "rating", lambda n: wanted, limit=40)
        assert rows == 30_000
        assert got == {k: (values[k], bisect.bisect_right(values, values[k])) for k in wanted}
    finite = wave.where(F.abs("rating") < float("inf"))
    exact = finite.select(F.percentile("rating", list(probs))).first()[0]
    assert quantile_breaks(finite, probs=probs) == pytest.approx(list(exact), rel=1e-12)


def test_order_statistics_of_nan_and_small_tables(spark):
    df = spark.createDataFrame([(2.0,), (float("nan"),), (1.0,)], "rating double")
    got, rows = quantiles.order_statistics(df, "rating", lambda n: range(n))
    assert rows == 3 and got[0] == (1.0, 1) and got[1] == (2.0, 2) and math.isnan(got[2][0]) and got[2][1] == 3
    assert quantile_breaks(df.where("rating = 2")) == [2.0] * 5
    with pytest.raises(ValueError):
        quantile_breaks(df.where("rating > 5 AND NOT isnan(rating)"))


def test_breaks_sort_no_values(spark):
    """Of 120,000 continuous values only those in the brackets are written, and no exchange is ranged by the value."""
    df = spark.range(120_000).select(F.rand(5).alias("rating"))
    before = set(written(spark))
    quantile_breaks(df)
    new = [p for p in written(spark) if p not in before]
    assert new and all("quantile-brackets" in p for p in new)
    assert sum(spark.read.parquet(p).count() for p in new) < 0.06 * 120_000


def test_rows_of_one_key_are_cut_without_a_window(spark):
    """A third of the rows have a null key, and rows equal in every column are cut by their place: exact counts, one projection, no window."""
    rows = [(None if i % 3 == 0 else f"k{i}", float(i % 4), i % 7 if i % 2 else 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "rk string, rating double, other int").repartition(5)
    for p in (0.05, 0.31):
        out = stratified_split(df, p, 1, keep_stratum=True, bucket_rows=50)
        for r in out.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect():
            assert r["t"] == math.ceil(r["n"] * p)
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.drop("is_test", "stratum").exceptAll(df).isEmpty() and out.count() == 6000
        # The same rows are picked again, up to rows that are equal in every column.
        again = stratified_split(df.repartition(3), p, 1, keep_stratum=True, bucket_rows=50)
        assert again.exceptAll(out).isEmpty()


def test_split_is_one_projection_over_its_input(spark, tmp_path):
    _ratings(spark).write.parquet(str(tmp_path / "r"))
    out = stratified_split(spark.read.parquet(str(tmp_path / "r")), 0.2, 1)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and not any(x in plan for x in ("Union", "Window", "Exchange", "InMemoryTableScan"))
