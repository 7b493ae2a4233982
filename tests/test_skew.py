"""Hot keys past the broadcast bound: split join equals the plain join."""

import pytest

from shrinkfit.operators import fit_effects, lookup_join, predict


def _skewed(spark, n=4000):
    import random
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        user = 0 if i % 3 == 0 else rnd.randrange(1, 200)        # user 0 holds a third of the rows
        movie = 7 if i % 4 == 0 else rnd.randrange(1, 150)        # movie 7 a quarter
        rows.append((f"k{i}", user, movie, 0.5 * rnd.randrange(1, 11), 1990 + movie % 9, 1996 + i % 5,
                     i % 54, "a|b" if movie % 2 else "b"))
    return spark.createDataFrame(rows, "rk string, userId long, movieId long, rating double, release_year int, "
                                       "rating_year int, rating_week_of_year int, genres string")


def test_lookup_join_hot_split_matches_plain(spark):
    big = _skewed(spark)
    small = big.groupBy("userId").count().withColumnRenamed("count", "n")
    plain = sorted(tuple(r) for r in lookup_join(big, small, ["userId"]).select("rk", "n").collect())
    spark.conf.set("shrinkfit.broadcastMaxBytes", "400")
    try:
        split = lookup_join(big, small, ["userId"], weight_col="n")
        plan = split._jdf.queryExecution().executedPlan().toString()
        got = sorted(tuple(r) for r in split.select("rk", "n").collect())
    finally:
        spark.conf.unset("shrinkfit.broadcastMaxBytes")
    assert got == plain
    assert "Union" not in plan and "BroadcastHashJoin" in plan


def test_two_effects_past_the_bound_read_the_rows_once(spark, tmp_path):
    _skewed(spark).write.parquet(str(tmp_path / "rows"))
    big = spark.read.parquet(str(tmp_path / "rows"))
    sides = [big.groupBy(k).count().withColumnRenamed("count", f"n_{k}") for k in ("userId", "movieId")]
    for i, side in enumerate(sides):
        side.write.parquet(str(tmp_path / f"side{i}"))
    spark.conf.set("shrinkfit.broadcastMaxBytes", "400")
    try:
        out = big
        for i, k in enumerate(("userId", "movieId")):
            out = lookup_join(out, spark.read.parquet(str(tmp_path / f"side{i}")), [k], weight_col=f"n_{k}")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        rows = out.count()
    finally:
        spark.conf.unset("shrinkfit.broadcastMaxBytes")
    # rk is in one scanned relation only.
    assert sum("Relation" in line and "rk#" in line for line in plan.splitlines()) == 1
    assert rows == big.count()


def test_fit_and_predict_without_broadcast_equal_default(spark):
    tr = _skewed(spark)
    a = fit_effects(tr, 2.0, name="sk-a")
    pa = {r["rk"]: r["pred"] for r in predict(a, tr).collect()}
    spark.conf.set("shrinkfit.broadcastMaxBytes", "400")
    try:
        b = fit_effects(tr, 2.0, name="sk-b")
        pb = {r["rk"]: r["pred"] for r in predict(b, tr).collect()}
    finally:
        spark.conf.unset("shrinkfit.broadcastMaxBytes")
    assert pa.keys() == pb.keys()
    assert all(pa[k] == pytest.approx(pb[k], abs=1e-12) for k in pa)


def test_guard_without_broadcast_equals_default(spark):
    from shrinkfit.operators import seen_key_guard, stratified_split
    s = stratified_split(_skewed(spark), 0.9, seed=2)
    want = sorted(tuple(r) for r in seen_key_guard(s).select("rk", "is_test", "moved_to_train").collect())
    spark.conf.set("shrinkfit.broadcastMaxBytes", "400")
    try:
        got = sorted(tuple(r) for r in seen_key_guard(s).select("rk", "is_test", "moved_to_train").collect())
    finally:
        spark.conf.unset("shrinkfit.broadcastMaxBytes")
    assert got == want and any(r[2] for r in got)


def test_guard_joins_only_values_without_a_train_row(spark):
    """Keys past the bound, few of them without a train row: no shuffle of the rows."""
    from shrinkfit.operators import seen_key_guard
    rows = [(f"k{i}", i % 150, i % 7, i % 5 == 0) for i in range(1500)]
    rows += [("only test", 900, 1, True), ("both sides", 901, 1, True), ("train", 901, 2, False), ("null user", None, 3, True), ("new item", 5, 70, True)]
    df = spark.createDataFrame(rows, "rk string, userId long, movieId long, is_test boolean")
    spark.conf.set("shrinkfit.broadcastMaxBytes", "2000")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = seen_key_guard(df)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r["rk"]: (r["is_test"], r["moved_to_train"]) for r in out.collect()}
    finally:
        spark.conf.unset("shrinkfit.broadcastMaxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    seen_users = {u for _, u, _, test in rows if not test}
    seen_items = {m for _, _, m, test in rows if not test}
    want = {k: (test and u in seen_users and m in seen_items, test and not (u in seen_users and m in seen_items)) for k, u, m, test in rows}
    assert got == want
    assert [k for k, v in got.items() if v[1] and not k.startswith("k")] == ["only test", "null user", "new item"]


def test_cut_counts_are_hashed_not_sorted(spark):
    """A cut whose bracket misses is found over all hashes by counts alone, with the strings of one bucket looked at."""
    from pyspark.sql import functions as F

    from shrinkfit.operators import split
    rows = spark.range(20000).select((F.col("id") % 3).cast("int").alias("stratum"), F.when(F.col("id") % 5 == 0, F.lit("a" * 32)).otherwise(F.md5(F.col("id").cast("string"))).alias("o"))
    held = {s: sorted(r["o"] for r in rows.where(F.col("stratum") == s).collect()) for s in range(3)}
    frame, plans = type(rows), []
    collect = frame.collect
    frame.collect = lambda self: (plans.append(self._jdf.queryExecution().executedPlan().toString()), collect(self))[1]
    try:
        for limit in (50, 50_000):
            need = {0: 1, 1: 4800, 2: len(held[2])}
            need[1] = held[1].index("a" * 32) + 7
            got = split.cut_values(rows, dict(need), limit)
            want = {s: (at := held[s][k - 1], k - sum(v < at for v in held[s]), held[s].count(at)) for s, k in need.items()}
            assert got == want
    finally:
        frame.collect = collect
    assert plans and "SortAggregate" not in plans[0]
