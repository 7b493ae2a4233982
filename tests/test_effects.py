"""Effect models: traps T1, T2, T12, T14, T15 and the algebraic properties of SURVEY §5."""

import math

import pytest
from pyspark.sql import functions as F

from shrinkfit.operators import (DEFAULT_CHAIN, EffectSpec, best_lambda, fit_effects, lambda_grid,
                                 load_model, model_sequence, predict, rmse, save_model)


def _train(spark, n=3000, seed=5):
    import random
    rnd = random.Random(seed)
    genres = ["a|b", "b", "c|a", "a|a", "(no genres listed)", "b|c"]
    rows = []
    for i in range(n):
        m = rnd.randrange(60)
        rows.append((f"k{i}", rnd.randrange(80), m, rnd.choice([0.5 * x for x in range(1, 11)]),
                     1950 + m % 7 if m % 11 else None, 1995 + rnd.randrange(6), rnd.randrange(54),
                     genres[m % len(genres)]))
    return spark.createDataFrame(rows, "rk string, userId long, movieId long, rating double, release_year int, "
                                       "rating_year int, rating_week_of_year int, genres string")


def test_lambda0_group_means_zero(spark):
    """After an effect with λ=0, the mean residual of every group of its key is 0."""
    tr = _train(spark)
    m = fit_effects(tr, 0.0, DEFAULT_CHAIN[:2], genres=False, name="t")
    scored = predict(m, tr).withColumn("res", F.col("rating") - F.col("pred"))
    worst = scored.groupBy("userId").agg(F.avg("res").alias("a")).agg(F.max(F.abs("a"))).first()[0]
    assert worst < 1e-9


def test_train_rmse_non_increasing(spark):
    tr = _train(spark)
    m = fit_effects(tr, 0.0, name="t")
    seq = [r["rmse"] for r in model_sequence(m, tr).orderBy("seq").collect()]
    assert all(b <= a + 1e-12 for a, b in zip(seq[:5], seq[1:5]))


def test_first_effect_shrinks_with_lambda(spark):
    tr = _train(spark)
    lams = [0.0, 1.0, 5.0]
    m = fit_effects(tr, lams, DEFAULT_CHAIN[:1], genres=False, name="t")
    for r in m.effects[0].table.collect():
        assert abs(r["b0"]) >= abs(r["b1"]) - 1e-15 >= abs(r["b2"]) - 2e-15


def test_grid_equals_single_fits(spark):
    tr = _train(spark, 1500)
    te = _train(spark, 600, seed=9).join(tr.select("movieId").distinct(), "movieId", "left_semi") \
        .join(tr.select("userId").distinct(), "userId", "left_semi")
    lams = [0.0, 2.5, 7.75]
    grid = {r["lambda"]: r["rmse"] for r in lambda_grid(tr, te, lams, chunk=2, parallel=2).collect()}
    for lam in lams:
        single = rmse(predict(fit_effects(tr, lam, name="s"), te)).first()["rmse"]
        assert grid[lam] == pytest.approx(single, abs=1e-12)


def test_cells_equal_rows(spark):
    """Fitting the low-cardinality tail on cells equals fitting it on rows."""
    tr = _train(spark, 1500)
    a = fit_effects(tr, 3.0, name="c", row_steps=2)
    b = fit_effects(tr, 3.0, name="r", row_steps=len(DEFAULT_CHAIN))
    for ea, eb in zip(a.effects, b.effects):
        k = ea.spec.key
        va = {r[k]: r["b0"] for r in ea.table.collect()}
        vb = {r[k]: r["b0"] for r in eb.table.collect()}
        assert va.keys() == vb.keys()
        assert all(va[x] == pytest.approx(vb[x], abs=1e-12) for x in va)
    ga = {r["genre"]: r["g0"] for r in a.genres.collect()}
    gb = {r["genre"]: r["g0"] for r in b.genres.collect()}
    assert ga == pytest.approx(gb, abs=1e-12)


def test_null_key_is_fitted_and_matched(spark):
    """dplyr matches NA to NA (T1): a NULL release_year has an effect and scores."""
    tr = _train(spark)
    m = fit_effects(tr, 0.0, name="t")
    eff = {r["release_year"]: r["b_ry"] for r in m.effect("b_ry").collect()}
    assert None in eff
    te = tr.where("release_year IS NULL").limit(5)
    assert predict(m, te).where("pred IS NULL").count() == 0


def test_strict_rmse_and_unscored(spark):
    tr = _train(spark)
    m = fit_effects(tr, 0.0, name="t")
    te = tr.limit(20).withColumn("rating_year", F.when(F.col("rk") == "k0", 1900).otherwise(F.col("rating_year")))
    out = rmse(predict(m, te)).first()
    assert out["rmse"] is None and out["n_unscored"] == 1 and out["rmse_scored"] is not None


def test_genre_membership_and_empty_group(spark):
    """Repeated token is not a member (T7); a genre with no rows gives 0 with n=0."""
    tr = _train(spark)
    for lam in (0.0, 2.0):
        m = fit_effects(tr, lam, vocabulary=["a", "b", "c", "zzz"], name="g")
        g = {r["genre"]: (r["b_g"], r["n"]) for r in m.genre_effects().collect()}
        assert g["zzz"] == (0.0, 0)
        n_a = tr.where("genres IN ('a|b', 'c|a')").count()   # 'a|a' is not a member
        assert g["a"][1] == n_a


def test_repeated_token_counts_twice_in_prediction(spark):
    tr = _train(spark)
    m = fit_effects(tr, 0.0, chain=(), vocabulary=["a"], name="g")
    ua = m.genre_effects().first()["b_g"]
    te = spark.createDataFrame([("x", 3.0, "a|a"), ("y", 3.0, "a"), ("z", 3.0, "Newgenre")],
                               "rk string, rating double, genres string")
    p = {r["rk"]: r["pred"] for r in predict(m, te).collect()}
    assert p["x"] == pytest.approx(m.mu + 2 * ua) and p["y"] == pytest.approx(m.mu + ua)
    assert p["z"] == pytest.approx(m.mu)


def test_intercept_override(spark):
    tr = _train(spark)
    m = fit_effects(tr, 0.0, DEFAULT_CHAIN[:1], genres=False, name="t")
    a = predict(m, tr.limit(3)).collect()
    b = predict(m, tr.limit(3), intercept=m.mu + 1.0).collect()
    assert [x["pred"] + 1.0 for x in a] == pytest.approx([x["pred"] for x in b])


def test_best_lambda_ties_and_null(spark):
    grid = spark.createDataFrame([(0.0, None), (0.25, 1.0), (0.5, 0.9), (0.75, 0.9)], "lambda double, rmse double")
    r = best_lambda(grid).first()
    assert (r["lambda"], r["rmse"]) == (0.5, 0.9)


def test_null_rating_rejected(spark):
    df = spark.createDataFrame([("a", 1, 1, None)], "rk string, userId long, movieId long, rating double")
    with pytest.raises(ValueError):
        fit_effects(df, 0.0, (EffectSpec("b_i", "movieId"),), genres=False)


def test_rmse_value(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "pred double, rating double")
    assert rmse(df).first()["rmse"] == pytest.approx(math.sqrt(0.5))


def test_save_load_roundtrip(spark, tmp_path):
    tr = _train(spark, 800)
    m = fit_effects(tr, [0.0, 3.0], name="sv")
    save_model(m, str(tmp_path / "model"))
    back = load_model(spark, str(tmp_path / "model"))
    assert back.mu == m.mu and back.lambdas == m.lambdas
    a = sorted(tuple(r) for r in predict(m, tr).select("rk", "pred0", "pred1").collect())
    b = sorted(tuple(r) for r in predict(back, tr).select("rk", "pred0", "pred1").collect())
    assert a == b


def test_ablation_equals_separate_candidate_fits(spark):
    from shrinkfit.operators import ablation, residuals
    from shrinkfit.operators.effects import fit_effect
    tr = _train(spark, 1500).withColumn("rating_month", (F.col("rating_week_of_year") % 12) + 1)
    te = tr.limit(400)
    m = fit_effects(tr, 0.0, name="ab")
    cands = [EffectSpec("b_rat_y", "rating_year"), EffectSpec("b_rat_m", "rating_month")]
    got = {r["candidate"]: r["rmse"] for r in ablation(m, tr, te, cands).collect()}
    resid = residuals(m.prefix(3), tr)
    base = predict(m.prefix(3), te)
    for c in cands:
        f = fit_effect(resid, c, [0.0], shared=True, name="ab-one")
        side = f.table.select(c.key, F.col("b0").alias("_c"))
        want = base.join(side, c.key, "left").select(
            F.sqrt(F.avg(F.pow(F.col("pred") + F.col("_c") - F.col("rating"), 2)))).first()[0]
        assert got[c.key] == pytest.approx(want, abs=1e-12)


def _written_by(run):
    """Result of ``run`` and the rows of each table that it wrote."""
    from shrinkfit.operators import effects

    written = {}
    own = effects.materialize

    def spy(df, name, *rest, **kw):
        out = own(df, name, *rest, **kw)
        written[name] = out.count()
        return out

    effects.materialize = spy
    try:
        return run(), written
    finally:
        effects.materialize = own


def test_tail_is_fitted_without_the_combinations_of_its_keys(spark):
    """Nothing written for the later effects is as long as the rows: sums per value and counts per pair of values alone."""
    import random
    rnd = random.Random(11)
    rows = [(rnd.randrange(5), rnd.randrange(7), rnd.choice([1.0, 2.5, 4.0]), 1950 + rnd.randrange(10), 1995 + rnd.randrange(6),
             rnd.randrange(20), rnd.choice(["a|b", "b", "c|a", None])) for _ in range(4000)]
    tr = spark.createDataFrame(rows, "userId long, movieId long, rating double, release_year int, rating_year int, rating_week_of_year int, genres string")
    for lams in (1.0, [0.0, 1.0, 3.0]):
        model, written = _written_by(lambda: fit_effects(tr, lams, name="tail"))
        combinations = tr.select("release_year", "rating_year", "rating_week_of_year", "genres").distinct().count()
        assert max(written.values()) < 600 < combinations
        rowwise = fit_effects(tr, 1.0, name="tail-rows", row_steps=len(DEFAULT_CHAIN))
        j = 0 if lams == 1.0 else 1
        for e in rowwise.effects:
            got = {r[0]: (r[1], r[2]) for r in model.effect(e.spec.name, j).collect()}
            want = {r[0]: (r[1], r[2]) for r in rowwise.effect(e.spec.name).collect()}
            assert got.keys() == want.keys()
            assert all(got[k][0] == pytest.approx(want[k][0], abs=1e-12) and got[k][1] == want[k][1] for k in want)
        assert {r.genre: r.b_g for r in model.genre_effects(j).collect()} == pytest.approx(
            {r.genre: r.b_g for r in rowwise.genre_effects().collect()}, abs=1e-12)


def test_grid_scoring_shuffles_two_numbers_of_the_first_effect(spark):
    """Past the broadcast bound no row carries a value of the first effect per λ into the second one's join."""
    tr = _train(spark, 1500)
    lams = [0.5 * j for j in range(12)]
    model = fit_effects(tr, lams, DEFAULT_CHAIN[:2], genres=True, vocabulary=["a"], name="two")
    spark.conf.set("shrinkfit.broadcastMaxBytes", "10")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = predict(model, tr)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("shrinkfit.broadcastMaxBytes")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join LeftOuter" in line]
    values = [i for i, line in enumerate(plan.splitlines()) if "_b_i11" in line]
    assert values == [] or max(values) < min(joins)


def test_statistics_hold_numbers_for_texts_and_serve_every_lambda(spark):
    """Rows laid out for the fits carry a number for each genre string (NULL too); one λ at a time equals the fit over rows."""
    from shrinkfit.operators.effects import grid_statistics, later_keys
    tr = _train(spark, 1200).withColumn("genres", F.when(F.col("movieId") % 6 != 0, F.col("genres")))
    stats = grid_statistics(tr, DEFAULT_CHAIN, name="codes", keys=later_keys(DEFAULT_CHAIN, True))
    assert stats.layout.df.schema["genres"].dataType.typeName() == "long"
    for lam in (0.0, 2.5):
        got, want = fit_effects(tr, lam, vocabulary=["a", "b"], name="codes-one", statistics=stats), fit_effects(tr, lam, vocabulary=["a", "b"], name="codes-rows")
        for e in want.effects:
            a, b = ({r[0]: (r[1], r[2]) for r in m.effect(e.spec.name).collect()} for m in (got, want))
            assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in b)
        a, b = ({r["genre"]: (r["b_g"], r["n"]) for r in m.genre_effects().collect()} for m in (got, want))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in b)
        a, b = ({r["rk"]: r["pred"] for r in predict(m, tr).collect()} for m in (got, want))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in b)


def test_experiment_past_the_bound_lays_training_rows_out_once(spark):
    """Model 6, the λ grid and Model 7 start from one written table of the training rows; the splits aren't laid out besides."""
    from shrinkfit.operators import copartition, effects
    from shrinkfit.plans import experiment
    rows = [(f"r{i}", i * 7 % 60, i * 11 % 45, (i * 13 % 9) / 2 + 0.5, 900000000 + i * 86400 * 3, f"t ({1960 + i * 11 % 45 % 9})", ["a|b", "b", "c|a", None][i * 11 % 45 % 4])
            for i in range(1500)]
    frame = spark.createDataFrame(rows, "rk string, userId long, movieId long, rating double, ts long, title string, genres string")
    laid, own = [], copartition.lay_out

    def counted(df, key, *rest, **kw):
        laid.append(kw.get("name"))
        return own(df, key, *rest, **kw)

    def run():
        e = experiment.Experiment(spark, "", source=frame, lambdas=[0.0, 2.5])
        boards = [r["rmse"] for r in e.grid.orderBy("lambda").collect()]
        return boards, {r["rk"]: r["pred"] for r in e.score(e.model7, "edx_test").collect()}, {r[0]: r[1] for r in e.model0.effect("b_u").collect()}, e.by_user

    plain = run()
    spark.conf.set("shrinkfit.broadcastMaxBytes", "400")
    effects.lay_out = experiment.lay_out = counted
    try:
        past = run()
    finally:
        effects.lay_out = experiment.lay_out = own
        spark.conf.unset("shrinkfit.broadcastMaxBytes")
    assert not plain[3] and past[3]
    assert laid == ["grid-edx_train-rows"]
    assert past[0] == pytest.approx(plain[0], abs=1e-12)
    assert past[1] == pytest.approx(plain[1], abs=1e-12) and past[2] == pytest.approx(plain[2], abs=1e-12)
