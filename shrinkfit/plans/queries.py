"""Registered queries: one per operator / reference step.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
tables of that folder. Doubles are rounded to 6 decimals (``+ 0.0`` turns
``-0.0`` into ``0.0``) so the DuckDB oracle in ``oracle.py`` can be compared
by value hash despite different summation orders.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import release_year
from ..functions.sql import register_functions, register_model, scoring_sql
from ..operators.correlate import correlation_matrix
from ..operators.effects import predict
from ..operators.evaluate import (ablation, best_lambda, fit_candidates, model_sequence, rmse, with_drop_pct)
from ..operators.features import (explode_genres, genre_indicators, genre_vocabulary,
                                  dense_row_id, genre_vocabulary_df, head, regroup_first_sum,
                                  select_prefix, with_row_id)
from ..operators.joins import natural_anti_join, semi_join_keys
from ..operators.sparse import exclude_correlated, sparse_correlated_pairs
from ..operators.split import quantile_breaks, seen_key_guard, split_share, stratified_split, stratum_expr
from ..session import checkpoint_dir, configure, materialize
from ..sources.readers import MOVIES_SCHEMA, count_malformed, read_csv, read_delimited, write_csv, write_delimited
from ..sources.tables import load_files, movielens, movies_view, ratings_view
from .experiment import DATE_CANDIDATES, Experiment, experiment

DIGITS = 6
FIXED_LAMBDA = 2.5        # Model 7 at a fixed, given λ
GUARD_P = 0.9             # split share where the seen-key guard really fires
PAIR_THRESHOLD = 0.1      # |r| cut for correlated genre pairs on the fixture
MALFORMED_ABOVE = 4.5     # ratings written as malformed lines
PRICE_PROBS = (0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0)
HEAD_ROWS = 100           # the reference keeps the first 100 rows as a sample

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = [(F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


# ---- sources / features ---------------------------------------------------

def q_ratings_enriched(spark, sf_dir):
    return rounded(movielens(spark, sf_dir))


def q_release_year(spark, sf_dir):
    return movies_view(spark, sf_dir).select("movieId", "title", release_year("title").alias("release_year"))


def q_rating_date_parts(spark, sf_dir):
    from ..functions.columns import rating_date_parts
    return ratings_view(spark, sf_dir).select("rk", "ts", *[c.alias(n) for n, c in rating_date_parts("ts").items()])


def q_feature_table(spark, sf_dir):
    return rounded(experiment(spark, sf_dir).features)


def _movielens(spark, sf_dir):
    """The enriched ratings as already written by the session's experiment."""
    return experiment(spark, sf_dir).features


def q_genre_explode(spark, sf_dir):
    return explode_genres(_movielens(spark, sf_dir).select("rk", "movieId", "genres"))


def q_genre_vocabulary(spark, sf_dir):
    return genre_vocabulary_df(_movielens(spark, sf_dir))


def q_genre_indicators(spark, sf_dir):
    ml = _movielens(spark, sf_dir).select("rk", "genres")
    return genre_indicators(ml, genre_vocabulary(ml))


def q_regroup_first_sum(spark, sf_dir):
    """The reference's explode/regroup recipe keyed by a surrogate row id."""
    ml = _movielens(spark, sf_dir).select("rk", "userId", "movieId", "rating", "genres")
    out = regroup_first_sum(with_row_id(ml, "_row"), "_row", genre_vocabulary(ml))
    return rounded(out.drop("_row"))


def q_delimited_roundtrip(spark, sf_dir):
    """Write the ratings as ``::`` text under the checkpoint folder, read it back typed."""
    configure(spark)
    path = os.path.join(checkpoint_dir(spark), "shrinkfit", f"ratings-dat-{uuid.uuid4().hex[:12]}")
    write_delimited(ratings_view(spark, sf_dir).select("userId", "movieId", "rating", "ts"), path)
    schema = T.StructType([T.StructField("userId", T.LongType()), T.StructField("movieId", T.LongType()),
                           T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])
    return rounded(read_delimited(spark, path, schema))


def _file(spark, name: str) -> str:
    configure(spark)
    return os.path.join(checkpoint_dir(spark), "shrinkfit", f"{name}-{uuid.uuid4().hex[:12]}")


def q_movies_roundtrip(spark, sf_dir):
    """The items as ``::`` text, read back typed."""
    path = _file(spark, "movies-dat")
    write_delimited(movies_view(spark, sf_dir), path)
    out = read_delimited(spark, path, MOVIES_SCHEMA)
    return out.withColumn("movieId", F.col("movieId").cast("long"))


def q_malformed_lines(spark, sf_dir):
    """Ratings as ``::`` text, those above ``MALFORMED_ABOVE`` with a user that is no number: rows and malformed ones."""
    path = _file(spark, "ratings-bad")
    user = F.when(F.col("rating") > MALFORMED_ABOVE, F.lit("?")).otherwise(F.col("userId").cast("string"))
    write_delimited(ratings_view(spark, sf_dir).select(user.alias("userId"), "movieId", "rating", "ts"), path)
    schema = T.StructType([T.StructField("userId", T.LongType()), T.StructField("movieId", T.LongType()),
                           T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])
    return count_malformed(read_delimited(spark, path, schema, keep_corrupt=True))


def q_quarantined_lines(spark, sf_dir):
    """Both ``::`` inputs with bad ratings among them, as the workflow loads them: the rejected lines and why."""
    ratings, movies = _file(spark, "ratings-mixed"), _file(spark, "movies-mixed")
    user = F.when(F.col("rating") > MALFORMED_ABOVE, F.lit("?")).otherwise(F.col("userId").cast("string"))
    write_delimited(ratings_view(spark, sf_dir).select(user.alias("userId"), "movieId", "rating", "ts"), ratings)
    write_delimited(movies_view(spark, sf_dir), movies)
    return load_files(spark, ratings, movies).rejected


def q_sql_features(spark, sf_dir):
    """Release year, date parts and label counts by the registered SQL functions alone."""
    register_functions(configure(spark))
    movielens(spark, sf_dir).createOrReplaceTempView("shrinkfit_ratings")
    return spark.sql("SELECT rk, release_year(title) AS release_year, rating_year(ts) AS rating_year, rating_month(ts) AS rating_month, "
                     "rating_day_of_week(ts) AS rating_day_of_week, rating_week_of_year(ts) AS rating_week_of_year, "
                     "label_count(genres) AS n_labels FROM shrinkfit_ratings")


def q_sql_predictions(spark, sf_dir):
    """Scoring at the fixed λ as one SQL statement over registered views."""
    e = experiment(spark, sf_dir)
    model = e.fit_part("edx_train", FIXED_LAMBDA, "model-sql")
    register_model(spark, model, "shrinkfit_model")
    e.edx_test.createOrReplaceTempView("shrinkfit_test")
    return rounded(spark.sql(scoring_sql(model, "shrinkfit_test", "shrinkfit_model")).select("rk", "userId", "movieId", "rating", "pred"))


def q_csv_roundtrip(spark, sf_dir):
    """The wide indicator table as header CSV, read back with an inferred schema (S3)."""
    ml = _movielens(spark, sf_dir).select("rk", "movieId", "rating", "genres")
    path = _file(spark, "indicators-csv")
    write_csv(genre_indicators(ml, genre_vocabulary(ml)), path)
    out = read_csv(spark, path)
    return rounded(out.withColumn("movieId", F.col("movieId").cast("long")))


def q_head_sample(spark, sf_dir):
    e = experiment(spark, sf_dir)
    return rounded(head(e.edx.select("rk", "userId", "movieId", "rating", "title", "genres"),
                        HEAD_ROWS, ["rk"]))


# ---- split / guard ------------------------------------------------------------

def q_stratified_split(spark, sf_dir):
    e = experiment(spark, sf_dir)
    return stratified_split(e.features.select("rk", "rating"), 0.1, 1, keep_stratum=True)


def q_guarded_train_test(spark, sf_dir):
    e = experiment(spark, sf_dir)
    s = stratified_split(e.features.select("rk", "userId", "movieId", "rating"), GUARD_P, 1)
    return seen_key_guard(s).select("rk", "is_test", "moved_to_train")


def q_seen_key_semi(spark, sf_dir):
    e = experiment(spark, sf_dir)
    s = stratified_split(e.features.select("rk", "userId", "movieId", "rating"), GUARD_P, 1)
    temp = s.where("is_test")
    train = s.where("NOT is_test")
    kept = semi_join_keys(temp, train, ["movieId", "userId"])
    return rounded(kept.select("rk", "userId", "movieId", "rating"))


def q_seen_key_removed(spark, sf_dir):
    e = experiment(spark, sf_dir)
    s = stratified_split(e.features.select("rk", "userId", "movieId", "rating"), GUARD_P, 1)
    temp = s.where("is_test").drop("is_test")
    train = s.where("NOT is_test")
    kept = semi_join_keys(temp, train, ["movieId", "userId"])
    return rounded(natural_anti_join(temp, kept).select("rk", "userId", "movieId", "rating"))


def q_reloaded_split(spark, sf_dir):
    """The holdout split as a later run finds it: stored by one experiment, reloaded by another one that computes nothing."""
    root = os.path.join(checkpoint_dir(configure(spark)), "shrinkfit", "store")
    Experiment(spark, sf_dir, store=root).holdout_split
    later = Experiment(spark, sf_dir, store=root)
    split = later.holdout_split
    if not all(c.reloaded for c in later.checkpoints.values()):
        raise RuntimeError("a stored step was computed again")
    return split.select("rk", "is_test", "moved_to_train")


def _prices(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_extendedprice").cast("double").alias("price"))


def q_price_quantiles(spark, sf_dir):
    """Exact quantiles of a continuous column, no sort of its values."""
    breaks = quantile_breaks(_prices(spark, sf_dir), "price", PRICE_PROBS)
    rows = spark.createDataFrame(list(zip(PRICE_PROBS, breaks)), "prob double, price double")
    return rounded(rows)


def q_price_strata(spark, sf_dir):
    """Rows, least and greatest price of each stratum that the quartiles cut."""
    prices = _prices(spark, sf_dir)
    stratum = stratum_expr("price", quantile_breaks(prices, "price"))
    return rounded(prices.groupBy(stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.min("price").alias("low"), F.max("price").alias("high")))


def q_split_share(spark, sf_dir):
    e = experiment(spark, sf_dir)
    a = split_share(e.holdout_split).withColumn("split", F.lit("holdout"))
    b = split_share(e.edx_split).withColumn("split", F.lit("edx_test"))
    return rounded(a.unionByName(b))


def q_edx_train_test(spark, sf_dir):
    e = experiment(spark, sf_dir)
    return (e.edx_train.select("rk", F.lit("edx_train").alias("part"))
            .unionByName(e.edx_test.select("rk", F.lit("edx_test").alias("part")))
            .unionByName(e.holdout.select("rk", F.lit("holdout").alias("part"))))


# ---- unregularised effects and Models 1-6 ---------------------------------------

def _effect(name: str) -> Query:
    def q(spark, sf_dir):
        return rounded(experiment(spark, sf_dir).model0.effect(name))
    q.__name__ = f"q_effect_{name}"
    return q


def q_genre_effects(spark, sf_dir):
    return rounded(experiment(spark, sf_dir).model0.genre_effects())


def q_model_sequence(spark, sf_dir):
    e = experiment(spark, sf_dir)
    return rounded(model_sequence(e.model0, e.edx_test, layout=e.layout("edx_test")))


def q_ablation_rating_date(spark, sf_dir):
    e = experiment(spark, sf_dir)
    return rounded(ablation(e.model0, e.edx_train, e.edx_test, list(DATE_CANDIDATES)))


# ---- regularisation ---------------------------------------------------------------

def q_model7_fixed_lambda(spark, sf_dir):
    e = experiment(spark, sf_dir)
    model = e.fit(e.edx_train, FIXED_LAMBDA, "model-fixed")
    return rounded(rmse(predict(model, e.edx_test)).select(
        F.lit(FIXED_LAMBDA).alias("lambda"), "rmse", "n", "n_unscored"))


def q_lambda_grid(spark, sf_dir):
    return rounded(experiment(spark, sf_dir).grid)


def q_best_lambda(spark, sf_dir):
    return rounded(best_lambda(experiment(spark, sf_dir).grid))


def q_model7_predictions(spark, sf_dir):
    e = experiment(spark, sf_dir)
    return rounded(e.score(e.model7, "edx_test").select("rk", "userId", "movieId", "rating", "pred"))


def q_copartitioned_predictions(spark, sf_dir):
    """Fit and scoring at the fixed λ with both splits laid out by user."""
    e = experiment(spark, sf_dir).laid_out
    model = e.fit_part("edx_train", FIXED_LAMBDA, "model-laid-out")
    return rounded(e.score(model, "edx_test").select("rk", "userId", "movieId", "rating", "pred"))


def q_leaderboard(spark, sf_dir):
    e = experiment(spark, sf_dir)
    seq = model_sequence(e.model0, e.edx_test, layout=e.layout("edx_test"))
    m7 = rmse(e.score(e.model7, "edx_test")).select(
        F.lit(7).alias("seq"), F.lit("Model 7: regularised Model 6").alias("method"), "rmse")
    return rounded(with_drop_pct(seq.unionByName(m7)))


def q_final_holdout_rmse(spark, sf_dir):
    e = experiment(spark, sf_dir)
    out = rmse(e.score(e.final_model, "holdout"))
    return rounded(out.select(F.lit(e.best[0]).alias("lambda"), "rmse", "n", "n_unscored"))


def q_final_holdout_rmse_ref_intercept(spark, sf_dir):
    """Effects fitted on edx, intercept from edx_train: the reference's final number."""
    e = experiment(spark, sf_dir)
    out = rmse(e.score(e.final_model, "holdout", intercept=e.mu_train))
    return rounded(out.select(F.lit(e.best[0]).alias("lambda"), "rmse", "n", "n_unscored"))


# ---- correlation ---------------------------------------------------------------------

ID_COLS = ["rating", "userId", "movieId", "release_year"]
DATE_COLS = ["rating", "rating_year", "rating_month", "rating_day_of_week", "rating_week_of_year"]


def q_corr_ids(spark, sf_dir):
    return rounded(correlation_matrix(experiment(spark, sf_dir).edx, ID_COLS))


def q_corr_date_parts(spark, sf_dir):
    return rounded(correlation_matrix(experiment(spark, sf_dir).edx_train, DATE_COLS))


def _genre_frame(e):
    """(rating, genre string) cells with their number, one indicator per genre."""
    cells = e.edx_train.groupBy("rating", "genres").agg(F.count(F.lit(1)).alias("_n"))
    ind = materialize(genre_indicators(cells, e.vocabulary), "genre-cells")
    return ind, ["rating"] + [c for c in ind.columns if c.startswith("genres_")]


def q_corr_genres(spark, sf_dir):
    ind, cols = _genre_frame(experiment(spark, sf_dir))
    return rounded(correlation_matrix(ind, cols, weight="_n"))


def _genre_pairs(e) -> DataFrame:
    """(a, b, r) of genres and the rating, from sparse counts over edx_train; written once for an experiment."""
    if e.pairs is None:
        e.pairs = materialize(sparse_correlated_pairs(e.edx_train.select("rating", "genres"), PAIR_THRESHOLD), "genre-pairs")
    return e.pairs


def q_correlated_pairs(spark, sf_dir):
    def column(c):
        return F.when(F.col(c) == "rating", F.col(c)).otherwise(F.concat(F.lit("genres_"), F.regexp_replace(c, "[^A-Za-z0-9]", "_")))
    return rounded(_genre_pairs(experiment(spark, sf_dir)).select(column("a").alias("col_a"), column("b").alias("col_b"), "r"))


def _excluded_by_correlation(e) -> DataFrame:
    return exclude_correlated(_genre_pairs(e).where("a <> 'rating'"))


def q_excluded_genres(spark, sf_dir):
    """Genres to leave out so that no correlated pair of genres is left."""
    return rounded(_excluded_by_correlation(experiment(spark, sf_dir)).withColumnRenamed("label", "genre"))


def q_model7_auto_excluded(spark, sf_dir):
    """The fixed-λ model without the genres that the correlations exclude (a part of the vocabulary, which is on the driver)."""
    e = experiment(spark, sf_dir)
    e = e.excluding(tuple(sorted(r["label"] for r in _excluded_by_correlation(e).collect())))
    model = e.fit_part("edx_train", FIXED_LAMBDA, "model-auto-excluded")
    return rounded(rmse(e.score(model, "edx_test")).select(F.lit(FIXED_LAMBDA).alias("lambda"), "rmse", "n", "n_unscored"))


# ---- genre exclusion (M9, M15), effects at a given lambda (M10), candidates, small operators -----

#: The first genre of each of the two pairs with the highest |r| on the fixture, and two more.
EXCLUDED = ("T-ECONOMY", "T-PROMO", "anvil", "red")


def _excluding(spark, sf_dir):
    return experiment(spark, sf_dir).excluding(EXCLUDED)


def q_genre_effects_excluded(spark, sf_dir):
    return rounded(_excluding(spark, sf_dir).model0.genre_effects())


def q_model_sequence_excluded(spark, sf_dir):
    e = _excluding(spark, sf_dir)
    return rounded(model_sequence(e.model0, e.edx_test))


def q_regularised_effects(spark, sf_dir):
    """Every effect table of the model at the fixed λ, in long form."""
    e = experiment(spark, sf_dir)
    model = e.fit(e.edx_train, FIXED_LAMBDA, "model-tables")
    tables = [(f.spec.name, f.spec.key, f.table.withColumnRenamed("b0", "b")) for f in model.effects]
    tables.append(("b_g", "genre", model.genre_effects().withColumnRenamed("b_g", "b")))
    return rounded(_long_effects(tables))


def _long_effects(tables) -> DataFrame:
    out = None
    for name, key, table in tables:
        part = table.select(F.lit(name).alias("effect"), F.col(key).cast("string").alias("key"), "b", "n")
        out = part if out is None else out.unionByName(part)
    return out


def q_candidate_effects(spark, sf_dir):
    """The candidate effect tables (year, month, week, weekday) on the Model 4 residual, in long form."""
    e = experiment(spark, sf_dir)
    fitted = fit_candidates(e.model0, e.edx_train, list(DATE_CANDIDATES), name="candidates")
    return rounded(_long_effects([(f.spec.name, f.spec.key, f.table.withColumnRenamed("b0", "b")) for f in fitted]))


def q_model7_excluded(spark, sf_dir):
    e = _excluding(spark, sf_dir)
    model = e.fit(e.edx_train, FIXED_LAMBDA, "model-excluded")
    return rounded(rmse(predict(model, e.edx_test)).select(F.lit(FIXED_LAMBDA).alias("lambda"), "rmse", "n", "n_unscored"))


def q_dense_row_id(spark, sf_dir):
    return dense_row_id(experiment(spark, sf_dir).features.select("rk"), ["rk"], "row_id")


def q_prefix_columns(spark, sf_dir):
    return select_prefix(experiment(spark, sf_dir).features, "rating_", also=["rk"])


QUERIES: dict[str, Query] = {
    "ratings_enriched": q_ratings_enriched,
    "release_year": q_release_year,
    "rating_date_parts": q_rating_date_parts,
    "feature_table": q_feature_table,
    "genre_explode": q_genre_explode,
    "genre_vocabulary": q_genre_vocabulary,
    "genre_indicators": q_genre_indicators,
    "regroup_first_sum": q_regroup_first_sum,
    "delimited_roundtrip": q_delimited_roundtrip,
    "head_sample": q_head_sample,
    "stratified_split": q_stratified_split,
    "guarded_train_test": q_guarded_train_test,
    "seen_key_semi": q_seen_key_semi,
    "seen_key_removed": q_seen_key_removed,
    "reloaded_split": q_reloaded_split,
    "split_share": q_split_share,
    "price_quantiles": q_price_quantiles,
    "price_strata": q_price_strata,
    "edx_train_test": q_edx_train_test,
    "movie_effect": _effect("b_i"),
    "user_effect": _effect("b_u"),
    "release_year_effect": _effect("b_ry"),
    "rating_year_effect": _effect("b_rat_y"),
    "rating_week_effect": _effect("b_rat_wy"),
    "genre_effects": q_genre_effects,
    "model_sequence": q_model_sequence,
    "ablation_rating_date": q_ablation_rating_date,
    "model7_fixed_lambda": q_model7_fixed_lambda,
    "lambda_grid": q_lambda_grid,
    "best_lambda": q_best_lambda,
    "model7_predictions": q_model7_predictions,
    "copartitioned_predictions": q_copartitioned_predictions,
    "leaderboard": q_leaderboard,
    "final_holdout_rmse": q_final_holdout_rmse,
    "final_holdout_rmse_ref_intercept": q_final_holdout_rmse_ref_intercept,
    "corr_ids": q_corr_ids,
    "corr_date_parts": q_corr_date_parts,
    "corr_genres": q_corr_genres,
    "correlated_pairs": q_correlated_pairs,
    "genre_effects_excluded": q_genre_effects_excluded,
    "model_sequence_excluded": q_model_sequence_excluded,
    "model7_excluded": q_model7_excluded,
    "dense_row_id": q_dense_row_id,
    "prefix_columns": q_prefix_columns,
    "movies_roundtrip": q_movies_roundtrip,
    "malformed_lines": q_malformed_lines,
    "quarantined_lines": q_quarantined_lines,
    "sql_features": q_sql_features,
    "sql_predictions": q_sql_predictions,
    "excluded_genres": q_excluded_genres,
    "model7_auto_excluded": q_model7_auto_excluded,
    "csv_roundtrip": q_csv_roundtrip,
    "regularised_effects": q_regularised_effects,
    "candidate_effects": q_candidate_effects,
}
