"""Column functions on hand-made rows (FIXTURES §3, traps T5-T9, T16)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shrinkfit.functions import (genre_count, indicator_columns, lambda_values, rating_date_parts,
                                 release_year, sanitize_genre)
from shrinkfit.operators import explode_genres, genre_indicators, genre_vocabulary, regroup_first_sum


@pytest.mark.parametrize("title,year", [
    ("The Long Crossing (also: Crossing) (1977)", 1977),
    ("No year", None),
    ("X (foo)", None),
    ("A (b (c)) (1999)", 1999),
    ("Z ( 1980 )", 1980),
    ("Y (1977.5)", None),
    (None, None),
])
def test_release_year(spark, title, year):
    df = spark.createDataFrame([(title,)], "title string")
    assert df.select(release_year("title").alias("y")).first()["y"] == year


def test_sunday_monday_parts(spark):
    df = spark.createDataFrame([(788918400,), (789004800,)], "ts long")
    rows = df.select(*[c.alias(n) for n, c in rating_date_parts("ts").items()]).collect()
    assert (rows[0]["rating_day_of_week"], rows[0]["rating_week_of_year"]) == (0, 0)
    assert (rows[1]["rating_day_of_week"], rows[1]["rating_week_of_year"]) == (1, 1)
    assert rows[0]["rating_year"] == 1995 and rows[0]["rating_month"] == 1


def test_week_and_weekday_match_strftime_every_day(spark):
    """%W and %w against Python's strftime for every day 1970-2035."""
    start, end = dt.date(1970, 1, 1), dt.date(2035, 12, 31)
    n = (end - start).days + 1
    df = spark.range(n).select((F.col("id") * 86400 + 3600).alias("ts"))
    parts = rating_date_parts("ts")
    got = {r["ts"]: (r["w"], r["W"]) for r in df.select(
        "ts", parts["rating_day_of_week"].alias("w"), parts["rating_week_of_year"].alias("W")).collect()}
    for i in range(n):
        d = start + dt.timedelta(days=i)
        assert got[i * 86400 + 3600] == (int(d.strftime("%w")), int(d.strftime("%W"))), d


def test_indicators_repeat_and_unseen(spark):
    df = spark.createDataFrame([
        (1, "Comedy|Comedy"), (2, '"Great"|(no genres listed)'), (3, "Newgenre|Drama"), (4, ""), (5, None),
    ], "id int, genres string")
    out = {r["id"]: r for r in genre_indicators(df, ["Comedy", "Drama"]).collect()}
    assert out[1]["genres_Comedy"] == 2            # T7: a repeated token counts twice
    assert out[3]["genres_Drama"] == 1 and out[3]["genres_Comedy"] == 0   # unseen token ignored (T8)
    assert out[4]["genres_Comedy"] == 0 and out[5]["genres_Drama"] == 0


def test_explode_keeps_empty_and_null(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "a|b")], "id int, genres string")
    rows = explode_genres(df).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in rows} == {1: 1, 2: 1, 3: 2}


def test_vocabulary_drops_marker_and_sanitises(spark):
    df = spark.createDataFrame([("Sci-Fi|Film-Noir",), ("(no genres listed)",), ("Drama",)], "genres string")
    vocab = genre_vocabulary(df)
    assert vocab == ["Drama", "Film-Noir", "Sci-Fi"]
    assert indicator_columns(vocab)["Sci-Fi"] == "genres_Sci_Fi"
    assert sanitize_genre("T-SMALL") == "T_SMALL"


def test_case_insensitive_collision_fails():
    with pytest.raises(ValueError):
        indicator_columns(["Small", "small"])


def test_regroup_equals_indicators(spark):
    df = spark.createDataFrame([("r1", 5.0, "a|b|a"), ("r2", 3.0, "b"), ("r3", 1.0, None)],
                               "rk string, rating double, genres string")
    vocab = ["a", "b"]
    a = sorted(tuple(r) for r in genre_indicators(df, vocab).select("rk", "rating", "genres_a", "genres_b").collect())
    b = sorted(tuple(r) for r in regroup_first_sum(df, "rk", vocab).select("rk", "rating", "genres_a", "genres_b").collect())
    assert a == b


def test_genre_count_expression(spark):
    df = spark.createDataFrame([("x|y|x",)], "genres string")
    assert df.select(genre_count("genres", "x").alias("c")).first()["c"] == 2


def test_lambda_values():
    lams = lambda_values()
    assert len(lams) == 41 and lams[0] == 0.0 and lams[-1] == 10.0 and lams[1] == 0.25


def test_select_prefix_and_row_ids(spark):
    from shrinkfit.operators.features import select_prefix, with_row_id
    df = spark.createDataFrame([(5.0, 1, 0, "x")] * 3, "rating double, genres_a int, genres_b int, title string")
    assert select_prefix(df, "genres_", also=["rating"]).columns == ["rating", "genres_a", "genres_b"]
    ids = [r["rowID"] for r in with_row_id(df.repartition(2)).collect()]
    assert len(set(ids)) == 3     # identical rows still get distinct ids
