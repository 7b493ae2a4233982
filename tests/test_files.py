"""Quarantine of bad lines, the file inputs, and the SQL functions."""

import pytest
from pyspark.sql import functions as F

from shrinkfit.functions import rating_date_parts, release_year
from shrinkfit.functions.sql import register_functions
from shrinkfit.plans.experiment import FEATURE_COLS, experiment_from_files
from shrinkfit.sources import MOVIES_SCHEMA, RATINGS_SCHEMA, load_files, quarantine

LINES = ["1::10::4.5::1000000000", "x::10::4::1000000001", "2::11::::1000000002", "3::12::NaN::1000000003", "4::13::2.0",
         "5::14::1::1000000004::9", "", "6::15::3::1000000005", "7::16::2::99999999999999999999", "::17::2::1000000006"]


def _write(path, lines):
    path.write_text("".join(f"{line}\n" for line in lines))
    return str(path)


def test_good_and_rejected_lines(spark, tmp_path):
    q = quarantine(spark, _write(tmp_path / "r.dat", LINES), RATINGS_SCHEMA)
    assert sorted(map(tuple, q.good.collect())) == [(1, 10, 4.5, 1000000000), (6, 15, 3.0, 1000000005)]
    assert {r.line: r.reason for r in q.rejected.collect()} == {
        LINES[1]: "userId", LINES[2]: "rating", LINES[3]: "rating", LINES[4]: "fields", LINES[5]: "fields", LINES[8]: "timestamp", LINES[9]: "userId"}
    assert (q.n_good, q.n_rejected) == (2, 7)
    assert [f.name for f in q.good.schema.fields] == RATINGS_SCHEMA.names


def test_empty_text_is_a_value_and_any_separator(spark, tmp_path):
    q = quarantine(spark, _write(tmp_path / "m.dat", ["1|*|A (1990)|*|", "2|*||*|x"]), MOVIES_SCHEMA, sep="|*|")
    assert sorted(map(tuple, q.good.collect())) == [(1, "A (1990)", ""), (2, "", "x")] and q.n_rejected == 0
    assert q.rejected.columns == ["line", "reason"] and q.rejected.collect() == []


@pytest.mark.parametrize("lines, counts", [([], (0, 0)), (["bad"], (0, 1))])
def test_no_good_line(spark, tmp_path, lines, counts):
    q = quarantine(spark, _write(tmp_path / "r.dat", lines), RATINGS_SCHEMA)
    assert q.good.collect() == [] and q.good.columns == RATINGS_SCHEMA.names
    assert (q.n_good, q.n_rejected) == counts and q.rejected.count() == counts[1]


def test_loaded_files_hold_no_null_id(spark, tmp_path):
    movies = _write(tmp_path / "m.dat", ["10::Ten (1999)::a|b", "15::Fifteen (2001)::b", "z::Bad (1)::c"])
    ratings = _write(tmp_path / "r.dat", LINES)
    got = load_files(spark, ratings, movies)
    assert got.counts == {"ratings": (2, 7), "movies": (2, 1)} and got.rejected.count() == 8
    assert {(r.userId, r.movieId, r.release_year) for r in got.df.collect()} == {(1, 10, 1999), (6, 15, 2001)}
    e = experiment_from_files(spark, ratings, movies)
    assert e.features.columns == FEATURE_COLS and e.features.where("userId IS NULL OR movieId IS NULL").isEmpty()
    assert e.line_counts == got.counts and e.rejected.where("source = 'movies'").count() == 1


def test_sql_functions_equal_the_columns(spark):
    register_functions(spark)
    titles = ["A (1990)", "B (x) (2001)", "C (1999) (y)", "D ( 12 )", "E ()", "none", "", None, "F (1.5)"]
    df = spark.createDataFrame([(i, t, g, s) for i, t in enumerate(titles) for g, s in [("a|b|a", 0), (None, 1230768000), ("", 1704067199), ("(no genres listed)", None)]],
                               "i long, title string, genres string, ts long")
    want = df.select("i", release_year("title").alias("release_year"), *[c.alias(n) for n, c in rating_date_parts("ts").items()])
    got = df.selectExpr("i", "release_year(title) AS release_year", "rating_year(ts) AS rating_year", "rating_month(ts) AS rating_month",
                        "rating_day_of_week(ts) AS rating_day_of_week", "rating_week_of_year(ts) AS rating_week_of_year")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert [r[0] for r in df.where("i = 0").orderBy(F.col("ts").asc_nulls_last()).selectExpr("label_count(genres)").collect()] == [3, 0, 0, 0]
    assert [r[0] for r in spark.sql("SELECT shrunk_mean(4D, 3, 1D) UNION ALL SELECT shrunk_mean(NULL, 0, 0D)").collect()] == [1.0, 0.0]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan
