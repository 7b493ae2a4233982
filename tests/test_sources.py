"""Readers/sinks (S1-S4) and the ratings view over the driver's tables."""

import pytest
from pyspark.sql import types as T

from shrinkfit.sources import (MOVIES_SCHEMA, RATINGS_SCHEMA, count_malformed, movielens, movies_view,
                               ratings_view, read_csv, read_delimited, write_delimited, write_parquet)


def test_read_delimited_quotes_and_bad_ids(spark, tmp_path):
    p = tmp_path / "movies.dat"
    p.write_text('1::Toy Story (1995)::Adventure|Animation\n'
                 '2::"Great" Movie, The (2000)::(no genres listed)\n'
                 'x::b::c\n')
    df = read_delimited(spark, str(p), MOVIES_SCHEMA)
    rows = df.orderBy("title").collect()
    assert [r["movieId"] for r in rows] == [2, 1, None]
    assert rows[0]["title"] == '"Great" Movie, The (2000)'      # quotes kept
    counts = count_malformed(df).first()
    assert (counts["n_rows"], counts["n_malformed"]) == (3, 1)


def test_read_delimited_ratings_types(spark, tmp_path):
    p = tmp_path / "ratings.dat"
    p.write_text("1::122::5::838985046\n1::185::4.5::838983525\n")
    df = read_delimited(spark, str(p), RATINGS_SCHEMA)
    assert df.schema == RATINGS_SCHEMA
    assert [r["rating"] for r in df.orderBy("movieId").collect()] == [5.0, 4.5]


def test_delimited_and_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "A (1999)", "x|y"), (2, "B", None)], "movieId int, title string, genres string")
    write_delimited(df, str(tmp_path / "d"))
    back = read_delimited(spark, str(tmp_path / "d"), MOVIES_SCHEMA)
    assert sorted(r["title"] for r in back.collect()) == ["A (1999)", "B"]
    df.write.option("header", "true").csv(str(tmp_path / "c"))
    inferred = read_csv(spark, str(tmp_path / "c"))
    assert dict(inferred.dtypes)["movieId"] == "int"
    typed = read_csv(spark, str(tmp_path / "c"), MOVIES_SCHEMA)
    assert typed.count() == 2
    write_parquet(df, str(tmp_path / "p"), partition_by=["movieId"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_ratings_view(spark, small_dir):
    r = ratings_view(spark, small_dir)
    assert r.columns == ["rk", "userId", "movieId", "rating", "ts"]
    stats = r.selectExpr("count(*) n", "min(rating) lo", "max(rating) hi").first()
    assert stats["n"] == spark.read.parquet(f"{small_dir}/lineitem.parquet").count() > 0   # one rating per line
    assert 0.5 <= stats["lo"] and stats["hi"] <= 5.0
    m = movies_view(spark, small_dir)
    assert m.where("genres = '(no genres listed)'").count() > 0
    ml = movielens(spark, small_dir)
    assert ml.count() == stats["n"] and ml.where("title IS NULL").count() == 0


def test_scan_prunes_columns(spark, small_dir):
    plan = ratings_view(spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan


def test_schema_constants():
    assert [f.name for f in RATINGS_SCHEMA.fields] == ["userId", "movieId", "rating", "timestamp"]
    assert isinstance(MOVIES_SCHEMA["title"].dataType, T.StringType)


def test_enrich_rejects_repeated_items_and_matches_null(spark):
    from shrinkfit.sources.tables import enrich

    ratings = spark.createDataFrame([("a", 1), ("b", None)], "rk string, movieId long")
    once = spark.createDataFrame([(1, "x"), (None, "n")], "movieId long, title string")
    assert {r.rk: r.title for r in enrich(ratings, once).collect()} == {"a": "x", "b": "n"}
    with pytest.raises(ValueError):
        enrich(ratings, once.unionByName(once))


def test_semi_join_keys_matches_null(spark):
    from shrinkfit.operators.joins import semi_join_keys

    df = spark.createDataFrame([(1, None), (2, 5), (3, None)], "a long, b long")
    seen = spark.createDataFrame([(1, None), (2, 6)], "a long, b long")
    assert [tuple(r) for r in semi_join_keys(df, seen, ["a", "b"]).collect()] == [(1, None)]


def test_dense_row_id(spark):
    from shrinkfit.operators.features import dense_row_id

    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(57)], "k string").repartition(5)
    got = sorted((r.k, r.rowID) for r in dense_row_id(df, ["k"]).collect())
    assert got == [(f"k{i:03d}", i + 1) for i in range(57)]


def test_delete_written_takes_only_what_this_application_wrote(spark):
    import os

    from shrinkfit.session import checkpoint_dir, delete_written, materialize, written
    kept, gone = (materialize(spark.range(5), name) for name in ("kept", "gone"))
    path = written(spark)[-1]
    delete_written(spark, [path, os.path.join(checkpoint_dir(spark), "shrinkfit")])
    assert path not in written(spark) and kept.count() == 5
    with pytest.raises(Exception):
        spark.read.parquet(path).count()


def test_items_past_the_bound_read_the_ratings_once(spark, tmp_path):
    """Given the items' weights, nothing but the join itself reads the ratings; hot items and null ones are matched."""
    from pyspark.sql import functions as F

    from shrinkfit.sources.tables import enrich
    rows = [(f"r{i}", None if i % 50 == 1 else 3 if i % 2 else i % 40) for i in range(800)]
    ratings = spark.createDataFrame(rows, "rk string, movieId long")
    movies = spark.createDataFrame([(i, f"t{i}") for i in range(39)] + [(None, "none")], "movieId long, title string")
    weights = ratings.groupBy("movieId").agg(F.count(F.lit(1)).alias("_w"))

    want = {k: "none" if m is None else f"t{m}" if m < 39 else None for k, m in rows}
    spark.conf.set("shrinkfit.broadcastMaxBytes", "400")
    try:
        out = enrich(ratings, movies, weights=weights)
        assert out.columns == ["rk", "movieId", "title"]
        assert {r.rk: r.title for r in out.collect()} == want and out.count() == len(rows)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert sum("LogicalRDD" in line and "rk#" in line for line in plan.splitlines()) == 1
        assert "Aggregate" not in plan      # the weights were counted once, and written
        assert {r.rk: r.title for r in enrich(ratings, movies).collect()} == want
    finally:
        spark.conf.unset("shrinkfit.broadcastMaxBytes")


def test_partitioned_writes_do_not_sort_the_rows(spark):
    from pyspark.sql import functions as F

    from shrinkfit import session
    seen = []
    own = session.DataFrameWriter.parquet

    def spy(self, path, *rest, **kw):
        seen.append(self._spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))
        return own(self, path, *rest, **kw)

    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    session.DataFrameWriter.parquet = spy
    try:
        out = session.materialize(spark.range(1000).withColumn("side", F.col("id") % 3 == 0), "sides", partition_by=["side"])
    finally:
        session.DataFrameWriter.parquet = own
    assert int(seen[0]) >= 2 and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert out.where("side").count() == 334 and out.count() == 1000 and out.columns == ["id", "side"]
