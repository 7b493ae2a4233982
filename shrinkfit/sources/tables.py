"""Ratings and items derived from the driver's TPC-H-like tables.

``lineitem`` ⋈ ``orders`` gives one rating per line (user = customer, item =
part); ``part`` gives the item dimension with a title that carries a year in
its last parentheses and a ``|``-separated genre list.  Only the columns used
are read, so the Parquet scans are pruned.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure, materialize

#: The tables that ratings and items come from.
INPUT_TABLES = ("lineitem", "orders", "part")

# Fixed value: the reference's marker for an item without genres.
NO_GENRE = "(no genres listed)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an under-partitioned scan over the session's task slots.

    A single unsplittable file (one Parquet row group) is read by one task and
    every operator fused with the scan runs there too. Large inputs come as
    many files/row groups and are returned unchanged (no extra shuffle).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    current = df.rdd.getNumPartitions()
    return df.repartition(target) if current < target else df


def ratings_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rk, userId, movieId, rating, ts): one row per line item.

    ``rk`` is the natural key (order, line, part, supplier); ``rating`` maps
    quantity 1..50 to ten half-star levels; ``ts`` is epoch seconds (UTC).
    """
    configure(spark)
    # Rating and time before the join: they shuffle in fewer bytes than what they come from.
    li = spread(_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.ceil(F.col("l_quantity") / 5) / 2).alias("rating"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("ts")))
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = li.join(orders, li["l_orderkey"] == orders["o_orderkey"], "inner")
    return joined.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("rk"),
        F.col("o_custkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        "rating", "ts",
    )


def item_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(movieId, _w): line items of each item, from one column; which items are hot follows from it without the ratings' join."""
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("movieId")).agg(F.count(F.lit(1)).alias("_w"))


def movies_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(movieId, title, genres) from ``part``."""
    configure(spark)
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    title = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(") ("),
                     (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(")"))
    genres = F.when(F.col("p_size") == 50, F.lit(NO_GENRE)).otherwise(
        F.concat_ws("|", F.concat(F.lit("T-"), F.col("p_type")),
                    F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)),
                    F.split_part(F.col("p_name"), F.lit(" "), F.lit(2))))
    return part.select(F.col("p_partkey").alias("movieId"), title.alias("title"), genres.alias("genres"))


def movielens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings left-joined to the item dimension (J1): the reference's ``movielens``."""
    return enrich(ratings_view(spark, sf_dir), movies_view(spark, sf_dir), weights=item_weights(spark, sf_dir))


def enrich(ratings: DataFrame, movies: DataFrame, key: str = "movieId", weights: DataFrame | None = None) -> DataFrame:
    """Dimension left join (J1), null-safe; a repeated item key raises.

    One aggregate checks the item side and counts it. Past the broadcast bound the ratings' items are counted too
    (partial sums, written) and hot items are joined apart (``lookup_join``); ``weights`` (key, _w) are
    such counts from something cheaper than the ratings, which are then read by the join alone.
    """
    from ..operators.joins import can_broadcast, lookup_join

    items = movies.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("keys"), F.max("n").alias("most")).first()
    if (items["most"] or 0) > 1:
        raise ValueError(f"item key {key!r} is not unique")
    if can_broadcast(movies, items["keys"]):
        return lookup_join(ratings, movies, [key], "left", small_rows=items["keys"])
    if weights is None:
        weights = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("_w"))
    return lookup_join(ratings, movies, [key], "left", small_rows=items["keys"], weight_col="_w", weights=materialize(weights, "item-weights"))


@dataclass
class FileInput:
    """The reference's inputs as one frame, and what was rejected on the way."""

    df: DataFrame
    rejected: DataFrame   # source, line, reason
    counts: dict[str, tuple[int, int]]   # source -> (good, rejected)


def load_files(spark: SparkSession, ratings_path: str, movies_path: str, sep: str = "::") -> FileInput:
    """``ratings.dat`` ⋈ ``movies.dat`` (S1, S2, J1), bad lines quarantined, so that no NULL id reaches a fit.

    Same columns as ``movielens`` and ``release_year``, taken once per item: ``rk`` is
    ``userId-movieId-timestamp`` (one rating per user, item and second), ``ts`` the epoch seconds.
    """
    from ..functions.columns import release_year
    from .readers import MOVIES_SCHEMA, RATINGS_SCHEMA, quarantine

    configure(spark)
    read = {"ratings": quarantine(spark, ratings_path, RATINGS_SCHEMA, sep, "ratings"),
            "movies": quarantine(spark, movies_path, MOVIES_SCHEMA, sep, "movies")}
    ratings = spread(read["ratings"].good).select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in ("userId", "movieId", "timestamp")]).alias("rk"),
        "userId", "movieId", "rating", F.col("timestamp").alias("ts"))
    movies = read["movies"].good.withColumn("release_year", release_year("title"))
    rejected = [q.rejected.select(F.lit(name).alias("source"), "line", "reason") for name, q in read.items()]
    return FileInput(enrich(ratings, movies), rejected[0].unionByName(rejected[1]),
                     {name: (q.n_good, q.n_rejected) for name, q in read.items()})


def movielens_from_files(spark: SparkSession, ratings_path: str, movies_path: str, sep: str = "::") -> DataFrame:
    """The frame of ``load_files`` alone."""
    return load_files(spark, ratings_path, movies_path, sep).df
