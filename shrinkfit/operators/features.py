"""Feature operators: release year, date parts, genre vocabulary / indicators.

The reference explodes every rating by its genres, adds one column per genre
and regroups by a row id (its 54 GB peak).  Genres are a property of the
item, so the production path computes indicators with one array expression
per genre and never multiplies rows; ``regroup_first_sum`` keeps the
explode-and-regroup form for parity checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (genre_count, genre_tokens, indicator_columns, rating_date_parts,
                                 release_year)
from ..session import materialize
from ..sources.tables import NO_GENRE


def add_features(df: DataFrame, title_col: str = "title", ts_col: str = "ts") -> DataFrame:
    """Append release_year and the four date parts (P3/P4); narrow, no shuffle."""
    cols = {"release_year": release_year(title_col)}
    cols.update(rating_date_parts(ts_col))
    return df.withColumns(cols)


def explode_genres(df: DataFrame, genres_col: str = "genres", out: str = "genre") -> DataFrame:
    """One row per genre token (C4); ``''``/NULL keep one row."""
    return df.withColumn(out, F.explode_outer(genre_tokens(genres_col))).drop(genres_col)


def genre_vocabulary_df(df: DataFrame, genres_col: str = "genres") -> DataFrame:
    """Distinct genre tokens (A10) without the no-genre marker, with column names.

    Deduplicates genre *strings* first (partial aggregation: a handful of
    distinct lists even at billions of rows), then explodes that small set.
    """
    lists = df.select(genres_col).distinct()
    tokens = lists.select(F.explode(genre_tokens(genres_col)).alias("genre")).distinct()
    tokens = tokens.where((F.col("genre") != F.lit(NO_GENRE)) & (F.col("genre") != F.lit("")))
    return tokens.withColumn(
        "column_name", F.concat(F.lit("genres_"), F.regexp_replace("genre", "[^A-Za-z0-9]", "_")))


def genre_vocabulary(df: DataFrame, genres_col: str = "genres") -> list[str]:
    """Sorted vocabulary on the driver: one column will be made for each token."""
    vocab = [r["genre"] for r in genre_vocabulary_df(df, genres_col).select("genre").orderBy("genre").collect()]
    indicator_columns(vocab)  # fails early on column-name collisions (T9)
    return vocab


def genre_indicators(df: DataFrame, vocabulary: list[str], genres_col: str = "genres",
                     drop_genres: bool = True) -> DataFrame:
    """One integer column per vocabulary genre (C5, P8, P13); unseen tokens ignored."""
    names = indicator_columns(vocabulary)
    out = df.withColumns({names[g]: genre_count(genres_col, g) for g in vocabulary})
    return out.drop(genres_col) if drop_genres else out


def regroup_first_sum(df: DataFrame, id_col: str, vocabulary: list[str],
                      genres_col: str = "genres") -> DataFrame:
    """The reference's recipe (A5): explode, 0/1 per token, regroup by row id.

    Constant columns are taken with ``any_value`` (they are equal within a
    row id) and indicators are summed, so a repeated token gives 2 (T7).
    Shuffles the exploded rows by ``id_col``; use ``genre_indicators`` instead.
    """
    names = indicator_columns(vocabulary)
    keep = [c for c in df.columns if c not in (id_col, genres_col)]
    exploded = df.withColumn("_g", F.explode_outer(genre_tokens(genres_col)))
    aggs = [F.any_value(c).alias(c) for c in keep]
    aggs += [F.sum(F.when(F.col("_g") == F.lit(g), 1).otherwise(0)).cast("int").alias(names[g])
             for g in vocabulary]
    return exploded.groupBy(id_col).agg(*aggs)


def with_row_id(df: DataFrame, name: str = "rowID") -> DataFrame:
    """Surrogate row id (P9): unique per row, no shuffle, no single-task window.

    Not consecutive like ``seq(1, nrow)`` — only uniqueness is needed to
    regroup exploded rows. Deterministic for a deterministic input order.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def dense_row_id(df: DataFrame, order_by: list[str], name: str = "rowID") -> DataFrame:
    """Row numbers 1..n in a given order (P9), without a window over all rows.

    A range sort deals the rows; each partition numbers its own, and the
    partitions' counts (a row each) give where it starts.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(df.repartitionByRange(parts, *order_by).withColumn("_part", F.spark_partition_id()), "row-id")
    counts = dealt.groupBy("_part").count().collect()
    starts, before = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        starts.append((r["_part"], before))
        before += r["count"]
    base = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _before long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order_by))
    return dealt.withColumn("_local", local).join(F.broadcast(base), "_part").withColumn(name, F.col("_before") + F.col("_local")).select(*df.columns, name)


def select_prefix(df: DataFrame, prefix: str, also: list[str] | None = None) -> DataFrame:
    """``select(also…, starts_with(prefix))``."""
    cols = list(also or []) + [c for c in df.columns if c.startswith(prefix)]
    return df.select(*cols)


def head(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """First ``n`` rows in an explicit order (S5/O1, T13): a top-k, not a full sort."""
    return df.orderBy(*order_by).limit(n)
