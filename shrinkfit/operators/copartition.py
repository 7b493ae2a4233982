"""Co-partitioned effect joins (J2, M11): tables laid out by one key, so that joins on it need no shuffle.

A fit and every later scoring join ratings to the same high-cardinality key
(users). Past the broadcast bound each such join shuffles all ratings again.
``lay_out`` pays that shuffle once: rows go to a table bucketed by the key,
effect tables are bucketed alike, and joins and group-bys on the key then read
bucket by bucket without an Exchange.

Buckets can't be split at run time, so hot keys must not be in them: keys that
hold more than a quarter of a bucket's even share, and NULL, stay in a plain
table beside (``rest``), whose joins broadcast just those keys' effects. There
are at most 4 · buckets hot keys, whatever the data. Equality on the bucketed
side is ``=``: a null-safe comparison would hash another expression than the
buckets' and bring the Exchange back; NULL keys are all in ``rest``.

An empty table gives empty parts. Column names starting with ``_lk_`` are reserved.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize, register_written
from .joins import lookup_join


@dataclass
class Bucketed:
    """A table bucketed by ``key``, stored under the checkpoint folder."""

    name: str
    path: str
    df: DataFrame

    def drop(self) -> None:
        """Forget the catalog entry; the folder goes with ``delete_written``."""
        self.df.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


@dataclass
class Layout:
    key: str
    buckets: int
    cold: Bucketed       # rows of all other keys
    rest: DataFrame      # rows of hot keys and of NULL
    hot: DataFrame       # the hot keys and NULL, at most 4 · buckets + 1 rows

    @property
    def parts(self) -> list[DataFrame]:
        return [self.cold.df, self.rest]

    @property
    def df(self) -> DataFrame:
        return self.cold.df.unionByName(self.rest)


@dataclass
class AlignedTable:
    """One row per key, bucketed like layouts of as many buckets."""

    bucketed: Bucketed
    rows: int
    buckets: int


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str) -> Bucketed:
    """One file per bucket: rows are dealt by the hash that the buckets use."""
    spark = df.sparkSession
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex[:12]}"
    path = os.path.join(checkpoint_dir(spark), "shrinkfit", table)
    register_written(spark, path)
    (df.repartition(buckets, key).write.format("parquet").option("path", path)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return Bucketed(table, path, spark.table(table))


def hot_keys(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Keys with more than a quarter of a bucket's even share of the rows, and NULL if it occurs; written."""
    sizes = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), "key-sizes")
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    most = max(1, total // (4 * buckets))
    return materialize(sizes.where((F.col("_n") > most) | F.col(key).isNull()).select(key), "hot-keys")


def lay_out(df: DataFrame, key: str, buckets: int | None = None, name: str = "layout", sizes_of: DataFrame | None = None) -> Layout:
    """Write ``df`` bucketed by ``key``, hot keys apart. ``df`` is read twice (sizes, rows), and again where a key is hot;
    ``sizes_of`` is a cheaper frame of as many rows per key, to take the sizes from."""
    buckets = buckets or default_buckets(df.sparkSession)
    hot = hot_keys(df if sizes_of is None else sizes_of, key, buckets)
    if hot.isEmpty():
        return Layout(key, buckets, write_bucketed(df, key, buckets, f"{name}-cold"), materialize(df.where(F.lit(False)), f"{name}-rest"), hot)
    marked = lookup_join(df, hot.withColumn("_lk_hot", F.lit(True)), [key], "left")
    is_hot = F.coalesce(F.col("_lk_hot"), F.lit(False))
    cold = write_bucketed(marked.where(~is_hot).drop("_lk_hot"), key, buckets, f"{name}-cold")
    rest = materialize(marked.where(is_hot).drop("_lk_hot"), f"{name}-rest")
    return Layout(key, buckets, cold, rest, hot)


def align(table: DataFrame, key: str, buckets: int, name: str = "effect") -> AlignedTable:
    """A table with a row per key, bucketed like layouts of ``buckets`` buckets.

    The NULL row is kept (its bucket is one row longer) and is matched only in ``rest``.
    """
    held = write_bucketed(table, key, buckets, name)
    return AlignedTable(held, held.df.count(), buckets)


def join_parts(parts: list[DataFrame], layout: Layout, table: AlignedTable, columns: dict[str, str]) -> list[DataFrame]:
    """Left lookup join of a layout's two parts (or frames derived from them row by row) with an aligned table.

    ``columns`` names the table's columns to take and what to call them.
    """
    if table.buckets != layout.buckets:
        raise ValueError(f"{table.buckets} buckets against the layout's {layout.buckets}")
    cold, rest = parts
    side = table.bucketed.df.select(F.col(layout.key).alias("_lk_key"), *[F.col(c).alias(to) for c, to in columns.items()])
    joined = cold.join(side.hint("merge"), cold[layout.key] == side["_lk_key"], "left").drop("_lk_key")
    hot = layout.hot.withColumnRenamed(layout.key, "_lk_hot")
    few = side.join(F.broadcast(hot), side["_lk_key"].eqNullSafe(hot["_lk_hot"]), "left_semi").withColumnRenamed("_lk_key", layout.key)
    return [joined, lookup_join(rest, few, [layout.key], "left")]


def group_parts(parts: list[DataFrame], key: str, *aggs) -> DataFrame:
    """Group sums by the layout's key: no Exchange over the cold part; the parts share no key."""
    cold, rest = [p.groupBy(key).agg(*aggs) for p in parts]
    return cold.unionByName(rest)
