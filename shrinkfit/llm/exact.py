"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, in the shared folder. New documents come in
batches: a batch is reduced to one row per digest (a partial aggregate, so a text that a third of
the rows hold is one row per task before the shuffle), the digests that the index already holds go by a
sort-merge anti join - the index side is read by its buckets and not shuffled - and the rest is
appended. It has a bucket for each ``BUCKET`` digests of the first batches, which stays with it. What came first stays; the query deals the documents by falling doc_id, so that
the largest one stays.

Texts are equal when identical after lower-casing A-Z; the digest is SHA-256 of that text in UTF-8.
Nulls: a null text is empty; a null doc_id counts as smaller than any other, and stays only where all
ids of its text are null. Very long texts are hashed whole. Ties and repeated rows: rows with the same doc_id and text are
listed as often as they occur, with the same result. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import hot_split_join, keep_rows, scratch


def normalised(text: str):
    """Only A-Z are lower-cased; null is empty."""
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


#: Digests (about 80 bytes each) of a bucket when the index is made, and buckets at least.
BUCKET, LEAST = 1_000_000, 16


class DigestIndex:
    """(digest, keep_id), unique by digest; bucketed and sorted by digest under ``path``, for about ``expected`` digests if it is new."""

    def __init__(self, spark: SparkSession, path: str | None = None, expected: int = 0):
        self.spark = spark
        self.path = path or scratch(spark, "digest-index")
        # The number of buckets belongs to the files, so it lies beside them.
        told = f"{self.path}-buckets"
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{told}/_SUCCESS")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            spark.range(1).select(F.lit(max(LEAST, -(-expected // BUCKET))).alias("buckets")).coalesce(1).write.mode("overwrite").json(told)
        buckets = self.buckets = spark.read.schema("buckets int").json(told).first()[0]
        self.name = f"digest_index_{uuid.uuid4().hex[:12]}"
        # An entry in this session's catalog for the files at path, which may be there from an earlier session.
        spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of (digest, doc_id) that aren't there yet, each with its largest doc_id."""
        first = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
        new = first.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        new.repartition(self.buckets, "digest").write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name, format="parquet", path=self.path)
        self.spark.catalog.refreshTable(self.name)

    def close(self) -> None:
        """Forget the catalog entry; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A narrow written table: doc_id, digest, and raw, a hash of the text as it is."""
    return materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(F.encode(normalised(text), "UTF-8"), 256).alias("digest"), F.xxhash64(F.col(text)).alias("raw")), "digests")


def exact_groups(found: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """doc_id, digest, raw, keep_id, group_size, kept for each row of ``digests()``, added in batches of falling doc_id."""
    low, high, total = found.agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    low, high = (0, 0) if low is None else (low, high)
    step = (high - low) // batches + 1
    for k in reversed(range(batches)):
        start = low + k * step
        part = found.filter((F.col("doc_id") >= start) & (F.col("doc_id") < start + step))
        if k == 0:
            part = found.filter((F.col("doc_id") < start + step) | F.col("doc_id").isNull())
        index.add(part)
    sizes = found.groupBy("digest").agg(F.count("*").alias("group_size"))
    groups = materialize(index.table().join(sizes, "digest"), "exact-groups")
    return hot_split_join(found, groups, "digest", "group_size", total).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_query(docs: DataFrame) -> DataFrame:
    """op7: doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    found = digests(docs)
    rows = exact_groups(found, DigestIndex(docs.sparkSession, expected=found.count()))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; of repeated rows one stays."""
    found = digests(docs, doc_id=doc_id, text=text)
    index = DigestIndex(docs.sparkSession, expected=found.count())
    groups = materialize(exact_groups(found, index), "exact-kept")
    index.close()
    gone = groups.filter("not kept").select("doc_id", "raw").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("raw"))
    rest = keep_rows(rows, gone, ["doc_id", "raw"])
    # Rows that share doc_id and normalised text all carry kept; usually there are none.
    again = groups.filter("kept").groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    again = again.join(groups.filter("kept"), "digest").select("doc_id", "raw").distinct()
    n = again.count()
    if n:
        once = rows.join(again.withColumnsRenamed({"doc_id": "d", "raw": "r"}), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("raw").eqNullSafe(F.col("r")), "left_semi")
        once = once.withColumn("digest", F.sha2(F.encode(normalised(f"row.{text}"), "UTF-8"), 256)).dropDuplicates(["digest"])
        rest = keep_rows(rest, again, ["doc_id", "raw"], n).unionByName(once.drop("digest"))
    return rest.select("row.*")


#: DuckDB SQL for op7.
EXACT_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
