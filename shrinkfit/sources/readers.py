"""Readers and sinks: multi-character-delimited text, header CSV, Parquet.

The reference parses ``::`` separated text by splitting whole lines in memory;
here the CSV data source does it on executors with an explicit schema, so
parsing is split across files/blocks and bad values surface as NULLs that we
count instead of aborting the job.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize

# Fixed schemas of the two reference inputs (ratings.dat, movies.dat).
RATINGS_SCHEMA = T.StructType([
    T.StructField("userId", T.IntegerType()),
    T.StructField("movieId", T.IntegerType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("timestamp", T.LongType()),
])
MOVIES_SCHEMA = T.StructType([
    T.StructField("movieId", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType()),
])

CORRUPT_COL = "_corrupt_record"


def read_delimited(spark: SparkSession, path: str, schema: T.StructType,
                   sep: str = "::", keep_corrupt: bool = False) -> DataFrame:
    """Headerless delimited text with named, typed columns.

    ``quote`` is disabled so titles keep their quote characters; fields that
    do not parse become NULL (R's ``as.integer`` gives NA). With
    ``keep_corrupt`` the raw line of any malformed record is kept in
    ``_corrupt_record`` so callers can count it.
    """
    read_schema = schema
    if keep_corrupt:
        read_schema = T.StructType(list(schema.fields) + [T.StructField(CORRUPT_COL, T.StringType())])
    reader = (spark.read.option("sep", sep).option("header", "false").option("quote", "")
              .option("escape", "").option("mode", "PERMISSIVE"))
    if keep_corrupt:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT_COL)
    return reader.schema(read_schema).csv(path)


def count_malformed(df: DataFrame) -> DataFrame:
    """One row: total rows and rows the parser could not type: a typed field that is missing or does not parse and, in a
    frame read with ``keep_corrupt``, a wrong number of fields. An empty text field is a value."""
    fields = [f.name for f in df.schema.fields if not isinstance(f.dataType, T.StringType)]
    bad = F.lit(False)
    for c in fields:
        bad = bad | F.col(c).isNull()
    if CORRUPT_COL in df.columns:
        bad = bad | F.col(CORRUPT_COL).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(bad).alias("n_malformed"))


@dataclass
class Quarantine:
    """Lines of one input, typed (``good``) or rejected (``line``, ``reason``), and how many."""

    good: DataFrame
    rejected: DataFrame
    n_good: int
    n_rejected: int


def quarantine(spark: SparkSession, path: str, schema: T.StructType, sep: str = "::", name: str = "lines") -> Quarantine:
    """Read delimited lines once; write good rows and rejected lines apart under the checkpoint folder, counted as they pass.

    A line is rejected, with the first reason that holds, if it has another number of fields than the schema
    (``fields``) or a number that is missing, no number or NaN (that column's name). An empty text is a value. Blank lines are skipped.
    """
    parts = F.split("value", f"\\Q{sep}\\E", -1)
    typed, reason = [], F.when(F.size("parts") != len(schema.fields), F.lit("fields"))
    for i, f in enumerate(schema.fields):
        text = F.get("parts", F.lit(i))
        if isinstance(f.dataType, T.StringType):
            typed.append(text.alias(f.name))
            continue
        value = text.try_cast(f.dataType)
        missing = value.isNull() | F.isnan(value) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else value.isNull()
        reason = reason.when(missing, F.lit(f.name))
        typed.append(value.alias(f.name))
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("parts", parts).withColumn("reason", reason)
    bad = F.col("reason").isNotNull()
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    rows = lines.select(F.when(bad, F.col("value")).alias("line"), "reason", F.when(~bad, F.struct(*typed)).alias("row"), bad.alias("is_rejected"))
    rows = rows.observe(seen, F.count(F.lit(1)).alias("n"), F.count_if("is_rejected").alias("bad"))
    written = materialize(rows, f"quarantine-{name}", partition_by=["is_rejected"])
    n, n_bad = seen.get["n"], seen.get["bad"]
    return Quarantine(written.where("NOT is_rejected").select("row.*"), written.where("is_rejected").select("line", "reason"), n - n_bad, n_bad)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV (S3). Pass ``schema`` in production; inference is a full extra pass."""
    reader = spark.read.option("header", "true")
    if schema is None:
        return reader.option("inferSchema", "true").csv(path)
    return reader.schema(schema).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV sink (S3), one part per task."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = "::") -> None:
    """Sink for ``::`` text (the reference's input format), one part per task."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *cols).alias("value")).write.mode("overwrite").text(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Checkpoint sink (S4): Parquet, optionally partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
