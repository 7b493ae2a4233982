"""Helpers shared by the operators: scratch paths, file access from tasks, joins with hot keys."""

from __future__ import annotations

import os
import posixpath
import re
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir

#: Ids (16 bytes each in a broadcast relation's pages, at most ~64 with overhead) that are broadcast at most.
BROADCAST_ROWS = 500_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder that the session names in ``spark.checkpoint.dir``."""
    return posixpath.join(checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex[:12]}")


#: Bytes of an Arrow batch on its way to or from a Python task: with long texts, 10,000 rows (the default) are tens of megabytes on both sides.
ARROW_BYTES = 4 << 20

#: Rows that Spark reads from Parquet at one time: of long texts, 4,096 (the default) are tens of megabytes of heap in each task.
READ_ROWS = 1024

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, for a cluster on which it isn't installed, once per application; and bound the session's Arrow batches by bytes and what it reads at one time."""
    app = spark.sparkContext.applicationId
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="shrinkfit-ship-")  # the driver's own; Spark sends the file
    path = os.path.join(folder, "shrinkfit.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def driver_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """The driver's own rows (some) as a table, by Arrow: ``createDataFrame`` of tuples starts Python workers of another kind beside those of the operators."""
    schema = StructType.fromDDL(ddl)
    return spark.createDataFrame(pa.table([pa.array(x) for x in zip(*rows, strict=True)], names=schema.names), schema)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI; runs in tasks, where Spark's writers aren't at hand."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def offsets_of(array: pa.Array) -> np.ndarray:
    """Offsets of a list or string array as int64, also where the array is a slice."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_list(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    return np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in runs of about ``most`` bytes of a string column (one row at least), to bound a task's memory."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(byte_lengths(batch.column(column)))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def fresh(texts: pa.Array) -> pa.Array:
    """The texts as large strings in buffers of their own, null as empty; Arrow's casts and kernels go wrong on some slices."""
    import pyarrow.compute as pc

    return pc.fill_null(texts.take(pa.array(np.arange(len(texts)))), "").cast(pa.large_string())


def byte_lengths(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def hot_split_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, parts: int = 1000) -> DataFrame:
    """Left join on a key that is unique in ``right``, where one key may hold a large share of ``left``.

    Keys whose ``weight`` (their number of rows in ``left``) is over ``total / parts`` are at most
    ``parts``, so their rows are broadcast; all others are shuffled, none of them large. ``left``
    is read twice and should be a written table.
    """
    hot = right.filter(F.col(weight) * parts > F.lit(total))
    cold = right.filter(F.col(weight) * parts <= F.lit(total))
    names = [c for c in right.columns if c != key]
    hit = left.join(F.broadcast(hot), key, "inner").select(*left.columns, *names)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left").select(*left.columns, *names)
    return hit.unionByName(rest)


def keep_rows(wide: DataFrame, gone: DataFrame, on: list[str], n_gone: int | None = None) -> DataFrame:
    """Anti join of wide rows with a narrow table of keys to drop: a broadcast while the counted keys are few, a shuffle beyond that."""
    n = gone.count() if n_gone is None else n_gone
    side = F.broadcast(gone) if n <= BROADCAST_ROWS else gone
    # Null-safe, so that a row with a null key follows its decision as well.
    marked = side.select(*[F.col(c).alias(f"__gone_{c}") for c in on])
    cond = [F.col(c).eqNullSafe(F.col(f"__gone_{c}")) for c in on]
    return wide.join(marked, cond, "left_anti")
