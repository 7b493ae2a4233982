"""Keyed checkpoints: expensive steps that a later application reads instead of computing them again.

A checkpoint is named by its step and a fingerprint of everything its rows follow from: the input files (path, length, time of change),
the step's parameters, and the keys of the checkpoints that it was computed from. Its rows are written into a folder of their own; the
marker, one small JSON file that names the folder, is written after them and never replaced. So a half-written folder has no marker
and is not seen, a changed input or parameter has another key, and of two applications that compute the same step at once one wins and the
other one's folder is waste, which ``sweep`` deletes. Listing, reading and writing markers goes through Hadoop's file systems, so the root may be
any folder that Spark can write; nothing but the marker's few bytes passes through the driver.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import write_partitioned

#: Raised when a step's definition changes, so that older checkpoints aren't taken for the new one's.
FORMAT = 1


@dataclass(frozen=True)
class Checkpoint:
    """A stored step: its rows, how many they are, and the key for steps that follow from it."""

    df: DataFrame
    rows: int
    key: str
    reloaded: bool


class CheckpointStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- files --------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, path: str) -> str | None:
        fs, p = self._fs(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Write a file that doesn't exist yet; False if it does."""
        fs, p = self._fs(path)
        try:
            stream = fs.create(p, False)
        except Exception as error:  # noqa: BLE001  (a Java exception; another writer was first)
            if fs.exists(p):
                return False
            raise error
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        return True

    def files(self, path: str) -> list[list]:
        """[path, length, time of change] of every data file under ``path``, in order; names that begin with _ or . don't count."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        found, walk = [], fs.listFiles(p, True)
        while walk.hasNext():
            status = walk.next()
            name = status.getPath()
            if not name.getName().startswith(("_", ".")):
                found.append([name.toString(), status.getLen(), status.getModificationTime()])
        return sorted(found)

    # ---- keys ---------------------------------------------------------
    def key(self, step: str, inputs: list[str] = (), params: dict | None = None, upstream: list[str] = ()) -> str:
        told = {"format": FORMAT, "step": step, "params": params or {}, "upstream": list(upstream), "inputs": [self.files(x) for x in inputs]}
        return hashlib.sha256(json.dumps(told, sort_keys=True, default=str).encode()).hexdigest()[:32]

    def marker(self, step: str, key: str) -> str:
        return posixpath.join(self.root, f"{step}-{key}.json")

    # ---- checkpoints ----------------------------------------------------
    def load(self, step: str, key: str) -> Checkpoint | None:
        """A committed checkpoint, or None. Its schema is in the marker, so reading starts no job."""
        text = self._read(self.marker(step, key))
        if text is None:
            return None
        told = json.loads(text)
        data = posixpath.join(self.root, told["data"])
        fs, p = self._fs(posixpath.join(data, "_SUCCESS"))
        if not fs.exists(p):
            return None  # deleted behind the marker
        schema = T.StructType.fromJson(told["schema"])
        return Checkpoint(self.spark.read.schema(schema).parquet(data).select(*schema.names), told["rows"], key, True)

    def save(self, df: DataFrame, step: str, key: str, partition_by: list[str] | None = None) -> Checkpoint:
        """Write the rows, then the marker. If another application was first, its checkpoint is the result."""
        data = posixpath.join("data", f"{step}-{key}-{uuid.uuid4().hex[:8]}")
        seen = Observation(f"{step}-{key}")
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write
        write_partitioned(writer, self.spark, posixpath.join(self.root, data), partition_by)
        told = {"step": step, "data": data, "rows": seen.get["rows"], "schema": _nullable(df.schema).jsonValue()}
        own = self._create(self.marker(step, key), json.dumps(told))
        found = self.load(step, key)
        if found is None:
            raise RuntimeError(f"checkpoint {step}-{key} has a marker but no rows: delete {self.marker(step, key)}")
        return Checkpoint(found.df, found.rows, key, not own)

    def step(self, step: str, build: Callable[[], DataFrame], *, inputs: list[str] = (), params: dict | None = None,
             upstream: list[str] = (), partition_by: list[str] | None = None) -> Checkpoint:
        """The stored rows of this step for these inputs and parameters; ``build`` is called only if there are none."""
        key = self.key(step, inputs, params, upstream)
        return self.load(step, key) or self.save(build(), step, key, partition_by)

    def sweep(self) -> list[str]:
        """Delete the data folders that no marker names (left by applications that died, or lost a race); for when no other one writes here."""
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        named = {json.loads(self._read(s.getPath().toString()))["data"].rpartition("/")[2] for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")}
        fs, p = self._fs(posixpath.join(self.root, "data"))
        gone = []
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)
                gone.append(s.getPath().getName())
        return sorted(gone)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
