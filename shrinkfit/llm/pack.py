"""Best-fit packing of token sequences, bulk-synchronous.

Documents are cut only where they are longer than a sequence; the pieces are range-sorted by
(length, document, piece), which gives each its rank among the pieces of its length. Lengths are
whole numbers up to the capacity, so the state of all open sequences and all waiting pieces is
a table of classes: how many pieces of each length wait, and how many sequences have each gap,
as runs of ranks. A round lets every length class, longest first, look for its successor among
the gaps (the smallest that holds it), takes as many as both sides have - where more pieces want a
gap than there are, the lower ranks get it and the others go on to the next gap - and updates
those gaps for the next round; when no waiting piece fits any gap, the longest class opens new
sequences. The table has as many classes as the capacity, whatever the data's size; the pieces
themselves never leave the executors and take their places by a join on length and rank.

Nulls: a null text is empty and takes one token, the end id; a null doc_id is kept. Very long texts are cut
into capacity-sized pieces, the first one taking what is left over. Ties and repeated rows: every row is packed;
equal lengths are told apart by rank. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .cache import tidy
from .common import driver_rows, shuffle_partitions, slices
from .tokens import encoder, tokenizer_path

#: Bytes of text that are encoded at one time.
SLICE = 2 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, capacity: int, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0) -> DataFrame:
    """The pieces of every document, by whole texts: doc_id, piece, start, length, ids_crc32."""
    path = path or tokenizer_path()

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                offsets, ids = enc.encode(part.column("text"), end)
                data, sizes = ids.astype("<u4").tobytes(), np.diff(offsets)
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = sizes - (pieces - 1) * capacity
                start = np.where(number == 0, 0, head[row] + (number - 1) * capacity)
                length = np.where(number == 0, head[row], capacity)
                at = 4 * (offsets[row] + start)
                crc = [zlib.crc32(data[a:z]) for a, z in zip(at.tolist(), (at + 4 * length).tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(cut), PIECES)


def ranked(pieces: DataFrame, parts: int) -> tuple[DataFrame, dict[int, int]]:
    """Each piece with its rank among those of its length, and how many pieces each length has.

    A range sort over all pieces: a length that a third of them have is spread over many partitions.
    """
    order = ["length", "doc_id", "piece", "start", "ids_crc32"]

    def number(batches):
        part, length, seen = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lens = batch.column("length").to_numpy()
            first = np.concatenate([[0], np.flatnonzero(np.diff(lens)) + 1])
            runs = np.diff(np.concatenate([first, [len(lens)]]))
            local = np.arange(len(lens)) - np.repeat(first, runs)
            if lens[0] == length:
                local[: runs[0]] += seen
            length, seen = lens[-1], local[-1] + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lens), part), pa.int64()), pa.array(local, pa.int64())], [*batch.schema.names, "part", "local"])

    # Written first: the range sort reads its input twice, once for a sample of the keys.
    pieces = materialize(pieces, "pack-pieces")
    local = materialize(pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(number), f"{PIECES}, part long, local long"), "pack-ranked")
    # A row per partition, and one more for each length that begins inside one.
    counts = sorted(local.groupBy("part", "length").agg(F.count("*").alias("n")).collect(), key=lambda r: (r.length, r.part))
    sizes: dict[int, int] = defaultdict(int)
    shift = []
    for r in counts:
        shift.append((r.part, r.length, sizes[r.length]))
        sizes[r.length] += r.n
    spark = pieces.sparkSession
    base = driver_rows(spark, shift or [(0, 0, 0)], "part long, length long, before long")
    out = local.join(F.broadcast(base), ["part", "length"]).withColumn("rank", F.col("local") + F.col("before")).drop("part", "local", "before")
    return out, dict(sizes)


def match_rounds(sizes: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, number, first sequence, offset) that place all pieces, and the number of sequences.

    Ranks first..first+number-1 of a length go to as many sequences from the first one on.
    """
    waiting = {s: n for s, n in sizes.items() if n}
    taken = dict.fromkeys(waiting, 0)
    gaps: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # gap: runs (first sequence, number, filled)
    placed, sequences = [], 0

    def take(size: int, n: int, first: int, filled: int) -> None:
        placed.append((size, taken[size], n, first, filled))
        taken[size] += n
        waiting[size] -= n

    def open_new(size: int, n: int) -> None:
        nonlocal sequences
        take(size, n, sequences, 0)
        if capacity > size:
            gaps[capacity - size].append((sequences, n, size))
        sequences += n

    for size in sorted(waiting, reverse=True):
        if 2 * size > capacity:  # no two of these share a sequence
            open_new(size, waiting[size])
    while any(waiting.values()):
        moved, after, classes = False, defaultdict(list), sorted(gaps)
        for size in sorted((s for s, n in waiting.items() if n and classes and s <= classes[-1]), reverse=True):
            k = bisect_left(classes, size)
            while waiting[size] and k < len(classes):
                gap = classes[k]
                first, have, filled = gaps[gap].pop()
                n = min(have, waiting[size])
                take(size, n, first, filled)
                if have > n:
                    gaps[gap].append((first + n, have - n, filled))
                if not gaps[gap]:
                    del gaps[gap]
                    classes.pop(k)
                if gap > size:
                    after[gap - size].append((first, n, filled + size))
                moved = True
        for gap, runs in after.items():
            gaps[gap] += runs
        if not moved and any(waiting.values()):
            # Nothing fits: the longest class opens as many sequences as it fills by itself.
            longest = max(s for s, n in waiting.items() if n)
            open_new(longest, -(-waiting[longest] // (capacity // longest)))
    return placed, sequences


def pack(docs: DataFrame, capacity: int = 2048, *, doc_id: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0) -> DataFrame:
    """Pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces, sizes = ranked(cut_pieces(docs, capacity, doc_id=doc_id, text=text, path=path, end=end), shuffle_partitions(spark))
    placed, _ = match_rounds(sizes, capacity)
    runs = driver_rows(spark, placed or [(0, 0, 0, 0, 0)], "length long, first long, n long, sequence long, offset long")
    at = F.col("rank") >= F.col("first")
    joined = pieces.join(F.broadcast(runs), (pieces.length == runs.length) & at & (F.col("rank") < F.col("first") + F.col("n")))
    return joined.select("doc_id", "piece", "start", pieces.length, "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset")
