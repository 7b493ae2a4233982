"""Exact top-k by inner product over a bit-sliced index.

Vectors are quantised to whole numbers, floor(scale * x). A block of rows is stored by slices: for each
component and each binary digit of (value - lowest) one bitmap over the block's rows. A query's
scores for all rows of a block are themselves slices, made by bitmap arithmetic: for every set
digit of a query's weight the component's slices are added - carry-save, three bitmaps into two - and
doubling moves to the next digit. Negative weights use the complement slices, and a constant
corrects for both shifts. The k largest are selected from the most significant score slice downward: rows
with the digit set are kept while more than k remain, else they are in and the rest is searched
on; what is left at the last slice are equal scores, resolved by the smallest id. A block gives at most k rows
for a query, and the best k of all blocks are the result, exact in whole numbers.

The index is a written table of blocks; queries come in blocks too and travel to the index: each index block is sent once to
each of ``shares`` tasks (one, where there are blocks enough to keep all slots busy), the query blocks are dealt over those and pass
it one by one. So what is shuffled of the index grows with the index alone. Queries: a stated set, against all rows.

Vectors that are null, or hold null, NaN or infinite components, take no part; nor do empty ones. Vectors of different
lengths: the shorter one counts as filled up with zeros. Ties: smaller id. Repeated ids: each row is a candidate; a query leaves out
all rows with its own id, and repeated queries are searched as one for each row. Empty table: no rows. Null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCK_ROWS, BLOCK_QUERIES = 32_768, 64


def quantised(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, v (array of long) of the vectors that take part."""
    v = F.col(vector)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = rows.filter(v.isNotNull() & (F.size(v) > 0) & F.col(vec_id).isNotNull() & whole)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    from .common import offsets_of

    offs = offsets_of(column)
    flat = column.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
    lens = np.diff(offs)
    out = np.zeros((len(column), dims), dtype=np.int64)
    out[np.arange(dims) < lens[:, None]] = flat
    return out


def bitmaps(values: np.ndarray, digits: int) -> np.ndarray:
    """[digits, words] of non-negative whole numbers; row i is bit i."""
    words = -(-len(values) // 64)
    bits = (values[None, :] >> np.arange(digits)[:, None] & 1).astype(np.uint8)
    packed = np.zeros((digits, words * 8), dtype=np.uint8)
    packed[:, : -(-len(values) // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return packed.view("<u8")


class CarrySave:
    """A sum of bit-sliced numbers, two bitmaps for each digit until the carries are resolved."""

    def __init__(self, digits: int, words: int):
        self.sum = np.zeros((digits, words), dtype=np.uint64)
        self.carry = np.zeros((digits, words), dtype=np.uint64)

    def add(self, slices: np.ndarray) -> None:
        n = len(slices)
        s, c = self.sum, self.carry
        # Where the added number has digits, three bitmaps become two; above them the carries ripple one step.
        a, b = s[:n], c[:n]
        half = a ^ b
        carry = (half & slices) | (a & b)
        s[:n] = half ^ slices
        top_sum, top_carry = s[n:], c[n:]
        high = top_sum & top_carry
        s[n:] = top_sum ^ top_carry
        c[0] = 0
        c[1 : n + 1] = carry
        c[n + 1 :] = high[:-1]

    def resolve(self) -> np.ndarray:
        s, c = self.sum, self.carry
        while c.any():
            over = s & c
            s = s ^ c
            c = np.zeros_like(c)
            c[1:] = over[:-1]
        return s


def scores(index: np.ndarray, weights: np.ndarray, digits: int) -> np.ndarray:
    """Slices of sum over components of |w| * (value - low, or its complement where w < 0)."""
    dims, width, words = index.shape
    size = np.abs(weights)
    total = None
    for digit in reversed(range(int(size.max()).bit_length())):
        sums = CarrySave(digits, words)
        if total is not None:
            sums.sum[1:] = total[:-1]  # doubled
        for j in np.flatnonzero(size >> digit & 1):
            sums.add(index[j] if weights[j] > 0 else ~index[j])
        total = sums.resolve()
    return np.zeros((digits, words), np.uint64) if total is None else total


def positions(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def popcount(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def select(slices: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest among ``rows`` (a bitmap); equal ones by position."""
    inside, open_rows = np.zeros_like(rows), rows
    if popcount(rows) > k:
        for bitmap in slices[::-1]:
            with_digit = open_rows & bitmap
            n = popcount(inside) + popcount(with_digit)
            if n > k:
                open_rows = with_digit
            else:
                inside = inside | with_digit
                open_rows = open_rows & ~bitmap
                if n == k:
                    return positions(inside)
    first = positions(inside)
    return np.concatenate([first, positions(open_rows)[: k - len(first)]])


def search_block(ids: np.ndarray, index: np.ndarray, low: int, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(ids, scores) of each query's k best rows of the block."""
    dims, width, words = index.shape
    everyone = bitmaps(np.ones(len(ids), dtype=np.int64), 1)[0]
    for q in range(len(query_ids)):
        w = queries[q]
        reach = int(np.abs(w).sum()) * ((1 << width) - 1)
        slices = scores(index, w, max(1, reach.bit_length()) + 1)
        rows = everyone
        own = slice(*np.searchsorted(ids, [query_ids[q], query_ids[q] + 1]))
        if own.start < own.stop:
            rows = everyone & ~bitmaps((ids == query_ids[q]).astype(np.int64), 1)[0]
        found = select(slices, rows, k)
        shift = int(w.sum()) * low + int(w[w < 0].sum()) * ((1 << width) - 1)
        bits = np.stack([slices[:, p // 64] >> np.uint64(p % 64) & np.uint64(1) for p in found]) if len(found) else np.zeros((0, len(slices)), np.uint64)
        value = (bits.astype(np.int64) << np.arange(len(slices))).sum(axis=1) + shift
        yield ids[found], value


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, int, int]:
    """Written blocks (block, dims, width, low, ids, slices); their number, and the number of dimensions.

    ``vectors``: vec_id, v. Blocks are runs of the range-sorted ids.
    """
    stats = vectors.agg(F.count("*").alias("n"), F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high"), F.max(F.size("v")).alias("dims")).first()
    if not stats.n:
        return vectors.sparkSession.createDataFrame([], "block long, low long, ids binary, slices binary"), 0, 0
    low, dims = min(0, stats.low), stats.dims
    width = max(1, (max(0, stats.high) - low).bit_length())
    parts = -(-stats.n // block_rows)
    schema = "block long, low long, ids binary, slices binary"

    def build(batches):
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows: pa.Table):
            ids = rows.column("vec_id").combine_chunks().to_numpy()
            values = matrix(rows.column("v").combine_chunks(), dims) - low
            slices = np.stack([bitmaps(values[:, j], width) for j in range(dims)])
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64()), pa.array([low], pa.int64()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([slices.tobytes()], pa.binary())], ["block", "low", "ids", "slices"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= 2 * block_rows:
                rows = pa.Table.from_batches(held)
                yield block(rows.slice(0, block_rows))
                number, held = number + 1, rows.slice(block_rows).to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield block(rows)

    blocks = vectors.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id").mapInArrow(build, schema)
    return materialize(blocks, "bit-slices"), dims, width


def search(index: DataFrame, dims: int, width: int, queries: DataFrame, k: int = 5, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries``: vec_id, v."""
    spark = index.sparkSession
    schema = "query_id long, vec_id long, score long"
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = [r.block for r in index.select("block").collect()]  # a number for each block
    # Query blocks, each repeated for each index block: a stated set against all rows, in blocks.
    queries = queries.withColumn("row", F.monotonically_increasing_id())
    n_queries = queries.count()
    shares = max(1, min(-(-4 * spark.sparkContext.defaultParallelism // len(blocks)), -(-n_queries // block_queries)))

    def gather(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, block_queries):
                part = batch.slice(a, block_queries)
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([part.column("row").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([matrix(part.column("v"), dims).astype("<i8").tobytes()], pa.binary())], ["query_ids", "rows", "weights"])

    grouped = queries.repartition(max(1, -(-n_queries // (4 * block_queries)))).mapInArrow(gather, "query_ids binary, rows binary, weights binary")
    # Numbered nearly without gaps: about four blocks in a partition.
    number = F.spark_partition_id() * 4 + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = grouped.withColumn("share", F.pmod(number, F.lit(shares))).withColumn("block", F.explode(F.lit(blocks).cast("array<bigint>")))
    copies = index.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    tasks = len(blocks) * shares
    pairs = spread.repartition(tasks, "block", "share").join(copies.repartition(tasks, "block", "share").hint("merge"), ["block", "share"])

    def look(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, kind="<i8": np.frombuffer(batch.column(name)[row].as_py(), kind)  # noqa: E731, B023
                ids, query_ids, rows = get("ids"), get("query_ids"), get("rows")
                slices = get("slices", "<u8").reshape(dims, width, -1)
                weights = get("weights").reshape(-1, dims)
                out = list(search_block(ids, slices, batch.column("low")[row].as_py(), query_ids, weights, k))
                n = [len(i) for i, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, n)), pa.array(np.repeat(rows, n)), pa.array(np.concatenate([i for i, _ in out])), pa.array(np.concatenate([s for _, s in out]))], ["query_id", "row", "vec_id", "score"])

    found = pairs.mapInArrow(look, "query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_query(rows: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """op1: the k best rows for every row whose vec_id is divisible by ``every``."""
    vectors = quantised(rows, "vec_id", "embedding", scale)
    index, dims, width = build_index(vectors)
    return search(index, dims, width, vectors.filter(F.col("vec_id") % every == 0), k)


#: DuckDB SQL for op1.
TOP_K_SQL = """
WITH ok AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM ok q, ok c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p) WHERE rank <= 5
"""
