"""Passages that repeat across documents, by sparse suffix arrays.

1. Texts whose words are all equal are one representative from here on, whatever their number: each copy is a passage as a whole.
2. Of each representative's suffixes (by word) only those at minimisers are retained: a position whose hash of
   the next ANCHOR words is the least in some window of ``words - ANCHOR + 1`` positions. What a position's window holds
   alone decides, so two documents that share ``words`` words in a row retain a common suffix there.
3. Suffixes whose first ANCHOR words occur once are dropped (one aggregate by hash). The others are given their next ``words`` words
   and the ANCHOR ones before them, as 32-bit hashes.
4. Suffixes are range-sorted by their words - all columns are sort keys, so equal ones may be dealt over many tasks - and each is
   compared with its neighbours and the nearest one of another document; the rows at a task's ends are compared again with those of the next task.
   A match is extended to both sides; it counts from ``words`` words on. A suffix keeps the farthest reach to each side of all its matches: they
   all hold its position, so together they are one span.
5. Suffixes that have more neighbours with the same beginning than were compared are resolved exactly, whether they found a match or not. Sorted neighbours tell how many words any other document shares to the right, a second sort by the words before how many
   to the left; only the ``words``-word runs across the position that both bounds allow are looked up by hash.
6. Each document's matches are joined to maximal passages: longer ones have a retained suffix every few words.

Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased. Null, empty and shorter texts have no passage; a null doc_id takes no part. Very long texts
are used whole. Repeats inside one doc_id don't count, so repeated rows don't either; the passages of an id's
several texts are given together, by word number. Words are compared by hash: 64 bits of the first ANCHOR words, 32 of each further one. Ties need no rule: every occurrence is reported. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .cache import tidy
from .common import hot_split_join, keep_rows, shuffle_partitions
from .forest import mix, text_slices, word_hashes

#: Words of a suffix that are hashed to select and group it, and neighbours compared on each side.
ANCHOR, NEIGHBOURS = 25, 8
#: A word's hash beside a suffix: big-endian, so that bytes sort as words do.
WORD, BYTES = ">u4", 4
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BASE_2 = 0xC2B2AE3D27D4EB4F

_FOUND = pa.schema([("kind", pa.int8()), ("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("other", pa.int64()), ("after", pa.binary()), ("before", pa.binary())])
_FOUND_DDL = "kind byte, h long, doc_id long, pos long, start long, end long, other long, after binary, before binary"
MATCH, OPEN, EDGE, CROWD = 0, 1, 2, 3


def runs(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words (mod 2**64 polynomial, mixed)."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power = np.empty(len(words), np.uint64)
    power[0], power[1:] = 1, np.uint64(_BASE)
    np.multiply.accumulate(power, out=power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)])
    back = np.full(n, np.uint64(_INVERSE))
    back[0] = 1
    np.multiply.accumulate(back, out=back)
    return mix((total[length:] - total[:-length]) * back)


def sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x, have = op(x[:-have], x[have:]), 2 * have
    rest = width - have
    return op(x[:-rest], x[rest:]) if rest else x


def minimisers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the least of some window of positions."""
    if len(h) < window:
        return np.zeros(0, np.int64)
    least = sliding(h, window, np.minimum)
    # A position is retained where the largest of its windows' least values is its own.
    padded = np.concatenate([np.zeros(window - 1, np.uint64), least, np.zeros(window - 1, np.uint64)])
    return np.flatnonzero(sliding(padded, window, np.maximum) == h)


def scanned(docs: DataFrame, words: int) -> DataFrame:
    """A row for each text of ``words`` words or more: doc_id, d, digest (of its words), n_words, h and pos (hash of the first words and number
    of the first word of each retained suffix), short (its words as 32-bit hashes)."""
    schema = pa.schema([("doc_id", pa.int64()), ("d", pa.int64()), ("digest", pa.binary()), ("n_words", pa.int64()), ("h", pa.list_(pa.int64())), ("pos", pa.list_(pa.int32())), ("short", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(), batch.column("d").to_numpy()
            for start, part in text_slices(batch.column("text")):
                offs, hashes = word_hashes(part)
                long = np.flatnonzero(np.diff(offs) >= words)
                digests, hs, at, short = [], [], [], []
                for k in long.tolist():
                    w = hashes[offs[k] : offs[k + 1]]
                    h = runs(w, ANCHOR)
                    places = minimisers(h, words - ANCHOR + 1)
                    digests.append(hashlib.blake2b(w.tobytes(), digest_size=16).digest())
                    hs.append(h[places].view(np.int64))
                    at.append(places.astype(np.int32))
                    short.append((w >> np.uint64(17)).astype(WORD).tobytes())
                if not hs:
                    continue
                ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (hs, at)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[start + long]), pa.array(keys[start + long]), pa.array(digests, pa.binary()), pa.array(np.diff(offs)[long]), *lists, pa.array(short, pa.binary())], schema=schema)

    return docs.select("doc_id", "d", "text").mapInArrow(tidy(run), "doc_id long, d long, digest binary, n_words long, h array<long>, pos array<int>, short binary")


def with_words(rows: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """h, doc_id, pos, after, before for each retained place; ``places``: d, places (array of struct<pos, h>)."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("after", pa.binary()), ("before", pa.binary())])

    def run(batches):
        for batch in batches:
            for doc_id, short, at in zip(batch.column("doc_id").to_pylist(), batch.column("short").to_pylist(), batch.column("places")):
                h, pos = (at.values.field(c).cast(pa.int64()) for c in ("h", "pos"))
                w = np.frombuffer(short, WORD)
                back = w[::-1].tobytes()
                after = [short[BYTES * p : BYTES * (p + words)] for p in pos.to_pylist()]
                before = [back[BYTES * (len(w) - p) : BYTES * (len(w) - max(0, p - ANCHOR))] for p in pos.to_pylist()]
                yield pa.RecordBatch.from_arrays([h, pa.array(np.full(len(pos), doc_id)), pos, pa.array(after, pa.binary()), pa.array(before, pa.binary())], schema=schema)

    return rows.select("d", "doc_id", "short").join(places, "d").select("doc_id", "short", "places").mapInArrow(tidy(run), "h long, doc_id long, pos long, after binary, before binary")


def as_words(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """[rows, width] words, filled up, and each row's number of them."""
    data = [x.ljust(BYTES * width, b"\0") for x in column.to_pylist()]
    lens = np.array([len(x) // BYTES for x in column.to_pylist()], dtype=np.int64)
    return np.frombuffer(b"".join(data), WORD).reshape(-1, width), lens


def common(words: np.ndarray, lens: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Number of equal words at the beginning."""
    same = words[i] == words[j]
    n = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1))
    return np.minimum(n, np.minimum(lens[i], lens[j]))


def nearest(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the last row before and the first one after its run of equal h and doc; -1 and n at the ends."""
    n = len(h)
    turn = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])
    starts, run = np.flatnonzero(turn), np.cumsum(turn) - 1
    return starts[run] - 1, np.append(starts[1:], n)[run]


def compare(rows: pa.Table, words: int, first: bool, last: bool) -> pa.RecordBatch:
    """Matches, open rows, crowded ones with the words that any other document shares to the right, and (``first``, ``last``) the
    rows at the ends of a run of sorted suffixes."""
    n = rows.num_rows
    col = lambda c: rows.column(c).combine_chunks()
    h, doc, pos = (col(c).to_numpy() for c in ("h", "doc_id", "pos"))
    after, n_after = as_words(col("after"), words)
    before, n_before = as_words(col("before"), ANCHOR)
    left, right, reach = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    other = np.full(n, -1)
    hit = np.zeros(n, bool)

    def look(i: np.ndarray, j: np.ndarray) -> None:
        ok = (h[i] == h[j]) & (doc[i] != doc[j])
        i, j = i[ok], j[ok]
        if not len(i):
            return
        r, b = common(after, n_after, i, j), common(before, n_before, i, j)
        for x, y in ((i, j), (j, i)):
            np.maximum.at(reach, x, r)
            enough = (r >= ANCHOR) & (r + b >= words)
            x, y = x[enough], y[enough]
            np.maximum.at(left, x, b[enough])
            np.maximum.at(right, x, r[enough])
            other[x], hit[x] = doc[y], True

    at = np.arange(n)
    for lag in range(1, NEIGHBOURS + 1):
        look(at[:-lag], at[lag:])
    # The nearest rows of another document share most words to the right.
    low, high = nearest(h, doc)
    for i, j in ((at[high < n], high[high < n]), (at[low >= 0], low[low >= 0])):
        look(i, j)
    reach[(low < 0) | (high == n)] = words  # not known here
    crowded = np.zeros(n, bool)
    if n > NEIGHBOURS:
        crowded[:-NEIGHBOURS] |= h[:-NEIGHBOURS] == h[NEIGHBOURS:]
        crowded[NEIGHBOURS:] |= h[NEIGHBOURS:] == h[:-NEIGHBOURS]
    unresolved = crowded.copy()
    # Rows of a beginning that may go on past the ends belong to a crowd that isn't seen as a whole.
    crowded |= (h == h[0]) | (h == h[-1])
    edge = np.zeros(n, bool)
    edge[: NEIGHBOURS * first] = True
    edge[n - min(n, NEIGHBOURS * last) :] = True
    take = np.concatenate([np.flatnonzero(x) for x in (hit, unresolved, edge, crowded)])
    kind = np.repeat([MATCH, OPEN, EDGE, CROWD], [x.sum() for x in (hit, unresolved, edge, crowded)]).astype(np.int8)
    start, end = np.where(kind == CROWD, pos[take], (pos - left)[take]), (pos + right)[take]
    end = np.where(kind == CROWD, (pos + reach)[take], end)
    narrow = pa.array((kind == MATCH) | (kind == OPEN))
    ctx = [pc.if_else(narrow, pa.scalar(None, pa.binary()), col(c).take(pa.array(take))) for c in ("after", "before")]
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(h[take]), pa.array(doc[take]), pa.array(pos[take]), pa.array(start), pa.array(end), pa.array(other[take]), *ctx], schema=_FOUND)


def in_runs(batches, rows: int, again: int):
    """(rows, first, last): the sorted rows of a task in tables of about ``rows``, the last ``again`` of each one repeated in the next."""
    held, first = None, True
    for batch in batches:
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        if held.num_rows >= rows:
            # What follows is not known yet; a table that turns out to be the last one is given as such by its repeated rows.
            yield held, first, False
            held, first = held.slice(held.num_rows - again), False
    if held is not None and held.num_rows:
        yield held, first, True


def sorted_matches(suffixes: DataFrame, words: int, parts: int) -> DataFrame:
    order = ["h", "after", "before", "doc_id", "pos"]

    def run(batches, edges=True):
        for rows, first, last in in_runs(batches, 20_000, 2 * NEIGHBOURS):
            yield compare(rows, words, first and edges, last and edges)

    found = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidy(run), _FOUND_DDL)
    found = materialize(found, "suffix-matches")
    # The rows at the ends of tasks, a few for each task whatever its size: one sorted list.
    ends = found.filter(F.col("kind") == EDGE).select("h", "doc_id", "pos", "after", "before").distinct().coalesce(1).sortWithinPartitions(*order)
    again = ends.mapInArrow(lambda batches: run(batches, edges=False), _FOUND_DDL).filter(F.col("kind").isin(MATCH, OPEN))
    return found.filter(F.col("kind") != EDGE).unionByName(materialize(again, "suffix-ends"))


def across(before: np.ndarray, after: np.ndarray, words: int, base: int) -> np.ndarray:
    """[rows, ANCHOR + 1] hashes of the ``words``-word runs that take k words of ``before`` (k from 0)."""
    window = mix(np.concatenate([before[:, ::-1], after], axis=1).astype(np.uint64) + np.uint64(base))
    power = np.array([pow(base, i, 1 << 64) for i in range(window.shape[1])], np.uint64)
    total = np.concatenate([np.zeros((len(window), 1), np.uint64), np.cumsum(window * power, axis=1, dtype=np.uint64)], axis=1)
    at = ANCHOR - np.arange(ANCHOR + 1)
    back = np.array([pow(pow(base, -1, 1 << 64), int(i), 1 << 64) for i in at], np.uint64)
    return mix((total[:, at + words] - total[:, at]) * back)


def resolved(crowd: DataFrame, words: int, parts: int) -> DataFrame:
    """doc_id, start, end, other for the rows of ``crowd`` by the ``words``-word runs across their position that may have a partner."""
    order = ["h", "before", "after", "doc_id", "pos"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("run", pa.int64()), ("check", pa.int64())])

    def run(batches):
        for rows, _, _ in in_runs(batches, 20_000, 1):
            col = lambda c: rows.column(c).combine_chunks()
            h, doc, pos, end = (col(c).to_numpy() for c in ("h", "doc_id", "pos", "end"))
            after, n_after = as_words(col("after"), words)
            before, n_before = as_words(col("before"), ANCHOR)
            low, high = nearest(h, doc)
            share = np.zeros(len(h), np.int64)
            for j, ok in ((low, low >= 0), (high, high < len(h))):
                i = np.flatnonzero(ok)
                i = i[h[i] == h[j[i]]]
                share[i] = np.maximum(share[i], common(before, n_before, i, j[i]))
            share[(low < 0) | (high == len(h))] = ANCHOR  # not known here
            k = np.arange(ANCHOR + 1)
            most, least = np.minimum(share, n_before), words - np.minimum(end - pos, n_after)
            row, k = np.nonzero((k <= most[:, None]) & (k >= least[:, None]))
            # With the whole hash of the beginning and its place in the run: the words' hashes alone would mix up runs of one repeated word.
            own = h[row].view(np.uint64) * np.uint64(_INVERSE) + k.astype(np.uint64)
            keys = [mix(across(before, after, words, base)[row, k] + own).view(np.int64) for base in (_BASE, _BASE_2)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array(pos[row] - k), *map(pa.array, keys)], schema=schema)

    rows = crowd.select("end", *order).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    spans = materialize(rows.mapInArrow(tidy(run), "doc_id long, start long, run long, check long"), "suffix-runs")
    both = spans.groupBy("run", "check").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low <> high")
    return spans.join(both, ["run", "check"]).select("doc_id", "start", (F.col("start") + words).alias("end"), F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other"))


def repeated_passages(docs: DataFrame, words: int = 50, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end (word numbers, end excluded), n_words, other (a document that has a part of it) of passages that repeat across documents."""
    if words <= ANCHOR:
        raise ValueError(f"words must be over {ANCHOR}")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    parts = shuffle_partitions(docs.sparkSession)
    rows = materialize(scanned(texts.withColumn("d", F.xxhash64("doc_id", "text")), words), "suffix-rows")
    # An id that stands for different texts keeps a row for each of them: what one of them shares with the other doesn't count.
    several = rows.groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("several")).filter("several").select("doc_id")
    single = rows.select("doc_id", "d", "digest", "n_words").join(several, "doc_id", "left_anti")
    copies = materialize(single.groupBy("digest").agg(F.count("*").alias("n"), F.min_by("d", "doc_id").alias("d"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("n > 1"), "suffix-copies")
    whole = hot_split_join(rows.select("doc_id", "d", "digest", "n_words"), copies.withColumnRenamed("d", "kept_d"), "digest", "n", rows.count())
    whole = materialize(whole.filter("kept_d IS NOT NULL").join(several, "doc_id", "left_anti"), "suffix-whole")
    gone = materialize(whole.filter("d <> kept_d").select("d").distinct(), "suffix-gone")
    reps = keep_rows(rows.select("d", "h", "pos"), gone, ["d"])
    places = materialize(reps.select("d", F.explode(F.arrays_zip("h", "pos")).alias("at")).select("d", "at.h", "at.pos"), "suffix-places")
    again = materialize(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "suffix-again")
    # A common beginning may hold a large share of the places.
    by_row = hot_split_join(places, again, "h", "n", places.count()).filter("n IS NOT NULL").groupBy("d").agg(F.collect_set(F.struct("pos", "h")).alias("places"))
    suffixes = materialize(with_words(rows, by_row, words), "suffixes")
    found = sorted_matches(suffixes, words, parts)
    spans = found.filter(F.col("kind") == MATCH).select("doc_id", "start", "end", "other")
    spans = spans.unionByName(whole.filter("low <> high").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"), F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("other")))
    still_open = materialize(found.filter(F.col("kind") == OPEN).select("h").distinct(), "suffix-open")
    if not still_open.isEmpty():
        spans = spans.unionByName(resolved(found.filter(F.col("kind") == CROWD).join(still_open, "h", "left_semi"), words, parts))
    # Matches that overlap or touch are one passage; a document's matches are bounded by its length.
    so_far = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    spans = spans.withColumn("new", F.when(F.col("start") <= F.max("end").over(so_far), 0).otherwise(1)).withColumn("part", F.sum("new").over(up_to))
    out = spans.groupBy("doc_id", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other"))
    return out.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "other")


def passages_query(docs: DataFrame) -> DataFrame:
    """op4: passages of 50 words or more that repeat across documents."""
    return repeated_passages(docs)
