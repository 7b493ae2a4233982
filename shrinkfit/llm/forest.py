"""Near-duplicate classes by an LSH forest over MinHash signatures, links confirmed on whole shingle sets.

1. Each text's set of w-word shingles is hashed (64 bits) and gives its size, a digest of the set and a
   MinHash signature. Equal sets are one representative from here on, whatever their number.
2. Forest: each tree orders the representatives by its own run of the signature (a range sort; the id is
   the last key, so a region that a third of them share is dealt over many tasks). Neighbours with a common
   prefix of ``BASE`` values are candidates; a region of more than ``LEAF`` rows is cut at the next value, and so on:
   the depth adapts to each region. The pieces of a cut region stay linked by their neighbouring rows.
   Pairs whose signatures make the similarity unlikely (``DOUBT`` standard errors) go at once, and so do pairs whose parity sketches prove
   it too low: a set's sketch has a bit for each hash value modulo ``BITS``, set if an odd number of its shingles fall there, so two sketches differ in no
   more bits than the sets differ in shingles. That loses nothing.
3. Of a region's candidates, a spanning forest (most alike first) is confirmed on the full shingle sets; a second round confirms all other
   candidates that lie between different classes. So no pair of the candidates is lost, and a group of n near copies
   costs about n confirmations for each tree, not n squared.
4. The rows of regions that were cut (by ``LEAF``, or at the ends of a task's run) are joined exactly with each other: two sets of the threshold
   share one of their rarest shingles, at a place that leaves enough others behind it in both. The pairs between different classes are confirmed.
   A shingle of many rows is dealt over blocks; it costs pairs only for rows that have it among their rarest, by which they could reach the threshold,
   and whose sketches leave it open: a crowd of near copies that don't link costs comparisons of 256 bytes inside tasks, but next to no pairs.
5. Classes are the connected components of the confirmed links.

A link at the threshold 0.85 is a candidate in one tree with probability 0.85 ** 2, in ten with 1 - 3e-6. The signature's estimate, the same in all
trees, loses less than 2e-7 of the links at 0.85 or 0.8 besides (binomially). Of two rows of one cut region no link is lost.

Words are runs of [^\\x20\\x09-\\x0D], A-Z lower-cased. Fewer words than a shingle has: the whole sequence is one. Null, empty and
wordless texts have no shingles and link with nothing. Very long texts are used whole. A null doc_id links with nothing and is its own class (null). A doc_id that
stands for texts of different sets has a class for each of them. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .cache import tidy
from .common import BROADCAST_ROWS, byte_lengths, fresh, hot_split_join, keep_rows, offsets_of, shuffle_partitions
from .graph import components

TREES, DEPTH, BASE, LEAF = 10, 6, 2, 48
HASHES = TREES * DEPTH
#: Rows of one shingle that are compared in one block, and frequent shingles that are known to every task at most.
BLOCK, FREQUENT = 4096, 1_000_000
#: Standard errors of the signature's estimate by which a pair may miss the threshold and still be confirmed.
DOUBT = 6
#: Bits of a set's parity sketch, and sketches by different hashes of a set that stands in a crowd.
BITS, CROWD = 512, 4

_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_MASKS = np.random.default_rng(6).integers(0, 2**32, HASHES, dtype=np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, 64-bit hashes) of the words of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(fresh(texts)))
    offs = offsets_of(split)
    coded = split.values.slice(offs[0], offs[-1] - offs[0]).dictionary_encode()
    words = coded.dictionary.to_pandas().to_numpy(dtype=object)
    hashed = pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    full = (byte_lengths(coded.dictionary.cast(pa.large_string())) > 0)[codes] if len(words) else np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(full)])
    return upto[offs - offs[0]], hashed[codes[full]]


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of each text's shingles in order, repeats included."""
    offs, words = word_hashes(texts)
    n = np.diff(offs)
    own = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(own)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], own) + np.repeat(offs[:-1], own)
    last = np.repeat(offs[1:], own) - at  # words from here to the text's end
    h = np.zeros(ends[-1], dtype=np.uint64)
    for j in range(width):
        inside = last > j
        h[inside] = mix((h[inside] + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15) + words[at[inside] + j])
    return ends, h


def text_slices(texts: pa.Array, most: int = 2 << 20):
    ends = np.cumsum(byte_lengths(texts))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for _, part in text_slices(texts):
        ends, h = shingle_hashes(part, width)
        out += [np.unique(h[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out


def signatures(ends: np.ndarray, h: np.ndarray) -> np.ndarray:
    """[rows, HASHES] uint16; rows without shingles are 0."""
    full = np.diff(ends) > 0
    out = np.zeros((len(full), HASHES), dtype=np.uint16)
    if full.any():
        x, starts = (h >> np.uint64(32)).astype(np.uint32), ends[:-1][full]
        for k in range(HASHES):
            least = np.minimum.reduceat((x ^ _MASKS[k]) * _MULTIPLIERS[k], starts)
            out[full, k] = (least * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    return out


def parities(row: np.ndarray, h: np.ndarray, rows: int, times: int = 1) -> np.ndarray:
    """[rows, times * BITS / 8] bytes: the parity sketches of sets of distinct hashes."""
    out = []
    for t in range(times):
        place = row * BITS + (mix(h + np.uint64(t)) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
        odd = np.bincount(place, minlength=rows * BITS)[: rows * BITS] & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(rows, BITS), axis=1))
    return np.concatenate(out, axis=1)


def in_reach(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """May sets of these sketches (rows of 64-bit words) and sizes (both together) reach the share? They differ in as many shingles as any of their sketches at least."""
    differ = np.bitwise_count(left ^ right).reshape(len(left), left.shape[1] * 64 // BITS, BITS // 64).sum(axis=2, dtype=np.int64).max(axis=1)
    return differ * (share[0] + share[1]) <= sizes * (share[1] - share[0])


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, raw, text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("raw"), F.col(text).cast("string").alias("text"))


def signature_rows(docs: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """Written: doc_id, raw (a hash of the text as it is), n_shingles, digest (null without shingles), signature (the MinHash values, then the sketch)."""
    schema = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        for batch in batches:
            for start, part in text_slices(batch.column("text")):
                ends, h = shingle_hashes(part, width)
                distinct = [np.unique(h[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]
                row = np.repeat(np.arange(len(distinct)), [len(x) for x in distinct])
                sketch = parities(row, np.concatenate([*distinct, np.zeros(0, np.uint64)]), len(distinct))
                sig = np.concatenate([signatures(ends, h).astype("<u2").view(np.uint8), sketch], axis=1)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(start, len(part)) for c in ("doc_id", "raw")], pa.array([len(x) for x in distinct], pa.int64()), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in distinct], pa.binary()), pa.array([row.tobytes() for row in sig], pa.binary())], schema=schema)

    return materialize(keyed(docs, doc_id, text).mapInArrow(tidy(run), "doc_id long, raw long, n_shingles long, digest binary, signature binary"), "signatures")


def leaves(prefix: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """A number for each row's region: rows of equal tree and prefix, deeper where there are more than LEAF of them."""
    n = len(tree)
    new = np.concatenate([[True], tree[1:] != tree[:-1]])
    for k in range(BASE):
        new[1:] |= prefix[1:, k] != prefix[:-1, k]
    cut = new.copy()
    for k in range(BASE, DEPTH + 1):
        group = np.cumsum(cut) - 1
        large = np.bincount(group)[group] > LEAF
        if not large.any():
            break
        if k < DEPTH:
            new[1:] |= prefix[1:, k] != prefix[:-1, k]
            cut |= new & large
        else:  # equal to the last value
            place = np.arange(n) - np.maximum.accumulate(np.where(cut, np.arange(n), 0))
            cut |= large & (place % LEAF == 0)
    return np.cumsum(cut) - 1


def cut_rows(prefix: np.ndarray, tree: np.ndarray) -> np.ndarray:
    """The rows whose region (equal tree and first ``BASE`` values) is cut, or may go on past the ends of this run."""
    region = np.cumsum(np.concatenate([[True], (tree[1:] != tree[:-1]) | (prefix[1:, :BASE] != prefix[:-1, :BASE]).any(axis=1)])) - 1
    return np.flatnonzero((np.bincount(region)[region] > LEAF) | (region == 0) | (region == region[-1]))


def candidates(tree: np.ndarray, prefix: np.ndarray, rid: np.ndarray, size: np.ndarray, sketch: np.ndarray, parity: np.ndarray, share: tuple[int, int], least: float):
    """(a, b, first) of a run of sorted rows; first: it belongs to the region's spanning forest."""
    leaf = leaves(prefix, tree)
    lefts, rights, alike = [], [], []

    def look(i: np.ndarray, j: np.ndarray) -> None:
        ok = share[1] * np.minimum(size[i], size[j]) >= share[0] * np.maximum(size[i], size[j])
        ok &= rid[i] != rid[j]
        i, j = i[ok], j[ok]
        same = (sketch[i] == sketch[j]).mean(axis=1)
        ok = same >= least
        ok[ok] = in_reach(parity[i[ok]], parity[j[ok]], size[i[ok]] + size[j[ok]], share)
        lefts.append(i[ok])
        rights.append(j[ok])
        alike.append(same[ok])

    i = np.arange(len(tree))
    for lag in range(1, LEAF):
        i = i[: np.searchsorted(i, len(tree) - lag)]
        i = i[leaf[i] == leaf[i + lag]]
        if not len(i):
            break
        look(i, i + lag)
    # Neighbours across a cut of one region.
    edge = np.flatnonzero((leaf[1:] != leaf[:-1]) & (tree[1:] == tree[:-1]) & (prefix[1:, :BASE] == prefix[:-1, :BASE]).all(axis=1))
    look(edge, edge + 1)
    left, right, alike = np.concatenate(lefts), np.concatenate(rights), np.concatenate(alike)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    first = np.zeros(len(left), dtype=bool)
    for k in np.argsort(-alike, kind="stable").tolist():
        a, b = root(int(left[k])), root(int(right[k]))
        if a != b:
            parent[a] = b
            first[k] = True
    return np.minimum(rid[left], rid[right]), np.maximum(rid[left], rid[right]), first


def least_alike(threshold: float) -> float:
    """The smallest share of equal values at which a pair may still reach the threshold."""
    return threshold - DOUBT * (threshold * (1 - threshold) / HASHES) ** 0.5


def forest_pairs(reps: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Written: a, b, first; each pair once, and a row with a null b for each a of a cut region. ``reps``: rid, n_shingles, signature."""
    spark = reps.sparkSession
    width = 2 * DEPTH
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), F.expr(f"substring(signature, {t * width + 1}, {width})").alias("prefix")) for t in range(TREES)])
    rows = reps.select("rid", "n_shingles", "signature", F.explode(trees).alias("t")).select("t.tree", "t.prefix", "rid", "n_shingles", "signature")
    least = least_alike(share[0] / share[1])

    def run(batches):
        held = None

        def look(rows: pa.Table):
            col = lambda c: rows.column(c).combine_chunks()
            raw = lambda c, w: np.frombuffer(b"".join(col(c).to_pylist()), "<u2").reshape(-1, w)
            tree, prefix, rid = col("tree").to_numpy(), raw("prefix", DEPTH), col("rid").to_numpy()
            signature = np.frombuffer(b"".join(col("signature").to_pylist()), np.uint8).reshape(len(tree), -1)
            sketch = np.ascontiguousarray(signature[:, : 2 * HASHES : 2])  # the low bytes
            parity = np.ascontiguousarray(signature[:, 2 * HASHES :]).view("<u8")
            a, b, first = candidates(tree, prefix, rid, col("n_shingles").to_numpy(), sketch, parity, share, least)
            marked = np.unique(rid[cut_rows(prefix, tree)])
            b = pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(marked), pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, marked]), pa.int64()), b, pa.array(np.concatenate([first, np.zeros(len(marked), bool)]))], ["a", "b", "first"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if held.num_rows < 20_000:
                continue
            # Up to the last region that has begun; a region as long as this is cut, and its last row looked at again.
            tail = held.column("prefix").slice(max(0, held.num_rows - 10_000)).to_pylist()
            back = next((k for k in range(1, len(tail)) if tail[-k - 1][: 2 * BASE] != tail[-1][: 2 * BASE]), None)
            back = back or 1
            yield look(held.slice(0, held.num_rows - back + (back == 1)))
            held = held.slice(held.num_rows - back)
        if held is not None and held.num_rows:
            yield look(held)

    order = ["tree", "prefix", "rid"]
    pairs = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(tidy(run), "a long, b long, first boolean")
    return materialize(pairs.groupBy("a", "b").agg(F.max("first").alias("first")), "forest-pairs")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) with share[1] * intersection >= share[0] * union of the whole sets. ``texts``: doc_id, text, ids unique.

    Each pair carries one text; the other one is sent once for each slot of a, of about 256 pairs.
    """
    spark = pairs.sparkSession
    slots = pairs.groupBy("a").agg(F.ceil(F.count("*") / 256).alias("slots"))
    pairs = pairs.join(slots, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("slots")).alias("slot"))
    theirs = pairs.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "slot", "b", "text")
    heads = texts.withColumnRenamed("doc_id", "a").join(pairs.select("a", "slot").distinct(), "a").select("a", "slot", F.lit(None).cast("long").alias("b"), "text")

    def run(batches):
        a, own = None, None
        for batch in batches:
            left, right, keep = [], [], sets(batch.column("text"), width)
            for x, y, s in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), keep):
                if y is None:
                    a, own = x, s
                    continue
                if x != a:
                    raise RuntimeError("pair without its first text")
                both = len(np.intersect1d(own, s, assume_unique=True))
                if both and share[1] * both >= share[0] * (len(own) + len(s) - both):
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    rows = theirs.unionByName(heads).repartition(shuffle_partitions(spark), "a", "slot").sortWithinPartitions("a", "slot", F.col("b").asc_nulls_first())
    return rows.mapInArrow(tidy(run), "a long, b long")


def rarest(marked: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Written: shingle, rid, class, n (size of the set), upto (of the largest partner that this place leaves room for), sketch, for each set's rarest
    shingles, as many as a partner may not all miss. ``marked``: rid, class, n_shingles, text."""
    spark = marked.sparkSession
    total = marked.agg(F.sum("n_shingles")).first()[0] or 0

    def count(batches):
        for batch in batches:
            for _, part in text_slices(batch.column("text")):
                found = sets(part, width)
                h, n = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["shingle", "n"])

    # Counts over every row. Those above ``most`` are FREQUENT at most; the others tie, and go by their hash. Any order that all sets share is right.
    most = max(8, total // FREQUENT)
    often = marked.select("text").mapInArrow(tidy(count), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") > most).toArrow()
    key = often.column("shingle").to_numpy().view(np.uint64)
    by_key = np.argsort(key)
    known = spark.sparkContext.broadcast((key[by_key], often.column("n").to_numpy()[by_key]))
    part_of, whole = share

    def run(batches):
        keys, times = known.value
        for batch in batches:
            rid, group = batch.column("rid").to_numpy(), batch.column("class").to_numpy()
            for start, part in text_slices(batch.column("text")):
                found = sets(part, width)
                lens = np.array([len(x) for x in found], dtype=np.int64)
                h = np.concatenate([*found, np.zeros(0, np.uint64)])
                row = np.repeat(np.arange(len(found)), lens)
                times_of = np.zeros(len(h), np.int64)
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    times_of = np.where(keys[at] == h, times[at], 0)
                order = np.lexsort((h, times_of, row))
                place = np.arange(len(h)) - np.repeat(np.cumsum(lens) - lens, lens)
                n = lens[row]
                upto = (n - place) * (part_of + whole) // part_of - n
                take = np.flatnonzero(upto * whole >= n * part_of)
                of = start + row[take]
                sketch = pa.array([x.tobytes() for x in parities(row, h, len(found), CROWD)], pa.binary()).take(pa.array(row[take]))
                yield pa.RecordBatch.from_arrays([pa.array(h[order][take].view(np.int64)), pa.array(rid[of]), pa.array(group[of]), pa.array(n[take]), pa.array(upto[take]), sketch], ["shingle", "rid", "class", "n", "upto", "sketch"])

    return materialize(marked.select("rid", "class", "text").mapInArrow(tidy(run), "shingle long, rid long, class long, n long, upto long, sketch binary"), "near-rarest")


def meeting(group: np.ndarray, rid: np.ndarray, kind: np.ndarray, n: np.ndarray, upto: np.ndarray, home: np.ndarray, parity: np.ndarray, share: tuple[int, int], most: int = 200_000):
    """(a, b) of rows of equal ``group`` and different ``kind`` that leave room for each other, also by their sketches; sorted by group and n,
    ``home``: may be the larger."""
    tail = group.astype(np.int64) << np.int64(40)
    x = np.flatnonzero(upto >= n)
    end = np.searchsorted(tail + n, tail[x] + upto[x], side="right")
    x, number = x[end > x + 1], (end - x - 1)[end > x + 1]
    done = np.cumsum(number)
    start = 0
    while start < len(x):
        before = done[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(done, before + most, side="right")))
        i = np.repeat(x[start:stop], number[start:stop])
        j = i + 1 + np.arange(len(i)) - np.repeat(done[start:stop] - number[start:stop] - before, number[start:stop])
        ok = home[j] & (kind[i] != kind[j]) & (upto[j] >= n[i]) & (rid[i] != rid[j])
        i, j = i[ok], j[ok]
        ok = in_reach(parity[i], parity[j], n[i] + n[j], share)
        yield np.minimum(rid[i[ok]], rid[j[ok]]), np.maximum(rid[i[ok]], rid[j[ok]])
        start = stop


def crowd_pairs(marked: DataFrame, width: int, share: tuple[int, int]) -> DataFrame:
    """Written: a, b; every pair of different classes that may reach the threshold, each once. ``marked`` as in ``rarest``."""
    spark = marked.sparkSession
    rows = rarest(marked, width, share)
    keys = rows.groupBy("shingle").agg(F.count("*").alias("rows"), F.min("class").alias("low"), F.max("class").alias("high"), F.max(F.col("upto") >= F.col("n")).alias("least"))
    keys = materialize(keys.filter("low <> high AND least").select("shingle", "rows"), "near-meeting")
    met = hot_split_join(rows, keys, "shingle", "rows", rows.count()).filter("rows IS NOT NULL")
    # Rows that may be the smaller of a pair go to all blocks of their shingle, each row's own block is one of them.
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    met = met.withColumn("block", F.explode(F.when(F.col("upto") >= F.col("n"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own)))).withColumn("home", F.col("block") == own)

    def run(batches):
        def look(t: pa.Table):
            col = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
            shingle, block = col("shingle"), col("block")
            group = np.cumsum(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (block[1:] != block[:-1])])) - 1
            parity = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u8").reshape(t.num_rows, -1)
            for a, b in meeting(group, col("rid"), col("class"), col("n"), col("upto"), col("home").astype(bool), parity, share):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            shingle, block = (held.column(c).to_numpy() for c in ("shingle", "block"))
            last = np.flatnonzero((shingle != shingle[-1]) | (block != block[-1])) if held.num_rows >= 20_000 else []
            if len(last):
                yield from look(held.slice(0, int(last[-1]) + 1))
                held = held.slice(int(last[-1]) + 1)
        if held is not None and held.num_rows:
            yield from look(held)

    met = met.select("shingle", "block", "n", "rid", "class", "upto", "home", "sketch").repartition(shuffle_partitions(spark), "shingle", "block").sortWithinPartitions("shingle", "block", "n")
    return materialize(met.mapInArrow(tidy(run), "a long, b long").distinct(), "near-crowd-pairs")


def near_rows(docs: DataFrame, doc_id: str, text: str, width: int, share: tuple[int, int]) -> DataFrame:
    """doc_id, raw, n_shingles, component_id, kept for every row; kept: its set and doc_id stand for the class."""
    rows = signature_rows(docs, doc_id, text, width)
    linkable = rows.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # One row of each set stands for it, under a key of its own: a doc_id may stand for several sets.
    groups = linkable.groupBy("digest").agg(F.min(F.struct("doc_id", "raw")).alias("head"), F.count("*").alias("n"))
    groups = materialize(groups.select("digest", F.monotonically_increasing_id().alias("rid"), "head.doc_id", "head.raw", "n"), "near-groups")
    reps = linkable.join(groups.select("digest", "rid", "doc_id", "raw"), ["digest", "doc_id", "raw"]).dropDuplicates(["rid"])
    pairs = forest_pairs(reps.select("rid", "n_shingles", "signature"), share)
    crowd = pairs.filter("b IS NULL").select(F.col("a").alias("rid"))
    involved = pairs.select(F.col("a").alias("rid")).unionByName(pairs.filter("b IS NOT NULL").select(F.col("b").alias("rid"))).distinct()
    involved = materialize(involved.join(groups, "rid").select("rid", "doc_id", "raw"), "near-involved")
    n = involved.count()
    texts = keyed(docs, doc_id, text).join(F.broadcast(involved) if n <= BROADCAST_ROWS else involved, ["doc_id", "raw"])
    texts = materialize(texts.select(F.col("rid").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "near-texts")
    first = materialize(confirmed(pairs.filter("first").select("a", "b"), texts, width, share), "near-links")
    known = components(first)
    known = materialize(known, "near-classes")
    ends = pairs.filter("not first AND b IS NOT NULL").select("a", "b")
    for c in ("a", "b"):
        at = known.select(F.col("node").alias(c), F.col("component").alias(f"class_{c}"))
        ends = ends.join(at, c, "left").withColumn(f"class_{c}", F.coalesce(f"class_{c}", c))
    rest = materialize(ends.filter("class_a <> class_b").select("a", "b"), "near-rest")
    more = materialize(confirmed(rest, texts, width, share), "near-more")
    if not more.isEmpty():
        known = materialize(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "near-classes")
    marked = crowd.join(known.select(F.col("node").alias("rid"), F.col("component").alias("class")), "rid", "left").withColumn("class", F.coalesce("class", "rid"))
    marked = marked.join(reps.select("rid", "n_shingles"), "rid").join(texts.withColumnRenamed("doc_id", "rid"), "rid")
    met = crowd_pairs(materialize(marked, "near-crowd"), width, share)
    if not met.isEmpty():
        more = materialize(confirmed(met, texts, width, share), "near-crowd-links")
        known = materialize(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "near-classes")
    named = groups.join(known.select(F.col("node").alias("rid"), "component"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    named = materialize(named.select("component", "digest", "n", "doc_id"), "near-classed")
    heads = named.groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("head"))
    named = named.join(heads, "component").select("digest", "n", F.col("head.doc_id").alias("component_id"), (F.col("digest") == F.col("head.digest")).alias("stands"))
    out = hot_split_join(linkable, materialize(named, "near-named"), "digest", "n", rows.count()).select("doc_id", "raw", "n_shingles", "component_id", (F.col("stands") & (F.col("doc_id") == F.col("component_id"))).alias("kept"))
    alone = rows.filter(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "raw", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; texts link where share[1] * intersection >= share[0] * union."""
    return near_rows(docs, doc_id, text, width, share).select("doc_id", "n_shingles", "component_id", "kept")


def near_query(docs: DataFrame) -> DataFrame:
    """op5: 3-word shingles, Jaccard of 0.85 or more."""
    return near_groups(docs, width=3, share=(85, 100))


def drop_near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, with all its columns."""
    groups = near_rows(docs, doc_id, text, width, share)
    gone = materialize(groups.filter("not kept").select("doc_id", "raw").distinct(), "near-gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("raw"))
    return keep_rows(rows, gone, ["doc_id", "raw"]).select("row.*")
