"""Collocations: phrases of two or three words that are frequent for their parts, counted by a multikey quicksort of suffixes.

1. Every word begins a suffix; to the greatest depth (three words, or to its piece's end) it is a window of words. A slice of texts is
   coded by its own words, equal windows are counted together, and what is left is routed by the leading words: ranges of windows, in order, with
   boundaries from a sample (it decides balance only). So a word or a pair that begins a third of all windows is dealt over many ranges. A
   range's windows of a slice travel as one row: their words, three numbers each, and counts.
2. A range's task sorts pointers to its windows by three-way partitioning, all partitions at once: each takes a pivot among its
   words at its depth and splits into less, equal and more. The weight of an equal partition is the count of its phrase; it goes on with the next word.
   Partitions of less weight than ``least`` are abandoned at once: no phrase in them can be frequent.
3. Only the leading words of a range's own boundaries may be shared with other ranges. Their counts are given out whatever they are, and summed.
4. Cuts, scores and containment are joins over the frequent phrases, exact in 38-digit decimals.

Nulls: a null text is empty, a null language is ``und``; doc_id is not read. Very long texts are used whole; a slice holds one text at least. Ties: equal
scores by count, then by the phrase's bytes. Repeated rows count each time. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .cache import tidy
from .common import fresh, offsets_of, shuffle_partitions, slices

DEPTH = 3
#: Bytes of text for each range, ranges at most, and sampled windows at most.
RANGE, RANGES, SAMPLE = 8 << 20, 1_000_000, 1_000_000
#: Windows of a range from which equal ones are put together.
GATHER = 4_000_000
#: What ends a piece, and what parts words.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
_BYTES[list(ENDS)], _BYTES[list(BLANKS)] = ENDS[0], BLANKS[0]


def word_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(codes, begins, words): every word's number among the sorted different ``words``, from 1, and whether it begins a piece."""
    texts = fresh(texts)
    offs = offsets_of(texts)
    data = _BYTES[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]]
    offs = offs - offs[0]
    inside = (data != ENDS[0]) & (data != BLANKS[0])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][np.diff(offs) > 0]
    first[heads] = inside[heads]
    at = np.flatnonzero(first)
    upto = np.concatenate([[0], np.cumsum(inside)])
    words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.concatenate([upto[at], upto[-1:]]).astype(np.int64)), pa.py_buffer(data[inside])])
    ended = data == ENDS[0]
    piece = np.cumsum(ended)[at] if len(at) else np.zeros(0, np.int64)
    row = np.searchsorted(offs, at, side="right")
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    codes = rank[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64)
    return codes, begins, coded.dictionary.take(pa.array(order)).to_pylist()


def windows(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """[words, DEPTH]: each word and those after it in its piece, 0 past the piece's end."""
    out = np.zeros((len(codes), DEPTH), dtype=np.int64)
    going = np.ones(len(codes), dtype=bool)
    for k in range(DEPTH):
        out[: len(codes) - k, k] = np.where(going[: len(codes) - k], codes[k:], 0)
        if k + 1 < DEPTH:
            more = np.zeros(len(codes), dtype=bool)
            more[: len(codes) - k - 1] = ~begins[k + 1 :]
            going &= more
    return out


def put_together(rows: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The different windows in order, and the weight of each (its number, if none is given)."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    lead = rows[:, 0] << np.int64(32) | rows[:, 1]
    order = np.lexsort((rows[:, 2], lead))
    lead, tail = lead[order], rows[order, 2]
    starts = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (tail[1:] != tail[:-1])]))
    total = np.diff(np.concatenate([starts, [len(rows)]])) if weight is None else np.add.reduceat(weight[order], starts)
    return rows[order[starts]], total


def place(rows: np.ndarray, words: list[str], bound: tuple[str, ...]) -> int:
    """How many of the sorted windows come before the boundary."""
    lo, hi = 0, len(rows)
    for k, word in enumerate(bound):
        if word == "":
            return lo  # the windows that end here come first
        i = bisect_left(words, word)
        column = rows[lo:hi, k]
        if i == len(words) or words[i] != word:
            return lo + int(np.searchsorted(column, i + 1))
        lo, hi = lo + int(np.searchsorted(column, i + 1)), lo + int(np.searchsorted(column, i + 2))
    return lo


def narrow(values: np.ndarray) -> tuple[int, bytes]:
    """Bytes of a number, and the numbers in as few bytes as hold the largest."""
    width = 1 if not len(values) or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 4 if values.max() < 1 << 32 else 8
    return width, values.astype(f"<u{width}").tobytes()


def by_language(batch: pa.RecordBatch):
    """(language, texts) of each slice of the batch."""
    for part in slices(batch, "text"):
        for lang in pc.unique(part.column("lang")).to_pylist():
            yield lang, part.column("text").filter(pc.equal(part.column("lang"), lang))


def sampled_bounds(docs: DataFrame, size: int, ranges: int) -> list[tuple[str, ...]]:
    """Boundaries (language, words) between about equal ranges of all windows, from a sample of at most about ``SAMPLE``."""
    target = min(SAMPLE, 100 * ranges)
    share = min(1.0, target * 200 / max(1, size))
    keep = min(1.0, target * 6 / max(1.0, share * size))

    def run(batches):
        chance = np.random.default_rng(13)
        for batch in batches:
            for lang, texts in by_language(batch):
                codes, begins, words = word_runs(texts)
                rows = windows(codes, begins)
                rows = rows[chance.random(len(rows)) < keep]
                shown = [" ".join(words[c - 1] for c in row if c) for row in rows.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(shown), pa.string()), pa.array(shown, pa.string())], ["lang", "words"])

    some = docs.sample(share, seed=13) if share < 1 else docs
    found = some.mapInArrow(tidy(run), "lang string, words string").toArrow()
    keys = sorted((a, *(b.split(" ") + [""] * DEPTH)[:DEPTH]) for a, b in zip(found.column("lang").to_pylist(), found.column("words").to_pylist()))
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def routed(docs: DataFrame, bounds: list[tuple[str, ...]]) -> DataFrame:
    """Rows of windows: range, lang, words (space-joined), width, codes, count_width, counts."""
    sent = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches):
        bounds = sent.value
        langs = [b[0] for b in bounds]
        for batch in batches:
            for lang, texts in by_language(batch):
                codes, begins, words = word_runs(texts)
                rows, weight = put_together(windows(codes, begins))
                lo, hi = bisect_left(langs, lang), bisect_left(langs, lang + "\0")
                cuts = [0, *(place(rows, words, b[1:]) for b in bounds[lo:hi]), len(rows)]
                out = []
                for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if z > a:
                        own, inverse = np.unique(rows[a:z], return_inverse=True)
                        shift = int(own[0] != 0)  # 0 stays the end
                        used = own[1 - shift :].tolist()
                        out.append((lo + k, lang, " ".join([words[c - 1] for c in used]), *narrow(inverse.reshape(-1) + shift), *narrow(weight[a:z])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), KINDS)], NAMES) if out else pa.RecordBatch.from_arrays([pa.array([], t) for t in KINDS], NAMES)

    return docs.mapInArrow(tidy(run), "range int, lang string, words string, width int, codes binary, count_width int, counts binary")


NAMES = ["range", "lang", "words", "width", "codes", "count_width", "counts"]
KINDS = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]


def quicksort_counts(rows: np.ndarray, weight: np.ndarray, least: int):
    """(depth, pointers, counts) of the phrases of ``least`` or more: the first ``depth`` words of the windows pointed to.

    Three-way partitioning of pointers on the word at each partition's depth, in rounds over all partitions.
    """
    chance = np.random.default_rng(len(rows))
    columns = np.ascontiguousarray(rows.T)
    p, lens, depth = np.arange(len(rows)), np.array([len(rows)]), np.zeros(1, dtype=np.int64)
    if not len(rows):
        return
    while len(lens):
        starts = np.cumsum(lens) - lens
        s = np.repeat(np.arange(len(lens)), lens)
        key = columns[depth[s], p]
        chosen = starts + (chance.random(len(lens)) * lens).astype(np.int64)
        pivot = key[chosen]
        side = (key >= pivot[s]).astype(np.int64) + (key > pivot[s])  # 0 less, 1 equal, 2 more
        group = 3 * s + side
        size = np.bincount(group, minlength=3 * len(lens))
        total = np.zeros(3 * len(lens), dtype=np.int64)
        np.add.at(total, group, weight[p])
        equal = total[1::3]
        hit = np.flatnonzero((equal >= least) & (pivot > 0))
        for d in range(DEPTH):
            of = hit[depth[hit] == d]
            if len(of):
                yield d + 1, p[chosen[of]], equal[of]
        keep = total >= least
        keep[1::3] &= (pivot > 0) & (depth + 1 < DEPTH)
        # Kept pointers move to their group's place, in order.
        new = np.cumsum(np.where(keep, size, 0)) - np.where(keep, size, 0)
        moved = np.empty(int(size[keep].sum()), dtype=np.int64)
        for k in range(3):
            own = np.flatnonzero((side == k) & keep[group])
            n = np.where(keep[k::3], size[k::3], 0)
            moved[new[group[own]] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)] = p[own]
        p, held = moved, np.flatnonzero(keep & (size > 0))
        lens, depth = size[held], depth[held // 3] + (held % 3 == 1)


class Gathered:
    """The windows of one range and language, with numbers for the words of all its rows."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, GATHER

    def add(self, words: str, width: int, codes: bytes, count_width: int, counts: bytes) -> None:
        number = self.number
        of = np.array([0, *(number.setdefault(x, len(number) + 1) for x in words.split(" "))], dtype=np.int64)
        rows = of[np.frombuffer(codes, f"<u{width}").reshape(-1, DEPTH)]
        self.parts.append((rows.astype(np.int32), np.frombuffer(counts, f"<u{count_width}").astype(np.int64)))
        self.size += len(rows)
        if self.size > self.limit:
            rows, weight = put_together(*self.all())
            self.parts, self.size = [(rows.astype(np.int32), weight)], len(rows)
            self.limit = max(GATHER, 2 * self.size)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([x for x, _ in self.parts]).astype(np.int64), np.concatenate([x for _, x in self.parts])

    def counts(self, least: int, edges: set[tuple[str, ...]]):
        """(phrase or None for all words, count): frequent phrases, and the edges whatever their counts."""
        rows, weight = self.all()
        names = ["", *self.number]
        yield None, 0, int(weight.sum())
        for edge in edges:
            if all(x in self.number for x in edge):
                here = np.logical_and.reduce([rows[:, k] == self.number[x] for k, x in enumerate(edge)])
                if n := int(weight[here].sum()):
                    yield " ".join(edge), len(edge), n
        for depth, at, n in quicksort_counts(rows, weight, least):
            for row, m in zip(rows[at, :depth].tolist(), n.tolist()):
                phrase = tuple(names[c] for c in row)
                if phrase not in edges:
                    yield " ".join(phrase), depth, m


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """Written: lang, phrase, words, f of every phrase of ``least`` or more; words = 0, phrase null: all words of the language. ``docs``: lang, text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = shuffle_partitions(spark)
    bounds = sampled_bounds(docs, size, int(min(RANGES, max(tasks, size // RANGE + 1))))
    sent, ranges = spark.sparkContext.broadcast(bounds), len(bounds) + 1

    def run(batches):
        bounds, at, held = sent.value, None, None

        def done():
            edges = {b[1 : 1 + n] for b in bounds[max(0, at[0] - 1) : at[0] + 1] if b[0] == at[1] for n in range(1, DEPTH + 1)}
            edges = {e for e in edges if "" not in e}
            found = list(held.counts(least, edges))
            return pa.RecordBatch.from_arrays([pa.array([at[1]] * len(found), pa.string()), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int64())], ["lang", "phrase", "words", "f"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in NAMES]
            for r, lang, *row in zip(*columns):
                if (r, lang) != at:
                    if at is not None:
                        yield done()
                    at, held = (r, lang), Gathered()
                held.add(*row)
        if at is not None:
            yield done()

    # Neighbouring ranges to one task, which takes them one after the other.
    task = (F.col("range").cast("long") * F.lit(tasks) / F.lit(ranges)).cast("int")
    dealt = routed(docs, bounds).repartitionById(tasks, task).sortWithinPartitions("range", "lang")
    partial = dealt.mapInArrow(tidy(run), "lang string, phrase string, words int, f long")
    total = partial.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter((F.col("f") >= least) | F.col("phrase").isNull())
    return materialize(total, "phrase-counts")


def collocations(docs: DataFrame, *, least: int = 10, top: int = 2000, cover: tuple[int, int] = (50, 100), lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``top`` phrases.

    A phrase goes if a longer one that holds it has ``cover[0] / cover[1]`` of its occurrences or more."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counts = phrase_counts(docs, least)
    known = counts.filter("words > 0").select("lang", "phrase", "f")
    found = counts.filter("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # Every cut of every candidate, with the counts of both sides: a part is at least as frequent as the whole, so it is known.
    cut = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cut = cut.withColumn("first", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " "))
    for side, name in (("first", "l"), ("rest", "r")):
        cut = cut.join(known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    whole = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "l", "r")}
    score = F.expr("CAST((CAST(1000000 AS DECIMAL(7,0)) * wide_a) div wide_lr AS BIGINT)")
    cut = cut.withColumn("wide_a", whole["a"] * whole["a"]).withColumn("wide_lr", whole["l"] * whole["r"]).withColumn("score", score)
    lowest = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("cut"))
    # The shorter phrases inside each candidate, and the most frequent candidate that holds each.
    inner = found.filter(F.size("w") > 2).withColumn("phrase", F.explode(F.array(*[F.array_join(F.slice("w", k, DEPTH - 1), " ") for k in (1, 2)])))
    holder = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = lowest.join(holder, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (cover[1] * F.col("longer") < cover[0] * F.col("cut.a")))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("cut.a").desc(), F.col("phrase"))
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    n = counts.filter("phrase IS NULL").select("lang", F.col("f").alias("n"))
    return rows.join(n, "lang").select("lang", "rank", "phrase", *[F.col(f"cut.{c}").alias(c) for c in ("a", "l", "r")], "n", F.col("cut.score").alias("score"))


PHRASES_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
piece AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
every AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w WHERE len(w) >= 2
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM w WHERE len(w) >= 3),
f AS (SELECT lang, words, phrase, count(*) AS f FROM every GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
candidate AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= 10),
cut AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS first, array_to_string(w[2:], ' ') AS rest FROM candidate
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidate WHERE words = 3),
scored AS (
  SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = cut.first JOIN f AS y ON y.lang = cut.lang AND y.phrase = cut.rest),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
holder AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidate WHERE words = 3
        UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidate WHERE words = 3) GROUP BY ALL),
ranked AS (
  SELECT s.lang, s.phrase, s.a, s.l, s.r, s.score, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank
  FROM lowest AS s LEFT JOIN holder AS h ON h.lang = s.lang AND h.phrase = s.phrase
  WHERE h.longer IS NULL OR 100 * h.longer < 50 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
