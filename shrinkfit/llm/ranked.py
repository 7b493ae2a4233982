"""Ranked lexical search over impact vectors in buckets of falling length.

A document is a vector of impacts, one coordinate for each term of the query set, ``(10^9 tf) div (1000 tf + 12 m)``, where m grows with the
document's length; a query is a vector of term weights times repeats. The k documents of the largest inner product are found exactly:

1. One pass over the texts counts every document's terms and keeps the frequencies of the query set's terms; two aggregates give the corpus
   statistics over all documents.
2. The vectors are range-sorted by length, longest first, into buckets. Length is taken with each coordinate scaled by the root of its weight
   (on the query's side as well), which leaves products as they are and makes common terms short.
3. Buckets are searched in rounds: the first one, then about the root of their number, then the rest. Each round starts from the k-th best scores
   found before it. A task goes through its bucket in runs of falling length. Cauchy-Schwarz ends a query's search at the first run whose
   longest vector can't reach its threshold.
4. Inside a run, coordinate bounds (the run's largest impact of each term) tell which terms alone can't lift a document to the threshold:
   only the postings of the others are read, and documents whose partial score plus the rest's bounds falls short go.
5. The survivors are scored exactly in 64-bit integers. Ties are never cut off: bounds below a threshold go, equal ones stay.

The query set is taken in blocks of about ``BLOCK`` bytes of text by a hash (a longer query is a block of its own), so what is broadcast is bounded;
documents are read once for each block.

Nulls: a null text has no terms; a null doc_id takes part and comes last among equal scores. Queries without terms, or all of whose documents score 0,
give no rows. Each row of the query table is a query: rows of one id are ranked apart. Very long texts are used whole. Repeated documents are ranked each. Empty
tables: no rows. Further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .cache import tidy
from .common import byte_lengths, fresh, offsets_of, shuffle_partitions, slices

#: Bytes of query text whose terms are broadcast at once, and documents of a run that are searched together.
BLOCK, RUN = 2 << 20, 8192
#: The ASCII ranges that part terms.
APART = [(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)]

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[ord("A") : ord("Z") + 1] += 32
for _a, _z in APART:
    _BYTES[_a : _z + 1] = ord(" ")


def term_lists(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, terms) of the texts: A-Z lower-cased, cut at the ASCII characters that aren't letters or digits."""
    texts = fresh(texts)
    offs = offsets_of(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offs - offs[0]), pa.py_buffer(_BYTES[data])])
    split = pc.split_pattern(plain, " ")
    ends = offsets_of(split)
    terms = split.values.slice(ends[0], ends[-1] - ends[0])
    full = byte_lengths(terms) > 0
    upto = np.concatenate([[0], np.cumsum(full)])
    return upto[ends - ends[0]], terms.filter(pa.array(full))


def term_rows(docs: DataFrame, number: dict[str, int]) -> DataFrame:
    """doc_id, n (terms of the text), codes and tfs (of the terms in ``number``; null if none) of every row."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        code_of, size = known.value, max(1, len(known.value))
        for batch in batches:
            for part in slices(batch, "text"):
                offs, terms = term_lists(part.column("text"))
                coded = terms.dictionary_encode()
                codes = np.array([code_of.get(x, -1) for x in coded.dictionary.to_pylist()], dtype=np.int64)
                each = codes[coded.indices.to_numpy(zero_copy_only=False)] if len(terms) else np.zeros(0, np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(offs))
                keys, tfs = np.unique((row * size + each)[each >= 0], return_counts=True)
                cuts = np.searchsorted(keys, np.arange(part.num_rows + 1) * size)
                code_bytes, tf_bytes = (keys % size).astype("<i4").tobytes(), tfs.astype("<i4").tobytes()
                spans = [(4 * a, 4 * z) for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                binary = [pa.array([b[a:z] if z > a else None for a, z in spans], pa.binary()) for b in (code_bytes, tf_bytes)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offs), pa.int64()), *binary], ["doc_id", "n", "codes", "tfs"])

    return docs.mapInArrow(tidy(run), "doc_id long, n long, codes binary, tfs binary")


def document_frequencies(rows: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; counted in each task first, so a row per task and term is shuffled."""

    def run(batches):
        df = np.zeros(size, dtype=np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<i4"), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(df[held])], ["code", "df"])

    found = rows.filter("codes IS NOT NULL").select("codes").mapInArrow(run, "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(size, dtype=np.int64)
    out[found.column("code").to_numpy()] = found.column("df").to_numpy()
    return out


def impact_rows(rows: DataFrame, n_docs: int, n_terms: int, weight: np.ndarray) -> DataFrame:
    """doc_id, length, codes, impacts of the documents that hold a term of some weight."""
    sent = rows.sparkSession.sparkContext.broadcast(weight)

    def run(batches):
        w = sent.value
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<i4")
            tf = np.frombuffer(b"".join(batch.column("tfs").to_pylist()), "<i4").astype(np.int64)
            lens = byte_lengths(batch.column("codes")) // 4
            m = 75 + (25 * n_docs * batch.column("n").to_numpy().astype(np.int64)) // n_terms
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, lens))
            starts = np.cumsum(lens) - lens
            square = np.add.reduceat(w[codes] * (impact.astype(np.float64) ** 2), starts) if len(starts) else np.zeros(0)
            data = impact.astype("<i4").tobytes()
            packed = pa.array([data[4 * a : 4 * z] for a, z in zip(starts.tolist(), (starts + lens).tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.sqrt(square)), batch.column("codes"), packed], ["doc_id", "length", "codes", "impacts"])

    return rows.filter("codes IS NOT NULL").mapInArrow(tidy(run), "doc_id long, length double, codes binary, impacts binary").filter("length > 0")


class Best:
    """The k best (score, ids in ascending order) of one query so far."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, max(least, 1)
        self.score, self.doc, self.absent = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, absent: np.ndarray) -> None:
        score, doc, absent = (np.concatenate(x) for x in ((self.score, score), (self.doc, doc), (self.absent, absent)))
        order = np.lexsort((doc, absent, -score))[: self.k]
        self.score, self.doc, self.absent = score[order], doc[order], absent[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


class Run:
    """Vectors of similar length as postings: for each term the rows that hold it, their impacts and the largest of these."""

    def __init__(self, codes: np.ndarray, impacts: np.ndarray, lens: np.ndarray):
        row = np.repeat(np.arange(len(lens)), lens)
        order = np.argsort(codes, kind="stable")
        self.rows, self.impacts, sorted_codes = row[order], impacts[order].astype(np.int64), codes[order]
        self.terms, starts = np.unique(sorted_codes, return_index=True)
        self.cuts = np.concatenate([starts, [len(codes)]])
        self.most = np.maximum.reduceat(self.impacts, starts) if len(starts) else np.zeros(0, np.int64)
        self.size = len(lens)

    def reach(self, terms: np.ndarray, weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the rows that score ``least`` or more."""
        at = np.searchsorted(self.terms, terms)
        here = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)
        at, weights = at[here], weights[here]
        bound = weights * self.most[at]
        order = np.argsort(bound)
        at, weights, upto = at[order], weights[order], np.cumsum(bound[order])
        first = int(np.searchsorted(upto, least))  # terms before it can't reach ``least`` together
        if first == len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rest = int(upto[first - 1]) if first else 0
        score = np.zeros(self.size, np.int64)
        for k in range(first, len(at)):
            a, z = self.cuts[at[k]], self.cuts[at[k] + 1]
            score[self.rows[a:z]] += weights[k] * self.impacts[a:z]
        rows = np.flatnonzero((score > 0) & (score + rest >= least))
        exact = score[rows]
        for k in range(first if len(rows) else 0):
            a, z = self.cuts[at[k]], self.cuts[at[k] + 1]
            place = np.minimum(np.searchsorted(self.rows[a:z], rows), z - a - 1)
            exact += np.where(self.rows[a:z][place] == rows, weights[k] * self.impacts[a:z][place], 0)
        hit = exact >= least
        return rows[hit], exact[hit]


def search_bucket(batches, queries: list[tuple[int, np.ndarray, np.ndarray, float]], thresholds: dict[int, int], k: int):
    """The best rows of a bucket's vectors, which come longest first: (query, doc_id, score) batches."""
    best = {q: Best(k, thresholds.get(q, 0)) for q, *_ in queries}
    live = list(queries)
    for batch in batches:
        for start in range(0, batch.num_rows, RUN):
            part = batch.slice(start, RUN)
            longest = float(part.column("length")[0].as_py())
            # Lengths are rounded numbers; the slack keeps the bound safe.
            live = [x for x in live if x[3] * longest * (1 + 1e-9) >= best[x[0]].least]
            if not live:
                break
            codes, impacts = (np.frombuffer(b"".join(part.column(c).to_pylist()), "<i4") for c in ("codes", "impacts"))
            run = Run(codes, impacts, byte_lengths(part.column("codes")) // 4)
            absent = part.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            for q, terms, weights, _ in live:
                rows, score = run.reach(terms, weights, best[q].least)
                if len(rows):
                    best[q].add(score, doc[rows], absent[rows])
    for q, found in best.items():
        if len(found.score):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found.score), q), pa.int64()), pa.array(found.doc, mask=found.absent), pa.array(found.score)], ["query", "doc_id", "score"])


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame | None:
    """query (place in ``texts``), rank, doc_id, score. ``docs``: doc_id, text."""
    spark = docs.sparkSession
    offs, terms = term_lists(pa.array(texts, pa.string()))
    words = terms.to_pylist()
    number = {x: i for i, x in enumerate(dict.fromkeys(words))}
    if not number:
        return None
    rows = materialize(term_rows(docs, number), "rank-terms")
    n_docs, n_terms = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not n_docs:
        return None
    df = document_frequencies(rows, len(number)).tolist()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) if x else 0 for x in df], dtype=np.int64)
    queries = []
    for q, (a, z) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        count = Counter(number[x] for x in words[a:z])
        own = np.array(sorted(t for t in count if weight[t]), dtype=np.int64)
        if len(own):
            times = np.array([count[t] for t in own.tolist()], dtype=np.int64)
            queries.append((q, own, weight[own] * times, math.sqrt(float((weight[own] * times.astype(np.float64) ** 2).sum()))))
    if not queries:
        return None
    parts = shuffle_partitions(spark)
    order = [F.col("length").desc(), F.col("doc_id")]
    vectors = materialize(impact_rows(rows, n_docs, n_terms, weight), "rank-vectors")
    # A bucket is a file, so the statistics of its row groups keep a round to its own buckets.
    buckets = vectors.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("bucket", F.spark_partition_id())
    buckets = materialize(buckets, "rank-buckets")
    number_of = sorted(r.bucket for r in buckets.select("bucket").distinct().collect())  # a row per bucket
    rounds = [1, math.isqrt(len(number_of)), len(number_of)]
    best, done, thresholds = None, 0, {}
    for upto in rounds:
        own, done = number_of[done : done + upto], done + upto
        if not own:
            break
        sent = spark.sparkContext.broadcast((queries, thresholds))

        def run(batches):
            yield from search_bucket(batches, *sent.value, k)

        chosen = buckets.filter(F.col("bucket").between(own[0], own[-1]))
        found = chosen.select("doc_id", "length", "codes", "impacts").sortWithinPartitions(F.col("length").desc()).mapInArrow(tidy(run), "query long, doc_id long, score long")
        both = found if best is None else found.unionByName(best.select("query", "doc_id", "score"))
        best = materialize(best_of(both, k), "rank-best")
        # At most one number for each query of the block.
        thresholds = {r.query: r.score for r in best.filter(F.col("rank") == k).select("query", "score").collect()}
    return best


def ranked_search(docs: DataFrame, items: DataFrame, *, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents of a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = 1 + total // BLOCK
    out = None
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        found = search_block(docs, [r.text for r in own], k)
        if found is None:
            continue
        ids = spark.createDataFrame([(q, r.item_id) for q, r in enumerate(own)], "query long, item_id long")
        found = found.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def ranked_query(docs: DataFrame, items: DataFrame) -> DataFrame:
    """op12: the 20 best documents of every benchmark item."""
    return ranked_search(docs, items)


RANKED_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT r, doc_id, unnest(terms) AS term FROM d),
tf AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
size AS (SELECT r, count(*) AS n FROM t GROUP BY r),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, total GROUP BY term, docs),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
need AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
scored AS (
  SELECT item_id, r, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // total.terms))))) AS BIGINT) AS score
  FROM need JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (r), total
  GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 20
"""
