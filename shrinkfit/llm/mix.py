"""Mixing sources to target weights by hash-threshold histograms, DataFrame operations only.

Every document has a 36-bit hash of its id and text. Words are summed by source and by the hash's upper 12
bits; the running sum finds, for each source, the bucket in which its budget is used up. Only that
bucket is summed again by the next 12 bits, and once more by the last ones, so the threshold ends
between two documents, and each document is taken or not by comparing its hash with its source's threshold:
nothing is sorted but a source's 4,096 buckets. A source whose target is above its size is taken whole as often as it
goes in, and the rest is the budget. Smaller budgets take subsets of what larger ones take.

The table of sources (a row each) is ordered in one task to deal the weights; documents are only aggregated by
(source, bucket) with partial sums, so a source with a third of all rows is summed where it is read.

Nulls: a null text has size 0 and hashes as an empty one; a null source is a source, ordered last; a null doc_id hashes as empty text. Ties and repeated
rows: rows of one doc_id with different texts are taken apart, rows equal in both share their hash and are taken together. An empty text has size 0 and takes part without
effect. Empty table: no rows. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import BROADCAST_ROWS

WHITE = r"[\x20\x09-\x0D]"
BITS, LEVELS = 12, 3
#: Hex digits of the hash: BITS * LEVELS bits.
DIGITS = BITS * LEVELS // 4


def word_count(text):
    """Number of runs of [^\\x20\\x09-\\x0D]; null: 0."""
    edges = F.when(text.rlike(f"^{WHITE}"), 1).otherwise(0) + F.when(text.rlike(rf"{WHITE}\z"), 1).otherwise(0)
    return F.coalesce(F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(text, f"{WHITE}+")) - edges), F.lit(0)).cast("long")


def hashed(doc_id, text):
    """Of the id and the text: an id that a third of the rows share doesn't make them one lump."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, DIGITS), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size, target from (source, source_size): weights dealt in turn, no target above ``most`` times its source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    deal = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", deal).withColumn("most", F.col("source_size").cast("double") * most)
    # Water level: with the sources in the order in which they fill up, what is left over what is open; the highest one holds.
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("most").over(rising), F.lit(0.0))
    still = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))
    rows = rows.withColumn("level", left / still)
    rows = rows.withColumn("level", F.max("level").over(whole))
    return rows.select("source", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def thresholds(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, copies (of every document), threshold (one more below it)."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    bounds = targets.withColumn("copies", full).withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    bounds = materialize(bounds.withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")), "mix-targets")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = docs
        if level:
            at = bounds.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            inside = small_join(docs, at, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("hash", shift + BITS) == F.col("p")), "left_semi")
        cells = inside.groupBy("source", F.shiftright("hash", shift).alias("cell")).agg(F.sum("size").alias("words"))
        cells = cells.select(F.col("source").alias("s"), "cell", "words", F.sum("words").over(Window.partitionBy("source").orderBy("cell")).alias("upto"))
        found = bounds.join(cells, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("upto", F.col("below") + F.col("upto"))
        # The first cell that uses the budget up; none where nothing is to be taken.
        hit = F.when((F.col("upto") >= F.col("budget")) & (F.col("budget") > 0), F.struct("cell", (F.col("upto") - F.col("words")).alias("before"), F.col("upto").alias("after")))
        keys = ["source", "source_size", "target", "copies", "budget"]
        bounds = found.groupBy(*keys).agg(F.min(hit).alias("hit"))
        bounds = bounds.select(*keys, F.coalesce("hit.cell", F.lit(-1).cast("long")).alias("prefix"), F.coalesce("hit.before", F.lit(0).cast("long")).alias("below"), F.col("hit.after").alias("after"))
        bounds = materialize(bounds, f"mix-level{level}")
    nearer = (F.col("after") - F.col("budget")) < (F.col("budget") - F.col("below"))
    return bounds.select("source", "source_size", "target", "copies", F.when(F.col("prefix") < 0, 0).when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("threshold"))


def small_join(rows: DataFrame, by_source: DataFrame, on, how: str) -> DataFrame:
    """Join with a table of a row per source: a broadcast up to a counted bound, a shuffle beyond."""
    return rows.join(F.broadcast(by_source) if by_source.count() <= BROADCAST_ROWS else by_source, on, how)


def plan_mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> tuple[DataFrame, DataFrame]:
    """A written table (doc_id, source, size, hash), and the sources' thresholds."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hashed(F.col(doc_id), F.col(text)).alias("hash"))
    narrow = materialize(narrow, "mix-sizes")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    return narrow, thresholds(narrow, source_targets(sizes, weights, most))


def taken(hash_col, bounds_copies="copies"):
    return F.col(bounds_copies) + F.when(hash_col < F.col("threshold"), 1).otherwise(0)


def mix_query(docs: DataFrame) -> DataFrame:
    """op8: doc_id, size, source_size, target, taken."""
    narrow, bounds = plan_mix(docs)
    at = bounds.withColumnRenamed("source", "s")
    rows = small_join(narrow, at, F.col("source").eqNullSafe(F.col("s")), "inner")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * taken(F.col("hash"))).alias("taken"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns."""
    _, bounds = plan_mix(docs, doc_id=doc_id, text=text, source=source, weights=weights, most=most)
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), hashed(F.col(doc_id), F.col(text)).alias("hash"))
    at = bounds.select(F.col("source").alias("s"), "copies", "threshold")
    rows = small_join(rows, at, F.col("source").eqNullSafe(F.col("s")), "inner")
    n = taken(F.col("hash")).cast("int")
    return rows.filter(n > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), n))).select("row.*")


#: DuckDB SQL for op8: the same rule by sorting, without histograms.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 9))::BIGINT AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size::DOUBLE * 3 AS most FROM s),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(most) OVER w, 0.0)) / (sum(weight) OVER ()::DOUBLE - coalesce(sum(weight) OVER w, 0)::DOUBLE) AS level
      FROM r WINDOW w AS (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, max(level) OVER () * weight) AS target FROM l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t),
c AS (SELECT source, hash, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY hash) AS upto FROM d GROUP BY source, hash),
h AS (SELECT b.source, b.source_size, b.target, b.copies, c.hash, c.upto, c.upto - c.words AS before, b.target - b.copies * b.source_size AS budget
      FROM b JOIN c ON b.source IS NOT DISTINCT FROM c.source),
x AS (SELECT source, min(CASE WHEN upto >= budget AND budget > 0 THEN hash END) AS cell FROM h GROUP BY source),
y AS (SELECT h.source, CASE WHEN h.upto - h.budget < h.budget - h.before THEN h.hash + 1 ELSE h.hash END AS threshold
      FROM h JOIN x ON h.source IS NOT DISTINCT FROM x.source AND h.hash = x.cell)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.copies + CASE WHEN d.hash < coalesce(y.threshold, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN y ON d.source IS NOT DISTINCT FROM y.source
"""
