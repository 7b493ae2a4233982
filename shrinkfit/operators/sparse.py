"""Correlated pairs of multi-label features from sparse counts (A9, C5, P8), and which labels to leave out.

The rows' labels are never made into columns. Per distinct label string there are
a row count and a residual sum; exploding its few labels and pairs of labels gives
every Σx, Σx² and Σxy in two group-bys, exactly in integers. A pair that never
occurs together has Σxy = 0 and r = −q_a·q_b with q = Σx/√(n·Σx² − (Σx)²), so it passes a threshold t
only if one of the two has q > √t; such labels are in more than t/(1+t) of the
rows, so there are at most (1+t)/t · (mean labels a row) of them. They alone reach
the driver, and no k×k table is built anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import genre_tokens
from ..session import materialize
from ..sources.tables import NO_GENRE

PAIRS_SCHEMA = "a string, b string, r double"
#: Correlations are compared in these units (integers), so that ties don't hang on the order of a sum.
R_UNIT = 1_000_000


def _exact(c):
    return F.col(c).cast("decimal(18,0)")


def _spread(n, sq, s):
    """n·Σx² − (Σx)², exactly."""
    return (n.cast("decimal(18,0)") * _exact(sq) - _exact(s) * _exact(s)).cast("double")


def sparse_correlated_pairs(df: DataFrame, threshold: float, genres_col: str = "genres", value_col: str = "rating",
                            value_name: str = "rating") -> DataFrame:
    """(a, b, r) with ``|r| > threshold``: pairs of labels, a before b, and (value_name, label).

    x is how often a row's list holds the label; NULL, '' and the no-genre marker are no labels. A constant feature correlates with
    nothing; neither does the value column if it holds a NULL or NaN. An empty table has no pairs. The threshold must be positive.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 asks for all pairs: use correlation_matrix")
    spark = df.sparkSession
    value = F.col(value_col).cast("double")
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.count_if(value.isNull() | F.isnan(value)).alias("bad"),
                   (F.min(value) == F.max(value)).alias("constant")).first()
    if not whole["n"]:
        return spark.createDataFrame([], PAIRS_SCHEMA)
    n, usable = F.lit(whole["n"]).cast("long"), not whole["bad"] and not whole["constant"]
    centred = value - F.lit(whole["mean"]) if usable else F.lit(0.0)
    lists = df.groupBy(F.col(genres_col).alias("g")).agg(F.count(F.lit(1)).alias("w"), F.sum(centred).alias("y"), F.sum(centred * centred).alias("yy"))
    tokens = genre_tokens("g")
    counts = F.transform(F.array_sort(F.filter(F.array_distinct(tokens), lambda t: (t != F.lit("")) & (t != F.lit(NO_GENRE)))),
                         lambda t: F.struct(t.alias("t"), F.size(F.filter(tokens, lambda u: u == t)).alias("x")))
    lists = materialize(lists.select("w", "y", "yy", counts.alias("c")), "label-lists")
    one = lists.select("w", "y", F.explode("c").alias("e")).groupBy(F.col("e.t").alias("t")).agg(
        F.sum(F.col("w") * F.col("e.x")).alias("s"), F.sum(F.col("w") * F.col("e.x") * F.col("e.x")).alias("sq"), F.sum(F.col("y") * F.col("e.x")).alias("sy"))
    one = one.withColumn("v", _spread(n, "sq", "s")).where("v > 0")
    one = materialize(one.withColumn("q", F.col("s") / F.sqrt("v")), "label-sums")
    pairs = (lists.select("w", "c", F.posexplode("c").alias("i", "p")).select("w", "p", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("o"))
             .groupBy(F.col("p.t").alias("a"), F.col("o.t").alias("b")).agg(F.sum(F.col("w") * F.col("p.x") * F.col("o.x")).alias("sab")))
    together = (pairs.join(one.select(F.col("t").alias("a"), F.col("s").alias("sa"), F.col("v").alias("va")), "a")
                .join(one.select(F.col("t").alias("b"), F.col("s").alias("sb"), F.col("v").alias("vb")), "b"))
    cov = (n.cast("decimal(18,0)") * _exact("sab") - _exact("sa") * _exact("sb")).cast("double")
    together = together.select("a", "b", (cov / (F.sqrt("va") * F.sqrt("vb"))).alias("r"))
    out = together.where(F.abs("r") > threshold)
    frequent = one.where(F.col("q") * F.col("q") > threshold).select("t", "q").collect()    # bounded, see above
    if frequent:
        held = F.array(*[F.struct(F.lit(f["t"]).alias("t"), F.lit(f["q"]).alias("q")) for f in frequent])
        met = F.explode(F.filter(held, lambda f: (f["t"] != F.col("t")) & (f["q"] * F.col("q") > threshold)
                                 & ((F.col("q") * F.col("q") <= threshold) | (F.col("t") < f["t"]))))
        apart = one.select("t", "q", met.alias("f")).select(F.least("t", "f.t").alias("a"), F.greatest("t", "f.t").alias("b"),
                                                            (-F.col("q") * F.col("f.q")).alias("r"))
        out = out.unionByName(apart.join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    if usable:
        yy = lists.agg(F.sum("yy")).first()[0]
        r = F.col("sy") * F.sqrt(n.cast("double")) / (F.sqrt("v") * F.lit(float(yy) ** 0.5))
        out = out.unionByName(one.select(F.lit(value_name).alias("a"), F.col("t").alias("b"), r.alias("r")).where(F.abs("r") > threshold))
    return out


def exclude_correlated(pairs: DataFrame) -> DataFrame:
    """(label, round, mean_r): labels to leave out, so that no pair of ``pairs`` (a, b, r) is left.

    Each round, every label whose mean |r| over its remaining pairs is larger than that of all labels it is paired with
    leaves (ties: more pairs, then the greater name); rounds go on while pairs remain. Neighbours never leave in the same
    round. Each round is two joins over the remaining pairs, written, so lineage doesn't grow. |r| counts in millionths.
    """
    edges = materialize(pairs.select("a", "b", F.round(F.abs("r") * R_UNIT).cast("long").alias("m")), "pair-round")
    left, step = None, 0
    while not edges.isEmpty():
        step += 1
        ends = edges.select(F.col("a").alias("label"), "m").unionByName(edges.select(F.col("b").alias("label"), "m"))
        rank = ends.groupBy("label").agg(F.sum("m").alias("s"), F.count(F.lit(1)).alias("k"))
        rank = rank.select("label", F.struct(F.floor(F.col("s") / F.col("k")).alias("mean"), "k", "label").alias("o"))
        ranked = (edges.join(rank.select(F.col("label").alias("a"), F.col("o").alias("oa")), "a")
                  .join(rank.select(F.col("label").alias("b"), F.col("o").alias("ob")), "b"))
        beaten = ranked.select(F.when(F.col("oa") < F.col("ob"), F.col("a")).otherwise(F.col("b")).alias("label")).distinct()
        leaves = materialize(rank.join(beaten, "label", "left_anti").select(
            "label", F.lit(step).alias("round"), (F.col("o.mean") / R_UNIT).alias("mean_r")), "pair-leaves")
        edges = (edges.join(leaves.select(F.col("label").alias("a")), "a", "left_anti")
                 .join(leaves.select(F.col("label").alias("b")), "b", "left_anti"))
        edges = materialize(edges.select("a", "b", "m"), "pair-round")
        left = leaves if left is None else left.unionByName(leaves)
    return left if left is not None else pairs.sparkSession.createDataFrame([], "label string, round int, mean_r double")
