"""Connected components of a large edge list, by alternating stars with written intermediates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """node, component (the smallest node reachable) for every node of (a, b).

    Large star: each node's larger neighbours are tied to its smallest neighbour; small star: its smaller ones and
    itself. Both keep the components; the rounds end when nothing changes, after about log(n) of them. Smallest
    neighbours are partial aggregates; rows of a node with many edges are split by the adaptive join.
    Edges with a null end and loops don't count; an empty list gives no rows.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "components")
    state = _state(e)
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "components")
        before, state = state, _state(e)
        if state == before:
            break
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
