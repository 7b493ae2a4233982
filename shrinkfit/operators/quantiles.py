"""Exact order statistics without a sort of all values.

1. One pass: a KLL sketch of the values with their count, minimum and maximum. Partial sketches are
   merged in two steps, so no task receives one from every scan task.
2. The sketch brackets each wanted rank by two values. A second pass counts the rows below and up to
   each of these cut values and writes only the rows inside the brackets.
3. The counts say where each rank lies: at a cut value, which ends it, or strictly between two of
   them. There the search goes on among the written rows, about one row in a hundred, until few enough are left.

The sketch only chooses cut values, counts decide: a bracket that misses its rank costs another pass
over the rows and changes no result. Cut values are values of the column, so every step leaves some out and the search ends.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..session import materialize

#: Size of a sketch (about 50 KB) and half the share of rows that a bracket spans: twice the sketch's rank error at 99 %.
SKETCH_K, SLACK = 2048, 0.005


def order_statistics(df: DataFrame, col: str, ranks_of: Callable[[int], Iterable[int]],
                     limit: int = 50_000) -> tuple[dict[int, tuple[float, int]], int]:
    """``{rank: (value, rows with this value or less)}`` and the number of rows; ranks count from 0.

    ``ranks_of`` gives the wanted ranks (a few) for a number of rows; ``limit`` distinct values at
    most come to the driver. NULLs raise, no rows raise; NaN sorts last.
    """
    rows = df.select(F.col(col).cast("double").alias("v"))
    seen = _sketched(rows)
    if seen["nulls"]:
        raise ValueError(f"{seen['nulls']} NULL values in {col!r}")
    if not seen["n"]:
        raise ValueError(f"no values in {col!r} to cut into strata")
    whole = seen["n"] + seen["nans"]
    ranks = sorted(set(ranks_of(whole)))
    found = {k: (float("nan"), whole) for k in ranks if k >= seen["n"]}
    number = [k for k in ranks if k < seen["n"]]
    return found | (_search(rows.where(~F.isnan("v")), seen, number, limit) if number else {}), whole


def _sketched(rows: DataFrame) -> dict:
    """n (values but NaN), nulls, nans, low, high and sketch of ``rows`` (v)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.when(~F.isnan("v"), F.col("v"))
    some = rows.select("v", number.alias("number"), F.pmod(F.spark_partition_id(), F.lit(parts)).alias("part")).groupBy("part").agg(
        F.count("number").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(F.isnan("v")).alias("nans"),
        F.min("number").alias("low"), F.max("number").alias("high"), F.kll_sketch_agg_double("number", SKETCH_K).alias("sketch"))
    whole = some.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "nulls", "nans")], F.min("low").alias("low"),
                     F.max("high").alias("high"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
    return whole.first().asDict()


def _brackets(rows: DataFrame, seen: dict, ranks: list[int]) -> list[tuple[float, float]]:
    """Two values of the column around each rank."""
    low, high = [(k + 0.5) / seen["n"] - SLACK for k in ranks], [(k + 0.5) / seen["n"] + SLACK for k in ranks]
    at = F.array(*[F.lit(min(1.0, max(0.0, p))) for p in low + high])
    values = rows.sparkSession.range(1).select(F.kll_sketch_get_quantile_double(F.lit(bytes(seen["sketch"])), at).alias("v")).first()["v"]
    return [(a if p > 0 else seen["low"], b if q < 1 else seen["high"])
            for p, q, a, b in zip(low, high, values[: len(ranks)], values[len(ranks):])]


def _search(rows: DataFrame, seen: dict, ranks: list[int], limit: int) -> dict[int, tuple[float, int]]:
    if seen["n"] <= limit:
        return _listed(rows, ranks)
    brackets = _brackets(rows, seen, ranks)
    cuts = sorted({seen["low"], seen["high"], *[v for b in brackets for v in b]})
    v = F.col("v")
    inside = F.lit(False)
    for a, b in set(brackets):
        inside = inside | ((v > a) & (v < b))
    counts = Observation()
    counted = rows.observe(counts, *[F.count_if(v < c).alias(f"below_{i}") for i, c in enumerate(cuts)], *[F.count_if(v <= c).alias(f"upto_{i}") for i, c in enumerate(cuts)])
    written = materialize(counted.where(inside), "quantile-brackets")
    upto = [counts.get[f"upto_{i}"] for i in range(len(cuts))]
    found: dict[int, tuple[float, int]] = {}
    cells: dict[int, list[int]] = {}
    for k in ranks:
        i = bisect_right(upto, k)   # the first cut value that at least k + 1 rows don't exceed
        if k >= counts.get[f"below_{i}"]:
            found[k] = (cuts[i], upto[i])
        else:
            cells.setdefault(i, []).append(k)
    for i, held in cells.items():
        a, b, before, n = cuts[i - 1], cuts[i], upto[i - 1], counts.get[f"below_{i}"] - upto[i - 1]
        source = written if any(x <= a and b <= y for x, y in brackets) else rows
        cell, local = source.where((v > a) & (v < b)), [k - before for k in held]
        below = _listed(cell, local) if n <= limit else _search(cell, _sketched(cell), local, limit)
        found |= {before + k: (value, before + m) for k, (value, m) in below.items()}
    return found


def _listed(rows: DataFrame, ranks: list[int]) -> dict[int, tuple[float, int]]:
    """From a list of all values with their counts: for few rows."""
    upto, found, waiting = 0, {}, list(ranks)
    for r in sorted(rows.groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["v"]):
        upto += r["n"]
        while waiting and waiting[0] < upto:
            found[waiting.pop(0)] = (r["v"], upto)
    return found
