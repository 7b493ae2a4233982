"""Stratified train/test split and the seen-key guard.

The split picks exactly ``ceil(p * n_s)`` rows in every stratum ``s`` (the
documented behaviour of the reference's partitioning helper). R's random
generator cannot be reproduced, so rows are ordered by a seeded MD5 of a row
key instead (T18); the smallest ``ceil(p * n_s)`` hashes form the test side.

At scale a window over a stratum would put a quarter of the table into one
task. Instead the split is a cut value per stratum:

1. the search for the strata's breaks also counts each stratum's rows, so
   the hash at which its share ends is known up to a few standard errors;
2. one narrow pass (key and value only) counts the rows below that bracket and
   writes those inside it, about the root of the table's rows;
3. radix refinement of the written rows, four hex digits at a time, finds the one
   hash ``T`` at which the count is met; a bracket that misses (repeated keys)
   is replaced by a refinement of all hashes;
4. the label is a projection: ``hash <= T``. No union, no window, no cached copy.

Rows that share the hash at the cut (repeated or NULL keys) are cut again, by a hash of
all their columns, and rows equal in every column by their position in a written copy; neither puts them into one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Observation
from pyspark.sql import types as T

from ..session import WIDE_CODEC, materialize
from .joins import can_broadcast, lookup_join
from .quantiles import order_statistics

DEFAULT_PROBS = (0.0, 0.25, 0.5, 0.75, 1.0)


def quantile_breaks(df: DataFrame, col: str = "rating",
                    probs: tuple[float, ...] = DEFAULT_PROBS) -> list[float]:
    """Type-7 quantiles (linear interpolation) of ``col`` (A13), exact for any number of values.

    The order statistics come from two passes and a search among few rows (``order_statistics``).
    NULLs raise, as R's ``quantile`` does.
    """
    return _breaks(df, col, probs)[0]


def _breaks(df: DataFrame, col: str, probs: tuple[float, ...]) -> tuple[list[float], dict[int, int]]:
    """The quantiles, and the number of rows of each stratum that they cut."""
    at: list[float] = []

    def ranks(n: int) -> set[int]:
        at.extend((n - 1) * p for p in probs)
        return {k for x in at for k in (math.floor(x), math.ceil(x))}

    value, rows = order_statistics(df, col, ranks)
    out, upto = [], {}
    for x in at:
        (a, a_rows), (b, b_rows) = value[math.floor(x)], value[math.ceil(x)]
        brk = a if x == math.floor(x) or a == b else (math.ceil(x) - x) * a + (x - math.floor(x)) * b
        out.append(brk)
        upto[brk] = b_rows if brk >= b else a_rows
    ends = [upto[b] for b in _interior(out)] + [rows]
    sizes = {s + 1: end - start for s, (start, end) in enumerate(zip([0, *ends], ends))}
    return out, {s: n for s, n in sizes.items() if n}


def _interior(breaks: list[float]) -> list[float]:
    lo, hi = breaks[0], breaks[-1]
    return sorted({b for b in breaks[1:-1] if lo < b < hi})


def stratum_expr(y: Column | str, breaks: list[float]) -> Column:
    """Bin number of ``y`` for ``cut(y, unique(breaks), include.lowest=TRUE)``.

    Bins are ``[b0,b1], (b1,b2], …``; label = 1 + number of distinct interior
    breaks strictly below ``y``. Interior breaks equal to the minimum or the
    maximum are dropped, as ``unique`` would merge them.
    """
    y = F.col(y) if isinstance(y, str) else y
    expr = F.lit(1)
    for b in _interior(breaks):
        expr = expr + F.when(y > F.lit(b), 1).otherwise(0)
    return expr.cast("int")


def seeded_hash(key: Column | str, seed: int | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    # A NULL key hashes like an empty one: no row is left without a place in the order.
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


#: Digits that one refinement step looks at, and standard errors of a bracket.
_STEP, _ERRORS = 4, 6


def cut_values(rows: DataFrame, need: dict[int, int], limit: int) -> dict[int, tuple[str, int, int]]:
    """Per stratum, the ``need``-th smallest hex string of ``rows`` (stratum, o): (string, how many of the rows equal to it count, all of these).

    Each step counts the buckets of the next digits (a count alone is hashed, not sorted) and keeps the one in which it is met; a few rows, or equal ones, end it.
    """
    found: dict[int, tuple[str, int, int]] = {}
    digits = 0
    while need:
        digits += _STEP
        bucket = F.substring("o", 1, digits)
        hist = rows.groupBy("stratum", bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        met = {}
        # At most 16 ** 4 rows for each stratum: those before have the same digits up to here.
        for r in sorted(hist.collect(), key=lambda r: (r["stratum"], r["b"])):
            s = r["stratum"]
            if s in need and s not in met:
                if need[s] <= r["n"]:
                    met[s] = r
                else:
                    need[s] -= r["n"]
        small = {s for s, r in met.items() if r["n"] <= limit}
        if small:
            few: dict[int, list[str]] = {s: [] for s in small}
            for r in rows.where(_any([(F.col("stratum") == s) & (bucket == met[s]["b"]) for s in small])).collect():
                few[r["stratum"]].append(r["o"])
            for s, values in few.items():
                values.sort()
                at = values[need[s] - 1]
                found[s] = (at, need[s] - sum(v < at for v in values), values.count(at))
        need = {s: n for s, n in need.items() if s in met and s not in found}
        if need:
            rows = materialize(rows.where(_any([(F.col("stratum") == s) & (bucket == met[s]["b"]) for s in need])), "split-refined")
            for r in rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), F.min("o").alias("low"), F.max("o").alias("high")).collect():
                if r["low"] == r["high"]:
                    found[r["stratum"]] = (r["low"], need.pop(r["stratum"]), r["n"])
    return found


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _bracket(n: int, take: int) -> tuple[str, str]:
    """Hex bounds between which the ``take``-th smallest of n uniform hashes lies, but for ``_ERRORS`` standard errors."""
    slack = _ERRORS * math.sqrt(take * (n - take) / n) + _ERRORS
    lo, hi = (take - slack) / n, (take + slack) / n
    return (f"{int(lo * 16 ** 12):012x}" if lo > 0 else "", f"{int(hi * 16 ** 12):012x}" if hi < 1 else "g")


def stratified_split(df: DataFrame, p: float, seed: int | str = 1, key: str = "rk",
                     y: str = "rating", label: str = "is_test",
                     bucket_rows: int = 50_000, keep_stratum: bool = False) -> DataFrame:
    """Add boolean ``label``: exactly ``ceil(p·n_s)`` rows per stratum are True.

    ``bucket_rows`` hashes of a stratum at most are compared on the driver at the end.
    """
    if not 0.0 <= p <= 1.0:
        raise ValueError("p must be in [0, 1]")
    if df.isEmpty():
        empty = df.withColumns({label: F.lit(False), "stratum": F.lit(1)})
        return empty if keep_stratum else empty.drop("stratum")
    breaks, sizes = _breaks(df, y, DEFAULT_PROBS)
    stratum = stratum_expr(y, breaks)
    take = {s: (math.ceil(n * p) if n > 1 else (1 if p > 0 else 0)) for s, n in sizes.items()}
    cut = {s: k for s, k in take.items() if 0 < k < sizes[s]}
    o = seeded_hash(key, seed)
    values = _cut_hashes(df.select(stratum.alias("stratum"), o.alias("o")), cut, sizes, bucket_rows)
    # Rows of one hash of which some count: cut by all their columns; rows equal in all of them by their place.
    shared = {s: v for s, v in values.items() if v[1] < v[2]}
    equal = {}
    if shared:
        df = materialize(df, "split-shared-keys")
        tie = F.lpad(F.hex(F.xxhash64(*[F.col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])), 16, "0")
        held = df.where(_any([(stratum == s) & (o == v[0]) for s, v in shared.items()]))
        equal = cut_values(held.select(stratum.alias("stratum"), tie.alias("o")), {s: v[1] for s, v in shared.items()}, bucket_rows)
    place = F.monotonically_increasing_id()
    picked = F.lit(False)
    for s, k in take.items():
        if s not in values:
            chosen = F.lit(k > 0)
        elif s not in shared:
            chosen = o <= F.lit(values[s][0])
        else:
            at, some, every = equal[s]
            among = tie <= F.lit(at)
            if some < every:
                last = _place_of(df.select(place.alias("place"), F.spark_partition_id().alias("part"), ((stratum == s) & (o == values[s][0]) & (tie == at)).alias("hit")), some)
                among = (tie < F.lit(at)) | ((tie == at) & (F.col("_place") <= last))
            chosen = (o < F.lit(values[s][0])) | ((o == F.lit(values[s][0])) & among)
        picked = F.when(F.col("_stratum") == s, chosen).otherwise(picked)
    placed = any(some < every for _, some, every in equal.values())
    out = df.withColumns({"_stratum": stratum, **({"_place": place} if placed else {})})
    out = out.withColumn(label, picked).drop("_place")
    return out.withColumnRenamed("_stratum", "stratum") if keep_stratum else out.drop("_stratum")


def _cut_hashes(narrow: DataFrame, cut: dict[int, int], sizes: dict[int, int], limit: int) -> dict[int, tuple[str, int, int]]:
    """The cut value of each stratum, from one pass over ``narrow`` (stratum, o) if the brackets hold it."""
    if not cut:
        return {}
    bounds = {s: _bracket(sizes[s], k) for s, k in cut.items()}
    below = Observation()
    seen = narrow.observe(below, *[F.count_if((F.col("stratum") == s) & (F.col("o") < lo)).alias(f"below_{s}") for s, (lo, _) in bounds.items()])
    inside = materialize(seen.where(_any([(F.col("stratum") == s) & (F.col("o") >= lo) & (F.col("o") < hi) for s, (lo, hi) in bounds.items()])), "split-bracket")
    counted = below.get
    held = {r["stratum"]: r["n"] for r in inside.groupBy("stratum").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = {s: k - counted[f"below_{s}"] for s, k in cut.items()}
    hit = {s: n for s, n in left.items() if 0 < n <= held.get(s, 0)}
    found = cut_values(inside, dict(hit), limit)
    missed = {s: k for s, k in cut.items() if s not in hit}
    return found | (cut_values(narrow, missed, limit) if missed else {})


def _place_of(rows: DataFrame, n: int) -> int:
    """The place of the n-th hit; ``rows``: place, part, hit."""
    before = 0
    for r in sorted(rows.where("hit").groupBy("part").count().collect(), key=lambda r: r["part"]):
        if before + r["count"] >= n:
            own = rows.where((F.col("part") == r["part"]) & F.col("hit")).select("place")
            return own.orderBy("place").limit(n - before).agg(F.max("place")).first()[0]
        before += r["count"]
    raise ValueError("fewer rows than counted before")


def seen_key_guard(df: DataFrame, label: str = "is_test",
                   keys: tuple[str, ...] = ("movieId", "userId"),
                   moved: str | None = "moved_to_train") -> DataFrame:
    """Keep a test row only if every key also occurs on the train side (M2).

    All keys are tested against the *initial* train side (T11); test rows
    that fail go to train (U1), marked in ``moved``. One aggregate over
    ``GROUPING SETS ((key1), (key2), …)`` computes, per key value, whether it
    has a train row and how many rows it has (partial aggregation
    pre-combines a hot key map-side); it is written once and counted per key in
    one job. Of each key only the values without a train row are joined back, which are few
    where the test side is the smaller one: none, or a broadcast under the size bound. Past
    it all values are joined, by a shuffle join whose hot keys are split off to a broadcast (``lookup_join``).
    """
    flags = [F.grouping(k).alias(f"_g_{k}") for k in keys]
    seen_all = df.groupingSets([[k] for k in keys], *keys).agg(
        (F.count_if(~F.col(label)) > 0).alias("_seen"), F.count(F.lit(1)).alias("_seen_w"), *flags)
    seen_all = materialize(seen_all, "seen-keys")
    sizes = {tuple(r[f"_g_{k}"] for k in keys): (r["n"], r["unseen"])
             for r in seen_all.groupBy(*[f"_g_{k}" for k in keys]).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("_seen")).alias("unseen")).collect()}
    out = df
    ok = F.lit(True)
    for k in keys:
        mask = tuple(0 if x == k else 1 for x in keys)
        sel = F.lit(True)
        for x, m in zip(keys, mask):
            sel = sel & (F.col(f"_g_{x}") == m)
        n, n_unseen = sizes.get(mask, (0, 0))
        if not n_unseen:
            continue
        unseen = seen_all.where(sel & ~F.col("_seen")).select(k, F.col("_seen").alias(f"_seen_{k}"))
        if can_broadcast(unseen, n_unseen):
            out = lookup_join(out, unseen, [k], "left", small_rows=n_unseen)
            ok = ok & F.coalesce(F.col(f"_seen_{k}"), F.lit(True))
            continue
        seen = seen_all.where(sel).select(k, F.col("_seen").alias(f"_seen_{k}"), "_seen_w")
        out = lookup_join(out, seen, [k], "left", small_rows=n,
                          weight_col="_seen_w").drop("_seen_w")
        ok = ok & F.coalesce(F.col(f"_seen_{k}"), F.lit(False))
    cols = {label: F.col(label) & ok}
    if moved:
        cols[moved] = F.col(label) & ~ok
    return out.withColumns(cols).drop(*[f"_seen_{k}" for k in keys])


def train_test(df: DataFrame, label: str = "is_test") -> tuple[DataFrame, DataFrame]:
    """Complement by flag."""
    return df.where(~F.col(label)).drop(label), df.where(F.col(label)).drop(label)


def guarded_split(df: DataFrame, p: float, seed: int | str = 1, key: str = "rk",
                  y: str = "rating", label: str = "is_test",
                  keys: tuple[str, ...] = ("movieId", "userId"), name: str = "split") -> DataFrame:
    """Stratified split + seen-key guard, written once under the checkpoint folder.

    Written partitioned by ``label`` so reading either side prunes to its files.
    """
    return materialize(flagged_split(df, p, seed, key, y, label, keys), name, partition_by=[label], codec=WIDE_CODEC)


def flagged_split(df: DataFrame, p: float, seed: int | str = 1, key: str = "rk", y: str = "rating", label: str = "is_test",
                  keys: tuple[str, ...] = ("movieId", "userId")) -> DataFrame:
    """Stratified split + seen-key guard. The guard's key aggregates repeat the labelling projection over a pruned scan; nothing is cached."""
    return seen_key_guard(stratified_split(df, p, seed, key, y, label), label, keys)


def split_share(df: DataFrame, label: str = "is_test") -> DataFrame:
    """Counts and percentages of each side."""
    n = F.count(F.lit(1))
    n_test = F.count_if(F.col(label))
    return df.agg(n.alias("n_total"), n_test.alias("n_test"), (n - n_test).alias("n_train"),
                  (n_test / n * 100).alias("test_pct"), ((n - n_test) / n * 100).alias("train_pct"))
