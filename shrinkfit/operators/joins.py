"""Lookup joins against derived tables whose size is checked, not assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper bound for an explicit broadcast; beyond it the join is left to AQE
# (shuffle join with skew splitting, or a runtime broadcast if it turns out small).
DEFAULT_BROADCAST_MAX_BYTES = 64 * 1024 * 1024
_CONF_KEY = "shrinkfit.broadcastMaxBytes"


def broadcast_max_bytes(df: DataFrame) -> int:
    v = df.sparkSession.conf.get(_CONF_KEY, None)
    return int(v) if v else DEFAULT_BROADCAST_MAX_BYTES


def row_bytes(schema: T.StructType) -> int:
    """Rough in-memory width of one row (fixed 8 bytes per numeric, 32 per string besides its measured bytes)."""
    width = 16
    for f in schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            width += 32
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width += 64
        else:
            width += 8
    return width


def can_broadcast(df: DataFrame, n_rows: int) -> bool:
    """Counted rows and, for string columns, their measured bytes, against the bound."""
    fixed, most = n_rows * row_bytes(df.schema), broadcast_max_bytes(df)
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if fixed > most or not strings:
        return fixed <= most
    held = df.agg(sum(F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in strings).alias("b")).first()["b"]
    return fixed + held <= most


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left",
                small_rows: int | None = None, null_safe: bool = True,
                weight_col: str | None = None, weights: DataFrame | None = None) -> DataFrame:
    """``big ⋈ small`` on ``keys`` (null-safe by default, T1).

    ``small`` is broadcast only if its counted size is under the bound. Past
    it, if ``weight_col`` gives the number of ``big`` rows per key (effect
    tables carry ``n``), keys holding more than a share of one shuffle
    partition are *hot*: their rows take their values from a broadcast of just
    the hot lookup rows (at most total/threshold of them, counted) and go through
    the shuffle join under a salt that spreads them and matches nothing there.
    ``big`` is read once, however many such joins follow each other. ``weights`` (keys, ``weight_col``) gives the
    numbers if ``small`` doesn't hold them; it is read twice, so it should be written, and only says which keys are hot.
    """
    if small_rows is None:
        small_rows = small.count()
    fits = can_broadcast(small, small_rows)
    if fits or weight_col is None or how != "left":
        return _join(big, small, keys, how, null_safe, F.broadcast if fits else None)
    parts = int(big.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    counted = small if weights is None else weights
    total = counted.agg(F.sum(weight_col)).first()[0] or 0
    threshold = max(1, total // max(1, 4 * parts))
    hot = counted.where(F.col(weight_col) > threshold)
    hot_rows = hot.count()
    if hot_rows == 0 or not can_broadcast(hot, hot_rows):
        return _join(big, small, keys, how, null_safe, None)
    if weights is None:
        cold = small.where(F.col(weight_col) <= threshold)
    else:
        marked = _join(small, hot.select(*keys, F.lit(True).alias("_hot_key")), keys, "left", True, F.broadcast)
        hot, cold = (marked.where(F.col("_hot_key") if is_hot else F.col("_hot_key").isNull()).drop("_hot_key") for is_hot in (True, False))
        if not can_broadcast(hot, hot_rows):
            return _join(big, small, keys, how, null_safe, None)
    values = [c for c in small.columns if c not in keys]
    side = hot.select(*keys, *[F.col(c).alias(f"_hot_{c}") for c in values], F.lit(True).alias("_hot"))
    tagged = _join(big, side, keys, "left", null_safe, F.broadcast)
    row = [F.col(f.name) for f in big.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    salt = F.when(F.col("_hot"), 1 + F.pmod(F.xxhash64(*row), F.lit(4 * parts))).otherwise(F.lit(0)).cast("long")
    cold = cold.withColumn("_salt", F.lit(0).cast("long"))
    out = _join(tagged.withColumn("_salt", salt), cold, [*keys, "_salt"], "left", null_safe, None)
    return out.select(*big.columns, *[F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def _join(big: DataFrame, small: DataFrame, keys: list[str], how: str, null_safe: bool, hint) -> DataFrame:
    renamed = small
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_lk_{k}")
    side = hint(renamed) if hint else renamed
    conds = [(big[k].eqNullSafe(side[f"_lk_{k}"]) if null_safe else big[k] == side[f"_lk_{k}"])
             for k in keys]
    cond = conds[0]
    for c in conds[1:]:
        cond = cond & c
    out = big.join(side, cond, how)
    if how in ("left_semi", "left_anti", "semi", "anti"):
        return out
    return out.drop(*[f"_lk_{k}" for k in keys])


def natural_anti_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of ``left`` with no row of ``right`` equal on every shared column.

    Equality is null-safe, like dplyr's default. Duplicated rows in ``left``
    are all kept when unmatched (bag semantics of ``anti_join``).
    """
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("natural anti join needs at least one shared column")
    r = right.select(*common).distinct()
    for c in common:
        r = r.withColumnRenamed(c, f"_na_{c}")
    cond = left[common[0]].eqNullSafe(r[f"_na_{common[0]}"])
    for c in common[1:]:
        cond = cond & left[c].eqNullSafe(r[f"_na_{c}"])
    return left.join(r, cond, "left_anti")


def semi_join_keys(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose value of every key occurs in ``seen`` (J3); NULL matches NULL, as in the reference.

    Each key's values are counted once (partial sums), so the lookup joins know
    their size and, past the broadcast bound, their hot values.
    """
    out = df
    for k in keys:
        values = seen.groupBy(k).agg(F.count(F.lit(1)).alias("_w")).withColumn("_hit", F.lit(True))
        out = lookup_join(out, values, [k], "left", weight_col="_w").where("_hit").drop("_hit", "_w")
    return out
