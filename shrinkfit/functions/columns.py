"""Column expressions (C1-C3, C6, C7, T5-T7, T9). All JVM-side, no UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: a parenthesised group (non-greedy) and an all-digits year.
PAREN_GROUP = r"\((.*?)\)"
DIGITS_ONLY = r"^\s*\d+\s*$"
GENRE_SEP = r"\|"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def release_year(title: Column | str) -> Column:
    """Integer inside the *last* ``( … )`` of a title, else NULL.

    ``try_element_at`` keeps an empty match list NULL instead of throwing
    under ANSI; only an all-digits group (spaces allowed) is a year.
    """
    groups = F.regexp_extract_all(_col(title), F.lit(PAREN_GROUP), F.lit(1))
    last = F.try_element_at(groups, F.lit(-1))
    return F.when(last.rlike(DIGITS_ONLY), F.trim(last).try_cast("int"))


def epoch_to_timestamp(ts: Column | str) -> Column:
    """Epoch seconds → timestamp."""
    return F.timestamp_seconds(_col(ts))


def day_of_week_sunday0(d: Column | str) -> Column:
    """``%w``: 0 = Sunday … 6 = Saturday."""
    return F.dayofweek(_col(d)) - 1


def week_of_year_monday(d: Column | str) -> Column:
    """``%W``: Monday-first week 00-53; days before the first Monday are week 0.

    ``weekofyear`` (ISO-8601) differs on about 40 % of days, so it is not used.
    """
    d = _col(d)
    return F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7).cast("int")


def rating_date_parts(ts: Column | str) -> dict[str, Column]:
    """rating_year, rating_month, rating_day_of_week, rating_week_of_year."""
    d = epoch_to_timestamp(ts)
    return {
        "rating_year": F.year(d),
        "rating_month": F.month(d),
        "rating_day_of_week": day_of_week_sunday0(d),
        "rating_week_of_year": week_of_year_monday(d),
    }


def genre_tokens(genres: Column | str) -> Column:
    """``a|b|c`` → array; NULL behaves as the empty string (one empty token)."""
    return F.split(F.coalesce(_col(genres), F.lit("")), GENRE_SEP)


def genre_count(genres: Column | str, genre: str) -> Column:
    """How many times ``genre`` occurs in the list (T7: a repeat counts 2)."""
    return F.size(F.filter(genre_tokens(genres), lambda t: t == F.lit(genre)))


def sanitize_genre(name: str) -> str:
    """Column-safe genre name: every non-alphanumeric becomes ``_``."""
    return re.sub(r"[^A-Za-z0-9]", "_", name)


def indicator_columns(vocabulary: list[str], prefix: str = "genres_") -> dict[str, str]:
    """Map genre → output column name; fail on case-insensitive collisions."""
    names: dict[str, str] = {}
    seen: dict[str, str] = {}
    for g in vocabulary:
        col = prefix + sanitize_genre(g)
        low = col.lower()
        if low in seen:
            raise ValueError(f"genres {seen[low]!r} and {g!r} both map to column {col!r}")
        seen[low] = g
        names[g] = col
    return names


def lambda_values(start: float = 0.0, stop: float = 10.0, step: float = 0.25) -> list[float]:
    """``seq(start, stop, step)`` as exact multiples of the step."""
    n = int(round((stop - start) / step))
    return [start + i * step for i in range(n + 1)]
