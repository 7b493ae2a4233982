"""The column functions as Spark SQL functions, and a model's scoring as one SQL statement.

``register_functions`` makes them temporary functions of the session, whose bodies Catalyst inlines: no Python runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.effects import BiasModel
from ..sources.tables import NO_GENRE

_LABELS = r"split(coalesce(genres, ''), r'\|')"
_LAST_GROUP = r"try_element_at(regexp_extract_all(title, r'\((.*?)\)', 1), -1)"
_DAY = "timestamp_seconds(ts)"

#: name → (parameters, result type, body)
FUNCTIONS = {
    "release_year": ("title STRING", "INT",
                     rf"CASE WHEN {_LAST_GROUP} RLIKE r'^\s*\d+\s*$' THEN try_cast(trim({_LAST_GROUP}) AS INT) END"),
    "rating_year": ("ts BIGINT", "INT", f"year({_DAY})"),
    "rating_month": ("ts BIGINT", "INT", f"month({_DAY})"),
    "rating_day_of_week": ("ts BIGINT", "INT", f"dayofweek({_DAY}) - 1"),
    "rating_week_of_year": ("ts BIGINT", "INT", f"CAST(floor((dayofyear({_DAY}) + 6 - weekday({_DAY})) / 7) AS INT)"),
    "label_count": ("genres STRING", "INT", f"size(filter({_LABELS}, t -> t <> '' AND t <> '{NO_GENRE}'))"),
    "shrunk_mean": ("total DOUBLE, n BIGINT, penalty DOUBLE", "DOUBLE",
                    "CASE WHEN n + penalty > 0 THEN coalesce(total, 0D) / (n + penalty) ELSE 0D END"),
}


def register_functions(spark: SparkSession) -> None:
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")


def register_model(spark: SparkSession, model: BiasModel, prefix: str, j: int = 0) -> None:
    """Temporary views ``<prefix>_<effect>`` (key, b) and ``<prefix>_genres`` (genre, b_g) of λ number ``j``."""
    for e in model.effects:
        model.effect(e.spec.name, j).withColumnRenamed(e.spec.name, "b").select(e.spec.key, "b").createOrReplaceTempView(f"{prefix}_{e.spec.name}")
    if model.genres is not None:
        model.genre_effects(j).select("genre", "b_g").createOrReplaceTempView(f"{prefix}_genres")


def scoring_sql(model: BiasModel, rows: str, prefix: str) -> str:
    """SELECT over the view ``rows`` that adds ``pred``, from a registered model; a key without effect gives NULL, as ``predict`` does."""
    joins = [f"LEFT JOIN {prefix}_{e.spec.name} ON r.{e.spec.key} <=> {prefix}_{e.spec.name}.{e.spec.key}" for e in model.effects]
    terms = [f"{model.mu!r}D"] + [f"{prefix}_{e.spec.name}.b" for e in model.effects]
    head = ""
    if model.genres is not None:
        g = model.genres_col
        head = (f"WITH lists AS (SELECT DISTINCT {g} FROM {rows}), "
                f"tokens AS (SELECT {g}, explode(split(coalesce({g}, ''), r'\\|')) AS genre FROM lists), "
                f"terms AS (SELECT {g}, sum(b_g) AS term FROM tokens JOIN {prefix}_genres USING (genre) GROUP BY {g}) ")
        joins.append(f"LEFT JOIN terms ON r.{g} <=> terms.{g}")
        terms.append("coalesce(terms.term, 0D)")
    return f"{head}SELECT r.*, {' + '.join(terms)} AS pred FROM {rows} r {' '.join(joins)}"
