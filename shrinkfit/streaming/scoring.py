"""Scoring a stream of new ratings with a fitted model (Structured Streaming).

The reference scores a static holdout table; the same operator applies
unchanged to ratings that arrive over time: every effect table is static, so
each one is a stream-static left join (broadcast when its counted size
allows), and the genre term is a per-row lookup in the bounded genre-effect
map. No state is kept; each micro-batch is scored independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.effects import BiasModel, predict


def score_stream(model: BiasModel, stream: DataFrame, intercept: float | None = None) -> DataFrame:
    """Streaming DataFrame of ``stream`` rows with ``pred`` added."""
    return predict(model, stream, intercept=intercept, genre_terms="map")


def start_scoring(model: BiasModel, source_dir: str, schema: T.StructType, sink_dir: str,
                  checkpoint_location: str, available_now: bool = True,
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Score Parquet files landing in ``source_dir`` into Parquet at ``sink_dir``.

    The checkpoint location must be on shared storage so a restarted query
    resumes exactly once from the last committed micro-batch.
    """
    spark = model.effects[0].table.sparkSession if model.effects else model.genres.sparkSession
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    scored = score_stream(model, reader.parquet(source_dir))
    writer = (scored.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_location).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
