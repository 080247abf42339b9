"""Scoring objects as they arrive, with the basis held fixed.

An object comes whole (array layout) and its coefficients depend on the basis alone, so the
stream keeps no state, needs no watermark, and runs the very function the batch runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.score import score

OBJECT_SCHEMA = "obj_id bigint, y array<double>, w array<double>"


def read_stream(spark: SparkSession, path: str, schema: str = OBJECT_SCHEMA, max_files: int | None = None) -> DataFrame:
    """Objects from the Parquet files that land in a folder."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def score_stream(objects: DataFrame, model, sink: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Score a stream into Parquet files. ``once`` works off what is there and stops."""
    scored = score(objects, model, **options)
    writer = scored.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
