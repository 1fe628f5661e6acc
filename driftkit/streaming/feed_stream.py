"""Structured Streaming ingest of the raw long feed.

* ``typed_feed_stream``: parse (P2/P3/F5/F6/F8) each arriving file of raw rows
  and append the typed rows to a Parquet table - exactly once through the
  query's checkpoint location.
* ``snapshot_stream``: the pivot with medians of duplicates (A2) as a streaming
  aggregation with a watermark on ``model_time``: a (group, entity, time) row is
  emitted once no later reading for it can arrive (late rows beyond the delay
  are dropped by the watermark, as Structured Streaming defines).

History features and labels need whole-history and future frames, so they stay
batch jobs over the appended tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from driftkit.operators.ingest import parse_feed
from driftkit.operators.reshape import node_rows, pivot_median


def read_feed_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "json",
                     max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def typed_feed_stream(raw: DataFrame, out_path: str, checkpoint: str, available_now: bool = True, **parse_kw) -> StreamingQuery:
    typed = parse_feed(raw, **parse_kw)
    w = typed.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()


def snapshot_stream(raw: DataFrame, properties: Sequence[str], out_path: str, checkpoint: str, delay: str = "6 hours",
                    available_now: bool = True, keys: Sequence[str] = ("backend", "qubit", "model_time"), **parse_kw) -> StreamingQuery:
    # watermarks need TIMESTAMP event time: aggregate on it, hand back TIMESTAMP_NTZ
    typed = parse_feed(raw, **parse_kw).withColumn("model_time", F.col("model_time").cast("timestamp"))
    typed = typed.withWatermark("model_time", delay)
    wide = pivot_median(node_rows(typed, properties), list(keys), properties, extra_medians=["calibration_lag_hours"],
                        method="aggregate")
    wide = wide.withColumn("model_time", F.col("model_time").cast("timestamp_ntz"))
    w = wide.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()
