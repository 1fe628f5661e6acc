"""Readers (S1, S2) and the test-data views that stand in for the telemetry feed.

The supplied tables are TPC-H-like plus an ``events`` stream.  The views below
map them onto the long telemetry vocabulary (group, entity, property, value,
times, environment) so every operator runs on data whose size grows with the
input.  Column names are parameters everywhere else; these views only fix the
defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from driftkit.functions.scalar import hours_between, nan_to_null, truncate_hour

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied Parquet table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


CORRUPT, FILE = "_corrupt", "_file"
TEXT_FORMATS = ("csv", "json")


def read_feed(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    schema: StructType | str | None = None,
    options: dict | None = None,
) -> DataFrame:
    """Raw long feed from Parquet/CSV/JSON.  A pinned revision is simply a path.

    Text formats are read permissively and need a schema: a record that does not fit it
    is kept, whole, in ``_corrupt`` (NULL for sound ones) beside the name of its file in
    ``_file``, for ``ingest.quarantine``."""
    reader = spark.read.format(fmt)
    if fmt not in TEXT_FORMATS:
        return (reader.schema(schema) if schema is not None else reader).options(**(options or {})).load(path)
    if schema is None:
        raise ValueError(f"a {fmt} feed needs a schema")
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    # all columns are parsed whatever a query selects: else the number of fields is not checked
    reader = reader.schema(StructType([*fields.fields, StructField(CORRUPT, StringType())])).option("columnPruning", False)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.options(**(options or {})).load(path).withColumn(FILE, F.input_file_name())


def _k_minutes(props: str = "props"):
    return F.regexp_extract(F.col(props), r'"k": (\d+)', 1).cast("int")


def readings(spark: SparkSession, sf_dir: str, hourly: bool = False, ids: tuple = ()) -> DataFrame:
    """Long node feed from ``events``.

    backend = user_id % 3, qubit = user_id, property = event_type, value,
    observed_time = ts, calibrated_time = ts - k minutes (k from props),
    env_a = k (NULL when k % 7 = 0), env_b = value / 10.
    ``hourly`` makes model_time the hour of ts, so keys repeat (medians, pivot); ``ids``
    are columns of ``events`` to keep.
    """
    ev = read_table(spark, sf_dir, "events")
    k = _k_minutes()
    observed = F.col("ts")
    calibrated = observed - F.make_dt_interval(F.lit(0), F.lit(0), k, F.lit(0))
    return ev.select(
        *ids,
        (F.col("user_id") % 3).alias("backend"),
        F.col("user_id").alias("qubit"),
        F.col("event_type").alias("property"),
        nan_to_null("value").alias("value"),
        observed.alias("observed_time"),
        calibrated.alias("calibrated_time"),
        (truncate_hour(observed) if hourly else observed).alias("model_time"),
        F.when(k % 7 != 0, k.cast("double")).alias("env_a"),
        (F.col("value") / 10.0).alias("env_b"),
        hours_between(observed, calibrated).alias("calibration_lag_hours"),
    )


def edge_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long edge feed from ``lineitem``: property ``cz_error_<suppkey>_<linenumber>``,
    value = discount, time = shipdate, group = returnflag, raw qubit = -1."""
    li = read_table(spark, sf_dir, "lineitem")
    t = F.col("l_shipdate")
    cal = t - F.make_dt_interval(F.lit(0), F.col("l_linenumber"), F.lit(0), F.lit(0))
    return li.select(
        F.col("l_returnflag").alias("backend"),
        F.lit(-1).alias("qubit"),
        F.concat(F.lit("cz_error_"), F.col("l_suppkey").cast("string"), F.lit("_"),
                 F.col("l_linenumber").cast("string")).alias("property"),
        nan_to_null("l_discount").alias("value"),
        t.alias("observed_time"),
        cal.alias("calibrated_time"),
        t.alias("model_time"),
        F.col("l_quantity").alias("env_a"),
        (F.col("l_tax") * 100.0).alias("env_b"),
        hours_between(t, cal).alias("calibration_lag_hours"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vectors`` view: embeddings (vec_id, embedding, label)."""
    return read_table(spark, sf_dir, "embeddings")
