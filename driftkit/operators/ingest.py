"""Typed ingest of the raw long feed (P2, P3, F5, F6, F8) and its counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, TimestampNTZType, TimestampType

from driftkit.functions.scalar import hours_between, to_double, to_timestamp_ntz, utc_wall
from driftkit.sources.tables import CORRUPT


def _as_time(df: DataFrame, c: str):
    dt = df.schema[c].dataType
    if isinstance(dt, TimestampNTZType):
        return F.col(c)
    if isinstance(dt, TimestampType):
        return utc_wall(F.col(c))
    return to_timestamp_ntz(c)


def _as_double(df: DataFrame, c: str):
    return to_double(c)


def parse_feed(
    df: DataFrame,
    group_col: str = "backend",
    entity_col: str = "qubit",
    property_col: str = "property",
    value_col: str = "value",
    observed_col: str = "observed_time",
    calibrated_col: str | None = "calibrated_time",
    model_time_source: str = "observed_time",
    drop_invalid: bool = True,
) -> DataFrame:
    """Parse times (bad -> NULL), coerce value to double (bad/NaN -> NULL), derive
    ``model_time`` and ``calibration_lag_hours`` (always present, NULL without a
    calibration column), drop rows with NULL structural columns (P3)."""
    if model_time_source not in df.columns:
        raise ValueError(f"Configured model_time column not found: {model_time_source}")
    times = {c for c in (observed_col, calibrated_col, model_time_source) if c and c in df.columns}
    cols = []
    for c in df.columns:
        if c in times:
            cols.append(_as_time(df, c).alias(c))
        elif c == value_col:
            cols.append(_as_double(df, c).alias(c))
        elif c == property_col:
            cols.append(F.col(c).cast("string").alias(c))
        else:
            cols.append(F.col(c))
    typed = df.select(*cols)
    typed = typed.withColumn("model_time", F.col(model_time_source))
    if calibrated_col and calibrated_col in df.columns and observed_col in df.columns:
        lag = hours_between(observed_col, calibrated_col)
    else:
        lag = F.lit(None).cast("double")
    if "calibration_lag_hours" not in df.columns or (calibrated_col and calibrated_col in df.columns):
        typed = typed.withColumn("calibration_lag_hours", lag)
    if drop_invalid:
        typed = typed.dropna(subset=[group_col, entity_col, property_col, "model_time", value_col])
    return typed


def quarantine(
    raw: DataFrame,
    value_col: str = "value",
    time_cols: Sequence[str] = ("observed_time", "calibrated_time"),
    structural: Sequence[str] = ("backend", "qubit", "property", "observed_time", "value"),
) -> DataFrame:
    """The rows that ``parse_feed`` cannot use as they are, with ``reason``: a record
    that does not fit the schema, a time or number that cannot be read, a missing key.
    Lazy, one scan; the first reason in this order counts."""
    reasons = [F.when(F.col(CORRUPT).isNotNull(), F.lit("malformed record"))] if CORRUPT in raw.columns else []
    for c in time_cols:
        if c in raw.columns:
            reasons.append(F.when(F.col(c).isNotNull() & _as_time(raw, c).isNull(), F.lit(f"bad {c}")))
    reasons.append(F.when(F.col(value_col).isNotNull() & _as_double(raw, value_col).isNull(), F.lit(f"bad {value_col}")))
    reasons += [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in structural]
    return raw.withColumn("reason", F.coalesce(*reasons)).where("reason IS NOT NULL")


def parse_report(
    raw: DataFrame,
    value_col: str = "value",
    time_cols: Sequence[str] = ("observed_time", "calibrated_time"),
    structural: Sequence[str] = ("backend", "qubit", "property", "observed_time", "value"),
) -> DataFrame:
    """A10-A12 in ONE pass over the raw feed: parse failures per time column and
    for the value, value missing rate after parse, negative/missing calibration
    lag, structurally invalid rows, row count."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    parsed = {}
    for c in time_cols:
        if c in raw.columns:
            parsed[c] = _as_time(raw, c)
            aggs.append(F.count_if(F.col(c).isNotNull() & parsed[c].isNull()).alias(f"{c}_parse_failures"))
    v = _as_double(raw, value_col)
    aggs.append(F.count_if(F.col(value_col).isNotNull() & v.isNull()).alias("value_parse_failures"))
    aggs.append(F.avg(v.isNull().cast("double")).alias("value_missing_rate_after_numeric_parse"))
    if len(parsed) == 2:
        a, b = list(parsed.values())
        lag = hours_between(a, b)
        aggs.append(F.avg(lag.isNull().cast("double")).alias("calibration_lag_hours_missing_rate"))
        aggs.append(F.count_if(lag < 0).alias("negative_calibration_lag_rows"))
    bad = None
    for c in structural:
        e = (parsed.get(c, F.col(c)) if c != value_col else v).isNull()
        bad = e if bad is None else (bad | e)
    aggs.append(F.count_if(bad).alias("dropped_structurally_invalid_rows"))
    return raw.agg(*aggs)


def numeric_columns(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """Configured columns that exist and are numeric (schema only, no job)."""
    return [c for c in candidates if c in df.columns and isinstance(df.schema[c].dataType, NumericType)]
