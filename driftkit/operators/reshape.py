"""Filters, pivots and grouped medians that build the wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftkit.functions.names import sanitize_name
from driftkit.functions.scalar import regex_int

EDGE_PATTERN = r"^cz_error_(\d+)_(\d+)$"


def node_rows(df: DataFrame, properties: Sequence[str], entity_col: str = "qubit",
              property_col: str = "property", edge_pattern: str = EDGE_PATTERN) -> DataFrame:
    """Entity >= 0, property in the list and not an edge property (pushed to the scan)."""
    p = F.col(property_col)
    return df.filter((F.col(entity_col) >= 0) & p.isin(list(properties)) & ~p.rlike(edge_pattern))


def edge_rows(df: DataFrame, property_col: str = "property", edge_pattern: str = EDGE_PATTERN) -> DataFrame:
    """P5 + F3: rows whose property matches the edge pattern, with int endpoints q1, q2."""
    p = F.col(property_col)
    return df.filter(p.rlike(edge_pattern)).withColumn("q1", regex_int(p, edge_pattern, 1)).withColumn(
        "q2", regex_int(p, edge_pattern, 2)
    )


def sorted_medians(df: DataFrame, keys: Sequence[str], specs: Sequence[tuple]) -> DataFrame:
    """Exact medians per key of several value expressions, sort-based.

    ``specs``: (output name, value Column or column name); NULL/NaN values are
    ignored and every key of ``df`` keeps its row.  Rows are hash-partitioned
    once by ``keys``; a window per (key, spec) ordered by value flags the one or
    two middle values; one aggregation (no further exchange - the partitioning
    already clusters every key) averages them into one column per spec.  No
    per-group hash-map buffers: sorting spills, so a big key costs disk, not
    memory.  Same values as ``median`` / ``percentile(0.5)``."""
    def val(v):
        x = (F.col(v) if isinstance(v, str) else v).cast("double")
        return F.when(~F.isnan(x), x)

    entries = F.array(*[F.struct(F.lit(i).alias("_i"), val(v).alias("_v")) for i, (_, v) in enumerate(specs)])
    # only present values travel; a row without any still stands for its key
    present = F.explode_outer(F.filter(entries, lambda s: s["_v"].isNotNull()))
    long = df.select(*keys, present.alias("_s")).select(*keys, "_s._i", "_s._v").repartition(*keys)
    w = Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_last())
    n = F.count("_v").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = F.row_number().over(w)
    flagged = long.select(*keys, "_i", "_v", r.alias("_r"), n.alias("_n"))
    mid = F.col("_v").isNotNull() & ((F.col("_r") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1))
    return flagged.groupBy(*keys).agg(
        *[F.avg(F.when(mid & (F.col("_i") == i), F.col("_v"))).alias(name) for i, (name, _) in enumerate(specs)])


def grouped_medians(df: DataFrame, keys: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """A1: exact median of many columns per key (NULLs ignored), sort-based."""
    return sorted_medians(df, keys, [(c, c) for c in value_cols])


def pivot_median(
    df: DataFrame,
    keys: Sequence[str],
    properties: Sequence[str],
    property_col: str = "property",
    value_col: str = "value",
    extra_medians: Sequence[str] = (),
    method: str = "sort",
) -> DataFrame:
    """A2 + A3 + P7: long -> wide with the median of duplicates.

    ``method="aggregate"`` uses the built-in ``median`` aggregate instead (one
    hash-aggregation buffer per key; needed for streaming aggregations).

    One sort-based median pass (``sorted_medians``) over
    ``CASE WHEN property = p THEN value END`` per requested property (an explicit
    list, so absent properties still get an all-NULL column and no
    distinct-values job runs), plus medians of ``extra_medians`` over the same
    rows (the metadata join J3 folded in).  Output names are sanitised.
    """
    specs = [(sanitize_name(p), F.when(F.col(property_col) == F.lit(p), F.col(value_col))) for p in properties]
    specs += [(c, F.col(c)) for c in extra_medians]
    if method == "aggregate":
        return df.groupBy(*keys).agg(*[F.median(v).alias(name) for name, v in specs])
    return sorted_medians(df, keys, specs)


def edge_medians(df: DataFrame, keys: Sequence[str] = ("backend", "q1", "q2", "model_time"),
                 value_col: str = "value", out_col: str = "cz_error",
                 extra_medians: Sequence[str] = ("calibration_lag_hours",)) -> DataFrame:
    """A4: named medians per (group, q1, q2, time), sort-based."""
    return sorted_medians(df, list(keys), [(out_col, value_col)] + [(c, c) for c in extra_medians])


def join_many_to_one(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
) -> DataFrame:
    """J1 + J4: left equi-join where ``right`` has at most one row per key.  A key that
    occurs twice fails the query: the check is part of the plan (a count per key over
    the partitioning that the join needs anyway), so it runs no job and no scan of its
    own.  AQE decides the join from runtime sizes (broadcast, sort-merge or
    shuffled-hash, skew-join splitting)."""
    return left.join(checked_unique(right, keys), on=list(keys), how=how)


def checked_unique(df: DataFrame, keys: Sequence[str], name: str = "right side of a many-to-one join") -> DataFrame:
    """J4 inside a plan: ``df`` itself, or an error as soon as a key is met twice."""
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    told = F.concat(F.lit(f"{name}: duplicate key ({', '.join(keys)}) = "), F.to_json(F.struct(*keys)))
    counted = df.withColumn("_twice", twice)
    return counted.where(F.when(F.col("_twice"), F.raise_error(told).cast("boolean")).otherwise(True)).drop("_twice")


def assert_unique_keys(df: DataFrame, keys: Sequence[str], name: str = "frame") -> None:
    """Raise if any key occurs twice (one aggregate job, stops at the first hit)."""
    dup = df.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"{name}: duplicate keys {list(keys)}, e.g. {dup[0].asDict()}")

