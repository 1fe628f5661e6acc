"""Distributed prefix sums over a global order (optionally per group).

A window ordered over a whole table (or a whole hot group) runs in one task.
Here the rows are range-partitioned on (group, order key) and checkpointed so
partition membership is fixed; each partition computes local running sums, a
tiny table of per-(partition, group) totals gives the carried-in offsets (one
row per partition and group - a proven small broadcast), and the two add up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkit.session import cut_lineage

PID = "_pid"


def prefix_sums(
    df: DataFrame,
    order: Sequence[Column],
    sum_cols: Sequence[str],
    group_cols: Sequence[str] = (),
    suffix: str = "_cum",
    partitions: int | None = None,
    checkpoint: bool = True,
) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order`` within ``group_cols``.
    ``order`` must be unique within a group (aggregate ties first)."""
    gcols = [F.col(g) for g in group_cols]
    # without an explicit count AQE may coalesce neighbouring ranges; merged
    # ranges stay contiguous, so partition ids still follow the global order
    ranged = df.repartitionByRange(partitions, *gcols, *order) if partitions else df.repartitionByRange(*gcols, *order)
    ranged = ranged.withColumn(PID, F.spark_partition_id())
    if checkpoint:
        ranged = cut_lineage(ranged)
    local_w = Window.partitionBy(PID, *group_cols).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[F.sum(c).over(local_w).alias(c + "_loc") for c in sum_cols])
    totals = ranged.groupBy(PID, *group_cols).agg(*[F.sum(c).alias(c + "_tot") for c in sum_cols])
    carry_w = Window.partitionBy(*group_cols).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PID, *group_cols,
                            *[F.coalesce(F.sum(c + "_tot").over(carry_w), F.lit(0)).alias(c + "_off") for c in sum_cols])
    keys = [PID, *group_cols]
    # ungrouped: one row per partition - a proven bound, broadcast it; grouped: one
    # row per (partition, group) - sized by the grouping, let AQE choose
    joined = local.join(F.broadcast(offsets) if not group_cols else offsets, keys, "left")
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[(F.col(c + "_loc") + F.coalesce(F.col(c + "_off"), F.lit(0))).alias(c + suffix) for c in sum_cols],
    )


RUNS_BROADCAST = 200_000


def row_numbers(df: DataFrame, order: Sequence[Column], group_cols: Sequence[str], out: str, total: str) -> tuple[DataFrame, int]:
    """Add the 1-based position of each row in its group in ``order`` and the group's
    number of rows; also returns the largest group's.

    Rows are sorted in range partitions and checkpointed; a row's place in its
    partition is its place in the file, so only one row per (partition, group) - at
    most partitions + groups in all - is added up, and broadcast where that count
    allows; the rows themselves are not shuffled again."""
    gcols = [F.col(g) for g in group_cols]
    ranged = cut_lineage(df.repartitionByRange(*gcols, *order).sortWithinPartitions(*gcols, *order))
    placed = ranged.withColumns({PID: F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    keys = [PID, *group_cols]
    runs = cut_lineage(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first")))
    number, largest = runs.groupBy(*group_cols).agg(F.sum("_n").alias("t"), F.count(F.lit(1)).alias("r")).agg(F.sum("r"), F.max("t")).first()
    carry = Window.partitionBy(*group_cols).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    before = runs.select(*keys, (F.coalesce(F.sum("_n").over(carry), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
                         F.sum("_n").over(Window.partitionBy(*group_cols)).alias(total))
    if (number or 0) <= RUNS_BROADCAST:
        before = F.broadcast(before)
    joined = placed.join(before, keys)
    return joined.select(*df.columns, (F.col("_mid") + F.col("_shift")).alias(out), total), int(largest or 0)
