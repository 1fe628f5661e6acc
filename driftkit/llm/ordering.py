"""Exclusive prefix sums in a given order, with no group in one task.

Rows carry a position that is uniform in [0, 1) (a seeded hash, a fractional
rank).  The unit interval is cut into equal buckets; sums per (group, bucket)
give offsets, and a window inside each (group, bucket) gives the rest.  A group
with a third of all rows is spread over all buckets; no sampling is involved, so
reruns and recomputed partitions agree.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 5_000
BUCKET = "_bucket"


def bucket_count(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, -(-rows // rows_per_bucket))


def prefix_before(
    df: DataFrame,
    groups: Sequence[str],
    unit: Column,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    buckets: int,
) -> DataFrame:
    """Add ``<name>_before`` (sum over earlier rows of the group) and
    ``<name>_total`` for each of ``sums``; ``groups`` must be non-NULL columns."""
    cut = df.withColumn(BUCKET, F.least(F.floor(unit * buckets), F.lit(buckets - 1)).cast("int"))
    cut = cut.withColumns({f"_v_{k}": v for k, v in sums.items()})
    keys = [*groups, BUCKET]
    per = cut.groupBy(*keys).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums])
    ahead = Window.partitionBy(*groups).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(
        *keys,
        *[F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_o_{k}") for k in sums],
        *[F.sum(f"_t_{k}").over(Window.partitionBy(*groups)).alias(f"{k}_total") for k in sums],
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.select("*", *[F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)).alias(f"_l_{k}") for k in sums])
    joined = local.join(offsets, keys)
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{k}") + F.col(f"_l_{k}")).alias(f"{k}_before") for k in sums],
        *[f"{k}_total" for k in sums],
    )
