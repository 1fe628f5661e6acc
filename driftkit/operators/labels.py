"""Future-horizon labels.

* W7 ``expanding_quantile``  - per group, time-ordered, current row included,
  linear-interpolated quantile of all non-NULL values so far (>= ``min_periods``).
* W8 ``future_horizon``      - max and non-NULL count of a value in (t, t + h] per entity.
* W9 ``fault_label``         - 1.0 if future max > threshold, 0.0 if not, NULL if either is NULL.
* W11 ``combine_labels``     - max over targets skipping NULLs; NULL when no target
  has a future observation; count of targets with one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftkit.operators import frames
from driftkit.operators.expanding import expanding_quantile
from driftkit.operators.frames import parse_duration_us


def expanding_quantile_sql(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    value_cols: Sequence[str],
    q: float = 0.95,
    min_periods: int = 10,
    suffix: str = "_threshold",
) -> DataFrame:
    """W7 as a window: ``percentile`` over ROWS UNBOUNDED PRECEDING.  Exact, but the
    buffer is re-read per row (quadratic in the group size): the definition that
    tests hold :func:`driftkit.operators.expanding.expanding_quantile` against."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(
        "*",
        *[F.when(F.count(c).over(w) >= min_periods, F.percentile(c, q).over(w)).alias(c + suffix) for c in value_cols],
    )


def future_horizon(
    df: DataFrame,
    entity_cols: Sequence[str],
    time_col: str,
    value_cols: Sequence[str],
    horizon: str | int = "24h",
    tag: str = "24h",
    block_us: int | None = None,
) -> DataFrame:
    """``<c>_future_max_<tag>`` and ``<c>_future_obs_count_<tag>`` over (t, t + horizon]."""
    h = parse_duration_us(horizon)

    def build(w, staged):
        return future_columns(w, value_cols, h, tag)

    return frames.apply_bounded_frames(df, entity_cols, time_col, build, lookback_us=0, lookahead_us=h, block_us=block_us)


def future_columns(w, value_cols: Sequence[str], h: int, tag: str) -> list:
    """W8 column expressions over a window ordered by microsecond time."""
    fw = w.rangeBetween(1, h)
    cols = []
    for c in value_cols:
        cols.append(F.max(c).over(fw).alias(f"{c}_future_max_{tag}"))
        cols.append(F.count(c).over(fw).cast("int").alias(f"{c}_future_obs_count_{tag}"))
    return cols


def fault_label(future_max: str, threshold: str):
    """W9 as a column."""
    m, t = F.col(future_max), F.col(threshold)
    return F.when(m.isNull() | t.isNull(), F.lit(None).cast("double")).otherwise((m > t).cast("double"))


def combine_labels(df: DataFrame, targets: Sequence[str], tag: str = "24h") -> DataFrame:
    """W9 per target + W11/A13 overall label ``fault_<tag>`` and ``future_fault_target_count_<tag>``."""
    per_target = [fault_label(f"{c}_future_max_{tag}", f"{c}_threshold").alias(f"{c}_fault_{tag}") for c in targets]
    out = df.select("*", *per_target)
    n_obs = sum((F.col(f"{c}_future_obs_count_{tag}") > 0).cast("int") for c in targets)
    overall = F.greatest(*[F.col(f"{c}_fault_{tag}") for c in targets]) if len(targets) > 1 else F.col(f"{targets[0]}_fault_{tag}")
    return out.withColumn(f"future_fault_target_count_{tag}", n_obs).withColumn(
        f"fault_{tag}", F.when(F.col(f"future_fault_target_count_{tag}") == 0, F.lit(None).cast("double")).otherwise(overall)
    )


def add_future_fault_labels(
    df: DataFrame,
    targets: Sequence[str],
    group_cols: Sequence[str] = ("backend",),
    entity_cols: Sequence[str] = ("backend", "qubit"),
    time_col: str = "model_time",
    horizon: str = "24h",
    q: float = 0.95,
    min_periods: int = 10,
    drop_unlabelled: bool = True,
    block_us: int | None = None,
    future_ready: bool = False,
) -> DataFrame:
    """W7 -> W8 -> W9 -> W11 -> P16: label table from a wide snapshot.

    Ties in time inside a group are ordered by the entity columns.
    ``future_ready``: the W8 columns are already present (fused with W2).
    """
    from driftkit.session import cut_lineage

    tag = horizon.lower().replace(" ", "")
    targets = [c for c in targets if c in df.columns]
    order = [time_col] + [c for c in entity_cols if c not in group_cols]
    # the snapshot is read by the threshold pass, its join and the horizon
    # windows: materialise it once in the shared checkpoint folder
    df = cut_lineage(df)
    thr = expanding_quantile(df, group_cols, order, targets, q, min_periods)
    # W8 columns may come precomputed from the same blocked pass as W2
    fut = thr if future_ready else future_horizon(thr, entity_cols, time_col, targets, horizon, tag=tag, block_us=block_us)
    lab = combine_labels(fut, targets, tag=tag)
    if drop_unlabelled:
        lab = lab.filter(F.col(f"fault_{tag}").isNotNull())
    return lab
