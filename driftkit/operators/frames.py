"""Time-blocked window frames.

A window partitioned only by a coarse key (a device group, or one very busy
device) puts every row of that key into one task.  For frames bounded in time
(look back L, look ahead A) the rows of a key can instead be cut into time
blocks of width B: each row is copied into the neighbouring blocks whose rows
can see it, the window runs per (key, block), and only each block's own rows
are kept.  Results are exact; the data grows by about (L + A) / B.

Unbounded "previous row" lookups (lag) use the same blocks plus a small
per-block tail table that carries the last row of the previous non-empty block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkit.functions.scalar import epoch_micros

T_US = "_t_us"
BLOCK = "_blk"
HOME = "_home"

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def parse_duration_us(value: str | int | float) -> int:
    """'6h', '24h', '30min', '2d', '90s' or a number of microseconds -> microseconds."""
    if isinstance(value, (int, float)):
        return int(value)
    s = value.strip().lower().replace(" ", "")
    units = [("ms", 1_000), ("us", 1), ("min", 60_000_000), ("d", DAY_US), ("h", HOUR_US), ("m", 60_000_000), ("s", 1_000_000)]
    for suffix, mult in units:
        if s.endswith(suffix):
            return int(float(s[: -len(suffix)]) * mult)
    return int(float(s))


def default_block_us(lookback_us: int, lookahead_us: int) -> int:
    """Blocks 8x the frame reach (>= 1 day): about 12 % duplicated rows."""
    return max(DAY_US, 8 * max(lookback_us, lookahead_us, 1))


def with_micros(df: DataFrame, time_col: str) -> DataFrame:
    return df.withColumn(T_US, epoch_micros(time_col))


def into_blocks(df: DataFrame, time_col: str, lookback_us: int, lookahead_us: int, block_us: int | None = None) -> tuple[DataFrame, bool]:
    """Add the microsecond time, ``_blk`` (one row per block that needs the row) and
    ``_home`` (own block); False and the time alone where ``block_us`` is 0."""
    if block_us is None:
        block_us = default_block_us(lookback_us, lookahead_us)
    t = epoch_micros(time_col)
    if not block_us:
        return df.select("*", t.alias(T_US)), False
    own = F.floor(t / F.lit(block_us))
    lo = F.floor((t - F.lit(lookahead_us)) / F.lit(block_us))
    hi = F.floor((t + F.lit(lookback_us)) / F.lit(block_us))
    spread = F.when(lo == hi, F.array(own)).otherwise(F.sequence(lo, hi))
    staged = df.select("*", t.alias(T_US), F.explode(spread).alias(BLOCK))
    return staged.withColumn(HOME, F.col(BLOCK) == F.floor(F.col(T_US) / F.lit(block_us))), True


def blocked_window(partition_cols: Sequence[str], blocked: bool) -> Window:
    keys = list(partition_cols) + ([BLOCK] if blocked else [])
    return Window.partitionBy(*keys).orderBy(T_US) if keys else Window.orderBy(T_US)


def apply_bounded_frames(
    df: DataFrame,
    partition_cols: Sequence[str],
    time_col: str,
    build: "callable",
    lookback_us: int,
    lookahead_us: int,
    block_us: int | None = None,
) -> DataFrame:
    """Run ``build(base_window, df) -> list[Column]`` on time-blocked partitions.

    ``build`` receives a window partitioned by keys (+ block) and ordered by the
    microsecond time, and returns the new columns (already aliased).  Rows keep
    their original columns.  ``block_us=0`` disables blocking.
    """
    staged, blocked = into_blocks(df, time_col, lookback_us, lookahead_us, block_us)
    w = blocked_window(partition_cols, blocked)
    new_cols = build(w, staged)
    if blocked:
        return staged.select(*[F.col(c) for c in df.columns], *new_cols, F.col(HOME)).filter(F.col(HOME)).drop(HOME)
    return staged.select(*[F.col(c) for c in df.columns], *new_cols)


def blocked_lag(
    df: DataFrame,
    partition_cols: Sequence[str],
    time_col: str,
    value_cols: Sequence[str],
    suffix: str = "_last_prev",
    block_us: int | None = DAY_US * 7,
    tie_cols: Sequence[str] = (),
) -> DataFrame:
    """Previous row's value (NULLs included) per key in time order, without
    putting a whole key into one task.

    Inside a block it is ``lag``; the first row of a block takes the last row of
    the previous non-empty block from a tail table with one row per block.
    """
    order_cols = [T_US, *tie_cols]
    staged = with_micros(df, time_col)
    if not block_us:
        w = Window.partitionBy(*partition_cols).orderBy(*order_cols)
        return staged.select(*df.columns, *[F.lag(c, 1).over(w).alias(c + suffix) for c in value_cols])
    staged = staged.withColumn(BLOCK, F.floor(F.col(T_US) / F.lit(block_us)))
    keys = list(partition_cols) + [BLOCK]
    w = Window.partitionBy(*keys).orderBy(*order_cols)
    # one window pass: in-block lag, first-row and last-row flags
    inner = staged.select(
        *df.columns, BLOCK,
        (F.row_number().over(w) == 1).alias("_first"),
        F.lead(F.lit(1), 1).over(w).isNull().alias("_last"),
        *[F.lag(c, 1).over(w).alias("_lag_" + c) for c in value_cols],
    )
    # the block tails come from the same windowed frame (its exchange is reused),
    # one row per block; the previous non-empty block's tail follows by lag
    tails = inner.filter(F.col("_last")).select(*keys, F.struct(*[F.col(c).alias("_v_" + c) for c in value_cols]).alias("_tail"))
    wb = Window.partitionBy(*partition_cols).orderBy(BLOCK) if partition_cols else Window.orderBy(BLOCK)
    prev = tails.select(*[F.col(k).alias("_pk_" + k) for k in keys], F.lag("_tail", 1).over(wb).alias("_prev"))
    # null-safe keys: no IS NOT NULL is inferred into the tails branch, so both
    # branches stay identical up to the window's exchange and AQE reuses it
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col("_pk_" + k))
        cond = c if cond is None else cond & c
    joined = inner.join(prev, on=cond, how="left")
    lagged = [
        F.when(F.col("_first"), F.col("_prev")["_v_" + c]).otherwise(F.col("_lag_" + c)).alias(c + suffix)
        for c in value_cols
    ]
    return joined.select(*df.columns, *lagged)

