"""Causal history features (W1-W6, W10): each value at time t uses rows <= t only.

* W1 ``capped_forward_fill``       - fill a NULL with the last observation if it is at most ``max_age`` old
* W2 ``last_observation_features`` - last value (current row included), its age in hours, was-missing flag
* W3 ``previous_value``            - previous row's value, NULLs included
* W4-W6 ``rolling_features``       - left-closed [t - w, t) mean/max/min/std(pop)/count/median
* W10 ``autoregressive_lag``       - lag of a target after dropping NULL targets

All frames are bounded in time (an age cap bounds W1/W2), so they run on
time-blocked partitions (``frames.apply_bounded_frames``) and a hot key is
spread over many tasks.  Keys must be unique per time stamp (true after the
pivot/medians), as RANGE frames treat equal times as peers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit.operators import frames
from driftkit.operators.frames import T_US, parse_duration_us
from driftkit.operators.order_stats import range_quantiles, range_summaries

STATS = ("mean", "max", "min", "std", "count")
ROWS_AT_ONCE = 50_000


def capped_forward_fill(
    df: DataFrame,
    group_cols: Sequence[str],
    time_col: str,
    value_cols: Sequence[str],
    max_age: str | int = "6h",
    block_us: int | None = None,
) -> DataFrame:
    """NULL -> last non-NULL value of the same group if observed within ``max_age`` (inclusive)."""
    cap = parse_duration_us(max_age)
    value_cols = [c for c in value_cols if c in df.columns]
    if not value_cols:
        return df

    def build(w, staged):
        fw = w.rangeBetween(-cap, 0)
        return [F.last(c, ignorenulls=True).over(fw).alias("_ff_" + c) for c in value_cols]

    out = frames.apply_bounded_frames(df, group_cols, time_col, build, lookback_us=cap, lookahead_us=0, block_us=block_us)
    return out.select(
        *[F.coalesce(F.col(c), F.col("_ff_" + c)).alias(c) if c in value_cols else F.col(c) for c in df.columns]
    )


def last_observation_features(
    df: DataFrame,
    group_cols: Sequence[str],
    time_col: str,
    value_cols: Sequence[str],
    max_age: str | int = "24h",
    include_missing_indicators: bool = True,
    block_us: int | None = None,
) -> DataFrame:
    """``<c>_last_obs``, ``<c>_last_obs_age_hours`` (NULL if never seen or older than
    ``max_age``), ``<c>_was_missing`` (1 if the current value is NULL).  Original columns untouched."""
    cap = parse_duration_us(max_age)
    value_cols = [c for c in value_cols if c in df.columns]
    if not value_cols:
        return df

    def build(w, staged):
        return last_observation_columns(w, value_cols, cap, include_missing_indicators)

    return frames.apply_bounded_frames(df, group_cols, time_col, build, lookback_us=cap, lookahead_us=0, block_us=block_us)


def last_observation_columns(w, value_cols: Sequence[str], cap: int, include_missing_indicators: bool = True) -> list:
    """W2 column expressions over a window ordered by microsecond time."""
    fw = w.rangeBetween(-cap, 0)
    cols = []
    for c in value_cols:
        seen_at = F.last(F.when(F.col(c).isNotNull(), F.col(T_US)), ignorenulls=True).over(fw)
        cols.append(F.last(c, ignorenulls=True).over(fw).alias(c + "_last_obs"))
        cols.append(((F.col(T_US) - seen_at) / F.lit(float(frames.HOUR_US))).alias(c + "_last_obs_age_hours"))
        if include_missing_indicators:
            cols.append(F.col(c).isNull().cast("int").alias(c + "_was_missing"))
    return cols


def previous_value(
    df: DataFrame,
    group_cols: Sequence[str],
    time_col: str,
    value_cols: Sequence[str],
    suffix: str = "_last_prev",
    block_us: int | None = frames.DAY_US * 7,
) -> DataFrame:
    """The previous row's value per group (NULL if that row's value is NULL)."""
    return frames.blocked_lag(df, group_cols, time_col, value_cols, suffix=suffix, block_us=block_us)


def rolling_features(
    df: DataFrame,
    group_cols: Sequence[str],
    time_col: str,
    source_cols: Sequence[str],
    windows: Sequence[str] = ("6h", "12h", "24h"),
    statistics: Sequence[str] = STATS,
    closed: str = "left",
    min_periods: int = 1,
    include_last_previous_value: bool = True,
    block_us: int | None = None,
) -> DataFrame:
    """W3 + W4-W6: per source column ``<c>_last_prev`` and ``<c>_<stat>_prev_<w>``.

    ``closed``: "left" [t-w, t) (default), "right" (t-w, t], "both" [t-w, t], "neither" (t-w, t).
    ``count`` is NULL when the frame holds no rows, else the non-NULL count
    (0 when all are NULL); other statistics are NULL below ``min_periods``
    non-NULL values; std uses ddof 0.  NaN is missing like NULL.
    """
    source_cols = [c for c in source_cols if c in df.columns]
    if not source_cols:
        return df
    spans = [(w.lower().replace(" ", ""), parse_duration_us(w)) for w in windows]
    if unknown := set(statistics) - {*STATS, "median"}:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    out = _rolled(df, list(group_cols), time_col, source_cols, spans, list(statistics), closed, min_periods, block_us)
    if include_last_previous_value:
        out = previous_value(out, group_cols, time_col, source_cols)
        ordered = list(df.columns)
        for c in source_cols:
            ordered.append(c + "_last_prev")
            ordered += [f"{c}_{stat}_prev_{name}" for name, _ in spans for stat in statistics]
        out = out.select(*ordered)
    return out


def frame_columns(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, statistics: Sequence[str], min_periods: int) -> list[pa.Array]:
    """One column per statistic over index ranges [lo, hi) of ``values`` (NaN: missing)."""
    known = ~np.isnan(values)
    before = np.concatenate([[0], np.cumsum(known)])
    a, b = before[lo], before[hi]
    n_obs = b - a
    enough = (n_obs >= min_periods) & (n_obs > 0)
    a, b, kept = a[enough], b[enough], values[known]
    found = range_summaries(kept, a, b) if set(statistics) & {"mean", "max", "min", "std"} else {}
    found["std"] = np.sqrt(found["m2"] / (b - a)) if found else None
    found["median"] = range_quantiles(kept, a, b, 0.5) if "median" in statistics else None
    out = []
    for stat in statistics:
        if stat == "count":
            rows = hi - lo
            out.append(pa.array(n_obs.astype(float), mask=(rows < min_periods)))
        else:
            column = np.zeros(len(lo))
            column[enough] = found[stat]
            out.append(pa.array(column, mask=~enough))
    return out


def _rolled(df: DataFrame, keys: list[str], time_col: str, sources: list[str], spans: list, statistics: list[str], closed: str, min_periods: int, block_us: int | None) -> DataFrame:
    """Frames of each row, answered in streams.

    A task reads the rows of a (key, time block) in time order and keeps those that
    later frames can still reach; new rows are answered in runs as long as what is
    kept, so the work is rows x log(rows in a run) however many rows a frame holds,
    and a task's memory follows the longest frame, not the block."""
    reach = max(s for _, s in spans)
    staged, blocked = frames.into_blocks(df, time_col, lookback_us=reach, lookahead_us=0, block_us=block_us)
    by = [*keys, *([frames.BLOCK] if blocked else [])]
    home = F.col(frames.HOME) if blocked else F.lit(True)
    values = [F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(sources)]
    staged = staged.select(*df.columns, F.col(T_US), home.alias(frames.HOME), *([F.col(frames.BLOCK)] if blocked else []), *values)
    dealt = (staged.repartition(*by) if by else staged.coalesce(1)).sortWithinPartitions(*by, T_US)
    names = [f"{c}_{stat}_prev_{name}" for c in sources for name, _ in spans for stat in statistics]
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])
    own_columns, answer_names = list(df.columns), schema.names
    lo_side = "left" if closed in ("left", "both") else "right"
    hi_side = "right" if closed in ("right", "both") else "left"

    def answer(held: pa.Table, first: int, last: int) -> pa.Table:
        t = held.column(T_US).to_numpy()
        own = first + np.flatnonzero(held.column(frames.HOME).to_numpy()[first:last])
        ranges = [(np.searchsorted(t, t[own] - span, lo_side), np.searchsorted(t, t[own], hi_side)) for _, span in spans]
        columns = held.select(own_columns).take(pa.array(own)).columns
        for i in range(len(sources)):
            v = held.column(f"_v{i}").to_numpy(zero_copy_only=False)
            for lo, hi in ranges:
                columns += frame_columns(v, lo, np.maximum(lo, hi), statistics, min_periods)
        return pa.table(columns, names=answer_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        key, parts, done = None, [], 0  # the rows held, and how many of them are answered

        def take(final: bool) -> Iterable[pa.RecordBatch]:
            nonlocal parts, done
            held = pa.Table.from_batches(parts).combine_chunks()
            t = held.column(T_US).to_numpy()
            end = len(t) if final else int(np.searchsorted(t, t[-1]))  # rows of equal time wait for each other
            if end > done:
                yield from answer(held, done, end).combine_chunks().to_batches()
            if not final:
                keep = int(np.searchsorted(t, t[max(end - 1, 0)] - reach))
                done, parts = end - keep, held.slice(keep).to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy() for c in by]
            change = np.zeros(batch.num_rows - 1, bool)
            for c in codes:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                own = tuple(batch.column(c)[a].as_py() for c in by)
                if parts and own != key:
                    yield from take(True)
                    parts, done = [], 0
                key = own
                parts.append(batch.slice(a, b - a))
                if sum(p.num_rows for p in parts) >= max(ROWS_AT_ONCE, 2 * done):
                    yield from take(False)
        if parts:
            yield from take(True)

    return dealt.mapInArrow(run, schema)


def autoregressive_lag(
    df: DataFrame,
    group_cols: Sequence[str],
    time_col: str,
    target: str,
    suffix: str = "_prev",
    block_us: int | None = frames.DAY_US * 7,
    tie_cols: Sequence[str] = (),
) -> DataFrame:
    """W10 + P17: drop NULL targets, add ``<target>_prev`` (previous non-NULL target), drop rows without it.
    ``tie_cols`` order rows sharing a time stamp."""
    kept = df.filter(F.col(target).isNotNull())
    lagged = frames.blocked_lag(kept, group_cols, time_col, [target], suffix=suffix, block_us=block_us, tie_cols=tie_cols)
    return lagged.filter(F.col(target + suffix).isNotNull())
