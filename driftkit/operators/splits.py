"""Time order, row index and splits.

The global row index is built without a single-task window and without a copy of
the wide rows: only the key columns are range-partitioned and checkpointed (stable
ranges, survives executor loss).  The least key and the row count of each range (a
row per range) tell every row its range and that range's first index; rows are
numbered inside their range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkit.session import cut_lineage


def row_index(df: DataFrame, order_cols: Sequence[str], index_col: str = "row_index") -> DataFrame:
    """0-based position in ascending ``order_cols`` order, NULL first (break ties with a
    unique id: rows with equal keys are numbered in any order).  Lazy apart from the
    checkpoint of the keys; cut the result's lineage where several jobs read it."""
    order = [F.col(c) for c in order_cols]
    key = F.struct(*order)
    keys = cut_lineage(df.select(key.alias("_key")).repartitionByRange(F.col("_key")))
    ranges = cut_lineage(keys.groupBy(F.spark_partition_id().alias("_pid")).agg(F.min("_key").alias("_least"), F.count(F.lit(1)).alias("_n")))
    by_key = Window.orderBy("_least")
    first = F.coalesce(F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select(F.row_number().over(by_key).alias("_range"), first.alias("_off"))
    least = ranges.agg(F.array_sort(F.collect_list("_least")).alias("_all")).scalar()
    # the last range whose least key is not above the row's: halving steps over the sorted bounds
    steps = ranges.count().bit_length()
    placed = df.withColumns({"_bounds": least, "_key": key})
    here = F.aggregate(
        F.array(*[F.lit(1 << i) for i in reversed(range(steps))]),
        F.lit(0),
        lambda at, step: F.when((at + step <= F.size("_bounds")) & (F.get("_bounds", at + step - 1) <= F.col("_key")), at + step).otherwise(at),
    ) if steps else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    numbered = placed.withColumn("_range", here).drop("_bounds", "_key").withColumn("_inside", inside)
    # one row per range: a proven bound
    joined = numbered.join(F.broadcast(offsets), "_range")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_off") + F.col("_inside") - 1).alias(index_col))


def chronological_cutoff(df: DataFrame, time_col: str, ratio: float = 0.8, tie_cols: Sequence[str] = ()):
    """The time stamp at row int(n * ratio) in time order.

    Only the time matters (ties cannot change it), so rows are counted per
    distinct time and the first time whose cumulative count exceeds k is the
    cutoff - distributed prefix sum over distinct times, one scan of ``df``."""
    from driftkit.operators.scan import prefix_sums

    counts = df.groupBy(time_col).agg(F.count(F.lit(1)).alias("_w"))
    cum = prefix_sums(counts, [F.col(time_col)], ["_w"])
    n = cum.agg(F.max("_w_cum")).first()[0] or 0
    k = int(n * ratio)
    return cum.filter(F.col("_w_cum") > k).agg(F.min(time_col)).first()[0]


def chronological_split(df: DataFrame, time_col: str, ratio: float = 0.8, tie_cols: Sequence[str] = ()):
    """train = time < cutoff, test = time >= cutoff."""
    cut = chronological_cutoff(df, time_col, ratio, tie_cols)
    return df.filter(F.col(time_col) < F.lit(cut)), df.filter(F.col(time_col) >= F.lit(cut)), cut


def positional_split(indexed: DataFrame, n: int, ratio: float = 0.75, index_col: str = "row_index"):
    """First int(n * ratio) rows train, the rest test."""
    k = int(n * ratio)
    return indexed.filter(F.col(index_col) < k), indexed.filter(F.col(index_col) >= k)


def expanding_folds(n: int, k: int) -> list[dict]:
    """T8 bounds: test = n // (k + 1) rows, the last k blocks; train = all rows before."""
    if k < 2:
        raise ValueError("expanding folds need k >= 2")
    test = n // (k + 1)
    if test < 1:
        raise ValueError(f"too few rows ({n}) for {k} folds")
    first = n - k * test
    out = []
    for f in range(1, k + 1):
        s = first + (f - 1) * test
        out.append({"fold": f, "train_start": 0, "train_end": s - 1, "valid_start": s, "valid_end": s + test - 1})
    return out


def fold_column(n: int, k: int, index_col: str = "row_index") -> Column:
    """T8 as a column: fold number whose validation block holds the row (NULL for the
    train-only head)."""
    test = n // (k + 1)
    first = n - k * test
    i = F.col(index_col)
    return F.when(i >= first, ((i - F.lit(first)) / F.lit(test)).cast("int") + 1)


def fold_summary(indexed: DataFrame, n: int, k: int, label: str, index_col: str = "row_index") -> DataFrame:
    """T8 per fold: sizes, index bounds and positive rates of train and validation,
    from one aggregation over validation blocks plus cumulative sums."""
    test = n // (k + 1)
    first = n - k * test
    blk = F.when(F.col(index_col) >= first, ((F.col(index_col) - F.lit(first)) / F.lit(test)).cast("int") + 1).otherwise(0)
    per = indexed.groupBy(blk.alias("fold")).agg(
        F.count(F.lit(1)).alias("valid_size"), F.sum(F.col(label).cast("double")).alias("valid_pos"),
        F.min(index_col).alias("valid_start_index"), F.max(index_col).alias("valid_end_index"),
    )
    w = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    out = per.select(
        "*", F.sum("valid_size").over(w).alias("train_size"), F.sum("valid_pos").over(w).alias("train_pos")
    ).filter(F.col("fold") >= 1)
    return out.select(
        "fold", F.col("train_size").cast("long").alias("train_size"), "valid_size",
        F.lit(0).cast("long").alias("train_start_index"), (F.col("valid_start_index") - 1).alias("train_end_index"),
        "valid_start_index", "valid_end_index",
        (F.col("train_pos") / F.col("train_size")).alias("train_positive_rate"),
        (F.col("valid_pos") / F.col("valid_size")).alias("valid_positive_rate"),
    )


def head_in_time_order(df: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """T4: first ``n`` rows in time order (TakeOrderedAndProject)."""
    return df.orderBy(*order_cols).limit(n)


def deterministic_sample(df: DataFrame, n: int, id_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """T5: seeded sample of ``n`` rows without replacement, reproducible across runs
    and cluster sizes (order by the md5 of seed and row key, which plain SQL can restate)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in id_cols])), *id_cols).limit(n)


def top_k(df: DataFrame, by: str | Column, k: int, by_abs: bool = False, ties: Sequence[str] = ()) -> DataFrame:
    """Top ``k`` by value (or |value|) descending; ties broken by ``ties``."""
    c = F.col(by) if isinstance(by, str) else by
    key = F.abs(c) if by_abs else c
    return df.orderBy(key.desc_nulls_last(), *ties).limit(k)


def sort_for_write(df: DataFrame, partition_cols: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Order only where it matters - inside output files, no global sort."""
    return df.repartition(*partition_cols).sortWithinPartitions(*order_cols) if partition_cols else df.sortWithinPartitions(*order_cols)
