"""Exact expanding quantile without one task per group.

For a group in time order, row i needs the q-quantile (linear interpolation) of
all known values up to and including itself.  Every group is cut into blocks of
``rows_per_block`` rows by its running row number, whatever its size or its
times.  For block j let E_j be the values of all earlier blocks (``before`` of
them) and ``held`` the block's own.  Any row of the block asks for ranks
floor(q (before + p - 1)) and +1 of E_j + (its first p own values), so only E_j's
order statistics in [floor(q (before - 1)) - held - 1, floor(q (before + held - 1)) + 2]
can matter: a slice of about (1 + q) ``held`` values.

1. Running row numbers come from distributed row numbering (``row_numbers``).
2. The values that a later block can ask for (all but those of a group's last block)
   are numbered again in value order and cut into chunks; a table of counts per
   (chunk, block), summed up over earlier blocks and lower chunks, says which ranks
   of E_j a chunk holds.  These counts, the bounds and the routes are DataFrames
   throughout; nothing of them reaches the driver or is broadcast.  Blocks grow with
   the square root of the largest group, however small they are asked to be, so the
   table has at most a quarter of the group's rows.
3. Values are joined to the routes of their chunk.  Chunks that many blocks ask
   are spread over as many salts as they have routes (``ROUTES_PER_SALT`` each).
4. Each (group, block) task puts its slice before its own rows, and all its rows'
   ranks are found at once by descending a wavelet matrix (``range_select``).

Where no group has a second block, nothing is asked and steps 2 and 3 have no rows
to work on; they are left out then.

A task holds one partition of values, or one block and its slice, whatever the
size of a group.  Several value columns share the blocks.  NaN is missing like NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftkit.functions.scalar import nan_to_null
from driftkit.operators.order_stats import range_select
from driftkit.operators.scan import row_numbers
from driftkit.session import cut_lineage

GROUP, KEY, BLK, CHUNK, AT, TO, SALT, OF, ROWS = "_group", "_key", "_blk", "_chunk", "_at", "_to", "_salt", "_of", "_rows"
ROWS_PER_BLOCK = 100_000
ROUTES_PER_SALT = 8


def running_quantiles(slice_sorted: np.ndarray, c0: int, before: int, own: np.ndarray, q: float, min_periods: int) -> np.ndarray:
    """Thresholds for one block's rows in time order.

    Row i asks for ranks of the slice and the own values so far, that is of a prefix
    of both end to end; ``c0`` values lie below the slice."""
    known = ~np.isnan(own)
    seen = before + np.cumsum(known)
    res = np.full(len(own), np.nan)
    merged = np.concatenate([slice_sorted, own[known]])
    ends = len(slice_sorted) + np.cumsum(known)
    at = np.flatnonzero((seen >= max(min_periods, 1)) & (ends > 0))
    if not len(at):
        return res
    place = q * (seen[at] - 1) - c0
    low = np.minimum(np.floor(place).astype(np.int64), ends[at] - 1)
    high = np.minimum(low + 1, ends[at] - 1)
    both = range_select(merged, np.zeros(2 * len(at), np.int64), np.tile(ends[at], 2), np.concatenate([low, high]))
    a, b = both[:len(at)], both[len(at):]
    res[at] = a + (b - a) * (place - np.floor(place))
    return res


def _chunk_routes(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(group, chunk, target block, first, last): positions, among the chunk's values
    of earlier blocks, that the target block asks for."""
    cells = chunks.groupBy(KEY, CHUNK, BLK).agg(F.count(F.lit(1)).alias("n"))
    grid = cells.select(KEY, CHUNK).distinct().join(blocks.select(KEY, BLK, "lo", "hi"), KEY)
    grid = grid.join(cells, [KEY, CHUNK, BLK], "left")
    earlier = Window.partitionBy(KEY, CHUNK).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy(KEY, BLK).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("here", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    grid = grid.withColumn("start", F.coalesce(F.sum("here").over(below), F.lit(0)))
    asked = grid.where("here > 0 AND start <= hi AND start + here > lo")
    return asked.select(
        KEY, CHUNK, F.col(BLK).alias(TO),
        F.greatest(F.col("lo") - F.col("start"), F.lit(0)).alias("first"),
        F.least(F.col("hi") - F.col("start"), F.col("here") - 1).alias("last"),
    )


def _slices(chunks: DataFrame, routes: DataFrame) -> DataFrame:
    """(key, block, value): what each block needs of its group's earlier values."""
    salts = F.ceil(F.col("fan") / ROUTES_PER_SALT)
    fans = routes.groupBy(KEY, CHUNK).agg(F.count(F.lit(1)).alias("fan"))
    values = chunks.join(fans, [KEY, CHUNK]).withColumn(SALT, F.pmod(F.col(AT), salts)).drop("fan")
    fan = F.count(F.lit(1)).over(Window.partitionBy(KEY, CHUNK))
    spread = routes.withColumn("fan", fan).withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("fan")
    sent = values.join(spread, [KEY, CHUNK, SALT]).where(F.col(BLK) < F.col(TO))
    place = F.row_number().over(Window.partitionBy(KEY, CHUNK, TO).orderBy("_v", AT)) - 1
    return sent.withColumn("_place", place).where("_place BETWEEN first AND last").select(
        KEY, TO, F.col("_v").alias("_value"))


def block_rows(least: int, largest: int) -> int:
    """Rows of a block: a group of ``largest`` rows meets (largest / rows)^2 pairs of a chunk
    and a block, which stay below a quarter of its rows."""
    return max(least, math.isqrt(4 * largest))


def expanding_quantile(
    df: DataFrame,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    value_cols: Sequence[str],
    q: float = 0.95,
    min_periods: int = 10,
    suffix: str = "_threshold",
    rows_per_block: int | None = None,
) -> DataFrame:
    """Adds ``<value><suffix>`` for each of ``value_cols``.  Rows are unique in group
    and order columns; the first of ``order_cols`` is the time, the rest break ties.
    ``rows_per_block`` (default ``ROWS_PER_BLOCK``): a block has as many rows, or twice the
    square root of the largest group if that is more."""
    keys = list(dict.fromkeys([*group_cols, *order_cols]))
    held = [f"_v{i}" for i in range(len(value_cols))]
    base = df.select(*keys, F.to_json(F.struct(F.lit(0).alias("_"), *group_cols)).alias(GROUP), *[nan_to_null(F.col(c).cast("double")).alias(v) for c, v in zip(value_cols, held)])
    own, largest = row_numbers(base, [F.col(c) for c in order_cols], [GROUP], AT, ROWS)
    size = block_rows(rows_per_block or ROWS_PER_BLOCK, largest)
    own = own.withColumn(BLK, F.expr(f"({AT} - 1) DIV {size}"))
    schema = T.StructType([*[T.StructField(k, df.schema[k].dataType) for k in keys], *[T.StructField(c + suffix, T.DoubleType()) for c in value_cols]])

    names = schema.names

    def merge(mine: pa.Table, asked: pa.Table | None) -> pa.Table:
        mine = mine.sort_by(AT)
        columns = [mine.column(k) for k in keys]
        for i, v in enumerate(held):
            lo = before = 0
            earlier = np.zeros(0)
            if asked is not None and asked.num_rows:
                part = asked.filter(pc.equal(asked.column(OF), i))
                head = part.filter(pc.is_valid(part.column("before")))
                lo, before = head.column("lo")[0].as_py(), head.column("before")[0].as_py()
                earlier = np.sort(part.column("_value").drop_null().to_numpy())
            found = running_quantiles(earlier, lo, before, mine.column(v).to_numpy(), q, min_periods)
            columns.append(pa.array(found, from_pandas=True))
        return pa.table(columns, names=names)

    grouped = own.select(GROUP, BLK, AT, *keys, *held).groupBy(GROUP, BLK)
    if largest <= size:
        found = grouped.applyInArrow(lambda mine: merge(mine, None), schema)
    else:
        found = grouped.cogroup(_asked(own, held, size, q).groupBy("_to_group", TO)).applyInArrow(merge, schema)
    found = found.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return df.join(found, same, "left").drop(*[f"_k_{k}" for k in keys])


def _asked(own: DataFrame, held: Sequence[str], size: int, q: float) -> DataFrame:
    """(group, block, column, value | bounds): each block's slice of earlier values, and
    one row with the first rank of the slice and the number of earlier values."""
    entry = F.explode(F.array(*[F.struct(F.lit(i).alias(OF), F.col(v).alias("_v")) for i, v in enumerate(held)]))
    long = own.select(GROUP, BLK, AT, ROWS, entry.alias("_e")).select(GROUP, BLK, AT, ROWS, f"_e.{OF}", "_e._v")
    long = long.withColumn(KEY, F.concat(F.col(OF).cast("string"), F.col(GROUP)))
    earlier = Window.partitionBy(KEY).orderBy(BLK).rowsBetween(Window.unboundedPreceding, -1)
    blocks = long.groupBy(KEY, GROUP, OF, BLK).agg(F.count("_v").alias("held"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("held").over(earlier), F.lit(0)))
    below = F.floor(F.lit(q) * (F.col("before") - 1)) - F.col("held") - 1
    above = F.floor(F.lit(q) * (F.col("before") + F.col("held") - 1)) + 2
    blocks = cut_lineage(blocks.withColumns({"lo": F.greatest(below, F.lit(0)), "hi": F.least(above, F.col("before") - 1)}))
    asked_for = F.col("_v").isNotNull() & (F.col(BLK) < F.expr(f"({ROWS} - 1) DIV {size}"))
    ranked, _ = row_numbers(long.where(asked_for).select(KEY, BLK, AT, "_v"), [F.col("_v"), F.col(AT)], [KEY], "_rank", "_all")
    chunks = ranked.select(KEY, F.expr(f"(_rank - 1) DIV {size}").alias(CHUNK), BLK, AT, "_v")
    slices = _slices(chunks, cut_lineage(_chunk_routes(chunks, blocks)))
    heads = blocks.select(F.col(GROUP).alias("_to_group"), F.col(BLK).alias(TO), OF, F.lit(None).cast("double").alias("_value"), "lo", "before")
    names = blocks.select(KEY, GROUP, OF).distinct()
    none = F.lit(None).cast("long")
    values = slices.join(names, KEY).select(F.col(GROUP).alias("_to_group"), TO, OF, "_value", none.alias("lo"), none.alias("before"))
    return values.unionByName(heads)
