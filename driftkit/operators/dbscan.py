"""Density clustering on two or three columns (M40), rho-approximate.

Space is cut into cells of side eps / sqrt(d), so points of one cell are neighbours,
and cells into sub-cells of a share ``rho`` of that side.  Points are counted per
sub-cell first and from there on stand at its centre, which moves each by at most
rho * eps / 2: the result is that of exact DBSCAN on the moved points, and lies
between those of eps (1 - rho) and eps (1 + rho) on the points themselves.  A cell
holds at most (1 / rho) ** d sub-cells, whatever the number of points, so no task
holds a dense cell's points and no pairs of points are made.

* Each cell's sub-cells are sent to the cells that a distance of eps can reach; a
  sub-cell is core if those within eps (itself included) hold ``min_samples`` points.
* Core sub-cells of one cell are one cluster; two cells join where a core sub-cell of
  one is within eps of a core sub-cell of the other; clusters are the connected
  components of the cells.
* Other sub-cells go to the cluster of the nearest core sub-cell within eps (ties: the
  smaller cell), or are noise (-1).

Clusters are numbered from 0 by their smallest cell.  Rows with a NULL, NaN or infinite
coordinate are noise.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftkit.session import cut_lineage

NOISE = -1
SUB = "_sub"
CELL = "_cell"


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label): the smallest node of each node's connected component; ``links``
    (a, b) hold every node at least as (a, a).  Ends with an error if ``max_rounds``
    rounds do not settle it."""
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    label = cut_lineage(both.groupBy("a").agg(F.min("b").alias("label")))
    for _ in range(max_rounds):
        # the least label of the neighbours, then the label of that label
        near = both.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        up = label.select(F.col("a").alias("near"), F.col("label").alias("up"))
        new = cut_lineage(near.join(up, "near").select("a", F.least("near", "up").alias("label")))
        changed = new.join(label.withColumnRenamed("label", "old"), "a").where("label <> old").limit(1).count()
        label = new
        if not changed:
            return label.withColumnRenamed("a", "node")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def dbscan(df: DataFrame, columns: Sequence[str], eps: float, min_samples: int, rho: float = 0.1, out: str = "cluster") -> DataFrame:
    """``df`` with the column ``out``: cluster number, or -1 for noise."""
    d, per_side = len(columns), max(1, round(1 / rho))
    if d not in (2, 3):
        raise ValueError("two or three columns")
    bits = 62 // d
    half = 1 << (bits - 1)
    side = eps / math.sqrt(d) / per_side
    x = [F.col(c).cast("double") for c in columns]
    known = F.lit(True)
    for c in x:
        known = known & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    subs = [F.when(known, F.floor(c / side).cast("long")) for c in x]
    placed = df.select("*", *[s.alias(f"{SUB}{i}") for i, s in enumerate(subs)])
    keys = [f"{SUB}{i}" for i in range(d)]
    counted = placed.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def cell_id(shift: Sequence[int] = (0,) * 3):
        """One long for a cell; coordinates that would not fit end with an error."""
        total = F.lit(0).cast("long")
        for k, s in zip(keys, shift):
            at = F.floor(F.col(k) / per_side).cast("long") + s + half
            total = total * (1 << bits) + F.when((at >= 0) & (at < 1 << bits), at).otherwise(F.raise_error(F.lit("eps is too small for the range of the columns")).cast("long"))
        return total

    reach = [s for s in itertools.product(range(-2, 3), repeat=d) if sum(max(abs(v) - 1, 0) ** 2 for v in s) < d]
    counted = cut_lineage(counted.withColumn(CELL, cell_id()))

    def sent(rows: DataFrame, *fields: str) -> DataFrame:
        """Sub-cells, once for each cell that can reach them."""
        return rows.select(*keys, *fields, CELL, F.explode(F.array(*[cell_id(s) for s in reach])).alias("_to"))

    def near(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Own rows of a cell, and which of all rows are within eps of each."""
        spots = np.stack([table.column(k).to_numpy() for k in keys], axis=1)
        own = np.flatnonzero(table.column(CELL).to_numpy() == table.column("_to").to_numpy())
        apart = ((spots[own][:, None].astype(float) - spots[None]) ** 2).sum(axis=2) * side * side
        return own, apart, apart <= eps * eps * (1 + 1e-12)

    def core_of(table: pa.Table) -> pa.Table:
        own, _, within = near(table)
        n = table.column("n").to_numpy()
        return pa.table([table.column(k).take(pa.array(own)) for k in (*keys, CELL)] + [pa.array(within @ n >= min_samples)], names=[*keys, CELL, "core"])

    shape = ", ".join(f"{k} long" for k in keys)
    cores = cut_lineage(sent(counted, "n").groupBy("_to").applyInArrow(core_of, f"{shape}, {CELL} long, core boolean"))

    def links_of(table: pa.Table) -> pa.Table:
        """Per own sub-cell the cell it follows (NULL: none), per pair of cells a link."""
        own, apart, within = near(table)
        cell, core = table.column(CELL).to_numpy(), table.column("core").to_numpy()
        within &= core
        follows = []
        for i, row in enumerate(own):
            if core[row]:
                follows.append(int(cell[row]))
            else:
                at = np.flatnonzero(within[i])
                follows.append(int(cell[at[np.lexsort((cell[at], apart[i, at]))[0]]]) if len(at) else None)
        joined = np.unique(cell[within[core[own]].any(axis=0)]) if core[own].any() else np.zeros(0, np.int64)
        here = table.column("_to")[0].as_py()
        none = [None] * len(joined)
        columns = [pa.concat_arrays([table.column(k).take(pa.array(own)).combine_chunks(), pa.array(none, pa.int64())]) for k in keys]
        return pa.table([*columns, pa.array([*follows, *none], pa.int64()), pa.array([None] * len(own) + [here] * len(joined), pa.int64()),
                         pa.array([None] * len(own) + joined.tolist(), pa.int64())], names=[*keys, "follows", "a", "b"])

    found = cut_lineage(sent(cores, "core").groupBy("_to").applyInArrow(links_of, f"{shape}, follows long, a long, b long"))
    label = components(found.where("a IS NOT NULL").select("a", "b"))
    # one row per cluster: numbered by its smallest cell
    number = label.select("label").distinct().withColumn(out, (F.row_number().over(Window.orderBy("label")) - 1).cast("int"))
    named = label.join(number, "label").select(F.col("node").alias("follows"), out)
    by_sub = found.where("a IS NULL AND follows IS NOT NULL").join(named, "follows").select(*keys, out)
    return placed.join(by_sub, keys, "left").withColumn(out, F.coalesce(out, F.lit(NOISE))).drop(*keys)
