"""Exact quantiles without one buffer per group (whole columns, coarse groups).

Built-in ``percentile`` / ``median`` keep every distinct value of a group in one
aggregation buffer - right for per-key medians, wrong for a whole column or a
group holding a third of the table.  Here values are counted per distinct value
(map-side combined), cumulative counts come from the distributed prefix sum,
and the order statistics at ranks floor/ceil(p (n - 1)) are picked by one
conditional ``min`` per probability: linear interpolation, identical to
``percentile`` / numpy / pandas / DuckDB ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.operators.scan import prefix_sums


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                    names: Sequence[str] | None = None, weight_col: str | None = None) -> DataFrame:
    """One row per group: ``n`` and one column per probability (NULL when n = 0).
    ``weight_col``: integer multiplicity per row (pre-counted values)."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    const = not group_cols
    groups = ["_g"] if const else list(group_cols)
    x = F.col(value_col).cast("double")
    w = F.col(weight_col).cast("long") if weight_col else F.lit(1).cast("long")
    base = df.select(*([F.lit(0).alias("_g")] if const else [F.col(g) for g in groups]), x.alias("_x"), w.alias("_c"))
    base = base.filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    vc = base.groupBy(*groups, "_x").agg(F.sum("_c").alias("_w"))
    cum = prefix_sums(vc, [F.col("_x")], ["_w"], groups)
    # from the checkpointed sums: the values are counted once
    tot = cum.groupBy(*groups).agg(F.max("_w_cum").alias("_n"))
    j = cum.join(tot, groups)
    aggs = [F.first("_n").alias("n")]
    for i, p in enumerate(probs):
        r = F.lit(float(p)) * (F.col("_n") - 1)
        lo, hi = F.floor(r), F.ceil(r)
        aggs += [F.min(F.when(F.col("_w_cum") > lo, F.col("_x"))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("_w_cum") > hi, F.col("_x"))).alias(f"_hi{i}"),
                 F.first(r - lo).alias(f"_f{i}")]
    a = j.groupBy(*groups).agg(*aggs)
    out = a.select(*([] if const else groups), "n",
                   *[(F.col(f"_lo{i}") + F.col(f"_f{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(nm)
                     for i, nm in enumerate(names)])
    return out


def exact_column_medians(df: DataFrame, cols: Sequence[str]) -> dict:
    """Medians of many columns in one pipeline: unpivot to (feature, value), group by feature."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v"))
                                          for c in cols])).alias("s")).select("s.feature", "s.v")
    rows = exact_quantiles(long, "v", [0.5], ["feature"], ["median"]).collect()
    got = {r["feature"]: r["median"] for r in rows}
    return {c: got.get(c) for c in cols}
