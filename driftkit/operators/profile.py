"""Profiling aggregates (A5-A22).  Each is one aggregation job (two where a data
range is needed first); wide per-column statistics are computed in one pass
and unpivoted, never one job per column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from driftkit.operators.gram import pairwise_correlations
from driftkit.operators.prune import ID_COLUMNS
from driftkit.operators.quantiles import exact_quantiles
from driftkit.session import cut_lineage


def numeric_cols(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def _unpivot(row_df: DataFrame, cols: Sequence[str], name: str, value: str) -> DataFrame:
    return row_df.unpivot([], list(cols), name, value)


def missing_rates(df: DataFrame, cols: Sequence[str] | None = None, only_positive: bool = True) -> DataFrame:
    """A5: (column, missing_rate) sorted descending, only rates > 0."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    out = _unpivot(one, cols, "column", "missing_rate")
    if only_positive:
        out = out.filter(F.col("missing_rate") > 0)
    return out.orderBy(F.col("missing_rate").desc(), F.col("column"))


def stored_with_profile(df: DataFrame, protected: Iterable[str] = (), id_cols: Iterable[str] = ID_COLUMNS) -> tuple[DataFrame, dict]:
    """P8 + A5 + A12 in the pass that stores the frame: rows, and per column the present
    values and whether they are all equal, observed while the checkpoint is written.
    Returns the stored frame without its all-missing and constant columns (ids and
    ``protected`` stay), and {"all_missing", "constant", "shape", "missingness"};
    ``missingness`` holds rates above 0, largest first.  Without rows: rates are left
    out and every unprotected column is all-missing."""
    seen = Observation()
    metrics = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        column = F.col(f"`{c}`")
        metrics += [F.count(column).alias(f"n{i}"), (F.min(column) == F.max(column)).alias(f"eq{i}")]
    stored = cut_lineage(df.observe(seen, *metrics))
    got = seen.get
    rows, present = got["rows"], {c: got[f"n{i}"] for i, c in enumerate(df.columns)}
    candidates = [c for c in df.columns if c not in {*protected, *id_cols}]
    equal = {c for i, c in enumerate(df.columns) if got[f"eq{i}"]}
    stats = {
        "all_missing": sorted(c for c in candidates if present[c] == 0),
        "constant": sorted(c for c in candidates if present[c] > 0 and c in equal),
    }
    kept = stored.drop(*stats["all_missing"], *stats["constant"])
    rates = {c: 1 - present[c] / rows for c in kept.columns if present[c] < rows}
    stats["shape"] = [rows, len(kept.columns)]
    stats["missingness"] = dict(sorted(rates.items(), key=lambda r: (-r[1], r[0])))
    return kept, stats


def value_counts(df: DataFrame, col: str, top: int | None = 20) -> DataFrame:
    """Counts per value, NULL included, most frequent first (ties by value)."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), F.col(col).asc_nulls_first())
    return out.limit(top) if top else out


def range_profile(df: DataFrame, col: str) -> DataFrame:
    """Min, max and number of distinct non-NULL values."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"), F.count_distinct(col).alias("nunique"))


def key_counts(df: DataFrame, edge_keys: Sequence[str], time_col: str,
               names=("rows", "distinct_keys", "duplicate_key_rows")) -> DataFrame:
    """A8 + A9 + A12 rows: row count, distinct keys, rows beyond the first per (keys, time).

    Both distinct counts come from one two-level aggregation (no global sort)."""
    per_key_time = df.groupBy(*edge_keys, time_col).agg(F.count(F.lit(1)).alias("_n"))
    per_key = per_key_time.groupBy(*edge_keys).agg(F.sum("_n").alias("_n"), F.sum(F.col("_n") - 1).alias("_dup"))
    return per_key.agg(
        F.sum("_n").cast("long").alias(names[0]),
        F.count(F.lit(1)).alias(names[1]),
        F.sum("_dup").cast("long").alias(names[2]),
    )


def shape(df: DataFrame) -> DataFrame:
    """(rows, cols) as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("cols", F.lit(len(df.columns)))


def class_balance(df: DataFrame, label: str, time_col: str | None = None) -> DataFrame:
    """Positives, total, positive rate, time coverage."""
    aggs = [
        F.sum(F.col(label)).cast("long").alias("positives"),
        F.count(F.col(label)).alias("total"),
        F.avg(F.col(label).cast("double")).alias("positive_rate"),
    ]
    if time_col:
        aggs += [F.min(time_col).alias("time_min"), F.max(time_col).alias("time_max")]
    return df.agg(*aggs)


def _bias_corrected(n: Column, g1: Column, g2: Column) -> tuple[Column, Column]:
    """pandas/DuckDB sample skewness and excess kurtosis from Spark's population moments."""
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return skew, kurt


def univariate_summary(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, std (n-1), skewness, excess kurtosis, min, max for the raw
    values and for the log of the positive ones; two rows (scale = raw / log).
    Moments in one aggregation; the exact medians of both scales in one
    distributed quantile pipeline (no whole-column buffer)."""
    x = F.col(col)
    lx = F.when(x > 0, F.ln(x))
    parts = []
    for label, e in (("raw", x), ("log", lx)):
        n = F.count(e).cast("double")
        skew, kurt = _bias_corrected(n, F.skewness(e), F.kurtosis(e))
        parts.append(F.struct(
            F.lit(label).alias("scale"), F.count(e).alias("n"), F.avg(e).alias("mean"),
            F.stddev_samp(e).alias("std"), skew.alias("skewness"), kurt.alias("kurtosis"),
            F.min(e).cast("double").alias("min"), F.max(e).cast("double").alias("max"),
        ))
    moments = df.agg(F.array(*parts).alias("_s")).select(F.explode("_s").alias("_s")).select("_s.*")
    long = df.select(F.explode(F.array(F.struct(F.lit("raw").alias("scale"), x.cast("double").alias("v")),
                                       F.struct(F.lit("log").alias("scale"), lx.alias("v")))).alias("s")).select("s.*")
    med = exact_quantiles(long, "v", [0.5], ["scale"], ["median"]).drop("n")
    out = moments.join(med, "scale", "left")
    return out.select("scale", "n", "mean", "median", "std", "skewness", "kurtosis", "min", "max")


def five_number_by_group(df: DataFrame, value: str, group: str) -> DataFrame:
    """Min, q1, median, q3, max per (coarse) group, linear interpolation,
    distributed exact quantiles (a big group is not one buffer)."""
    return exact_quantiles(df, value, (0.0, 0.25, 0.5, 0.75, 1.0), [group], ("min", "q1", "median", "q3", "max"))


def histogram(df: DataFrame, col: str, bins: int = 80, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Fixed-width histogram over [lo, hi]; the last bin is closed on the right.

    Without explicit bounds one small aggregate fetches min/max first."""
    if lo is None or hi is None:
        r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        lo, hi = float(r["lo"]), float(r["hi"])
    x = F.col(col)
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    return (df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "count"))


def binned_profile(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Y profile over ``bins`` x-centres placed at evenly spaced quantiles
    k / (bins + 1); each x goes to the nearest centre (ties to the lower one).
    Mean, std, count and a normal 95 % interval of y per bin, plus the overall
    least-squares line (regr_slope / regr_intercept).

    Centres are exact quantiles from the distributed pipeline (bounded memory)."""
    probs = [(k + 1) / (bins + 1) for k in range(bins)]
    q = exact_quantiles(df, x, probs).first()
    centres = sorted(set(float(q[f"q{i}"]) for i in range(bins)))
    mids = [(a + b) / 2 for a, b in zip(centres, centres[1:])]
    xc = F.col(x)
    idx = F.lit(0)
    for m in mids:
        idx = idx + (xc > F.lit(m)).cast("int")
    centre_arr = F.array(*[F.lit(c) for c in centres])
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).first()
    prof = (df.filter(xc.isNotNull() & F.col(y).isNotNull()).groupBy(idx.alias("bin"))
            .agg(F.avg(y).alias("y_mean"), F.stddev_samp(y).alias("y_std"), F.count(F.lit(1)).alias("n"))
            .withColumn("x_centre", centre_arr[F.col("bin")])
            .withColumn("ci_half", F.lit(1.959963984540054) * F.col("y_std") / F.sqrt("n")))
    return prof.withColumn("fit_slope", F.lit(fit["slope"])).withColumn("fit_intercept", F.lit(fit["intercept"]))


def target_correlations(df: DataFrame, target: str, features: Sequence[str] | None = None, min_rows: int = 10) -> DataFrame:
    """A19 + P19: Pearson r (pairwise-complete) of each feature with the target, |r|,
    missing %, sorted by |r| descending.  One aggregation for all features."""
    feats = list(features or numeric_cols(df, exclude=[target]))
    aggs = []
    for f in feats:
        aggs += [
            F.corr(f, target).alias(f"r__{f}"),
            F.count_if(F.col(f).isNotNull() & F.col(target).isNotNull()).alias(f"n__{f}"),
            (F.avg(F.col(f).isNull().cast("double")) * 100).alias(f"m__{f}"),
        ]
    one = df.agg(*aggs)
    stacked = one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"r__{f}").alias("pearson_r"), F.col(f"n__{f}").alias("n"),
                 F.col(f"m__{f}").alias("missing_pct")) for f in feats])).alias("s")).select("s.*")
    return (stacked.filter(F.col("n") >= min_rows).withColumn("abs_pearson_r", F.abs("pearson_r"))
            .select("feature", "pearson_r", "abs_pearson_r", "missing_pct")
            .orderBy(F.col("abs_pearson_r").desc_nulls_last(), "feature"))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long (a, b, r) Pearson matrix, pairwise-complete; NULL where undefined
    (a constant column, fewer than two common rows)."""
    r = pairwise_correlations(df, list(cols))
    rows = [(a, b, None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def high_correlation_pairs(corr_long: DataFrame, lo: float = 0.8, hi: float = 1.0, cols_order: Sequence[str] | None = None) -> DataFrame:
    """Pairs a < b (by position, else by name) with lo < |r| < hi."""
    if cols_order:
        pos = {c: i for i, c in enumerate(cols_order)}
        m = F.create_map(*[x for c, i in pos.items() for x in (F.lit(c), F.lit(i))])
        keep = m[F.col("a")] < m[F.col("b")]
    else:
        keep = F.col("a") < F.col("b")
    return corr_long.filter(keep & (F.abs("r") > lo) & (F.abs("r") < hi)).orderBy(F.abs("r").desc(), "a", "b")


def group_mean_difference(df: DataFrame, flag: str, features: Sequence[str], label: str | None = None, top: int = 10) -> DataFrame:
    """Mean of each feature for flag = 1 vs 0, |difference|, top ``top``; and the
    label rate per flag when ``label`` is given (as feature ``<label>``)."""
    feats = list(features) + ([label] if label else [])
    g = df.groupBy(flag).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats])
    one = g.agg(*[F.max(F.when(F.col(flag) == 1, F.col(f))).alias(f"a__{f}") for f in feats],
                *[F.max(F.when(F.col(flag) == 0, F.col(f))).alias(f"b__{f}") for f in feats])
    st = one.select(F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"a__{f}").alias("mean_flagged"), F.col(f"b__{f}").alias("mean_other"))
        for f in feats])).alias("s")).select("s.*")
    st = st.withColumn("abs_diff", F.abs(F.col("mean_flagged") - F.col("mean_other")))
    return st.orderBy(F.col("abs_diff").desc_nulls_last(), "feature").limit(top)
