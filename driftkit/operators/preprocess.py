"""Fitted column preprocessing (M1-M6): median / most-frequent imputation,
population z-scoring, one-hot encoding.

``fit`` takes exact medians from the distributed quantile pipeline (no buffer
holds a column, whatever its length) and everything else - means, deviations,
modes, the distinct categories, few by construction - from one aggregation.
NaN is a missing value like NULL.  ``transform`` is a single ``select`` of
literal-parameterised expressions, so it stays in whole-stage codegen and can run
on any split.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.functions.names import sanitize_name
from driftkit.functions.scalar import nan_to_null
from driftkit.operators.quantiles import exact_column_medians

CONSTANT = 1e-12  # a deviation below this share of the mean is rounding: the column is constant


@dataclass
class PreprocessModel:
    numeric: list[str]
    categorical: list[str]
    medians: dict = field(default_factory=dict)
    means: dict = field(default_factory=dict)
    scales: dict = field(default_factory=dict)
    modes: dict = field(default_factory=dict)
    categories: dict = field(default_factory=dict)
    drop_first: bool = True
    scale: bool = True

    def feature_names(self) -> list[str]:
        names = list(self.numeric)
        for c in self.categorical:
            cats = self.categories[c][1:] if self.drop_first else self.categories[c]
            names += [f"{c}_{sanitize_name(v)}" for v in cats]
        return names

    def columns(self) -> list:
        """M1+M3 numeric expressions and M2+M4/M5 one-hot expressions."""
        out = []
        for c in self.numeric:
            x = F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(self.medians[c]))
            if self.scale:
                x = (x - F.lit(self.means[c])) / F.lit(self.scales[c])
            out.append(x.alias(c))
        for c in self.categorical:
            v = F.coalesce(F.col(c), F.lit(self.modes[c]))
            cats = self.categories[c][1:] if self.drop_first else self.categories[c]
            for cat in cats:
                hit = (v == F.lit(cat)).cast("double")
                if self.drop_first:  # M4: an unknown category is an error, not the baseline
                    unknown = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), v.cast("string"))).cast("double")
                    hit = F.when(v.isNull() | v.isin(*self.categories[c]), hit).otherwise(unknown)
                out.append(hit.alias(f"{c}_{sanitize_name(cat)}"))
        return out

    def transform(self, df: DataFrame, keep: Sequence[str] = (), vector_col: str | None = None) -> DataFrame:
        out = df.select(*keep, *self.columns())
        if vector_col:
            out = VectorAssembler(inputCols=self.feature_names(), outputCol=vector_col, handleInvalid="keep").transform(out)
        return out


def fit_preprocessing(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    drop_first: bool = True,
    scale: bool = True,
) -> PreprocessModel:
    """M6 fit.  ``drop_first``: one-hot drops the alphabetically first category
    (M4, an unknown category then raises); otherwise every
    category gets a column and unknown values give all zeros (M5)."""
    numeric, categorical = list(numeric), list(categorical)
    medians = exact_column_medians(train, numeric) if numeric else {}
    aggs = []
    for i, c in enumerate(numeric):
        x = nan_to_null(F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"cnt{i}"), F.avg(x).alias(f"avg{i}"), F.stddev_pop(x).alias(f"std{i}")]
    aggs.append(F.count(F.lit(1)).alias("_n"))
    for i, c in enumerate(categorical):
        aggs += [F.mode(F.col(c), True).alias(f"mode{i}"),
                 F.array_sort(F.collect_set(F.col(c))).alias(f"cats{i}")]
    r = train.agg(*aggs).first()
    model = PreprocessModel(numeric, categorical, drop_first=drop_first, scale=scale)
    n = float(r["_n"])
    for i, c in enumerate(numeric):
        m = medians[c]
        model.medians[c] = float(m) if m is not None else 0.0
        if scale:
            # moments of the IMPUTED column, as a pipeline would see it: the known rows
            # and the rows that got the median are two groups of known mean and deviation
            med, known = model.medians[c], float(r[f"cnt{i}"]) / n if n else 0.0
            mean, std = (float(r[f"{k}{i}"]) if r[f"{k}{i}"] is not None else med * (k == "avg") for k in ("avg", "std"))
            mu = known * mean + (1 - known) * med
            sd = (known * std * std + known * (1 - known) * (mean - med) ** 2) ** 0.5
            model.means[c] = mu
            model.scales[c] = sd if sd > CONSTANT * abs(mu) else 1.0
    for i, c in enumerate(categorical):
        model.modes[c] = r[f"mode{i}"]
        model.categories[c] = list(r[f"cats{i}"])
    return model
