"""Mergeable moments and the linear-model statistics that rest on them.

``moments`` is the one engine: weight, mean and centred sums of products of a row
vector, per key when asked.  Tasks centre each batch before they multiply and merge
batches by Chan's pairwise update; a fixed number of merging tasks joins what the
tasks found, so nothing is ever a difference of large sums: a column at 1.7e9 with a
deviation of 100 loses no digits.  From it come Gram matrices (per time-ordered CV
block, so every fold's training statistics are merges of blocks) and pairwise-complete
correlations.  Everything linear - OLS, VIF, Cook's distance, ridge, lasso by
coordinate descent, validation R^2 - is then solved on p x p matrices.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MERGERS = 16  # tasks that merge; the driver merges as many rows per key


@dataclass
class Moments:
    """Weight, mean and centred sums of products of a row vector."""

    n: float
    mean: np.ndarray     # (k,)
    centred: np.ndarray  # (k, k): sum of w (z - mean) (z - mean)'

    @classmethod
    def zero(cls, k: int) -> "Moments":
        return cls(0.0, np.zeros(k), np.zeros((k, k)))

    @classmethod
    def of(cls, z: np.ndarray, w: np.ndarray) -> "Moments":
        n = float(w.sum())
        if n == 0:
            return cls.zero(z.shape[1])
        mean = z[0] + w @ (z - z[0]) / n
        c = z - mean
        slip = w @ c / n  # what rounding left of the mean
        c = c - slip
        return cls(n, mean + slip, c.T @ (c * w[:, None]))

    def merge(self, o: "Moments") -> "Moments":
        n = self.n + o.n
        if o.n == 0 or self.n == 0:
            return self if o.n == 0 else o
        d = o.mean - self.mean
        return Moments(n, self.mean + d * (o.n / n), self.centred + o.centred + np.outer(d, d) * (self.n * o.n / n))

    def map(self, t: np.ndarray) -> "Moments":
        """Moments of ``t z``."""
        return Moments(self.n, t @ self.mean, t @ self.centred @ t.T)

    def raw(self) -> np.ndarray:
        """sum of w z z'."""
        return self.centred + self.n * np.outer(self.mean, self.mean)


def merged(parts: Iterable[Moments], k: int) -> Moments:
    out = Moments.zero(k)
    for p in parts:
        out = out.merge(p)
    return out


def moments(df: DataFrame, columns: Sequence[Column], key: Column | None = None, weight: Column | None = None) -> dict[object, Moments]:
    """{key: moments} of the row vector ``columns`` (NULL and NaN entries count as 0).

    Each task sends one row per key; ``MERGERS`` tasks merge them as they stream in,
    and as many rows per key reach the driver, whatever the number of partitions;
    ``key`` has few values (CV blocks)."""
    k = len(columns)
    staged = df.select((F.lit(0) if key is None else key).alias("_k"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"),
                       *[c.cast("double").alias(f"z{i}") for i, c in enumerate(columns)])
    schema = T.StructType([T.StructField("_k", staged.schema["_k"].dataType), T.StructField("_task", T.IntegerType()),
                           T.StructField("_n", T.DoubleType()), T.StructField("_mean", T.BinaryType()), T.StructField("_centred", T.BinaryType())])

    def rows(found: dict, key_type) -> pa.RecordBatch:
        columns = [pa.array(list(found), key_type), pa.array([TaskContext.get().partitionId()] * len(found), pa.int32()), pa.array([m.n for m in found.values()])]
        blobs = [pa.array([getattr(m, c).tobytes() for m in found.values()], pa.binary()) for c in ("mean", "centred")]
        return pa.RecordBatch.from_arrays([*columns, *blobs], names=schema.names)

    def part(batches):
        found: dict = {}
        key_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key_type = batch.column(0).type
            coded = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = coded.indices.to_numpy(zero_copy_only=False)
            w, *z = (np.nan_to_num(c.to_numpy(zero_copy_only=False).astype("float64"), nan=0.0, posinf=np.inf, neginf=-np.inf)
                     for c in batch.columns[1:])
            z = np.column_stack(z)
            for code, value in enumerate(coded.dictionary.to_pylist()):
                mine = codes == code
                found[value] = found.get(value, Moments.zero(k)).merge(Moments.of(z[mine], w[mine]))
        if found:
            yield rows(found, key_type)

    def read(value, n, mean, centred) -> tuple:
        return value, Moments(n, np.frombuffer(mean), np.frombuffer(centred).reshape(k, k))

    def merge(batches):
        found: dict = {}
        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for row in zip(*(batch.column(c).to_pylist() for c in ("_k", "_n", "_mean", "_centred"))):
                value, m = read(*row)
                found[value] = found.get(value, Moments.zero(k)).merge(m)
        if found:
            yield rows(found, key_type)

    out: dict = {}
    for r in staged.mapInArrow(part, schema).repartition(MERGERS, "_task").mapInArrow(merge, schema).collect():
        value, m = read(r["_k"], r["_n"], r["_mean"], r["_centred"])
        out[value] = out.get(value, Moments.zero(k)).merge(m)
    return out


@dataclass
class Gram:
    """Moments of [features, target]: what every linear model is solved from."""

    features: list[str]
    moments: Moments
    target: bool = True

    def __add__(self, o: "Gram") -> "Gram":
        return Gram(self.features, self.moments.merge(o.moments), self.target)

    @property
    def n(self) -> float:
        return self.moments.n

    @property
    def xbar(self) -> np.ndarray:
        return self.moments.mean[:len(self.features)]

    @property
    def ybar(self) -> float:
        return float(self.moments.mean[-1])

    @property
    def cxx(self) -> np.ndarray:
        p = len(self.features)
        return self.moments.centred[:p, :p]

    @property
    def cxy(self) -> np.ndarray:
        return self.moments.centred[:-1, -1]

    @property
    def sx(self) -> np.ndarray:
        return self.n * self.xbar

    @property
    def xtx(self) -> np.ndarray:
        p = len(self.features)
        return self.moments.raw()[:p, :p]

    def centered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Covariance-type statistics: cov(x, x), cov(x, y) (divided by n), xbar, ybar."""
        return self.cxx / self.n, self.cxy / self.n, self.xbar, self.ybar

    def sse(self, intercept: float, coef: np.ndarray) -> float:
        """sum (y - b0 - x'w)^2 from the statistics alone."""
        v = np.append(-np.asarray(coef, dtype=float), 1.0)
        return float(v @ self.moments.centred @ v + self.n * (v @ self.moments.mean - intercept) ** 2)

    def sst(self) -> float:
        return float(self.moments.centred[-1, -1])


def _complete(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    ok = F.lit(True)
    for c in cols:
        x = F.col(c).cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x)
    return df.where(ok)


def grouped_gram(df: DataFrame, key: str | Column | None, features: Sequence[str], target: str | None = None,
                 weight: Column | None = None) -> dict:
    """{key value: Gram} in one pass; rows with NULL or NaN in a used column are left out."""
    cols = list(features) + ([target] if target else [])
    found = moments(_complete(df, cols), [F.col(c) for c in cols], F.col(key) if isinstance(key, str) else key, weight)
    return {k: Gram(list(features), m, target is not None) for k, m in found.items()}


def gram(df: DataFrame, features: Sequence[str], target: str | None = None, weight: Column | None = None) -> Gram:
    """One pass -> :class:`Gram`; rows with NULL or NaN in a used column are left out."""
    empty = Gram(list(features), Moments.zero(len(features) + (target is not None)), target is not None)
    return grouped_gram(df, None, features, target, weight).get(0, empty)


def gram_long(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The X'X entries of :func:`gram` as a long frame (feature_i, feature_j, value)."""
    g = gram(df, features)
    rows = [(a, b, float(g.xtx[i, j])) for i, a in enumerate(features) for j, b in enumerate(features) if j >= i]
    return df.sparkSession.createDataFrame(rows, "feature_i string, feature_j string, value double")


def pairwise_correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson r of every pair over the rows where both are present (NaN: undefined).

    One scan for the means (values are shifted by them, so large offsets cost no
    digits), one for the masked products [present, x, x^2]'[present, x, x^2]."""
    p = len(cols)
    x = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    means = df.agg(*[F.avg(c) for c in x]).first()
    shifted = [F.coalesce(c - F.lit(float(m or 0.0)), F.lit(0.0)) for c, m in zip(x, means)]
    m = moments(df, [*[c.isNotNull() for c in x], *shifted, *[s * s for s in shifted]]).get(0, Moments.zero(3 * p)).raw()
    n, sx, sxx, sxy = m[:p, :p], m[p:2 * p, :p], m[2 * p:, :p], m[p:2 * p, p:2 * p]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = sxy - sx * sx.T / n
        var = sxx - sx * sx / n
        size = n * np.square([float(v or 0.0) for v in means])[:, None]
        var = np.where(var > 1e-24 * size, var, np.nan)  # below: rounding of a constant
        r = cov / np.sqrt(var * var.T)
    return np.clip(r, -1.0, 1.0)


def quadratic_form(features: Sequence[str | Column], a: np.ndarray, center: np.ndarray | None = None) -> Column:
    """x' A x as a column expression (x optionally centred)."""
    terms = [(F.col(f) if isinstance(f, str) else f).cast("double") for f in features]
    if center is not None:
        terms = [t - F.lit(float(c)) for t, c in zip(terms, center)]
    k = len(terms)
    expr = None
    for i in range(k):
        for j in range(i, k):
            coef = float(a[i, i]) if i == j else float(a[i, j] + a[j, i])
            if coef == 0.0:
                continue
            t = F.lit(coef) * terms[i] * terms[j]
            expr = t if expr is None else expr + t
    return expr if expr is not None else F.lit(0.0)


def quadratic_form_in_batches(features: Sequence[str | Column], a: np.ndarray, center: np.ndarray | None = None) -> Column:
    """(x - c)' A (x - c) as a column, numpy on Arrow batches; only ``features`` leave the
    JVM, each computed once.  NULL or NaN in a feature: NULL."""
    c = np.zeros(len(features)) if center is None else np.asarray(center, dtype=float)
    amat = np.asarray(a, dtype=float)

    @F.pandas_udf("double")
    def form(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype="float64") for s in xs]) - c
        return pd.Series(np.einsum("ij,ij->i", x @ amat, x))

    found = form(*[(F.col(f) if isinstance(f, str) else f).cast("double") for f in features]) if features else F.lit(0.0)
    return F.nanvl(found, F.lit(None).cast("double"))


def add_quadratic_form(df: DataFrame, features: Sequence[str], a: np.ndarray, center: np.ndarray | None,
                       out_col: str) -> DataFrame:
    """Add (x - c)' A (x - c) as :func:`quadratic_form_in_batches` finds it."""
    return df.withColumn(out_col, quadratic_form_in_batches(features, a, center))
