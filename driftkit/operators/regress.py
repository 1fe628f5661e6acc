"""Linear regression study on sufficient statistics.

Design: rows never leave the executors.  ``LinearDesign`` turns each row into
a raw vector u = [1, coalesce(x - r, 0), isnull(x), onehot(v), isnull(v), y], where r
is a reference value of each column (its mean); one aggregation gives the moments
of u (per CV block when asked).  Median/mode imputation, z-scoring and one-hot
dropping are affine maps of u, so the moments of the final design matrix for ANY
training subset follow from those of u - exact, with the preprocessing refitted per
fold as a pipeline would be.  Neither the moments nor the maps subtract large
numbers of like size, so offsets of a column cost no digits.  OLS, ridge, lasso
(coordinate descent), VIF, R^2/RMSE on any block follow on the driver from
(p x p) matrices; per-row quantities (Cook's distance, residuals, MAE) are
column expressions with the fitted numbers as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit.functions.names import sanitize_name
from driftkit.operators.gram import Gram, Moments, moments, quadratic_form_in_batches
from driftkit.operators.preprocess import CONSTANT


# ----------------------------------------------------------------- design --

@dataclass
class FoldParams:
    medians: dict
    modes: dict
    categories: dict  # categories present in the training rows


@dataclass
class LinearDesign:
    numeric: list[str]
    categorical: list[str]
    target: str
    categories: dict = field(default_factory=dict)  # superset, from the training frame
    reference: dict = field(default_factory=dict)  # a value of each numeric column's size (0 if none is given)
    drop_first: bool = True
    scale: bool = True

    # u layout -------------------------------------------------------------
    def u_names(self) -> list[str]:
        names = ["1"] + [f"x:{c}" for c in self.numeric] + [f"n:{c}" for c in self.numeric]
        for v in self.categorical:
            names += [f"o:{v}:{c}" for c in self.categories[v]] + [f"n:{v}"]
        return names + ["y"]

    def u_columns(self) -> list[Column]:
        cols = [F.lit(1.0)]
        cols += [F.coalesce(F.col(c).cast("double") - F.lit(self.reference.get(c, 0.0)), F.lit(0.0)) for c in self.numeric]
        cols += [F.col(c).isNull().cast("double") for c in self.numeric]
        for v in self.categorical:
            cols += [F.coalesce((F.col(v) == F.lit(c)).cast("double"), F.lit(0.0)) for c in self.categories[v]]
            cols += [F.col(v).isNull().cast("double")]
        cols.append(F.col(self.target).cast("double"))
        return cols

    def moments_u(self, df: DataFrame, key: Column | None = None):
        """Moments of u in one pass; with ``key`` a dict {key: moments}.  Rows without a target are left out."""
        found = moments(df.where(F.col(self.target).isNotNull()), self.u_columns(), key)
        return found if key is not None else found.get(0, Moments.zero(len(self.u_names())))

    # parameters -------------------------------------------------------------
    def fold_params(self, df: DataFrame, masks: dict, block_col: str | None = None) -> dict:
        """Medians, modes and present categories for each named row subset.
        ``masks``: {name: boolean Column selecting that subset's training rows}.

        Medians are exact and distributed: value counts per (feature, subset), then
        prefix sums.  With ``block_col`` (expanding folds: fold f trains on blocks
        < f) the counts are made once per block and repeated to the folds."""
        from driftkit.operators.quantiles import exact_quantiles

        medians = {}
        if self.numeric:
            names = list(masks)
            entries = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in self.numeric]))
            if block_col is not None:
                counts = df.select(F.col(block_col).alias("_b"), entries.alias("s")).groupBy("_b", "s.feature", "s.v").agg(F.count(F.lit(1)).alias("_n"))
                counts = counts.withColumn("fold", F.explode(F.sequence(F.col("_b") + 1, F.lit(max(names))))).where(F.col("fold").isin(names))
            else:
                subsets = F.filter(F.array(*[F.when(m, F.lit(i)) for i, m in enumerate(masks.values())]), lambda x: x.isNotNull())
                counts = df.select(F.explode(subsets).alias("fold"), *self.numeric).select("fold", entries.alias("s")).groupBy("fold", "s.feature", "s.v").agg(F.count(F.lit(1)).alias("_n"))
            for r in exact_quantiles(counts, "v", [0.5], ["fold", "feature"], ["median"], weight_col="_n").collect():
                medians[(r["fold"] if block_col is not None else names[r["fold"]], r["feature"])] = r["median"]
        found = self._category_counts(df, masks)
        out = {}
        for name in masks:
            counts = {v: found.get((name, v), {}) for v in self.categorical}
            out[name] = FoldParams(
                {c: float(medians.get((name, c)) or 0.0) for c in self.numeric},
                {v: min(counts[v], key=lambda x: (-counts[v][x], x), default=None) for v in self.categorical},  # noqa: B023
                {v: sorted(counts[v]) for v in self.categorical},
            )
        return out

    def _category_counts(self, df: DataFrame, masks: dict) -> dict:
        """{(subset, column): {category: rows}}: rows are counted per combination, and those
        counts added up per column; only categories reach the driver."""
        if not self.categorical:
            return {}
        inside = [F.coalesce(m, F.lit(False)).alias(f"_m{f}") for f, m in enumerate(masks.values())]
        kinds = [F.col(v).alias(f"_c{i}") for i, v in enumerate(self.categorical)]
        flags, columns = [f"_m{f}" for f in range(len(inside))], [f"_c{i}" for i in range(len(kinds))]
        rows = df.select(*inside, *kinds).groupBy(*flags, *columns).agg(F.count(F.lit(1)).alias("_n"))
        each = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(kinds) - 1))))
        own = [F.when(F.col("_i") == i, F.col(c)).alias(c) for i, c in enumerate(columns)]
        per = each.select(*flags, "_i", *own, "_n").groupBy(*flags, "_i", *columns).agg(F.sum("_n").alias("_n"))
        out: dict = {}
        for r in per.collect():
            value = r[columns[r["_i"]]]
            for f, name in enumerate(masks):
                if r[flags[f]] and value is not None:
                    counts = out.setdefault((name, self.categorical[r["_i"]]), {})
                    counts[value] = counts.get(value, 0) + r["_n"]
        return out

    def feature_names(self, fp: FoldParams) -> list[str]:
        names = list(self.numeric)
        for v in self.categorical:
            cats = fp.categories[v][1:] if self.drop_first else fp.categories[v]
            names += [f"{v}_{sanitize_name(c)}" for c in cats]
        return names

    def transform_matrix(self, fp: FoldParams, train_u: Moments) -> tuple[np.ndarray, list[str], dict]:
        """T with [z, y] = T u; scaling moments come from the training moments themselves."""
        pos = {n: i for i, n in enumerate(self.u_names())}
        k = len(pos)
        rows, names = [], []
        ref = [self.reference.get(c, 0.0) for c in self.numeric]
        for c, r0 in zip(self.numeric, ref):
            r = np.zeros(k)
            r[pos[f"x:{c}"]] = 1.0
            r[pos[f"n:{c}"]] = fp.medians[c] - r0
            rows.append(r)
            names.append(c)
        for v in self.categorical:
            cats = fp.categories[v][1:] if self.drop_first else fp.categories[v]
            for c in cats:
                r = np.zeros(k)
                r[pos[f"o:{v}:{c}"]] = 1.0
                r[pos[f"n:{v}"]] = 1.0 if fp.modes[v] == c else 0.0
                rows.append(r)
                names.append(f"{v}_{sanitize_name(c)}")
        b = np.array(rows).reshape(len(rows), k)
        nnum = len(self.numeric)
        mean, scale = np.array(ref), np.ones(nnum)
        if self.scale:
            own = train_u.map(b[:nnum])  # of the numeric columns less their references
            sd = np.sqrt(np.maximum(np.diag(own.centred), 0.0) / max(train_u.n, 1.0))
            mean = mean + own.mean
            scale = np.where(sd > CONSTANT * np.abs(mean), sd, 1.0)
            b[:nnum, 0] = -own.mean
            b[:nnum] /= scale[:, None]
        else:
            b[:nnum, 0] = ref
        yrow = np.zeros(k)
        yrow[pos["y"]] = 1.0
        info = {"mean": dict(zip(names[:nnum], mean)), "scale": dict(zip(names[:nnum], scale))}
        return np.vstack([b, yrow]), names, info

    def to_gram(self, t: np.ndarray, u: Moments, names: list[str]) -> Gram:
        return Gram(names, u.map(t))

    def z_columns(self, fp: FoldParams, info: dict) -> list[Column]:
        """The preprocessed design as column expressions (for row-level scoring)."""
        cols = []
        for c in self.numeric:
            x = F.coalesce(F.col(c).cast("double"), F.lit(fp.medians[c]))
            if self.scale:
                x = (x - F.lit(float(info["mean"][c]))) / F.lit(float(info["scale"][c]))
            cols.append(x.alias(c))
        for v in self.categorical:
            val = F.coalesce(F.col(v), F.lit(fp.modes[v]))
            cats = fp.categories[v][1:] if self.drop_first else fp.categories[v]
            cols += [(val == F.lit(c)).cast("double").alias(f"{v}_{sanitize_name(c)}") for c in cats]
        return cols


def discover_design(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str) -> LinearDesign:
    """Distinct values per categorical column (few by construction) and the mean of each
    numeric one as its reference."""
    means = [F.avg(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))).alias(f"r{i}") for i, c in enumerate(numeric)]
    r = df.agg(*means).first() if means else None
    reference = {c: float(r[f"r{i}"] or 0.0) for i, c in enumerate(numeric)}
    found = LinearDesign(list(numeric), list(categorical), target, {}, reference)
    counts = found._category_counts(df, {"all": F.lit(True)})
    found.categories = {c: sorted(counts.get(("all", c), {})) for c in categorical}
    return found


# ---------------------------------------------------------------- solvers --

@dataclass
class LinearFit:
    features: list[str]
    intercept: float
    coef: np.ndarray
    alpha: float = 0.0
    kind: str = "ols"

    def predict(self, z_cols: Sequence[Column] | None = None) -> Column:
        e = F.lit(float(self.intercept))
        for f, w in zip(self.features, self.coef):
            if w != 0.0:
                e = e + F.lit(float(w)) * F.col(f)
        return e


def scaled_inverse(a: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a matrix of sums of products, taken at unit diagonal, so that
    the columns' units play no part; a column without any spread gets zeros."""
    s = np.sqrt(np.diag(a))
    s = np.where(s > 0, s, np.inf)
    return np.linalg.pinv(a / np.outer(s, s), rcond=1e-13, hermitian=True) / np.outer(s, s)


def ols(g: Gram) -> LinearFit:
    """Least squares with a constant, solved on centred sums (constant columns get 0)."""
    w = scaled_inverse(g.cxx) @ g.cxy
    return LinearFit(g.features, float(g.ybar - g.xbar @ w), w, 0.0, "ols")


def ridge(g: Gram, alpha: float) -> LinearFit:
    """min ||y - b - Xw||^2 + alpha ||w||^2 (intercept unpenalised)."""
    c, d, xbar, ybar = g.centered()
    n = g.n
    w = np.linalg.solve(n * c + alpha * np.eye(len(d)), n * d) if len(d) else np.zeros(0)
    return LinearFit(g.features, float(ybar - xbar @ w), w, alpha, "ridge")


def lasso(g: Gram, alpha: float, max_iter: int = 10_000, tol: float = 1e-10, warm: np.ndarray | None = None) -> LinearFit:
    """min (1 / 2n) ||y - b - Xw||^2 + alpha ||w||_1 by cyclic coordinate descent on the Gram."""
    c, d, xbar, ybar = g.centered()
    p = len(d)
    w = np.zeros(p) if warm is None else warm.copy()
    diag = np.diag(c)
    for _ in range(max_iter):
        delta = 0.0
        for j in range(p):
            if diag[j] <= 0:
                w[j] = 0.0
                continue
            rho = d[j] - c[j] @ w + diag[j] * w[j]
            new = math.copysign(max(abs(rho) - alpha, 0.0), rho) / diag[j]
            delta = max(delta, abs(new - w[j]))
            w[j] = new
        if delta < tol:
            break
    return LinearFit(g.features, float(ybar - xbar @ w), w, alpha, "lasso")


def r2(g: Gram, fit: LinearFit) -> float:
    sst = g.sst()
    return 1.0 - g.sse(fit.intercept, fit.coef) / sst if sst > 0 else float("nan")


def rmse(g: Gram, fit: LinearFit) -> float:
    return math.sqrt(max(g.sse(fit.intercept, fit.coef), 0.0) / g.n)


# ------------------------------------------------------------ diagnostics --

def coefficient_table(spark: SparkSession, fit: LinearFit, model: str = "OLS") -> DataFrame:
    """(model, feature, coefficient, abs_coef) sorted by |coef| desc, plus the intercept row."""
    rows = [(model, f, float(w), abs(float(w))) for f, w in zip(fit.features, fit.coef)]
    rows.append((model, "(intercept)", float(fit.intercept), abs(float(fit.intercept))))
    df = spark.createDataFrame(rows, "model string, feature string, coefficient double, abs_coef double")
    return df.orderBy(F.col("abs_coef").desc(), "feature")


def vif(g: Gram) -> list[tuple[str, float]]:
    """M8: VIF_i = G_ii (G^-1)_ii on the uncentred design without a constant column."""
    xtx = g.xtx
    inv = scaled_inverse(xtx)
    return [(f, float(xtx[i, i] * inv[i, i])) for i, f in enumerate(g.features)]


def vif_table(spark: SparkSession, g: Gram, flag_above: float = 10.0) -> DataFrame:
    rows = [(f, v, v > flag_above) for f, v in vif(g)]
    return spark.createDataFrame(rows, "feature string, vif double, high boolean").orderBy(F.col("vif").desc(), "feature")


def leverage_and_cooks(scored: DataFrame, g: Gram, fit: LinearFit, y: str, yhat: str = "y_hat",
                       columns: Sequence[Column] | None = None) -> DataFrame:
    """M9 per row: leverage h = 1 / n + (x - xbar)'C^-1 (x - xbar) of the design with a
    constant, e, D = e^2 h / (p~ s^2 (1 - h)^2).
    ``columns``: the features as expressions, where the frame does not hold them by name."""
    k = len(g.features) + 1
    s2 = g.sse(fit.intercept, fit.coef) / (g.n - k)
    h = F.lit(1.0 / g.n) + quadratic_form_in_batches(columns or g.features, scaled_inverse(g.cxx), center=g.xbar)
    e = F.col(y) - F.col(yhat)
    return scored.withColumn("leverage", h).withColumn("residual", e).withColumn(
        "cooks_d", e * e * F.col("leverage") / (F.lit(k * s2) * (1 - F.col("leverage")) ** 2)
    )


def residual_columns(scored: DataFrame, y: str, yhat: str = "y_hat") -> DataFrame:
    """Residual, standardised residual e / sqrt(mean e^2), sqrt(|standardised|)."""
    e = F.col(y) - F.col(yhat)
    rms = scored.agg(F.sqrt(F.avg(e * e)).alias("r")).first()["r"] or 1.0
    return scored.withColumn("residual", e).withColumn("std_residual", F.col("residual") / F.lit(rms)).withColumn(
        "sqrt_abs_std_residual", F.sqrt(F.abs("std_residual"))
    )


def qq_table(residuals: DataFrame, col: str = "residual", points: int = 99) -> DataFrame:
    """Sample quantiles of the residuals at p = k/(points+1) against N(0,1) quantiles."""
    from driftkit.operators.quantiles import exact_quantiles

    probs = [(k + 1) / (points + 1) for k in range(points)]
    nd = NormalDist()
    q = exact_quantiles(residuals, col, probs).first()
    spark = residuals.sparkSession
    rows = [(p, nd.inv_cdf(p), q[f"q{i}"]) for i, p in enumerate(probs)]
    return spark.createDataFrame(rows, "p double, normal_quantile double, sample_quantile double")


def jarque_bera(residuals: DataFrame, col: str = "residual") -> DataFrame:
    """JB = n/6 (S^2 + K^2/4) with population skewness and excess kurtosis over
    ALL rows; p = exp(-JB/2) (chi-square, 2 d.o.f.)."""
    n = F.count(col).cast("double")
    s, k = F.skewness(col), F.kurtosis(col)
    jb = n / 6 * (s * s + k * k / 4)
    return residuals.agg(n.alias("n"), s.alias("skewness"), k.alias("excess_kurtosis"), jb.alias("jb")).withColumn(
        "p_value", F.exp(-F.col("jb") / 2))

