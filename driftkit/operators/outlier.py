"""Multivariate outliers (M35) and the outlier-ablation comparison.

Mean and covariance of the z-scored features come from one Gram aggregation
over ALL rows (no sub-sample); the pseudo-inverse is p x p on the driver and
the squared Mahalanobis distance is a quadratic-form column expression.  The
chi-square cut-off (p < 0.001) is a single driver constant.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.operators.gram import add_quadratic_form, gram
from driftkit.operators.preprocess import fit_preprocessing


def _lower_gamma_regularized(a: float, x: float) -> float:
    """P(a, x) by its series (x < a + 1) or continued fraction (Numerical-Recipes forms)."""
    if x <= 0:
        return 0.0
    gln = math.lgamma(a)
    if x < a + 1:
        ap, s, d = a, 1.0 / a, 1.0 / a
        for _ in range(10_000):
            ap += 1
            d *= x / ap
            s += d
            if abs(d) < abs(s) * 1e-15:
                break
        return s * math.exp(-x + a * math.log(x) - gln)
    b, c, d = x + 1 - a, 1e300, 1.0 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return 1.0 - math.exp(-x + a * math.log(x) - gln) * h


def chi2_cdf(x: float, dof: int) -> float:
    return _lower_gamma_regularized(dof / 2.0, x / 2.0)


def chi2_quantile(q: float, dof: int) -> float:
    """Inverse CDF by bisection (monotone), ~1e-12 relative."""
    lo, hi = 0.0, max(1.0, dof + 20 * math.sqrt(2 * dof) + 50)
    while chi2_cdf(hi, dof) < q:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if chi2_cdf(mid, dof) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def mahalanobis_outliers(df: DataFrame, features: Sequence[str], p_value: float = 0.001, keep: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """Median-impute + z-score ``features`` (fitted on the whole frame), then
    d2 = (z - mean)' pinv(cov) (z - mean) with the sample covariance (n - 1),
    ``is_outlier`` = d2 > chi2 quantile (1 - p_value, dof = p)."""
    feats = list(features)
    prep = fit_preprocessing(df, feats, [])
    z = prep.transform(df, keep=[c for c in df.columns if c not in feats] if not keep else list(keep))
    g = gram(z, feats)
    mu = g.xbar
    inv = np.linalg.pinv(g.cxx / (g.n - 1))
    cut = chi2_quantile(1 - p_value, len(feats))
    out = add_quadratic_form(z, feats, inv, mu, "mahalanobis_sq")
    out = out.withColumn("is_outlier", F.col("mahalanobis_sq") > F.lit(cut))
    return out, {"threshold": cut, "mean": mu, "n": g.n, "dof": len(feats)}
