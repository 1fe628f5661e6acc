"""Metrics against brute force; Gram-based models against numpy; outliers; entry smoke."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftkit.operators import metrics, profile, regress
from driftkit.operators.gram import gram, grouped_gram
from driftkit.operators.outlier import chi2_cdf, chi2_quantile
from driftkit.operators.preprocess import fit_preprocessing
from driftkit.operators.scan import prefix_sums


def brute_ap(y, s):
    """Step-wise AP with tied scores grouped (sum of recall steps times precision)."""
    P = sum(y)
    if P == 0:
        return 0.0
    if P == len(y):
        return 1.0
    ap, prev_r = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp = sum(1 for yy, ss in zip(y, s) if ss >= t and yy == 1)
        fp = sum(1 for yy, ss in zip(y, s) if ss >= t and yy == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def brute_auc(y, s):
    pos = [ss for yy, ss in zip(y, s) if yy == 1]
    neg = [ss for yy, ss in zip(y, s) if yy == 0]
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return tot / (len(pos) * len(neg))


def test_ranking_metrics_brute_force(spark):
    rnd = random.Random(5)
    data = [(g, int(rnd.random() < 0.3), round(rnd.random(), 1)) for g in range(3) for _ in range(120)]
    df = spark.createDataFrame(data, "g int, y int, s double")
    got = {r.g: r for r in metrics.ranking_metrics(df, "y", "s", group_cols=["g"]).collect()}
    for g in range(3):
        y = [d[1] for d in data if d[0] == g]
        s = [d[2] for d in data if d[0] == g]
        assert got[g].average_precision == pytest.approx(brute_ap(y, s), abs=1e-12)
        assert got[g].roc_auc == pytest.approx(brute_auc(y, s), abs=1e-12)


def test_score_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (0, 0.5), (1, 0.5)], "y int, s double")
    r = metrics.ranking_metrics(df, "y", "s").first()
    assert r.average_precision == pytest.approx(0.5) and r.roc_auc == pytest.approx(0.5)
    none = spark.createDataFrame([(0, 0.1), (0, 0.7)], "y int, s double")
    allp = spark.createDataFrame([(1, 0.1), (1, 0.7)], "y int, s double")
    a, b = metrics.ranking_metrics(none, "y", "s").first(), metrics.ranking_metrics(allp, "y", "s").first()
    assert (a.average_precision, a.roc_auc) == (0.0, None) and (b.average_precision, b.roc_auc) == (1.0, None)
    t = metrics.threshold_metrics(none, "y", "s", 0.5).first()
    assert t.one_class_fold and t.precision == 0.0 and t.f1 == 0.0 and t.balanced_accuracy == 0.5


def test_prefix_sums_match_cumsum(spark):
    rnd = random.Random(9)
    data = [(g, i, rnd.randrange(0, 5)) for g in range(3) for i in range(300)]
    df = spark.createDataFrame(data, "g int, k int, w long").repartition(5)
    out = prefix_sums(df, [F.col("k")], ["w"], ["g"], partitions=6).collect()
    got = {(r.g, r.k): r.w_cum for r in out}
    for g in range(3):
        c = 0
        for i in range(300):
            c += data[g * 300 + i][2]
            assert got[(g, i)] == c


def _reg_data(spark, n=200, p=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = 1.5 + x @ np.array([2.0, -1.0, 0.5])[:p] + rng.normal(scale=0.3, size=n)
    cols = [f"x{i}" for i in range(p)]
    df = spark.createDataFrame([tuple(map(float, r)) + (float(t),) for r, t in zip(x, y)], ", ".join(f"{c} double" for c in cols) + ", y double")
    return df, x, y, cols


def test_ols_ridge_lasso_vs_numpy(spark):
    df, x, y, cols = _reg_data(spark)
    g = gram(df, cols, "y")
    fit = regress.ols(g)
    X = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    assert fit.intercept == pytest.approx(beta[0]) and np.allclose(fit.coef, beta[1:])
    alpha = 3.0
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc)
    assert np.allclose(regress.ridge(g, alpha).coef, w)
    las = regress.lasso(g, 0.1)
    n = len(y)
    # KKT: |grad_j| <= alpha for zero coefs, = alpha * sign for non-zero
    grad = xc.T @ (yc - xc @ las.coef) / n
    for j in range(3):
        if las.coef[j] != 0:
            assert grad[j] == pytest.approx(0.1 * np.sign(las.coef[j]), abs=1e-7)
        else:
            assert abs(grad[j]) <= 0.1 + 1e-9


@pytest.mark.parametrize("copies", [1, 5])
def test_gram_matches_numpy_over_complete_rows(spark, copies):
    df, x, y, cols = _reg_data(spark, n=60, p=3, seed=2)
    wide = df.select(*[(F.col(c) * (k + 1)).alias(f"{c}_{k}") for c in cols for k in range(copies)])
    arr = np.array(wide.collect(), dtype=float)
    names = wide.columns
    broken = wide.union(wide.limit(2).withColumn(names[0], F.lit(None).cast("double"))).union(
        wide.limit(2).withColumn(names[-1], F.lit(float("nan"))))
    g = gram(broken.repartition(5), names)
    assert g.n == len(arr) and np.allclose(g.xtx, arr.T @ arr) and np.allclose(g.sx, arr.sum(0))
    w = gram(wide, names, weight=F.lit(2.0))
    assert w.n == 2 * len(arr) and np.allclose(w.xtx, 2 * arr.T @ arr)
    by = grouped_gram(wide.withColumn("k", (F.col(names[0]) > 0).cast("int")), "k", names)
    assert set(by) == {0, 1} and np.allclose(by[0].xtx + by[1].xtx, arr.T @ arr)
    assert gram(wide.limit(0), names).n == 0


def test_correlation_matrix_is_pairwise_complete_and_stable(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=200)
    cols = {"a": a + 1e9, "b": 1e-7 * (a + rng.normal(size=200)), "c": rng.normal(size=200), "k": np.full(200, 0.1)}
    cols["b"][rng.random(200) < 0.3] = np.nan
    cols["c"][rng.random(200) < 0.3] = np.nan
    pdf = pd.DataFrame(cols)
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(pdf.to_numpy())]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double").repartition(4)
    got = {(r.a, r.b): r.r for r in profile.correlation_matrix(df, list(cols)).collect()}
    want = pdf.corr()
    assert len(got) == 16
    for (i, j), r in got.items():
        if "k" in (i, j):
            assert r is None
        else:
            assert r == pytest.approx(want.loc[i, j], abs=1e-6)


def test_cooks_distance_vs_leave_one_out(spark):
    df, x, y, cols = _reg_data(spark, n=50, seed=4)
    g = gram(df, cols, "y")
    fit = regress.ols(g)
    scored = df.withColumn("_id", F.monotonically_increasing_id()).withColumn("y_hat", fit.predict())
    out = regress.leverage_and_cooks(scored, g, fit, "y").orderBy("_id").collect()
    X = np.column_stack([np.ones(len(y)), x])
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    k = X.shape[1]
    s2 = np.sum((y - X @ beta) ** 2) / (len(y) - k)
    for i in range(len(y)):
        m = np.ones(len(y), bool)
        m[i] = False
        bi = np.linalg.lstsq(X[m], y[m], rcond=None)[0]
        d = np.sum((X @ beta - X @ bi) ** 2) / (k * s2)
        assert out[i].cooks_d == pytest.approx(d, rel=1e-6)


def test_vif_vs_auxiliary_regression(spark):
    df, x, y, cols = _reg_data(spark, n=100, seed=6)
    g = gram(df, cols)
    v = dict(regress.vif(g))
    for j, c in enumerate(cols):
        others = np.delete(x, j, axis=1)
        b = np.linalg.lstsq(others, x[:, j], rcond=None)[0]
        rss = np.sum((x[:, j] - others @ b) ** 2)
        r2u = 1 - rss / np.sum(x[:, j] ** 2)
        assert v[c] == pytest.approx(1 / (1 - r2u), rel=1e-9)


def test_chi2_quantile():
    # chi-square with 2 dof has closed form 1 - exp(-x/2)
    assert chi2_cdf(3.0, 2) == pytest.approx(1 - math.exp(-1.5), abs=1e-12)
    assert chi2_quantile(0.999, 2) == pytest.approx(-2 * math.log(0.001), rel=1e-9)
    assert chi2_quantile(0.999, 10) == pytest.approx(29.588298445, rel=1e-6)


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0 and "fault_24h" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_exact_quantiles_match_numpy(spark):
    from driftkit.operators.quantiles import exact_column_medians, exact_quantiles
    from driftkit.operators.preprocess import fit_preprocessing

    rng = np.random.default_rng(8)
    vals = np.round(rng.normal(size=(3, 101)), 1)
    data = [(g, float(v)) for g in range(3) for v in vals[g]] + [(0, None)]
    df = spark.createDataFrame(data, "g int, v double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    for g in range(3):
        want = np.quantile(vals[g], probs)
        assert got[g].n == 101
        assert [got[g][f"q{i}"] for i in range(len(probs))] == pytest.approx(list(want), abs=1e-12)
    wide = spark.createDataFrame([tuple(float(x) for x in vals[:, i]) for i in range(101)], "a double, b double, c double")
    med = exact_column_medians(wide, ["a", "b", "c"])
    assert [med["a"], med["b"], med["c"]] == pytest.approx(list(np.median(vals, axis=1)))
    model = fit_preprocessing(wide, ["a", "b"], [])
    assert [model.medians[c] for c in "ab"] == pytest.approx(list(np.median(vals, axis=1)[:2]))
    assert [model.scales[c] for c in "ab"] == pytest.approx(list(np.std(vals, axis=1)[:2]))


def test_preprocessing_edge_values(spark):
    from pyspark.errors import PySparkException

    nan = float("nan")
    df = spark.createDataFrame([(v, 5e-7 + s * 1e-7, 3.0, c) for v, s, c in [(1.0, 1, "a"), (2.0, 2, "b"), (3.0, 3, "a"), (nan, 4, "b"), (None, 5, "a")]], "x double, tiny double, same double, c string")
    model = fit_preprocessing(df, ["x", "tiny", "same"], ["c"])
    assert model.medians["x"] == 2.0 and model.means["x"] == pytest.approx(2.0)
    assert model.scales["tiny"] == pytest.approx(np.std([1, 2, 3, 4, 5]) * 1e-7) and model.scales["same"] == 1.0
    assert all(v is not None and not np.isnan(v) for r in model.transform(df).collect() for v in r)
    strange = df.withColumn("c", F.lit("zz"))
    with pytest.raises(PySparkException, match="unknown category"):
        model.transform(strange).collect()
    zeros = fit_preprocessing(df, [], ["c"], drop_first=False).transform(strange).first()
    assert list(zeros) == [0.0, 0.0]


def test_fold_params_by_block_and_by_mask(spark):
    from driftkit.operators.regress import LinearDesign

    rng = np.random.default_rng(12)
    data = [(int(b), float(np.round(v, 1)) if rng.random() > 0.1 else None, str(rng.choice(["A", "B"])), float(rng.normal()))
            for b, v in zip(rng.integers(0, 4, 300), rng.normal(size=300))]
    df = spark.createDataFrame(data, "_blk int, x double, c string, y double")
    d = LinearDesign(["x"], ["c"], "y", {"c": ["A", "B"]})
    masks = {f: F.col("_blk") < f for f in range(1, 4)}
    small = d.fold_params(df, masks)
    large = d.fold_params(df, masks, block_col="_blk")
    for f in range(1, 4):
        assert large[f].medians["x"] == pytest.approx(small[f].medians["x"])
        assert large[f].modes == small[f].modes and large[f].categories == small[f].categories


def test_prefix_sums_with_adaptive_partitions(spark):
    rnd = random.Random(4)
    data = [(i, rnd.randrange(0, 3)) for i in range(2000)]
    df = spark.createDataFrame(data, "k int, w long").repartition(9)
    got = sorted((r.k, r.w_cum) for r in prefix_sums(df, [F.col("k")], ["w"]).collect())
    c = 0
    for (k, w), (k2, cum) in zip(sorted(data), got):
        c += w
        assert k == k2 and cum == c


def test_temporal_evaluation_folds(spark):
    from driftkit.operators import classify, splits

    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    y = (x + rng.normal(scale=0.8, size=400) > 0.8).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "t long, x double, y int")
    idx = splits.row_index(df, ["t"])
    res = classify.evaluate_temporally(idx, 400, ["x"], [], "y", classify.LOGISTIC, 3, time_col=None)
    fm = {r.fold: r for r in res["fold_metrics"].collect()}
    assert sorted(fm) == [1, 2, 3] and all(fm[f].error == "" for f in fm)
    assert [fm[f].valid_start_index for f in (1, 2, 3)] == [100, 200, 300] and fm[1].train_size == 100
    assert all(fm[f].roc_auc > 0.7 for f in fm)
    assert res["predictions"].count() == 300
    s = res["summary"].first()
    assert s.folds == 3 and s.failed_folds == 0


def _offset_frame(spark, centre, spread, n=600, missing=0.0):
    rng = np.random.default_rng(17)
    z, c = rng.normal(size=(n, 2)), rng.choice(["A", "B", "C"], n)
    x = np.column_stack([centre + spread * z[:, 0], z[:, 1]])
    y = 5.0 + 3.0 * z[:, 0] - z[:, 1] + (c == "B") + rng.normal(scale=0.1, size=n)
    gone = rng.random(n) < missing
    rows = [(i, None if g else float(a), float(b), str(k), float(t), int(6 * i // n)) for i, (g, (a, b), k, t) in enumerate(zip(gone, x, c, y))]
    df = spark.createDataFrame(rows, "i long, a double, b double, c string, y double, _blk int").repartition(7)
    x[gone, 0] = np.median(x[~gone, 0])
    return df, x, c, y


@pytest.mark.parametrize("centre, spread", [(0.0, 1.0), (1e6, 1.0), (1.7e9, 100.0), (-3e12, 1e3)])
@pytest.mark.parametrize("missing", [0.0, 0.2])
def test_linear_models_keep_their_digits_at_any_offset(spark, centre, spread, missing):
    """Coefficients, R2, VIF, leverage, ridge, lasso and folds against numpy on centred data."""
    from driftkit.operators.regress import LinearDesign, discover_design
    from driftkit.plans import regression_study as rs

    df, x, c, y = _offset_frame(spark, centre, spread, missing=missing)
    d = discover_design(df, ["a", "b"], ["c"], "y")
    assert isinstance(d, LinearDesign) and d.categories["c"] == ["A", "B", "C"]
    fp, u = d.fold_params(df, {"all": F.lit(True)})["all"], d.moments_u(df)
    t, names, info = d.transform_matrix(fp, u)
    g = d.to_gram(t, u, names)
    shifted = x - [centre, 0.0]  # exact: numpy then works on small numbers
    z = (shifted - shifted.mean(0)) / shifted.std(0)
    design = np.column_stack([np.ones(len(y)), z, c == "B", c == "C"])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    fit = regress.ols(g)
    tol = 1e-9 if spread > 1e-8 * abs(centre) else 1e-6  # doubles at -3e12 are 5e-4 apart
    assert np.allclose(fit.coef, beta[1:], rtol=tol, atol=tol) and fit.intercept == pytest.approx(beta[0], rel=tol)
    r2 = 1 - np.sum((y - design @ beta) ** 2) / np.sum((y - y.mean()) ** 2)
    assert regress.r2(g, fit) == pytest.approx(r2, rel=tol) and regress.r2(g, fit) < 1
    zc, yc = design[:, 1:] - design[:, 1:].mean(0), y - y.mean()
    assert np.allclose(regress.ridge(g, 7.0).coef, np.linalg.solve(zc.T @ zc + 7 * np.eye(4), zc.T @ yc), rtol=tol, atol=tol)
    grad = zc.T @ (yc - zc @ regress.lasso(g, 0.05).coef) / len(y)
    assert np.all(np.abs(grad) <= 0.05 + 1e-6)
    inverse = np.linalg.inv(design[:, 1:].T @ design[:, 1:])
    assert [v for _, v in regress.vif(g)] == pytest.approx(list(np.diag(design[:, 1:].T @ design[:, 1:]) * np.diag(inverse)), rel=max(tol, 1e-8))
    fl = rs.FittedLinear(d, fp, t, names, info, g, fit)
    scored = regress.leverage_and_cooks(df.withColumn("y_hat", fl.predict_expr()), g, fit, "y", columns=fl.z_cols()).orderBy("i").collect()
    hat = np.einsum("ij,jk,ik->i", design, np.linalg.inv(design.T @ design), design)
    assert [r.leverage for r in scored] == pytest.approx(list(hat), rel=1e-6) and [r.y_hat for r in scored] == pytest.approx(list(design @ beta), rel=1e-6, abs=1e-6)
    # a fold trains on the merged moments of its blocks
    blocks = d.moments_u(df, F.col("_blk"))
    params = d.fold_params(df, {3: F.col("_blk") < 3}, block_col="_blk")
    tr = rs.merged((blocks[b] for b in range(3)), len(d.u_names()))
    tf, nf, _ = d.transform_matrix(params[3], tr)
    g_tr, g_va = d.to_gram(tf, tr, nf), d.to_gram(tf, blocks[3], nf)
    first = np.arange(len(y)) < len(y) // 2
    valid = ~first & (np.arange(len(y)) < 2 * len(y) // 3)
    if not missing:
        zf = (shifted - shifted[first].mean(0)) / shifted[first].std(0)
        df_ = np.column_stack([np.ones(len(y)), zf, c == "B", c == "C"])
        bf = np.linalg.lstsq(df_[first], y[first], rcond=None)[0]
        want = 1 - np.sum((y[valid] - df_[valid] @ bf) ** 2) / np.sum((y[valid] - y[valid].mean()) ** 2)
        assert regress.r2(g_va, regress.ols(g_tr)) == pytest.approx(want, rel=tol)


def test_gram_of_a_far_off_column(spark):
    """``gram`` itself, over many partitions, beside a constant column."""
    rng = np.random.default_rng(3)
    e = rng.normal(size=500)
    x = 1.7e9 + 1000 * e
    y = 2 * e + rng.normal(scale=0.07, size=500)
    df = spark.createDataFrame([(float(a), 0.1, float(b)) for a, b in zip(x, y)], "x double, k double, y double").repartition(40)
    g = gram(df, ["x", "k"], "y")
    fit = regress.ols(g)
    xc = x - 1.7e9
    slope = np.sum((xc - xc.mean()) * (y - y.mean())) / np.sum((xc - xc.mean()) ** 2)
    assert fit.coef[0] == pytest.approx(slope, rel=1e-9) and abs(fit.coef[1] * 0.1) < 1e-9
    assert regress.r2(g, fit) == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2, rel=1e-9)
