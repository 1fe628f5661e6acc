"""Registered queries that run the regression, outlier and PCA operators on one or
two regressors, where plain SQL states the answer (M8-M18, M35, M38)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftkit.operators import cluster, regress
from driftkit.operators.gram import gram
from driftkit.operators.outlier import mahalanobis_outliers
from driftkit.plans import regression_study as rs
from driftkit.plans.catalog import register, rounded
from driftkit.plans.q_regression import RF_SQL

IDS = ["l_orderkey", "l_linenumber"]
ONE = rs.StudyConfig(numeric=("l_quantity",), categorical=())


def _train(spark, sf_dir):
    return rs.prepare(rs.regression_frame(spark, sf_dir), rs.StudyConfig())["train"]


def _one_regressor(spark, sf_dir):
    """Training rows with a quantity, their Gram, the fit and the scored rows."""
    rows = _train(spark, sf_dir).na.drop(subset=["y", "l_quantity"])
    g = gram(rows, ["l_quantity"], "y")
    fit = regress.ols(g)
    return g, fit, rows.select(*IDS, "y", "l_quantity", fit.predict().alias("y_hat"))


ONE_SQL = f"""WITH {RF_SQL},
d AS (SELECT l_orderkey, l_linenumber, y, CAST(l_quantity AS DOUBLE) AS x FROM tr WHERE y IS NOT NULL AND l_quantity IS NOT NULL),
f AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM d),
p AS (SELECT d.*, f.*, my + sxy / sxx * (x - mx) AS y_hat FROM d, f),
e AS (SELECT *, y - y_hat AS residual, sqrt(avg((y - y_hat) * (y - y_hat)) OVER ()) AS rms FROM p)"""


@register("m8_vif_two_regressors", f"""WITH {RF_SQL},
s AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_discount * l_discount) AS b, sum(l_quantity * l_discount) AS c
      FROM tr WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL)
SELECT feature, rnd(a * b / (a * b - c * c)) AS vif, a * b / (a * b - c * c) > 10 AS high
FROM s, (VALUES ('l_quantity'), ('l_discount')) AS t(feature)""")
def q_vif_two(spark, sf_dir):
    g = gram(_train(spark, sf_dir), ["l_quantity", "l_discount"])
    return rounded(regress.vif_table(spark, g))


@register("m9_cooks_one_regressor", f"""{ONE_SQL},
h AS (SELECT *, 1.0 / n + (x - mx) * (x - mx) / sxx AS leverage, rms * rms * n / (n - 2) AS s2 FROM e),
c AS (SELECT *, residual * residual * leverage / (2 * s2 * (1 - leverage) * (1 - leverage)) AS cooks_d FROM h)
SELECT l_orderkey, l_linenumber, rnd(leverage * n) AS leverage_n, rnd(residual) AS residual, rnd(cooks_d * n) AS cooks_d_n,
       cooks_d <= 4.0 / n AS kept FROM c""")
def q_cooks_one(spark, sf_dir):
    g, fit, scored = _one_regressor(spark, sf_dir)
    out = regress.leverage_and_cooks(scored, g, fit, "y")
    return rounded(out.select(*IDS, (F.col("leverage") * g.n).alias("leverage_n"), "residual", (F.col("cooks_d") * g.n).alias("cooks_d_n"),
                              (F.col("cooks_d") <= 4.0 / g.n).alias("kept")))


@register("m10_residuals_one_regressor", f"""{ONE_SQL}
SELECT l_orderkey, l_linenumber, rnd(y) AS y, rnd(y_hat) AS y_hat, rnd(residual) AS residual, rnd(residual / rms) AS std_residual,
       rnd(sqrt(abs(residual / rms))) AS sqrt_abs_std_residual FROM e""")
def q_residuals_one(spark, sf_dir):
    _, _, scored = _one_regressor(spark, sf_dir)
    return rounded(regress.residual_columns(scored.drop("l_quantity"), "y"))


_PROBS = "[" + ", ".join(f"{(k + 1) / 100!r}" for k in range(99)) + "]"


@register("m11_qq_one_regressor", f"""{ONE_SQL},
s AS (SELECT unnest({_PROBS}) AS p, unnest(quantile_cont(residual, {_PROBS})) AS sample_quantile FROM e)
SELECT rnd(CAST(p AS DOUBLE)) AS p, rnd(sample_quantile) AS sample_quantile FROM s""")
def q_qq_one(spark, sf_dir):
    _, _, scored = _one_regressor(spark, sf_dir)
    res = scored.select((F.col("y") - F.col("y_hat")).alias("residual"))
    return rounded(regress.qq_table(res).drop("normal_quantile"))


@register("m12_jarque_bera_one_regressor", f"""{ONE_SQL},
m AS (SELECT count(*) AS n, avg(residual) AS m1 FROM e),
c AS (SELECT min(m.n) AS n, avg(power(residual - m1, 2)) AS m2, avg(power(residual - m1, 3)) AS m3, avg(power(residual - m1, 4)) AS m4 FROM e, m),
k AS (SELECT n, m3 / power(m2, 1.5) AS s, m4 / (m2 * m2) - 3 AS k FROM c)
SELECT CAST(n AS DOUBLE) AS n, rnd(s) AS skewness, rnd(k) AS excess_kurtosis, rnd((s * s + k * k / 4) / 6) AS jb_per_row,
       rnd(exp(-n / 12.0 * (s * s + k * k / 4))) AS p_value FROM k""")
def q_jb_one(spark, sf_dir):
    _, _, scored = _one_regressor(spark, sf_dir)
    out = regress.jarque_bera(scored.select((F.col("y") - F.col("y_hat")).alias("residual")))
    return rounded(out.withColumn("jb_per_row", F.col("jb") / F.col("n")).drop("jb"))


_SHRINK = [("ridge", a) for a in (0.0, 1.0, 1e3, 1e5, 1e7)] + [("lasso", a) for a in (0.0, 1.0, 10.0, 100.0, 1000.0)]


@register("m13_m14_shrinkage_one_regressor", f"""{ONE_SQL},
a(model, alpha) AS (VALUES {", ".join(f"('{k}', {a:e})" for k, a in _SHRINK)}),
w AS (SELECT model, alpha, mx, my, CASE WHEN model = 'ridge' THEN sxy / (sxx + alpha)
             ELSE sign(sxy) * greatest(abs(sxy) / n - alpha, 0) / (sxx / n) END AS coef FROM f, a)
SELECT model, rnd(alpha) AS alpha, rnd(coef) AS coef, rnd(my - coef * mx) AS intercept FROM w""")
def q_shrinkage(spark, sf_dir):
    g = gram(_train(spark, sf_dir), ["l_quantity"], "y")
    fits = [(k, a, (regress.ridge if k == "ridge" else regress.lasso)(g, a)) for k, a in _SHRINK]
    rows = [(k, a, float(f.coef[0]), float(f.intercept)) for k, a, f in fits]
    out = spark.createDataFrame(rows, "model string, alpha double, coef double, intercept double")
    return rounded(out)


def _grid(values) -> str:
    return "[" + ", ".join(f"{float(v):.17e}" for v in values) + "]"


_CV_SQL = f"""WITH {RF_SQL},
q AS (SELECT y, CAST(l_quantity AS DOUBLE) AS x0, row_number() OVER (ORDER BY model_time, l_orderkey, l_linenumber) - 1 AS i, count(*) OVER () AS n FROM tr),
k AS (SELECT *, CASE WHEN i >= n - 5 * (n // 6) THEN (i - (n - 5 * (n // 6))) // (n // 6) + 1 ELSE 0 END AS blk FROM q),
folds AS (SELECT unnest(range(1, 6)) AS fold),
md AS (SELECT fold, median(x0) AS med FROM k JOIN folds ON blk < fold GROUP BY fold),
a AS (SELECT fold, blk, y, coalesce(x0, med) AS x FROM k JOIN md ON blk <= fold),
t AS (SELECT fold, count(*) AS nt, avg(x) AS mx, stddev_pop(x) AS sd, avg(y) AS my, covar_pop(y, x) / stddev_pop(x) AS c, var_pop(y) AS vy
      FROM a WHERE blk < fold GROUP BY fold),
v AS (SELECT fold, sum((y - my) * (y - my)) AS yy, sum((x - mx) / sd * (y - my)) AS xy, sum((x - mx) / sd * (x - mx) / sd) AS xx, var_pop(y) * count(*) AS sst
      FROM a JOIN t USING (fold) WHERE blk = fold GROUP BY fold),
g AS (SELECT 'lasso' AS model, unnest({_grid(rs.LASSO_GRID)}) AS alpha UNION ALL SELECT 'ridge' AS model, unnest({_grid(rs.RIDGE_GRID)}) AS alpha),
w AS (SELECT fold, model, alpha, c, vy, CASE WHEN model = 'ridge' THEN nt * c / (nt + alpha) ELSE sign(c) * greatest(abs(c) - alpha, 0) END AS w FROM t, g),
s AS (SELECT model, CAST(fold AS INTEGER) AS fold, alpha, 1 - (yy - 2 * w * xy + w * w * xx) / sst AS test_score, 1 - (vy - 2 * w * c + w * w) / vy AS train_score
      FROM w JOIN v USING (fold))"""


def _cv(spark, sf_dir) -> dict:
    train = rs.prepare(rs.regression_frame(spark, sf_dir), ONE)["train"]
    stats, full = rs.fold_statistics(train, ["l_quantity"], ONE), rs.fit_full(train, ["l_quantity"], ONE)
    return {k: rs.regularized_cv(stats, full, ONE, k, grid) for k, grid in (("lasso", rs.LASSO_GRID), ("ridge", rs.RIDGE_GRID))}


@register("m13_cv_folds_one_regressor", f"""{_CV_SQL}
SELECT model, fold, rnd(alpha) AS alpha, rnd(test_score) AS test_score, rnd(train_score) AS train_score FROM s""")
def q_cv_one(spark, sf_dir):
    rows = [(k, r["fold"], r["alpha"], r["test_score"], r["train_score"]) for k, cv in _cv(spark, sf_dir).items() for r in cv["folds"]]
    return rounded(spark.createDataFrame(rows, "model string, fold int, alpha double, test_score double, train_score double"))


@register("m15_cv_curve_one_regressor", f"""{_CV_SQL}
SELECT model, rnd(alpha) AS alpha, rnd(avg(test_score)) AS mean_test_score, rnd(stddev_pop(test_score)) AS std_test_score FROM s GROUP BY model, alpha""")
def q_curve_one(spark, sf_dir):
    rows = [(k, r["alpha"], r["mean_test_score"], r["std_test_score"]) for k, cv in _cv(spark, sf_dir).items() for r in cv["curve"]]
    return rounded(spark.createDataFrame(rows, "model string, alpha double, mean_test_score double, std_test_score double"))


@register("m17_m18_comparison_one_regressor", f"""WITH {RF_SQL},
md AS (SELECT median(l_quantity) AS med FROM tr),
a AS (SELECT true AS fitted, y, coalesce(l_quantity, med) AS x FROM tr, md UNION ALL SELECT false AS fitted, y, coalesce(l_quantity, med) AS x FROM te, md),
t AS (SELECT count(*) AS n, avg(x) AS mx, stddev_pop(x) AS sd, avg(y) AS my, covar_pop(y, x) / stddev_pop(x) AS c FROM a WHERE fitted),
w AS (SELECT 'OLS' AS model, CAST(NULL AS DOUBLE) AS alpha, c AS w, mx, sd, my FROM t
      UNION ALL SELECT 'Ridge', 1e3, n * c / (n + 1e3), mx, sd, my FROM t
      UNION ALL SELECT 'LASSO', 5e0, sign(c) * greatest(abs(c) - 5, 0), mx, sd, my FROM t),
e AS (SELECT model, alpha, w, fitted, y, y - my - w * (x - mx) / sd AS err FROM a, w),
s AS (SELECT model, alpha, w, fitted, avg(err * err) AS mse, avg(abs(err)) AS mae, var_pop(y) AS v FROM e GROUP BY ALL)
SELECT model, rnd(1 - r.mse / r.v) AS R2_train, rnd(1 - h.mse / h.v) AS R2_test, rnd(sqrt(h.mse)) AS RMSE_test, rnd(h.mae) AS MAE_test, r.alpha AS alpha,
       CASE WHEN r.alpha IS NOT NULL THEN CAST(r.w <> 0 AS DOUBLE) END AS n_features_selected,
       CASE WHEN r.alpha IS NOT NULL THEN CAST(1 AS DOUBLE) END AS n_features_total
FROM s r JOIN s h USING (model) WHERE r.fitted AND NOT h.fitted""")
def q_comparison_one(spark, sf_dir):
    p = rs.prepare(rs.regression_frame(spark, sf_dir), ONE)
    kinds = (("OLS", None, regress.ols), ("Ridge", 1e3, lambda g: regress.ridge(g, 1e3)), ("LASSO", 5.0, lambda g: regress.lasso(g, 5.0)))
    models = [rs.fit_full(p["train"], ["l_quantity"], ONE, solver) for _, _, solver in kinds]
    test = models[0].design.moments_u(p["test"])
    rows = []
    for (name, alpha, _), m, mae in zip(kinds, models, rs.mean_absolute_errors(p["test"], models)):
        extra = {"alpha": alpha, "n_features_selected": int((m.fit.coef != 0).sum()), "n_features_total": 1} if alpha else None
        rows.append(rs.evaluate(m, test, mae, name, extra))
    counts = {c: F.col(c).cast("double") for c in ("n_features_selected", "n_features_total")}
    return rounded(rs.comparison_table(spark, rows).withColumns(counts))


_PAIR_SQL = f"""WITH {RF_SQL},
md AS (SELECT median(l_quantity) AS qa, median(l_discount) AS qb FROM tr),
i AS (SELECT l_orderkey, l_linenumber, CAST(coalesce(l_quantity, qa) AS DOUBLE) AS a, CAST(coalesce(l_discount, qb) AS DOUBLE) AS b FROM tr, md),
m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) AS sa, stddev_pop(b) AS sb, corr(a, b) AS r FROM i)"""


@register("m35_mahalanobis_two_columns", f"""{_PAIR_SQL},
z AS (SELECT l_orderkey, l_linenumber, n, r, (a - ma) / sa AS a, (b - mb) / sb AS b FROM i, m),
s AS (SELECT *, (a * a - 2 * r * a * b + b * b) / (1 - r * r) * (n - 1) / n AS d2 FROM z)
SELECT l_orderkey, l_linenumber, rnd(d2) AS mahalanobis_sq, d2 > -2 * ln(0.2) AS is_outlier FROM s""")
def q_mahalanobis_two(spark, sf_dir):
    out, _ = mahalanobis_outliers(_train(spark, sf_dir), ["l_quantity", "l_discount"], p_value=0.2, keep=IDS)
    return rounded(out.select(*IDS, "mahalanobis_sq", "is_outlier"))


@register("m38_pca_two_columns", f"""{_PAIR_SQL}
SELECT 1 AS component, rnd((1 + abs(r)) / 2) AS variance_ratio, rnd((1 + abs(r)) / 2) AS cumulative_ratio FROM m
UNION ALL SELECT 2 AS component, rnd((1 - abs(r)) / 2) AS variance_ratio, rnd(1.0) AS cumulative_ratio FROM m""")
def q_pca_two(spark, sf_dir):
    explained, _, _, _ = cluster.pca(_train(spark, sf_dir), ["l_quantity", "l_discount"], keep=IDS)
    return rounded(cluster.explained_frame(spark, explained))
