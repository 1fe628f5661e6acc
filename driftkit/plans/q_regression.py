"""Registered queries for splits, preprocessing and the regression study
(W12, T6, M1-M18).  Row-level and aggregate steps have SQL twins; solved
models (driver-side p x p algebra) are rows-only checks, verified against
brute force in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftkit.operators import regress, splits
from driftkit.operators.preprocess import fit_preprocessing
from driftkit.plans import regression_study as rs
from driftkit.plans.catalog import register, rounded

def study(spark, sf_dir):
    """The study over this call's tables; each query below computes only the pieces it reads."""
    return rs.run(spark, sf_dir)


RF_SQL = """rf0 AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate AS model_time, l_extendedprice / 1000.0 AS y,
        l_quantity, l_discount, l_tax, l_returnflag,
        lag(l_extendedprice / 1000.0) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS y_prev,
        CASE WHEN l_discount IS NULL THEN NULL WHEN l_discount <= 0.05 THEN 'low_discount' ELSE 'high_discount' END AS discount_class
      FROM lineitem WHERE l_extendedprice IS NOT NULL),
rf AS (SELECT * FROM rf0 WHERE y_prev IS NOT NULL),
ix AS (SELECT *, row_number() OVER (ORDER BY model_time, l_orderkey, l_linenumber) - 1 AS row_index, count(*) OVER () AS n FROM rf),
cut AS (SELECT min(model_time) AS cutoff FROM ix WHERE row_index = CAST(floor(n * 0.8) AS BIGINT)),
tr AS (SELECT ix.* FROM ix, cut WHERE model_time < cutoff),
te AS (SELECT ix.* FROM ix, cut WHERE model_time >= cutoff)"""

NUM = ["y_prev", "l_quantity", "l_discount", "l_tax"]


@register("w12_row_index", f"""WITH {RF_SQL}
SELECT l_orderkey, l_linenumber, row_index FROM ix""")
def q_row_index(spark, sf_dir):
    fr = rs.regression_frame(spark, sf_dir)
    return splits.row_index(fr, ["model_time", "l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "row_index")


def _prepared(spark, sf_dir):
    """regression frame -> checkpoint -> P9 -> T6 (what every step below reads)."""
    return rs.prepare(rs.regression_frame(spark, sf_dir), rs.StudyConfig())


@register("t6_chronological_split", f"""WITH {RF_SQL}
SELECT (SELECT cutoff FROM cut) AS cutoff, (SELECT count(*) FROM tr) AS n_train, (SELECT count(*) FROM te) AS n_test""")
def q_split(spark, sf_dir):
    p = _prepared(spark, sf_dir)
    return spark.createDataFrame([(p["cutoff"], p["train"].count(), p["test"].count())],
                                 "cutoff timestamp_ntz, n_train long, n_test long")


def _params_sql() -> str:
    parts = []
    for c in NUM:
        parts.append(f"""SELECT '{c}' AS feature, median({c}) AS median,
   avg(coalesce({c}, (SELECT median({c}) FROM tr))) AS mean,
   stddev_pop(coalesce({c}, (SELECT median({c}) FROM tr))) AS sd FROM tr""")
    return "\n  UNION ALL ".join(parts)


@register("m1_m3_fit_parameters", f"""WITH {RF_SQL}, p AS ({_params_sql()})
SELECT feature, rnd(median) AS median, rnd(mean) AS mean, rnd(CASE WHEN sd > 0 THEN sd ELSE 1.0 END) AS scale FROM p""")
def q_params(spark, sf_dir):
    train = _prepared(spark, sf_dir)["train"]
    m = fit_preprocessing(train, NUM, [])
    rows = [(c, m.medians[c], m.means[c], m.scales[c]) for c in NUM]
    return rounded(spark.createDataFrame(rows, "feature string, median double, mean double, scale double"))


def _design_sql() -> str:
    z = []
    for c in NUM:
        med = f"(SELECT median({c}) FROM tr)"
        imp = f"coalesce({c}, {med})"
        mu = f"(SELECT avg(coalesce({c}, {med})) FROM tr)"
        sd = f"(SELECT CASE WHEN stddev_pop(coalesce({c}, {med})) > 0 THEN stddev_pop(coalesce({c}, {med})) ELSE 1.0 END FROM tr)"
        z.append(f"rnd(({imp} - {mu}) / {sd}) AS {c}")
    mode_rf = "(SELECT mode(l_returnflag ORDER BY l_returnflag) FROM tr)"
    return ", ".join(z) + f""",
  rnd(CAST(coalesce(l_returnflag, {mode_rf}) = 'N' AS DOUBLE)) AS l_returnflag_N,
  rnd(CAST(coalesce(l_returnflag, {mode_rf}) = 'R' AS DOUBLE)) AS l_returnflag_R"""


@register("m4_m6_design_matrix", f"""WITH {RF_SQL}
SELECT l_orderkey, l_linenumber, {_design_sql()} FROM tr""")
def q_design(spark, sf_dir):
    train = _prepared(spark, sf_dir)["train"]
    m = fit_preprocessing(train, NUM, ["l_returnflag"], drop_first=True)
    return rounded(m.transform(train, keep=["l_orderkey", "l_linenumber"]))


@register("m7_gram_matrix", f"""WITH {RF_SQL}, d AS (SELECT {", ".join(f"{c}" for c in NUM)} FROM tr),
g AS ({" UNION ALL ".join(f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, sum({a} * {b}) AS value FROM d" for i, a in enumerate(NUM) for b in NUM[i:])})
SELECT feature_i, feature_j, rnd(value / 1000.0) AS value FROM g""")
def q_gram(spark, sf_dir):
    from driftkit.operators.gram import gram_long
    train = _prepared(spark, sf_dir)["train"]
    out = gram_long(train.na.drop(subset=NUM), NUM)
    return rounded(out.withColumn("value", F.col("value") / 1000.0))


@register("m7_ols_coefficients")
def q_ols(spark, sf_dir):
    s = study(spark, sf_dir)
    return rounded(regress.coefficient_table(spark, s["ols"].fit, "OLS"))


@register("m8_vif")
def q_vif(spark, sf_dir):
    s = study(spark, sf_dir)
    return rounded(regress.vif_table(spark, s["ols"].gram))


@register("m9_cooks_distance_filter")
def q_cooks(spark, sf_dir):
    s = study(spark, sf_dir)
    c = s["cooks"]
    kept = s["clean"].count()
    n = int(c["n"])
    return rounded(spark.createDataFrame([(n, kept, n - kept, float(c["threshold"]))],
                                         "n_train long, n_kept long, n_excluded long, threshold double"))


@register("m10_residual_diagnostics")
def q_residuals(spark, sf_dir):
    s = study(spark, sf_dir)
    fl = s["ols"]
    scored = s["clean"].select("l_orderkey", "l_linenumber", "y", fl.predict_expr().alias("y_hat"))
    return rounded(regress.residual_columns(scored, "y"))


@register("m11_qq_points")
def q_qq(spark, sf_dir):
    s = study(spark, sf_dir)
    fl = s["ols"]
    res = s["clean"].select((F.col("y") - fl.predict_expr()).alias("residual"))
    return rounded(regress.qq_table(res))


@register("m12_jarque_bera")
def q_jb(spark, sf_dir):
    s = study(spark, sf_dir)
    out = []
    for name, fl, frame in (("baseline", s["base"], s["prep"]["train"]), ("cleaned", s["ols"], s["clean"])):
        res = frame.select((F.col("y") - fl.predict_expr()).alias("residual"))
        out.append(regress.jarque_bera(res).withColumn("model", F.lit(name)))
    return rounded(out[0].unionByName(out[1]))


def _folds(spark, s, kind):
    rows = [(kind, r["fold"], r["alpha"], r["test_score"], r["train_score"]) for r in s[kind]["folds"]]
    return spark.createDataFrame(rows, "model string, fold int, alpha double, test_score double, train_score double")


@register("m13_regularized_cv_folds")
def q_cv_folds(spark, sf_dir):
    s = study(spark, sf_dir)
    return rounded(_folds(spark, s, "lasso").unionByName(_folds(spark, s, "ridge")))


@register("m14_lasso_path")
def q_path(spark, sf_dir):
    s = study(spark, sf_dir)
    rows = rs.lasso_path(s["ols"])
    return rounded(spark.createDataFrame(rows, "alpha double, feature string, coef double"))


@register("m15_cv_curve_top5")
def q_curve(spark, sf_dir):
    s = study(spark, sf_dir)
    rows = [(k, r["alpha"], r["mean_test_score"], r["std_test_score"], r["rank_test_score"])
            for k in ("lasso", "ridge") for r in s[k]["curve"]]
    df = spark.createDataFrame(rows, "model string, alpha double, mean_test_score double, std_test_score double, rank_test_score int")
    from pyspark.sql import Window
    w = Window.partitionBy("model").orderBy("rank_test_score", "alpha")
    return rounded(df.withColumn("_r", F.row_number().over(w)).filter("_r <= 5").drop("_r"))


@register("m16_coefficient_comparison")
def q_coef_cmp(spark, sf_dir):
    s = study(spark, sf_dir)
    lasso, ridge = s["lasso"]["fitted"], s["ridge"]["fitted"]
    tabs = []
    for name, fl in (("OLS", s["ols"]), ("LASSO", lasso), ("Ridge", ridge)):
        tabs.append(spark.createDataFrame([(f, float(w)) for f, w in zip(fl.names, fl.fit.coef)], f"feature string, {name} double"))
    out = tabs[0].join(tabs[1], "feature", "full").join(tabs[2], "feature", "full")
    return rounded(out.withColumn("lasso_selected", F.col("LASSO") != 0))


@register("m17_m18_model_comparison")
def q_compare(spark, sf_dir):
    s = study(spark, sf_dir)
    return rounded(rs.comparison_table(spark, s["metrics"]))


@register("m7_m17_simple_regression", f"""WITH {RF_SQL},
f AS (SELECT regr_slope(y, l_quantity) AS slope, regr_intercept(y, l_quantity) AS intercept, regr_r2(y, l_quantity) AS r2 FROM tr
      WHERE y IS NOT NULL AND l_quantity IS NOT NULL),
e AS (SELECT y - (f.intercept + f.slope * l_quantity) AS err FROM te, f WHERE y IS NOT NULL AND l_quantity IS NOT NULL),
s AS (SELECT avg(y) AS ybar FROM te WHERE y IS NOT NULL AND l_quantity IS NOT NULL)
SELECT rnd(f.slope) AS slope, rnd(f.intercept) AS intercept, rnd(f.r2) AS R2_train,
       rnd(1 - (SELECT sum(err * err) FROM e) / (SELECT sum((y - s.ybar) * (y - s.ybar)) FROM te, s WHERE y IS NOT NULL AND l_quantity IS NOT NULL)) AS R2_test,
       rnd(sqrt((SELECT avg(err * err) FROM e))) AS RMSE_test, rnd((SELECT avg(abs(err)) FROM e)) AS MAE_test
FROM f""")
def q_simple_regression(spark, sf_dir):
    """M7 + M17 with one regressor: Gram solve on the driver, metrics from Grams and one pass."""
    from driftkit.operators.gram import gram

    p = _prepared(spark, sf_dir)
    tr = p["train"].na.drop(subset=["y", "l_quantity"])
    te = p["test"].na.drop(subset=["y", "l_quantity"])
    g_tr, g_te = gram(tr, ["l_quantity"], "y"), gram(te, ["l_quantity"], "y")
    fit = regress.ols(g_tr)
    mae = te.agg(F.avg(F.abs(F.col("y") - fit.predict())).alias("m")).first()["m"]
    row = (float(fit.coef[0]), fit.intercept, regress.r2(g_tr, fit), regress.r2(g_te, fit), regress.rmse(g_te, fit), float(mae))
    return rounded(spark.createDataFrame([row], "slope double, intercept double, R2_train double, R2_test double, "
                                                "RMSE_test double, MAE_test double"))
