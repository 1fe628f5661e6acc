"""Registered queries for the classification study (P9-P12, T7/T8, M19-M37,
A22-A25) and the unsupervised pieces (M38, M39)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from driftkit.operators import classify, cluster, profile, prune, splits
from driftkit.operators.boosting import fit_boosted
from driftkit.operators.dbscan import dbscan
from driftkit.operators.outlier import mahalanobis_outliers
from driftkit.plans import fault_study as fs
from driftkit.plans.catalog import HIST, NODE_PROPS, TARGETS, register, rounded
from driftkit.plans.q_telemetry import _env_cols, _label_sql, _node_sql
from driftkit.sources.tables import read_table, vectors

def frame(spark, sf_dir):
    return fs.classification_frame(spark, sf_dir)


# Name rules applied to the label table's columns (P10 leakage, P11 counts and
# instant targets, P12 rolling keep-list), written out for the oracle.
_KEPT = (["backend", "qubit", "model_time", "click", "signup", "view", "calibration_lag_hours", "env_a",
          "env_a_mean_prev_24h", "env_a_std_prev_24h", "env_b", "env_b_mean_prev_24h", "env_b_std_prev_24h",
          "click_last_obs", "click_last_obs_age_hours", "click_was_missing", "error_last_obs",
          "error_last_obs_age_hours", "error_was_missing", "error_threshold", "purchase_threshold", "fault_24h"])
_ROUND = [c for c in _KEPT if c not in ("backend", "qubit", "model_time", "click_was_missing", "error_was_missing")]


@register("p10_p11_p12_name_pruning", f"""{_node_sql()},
{_label_sql('lo')}
SELECT backend, qubit, model_time, {", ".join(f"rnd({c}) AS {c}" for c in _ROUND)}, click_was_missing, error_was_missing
FROM lab WHERE fault_24h IS NOT NULL""")
def q_name_pruning(spark, sf_dir):
    return rounded(fs.name_pruned(fs.label_table(spark, sf_dir)))


_LABEL_COLS = [*NODE_PROPS, "calibration_lag_hours", *_env_cols(), *[f"{c}_{x}" for c in HIST for x in ("last_obs", "last_obs_age_hours", "was_missing")],
               *[f"{c}_threshold" for c in TARGETS], *[f"{c}_{x}_24h" for c in TARGETS for x in ("future_max", "future_obs_count", "fault")], "future_fault_target_count_24h"]


@register("p9_high_missingness", f"""{_node_sql()},
{_label_sql('lo')},
f AS (SELECT * FROM lab WHERE fault_24h IS NOT NULL),
m AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CAST({c} IS NULL AS DOUBLE)) AS missing_rate FROM f" for c in _LABEL_COLS)})
SELECT feature, rnd(missing_rate) AS missing_rate, missing_rate > 0.5 AS dropped FROM m""")
def q_missingness(spark, sf_dir):
    """Every column of the label table but its ids and target."""
    _, info = prune.drop_high_missingness(fs.label_table(spark, sf_dir), 0.5, keep=[*fs.ID_COLS, fs.TARGET])
    rows = [(c, r, r > 0.5) for c, r in info["rates"].items()]
    return rounded(spark.createDataFrame(rows, "feature string, missing_rate double, dropped boolean"))


@register("t7_t8_fold_summary", f"""{_node_sql()},
{_label_sql('lo')},
f AS (SELECT *, row_number() OVER (ORDER BY model_time, CAST(backend AS VARCHAR), qubit) - 1 AS row_index,
             count(*) OVER () AS n FROM lab WHERE fault_24h IS NOT NULL),
b AS (SELECT *, n // 4 AS t, n - 3 * (n // 4) AS first FROM f),
k AS (SELECT *, CASE WHEN row_index >= first THEN CAST((row_index - first) // t AS INTEGER) + 1 ELSE 0 END AS fold FROM b),
per AS (SELECT fold, count(*) AS valid_size, sum(fault_24h) AS valid_pos, min(row_index) AS valid_start_index,
               max(row_index) AS valid_end_index FROM k GROUP BY fold),
cum AS (SELECT *, sum(valid_size) OVER w AS train_size, sum(valid_pos) OVER w AS train_pos FROM per
        WINDOW w AS (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT fold, CAST(train_size AS BIGINT) AS train_size, valid_size, CAST(0 AS BIGINT) AS train_start_index,
       valid_start_index - 1 AS train_end_index, valid_start_index, valid_end_index,
       rnd(train_pos / train_size) AS train_positive_rate, rnd(valid_pos / valid_size) AS valid_positive_rate
FROM cum WHERE fold >= 1""")
def q_folds(spark, sf_dir):
    idx, n, _, _ = frame(spark, sf_dir)
    return rounded(splits.fold_summary(idx, n, 3, "fault_24h"))


def _model_query(spec):
    def q(spark, sf_dir):
        idx, n, num, cat = frame(spark, sf_dir)
        res = classify.evaluate_temporally(idx, n, num, cat, "fault_24h", spec, 3, 0.5)
        return rounded(res["fold_metrics"])
    return q


register("m19_m20_logistic_folds")(_model_query(classify.LOGISTIC))
register("m21_random_forest_folds")(_model_query(classify.RANDOM_FOREST))
register("m22_boosted_trees_folds")(_model_query(classify.BOOSTED))
register("m23_mlp_folds")(_model_query(classify.MLP))


@register("m25_m26_out_of_fold_predictions")
def q_oof(spark, sf_dir):
    idx, n, num, cat = frame(spark, sf_dir)
    res = classify.evaluate_temporally(idx, n, num, cat, "fault_24h", classify.LOGISTIC, 3, 0.5)
    return rounded(res["predictions"])


@register("m37_a23_model_comparison")
def q_compare(spark, sf_dir):
    """All five models; the perceptron is tuned over two candidates, the trees have a query of their own."""
    idx, n, num, cat = frame(spark, sf_dir)
    res = fs.run_models(idx, n, num, cat, tune_iter=2, grids={classify.MLP.name: classify.MLP_GRID})
    return rounded(res["summary"])


def _search(spark, sf_dir, spec, n_iter):
    idx, n, num, cat = frame(spark, sf_dir)
    folds = classify.prepare_folds(idx, n, num, cat, fs.TARGET)
    best, cv = classify.random_search(folds, fs.TARGET, spec, fs.TUNED[spec.name], n_iter)
    return rounded(cv.withColumn("is_best", F.col("params") == F.lit(str(sorted(best.items())))))


@register("m27_random_search_mlp")
def q_search(spark, sf_dir):
    return _search(spark, sf_dir, classify.MLP, 12)


@register("m27_random_search_forest")
def q_search_forest(spark, sf_dir):
    return _search(spark, sf_dir, classify.RANDOM_FOREST, 12)


@register("m27_random_search_boosted")
def q_search_boosted(spark, sf_dir):
    return _search(spark, sf_dir, classify.BOOSTED, 12)


@register("m34_feature_ranking")
def q_rank(spark, sf_dir):
    idx, n, num, cat = frame(spark, sf_dir)
    train, _ = splits.positional_split(idx, n, 0.75)
    fc = classify.fit_classifier(train, num, cat, "fault_24h", classify.RANDOM_FOREST_BASIC)
    return rounded(classify.feature_ranking(spark, fc, 15))


@register("m35_a22_mahalanobis_outliers")
def q_mahalanobis(spark, sf_dir):
    idx, n, num, cat = frame(spark, sf_dir)
    flagged, info = mahalanobis_outliers(idx, num, keep=["row_index", "fault_24h"])
    flagged = flagged.withColumn("flag", F.col("is_outlier").cast("int"))
    return rounded(profile.group_mean_difference(flagged, "flag", num, label="fault_24h", top=10))


@register("m36_outlier_ablation")
def q_ablation(spark, sf_dir):
    idx, n, num, cat = frame(spark, sf_dir)
    return rounded(fs.outlier_ablation(idx, n, num, cat))


@register("a24_entity_profile", f"""{_node_sql()},
{_label_sql('lo')}
SELECT backend, qubit, count(error) AS n, rnd(quantile_cont(error, 0.5)) AS median,
       rnd(quantile_cont(error, 0.75) - quantile_cont(error, 0.25)) AS iqr,
       rnd(avg(CAST(fault_24h = 1 AS DOUBLE))) AS fail_fraction, rnd(median(calibration_lag_hours)) AS lag_median
FROM lab WHERE fault_24h IS NOT NULL GROUP BY backend, qubit""")
def q_entity(spark, sf_dir):
    lab = fs.label_table(spark, sf_dir)
    return rounded(cluster.entity_profile(lab, ["backend", "qubit"], "error", "fault_24h", "calibration_lag_hours"))


def _vec(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return cluster.explode_vector(v, "embedding", 64, keep=["vec_id", "label"]), [f"x{i}" for i in range(64)]


@register("m38_pca_explained_variance")
def q_pca(spark, sf_dir):
    df, feats = _vec(spark, sf_dir)
    explained, _, _, _ = cluster.pca(df, feats, keep=["vec_id", "label"])
    return rounded(cluster.explained_frame(spark, explained))


@register("m39_a25_kmeans_contingency")
def q_kmeans(spark, sf_dir):
    df, feats = _vec(spark, sf_dir)
    _, _, _, proj = cluster.pca(df, feats, keep=["vec_id", "label"])
    km = cluster.kmeans(proj, "pcs", 3, keep=["vec_id", "label"])
    return cluster.contingency(km, "cluster", "label")


@register("m40_dbscan")
def q_dbscan(spark, sf_dir):
    """Density clusters on the first two principal components; rows per cluster."""
    df, feats = _vec(spark, sf_dir)
    _, _, _, proj = cluster.pca(df, feats, k=2, keep=["vec_id", "label"])
    flat = proj.select("vec_id", *[vector_to_array("pcs")[i].alias(f"pc{i + 1}") for i in range(2)])
    found = dbscan(flat, ["pc1", "pc2"], eps=0.3, min_samples=8)
    return found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_STUMP = ("l_quantity", "l_discount", "l_tax")


@register("m22_first_stump", f"""WITH d AS (SELECT {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _STUMP)}, CAST(l_returnflag = 'R' AS DOUBLE) AS y
  FROM lineitem WHERE l_returnflag IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in _STUMP)}),
b AS (SELECT avg(y) AS p, (count(*) - sum(y)) / sum(y) AS w FROM d),
g AS (SELECT d.*, CASE WHEN y = 1 THEN w ELSE 1 END * (p - y) AS g, CASE WHEN y = 1 THEN w ELSE 1 END * p * (1 - p) AS h FROM d, b),
t AS (SELECT sum(g) AS gt, sum(h) AS ht FROM g),
v AS ({" UNION ALL ".join(f"SELECT {i} AS k, '{c}' AS feature, {c} AS v, sum(g) AS g, sum(h) AS h FROM g GROUP BY {c}" for i, c in enumerate(_STUMP))}),
c AS (SELECT k, feature, v AS cut, sum(g) OVER w AS gl, sum(h) OVER w AS hl FROM v
      WINDOW w AS (PARTITION BY k ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) AS gain FROM c, t WHERE hl >= 1 AND ht - hl >= 1),
best AS (SELECT * FROM s ORDER BY gain DESC, k, cut LIMIT 1)
SELECT feature, rnd(cut) AS cut, rnd(gain) AS gain, rnd(-0.05 * gl / (hl + 1)) AS left_leaf, rnd(-0.05 * (gt - gl) / (ht - hl + 1)) AS right_leaf FROM best""")
def q_stump(spark, sf_dir):
    """The first split of the boosted trees on three columns of few values."""
    li = read_table(spark, sf_dir, "lineitem").na.drop(subset=["l_returnflag", *_STUMP])
    li = li.select(*_STUMP, (F.col("l_returnflag") == "R").cast("int").alias("y"))
    n, p = li.agg(F.count(F.lit(1)), F.sum("y")).first()
    model = fit_boosted(li, _STUMP, "y", n, p / n, (n - p) / p, n_estimators=1, max_depth=1, subsample=1.0, colsample=1.0)
    t = model.trees[0]
    f = int(t.feature[0])
    row = (_STUMP[f], float(model.cuts[f][t.cut[0] - 1]), float(t.gain[0]), float(t.value[1]), float(t.value[2]))
    return rounded(spark.createDataFrame([row], "feature string, cut double, gain double, left_leaf double, right_leaf double"))


@register("a25_label_contingency", """SELECT event_type, user_id % 3 AS backend, count(*) AS count FROM events GROUP BY ALL""")
def q_label_contingency(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").withColumn("backend", F.col("user_id") % 3)
    return cluster.contingency(events, "event_type", "backend")


_FOLD_SQL = f"""{_node_sql()},
{_label_sql('lo')},
f AS (SELECT *, row_number() OVER (ORDER BY model_time, CAST(backend AS VARCHAR), qubit) - 1 AS row_index,
             count(*) OVER () AS n FROM lab WHERE fault_24h IS NOT NULL),
b AS (SELECT *, n // 4 AS t, n - 3 * (n // 4) AS first FROM f)"""


@register("m20_class_weights", f"""{_FOLD_SQL},
folds(fold) AS (VALUES (1), (2), (3)),
tr AS (SELECT fold, count(*) AS n, sum(fault_24h) AS p FROM b, folds WHERE row_index < first + (fold - 1) * t GROUP BY fold)
SELECT fold, n AS train_size, CAST(p AS BIGINT) AS positives, rnd(n / (2.0 * p)) AS weight_positive,
       rnd(n / (2.0 * (n - p))) AS weight_negative, rnd((n - p) / p) AS scale_pos_weight FROM tr""")
def q_class_weights(spark, sf_dir):
    idx, n, _, _ = frame(spark, sf_dir)
    rows = []
    for fb in splits.expanding_folds(n, 3):
        train = idx.filter(F.col("row_index") <= fb["train_end"])
        n_tr, p = classify.class_counts(train, "fault_24h")
        rows.append((fb["fold"], int(n_tr), int(p), n_tr / (2 * p), n_tr / (2 * (n_tr - p)), (n_tr - p) / p))
    return rounded(spark.createDataFrame(rows, "fold int, train_size long, positives long, weight_positive double, "
                                               "weight_negative double, scale_pos_weight double"))


_A22_FEATS = ["click_last_obs", "click_last_obs_age_hours", "env_a", "env_b", "calibration_lag_hours"]


@register("a22_group_mean_difference", f"""{_node_sql()},
{_label_sql('lo')},
f AS (SELECT * FROM lab WHERE fault_24h IS NOT NULL),
g AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, avg(CASE WHEN error_was_missing = 1 THEN CAST({c} AS DOUBLE) END) AS mean_flagged, avg(CASE WHEN error_was_missing = 0 THEN CAST({c} AS DOUBLE) END) AS mean_other FROM f" for c in _A22_FEATS + ["fault_24h"])})
SELECT feature, rnd(mean_flagged) AS mean_flagged, rnd(mean_other) AS mean_other, rnd(abs(mean_flagged - mean_other)) AS abs_diff
FROM g ORDER BY abs(mean_flagged - mean_other) DESC NULLS LAST, feature LIMIT 10""")
def q_group_diff(spark, sf_dir):
    lab = fs.label_table(spark, sf_dir)
    return rounded(profile.group_mean_difference(lab, "error_was_missing", _A22_FEATS, label="fault_24h", top=10))
