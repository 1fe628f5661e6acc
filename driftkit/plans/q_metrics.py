"""Registered queries for the classification metrics (M29-M33) on a fixed score:
events.value / 100 as the score of "event is an error", per fold = user_id % 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftkit.operators import metrics
from driftkit.plans.catalog import register, rounded
from driftkit.sources.tables import read_table

SCORED_SQL = """SELECT user_id % 3 AS fold, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y,
       CASE WHEN value IS NULL OR isnan(value) THEN -'inf'::DOUBLE ELSE value / 100.0 END AS score FROM events"""

CUM_SQL = f"""s AS ({SCORED_SQL}),
c AS (SELECT fold, score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM s GROUP BY fold, score),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
               sum(pos) OVER (PARTITION BY fold) AS P, sum(neg) OVER (PARTITION BY fold) AS N
        FROM c WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def scored(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select((F.col("user_id") % 3).alias("fold"), (F.col("event_type") == "error").cast("int").alias("y"),
                     (F.col("value") / 100.0).alias("score"))


@register("m29_m30_ranking_metrics", f"""WITH {CUM_SQL}
SELECT fold,
  rnd(CASE WHEN max(P) = 0 THEN 0.0 WHEN max(N) = 0 THEN 1.0 ELSE sum(pos * tp / (tp + fp)) / max(P) END) AS average_precision,
  rnd(CASE WHEN max(P) = 0 OR max(N) = 0 THEN NULL ELSE sum(pos * (N - fp + neg / 2.0)) / (max(P) * max(N)) END) AS roc_auc
FROM cum GROUP BY fold""")
def q_ranking(spark, sf_dir):
    return rounded(metrics.ranking_metrics(scored(spark, sf_dir), "y", "score", group_cols=["fold"]))


@register("m31_threshold_metrics", f"""WITH s AS ({SCORED_SQL}),
a AS (SELECT fold,
   count(*) FILTER (WHERE y <> 1 AND score < 0.5) AS tn, count(*) FILTER (WHERE y <> 1 AND score >= 0.5) AS fp,
   count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp,
   count(*) AS support FROM s GROUP BY fold)
SELECT fold, tn, fp, fn, tp,
  rnd(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END) AS precision,
  rnd(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END) AS recall,
  rnd(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS f1,
  rnd(CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (tp / (tp + fn) + tn / (tn + fp)) / 2
       WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE tn / (tn + fp) END) AS balanced_accuracy,
  support, rnd((tp + fn) / support) AS positive_rate, rnd(0.5) AS threshold, (tp + fn = 0 OR tn + fp = 0) AS one_class_fold
FROM a""")
def q_threshold(spark, sf_dir):
    return rounded(metrics.threshold_metrics(scored(spark, sf_dir), "y", "score", 0.5, group_cols=["fold"]))


@register("m32_pr_roc_curves", f"""WITH {CUM_SQL}
SELECT fold, rnd(score) AS threshold, tp, fp, rnd(tp / (tp + fp)) AS precision,
  rnd(CASE WHEN P > 0 THEN tp / P END) AS recall, rnd(CASE WHEN N > 0 THEN fp / N END) AS fpr,
  rnd(CASE WHEN P > 0 THEN tp / P END) AS tpr
FROM cum""")
def q_curves(spark, sf_dir):
    out = metrics.curves(scored(spark, sf_dir), "y", "score", group_cols=["fold"])
    return rounded(out.withColumn("tp", F.col("tp").cast("long")).withColumn("fp", F.col("fp").cast("long")))


@register("m33_best_f1_threshold", f"""WITH {CUM_SQL},
f AS (SELECT fold, score, 2 * (tp / (tp + fp)) * (tp / P) / ((tp / (tp + fp)) + (tp / P) + 1e-8) AS f1 FROM cum)
SELECT fold, rnd(arg_max(score, [f1, -score])) AS threshold, rnd(max(f1)) AS f1 FROM f GROUP BY fold""")
def q_best_f1(spark, sf_dir):
    return rounded(metrics.best_f1_threshold(scored(spark, sf_dir), "y", "score", group_cols=["fold"]))
