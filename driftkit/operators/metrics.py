"""Binary-classification metrics (M29-M33) and regression metrics (M17), grouped
by any key columns (model, fold, ...) in one pass each.

Scores are first reduced to one row per (group, distinct score) with positive
and negative counts; cumulative counts in descending score order come from the
distributed prefix sum, and every ranking metric is an aggregate of that table:

  AP      = (1/P) sum_t pos_t * tp_t / (tp_t + fp_t)          (step-wise, ties grouped)
  ROC-AUC = sum_t pos_t * (N - fp_t + neg_t / 2) / (P N)       (ties count 1/2)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftkit.functions.scalar import score_or_neg_inf
from driftkit.operators.scan import prefix_sums


def _grouped(fn):
    """Run ungrouped calls as one constant group (joins stay equi-joins)."""
    import functools

    @functools.wraps(fn)
    def wrapper(df, y, score, *args, group_cols: Sequence[str] = (), **kw):
        if group_cols:
            return fn(df, y, score, *args, group_cols=group_cols, **kw)
        out = fn(df.withColumn("_g", F.lit(0)), y, score, *args, group_cols=["_g"], **kw)
        return out.drop("_g")

    return wrapper


def score_counts(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """One row per (group, score): pos, neg.  NaN/NULL scores rank last (-inf)."""
    s = score_or_neg_inf(score)
    return df.groupBy(*group_cols, s.alias("score")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg")
    )


@_grouped
def cumulative_counts(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """M32 base: per distinct score (descending): pos, neg, tp, fp, P, N."""
    sc = score_counts(df, y, score, group_cols)
    cum = prefix_sums(sc, [F.col("score").desc()], ["pos", "neg"], group_cols)
    tot = sc.groupBy(*group_cols).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    out = cum.withColumnRenamed("pos_cum", "tp").withColumnRenamed("neg_cum", "fp")
    # one row per group: size follows the caller's grouping, so no broadcast hint
    # (AQE broadcasts it at run time when it is small)
    return out.join(tot, list(group_cols), "left")


@_grouped
def ranking_metrics(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """M29 + M30: average_precision (0 without positives, 1 without negatives) and
    roc_auc (NULL for one-class groups)."""
    c = cumulative_counts(df, y, score, group_cols=group_cols)
    ap_term = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    auc_term = F.col("pos") * (F.col("N") - F.col("fp") + F.col("neg") / 2.0)
    agg = c.groupBy(*group_cols).agg(
        F.first("P").alias("P"), F.first("N").alias("N"),
        F.sum(ap_term).alias("_ap"), F.sum(auc_term).alias("_auc"),
    )
    return agg.select(
        *group_cols,
        F.when(F.col("P") == 0, 0.0).when(F.col("N") == 0, 1.0).otherwise(F.col("_ap") / F.col("P")).alias("average_precision"),
        F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(None).cast("double"))
         .otherwise(F.col("_auc") / (F.col("P") * F.col("N"))).alias("roc_auc"),
    )


@_grouped
def threshold_metrics(df: DataFrame, y: str, score: str, threshold: float = 0.5, group_cols: Sequence[str] = ()) -> DataFrame:
    """Confusion matrix at ``score >= threshold`` (NaN scores -> negative),
    precision, recall, F1 (0 on zero division), balanced accuracy over the classes
    present, support, positive rate."""
    pred = (score_or_neg_inf(score) >= F.lit(threshold))
    pos = F.col(y) == 1
    a = df.groupBy(*group_cols).agg(
        F.count_if(~pos & ~pred).alias("tn"), F.count_if(~pos & pred).alias("fp"),
        F.count_if(pos & ~pred).alias("fn"), F.count_if(pos & pred).alias("tp"),
        F.count(F.lit(1)).alias("support"),
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)
    spec = tn / (tn + fp)
    bal = (F.when((tp + fn > 0) & (tn + fp > 0), (rec + spec) / 2)
           .when(tp + fn > 0, rec).otherwise(spec))
    return a.select(
        *group_cols, "tn", "fp", "fn", "tp", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
        bal.alias("balanced_accuracy"), "support", ((tp + fn) / F.col("support")).alias("positive_rate"),
        F.lit(float(threshold)).alias("threshold"), ((tp + fn == 0) | (tn + fp == 0)).alias("one_class_fold"),
    )


@_grouped
def binary_metrics(df: DataFrame, y: str, score: str, threshold: float = 0.5, group_cols: Sequence[str] = ()) -> DataFrame:
    """M29-M31 together: one row per group with every metric of the fold table."""
    r = ranking_metrics(df, y, score, group_cols=group_cols)
    t = threshold_metrics(df, y, score, threshold, group_cols=group_cols)
    out = t.join(r, list(group_cols), "left")
    return out.withColumn("pr_auc", F.col("average_precision"))


@_grouped
def curves(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Per distinct threshold - precision, recall, fpr, tpr."""
    c = cumulative_counts(df, y, score, group_cols=group_cols)
    return c.select(
        *group_cols, F.col("score").alias("threshold"), "tp", "fp",
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("recall"),
        F.when(F.col("N") > 0, F.col("fp") / F.col("N")).alias("fpr"),
        F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("tpr"),
    )


@_grouped
def best_f1_threshold(df: DataFrame, y: str, score: str, group_cols: Sequence[str] = (), eps: float = 1e-8) -> DataFrame:
    """Threshold maximising 2PR/(P+R+eps); ties -> the smaller threshold."""
    cv = curves(df, y, score, group_cols=group_cols)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(eps))
    cv = cv.withColumn("f1", f1)
    best = F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold")))
    return cv.groupBy(*group_cols).agg(best.alias("b")).select(*group_cols, F.col("b.threshold").alias("threshold"),
                                                                F.col("b.f1").alias("f1"))
