"""Fault classification study: label table -> leakage/sparsity
pruning -> time index -> expanding-window evaluation of several models ->
fold metrics, out-of-fold predictions, summaries; plus the baseline study's
outlier ablation and the unsupervised pieces."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit.functions.names import sanitize_name
from driftkit.operators import classify, metrics, prune, splits
from driftkit.operators.outlier import mahalanobis_outliers
from driftkit.plans import telemetry
from driftkit.plans.catalog import TARGETS
from driftkit.session import cut_lineage, stored
from driftkit.sources import sinks
from driftkit.sources.tables import readings

ID_COLS = ("backend", "qubit", "model_time")
TARGET = "fault_24h"
ENV_VARS = ("env_a", "env_b")


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftkit.plans.q_telemetry import node_cfg

    cfg = node_cfg()
    feed = readings(spark, sf_dir, hourly=True)
    env = telemetry.environment_features(feed, cfg)
    return telemetry.labelled_snapshot(feed, env, cfg)


def name_pruned(lab: DataFrame, instant: Sequence[str] = TARGETS, env_vars: Sequence[str] = ENV_VARS) -> DataFrame:
    """P10 -> P11 -> P12 (schema-only)."""
    out = prune.drop_leakage(lab, TARGET)
    out = prune.drop_count_and_instant(out, instant)
    return prune.keep_rolling_suffixes(out, env_vars)


def classification_frame(spark: SparkSession, sf_dir: str, null_threshold: float = 0.5):
    """P10 -> P9 (> 50 % NULL) -> P11 -> P12 -> W12 time index; checkpointed once
    (every fold and model reads it).  Returns (frame, n, numeric, categorical)."""
    # the missing rates, the index's keys and its rows are read from one copy
    out = stored(prune.drop_leakage(label_table(spark, sf_dir), TARGET))
    out, info = prune.drop_high_missingness(out, null_threshold, keep=list(ID_COLS) + [TARGET])
    out = prune.drop_count_and_instant(out, TARGETS)
    out = prune.keep_rolling_suffixes(out, ENV_VARS)
    out = out.withColumn("backend", F.col("backend").cast("string")).withColumn(TARGET, F.col(TARGET).cast("int"))
    idx = cut_lineage(splits.row_index(out, ["model_time", "backend", "qubit"]))
    n = idx.count()
    numeric = [c for c in idx.columns if c not in (*ID_COLS, TARGET, "row_index")]
    return idx, n, numeric, ["backend"]


# Which models of the source study are tuned, and over which grid.
TUNED = {classify.RANDOM_FOREST.name: classify.RANDOM_FOREST_GRID, classify.BOOSTED.name: classify.BOOSTED_GRID, classify.MLP.name: classify.MLP_GRID}
MODELS = (classify.LOGISTIC, classify.RANDOM_FOREST_BASIC, classify.RANDOM_FOREST, classify.BOOSTED, classify.MLP)


def _all(frames: Sequence[DataFrame | None]) -> DataFrame | None:
    out = None
    for f in frames:
        if f is not None:
            out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def run_models(idx: DataFrame, n: int, numeric, categorical, specs: Sequence[classify.ModelSpec] = MODELS, n_splits: int = 3,
               threshold: float = 0.5, tune_iter: int = 0, grids: dict | None = None, out_dir: str | None = None) -> dict:
    """Every model tuned (``tune_iter`` candidates of its grid; 0: none), evaluated
    through the same folds with its best parameters, and combined.  A model whose
    search fails is evaluated with its own settings and the error noted in its
    parameters.  With ``out_dir`` each model's and the combined artefacts are written (S9)."""
    grids = TUNED if grids is None else grids
    folds = classify.prepare_folds(idx, n, numeric, categorical, TARGET, n_splits) if tune_iter and any(s.name in grids for s in specs) else []
    spark, results, best, tuning = idx.sparkSession, [], {}, []
    for spec in specs:
        cv = None
        if tune_iter and spec.name in grids:
            try:
                found, cv = classify.random_search(folds, TARGET, spec, grids[spec.name], tune_iter)
                best[spec.name] = found
                spec = replace(spec, params={**spec.params, **found})
            except Exception as exc:  # noqa: BLE001 - the model runs with its own settings
                best[spec.name] = {"error": f"{type(exc).__name__}: {exc}"}
        else:
            best[spec.name] = {"note": "not tuned"}
        res = classify.evaluate_temporally(idx, n, numeric, categorical, TARGET, spec, n_splits, threshold)
        results.append(res)
        tuning.append(cv)
        if out_dir:
            sinks.write_model_artifacts(f"{out_dir.rstrip('/')}/{sanitize_name(spec.name)}", res["fold_metrics"], res["summary"], res["predictions"], cv, best[spec.name])
    fold_metrics = _all([r["fold_metrics"] for r in results])
    out = {"fold_metrics": fold_metrics, "summary": classify.summarize_folds(fold_metrics), "predictions": _all([r["predictions"] for r in results]),
           "tuning": _all(tuning), "best_params": best}
    if out_dir:
        sinks.write_model_artifacts(out_dir.rstrip("/"), fold_metrics, out["summary"], out["predictions"], out["tuning"], best)
    return out


def outlier_ablation(idx: DataFrame, n: int, numeric, categorical) -> DataFrame:
    """Logistic regression on the first 75 % / last 25 % (T7), with and without
    Mahalanobis outliers; AP, ROC-AUC, best F1 and its threshold per variant."""
    flagged, info = mahalanobis_outliers(idx, numeric, keep=["row_index"])
    flagged = flagged.select("row_index", "is_outlier")
    base = idx.join(flagged, "row_index")
    out = []
    for name, frame in (("all_rows", base), ("without_outliers", base.filter(~F.col("is_outlier")))):
        # the index of all rows holds already; only the filtered variant is numbered anew
        fr = frame if name == "all_rows" else splits.row_index(frame.drop("row_index"), ["model_time", "backend", "qubit"])
        m = fr.count()
        train, test = splits.positional_split(fr, m, 0.75)
        fc = classify.fit_classifier(train, numeric, categorical, TARGET, classify.LOGISTIC)
        sc = fc.score(test, ["row_index", TARGET]).withColumn("variant", F.lit(name))
        out.append(sc)
    scored = out[0].unionByName(out[1])
    rk = metrics.ranking_metrics(scored, TARGET, "y_score", group_cols=["variant"])
    f1 = metrics.best_f1_threshold(scored, TARGET, "y_score", group_cols=["variant"])
    return rk.join(f1, "variant").withColumn("outlier_threshold", F.lit(info["threshold"]))
