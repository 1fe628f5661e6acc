"""Time-ordered binary classification.

Every fold refits the column preprocessing (M6) on its own training rows and an
estimator on the result: MLlib's logistic regression and forest (``forest`` where rows fill more
than a task), MLlib's perceptron, its weights trained by ``perceptron`` there, and the boosted trees of ``boosting``.  A fold's validation scores are written inside its own
guarded step; all folds' scores are then measured by ONE grouped job per model.  Candidate fits of a
random search run as concurrent Spark jobs (``parallelism``), the way MLlib's
``CrossValidator`` does.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit.operators import metrics, splits
from driftkit.operators.boosting import BoostedModel, fit_boosted
from driftkit.operators.forest import PARAMS as FOREST_PARAMS, ForestModel, fit_forest, fit_forests, score_forests, subset_size
from driftkit.operators.perceptron import ROWS_PER_PART, fit_perceptrons, spread
from driftkit.operators.preprocess import fit_preprocessing
from driftkit.session import cut_lineage

IDX = "row_index"
METRIC_COLS = ["average_precision", "pr_auc", "roc_auc", "f1", "precision", "recall", "balanced_accuracy"]


@dataclass
class ModelSpec:
    """An estimator factory plus how to weight classes."""

    name: str
    kind: str                       # logistic | random_forest | boosted | mlp
    params: dict = field(default_factory=dict)
    weighting: str = "balanced"     # balanced | pos_ratio | none


# The model settings of the source study.
LOGISTIC = ModelSpec("Logistic Regression", "logistic", {"maxIter": 1000})
RANDOM_FOREST_BASIC = ModelSpec("Random Forest (basis)", "random_forest", {"numTrees": 50, "maxDepth": 7})
RANDOM_FOREST = ModelSpec("Random Forest", "random_forest",
                          {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt"})
BOOSTED = ModelSpec("Gradient Boosted Trees", "boosted",
                    {"n_estimators": 150, "max_depth": 3, "learning_rate": 0.05, "subsample": 0.9, "colsample": 0.9,
                     "reg_alpha": 0.0, "reg_lambda": 1.0, "max_bin": 256}, weighting="pos_ratio")
MLP = ModelSpec("MLP", "mlp", {"hidden": (64, 32), "maxIter": 200}, weighting="none")

# The search grids of the source study.  The MLP learning rate has no
# counterpart under l-bfgs, and depth 30 (the most MLlib takes) stands for no limit.
RANDOM_FOREST_GRID = {"numTrees": [200, 500], "maxDepth": [5, 10, 20, 30], "minInstancesPerNode": [1, 5, 10],
                      "featureSubsetStrategy": ["sqrt", "log2"]}
BOOSTED_GRID = {"n_estimators": [100, 200], "max_depth": [3, 5], "learning_rate": [0.01, 0.05, 0.1], "subsample": [0.7, 0.9, 1.0],
                "colsample": [0.7, 0.9, 1.0], "reg_lambda": [1.0, 5.0, 10.0], "reg_alpha": [0.0, 0.1]}
MLP_GRID = {"hidden": [(32,), (64,), (64, 32), (128, 64)], "maxIter": [100, 200, 300]}
SEED = 42
MLLIB_ROWS = ROWS_PER_PART  # perceptrons and forests of fewer rows, one task's, are trained by MLlib itself


def class_counts(train: DataFrame, label: str) -> tuple[float, float]:
    """Rows and positive rows."""
    r = train.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("p")).first()
    return float(r["n"]), float(r["p"] or 0.0)


def weight_values(n: float, p: float, mode: str) -> tuple[float, float]:
    """Balanced weights n / (2 n_c) (sum to n) or positive weight n0 / n1, of classes 0 and 1."""
    neg = n - p
    if mode == "balanced" and p > 0 and neg > 0:
        return n / (2 * neg), n / (2 * p)
    if mode == "pos_ratio" and p > 0 and neg > 0:
        return 1.0, neg / p
    return 1.0, 1.0


def class_weights(label: str, n: float, p: float, mode: str):
    """M20 weights as a column."""
    zero, one = weight_values(n, p, mode)
    return F.lit(one) if zero == one else F.when(F.col(label) == 1, F.lit(one)).otherwise(F.lit(zero))


def make_estimator(spec: ModelSpec, n_features: int, n_train: float, label: str, weight: str | None):
    p = dict(spec.params)
    common = {"featuresCol": "features", "labelCol": label}
    if spec.kind == "logistic":
        return LogisticRegression(regParam=1.0 / max(n_train, 1.0), elasticNetParam=0.0, standardization=False,
                                  weightCol=weight, **common, **p)
    if spec.kind == "random_forest":
        return RandomForestClassifier(seed=SEED, weightCol=weight, **common, **p)
    if spec.kind == "mlp":
        hidden = list(p.pop("hidden", (64, 32)))
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], seed=SEED, solver="l-bfgs", **common, **p)
    raise ValueError(spec.kind)


def fit_transformed(x: DataFrame, prep, label: str, spec: ModelSpec, n: float, p: float, weights=None):
    """The estimator on rows that went through ``prep`` (its columns, ``features`` and the
    label); None where the ``n`` rows, ``p`` of them positive, are of one class.
    ``weights``: of a perceptron that ``fit_mlps`` has trained."""
    if p == 0 or p == n:
        return None
    if spec.kind == "mlp" and n > MLLIB_ROWS:
        if weights is None:
            weights = fit_mlps([(x, prep, n)], label, [(0, spec)])[0]
        if isinstance(weights, Exception):
            raise weights
        return mlp_model(prep, label, spec, weights)
    if spec.kind == "boosted":
        weight = (n - p) / p if spec.weighting == "pos_ratio" else 1.0
        return fit_boosted(x, prep.feature_names(), label, int(n), p / n, weight, seed=SEED, **spec.params)
    if spec.kind == "random_forest" and n > MLLIB_ROWS and set(spec.params) <= FOREST_PARAMS:
        return fit_forest(x, prep.feature_names(), label, int(n), weight_values(n, p, spec.weighting), seed=SEED, **spec.params)
    w = class_weights(label, n, p, spec.weighting)
    est = make_estimator(spec, len(prep.feature_names()), n, label, "_w" if spec.weighting != "none" else None)
    return est.fit(x.select(F.col(label).cast("double").alias(label), "features", w.alias("_w")))


def mlp_model(prep, label: str, spec: ModelSpec, weights=None):
    """MLlib's perceptron with these weights, or with the seed's first ones."""
    width = len(prep.feature_names())
    est = make_estimator(spec, width, 0.0, label, None).setMaxIter(0)  # no steps: two rows suffice
    if weights is not None:
        est = est.setInitialWeights(Vectors.dense(weights))
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    return est.fit(spark.createDataFrame([(float(k), Vectors.dense([0.0] * width)) for k in (0, 1)], [label, "features"]).coalesce(1))


def fit_mlps(parts: Sequence[tuple], label: str, wanted: Sequence[tuple[int, ModelSpec]]) -> list:
    """The weights of perceptrons of several settings, each on its part of ``parts`` (rows that went
    through a preprocessing, that preprocessing, number of rows), trained together.  Settings
    that make no network give the exception instead."""
    networks, firsts, out = [], {}, []
    for i, spec in wanted:
        try:
            est = make_estimator(spec, len(parts[i][1].feature_names()), 0.0, label, None)
            layers = tuple(est.getLayers())
            if layers not in firsts:
                firsts[layers] = mlp_model(parts[i][1], label, spec).weights.toArray()
            out.append(len(networks))
            networks.append((i, layers, firsts[layers], est.getMaxIter()))
        except Exception as exc:  # noqa: BLE001 - the other settings are trained
            out.append(exc)
    if not networks:
        return out
    trained = fit_perceptrons([(spread(x, int(n)), prep.feature_names()) for x, prep, n in parts], label, networks)
    return [k if isinstance(k, Exception) else trained[k] for k in out]


def score_transformed(x: DataFrame, model, keep: Sequence[str], constant: float = 0.0) -> DataFrame:
    """Probability of class 1 (M24: a constant for single-class training)."""
    if model is None:
        return x.select(*keep, F.lit(constant).alias("y_score"))
    if isinstance(model, (BoostedModel, ForestModel)):
        return model.score(x, keep)
    return model.transform(x).select(*keep, vector_to_array("probability")[1].alias("y_score"))


@dataclass
class FittedClassifier:
    prep: object
    model: object
    constant: float = 0.0

    def score(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        return score_transformed(self.prep.transform(df, keep=keep, vector_col="features"), self.model, keep, self.constant)


def fit_classifier(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, spec: ModelSpec) -> FittedClassifier:
    prep = fit_preprocessing(train, numeric, categorical, drop_first=False)
    n, p = class_counts(train, label)
    x = prep.transform(train, keep=[label], vector_col="features")
    return FittedClassifier(prep, fit_transformed(x, prep, label, spec, n, p), 1.0 if n and p == n else 0.0)


def evaluate_temporally(
    indexed: DataFrame,
    n: int,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    spec: ModelSpec,
    n_splits: int = 3,
    threshold: float = 0.5,
    time_col: str | None = "model_time",
    parallelism: int | None = None,
) -> dict:
    """Expanding-window folds.  A fold that fails, in fitting or in scoring, becomes
    a row with ``error`` and NULL metrics; the others stay.  ``warning`` tells of folds
    whose validation rows are of one class.  Folds are independent, so they run as
    concurrent Spark jobs (``parallelism``, default one thread per fold).
    Returns fold metrics, out-of-fold predictions and the A23 summary."""
    spark = indexed.sparkSession
    keep = [IDX, label] + ([time_col] if time_col else [])
    preds, errors = [], {}

    def one(fb):
        f = fb["fold"]
        train = indexed.filter(F.col(IDX) <= fb["train_end"])
        valid = indexed.filter((F.col(IDX) >= fb["valid_start"]) & (F.col(IDX) <= fb["valid_end"]))
        try:
            fc = fit_classifier(train, numeric, categorical, label, spec)
            # written here, so that a failure in scoring is this fold's own
            return f, cut_lineage(fc.score(valid, keep).withColumn("fold", F.lit(f))), None
        except Exception as exc:  # noqa: BLE001 - record and keep the other folds
            return f, None, f"{type(exc).__name__}: {exc}"

    folds = splits.expanding_folds(n, n_splits)
    with ThreadPoolExecutor(max_workers=max(1, parallelism or len(folds))) as pool:
        for f, pred, err in sorted(pool.map(one, folds), key=lambda t: t[0]):
            if err is None:
                preds.append(pred)
            else:
                errors[f] = err
    sizes = splits.fold_summary(indexed, n, n_splits, label)
    if preds:
        oof = preds[0]
        for p in preds[1:]:
            oof = oof.unionByName(p)
    else:  # all folds failed: no predictions, and every metric NULL
        oof = indexed.limit(0).select(*keep, F.lit(None).cast("double").alias("y_score"), F.lit(None).cast("int").alias("fold"))
    oof = oof.select(F.col(IDX), F.lit(spec.name).alias("model"), "fold", F.col(label).cast("int").alias("y_true"),
                     "y_score", (metrics.score_or_neg_inf("y_score") >= threshold).cast("int").alias("y_pred"),
                     *([time_col] if time_col else []))
    fold_metrics = sizes.join(metrics.binary_metrics(oof, "y_true", "y_score", threshold, group_cols=["fold"]), "fold", "left")
    present = F.concat(F.lit("Only one class present in y_true: ["), F.col("positive_rate").cast("int").cast("string"), F.lit("]."))
    fold_metrics = fold_metrics.withColumn("warning", F.when(F.col("one_class_fold"), present).when(~F.col("one_class_fold"), ""))
    err_df = spark.createDataFrame([(f, e) for f, e in errors.items()] or [(0, "")], "fold int, error string")
    fold_metrics = (fold_metrics.join(F.broadcast(err_df), "fold", "left")
                    .withColumn("error", F.coalesce(F.col("error"), F.lit("")))
                    .withColumn("model", F.lit(spec.name)))
    return {"fold_metrics": fold_metrics, "predictions": oof if preds else None, "summary": summarize_folds(fold_metrics)}


def summarize_folds(fold_metrics: DataFrame, ddof: int = 1) -> DataFrame:
    """Per model mean and std (ddof 1; 0 = population) of each metric, folds,
    failed folds; sorted by mean average precision descending."""
    std = F.stddev_samp if ddof == 1 else F.stddev_pop
    aggs = [F.count_distinct("fold").alias("folds")]
    for c in METRIC_COLS:
        aggs += [F.avg(c).alias(f"{c}_mean"), std(c).alias(f"{c}_std")]
    aggs.append(F.count_if(F.col("error") != "").alias("failed_folds"))
    return fold_metrics.groupBy("model").agg(*aggs).orderBy(F.col("average_precision_mean").desc_nulls_last(), "model")


def bounded_n_iter(grid: dict, n_iter: int) -> int:
    size = 1
    for v in grid.values():
        size *= len(v)
    return min(n_iter, size)


def sample_grid(grid: dict, n_iter: int, seed: int = SEED) -> list[dict]:
    """Seeded sample of distinct parameter combinations (no replacement)."""
    keys = list(grid)
    combos = list(itertools.product(*[grid[k] for k in keys]))
    rng = random.Random(seed)
    picked = rng.sample(combos, bounded_n_iter(grid, n_iter))
    return [dict(zip(keys, c)) for c in picked]


@dataclass
class PreparedFold:
    """A fold with its own fitted preprocessing applied once, for every candidate."""

    fold: int
    prep: object
    train: DataFrame
    valid: DataFrame
    n: float
    p: float


def prepare_folds(indexed: DataFrame, n: int, numeric, categorical, label: str, n_splits: int = 3) -> list[PreparedFold]:
    """Preprocessing is fitted and the vectors are assembled and written once per fold."""

    def one(fb) -> PreparedFold:
        train = indexed.filter(F.col(IDX) <= fb["train_end"])
        valid = indexed.filter((F.col(IDX) >= fb["valid_start"]) & (F.col(IDX) <= fb["valid_end"]))
        prep = fit_preprocessing(train, numeric, categorical, drop_first=False)
        made = [cut_lineage(prep.transform(d, keep=[IDX, label], vector_col="features")) for d in (train, valid)]
        return PreparedFold(fb["fold"], prep, *made, *class_counts(made[0], label))

    folds = splits.expanding_folds(n, n_splits)
    with ThreadPoolExecutor(max_workers=len(folds)) as pool:
        return list(pool.map(one, folds))


def forest_setting(params: dict) -> bool:
    """What ``forest`` grows by itself; anything else is MLlib's, or its error."""
    try:
        subset_size(params.get("featureSubsetStrategy", "auto"), 1, 2)
        return set(params) <= FOREST_PARAMS and params.get("numTrees", 20) >= 1 and params.get("minInstancesPerNode", 1) >= 1 and 0 <= params.get("maxDepth", 5) <= 30
    except (TypeError, ValueError, AttributeError):
        return False


def forest_candidates(folds: Sequence[PreparedFold], label: str, specs: Sequence[ModelSpec]) -> DataFrame:
    """Validation scores (``label``, ``candidate``, ``y_score``, ``fold``) of forests of several settings,
    a fold's grown together (``forest.fit_forests``) on rows of any number, folds as concurrent jobs."""

    def one(f: PreparedFold) -> DataFrame:
        if f.p == 0 or f.p == f.n:
            numbers = F.explode(F.sequence(F.lit(0), F.lit(len(specs) - 1)))
            scored = f.valid.select(label, numbers.alias("candidate"), F.lit(float(f.p == f.n and f.n > 0)).alias("y_score"))
        else:
            models = fit_forests(f.train, f.prep.feature_names(), label, int(f.n), [s.params for s in specs], weight_values(f.n, f.p, specs[0].weighting), SEED)
            scored = score_forests(models, f.valid, [label])
        return scored.withColumn("fold", F.lit(f.fold))

    with ThreadPoolExecutor(max_workers=len(folds)) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, folds))


def random_search(
    folds: Sequence[PreparedFold], label: str, spec: ModelSpec, grid: dict, n_iter: int = 12, parallelism: int = 4,
) -> tuple[dict, DataFrame]:
    """Candidates x expanding folds scored by average precision; best = highest
    mean (ties -> earlier candidate).  A candidate that fails has no score and an
    ``error``; if all fail, so does the search.  Returns (best params, cv results)."""
    spark = folds[0].train.sparkSession
    picked = sample_grid(grid, n_iter)
    specs = [ModelSpec(spec.name, spec.kind, {**spec.params, **params}, spec.weighting) for params in picked]
    weights: dict = {}
    both = [k for k, f in enumerate(folds) if 0 < f.p < f.n and f.n > MLLIB_ROWS]
    if spec.kind == "mlp" and both:  # perceptrons of all candidates and folds share their passes
        wanted = [(i, k) for i in range(len(specs)) for k in both]
        parts = [(folds[k].train, folds[k].prep, folds[k].n) for k in both]
        weights = dict(zip(wanted, fit_mlps(parts, label, [(both.index(k), specs[i]) for i, k in wanted])))

    def run(i_params):
        i, params = i_params
        try:
            scored = None
            for k, f in enumerate(folds):
                model = fit_transformed(f.train, f.prep, label, specs[i], f.n, f.p, weights.get((i, k)))
                part = score_transformed(f.valid, model, [label], 1.0 if f.p == f.n else 0.0).withColumn("fold", F.lit(f.fold))
                scored = part if scored is None else scored.unionByName(part)
            found = metrics.ranking_metrics(scored, label, "y_score", group_cols=["fold"])
            r = found.agg(F.avg("average_precision").alias("m"), F.stddev_pop("average_precision").alias("s")).first()
            return i, params, r["m"], r["s"], ""
        except Exception as exc:  # noqa: BLE001 - record and keep the other candidates
            return i, params, None, None, f"{type(exc).__name__}: {exc}"

    together = {}
    if spec.kind == "random_forest":
        alike = [i for i, s in enumerate(specs) if forest_setting(s.params)]
        if alike:
            try:
                found = metrics.ranking_metrics(forest_candidates(folds, label, [specs[i] for i in alike]), label, "y_score", group_cols=["candidate", "fold"])
                means = found.groupBy("candidate").agg(F.avg("average_precision").alias("m"), F.stddev_pop("average_precision").alias("s")).collect()
                together = {alike[r["candidate"]]: (alike[r["candidate"]], picked[alike[r["candidate"]]], r["m"], r["s"], "") for r in means}
            except Exception as exc:  # noqa: BLE001 - of all of them
                together = {i: (i, picked[i], None, None, f"{type(exc).__name__}: {exc}") for i in alike}
    if spec.kind == "boosted":  # a fit is a task or a few: as many at a time as cores take
        parallelism = max(parallelism, spark.sparkContext.defaultParallelism)
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        results = list(pool.map(lambda i_params: together.get(i_params[0]) or run(i_params), enumerate(picked)))
    if all(r[2] is None for r in results):
        raise RuntimeError(f"every candidate failed, the first with {results[0][4]}")
    rows = [(spec.name, i, str(sorted(p.items())), m, s, e) for i, p, m, s, e in results]
    cv = spark.createDataFrame(rows, "model string, candidate int, params string, mean_test_score double, std_test_score double, error string")
    best = max(results, key=lambda t: (t[2] if t[2] is not None else float("-inf"), -t[0]))
    return best[1], cv


def feature_ranking(spark: SparkSession, fc: FittedClassifier, top: int = 15) -> DataFrame:
    """Tree importances or |coefficient| per feature, top ``top``."""
    names = fc.prep.feature_names()
    m = fc.model
    if isinstance(m, (BoostedModel, ForestModel)):
        vals, kind = m.importances().tolist(), "importance"
    elif hasattr(m, "featureImportances"):
        vals = m.featureImportances.toArray().tolist()
        kind = "importance"
    elif hasattr(m, "coefficients"):
        vals = m.coefficients.toArray().tolist()
        kind = "coefficient"
    else:
        return spark.createDataFrame([], "feature string, value double, abs_value double, kind string")
    df = spark.createDataFrame([(f, float(v), abs(float(v)), kind) for f, v in zip(names, vals)],
                               "feature string, value double, abs_value double, kind string")
    return df.orderBy(F.col("abs_value").desc(), "feature").limit(top)
