"""Regression study over a time-ordered frame:
lag + binning -> missingness filter -> chronological split -> Cook filter ->
OLS suite (coefficients, VIF, residual diagnostics) -> LASSO / Ridge with
expanding-window CV -> comparison table.

All heavy work is aggregations: moments per CV block (one grouped aggregation),
fold parameters (one aggregation), test Gram (one aggregation), MAE (one
aggregation).  The driver only solves p x p systems.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce
from operator import add, or_

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftkit.functions.scalar import epoch_micros, two_class_bin
from driftkit.operators import causal, prune, regress, splits
from driftkit.operators.gram import Moments, merged
from driftkit.operators.regress import LinearDesign, discover_design
from driftkit.operators.scan import prefix_sums
from driftkit.session import stored
from driftkit.sources.tables import read_table

# The penalty grids of the source study.
LASSO_GRID = np.logspace(-2, 2, 20)
RIDGE_GRID = np.logspace(-4, 4, 20)
PATH_GRID = np.logspace(-6, -1, 80)


@dataclass
class StudyConfig:
    numeric: Sequence[str] = ("y_prev", "l_quantity", "l_discount", "l_tax")
    categorical: Sequence[str] = ("l_returnflag", "discount_class")
    target: str = "y"
    time_col: str = "model_time"
    tie_cols: Sequence[str] = ("l_orderkey", "l_linenumber")
    train_ratio: float = 0.8
    missing_threshold: float = 0.30
    cv_splits: int = 5
    cooks_multiplier: float = 4.0


def regression_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``regress`` view: target y = extendedprice in thousands (P18 unit change),
    W10 lag y_prev per supplier in (shipdate, order, line) order, F10 discount class."""
    li = read_table(spark, sf_dir, "lineitem")
    base = li.select(
        "l_orderkey", "l_linenumber", "l_suppkey", F.col("l_shipdate").alias("model_time"),
        (F.col("l_extendedprice") / 1000.0).alias("y"), "l_quantity", "l_discount", "l_tax", "l_returnflag",
    )
    lagged = causal.autoregressive_lag(base, ["l_suppkey"], "model_time", "y", suffix="_prev",
                                       block_us=400 * 86_400_000_000, tie_cols=["l_orderkey", "l_linenumber"])
    return lagged.withColumn("discount_class", two_class_bin("l_discount", 0.05, "low_discount", "high_discount"))


def prepare(df: DataFrame, cfg: StudyConfig) -> dict:
    """P9 on the whole frame (as the source workflow does) + T6 split."""
    ids = ["l_orderkey", "l_linenumber", cfg.time_col, cfg.target, *cfg.categorical]
    # many passes follow (split, fits, CV), each over a few columns: stored once in the shared folder
    base = stored(prune.select_available(df, ids, cfg.numeric, cfg.target))
    df2, info = prune.drop_high_missingness(base, cfg.missing_threshold, keep=ids)
    numeric = [c for c in cfg.numeric if c in df2.columns]
    train, test, cutoff = splits.chronological_split(df2, cfg.time_col, cfg.train_ratio, cfg.tie_cols)
    return {"train": train, "test": test, "cutoff": cutoff, "numeric": numeric, "dropped": info["dropped"]}


@dataclass
class FittedLinear:
    design: LinearDesign
    params: regress.FoldParams
    transform: np.ndarray
    names: list
    info: dict
    gram: object
    fit: regress.LinearFit

    def z_cols(self):
        return self.design.z_columns(self.params, self.info)

    def predict_expr(self):
        """Prediction as ONE expression over the original columns."""
        e = F.lit(float(self.fit.intercept))
        for zc, w in zip(self.z_cols(), self.fit.coef):
            if w != 0.0:
                e = e + F.lit(float(w)) * zc
        return e


def fit_full(train: DataFrame, numeric, cfg: StudyConfig, solver=regress.ols) -> FittedLinear:
    d = discover_design(train, numeric, cfg.categorical, cfg.target)
    fp = d.fold_params(train, {"all": F.lit(True)})["all"]
    u = d.moments_u(train)
    t, names, info = d.transform_matrix(fp, u)
    g = d.to_gram(t, u, names)
    return FittedLinear(d, fp, t, names, info, g, solver(g))


def evaluate(fl: FittedLinear, test_u: Moments, mae: float, model: str, extra: dict | None = None) -> dict:
    """R^2 train/test and RMSE from moments (``test_u``: those of u over the test rows)."""
    gt = fl.design.to_gram(fl.transform, test_u, fl.names)
    out = {"model": model, "R2_train": regress.r2(fl.gram, fl.fit), "R2_test": regress.r2(gt, fl.fit),
           "RMSE_test": regress.rmse(gt, fl.fit), "MAE_test": mae}
    out.update(extra or {})
    return out


def mean_absolute_errors(test: DataFrame, models: Sequence[FittedLinear]) -> list[float]:
    """MAE of every model in one pass over the test rows."""
    y = F.col(models[0].design.target)
    r = test.agg(*[F.avg(F.abs(y - m.predict_expr())).alias(f"m{i}") for i, m in enumerate(models)]).first()
    return [float(v) for v in r]


def cooks_filter(train: DataFrame, fl: FittedLinear, cfg: StudyConfig) -> tuple[DataFrame, dict]:
    """M9: Cook's D of the baseline OLS (with constant) per row, keep D <= m / N."""
    limit = cfg.cooks_multiplier / fl.gram.n
    scored = regress.leverage_and_cooks(train.withColumn("y_hat", fl.predict_expr()), fl.gram, fl.fit, cfg.target, columns=fl.z_cols())
    kept = scored.filter(F.col("cooks_d") <= F.lit(limit)).select(*train.columns)
    return kept, {"fit": fl, "threshold": limit, "n": fl.gram.n, "scored": scored}


def cv_blocks(train: DataFrame, cfg: StudyConfig):
    """W12 + T8: the validation block (0 = train-only head) of each row by its place in time
    order.  Rows per time tell the times within which a block begins; only the rows of
    those times are numbered, all others have their block from their time alone.  Every
    row of ``train`` has a time (the split leaves others out)."""
    time, k = epoch_micros(cfg.time_col), cfg.cv_splits
    per_time = prefix_sums(train.groupBy(time.alias("_t")).agg(F.count(F.lit(1)).alias("_w")), [F.col("_t")], ["_w"])
    n = per_time.agg(F.max("_w_cum")).first()[0] or 0
    starts = [f["valid_start"] for f in splits.expanding_folds(n, k)]
    holds = reduce(or_, [F.lit(s).between(F.col("_w_cum") - F.col("_w"), F.col("_w_cum") - 1) for s in starts])
    edges = sorted((r["_t"], r["_w_cum"], r["_w"]) for r in per_time.where(holds).collect())
    at_edge = time.isin([t for t, _, _ in edges])
    begun = [next(t for t, last, _ in edges if s < last) for s in starts]
    inside = train.where(~at_edge).withColumn("_blk", reduce(add, [(time > F.lit(t)).cast("int") for t in begun]))
    index, numbered = F.col("row_index"), 0
    for t, last, rows in edges:  # the rows before those of this time, less those numbered before them
        index = index + F.when(time == F.lit(t), F.lit(last - rows - numbered)).otherwise(F.lit(0))
        numbered += rows
    placed = splits.row_index(train.where(at_edge), [cfg.time_col, *cfg.tie_cols]).withColumn("row_index", index)
    placed = stored(placed.withColumn("_blk", F.coalesce(splits.fold_column(n, k), F.lit(0))).drop("row_index"))
    return inside.unionByName(placed), n


@dataclass
class FoldStatistics:
    """What every fold x alpha fit needs: moments of u per block and the training parameters per fold."""
    design: LinearDesign
    blocks: dict
    params: dict  # per fold; one more stands for all rows

    def full(self, solver=regress.ols) -> FittedLinear:
        """:func:`fit_full` of all rows, from the blocks' moments."""
        d, fp = self.design, self.params[max(self.params)]
        u = merged((self.blocks[b] for b in sorted(self.blocks)), len(d.u_names()))
        t, names, info = d.transform_matrix(fp, u)
        g = d.to_gram(t, u, names)
        return FittedLinear(d, fp, t, names, info, g, solver(g))


def fold_statistics(train: DataFrame, numeric, cfg: StudyConfig) -> FoldStatistics:
    """One pass for the block moments and one aggregation for medians, modes and
    categories; lasso and ridge share them."""
    idx, _ = cv_blocks(train, cfg)
    d = discover_design(idx, numeric, cfg.categorical, cfg.target)
    masks = {f: F.col("_blk") < f for f in range(1, cfg.cv_splits + 2)}
    return FoldStatistics(d, d.moments_u(idx, F.col("_blk")), d.fold_params(idx, masks, block_col="_blk"))


def regularized_cv(stats: FoldStatistics, full: FittedLinear, cfg: StudyConfig, kind: str, grid) -> dict:
    """M13 + M15: expanding-window CV over ``grid`` with R^2 scoring, p x p algebra only;
    refit on the best alpha from the Gram of the ``full`` training rows."""
    d, blocks, params = stats.design, stats.blocks, stats.params
    k = cfg.cv_splits
    size = len(d.u_names())
    solver = regress.lasso if kind == "lasso" else regress.ridge
    rows = []
    for f in range(1, k + 1):
        train_u = merged((blocks[b] for b in range(f) if b in blocks), size)
        t, names, info = d.transform_matrix(params[f], train_u)
        g_tr = d.to_gram(t, train_u, names)
        g_va = d.to_gram(t, blocks.get(f, Moments.zero(size)), names)
        warm = None
        for a in grid:
            fit = solver(g_tr, float(a)) if kind == "ridge" else solver(g_tr, float(a), warm=warm)
            warm = fit.coef if kind == "lasso" else None
            rows.append({"alpha": float(a), "fold": f, "test_score": regress.r2(g_va, fit), "train_score": regress.r2(g_tr, fit)})
    curve = {}
    for r in rows:
        curve.setdefault(r["alpha"], []).append(r["test_score"])
    summary = [{"alpha": a, "mean_test_score": float(np.mean(v)), "std_test_score": float(np.std(v))} for a, v in curve.items()]
    order = sorted(range(len(summary)), key=lambda i: (-summary[i]["mean_test_score"], i))
    rank = 1
    for pos, i in enumerate(order):
        if pos > 0 and summary[i]["mean_test_score"] < summary[order[pos - 1]]["mean_test_score"]:
            rank = pos + 1
        summary[i]["rank_test_score"] = rank
    best = summary[order[0]]["alpha"]
    return {"folds": rows, "curve": summary, "best_alpha": best, "fitted": replace(full, fit=solver(full.gram, best))}


def lasso_path(fl: FittedLinear, grid=PATH_GRID) -> list[tuple]:
    """(alpha, feature, coef) on the full training Gram, warm-started along the grid."""
    out, warm = [], None
    for a in sorted(grid):
        fit = regress.lasso(fl.gram, float(a), warm=warm)
        warm = fit.coef
        out += [(float(a), f, float(w)) for f, w in zip(fit.features, fit.coef)]
    return out


class Study:
    """The study's pieces, each computed when first asked for and once per study
    (a study is built per call, nothing is kept between calls)."""

    def __init__(self, frame: DataFrame, cfg: StudyConfig | None = None):
        self.frame, self.cfg = frame, cfg or StudyConfig()

    def __getitem__(self, piece: str):
        return getattr(self, piece)

    @cached_property
    def prep(self) -> dict:
        return prepare(self.frame, self.cfg)

    @cached_property
    def base(self) -> FittedLinear:
        return fit_full(self.prep["train"], self.prep["numeric"], self.cfg)

    @cached_property
    def _filtered(self) -> tuple[DataFrame, dict]:
        kept, info = cooks_filter(self.prep["train"], self.base, self.cfg)
        return stored(kept), info

    @property
    def clean(self) -> DataFrame:
        return self._filtered[0]

    @property
    def cooks(self) -> dict:
        return self._filtered[1]

    @cached_property
    def ols(self) -> FittedLinear:
        """From the folds' moments, where those are there already."""
        return self.folds.full() if "folds" in self.__dict__ else fit_full(self.clean, self.prep["numeric"], self.cfg)

    @cached_property
    def folds(self) -> FoldStatistics:
        return fold_statistics(self.clean, self.prep["numeric"], self.cfg)

    @cached_property
    def lasso(self) -> dict:
        return regularized_cv(self.folds, self.ols, self.cfg, "lasso", LASSO_GRID)

    @cached_property
    def ridge(self) -> dict:
        return regularized_cv(self.folds, self.ols, self.cfg, "ridge", RIDGE_GRID)

    @cached_property
    def metrics(self) -> list[dict]:
        """M17 of the four models; the three on the cleaned rows share one design and test Gram."""
        test = self.prep["test"]
        lasso, ridge = self.lasso["fitted"], self.ridge["fitted"]  # first: least squares come with the folds
        models = [self.base, self.ols, lasso, ridge]
        mae = mean_absolute_errors(test, models)
        shared = self.ols.design.moments_u(test)
        grams = [self.base.design.moments_u(test), shared, shared, shared]
        extra = [None, None]
        for cv in (self.lasso, self.ridge):
            coef = cv["fitted"].fit.coef
            extra.append({"alpha": cv["best_alpha"], "n_features_selected": int(np.sum(coef != 0)), "n_features_total": len(coef)})
        return [evaluate(m, g, e, n, x) for m, g, e, n, x in zip(models, grams, mae, ("Base OLS", "OLS", "LASSO", "Ridge"), extra)]


def run(spark: SparkSession, sf_dir: str, cfg: StudyConfig | None = None) -> Study:
    return Study(regression_frame(spark, sf_dir), cfg)


def comparison_table(spark: SparkSession, metric_rows: Sequence[dict]) -> DataFrame:
    """Fixed leading columns, extras after; missing extras NULL (union by name)."""
    lead = ["model", "R2_train", "R2_test", "RMSE_test", "MAE_test"]
    extra = []
    for r in metric_rows:
        extra += [k for k in r if k not in lead and k not in extra]
    schema = "model string, R2_train double, R2_test double, RMSE_test double, MAE_test double"
    frames = []
    for r in metric_rows:
        cols = lead + [k for k in extra if k in r]
        types = {"alpha": "double", "n_features_selected": "int", "n_features_total": "int"}
        sch = schema + "".join(f", {k} {types.get(k, 'double')}" for k in cols[5:])
        frames.append(spark.createDataFrame([tuple(r[c] for c in cols)], sch))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
