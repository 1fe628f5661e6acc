"""Boosted trees, density clusters, fold isolation and checked joins against brute force."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftkit.operators import boosting, classify, cluster, dbscan as dbs, reshape, splits
from driftkit.operators.boosting import fit_boosted


def grow(x, y, margin, weight, depth, rate, l1, l2, least=1.0):
    """One exact tree: every cut of every feature is tried."""
    p = 1 / (1 + np.exp(-margin))
    w = np.where(y == 1, weight, 1.0)
    g, h = w * (p - y), w * p * (1 - p)
    shrink = lambda v: np.sign(v) * max(abs(v) - l1, 0)
    worth = lambda a, b: shrink(a) ** 2 / (b + l2)

    def split(rows, left):
        best = None
        if left:
            for f in range(x.shape[1]):
                for cut in np.unique(x[rows, f])[1:]:
                    low, high = rows[x[rows, f] < cut], rows[x[rows, f] >= cut]
                    if h[low].sum() < least or h[high].sum() < least:
                        continue
                    gain = worth(g[low].sum(), h[low].sum()) + worth(g[high].sum(), h[high].sum()) - worth(g[rows].sum(), h[rows].sum())
                    if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                        best = gain, low, high
        if best is None:
            out[rows] = -rate * shrink(g[rows].sum()) / (h[rows].sum() + l2)
        else:
            split(best[1], left - 1)
            split(best[2], left - 1)

    out = np.zeros(len(y))
    split(np.arange(len(y)), depth)
    return out


@pytest.fixture(scope="module")
def two_classes(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(400, 3)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=400) > 0.7).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "row_index long, a double, b double, c double, y int")
    return df, x, y


@pytest.mark.parametrize("rounds, depth, l1, l2", [(1, 1, 0.0, 1.0), (2, 1, 0.0, 1.0), (2, 3, 0.0, 1.0), (12, 2, 0.5, 5.0)])
def test_boosted_trees_against_brute_force(spark, two_classes, monkeypatch, rounds, depth, l1, l2):
    """Several blocks and merging tasks; margins written anew between the trees."""
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 40)
    monkeypatch.setattr(boosting, "MERGERS", 3)
    monkeypatch.setattr(boosting, "MARGINS_EVERY", 5)
    df, x, y = two_classes
    rate, weight = y.mean(), (1 - y).sum() / y.sum()
    model = fit_boosted(df, ["a", "b", "c"], "y", 400, rate, weight, n_estimators=rounds, max_depth=depth, learning_rate=0.3, subsample=1.0, colsample=1.0, reg_alpha=l1, reg_lambda=l2, max_bin=1000)
    margin = np.full(400, np.log(rate / (1 - rate)))
    for _ in range(rounds):
        margin = margin + grow(x, y, margin, weight, depth, 0.3, l1, l2)
    got = {r.row_index: r.y_score for r in model.score(df, ["row_index"]).collect()}
    assert [got[i] for i in range(400)] == pytest.approx(list(1 / (1 + np.exp(-margin))), abs=1e-9)


def test_boosting_samples_rows_and_features(spark, two_classes):
    df, x, y = two_classes
    fit = lambda **o: fit_boosted(df, ["a", "b", "c"], "y", 400, y.mean(), n_estimators=8, **o)
    one, again, other = fit(), fit(), fit(seed=7)
    assert all(np.array_equal(a.value, b.value) for a, b in zip(one.trees, again.trees))
    assert not all(np.array_equal(a.value, b.value) for a, b in zip(one.trees, other.trees))
    assert len({tuple(t.feature[t.feature >= 0]) for t in fit(colsample=0.34, max_depth=1).trees}) > 1
    assert one.importances().sum() == pytest.approx(1.0)
    odd = df.limit(3).withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(float("nan")))
    assert all(0 < r.y_score < 1 for r in one.score(odd, ["row_index"]).collect())
    with pytest.raises(ValueError):
        fit_boosted(df, [], "y", 400, 0.5)


def test_boosted_folds_learn(spark, two_classes):
    df, _, _ = two_classes
    spec = classify.ModelSpec("b", "boosted", {"n_estimators": 15, "learning_rate": 0.3}, "pos_ratio")
    res = classify.evaluate_temporally(df, 400, ["a", "b", "c"], [], "y", spec, 3, time_col=None)
    assert all(r.roc_auc > 0.8 and r.error == "" and r.warning == "" for r in res["fold_metrics"].collect())


def test_a_fold_that_fails_in_scoring_is_a_row(spark, two_classes):
    df, _, _ = two_classes
    bad = df.withColumn("a", F.when(F.col("row_index") == 390, F.raise_error(F.lit("broken reading")).cast("double")).otherwise(F.col("a")))
    res = classify.evaluate_temporally(bad, 400, ["a", "b"], [], "y", classify.LOGISTIC, 3, time_col=None)
    rows = {r.fold: r for r in res["fold_metrics"].collect()}
    assert rows[1].error == rows[2].error == "" and "broken reading" in rows[3].error
    for c in ("average_precision", "roc_auc", "tn", "fp", "fn", "tp", "support", "positive_rate", "f1", "precision", "recall", "balanced_accuracy"):
        assert rows[3][c] is None and rows[1][c] is not None
    assert {r.fold for r in res["predictions"].select("fold").distinct().collect()} == {1, 2}
    s = res["summary"].first()
    assert (s.folds, s.failed_folds) == (3, 1)
    none = classify.evaluate_temporally(df.withColumn("a", F.raise_error(F.lit("all broken")).cast("double")), 400, ["a"], [], "y", classify.LOGISTIC, 3, time_col=None)
    assert none["predictions"] is None and all(r.tp is None and "all broken" in r.error for r in none["fold_metrics"].collect())


def test_one_class_folds_warn(spark, two_classes):
    df, _, _ = two_classes
    late = df.withColumn("y", F.when(F.col("row_index") >= 300, 0).otherwise(F.col("y")))
    rows = {r.fold: r for r in classify.evaluate_temporally(late, 400, ["a"], [], "y", classify.LOGISTIC, 3, time_col=None)["fold_metrics"].collect()}
    assert rows[3].warning == "Only one class present in y_true: [0]." and rows[3].roc_auc is None and rows[1].warning == ""


def brute_dbscan(points, eps, least):
    """Exact DBSCAN; border points go to the nearest core point."""
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    near = apart <= eps * (1 + 1e-9)
    core = near.sum(axis=1) >= least
    label, n = np.full(len(points), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core):
                    if label[j] < 0:
                        label[j] = n
                        todo.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        at = np.flatnonzero(near[i] & core)
        if len(at):
            label[i] = label[at[np.argmin(apart[i, at])]]
    return label


@pytest.mark.parametrize("d, rho", [(2, 0.1), (2, 0.5), (3, 0.25)])
def test_dbscan_equals_exact_on_the_moved_points(spark, d, rho):
    rng = np.random.default_rng(d)
    blobs = [rng.normal(size=(120, d)) * 0.25 + c for c in rng.uniform(-4, 4, (4, d))]
    bridge = np.linspace(-4, 4, 40)[:, None] * np.ones(d)
    pts = np.concatenate([*blobs, bridge, rng.uniform(-6, 6, (60, d)), np.repeat(rng.uniform(-6, 6, (1, d)), 30, axis=0)])
    eps, least = 0.45, 7
    cols = [f"x{i}" for i in range(d)]
    rows = [(i, *map(float, p)) for i, p in enumerate(pts)] + [(9000, None, *[0.0] * (d - 1)), (9001, float("nan"), *[0.0] * (d - 1))]
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in cols))
    got = {r.i: r.cluster for r in dbs.dbscan(df, cols, eps, least, rho).collect()}
    side = eps / np.sqrt(d) / round(1 / rho)
    want = brute_dbscan(np.floor(pts / side) * side, eps, least)
    assert len(got) == len(rows) and got[9000] == got[9001] == -1
    moved = [got[i] for i in range(len(pts))]
    assert [m < 0 for m in moved] == [w < 0 for w in want.tolist()] and len(set(want.tolist())) > 3
    core = brute_core(np.floor(pts / side) * side, eps, least)
    assert len({(m, w) for m, w, c in zip(moved, want.tolist(), core) if c}) == len({w for w, c in zip(want.tolist(), core) if c})


def brute_core(points, eps, least):
    return (np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2)) <= eps * (1 + 1e-9)).sum(axis=1) >= least


def test_dense_cells_cost_sub_cells_only(spark):
    """A third of a million points in one place are one row after the first step."""
    df = spark.range(300_000).selectExpr("id", "0.001 * (id % 7) AS a", "0.0 AS b").unionByName(spark.range(3).selectExpr("id + 1000000 AS id", "50.0 + id * 10 AS a", "1.0 AS b"))
    got = {r.cluster: r["count"] for r in dbs.dbscan(df, ["a", "b"], 0.5, 5).groupBy("cluster").count().collect()}
    assert got == {0: 300_000, -1: 3}
    assert dbs.dbscan(df.limit(0), ["a", "b"], 0.5, 5).count() == 0


def test_duplicate_keys_fail_the_join_in_the_plan(spark):
    left = spark.range(20).selectExpr("id % 4 AS g", "id AS v")
    right = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (None, 1.0)], "g long, e double")
    joined = reshape.join_many_to_one(left, right, ["g"])
    assert joined.count() == 20 and joined.where("e IS NULL").count() == 5
    with pytest.raises(PySparkException, match="duplicate key"):
        reshape.join_many_to_one(left, right.union(right.limit(1)), ["g"]).collect()


def test_duplicate_environment_key_fails_the_snapshot(spark):
    from driftkit.plans import telemetry
    from driftkit.plans.q_telemetry import node_cfg
    from driftkit.sources.tables import readings

    cfg = node_cfg()
    feed = readings(spark, "/root/testdata/sf0.001", hourly=True)
    env = telemetry.environment_features(feed, cfg)
    plan = telemetry.node_snapshot(feed, env, cfg)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 3  # pivot, rolling, previous value: none for the check
    with pytest.raises(PySparkException, match="duplicate key"):
        telemetry.node_snapshot(feed, env.unionByName(env.limit(1)), cfg).count()


def test_entity_profile_of_a_hot_and_a_null_entity(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 10 == 0 else 0 if i % 2 else i % 5, float(v) if i % 7 else None, int(i % 3 == 0), float(i)) for i, v in enumerate(rng.normal(size=600))]
    df = spark.createDataFrame(rows, "e int, v double, y int, lag double").repartition(6)
    got = {r.e: r for r in cluster.entity_profile(df, ["e"], "v", "y", "lag").collect()}
    assert set(got) == {r[0] for r in rows}
    for e, r in got.items():
        v = np.array([x[1] for x in rows if x[0] == e and x[1] is not None])
        assert (r.n, r.median) == (len(v), pytest.approx(np.median(v))) and r.iqr == pytest.approx(np.subtract(*np.quantile(v, [0.75, 0.25])))
        assert r.lag_median == pytest.approx(np.median([x[3] for x in rows if x[0] == e]))


def test_positional_split(spark):
    idx = spark.range(10).withColumnRenamed("id", "row_index")
    train, test = splits.positional_split(idx, 10, 0.75)
    assert (train.count(), test.count(), test.agg(F.min("row_index")).first()[0]) == (7, 3, 7)


def test_models_are_tuned_evaluated_and_written(spark, two_classes, tmp_path, monkeypatch):
    """Best parameters by the search, own settings where it fails, every artefact read back."""
    from driftkit.plans import fault_study as fs

    monkeypatch.setattr(fs, "TARGET", "y")
    df, _, _ = two_classes
    boosted = classify.ModelSpec("Gradient Boosted Trees", "boosted", {"n_estimators": 5, "learning_rate": 0.3}, "pos_ratio")
    specs = [classify.LOGISTIC, boosted, classify.ModelSpec("MLP", "mlp", {"hidden": (4,), "maxIter": 20}, "none")]
    grids = {boosted.name: {"max_depth": [1, 3], "n_estimators": [5]}, "MLP": {"hidden": ["no layers"]}}
    timed = df.withColumn("model_time", F.col("row_index"))
    res = fs.run_models(timed, 400, ["a", "b", "c"], [], specs, tune_iter=4, grids=grids, out_dir=str(tmp_path))
    assert res["best_params"]["Gradient Boosted Trees"] == {"max_depth": 3, "n_estimators": 5}
    assert "error" in res["best_params"]["MLP"] and res["best_params"]["Logistic Regression"] == {"note": "not tuned"}
    cv = {r.params: r.mean_test_score for r in res["tuning"].collect()}
    assert len(cv) == 2
    direct = classify.evaluate_temporally(timed, 400, ["a", "b", "c"], [], "y", classify.ModelSpec("x", "boosted", {**boosted.params, "max_depth": 3}, "pos_ratio"), 3)
    assert direct["summary"].first().average_precision_mean == pytest.approx(max(cv.values()))
    summary = spark.read.option("header", True).csv(f"{tmp_path}/metrics_summary")
    assert {r.model for r in summary.collect()} == {s.name for s in specs}
    assert spark.read.parquet(f"{tmp_path}/metrics_fold_by_fold").count() == 9
    assert spark.read.parquet(f"{tmp_path}/out_of_fold_predictions").count() == 900
    one = f"{tmp_path}/Gradient_Boosted_Trees"
    assert spark.read.option("header", True).csv(f"{one}/tuning_results").count() == 2
    import json

    assert json.loads(spark.read.text(f"{one}/best_params").first()[0]) == {"max_depth": 3, "n_estimators": 5}


def test_the_driver_sees_cuts_not_sums(spark, two_classes, monkeypatch):
    """Per level and feature a cut a node comes back, and a level has no more tasks than cores; trees stay."""
    df, _, y = two_classes
    fit = lambda: fit_boosted(df, ["a", "b", "c"], "y", 400, y.mean(), n_estimators=3, max_depth=2, subsample=0.8, max_bin=1000)
    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 10)
    returned, tasks, collect, coalesce = [], [], type(df).collect, type(df).coalesce
    monkeypatch.setattr(type(df), "collect", lambda self: returned.append(collect(self)) or returned[-1])
    monkeypatch.setattr(type(df), "coalesce", lambda self, n: tasks.append(n) or coalesce(self, n))
    few = fit()
    assert max(tasks) <= spark.sparkContext.defaultParallelism < 40
    assert max(len(r) for r in returned) <= 2 * 3 and not any(isinstance(v, (bytes, bytearray)) for rows in returned for r in rows for v in r)
    monkeypatch.setattr(type(df), "coalesce", lambda self, n: self)
    for a, b in zip(few.trees, fit().trees):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and a.value == pytest.approx(b.value)


def test_perceptrons_are_mllibs_in_fewer_jobs(spark, two_classes, monkeypatch):
    """Weights of MLlib's own training, for networks of two folds trained together in one job a step."""
    from driftkit.operators import perceptron
    from driftkit.operators.preprocess import fit_preprocessing

    df, _, _ = two_classes
    parts, direct = [], []
    specs = [classify.ModelSpec("MLP", "mlp", {"hidden": h, "maxIter": 12}, "none") for h in ((4,), (5, 3))]
    for rows in (200, 330):
        train = df.filter(F.col("row_index") < rows).coalesce(1).sortWithinPartitions("row_index")
        prep = fit_preprocessing(train, ["a", "b", "c"], [], drop_first=False)
        x = prep.transform(train, keep=["y"], vector_col="features")
        parts.append((x, prep, rows))
        direct += [classify.make_estimator(s, 3, rows, "y", None).fit(x).weights.toArray() for s in specs]
    passes, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: passes.append(self.columns) or collect(self))
    got = classify.fit_mlps(parts, "y", [(i, s) for i in (0, 1) for s in [*specs, classify.ModelSpec("MLP", "mlp", {"hidden": "no layers"}, "none")]])
    assert isinstance(got[2], Exception) and isinstance(got[5], Exception)
    for a, b in zip([got[i] for i in (0, 1, 3, 4)], direct):
        assert a == pytest.approx(b, rel=1e-6, abs=1e-8)
    assert passes.count(["network", "sums"]) < 25
    assert perceptron.spread(df.coalesce(1), 5 * perceptron.ROWS_PER_PART).rdd.getNumPartitions() == 5


def test_perceptron_search_finds_mllibs_scores(spark, two_classes, monkeypatch):
    """Candidates trained together score as those that MLlib trains one by one."""
    df, _, _ = two_classes
    folds = classify.prepare_folds(df, 400, ["a", "b", "c"], [], "y")
    spec, grid = classify.ModelSpec("MLP", "mlp", {}, "none"), {"hidden": [(3,), (4, 2)], "maxIter": [8]}
    scores = []
    for rows in (10**9, 0):
        monkeypatch.setattr(classify, "MLLIB_ROWS", rows)
        best, cv = classify.random_search(folds, "y", spec, grid)
        scores.append((best, [(r.params, r.error, round(r.mean_test_score, 6)) for r in cv.orderBy("candidate").collect()]))
    assert scores[0] == scores[1] and len(scores[0][1]) == 2


def brute_tree(bins, y, times, depth, weights, most, least, out, at=()):
    """Splits by path of the tree over all features, siblings of one class merged: path -> (feature, cut) or class 1 share."""
    n = np.array([times[y == k].sum() for k in (0, 1)], float)
    gini = lambda c: 2 * np.prod(c * weights) / max((c * weights).sum(), 1e-300)
    found = []
    for f in range(bins.shape[1] if depth < most and n.min() > 0 else 0):
        for cut in range(1, bins.max() + 1):
            left = np.array([times[(y == k) & (bins[:, f] < cut)].sum() for k in (0, 1)], float)
            if min(left.sum(), (n - left).sum()) >= least:
                found.append((gini(n) - gini(left) - gini(n - left), -f, -cut))
    if found and max(found)[0] / (n * weights).sum() > 1e-12:
        best = max(found[i][0] for i in range(len(found)))
        _, f, cut = max((0, f, cut) for gain, f, cut in found if gain > best - 1e-9)
        right = bins[:, -f] >= -cut
        sides = [brute_tree(bins[o], y[o], times[o], depth + 1, weights, most, least, out, (*at, k)) for k, o in enumerate((~right, right))]
        if not (sides[0] is not None and sides[0] == sides[1]):
            out[at] = (-f, -cut)
            return None
        del out[(*at, 0)], out[(*at, 1)]
    out[at] = n[1] * weights[1] / (n * weights).sum()
    return n[1] * weights[1] > n[0] * weights[0]


def tree_by_path(nodes, weights, i=0, at=()):
    if nodes.feature[i] < 0:
        w = nodes.counts[i] * weights
        return {at: w[1] / w.sum()}
    own = {at: (int(nodes.feature[i]), int(nodes.cut[i]))}
    return own | tree_by_path(nodes, weights, nodes.child[i], (*at, 0)) | tree_by_path(nodes, weights, nodes.child[i] + 1, (*at, 1))


@pytest.mark.parametrize("most,least", [(3, 1), (6, 4), (20, 2)])
def test_forest_pieces_are_exact_trees(most, least):
    from driftkit.operators import forest

    rng = np.random.default_rng(5)
    bins, times = rng.integers(0, 6, (300, 3)).astype(np.uint8), rng.integers(1, 4, 300).astype(np.uint8)
    y = (bins[:, 0] + bins[:, 1] * (bins[:, 2] > 2) + rng.normal(size=300) > 5).astype(np.uint8)
    weights, want = np.array([0.7, 2.1]), {}
    brute_tree(bins, y, times, 0, weights, most, least, want)
    got = forest.grow(bins, y, times, 0, rng, forest.Rules(weights, most, least, 3, 6)).pruned(weights)
    got = tree_by_path(got, weights)
    assert len(want) > 5 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_forest_is_the_same_in_pieces_and_rounds(spark, two_classes, monkeypatch):
    """Splitting large nodes over blocks, shuffled pieces and rounds of trees give the trees of one task."""
    from driftkit.operators import forest

    df, _, y = two_classes
    monkeypatch.setattr(forest, "ROWS_PER_BLOCK", 90)
    runs = []
    for piece, pairs, width in ((10**9, 10**9, 10**9), (40, 1000, 150), (40, 10**9, 10**9)):
        monkeypatch.setattr(forest, "ROWS_PER_PIECE", piece)
        monkeypatch.setattr(forest, "PAIRS_PER_ROUND", pairs)
        monkeypatch.setattr(forest, "ROWS_PER_SLICE", width)
        m = forest.fit_forest(df, ["a", "b", "c"], "y", 400, (1.0, 2.0), 6, 8, 2, "all")
        got = {r.row_index: r.y_score for r in m.score(df, ["row_index"]).collect()}
        assert len(got) == 400 and m.trees.count() == 6 and m.importances().sum() == pytest.approx(1.0)
        runs.append([got[i] for i in range(400)])
    assert runs[1] == pytest.approx(runs[0]) and runs[2] == pytest.approx(runs[0])
    assert np.mean((np.array(runs[0]) > 0.5) == (y == 1)) > 0.8
    sampled = [forest.fit_forest(df, ["a", "b", "c"], "y", 400, numTrees=5, maxDepth=4, featureSubsetStrategy="sqrt").importances() for _ in range(2)]
    assert np.array_equal(*sampled)
    leaf = forest.fit_forest(df, ["a"], "y", 400, numTrees=3, maxDepth=0)
    assert all(abs(r.y_score - y.mean()) < 0.15 for r in leaf.score(df, ["y"]).collect())
    assert [forest.subset_size(s, 14, 9) for s in ("auto", "all", "sqrt", "log2", "onethird", "3", "0.5")] == [4, 14, 4, 4, 5, 3, 7]


def test_large_forests_are_not_left_to_mllib(spark, two_classes, monkeypatch):
    """Over one task's rows no forest of a search is MLlib's, and scores are alike."""
    df, _, _ = two_classes
    folds = classify.prepare_folds(df, 400, ["a", "b", "c"], [], "y")
    spec, grid = classify.ModelSpec("RF", "random_forest", {}), {"numTrees": [30], "maxDepth": [6], "minInstancesPerNode": [2, 5], "featureSubsetStrategy": ["sqrt"]}
    found = {}
    for rows in (10**9, 0):
        monkeypatch.setattr(classify, "MLLIB_ROWS", rows)
        if not rows:
            monkeypatch.setattr(classify.RandomForestClassifier, "fit", lambda *a, **k: pytest.fail("MLlib's forest"))
        best, cv = classify.random_search(folds, "y", spec, grid)
        found[rows] = [(r.error, r.mean_test_score) for r in cv.orderBy("candidate").collect()]
    for (e1, a), (e2, b) in zip(*found.values()):
        assert e1 == e2 == "" and abs(a - b) < 0.05
    fc = classify.fit_classifier(df, ["a", "b", "c"], [], "y", classify.ModelSpec("RF", "random_forest", {"numTrees": 5}))
    ranked = classify.feature_ranking(spark, fc, 2).collect()
    assert len(ranked) == 2 and ranked[0].kind == "importance" and ranked[0].value >= ranked[1].value
