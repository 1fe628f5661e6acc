"""The registered searches draw what the source study draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftkit.operators import classify, forest
from driftkit.plans import q_classify


def drawn(monkeypatch, query):
    """(model, candidates) that a registered search asks for."""
    asked = []
    monkeypatch.setattr(q_classify, "frame", lambda *a: (None, 0, [], []))
    monkeypatch.setattr(classify, "prepare_folds", lambda *a: [])
    monkeypatch.setattr(classify, "random_search", lambda folds, label, spec, grid, n_iter: asked.append((spec.kind, len(classify.sample_grid(grid, n_iter)))))
    with pytest.raises(TypeError):  # nothing is returned to go on with
        query(None, "")
    return asked


def test_forest_search_draws_twelve(monkeypatch):
    assert drawn(monkeypatch, q_classify.q_search_forest) == [("random_forest", 12)]


def test_boosted_search_draws_twelve(monkeypatch):
    assert drawn(monkeypatch, q_classify.q_search_boosted) == [("boosted", 12)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.6, size=300) > 0.6).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))], "row_index long, a double, b double, c double, d double, y int")


def test_trees_grown_together_are_those_grown_alone():
    """Rules that part at some node go on apart; a shallower tree is the top of a deeper one."""
    rng = np.random.default_rng(5)
    bins, times = rng.integers(0, 8, (600, 6)).astype(np.uint8), rng.integers(1, 4, 600).astype(np.uint8)
    y = (bins[:, 0] + bins[:, 1] * (bins[:, 2] > 3) + 3 * rng.normal(size=600) > 8).astype(np.uint8)
    codes, weights, key = (2 * bins + y[:, None]).astype(np.uint8).ravel(), np.array([0.7, 2.1]), forest.root_key(1, 2)
    kinds = [forest.Rules(weights, depth, least, 3, 8) for depth, least in ((12, 1), (4, 6), (12, 250))]
    together = forest.grow_alike(codes, 6, times, 0, key, kinds)
    for rules, tree in zip(kinds, together):
        alone = forest.grow_alike(codes, 6, times, 0, key, [rules])[0]
        assert all(np.array_equal(getattr(tree, k), getattr(alone, k)) for k in forest.Nodes.KINDS)
    assert len({(i, t.feature[i], t.cut[i]) for t in together for i in (1, 2) if t.feature[i] >= 0}) > 2  # they part near the root
    at = np.arange(600) * 6
    for rules, tree in zip(kinds, together):
        shallow, deep = forest.grow_alike(codes, 6, times, 0, key, [forest.Rules(weights, 3, rules.least, 3, 8)])[0].pruned(weights), tree.pruned(weights)
        (share, falls), (want, wanted) = deep.at_depth(3, weights, 6), shallow.at_depth(3, weights, 6)
        ends = next(forest.Walk(deep.feature, deep.cut, deep.child).ends(codes, at, [3]))
        assert np.array_equal(share[ends], want[forest.route(shallow, codes, at)]) and falls == pytest.approx(wanted)


def test_forests_of_a_search_are_grown_once_and_are_those_grown_alone(spark, rows, monkeypatch):
    """Nodes split over blocks and pieces, rules that part there too; the scores are each forest's own."""
    for name, value in (("ROWS_PER_BLOCK", 100), ("ROWS_PER_PIECE", 60), ("ROWS_PER_SLICE", 170), ("STEPS_AT_ONCE", 2)):
        monkeypatch.setattr(forest, name, value)
    settings = [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": m, "featureSubsetStrategy": s} for n, d, m, s in ((5, 7, 1, "sqrt"), (3, 7, 25, "log2"), (4, 2, 1, "2"), (2, 9, 25, "all"))]
    train = rows.coalesce(1).sortWithinPartitions("row_index")
    models = forest.fit_forests(train, ["a", "b", "c", "d"], "y", 300, settings, (1.0, 2.0))
    assert models[0].trees.groupBy("kind").count().count() == 3
    scored = {}
    for r in forest.score_forests(models, rows, ["row_index"]).collect():
        scored.setdefault(r.candidate, {})[r.row_index] = r.y_score
    for i, s in enumerate(settings):
        alone = forest.fit_forest(train, ["a", "b", "c", "d"], "y", 300, (1.0, 2.0), **s)
        got = {r.row_index: r.y_score for r in alone.score(rows, ["row_index"]).collect()}
        assert len(got) == 300 and [scored[i][k] for k in range(300)] == pytest.approx([got[k] for k in range(300)])
        assert models[i].importances() == pytest.approx(alone.importances())


def test_no_forest_of_a_search_is_left_to_mllib(spark, rows, monkeypatch):
    """At any number of rows; a setting that makes no forest has its own error."""
    grown, fit = [], classify.fit_forests
    monkeypatch.setattr(classify, "fit_forests", lambda *a: grown.append(len(a[4])) or fit(*a))
    folds = classify.prepare_folds(rows.withColumn("y", F.when(F.col("row_index") < 75, 0).otherwise(F.col("y"))), 300, ["a", "b", "c", "d"], [], "y")
    spec, grid = classify.ModelSpec("RF", "random_forest", {}), {"numTrees": [8], "maxDepth": [3, 5], "featureSubsetStrategy": ["sqrt", "no such"]}
    _, cv = classify.random_search(folds, "y", spec, grid)
    found = {r.params: r for r in cv.collect()}
    assert grown == [2, 2] and len(found) == 4  # the first fold has one class
    for params, r in found.items():
        assert (r.mean_test_score is None and r.error != "") if "no such" in params else (r.error == "" and 0 < r.mean_test_score <= 1)


def test_networks_of_fewer_steps_are_stops_of_one_training(spark, rows, monkeypatch):
    """Weights after 3, 6 and 9 steps, those of networks trained alone, at the gradients of one."""
    from driftkit.operators import perceptron

    monkeypatch.setattr(perceptron, "ROWS_PER_BLOCK", 128)
    first = np.random.default_rng(1).normal(size=4 * 3 + 3 + 3 * 2 + 2)
    parts = [(rows.coalesce(1).sortWithinPartitions("row_index"), ["a", "b", "c", "d"])]
    asked, work = [], perceptron.minimize
    monkeypatch.setattr(perceptron, "minimize", lambda x, stops: asked.append(list(stops)) or work(x, stops))
    together = perceptron.fit_perceptrons(parts, "y", [(0, [4, 3, 2], first, most) for most in (6, 3, 9)])
    assert asked == [[3, 6, 9]]
    for most, weights in zip((6, 3, 9), together):
        assert weights == pytest.approx(perceptron.fit_perceptrons(parts, "y", [(0, [4, 3, 2], first, most)])[0], rel=1e-9)
    assert not np.allclose(together[0], together[1]) and not np.allclose(together[0], together[2])


def test_one_task_grows_all_boosted_trees(spark, rows, monkeypatch):
    """No job a level where one task holds the blocks; the trees are those of tasks that shuffle."""
    from driftkit.operators import boosting

    monkeypatch.setattr(boosting, "ROWS_PER_BLOCK", 40)
    jobs, collect = [], type(rows).collect
    monkeypatch.setattr(type(rows), "collect", lambda self: jobs.append(self.columns) or collect(self))
    fitted = []
    for most in (8, 2):
        monkeypatch.setattr(boosting, "BLOCKS_PER_TASK", (most, 32))
        jobs.clear()
        fitted.append(boosting.fit_boosted(rows, ["a", "b", "c", "d"], "y", 300, 0.4, 2.0, n_estimators=12, max_depth=3, subsample=0.8, colsample=0.6, reg_alpha=0.1))
        assert len(jobs) < 4 if most == 8 else len(jobs) > 12
    for a, b in zip(*(m.trees for m in fitted)):
        assert np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) and a.value == pytest.approx(b.value) and a.gain == pytest.approx(b.gain)
    assert len(fitted[0].trees) == 12
