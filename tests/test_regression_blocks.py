"""Blocks of the regression study's folds and the counts behind its design."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftkit.operators import splits
from driftkit.operators.regress import discover_design
from driftkit.plans import regression_study as rs


@pytest.fixture(scope="module")
def train(spark):
    """60 rows on 7 days, so that blocks begin inside a day; some categories are NULL."""
    rng = np.random.default_rng(5)
    rows = [(i // 3, i % 3, datetime(2024, 1, 1) + timedelta(days=int(rng.integers(7))), float(rng.normal()), float(rng.normal()), ["a", "b", "c", None][int(rng.integers(4))])
            for i in range(60)]
    return spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, model_time timestamp_ntz, y double, x double, kind string")


def test_blocks_number_only_the_rows_of_times_in_which_a_block_begins(train, monkeypatch):
    cfg = rs.StudyConfig(numeric=("x",), categorical=("kind",))
    order = ["model_time", "l_orderkey", "l_linenumber"]
    want = {(r.l_orderkey, r.l_linenumber): r.b for r in
            splits.row_index(train, order).withColumn("b", F.coalesce(splits.fold_column(60, 5), F.lit(0))).collect()}
    numbered, row_index = [], splits.row_index
    monkeypatch.setattr(rs.splits, "row_index", lambda df, *a: numbered.append(df.count()) or row_index(df, *a))
    blocks, n = rs.cv_blocks(train, cfg)
    assert n == 60 and {(r.l_orderkey, r.l_linenumber): r._blk for r in blocks.collect()} == want
    assert 0 < numbered[0] < 60


def test_least_squares_from_the_folds_is_the_full_fit(train):
    cfg = rs.StudyConfig(numeric=("x",), categorical=("kind",))
    full, stats = rs.fit_full(train, ["x"], cfg), rs.fold_statistics(train, ["x"], cfg)
    again = stats.full()
    assert again.names == full.names
    assert np.allclose(again.fit.coef, full.fit.coef, atol=1e-12) and again.fit.intercept == pytest.approx(full.fit.intercept, abs=1e-12)


def test_modes_and_categories_of_subsets(train):
    design = discover_design(train, ["x"], ["kind"], "y")
    assert design.categories == {"kind": ["a", "b", "c"]}
    found = design.fold_params(train, {"all": F.lit(True), "few": F.col("l_orderkey") < 4, "none": F.col("l_orderkey") < 0})
    for name, rows in (("all", train), ("few", train.where("l_orderkey < 4")), ("none", train.limit(0))):
        r = rows.agg(F.mode("kind", True).alias("m"), F.array_sort(F.collect_set("kind")).alias("c")).first()
        assert (found[name].modes["kind"], found[name].categories["kind"]) == (r.m, r.c)
