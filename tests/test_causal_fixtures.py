"""Hand-made edge fixtures for the causal windows and labels (FIXTURES.md section 4)."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftkit.operators import causal, labels, reshape
from driftkit.operators.expanding import expanding_quantile

T0 = datetime(2024, 1, 1)
US = timedelta(microseconds=1)
H = timedelta(hours=1)
SCHEMA = "g long, ts timestamp_ntz, v double"


def rows(spark, data, schema=SCHEMA):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("block", [None, 0, 3_600_000_000])
def test_fill_cap_inclusive(spark, block):
    df = rows(spark, [(1, T0, 5.0), (1, T0 + 6 * H, None), (1, T0 + 6 * H + US, None)])
    out = causal.capped_forward_fill(df, ["g"], "ts", ["v"], "6h", block_us=block).orderBy("ts").collect()
    assert [r.v for r in out] == [5.0, 5.0, None]


@pytest.mark.parametrize("block", [None, 0, 3_600_000_000])
def test_last_obs_now_and_too_old(spark, block):
    df = rows(spark, [(1, T0, 2.0), (1, T0 + 24 * H + US, None), (1, T0 + 30 * H, 3.0)])
    out = causal.last_observation_features(df, ["g"], "ts", ["v"], "24h", block_us=block).orderBy("ts").collect()
    assert (out[0].v_last_obs, out[0].v_last_obs_age_hours, out[0].v_was_missing) == (2.0, 0.0, 0)
    assert (out[1].v_last_obs, out[1].v_last_obs_age_hours, out[1].v_was_missing) == (None, None, 1)
    assert (out[2].v_last_obs, out[2].v_last_obs_age_hours) == (3.0, 0.0)
    assert out[1].v is None  # original untouched


@pytest.mark.parametrize("block", [None, 0, 3_600_000_000])
def test_rolling_closure_count_std(spark, block):
    df = rows(spark, [(1, T0, 1.0), (1, T0 + 1 * H, None), (1, T0 + 2 * H, None), (1, T0 + 6 * H, 4.0), (1, T0 + 12 * H, 7.0)])
    out = causal.rolling_features(df, ["g"], "ts", ["v"], ["6h"], include_last_previous_value=True, block_us=block)
    r = {x.ts: x for x in out.collect()}
    assert r[T0].v_count_prev_6h is None and r[T0].v_mean_prev_6h is None      # no rows in frame
    assert r[T0 + 2 * H].v_count_prev_6h == 1.0                                 # rows at 00:00, 01:00
    assert r[T0 + 6 * H].v_mean_prev_6h == 1.0 and r[T0 + 6 * H].v_count_prev_6h == 1.0  # t-6h in, t out
    assert r[T0 + 6 * H].v_std_prev_6h == 0.0                                   # one point, ddof 0
    assert r[T0 + 12 * H].v_mean_prev_6h == 4.0                                 # 06:00 in, 12:00 out
    assert r[T0 + 2 * H].v_last_prev is None and r[T0 + 6 * H].v_last_prev is None  # lag keeps NULLs
    assert r[T0 + 1 * H].v_last_prev == 1.0


def test_rolling_only_null_rows_count_zero(spark):
    df = rows(spark, [(1, T0, None), (1, T0 + H, 2.0)])
    out = causal.rolling_features(df, ["g"], "ts", ["v"], ["6h"], include_last_previous_value=False).orderBy("ts").collect()
    assert out[1].v_count_prev_6h == 0.0 and out[1].v_mean_prev_6h is None


@pytest.mark.parametrize("block", [None, 0, 3_600_000_000])
def test_future_bound_and_labels(spark, block):
    data = [(1, 1, T0, 0.1, None), (1, 1, T0 + 24 * H, 0.5, None), (1, 1, T0 + 24 * H + US, 9.0, None)]
    df = spark.createDataFrame(data, "backend long, qubit long, model_time timestamp_ntz, a double, b double")
    fut = labels.future_horizon(df, ["backend", "qubit"], "model_time", ["a"], "24h", block_us=block)
    r = fut.orderBy("model_time").collect()
    assert (r[0].a_future_max_24h, r[0].a_future_obs_count_24h) == (0.5, 1)
    assert r[2].a_future_obs_count_24h == 0 and r[2].a_future_max_24h is None


def test_threshold_warm_up_and_label_combine(spark):
    data = [(1, q, T0 + q * H, float(q), None) for q in range(10)]
    df = spark.createDataFrame(data, "backend long, qubit long, model_time timestamp_ntz, a double, b double")
    for fn in (expanding_quantile, labels.expanding_quantile_sql):
        r = fn(df, ["backend"], ["model_time", "qubit"], ["a"], 0.95, 10).orderBy("model_time").collect()
        assert r[8].a_threshold is None and r[9].a_threshold == pytest.approx(8.55)
    comb = spark.createDataFrame([(0.2, 0.1, 1, None, None, 0)],
                                 "a_future_max_24h double, a_threshold double, a_future_obs_count_24h int, "
                                 "b_future_max_24h double, b_threshold double, b_future_obs_count_24h int")
    out = labels.combine_labels(comb, ["a", "b"]).first()
    assert out.a_fault_24h == 1.0 and out.b_fault_24h is None and out.fault_24h == 1.0


def test_label_combine_zero_and_null(spark):
    comb = spark.createDataFrame([(0.05, 0.1, 1, None, None, 0), (None, 0.1, 0, None, None, 0)],
                                 "a_future_max_24h double, a_threshold double, a_future_obs_count_24h int, "
                                 "b_future_max_24h double, b_threshold double, b_future_obs_count_24h int")
    out = labels.combine_labels(comb, ["a", "b"]).collect()
    assert out[0].fault_24h == 0.0 and out[0].future_fault_target_count_24h == 1
    assert out[1].fault_24h is None


def test_pivot_median_of_duplicates(spark):
    data = [("b", 1, T0, "T1", v) for v in (1.0, 2.0, 4.0, 8.0)]
    df = spark.createDataFrame(data, "backend string, qubit int, model_time timestamp_ntz, property string, value double")
    out = reshape.pivot_median(df, ["backend", "qubit", "model_time"], ["T1", "T2"]).first()
    assert out.T1 == 3.0 and out.T2 is None


def test_blocked_lag_matches_plain(spark):
    import random

    rnd = random.Random(7)
    data = [(g, T0 + timedelta(minutes=rnd.randrange(0, 20000)), rnd.choice([None, rnd.random()])) for g in range(3) for _ in range(200)]
    df = rows(spark, data).dropDuplicates(["g", "ts"])
    a = causal.previous_value(df, ["g"], "ts", ["v"], block_us=0).orderBy("g", "ts").collect()
    b = causal.previous_value(df, ["g"], "ts", ["v"], block_us=3_600_000_000 * 5).orderBy("g", "ts").collect()
    assert a == b


def test_blocked_frames_match_unblocked(spark):
    import random

    rnd = random.Random(3)
    data = [(g, T0 + timedelta(minutes=rnd.randrange(0, 5000)), rnd.choice([None, rnd.random()])) for g in range(2) for _ in range(300)]
    df = rows(spark, data).dropDuplicates(["g", "ts"])
    kw = dict(windows=["6h", "24h"], statistics=["mean", "max", "min", "std", "count"])
    a = causal.rolling_features(df, ["g"], "ts", ["v"], block_us=0, **kw).orderBy("g", "ts").collect()
    b = causal.rolling_features(df, ["g"], "ts", ["v"], block_us=3_600_000_000 * 7, **kw).orderBy("g", "ts").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for k in x.asDict():
            if isinstance(x[k], float):
                assert y[k] == pytest.approx(x[k], abs=1e-12)
            else:
                assert x[k] == y[k]
    fa = labels.future_horizon(df, ["g"], "ts", ["v"], "24h", block_us=0).orderBy("g", "ts").collect()
    fb = labels.future_horizon(df, ["g"], "ts", ["v"], "24h", block_us=3_600_000_000 * 10).orderBy("g", "ts").collect()
    assert fa == fb


@pytest.mark.parametrize("rows_per_block", [7, 50, 10_000])
def test_expanding_quantile_matches_the_window_form(spark, rows_per_block):
    """Many blocks, some blocks and one block per group; NULL, NaN and a NULL group."""
    import random

    rnd = random.Random(11)
    data = [(g, q, T0 + timedelta(minutes=rnd.randrange(0, 20000)), rnd.choice([None, float("nan"), *[round(rnd.random(), 2) for _ in range(4)]]), rnd.random())
            for g in (0, 1, None) for q in range(6) for _ in range(40)]
    df = spark.createDataFrame(data, "backend long, qubit long, model_time timestamp_ntz, a double, b double").dropDuplicates(
        ["backend", "qubit", "model_time"])
    known = df.withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    key = lambda r: (r.backend, r.qubit, r.model_time)
    want = {key(r): r for r in labels.expanding_quantile_sql(known, ["backend"], ["model_time", "qubit"], ["a", "b"], 0.9, 10).collect()}
    got = expanding_quantile(df, ["backend"], ["model_time", "qubit"], ["a", "b"], 0.9, 10, rows_per_block=rows_per_block).collect()
    assert len(got) == len(want)
    for r in got:
        for c in ("a_threshold", "b_threshold"):
            assert (r[c] is None and want[key(r)][c] is None) or r[c] == pytest.approx(want[key(r)][c], abs=1e-12)


def test_blocks_of_the_expanding_quantile_grow_with_the_group(spark, monkeypatch):
    """However few rows a block is asked to hold, a group has at most a quarter as many
    (chunk, block) pairs as rows."""
    from driftkit.operators import expanding

    sizes, asked = [], expanding._asked
    monkeypatch.setattr(expanding, "_asked", lambda own, held, size, q: sizes.append(size) or asked(own, held, size, q))
    df = spark.range(900).selectExpr("0L AS backend", "id AS qubit", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, int(id)) AS model_time", "double(id * 37 % 900) AS a")
    got = expanding_quantile(df, ["backend"], ["model_time", "qubit"], ["a"], 0.5, 10, rows_per_block=2).collect()
    want = labels.expanding_quantile_sql(df, ["backend"], ["model_time", "qubit"], ["a"], 0.5, 10).collect()
    assert {r.qubit: r.a_threshold for r in got} == pytest.approx({r.qubit: r.a_threshold for r in want})
    assert (900 / sizes[0]) ** 2 <= 900 / 4


def test_a_block_of_the_expanding_quantile_is_bounded():
    """What one Python worker holds at a time: 100,000 rows of a group of 12 million."""
    from driftkit.operators import expanding

    assert expanding.block_rows(expanding.ROWS_PER_BLOCK, 12_000_000) <= 100_000


def test_expanding_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "backend long, qubit long, model_time timestamp_ntz, a double")
    assert expanding_quantile(df, ["backend"], ["model_time", "qubit"], ["a"]).collect() == []


def test_hot_key_spreads_over_blocks(spark):
    """One group holds ~90 % of rows: blocked frames split it over several
    (key, block) partitions and still equal the unblocked answer."""
    import random

    from driftkit.operators import frames

    rnd = random.Random(21)
    data = [(0 if rnd.random() < 0.9 else 1, T0 + timedelta(minutes=rnd.randrange(0, 60 * 24 * 20)), rnd.random())
            for _ in range(3000)]
    df = rows(spark, data).dropDuplicates(["g", "ts"])
    block = 2 * 24 * 3_600_000_000
    staged, _ = frames.into_blocks(df, "ts", 6 * 3_600_000_000, 0, block)
    hot_blocks = staged.filter("g = 0").select(frames.BLOCK).distinct().count()
    assert hot_blocks >= 9  # 20 days / 2-day blocks
    a = causal.rolling_features(df, ["g"], "ts", ["v"], ["6h"], block_us=0).orderBy("g", "ts").collect()
    b = causal.rolling_features(df, ["g"], "ts", ["v"], ["6h"], block_us=block).orderBy("g", "ts").collect()
    for x, y in zip(a, b):
        assert x.v_count_prev_6h == y.v_count_prev_6h
        assert (x.v_mean_prev_6h is None and y.v_mean_prev_6h is None) or x.v_mean_prev_6h == pytest.approx(y.v_mean_prev_6h)


def test_running_quantiles_of_a_slice():
    import numpy as np

    from driftkit.operators.expanding import running_quantiles

    rng = np.random.default_rng(0)
    hist = np.round(rng.normal(size=300), 2)
    own = np.round(rng.normal(size=200), 2)
    own[rng.random(200) < 0.2] = np.nan
    q = 0.9
    # slice = the whole history (c0 = 0) must reproduce the plain expanding quantile
    got = running_quantiles(np.sort(hist), 0, len(hist), own, q, 10)
    vals = list(hist)
    for i, v in enumerate(own):
        if not np.isnan(v):
            vals.append(v)
        assert got[i] == pytest.approx(np.quantile(vals, q), abs=1e-12)
    # a slice around the needed ranks plus the count below it gives the same answers
    s = np.sort(hist)
    lo = int(np.floor(q * (len(hist) - 1))) - 200 - 1
    got2 = running_quantiles(s[lo:], lo, len(hist), own, q, 10)
    assert np.allclose(got, got2, atol=1e-12)


def test_range_statistics_against_numpy():
    import numpy as np

    from driftkit.operators.order_stats import range_quantiles, range_select, range_summaries

    rng = np.random.default_rng(6)
    for n in (1, 2, 3, 64, 65, 500):
        for values in (rng.normal(size=n), np.round(rng.normal(size=n)), 1e9 + rng.normal(size=n), np.where(rng.random(n) < 0.1, 1e12, rng.normal(size=n))):
            lo = rng.integers(0, n, 300)
            hi = lo + 1 + (rng.random(300) * (n - lo)).astype(int)
            k = (rng.random(300) * (hi - lo)).astype(int)
            assert range_select(values, lo, hi, k).tolist() == [np.sort(values[a:b])[c] for a, b, c in zip(lo, hi, k)]
            assert np.allclose(range_quantiles(values, lo, hi, 0.37), [np.quantile(values[a:b], 0.37) for a, b in zip(lo, hi)], rtol=1e-12)
            got = range_summaries(values, lo, hi)
            assert got["min"].tolist() == [values[a:b].min() for a, b in zip(lo, hi)]
            assert got["max"].tolist() == [values[a:b].max() for a, b in zip(lo, hi)]
            assert np.allclose(got["mean"], [values[a:b].mean() for a, b in zip(lo, hi)], rtol=1e-12)
            spread = [((values[a:b] - values[a:b].mean()) ** 2).sum() for a, b in zip(lo, hi)]
            assert np.allclose(got["m2"], spread, rtol=1e-9, atol=1e-9 * max(1.0, np.abs(values).max() * 1e-7) ** 2)


@pytest.mark.parametrize("closed", ["left", "right", "both", "neither"])
@pytest.mark.parametrize("at_once", [1, 40, 50_000])
def test_rolling_against_brute_force(spark, monkeypatch, closed, at_once):
    """Every closure, repeated times, NULL, NaN and a NULL key, in runs of any length."""
    import random

    import numpy as np

    monkeypatch.setattr(causal, "ROWS_AT_ONCE", at_once)
    rnd = random.Random(5)
    data = [(rnd.choice([1, 2, None]), T0 + timedelta(minutes=10 * rnd.randrange(0, 300)), rnd.choice([None, float("nan"), 1e9 + rnd.random(), rnd.random(), rnd.random()]))
            for _ in range(400)]
    out = causal.rolling_features(rows(spark, data), ["g"], "ts", ["v"], ["6h", "1h"], ["mean", "std", "median", "min", "max", "count"],
                                  closed=closed, min_periods=2, include_last_previous_value=False, block_us=36_000_000_000).collect()
    assert len(out) == len(data)
    for r in out:
        for name, span in (("6h", 6 * H), ("1h", H)):
            inside = [v for g, t, v in data if g == r.g and (t > r.ts - span or (t == r.ts - span and closed in ("left", "both")))
                      and (t < r.ts or (t == r.ts and closed in ("right", "both")))]
            known = np.array([v for v in inside if v is not None and not np.isnan(v)])
            assert r[f"v_count_prev_{name}"] == (len(known) if len(inside) >= 2 else None)
            for stat, fn in (("mean", np.mean), ("std", np.std), ("median", np.median), ("min", np.min), ("max", np.max)):
                got = r[f"v_{stat}_prev_{name}"]
                assert got is None if len(known) < 2 else got == pytest.approx(fn(known), rel=1e-9, abs=1e-12)


def test_dense_frames_take_linear_time():
    """4 times the rows at 4 times the rows per frame: far from 16 times the time."""
    import time

    import numpy as np

    took = []
    for n in (50_000, 200_000):
        v, hi = np.random.default_rng(1).normal(size=n), np.arange(n)
        lo = np.maximum(hi - n // 5, 0)
        began = time.process_time()
        causal.frame_columns(v, lo, hi, ["mean", "max", "min", "std", "count", "median"], 1)
        took.append(time.process_time() - began)
    assert took[1] < 9 * took[0]
