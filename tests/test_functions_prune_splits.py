"""Scalar helpers, pruning and splits."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftkit.functions.names import sanitize_name, sanitize_name_col
from driftkit.functions.scalar import regex_int, to_double, to_timestamp_ntz, two_class_bin
from driftkit.operators import prune, splits
from driftkit.operators.preprocess import fit_preprocessing
from driftkit.operators.reshape import EDGE_PATTERN
from driftkit.session import cut_lineage


def test_name_sanitiser_python_and_column(spark):
    cases = {" a/b-c (d) ": "a_b_c_d", "__x__": "x", "()": "unnamed"}
    for raw, want in cases.items():
        assert sanitize_name(raw) == want
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.o for r in df.select("s", sanitize_name_col("s").alias("o")).collect()}
    assert got == cases


def test_edge_names(spark):
    df = spark.createDataFrame([("cz_error_3_12",), ("cz_error_3",), ("xcz_error_1_2",)], "p string")
    out = df.select(regex_int("p", EDGE_PATTERN, 1).alias("a"), regex_int("p", EDGE_PATTERN, 2).alias("b")).collect()
    assert [(r.a, r.b) for r in out] == [(3, 12), (None, None), (None, None)]


def test_bad_input_parse(spark):
    df = spark.createDataFrame([("junk", "x"), ("2024-01-01 00:00:00", "nan"), ("2024-01-01 01:00:00", "1.5")], "t string, v string")
    out = df.select(to_timestamp_ntz("t").alias("t"), to_double("v").alias("v")).collect()
    assert out[0].t is None and out[0].v is None and out[1].v is None and out[2].v == 1.5
    assert out[1].t == datetime(2024, 1, 1)


def test_two_class_bin(spark):
    df = spark.createDataFrame([(None,), (0.00025,), (0.00026,)], "x double")
    out = [r.c for r in df.select(two_class_bin("x", 0.00025).alias("c")).collect()]
    assert out == [None, "low_error", "high_or_failed"]


def test_low_information(spark):
    df = spark.createDataFrame([(1, None, 5.0, 5.0, 7.0, 1.0), (2, None, 5.0, None, 7.0, 2.0)],
                               "qubit int, allnull double, const double, constnull double, protected double, ok double")
    out, stats = prune.drop_low_information_columns(df, protected=["protected"])
    assert stats == {"all_missing": ["allnull"], "constant": ["const", "constnull"]}
    assert out.columns == ["qubit", "protected", "ok"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_are_utc_in_any_session(spark, zone):
    from driftkit.functions.scalar import to_timestamp_ntz

    want = {"2026-04-07T00:00:00Z": "2026-04-07 00:00:00", "2026-03-08 02:30:00": "2026-03-08 02:30:00", "2026-04-07 01:00:00.5+02:00": "2026-04-06 23:00:00.5",
            "2026-04-07": "2026-04-07 00:00:00", "nonsense": None, None: None}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(k,) for k in want], "t string").select("t", to_timestamp_ntz("t").cast("string").alias("u")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert {r.t: r.u for r in rows} == want


def test_leakage_rule():
    for c in ["a_future_max_24h", "future_x", "sx_error_fault_24h", "x_future_fault_y"]:
        assert prune.looks_ahead(c)
    assert not prune.looks_ahead("fault_24h") and not prune.looks_ahead("sx_error_threshold")


def test_expanding_folds_rule():
    f = splits.expanding_folds(11, 3)
    assert [x["valid_start"] for x in f] == [5, 7, 9] and all(x["valid_end"] - x["valid_start"] == 1 for x in f)


def test_row_index_and_split(spark):
    import random

    rnd = random.Random(1)
    data = [(i, datetime(2024, 1, 1 + rnd.randrange(0, 20))) for i in range(500)]
    df = spark.createDataFrame(data, "id long, t timestamp_ntz").repartition(7)
    idx = splits.row_index(df, ["t", "id"]).collect()
    want = sorted(data, key=lambda r: (r[1], r[0]))
    got = sorted(idx, key=lambda r: r.row_index)
    assert [r.row_index for r in got] == list(range(500))
    assert [(r.id, r.t) for r in got] == want
    cut = splits.chronological_cutoff(df, "t", 0.8, ["id"])
    assert cut == want[400][1]


def test_row_index_orders_nulls_and_copies_keys_only(spark, monkeypatch):
    """NULL, NaN and repeated keys, many ranges, no rows; the checkpoints hold key columns only."""
    stored = []

    def watched(df):
        out = cut_lineage(df)
        stored.append(set(out.columns))
        return out

    monkeypatch.setattr(splits, "cut_lineage", watched)
    rows = [(None if i % 11 == 0 else float("nan") if i % 13 == 0 else float(i * 37 % 101), f"k{i % 7}", i, "wide" * 20) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, s string, id long, payload string").repartition(9)
    got = splits.row_index(df, ["x", "s", "id"]).orderBy("row_index").collect()
    assert stored and all("payload" not in columns for columns in stored)

    def key(r):
        return (r[0] is not None, 0.0 if r[0] is None else float("inf") if math.isnan(r[0]) else r[0], r[1], r[2])

    assert [r.row_index for r in got] == list(range(3000))
    assert [r.id for r in got] == [r[2] for r in sorted(rows, key=key)]
    tied = splits.row_index(df, ["s"]).orderBy("row_index").collect()
    assert [r.row_index for r in tied] == list(range(3000)) and [r.s for r in tied] == sorted(r[1] for r in rows)
    empty = splits.row_index(df.where("id < 0"), ["x", "id"])
    assert empty.columns == [*df.columns, "row_index"] and empty.count() == 0


def test_constant_feature_scaled_to_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, None), (3.0, 5.0)], "c double, x double")
    m = fit_preprocessing(df, ["c", "x"], [])
    assert m.scales["c"] == 1.0 and m.medians["x"] == 3.0
    out = m.transform(df).collect()
    assert all(r.c == 0.0 for r in out)
    assert out[1].x == pytest.approx(0.0, abs=1e-12)


def test_assert_unique_keys(spark):
    from driftkit.operators.reshape import assert_unique_keys

    ok = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    assert_unique_keys(ok, ["a", "b"])
    with pytest.raises(ValueError):
        assert_unique_keys(ok, ["a"])


def test_single_class_fold_gives_constant_scores(spark):
    from driftkit.operators import classify

    df = spark.createDataFrame([(float(i), 0) for i in range(20)], "x double, y int")
    fc = classify.fit_classifier(df, ["x"], [], "y", classify.LOGISTIC)
    assert fc.constant == 0.0
    assert {r.y_score for r in fc.score(df, ["y"]).collect()} == {0.0}
