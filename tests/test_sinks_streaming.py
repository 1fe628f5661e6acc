"""Sinks round-trip and the streaming ingest (file source, availableNow trigger)."""

import json
import os
import tempfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftkit.sources import sinks
from driftkit.streaming.feed_stream import read_feed_stream, snapshot_stream, typed_feed_stream

RAW_SCHEMA = "backend string, qubit int, property string, value string, observed_time string, calibrated_time string"


def test_sinks_round_trip(spark):
    d = tempfile.mkdtemp(prefix="driftkit-sinks-")
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 2.0)], "model string, fold int, v double")
    paths = sinks.write_outputs({"t": df}, d, partition_by={"t": ["model"]})
    assert spark.read.parquet(paths["t_parquet"]).count() == 2
    assert spark.read.option("header", True).csv(paths["t_csv"]).count() == 2
    p = sinks.write_json_report(spark, {"rows": 2, "nested": {"x": [1, 2]}}, f"{d}/report")
    txt = spark.read.text(p).first()[0]
    assert json.loads(txt)["nested"]["x"] == [1, 2]
    arts = sinks.write_model_artifacts(f"{d}/model", df, df.groupBy("model").count(), df, best_params={"a": 1})
    assert set(arts) == {"fold_metrics", "summary", "predictions", "best_params"}


def test_streaming_ingest_and_watermarked_pivot(spark):
    d = tempfile.mkdtemp(prefix="driftkit-stream-")
    src = f"{d}/in"
    os.makedirs(src)
    t0 = datetime(2024, 1, 1)
    rows = []
    for h in range(12):
        t = (t0 + timedelta(hours=h)).isoformat(sep=" ")
        rows += [{"backend": "b", "qubit": 1, "property": "T1", "value": str(h), "observed_time": t, "calibrated_time": t},
                 {"backend": "b", "qubit": 1, "property": "T1", "value": str(h + 2), "observed_time": t, "calibrated_time": t}]
    rows.append({"backend": "b", "qubit": 1, "property": "T1", "value": "junk", "observed_time": "bad", "calibrated_time": None})
    with open(f"{src}/part-0.json", "w") as fh:
        fh.write("\n".join(json.dumps(r) for r in rows))
    raw = read_feed_stream(spark, src, RAW_SCHEMA)
    q = typed_feed_stream(raw, f"{d}/typed", f"{d}/ck1")
    q.awaitTermination(120)
    typed = spark.read.parquet(f"{d}/typed")
    assert typed.count() == 24  # the junk row is dropped
    q2 = snapshot_stream(read_feed_stream(spark, src, RAW_SCHEMA), ["T1"], f"{d}/snap", f"{d}/ck2", delay="1 hour")
    q2.awaitTermination(120)
    snap = spark.read.parquet(f"{d}/snap").orderBy("model_time").collect()
    # rows older than the final watermark (max time - 1 h) are final: medians of (h, h + 2)
    assert len(snap) >= 10 and all(r.T1 == float(i) + 1.0 for i, r in enumerate(snap))


def test_run_and_write_preprocessing(spark):
    from driftkit.plans import telemetry
    from driftkit.plans.q_telemetry import node_cfg
    from driftkit.sources.tables import edge_feed, readings

    d = tempfile.mkdtemp(prefix="driftkit-run-")
    sf = "/root/testdata/sf0.001"
    res = telemetry.run_and_write(readings(spark, sf, hourly=True), node_cfg(), d, edge_feed=edge_feed(spark, sf),
                                  formats=("parquet",), raw=readings(spark, sf))
    rep = res["report"]
    assert rep["qubit_snapshot_shape"][0] > 0 and "fault_prediction_parquet" in res["paths"]
    assert spark.read.parquet(res["paths"]["fault_prediction_parquet"]).count() == rep["fault_prediction_shape"][0]
    assert rep["value_parse_failures"] == 0


def test_shipped_package_zip_is_importable(spark):
    import sys
    import zipfile

    from driftkit import session

    session._SHIPPED.discard(spark.sparkContext.applicationId)
    session.ship_package(spark)
    assert spark.sparkContext.applicationId in session._SHIPPED
    # the zip Spark serves to workers contains the whole package
    import glob

    zips = sorted(glob.glob(os.path.join(tempfile.gettempdir(), "driftkit-py-*", "driftkit.zip")), key=os.path.getmtime)
    names = zipfile.ZipFile(zips[-1]).namelist()
    assert "driftkit/__init__.py" in names and "driftkit/operators/expanding.py" in names
    # a Python worker resolves driftkit through the shipped file
    out = spark.sparkContext.parallelize([1], 1).map(lambda _: __import__("driftkit").__version__).collect()
    assert out == [sys.modules["driftkit"].__version__]


def test_profile_comes_with_the_stored_frame(spark):
    """P8, A5 and A12 equal the separate passes, and the source is read once."""
    from driftkit.operators import profile, prune

    read = spark.sparkContext.accumulator(0)

    def watch(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.range(0, 400, 1, 5).selectExpr(
        "id AS qubit", "cast(NULL AS double) AS gone", "3 AS same", "CASE WHEN id % 4 = 0 THEN id END AS some",
        "CASE WHEN id % 2 = 0 THEN 'x' END AS half", "cast(NULL AS string) AS kept")
    table, stats = profile.stored_with_profile(df.mapInPandas(watch, df.schema), ["kept"])
    assert read.value == 400 and table.count() == 400 and read.value == 400
    want, dropped = prune.drop_low_information_columns(df, ["kept"])
    assert table.columns == want.columns and {k: stats[k] for k in dropped} == dropped
    assert stats["shape"] == list(profile.shape(want).first().asDict()[c] for c in ("rows", "cols"))
    rates = {r["column"]: r["missing_rate"] for r in profile.missing_rates(want).collect()}
    assert stats["missingness"] == rates and list(stats["missingness"]) == list(rates)
    none, stats = profile.stored_with_profile(df.where("qubit < 0"))
    assert none.count() == 0 and stats["shape"][0] == 0 and stats["missingness"] == {}
