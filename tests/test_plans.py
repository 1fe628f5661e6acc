"""Physical-plan properties: pushdown, pruning, no single-task global windows."""

import io
from contextlib import redirect_stdout

from driftkit.operators import metrics, reshape
from driftkit.sources.tables import read_table, readings

SF = "/root/testdata/sf0.001"


def plan_text(df, mode="formatted"):
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_node_filter_reaches_parquet_scan(spark):
    feed = readings(spark, SF, hourly=True)
    rows = reshape.node_rows(feed, ["click", "error"])
    wide = reshape.pivot_median(rows, ["backend", "qubit", "model_time"], ["click", "error"])
    txt = plan_text(wide)
    assert "In(event_type, [click,error])" in txt and "GreaterThanOrEqual(user_id,0)" in txt
    # column pruning: the scan never reads event_id
    read_schema = [line for line in txt.splitlines() if line.startswith("ReadSchema")]
    assert read_schema and all("event_id" not in line for line in read_schema)


def test_grouped_ranking_metrics_have_no_single_partition_exchange(spark):
    ev = read_table(spark, SF, "events")
    scored = ev.selectExpr("user_id % 3 AS fold", "CAST(event_type = 'error' AS INT) AS y", "value / 100.0 AS score")
    txt = plan_text(metrics.ranking_metrics(scored, "y", "score", group_cols=["fold"]))
    assert "SinglePartition" not in txt
    # the range-partitioned distinct-score table was materialised by a reliable checkpoint
    assert "Scan ExistingRDD" in txt
