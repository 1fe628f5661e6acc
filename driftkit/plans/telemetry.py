"""Raw long feed -> environment features, node snapshot, edge snapshot, label table.

Shuffle plan (one exchange per step, each keyed on fine-grained keys):
  A1 medians by (group, time) -> W1/W3/W4 on time-blocked (group, block)
  A2 pivot by (group, entity, time) -> J1 left join env -> W2 on (group, entity, block)
  W7 thresholds by group -> W8 on (group, entity, block)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftkit.functions.names import sanitize_name
from driftkit.operators import causal, frames, labels, reshape
from driftkit.operators.frames import parse_duration_us
from driftkit.operators.ingest import numeric_columns


@dataclass
class FeedConfig:
    # Option names and defaults follow the source study's configuration.
    group_col: str = "backend"
    entity_col: str = "qubit"
    property_col: str = "property"
    value_col: str = "value"
    time_col: str = "model_time"
    properties: Sequence[str] = ("T1", "T2", "sx_error", "readout_error", "prob_meas0_prep1", "prob_meas1_prep0")
    history_columns: Sequence[str] = ("T1", "T2", "sx_error", "readout_error")
    history_max_age: str = "24h"
    include_missing_indicators: bool = True
    edge_pattern: str = reshape.EDGE_PATTERN
    environment_columns: Sequence[str] = ()
    causal_fill: bool = True
    max_fill_age: str = "6h"
    rolling_columns: Sequence[str] = ()
    rolling_windows: Sequence[str] = ("6h", "12h", "24h")
    rolling_closed: str = "left"
    rolling_min_periods: int = 1
    rolling_statistics: Sequence[str] = ("mean", "max", "min", "std", "count")
    include_last_previous_value: bool = True
    targets: Sequence[str] = ("sx_error", "readout_error")
    horizon: str = "24h"
    threshold_quantile: float = 0.95
    threshold_min_periods: int = 10
    drop_rows_without_future_label: bool = True
    block_us: int | None = None


def environment_features(df: DataFrame, cfg: FeedConfig) -> DataFrame:
    """A1 -> W1 -> W3/W4: one row per (group, time) with filled environment medians
    and left-closed rolling statistics."""
    g, t = cfg.group_col, cfg.time_col
    env_cols = numeric_columns(df, cfg.environment_columns)
    if not env_cols:
        return df.select(g, t).distinct()
    env = reshape.grouped_medians(df, [g, t], env_cols)
    if cfg.causal_fill:
        env = causal.capped_forward_fill(env, [g], t, env_cols, cfg.max_fill_age, block_us=cfg.block_us)
    roll = [c for c in cfg.rolling_columns if c in env_cols]
    if roll:
        env = causal.rolling_features(
            env, [g], t, roll, cfg.rolling_windows, cfg.rolling_statistics, cfg.rolling_closed,
            cfg.rolling_min_periods, cfg.include_last_previous_value, block_us=cfg.block_us,
        )
    return env


def node_snapshot(df: DataFrame, env: DataFrame | None, cfg: FeedConfig, with_future: bool = False) -> DataFrame:
    """P4 -> A2 (+A3, P7) -> J1 -> W2 (and, with ``with_future``, W8 in the SAME
    time-blocked window pass: one shuffle of the snapshot for both frames)."""
    g, e, t = cfg.group_col, cfg.entity_col, cfg.time_col
    rows = reshape.node_rows(df, cfg.properties, e, cfg.property_col, cfg.edge_pattern)
    extra = ["calibration_lag_hours"] if "calibration_lag_hours" in df.columns else []
    wide = reshape.pivot_median(rows, [g, e, t], cfg.properties, cfg.property_col, cfg.value_col, extra)
    if env is not None:
        wide = reshape.join_many_to_one(wide, env, [g, t], "left")
    hist = [sanitize_name(c) for c in cfg.history_columns if sanitize_name(c) in wide.columns]
    cap = parse_duration_us(cfg.history_max_age)
    targets = [sanitize_name(c) for c in cfg.targets if sanitize_name(c) in wide.columns] if with_future else []
    h = parse_duration_us(cfg.horizon) if targets else 0
    tag = cfg.horizon.lower().replace(" ", "")

    def build(w, staged):
        cols = causal.last_observation_columns(w, hist, cap, cfg.include_missing_indicators)
        return cols + (labels.future_columns(w, targets, h, tag) if targets else [])

    return frames.apply_bounded_frames(wide, [g, e], t, build, lookback_us=cap, lookahead_us=h, block_us=cfg.block_us)


def edge_snapshot(df: DataFrame, env: DataFrame | None, cfg: FeedConfig) -> DataFrame:
    """P5 -> F3 -> A4 -> J1."""
    g, t = cfg.group_col, cfg.time_col
    rows = reshape.edge_rows(df, cfg.property_col, cfg.edge_pattern)
    extra = ["calibration_lag_hours"] if "calibration_lag_hours" in df.columns else []
    edges = reshape.edge_medians(rows, [g, "q1", "q2", t], cfg.value_col, "cz_error", extra)
    if env is not None:
        edges = reshape.join_many_to_one(edges, env, [g, t], "left")
    return edges


def label_table(node: DataFrame, cfg: FeedConfig, future_ready: bool = False) -> DataFrame:
    """W7 -> W8 -> W9 -> W11 -> P16 (``future_ready``: W8 came with the snapshot)."""
    return labels.add_future_fault_labels(
        node,
        [sanitize_name(c) for c in cfg.targets],
        group_cols=[cfg.group_col],
        entity_cols=[cfg.group_col, cfg.entity_col],
        time_col=cfg.time_col,
        horizon=cfg.horizon,
        q=cfg.threshold_quantile,
        min_periods=cfg.threshold_min_periods,
        drop_unlabelled=cfg.drop_rows_without_future_label,
        block_us=cfg.block_us,
        future_ready=future_ready,
    )


def labelled_snapshot(df: DataFrame, env: DataFrame | None, cfg: FeedConfig) -> DataFrame:
    """Snapshot with W2 + W8 fused, then W7/W9/W11/P16."""
    return label_table(node_snapshot(df, env, cfg, with_future=True), cfg, future_ready=True)


def run(df: DataFrame, cfg: FeedConfig, edge_feed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Lazy outputs of the whole preprocessing flow (pruning and writes are separate actions)."""
    env = environment_features(df, cfg) if cfg.environment_columns else None
    fused = node_snapshot(df, env, cfg, with_future=True)
    node = fused.select(*[c for c in fused.columns if "_future_" not in c])
    if edge_feed is None:
        edge = edge_snapshot(df, env, cfg)
    else:  # a separate edge feed carries its own environment readings
        edge_env = environment_features(edge_feed, cfg) if cfg.environment_columns else None
        edge = edge_snapshot(edge_feed, edge_env, cfg)
    return {"environment": env, "qubit_snapshot": node, "edge_snapshot": edge,
            "fault_prediction": label_table(fused, cfg, future_ready=True)}


def run_and_write(df: DataFrame, cfg: FeedConfig, out_dir: str, edge_feed: DataFrame | None = None,
                  formats=("parquet", "csv"), raw: DataFrame | None = None) -> dict:
    """SURVEY 3.1 end to end: each table is computed once, into a checkpoint that also
    observes what P8, A12 and A5 need; the pruned checkpoint feeds the writes (S8) and
    the JSON report (S7)."""
    from driftkit.operators import profile
    from driftkit.operators.ingest import parse_report
    from driftkit.sources import sinks

    outs = run(df, cfg, edge_feed)
    props = [sanitize_name(p) for p in cfg.properties]
    protect = {
        "qubit_snapshot": set(props) | {"calibration_lag_hours"},
        "edge_snapshot": {"cz_error", "calibration_lag_hours"},
        "fault_prediction": set(props) | {f"fault_{cfg.horizon}"},
    }
    report: dict = {}
    if raw is not None:
        report.update(parse_report(raw).first().asDict())
    final = {}
    for name in ("qubit_snapshot", "edge_snapshot", "fault_prediction"):
        table, stats = profile.stored_with_profile(outs[name], protect[name])
        report[f"{name}_dropped_all_missing_columns"] = stats["all_missing"]
        report[f"{name}_dropped_constant_columns"] = stats["constant"]
        report[f"{name}_shape"] = stats["shape"]
        report[f"{name}_missingness"] = stats["missingness"]
        final[name] = table
    g, e, t = cfg.group_col, cfg.entity_col, cfg.time_col
    order = {"qubit_snapshot": [g, e, t], "edge_snapshot": [g, "q1", "q2", t], "fault_prediction": [g, e, t]}
    paths = sinks.write_outputs(final, out_dir, formats, sort_within=order)
    report["outputs"] = paths
    spark = df.sparkSession
    paths["report"] = sinks.write_json_report(spark, report, f"{out_dir.rstrip('/')}/report")
    return {"tables": final, "report": report, "paths": paths}
