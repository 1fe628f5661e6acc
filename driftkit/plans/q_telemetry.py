"""Registered queries for ingest, causal windows, pivots, joins and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftkit.functions.scalar import hours_between
from driftkit.operators import causal, labels, reshape
from driftkit.operators.expanding import expanding_quantile
from driftkit.operators.ingest import parse_feed, parse_report, quarantine
from driftkit.plans import telemetry
from driftkit.plans.catalog import EDGES_SQL, H6, H12, H24, HIST, K_EXPR, NODE_PROPS, TARGETS, readings_sql, register, rounded
from driftkit.session import ensure_checkpoint_dir
from driftkit.sources.tables import CORRUPT, FILE, edge_feed, read_feed, readings

ENV = ("env_a", "env_b")
WINDOWS = (("6h", H6), ("12h", H12), ("24h", H24))
STATS = ("mean", "max", "min", "std", "count")


def node_cfg(**kw) -> telemetry.FeedConfig:
    base = dict(
        properties=NODE_PROPS, history_columns=HIST, targets=TARGETS,
        environment_columns=ENV, rolling_columns=ENV, max_fill_age="6h",
    )
    base.update(kw)
    return telemetry.FeedConfig(**base)


# --------------------------------------------------------------------- SQL --

def _pivot_sql(src: str) -> str:
    props = ",\n".join(f"    median(CASE WHEN property = '{p}' THEN value END) AS {p}" for p in NODE_PROPS)
    plist = ", ".join(f"'{p}'" for p in NODE_PROPS)
    return f"""SELECT backend, qubit, model_time,
{props},
    median(calibration_lag_hours) AS calibration_lag_hours
  FROM {src}
  WHERE qubit >= 0 AND property IN ({plist}) AND NOT regexp_matches(property, '^cz_error_(\\d+)_(\\d+)$')
  GROUP BY backend, qubit, model_time"""


def _last_obs_sql(cols=HIST, keys="backend, qubit", cap=H24) -> str:
    parts = []
    for c in cols:
        parts.append(f"last_value({c} IGNORE NULLS) OVER wlo AS {c}_last_obs")
        parts.append(
            f"(epoch_us(model_time) - last_value(CASE WHEN {c} IS NOT NULL THEN epoch_us(model_time) END IGNORE NULLS) OVER wlo)"
            f" / 3600000000.0 AS {c}_last_obs_age_hours"
        )
        parts.append(f"CAST({c} IS NULL AS INTEGER) AS {c}_was_missing")
    win = f"WINDOW wlo AS (PARTITION BY {keys} ORDER BY epoch_us(model_time) RANGE BETWEEN {cap} PRECEDING AND CURRENT ROW)"
    return ", ".join(parts), win


def _env_sql(src: str, fill: bool = True, rolling: bool = True) -> str:
    """environment CTE chain ending in `envf`."""
    med = f"env0 AS (SELECT backend, model_time, median(env_a) AS env_a, median(env_b) AS env_b FROM {src} GROUP BY backend, model_time)"
    if fill:
        ff = ", ".join(
            f"coalesce({c}, last_value({c} IGNORE NULLS) OVER (PARTITION BY backend ORDER BY epoch_us(model_time) "
            f"RANGE BETWEEN {H6} PRECEDING AND CURRENT ROW)) AS {c}" for c in ENV
        )
        filled = f"env1 AS (SELECT backend, model_time, {ff} FROM env0)"
    else:
        filled = "env1 AS (SELECT * FROM env0)"
    if not rolling:
        return f"{med},\n{filled},\nenvf AS (SELECT * FROM env1)"
    cols, wins = [], []
    for name, span in WINDOWS:
        wins.append(f"w{name} AS (PARTITION BY backend ORDER BY epoch_us(model_time) RANGE BETWEEN {span} PRECEDING AND 1 PRECEDING)")
    for c in ENV:
        cols.append(f"lag({c}) OVER (PARTITION BY backend ORDER BY model_time) AS {c}_last_prev")
        for name, _ in WINDOWS:
            w = f"w{name}"
            cols.append(f"CASE WHEN count({c}) OVER {w} >= 1 THEN avg({c}) OVER {w} END AS {c}_mean_prev_{name}")
            cols.append(f"CASE WHEN count({c}) OVER {w} >= 1 THEN max({c}) OVER {w} END AS {c}_max_prev_{name}")
            cols.append(f"CASE WHEN count({c}) OVER {w} >= 1 THEN min({c}) OVER {w} END AS {c}_min_prev_{name}")
            cols.append(f"CASE WHEN count({c}) OVER {w} >= 1 THEN stddev_pop({c}) OVER {w} END AS {c}_std_prev_{name}")
            cols.append(f"CASE WHEN count(*) OVER {w} >= 1 THEN CAST(count({c}) OVER {w} AS DOUBLE) END AS {c}_count_prev_{name}")
    roll = f"envf AS (SELECT *, {', '.join(cols)} FROM env1 WINDOW {', '.join(wins)})"
    return f"{med},\n{filled},\n{roll}"


def _round_all(cols: list[str]) -> str:
    return ", ".join(f"rnd({c}) AS {c}" for c in cols)


def _label_sql(src: str, targets=TARGETS) -> str:
    """label CTE chain over `src` (a wide node table) ending in `lab` (unfiltered)."""
    thr = ", ".join(
        f"CASE WHEN count({c}) OVER wt >= 10 THEN quantile_cont({c}, 0.95) OVER wt END AS {c}_threshold" for c in targets
    )
    fut = ", ".join(
        f"max({c}) OVER wf AS {c}_future_max_24h, CAST(count({c}) OVER wf AS INTEGER) AS {c}_future_obs_count_24h"
        for c in targets
    )
    flt = ", ".join(
        f"CASE WHEN {c}_future_max_24h IS NULL OR {c}_threshold IS NULL THEN NULL "
        f"ELSE CAST({c}_future_max_24h > {c}_threshold AS DOUBLE) END AS {c}_fault_24h" for c in targets
    )
    cnt = " + ".join(f"CAST({c}_future_obs_count_24h > 0 AS INTEGER)" for c in targets)
    great = f"greatest({', '.join(f'{c}_fault_24h' for c in targets)})" if len(targets) > 1 else f"{targets[0]}_fault_24h"
    return f"""th AS (SELECT *, {thr} FROM {src}
     WINDOW wt AS (PARTITION BY backend ORDER BY model_time, qubit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fu AS (SELECT *, {fut} FROM th
     WINDOW wf AS (PARTITION BY backend, qubit ORDER BY epoch_us(model_time) RANGE BETWEEN 1 FOLLOWING AND {H24} FOLLOWING)),
fl AS (SELECT *, {flt} FROM fu),
fc AS (SELECT *, {cnt} AS future_fault_target_count_24h FROM fl),
lab AS (SELECT *, CASE WHEN future_fault_target_count_24h = 0 THEN NULL ELSE {great} END AS fault_24h FROM fc)"""


def _flagship_sql() -> str:
    lo, win = _last_obs_sql()
    return f"""WITH r AS ({readings_sql(True)}),
wide AS ({_pivot_sql('r')}),
lo AS (SELECT *, {lo} FROM wide {win}),
{_label_sql('lo')}
SELECT * REPLACE ({_round_all(list(NODE_PROPS) + ['calibration_lag_hours'] + [f'{c}_last_obs' for c in HIST] + [f'{c}_last_obs_age_hours' for c in HIST] + [f'{c}_threshold' for c in TARGETS] + [f'{c}_future_max_24h' for c in TARGETS])})
FROM lab WHERE fault_24h IS NOT NULL"""


# ------------------------------------------------------------------ Spark --

def flagship(spark, sf_dir):
    """readings_h -> pivot median -> last observation (24 h cap) -> expanding 0.95
    threshold per group -> 24 h future max/count -> labels -> drop unlabelled."""
    cfg = node_cfg(environment_columns=())
    feed = readings(spark, sf_dir, hourly=True)
    return rounded(telemetry.labelled_snapshot(feed, None, cfg))


register("flagship_fault_labels", _flagship_sql())(flagship)


@register("s1_p3_parse_feed", f"""
SELECT backend, qubit, property, rnd(value) AS value, observed_time, calibrated_time, observed_time AS model_time,
       rnd(calibration_lag_hours) AS calibration_lag_hours
FROM ({readings_sql(False)})
WHERE backend IS NOT NULL AND qubit IS NOT NULL AND property IS NOT NULL AND observed_time IS NOT NULL AND value IS NOT NULL""")
def q_parse_feed(spark, sf_dir):
    """S1 + P2/P3 + F5/F6/F8: the feed as text (as a CSV/JSON source delivers it), parsed back."""
    r = readings(spark, sf_dir)
    raw = r.select(
        "backend", "qubit", "property",
        F.col("value").cast("string").alias("value"),
        F.date_format("observed_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("observed_time"),
        F.date_format("calibrated_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("calibrated_time"),
    )
    parsed = parse_feed(raw)
    return rounded(parsed.select("backend", "qubit", "property", "value", "observed_time", "calibrated_time",
                                 "model_time", "calibration_lag_hours"))


@register("a10_a11_parse_report", f"""
SELECT count(*) AS rows,
       CAST(0 AS BIGINT) AS observed_time_parse_failures, CAST(0 AS BIGINT) AS calibrated_time_parse_failures,
       CAST(0 AS BIGINT) AS value_parse_failures,
       rnd(avg(CAST(value IS NULL AS DOUBLE))) AS value_missing_rate_after_numeric_parse,
       rnd(avg(CAST(calibration_lag_hours IS NULL AS DOUBLE))) AS calibration_lag_hours_missing_rate,
       count(*) FILTER (WHERE calibration_lag_hours < 0) AS negative_calibration_lag_rows,
       count(*) FILTER (WHERE backend IS NULL OR qubit IS NULL OR property IS NULL OR observed_time IS NULL OR value IS NULL)
         AS dropped_structurally_invalid_rows
FROM ({readings_sql(False)})""")
def q_parse_report(spark, sf_dir):
    r = readings(spark, sf_dir)
    return rounded(parse_report(r))


# Breakages of the text feed, by event_id.
_MALFORMED, _BAD_TIME, _BAD_VALUE, _NO_PROPERTY = 101, 89, 97, 83
_TEXT_SQL = f"""x AS (SELECT *, event_id % {_MALFORMED} = 0 AS malformed, event_id % {_BAD_TIME} = 0 AS bad_time,
  event_id % {_BAD_VALUE} = 0 AS bad_value, event_id % {_NO_PROPERTY} = 0 AS no_property, CASE WHEN isnan(value) THEN NULL ELSE value END AS v,
  ts - to_minutes({K_EXPR}) AS calibrated_time FROM events)"""


def text_feed(spark, sf_dir):
    """``events`` written as CSV text, some records broken on purpose, and read back."""
    broken = lambda n: F.col("event_id") % n == 0
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    r = readings(spark, sf_dir, ids=("event_id",))
    fields = [
        F.col("backend").cast("string"), F.col("qubit").cast("string"), F.when(~broken(_NO_PROPERTY), F.col("property")),
        F.when(broken(_BAD_VALUE), F.lit("n/a")).otherwise(F.col("value").cast("string")),
        F.when(broken(_BAD_TIME), F.lit("not a time")).otherwise(text("observed_time")), text("calibrated_time"),
        F.when(broken(_MALFORMED), F.lit("one field,too many")),
    ]
    line = F.concat_ws(",", F.array_compact(F.array(*[F.coalesce(f, F.lit("")) for f in fields[:-1]], fields[-1])))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/text-feed-{uuid.uuid4().hex}"
    r.select(line.alias("value")).write.text(path)
    return read_feed(spark, path, "csv", "backend string, qubit string, property string, value string, observed_time string, calibrated_time string")


@register("s1_quarantine_reasons", f"""WITH {_TEXT_SQL},
q AS (SELECT CASE WHEN malformed THEN 'malformed record' WHEN bad_time THEN 'bad observed_time' WHEN bad_value THEN 'bad value'
  WHEN user_id IS NULL THEN 'missing backend' WHEN no_property OR event_type IS NULL THEN 'missing property' WHEN ts IS NULL THEN 'missing observed_time'
  WHEN v IS NULL THEN 'missing value' END AS reason FROM x)
SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY reason""")
def q_quarantine(spark, sf_dir):
    """Broken records of a CSV feed are kept with their file and reason."""
    rejected = quarantine(text_feed(spark, sf_dir)).where(F.length(FILE) > 0)
    return rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("a10_text_feed_report", f"""WITH {_TEXT_SQL}
SELECT count(*) AS rows, count(*) FILTER (WHERE bad_time) AS observed_time_parse_failures, CAST(0 AS BIGINT) AS calibrated_time_parse_failures,
  count(*) FILTER (WHERE bad_value) AS value_parse_failures,
  rnd(avg(CAST(v IS NULL OR bad_value AS DOUBLE))) AS value_missing_rate_after_numeric_parse,
  rnd(avg(CAST(bad_time OR ts IS NULL OR calibrated_time IS NULL AS DOUBLE))) AS calibration_lag_hours_missing_rate,
  count(*) FILTER (WHERE NOT bad_time AND calibrated_time > ts) AS negative_calibration_lag_rows,
  count(*) FILTER (WHERE user_id IS NULL OR no_property OR event_type IS NULL OR bad_time OR ts IS NULL OR bad_value OR v IS NULL) AS dropped_structurally_invalid_rows
FROM x WHERE NOT malformed""")
def q_text_report(spark, sf_dir):
    """A10: parse failures of the records that fit the schema."""
    raw = text_feed(spark, sf_dir)
    return rounded(parse_report(raw.where(F.col(CORRUPT).isNull()).drop(CORRUPT, FILE)))


@register("a1_environment_medians", f"""WITH r AS ({readings_sql(True)}), {_env_sql('r', fill=False, rolling=False)}
SELECT backend, model_time, rnd(env_a) AS env_a, rnd(env_b) AS env_b FROM envf""")
def q_env_medians(spark, sf_dir):
    return rounded(reshape.grouped_medians(readings(spark, sf_dir, hourly=True), ["backend", "model_time"], list(ENV)))


@register("w1_capped_forward_fill", f"""WITH r AS ({readings_sql(True)}), {_env_sql('r', fill=True, rolling=False)}
SELECT backend, model_time, rnd(env_a) AS env_a, rnd(env_b) AS env_b FROM envf""")
def q_ffill(spark, sf_dir):
    env = reshape.grouped_medians(readings(spark, sf_dir, hourly=True), ["backend", "model_time"], list(ENV))
    return rounded(causal.capped_forward_fill(env, ["backend"], "model_time", list(ENV), "6h"))


@register("w3_previous_value", f"""WITH r AS ({readings_sql(True)}), {_env_sql('r', fill=False, rolling=False)}
SELECT backend, model_time, rnd(env_a) AS env_a, rnd(env_b) AS env_b,
       rnd(lag(env_a) OVER (PARTITION BY backend ORDER BY model_time)) AS env_a_last_prev,
       rnd(lag(env_b) OVER (PARTITION BY backend ORDER BY model_time)) AS env_b_last_prev
FROM envf""")
def q_prev(spark, sf_dir):
    env = reshape.grouped_medians(readings(spark, sf_dir, hourly=True), ["backend", "model_time"], list(ENV))
    return rounded(causal.previous_value(env, ["backend"], "model_time", list(ENV), block_us=2 * 86_400_000_000))


def _env_cols():
    cols = ["env_a", "env_b"]
    for c in ENV:
        cols.append(f"{c}_last_prev")
        cols += [f"{c}_{s}_prev_{w}" for w, _ in WINDOWS for s in STATS]
    return cols


@register("w4_environment_rolling", f"""WITH r AS ({readings_sql(True)}), {_env_sql('r')}
SELECT backend, model_time, {_round_all(_env_cols())} FROM envf""")
def q_env_features(spark, sf_dir):
    return rounded(telemetry.environment_features(readings(spark, sf_dir, hourly=True), node_cfg()))


@register("w5_w6_rolling_median_closed_both", f"""WITH r AS ({readings_sql(True)}), {_env_sql('r', fill=False, rolling=False)}
SELECT backend, model_time, rnd(env_a) AS env_a, rnd(env_b) AS env_b,
  rnd(CASE WHEN count(env_b) OVER w >= 2 THEN quantile_cont(env_b, 0.5) OVER w END) AS env_b_median_prev_6h,
  rnd(CASE WHEN count(env_b) OVER w >= 2 THEN avg(env_b) OVER w END) AS env_b_mean_prev_6h,
  CASE WHEN count(*) OVER w >= 2 THEN CAST(count(env_b) OVER w AS DOUBLE) END AS env_b_count_prev_6h
FROM envf WINDOW w AS (PARTITION BY backend ORDER BY epoch_us(model_time) RANGE BETWEEN {H6} PRECEDING AND CURRENT ROW)""")
def q_rolling_median(spark, sf_dir):
    env = reshape.grouped_medians(readings(spark, sf_dir, hourly=True), ["backend", "model_time"], list(ENV))
    out = causal.rolling_features(env, ["backend"], "model_time", ["env_b"], ["6h"], ["median", "mean", "count"],
                                  closed="both", min_periods=2, include_last_previous_value=False)
    return rounded(out)


@register("a2_pivot_median", f"""WITH r AS ({readings_sql(True)}), wide AS ({_pivot_sql('r')})
SELECT backend, qubit, model_time, {_round_all(list(NODE_PROPS) + ['calibration_lag_hours'])} FROM wide""")
def q_pivot(spark, sf_dir):
    feed = readings(spark, sf_dir, hourly=True)
    rows = reshape.node_rows(feed, NODE_PROPS)
    return rounded(reshape.pivot_median(rows, ["backend", "qubit", "model_time"], NODE_PROPS,
                                        extra_medians=["calibration_lag_hours"]))


def _node_sql() -> str:
    lo, win = _last_obs_sql()
    return f"""WITH r AS ({readings_sql(True)}), wide AS ({_pivot_sql('r')}), {_env_sql('r')},
j AS (SELECT wide.*, {', '.join('envf.' + c for c in _env_cols())} FROM wide LEFT JOIN envf USING (backend, model_time)),
lo AS (SELECT *, {lo} FROM j {win})"""


_NODE_ROUND = list(NODE_PROPS) + ["calibration_lag_hours"] + _env_cols() + [f"{c}_last_obs" for c in HIST] + [
    f"{c}_last_obs_age_hours" for c in HIST]


@register("j1_w2_node_snapshot", f"""{_node_sql()}
SELECT * REPLACE ({_round_all(_NODE_ROUND)}) FROM lo""")
def q_node_snapshot(spark, sf_dir):
    cfg = node_cfg()  # env join: AQE broadcasts from runtime sizes, no extra counting job
    feed = readings(spark, sf_dir, hourly=True)
    env = telemetry.environment_features(feed, cfg)
    return rounded(telemetry.node_snapshot(feed, env, cfg))


@register("p16_w11_label_table", f"""{_node_sql()},
{_label_sql('lo')}
SELECT * REPLACE ({_round_all(_NODE_ROUND + [f'{c}_threshold' for c in TARGETS] + [f'{c}_future_max_24h' for c in TARGETS])})
FROM lab WHERE fault_24h IS NOT NULL""")
def q_label_table(spark, sf_dir):
    cfg = node_cfg()
    feed = readings(spark, sf_dir, hourly=True)
    env = telemetry.environment_features(feed, cfg)
    return rounded(telemetry.labelled_snapshot(feed, env, cfg))


@register("w7_expanding_threshold", f"""WITH r AS ({readings_sql(True)}), wide AS ({_pivot_sql('r')})
SELECT backend, qubit, model_time, rnd(error) AS error,
  rnd(CASE WHEN count(error) OVER wt >= 10 THEN quantile_cont(error, 0.95) OVER wt END) AS error_threshold
FROM wide WINDOW wt AS (PARTITION BY backend ORDER BY model_time, qubit ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def q_threshold(spark, sf_dir):
    feed = readings(spark, sf_dir, hourly=True)
    wide = reshape.pivot_median(reshape.node_rows(feed, NODE_PROPS), ["backend", "qubit", "model_time"], ["error"])
    return rounded(expanding_quantile(wide, ["backend"], ["model_time", "qubit"], ["error"], 0.95, 10, rows_per_block=500))


@register("w8_future_horizon", f"""WITH r AS ({readings_sql(True)}), wide AS ({_pivot_sql('r')})
SELECT backend, qubit, model_time, rnd(error) AS error, rnd(view) AS view,
  rnd(max(error) OVER wf) AS error_future_max_24h, CAST(count(error) OVER wf AS INTEGER) AS error_future_obs_count_24h,
  rnd(max(view) OVER wf) AS view_future_max_24h, CAST(count(view) OVER wf AS INTEGER) AS view_future_obs_count_24h
FROM wide WINDOW wf AS (PARTITION BY backend, qubit ORDER BY epoch_us(model_time) RANGE BETWEEN 1 FOLLOWING AND {H24} FOLLOWING)""")
def q_future(spark, sf_dir):
    feed = readings(spark, sf_dir, hourly=True)
    wide = reshape.pivot_median(reshape.node_rows(feed, NODE_PROPS), ["backend", "qubit", "model_time"], ["error", "view"])
    return rounded(labels.future_horizon(wide, ["backend", "qubit"], "model_time", ["error", "view"], "24h"))


_EDGE_ENV = ["env_a", "env_b"]


@register("p5_a4_edge_snapshot", f"""WITH r AS ({EDGES_SQL}), {_env_sql('r', fill=True, rolling=False)},
e AS (SELECT backend, CAST(regexp_extract(property, '^cz_error_(\\d+)_(\\d+)$', 1) AS INTEGER) AS q1,
             CAST(regexp_extract(property, '^cz_error_(\\d+)_(\\d+)$', 2) AS INTEGER) AS q2, model_time, value, calibration_lag_hours
      FROM r WHERE regexp_matches(property, '^cz_error_(\\d+)_(\\d+)$')),
m AS (SELECT backend, q1, q2, model_time, median(value) AS cz_error, median(calibration_lag_hours) AS calibration_lag_hours
      FROM e GROUP BY backend, q1, q2, model_time)
SELECT m.backend, m.q1, m.q2, m.model_time, rnd(cz_error) AS cz_error, rnd(calibration_lag_hours) AS calibration_lag_hours,
       rnd(envf.env_a) AS env_a, rnd(envf.env_b) AS env_b
FROM m LEFT JOIN envf USING (backend, model_time)""")
def q_edge_snapshot(spark, sf_dir):
    cfg = node_cfg(rolling_columns=())
    feed = edge_feed(spark, sf_dir)
    env = telemetry.environment_features(feed, cfg)
    return rounded(telemetry.edge_snapshot(feed, env, cfg))


@register("a9_a8_edge_counts", f"""WITH r AS ({EDGES_SQL}),
e AS (SELECT backend, CAST(regexp_extract(property, '^cz_error_(\\d+)_(\\d+)$', 1) AS INTEGER) AS q1,
             CAST(regexp_extract(property, '^cz_error_(\\d+)_(\\d+)$', 2) AS INTEGER) AS q2, model_time
      FROM r WHERE regexp_matches(property, '^cz_error_(\\d+)_(\\d+)$'))
SELECT count(*) AS edge_long_rows,
       (SELECT count(*) FROM (SELECT DISTINCT backend, q1, q2 FROM e)) AS edge_unique_directed_edges,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT backend, q1, q2, model_time FROM e)) AS duplicate_key_rows
FROM e""")
def q_edge_counts(spark, sf_dir):
    from driftkit.operators import profile
    rows = reshape.edge_rows(edge_feed(spark, sf_dir))
    return profile.key_counts(rows, ["backend", "q1", "q2"], "model_time",
                              names=("edge_long_rows", "edge_unique_directed_edges", "duplicate_key_rows"))


@register("w10_autoregressive_lag", f"""WITH r AS ({readings_sql(True)}), wide AS ({_pivot_sql('r')}),
k AS (SELECT backend, qubit, model_time, error FROM wide WHERE error IS NOT NULL),
l AS (SELECT *, lag(error) OVER (PARTITION BY backend, qubit ORDER BY model_time) AS error_prev FROM k)
SELECT backend, qubit, model_time, rnd(error) AS error, rnd(error_prev) AS error_prev
FROM l WHERE error_prev IS NOT NULL""")
def q_ar_lag(spark, sf_dir):
    feed = readings(spark, sf_dir, hourly=True)
    wide = reshape.pivot_median(reshape.node_rows(feed, NODE_PROPS), ["backend", "qubit", "model_time"], ["error"])
    return rounded(causal.autoregressive_lag(wide, ["backend", "qubit"], "model_time", "error", block_us=3 * 86_400_000_000))
