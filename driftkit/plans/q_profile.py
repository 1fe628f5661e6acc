"""Registered profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftkit.operators import profile, reshape
from driftkit.plans import telemetry
from driftkit.plans.catalog import NODE_PROPS, readings_sql, register, rounded
from driftkit.plans.q_telemetry import _env_sql, _label_sql, _node_sql, _pivot_sql, node_cfg
from driftkit.session import cut_lineage
from driftkit.sources.tables import read_table, readings

PIVOT_COLS = list(NODE_PROPS) + ["calibration_lag_hours"]


def _pivot(spark, sf_dir):
    feed = readings(spark, sf_dir, hourly=True)
    return reshape.pivot_median(reshape.node_rows(feed, NODE_PROPS), ["backend", "qubit", "model_time"], NODE_PROPS,
                                extra_medians=["calibration_lag_hours"])


_MISS_UNION = "\n  UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", avg(CAST({c} IS NULL AS DOUBLE)) AS missing_rate FROM wide" for c in
    ["backend", "qubit", "model_time"] + PIVOT_COLS)


@register("a5_missing_rates", f"""WITH r AS ({readings_sql(True)}), wide AS ({_pivot_sql('r')}),
m AS ({_MISS_UNION})
SELECT "column", rnd(missing_rate) AS missing_rate FROM m WHERE missing_rate > 0""")
def q_missing(spark, sf_dir):
    return rounded(profile.missing_rates(_pivot(spark, sf_dir)))


@register("a6_value_counts_top20", """SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY l_suppkey
ORDER BY count DESC, l_suppkey ASC NULLS FIRST LIMIT 20""")
def q_value_counts(spark, sf_dir):
    return profile.value_counts(read_table(spark, sf_dir, "lineitem"), "l_suppkey", top=20)


@register("a7_range_profile", f"""SELECT min(qubit) AS min, max(qubit) AS max, count(DISTINCT qubit) AS nunique
FROM ({readings_sql(False)})""")
def q_range(spark, sf_dir):
    return profile.range_profile(readings(spark, sf_dir), "qubit")


@register("a12_shape", f"""WITH r AS ({readings_sql(True)}), wide AS ({_pivot_sql('r')})
SELECT count(*) AS rows, {3 + len(PIVOT_COLS)} AS cols FROM wide""")
def q_shape(spark, sf_dir):
    return profile.shape(_pivot(spark, sf_dir))


@register("a14_class_balance", f"""{_node_sql()},
{_label_sql('lo')}
SELECT CAST(sum(fault_24h) AS BIGINT) AS positives, count(fault_24h) AS total, rnd(avg(fault_24h)) AS positive_rate,
       min(model_time) AS time_min, max(model_time) AS time_max
FROM lab WHERE fault_24h IS NOT NULL""")
def q_class_balance(spark, sf_dir):
    cfg = node_cfg()
    feed = readings(spark, sf_dir, hourly=True)
    env = telemetry.environment_features(feed, cfg)
    lab = telemetry.labelled_snapshot(feed, env, cfg)
    return rounded(profile.class_balance(lab, "fault_24h", "model_time"))


def _y(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_extendedprice") / 1000.0).alias("y"), "l_returnflag", "l_quantity", "l_discount",
                     "l_tax", "l_linenumber")


_Y_SQL = "SELECT l_extendedprice / 1000.0 AS y, l_returnflag, l_quantity, l_discount, l_tax, l_linenumber FROM lineitem"


def _summary_sql(expr: str, label: str) -> str:
    return f"""SELECT '{label}' AS scale, count({expr}) AS n, rnd(avg({expr})) AS mean, rnd(median({expr})) AS median,
  rnd(stddev_samp({expr})) AS std, rnd(skewness({expr})) AS skewness, rnd(kurtosis({expr})) AS kurtosis,
  rnd(min({expr})) AS min, rnd(max({expr})) AS max FROM yv"""


@register("a15_univariate_summary", f"""WITH yv AS ({_Y_SQL})
{_summary_sql('y', 'raw')}
UNION ALL
{_summary_sql('CASE WHEN y > 0 THEN ln(y) END', 'log')}""")
def q_summary(spark, sf_dir):
    return rounded(profile.univariate_summary(_y(spark, sf_dir), "y"))


@register("a16_five_number_by_group", f"""WITH yv AS ({_Y_SQL}),
q AS (SELECT l_returnflag, count(y) AS n, quantile_cont(y, [0.0, 0.25, 0.5, 0.75, 1.0]) AS p FROM yv WHERE y IS NOT NULL GROUP BY l_returnflag)
SELECT l_returnflag, n, rnd(p[1]) AS min, rnd(p[2]) AS q1, rnd(p[3]) AS median, rnd(p[4]) AS q3, rnd(p[5]) AS max FROM q""")
def q_five(spark, sf_dir):
    return rounded(profile.five_number_by_group(_y(spark, sf_dir), "y", "l_returnflag"))


@register("a17_histogram_80", f"""WITH yv AS ({_Y_SQL}),
b AS (SELECT min(y) AS lo, max(y) AS hi FROM yv),
h AS (SELECT least(CAST(floor((y - lo) / ((hi - lo) / 80)) AS INTEGER), 79) AS bin, lo, (hi - lo) / 80 AS w
      FROM yv, b WHERE y IS NOT NULL)
SELECT bin, rnd(max(lo) + bin * max(w)) AS bin_lo, rnd(max(lo) + (bin + 1) * max(w)) AS bin_hi, count(*) AS count
FROM h GROUP BY bin""")
def q_hist(spark, sf_dir):
    return rounded(profile.histogram(_y(spark, sf_dir), "y", 80))


def _binned_sql() -> str:
    probs = ", ".join(repr((k + 1) / 21) for k in range(20))
    return f"""WITH yv AS ({_Y_SQL}),
c AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [{probs}]))) AS cs FROM yv),
m AS (SELECT cs, list_transform(range(1, len(cs)), lambda i: (cs[i] + cs[i + 1]) / 2) AS mids FROM c),
f AS (SELECT regr_slope(y, l_quantity) AS slope, regr_intercept(y, l_quantity) AS intercept FROM yv),
b AS (SELECT y, CAST(len(list_filter(mids, lambda md: l_quantity > md)) AS INTEGER) AS bin, cs FROM yv, m
      WHERE l_quantity IS NOT NULL AND y IS NOT NULL)
SELECT bin, rnd(avg(y)) AS y_mean, rnd(stddev_samp(y)) AS y_std, count(*) AS n, rnd(any_value(cs)[bin + 1]) AS x_centre,
       rnd(1.959963984540054 * stddev_samp(y) / sqrt(count(*))) AS ci_half,
       rnd(any_value(f.slope)) AS fit_slope, rnd(any_value(f.intercept)) AS fit_intercept
FROM b, f GROUP BY bin"""


@register("a18_binned_profile", _binned_sql())
def q_binned(spark, sf_dir):
    return rounded(profile.binned_profile(_y(spark, sf_dir), "l_quantity", "y", 20))


_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@register("a19_target_correlations", "WITH yv AS (" + _Y_SQL + "),\nc AS (" + "\n  UNION ALL ".join(
    f"SELECT '{f}' AS feature, corr({f}, y) AS pearson_r, count(*) FILTER (WHERE {f} IS NOT NULL AND y IS NOT NULL) AS n, "
    f"avg(CAST({f} IS NULL AS DOUBLE)) * 100 AS missing_pct FROM yv" for f in _FEATS) + """)
SELECT feature, rnd(pearson_r) AS pearson_r, rnd(abs(pearson_r)) AS abs_pearson_r, rnd(missing_pct) AS missing_pct
FROM c WHERE n >= 10""")
def q_corr_target(spark, sf_dir):
    return rounded(profile.target_correlations(_y(spark, sf_dir), "y", _FEATS))


_ROLL = ["env_a_mean_prev_6h", "env_a_mean_prev_12h", "env_a_mean_prev_24h",
         "env_b_mean_prev_6h", "env_b_mean_prev_12h", "env_b_mean_prev_24h",
         "env_a_count_prev_6h", "env_a_count_prev_12h", "env_a_count_prev_24h"]


def _env_features(spark, sf_dir):
    """The environment table, stored once: correlations read it for the means and again for the products."""
    return cut_lineage(telemetry.environment_features(readings(spark, sf_dir, hourly=True), node_cfg()).select(*_ROLL))


def _corr_pairs_sql() -> str:
    parts = []
    for i, a in enumerate(_ROLL):
        for b in _ROLL[i:]:
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM envf")
            if a != b:
                parts.append(f"SELECT '{b}' AS a, '{a}' AS b, corr({a}, {b}) AS r FROM envf")
    return "\n  UNION ALL ".join(parts)


@register("a20_correlation_matrix", f"""WITH r AS ({readings_sql(True)}), {_env_sql('r')},
cm AS ({_corr_pairs_sql()})
SELECT a, b, rnd(r) AS r FROM cm""")
def q_corr_matrix(spark, sf_dir):
    return rounded(profile.correlation_matrix(_env_features(spark, sf_dir), _ROLL))


_POS = ", ".join(f"('{c}', {i})" for i, c in enumerate(_ROLL))


@register("a21_high_correlation_pairs", f"""WITH r AS ({readings_sql(True)}), {_env_sql('r')},
cm AS ({_corr_pairs_sql()}), pos(name, i) AS (VALUES {_POS})
SELECT a, b, rnd(r) AS r FROM cm JOIN pos pa ON pa.name = a JOIN pos pb ON pb.name = b
WHERE pa.i < pb.i AND abs(r) > 0.8 AND abs(r) < 1.0""")
def q_high_corr(spark, sf_dir):
    cm = profile.correlation_matrix(_env_features(spark, sf_dir), _ROLL)
    return rounded(profile.high_correlation_pairs(cm, 0.8, 1.0, _ROLL))
