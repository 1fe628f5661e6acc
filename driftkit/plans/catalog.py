"""Query catalogue: every registered query and its DuckDB twin.

Each query takes ``(spark, sf_dir)`` and reads the supplied tables through the
views in ``driftkit.sources.tables``; each oracle is independent plain SQL over
the same tables.  Computed doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Comparison normalisation (final projection only, identical on both sides):
# doubles are shifted by NUDGE and rounded to PLACES decimals.  Decimal-valued
# data often has means that sit exactly on a rounding tie (e.g. 4.1141875); the
# shift, far above summation-order noise and far below the last kept digit,
# sends both engines' results to the same side of the tie.
NUDGE = 1e-9
PLACES = 6


def expand_rnd(sql: str) -> str:
    """Rewrite ``rnd(expr)`` into ``round((expr) + NUDGE, PLACES)`` (balanced parentheses)."""
    out, i = [], 0
    while True:
        j = sql.find("rnd(", i)
        if j < 0 or (j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 4])
            i = j + 4
            continue
        depth, k = 1, j + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = expand_rnd(sql[j + 4:k - 1])
        out.append(sql[i:j] + f"round(({inner}) + {NUDGE}, {PLACES})")
        i = k


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = expand_rnd(sql)
        return fn

    return deco


def rnd_col(c):
    return F.round(c + F.lit(NUDGE), PLACES)


def rounded(df: DataFrame) -> DataFrame:
    """Normalise every double column for comparison (final projection only).
    Built as one ``selectExpr`` (one call for all columns)."""
    exprs = []
    for f in df.schema.fields:
        name = "`" + f.name.replace("`", "``") + "`"
        if isinstance(f.dataType, (DoubleType, FloatType)):
            exprs.append(f"round(CAST({name} AS DOUBLE) + CAST({NUDGE!r} AS DOUBLE), {PLACES}) AS {name}")
        else:
            exprs.append(name)
    return df.selectExpr(*exprs)


# ---------------------------------------------------------------------------
# Shared SQL fragments for the oracle side (DuckDB dialect).
# ---------------------------------------------------------------------------

K_EXPR = """TRY_CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER)"""

READINGS_SQL = f"""
  SELECT user_id % 3 AS backend, user_id AS qubit, event_type AS property,
         CASE WHEN isnan(value) THEN NULL ELSE value END AS value,
         ts AS observed_time,
         ts - to_minutes(k) AS calibrated_time,
         {{model_time}} AS model_time,
         CASE WHEN k % 7 <> 0 THEN CAST(k AS DOUBLE) END AS env_a,
         value / 10.0 AS env_b,
         date_diff('microsecond', ts - to_minutes(k), ts) / 3600000000.0 AS calibration_lag_hours
  FROM (SELECT *, {K_EXPR} AS k FROM events)
"""


def readings_sql(hourly: bool) -> str:
    return READINGS_SQL.format(model_time="date_trunc('hour', ts)" if hourly else "ts")


EDGES_SQL = """
  SELECT l_returnflag AS backend, -1 AS qubit,
         'cz_error_' || CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS property,
         CASE WHEN isnan(l_discount) THEN NULL ELSE l_discount END AS value,
         l_shipdate AS observed_time,
         l_shipdate - to_hours(l_linenumber) AS calibrated_time,
         l_shipdate AS model_time,
         l_quantity AS env_a, l_tax * 100.0 AS env_b,
         date_diff('microsecond', l_shipdate - to_hours(l_linenumber), l_shipdate) / 3600000000.0 AS calibration_lag_hours
  FROM lineitem
"""

NODE_PROPS = ("click", "error", "purchase", "signup", "view")
HIST = ("click", "error")
TARGETS = ("error", "purchase")
H24 = 86_400_000_000
H6 = 21_600_000_000
H12 = 43_200_000_000
