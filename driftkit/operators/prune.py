"""Column pruning (P8-P13).  Steps that decide the schema from data run ONE
aggregate action and return ``(frame, dropped)``; name rules need no job."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID_COLUMNS = ("backend", "qubit", "q1", "q2", "model_time")


def low_information_columns(df: DataFrame, protected: Iterable[str] = (), id_cols: Iterable[str] = ID_COLUMNS) -> dict:
    """P8 statistics: all-NULL and constant (<= 1 distinct non-NULL value) columns.

    One aggregation: count, min, max per candidate; constant <=> min = max."""
    skip = set(protected) | set(id_cols)
    cand = [c for c in df.columns if c not in skip]
    if not cand:
        return {"all_missing": [], "constant": []}
    aggs = []
    for i, c in enumerate(cand):
        aggs += [F.count(c).alias(f"n{i}"), (F.min(c) == F.max(c)).alias(f"eq{i}")]
    r = df.agg(*aggs).first()
    all_missing = sorted(c for i, c in enumerate(cand) if r[f"n{i}"] == 0)
    constant = sorted(c for i, c in enumerate(cand) if r[f"n{i}"] > 0 and r[f"eq{i}"])
    return {"all_missing": all_missing, "constant": constant}


def drop_low_information_columns(df: DataFrame, protected: Iterable[str] = (), id_cols: Iterable[str] = ID_COLUMNS):
    """Drop all-missing and constant columns except ids and protected ones."""
    stats = low_information_columns(df, protected, id_cols)
    to_drop = stats["all_missing"] + stats["constant"]
    return (df.drop(*to_drop) if to_drop else df), stats


def missingness_by_column(df: DataFrame, cols: Sequence[str]) -> dict:
    r = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    return {c: float(r[f"m{i}"]) if r[f"m{i}"] is not None else 1.0 for i, c in enumerate(cols)}


def drop_high_missingness(df: DataFrame, threshold: float = 0.30, keep: Iterable[str] = (), fit_on: DataFrame | None = None):
    """Drop feature columns whose NULL rate is > ``threshold`` (measured on
    ``fit_on``, default the frame itself, as the source workflow does)."""
    keep = set(keep)
    src = fit_on if fit_on is not None else df
    cand = [c for c in src.columns if c not in keep]
    rates = missingness_by_column(src, cand) if cand else {}
    dropped = sorted(c for c, r in rates.items() if r > threshold)
    return (df.drop(*dropped) if dropped else df), {"dropped": dropped, "rates": rates}


# What in a column name shows that it looks ahead of its row; {label} is the target.
LOOKS_AHEAD = [
    ("ends with", "_{label}"),
    ("starts with", "future_"),
    ("holds", "_future_"),
    ("holds", "future_fault"),
]
NAME_TESTS = {"ends with": str.endswith, "starts with": str.startswith, "holds": str.__contains__}


def looks_ahead(name: str, target: str = "fault_24h") -> bool:
    """P10: a column other than the target to which one of the rules applies."""
    label = target.lower()
    return name != target and any(NAME_TESTS[how](name.lower(), text.format(label=label)) for how, text in LOOKS_AHEAD)


def drop_leakage(df: DataFrame, target: str = "fault_24h") -> DataFrame:
    """P10."""
    return df.select(*[c for c in df.columns if not looks_ahead(c, target)])


def drop_count_and_instant(df: DataFrame, instant: Sequence[str]) -> DataFrame:
    """Drop rolling ``_count_`` columns and the instantaneous target columns."""
    return df.select(*[c for c in df.columns if "_count_" not in c and c not in set(instant)])


def keep_rolling_suffixes(df: DataFrame, variables: Sequence[str], keep_suffixes: Iterable[str] = ("_mean_prev_24h", "_std_prev_24h")) -> DataFrame:
    """P12 as a schema rule: of the columns derived from a variable (its name, then a
    suffix) the schema keeps the listed ones; other columns are untouched."""
    derived = re.compile("(" + "|".join(map(re.escape, variables)) + ")(_.*)") if variables else None
    allowed = {v + s for v in variables for s in keep_suffixes} | set(variables)
    return df.select(*[c for c in df.columns if c in allowed or derived is None or not derived.fullmatch(c)])


def select_available(df: DataFrame, ids: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Ids + the requested features that exist + target."""
    cols = [c for c in list(ids) + list(features) + [target] if c in df.columns]
    return df.select(*dict.fromkeys(cols))
