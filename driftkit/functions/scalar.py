"""Scalar column helpers (F2-F11): parsing, time arithmetic, binning, flags.

All are built-in expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
# a clock time followed by an offset or a zone name
_ZONED = r"\d{1,2}:\d{2}.*([+-]\d{1,2}(:?\d{2})?|[A-Za-z]\S*)$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_double(c: Column | str) -> Column:
    """F8: numeric coercion; unparseable -> NULL and NaN -> NULL (one missing concept)."""
    x = _c(c).try_cast("double")
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def nan_to_null(c: Column | str) -> Column:
    x = _c(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def to_timestamp_ntz(c: Column | str) -> Column:
    """parse a time as UTC whatever the session zone; bad text -> NULL.

    Text with a zone is converted to UTC, text without one is UTC already.  The
    instant is turned into wall time by arithmetic, so no step passes through the
    session zone (and its skipped or doubled hours)."""
    s = F.trim(_c(c).cast("string"))
    zoned = s.rlike(_ZONED)
    instant = F.coalesce(
        F.when(zoned, F.try_to_timestamp(s)),
        F.when(~zoned, F.try_to_timestamp(F.concat(s, F.lit("Z")))),
        F.when(~zoned, F.try_to_timestamp(F.concat(s, F.lit(" 00:00:00Z")))),
    )
    return utc_wall(instant)


def utc_wall(instant: Column) -> Column:
    """UTC wall time (TIMESTAMP_NTZ) of a TIMESTAMP, independent of the session zone."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def epoch_micros(c: Column | str) -> Column:
    """Microseconds since 1970 for a TIMESTAMP_NTZ, independent of the session zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), _c(c))


def hours_between(later: Column | str, earlier: Column | str) -> Column:
    """(later - earlier) in fractional hours, microsecond exact."""
    return F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)) / F.lit(float(MICROS_PER_HOUR))


def truncate_hour(c: Column | str) -> Column:
    """Truncate a TIMESTAMP_NTZ to the hour without passing through the session zone."""
    x = _c(c)
    return x - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(x), F.date_part(F.lit("SECOND"), x))


def regex_match(c: Column | str, pattern: str) -> Column:
    """anchored regex test (pattern carries its own anchors)."""
    return _c(c).rlike(pattern)


def regex_int(c: Column | str, pattern: str, group: int) -> Column:
    """capture group as int; no match -> NULL."""
    x = F.regexp_extract(_c(c), pattern, group)
    return F.when(_c(c).rlike(pattern), x.cast("int"))


def log_positive(c: Column | str) -> Column:
    """natural log for positive values, NULL otherwise."""
    return F.when(_c(c) > 0, F.ln(_c(c)))


def sqrt_abs(c: Column | str) -> Column:
    return F.sqrt(F.abs(_c(c)))


def clip(c: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    x = _c(c)
    if lo is not None:
        x = F.greatest(x, F.lit(lo))
    if hi is not None:
        x = F.least(x, F.lit(hi))
    return x


def two_class_bin(c: Column | str, cut: float, low: str = "low_error", high: str = "high_or_failed") -> Column:
    """<= cut -> low label, > cut -> high label, NULL stays NULL."""
    x = _c(c)
    return F.when(x.isNull(), F.lit(None).cast("string")).when(x <= cut, F.lit(low)).otherwise(F.lit(high))


def missing_flag(c: Column | str) -> Column:
    """1 when NULL, else 0."""
    return _c(c).isNull().cast("int")


def score_or_neg_inf(c: Column | str) -> Column:
    """NaN/NULL scores rank last."""
    x = _c(c)
    return F.when(x.isNull() | F.isnan(x), F.lit(float("-inf"))).otherwise(x)
