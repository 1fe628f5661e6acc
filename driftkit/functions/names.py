"""Column-name sanitiser (F1), usable on Python strings and on string columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source workflow's rule for identical names:
# runs of whitespace, "/" and "-" become "_"; parentheses are removed; any other
# character outside [0-9A-Za-z_] becomes "_"; repeated "_" collapse; leading and
# trailing "_" are stripped; an empty result becomes "unnamed".
EMPTY_NAME = "unnamed"
RULES = (
    (r"^\s+|\s+$", ""),
    (r"[\s/\-]+", "_"),
    (r"[()]+", ""),
    (r"[^0-9A-Za-z_]+", "_"),
    (r"_+", "_"),
    (r"^_+|_+$", ""),
)


def sanitize_name(value: object) -> str:
    """The rule table on a Python string."""
    return reduce(lambda text, rule: re.sub(*rule, text), RULES, str(value)) or EMPTY_NAME


def sanitize_name_col(c: Column | str) -> Column:
    """The rule table as a JVM-side expression."""
    done = reduce(lambda x, rule: F.regexp_replace(x, *rule), RULES, F.col(c) if isinstance(c, str) else c)
    return F.coalesce(F.nullif(done, F.lit("")), F.lit(EMPTY_NAME))
