"""Column-expression helpers (all JVM-side built-ins, no UDF).

These carry the null/zero rules of the analyses:
* a ratio with a zero (or null) denominator is null (``safe_div``);
* ``greatest``/``clip`` keep a null input null (pandas keeps NaN, while
  ``F.greatest`` would skip the null and return the bound);
* min-max scaling returns a fixed value when the range is flat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """num / den, null when den is 0 or null (never raises under ANSI)."""
    d = col(den)
    return F.when(d != 0, col(num) / d)


def quarter_year(q: str | Column) -> Column:
    """Year of a YYYYQ quarter code (int)."""
    return (col(q) / 10).cast("int")


def quarter_of_year(q: str | Column) -> Column:
    """Quarter-of-year digit of a YYYYQ code."""
    return (col(q) % 10).cast("int")


def clip_lower(c: str | Column, lo: float) -> Column:
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(lo)))


def minmax_scale(x: str | Column, lo: str | Column, hi: str | Column,
                 scale: float = 100.0, flat: float = 50.0) -> Column:
    """(x - lo) / (hi - lo) * scale, or ``flat`` when hi == lo."""
    x, lo, hi = col(x), col(lo), col(hi)
    return F.when(hi != lo, (x - lo) / (hi - lo) * F.lit(scale)).otherwise(F.lit(flat))


def count_true(conds: list[Column]) -> Column:
    """Number of conditions that hold (false/null count as 0)."""
    return reduce(lambda a, b: a + b, [F.when(c, 1).otherwise(0) for c in conds])


def up_count(cols: list[str]) -> Column:
    """Number of rises between consecutive columns (not necessarily in a row)."""
    return count_true([F.col(b) > F.col(a) for a, b in zip(cols, cols[1:])])


def mean_of(cols: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in cols]) / F.lit(float(len(cols)))


def known(c: str | Column, unknown: str) -> Column:
    """Dimension value present and not the 'unknown' sentinel."""
    x = col(c)
    return x.isNotNull() & (x != unknown)
