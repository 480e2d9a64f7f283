"""Small column expressions shared by operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c, lo: float, hi: float) -> Column:
    """``np.clip`` with NULL passing through (greatest/least skip NULLs)."""
    c = _col(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def nan_to_default(c, default=0.0) -> Column:
    """NaN and NULL -> default (``nan_to_num`` / ``if x is None``)."""
    c = _col(c)
    return F.coalesce(F.nanvl(c, F.lit(None).cast("double")), F.lit(default))


def safe_ratio(a, b, eps: float = 1e-15) -> Column:
    """``a / (b + eps)`` — the guarded ratio of the engineered features."""
    return _col(a) / (_col(b) + F.lit(eps))


def count_substring(text, sub: str) -> Column:
    """Non-overlapping occurrences of ``sub`` (same as Python ``str.count``)."""
    t = _col(text)
    return ((F.length(t) - F.length(F.replace(t, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("bigint")


def round6(c) -> Column:
    return F.round(_col(c), 6)
