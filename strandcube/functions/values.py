"""Expressions on numeric values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: Column) -> Column:
    """The value, with not-a-number as NULL."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def clip(c: Column, lo: float, hi: float) -> Column:
    """Clipped value; NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, NULL where ``b`` is 0 or NULL."""
    return a / F.nullif(b, F.lit(0))
