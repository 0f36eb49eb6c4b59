"""Aggregates whose result does not depend on the order of the rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandcube.functions.values import ratio


#: Decimal places kept of each value; nine are more than a measurement has.
PLACES = 9


def exact(c: Column, digits: int = 28) -> Column:
    """The value as a decimal of ``PLACES`` places."""
    return c.cast(f"decimal({digits},{PLACES})")


def exact_sum(c: Column) -> Column:
    """Sum as a double, added up as decimals: any split of the rows gives the same bits."""
    return F.sum(exact(c)).cast("double")


def exact_avg(c: Column) -> Column:
    return ratio(exact_sum(c), F.count(c))


def share(c: Column) -> Column:
    """Percent of rows with flag 1 among those with a flag."""
    return ratio(F.sum(c).cast("double") * 100, F.count(c))
