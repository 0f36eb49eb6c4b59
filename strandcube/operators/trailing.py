"""Rolling totals over trailing periods by binary doubling.

Daily sums per entity are laid out over every calendar day, then blocks of
1, 2, 4, 8, ... days are built by adding a block to the one before it; a window
of any length is the sum of the blocks in its binary expansion, each shifted
behind the previous one. A window of w days costs O(log w) additions per row, all
over one sort by (entity, day).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandcube.functions.values import ratio


def dense_days(daily: DataFrame, entity: str, day: str) -> DataFrame:
    """``entity, day`` for each calendar day from an entity's first to its last; NULL entities and days are left out."""
    span = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(entity).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return span.select(entity, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))


def fill_days(daily: DataFrame, entity: str, day: str, sums: Sequence[str]) -> DataFrame:
    """The daily rows plus one row per idle day (sums 0, ``is_idle`` 1). ``daily`` has one row per entity and day."""
    days = dense_days(daily, entity, day)
    got = daily.select(F.col(entity).alias("_e"), F.col(day).alias("_d"), *sums)
    out = days.join(got, (days[entity] == got["_e"]) & (days[day] == got["_d"]), "left")
    return out.select(entity, day, *[F.coalesce(F.col(c), F.lit(0).cast(daily.schema[c].dataType)).alias(c) for c in sums], F.col("_e").isNull().cast("int").alias("is_idle"))


def trailing_totals(daily: DataFrame, entity: str, day: str, sums: Sequence[str], windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Totals of each column in ``sums`` over the last w days (the day itself included), for w in ``windows``.

    ``daily`` has one row per entity and day with the day's sums (see
    :func:`daily_sums`); days without a row count as 0 and appear in the result.
    Returns ``entity, day, is_idle, <sums>, <sum>_<w>d``. Before an entity's first
    day nothing is added. Entities are calendar-bounded (one row a day), so no
    group grows with the number of records. Empty input gives no rows.
    """
    if any(w < 1 for w in windows):
        raise ValueError("windows are positive numbers of days")
    out = fill_days(daily, entity, day, sums)
    w = Window.partitionBy(entity).orderBy(day)
    top = max(windows, default=1)
    sizes = [1]
    while sizes[-1] * 2 <= top:
        sizes.append(sizes[-1] * 2)
    zero = {c: F.lit(0).cast(daily.schema[c].dataType) for c in sums}
    shifted = lambda name, c, k: F.coalesce(F.lag(name, k).over(w), zero[c]) if k else F.col(name)
    out = out.withColumns({f"_{c}_1": F.col(c) for c in sums})
    for a in sizes[1:]:
        out = out.withColumns({f"_{c}_{a}": F.col(f"_{c}_{a // 2}") + shifted(f"_{c}_{a // 2}", c, a // 2) for c in sums})
    made = {}
    for span in windows:
        for c in sums:
            total, behind = None, 0
            for a in reversed(sizes):
                if span & a:
                    part = shifted(f"_{c}_{a}", c, behind)
                    total, behind = part if total is None else total + part, behind + a
            made[f"{c}_{span}d"] = total
    out = out.withColumns(made)
    return out.select(entity, day, "is_idle", *sums, *made)


def daily_sums(facts: DataFrame, entity: str, day: str, totals: dict[str, str], means: Sequence[str] = (), rows: str | None = None) -> DataFrame:
    """One row per entity and day: ``totals`` maps output names to summed columns; for each column in ``means`` also ``n_<column>``, its number of values; ``rows`` names a count of all rows."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in totals.items()]
    aggs += [F.count(c).alias(f"n_{c}") for c in means]
    aggs += [F.count(F.lit(1)).alias(rows)] if rows else []
    return facts.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(entity, day).agg(*aggs)


def latest_load(facts: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per key combination, the one loaded last (greatest ``order``); other columns go."""
    last = F.max(F.struct(*order, *values)).alias("_last")
    return facts.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


__all__ = ["daily_sums", "dense_days", "fill_days", "latest_load", "ratio", "trailing_totals"]
