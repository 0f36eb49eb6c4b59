"""Measure layer: named measures evaluated under filters and group levels, over several facts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcube.functions.aggregates import exact_avg, exact_sum
from strandcube.functions.values import ratio


@dataclass(frozen=True)
class Measure:
    """``expr`` aggregates rows of ``fact``; ``override`` columns lose their outer filters, as the measure sets its own."""

    name: str
    fact: str
    expr: Callable[[], Column]
    override: tuple[str, ...] = ()


@dataclass(frozen=True)
class Derived:
    """A measure computed from other measures."""

    name: str
    needs: tuple[str, ...]
    expr: Callable[[], Column]


@dataclass(frozen=True)
class Shifted:
    """Another measure as it was ``months`` months before the dates of the context."""

    name: str
    of: str
    months: int = 1


@dataclass(frozen=True)
class Trailing:
    """The mean of another measure's daily values over the last ``days`` days up to the last date of the context; days without rows are skipped."""

    name: str
    of: str
    days: int = 7


#: Columns that follow from a row's date; measures over other dates lose their outer filters on them.
CALENDAR = {
    "date": lambda d: d, "year": F.year, "quarter": F.quarter, "month": F.month, "month_name": lambda d: F.date_format(d, "MMMM"), "week_of_year": F.weekofyear,
    "day_of_month": F.dayofmonth, "day_of_week": F.weekday, "day_name": lambda d: F.date_format(d, "EEEE"), "is_weekend": lambda d: (F.weekday(d) >= 5).cast("int"),
}


@dataclass
class MeasureModel:
    """Facts (already joined with their dimensions) and the measures on them.

    Facts that time measures are asked of have a column ``date``.
    """

    facts: Mapping[str, DataFrame]
    measures: Sequence[Measure]
    derived: Sequence[Derived] = field(default_factory=tuple)
    timed: Sequence[Shifted | Trailing] = field(default_factory=tuple)

    def query(self, names: Sequence[str], by: Sequence[str] = (), where: Mapping[str, Sequence] | None = None) -> DataFrame:
        """The named measures per combination of ``by``, under the filters ``where`` (column -> allowed values).

        Each fact is filtered and aggregated by itself; results are joined on the
        group levels (NULL equal to NULL), so a group seen by one fact only has
        NULL measures of the other. A filter on a column a measure overrides, or
        that its fact lacks, does not apply to it. Time measures are given for the
        groups that the facts show under the filters; without any time measure in
        ``by`` the context is all dates left by the filters.
        """
        base = {m.name: m for m in self.measures}
        derived = {d.name: d for d in self.derived}
        timed = {t.name: t for t in self.timed}
        need = list(dict.fromkeys(x for n in names for x in (derived[n].needs if n in derived else (n,))))
        over = [timed[n] for n in need if n in timed]
        plain = list(dict.fromkeys([n for n in need if n in base] + [t.of for t in over]))
        groups: dict[tuple, list[Measure]] = {}
        for n in plain:
            m = base[n]
            groups.setdefault((m.fact, self._live(m, where)), []).append(m)
        out = None
        for (fact, live), ms in groups.items():
            part = _under(self.facts[fact], live, where).groupBy(*by).agg(*[m.expr().alias(m.name) for m in ms])
            out = part if out is None else _merge(out, part, by)
        for t in over:
            m = base[t.of]
            part = self._shifted(t, m, by, where) if isinstance(t, Shifted) else self._trailing(t, m, by, where)
            out = _merge(out, part, by, "left")
        out = out.withColumns({n: derived[n].expr() for n in names if n in derived})
        return out.select(*by, *names)

    def _live(self, m: Measure, where: Mapping[str, Sequence] | None) -> tuple[str, ...]:
        cols = self.facts[m.fact].columns
        return tuple(sorted(c for c in (where or {}) if c in cols and c not in m.override))

    def _shifted(self, t: Shifted, m: Measure, by: Sequence[str], where: Mapping[str, Sequence] | None) -> DataFrame:
        """The rows are moved to the dates they are asked for, with all that follows from a date; groups and filters then apply to them."""
        fact = self.facts[m.fact]
        later = F.add_months("date", t.months)
        moved = fact.withColumns({c: make(later) for c, make in CALENDAR.items() if c in fact.columns})
        return _under(moved, self._live(m, where), where).groupBy(*by).agg(m.expr().alias(t.name))

    def _trailing(self, t: Trailing, m: Measure, by: Sequence[str], where: Mapping[str, Sequence] | None) -> DataFrame:
        """Daily values per group without its dates, met by the days up to each group's last date."""
        fact, live = self.facts[m.fact], self._live(m, where)
        fixed = [c for c in by if c not in CALENDAR]
        daily = _under(fact, [c for c in live if c not in CALENDAR], where).groupBy(*fixed, "date").agg(m.expr().alias("_v"))
        daily = daily.select(*[F.col(c).alias(f"_f_{c}") for c in fixed], F.col("date").alias("_day"), "_v")
        last = _under(fact, live, where).groupBy(*by).agg(F.max("date").alias("_last"))
        days = last.withColumn("_day_", F.explode(F.sequence(F.date_sub("_last", t.days - 1), "_last")))
        on = F.col("_day_") == F.col("_day")
        for c in fixed:
            on = on & F.col(c).eqNullSafe(F.col(f"_f_{c}"))
        return days.join(daily, on).groupBy(*by).agg(F.avg("_v").alias(t.name))


def _under(rows: DataFrame, live: Sequence[str], where: Mapping[str, Sequence] | None) -> DataFrame:
    for c in live:
        rows = rows.where(F.col(c).isin(*where[c]))
    return rows


def _merge(a: DataFrame, b: DataFrame, by: Sequence[str], how: str = "full") -> DataFrame:
    if not by:
        one = {"_one": F.lit(1)}
        return a.withColumns(one).join(F.broadcast(b.withColumns(one)), "_one").drop("_one")  # one row each
    r = b.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[c for c in b.columns if c not in by])
    on = None
    for c in by:
        one = a[c].eqNullSafe(r[f"_r_{c}"])
        on = one if on is None else on & one
    j = a.join(r, on, how)
    return j.select(*[F.coalesce(c, f"_r_{c}").alias(c) for c in by], *[c for c in a.columns if c not in by], *[c for c in b.columns if c not in by])


def when(flag: str, value: object, c: str) -> Column:
    return F.when(F.col(flag) == value, F.col(c))


def count_where(cond: Column) -> Column:
    return F.sum(F.coalesce(cond, F.lit(False)).cast("bigint"))


TRAFFIC = (
    Measure("observations", "traffic", lambda: F.count(F.lit(1))),
    Measure("avg_congestion", "traffic", lambda: exact_avg(F.col("congestion_index"))),
    Measure("peak_congestion", "traffic", lambda: F.max("congestion_index")),
    Measure("avg_speed", "traffic", lambda: exact_avg(F.col("avg_speed_kmph"))),
    Measure("avg_speed_ratio", "traffic", lambda: exact_avg(F.col("speed_ratio"))),
    Measure("avg_travel_time", "traffic", lambda: exact_avg(F.col("travel_time_min"))),
    Measure("avg_delay_index", "traffic", lambda: exact_avg(F.col("delay_index"))),
    Measure("vehicle_km_total", "traffic", lambda: exact_sum(F.col("vehicle_km"))),
    Measure("congested_hours", "traffic", lambda: count_where(F.col("is_congested") == 1)),
    Measure("avg_congestion_adverse", "traffic", lambda: exact_avg(when("is_adverse", 1, "congestion_index")), ("is_adverse",)),
    Measure("avg_congestion_dry", "traffic", lambda: exact_avg(when("is_adverse", 0, "congestion_index")), ("is_adverse",)),
    Measure("avg_congestion_peak", "traffic", lambda: exact_avg(when("is_peak_hour", 1, "congestion_index")), ("is_peak_hour",)),
    Measure("avg_congestion_offpeak", "traffic", lambda: exact_avg(when("is_peak_hour", 0, "congestion_index")), ("is_peak_hour",)),
)
INCIDENTS = (
    Measure("incidents", "incident", lambda: F.count(F.lit(1))),
    Measure("major_incidents", "incident", lambda: count_where(F.col("is_major") == 1)),
    Measure("avg_severity", "incident", lambda: exact_avg(F.col("severity"))),
    Measure("avg_response_time", "incident", lambda: exact_avg(F.col("response_time_min"))),
    Measure("avg_incident_duration", "incident", lambda: exact_avg(F.col("duration_min"))),
    Measure("casualties_total", "incident", lambda: F.sum("casualties")),
)
MINING = (
    Measure("anomalies", "anomaly", lambda: F.count(F.lit(1))),
    Measure("agreed_anomalies", "anomaly", lambda: count_where(F.col("agreement") == 1)),
    Measure("unexplained_anomalies", "anomaly", lambda: count_where((F.col("agreement") == 1) & (F.col("incident_count") == 0))),
    Measure("forecast_mae", "forecast", lambda: F.avg(F.abs(F.col("actual") - F.col("predicted")))),
    Measure("persistence_mae", "forecast", lambda: F.avg(F.abs(F.col("actual") - F.col("persistence")))),
    Measure("rules", "rule", lambda: F.count(F.lit(1))),
    Measure("max_lift", "rule", lambda: F.max("lift")),
    Measure("segments_clustered", "cluster", lambda: F.count(F.lit(1))),
)
_c = F.col
DERIVED = (
    Derived("congested_hours_pct", ("congested_hours", "observations"), lambda: ratio(_c("congested_hours"), _c("observations"))),
    Derived("major_incident_pct", ("major_incidents", "incidents"), lambda: ratio(_c("major_incidents"), _c("incidents"))),
    Derived("incidents_per_1k_hours", ("incidents", "observations"), lambda: ratio(_c("incidents"), _c("observations")) * 1000),
    Derived("wet_weather_penalty", ("avg_congestion_adverse", "avg_congestion_dry"), lambda: _c("avg_congestion_adverse") - _c("avg_congestion_dry")),
    Derived("peak_offpeak_ratio", ("avg_congestion_peak", "avg_congestion_offpeak"), lambda: ratio(_c("avg_congestion_peak"), _c("avg_congestion_offpeak"))),
    Derived("avg_congestion_mom", ("avg_congestion", "avg_congestion_pm"), lambda: ratio(_c("avg_congestion") - _c("avg_congestion_pm"), _c("avg_congestion_pm"))),
    Derived("incidents_mom", ("incidents", "incidents_pm"), lambda: ratio(_c("incidents") - _c("incidents_pm"), _c("incidents_pm"))),
    Derived("forecast_lift_pct", ("forecast_mae", "persistence_mae"), lambda: ratio(_c("persistence_mae") - _c("forecast_mae"), _c("persistence_mae"))),
)
TIMED = (Shifted("avg_congestion_pm", "avg_congestion"), Shifted("incidents_pm", "incidents"), Trailing("avg_congestion_7d", "avg_congestion"))
