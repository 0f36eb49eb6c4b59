"""Mixed group and time effects of measurements, fitted by robust rounds of sums.

The model of a value of group g in slot k (hour of the week's two kinds of day)
and hour t is

    y = cell(g, k) + b(t) + noise,

with the cell mean shrunk towards group and slot means and b(t) shrunk towards
0, each by its estimated variance component. All that is ever shuffled are
partial sums per (g, k) and per t; no group of rows is collected. The cell table
has 48 rows per group and the time table one row per hour, so both are small
next to the rows; they are broadcast only if counted to be under a bound.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandcube.functions.values import clip, present
from strandcube.session import cut, small

#: Cell rows (about 150 bytes each) and time rows up to these numbers are broadcast.
BROADCAST_CELLS = 300_000
BROADCAST_TIMES = 300_000
SLOTS = 48


@dataclass(frozen=True)
class Field:
    """A measurement: its possible range, and the offset of its log scale (None: used as it is)."""

    name: str
    lo: float
    hi: float
    offset: float | None = None

    def scaled(self, c: Column) -> Column:
        """The value on the model's scale; NULL if missing, not a number or impossible."""
        v = present(c)
        v = F.when(v.between(self.lo, self.hi), v)
        return v if self.offset is None else F.log(v + self.offset)

    def unscaled(self, c: Column) -> Column:
        v = c if self.offset is None else F.exp(c) - self.offset
        return clip(v, self.lo, self.hi)


def hour_of(ts: Column) -> Column:
    return F.date_trunc("hour", ts)


def slot_of(ts: Column) -> Column:
    """0-23 on working days, 24-47 at weekends."""
    return (F.hour(ts) + F.when(F.weekday(ts) >= 5, 24).otherwise(0)).cast("int")


@dataclass
class Effects:
    """Fitted tables: ``cells`` (_g, _k, m_<f>, s_<f>, sg_<f>), ``times`` (_t, b_<f>) and the grand mean and spread per field.

    ``group_tally`` (_g) and ``time_tally`` (_t) hold the sums of the tallied columns over all rows.
    """

    fields: Sequence[Field]
    cells: DataFrame
    times: DataFrame
    grand: dict[str, tuple[float, float]]
    group_tally: DataFrame
    time_tally: DataFrame

    def attach(self, df: DataFrame) -> DataFrame:
        """``df`` (with _g, _t, _k) plus m_<f> (expected value on the model's scale), s_<f> (its usual deviation)."""
        out = df.join(small(self.cells, BROADCAST_CELLS), ["_g", "_k"], "left").join(small(self.times, BROADCAST_TIMES), "_t", "left")
        made = {}
        for f in self.fields:
            mu, sd = self.grand[f.name]
            made[f"m_{f.name}"] = F.coalesce(f"m_{f.name}", F.lit(mu)) + F.coalesce(f"b_{f.name}", F.lit(0.0))
            made[f"s_{f.name}"] = F.coalesce(f"s_{f.name}", F.lit(sd))
        return out.withColumns(made).drop(*[f"{p}_{f.name}" for f in self.fields for p in ("b", "sg")])


def observations(df: DataFrame, group: Column, ts: Column, fields: Sequence[Field], usable: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """``_g, _t, _k, _ok`` and y_<f> for each field, with the columns in ``keep``."""
    ok = F.lit(True) if usable is None else F.coalesce(usable, F.lit(True))
    return df.select(group.alias("_g"), hour_of(ts).alias("_t"), slot_of(ts).alias("_k"), ok.alias("_ok"), *[f.scaled(F.col(f.name)).alias(f"y_{f.name}") for f in fields], *keep)


def _cells(sums: DataFrame, fields: Sequence[Field], pool: float) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Shrunken cell means and pooled spreads from n, sum and sum of squares per cell."""
    g, k = Window.partitionBy("_g"), Window.partitionBy("_k")
    step = sums
    for f in fields:
        n, s, q = F.col(f"n_{f.name}"), F.col(f"t_{f.name}"), F.col(f"q_{f.name}")
        within = F.greatest(F.when(n > 0, q - s * s / n).otherwise(0.0), F.lit(0.0))
        step = step.withColumn(f"w_{f.name}", within)
    aggs = []
    for f in fields:
        n, s, w = F.col(f"n_{f.name}"), F.col(f"t_{f.name}"), F.col(f"w_{f.name}")
        aggs += [F.sum(n).alias(f"N_{f.name}"), F.sum(s).alias(f"S_{f.name}"), F.sum(w).alias(f"W_{f.name}"), F.sum((n > 0).cast("int")).alias(f"C_{f.name}")]
        aggs += [F.sum(F.when(n > 0, s * s / n)).alias(f"B_{f.name}")]
    row = step.agg(*aggs).first().asDict()
    grand, shrink = {}, {}
    for f in fields:
        n, s, w, c = (row[f"{x}_{f.name}"] or 0 for x in "NSWC")
        mu = s / n if n else 0.0
        noise = w / max(n - c, 1)
        between = max(((row[f"B_{f.name}"] or 0) - n * mu * mu) / n - c * noise / n, 0.0) if n else 0.0
        grand[f.name] = (mu, max(noise, 1e-12) ** 0.5)
        shrink[f.name] = min(noise / between, 100.0) if between > 0 else 100.0
    # Slot profile over all groups (48 rows); the first fallback is group mean + slot profile.
    slots = step.groupBy("_k").agg(*[F.expr(f"sum(t_{f.name}) / nullif(sum(n_{f.name}), 0)").alias(f"k_{f.name}") for f in fields])
    step = step.join(F.broadcast(slots), "_k")
    out = {}
    for f in fields:
        mu, sd = grand[f.name]
        n, s, w = F.col(f"n_{f.name}"), F.col(f"t_{f.name}"), F.col(f"w_{f.name}")
        n_g = F.sum(n).over(g)
        slot_part = F.coalesce(F.col(f"k_{f.name}"), F.lit(mu)) - mu
        # group deviation from the slots it was seen in
        dev = F.sum(s - n * (slot_part + mu)).over(g)
        fallback = mu + slot_part + dev / (n_g + shrink[f.name])
        var_g = F.greatest((F.sum(w).over(g) + pool * sd * sd) / (F.greatest(n_g - F.sum((n > 0).cast("int")).over(g), F.lit(0)) + pool), F.lit(sd * sd * 1e-2))
        out[f"m_{f.name}"] = (s + shrink[f.name] * fallback) / (n + shrink[f.name])
        out[f"s_{f.name}"] = F.sqrt((w + pool * var_g) / (F.greatest(n - 1, F.lit(0)) + pool))
        out[f"sg_{f.name}"] = F.sqrt(var_g)
    made = step.select("_g", "_k", *[e.alias(name) for name, e in out.items()])
    return cut(made.where(F.col("_g").isNotNull() & F.col("_k").isNotNull())), grand


def _sums(obs: DataFrame, values: Mapping[str, Column], tally: Mapping[str, Column]) -> DataFrame:
    aggs = [F.sum(c).alias(name) for name, c in tally.items()]
    for name, v in values.items():
        aggs += [F.count(v).cast("double").alias(f"n_{name}"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"t_{name}"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias(f"q_{name}")]
    return cut(obs.groupBy("_g", "_k").agg(*aggs))


def _usable(name: str) -> Column:
    return F.when(F.col("_ok"), F.col(f"y_{name}"))


def fit_effects(obs: DataFrame, fields: Sequence[Field], rounds: int = 2, pool: float = 20.0, time_prior: float = 4.0, tally: Mapping[str, Column] | None = None) -> Effects:
    """Fit :class:`Effects` to :func:`observations`.

    Each round takes cell means of the values, without those that lie more than
    3 deviations from the previous fit, then the mean clipped
    deviation per hour. Only values of rows with ``_ok`` are fitted. ``pool`` is
    the weight of the group's spread in a cell's spread, ``time_prior`` the number
    of readings as which "no effect" counts in an hour. Columns in ``tally`` (none
    named like another column of the fit) are summed over all rows in the passes of
    the first round, so they cost no pass of their own.
    """
    extra = dict(tally or {})
    effects: Effects | None = None
    for _ in range(rounds):
        if effects is None:
            values = {f.name: _usable(f.name) for f in fields}
            base = obs
        else:
            base = obs.join(small(effects.cells, BROADCAST_CELLS), ["_g", "_k"], "left").join(small(effects.times, BROADCAST_TIMES), "_t", "left")
            values = {}
            for f in fields:
                m, sg = F.col(f"m_{f.name}"), F.col(f"sg_{f.name}")
                rest = _usable(f.name) - F.coalesce(f"b_{f.name}", F.lit(0.0))
                values[f.name] = F.when(F.abs(rest - m) < 3 * sg, rest)
        sums = _sums(base, values, extra if effects is None else {})
        cells, grand = _cells(sums.drop(*extra), fields, pool)
        near = obs.join(small(cells, BROADCAST_CELLS), ["_g", "_k"], "left")
        if effects is not None:
            near = near.join(small(effects.times, BROADCAST_TIMES), "_t", "left")
        aggs = [F.sum(c).alias(name) for name, c in extra.items()] if effects is None else []
        for f in fields:
            # clipped around the last round's effect, so that a strong effect is not clipped away
            centre = F.lit(0.0) if effects is None else F.coalesce(f"b_{f.name}", F.lit(0.0))
            sg = F.col(f"sg_{f.name}")
            r = clip((_usable(f.name) - F.col(f"m_{f.name}") - centre) / sg, -2.5, 2.5) * sg + centre
            aggs.append((F.coalesce(F.sum(r), F.lit(0.0)) / (F.count(r) + time_prior)).alias(f"b_{f.name}"))
        times = cut(near.where(F.col("_t").isNotNull()).groupBy("_t").agg(*aggs))
        if effects is None:
            by_group = sums.where(F.col("_g").isNotNull()).groupBy("_g").agg(*[F.sum(c).alias(c) for c in extra], F.lit(1).alias("_one")).drop("_one")
            tallies = (by_group, times.select("_t", *extra))
        plain = times.drop(*extra)
        plain._counted = times._counted
        effects = Effects(fields, cells, plain, grand, *tallies)
    return effects
