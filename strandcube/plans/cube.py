"""Declarative cube: a fact, its dimensions and measures, and the OLAP operations on them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcube.functions.aggregates import exact
from strandcube.functions.values import ratio
from strandcube.session import cut


@dataclass(frozen=True)
class Dimension:
    """A dimension table, its key (same name in the fact) and its levels from coarse to fine."""

    table: DataFrame
    key: str
    levels: tuple[str, ...]
    #: Rows up to which the table is broadcast; larger ones are left to the optimizer.
    broadcast_rows: int = 500_000


@dataclass(frozen=True)
class Additive:
    """A measure made of parts that add up over any split of the rows, so that it can be had from a finer cuboid.

    ``parts`` maps names to (aggregate over fact rows, aggregate over parts);
    ``finish`` makes the measure from the parts.
    """

    parts: Mapping[str, tuple[Column, Callable[[str], Column]]]
    finish: Callable[..., Column]

    def column(self) -> Column:
        return self.finish(*[agg for agg, _ in self.parts.values()])


def rows_of() -> Additive:
    return Additive({"n": (F.count(F.lit(1)), F.sum)}, lambda n: n)


def total_of(c: str) -> Additive:
    return Additive({f"sum_{c}": (F.sum(c), F.sum)}, lambda x: x)


def exact_total_of(c: str) -> Additive:
    return Additive({f"total_{c}": (F.sum(exact(F.col(c))), F.sum)}, lambda x: x.cast("double"))


def mean_of(c: str) -> Additive:
    return Additive({f"total_{c}": (F.sum(exact(F.col(c))), F.sum), f"count_{c}": (F.count(c), F.sum)}, lambda x, n: ratio(x.cast("double"), n))


def percent_of(flag: str) -> Additive:
    return Additive({f"sum_{flag}": (F.sum(flag), F.sum), f"count_{flag}": (F.count(flag), F.sum)}, lambda x, n: ratio(x.cast("double") * 100, n))


def greatest_of(c: str) -> Additive:
    return Additive({f"max_{c}": (F.max(c), F.max)}, lambda x: x)


@dataclass
class Cube:
    """Operations return lazy frames; only the dimensions that an operation names are joined.

    Measures are aggregates, or :class:`Additive` ones, which :meth:`roll_up` can
    also take from a stored cuboid. ``cuboids`` maps sets of levels to the parts
    stored for them.
    """

    fact: DataFrame
    dimensions: Mapping[str, Dimension]
    measures: Mapping[str, Column | Additive]
    cuboids: dict[frozenset[str], DataFrame] = field(default_factory=dict)

    def _owner(self, level: str) -> str | None:
        return next((n for n, d in self.dimensions.items() if level in d.levels), None)

    def star(self, levels: Sequence[str]) -> DataFrame:
        """The fact inner-joined with the dimensions that hold ``levels``."""
        out = self.fact
        for name in dict.fromkeys(filter(None, map(self._owner, levels))):
            d = self.dimensions[name]
            need = [d.key, *[x for x in d.levels if x in levels and x != d.key]]
            right = d.table.select(*need)
            clash = [c for c in need if c != d.key and c in out.columns]
            out = out.drop(*clash).join(_bounded(d.table, right, d.broadcast_rows), d.key)
        return out

    def _column(self, name: str) -> Column:
        m = self.measures[name]
        return (m.column() if isinstance(m, Additive) else m).alias(name)

    def _aggs(self, names: Sequence[str] | None) -> list[Column]:
        return [self._column(n) for n in (names or self.measures)]

    def roll_up(self, levels: Sequence[str], measures: Sequence[str] | None = None) -> DataFrame:
        """Aggregate to ``levels``: from the stored cuboid of the fewest levels that holds them and the parts of the measures, else from the fact."""
        names = list(measures or self.measures)
        asked = [self.measures[n] for n in names]
        if all(isinstance(m, Additive) for m in asked):
            fit = [(len(k), sorted(k), c) for k, c in self.cuboids.items() if k >= set(levels) and all(p in c.columns for m in asked for p in m.parts)]
            if fit:
                ready = min(fit, key=lambda x: x[:2])[2]
                return ready.groupBy(*levels).agg(*[m.finish(*[again(p) for p, (_, again) in m.parts.items()]).alias(n) for n, m in zip(names, asked, strict=True)])
        return self.star(levels).groupBy(*levels).agg(*self._aggs(names))

    def slice(self, level: str, value: object, by: Sequence[str], measures: Sequence[str] | None = None) -> DataFrame:
        """One level fixed."""
        return self.dice({level: [value]}, by, measures)

    drill_down = slice

    def dice(self, where: Mapping[str, Sequence | tuple], by: Sequence[str], measures: Sequence[str] | None = None) -> DataFrame:
        """Several levels restricted: a list means membership, a ``range``-like tuple ('between', a, b) an inclusive span."""
        rows = self.star([*where, *by])
        for level, v in where.items():
            if isinstance(v, tuple) and v[:1] == ("between",):
                rows = rows.where(F.col(level).between(v[1], v[2]))
            else:
                rows = rows.where(F.col(level).isin(*v))
        return rows.groupBy(*by).agg(*self._aggs(measures))

    def pivot(self, rows: Sequence[str], column: str, values: Sequence, measure: str, prefix: str = "", fill: object = None) -> DataFrame:
        """Values of one level as columns ``prefix + value``; absent combinations are NULL or ``fill``."""
        named = F.concat(F.lit(prefix), F.col(column).cast("string"))
        out = self.star([*rows, column]).withColumn("_p", named)
        names = [f"{prefix}{v}" for v in values]
        out = out.groupBy(*rows).pivot("_p", names).agg(self._column(measure))
        return out if fill is None else out.fillna(fill, names)

    def cube(self, levels: Sequence[str], measures: Sequence[str] | None = None, margin: str = "ALL") -> DataFrame:
        """All combinations of ``levels`` with margins, in one pass; a margin reads ``margin``, a NULL level stays NULL."""
        out = self.star(levels).cube(*levels).agg(*self._aggs(measures), *[F.grouping(x).alias(f"_g_{x}") for x in levels])
        return out.select(*[F.when(F.col(f"_g_{x}") == 1, F.lit(margin)).otherwise(F.col(x).cast("string")).alias(x) for x in levels], *(measures or self.measures))

    def top(self, level: Sequence[str], measure: str, n: int, measures: Sequence[str] | None = None) -> DataFrame:
        """The n groups with the greatest measure; ties go by level."""
        return self.roll_up(level, measures).orderBy(F.desc(measure), *level).limit(n)

    def compare(self, bucket: Column, name: str, levels: Sequence[str] = (), measures: Sequence[str] | None = None) -> DataFrame:
        """Aggregate by an expression over the star of ``levels``."""
        return self.star(levels).withColumn(name, bucket).groupBy(name).agg(*self._aggs(measures))

    def materialise(self, levels: Sequence[str], measures: Sequence[str] | None = None, path: str | None = None) -> DataFrame:
        """Store the cuboid of ``levels`` as parts (sums and counts, not averages) and return its measures.

        It is written to ``path`` as Parquet, or without one into the shared
        checkpoint folder.
        """
        asked = [self.measures[n] for n in (measures or self.measures)]
        parts = {p: agg for m in asked if isinstance(m, Additive) for p, (agg, _) in m.parts.items()}
        if not all(isinstance(m, Additive) for m in asked):
            raise ValueError("a stored cuboid takes additive measures only")
        rows = self.star(levels).groupBy(*levels).agg(*[agg.alias(p) for p, agg in parts.items()])
        if path is None:
            stored = cut(rows)
        else:
            rows.write.mode("overwrite").parquet(path)
            stored = rows.sparkSession.read.parquet(path)
        self.cuboids[frozenset(levels)] = stored
        return self.roll_up(levels, measures)


#: Rows of dimension tables as counted before, by their files and size.
_COUNTED: dict[tuple, int] = {}


def _bounded(table: DataFrame, side: DataFrame, rows: int) -> DataFrame:
    """``side`` (columns of ``table``) with a broadcast hint if ``table`` is counted to hold at most ``rows`` rows; files are counted once."""
    files = tuple(table.inputFiles())
    key = (*files, str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), rows)
    n = _COUNTED.get(key) if files else None
    if n is None:
        n = table.limit(rows + 1).count()
        if files:
            _COUNTED[key] = n
    return F.broadcast(side) if n <= rows else side
