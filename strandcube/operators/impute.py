"""Filling missing values from similar records.

Numbers: mixed-effects prediction (group x slot effects shrunk towards group and
slot, plus an hour effect common to all groups). Categories: a multinomial model
with a shrunken hour effect and a shrunken group effect on the log scale. Filled
values are marked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcube.functions.labels import fold_column
from strandcube.functions.values import present
from strandcube.operators.effects import BROADCAST_CELLS, BROADCAST_TIMES, Effects, Field, fit_effects, hour_of, observations
from strandcube.session import cut, small


@dataclass(frozen=True)
class Category:
    """A text field and its vocabulary. ``hour_weight`` and ``group_weight`` are the readings as which the prior counts."""

    name: str
    labels: tuple[str, ...]
    hour_weight: float = 2.0
    group_weight: float = 200.0


def label_tally(label: Column, labels: Sequence[str]) -> dict[str, Column]:
    """One count per label, for :func:`~strandcube.operators.effects.fit_effects` to take along."""
    return {f"_c{i}": (label == x).cast("double") for i, x in enumerate(labels)}


def predict_category(df: DataFrame, cat: Category, effects: Effects) -> DataFrame:
    """Adds ``_fill`` to ``df`` (with _g, _t, _label): the label of the highest posterior; ties go to the label first in the vocabulary.

    ``effects`` holds the counts of :func:`label_tally` per group and per time.
    """
    label, n = F.col("_label"), len(cat.labels)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    by_t = effects.time_tally.select("_t", *[zero(f"_c{i}").alias(f"_ct{i}") for i in range(n)])
    by_g = cut(effects.group_tally.select("_g", *[zero(f"_c{i}").alias(f"_cg{i}") for i in range(n)]))
    row = by_g.agg(*[F.sum(f"_cg{i}") for i in range(n)]).first()
    seen = [float(x or 0) + 0.5 for x in row]
    share = [x / sum(seen) for x in seen]
    by_t._counted = effects.times._counted
    out = df.join(small(by_t, BROADCAST_TIMES), "_t", "left").join(small(by_g, BROADCAST_CELLS), "_g", "left")
    n_t, n_g = sum((zero(f"_ct{i}") for i in range(n)), F.lit(0.0)), sum((zero(f"_cg{i}") for i in range(n)), F.lit(0.0))
    scores = []
    for i, p in enumerate(share):
        hour = F.log((zero(f"_ct{i}") + cat.hour_weight * p) / (n_t + cat.hour_weight))
        group = F.log((zero(f"_cg{i}") + cat.group_weight * p) / (n_g + cat.group_weight)) - log(p)
        scores.append(F.struct((hour + group).alias("s"), F.lit(-i).alias("o"), F.lit(cat.labels[i]).alias("l")))
    pick = F.when(label.isNull(), F.array_max(F.array(*scores))["l"])
    return out.withColumn("_fill", pick).drop(*[f"_ct{i}" for i in range(n)], *[f"_cg{i}" for i in range(n)])


def fill_missing(df: DataFrame, group: str, ts: str, fields: Sequence[Field], category: Category | None = None, usable: Column | None = None) -> DataFrame:
    """``df`` with missing values of ``fields`` and ``category`` filled, and ``<field>_filled`` (0/1) for each.

    A number is missing if it is NULL or not a number; an impossible number is
    kept, but not learned from. A label is missing if it is NULL, blank or names
    no label of the vocabulary; labels that do name one come out in its spelling.
    ``usable`` marks the rows to learn the numbers from. Rows without group or
    time get the part of the prediction that is known (at last the grand mean). A
    field without any usable value is filled with its range's end nearest to
    zero. Columns named like a mask are replaced; other columns, repeated rows
    included, pass through. Empty input gives no rows.
    """
    raw = {c: f"_raw{i}" for i, c in enumerate(df.columns)}
    keep = [F.col(c).alias(x) for c, x in raw.items()]
    obs = observations(df, F.col(group), F.col(ts), fields, usable, keep)
    tally = {}
    if category is not None:
        obs = fold_column(obs, raw[category.name], category.labels, "_label")
        tally = label_tally(F.col("_label"), category.labels)
    effects = fit_effects(obs, fields, tally=tally)
    out = effects.attach(obs)
    made: dict[str, Column] = {}
    for f in fields:
        value = present(F.col(raw[f.name]))
        made[f.name] = F.coalesce(value, f.unscaled(F.col(f"m_{f.name}")))
        made[f"{f.name}_filled"] = value.isNull().cast("int")
    if category is not None:
        out = predict_category(out, category, effects)
        made[category.name] = F.coalesce("_label", "_fill")
        made[f"{category.name}_filled"] = F.col("_label").isNull().cast("int")
    plain = [F.col(x).alias(c) for c, x in raw.items() if c not in made]
    return out.select(*plain, *[e.alias(n) for n, e in made.items()])


def filled_cells(filled: DataFrame, row_id: str, names: Sequence[str]) -> DataFrame:
    """``row_id, field_name`` of each filled value in the result of :func:`fill_missing`, once per row id."""
    cell = lambda n: F.struct(F.lit(n).alias("n"), (F.col(f"{n}_filled") == 1).alias("m"), F.col(n).cast("string").alias("v"))
    cells = filled.select(row_id, F.explode(F.filter(F.array(*[cell(n) for n in names]), lambda c: c["m"] & c["v"].isNotNull())).alias("_c"))
    return cells.select(row_id, F.col("_c.n").alias("field_name")).distinct()


__all__ = ["Category", "Field", "fill_missing", "filled_cells", "hour_of", "label_tally", "predict_category"]
