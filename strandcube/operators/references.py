"""References to records that do not exist (or not yet, or no longer).

The distinct foreign keys of the facts, with the span of load times under which
they occur, are anti-joined against the parents. Only keys that some fact could
fail on go back to the fact rows. A fact table is read twice, whatever the number
of its key columns, and a hot key is pre-aggregated before any shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcube.session import cut, small

#: Suspect keys up to this number (about 50 bytes each) are broadcast to the fact rows.
BROADCAST_KEYS = 200_000


@dataclass(frozen=True)
class Reference:
    """One foreign key of a fact table and the parent it should lead to."""

    fact_table: str
    fact: DataFrame
    fact_id: str
    key: str
    parent: DataFrame
    parent_key: str
    fact_time: str = "loaded_at"
    parent_from: str | None = "loaded_at"
    parent_to: str | None = None


def _facts(refs: Sequence[Reference]) -> DataFrame:
    """``_ref, fact_key, _k, _at``: a row per fact and non-null key. References of one fact table share its scan."""
    tables: dict[tuple, list[tuple[int, Reference]]] = {}
    for i, r in enumerate(refs):
        tables.setdefault((id(r.fact), r.fact_id, r.fact_time), []).append((i, r))
    out = None
    for group in tables.values():
        r = group[0][1]
        keys = F.array(*[F.struct(F.lit(i).alias("_ref"), F.col(x.key).cast("bigint").alias("_k")) for i, x in group])
        one = r.fact.select(F.col(r.fact_id).cast("bigint").alias("fact_key"), F.col(r.fact_time).alias("_at"), F.inline(F.filter(keys, lambda k: k["_k"].isNotNull())))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no references given")
    return out


def _parents(refs: Sequence[Reference]) -> DataFrame:
    out = None
    for i, r in enumerate(refs):
        one = r.parent.select(
            F.lit(i).alias("_ref"), F.col(r.parent_key).cast("bigint").alias("_k"),
            (F.col(r.parent_from) if r.parent_from else F.lit("0001-01-01").cast("timestamp")).alias("_from"),
            (F.col(r.parent_to) if r.parent_to else F.lit(None).cast("timestamp")).alias("_to"),
        ).where(F.col("_k").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out


def _covers(at: Column, lo: Column, hi: Column) -> Column:
    """A parent version exists at ``at``; unknown times count as "does not exist"."""
    return F.coalesce((lo <= at) & (hi.isNull() | (hi > at)), F.lit(False))


def suspect_keys(refs: Sequence[Reference]) -> DataFrame:
    """``_ref, _k, _versions``: the referred keys on which at least one fact may fail, with the parent versions to test it against.

    Distinct keys without any parent row come from the anti-join; of the others
    only those stay of which no single parent version covers the whole span of
    their facts' load times. A key's parent versions are taken to be few.
    """
    facts, parents, on = _facts(refs), _parents(refs), ["_ref", "_k"]
    keys = cut(facts.groupBy(*on).agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), F.max(F.col("_at").isNull().cast("int")).alias("_untimed")))
    none = F.array().cast("array<struct<_from:timestamp,_to:timestamp>>")
    absent = keys.join(parents, on, "left_anti").select(*on, none.alias("_versions"))
    whole = _covers(F.col("_lo"), F.col("_from"), F.col("_to")) & _covers(F.col("_hi"), F.col("_from"), F.col("_to")) & (F.col("_untimed") == 0)
    spans = keys.join(parents, on).groupBy(*on).agg(F.max(whole.cast("int")).alias("_whole"), F.collect_list(F.struct("_from", "_to")).alias("_versions"))
    return cut(absent.unionByName(spans.where("_whole = 0").select(*on, "_versions")))


def _fails(versions: Column, at: Column) -> Column:
    return ~F.exists(versions, lambda v: _covers(at, v["_from"], v["_to"]))


def orphans(refs: Sequence[Reference]) -> DataFrame:
    """Fact rows whose non-null key has no parent row in force at the fact's load time.

    Returns ``_ref`` (the place in ``refs``), ``fact_key, fact_time``, one row per
    fact row and reference. A parent is in force if its start is not after the
    fact's time and its end is null or later. NULL keys are no references. A fact
    without a time, and a parent without a start, match nothing. Several parent
    versions of a key are allowed. Empty parents: every referring fact is an
    orphan; empty facts: no rows. Beyond ``BROADCAST_KEYS`` suspect keys the facts
    are shuffled by key; an adaptive skew join splits what a hot key holds.
    """
    hit = _facts(refs).join(small(suspect_keys(refs), BROADCAST_KEYS), ["_ref", "_k"])
    return hit.where(_fails(F.col("_versions"), F.col("_at"))).select("_ref", "fact_key", F.col("_at").alias("fact_time"))


def sound_facts(fact: DataFrame, refs: Sequence[Reference]) -> DataFrame:
    """The rows of ``fact`` whose keys named in ``refs`` are all non-null and lead to a parent in force."""
    suspects = suspect_keys(refs)
    out = fact
    for i, r in enumerate(refs):
        bad = suspects.where(F.col("_ref") == i).select(F.col("_k").alias(f"__ref_key_{i}"), F.col("_versions").alias(f"__ref_versions_{i}"))
        bad._counted = suspects._counted
        out = out.where(F.col(r.key).isNotNull()).join(small(bad, BROADCAST_KEYS), F.col(r.key).cast("bigint") == F.col(f"__ref_key_{i}"), "left")
        out = out.where(F.col(f"__ref_versions_{i}").isNull() | ~_fails(F.col(f"__ref_versions_{i}"), F.col(r.fact_time))).drop(f"__ref_key_{i}", f"__ref_versions_{i}")
    return out


def _named(refs: Sequence[Reference]) -> list[Column]:
    """The table and key column of ``_ref``."""
    pick = lambda f: F.element_at(F.array(*[F.lit(f(r)) for r in refs]), F.col("_ref") + 1)
    return [pick(lambda r: r.fact_table).alias("fact_table"), pick(lambda r: r.key).alias("key_column")]


def orphan_rows(refs: Sequence[Reference]) -> DataFrame:
    """:func:`orphans` by name: ``fact_table, key_column, fact_key, fact_time``."""
    return orphans(refs).select(*_named(refs), "fact_key", "fact_time")


def orphan_report(refs: Sequence[Reference]) -> DataFrame:
    """Orphans and references per fact table, key column and month of the fact's time (``month`` is NULL without a time)."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    bad = orphans(refs).groupBy("_ref", month(F.col("fact_time")).alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))
    totals = _facts(refs).groupBy("_ref", month(F.col("_at")).alias("month")).agg(F.count(F.lit(1)).alias("n_references"))
    b, t = bad.alias("b"), totals.alias("t")
    same = (F.col("b._ref") == F.col("t._ref")) & F.col("b.month").eqNullSafe(F.col("t.month"))
    joined = t.join(b, same, "left").select("t._ref", "t.month", "t.n_references", F.coalesce("b.n_orphans", F.lit(0)).cast("bigint").alias("n_orphans"))
    return joined.select(*_named(refs), "month", "n_references", "n_orphans")
