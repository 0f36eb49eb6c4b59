"""Folding of dirty labels onto a fixed vocabulary, inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcube.session import cut, small

# Folded texts that stand for "no value".
PLACEHOLDERS = ("na", "nan", "null", "none", "nil", "unknown", "notreported", "notavailable", "missing", "tbc", "tbd", "other", "undefined")

#: A vocabulary is a short list that becomes part of the plan; a longer one is refused.
MAX_LABELS = 1000
#: Distinct spellings of a column up to this number (about 60 bytes each) are broadcast.
BROADCAST_SPELLINGS = 200_000


def fold(c: Column) -> Column:
    """Lower-case letters and digits only: case, spacing, punctuation and padding no longer matter."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def plain(label: str) -> str:
    """:func:`fold` for driver-side strings."""
    return "".join(ch for ch in label if ch.isalnum()).lower()


def _letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, "")), "")


def canonical_label(raw: Column, labels: Sequence[str]) -> Column:
    """The label that ``raw`` spells, or NULL if it names none.

    Exact label first, then equality after :func:`fold`, then one edit, two
    swapped neighbours, or two edits for labels of eight letters and more. On a
    tie of distances the label first in ``labels`` wins. NULL, blank and
    placeholder texts give NULL.
    """
    labels = list(labels)
    if len(labels) > MAX_LABELS:
        raise ValueError(f"{len(labels)} labels; a vocabulary of at most {MAX_LABELS} is expected")
    if not labels:
        return F.lit(None).cast("string")
    folded = fold(raw)
    known: dict[str, str] = {}
    for x in labels:
        known.setdefault(plain(x), x)
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), folded)
    best = F.least(*[_misspelt(folded, k, i) for i, k in enumerate(known)], F.lit(10_000))
    fuzzy = F.when(best < 10_000, F.element_at(F.array(*[F.lit(v) for v in known.values()]), (best % 1000) + 1))
    return (
        F.when(raw.isNull(), F.lit(None))
        .when(raw.isin(labels), raw)
        .otherwise(F.coalesce(exact, F.when((folded == "") | folded.isin(*PLACEHOLDERS), F.lit(None)).otherwise(fuzzy)))
    )


def _misspelt(folded: Column, key: str, rank: int) -> Column:
    """1000 x distance + rank if ``folded`` is a misspelling of ``key``, else 10000."""
    d = F.levenshtein(folded, F.lit(key), 2)
    swapped = (d == 2) & (F.length(folded) == len(key)) & (_letters(folded) == F.lit("".join(sorted(key))))
    close = (d == 1) | swapped
    if len(key) >= 8:
        close = close | (d == 2)
    return F.when(close, d * 1000 + F.lit(rank)).otherwise(F.lit(10_000))


def vocabulary(dim: DataFrame, column: str) -> list[str]:
    """The sorted distinct labels of a dimension column, checked to be a small set."""
    rows = dim.select(column).where(F.col(column).isNotNull()).distinct().limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"{column} has more than {MAX_LABELS} labels")
    return sorted(r[0] for r in rows)


def fold_columns(df: DataFrame, vocabularies: Mapping[str, Sequence[str]], suffix: str = "_label") -> DataFrame:
    """``df`` with ``<column><suffix>``, the :func:`canonical_label` of each column in ``vocabularies``.

    Labels are worked out once per distinct spelling, in one pass over all the
    columns, and joined back.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_at"), F.col(c).alias("_spelt")) for i, c in enumerate(vocabularies)])
    spelt = df.select(F.inline(cells)).where("_spelt IS NOT NULL").distinct()
    label = F.lit(None).cast("string")
    for i, labels in enumerate(vocabularies.values()):
        label = F.when(F.col("_at") == i, canonical_label(F.col("_spelt"), labels)).otherwise(label)
    known = cut(spelt.withColumn("_folded", label))
    out = df
    for i, c in enumerate(vocabularies):
        one = known.where(F.col("_at") == i).select(F.col("_spelt").alias(f"_spelt{i}"), F.col("_folded").alias(f"{c}{suffix}"))
        one._counted = known._counted
        out = out.drop(f"{c}{suffix}").join(small(one, BROADCAST_SPELLINGS), F.col(c) == F.col(f"_spelt{i}"), "left").drop(f"_spelt{i}")
    return out


def fold_column(df: DataFrame, column: str, labels: Sequence[str], out: str) -> DataFrame:
    """``df`` with ``out``, the label of one column (see :func:`fold_columns`)."""
    return fold_columns(df, {column: labels}, "__folded").drop(out).withColumnRenamed(f"{column}__folded", out)


def entity_number(c: Column) -> Column:
    """The number in an entity id ('SEG0007', 'seg 7', '7' -> 7); NULL where there is none."""
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint")
