"""Mergeable percentiles with a deterministic rank bound.

A summary of n values is a sorted list of tuples (v, lo, hi): the rank of v lies
between lo and hi. Whatever rank is asked for, some tuple is at most half the
widest step from it, where a step runs from one tuple's lo to the next one's hi;
so the error of a summary can be read off its tuples after any merge or
compression. Tasks summarise their own rows; summaries are merged in rounds of
bounded fan-in and compressed to the uncertainty their round is permitted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcube.session import partitions_of

Summary = tuple[np.ndarray, np.ndarray, np.ndarray]

#: Rows a task holds before it turns them into summaries.
LEAF_ROWS = 1_000_000
FAN_IN = 32


def exact_summary(values: np.ndarray) -> Summary:
    """All values of a sorted array with their ranks 1..n."""
    r = np.arange(1, len(values) + 1, dtype=np.int64)
    return values, r, r


def compress(s: Summary, width: float) -> Summary:
    """Drop tuples while no step gets wider than ``width`` (steps that are wider already stay); the ends stay."""
    v, lo, hi = s
    if len(v) < 3 or width < 2:
        return s
    reach = np.searchsorted(hi, lo + width, side="right") - 1
    kept, i, end = [0], 0, len(v) - 1
    while i < end:
        i = min(max(int(reach[i]), i + 1), end)
        kept.append(i)
    k = np.array(kept)
    return v[k], lo[k], hi[k]


def merge(parts: Sequence[Summary], sizes: Sequence[int]) -> Summary:
    """One summary of all values; the ranks of a tuple are bounded by its neighbours in every other part."""
    if len(parts) == 1:
        return parts[0]
    v = np.concatenate([p[0] for p in parts])
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order = np.argsort(v, kind="stable")  # equal values: earlier part first
    v, source = v[order], source[order]
    lo, hi = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    for k, ((_, plo, phi), n) in enumerate(zip(parts, sizes, strict=True)):
        own = source == k
        seen = np.cumsum(own)  # tuples of part k up to here
        low = np.r_[0, plo][seen]
        high = np.where(own, np.r_[0, phi][seen], np.r_[phi - 1, n][seen])
        lo += low
        hi += high
    return v, lo, hi


def uncertainty(s: Summary) -> float:
    """Half the widest step: no rank is further than this from some tuple."""
    _, lo, hi = s
    return float(max((hi[1:] - lo[:-1]).max(initial=0) / 2, (hi - lo).max(initial=0) / 2))


def answer(s: Summary, n: int, q: float) -> tuple[float, int, int]:
    """Value for quantile q, its target rank, and how far its rank can be from the target."""
    v, lo, hi = s
    r = min(max(math.ceil(q * n), 1), n)
    off = np.maximum(r - lo, hi - r)
    i = int(off.argmin())
    return float(v[i]), r, int(max(off[i], 0))


def _rows(keys: list, parts: list, out: list[tuple[Summary, int]]) -> pd.DataFrame:
    return pd.DataFrame({"k": keys, "part": parts, "n": [n for _, n in out], "v": [s[0] for s, _ in out], "lo": [s[1] for s, _ in out], "hi": [s[2] for s, _ in out]})


def _schema(kind: str) -> str:
    return f"k {kind}, part bigint, n bigint, v array<double>, lo array<bigint>, hi array<bigint>"


def _leaves(batches: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    held: list[pd.DataFrame] = []
    count = 0

    def flush() -> pd.DataFrame:
        pdf = pd.concat(held)
        code, keys = pd.factorize(pdf["k"])
        v = pdf["v"].to_numpy(float)
        order = np.lexsort((v, code))
        code, v = code[order], v[order]
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        groups = np.split(v, starts[1:])
        out = [(compress(exact_summary(g), 2 * share * len(g)), len(g)) for g in groups]
        return _rows(list(keys[code[starts]]), [part] * len(out), out)

    for pdf in batches:
        held.append(pdf)
        count += len(pdf)
        if count >= LEAF_ROWS:
            yield flush()
            held, count = [], 0
    if count:
        yield flush()


def _merge_sorted(batches: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
    """Merges summaries that come sorted by key and group; at most ``FAN_IN`` and what they were merged into are held."""
    held: list[tuple[Summary, int]] = []
    key = group = None

    def fold() -> None:
        n = sum(x for _, x in held)
        held[:] = [(merge([s for s, _ in held], [x for _, x in held]), n)]

    def done() -> tuple:
        fold()
        s, n = held[0]
        return key, group, (compress(s, 2 * share * n), n)

    for pdf in batches:
        out = []
        for k, g, n, v, lo, hi in zip(pdf["k"], pdf["_g"], pdf["n"], pdf["v"], pdf["lo"], pdf["hi"], strict=True):
            if held and (k != key or g != group):
                out.append(done())
                held.clear()
            key, group = k, g
            held.append(((np.asarray(v), np.asarray(lo), np.asarray(hi)), int(n)))
            if len(held) > FAN_IN:
                fold()
        if out:
            yield _rows([o[0] for o in out], [o[1] for o in out], [o[2] for o in out])
    if held:
        out = [done()]
        yield _rows([o[0] for o in out], [o[1] for o in out], [o[2] for o in out])


def _merger(share: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    return lambda batches: _merge_sorted(batches, share)


def _merge_rounds(rows: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Rounds of merging groups of ``FAN_IN`` parts; the last one takes what is left of each key."""
    schema = _schema(rows.schema["k"].dataType.simpleString())
    for i, share in enumerate(shares):
        group = F.expr(f"part div {FAN_IN}") if i + 1 < len(shares) else F.lit(0).cast("bigint")
        keyed = rows.withColumn("_g", group).repartition("k", "_g").sortWithinPartitions("k", "_g", "part", "n")
        rows = keyed.mapInPandas(_merger(share), schema)
    return rows


def quantile_summaries(df: DataFrame, group: str, value: str, eps: float = 0.005) -> DataFrame:
    """One summary per group: ``group, n, v, lo, hi``, with every rank within ``eps * n``.

    NULL and not-a-number values and NULL groups are left out; ties and repeated
    rows count as they are. A group may hold any share of the rows: it leaves each
    task as a summary. Summaries of days, files or clusters with the same columns
    can be united and merged by :func:`merge_summaries`.
    """
    rows = df.select(F.col(group).alias("k"), F.col(value).cast("double").alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull() & ~F.isnan("v"))
    parts = max(partitions_of(rows), 1)
    rounds = max(1, math.ceil(math.log(parts, FAN_IN))) if parts > 1 else 1
    step = eps / (rounds + 1)
    leaves = rows.mapInPandas(lambda b: _leaves(b, step), _schema(df.schema[group].dataType.simpleString()))
    out = _merge_rounds(leaves, [step * (i + 2) for i in range(rounds)])
    return out.select(F.col("k").alias(group), "n", "v", "lo", "hi")


def merge_summaries(summaries: DataFrame, group: str, eps: float = 0.005) -> DataFrame:
    """Merge summaries of equal groups. A merge adds no error relative to n; each of its rounds compresses up to a share of ``eps``.

    The number of rounds follows from the most summaries that any group has.
    """
    most = summaries.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    rows = summaries.select(F.col(group).alias("k"), F.pmod(F.xxhash64("n", "v", "lo"), F.lit(most)).alias("part"), "n", "v", "lo", "hi")
    rounds = max(1, math.ceil(math.log(most, FAN_IN)))
    out = _merge_rounds(rows, [eps * (i + 1) / rounds for i in range(rounds)])
    return out.select(F.col("k").alias(group), "n", "v", "lo", "hi")


def quantiles(summaries: DataFrame, group: str, probabilities: Sequence[float]) -> DataFrame:
    """``group, n_values, q, value, target_rank, rank_error``: the true rank of ``value`` is within ``rank_error`` of ``target_rank`` = ceil(q * n)."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, n, v, lo, hi in pdf.itertuples(index=False, name=None):
                s = (np.asarray(v), np.asarray(lo), np.asarray(hi))
                out += [(k, n, q, *answer(s, int(n), q)) for q in probabilities]
            yield pd.DataFrame(out, columns=["k", "n_values", "q", "value", "target_rank", "rank_error"])

    kind = summaries.schema[group].dataType.simpleString()
    rows = summaries.select(F.col(group).alias("k"), "n", "v", "lo", "hi")
    return rows.mapInPandas(ask, f"k {kind}, n_values bigint, q double, value double, target_rank bigint, rank_error bigint").withColumnRenamed("k", group)
