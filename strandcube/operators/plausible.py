"""Implausible measurements: a hidden Markov model per source and field.

States are normal, spike, stuck and out-of-range. A normal value follows a Student
t around the source's own cell (hour of the day, kind of day) plus the hour's
effect common to all sources, and seldom equals the value before it; spikes are
spread evenly; out-of-range values violate the hard bounds. A stuck detector
repeats its first value, for at least ``min_run`` readings: the state is a chain of
links that can only go forward, so whether a value is stuck follows from its
neighbours on both sides. Spread, chance of an equal value and transitions are
fitted per source by Baum-Welch rounds, shrunk to the starting tables.
Forward-backward probabilities assign the state; hard bounds and the length of the
run are checked exactly afterwards.

Sources are packed into buckets of bounded size and run together, one numpy step
per reading for all sequences of a bucket. A source too large for a bucket is cut
into blocks of minutes, each fitted by itself, with a halo of readings at either
side, long enough to hold any run that decides a flag.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcube.functions.hmm import held_forward_backward
from strandcube.functions.values import present
from strandcube.operators.effects import Field, fit_effects, observations
from strandcube.session import cut, parallelism, small

STATES = ("normal", "spike", "stuck", "out_of_range")
_STUCK = 2


@dataclass(frozen=True)
class SpikeModel:
    """Parameters of the model: starting transition rows in the order of ``STATES``, the weights they keep, and the emissions."""

    start: tuple[float, ...] = (0.97, 0.01, 0.01, 0.01)
    transitions: tuple[tuple[float, ...], ...] = (
        (0.9920, 0.0050, 0.0005, 0.0025),
        (0.9500, 0.0200, 0.0100, 0.0200),
        (0.1000, 0.0050, 0.8900, 0.0050),
        (0.8800, 0.0200, 0.0100, 0.0900),
    )
    #: Baum-Welch rounds, and the readings in a state as which its starting row counts.
    rounds: int = 2
    row_weight: tuple[float, ...] = (4000.0, 200.0, 200.0, 200.0)
    #: Readings as which a spread of 1 and the usual chance of an equal value count; that chance is kept below ``max_equal``.
    spread_weight: float = 1000.0
    equal: float = 0.002
    equal_weight: float = 2000.0
    max_equal: float = 0.005
    freedom: float = 10.0
    spike_density: float = 1 / 40
    stuck_spread: float = 3.0
    min_run: int = 6
    threshold: float = 0.5
    #: Rows in a bucket, and in a block of a source that is cut.
    bucket_rows: int = 60_000
    block_rows: int = 4096
    #: Readings with a value kept at either side of a block.
    halo: int = 24
    broadcast_blocks: int = 300_000


def _student(z: np.ndarray, nu: float) -> np.ndarray:
    return 0.389 * (1 + z * z / nu) ** (-(nu + 1) / 2)


def _emissions(z: np.ndarray, equal: np.ndarray, outside: np.ndarray, calm: np.ndarray, spread: np.ndarray, chance: np.ndarray, m: SpikeModel) -> tuple[np.ndarray, np.ndarray]:
    """Densities of a reading in each state, and of a further reading of a stuck run; ``spread`` and ``chance`` are those of the reading's source."""
    e = np.empty((len(z), 4))
    luck = np.where(equal, chance, 1 - chance)
    e[:, 0] = _student(z / spread, m.freedom) / spread * luck
    # What goes with an announced disturbance is no spike, however far off.
    e[:, 1] = np.where(calm, m.spike_density * luck, 1e-9 * e[:, 0])
    wide = np.maximum(_student(z / m.stuck_spread, 2.0) / m.stuck_spread, m.spike_density)  # a dead detector may read anything
    e[:, _STUCK] = wide * luck
    e[:, 3] = 1e-12
    e[outside] = (1e-12, 1e-12, m.spike_density, 1.0)
    held = np.where(equal, np.where(outside, m.spike_density, wide), 1e-9)
    return e, held


def fit_states(z: np.ndarray, equal: np.ndarray, outside: np.ndarray, calm: np.ndarray, lengths: np.ndarray, m: SpikeModel) -> np.ndarray:
    """State probabilities of sequences laid end to end, each with its own parameters after ``m.rounds`` rounds of Baum-Welch."""
    n = len(lengths)
    rows = np.repeat(np.arange(n), lengths)
    base = np.array(m.transitions)
    base /= base.sum(1, keepdims=True)
    move, start = np.tile(base, (n, 1, 1)), np.tile(np.array(m.start), (n, 1))
    spread, chance = np.ones(n), np.full(n, m.equal)
    weight = np.array(m.row_weight)[None, :, None] * base
    for k in range(m.rounds + 1):
        e, held = _emissions(z, equal, outside, calm, spread[rows], chance[rows], m)
        post, moved = held_forward_backward(e, held, lengths, move, start, _STUCK, m.min_run, k < m.rounds)
        if k == m.rounds:
            return post
        total = lambda x: np.bincount(rows, x, n)
        usual = post[:, 0] * calm
        spread = np.sqrt((m.spread_weight + total(usual * z * z)) / (m.spread_weight + total(usual)))
        luck = total(post[:, 0] * equal) + m.equal * m.equal_weight
        chance = np.minimum(luck / (total(post[:, 0]) + m.equal_weight), m.max_equal)
        move = moved + weight
        move /= move.sum(2, keepdims=True)
    raise AssertionError("unreachable")


def label_rows(pdf: pd.DataFrame, fields: Sequence[tuple[str, float, float]], m: SpikeModel) -> pd.DataFrame:
    """Flagged values of one bucket: columns _id, field_name, kind, probability. ``_seq`` is NULL for rows that belong to no sequence."""
    known = pdf["_seq"].notna().to_numpy() & pdf["_us"].notna().to_numpy()
    seq = pd.factorize(pdf["_seq"])[0]
    us = pdf["_us"].fillna(0).to_numpy(np.int64)
    order = np.lexsort((us, seq))
    ids, core = pdf["_id"].to_numpy(object), pdf["_core"].to_numpy(bool)
    calm_all = pdf["_ok"].to_numpy(bool)
    parts, lengths = [], []
    held: list[tuple[np.ndarray, ...]] = []
    out: list[pd.DataFrame] = []
    for name, lo, hi in fields:
        v_all, z_all = pdf[f"v_{name}"].to_numpy(float), pdf[f"z_{name}"].to_numpy(float)
        loose = np.flatnonzero(~known & ~np.isnan(v_all) & ((v_all < lo) | (v_all > hi)) & core)
        if len(loose):
            out.append(pd.DataFrame({"_id": ids[loose], "field_name": name, "kind": STATES[3], "probability": 1.0}))
        rows = order[(~np.isnan(v_all) & known)[order]]
        if not len(rows):
            continue
        s, t = seq[rows], us[rows]
        first = np.r_[True, (s[1:] != s[:-1]) | (t[1:] != t[:-1])]
        reading = np.cumsum(first) - 1  # rows of one instant are one reading
        head = rows[first]
        v, sh = v_all[head], s[first]
        equal = np.r_[False, (v[1:] == v[:-1]) & (sh[1:] == sh[:-1])]
        outside = (v < lo) | (v > hi)
        calm = np.minimum.reduceat(calm_all[rows], np.flatnonzero(first)).astype(bool)
        held.append((np.nan_to_num(z_all[head]), equal, outside, calm))
        lengths.append(np.bincount(np.cumsum(np.r_[False, sh[1:] != sh[:-1]])))
        parts.append((lo, hi, name, rows, reading, equal, v_all))
    if held:
        post = fit_states(*[np.concatenate(x) for x in zip(*held, strict=True)], np.concatenate(lengths), m)
        at = 0
        for lo, hi, name, rows, reading, equal, v_all in parts:
            p, at = post[at : at + len(equal)], at + len(equal)
            state = p[:, 1:].argmax(1) + 1
            faulty = 1 - p[:, 0]
            run = np.bincount(np.cumsum(~equal))[np.cumsum(~equal)]
            keep = faulty >= m.threshold
            keep &= (state != _STUCK) | (run >= m.min_run)  # the exact check of a run
            r_state, r_keep, r_p = state[reading], keep[reading], faulty[reading]
            own = (v_all[rows] < lo) | (v_all[rows] > hi)  # hard bounds hold for each row
            sel = np.flatnonzero((r_keep | own) & core[rows])
            if len(sel):
                kind = np.where(own[sel], 3, r_state[sel])
                out.append(pd.DataFrame({"_id": ids[rows[sel]], "field_name": name, "kind": np.array(STATES, object)[kind], "probability": np.where(own[sel], 1.0, r_p[sel])}))
    return pd.concat(out) if out else pd.DataFrame({c: pd.Series([], dtype=object) for c in ("_id", "field_name", "kind", "probability")})


def _cut_minutes(pdf: pd.DataFrame, names: Sequence[str], m: SpikeModel) -> pd.DataFrame:
    """Blocks of one source's minutes: _g, _m, _block, _core, with the halo minutes of each block."""
    pdf = pdf.sort_values("_m", ignore_index=True)
    before = pdf["_n"].cumsum().to_numpy() - pdf["_n"].to_numpy()
    block = (before // m.block_rows).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    ends = np.r_[starts[1:], len(pdf)]
    sums = [np.r_[0, pdf[f"c_{n}"].cumsum().to_numpy()] for n in names]
    g, t = pdf["_g"].iloc[0], pdf["_m"].to_numpy()
    out = []
    for i, j in zip(starts, ends, strict=True):
        lo = min((max(int(np.searchsorted(c, c[i] - m.halo, side="right")) - 1, 0) for c in sums), default=i)
        hi = max((min(int(np.searchsorted(c, c[j] + m.halo, side="left")), len(pdf)) for c in sums), default=j)
        lo, hi = min(lo, i), max(hi, j)
        k = np.arange(lo, hi)
        out.append(pd.DataFrame({"_g": g, "_m": t[k], "_block": block[i], "_core": (k >= i) & (k < j)}))
    return pd.concat(out)


def _minute() -> Column:
    return F.expr("_us div 60000000")


def _blocks(obs: DataFrame, per_source: DataFrame, names: Sequence[str], m: SpikeModel) -> DataFrame | None:
    """The minutes of the sources that must be cut, with their blocks (None: no such source). ``per_source`` has the rows of each."""
    large = cut(per_source.where(F.col("_rows") > 2 * m.block_rows).select("_g"))
    if not large._counted:
        return None
    has = [F.max(F.col(f"v_{n}").isNotNull().cast("int")).alias(f"c_{n}") for n in names]
    instants = obs.where(F.col("_us").isNotNull()).join(small(large, m.broadcast_blocks), "_g").groupBy("_g", "_us").agg(F.count(F.lit(1)).alias("_n"), *has)
    minutes = instants.groupBy("_g", _minute().alias("_m")).agg(F.sum("_n").alias("_n"), *[F.sum(f"c_{n}").alias(f"c_{n}") for n in names])
    kind = obs.schema["_g"].dataType.simpleString()
    return cut(minutes.groupBy("_g").applyInPandas(lambda p: _cut_minutes(p, names, m), f"_g {kind}, _m bigint, _block bigint, _core boolean"))


def flag_implausible(df: DataFrame, group: str, ts: str, row_id: str, fields: Sequence[Field], calm: Column | None = None, model: SpikeModel | None = None) -> DataFrame:
    """Implausible values of ``fields``: ``row_id, field_name, kind, probability``.

    ``kind`` is spike, stuck or out_of_range; ``probability`` is that of not being
    normal. Missing values (NULL, not a number) are never flagged and do not
    interrupt a run. Rows of one source at one instant are one reading and share
    its flag; repeated rows give one row per row id and field. ``calm`` is false
    for rows whose deviations are explained (they can still be stuck or out of
    range). Rows without source or time are held against the hard bounds only.
    Empty input gives no rows; other columns are not read. A source of more than
    twice ``block_rows`` rows is fitted block by block; the smallest block is a
    minute, whatever it holds.
    """
    m = model or SpikeModel()
    names = [f.name for f in fields]
    keep = [F.col(row_id).alias("_id"), F.unix_micros(F.col(ts)).alias("_us"), *[present(F.col(n)).cast("double").alias(f"v_{n}") for n in names]]
    obs = observations(df, F.col(group), F.col(ts), fields, calm, keep)
    effects = fit_effects(obs, fields, tally={"_rows": F.lit(1)})
    per_source = cut(effects.group_tally)
    total = per_source.agg(F.sum("_rows")).first()[0] or 0
    blocks = _blocks(obs, per_source, names, m)
    z = [((F.col(f"y_{n}") - F.col(f"m_{n}")) / F.col(f"s_{n}")).cast("float").alias(f"z_{n}") for n in names]
    rows = effects.attach(obs).select("_id", "_g", "_us", "_ok", *[f"v_{n}" for n in names], *z)
    if blocks is None:
        rows = rows.withColumns({"_block": F.lit(0).cast("bigint"), "_core": F.lit(True)})
    else:
        rows = rows.withColumn("_m", _minute()).join(small(blocks, m.broadcast_blocks), ["_g", "_m"], "left").drop("_m")
        rows = rows.withColumns({"_block": F.coalesce("_block", F.lit(0)), "_core": F.coalesce("_core", F.lit(True))})
    buckets = max(parallelism(df.sparkSession), -(-total // m.bucket_rows))
    # A sequence is known by 64 bits of its source and block; rows without a source are spread by their id.
    rows = rows.withColumn("_seq", F.when(F.col("_g").isNotNull(), F.xxhash64("_g", "_block"))).drop("_g", "_block")
    rows = rows.withColumn("_bucket", F.pmod(F.coalesce("_seq", F.xxhash64("_id")), F.lit(buckets)).cast("int")).repartition(buckets, "_bucket")
    bounds = [(f.name, f.lo, f.hi) for f in fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return label_rows(pdf, bounds, m)

    id_type = df.schema[row_id].dataType.simpleString()
    flags = rows.groupBy("_bucket").applyInPandas(run, f"_id {id_type}, field_name string, kind string, probability double")
    return flags.groupBy(F.col("_id").alias(row_id), "field_name").agg(F.max_by("kind", "probability").alias("kind"), F.max("probability").alias("probability"))


__all__ = ["STATES", "Field", "SpikeModel", "fit_states", "flag_implausible", "label_rows"]
