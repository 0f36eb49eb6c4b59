"""Missing values, implausible readings, orphan references, trailing totals."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandcube.functions.hmm import forward_backward, held_forward_backward
from strandcube.functions.labels import canonical_label, entity_number
from strandcube.operators.effects import Field
from strandcube.operators.impute import Category, fill_missing, filled_cells
from strandcube.operators.plausible import SpikeModel, fit_states, flag_implausible, label_rows
from strandcube.operators.references import Reference, orphan_report, orphan_rows, orphans, sound_facts
from strandcube.operators.trailing import daily_sums, fill_days, trailing_totals

START = datetime(2024, 1, 1)
SPEED = Field("speed", 0.0, 160.0, 1.0)
FLOW = Field("flow", 0.0, 20_000.0, 1.0)


def feed(n_segments=6, days=20, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(n_segments):
        for h in range(days * 24):
            t = START + timedelta(hours=h, minutes=int(7 * s))
            daily = 1 + 0.5 * np.sin((h % 24) / 24 * 2 * np.pi)
            rows.append((f"r{s}-{h}", f"S{s}", t, 40 * daily * (1 + 0.1 * s) * np.exp(rng.normal(0, 0.04)), 500 * daily * np.exp(rng.normal(0, 0.05)), "Rain" if h % 48 < 10 else "Clear", 0, h))
    return pd.DataFrame(rows, columns=["id", "seg", "ts", "speed", "flow", "weather", "active", "_g"])


SCHEMA = "id string, seg string, ts timestamp, speed double, flow double, weather string, active int, _g int"


def test_labels(spark):
    raw = ["Heavy Rain", "HEAVYRAIN", " heavy-rain.", "Heavy Rian", "Hvy Rain", "Claer", "nan", "N/A", "", None, "not reported", "blizzard"]
    got = spark.createDataFrame([(x,) for x in raw], "w string").select(canonical_label(F.col("w"), ["Clear", "Fog", "Heavy Rain", "Rain"])).toPandas().iloc[:, 0]
    assert [x if isinstance(x, str) else None for x in got] == ["Heavy Rain"] * 5 + ["Clear"] + [None] * 6
    ids = spark.createDataFrame([("SEG0007",), ("seg 7",), ("tbc",), (None,), ("",)], "s string").select(entity_number(F.col("s"))).collect()
    assert [r[0] for r in ids] == [7, 7, None, None, None]


def test_fill_is_marked_and_accurate(spark):
    pdf = feed()
    rng = np.random.default_rng(2)
    gone = rng.random(len(pdf)) < 0.05
    truth = pdf.loc[gone, ["id", "speed", "weather"]].set_index("id")
    pdf.loc[gone, "speed"] = np.nan
    pdf.loc[gone, "weather"] = "n/a"
    df = spark.createDataFrame(pdf, SCHEMA)
    cat = Category("weather", ("Clear", "Rain"))
    got = fill_missing(df, "seg", "ts", [SPEED, FLOW], cat, F.col("active") != 1).toPandas().set_index("id")
    assert len(got) == len(pdf) and got["speed"].notna().all() and "_g" in got.columns
    assert set(got.index[got.speed_filled == 1]) == set(truth.index) == set(got.index[got.weather_filled == 1])
    est = got.loc[truth.index]
    rmse = float(np.sqrt(((est.speed - truth.speed) ** 2).mean()))
    assert rmse < 0.1 * truth.speed.std() + 2.0  # far below the spread of the values
    assert (est.weather == truth.weather).mean() > 0.98
    kept = got.loc[got.speed_filled == 0, "speed"]
    assert np.allclose(kept, pdf.set_index("id").loc[kept.index, "speed"])


def test_fill_edges(spark):
    rows = [("a", None, None, None, float("nan"), None, None, 1), ("a", "S1", START, 50.0, 9e9, "clear", 0, 1), ("a", "S1", START, 50.0, 9e9, "clear", 0, 1), ("b", "S2", START, None, None, " ", 0, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = fill_missing(df, "seg", "ts", [SPEED, FLOW], Category("weather", ("Clear", "Rain")))
    got = out.toPandas()
    assert len(got) == 4 and got.speed.notna().all() and got.flow.notna().all() and got.weather.notna().all()
    assert sorted(got.loc[got.id == "a", "flow"]).count(9e9) == 2  # impossible, not missing
    cells = {tuple(r) for r in filled_cells(out, "id", ["speed", "flow", "weather"]).collect()}
    assert cells == {("a", "speed"), ("a", "flow"), ("a", "weather"), ("b", "speed"), ("b", "flow"), ("b", "weather")}
    assert fill_missing(df.limit(0), "seg", "ts", [SPEED], Category("weather", ("Clear",))).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    a, start = np.array([[0.9, 0.1], [0.3, 0.7]]), np.array([0.6, 0.4])
    e = rng.random((5, 2))
    moved, pairs = np.zeros((2, 2)), np.zeros((2, 2))
    got = forward_backward(e, np.array([3, 2]), a, start, moved)
    for lo, n in ((0, 3), (3, 2)):
        p, seen = np.zeros((n, 2)), np.zeros((2, 2))
        for path in np.ndindex(*[2] * n):
            w = start[path[0]] * e[lo, path[0]]
            for i in range(1, n):
                w *= a[path[i - 1], path[i]] * e[lo + i, path[i]]
            for i in range(n):
                p[i, path[i]] += w
            for i in range(1, n):
                seen[path[i - 1], path[i]] += w
        pairs += seen / p[0].sum()
        assert np.allclose(got[lo : lo + n], p / p.sum(1, keepdims=True))
    assert np.allclose(moved, pairs)


@pytest.mark.parametrize("block_rows", [4096, 60])
def test_flags_faults_and_only_those(spark, block_rows):
    """With small blocks every source is cut, and runs across a cut are still found."""
    pdf = feed(days=25)
    pdf.loc[100, "speed"] = 900.0
    pdf.loc[200:206, "speed"] = 33.0  # stuck for 7
    pdf.loc[293:297, "speed"] = 57.5  # 5 is no run
    spike = 411
    pdf.loc[spike, "flow"] = pdf.loc[spike, "flow"] * 4
    calm = 500
    pdf.loc[calm, "flow"] *= 4
    pdf.loc[calm, "active"] = 1
    pdf.loc[203, "speed"] = np.nan  # skipped inside the run
    twin = pdf.loc[[204]].assign(id="twin")
    df = spark.createDataFrame(pd.concat([pdf, twin, pdf.loc[[205]]]), SCHEMA)
    got = flag_implausible(df, "seg", "ts", "id", [SPEED, FLOW], F.col("active") != 1, SpikeModel(block_rows=block_rows)).toPandas()
    cases = {(r.id, r.field_name, r.kind) for r in got.itertuples()}
    want = {(pdf.id[100], "speed", "out_of_range"), (pdf.id[spike], "flow", "spike"), ("twin", "speed", "stuck")} | {(pdf.id[i], "speed", "stuck") for i in (200, 201, 202, 204, 205, 206)}
    assert cases == want and len(got) == len(want)


def _run(z, equal, model=SpikeModel()):
    n = len(z)
    return fit_states(np.array(z, float), np.array(equal, bool), np.zeros(n, bool), np.ones(n, bool), np.array([n]), model)


def test_flags_depend_on_the_sequence():
    """Readings of the same value are flagged or not by what stands before and after them."""
    z = np.random.default_rng(3).normal(0, 1, 600)
    z[100], z[101], z[300] = 15.0, 5.4, 5.4
    faulty = 1 - _run(z, np.zeros(600))[:, 0]
    assert faulty[101] > 0.5 > faulty[300]  # after a spike another one is likelier
    forgetful = SpikeModel(transitions=(SpikeModel().transitions[0],) * 4, rounds=0)
    assert (1 - _run(z, np.zeros(600), forgetful)[:, 0])[101] < 0.5
    equal = np.zeros(600)
    equal[401:406] = equal[501:505] = 1  # a run of 6, a run of 5
    post = _run(np.where(equal > 0, 0.3, z), equal)
    assert (post[400:406, 2] > 0.5).all() and post[500:505, 2].max() < 0.5 and post[399, 2] < 0.5
    alone = fit_states(z[400:406], equal[400:406] > 0, np.zeros(6, bool), np.ones(6, bool), np.ones(6, int), SpikeModel())
    assert alone[:, 2].max() < 0.5  # the same readings, each a sequence of its own


def test_sources_get_their_own_parameters():
    """The same deviation is flagged at a steady source and not at a restless one."""
    rng = np.random.default_rng(4)
    z = np.r_[rng.normal(0, 0.6, 3000), rng.normal(0, 1.8, 3000)]
    z[[1500, 4500]] = 5.5
    none = np.zeros(6000, bool)
    post = fit_states(z, none, none, ~none, np.array([3000, 3000]), SpikeModel())
    assert post[1500, 0] < 0.5 < post[4500, 0]


def test_held_recursion_matches_enumeration():
    rng = np.random.default_rng(0)
    e, held = rng.random((6, 3)), rng.random(6)
    move, start = rng.dirichlet(np.ones(3), (1, 3)), rng.dirichlet(np.ones(3), 1)
    got, moved = held_forward_backward(e, held, np.array([6]), move, start, 1, 3)
    # states 0, 1 (a run that may end), 2, then the first and second reading of a run
    full = np.zeros((5, 5))
    full[:3, :3] = move[0]
    full[[0, 2], 3], full[[0, 2], 1] = move[0][[0, 2], 1], 0.0
    full[3, 4] = full[4, 1] = 1.0
    dense = np.c_[e[:, 0], held, e[:, 2], e[:, 1], held]
    first = np.array([start[0, 0], 0.0, start[0, 2], start[0, 1], 0.0])
    want = forward_backward(dense, np.array([6]), full, first)
    assert np.allclose(got, np.c_[want[:, 0], want[:, 1] + want[:, 3] + want[:, 4], want[:, 2]], atol=1e-5)
    assert np.isclose(moved.sum() + want[:-1, 3].sum() + want[:-1, 4].sum(), 5, atol=1e-4)


def test_flag_edges(spark):
    rows = [("a", None, None, 999.0, None, None, 0, 1), ("b", "S", None, float("nan"), -5.0, None, 0, 1), ("c", "S", START, 50.0, 10.0, None, None, 1)]
    got = flag_implausible(spark.createDataFrame(rows, SCHEMA), "seg", "ts", "id", [SPEED, FLOW]).collect()
    assert {(r.id, r.field_name, r.kind) for r in got} == {("a", "speed", "out_of_range"), ("b", "flow", "out_of_range")}
    assert flag_implausible(spark.createDataFrame([], SCHEMA), "seg", "ts", "id", [SPEED]).count() == 0
    assert len(label_rows(pd.DataFrame({c: [] for c in ("_id", "_seq", "_us", "_core", "_ok", "v_x", "z_x")}), [("x", 0, 1)], SpikeModel())) == 0


FACTS = "id bigint, k bigint, loaded_at timestamp, _k string, _versions int"
DIM = "k bigint, loaded_at timestamp, deleted_at timestamp, id string"


def _refs(spark, facts, dim):
    return [Reference("f", spark.createDataFrame(facts, FACTS), "id", "k", spark.createDataFrame(dim, DIM), "k", parent_to="deleted_at")]


def test_orphans_against_brute_force(spark):
    rng = np.random.default_rng(3)
    day = lambda d: None if d is None else START + timedelta(days=int(d))
    dim = [(k, day(rng.integers(0, 20)), day(rng.integers(10, 40)) if rng.random() < 0.4 else None, "x") for k in rng.integers(0, 25, 30).tolist()] + [(None, START, None, "n"), (3, None, None, "m")]
    facts = [(i, None if rng.random() < 0.05 else int(min(rng.integers(0, 60), 30)), None if rng.random() < 0.03 else day(rng.integers(0, 40)), "z", 1) for i in range(400)]
    facts.append(facts[5])
    want = sorted(f[0] for f in facts if f[1] is not None and not any(d[0] == f[1] and d[1] is not None and f[2] is not None and d[1] <= f[2] and (d[2] is None or d[2] > f[2]) for d in dim))
    refs = _refs(spark, facts, dim)
    assert sorted(r.fact_key for r in orphans(refs).collect()) == want
    sound = sound_facts(refs[0].fact, refs)
    assert sorted(r.id for r in sound.collect()) == sorted(f[0] for f in facts if f[1] is not None and f[0] not in set(want)) and sound.columns == refs[0].fact.columns
    report = orphan_report(refs).toPandas()
    assert report.n_orphans.sum() == len(want) and report.n_references.sum() == sum(f[1] is not None for f in facts)


def test_orphans_empty(spark):
    assert orphan_rows(_refs(spark, [], [(1, START, None, "x")])).count() == 0
    assert orphan_rows(_refs(spark, [(1, 5, START, "a", 1)], [])).count() == 1
    with pytest.raises(ValueError):
        orphan_rows([])


def test_trailing_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(s), (START + timedelta(days=int(d))).date(), int(rng.integers(0, 9)), 1) for s in range(3) for d in sorted(rng.choice(70, 30, replace=False))] + [(None, START.date(), 5, 1), (1, None, 5, 1)]
    df = spark.createDataFrame(rows, "seg int, day date, n int, _e int")
    daily = daily_sums(df, "seg", "day", {"n": "n"}, ["n"])
    got = trailing_totals(daily, "seg", "day", ["n"], (1, 7, 30)).toPandas()
    base = pd.DataFrame(rows, columns=["seg", "day", "n", "_e"]).dropna()
    for s, g in got.groupby("seg"):
        own = base[base.seg == s].set_index(pd.to_datetime(base[base.seg == s].day)).n.asfreq("D").fillna(0)
        g = g.sort_values("day")
        assert list(pd.to_datetime(g.day)) == list(own.index)
        for w in (1, 7, 30):
            assert g[f"n_{w}d"].tolist() == own.rolling(w, min_periods=1).sum().tolist()
        assert g.is_idle.sum() == len(own) - 30
    assert trailing_totals(daily.limit(0), "seg", "day", ["n"]).count() == 0
    assert fill_days(daily, "seg", "day", ["n"]).count() == len(got)
    with pytest.raises(ValueError):
        trailing_totals(daily, "seg", "day", ["n"], (0,))
