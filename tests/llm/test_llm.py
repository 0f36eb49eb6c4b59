"""Percentiles, pairs, nearest-time matching, packing, mixing and page labelling."""

import re
import time
from collections import Counter
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandcube.llm.mixing import Target, mix, mix_shares, route
from strandcube.llm.nearest import match_nearest, merge_sorted
from strandcube.llm.packing import Cost, assign, least_containers, pack, packing_report
from strandcube.llm.pages import batch_features, common_words, page_shares, stuffed_pages
from strandcube.llm.pairs import count_batch, item_pairs
from strandcube.llm.percentiles import answer, compress, exact_summary, merge, merge_summaries, quantile_summaries, quantiles, uncertainty
from strandcube.llm.tokens import token_counts

START = datetime(2024, 1, 1)


# --- percentiles -----------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=1, max_size=60), min_size=1, max_size=6), st.sampled_from([2, 5, 9]))
def test_merged_ranks_hold(parts, width):
    sums = [compress(exact_summary(np.sort(np.array(p, float))), width) for p in parts]
    s = compress(merge(sums, [len(p) for p in parts]), 2 * width)
    everything = np.sort(np.concatenate([np.array(p, float) for p in parts]))
    n = len(everything)
    for v, lo, hi in zip(*s, strict=True):
        first, last = np.searchsorted(everything, v) + 1, np.searchsorted(everything, v, side="right")
        assert lo <= last and hi >= first and 1 <= lo <= hi <= n
    for q in (0, 0.1, 0.5, 0.9, 1):
        value, r, err = answer(s, n, q)
        first, last = np.searchsorted(everything, value) + 1, np.searchsorted(everything, value, side="right")
        assert first - err <= r <= last + err and err <= max(np.ceil(uncertainty(s)), 1)


def test_quantiles_within_bound(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(rng.random(20_000) < 0.4, 0, rng.integers(1, 6, 20_000)), "v": np.round(rng.gamma(2, 1, 20_000), 2), "part": 1})
    df = spark.createDataFrame(pdf).repartition(7)
    extra = spark.createDataFrame([(None, 1.0, 1), (9, float("nan"), 1), (9, None, 1), (8, 3.0, 1)], "g bigint, v double, part int")
    df = df.unionByName(extra)
    one = quantile_summaries(df, "g", "v", 0.01)
    halves = quantile_summaries(df.where("v < 2"), "g", "v", 0.01).unionByName(quantile_summaries(df.where("v >= 2"), "g", "v", 0.01))
    for got in (quantiles(one, "g", (0.1, 0.5, 0.99)), quantiles(merge_summaries(halves, "g", 0.02), "g", (0.1, 0.5, 0.99))):
        rows = got.collect()
        assert {r.g for r in rows} == {0, 1, 2, 3, 4, 5, 8}
        for r in rows:
            own = np.sort(pdf.v[pdf.g == r.g]) if r.g != 8 else np.array([3.0])
            assert r.n_values == len(own) and r.rank_error <= 0.02 * len(own) + 1
            assert np.searchsorted(own, r.value) + 1 - r.rank_error <= r.target_rank <= np.searchsorted(own, r.value, side="right") + r.rank_error
    assert max(r["n"] for r in one.select(F.size("v").alias("n")).collect()) < 400
    assert quantile_summaries(df.limit(0), "g", "v").count() == 0


# --- pairs -----------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.sampled_from("abcdefgh"), max_size=6), max_size=40), st.sets(st.sampled_from("abcdefgh")))
def test_pair_counts_by_any_split(baskets, heavy):
    got = Counter()
    for part in count_batch([sorted(b) for b in baskets], {x: i for i, x in enumerate(sorted(heavy))}):
        for r in part.itertuples():
            got[r.item_a, r.item_b] += r.n_ab
    assert got == Counter(p for b in baskets for p in combinations(sorted(b), 2))


def test_pair_counts_in_bounded_memory():
    """Records of many rare items beside many heavy ones come in blocks of bounded size."""
    import tracemalloc

    rng = np.random.default_rng(11)
    heavy = {f"h{i:04d}": i for i in range(1024)}
    names = list(heavy)
    items = [[names[j] for j in rng.choice(1024, 200, replace=False)] + [f"x{i}-{j}" for j in range(50)] for i in range(2000)]
    tracemalloc.start()
    n, most = 0, 0
    for part in count_batch(items, heavy):
        n, most = n + int(part.n_ab.sum()), max(most, len(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2000 * (250 * 249 // 2) and most <= 4_500_000 and peak < 1_000_000_000


def test_pairs_of_large_records(spark):
    """A record cut into blocks gives the pairs it would give whole."""
    big = [f"i{k:03d}" for k in range(600)]
    rows = [("r0", big), ("r1", big[:300]), ("r2", big[5:8]), ("r0", big[:10]), ("r3", ["i000"])]
    got = {(r.item_a, r.item_b): r.n_ab for r in item_pairs(spark.createDataFrame(rows, "id string, items array<string>"), "id", "items", min_count=1).collect()}
    want = Counter(p for x in ({*big}, {*big[:300]}, {*big[5:8]}) for p in combinations(sorted(x), 2))
    assert got == dict(want)


def test_item_pairs(spark):
    rows = [("r1", ["a", "b", None]), ("r1", ["c", "a"]), ("r2", ["a", "b"]), ("r3", []), ("r4", None), (None, ["a", "b"]), ("r5", ["b", "b"]), ("r2", ["a", "b"])]
    df = spark.createDataFrame(rows, "id string, items array<string>").withColumn("n", F.lit(1))
    for share in (0.01, 0.9):
        got = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab, r.n_records, round(r.lift, 6)) for r in item_pairs(df, "id", "items", share).collect()}
        assert got == {("a", "b"): (2, 3, 2, 5, round(2 * 5 / 6, 6)), ("a", "c"): (2, 1, 1, 5, 2.5), ("b", "c"): (3, 1, 1, 5, round(5 / 3, 6))}
    assert item_pairs(df.limit(0), "id", "items").count() == 0


# --- nearest time ----------------------------------------------------------------------------


def _brute(left, right, tol):
    out = set()
    for i, e, t in left:
        near = sorted((abs(rt - t), rt, rid) for rid, re, rt in right if re == e and abs(rt - t) <= tol)
        if near:
            out.add((i, near[0][2]))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=25), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60)), max_size=25), st.integers(1, 7))
def test_streaming_merge(lefts, rights, size):
    left = [(f"l{i:03d}", e, t) for i, (e, t) in enumerate(lefts)]
    right = [(f"r{i:03d}", e, t) for i, (e, t) in enumerate(rights)]
    rows = sorted([(e, 0, t, i, False) for i, e, t in left] + [(e, 0, t, i, True) for i, e, t in right])
    pdf = pd.DataFrame(rows, columns=["e", "b", "t", "id", "r"]).astype({"e": "int64", "b": "int64", "t": "int64", "r": bool})
    batches = [pdf.iloc[k : k + size].reset_index(drop=True) for k in range(0, len(pdf), size)]
    got = {(r.l, r.r) for out in merge_sorted(iter(batches), 9) for r in out.itertuples()}
    assert got == _brute(left, right, 9)


def test_match_nearest_across_buckets(spark):
    rng = np.random.default_rng(5)
    at = lambda s: START + timedelta(seconds=int(s))
    left = [(f"l{i}", int(rng.integers(0, 3)), int(s)) for i, s in enumerate(rng.integers(0, 40_000, 300))]
    right = [(f"r{i}", 0 if rng.random() < 0.5 else int(rng.integers(0, 3)), int(s)) for i, s in enumerate(rng.integers(0, 40_000, 600))]
    right.append(("r0b", right[0][1], right[0][2]))
    ldf = spark.createDataFrame([(i, e, at(t), "x") for i, e, t in left] + [("n1", None, at(5), "x"), (None, 1, at(5), "x"), ("n2", 1, None, "x")], "lid string, seg bigint, t timestamp, b string")
    ldf = ldf.unionByName(ldf.limit(20))
    rdf = spark.createDataFrame([(i, e, at(t), 1) for i, e, t in right] + [(None, 1, at(5), 1), ("q", None, at(5), 1)], "rid string, seg bigint, t timestamp, e int")
    got = match_nearest(ldf, rdf, "lid", "rid", (F.col("seg"), F.col("seg")), ("t", "t"), 60, 200).collect()
    assert {(r.lid, r.rid) for r in got} == _brute(left, right, 60) and len(got) == len({r.lid for r in got})
    assert match_nearest(ldf, rdf.limit(0), "lid", "rid", (F.col("seg"), F.col("seg")), ("t", "t"), 60).count() == 0


# --- packing ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=60))
def test_assignment_fits(sizes):
    s = np.sort(np.array(sizes, np.int64))[::-1]
    got = assign(s, 100, Cost())
    load = np.bincount(got, s, minlength=1) if len(s) else np.zeros(1)
    assert load.max() <= 100 and (not len(s) or got.max() + 1 >= least_containers(s, 100))


def test_little_room_is_left():
    """Sizes like those of the texts fill small and large containers nearly whole."""
    rng = np.random.default_rng(14)
    sizes = np.clip(rng.lognormal(5.0, 0.9, 16_000), 1, None).astype(np.int64)
    for capacity in (256, 1024, 8192):
        s = np.sort(sizes[sizes <= capacity])[::-1]
        got = assign(s, capacity, Cost())
        assert got.max() + 1 <= 1.01 * least_containers(s, capacity)


def test_least_containers_is_a_bound():
    rng = np.random.default_rng(6)
    for _ in range(200):
        s = np.sort(rng.integers(1, 11, rng.integers(1, 8)))[::-1]
        best = len(s)

        def search(i, bins, s=s):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(s):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] >= s[i]:
                    search(i + 1, [*bins[:k], bins[k] - s[i], *bins[k + 1 :]])
            search(i + 1, [*bins, 10 - s[i]])

        search(0, [])
        assert least_containers(s, 10) <= best


def test_pack(spark):
    rng = np.random.default_rng(7)
    sizes = [(i, int(x)) for i, x in enumerate(rng.gamma(1.5, 120, 3000))] + [(9001, 5000), (9002, 0), (9003, None), (7, 50)]
    df = spark.createDataFrame(sizes, "id bigint, n bigint").withColumn("bucket", F.lit("x"))
    caps = [("s", 256), ("m", 1024)]
    packed = pack(df, "id", "n", caps, bucket_items=1000)
    got = packed.toPandas()
    for name, cap in caps:
        one = got[got.container_name == name]
        assert one.groupby("container_id").n_tokens.sum().max() <= cap
        assert one.n_tokens.sum() == sum(n or 0 for _, n in sizes)
        whole = one.groupby("id").size()
        assert set(one.id) == {i for i, _ in sizes} and all(whole[i] == 1 for i, n in sizes if (n or 0) <= cap and i != 7)
        big = one[one.id == 9001].sort_values("piece_no")
        assert big.token_start.tolist() == list(range(0, 5000, cap)) and (big.n_tokens.iloc[:-1] == cap).all()
    used = {r.container_name: r.used_share for r in packing_report(packed, caps).collect()}
    assert used["s"] > 0.9 and used["m"] > 0.97
    assert pack(df.limit(0), "id", "n", caps).count() == 0
    with pytest.raises(ValueError):
        pack(df, "id", "n", [("zero", 0)])


def test_token_counts(spark):
    texts = [("Traffic is heavy.",), ("",), (None,), ("<|endoftext|>",), ("a" * 50_000,), ("wort " * 20_000,)]
    got = [r.n_tokens for r in token_counts(spark.createDataFrame(texts, "t string").withColumn("k", F.monotonically_increasing_id()), "t").orderBy("k").collect()]
    assert got[1:3] == [0, 0] and 3 <= got[0] <= 6 and got[3] > 1 and got[5] >= 20_000


# --- mixing ----------------------------------------------------------------------------------


def _best_cost(patterns, targets, quota):
    """Least cost of a flow that meets the quotas, by trying every split of small patterns."""
    limit = {t.source: t.max_repeats for t in targets}
    units = [(p, r) for p, n in patterns.items() for r in range(1, max(limit[s] for s in p) + 1) for _ in range(n)]
    best = {tuple(sorted(quota.items())): 0}
    for p, r in units:
        new = dict(best)
        for state, cost in best.items():
            for s in p:
                q = dict(state)
                if r <= limit[s] and q[s] > 0:
                    q[s] -= 1
                    key = tuple(sorted(q.items()))
                    new[key] = min(new.get(key, 10**9), cost + r * r)
        best = new
    return best.get(tuple(sorted((s, 0) for s in quota)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sets(st.sampled_from("abc"), min_size=1).map(lambda x: tuple(sorted(x))), st.integers(1, 3), min_size=1, max_size=4), st.lists(st.integers(1, 4), min_size=3, max_size=3), st.lists(st.integers(1, 2), min_size=3, max_size=3))
def test_routes_cost_least_and_are_largest(patterns, weights, repeats):
    targets = [Target(s, w / sum(weights), r) for s, w, r in zip("abc", weights, repeats, strict=True)]
    flows, quota = route(patterns, targets)
    sent = Counter()
    for (p, r, s), n in flows.items():
        assert s in p and r <= dict(zip("abc", repeats, strict=True))[s]
        sent[s] += n
    assert all(sent[s] == q for s, q in quota.items())
    for (p, r) in {(p, r) for p, r, _ in flows}:
        assert sum(n for (a, b, _), n in flows.items() if (a, b) == (p, r)) <= patterns[p]
    assert sum(r * r * n for (_, r, _), n in flows.items()) == _best_cost(patterns, targets, quota)
    # two tokens more for every source that has any cannot be met
    there = {t.source for t in targets if any(t.source in p for p in patterns)}
    assert _best_cost(patterns, targets, {s: q + 2 * (s in there) for s, q in quota.items()}) is None


def test_routes_of_many_patterns():
    rng = np.random.default_rng(12)
    names = [f"s{i:02d}" for i in range(13)]
    patterns = {tuple(s for s, x in zip(names, bits, strict=True) if x): int(rng.integers(1, 10**9)) for bits in np.unique(rng.random((10_000, 13)) < 0.4, axis=0) if any(bits)}
    targets = [Target(s, float(x), int(rng.integers(1, 5))) for s, x in zip(names, rng.dirichlet(np.ones(13)), strict=True)]
    began = time.time()
    flows, quota = route(patterns, targets)
    assert time.time() - began < 20 and len(patterns) > 2000
    for s, q in quota.items():
        assert sum(n for (_, _, t), n in flows.items() if t == s) == q


def test_route_meets_shares():
    targets = [Target("a", 0.5, 1), Target("b", 0.3, 3), Target("c", 0.1, 2), Target("gone", 0.1, 1)]
    flows, quota = route({("a",): 1000, ("a", "b"): 200, ("b",): 100, ("c",): 400}, targets)
    total = sum(quota.values())
    for t in targets[:3]:
        assert abs(quota[t.source] / total - t.share / 0.9) < 0.01
        assert sum(n for (_, _, s), n in flows.items() if s == t.source) == quota[t.source]
    assert quota["gone"] == 0 and all(r <= {"a": 1, "b": 3, "c": 2}[s] for _, r, s in flows)
    assert route({}, targets)[1]["a"] == 0


def test_mix(spark):
    rng = np.random.default_rng(8)
    rows = [(i, ["big", "Big.", " BIG "][i % 3], f"t{i}", int(rng.integers(5, 60))) for i in range(600)]
    rows += [(1000 + i, "small", f"s{i}", int(rng.integers(5, 60))) for i in range(60)]
    rows += [(2000 + i, "small", f"t{i}", rows[i][3]) for i in range(40)]  # texts of both sources
    rows += [(1, "big", "t1", rows[1][3]), (3000, None, "u", 9), (3001, "other", "v", 9), (3002, "big", None, 9), (3003, "big", "w", None), (3004, "big", "x", 0)]
    df = spark.createDataFrame(rows, "id bigint, source string, content string, n bigint").withColumn("_p", F.lit(1))
    targets = [Target("big", 0.6, 1), Target("small", 0.3, 4), Target("absent", 0.1, 2)]
    mixed = mix(df, "id", "source", "content", "n", targets)
    got = mixed.toPandas()
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, mix(df.repartition(5), "id", "source", "content", "n", targets).toPandas().to_numpy().tolist()))
    limit = {"big": 1, "small": 4}
    assert all(r.n_uses <= limit[r.source] for r in got.itertuples()) and not got.duplicated(["id", "source"]).any()
    shares = {r.source: r.actual_share for r in mix_shares(mixed, targets).collect()}
    assert abs(shares["big"] - 2 / 3) < 0.01 and abs(shares["small"] - 1 / 3) < 0.01 and shares["absent"] == 0
    assert mix(df.limit(0), "id", "source", "content", "n", targets).count() == 0


# --- pages -----------------------------------------------------------------------------------

PROSE = "The council met on Tuesday to discuss the closure of the bridge, and residents asked when the road will open again. "
SPAM = {
    "keywords": "used van dash cam roof box used van cheap tyres dash cam used van roof box " * 8,
    "pipes": "dash cam | roof box | used van | cheap tyres | dash cam | roof box | dash cam | toll pass | " * 5,
    "tags": "#dashcam #led #suv #roadtrip #usb #gps #black #wifi #rubber #parking " * 5,
    "links": "\n".join(f'<a href="https://shop.site{i}.example/list?id={i}">roof box</a>' for i in range(15)),
    "markdown": "\n".join(f"[cheap tyres](http://go.tyres{i}.example/top10)" for i in range(15)),
    "pressed": "Compare dash cam, find dash cam, get dash cam today! The best dash cam in town is dash cam from dash cam town. " * 6,
    "offers": "in stock | sku 8123 | 45.99 | add to cart | -20% | Used Van X12 | " * 8,
    "wrapped": PROSE + "\n" + "\n".join(f"* brake pads www.pads{i}.example" for i in range(25)) + "\n" + PROSE,
}
FINE = {
    "prose": PROSE * 5,
    "link": PROSE * 4 + "See https://city.example/roads for the map.",
    "log": "\n".join(f"{h:02d}:15 SEG00{h:02d} cabinet opened, fuse replaced" for h in range(20)),
    "stock": "\n".join(f"{n} x traffic cone, spare, yard North" for n in range(3, 20)),
    "table": "\n".join(f"Westgate   {h:02d}:10  {h:02d}:30  {h:02d}:50" for h in range(6, 20)),
    "closures": "\n".join(f"- Mill Road {n} westbound: closed from 08:{n} to 17:20 because of a fallen branch" for n in range(10, 30)),
    "empty": "",
    "word": "Test.",
    "long": PROSE * 3000,
}


# Languages that nothing in the package lists: sentence frames, their fillers, and what their keyword pages repeat.
OTHER = {
    "it": (["Il {0} della {1} è chiuso da ieri perché la {2} non ha ancora finito i lavori.", "Non si sa quando il {0} sarà riaperto, ma la {2} dice che per la {1} ci vorrà una settimana.", "Chi va verso la {1} deve passare per il {0}, come ha detto la {2} in una nota."],
           ["ponte", "sottopasso", "viale", "casello", "raccordo", "incrocio", "parcheggio", "cantiere"], ["stazione", "piazza", "scuola", "periferia", "fabbrica", "collina", "diga", "chiesa"], ["polizia", "squadra", "provincia", "ditta", "stampa", "centrale"], "gomme economiche portapacchi usato furgone offerta"),
    "nl": (["De {0} bij het {1} is sinds gisteren dicht omdat de {2} nog niet klaar is met het werk.", "Het is niet bekend wanneer de {0} weer open gaat, maar de {2} zegt dat het voor het {1} een week duurt.", "Wie naar het {1} wil moet over de {0}, zoals de {2} in een bericht heeft gezegd."],
           ["brug", "tunnel", "laan", "afrit", "rotonde", "kruising", "sluis", "kade"], ["station", "plein", "ziekenhuis", "dorp", "stadion", "kanaal", "bos", "fort"], ["politie", "aannemer", "provincie", "brandweer", "gemeente", "ploeg"], "goedkope banden dakkoffer tweedehands bestelbus korting"),
    "zh": (["{1}附近的{0}从昨天起关闭，因为{2}的工作还没有完成。", "目前不知道{0}什么时候可以重新开放，但是{2}说{1}的工程需要一个星期。", "去{1}的人应该走{0}，这是{2}在通知里说的。"],
           ["大桥", "隧道", "高架", "匝道", "环岛", "路口", "堤坝", "码头"], ["车站", "广场", "医院", "村庄", "球场", "运河", "树林", "学校"], ["警察", "施工队", "市政府", "消防队", "交通局", "媒体"], "便宜 轮胎 车顶箱 二手 货车 优惠"),
}


def _other_pages(lang, n, rng):
    frames, a, b, c, spam = OTHER[lang]
    fine = [(" " if lang != "zh" else "").join(frames[rng.integers(3)].format(a[rng.integers(8)], b[rng.integers(8)], c[rng.integers(6)]) for _ in range(rng.integers(3, 9))) for _ in range(n)]
    words = spam.split()
    bad = [" ".join(words[i] for i in rng.integers(0, len(words), 120)) for _ in range(n // 12)]
    return fine, bad


def test_pages(spark):
    rng = np.random.default_rng(9)
    names = list(SPAM) + list(FINE)
    rows = [(i, (SPAM | FINE)[n], 1) for i, n in enumerate(names)] + [(99, None, 1), (0, SPAM["keywords"], 1)]
    places = ["Mill Road", "Westgate", "the old bridge", "Station Square", "the ring road", "Quay Street", "the hospital", "the depot"]
    frames = ["The crew had closed {} by noon, but it was open to buses again in the evening.", "A driver on the way to {} said that there was no sign and that we should have been told.", "It is not known when the work at {} will be over, as the council has yet to decide.", "Two of the lanes near {} were shut for an hour because of a burst main."]
    rows += [(1000 + i, " ".join(frames[rng.integers(4)].format(places[rng.integers(8)]) for _ in range(rng.integers(3, 9))), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, text string, levels int")
    found = {r.id for r in stuffed_pages(df, "id", "text").collect()}
    assert {names[i] if i < 99 else i for i in found} == set(SPAM)
    shares = page_shares(df, "id", "text").toPandas()
    assert len(shares) == len(rows) and shares[shares.id == 99].n_words.iloc[0] == 0
    parts = shares[[c for c in shares if c.endswith("_share")]].sum(axis=1)
    assert np.allclose(parts[shares.n_words > 0], 1)
    assert stuffed_pages(df.limit(0), "id", "text").count() == 0


def test_pages_of_other_languages(spark):
    """Precision and recall on languages of which no word is listed anywhere, one of them without spaces."""
    rng = np.random.default_rng(10)
    rows = []
    for lang in OTHER:
        fine, bad = _other_pages(lang, 240, rng)
        rows += [(len(rows) + i, t, lang, x) for i, (t, x) in enumerate([(t, 0) for t in fine] + [(t, 1) for t in bad])]
    df = spark.createDataFrame(rows, "id bigint, text string, lang string, bad int")
    found = {r.id for r in stuffed_pages(df, "id", "text", lang="lang").collect()}
    for lang in OTHER:
        true = {i for i, _, g, x in rows if g == lang and x}
        got = {i for i, _, g, _ in rows if g == lang and i in found}
        assert len(true & got) >= 0.95 * len(true) and len(true & got) >= 0.95 * len(got), (lang, len(true), len(got), len(true & got))


def test_common_words_of_few_pages(spark):
    """Too few pages give no list, and pages are then judged by their other features."""
    df = spark.createDataFrame([(i, PROSE * 3, None) for i in range(20)] + [(50, SPAM["keywords"], "en"), (51, SPAM["links"], None)], "id bigint, text string, lang string")
    assert not common_words(df, "text", "lang").hashes
    assert {r.id for r in stuffed_pages(df, "id", "text", lang="lang").collect()} == {50, 51}


def test_a_rare_language_beside_a_usual_one(spark):
    """Pages of a language too rare for a list of its own are not flagged for lacking the other's function words."""
    rng = np.random.default_rng(13)
    fine, bad = _other_pages("it", 400, rng)
    rare, rare_bad = _other_pages("nl", 24, rng)
    texts = [(t, "it", 0) for t in fine] + [(t, "it", 1) for t in bad] + [(t, "nl", 0) for t in rare] + [(t, "nl", 1) for t in rare_bad]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "id bigint, text string, lang string, bad int")
    assert {r.id for r in stuffed_pages(df, "id", "text", lang="lang").collect()} == {i for i, x in enumerate(texts) if x[2]}


def test_all_words_are_counted():
    texts = [*(SPAM | FINE).values(), None, "", "\x00 a\x00b", "Straße über-all’s «ok»"]
    page, _, words = batch_features(texts)
    plain = [re.findall(r"\w+", re.sub(r"</?a\b[^>]*>", lambda m: m.group(), (t or "").replace("\x00", " "))) for t in texts]
    assert np.bincount(page, words, len(texts)).tolist() == [len(w) for w in plain]
    # pages do not meet: each alone gives what it gives among the others
    for i, t in enumerate(texts):
        alone = batch_features([t])
        assert alone[1].tolist() == batch_features(texts)[1][page == i].tolist()
