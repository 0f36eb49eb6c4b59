"""Keyword-stuffed and link-list pages.

A page is cut into units (lines, sentences, stretches of long lines). A hidden
Markov model labels each unit as prose, link list, tag list or menu from a few
features of form. Start, transitions and the features' tables are fitted by
expectation maximisation over all pages, from starting tables that stay in as a
prior. A page is flagged if the larger part of its words lies outside prose.

What counts as a function word is learned from the pages themselves: short words
that a fair share of the pages of a language hold, and hold seldom. Scripts that
put no spaces between words are read character by character.

Features are worked out for many pages at once on the bytes of their joined text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcube.functions.hmm import forward_backward
from strandcube.session import cut, spread

STATES = ("prose", "links", "tags", "menu")

_TAG = re.compile(r"</?(?:p|br|div|b|i|em|strong|span|h[1-6])\b[^>]*>", re.I)
_NO_SPACES = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
_LINK = re.compile(r"https?://\S+|www\.\S+|\b[\w-]*[a-zA-Z][\w-]*(?:\.[\w-]+)*\.[a-z]{2,12}\b")
_RECORD = re.compile(rb"\d{1,2}:\d\d\b|\d+\s*x\s|\d{4}-\d\d-\d\d|\d{1,3}[.)]\s")
# Typographic signs and the plain ones they are read as.
_SIGNS = {
    "\x00": " ", "\u00a0": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ", "\u2028": "\n", "\u2029": "\n", "\u0085": "\n",
    "’": "'", "‘": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": "|", "›": "|", "•": "|", "·": "|", "–": "-", "—": "-", "…": "...",
    "€": "$", "£": "$", "。": ". ", "！": "! ", "？": "? ", "，": ", ", "、": ", ", "；": "; ", "：": ": ",
}
UNIT_TOKENS = 25
#: Lines of fewer tokens are stubs; stubs in a row form one unit.
STUB_TOKENS = 5
_FUNCTION = 3
#: Bytes of text that are worked on at once (a longer page is by itself).
CHUNK = 4_000_000


@dataclass(frozen=True)
class CommonWords:
    """When a word is a function word of a language: at most ``length`` bytes, in at least ``share`` of its pages, and no more frequent on some of them than on others.

    ``burst`` bounds the mean square of its frequency on the pages that hold it, over the squared mean: 1 for a
    word that is equally frequent everywhere, more for a keyword that a few pages are stuffed with.
    """

    length: int = 7
    share: float = 0.15
    burst: float = 2.4
    #: Pages of fewer words are not counted; languages of fewer pages have no list of their own.
    page_words: int = 20
    pages: int = 40
    #: Words in a smaller share of a task's pages are left out there: the error of the share.
    slack: float = 0.02


@dataclass(frozen=True)
class FunctionWords:
    """Hashes of the function words of ``languages``; in pages of other languages their absence means nothing."""

    hashes: tuple[int, ...] = ()
    languages: frozenset[str] = frozenset()


@dataclass(frozen=True)
class PageModel:
    """Start and transition probabilities, per feature a table of level probabilities per state, and the function words with the languages they are of."""

    start: tuple[float, ...]
    transitions: tuple[tuple[float, ...], ...]
    levels: tuple[tuple[tuple[float, ...], ...], ...]
    words: FunctionWords = FunctionWords()


# The starting tables, per feature one row per state (prose, links, tags, menu).
PRIOR = PageModel(
    start=(0.90, 0.03, 0.05, 0.02),
    transitions=((0.93, 0.02, 0.03, 0.02), (0.05, 0.90, 0.02, 0.03), (0.06, 0.02, 0.90, 0.02), (0.08, 0.06, 0.06, 0.80)),
    levels=(
        # share of links: none, some, many
        ((0.970, 0.025, 0.005), (0.02, 0.18, 0.80), (0.85, 0.10, 0.05), (0.55, 0.20, 0.25)),
        # hash tags: none, some, many
        ((0.990, 0.008, 0.002), (0.97, 0.02, 0.01), (0.75, 0.05, 0.20), (0.90, 0.05, 0.05)),
        # separators: few, some, many
        ((0.90, 0.09, 0.01), (0.80, 0.15, 0.05), (0.40, 0.20, 0.40), (0.30, 0.20, 0.50)),
        # function words: usual, few, none
        ((0.90, 0.08, 0.02), (0.02, 0.18, 0.80), (0.10, 0.15, 0.75), (0.05, 0.15, 0.80)),
        # terms repeated within the unit: none, some, much
        ((0.985, 0.012, 0.003), (0.70, 0.20, 0.10), (0.20, 0.30, 0.50), (0.40, 0.20, 0.40)),
        # the unit is no record, or one (it starts with a time, date, count or item number, or holds several times)
        ((0.80, 0.20), (0.98, 0.02), (0.98, 0.02), (0.98, 0.02)),
        # the unit ends like a sentence or not
        ((0.30, 0.70), (0.95, 0.05), (0.85, 0.15), (0.95, 0.05)),
        # marks of offers (prices, discounts, article numbers): none, some, many
        ((0.970, 0.027, 0.003), (0.85, 0.10, 0.05), (0.80, 0.10, 0.10), (0.25, 0.25, 0.50)),
    ),
)
#: A record reports something even without function words.
RECORD_LEVEL = 0
#: Function words of a page whose language has no list.
UNKNOWN_LEVEL = 3
#: Levels per feature (unknown function words are one more); a unit's levels are stored as one number to these bases.
SHAPE = tuple(len(t[0]) + (j == _FUNCTION) for j, t in enumerate(PRIOR.levels))

# --- bytes -----------------------------------------------------------------------------------


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_BREAK = _table(b"\x00\n\r\x0b\x0c\x1c\x1d\x1e")
_SPACE = _BREAK | _table(b" \t\x1f")
_DIGIT = _table(b"0123456789")
_LETTER = _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_WORD = _DIGIT | _LETTER | _table(b"_" + bytes(range(128, 256)))
_MARK, _DASH, _END = _table(b"|;,"), _table(b"-/>"), _table(b".!?")
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_MIX = np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _plain(text: str) -> str:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "\x00" in text:
        text = text.replace("\x00", " ")
    if not text.isascii():
        for a, b in _SIGNS.items():
            text = text.replace(a, b)
        if _NO_SPACES.search(text):
            text = _NO_SPACES.sub(r" \g<0> ", text)
    return text


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true values."""
    d = np.diff(np.concatenate(([False], flags, [False])).view(np.int8))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _hashes(b: np.ndarray, word: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word, without regard to ASCII case."""
    if not len(starts):
        return np.empty(0, np.uint64)
    at = np.flatnonzero(word)
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(first, size)
    return np.add.reduceat(_LOWER[b[at]] * _MIX[place & 63], first) * _A + size.astype(np.uint64)


def word_hash(word: str) -> int:
    b = np.frombuffer(word.encode(), np.uint8)
    return int(_hashes(b, np.ones(len(b), bool), np.array([0]), np.array([len(b)]))[0])


def _chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Plain texts in stretches of about ``CHUNK`` bytes, with the number of the first."""
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        held.append(_plain(t or ""))
        size += len(held[-1])
        if size >= CHUNK:
            yield i + 1 - len(held), held
            held, size = [], 0
    if held:
        yield len(texts) - len(held), held


def _units(b: np.ndarray, ts: np.ndarray, te: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit of each token, page of each token, and whether a token begins a stub line behind another one.

    Units are lines, cut behind sentences of at least ``STUB_TOKENS`` tokens (shorter
    ones join what follows on their line) and into stretches of ``UNIT_TOKENS``
    tokens; short lines in a row join each other.
    """
    line = np.searchsorted(np.flatnonzero(_BREAK[b]), ts)
    page = np.searchsorted(np.flatnonzero(b == 0), ts)
    new_line = np.r_[True, line[1:] != line[:-1]]
    row = np.cumsum(new_line) - 1
    stub = (np.bincount(row) < STUB_TOKENS)[row]
    stop = _END[b[te - 1]]
    piece = np.cumsum(new_line | np.r_[False, stop[:-1]]) - 1
    closed = stop & (np.bincount(piece) >= STUB_TOKENS)[piece]
    same_stubs = np.r_[False, stub[1:] & stub[:-1] & (page[1:] == page[:-1])]
    begin = ~same_stubs & (new_line | np.r_[False, closed[:-1]])
    run = np.cumsum(begin) - 1
    begin |= (np.arange(len(ts)) - np.flatnonzero(begin)[run]) % UNIT_TOKENS == 0
    return np.cumsum(begin) - 1, page, same_stubs & new_line


def _chunk_features(pages: list[str], common: np.ndarray, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Page, levels (of the features in the order of ``PRIOR``, as one number) and words of each unit of some pages; units without words are left out."""
    raw = "\x00".join(pages).encode("utf-8", "replace")
    b = np.frombuffer(raw, np.uint8)
    ts, te = _runs(~_SPACE[b]) if len(b) else (np.empty(0, np.int64),) * 2
    if not len(ts):
        return np.empty(0, np.int64), np.empty(0, np.int16), np.empty(0, np.int64)
    unit, page, bar = _units(b, ts, te)
    n_units = int(unit[-1]) + 1
    head = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    tail = np.r_[head[1:], len(ts)] - 1
    of = lambda at: unit[np.searchsorted(ts, at, side="right") - 1]
    per_unit = lambda at: np.bincount(of(at), minlength=n_units)
    word = _WORD[b]
    ws, we = _runs(word)
    wu = of(ws)
    n = np.bincount(wu, minlength=n_units)
    some = np.maximum(n, 1)
    h = _hashes(b, word, ws, we)
    far = np.concatenate((b, np.zeros(5, np.uint8)))  # to look ahead of the end; looking behind the start meets a 0 there too
    digit = _DIGIT[far]

    dots = np.flatnonzero(b == 46)
    dots = dots[(word[dots - 1] | (far[dots - 1] == 45)) & _LETTER[far[dots + 1]] & _LETTER[far[dots + 2]]]
    slashes = np.flatnonzero((b == 58) & (far[1 : len(b) + 1] == 47) & (far[2 : len(b) + 2] == 47))
    links = np.zeros(n_units)
    for t in np.unique(np.searchsorted(ts, np.r_[dots, slashes], side="right") - 1).tolist():
        links[unit[t]] += len(_LINK.findall(raw[ts[t] : te[t]].decode("utf-8", "replace")))
    link = _level(links / (tail - head + 1), 1e-9, 0.12)

    tag = _level(per_unit(np.flatnonzero(b == 35)) / some, 0.02, 0.25)

    inner = np.ones(len(ts), bool)
    inner[tail] = False
    stops = _END[b[te - 1]] & inner & (te - ts > 1) & word[np.maximum(te - 2, 0)]
    inner[head] = False
    dashes = (te - ts == 1) & _DASH[b[ts]] & inner
    marks = per_unit(np.flatnonzero(_MARK[b])) + np.bincount(unit, stops.astype(float) + dashes + bar, n_units)

    percent = np.flatnonzero(b == 37)
    percent = percent[digit[percent - 1] | ((far[percent - 1] == 32) & digit[percent - 2])]
    price = np.flatnonzero(((b == 46) | (b == 44)) & digit[1 : len(b) + 1] & digit[2 : len(b) + 2])
    price = price[digit[price - 1] & ~_WORD[far[price + 3]] & ~(((far[price + 3] == 46) | (far[price + 3] == 58)) & digit[price + 4])]
    before = far[ws[np.maximum(np.searchsorted(ws, price, side="left") - 1, 0)] - 1] if len(ws) else price
    price = price[(before != 46) & (before != 58)]
    offers = per_unit(np.r_[np.flatnonzero(b == 36), percent, price]) + np.bincount(wu, h == _SKU, n_units)
    offer = _level(offers / some, 0.06, 0.15)

    record = np.zeros(n_units, bool)
    if len(ws):
        lead = np.flatnonzero(np.r_[True, wu[1:] != wu[:-1]])
        lead = lead[digit[ws[lead]]]
        end = te[tail]
        for u, at in zip(wu[lead].tolist(), ws[lead].tolist(), strict=True):
            record[u] = _RECORD.match(raw, at, int(end[u])) is not None
    colon = np.flatnonzero(b == 58)
    clock = colon[digit[colon - 1] & digit[colon + 1] & digit[colon + 2] & ~_WORD[far[colon + 3]]]
    record |= (per_unit(colon) >= 2) & (per_unit(clock) >= 2)
    record &= (link == 0) & (offer < 2)

    spot = np.searchsorted(common, h)
    known = common[np.minimum(spot, len(common) - 1)] == h if len(common) else np.zeros(len(h), bool)
    own = listed[page[head]]  # per unit: its language has a list
    known = np.where(own[wu], known, known | (we - ws <= 3))
    share = np.bincount(wu, known, n_units) / some
    function = np.where(record, RECORD_LEVEL, np.where(n < 5, 1, 2 - _level(share, 0.08, 0.17)))
    function = np.where(own | record, function, UNKNOWN_LEVEL)

    plain = ~known & ~(digit[ws] & digit[we - 1])
    c = np.flatnonzero(plain)
    key = (h[c] ^ (wu[c].astype(np.uint64) * _B)) * _A
    code, names = pd.factorize(key)
    times = np.bincount(code, minlength=len(names))[code]
    thrice = np.bincount(wu[c], times >= 3, n_units)
    near = np.flatnonzero((c[1:] == c[:-1] + 1) & (wu[c[1:]] == wu[c[:-1]]) & (times[1:] > 1) & (times[:-1] > 1))
    pair, names = pd.factorize(key[near] * _B + key[near + 1])
    twice = np.bincount(wu[c[near]], 2.0 * (np.bincount(pair, minlength=len(names))[pair] >= 2), n_units)
    repeated = np.where((n >= 6) & ~record, np.minimum(np.maximum(twice, thrice) / some, 1), 0)

    ends = _END[b[te[tail] - 1]] & (links == 0)
    found = [link, tag, _level(marks / some, 0.16, 0.28), function, _level(repeated, 0.12, 0.3), record, ends, offer]
    levels = np.ravel_multi_index([x.astype(np.int64) for x in found], SHAPE).astype(np.int16)
    full = n > 0
    return page[head][full], levels[full], n[full]


_SKU = np.uint64(word_hash("sku"))


def _level(x: np.ndarray, a: float, b: float) -> np.ndarray:
    return (x >= a).astype(np.int8) + (x >= b)


def batch_features(texts: Sequence[str | None], languages: Sequence[str] | None = None, words: FunctionWords = FunctionWords()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Page (place in ``texts``), levels (see :func:`_chunk_features`) and words of each unit of the texts; pages without words have no unit."""
    known = np.array(sorted(words.hashes), np.uint64)
    listed = np.array([x in words.languages for x in (languages if languages is not None else [""] * len(texts))], bool)
    got = [(i, _chunk_features(pages, known, listed[i : i + len(pages)])) for i, pages in _chunks(texts)]
    if not got:
        return np.empty(0, np.int64), np.empty(0, np.int16), np.empty(0, np.int64)
    return np.concatenate([g[0] + i for i, g in got]), np.concatenate([g[1] for _, g in got]), np.concatenate([g[2] for _, g in got])


# --- function words --------------------------------------------------------------------------


def common_words(df: DataFrame, text: str, lang: str | None = None, rule: CommonWords | None = None) -> FunctionWords:
    """The function words of all languages of ``df`` together (see :class:`CommonWords`).

    ``lang`` labels the pages; wrong labels and NULL (a language of its own) only
    blur the shares. Without it all pages are one language. Equal pages of a task
    count once, so that copies of a page do not make its words common. Each task
    sends a bounded number of short words; empty if no language has enough pages.
    """
    r = rule or CommonWords()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        parts = []
        for pdf in batches:
            texts = []
            for t, g in zip(pdf["t"], pdf["g"], strict=True):
                if t and (k := hash(t)) not in seen:
                    seen.add(k)
                    texts.append((t, g))
            for first, pages in _chunks([t for t, _ in texts]):
                parts.append(_page_words(pages, np.array([g for _, g in texts[first : first + len(pages)]], object), r))
        if parts:
            sums = pd.concat(parts).groupby(["g", "h"], as_index=False).sum()
            n = sums["g"].map(sums[sums["h"] == 0].set_index("g")["pages"])
            yield sums[(sums["h"] == 0) | (sums["pages"] >= r.slack * n)]

    rows = spread(df.select(F.col(text).alias("t"), _language(lang).alias("g"))).mapInPandas(count, "g string, h bigint, pages bigint, rate double, square double")
    sums = rows.groupBy("g", "h").agg(F.sum("pages").alias("pages"), F.sum("rate").alias("rate"), F.sum("square").alias("square"))
    sums = cut(sums)
    size = sums.where("h = 0").select("g", F.col("pages").alias("n")).where(F.col("n") >= r.pages)
    often = sums.where("h <> 0").join(size, "g").where((F.col("pages") >= r.share * F.col("n")) & (F.col("square") * F.col("pages") <= r.burst * F.col("rate") * F.col("rate")))
    # A language has at most 1 / share times the mean number of short words on its pages.
    hashes = tuple(sorted({int(x["h"]) & (2**64 - 1) for x in often.select("h").distinct().collect()}))
    return FunctionWords(hashes, frozenset(x["g"] for x in size.select("g").collect()))


def _language(lang: str | None) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang else F.lit("")


def _page_words(pages: list[str], group: np.ndarray, r: CommonWords) -> pd.DataFrame:
    """Per group and short word its pages, and the sums of its frequency there and of its square; the pages of a group stand at h = 0."""
    b = np.frombuffer("\x00".join(pages).encode("utf-8", "replace"), np.uint8)
    word = _WORD[b]
    ws, we = _runs(word) if len(b) else (np.empty(0, np.int64),) * 2
    page = np.searchsorted(np.flatnonzero(b == 0), ws)
    n = np.bincount(page, minlength=len(pages))
    h = _hashes(b, word, ws, we)
    ok = (we - ws <= r.length) & ~_DIGIT[b[ws]] & (n[page] >= r.page_words)
    page, h = page[ok], h[ok]
    code, names = pd.factorize(group)
    on, _ = pd.factorize((h ^ (page.astype(np.uint64) * _B)) * _A)  # word and page
    spot = np.zeros(int(on.max(initial=-1)) + 1, np.int64)
    spot[on] = np.arange(len(on))
    rate = np.bincount(on, minlength=len(spot)) / n[page[spot]]
    h, g = h[spot], code[page[spot]]
    key, _ = pd.factorize((h ^ (g.astype(np.uint64) * _B)) * _A)
    size = int(key.max(initial=-1)) + 1
    spot = np.zeros(size, np.int64)
    spot[key] = np.arange(len(key))
    sums = {"pages": np.bincount(key, minlength=size), "rate": np.bincount(key, rate, size), "square": np.bincount(key, rate * rate, size)}
    words = pd.DataFrame({"g": names[g[spot]], "h": h[spot].view(np.int64)} | sums)
    counted = np.bincount(code[n >= r.page_words], minlength=len(names)) if len(names) else np.empty(0, np.int64)
    return pd.concat([words, pd.DataFrame({"g": names, "h": 0, "pages": counted, "rate": 0.0, "square": 0.0})])


# --- model -----------------------------------------------------------------------------------


def _emissions(model: PageModel) -> np.ndarray:
    """Probability of each combination of levels in each state, up to a factor per combination."""
    levels = np.unravel_index(np.arange(np.prod(SHAPE)), SHAPE)
    logs = np.zeros((len(levels[0]), len(STATES)))
    for j, table in enumerate(model.levels):
        full = np.ones((len(STATES), SHAPE[j]))
        full[:, : len(table[0])] = table
        logs += np.log(full).T[levels[j]]
    return np.exp(logs - logs.max(1, keepdims=True))


def page_frame(df: DataFrame, doc_id: str, text: str, words: FunctionWords, lang: str | None = None) -> DataFrame:
    """``id, levels, words``: each row's features as bytes, computed once for training and scoring."""

    function = words

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            page, levels, n = batch_features(pdf["t"].tolist(), pdf["g"].tolist(), function)
            at = np.searchsorted(page, np.arange(len(pdf) + 1)).tolist()
            lv, wd = levels.tobytes(), n.astype(np.int32).tobytes()
            spans = list(zip(at, at[1:], strict=False))
            yield pd.DataFrame({"id": pdf["id"], "levels": [lv[2 * a : 2 * z] for a, z in spans], "words": [wd[4 * a : 4 * z] for a, z in spans]})

    rows = spread(df.select(F.col(doc_id).alias("id"), F.col(text).alias("t"), _language(lang).alias("g")))
    return cut(rows.mapInPandas(extract, f"id {df.schema[doc_id].dataType.simpleString()}, levels binary, words binary"))


def _posterior(pdf: pd.DataFrame, model: PageModel, moved: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths in units, levels, words and state probabilities of a batch of :func:`page_frame`."""
    words = np.frombuffer(b"".join(pdf["words"]), np.int32)
    levels = np.frombuffer(b"".join(pdf["levels"]), np.int16)
    lengths = np.array([len(w) // 4 for w in pdf["words"]], np.int64)
    full = lengths[lengths > 0]
    post = forward_backward(_emissions(model)[levels], full, np.array(model.transitions), np.array(model.start), moved) if len(full) else np.empty((0, len(STATES)))
    return lengths, levels, words, post


#: The rows of expected counts that are no feature: starts and transitions.
_START, _MOVE = -1, -2


def train_page_model(pages: DataFrame, words: FunctionWords = FunctionWords(), rounds: int = 20, prior: PageModel = PRIOR, strength: float = 1.0, tolerance: float = 0.02) -> PageModel:
    """Expectation maximisation over all of :func:`page_frame`, until no probability moves by ``tolerance`` (at most ``rounds`` rounds).

    Only expected counts (under 150 numbers a task) reach the driver. ``strength``
    is the weight of the prior tables against the counts of their state, so that
    the states keep their meaning on any corpus.
    """
    model = replace(prior, words=words)
    for _ in range(rounds):
        rows = pages.mapInPandas(_counter(model), "j int, s int, v int, x double").groupBy("j", "s", "v").agg(F.sum("x").alias("x")).collect()
        got = {(r.j, r.s, r.v): r.x for r in rows}

        def fitted(j: int, s: int, p: Sequence[float], got: dict = got) -> tuple[float, ...]:
            seen = np.array([got.get((j, s, v), 0.0) for v in range(len(p))])
            mixed = seen + strength * max(seen.sum(), 1.0) * np.array(p)
            return tuple(mixed / mixed.sum())

        levels = tuple(tuple(fitted(j, s, p) for s, p in enumerate(table)) for j, table in enumerate(prior.levels))
        new = PageModel(fitted(_START, 0, prior.start), tuple(fitted(_MOVE, s, p) for s, p in enumerate(prior.transitions)), levels, words)
        flat = lambda m: np.concatenate([np.ravel(m.start), np.ravel(m.transitions), *[np.ravel(t) for t in m.levels]])
        step = float(np.abs(flat(new) - flat(model)).max())
        model = new
        if step < tolerance:
            break
    return model


def _counter(model: PageModel) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Expected counts of (feature, state, level), starts and transitions of a task's pages."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(STATES)
        start, moved = np.zeros(k), np.zeros((k, k))
        sums = np.zeros((k, int(np.prod(SHAPE))))
        for pdf in batches:
            lengths, levels, _, post = _posterior(pdf, model, moved)
            full = lengths[lengths > 0]
            start += post[np.cumsum(full) - full].sum(0)
            for s in range(k):
                sums[s] += np.bincount(levels, post[:, s], sums.shape[1])
        by_feature = [sums.reshape(k, *SHAPE).sum(tuple(i + 1 for i in range(len(SHAPE)) if i != j)) for j in range(len(SHAPE))]
        rows = [(j, s, v, float(x)) for j, t in enumerate(by_feature) for (s, v), x in np.ndenumerate(t)]
        rows += [(_START, 0, v, float(x)) for v, x in enumerate(start)] + [(_MOVE, s, v, float(x)) for (s, v), x in np.ndenumerate(moved)]
        yield pd.DataFrame(rows, columns=["j", "s", "v", "x"])

    return count


def page_shares(df: DataFrame, doc_id: str, text: str, model: PageModel | None = None, lang: str | None = None) -> DataFrame:
    """Per row of ``df``: ``doc_id, n_words`` and the share of its words in each state (0 if it has no words).

    Without ``model`` one is trained on these pages; ``lang`` names a column of
    language labels for their function words. NULL and empty texts have 0 words.
    Whole texts are read, however long; rows are scored one by one, so repeated
    rows and ids give repeated results.
    """
    function = model.words if model else common_words(df, text, lang)
    pages = page_frame(df, doc_id, text, function, lang)
    found = model or train_page_model(pages, function)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths, _, words, post = _posterior(pdf, found)
            page = np.repeat(np.arange(len(lengths)), lengths)
            total = np.bincount(page, words, len(lengths))
            out = {"id": pdf["id"], "n_words": total.astype(np.int64)}
            for s, name in enumerate(STATES):
                out[f"{name}_share"] = np.bincount(page, words * post[:, s], len(lengths)) / np.maximum(total, 1)
            yield pd.DataFrame(out)

    kind = df.schema[doc_id].dataType.simpleString()
    shares = ", ".join(f"{s}_share double" for s in STATES)
    return pages.mapInPandas(score, f"id {kind}, n_words bigint, {shares}").withColumnRenamed("id", doc_id)


def stuffed_pages(df: DataFrame, doc_id: str, text: str, model: PageModel | None = None, min_share: float = 0.35, lang: str | None = None) -> DataFrame:
    """The pages with more than ``min_share`` of their words outside prose, with their shares."""
    shares = page_shares(df, doc_id, text, model, lang)
    return shares.where((F.col("n_words") > 0) & (1 - F.col("prose_share") > min_share))
