"""Mixing sources to target weights by min-cost flow over membership patterns.

Records with the same text may belong to several sources. They are aggregated to
membership patterns (the set of target sources a text belongs to), which are few;
a min-cost flow routes the patterns' tokens to the sources' quotas, the r-th use
of a pattern costing more than the one before. The records of each pattern are
then laid out in seeded random order by a distributed prefix sum, and each stretch
of the line goes, with the records whose middle it holds, to the source the flow
gave it to.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandcube.functions.labels import fold, plain
from strandcube.session import cut

#: Combinations of sources that the driver routes (about 100 bytes a source each), and target sources; more are refused.
MAX_PATTERNS = 100_000
MAX_SOURCES = 1000


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    max_repeats: int


class Supply:
    """Flow from supplies to the sources that may use them, by augmenting paths over sources.

    A path gives unused supply to one source, which hands as much of what it has to
    the next one, and so on to a source that lacks some. A step moves what all
    supplies together can give, so there are few paths however many supplies there
    are. Amounts are whole numbers, exact up to 2**53.
    """

    def __init__(self, amounts: np.ndarray, member: np.ndarray, demand: np.ndarray) -> None:
        self.member = member
        self.amounts, self.left = amounts.astype(float), np.zeros(len(amounts))
        self.flow = np.zeros(member.T.shape)  # source by supply
        self.lacks = demand.astype(float)

    def open(self, rows: np.ndarray) -> None:
        """Make the supplies ``rows`` usable and send as much as can be sent."""
        self.left[rows] = self.amounts[rows]
        while (path := self._path()) is not None:
            self._send(path)

    def _path(self) -> list[int] | None:
        """Sources from one with unused supply to one that lacks some, by breadth first."""
        queue = self._users(self.left)
        came = dict.fromkeys(queue, -1)
        for s in queue:
            if self.lacks[s] > 0:
                path = [s]
                while (s := came[s]) >= 0:
                    path.append(s)
                return path[::-1]
            for t in self._users(self.flow[s]):
                if t not in came:
                    came[t] = s
                    queue.append(t)
        return None

    def _users(self, stock: np.ndarray) -> list[int]:
        """The sources that may use some of what is in stock."""
        return np.flatnonzero(self.member[np.flatnonzero(stock)].any(0)).tolist()

    def _send(self, path: list[int]) -> None:
        stock = [self.left, *[self.flow[s] for s in path[:-1]]]
        size = min([float((x * self.member[:, t]).sum()) for x, t in zip(stock, path, strict=True)] + [float(self.lacks[path[-1]])])
        taken = []
        for x, t in zip(stock, path, strict=True):  # first all is taken, so that a step never passes on what it just got
            can = x * self.member[:, t]
            before = np.cumsum(can) - can
            taken.append(np.clip(size - before, 0, can))
        for x, part in zip(stock, taken, strict=True):
            x -= part
        for t, part in zip(path, taken, strict=True):
            self.flow[t] += part
        self.lacks[path[-1]] -= size

    def tight(self) -> np.ndarray:
        """The sources that lack some, and all that could hand on to them: together they use all they may."""
        out = self.lacks > 0
        while True:
            hands = (self.flow[:, (self.member & out).any(1)] > 0).any(1)
            if not (hands & ~out).any():
                return out
            out |= hands


def route(patterns: dict[tuple[str, ...], int], targets: Sequence[Target], total: int | None = None) -> tuple[dict[tuple[tuple[str, ...], int, str], int], dict[str, int]]:
    """Tokens of (pattern, use, source), and the quota of each source.

    The r-th use of a pattern costs r * r a token, whatever source it goes to. As
    the costs lie on the supplies alone, opening the uses in the order of their
    cost, each time sending all that can be sent, is a flow of least cost. Sources
    without any record get quota 0 and the other shares are scaled up. Without
    ``total`` the largest total is taken at which every quota can be met: the
    sources that fall short of a larger one name the next smaller total to try.
    """
    present = [t for t in targets if t.share > 0 and any(t.source in p and n for p, n in patterns.items())]
    quota = {t.source: 0 for t in targets}
    if not present:
        return {}, quota
    scale = sum(t.share for t in present)
    place = {t.source: i for i, t in enumerate(present)}
    repeats = np.array([t.max_repeats for t in present])
    share = np.array([t.share for t in present]) / scale
    rows: list[tuple[tuple[str, ...], int]] = []
    member, amounts = [], []
    for p, n in patterns.items():
        own = np.zeros(len(present), bool)
        own[[place[s] for s in p if s in place]] = True
        for r in range(1, int((repeats * own).max()) + 1 if n else 1):
            rows.append((p, r))
            member.append(own & (repeats >= r))
            amounts.append(n)
    m, w = np.array(member).reshape(-1, len(present)), np.array(amounts)
    use = np.array([r for _, r in rows])
    if total is None:
        total = int(w.sum())
        while True:
            flow = Supply(w, m, np.floor(total * share))
            flow.open(np.arange(len(rows)))
            if not (flow.lacks > 0).any():
                break
            short = flow.tight()
            total = min(total - 1, int(w[(m & short).any(1)].sum() / share[short].sum()))
    flow = Supply(w, m, np.floor(total * share))
    for r in range(1, int(use.max()) + 1):
        flow.open(np.flatnonzero(use == r))
    quota |= {t.source: int(total * x) for t, x in zip(present, share, strict=True)}
    flows = {(*rows[i], present[j].source): int(flow.flow[j, i]) for j, i in zip(*np.nonzero(flow.flow), strict=True)}
    return flows, quota


def membership(records: DataFrame, record: str, source: str, content: str, size: str, targets: Sequence[Target]) -> DataFrame:
    """One row per distinct content that belongs to a target source: ``_key, _size, _sources`` (source -> smallest record id).

    Source names are compared after folding case, spacing and punctuation.
    """
    known = {plain(t.source): t.source for t in targets}
    name = F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), fold(F.col(source)))
    rows = records.select(F.col(record).alias("_id"), name.alias("_s"), F.col(content).alias("_key"), F.col(size).cast("bigint").alias("_size"))
    rows = rows.where(F.col("_s").isNotNull() & (F.col("_size") > 0) & F.col("_key").isNotNull())
    first = rows.groupBy("_key", "_s").agg(F.min("_id").alias("_id"), F.max("_size").alias("_size"))
    return first.groupBy("_key").agg(F.max("_size").alias("_size"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_s", "_id")))).alias("_sources"))


def mix(records: DataFrame, record: str, source: str, content: str, size: str, targets: Sequence[Target], total: int | None = None, seed: int = 17, cells: int = 1024) -> DataFrame:
    """Records of the mix: ``record, source, n_uses, n_tokens`` (size of one use).

    ``content`` is a key of the record's content (equal texts, equal key): a text
    is used at most ``max_repeats`` times under a source, by the smallest record
    id it has there, and its r-th use in all goes only to a source that allows r
    uses. Records of no target source, of size 0 and without content are left
    out. ``total`` is the size of the mix (by default the largest at which every
    source meets its share). The draw depends on ``seed`` and the contents only.
    Empty input gives no rows.
    """
    targets = [t for t in targets if t.max_repeats > 0]
    if len(targets) > MAX_SOURCES or len({plain(t.source) for t in targets}) < len(targets):
        raise ValueError("target sources must be distinct and few")
    texts = cut(membership(records, record, source, content, size, targets).withColumn("_p", F.map_keys("_sources")))
    groups = texts.groupBy("_p").agg(F.sum("_size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(groups) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} combinations of sources")
    flows, _ = route({tuple(r["_p"]): int(r["n"]) for r in sorted(groups, key=lambda r: r["_p"])}, targets, total)
    # Seeded order: a record's place is the tokens before it. Cells of the hash give the
    # coarse place, a window inside a cell the fine one, so a pattern may hold any share of all rows.
    texts = texts.withColumn("_h", F.xxhash64("_key", F.lit(seed))).withColumn("_c", F.pmod(F.shiftright("_h", 20), F.lit(cells)).cast("int"))
    per_cell = texts.groupBy("_p", "_c").agg(F.sum("_size").alias("_n"))
    before = per_cell.withColumn("_from", F.sum("_n").over(Window.partitionBy("_p").orderBy("_c")) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("_p", "_c").orderBy("_h", "_key")
    placed = texts.join(before, ["_p", "_c"]).withColumn("_at", F.col("_from") + F.sum("_size").over(inside) - F.col("_size"))
    stretches, ends = [], {}
    for (p, r, s), n in sorted(flows.items()):
        a = ends.get((p, r), 0)
        ends[p, r] = a + n
        stretches.append((list(p), s, a, a + n))
    plan = records.sparkSession.createDataFrame(stretches, "_p array<string>, _s string, _a bigint, _b bigint")
    per_pattern = plan.groupBy("_p").agg(F.collect_list(F.struct("_s", "_a", "_b")).alias("_plan"))
    used = placed.join(F.broadcast(per_pattern), "_p")  # one row per pattern, at most MAX_PATTERNS
    middle = 2 * F.col("_at") + F.col("_size")
    hit = F.filter("_plan", lambda x: (middle >= 2 * x["_a"]) & (middle < 2 * x["_b"]))
    uses = used.select("_key", "_size", "_sources", F.explode(F.transform(hit, lambda x: x["_s"])).alias("_s"))
    uses = uses.groupBy("_key", "_s").agg(F.count(F.lit(1)).cast("int").alias("n_uses"), F.first("_size").alias("n_tokens"), F.first(F.element_at("_sources", F.col("_s"))).alias("_id"))
    return uses.select(F.col("_id").alias(record), F.col("_s").alias("source"), "n_uses", "n_tokens")


def mix_shares(mixed: DataFrame, targets: Sequence[Target]) -> DataFrame:
    """Per target source: ``source, target_share, actual_share, n_records, n_uses, n_tokens``."""
    want = mixed.sparkSession.createDataFrame([(t.source, float(t.share)) for t in targets], "source string, target_share double")
    tokens = F.col("n_uses") * F.col("n_tokens")
    got = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_uses").alias("n_uses"), F.sum(tokens).alias("n_tokens"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = want.join(got, "source", "left").select("source", "target_share", zero("n_records"), zero("n_uses"), zero("n_tokens"))
    all_tokens = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # a row per target source
    return out.withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.nullif(all_tokens, F.lit(0)), F.lit(0.0)))
