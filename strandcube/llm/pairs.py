"""Items that appear together: exact pair counts by heavy-light decomposition.

Items in a fair share of the records are heavy: their pairs are counted by
popcounts over a packed bit matrix (items x records) of each batch. Pairs of rare
items are counted through a hash of their codes, and mixed pairs by adding up the
heavy items' bits over each rare item's record list. The three parts are exact
and disjoint; their union is summed over batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandcube.session import cut, small

#: Item counts up to this number of rows (about 40 bytes each) are broadcast for scoring.
BROADCAST_ITEMS = 500_000
#: Cells of records by heavy items, or rare by heavy items, and pairs of rare items that are held at once.
MAX_CELLS = 4_000_000
MAX_PAIRS = 2_000_000
#: Items of a record beyond which it is cut into blocks of about so many.
LARGE = 256


def heavy_pairs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i < j) of columns of a boolean matrix and the number of rows that hold both."""
    bits = np.packbits(member, axis=0).T
    pad = -bits.shape[1] % 8
    words = np.ascontiguousarray(np.pad(bits, ((0, 0), (0, pad)))).view(np.uint64)
    a, b, n = [], [], []
    for i in range(len(words) - 1):
        both = np.bitwise_count(words[i] & words[i + 1 :]).sum(1)
        j = np.flatnonzero(both)
        a.append(np.full(len(j), i))
        b.append(j + i + 1)
        n.append(both[j])
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return cat(a), cat(b), cat(n).astype(np.int64)


def mixed_pairs(member: np.ndarray, row: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (rare item, heavy column, records with both): each rare item's records probe the heavy bits."""
    if not len(item) or not member.shape[1]:
        return
    order = np.argsort(item, kind="stable")
    row, item = row[order], item[order]
    starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
    ends = np.r_[starts[1:], len(item)]
    step = max(1, MAX_CELLS // member.shape[1])
    i = 0
    while i < len(starts):  # as many items as fill a block of rows; one item of more rows is added up by itself
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        total = np.zeros((j - i, member.shape[1]), np.int64)
        for k in range(int(starts[i]), int(ends[j - 1]), step):
            z = min(k + step, int(ends[j - 1]))
            own = np.searchsorted(starts, np.arange(k, z), side="right") - 1 - i
            at, first = np.unique(own, return_index=True)
            total[at] += np.add.reduceat(member[row[k:z]].astype(np.int32), first, axis=0)
        a, b = np.nonzero(total)
        yield item[starts[i:j]][a], b, total[a, b]
        i = j


def light_pairs(row: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of pairs (a < b) of rare items within a record, hash-counted; a block is some records' pairs, about ``MAX_PAIRS``."""
    order = np.lexsort((item, row))
    row, item = row[order], item[order].astype(np.int64)
    size = int(item.max()) + 1 if len(item) else 1
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    n = np.diff(np.r_[starts, len(row)])
    block = np.cumsum(n * (n - 1) // 2) // MAX_PAIRS
    for k in np.unique(block):
        some = np.flatnonzero(block == k)
        lo, hi = int(starts[some[0]]), int(starts[some[-1]] + n[some[-1]])
        r, x = row[lo:hi], item[lo:hi]
        codes = []
        for d in range(1, int(n[some].max())):
            same = np.flatnonzero(r[d:] == r[:-d])
            codes.append(x[same] * size + x[same + d])
        if codes:
            got, times = np.unique(np.concatenate(codes), return_counts=True)
            yield got // size, got % size, times


def _frame(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    swap = a > b
    return pd.DataFrame({"item_a": np.where(swap, b, a), "item_b": np.where(swap, a, b), "n_ab": n.astype(np.int64)})


def count_batch(items: Sequence[Sequence[str]], heavy: dict[str, int]) -> Iterator[pd.DataFrame]:
    """Pair counts of a batch of records in blocks of bounded size; a pair may come in several of them."""
    sizes = np.array([len(x) for x in items], np.int64)
    row = np.repeat(np.arange(len(items)), sizes)
    flat = np.concatenate([np.asarray(x, object) for x in items]) if sizes.sum() else np.empty(0, object)
    code, names = pd.factorize(flat, sort=True)
    names = np.asarray(names, object)
    column = np.array([heavy.get(x, -1) for x in names], np.int64)
    of = column[code] if len(code) else np.empty(0, np.int64)
    member = np.zeros((len(items), len(heavy)), bool)
    member[row[of >= 0], of[of >= 0]] = True
    by_column = np.array(list(heavy), object)
    rare = of < 0
    i, j, n = heavy_pairs(member)
    if len(n):
        yield _frame(by_column[i], by_column[j], n)
    for i, j, n in mixed_pairs(member, row[rare], code[rare]):
        yield _frame(names[i], by_column[j], n)
    for i, j, n in light_pairs(row[rare], code[rare]):
        yield _frame(names[i], names[j], n)


def count_blocks(left: Sequence[Sequence[str]], right: Sequence[Sequence[str]], same: Sequence[bool]) -> Iterator[pd.DataFrame]:
    """Pairs between two blocks of one record's items (or within one block), one block pair at a time."""
    for x, y, within in zip(left, right, same, strict=True):
        x, y = np.asarray(x, object), np.asarray(y, object)
        a, b = np.repeat(x, len(y)), np.tile(y, len(x))
        ok = a < b if within else slice(None)
        yield _frame(a[ok], b[ok], np.ones(len(a[ok]), np.int64))


def baskets(df: DataFrame, record: str, items: str) -> DataFrame:
    """``_id, _items``: the sorted distinct non-null items of each record; rows of one record are united, NULL records left out.

    Items are dropped into sets before the shuffle, so a record of many rows moves
    as one set per task.
    """
    rows = df.where(F.col(record).isNotNull()).select(F.col(record).alias("_id"), F.explode_outer(F.array_distinct(items)).alias("_item"))
    return rows.groupBy("_id").agg(F.array_sort(F.collect_set("_item")).alias("_items"))


def item_blocks(records: DataFrame) -> DataFrame:
    """``_items, _others, _same``: each pair of blocks of about ``LARGE`` items of a record; pairs are dealt to tasks by (record, block)."""
    cuts = F.transform(F.sequence(F.lit(0), F.expr(f"(size(_items) - 1) div {LARGE}").cast("int")), lambda i: F.slice("_items", i * LARGE + 1, F.lit(LARGE)))
    blocks = cut(records.select("_id", F.posexplode(cuts).alias("_b", "_items")))
    others = blocks.select("_id", F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("_i"), F.col("_b").alias("_j"), F.col("_items").alias("_others"))
    return blocks.withColumnRenamed("_b", "_i").join(others, ["_id", "_i"]).select("_items", "_others", (F.col("_i") == F.col("_j")).alias("_same"))


def item_pairs(df: DataFrame, record: str, items: str, heavy_share: float = 1 / 64, max_heavy: int = 1024, min_count: int = 1) -> DataFrame:
    """Counts and lift of each pair of items: ``item_a, item_b, n_a, n_b, n_ab, n_records, lift``, item_a < item_b.

    ``items`` is an array column; ``n_x`` is the number of distinct records that
    hold x, ``lift`` is n_ab * n_records / (n_a * n_b). An item is heavy if it is
    in at least ``heavy_share`` of the records (one word of the bit matrix per
    occurrence); of those at most ``max_heavy`` are taken, the others count as
    rare, which changes the way and not the result. Items occur once in a record
    however often they are repeated. Pairs below ``min_count`` are left out;
    records without items still count in ``n_records``. Empty input gives no rows.
    Records of more than ``LARGE`` items are counted in pairs of blocks of their
    items, so that no task holds all of a record.
    """
    records = cut(baskets(df, record, items))
    total = records.count()
    counts = cut(records.select(F.explode("_items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n")))
    floor = max(heavy_share * total, 1)
    top = counts.where(F.col("n") >= floor).orderBy(F.desc("n"), "item").limit(max_heavy).collect()
    heavy = {r["item"]: i for i, r in enumerate(sorted(top, key=lambda r: r["item"]))}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from count_batch(pdf["_items"].tolist(), heavy)

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from count_blocks(pdf["_items"].tolist(), pdf["_others"].tolist(), pdf["_same"].tolist())

    schema = "item_a string, item_b string, n_ab bigint"
    size = F.size("_items")
    sums = records.where((size > 1) & (size <= LARGE)).select("_items").mapInPandas(count, schema)
    large = records.where(size > LARGE)
    if large.limit(1).count():
        sums = sums.unionByName(item_blocks(large).mapInPandas(across, schema))
    pairs = sums.groupBy("item_a", "item_b").agg(F.sum("n_ab").alias("n_ab")).where(F.col("n_ab") >= min_count)
    one = lambda x: small(counts.select(F.col("item").alias(f"item_{x}"), F.col("n").alias(f"n_{x}")), BROADCAST_ITEMS)
    scored = pairs.join(one("a"), "item_a").join(one("b"), "item_b").withColumn("n_records", F.lit(total).cast("bigint"))
    lift = F.col("n_ab") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return scored.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n_records", lift.alias("lift"))
