"""Association rules: frequent itemsets and rules with any split of the set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandcube.functions.values import ratio
from strandcube.session import cut, small

SEP = ", "


def tagged(tags: Sequence[tuple[str, Column]]) -> Column:
    """Sorted array of 'TAG=value' of the non-null values."""
    return F.array_sort(F.array_compact(F.array(*[F.concat(F.lit(f"{t}="), c.cast("string")) for t, c in tags])))


#: Frequent sets of a level up to this number (about 100 bytes each) are broadcast to prune the next.
BROADCAST_SETS = 200_000


def frequent_itemsets(transactions: DataFrame, items: str, min_support: float, max_len: int = 3) -> DataFrame:
    """``itemset`` (sorted array), ``size``, ``n``, ``support`` of all sets of at most ``max_len`` items with support >= ``min_support``.

    Level by level: a transaction's frequent sets of one size are lengthened by
    its later frequent items, kept if their last items are a frequent set too, and
    counted. Each transaction is a set. Empty input gives no rows.
    """
    rows = cut(transactions.select(F.array_sort(F.array_distinct(F.array_compact(items))).alias("items")))
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], "itemset array<string>, size int, n bigint, support double")
    single = rows.select(F.explode("items").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    level = cut(single.where(F.col("n") >= min_support * total).select(F.array("i").alias("itemset"), "n"))
    found, k = level, 1
    sets = rows.select("items", F.posexplode("items").alias("at", "i")).select("items", "at", F.array("i").alias("itemset"))
    while k < max_len and level._counted > 1:
        sets = sets.join(small(level.select("itemset"), BROADCAST_SETS), "itemset", "left_semi")
        longer = sets.select("items", "itemset", F.col("at").alias("_from"), F.posexplode("items").alias("at", "i")).where(F.col("at") > F.col("_from"))
        sets = longer.select("items", "at", F.array_append("itemset", F.col("i")).alias("itemset"))
        tails = level.select(F.col("itemset").alias("_tail"))
        tails._counted = level._counted
        sets = sets.join(small(tails, BROADCAST_SETS), F.slice("itemset", 2, k) == F.col("_tail"), "left_semi")
        counts = sets.groupBy("itemset").agg(F.count(F.lit(1)).alias("n"))
        level, k = cut(counts.where(F.col("n") >= min_support * total)), k + 1
        found = found.unionByName(level)
    return found.select("itemset", F.size("itemset").alias("size"), "n", (F.col("n") / F.lit(total)).alias("support"))


def rules(itemsets: DataFrame, min_confidence: float, min_lift: float) -> DataFrame:
    """Rules A => C of every frequent set A u C, with confidence, lift, leverage and conviction.

    Thresholds apply to unrounded values; conviction is NULL where confidence is
    1 (infinite). Sets are written with their items sorted and joined by ', '.
    """
    sets = itemsets.where("size >= 2").withColumn("_m", F.explode(F.expr("sequence(1, cast(power(2, size) as int) - 2)")))
    side = lambda bit: F.filter("itemset", lambda x, i: F.expr("_m").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) == bit * F.call_function("shiftleft", F.lit(1), i))
    sets = sets.select(F.array_join(side(1), SEP).alias("antecedent"), F.array_join(side(0), SEP).alias("consequent"), "support", "size")
    known = itemsets.select(F.array_join("itemset", SEP).alias("_s"), F.col("support").alias("_x"))
    a = known.select(F.col("_s").alias("antecedent"), F.col("_x").alias("_sa"))
    c = known.select(F.col("_s").alias("consequent"), F.col("_x").alias("_sc"))
    out = sets.join(a, "antecedent").join(c, "consequent")
    conf = F.col("support") / F.col("_sa")
    lift = conf / F.col("_sc")
    out = out.withColumns({"confidence": conf, "lift": lift}).where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift))
    return out.select(
        "antecedent", "consequent", "support", "confidence", "lift", (F.col("support") - F.col("_sa") * F.col("_sc")).alias("leverage"),
        ratio(1 - F.col("_sc"), 1 - F.col("confidence")).alias("conviction"),
    )


def filtered_rules(found: DataFrame, min_confidence: float, min_lift: float, n: int = 200) -> DataFrame:
    """The n strongest rules that reach both bounds."""
    return top_rules(found.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)), n)


def shortened(label: Column, length: int = 58) -> Column:
    """Labels of ``length`` characters and more end in three dots, at that length."""
    return F.when(F.length(label) >= length, F.concat(F.substring(label, 1, length - 3), F.lit("..."))).otherwise(label)


def top_rules(found: DataFrame, n: int) -> DataFrame:
    return found.orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedent", "consequent").limit(n)
