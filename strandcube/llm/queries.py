"""Queries p4 and p6 to p10, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandcube.functions.labels import entity_number, fold, fold_columns, vocabulary
from strandcube.functions.values import present
from strandcube.llm.mixing import Target, mix, mix_shares
from strandcube.llm.nearest import match_nearest
from strandcube.llm.packing import pack, packing_report
from strandcube.llm.pages import page_shares, stuffed_pages
from strandcube.llm.pairs import item_pairs
from strandcube.llm.percentiles import merge_summaries, quantile_summaries, quantiles
from strandcube.llm.tokens import TOKENIZER, token_counts
from strandcube.sources.tables import table

# The labels of severity and the asked percentiles.
SEVERITIES = ("Minor", "Moderate", "Serious", "Critical")
PROBABILITIES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
EPS = 0.005
#: Rows of a parameter table (containers, targets) that become part of the plan.
MAX_PARAMETERS = 1000


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of congestion per segment, each with the bound of its rank error."""
    facts = table(spark, sf_dir, "fact_traffic")
    return quantiles(quantile_summaries(facts, "segment_key", "congestion_index", EPS), "segment_key", PROBABILITIES)


def _daily_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "fact_traffic").where("segment_key IS NOT NULL")
    # rows without a time are one more day of their segment: concat_ws leaves the NULL out
    keyed = facts.select(F.struct("segment_key", F.expr("time_key div 100").alias("day_key")).alias("k"), "congestion_index")
    return quantile_summaries(keyed.select(F.concat_ws("/", "k.segment_key", "k.day_key").alias("k"), "congestion_index"), "k", "congestion_index", EPS)


def p4_merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from summaries of single days, merged."""
    daily = _daily_summaries(spark, sf_dir)
    daily = daily.withColumn("segment_key", F.split("k", "/")[0].cast("bigint"))
    return quantiles(merge_summaries(daily, "segment_key", EPS), "segment_key", PROBABILITIES)


def _bounds(spark: SparkSession, sf_dir: str, got: DataFrame) -> DataFrame:
    asked = got.groupBy("segment_key").agg(F.first("n_values").alias("n_stated"), F.collect_list(F.struct("value", "target_rank", "rank_error")).alias("a"))
    facts = table(spark, sf_dir, "fact_traffic").select("segment_key", present(F.col("congestion_index")).alias("v")).where("v IS NOT NULL AND segment_key IS NOT NULL")
    rows = facts.join(asked, "segment_key", "left")
    below = [F.sum((F.col("v") < F.col("a")[i]["value"]).cast("bigint")).alias(f"lt{i}") for i in range(len(PROBABILITIES))]
    upto = [F.sum((F.col("v") <= F.col("a")[i]["value"]).cast("bigint")).alias(f"le{i}") for i in range(len(PROBABILITIES))]
    counts = rows.groupBy("segment_key").agg(F.first("n_stated").alias("n_values"), F.first("a").alias("a"), *below, *upto)
    good = F.lit(0)
    for i in range(len(PROBABILITIES)):
        a = F.col("a")[i]
        within = (F.col(f"lt{i}") + 1 - a["rank_error"] <= a["target_rank"]) & (F.col(f"le{i}") + a["rank_error"] >= a["target_rank"])
        good = good + (within & (a["rank_error"] <= F.ceil(F.lit(EPS) * F.col("n_values")))).cast("int")
    return counts.select("segment_key", "n_values", good.cast("int").alias("n_within"))


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per segment: values, and how many of its percentiles truly lie within their stated rank error (and within eps)."""
    return _bounds(spark, sf_dir, p4_percentiles(spark, sf_dir))


def p4_merged_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the percentiles from merged days, the error of the days' own summaries included."""
    return _bounds(spark, sf_dir, p4_merged_days(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    return {
        "incident_type": vocabulary(table(spark, sf_dir, "dim_incident_type"), "incident_type"),
        "weather": vocabulary(table(spark, sf_dir, "dim_weather"), "weather"),
        "road_type": vocabulary(table(spark, sf_dir, "dim_segment"), "road_type"),
        "severity_label": list(SEVERITIES),
    }


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    rows = fold_columns(table(spark, sf_dir, "incidents").select("incident_id", *labels), labels)
    items = F.array(*[F.concat(F.lit(f"{f}="), F.col(f"{f}_label")) for f in labels])
    return rows.select("incident_id", F.array_compact(items).alias("items"))


def _two_fields() -> Column:
    return F.substring_index("item_a", "=", 1) != F.substring_index("item_b", "=", 1)


def p6_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of labels of two fields with their counts and lift."""
    return item_pairs(_items(spark, sf_dir), "incident_id", "items").where(_two_fields())


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = item_pairs(_items(spark, sf_dir), "incident_id", "items", min_count=10).where(_two_fields())
    often = F.col("n_ab") * 200 >= F.col("n_records")
    together = F.col("n_ab") * F.col("n_records") * 2 >= F.col("n_a") * F.col("n_b") * 3
    return pairs.where(often & together).select("item_a", "item_b")


def p7_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each incident with the nearest reading of its segment within 20 minutes, and the seconds between them."""
    incidents = table(spark, sf_dir, "incidents").select("incident_id", entity_number(F.col("segment_id")).alias("_e"), "timestamp")
    # Resent and revised rows of an incident are one record.
    incidents = incidents.where("_e IS NOT NULL AND timestamp IS NOT NULL").groupBy("incident_id").agg(F.min(F.struct("timestamp", "_e")).alias("_x"))
    incidents = incidents.select("incident_id", "_x.timestamp", "_x._e")
    readings = table(spark, sf_dir, "readings").select("reading_id", entity_number(F.col("segment_id")).alias("_e"), "timestamp")
    return match_nearest(incidents, readings, "incident_id", "reading_id", (F.col("_e"), F.col("_e")), ("timestamp", "timestamp"), 20 * 60)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_matches(spark, sf_dir).select("incident_id", "reading_id")


def _sizes(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", tokenizer=tokenizer)


def _few(rows: DataFrame, what: str) -> list:
    """The rows of a parameter table; more than ``MAX_PARAMETERS`` are refused."""
    got = rows.limit(MAX_PARAMETERS + 1).collect()
    if len(got) > MAX_PARAMETERS:
        raise ValueError(f"more than {MAX_PARAMETERS} {what}")
    return got


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    rows = _few(table(spark, sf_dir, "pack_capacities").where("container_name IS NOT NULL AND capacity_tokens > 0"), "containers")
    return sorted((r["container_name"], int(r["capacity_tokens"])) for r in rows)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in containers of each capacity."""
    return pack(_sizes(spark, sf_dir), "doc_id", "n_tokens", _capacities(spark, sf_dir))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p8_containers(spark, sf_dir), _capacities(spark, sf_dir))


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container kind: placed texts, and breaches of the rules (overfull containers, texts split though they fit, pieces that do not join up to the whole text)."""
    sizes = _sizes(spark, sf_dir)
    caps = _capacities(spark, sf_dir)
    packed = pack(sizes, "doc_id", "n_tokens", caps)
    cap = F.element_at(F.create_map(*[F.lit(x) for n, k in caps for x in (n, k)]), F.col("container_name"))
    full = packed.groupBy("container_name", "container_id").agg(F.sum("n_tokens").alias("n")).groupBy("container_name").agg(F.sum((F.col("n") > cap).cast("bigint")).alias("n_overfull"))
    after = F.lead("token_start").over(Window.partitionBy("container_name", "doc_id").orderBy("token_start", "piece_no"))  # few pieces a text
    joins = packed.withColumn("_gap", (after != F.col("token_start") + F.col("n_tokens")).cast("bigint"))
    texts = joins.groupBy("container_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("n"), F.coalesce(F.sum("_gap"), F.lit(0)).alias("gaps"))
    texts = texts.join(sizes.select("doc_id", F.col("n_tokens").alias("size")), "doc_id")
    wrong = ((F.col("n") != F.col("size")) | (F.col("gaps") > 0)).cast("bigint")
    rows = texts.groupBy("container_name").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(((F.col("pieces") > 1) & (F.col("size") <= cap)).cast("bigint")).alias("n_split_needlessly"), F.sum(wrong).alias("n_incomplete"))
    return rows.join(full, "container_name").select("container_name", "n_texts", "n_overfull", "n_split_needlessly", "n_incomplete")


def _targets(spark: SparkSession, sf_dir: str) -> list[Target]:
    rows = _few(table(spark, sf_dir, "mix_targets").where("source IS NOT NULL"), "target sources")
    return sorted((Target(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in rows), key=lambda t: t.source)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the source each counts for and its number of uses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("content"), "text")
    return mix(token_counts(docs, "text"), "doc_id", "source", "content", "n_tokens", _targets(spark, sf_dir))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_shares(p9_mix(spark, sf_dir), _targets(spark, sf_dir))


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: the share it should get, whether it is met within 0.01, and its records used too often or not its own."""
    targets = _targets(spark, sf_dir)
    mixed = p9_mix(spark, sf_dir)
    shares = mix_shares(mixed, targets)
    given = shares.withColumn("_there", F.when(F.col("n_records") > 0, F.col("target_share")))
    wanted = F.coalesce(F.col("_there") / F.sum("_there").over(Window.partitionBy(F.lit(1))), F.lit(0.0))  # a row per target source
    cap = F.create_map(*[F.lit(x) for t in targets for x in (t.source, t.max_repeats)]) if targets else F.lit(None)
    own = table(spark, sf_dir, "documents").select("doc_id", fold(F.col("source")).alias("_own"))
    used = mixed.join(own, "doc_id", "left").groupBy("source").agg(
        F.sum((F.col("n_uses") > cap[F.col("source")]).cast("bigint")).alias("a"), F.sum((~F.col("_own").eqNullSafe(fold(F.col("source")))).cast("bigint")).alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rows = given.withColumn("wanted_share", F.round(wanted, 6)).join(used, "source", "left")
    met = (F.abs(F.col("actual_share") - F.col("wanted_share")) <= 0.01).cast("int")
    return rows.select("source", "wanted_share", met.alias("is_met"), zero("a").alias("n_too_often"), zero("b").alias("n_foreign"))


def p10_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the words and the share of them in prose, link lists, tag lists and menus."""
    return page_shares(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "text", lang="lang")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return stuffed_pages(docs, "doc_id", "text", lang="lang").select("doc_id").distinct()


QUERIES = {
    "p4_percentiles": p4_percentiles, "p4_merged_days": p4_merged_days, "p4_bounds": p4_bounds, "p4_merged_bounds": p4_merged_bounds,
    "p6_pairs": p6_pairs, "p6_found": p6_found, "p7_matches": p7_matches, "p7_found": p7_found,
    "p8_containers": p8_containers, "p8_report": p8_report, "p8_limits": p8_limits, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_limits": p9_limits,
    "p10_pages": p10_pages, "p10_found": p10_found,
}

_ITEMS = """
vocab AS (
  SELECT 'incident_type' AS field, incident_type AS label FROM dim_incident_type
  UNION SELECT 'weather', weather FROM dim_weather
  UNION SELECT 'road_type', road_type FROM dim_segment WHERE road_type IS NOT NULL
  UNION SELECT 'severity_label', unnest(['Minor', 'Moderate', 'Serious', 'Critical'])),
folded_vocab AS (SELECT *, lower(regexp_replace(label, '[^A-Za-z0-9]', '', 'g')) AS k FROM vocab),
raw AS (
  SELECT DISTINCT field, raw, lower(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) AS f FROM (
    SELECT 'incident_type' AS field, incident_type AS raw FROM incidents UNION SELECT 'weather', weather FROM incidents
    UNION SELECT 'road_type', road_type FROM incidents UNION SELECT 'severity_label', severity_label FROM incidents) WHERE raw IS NOT NULL),
named AS (
  SELECT r.field, r.raw, v.label FROM raw r JOIN folded_vocab v ON r.field = v.field
  WHERE r.f = v.k OR (
    r.f NOT IN ('', 'na', 'nan', 'null', 'none', 'nil', 'unknown', 'notreported', 'notavailable', 'missing', 'tbc', 'tbd', 'other', 'undefined')
    AND r.f NOT IN (SELECT k FROM folded_vocab w WHERE w.field = r.field)
    AND (levenshtein(r.f, v.k) = 1 OR (levenshtein(r.f, v.k) = 2 AND (length(v.k) >= 8
      OR (length(r.f) = length(v.k) AND list_sort(string_split(r.f, '')) = list_sort(string_split(v.k, '')))))))
  QUALIFY row_number() OVER (PARTITION BY r.field, r.raw ORDER BY levenshtein(r.f, v.k), v.label) = 1),
items AS (
  SELECT DISTINCT incident_id, field || '=' || label AS item FROM (
    SELECT incident_id, unnest(['incident_type', 'weather', 'road_type', 'severity_label']) AS field,
           unnest([incident_type, weather, road_type, severity_label]) AS raw FROM incidents WHERE incident_id IS NOT NULL) x JOIN named USING (field, raw)),
n AS (SELECT item, count(*) AS n FROM items GROUP BY ALL),
total AS (SELECT count(DISTINCT incident_id) AS n_records FROM incidents),
ab AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM items a JOIN items b ON a.incident_id = b.incident_id AND a.item < b.item
  WHERE split_part(a.item, '=', 1) <> split_part(b.item, '=', 1) GROUP BY ALL),
pairs AS (
  SELECT item_a, item_b, a.n AS n_a, b.n AS n_b, n_ab, n_records, n_ab * CAST(n_records AS DOUBLE) / (CAST(a.n AS DOUBLE) * b.n) AS lift
  FROM ab JOIN n a ON a.item = item_a JOIN n b ON b.item = item_b, total)"""

_NEAREST = """
i AS (
  SELECT incident_id, min({'t': timestamp, 'e': e}) AS x FROM (
    SELECT incident_id, timestamp, TRY_CAST(regexp_extract(segment_id, '(\\d+)', 1) AS BIGINT) AS e FROM incidents)
  WHERE e IS NOT NULL AND timestamp IS NOT NULL AND incident_id IS NOT NULL GROUP BY ALL),
r AS (SELECT reading_id, timestamp AS t, TRY_CAST(regexp_extract(segment_id, '(\\d+)', 1) AS BIGINT) AS e FROM readings WHERE reading_id IS NOT NULL),
near AS (
  SELECT incident_id, reading_id, (epoch_us(r.t) - epoch_us(i.x.t)) AS d FROM i JOIN r ON r.e = i.x.e
    AND r.t BETWEEN i.x.t - INTERVAL 20 MINUTE AND i.x.t + INTERVAL 20 MINUTE
  QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY abs(epoch_us(r.t) - epoch_us(i.x.t)), r.t, reading_id) = 1)"""

_VALUES = """
SELECT segment_key, count(*) AS n_values, CAST(7 AS INT) AS n_within FROM fact_traffic
WHERE segment_key IS NOT NULL AND congestion_index IS NOT NULL AND NOT isnan(congestion_index) GROUP BY ALL"""

SQL = {
    "p4_bounds": _VALUES,
    "p4_merged_bounds": _VALUES,
    "p8_limits": """
SELECT container_name, (SELECT count(*) FROM documents) AS n_texts, CAST(0 AS BIGINT) AS n_overfull, CAST(0 AS BIGINT) AS n_split_needlessly, CAST(0 AS BIGINT) AS n_incomplete
FROM pack_capacities WHERE container_name IS NOT NULL AND capacity_tokens > 0""",
    "p9_limits": """
WITH there AS (SELECT DISTINCT lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) AS k FROM documents WHERE length(text) > 0),
t AS (SELECT *, lower(regexp_replace(source, '[^A-Za-z0-9]', '', 'g')) IN (SELECT k FROM there WHERE k IS NOT NULL) AS given FROM mix_targets)
SELECT source, round(CASE WHEN given THEN target_share / (SELECT sum(target_share) FROM t WHERE given) ELSE 0 END, 6) AS wanted_share, CAST(1 AS INT) AS is_met, CAST(0 AS BIGINT) AS n_too_often, CAST(0 AS BIGINT) AS n_foreign FROM t""",
    "p6_pairs": f"WITH {_ITEMS} SELECT * FROM pairs",
    "p6_found": f"WITH {_ITEMS} SELECT item_a, item_b FROM pairs WHERE n_ab >= 10 AND n_ab * 200 >= n_records AND n_ab * n_records * 2 >= n_a * n_b * 3",
    "p7_matches": f"WITH {_NEAREST} SELECT incident_id, reading_id, d / 1e6 AS seconds FROM near",
    "p7_found": f"WITH {_NEAREST} SELECT incident_id, reading_id FROM near",
}
