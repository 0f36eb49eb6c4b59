"""Merged days hold every value that the direct percentiles hold."""

from strandcube.llm import queries


def test_rows_without_a_time_are_kept(spark, monkeypatch):
    rows = [(s, None if i % 3 == 0 else 2024010100 + i % 5 * 100, i / 100) for s in (1, 2) for i in range(60)] + [(None, 2024010100, 0.5), (3, None, 0.7)]
    df = spark.createDataFrame([(*r,) for r in rows], "segment_key bigint, time_key bigint, congestion_index double")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    counts = lambda q: {r.segment_key: r.n_values for r in q(spark, "").select("segment_key", "n_values").distinct().collect()}
    assert counts(queries.p4_merged_days) == counts(queries.p4_percentiles) == {1: 60, 2: 60, 3: 1}
