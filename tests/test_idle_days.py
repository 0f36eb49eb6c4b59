from strandcube.queries import training


def test_idle_days_come_from_the_totals_of_7_and_30_days(spark, monkeypatch):
    made, whole = [], training.trailing_totals
    monkeypatch.setattr(training, "trailing_totals", lambda d, e, t, sums, windows=(7, 30): made.append((tuple(sums), tuple(windows))) or whole(d, e, t, sums, windows))
    got = training.p5_found(spark, "/root/testdata/sf0.001")
    assert made == [(("incidents", "congestion_total", "n_congestion"), (7, 30))]
    want = training.p5_trailing(spark, "/root/testdata/sf0.001").where("is_idle = 1")
    assert sorted(map(tuple, got.collect())) == sorted((r.segment_key, r.day_key) for r in want.collect()) and got.count() > 0
