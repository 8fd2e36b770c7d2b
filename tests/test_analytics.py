"""Detections analytics on small seeded tables."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from wlanlake.functions.payload import is_simulated
from wlanlake.operators import analytics as A
from wlanlake.operators import filters as P
from wlanlake.operators import ledger as L
from wlanlake.operators import locate, maintenance
from wlanlake.sources import packets as S

NOW = datetime(2026, 8, 25, 12, 0, 0)
COLUMNS = [
    "id", "ts", "iface", "src_mac", "dst_mac", "bssid", "frame_len", "channel_freq", "datarate", "signal_dbm",
    "wlan_ds", "wlan_retry", "wlan_type", "wlan_subtype", "wlan_duration", "proba_anomaly", "proba_attack",
    "predicted_label", "raw",
]


def packets(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], S.PACKET_SCHEMA)


def ago(**kw):
    return NOW - timedelta(**kw)


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        {"id": 1, "ts": ago(hours=1), "src_mac": "aa:01", "bssid": "AP1", "channel_freq": 2412, "signal_dbm": -40.0, "predicted_label": "Deauth", "proba_attack": 0.9, "iface": "w0"},
        {"id": 2, "ts": ago(hours=2), "src_mac": "aa:01", "bssid": "AP2", "channel_freq": 2412, "signal_dbm": -60.0, "predicted_label": "Deauth", "proba_attack": None, "iface": "w0"},
        {"id": 3, "ts": ago(hours=3), "src_mac": "AA:02", "bssid": "AP1", "channel_freq": 5180, "signal_dbm": None, "predicted_label": "Evil_Twin", "proba_attack": 0.55, "raw": '{"sim": true, "sim_batch": "b1"}'},
        {"id": 4, "ts": ago(hours=4), "src_mac": None, "bssid": None, "channel_freq": None, "signal_dbm": 0.0, "predicted_label": "Krack", "proba_attack": 0.55, "raw": "junk"},
        {"id": 5, "ts": ago(days=10), "src_mac": "aa:03", "bssid": "AP1", "channel_freq": 2412, "signal_dbm": 0.0, "predicted_label": "Weird_Label", "proba_attack": 0.1, "raw": '{"ssid": "net"}'},
        {"id": 6, "ts": None, "src_mac": "aa:03", "predicted_label": None, "proba_attack": 0.2},
    ]
    return packets(spark, rows)


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_counts_are_zero_filled_and_unknown_labels_dropped(table):
    got = dict(rows(A.attack_analysis(table), "label", "count"))
    assert len(got) == 8 and got["Deauth"] == 2 and got["Kr00k"] == 0 and sum(got.values()) == 4


def test_limit_is_a_prefix(table):
    full = rows(A.top_offenders(table, limit=500), "wlan_sa", "count")
    assert full == [("aa:01", 2), ("aa:03", 2), ("AA:02", 1)]
    assert rows(A.top_offenders(table, limit=2), "wlan_sa", "count") == full[:2]


def test_days_window_leaves_rows_without_time_out(table):
    assert [r.id for r in P.filter_days(table, NOW, 1).orderBy("id").collect()] == [1, 2, 3, 4]
    assert P.filter_days(table, NOW, None).count() == 6
    with pytest.raises(ValueError):
        P.filter_days(table, NOW, 0)


def test_threat_filter_is_case_blind_and_refuses_unknown_classes(table):
    assert [r.id for r in P.filter_threats(table, NOW, src_mac=" AA:01 ").orderBy("id").collect()] == [1, 2]
    assert [r.id for r in P.filter_threats(table, NOW, label="evil twin").collect()] == [3]
    assert [r.id for r in P.filter_threats(table, NOW, min_confidence=0.5).orderBy("id").collect()] == [1, 3, 4]
    with pytest.raises(ValueError):
        P.filter_threats(table, NOW, label="weather")


def test_ledger_keeps_rows_without_time_and_time_buckets_skip_them(table):
    assert 6 in [r.id for r in P.ledger_filter(table, NOW, span="24h").collect()]
    assert sum(c for (c,) in rows(A.hour_of_day(table), "count")) == 5


def test_hour_and_day_agree_with_the_heatmap(table):
    grid = A.heatmap(table)
    assert grid.count() == 168
    by_hour = {h: n for h, n in rows(grid.groupBy("hour").agg(F.sum("intensity").alias("n")), "hour", "n")}
    assert by_hour == dict(rows(A.hour_of_day(table), "key", "count"))
    by_day = {d: n for d, n in rows(grid.groupBy("day").agg(F.sum("intensity").alias("n")), "day", "n")}
    assert by_day == dict(rows(A.day_of_week(table), "key", "count"))
    nested = A.heatmap_nested(grid).collect()
    assert len(nested) == 7 and all([c.hour for c in r.hours] == list(range(24)) for r in nested)


def test_zone_moves_a_row_to_the_next_day(spark):
    late = packets(spark, [{"id": 1, "ts": datetime(2026, 8, 24, 22, 30)}])
    assert rows(A.heatmap(late, zone="Asia/Riyadh").filter("intensity > 0"), "day", "hour") == [("Tue", 1)]
    assert rows(A.heatmap(late).filter("intensity > 0"), "day", "hour") == [("Mon", 22)]


def test_series_is_zero_filled_and_counts_rows_outside(table):
    series = A.attack_series(table, NOW, days=2, bucket="hour")
    assert series.count() == 48 and sum(n for (n,) in rows(series, "count")) == 4
    # 10 days back at noon: the first calendar day of the window starts later than the row.
    totals = A.attack_series_totals(table, NOW, days=10, bucket="day").first()
    assert (totals.total, totals.outside_range) == (4, 1)
    with pytest.raises(ValueError):
        A.attack_series(table, NOW, days=32, bucket="hour")
    with pytest.raises(ValueError):
        A.attack_series(table, NOW, label="Nope")


def test_series_over_a_clock_change(spark):
    # London, 25 October 2026: 01:30 comes twice.
    twice = packets(spark, [{"id": i, "ts": datetime(2026, 10, 25, h, 30)} for i, h in enumerate([0, 1])])
    got = A.attack_series(twice, datetime(2026, 10, 25, 12), days=1, zone="Europe/London")
    assert dict(rows(got.filter("count > 0"), "bucket", "count")) == {"2026-10-25T01": 2}


def test_report_ties(spark):
    even = packets(spark, [
        {"id": 1, "ts": ago(hours=1), "predicted_label": "SSDP", "src_mac": "a"},
        {"id": 2, "ts": ago(hours=2), "predicted_label": "Deauth", "src_mac": "a"},
        {"id": 3, "ts": ago(hours=3), "predicted_label": "odd", "src_mac": None},
    ])
    r = A.flat_summary(A.report_summary(even, NOW, days=1)).first()
    assert (r.most_frequent_type, r.peak_hour, r.unique_sources, r.total_attacks, r.n_other) == ("deauth", 9, 1, 3, 1)
    nothing = A.report_summary(even.filter("id > 9"), NOW, days=1).first()
    assert (nothing.total_attacks, nothing.most_frequent_type, nothing.peak_hour, nothing.unique_sources) == (0, "other", 0, 0)


def test_overview_agrees_with_report_and_analysis(table):
    o = A.flat_summary(A.threat_overview(table, NOW, days=30)).first()
    r = A.flat_summary(A.report_summary(table, NOW, days=30)).first()
    assert o.n_deauth == r.n_deauth and o.stored_all_time == 6
    assert o.all_time_evil_twin == dict(rows(A.attack_analysis(table), "label", "count"))["Evil_Twin"]


def test_compare_previous(table):
    c = A.compare_previous(table, NOW, 150).first()
    assert (c.current_total, c.previous_total, c.change) == (2, 2, 0)


def test_health_uses_the_newest_id(table):
    h = A.sensor_health(table).first()
    assert (h.packets, h.latest_ts, h.observed_iface) == (6, ago(hours=1), None)


def test_shares_hide_only_an_empty_other(table):
    got = {t: (n, s) for t, n, s in rows(A.class_share(table.filter("id < 5")), "type", "count", "share")}
    assert "other" not in got and got["kr00k"] == (0, 0.0) and got["deauth"] == (2, 0.5)
    assert "other" in dict(rows(A.class_share(table), "type", "count"))


def test_signal_zero_and_absent_fall_back(table):
    got = {(r.src_mac, r.bssid): r.avg_rssi for r in locate.source_rssi(table).collect()}
    assert got == {("aa:01", "AP1"): -40.0, ("aa:01", "AP2"): -60.0, ("AA:02", "AP1"): -90.0, ("aa:03", "AP1"): -90.0}


def test_origin_is_the_weighted_centre(spark, table):
    aps = spark.createDataFrame([("AP1", "one", 10.0, 20.0), ("AP2", "two", 11.0, 22.0), ("AP9", "nine", None, 1.0)], "bssid string, name string, lat double, lng double")
    got = {r.src_mac: r for r in locate.estimate_origin(table, aps, NOW, minutes=60 * 24).collect()}
    w1, w2 = 1 / 41, 1 / 61
    assert got["aa:01"].used == 2
    assert got["aa:01"].lat == pytest.approx((10 * w1 + 11 * w2) / (w1 + w2))
    nowhere = locate.estimate_origin(table, aps.filter("bssid = 'AP9'")).filter("src_mac = 'aa:01'").first()
    assert (nowhere.used, nowhere.lat) == (0, None)


def test_orders(table):
    assert [r.id for r in L.query_threats(table, "confidence", 6).collect()] == [1, 4, 3, 6, 5, 2]
    assert [r.id for r in L.query_threats(table, "newest", 2).collect()] == [1, 2]
    assert L.query_threats_report(table, "newest", 6).first().truncated is True


def test_ledger_order_and_paging(table):
    view = L.detection_view(table)
    up = [r.id for r in view.orderBy(*L.ledger_order("channel", descending=False)).collect()]
    down = [r.id for r in view.orderBy(*L.ledger_order("channel", descending=True)).collect()]
    assert up[-2:] == down[-2:] == ["4", "6"]
    assert down[0] == "3" and up[0] == "1"
    last = L.ledger_page(view, 99, L.ledger_order("time"), rows=4)
    assert [r.id for r in last.collect()] == ["5", "6"]


def test_view_hides_impossible_readings(spark):
    odd = packets(spark, [
        {"id": 1, "signal_dbm": -111.0, "proba_attack": 1.5, "src_mac": "  "},
        {"id": 2, "signal_dbm": -40.5, "proba_attack": 0.0, "src_mac": " x "},
    ])
    a, b = L.detection_view(odd).orderBy("id").collect()
    assert (a.rssi, a.confidence, a.src_mac, a.retry) == (None, None, None, None)
    assert (b.rssi, b.confidence, b.src_mac) == (-40, 0.0, "x")


def test_tail_counts_its_limit_before_the_simulated_filter(table):
    assert [r.id for r in L.rows_after(table, 1, limit=3).collect()] == [2, 3, 4]
    assert [r.id for r in L.rows_after(table, 1, sim_only=True, limit=1).collect()] == []


def test_merged_tape_prefers_the_stream(spark):
    schema = "id string, ts timestamp, src string"
    stream = spark.createDataFrame([("1", NOW, "s"), ("2", None, "s")], schema)
    poll = spark.createDataFrame([("1", NOW, "p"), ("3", ago(hours=1), "p"), ("", NOW, "p")], schema)
    assert rows(L.merge_tape(stream, poll, 5), "id", "src") == [("1", "s"), ("3", "p"), ("2", "s")]


def test_rows_that_arrive_at_once_leave_one_answer(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "z"), (2, None, "x"), (2, None, None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id int, arrival int, v string").coalesce(1)
        assert {(r.id, r.v) for r in L.dedupe_latest(df).collect()} == {(1, "b"), (2, "x")}


def test_dedupe_with_one_very_common_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("id"), F.col("id").alias("arrival"))
    got = L.dedupe_latest(df)
    assert got.count() == 1001 and got.filter("id = 0").first().arrival == 3999


def test_purge(spark, table, tmp_path):
    condition = maintenance.purge_condition("simulated")
    assert maintenance.purge_counts(table, condition).first().asDict() == {"deleted": 1, "remaining": 5}
    kept = maintenance.rewrite(table, condition, str(tmp_path / "kept"))
    assert kept.count() == 5 and kept.filter(is_simulated("raw")).count() == 0
    with pytest.raises(ValueError):
        maintenance.delete_condition(NOW)
    # A row whose time is unknown is not deleted by a time window.
    gone = maintenance.delete_condition(NOW, minutes=60 * 24 * 30)
    assert [r.id for r in maintenance.remaining(table, gone).collect()] == [6]


def test_adhoc_sql(spark, table):
    assert S.run_sql(spark, table, "select * from packets", max_rows=2).count() == 2
    assert S.run_sql(spark, table, "select * from packets limit 4", max_rows=2).count() == 4
    everything = table.count()
    assert S.run_sql(spark, table, "select * from packets").count() == everything
    assert S.run_sql(spark, table, "select * from packets limit all", max_rows=2).count() == everything
    assert S.run_sql(spark, table, "select * from packets limit 3 offset 1", max_rows=2).count() == 3
    with pytest.raises(ValueError):
        S.run_sql(spark, table, "drop table packets")


def test_normalise_ignores_junk(spark):
    df = spark.createDataFrame([(1, "2026-08-24 22:30:00", '{"ssid": "n"}'), (2, "soon", "junk")], "id int, ts string, raw string")
    a, b = S.normalise_packets(df).orderBy("id").collect()
    assert a.ts == datetime(2026, 8, 24, 22, 30) and a.raw.ssid == "n"
    assert b.ts is None and (b.raw is None or b.raw.ssid is None)


def test_to_packets_takes_the_first_value_and_rounds_half_even(spark):
    df = spark.createDataFrame(
        [(1, None, 2412.5, -1.0, 3.0, float("nan"), -41.0)],
        "id bigint, radiotap_channel_freq string, radio_freq_mhz double, fc_type double, fc_subtype double, wlan_radio_signal_dbm double, radio_signal_dbm double",
    ).selectExpr(
        "*", "timestamp '2026-01-01' as ts", "'w' as iface", "'s' as sa", "'d' as da", "'b' as bssid", "'{}' as raw",
        "named_struct('is_attack', true, 'label', 'Krack', 'p1', 0.5D, 'p2', 0.9D, 'stage', 2) as verdict",
    )
    r = S.to_packets(df).first()
    assert (r.channel_freq, r.wlan_type, r.wlan_subtype, r.signal_dbm, r.src_mac) == (2412, None, 3, -41.0, "s")
    assert (r.proba_anomaly, r.proba_attack, r.predicted_label, r.wlan_retry) == (0.5, 0.9, "Krack", None)


def test_pages_by_key_equal_pages_by_offset(spark):
    rng = np.random.default_rng(11)
    rows = [
        (str(i), datetime(2024, 1, 1) + timedelta(seconds=int(rng.integers(5))) if i % 9 else None,
         None if i % 4 == 0 else float(rng.integers(3)) / 4, int(rng.integers(3)) if i % 5 else None)
        for i in range(60)
    ]
    view = spark.createDataFrame(rows, "id string, ts timestamp, confidence double, channel int")
    for column, down in (("confidence", True), ("channel", False), ("time", True)):
        want = [r["id"] for r in view.orderBy(*L.ledger_order(column, down)).collect()]
        got, last = [], None
        while page := L.ledger_after(view, last, column, down, rows=7).collect():
            got += [r["id"] for r in page]
            last = page[-1]
        assert got == want
    plan = L.ledger_after(view, last, "channel", False, rows=7)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=7" in plan and "Offset" not in plan
    ids = view.select(F.col("id").cast("int").alias("id"))
    assert [r["id"] for r in L.detections_before(ids, 10, 3).collect()] == [9, 8, 7]


def test_groups_tell_what_is_left_out(spark):
    df = spark.createDataFrame([(f"m{i % 30}",) for i in range(100)] + [(None,)] * 5, "src_mac string")
    rows = A.aggregate_by(df, "src_mac", 20).collect()
    assert len(rows) == 20 and {(r.total, r.groups, r.truncated) for r in rows} == {(105, 31, True)}
    assert {r.truncated for r in A.aggregate_by(df, "src_mac", 31).collect()} == {False}
