"""Checks of the detections analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.adapters import AS_OF, access_points, detections
from wlanlake.catalog.common import (
    APS_SQL,
    CLASSES_SQL,
    FRONT,
    NOW,
    SEVERITY,
    local_sql,
    stamp,
    stamp_sql,
    with_detections,
)
from wlanlake.functions.payload import is_simulated, mac_contains, raw_field
from wlanlake.functions.timeparts import bucket_key, day_index, local_time
from wlanlake.operators import analytics as A
from wlanlake.operators import filters as P
from wlanlake.operators import ledger as L
from wlanlake.operators import locate, maintenance
from wlanlake.operators.layout import with_place
from wlanlake.sources import packets as S

QUERIES = {}
ORACLES = {}
ZONE = "Asia/Riyadh"


def query(name: str, sql: str | None = None):
    """Register a function of the detections table under a name, with its SQL."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(detections(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# ---- scans and listings --------------------------------------------------------------

query(
    "packets_count", with_detections("SELECT count(*) AS count FROM detections")
)(A.packets_count)


@query(
    "list_detections",
    with_detections(
        f"SELECT id, {stamp_sql()} AS ts, iface, src_mac, predicted_label FROM detections "
        "ORDER BY id DESC LIMIT 200 OFFSET 100"
    ),
)
def _list(df):
    return L.list_detections(df, 200, 100).select("id", stamp().alias("ts"), "iface", "src_mac", "predicted_label")


@query(
    "rows_after",
    with_detections(
        f"SELECT id, {stamp_sql()} AS ts, predicted_label FROM "
        "(SELECT * FROM detections WHERE id > 500 ORDER BY id LIMIT 400) t WHERE sim"
    ),
)
def _after(df):
    return L.rows_after(df, 500, sim_only=True, limit=400).select("id", stamp().alias("ts"), "predicted_label")


@query(
    "normalise_packets",
    with_detections(
        f"SELECT id, {stamp_sql()} AS ts, ssid, CASE WHEN sim THEN 'true' END AS sim, sim_batch FROM detections"
    ),
)
def _normalise(df):
    # Time as text, as a store without a time type would deliver it.
    text = df.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    out = S.normalise_packets(text)
    return out.select("id", stamp().alias("ts"), "raw.ssid", "raw.sim", "raw.sim_batch")


@query(
    "adhoc_sql",
    with_detections(
        "SELECT predicted_label, iface, count(*) AS n, round(avg(signal_dbm), 6) AS avg_signal "
        "FROM detections GROUP BY ALL"
    ),
)
def _adhoc(df):
    return S.run_sql(
        df.sparkSession,
        df,
        "SELECT predicted_label, iface, count(*) AS n, round(avg(signal_dbm), 6) AS avg_signal "
        "FROM packets GROUP BY ALL;",
    )


# ---- filters -------------------------------------------------------------------------


@query("filter_days", with_detections(f"SELECT id FROM detections WHERE ts >= {NOW} - INTERVAL 7 DAY"))
def _days(df):
    return P.filter_days(df, AS_OF, 7).select("id")


@query(
    "filter_threats",
    with_detections(
        f"SELECT id, src_mac FROM detections WHERE ts >= {NOW} - INTERVAL 28800 MINUTE "
        "AND predicted_label = 'Evil_Twin' AND lower(bssid) = 'aa:aa:aa:aa:aa:02' AND iface = 'wlan1' "
        "AND channel_freq = 2437 AND proba_attack >= 0.25"
    ),
)
def _threats(df):
    return P.filter_threats(
        df,
        AS_OF,
        minutes=28800,
        label="evil twin",
        bssid=" AA:AA:AA:AA:AA:02 ",
        iface="wlan1",
        channel_freq=2437,
        min_confidence=0.25,
    ).select("id", "src_mac")


_LEDGER_WHERE = (
    f"(ts IS NULL OR ts >= {NOW} - INTERVAL 720 HOUR) AND {SEVERITY} IN ('critical', 'high') "
    "AND replace(src_mac, ':', '') LIKE '%0000001%'"
)


@query(
    "ledger_filter",
    with_detections(f"SELECT id, src_mac, {SEVERITY} AS severity FROM detections WHERE {_LEDGER_WHERE}"),
)
def _ledger(df):
    kept = P.ledger_filter(df, AS_OF, span="30d", severities=["critical", "high"], search="00:00-001")
    return A.with_label_dimension(kept).select("id", "src_mac", "severity")


@query(
    "simulated_rows",
    with_detections(
        f"SELECT id, sim_batch FROM detections WHERE sim AND sim_batch = 'b1' AND ts >= {NOW} - INTERVAL 20160 MINUTE"
    ),
)
def _sim(df):
    return P.simulated_rows(df, AS_OF, minutes=20160, batch="b1").select(
        "id", raw_field("raw", "sim_batch").alias("sim_batch")
    )


@query(
    "ssid_filter",
    with_detections(
        "SELECT count(*) AS seen, count(*) FILTER (ssid IS NULL OR ssid = 'net3') AS passed, "
        "count(*) FILTER (ssid IS NOT NULL AND ssid <> 'net3') AS filtered FROM detections"
    ),
)
def _ssid(df):
    return P.ssid_filter_counts(df.withColumn("ssid", raw_field("raw", "ssid")), "net3")


# ---- deleting ------------------------------------------------------------------------


@query(
    "purge_simulated",
    with_detections(
        "SELECT count(*) FILTER (sim) AS deleted, count(*) FILTER (NOT sim) AS remaining FROM detections"
    ),
)
def _purge(df):
    return maintenance.purge_counts(df, maintenance.purge_condition("simulated"))


@query(
    "delete_filtered",
    with_detections(
        "SELECT id, predicted_label FROM detections "
        f"WHERE NOT coalesce(predicted_label = 'SSDP' AND ts >= {NOW} - INTERVAL 14400 MINUTE, false)"
    ),
)
def _delete(df):
    gone = maintenance.delete_condition(AS_OF, minutes=14400, label="upnp")
    return maintenance.remaining(df, gone).select("id", "predicted_label")


# ---- counts --------------------------------------------------------------------------

query(
    "attack_analysis",
    with_detections(
        "SELECT c.label, count(d.id) AS count FROM classes c LEFT JOIN detections d ON d.predicted_label = c.label "
        "GROUP BY c.label",
        CLASSES_SQL,
    ),
)(A.attack_analysis)


@query(
    "top_offenders",
    with_detections(
        "SELECT src_mac AS wlan_sa, count(*) AS count FROM detections WHERE src_mac IS NOT NULL "
        "GROUP BY src_mac ORDER BY count DESC, wlan_sa LIMIT 50"
    ),
)
def _offenders(df):
    return A.top_offenders(df)


query(
    "channel_usage",
    with_detections(
        "SELECT channel_freq, count(*) AS count FROM detections WHERE channel_freq IS NOT NULL GROUP BY 1"
    ),
)(A.channel_usage)

for _dim, _col in A.GROUP_COLUMNS.items():
    query(
        f"aggregate_by_{_dim}",
        with_detections(
            f"SELECT CAST({_col} AS VARCHAR) AS key, count(*) AS count, sum(count(*)) OVER ()::BIGINT AS total, "
            f"count(*) OVER () AS groups, count(*) OVER () > 20 AS truncated FROM detections GROUP BY {_col} "
            "ORDER BY count DESC, key ASC NULLS LAST LIMIT 20"
        ),
    )(lambda df, d=_dim: A.aggregate_by(df, d, 20))

query(
    "classes_without_detections",
    with_detections(
        "SELECT label FROM classes WHERE label NOT IN (SELECT predicted_label FROM detections)", CLASSES_SQL
    ),
)(A.classes_without_detections)

_DAYS = "['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat']"


def _heat_sql(zone: str, where: str = "") -> str:
    local = local_sql(zone)
    return with_detections(
        f"SELECT {_DAYS}[CAST(g.d + 1 AS BIGINT)] AS day, CAST(g.h AS INTEGER) AS hour, "
        "CAST(coalesce(c.n, 0) AS BIGINT) AS intensity FROM grid g LEFT JOIN c ON g.d = c.d AND g.h = c.h",
        "grid AS (SELECT d, h FROM range(7) a(d), range(24) b(h))",
        f"c AS (SELECT dayofweek({local}) AS d, hour({local}) AS h, count(*) AS n FROM detections {where} GROUP BY 1, 2)",
    )


@query("heatmap", _heat_sql(ZONE, f"WHERE ts >= {NOW} - INTERVAL 20 DAY"))
def _heat(df):
    return A.heatmap(df, AS_OF, days=20, zone=ZONE)


query("heatmap_utc", _heat_sql("UTC"))(A.heatmap)

query(
    "hour_of_day",
    with_detections(
        "SELECT CAST(h AS INTEGER) AS key, count(id) AS count FROM range(24) r(h) "
        "LEFT JOIN detections ON hour(ts) = h GROUP BY h"
    ),
)(A.hour_of_day)
query(
    "day_of_week",
    with_detections(
        f"SELECT {_DAYS}[CAST(d + 1 AS BIGINT)] AS key, count(id) AS count FROM range(7) r(d) "
        "LEFT JOIN detections ON dayofweek(ts) = d GROUP BY d"
    ),
)(A.day_of_week)


def _series_sql(zone: str, days: int, bucket: str, label: str | None = None) -> str:
    fmt = "%Y-%m-%d" if bucket == "day" else "%Y-%m-%dT%H"
    steps = days if bucket == "day" else days * 24
    only = f"AND predicted_label = '{label}'" if label else ""
    return with_detections(
        "SELECT s.bucket, CAST(coalesce(c.n, 0) AS BIGINT) AS count FROM s LEFT JOIN c USING (bucket)",
        f"s AS (SELECT DISTINCT strftime(date_trunc('{bucket}', {local_sql(zone, NOW)}) "
        f"- to_{bucket}s(CAST(i AS INTEGER)), '{fmt}') AS bucket FROM range({steps}) r(i))",
        f"c AS (SELECT strftime({local_sql(zone)}, '{fmt}') AS bucket, count(*) AS n FROM detections "
        f"WHERE ts >= {NOW} - INTERVAL {days} DAY {only} GROUP BY 1)",
    )


@query("attack_series_hour", _series_sql(ZONE, 7, "hour"))
def _hours(df):
    return A.attack_series(df, AS_OF, days=7, bucket="hour", zone=ZONE)


@query("attack_series_day", _series_sql("Europe/London", 31, "day", "Deauth"))
def _day_series(df):
    return A.attack_series(df, AS_OF, days=31, bucket="day", zone="Europe/London", label="Deauth")


@query(
    "attack_series_totals",
    with_detections(
        "SELECT CAST(coalesce(sum(c.n) FILTER (s.bucket IS NOT NULL), 0) AS BIGINT) AS total, "
        "CAST(coalesce(sum(c.n) FILTER (s.bucket IS NULL), 0) AS BIGINT) AS outside_range, "
        'min(s.bucket) AS start, max(s.bucket) AS "end" FROM s FULL JOIN c USING (bucket)',
        f"s AS (SELECT strftime(CAST({local_sql(ZONE, NOW)} AS DATE) - CAST(i AS INTEGER), '%Y-%m-%d') AS bucket "
        "FROM range(10) r(i))",
        f"c AS (SELECT strftime({local_sql(ZONE)}, '%Y-%m-%d') AS bucket, count(*) AS n FROM detections "
        f"WHERE ts >= {NOW} - INTERVAL 10 DAY GROUP BY 1)",
    ),
)
def _series_totals(df):
    return A.attack_series_totals(df, AS_OF, days=10, bucket="day", zone=ZONE)


_W = 5760


@query(
    "compare_previous",
    with_detections(
        "SELECT a AS current_total, b AS previous_total, a - b AS change FROM (SELECT "
        f"count(*) FILTER (ts >= {NOW} - INTERVAL {_W} MINUTE) AS a, "
        f"count(*) FILTER (ts >= {NOW} - INTERVAL {2 * _W} MINUTE AND ts < {NOW} - INTERVAL {_W} MINUTE) AS b "
        "FROM detections) t"
    ),
)
def _compare(df):
    return A.compare_previous(df, AS_OF, _W)


_KEYS = ["deauth", "ssdp", "evil_twin", "reassoc", "rogueap", "krack", "disas", "kr00k", "other"]
_FRONT_ROWS = ", ".join(f"({i}, '{k}')" for i, k in enumerate(_KEYS))


def _report_ctes(days: int) -> list[str]:
    return [
        f"w AS (SELECT *, {FRONT} AS type FROM detections WHERE ts >= {NOW} - INTERVAL {days} DAY)",
        f"k(pos, type) AS (VALUES {_FRONT_ROWS})",
        "t AS (SELECT k.pos, k.type, count(w.id) AS n FROM k LEFT JOIN w USING (type) GROUP BY ALL)",
        "h AS (SELECT hour(ts) AS hr, count(*) AS n FROM w GROUP BY 1)",
    ]


def _report_select(days: int) -> str:
    return (
        f"'Last {days} day(s)' AS period, (SELECT CAST(sum(n) AS BIGINT) FROM t) AS total_attacks, "
        "(SELECT type FROM t ORDER BY n DESC, pos LIMIT 1) AS most_frequent_type, "
        "(SELECT CAST(hr AS INTEGER) FROM h ORDER BY n DESC, hr LIMIT 1) AS peak_hour, "
        "(SELECT count(DISTINCT src_mac) FROM w) AS unique_sources, "
        + ", ".join(f"(SELECT n FROM t WHERE type = '{k}') AS n_{k}" for k in _KEYS)
    )


@query("report_summary", with_detections("SELECT " + _report_select(14), *_report_ctes(14)))
def _report(df):
    return A.flat_summary(A.report_summary(df, AS_OF, days=14))


_ALL_TIME = ", ".join(
    f"(SELECT count(*) FROM detections WHERE predicted_label = '{c}') AS all_time_{k}"
    for c, k in [
        ("Deauth", "deauth"), ("Disas", "disas"), ("(Re)Assoc", "reassoc"), ("RogueAP", "rogueap"),
        ("Krack", "krack"), ("Kr00k", "kr00k"), ("Evil_Twin", "evil_twin"), ("SSDP", "ssdp"),
    ]
)


@query(
    "threat_overview",
    with_detections(
        f"SELECT {_report_select(30)}, (SELECT count(*) FROM detections) AS stored_all_time, "
        f"(SELECT {stamp_sql('min(ts)')} FROM detections) AS earliest_ts, "
        f"(SELECT {stamp_sql('max(ts)')} FROM detections) AS latest_ts, {_ALL_TIME}",
        *_report_ctes(30),
    ),
)
def _overview(df):
    out = A.flat_summary(A.threat_overview(df, AS_OF, days=30))
    return out.withColumns({c: stamp(c) for c in ("earliest_ts", "latest_ts")})


@query(
    "sensor_health",
    with_detections(
        f"SELECT count(*) AS packets, {stamp_sql('max(ts)')} AS latest_ts, "
        "(SELECT iface FROM detections ORDER BY id DESC LIMIT 1) AS observed_iface, "
        "(SELECT channel_freq FROM detections ORDER BY id DESC LIMIT 1) AS observed_channel_freq FROM detections"
    ),
)
def _health(df):
    return A.sensor_health(df).withColumn("latest_ts", stamp("latest_ts"))


query(
    "severity_totals",
    with_detections(
        f"SELECT s.severity, count(d.id) AS count FROM (VALUES ('critical'), ('high'), ('info')) s(severity) "
        f"LEFT JOIN (SELECT id, {SEVERITY} AS severity FROM detections) d USING (severity) GROUP BY 1"
    ),
)(A.severity_totals)


@query(
    "class_share",
    with_detections(
        "SELECT type, n AS count, round(n::DOUBLE / sum(n) OVER (), 6) AS share FROM t WHERE type <> 'other' OR n > 0",
        f"w AS (SELECT *, {FRONT} AS type FROM detections)",
        f"k(pos, type) AS (VALUES {_FRONT_ROWS})",
        "t AS (SELECT k.type, count(w.id) AS n FROM k LEFT JOIN w USING (type) GROUP BY ALL)",
    ),
)
def _share(df):
    return A.class_share(df).withColumn("share", F.round("share", 6))


@query(
    "label_dim_join",
    with_detections(f"SELECT id, {FRONT} AS front_key, {SEVERITY} AS severity FROM detections"),
)
def _label_dim(df):
    return A.with_label_dimension(df).select("id", "front_key", "severity")


query(
    "field_presence",
    with_detections(
        "SELECT 'ssid' AS field, count(ssid) AS rows FROM detections UNION ALL "
        "SELECT 'src_mac', count(src_mac) FROM detections UNION ALL "
        "SELECT 'dst_mac', count(dst_mac) FROM detections UNION ALL SELECT 'bssid', count(bssid) FROM detections"
    ),
)(lambda df: A.field_presence(df.withColumn("ssid", raw_field("raw", "ssid"))))

query(
    "top3_classes",
    with_detections(
        "SELECT bssid, predicted_label, n AS count, CAST(r AS INTEGER) AS rank FROM (SELECT *, "
        "row_number() OVER (PARTITION BY bssid ORDER BY n DESC, pos) AS r FROM (SELECT bssid, predicted_label, "
        "pos, count(*) AS n FROM detections JOIN classes ON label = predicted_label GROUP BY ALL) a) b WHERE r <= 3",
        CLASSES_SQL,
    ),
)(lambda df: A.top_classes(df, "bssid", 3))


@query(
    "zero_fill",
    with_detections(
        "SELECT b.bssid, c.label, CAST(coalesce(n, 0) AS BIGINT) AS count FROM (SELECT DISTINCT bssid FROM detections) b "
        "CROSS JOIN classes c LEFT JOIN (SELECT bssid, predicted_label AS label, count(*) AS n FROM detections GROUP BY ALL) t "
        "ON t.bssid = b.bssid AND t.label = c.label",
        CLASSES_SQL,
    ),
)
def _zero(df):
    counts = df.groupBy("bssid", F.col("predicted_label").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    frame = df.select("bssid").distinct().select(
        "bssid", F.explode(F.array(*[F.lit(c) for c in spec.ATTACK_CLASSES])).alias("label")
    )
    return A.zero_fill(frame, counts, ["bssid", "label"])


# ---- place ---------------------------------------------------------------------------

_RSSI = (
    "r AS (SELECT src_mac, bssid, count(*) AS n, coalesce(nullif(avg(signal_dbm), 0), -90.0) AS avg_rssi "
    f"FROM detections WHERE src_mac <> '' AND ts >= {NOW} - INTERVAL 14400 MINUTE GROUP BY 1, 2)"
)
_WEIGHTED = "u AS (SELECT r.*, a.name, a.lat, a.lng, 1.0 / greatest(1.0, abs(avg_rssi) + 1.0) AS w FROM r JOIN aps a USING (bssid))"


@query(
    "source_rssi", with_detections("SELECT src_mac, bssid, round(avg_rssi, 6) AS avg_rssi, n FROM r", _RSSI)
)
def _rssi(df):
    return locate.source_rssi(df, AS_OF, minutes=14400).withColumn("avg_rssi", F.round("avg_rssi", 6))


@query(
    "rssi_ap_join",
    with_detections(
        "SELECT src_mac, bssid, name, n, round(avg_rssi, 6) AS avg_rssi, round(w, 8) AS weight FROM u",
        APS_SQL, _RSSI, _WEIGHTED,
    ),
)
def _rssi_ap(df):
    out = locate.rssi_ap_join(locate.source_rssi(df, AS_OF, minutes=14400), access_points(df.sparkSession))
    return out.select(
        "src_mac", "bssid", "name", "n", F.round("avg_rssi", 6).alias("avg_rssi"), F.round("weight", 8).alias("weight")
    )


@query(
    "estimate_origin",
    with_detections(
        "SELECT r.src_mac, count(*) AS points, CAST(sum(r.n) AS BIGINT) AS frames, count(u.w) AS used, "
        "round(sum(u.lat * u.w) / sum(u.w), 6) AS lat, round(sum(u.lng * u.w) / sum(u.w), 6) AS lng "
        "FROM r LEFT JOIN u ON u.src_mac = r.src_mac AND u.bssid = r.bssid GROUP BY 1",
        APS_SQL, _RSSI, _WEIGHTED,
    ),
)
def _origin(df):
    out = locate.estimate_origin(df, access_points(df.sparkSession), AS_OF, minutes=14400)
    return out.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


# ---- orders --------------------------------------------------------------------------

_THREAT_COLS = f"id, {stamp_sql()} AS ts, predicted_label, proba_attack, ssid, sim"


def _threat_rows(df, order):
    return L.query_threats(df, order, 100).select(
        "id", stamp().alias("ts"), "predicted_label", "proba_attack", "ssid", "sim"
    )


for _order, _by in (
    ("newest", "detections.ts DESC, id DESC"),
    ("oldest", "detections.ts, id"),
    ("confidence", "proba_attack DESC NULLS LAST, id DESC"),
):
    query(
        f"threats_{_order}", with_detections(f"SELECT {_THREAT_COLS} FROM detections ORDER BY {_by} LIMIT 100")
    )(lambda df, o=_order: _threat_rows(df, o))


@query(
    "threats_report",
    with_detections(
        "SELECT count(*) AS row_count, count(*) >= 100 AS truncated FROM (SELECT * FROM detections LIMIT 100) t"
    ),
)
def _threat_report(df):
    return L.query_threats_report(df, "newest", 100)


_CHANNEL = (
    "CASE WHEN channel_freq = 2484 THEN 14 WHEN channel_freq BETWEEN 2412 AND 2472 THEN (channel_freq - 2412) // 5 + 1 "
    "WHEN channel_freq BETWEEN 5000 AND 5925 THEN (channel_freq - 5000) // 5 END"
)


@query(
    "detection_view",
    with_detections(
        f"SELECT CAST(id AS VARCHAR) AS id, {stamp_sql()} AS ts, {FRONT} AS type, {SEVERITY} AS severity, ssid, "
        f"CAST({_CHANNEL} AS INTEGER) AS channel, CAST(floor(signal_dbm + 0.5) AS INTEGER) AS rssi, "
        "wlan_retry = 1 AS retry, proba_attack AS confidence, sim FROM detections"
    ),
)
def _view(df):
    return L.detection_view(df).select(
        "id", stamp().alias("ts"), "type", "severity", "ssid", "channel", "rssi", "retry", "confidence", "sim"
    )


@query(
    "ledger_sort",
    with_detections(
        f"SELECT CAST(id AS VARCHAR) AS id, CAST({_CHANNEL} AS INTEGER) AS channel, "
        f"row_number() OVER (ORDER BY CAST({_CHANNEL} AS INTEGER) ASC NULLS LAST, ts DESC NULLS LAST, detections.id) AS place "
        "FROM detections"
    ),
)
def _ledger_sort(df):
    order = L.ledger_order("channel", descending=False)
    return with_place(L.detection_view(df), *order).select("id", "channel", "place")


@query(
    "ledger_page",
    with_detections(
        "SELECT CAST(id AS VARCHAR) AS id, proba_attack AS confidence FROM detections "
        "ORDER BY proba_attack DESC NULLS LAST, ts DESC, detections.id LIMIT 25 OFFSET 75"
    ),
)
def _page(df):
    return L.ledger_page(L.detection_view(df), 4, L.ledger_order("confidence")).select("id", "confidence")


@query(
    "ledger_after",
    with_detections(
        f"SELECT CAST(id AS VARCHAR) AS id, CAST({_CHANNEL} AS INTEGER) AS channel FROM detections "
        f"ORDER BY CAST({_CHANNEL} AS INTEGER) ASC NULLS LAST, ts DESC NULLS LAST, detections.id LIMIT 25 OFFSET 75"
    ),
)
def _after(df):
    """The fourth page, from the last row of each page before it."""
    view, last = L.detection_view(df), None
    for _ in range(3):
        last = L.ledger_after(view, last, "channel", descending=False).collect()[-1]
    return L.ledger_after(view, last, "channel", descending=False).select("id", "channel")


@query(
    "merge_tape",
    with_detections(
        "SELECT id, source FROM (SELECT id, ts, CASE WHEN id % 3 = 0 THEN 'stream' ELSE 'poll' END AS source "
        "FROM detections WHERE id % 3 = 0 OR id % 2 = 0) t ORDER BY ts DESC, t.id LIMIT 100"
    ),
)
def _tape(df):
    stream = df.filter("id % 3 = 0").withColumn("source", F.lit("stream"))
    poll = df.filter("id % 2 = 0").withColumn("source", F.lit("poll"))
    return L.merge_tape(stream, poll, 100).select("id", "source")


@query(
    "dedupe_latest",
    with_detections(
        "SELECT id // 4 AS id, max(id // 2) AS arrival, max(predicted_label) FILTER (id % 4 >= 2 OR last < 2) AS predicted_label "
        "FROM (SELECT *, max(id % 4) OVER (PARTITION BY id // 4) AS last FROM detections) d GROUP BY 1"
    ),
)
def _dedupe(df):
    """Two rows each arrive at once."""
    copies = df.select(F.expr("id div 4").alias("id"), F.expr("id div 2").alias("arrival"), "predicted_label")
    return L.dedupe_latest(copies)


# ---- lifted fields and keys ------------------------------------------------------------


@query(
    "bucket_key",
    with_detections(
        f"SELECT id, strftime({local_sql('America/New_York')}, '%Y-%m-%dT%H') AS hour_key, "
        f"strftime({local_sql('America/New_York')}, '%Y-%m-%d') AS day_key FROM detections"
    ),
)
def _buckets(df):
    local = local_time("ts", "America/New_York")
    return df.select("id", bucket_key(local, "hour").alias("hour_key"), bucket_key(local, "day").alias("day_key"))


@query(
    "local_parts",
    with_detections(
        f"SELECT id, CAST(dayofweek({local_sql(ZONE)}) AS INTEGER) AS day_no, "
        f"CAST(hour({local_sql(ZONE)}) AS INTEGER) AS hour FROM detections"
    ),
)
def _local(df):
    local = local_time("ts", ZONE)
    return df.select("id", day_index(local).alias("day_no"), F.hour(local).alias("hour"))


@query("raw_fields", with_detections("SELECT id, sim, ssid, sim_batch FROM detections"))
def _raw(df):
    return df.select(
        "id", is_simulated("raw").alias("sim"), raw_field("raw", "ssid").alias("ssid"),
        raw_field("raw", "sim_batch").alias("sim_batch"),
    )


@query(
    "mac_search",
    with_detections("SELECT id, src_mac FROM detections WHERE replace(src_mac, ':', '') LIKE '%00002a%'"),
)
def _mac(df):
    return df.filter(mac_contains("src_mac", "00:00-2A")).select("id", "src_mac")

