"""Checks of frame features, rolling aggregates and model windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.adapters import events, features, labelled_frames, raw_frames
from wlanlake.catalog.common import (
    EVENTS,
    FRAME_KEYS,
    FRAMES,
    rounded,
    rounded_sql,
    with_frames,
)
from wlanlake.functions.labels import label_name
from wlanlake.operators import dataset, quality, rollups, windows
from wlanlake.operators import filters as P
from wlanlake.operators.frames import observed_times
from wlanlake.operators.layout import with_position
from wlanlake.session import store
from wlanlake.sources import capture, shards

QUERIES = {}
ORACLES = {}
KEYS = ["session_id", "block_id", "frame_number"]


def keyed(df):
    """Block, position key and class of every frame: what most window checks need."""
    return df.select(*KEYS, "label")


def query(name: str, sql: str | None = None, source=features):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(source(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def light(spark, sf_dir):
    """Frames without their features, for checks that only look at keys and classes."""
    return keyed(labelled_frames(spark, sf_dir))


# ---- features ------------------------------------------------------------------------


@query(
    "frame_features",
    with_frames(f"SELECT session_id, block_id, frame_number, label, {rounded_sql(spec.FLAT_FEATURES)} FROM frames"),
)
def _features(df):
    return df.selectExpr(*KEYS, "int(label) as label", *rounded(spec.FLAT_FEATURES))


query(
    "seq_delta", with_frames("SELECT block_id, frame_number, CAST(wlan_seq_delta AS DOUBLE) AS wlan_seq_delta FROM frames")
)(lambda df: df.selectExpr("block_id", "frame_number", "double(wlan_seq_delta) as wlan_seq_delta"))

query(
    "same_bssid_prev",
    with_frames("SELECT block_id, frame_number, CAST(addr_same_bssid_as_prev AS INTEGER) AS same FROM frames"),
)(lambda df: df.selectExpr("block_id", "frame_number", "int(addr_same_bssid_as_prev) as same"))

query(
    "frame_dt",
    with_frames(f"SELECT block_id, frame_number, {rounded_sql(['frame_dt', 'frame_dt_log'])} FROM frames"),
)(lambda df: df.selectExpr("block_id", "frame_number", *rounded(["frame_dt", "frame_dt_log"])))


@query(
    "observed_times",
    f"WITH {FRAMES}, t AS (SELECT block_id, event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE epoch_us(ts)::DOUBLE / 1000000 END AS x FROM f0) "
    "SELECT block_id, event_id AS frame_number, CASE WHEN x IS NOT NULL THEN round(coalesce(greatest(0, x - last_value(x IGNORE NULLS) OVER "
    "(PARTITION BY block_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0), 4) END AS time_delta, "
    "CASE WHEN x IS NOT NULL THEN round(x - arg_min(x, event_id) OVER (PARTITION BY block_id), 4) END AS time_relative FROM t",
    source=raw_frames,
)
def _observed(df):
    timed = df.selectExpr(
        *KEYS, "if(frame_number % 9 = 0, null, double(frame_time_epoch)) as epoch"
    )
    return observed_times(timed).selectExpr(
        "block_id", "frame_number", *rounded(["time_delta", "time_relative"])
    )


# ---- rolling aggregates ----------------------------------------------------------------


def _roll_sql(windows_=(16, 64)) -> str:
    parts = []
    for n in windows_:
        over = f"OVER (PARTITION BY block_id ORDER BY frame_number ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
        for c in map(spec.flat, spec.ROLL_MEAN_STD):
            x = f"CAST({c} AS DOUBLE)"
            parts.append(f"CAST(avg({x}) {over} AS FLOAT) AS roll{n}_{c}_mean")
            parts.append(
                f"CAST(CASE WHEN count({c}) {over} > 1 THEN stddev_pop({x}) {over} END AS FLOAT) AS roll{n}_{c}_std"
            )
        for c in map(spec.flat, spec.ROLL_RATE):
            parts.append(f"CAST(avg(CAST({c} AS DOUBLE)) {over} AS FLOAT) AS roll{n}_{c}_rate")
    return ", ".join(parts)


ROLLS = [spec.flat(c) for c in spec.roll_names()]


@query(
    "causal_rollups",
    with_frames(
        f"SELECT block_id, frame_number, {rounded_sql(ROLLS, 3)} FROM r",
        f"r AS (SELECT block_id, frame_number, {_roll_sql()} FROM frames)",
    ),
)
def _rollups(df):
    return rollups.causal_rollups(df).selectExpr("block_id", "frame_number", *rounded(ROLLS, 3))


@query(
    "model_row",
    with_frames(
        f"SELECT block_id, frame_number, label, {rounded_sql(spec.FLAT_MODEL_COLUMNS, 3)} FROM r",
        f"r AS (SELECT *, {_roll_sql()} FROM frames)",
    ),
    source=labelled_frames,
)
def _model_row(df):
    return rollups.model_rows_from_raw(df).selectExpr(
        "block_id", "frame_number", "int(label) as label", *rounded(spec.FLAT_MODEL_COLUMNS, 3)
    )


@query("causality_probe", "SELECT 0::BIGINT AS changed_past_rows")
def _causal(df):
    """How many past rows move when the future is perturbed: none."""
    stored = store(df.select(*KEYS, *rollups.INPUTS), "features")
    middle = stored.agg((F.max("frame_number") / 2).cast("long")).first()[0]
    leaks = rollups.future_leaks(stored, "frame_len", middle, 1000.0)
    return leaks.agg(F.count(F.lit(1)).alias("changed_past_rows"))


# ---- blocks -------------------------------------------------------------------------------

_F0 = f"WITH {FRAME_KEYS}"


@query(
    "block_ids",
    f"{_F0} SELECT event_id AS frame_number, session_id, block_id FROM f0",
    source=events,
)
def _block_ids(df):
    # Rebuild the path a capture file of that block would have.
    number = F.expr("get(array('1', '11', '12', '6'), int(user_id % 4))")
    session = F.expr("get(array('Deauth', 'SSDP', 'Evil_Twin', 'Krack'), int(user_id % 4))")
    path = F.concat(F.lit("file:/data/"), number, F.lit("."), session, F.lit("/"), session, F.lit("_"), F.expr("user_id % 16"), F.lit(".csv"))
    placed = capture.with_block_ids(df.withColumn("_path", path))
    return placed.select(F.col("event_id").alias("frame_number"), "session_id", "block_id")


query(
    "skip_sessions",
    f"{_F0} SELECT event_id AS frame_number, session_id FROM f0 WHERE session_id NOT IN ('SSDP', 'Krack')",
    source=light,
)(lambda df: capture.skip_sessions(df, ["SSDP", "Krack"]).select("frame_number", "session_id"))


def blocks_of(df):
    """Blocks made finer by user, so that a session has many of them."""
    return df.selectExpr("session_id", "concat(block_id, '.', frame_number % 10) as block_id").distinct()


@query(
    "sample_blocks_spread",
    f"{_F0}, b AS (SELECT DISTINCT session_id, block_id || '.' || (event_id % 10) AS block_id FROM f0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY block_id) - 1 AS i, "
    "count(*) OVER (PARTITION BY session_id) AS n FROM b) SELECT session_id, block_id FROM r "
    "WHERE n <= 7 OR i IN (SELECT CAST(floor(j * n / 7.0) AS BIGINT) FROM range(7) t(j))",
    source=light,
)
def _spread(df):
    return shards.sample_blocks_spread(blocks_of(df), 7).select("session_id", "block_id")


query(
    "block_label_counts",
    f"{_F0} SELECT session_id, block_id, label, count(*) AS count FROM f0 GROUP BY ALL",
    source=light,
)(lambda df: shards.block_label_counts(df).withColumn("label", F.col("label").cast("int")))

query(
    "shard_integrity",
    f"{_F0} SELECT CAST(event_id // 64 AS VARCHAR) AS shard, count(DISTINCT block_id) AS blocks FROM f0 GROUP BY 1 "
    "HAVING count(DISTINCT block_id) > 1",
    source=light,
)(lambda df: shards.shard_integrity(df.selectExpr("string(frame_number div 64) as shard", "block_id"), "shard"))


@query(
    "format_guard",
    f"{_F0} SELECT block_id, arg_min(label = 7 AND event_id % 5 = 0, event_id) AS rejected, "
    "count(*) FILTER (label = 7 AND event_id % 5 = 0) AS odd_rows FROM f0 GROUP BY 1",
    source=labelled_frames,
)
def _format(df):
    # Some beacon rows get the newer spelling of booleans.
    odd = df.withColumn(
        "wlan_fc_retry", F.expr("if(label = 7 and frame_number % 5 = 0, 'True', wlan_fc_retry)")
    )
    return capture.check_export_format(odd).select("block_id", "rejected", "odd_rows")


query(
    "null_sentinels",
    "WITH "
    + EVENTS
    + " SELECT event_id AS frame_number, CASE WHEN k % 16 = 0 THEN 'ab12' END AS pmkid FROM e",
    source=raw_frames,
)(lambda df: capture.null_sentinels(df).selectExpr("frame_number", "wlan_rsn_ie_pmkid as pmkid"))


@query(
    "analysis_columns",
    "WITH " + EVENTS + " SELECT event_id AS frame_number, k % 4 AS ds, "
    "'frame_len,frame_time_delta,radiotap_channel_flags_cck,radiotap_channel_flags_ofdm,radiotap_channel_freq,"
    "radiotap_datarate,radiotap_dbm_antsignal,radiotap_length,radiotap_rxflags,raw_label,wlan_country_info_code,wlan_duration,"
    "wlan_fc_ds,wlan_fc_frag,wlan_fc_moredata,wlan_fc_order,wlan_fc_protected,wlan_fc_pwrmgt,wlan_fc_retry,wlan_fc_subtype,"
    "wlan_fc_type,wlan_fcs_bad_checksum,wlan_fixed_beacon,wlan_fixed_capabilities_ess,wlan_fixed_capabilities_ibss,"
    "wlan_fixed_reason_code,wlan_radio_data_rate,wlan_radio_phy,wlan_radio_signal_dbm,wlan_rsn_capabilities_mfpc,wlan_seq' AS columns FROM e",
    source=raw_frames,
)
def _analysis(df):
    kept = capture.select_analysis_columns(df)
    names = ",".join(sorted(kept.columns))
    numbered = df.select("frame_number", *kept.columns)
    return numbered.select("frame_number", F.col("wlan_fc_ds").cast("long").alias("ds"), F.lit(names).alias("columns"))


query(
    "excluded_columns",
    "WITH " + EVENTS + ", x AS (SELECT count(*) AS n, count(*) FILTER (k % 7 = 0) AS mactime, count(*) FILTER (event_id % 97 <> 0) AS sa, "
    "count(*) FILTER (k % 2 = 1 OR event_id % 97 <> 0) AS ta, count(*) FILTER (event_id % 5 <> 0) AS bssid, "
    "count(*) FILTER (event_type = 'error') AS ssid FROM e) SELECT * FROM (SELECT unnest(['frame.time_epoch', 'radiotap.mactime', 'wlan.ssid', "
    "'wlan.sa', 'wlan.da', 'wlan.bssid', 'wlan.ta']) AS column, unnest(['capture clock', 'radio counter', 'identity', 'identity', "
    "'identity', 'identity', 'identity']) AS reason, unnest([n, mactime, ssid, sa, n, bssid, ta]) AS rows FROM x) t",
    source=raw_frames,
)(capture.excluded_report)


# ---- windows --------------------------------------------------------------------------------

_POS = "p AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY event_id) - 1 AS rn, count(*) OVER (PARTITION BY block_id) AS n FROM f0)"
_STARTS = "s AS (SELECT block_id, rn AS start, event_id, n FROM p WHERE n >= 64 AND ((rn % 16 = 0 AND rn < n - 64) OR rn = n - 64))"


@query(
    "block_positions",
    f"{_F0}, {_POS} SELECT block_id, event_id AS frame_number, rn, n AS n_rows FROM p",
    source=light,
)
def _positions(df):
    return with_position(df).select("block_id", "frame_number", "rn", "n_rows")


@query(
    "training_windows",
    f"{_F0}, {_POS}, {_STARTS} SELECT block_id, start, event_id AS frame_number FROM s",
    source=light,
)
def _windows(df):
    return windows.training_windows(df, 64, 16).select("block_id", "start", "frame_number")


@query(
    "windows_with_attack",
    f"{_F0}, {_POS}, {_STARTS} SELECT s.block_id, s.start, count(*) FILTER (p.label > 0) AS attack_rows, "
    "count(*) FILTER (p.label > 0) > 0 AS has_attack FROM s JOIN p ON p.block_id = s.block_id AND p.rn >= s.start "
    "AND p.rn < s.start + 64 GROUP BY 1, 2",
    source=light,
)
def _with_attack(df):
    return windows.windows_with_attack(df, 64, 16)


@query(
    "inference_chunks",
    f"{_F0}, {_POS} SELECT block_id, greatest(0, rn - 126) AS ctx_start, rn AS pred_start, least(rn + 200, n) AS pred_end "
    "FROM p WHERE rn % 200 = 0",
    source=light,
)
def _chunks(df):
    return windows.inference_chunks(df, 200, 126)


@query(
    "no_cross_block",
    f"{_F0}, {_POS}, {_STARTS} SELECT count(*) AS windows, 0::BIGINT AS escaping, "
    "count(*) FILTER (start + 64 + 40 > n) AS escaping_if_longer FROM s",
    source=light,
)
def _no_cross(df):
    starts = windows.training_windows(df, 64, 16)
    sizes = df.groupBy("block_id").agg(F.count(F.lit(1)).alias("n_rows"))
    n = F.count(F.lit(1))
    return (
        starts.agg(n.alias("windows"))
        .crossJoin(windows.escaping_windows(starts, sizes, 64).agg(n.alias("escaping")))
        .crossJoin(windows.escaping_windows(starts, sizes, 104).agg(n.alias("escaping_if_longer")))
    )


def _densest_sql(size: int) -> str:
    return (
        f"d{size} AS (SELECT block_id, CASE WHEN n <= {size} THEN 0 ELSE rn - {size - 1} END AS lo, CASE WHEN n <= {size} THEN n ELSE rn + 1 END AS hi, "
        f"CASE WHEN n <= {size} THEN sum(h) OVER (PARTITION BY block_id) ELSE sum(h) OVER (PARTITION BY block_id ORDER BY rn ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) END AS hits "
        f"FROM (SELECT *, CASE WHEN label = 1 THEN 1 ELSE 0 END AS h FROM p) x QUALIFY (n <= {size} AND rn = 0) OR (n > {size} AND rn >= {size - 1})), "
        f"b{size} AS (SELECT * FROM d{size} QUALIFY row_number() OVER (PARTITION BY block_id ORDER BY hits DESC, lo) = 1)"
    )


@query(
    "densest_window",
    f"{_F0}, {_POS}, {_densest_sql(32)}, {_densest_sql(64)}, {_densest_sql(100)} SELECT b100.block_id, "
    + ", ".join(
        f"CAST(CASE WHEN b32.hits >= 14 THEN b32.{c} WHEN b64.hits >= 14 THEN b64.{c} ELSE b100.{c} END AS BIGINT) AS {c}"
        for c in ("lo", "hi", "hits")
    )
    + " FROM b100 JOIN b64 USING (block_id) JOIN b32 USING (block_id)",
    source=light,
)
def _densest(df):
    return windows.densest_window(df, F.col("label") == 1, 32, 100, 14)


_GATHER = ["frame_len", "radio_signal_dbm", "fc_retry"]


@query(
    "gather_windows",
    with_frames(
        "SELECT s.block_id, s.start, count(*) AS rows, "
        + ", ".join(f"sum(CAST(p.{c} AS DOUBLE)) AS sum_{c}" for c in _GATHER)
        + " FROM s JOIN p ON p.block_id = s.block_id AND p.rn BETWEEN s.start AND s.start + 63 GROUP BY 1, 2",
        "p AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY frame_number) - 1 AS rn, count(*) OVER (PARTITION BY block_id) AS n FROM frames)",
        "s AS (SELECT block_id, rn AS start FROM p WHERE n >= 64 AND ((rn % 32 = 0 AND rn < n - 64) OR rn = n - 64))",
    ),
)
def _gather(df):
    made = windows.gather_windows(df, _GATHER, 64, 32)
    sums = [
        f"reduce(features[{i}], cast(null as double), (a, x) -> if(x is null, a, coalesce(a, 0D) + x)) as sum_{c}"
        for i, c in enumerate(_GATHER)
    ]
    return made.selectExpr("block_id", "start", "bigint(size(features[0])) as rows", *sums)


@query(
    "context_window",
    with_frames(
        "SELECT block_id, frame_number, count(*) OVER w AS rows, CAST(sum(frame_len) OVER w AS DOUBLE) AS sum_len, "
        "CAST(first_value(radio_signal_dbm) OVER w AS DOUBLE) AS oldest_signal FROM frames "
        "WINDOW w AS (PARTITION BY block_id ORDER BY frame_number ROWS BETWEEN 126 PRECEDING AND CURRENT ROW)"
    ),
)
def _context(df):
    ctx = windows.context_window(df, ["frame_len", "radio_signal_dbm"], 126)
    return ctx.selectExpr(
        "block_id",
        "frame_number",
        "bigint(size(context)) as rows",
        "reduce(context, cast(null as double), (a, r) -> if(r[0] is null, a, coalesce(a, 0D) + r[0])) as sum_len",
        "double(context[0][1]) as oldest_signal",
    )


# ---- profiles and samples of frames -----------------------------------------------------------


@query(
    "feature_coverage",
    with_frames(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(100.0 * count({c}) / count(*), 6) AS coverage_pct FROM frames"
            for c in spec.FLAT_FEATURES
        )
    ),
)
def _coverage(df):
    return quality.feature_coverage(df, spec.FLAT_FEATURES).withColumn("coverage_pct", F.round("coverage_pct", 6))


query(
    "class_distribution",
    f"{_F0}, c(label, class) AS (VALUES "
    + ", ".join(f"({i}, '{c}')" for i, c in enumerate(spec.CLASSES))
    + ") SELECT c.label, c.class, count(f0.label) AS count, round(100.0 * count(f0.label) / (SELECT count(*) FROM f0), 6) AS pct "
    "FROM c LEFT JOIN f0 USING (label) GROUP BY ALL",
    source=light,
)(lambda df: dataset.class_distribution(df).withColumn("pct", F.round("pct", 6)))

query(
    "unknown_labels",
    "WITH " + EVENTS + " SELECT 'odd ' || (k % 4) AS raw_label, count(*) AS count FROM e WHERE event_id % 9 = 0 GROUP BY 1",
    source=raw_frames,
)(
    lambda df: dataset.unknown_labels(
        df.withColumn("raw_label", F.expr("if(frame_number % 9 = 0, concat('odd ', regexp_extract(wlan_tag_length, '([0-9]+)$', 1) % 4), raw_label)"))
    )
)


@query(
    "binary_target",
    f"{_F0} SELECT event_id AS frame_number, CASE WHEN label = 0 THEN 0 ELSE 1 END AS binary_label FROM f0 WHERE label IN (0, 1, 8)",
    source=light,
)
def _binary(df):
    named = df.withColumn("label_name", label_name("label"))
    return P.binary_target(named, ["Deauth", "SSDP"]).select("frame_number", "binary_label")


# A number per row that both engines can compute, in place of their own hashes.
KEY32 = "(({0} * 2654435761) % 4294967296)"


def spark_key(c: str):
    """The shared number, moved into the upper bits of a 64-bit key."""
    return F.shiftleft(F.expr(KEY32.format(c)).cast("long"), 31)


_FLAGGED = (
    "w AS (SELECT s.block_id, s.start, count(*) FILTER (p.label > 1) AS attack_rows FROM s JOIN p ON p.block_id = s.block_id "
    "AND p.rn >= s.start AND p.rn < s.start + 8 GROUP BY 1, 2)"
)


@query(
    "select_windows",
    f"{_F0}, {_POS}, s AS (SELECT block_id, rn AS start FROM p WHERE n >= 8 AND ((rn % 4 = 0 AND rn < n - 8) OR rn = n - 8)), {_FLAGGED}, "
    "b AS (SELECT round_even(greatest(count(*), 1) * 0.25, 0) AS budget FROM w WHERE attack_rows > 0), "
    f"r AS (SELECT *, row_number() OVER (ORDER BY {KEY32.format('start')}, block_id, start) - 1 AS rk FROM w WHERE attack_rows = 0) "
    "SELECT block_id, start, attack_rows, true AS has_attack FROM w WHERE attack_rows > 0 UNION ALL "
    "SELECT block_id, start, attack_rows, false FROM r, b WHERE rk < budget",
    source=light,
)
def _select_windows(df):
    rare = df.withColumn("label", F.when(F.col("label") > 1, F.col("label")).otherwise(0))
    return dataset.select_windows(rare, 8, 4, ratio=0.25, key=spark_key("start"))


@query(
    "subsample_rows",
    f"{_F0} SELECT block_id, event_id AS frame_number, label FROM f0 WHERE label > 0 OR {KEY32.format('event_id')} / 4294967296.0 < 0.3",
    source=light,
)
def _subsample(df):
    uniform = F.expr(KEY32.format("frame_number")) / 4294967296.0
    return dataset.subsample_rows(df, 0.3, uniform=uniform).select(
        "block_id", "frame_number", F.col("label").cast("int").alias("label")
    )


@query(
    "oversample_minority",
    f"{_F0}, m AS (SELECT event_id, row_number() OVER (ORDER BY {KEY32.format('event_id')}, event_id) - 1 AS rk FROM f0 WHERE label = 1), "
    "z AS (SELECT (SELECT count(*) FROM m) AS minor, greatest(CAST(floor((SELECT count(*) FROM f0 WHERE label <> 1) * (0.30::DOUBLE / (1 - 0.30::DOUBLE))) AS BIGINT), (SELECT count(*) FROM m)) AS goal) "
    "SELECT event_id AS frame_number, 0 AS binary_label, 1::BIGINT AS copies FROM f0 WHERE label <> 1 UNION ALL "
    "SELECT event_id, 1, goal // minor + CASE WHEN rk < goal % minor THEN 1 ELSE 0 END FROM m, z",
    source=light,
)
def _oversample(df):
    target = df.select("frame_number", F.when(F.col("label") == 1, 1).otherwise(0).alias("binary_label"))
    more = dataset.oversample_minority(target, share=0.30, key=spark_key("frame_number"))
    return more.groupBy("frame_number", "binary_label").agg(F.count(F.lit(1)).alias("copies"))


_SPLIT = (
    f"x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {KEY32.format('event_id')}, event_id) - 1 AS rk, "
    "count(*) OVER (PARTITION BY label) AS n FROM f0), "
    "t AS (SELECT *, CASE WHEN rk < round_even(n * 0.2::DOUBLE, 0) THEN 'test' ELSE 'train' END AS split FROM x)"
)


@query(
    "stratified_split",
    f"{_F0}, {_SPLIT} SELECT event_id AS frame_number, label, split FROM t",
    source=light,
)
def _stratified(df):
    return dataset.stratified_split(df, "label", key=spark_key("frame_number")).select(
        "frame_number", F.col("label").cast("int").alias("label"), "split"
    )


@query(
    "union_splits",
    f"{_F0}, {_SPLIT} SELECT event_id AS frame_number, label, split FROM t",
    source=light,
)
def _union(df):
    parts = dataset.stratified_split(df, "label", key=spark_key("frame_number"))
    train, test = parts.filter("split = 'train'"), parts.filter("split = 'test'")
    return dataset.union_splits([train, test]).select(
        "frame_number", F.col("label").cast("int").alias("label"), "split"
    )


# ---- splits by block ----------------------------------------------------------------------------

_ASSIGN = "a AS (SELECT DISTINCT block_id, CASE WHEN user_id % 16 < 9 THEN 'train' WHEN user_id % 16 < 11 THEN 'val' ELSE 'test' END AS split FROM f0 WHERE user_id % 16 <> 15)"


def assignment(df):
    number = F.expr("int(right(block_id, 4))")
    split = F.when(number < 9, "train").when(number < 11, "val").otherwise("test")
    return df.filter(number != 15).select("block_id").distinct().withColumn("split", split)


query(
    "rows_by_split",
    f"{_F0}, {_ASSIGN} SELECT f0.block_id, event_id AS frame_number, split FROM f0 JOIN a USING (block_id)",
    source=light,
)(lambda df: shards.rows_by_split(df, assignment(df)).select("block_id", "frame_number", "split"))

query(
    "split_report",
    f"{_F0}, {_ASSIGN}, j AS (SELECT f0.*, split FROM f0 JOIN a USING (block_id)), "
    "g AS (SELECT label, count(DISTINCT block_id) AS blocks, count(*) FILTER (split = 'train') AS train, "
    "count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM j GROUP BY 1) "
    "SELECT label, ['Normal', 'Deauth', 'Disas', '(Re)Assoc', 'RogueAP', 'Krack', 'Kr00k', 'Evil_Twin', 'SSDP'][label + 1] AS class, "
    "blocks, train, val, test, concat_ws(',', CASE WHEN train = 0 THEN 'train' END, CASE WHEN val = 0 THEN 'val' END, "
    "CASE WHEN test = 0 THEN 'test' END) AS absent_from FROM g",
    source=light,
)(lambda df: dataset.split_report(df, assignment(df)))

query(
    "split_missing",
    f"{_F0} SELECT DISTINCT block_id, 'test' AS split FROM f0 WHERE user_id % 16 >= 13",
    source=light,
)(
    lambda df: shards.missing_blocks(
        df.select("block_id").distinct().withColumn("split", F.lit("test")),
        df.filter("int(right(block_id, 4)) < 13"),
    )
)

_OVER = ["radio_freq_mhz", "radio_datarate", "fc_ds", "mgmt_tag_len"]


@query(
    "split_overlap",
    with_frames(
        "SELECT (SELECT count(*) FROM a) AS train_rows, (SELECT count(*) FROM b) AS test_rows, "
        "(SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) i) AS overlap",
        f"a AS (SELECT DISTINCT {', '.join(_OVER)} FROM frames WHERE frame_number % 40 <> 7)",
        f"b AS (SELECT DISTINCT {', '.join(_OVER)} FROM frames WHERE frame_number % 40 = 7)",
    ),
)
def _overlap(df):
    return dataset.split_overlap(df.filter("frame_number % 40 <> 7"), df.filter("frame_number % 40 = 7"), _OVER)
