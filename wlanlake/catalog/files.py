"""Checks of scans and sinks; the files they read are written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.adapters import AS_OF, detections, features, labelled_frames, raw_frames, table
from wlanlake.catalog.common import (
    FRAME_KEYS,
    rounded,
    rounded_sql,
    stamp,
    stamp_sql,
    with_detections,
    with_frames,
)
from wlanlake.operators import dataset, maintenance
from wlanlake.plans.prepare import prepare_features
from wlanlake.session import work_dir
from wlanlake.sources import capture, inventory, packets, shards

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


FOLDERS = {"Deauth": "1.Deauth", "Krack": "6.Krack", "SSDP": "11.SSDP", "Evil_Twin": "12.Evil_Twin"}


def capture_files(spark, sf_dir, *, malformed: bool = False) -> str:
    """The raw frames as capture CSV files, one folder per session, one file per block.

    With ``malformed`` some rows have one cell too many.
    """
    frames = raw_frames(spark, sf_dir)
    folder = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair]), F.col("session_id")
    )
    file = F.concat(
        "session_id", F.lit("_"), F.right("block_id", F.lit(4)).cast("int").cast("string"), F.lit(".csv")
    )
    label = F.col("raw_label")
    options = {"header": True, "encoding": "ISO-8859-1", "emptyValue": ""}
    if malformed:
        # Without a quote character a comma in the last cell becomes one cell more.
        label = F.when(F.col("frame_number") % 50 == 0, F.concat(label, F.lit(",x"))).otherwise(label)
        frames = frames.withColumn("eapol_len", F.replace("eapol_len", F.lit(","), F.lit("-")))
        options |= {"quote": "", "escapeQuotes": False}
    cells = [F.col(spec.flat(c)).alias(c) for c in spec.SOURCE_COLUMNS if c != "Label"]
    path = work_dir(spark, "capture")
    (
        frames.select(
            folder.alias("folder"), file.alias("file"), F.col("frame_number").alias("frame.number"),
            *cells, label.alias("Label"),
        )
        .repartition("folder", "file")
        .sortWithinPartitions("`frame.number`")
        .write.partitionBy("folder", "file")
        .options(**options)
        .csv(path)
    )
    return path + "/*/*"


@query(
    "scan_capture_csv",
    f"WITH {FRAME_KEYS} SELECT session_id, block_id, event_id AS frame_number, CAST(seq AS VARCHAR) AS seq, "
    "CASE event_type WHEN 'signup' THEN 'deauth' WHEN 'error' THEN 'Evil_Twin' WHEN 'purchase' THEN 'SDDP' ELSE 'Normal' END AS raw_label, "
    "'0-8-' || k AS tags FROM f0 WHERE session_id <> 'SSDP'",
)
def _scan(spark, sf_dir):
    rows = capture.read_capture_csv(spark, capture_files(spark, sf_dir), skip_sessions=["11.SSDP"])
    return rows.selectExpr(
        "session_id", "block_id", "frame_number", "wlan_seq as seq", "raw_label", "wlan_tag_length as tags"
    )


@query(
    "malformed_rows",
    f"WITH {FRAME_KEYS} SELECT session_id, block_id, count(*) AS rows, count(*) FILTER (event_id % 50 = 0) AS malformed FROM f0 GROUP BY 1, 2",
)
def _malformed(spark, sf_dir):
    scan = capture.read_capture_csv(spark, capture_files(spark, sf_dir, malformed=True), malformed=True)
    return capture.split_malformed(scan)[1]


_SUMMARY = ", ".join(
    f"count(*) FILTER (event_id % 50 <> 0 AND label = {i}) AS n_{spec.FRONT_KEY_OF.get(c, c.lower())}"
    for i, c in enumerate(spec.CLASSES)
)


@query(
    "prepare_features",
    f"WITH {FRAME_KEYS} SELECT count(*) FILTER (event_id % 50 <> 0) AS rows, "
    f"count(DISTINCT CASE WHEN event_id % 50 <> 0 THEN block_id END) AS blocks, {_SUMMARY}, "
    "count(*) FILTER (event_id % 50 = 0) AS malformed, 0::BIGINT AS unknown_label_rows, 0::BIGINT AS rejected_blocks "
    "FROM f0 WHERE session_id <> 'Krack'",
)
def _prepare(spark, sf_dir):
    source = capture_files(spark, sf_dir, malformed=True)
    summary = prepare_features(spark, source, work_dir(spark, "features"), skip_sessions=["6.Krack"])
    return summary.drop("odd_rows")


def stored_features(spark, sf_dir) -> str:
    path = work_dir(spark, "features")
    shards.write_features(features(spark, sf_dir), path)
    return path


@query(
    "write_features",
    f"WITH {FRAME_KEYS} SELECT session_id, block_id, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS sum_frame FROM f0 GROUP BY 1, 2",
)
def _write(spark, sf_dir):
    path = stored_features(spark, sf_dir)
    # A second run finds every block there and adds nothing.
    shards.write_features(features(spark, sf_dir), path)
    return shards.read_features(spark, path).groupBy("session_id", "block_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("frame_number").alias("sum_frame")
    )


@query(
    "scan_features",
    with_frames(f"SELECT session_id, block_id, frame_number, label, {rounded_sql(spec.FLAT_FEATURES)} FROM frames"),
)
def _scan_features(spark, sf_dir):
    out = shards.read_features(spark, stored_features(spark, sf_dir))
    return out.selectExpr(
        "session_id", "block_id", "frame_number", "int(label) as label", *rounded(spec.FLAT_FEATURES)
    )


@query(
    "ap_locations",
    "SELECT printf('aa:aa:aa:aa:aa:%02x', s_suppkey % 256) AS bssid, s_name AS name, 24.0::DOUBLE + s_suppkey AS lat, "
    "s_acctbal AS lng FROM supplier WHERE s_suppkey % 10 NOT IN (3, 7)",
)
def _aps(spark, sf_dir):
    """An inventory file made from the suppliers, some entries without a usable place."""
    entry = F.struct(
        F.expr("format_string('aa:aa:aa:aa:aa:%02x', s_suppkey % 256)").alias("bssid"),
        F.expr("if(s_suppkey % 10 = 7, null, s_name)").alias("name"),
        F.expr("if(s_suppkey % 10 = 3, 'north', string(24D + s_suppkey))").alias("lat"),
        F.col("s_acctbal").alias("lng"),
    )
    path = work_dir(spark, "inventory")
    suppliers = table(spark, sf_dir, "supplier")
    # One document per hundred suppliers, so that no document grows with the data.
    documents = suppliers.groupBy(F.expr("s_suppkey div 100")).agg(
        F.to_json(F.struct(F.collect_list(entry).alias("aps"))).alias("value")
    )
    documents.select("value").write.text(path)
    return inventory.read_ap_locations(spark, path, per_line=True)


_NUMBER = "user_id % 16"


@query(
    "split_validate",
    f"WITH {FRAME_KEYS} SELECT DISTINCT block_id, CASE WHEN {_NUMBER} < 9 THEN 'train' ELSE 'test' END AS split FROM f0",
)
def _split(spark, sf_dir):
    blocks = labelled_frames(spark, sf_dir).select("block_id").distinct()
    split = F.when(F.right("block_id", F.lit(4)).cast("int") < 9, "train").otherwise("test")
    path = work_dir(spark, "split")
    shards.save_split(blocks.withColumn("split", split), path)
    return shards.load_split(spark, path, blocks)


@query(
    "to_packets",
    with_frames(
        "SELECT frame_number AS id, CAST(frame_len AS INTEGER) AS frame_len, CAST(radio_freq_mhz AS INTEGER) AS channel_freq, "
        "CAST(radio_datarate AS DOUBLE) AS datarate, CAST(radio_signal_dbm AS DOUBLE) AS signal_dbm, CAST(fc_ds AS INTEGER) AS wlan_ds, "
        "CAST(fc_retry AS INTEGER) AS wlan_retry, CASE WHEN fc_type >= 0 THEN CAST(fc_type AS INTEGER) END AS wlan_type, "
        "CASE WHEN fc_subtype >= 0 THEN CAST(fc_subtype AS INTEGER) END AS wlan_subtype, CAST(wlan_duration AS INTEGER) AS wlan_duration, "
        "0.75::DOUBLE AS proba_anomaly, 'Deauth' AS predicted_label FROM frames"
    ),
)
def _to_packets(spark, sf_dir):
    rows = features(spark, sf_dir).selectExpr(
        "*",
        "frame_number as id",
        f"timestamp '{AS_OF}' as ts",
        "'wlan0' as iface",
        "string(null) as sa",
        "string(null) as da",
        "string(null) as bssid",
        "'{}' as raw",
        "named_struct('is_attack', true, 'label', 'Deauth', 'p1', 0.75D, 'p2', double('NaN'), 'stage', 2) as verdict",
    )
    return packets.to_packets(rows).drop(
        "ts", "iface", "src_mac", "dst_mac", "bssid", "raw", "proba_attack"
    )


@query(
    "purge_rewrite",
    with_detections(f"SELECT id, {stamp_sql()} AS ts, predicted_label FROM detections WHERE NOT sim"),
)
def _purge(spark, sf_dir):
    path = work_dir(spark, "packets")
    packets.write_packets(detections(spark, sf_dir), path)
    stored = packets.read_packets(spark, path)
    kept = maintenance.rewrite(stored, maintenance.purge_condition("simulated"), work_dir(spark, "purged"))
    return kept.select("id", stamp().alias("ts"), "predicted_label")


@query(
    "label_spellings",
    f"WITH {FRAME_KEYS} SELECT CASE label WHEN 1 THEN 'deauth' WHEN 7 THEN 'Evil_Twin' WHEN 8 THEN 'SDDP' ELSE 'Normal' END AS raw_label, "
    "count(*) AS rows, NULL::BIGINT AS unknown FROM f0 GROUP BY 1",
)
def _spellings(spark, sf_dir):
    """Raw spellings of a capture and their rows, known ones included."""
    rows = capture.read_capture_csv(spark, capture_files(spark, sf_dir))
    known = rows.groupBy("raw_label").agg(F.count(F.lit(1)).alias("rows"))
    unknown = dataset.unknown_labels(rows).withColumnRenamed("count", "unknown")
    return known.join(unknown, "raw_label", "left")
