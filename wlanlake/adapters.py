"""Deterministic projections of the given tables onto the engine's own schemas."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions.labels import label_id, normalise_label
from wlanlake.operators.frames import derive_frame_features
from wlanlake.session import prepare, spread

AS_OF = "2024-01-31 00:00:00"
# The access points of the origin estimate.
ACCESS_POINTS = [
    ("aa:aa:aa:aa:aa:01", "AP-1", 24.7136, 46.6753),
    ("aa:aa:aa:aa:aa:02", "AP-2", 24.7139, 46.6758),
    ("aa:aa:aa:aa:aa:03", "AP-3", 24.7142, 46.6751),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned time stamp and ``k``, the number inside ``props``."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        "cast(ts as timestamp) as ts",
        "user_id",
        "event_type",
        "value",
        "cast(get_json_object(props, '$.k') as bigint) as k",
    )


SRC_MAC = (
    "if(event_id % 97 = 0, null, "
    "format_string('02:00:00:00:%02x:%02x', user_id div 256, user_id % 256))"
)
DST_MAC = "if(k % 3 = 0, 'ff:ff:ff:ff:ff:ff', format_string('02:00:00:01:00:%02x', k))"
BSSID = "format_string('aa:aa:aa:aa:aa:%02x', 1 + user_id % 5)"
FREQ = "if(event_id % 89 = 0, null, get(array(2412, 2437, 2462, 5180, 5240), int(k % 5)))"
LABEL = """case when k % 10 = 9 then 'Weird_Label' when k % 10 = 8 then 'Disas'
    when event_type = 'signup' then 'Deauth' when event_type = 'error' then 'Evil_Twin'
    when event_type = 'click' then 'SSDP' when event_type = 'view' then 'Krack'
    else '(Re)Assoc' end"""
RAW = """if(k % 10 = 0, concat('{"sim": true, "sim_batch": "b', k % 3, '"}'),
    concat('{"ssid": "net', k % 7, '"}'))"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as rows of the detections table."""
    return events(spark, sf_dir).selectExpr(
        "event_id as id",
        "ts",
        "if(user_id % 4 = 0, 'wlan0', 'wlan1') as iface",
        f"{SRC_MAC} as src_mac",
        f"{DST_MAC} as dst_mac",
        f"{BSSID} as bssid",
        "int(floor(value) + 24) as frame_len",
        f"{FREQ} as channel_freq",
        "1D + (event_id % 8) * 0.5D as datarate",
        "if(event_id % 83 = 0, null, double(-30 - event_id % 60)) as signal_dbm",
        "int(k % 4) as wlan_ds",
        "int(event_id % 3 = 0) as wlan_retry",
        "0 as wlan_type",
        "int(k % 13) as wlan_subtype",
        "if(event_id % 17 = 0, null, int(k * 7)) as wlan_duration",
        "double((event_id * 7) % 101) / 100 as proba_anomaly",
        "if(event_id % 79 = 0, null, double((event_id * 13) % 101) / 100) as proba_attack",
        f"{LABEL} as predicted_label",
        f"{RAW} as raw",
    )


def access_points(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACCESS_POINTS, "bssid string, name string, lat double, lng double")


EAPOL = "event_type = 'purchase' and k % 4 = 0"
# Cells as text; a column that is not listed is never carried.
RAW_CELLS = {
    "frame.len": "if(event_id % 11 = 0, null, string(int(floor(value) + 24)))",
    "frame.time_delta": "if(event_id % 2 = 0, null, string((k % 17) / 1000D))",
    "frame.time_epoch": "string(unix_micros(ts) / 1000000D)",
    "radiotap.length": "if(k % 2 = 0, '48', '56')",
    "radiotap.present.tsft": "if(k % 2 = 0, '1-0-0', '0-0-0')",
    "radiotap.mactime": "if(k % 7 = 0, string(event_id), null)",
    "radiotap.channel.freq": f"string({FREQ})",
    "radiotap.channel.flags.cck": "if(k % 5 < 3, '1', '0')",
    "radiotap.channel.flags.ofdm": "if(k % 5 < 3, '0', '1')",
    "radiotap.datarate": "if(event_id % 13 = 0, null, get(array('1.0', '5.5', '11.0', '54.0'), int(k % 4)))",
    "radiotap.dbm_antsignal": "concat('-', 30 + k % 40, '-', 31 + k % 40)",
    "wlan.fc.type": "if(event_id % 53 = 0, null, if(event_type in ('signup', 'error'), '0', '2'))",
    "wlan.fc.subtype": "case event_type when 'signup' then '12' when 'error' then '8' end",
    "wlan.fc.ds": "string(k % 4)",
    "wlan.fc.frag": "'0'",
    "wlan.fc.moredata": "if(k % 6 = 0, '1', '0')",
    "wlan.fc.protected": "if(event_id % 4 = 0, '1', '0')",
    "wlan.fc.pwrmgt": "if(k % 5 = 0, '1', '0')",
    "wlan.fc.retry": "if(event_id % 3 = 0, '1', '0')",
    "wlan.duration": "if(event_id % 17 = 0, null, if(k % 9 = 0, format_string('0x%x', k * 7), string((k * 7) % 400)))",
    "wlan.seq": "if(event_id % 7 = 0, null, string((event_id * 37) % 4096))",
    "wlan.fixed.reason_code": "if(event_type = 'signup', string(k), null)",
    "wlan.fixed.beacon": "if(event_type = 'error', '100', null)",
    "wlan.fixed.capabilities.ess": "if(event_type = 'error', '1', null)",
    "wlan.ssid": "if(event_type = 'error', if(k % 7 = 3, ' ', concat(' net', k)), null)",
    "wlan.tag.length": "concat('0-8-', k)",
    "wlan.country_info.code": "if(k % 6 = 0, 'SA', null)",
    "wlan.rsn.capabilities.mfpc": "if(k % 8 = 0, '1', '0')",
    "wlan.rsn.ie.pmkid": "if(k % 16 = 0, 'ab12', '?')",
    "wlan_rsna_eapol.keydes.msgnr": f"if({EAPOL}, string(1 + k % 3), null)",
    "eapol.type": f"if({EAPOL}, '3', null)",
    "eapol.len": f"if({EAPOL}, '95,117', null)",
    "eapol.keydes.key_len": f"if({EAPOL}, '16', null)",
    "eapol.keydes.replay_counter": f"if({EAPOL}, string(k), null)",
    "wlan_radio.signal_dbm": "if(event_id % 3 = 0, concat('-', 30 + k % 40), null)",
    "wlan_radio.data_rate": "'6.0'",
    "wlan.sa": SRC_MAC,
    "wlan.da": f"upper({DST_MAC})",
    "wlan.ta": f"if(k % 2 = 0, {SRC_MAC}, {BSSID})",
    "wlan.bssid": f"if(event_id % 5 = 0, null, {BSSID})",
    "Label": "case event_type when 'signup' then 'deauth' when 'error' then 'Evil_Twin' "
    "when 'purchase' then 'SDDP' else 'Normal' end",
}
SESSION = "get(array('Deauth', 'SSDP', 'Evil_Twin', 'Krack'), int(user_id % 4))"


def raw_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events seen as raw capture records: every cell is text, absent means NULL."""
    return spread(events(spark, sf_dir), "event_id").selectExpr(
        f"{SESSION} as session_id",
        f"format_string('%s:%04d', {SESSION}, user_id % 16) as block_id",
        "event_id as frame_number",
        *[
            f"cast({RAW_CELLS.get(c, 'null')} as string) as {spec.flat(c)}"
            for c in spec.SOURCE_COLUMNS
        ],
    )


def labelled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records with the class id; rows with an unknown label are dropped."""
    raw = raw_frames(spark, sf_dir)
    return raw.withColumn("label", label_id(normalise_label("raw_label"))).filter(
        F.col("label").isNotNull()
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_frame_features(labelled_frames(spark, sf_dir))
