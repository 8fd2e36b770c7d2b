"""Parts shared by the checks: the adapters once more, as plain SQL, and output formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wlanlake.adapters import AS_OF

EVENTS = (
    "e AS (SELECT event_id, ts, user_id, event_type, value, "
    "CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
)
SRC = (
    "CASE WHEN event_id % 97 = 0 THEN NULL ELSE "
    "printf('02:00:00:00:%02x:%02x', user_id // 256, user_id % 256) END"
)
DST = "CASE WHEN k % 3 = 0 THEN 'ff:ff:ff:ff:ff:ff' ELSE printf('02:00:00:01:00:%02x', k) END"
BSS = "printf('aa:aa:aa:aa:aa:%02x', 1 + user_id % 5)"
FREQ = "CASE WHEN event_id % 89 = 0 THEN NULL ELSE [2412, 2437, 2462, 5180, 5240][CAST(k % 5 + 1 AS BIGINT)] END"
DETECTIONS = f"""{EVENTS}, detections AS (SELECT event_id AS id, ts,
  CASE WHEN user_id % 4 = 0 THEN 'wlan0' ELSE 'wlan1' END AS iface,
  {SRC} AS src_mac, {DST} AS dst_mac, {BSS} AS bssid,
  CAST(floor(value) + 24 AS INTEGER) AS frame_len, {FREQ} AS channel_freq,
  1.0::DOUBLE + (event_id % 8) * 0.5::DOUBLE AS datarate,
  CASE WHEN event_id % 83 = 0 THEN NULL ELSE CAST(-30 - event_id % 60 AS DOUBLE) END AS signal_dbm,
  k % 4 AS wlan_ds, CAST(event_id % 3 = 0 AS INTEGER) AS wlan_retry, 0 AS wlan_type, k % 13 AS wlan_subtype,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE k * 7 END AS wlan_duration,
  CAST((event_id * 7) % 101 AS DOUBLE) / 100 AS proba_anomaly,
  CASE WHEN event_id % 79 = 0 THEN NULL ELSE CAST((event_id * 13) % 101 AS DOUBLE) / 100 END AS proba_attack,
  CASE WHEN k % 10 = 9 THEN 'Weird_Label' WHEN k % 10 = 8 THEN 'Disas' WHEN event_type = 'signup' THEN 'Deauth'
    WHEN event_type = 'error' THEN 'Evil_Twin' WHEN event_type = 'click' THEN 'SSDP'
    WHEN event_type = 'view' THEN 'Krack' ELSE '(Re)Assoc' END AS predicted_label,
  k % 10 = 0 AS sim, CASE WHEN k % 10 = 0 THEN 'b' || (k % 3) END AS sim_batch,
  CASE WHEN k % 10 = 0 THEN NULL ELSE 'net' || (k % 7) END AS ssid
  FROM e)"""
FRONT = """CASE predicted_label WHEN 'Deauth' THEN 'deauth' WHEN 'Disas' THEN 'disas'
  WHEN '(Re)Assoc' THEN 'reassoc' WHEN 'Krack' THEN 'krack' WHEN 'Evil_Twin' THEN 'evil_twin'
  WHEN 'SSDP' THEN 'ssdp' ELSE 'other' END"""
SEVERITY = """CASE predicted_label WHEN 'Evil_Twin' THEN 'critical' WHEN 'Krack' THEN 'critical'
  WHEN 'Deauth' THEN 'high' WHEN 'Disas' THEN 'high' ELSE 'info' END"""
NOW = f"TIMESTAMP '{AS_OF}'"
CLASSES_SQL = (
    "classes(pos, label) AS (VALUES (0, 'Deauth'), (1, 'Disas'), (2, '(Re)Assoc'), (3, 'RogueAP'), "
    "(4, 'Krack'), (5, 'Kr00k'), (6, 'Evil_Twin'), (7, 'SSDP'))"
)
APS_SQL = (
    "aps(bssid, name, lat, lng) AS (VALUES "
    "('aa:aa:aa:aa:aa:01', 'AP-1', 24.7136::DOUBLE, 46.6753::DOUBLE), "
    "('aa:aa:aa:aa:aa:02', 'AP-2', 24.7139::DOUBLE, 46.6758::DOUBLE), "
    "('aa:aa:aa:aa:aa:03', 'AP-3', 24.7142::DOUBLE, 46.6751::DOUBLE))"
)


def stamp(c: str = "ts") -> Column:
    """A time as text with microseconds, the same in every engine."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def stamp_sql(c: str = "ts") -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def with_detections(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([DETECTIONS, *ctes]) + " " + body


def local_sql(zone: str, c: str = "ts") -> str:
    """Wall clock of a zone, from a time stored in UTC."""
    return f"timezone('{zone}', timezone('UTC', {c}))"


# What the 46 features must be, said directly over the events table.
_EAPOL = "event_type = 'purchase' AND k % 4 = 0"
_FRAME_SQL = {
    "radio_freq_mhz": FREQ,
    "radio_is_5ghz": f"CASE WHEN {FREQ} >= 5000 THEN 1 ELSE 0 END",
    "radio_cck": "CASE WHEN k % 5 < 3 THEN 1 ELSE 0 END",
    "radio_ofdm": "CASE WHEN k % 5 < 3 THEN 0 ELSE 1 END",
    "radio_datarate": "CASE WHEN event_id % 13 = 0 THEN 6.0 ELSE [1.0, 5.5, 11.0, 54.0][CAST(k % 4 + 1 AS BIGINT)] END",
    "radio_signal_dbm": "-30 - k % 40",
    "radio_rt_len": "CASE WHEN k % 2 = 0 THEN 48 ELSE 56 END",
    "radio_has_tsft": "CASE WHEN k % 2 = 0 OR k % 7 = 0 THEN 1 ELSE 0 END",
    "radio_has_rate": "CASE WHEN event_id % 13 = 0 THEN 0 ELSE 1 END",
    "radio_has_signal": "1",
    "frame_len": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE floor(value) + 24 END",
    "frame_dt": "dt",
    "frame_dt_log": "ln(1 + dt)",
    "fc_type": "CASE WHEN event_id % 53 = 0 THEN -1 WHEN event_type IN ('signup', 'error') THEN 0 ELSE 2 END",
    "fc_subtype": "CASE event_type WHEN 'signup' THEN 12 WHEN 'error' THEN 8 ELSE -1 END",
    "fc_ds": "k % 4",
    "fc_retry": "CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END",
    "fc_protected": "CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END",
    "fc_pwrmgt": "CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END",
    "fc_moredata": "CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END",
    "fc_frag": "0",
    "fc_order": "0",
    "wlan_duration": "CASE WHEN event_id % 17 = 0 THEN NULL WHEN k % 9 = 0 THEN k * 7 ELSE (k * 7) % 400 END",
    "wlan_seq_delta": "CASE WHEN d < 2048 THEN d ELSE d - 4096 END",
    "addr_da_broadcast": "CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END",
    "addr_da_multicast": "CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END",
    "addr_sa_is_bssid": "0",
    "addr_sa_local_admin": "CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 END",
    "addr_ta_eq_sa": "CASE WHEN k % 2 = 0 AND event_id % 97 <> 0 THEN 1 ELSE 0 END",
    "addr_same_bssid_as_prev": "CASE WHEN bss = prev_bss THEN 1 ELSE 0 END",
    "mgmt_has_reason": "CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END",
    "mgmt_reason_code": "CASE WHEN event_type = 'signup' THEN k END",
    "mgmt_beacon_interval": "CASE WHEN event_type = 'error' THEN 100 END",
    "mgmt_cap_ess": "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END",
    "mgmt_cap_ibss": "0",
    "mgmt_ssid_len": "CASE WHEN event_type = 'error' AND k % 7 <> 3 THEN length('net' || k) END",
    "mgmt_tag_len": "8 + k",
    "rsn_mfpc": "CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END",
    "rsn_has_pmkid": "CASE WHEN k % 16 = 0 THEN 1 ELSE 0 END",
    "rsn_country_present": "CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END",
    "eapol_present": f"CASE WHEN {_EAPOL} THEN 1 ELSE 0 END",
    "eapol_type": f"CASE WHEN {_EAPOL} THEN 3 END",
    "eapol_len": f"CASE WHEN {_EAPOL} THEN 95 END",
    "eapol_msgnr": f"CASE WHEN {_EAPOL} THEN 1 + k % 3 END",
    "eapol_key_len": f"CASE WHEN {_EAPOL} THEN 16 END",
    "eapol_replay_counter": f"CASE WHEN {_EAPOL} THEN k END",
}
_SESSION = "['Deauth', 'SSDP', 'Evil_Twin', 'Krack'][CAST(user_id % 4 + 1 AS BIGINT)]"
_BLOCK_ORDER = "PARTITION BY block_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
FRAME_KEYS = f"""{EVENTS}, f0 AS (SELECT *, {_SESSION} AS session_id, {_SESSION} || ':' || printf('%04d', user_id % 16) AS block_id,
  CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 7 WHEN 'purchase' THEN 8 ELSE 0 END AS label,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id * 37) % 4096 END AS seq,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE {BSS} END AS bss,
  CASE WHEN event_id % 2 = 1 THEN (k % 17)::DOUBLE / 1000 END AS delta,
  CASE WHEN event_id % 2 = 0 THEN epoch_us(ts)::DOUBLE / 1000000 END AS epoch FROM e)"""
FRAMES = f"""{FRAME_KEYS},
f1 AS (SELECT *, ((seq - last_value(seq IGNORE NULLS) OVER w) % 4096 + 4096) % 4096 AS d,
  last_value(bss IGNORE NULLS) OVER w AS prev_bss,
  coalesce(delta, greatest(0, epoch - last_value(epoch IGNORE NULLS) OVER w)) AS dt0,
  last_value(epoch IGNORE NULLS) OVER w AS prev_epoch FROM f0 WINDOW w AS ({_BLOCK_ORDER})),
f2 AS (SELECT *, CASE WHEN delta IS NULL AND prev_epoch IS NULL THEN NULL ELSE dt0 END AS dt FROM f1),
frames AS (SELECT session_id, block_id, event_id AS frame_number, label, """ + ", ".join(
    f"CAST({sql} AS FLOAT) AS {name}" for name, sql in _FRAME_SQL.items()
) + " FROM f2)"


def with_frames(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([FRAMES, *ctes]) + " " + body


def rounded_sql(columns, digits: int = 4) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in columns)


def rounded(columns, digits: int = 4) -> list[str]:
    return [f"round(double({c}), {digits}) as {c}" for c in columns]
