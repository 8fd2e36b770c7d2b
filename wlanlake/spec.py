"""Names, orders and lookup tables every operator shares.

The tables below are fixed values: the class list, the feature list, the alias
tables and the physical constants have to equal those of the data this engine
reads, so they are stated plainly and in their natural order.
"""

from __future__ import annotations

# Classes. The position of a class is its label id.
CLASSES = ["Normal", "Deauth", "Disas", "(Re)Assoc", "RogueAP", "Krack", "Kr00k", "Evil_Twin", "SSDP"]
ATTACK_CLASSES = CLASSES[1:]
LABEL_ID = {name: i for i, name in enumerate(CLASSES)}

# Spellings found in the Label column, folded to lower case.
LABEL_ALIASES = {
    "sddp": "SSDP", "ssdp": "SSDP",
    "kr00k": "Kr00k", "krook": "Kr00k",
    "krack": "Krack",
    "deauth": "Deauth",
    "disas": "Disas",
    "(re)assoc": "(Re)Assoc", "re)assoc": "(Re)Assoc", "reassoc": "(Re)Assoc",
    "rogueap": "RogueAP", "rogue_ap": "RogueAP",
    "evil_twin": "Evil_Twin", "eviltwin": "Evil_Twin",
    "normal": "Normal",
}

# Front keys in display order, then in severity order.
FRONT_TYPES = ["deauth", "ssdp", "evil_twin", "reassoc", "rogueap", "krack", "disas", "kr00k"]
UI_TYPES = ["evil_twin", "krack", "kr00k", "rogueap", "deauth", "disas", "reassoc", "ssdp", "other"]
FRONT_KEY_OF = {
    "Deauth": "deauth", "Disas": "disas", "(Re)Assoc": "reassoc", "RogueAP": "rogueap",
    "Krack": "krack", "Kr00k": "kr00k", "Evil_Twin": "evil_twin", "SSDP": "ssdp",
}
SEVERITY_OF = {
    "evil_twin": "critical", "krack": "critical", "kr00k": "critical",
    "rogueap": "high", "deauth": "high", "disas": "high",
    "reassoc": "info", "ssdp": "info", "other": "info",
}
SEVERITIES = ["critical", "high", "info"]

# Squashed label -> UI type, where the squash is not already a type.
UI_ALIASES = {
    "eviltwin": "evil_twin", "twin": "evil_twin", "rogue": "rogueap",
    "reassociation": "reassoc", "assoc": "reassoc",
    "disassoc": "disas", "disassociation": "disas", "deauthentication": "deauth",
}

# Free-text wording -> front key.
PHRASE_ALIASES = {
    "deauthentication": "deauth", "deauthentication flood": "deauth", "deauth flood": "deauth",
    "disassociation": "disas", "disassociation flood": "disas", "disassoc": "disas",
    "association flood": "reassoc", "reassociation": "reassoc", "reassociation flood": "reassoc",
    "re assoc": "reassoc",
    "evil twin": "evil_twin", "eviltwin": "evil_twin", "fake access point": "evil_twin",
    "ssid impersonation": "evil_twin",
    "rogue ap": "rogueap", "rogue access point": "rogueap", "unauthorised ap": "rogueap",
    "unauthorized ap": "rogueap",
    "key reinstallation": "krack", "key reinstallation attack": "krack", "krack attack": "krack",
    "kr00k attack": "kr00k", "krook": "kr00k", "cve 2019 15126": "kr00k", "cve201915126": "kr00k",
    "all zero tk": "kr00k",
    "amplification": "ssdp", "reflection": "ssdp", "upnp": "ssdp",
}

# Week order of the heatmap, Sunday first.
DAYS_SUN_FIRST = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]

# Raw capture columns (tshark field names).
SOURCE_COLUMNS = [
    "frame.len", "frame.time_delta", "frame.time_epoch",
    "radiotap.length", "radiotap.present.tsft", "radiotap.mactime", "radiotap.rxflags",
    "radiotap.channel.freq", "radiotap.channel.flags.cck", "radiotap.channel.flags.ofdm",
    "radiotap.datarate", "radiotap.dbm_antsignal",
    "wlan.fc.type", "wlan.fc.subtype", "wlan.fc.ds", "wlan.fc.frag", "wlan.fc.order",
    "wlan.fc.moredata", "wlan.fc.protected", "wlan.fc.pwrmgt", "wlan.fc.retry",
    "wlan.duration", "wlan.seq", "wlan.fcs.bad_checksum",
    "wlan.fixed.reason_code", "wlan.fixed.beacon",
    "wlan.fixed.capabilities.ess", "wlan.fixed.capabilities.ibss",
    "wlan.ssid", "wlan.tag.length", "wlan.country_info.code",
    "wlan.rsn.capabilities.mfpc", "wlan.rsn.ie.pmkid",
    "wlan_rsna_eapol.keydes.msgnr", "wlan_rsna_eapol.keydes.data_len",
    "wlan_rsna_eapol.keydes.key_info.key_mic", "wlan_rsna_eapol.keydes.nonce",
    "eapol.type", "eapol.len", "eapol.keydes.key_len", "eapol.keydes.replay_counter",
    "wlan_radio.signal_dbm", "wlan_radio.data_rate", "wlan_radio.phy",
    "wlan.sa", "wlan.da", "wlan.bssid", "wlan.ta",
    "Label",
]

# The 46 frame features in model order.
FEATURES = [
    "radio.freq_mhz", "radio.is_5ghz", "radio.cck", "radio.ofdm",
    "radio.datarate", "radio.signal_dbm", "radio.rt_len",
    "radio.has_tsft", "radio.has_rate", "radio.has_signal",
    "frame.len", "frame.dt", "frame.dt_log",
    "fc.type", "fc.subtype", "fc.ds", "fc.retry", "fc.protected", "fc.pwrmgt",
    "fc.moredata", "fc.frag", "fc.order", "wlan.duration", "wlan.seq_delta",
    "addr.da_broadcast", "addr.da_multicast", "addr.sa_is_bssid",
    "addr.sa_local_admin", "addr.ta_eq_sa", "addr.same_bssid_as_prev",
    "mgmt.has_reason", "mgmt.reason_code", "mgmt.beacon_interval",
    "mgmt.cap_ess", "mgmt.cap_ibss", "mgmt.ssid_len", "mgmt.tag_len",
    "rsn.mfpc", "rsn.has_pmkid", "rsn.country_present",
    "eapol.present", "eapol.type", "eapol.len", "eapol.msgnr",
    "eapol.key_len", "eapol.replay_counter",
]

# Columns that get rolling aggregates, and the two windows.
ROLL_MEAN_STD = [
    "frame.len", "frame.dt_log", "radio.signal_dbm",
    "wlan.duration", "wlan.seq_delta", "radio.datarate",
]
ROLL_RATE = [
    "mgmt.has_reason", "fc.retry", "addr.da_broadcast",
    "eapol.present", "fc.protected", "addr.da_multicast",
]
ROLL_WINDOWS = [16, 64]

# Columns that must never become a feature, with the reason.
BANNED_COLUMNS = {
    "frame.number": "capture index", "frame.time": "capture clock",
    "frame.time_epoch": "capture clock", "frame.time_relative": "seconds since capture start",
    "radiotap.mactime": "radio counter", "wlan_radio.start_tsf": "radio counter",
    "wlan_radio.end_tsf": "radio counter", "wlan_radio.timestamp": "radio counter",
    "wlan.fixed.timestamp": "access point uptime",
    "wlan.sa": "identity", "wlan.da": "identity", "wlan.ta": "identity", "wlan.ra": "identity",
    "wlan.bssid": "identity", "wlan.ssid": "identity",
    "ip.src": "needs decryption", "ip.dst": "needs decryption",
    "tcp.srcport": "needs decryption", "tcp.dstport": "needs decryption",
    "udp.srcport": "needs decryption", "udp.dstport": "needs decryption",
    "tcp.payload": "needs decryption", "udp.payload": "needs decryption",
    "data.data": "needs decryption",
}

# Capture folders whose attacks live above the link layer.
SKIP_FOLDERS = ["7.SSH", "8.Botnet", "9.Malware", "10.SQL_Injection", "13.Website_spoofing"]

# The columns of the detections table, in order.
PACKET_COLUMNS = [
    "id", "ts", "iface", "src_mac", "dst_mac", "bssid", "frame_len", "channel_freq", "datarate",
    "signal_dbm", "wlan_ds", "wlan_retry", "wlan_type", "wlan_subtype", "wlan_duration",
    "proba_anomaly", "proba_attack", "predicted_label", "raw",
]

# Where each detections column is looked up, first hit wins.
PACKET_ALIASES = {
    "frame_len": ["frame.len"],
    "channel_freq": ["radiotap.channel.freq", "radio.freq_mhz"],
    "datarate": ["radiotap.datarate", "radio.datarate"],
    "signal_dbm": ["wlan_radio.signal_dbm", "radio.signal_dbm"],
    "wlan_ds": ["wlan.fc.ds", "fc.ds"],
    "wlan_retry": ["wlan.fc.retry", "fc.retry"],
    "wlan_type": ["wlan.fc.type", "fc.type"],
    "wlan_subtype": ["wlan.fc.subtype", "fc.subtype"],
    "wlan_duration": ["wlan.duration"],
}

# Decision thresholds and limits.
STAGE1_THRESHOLD = 0.40
STAGE2_THRESHOLD = 0.80
MAX_DAYS = 3650
MAX_BUCKET_DAYS = {"hour": 31, "day": 366}


def roll_names(windows=ROLL_WINDOWS) -> list[str]:
    """Names of the rolling columns in model order."""
    out = []
    for w in windows:
        out += [f"roll{w}.{c}.mean" for c in ROLL_MEAN_STD]
        out += [f"roll{w}.{c}.std" for c in ROLL_MEAN_STD]
        out += [f"roll{w}.{c}.rate" for c in ROLL_RATE]
    return out


MODEL_COLUMNS = FEATURES + roll_names()


def flat(name: str) -> str:
    """Internal name of a dotted column: ``wlan.fc.ds`` -> ``wlan_fc_ds``.

    Dots would need back-quotes everywhere; they come back on export. No two columns
    differ only in dots, so this is one-to-one. ``Label`` is renamed because names are
    not case-sensitive and ``label`` is the class id.
    """
    return "raw_label" if name == "Label" else name.replace(".", "_")


FLAT_FEATURES = [flat(f) for f in FEATURES]
FLAT_MODEL_COLUMNS = [flat(f) for f in MODEL_COLUMNS]
