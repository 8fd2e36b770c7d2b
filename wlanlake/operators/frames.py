"""The 46 per-frame features, derived from the raw capture record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions import cells
from wlanlake.operators.layout import carried, own_rows, tile_rows, tile_window

KEYS = ["session_id", "block_id", "frame_number"]
RAW_COLUMNS = [spec.flat(c) for c in spec.SOURCE_COLUMNS]


def _num(name: str) -> str:
    return cells.first_number(spec.flat(name), clean=True)


def _int(name: str) -> str:
    return cells.first_int(spec.flat(name), clean=True)


def _flag(name: str) -> str:
    return f"coalesce({_int(name)}, 0)"


def _present(*names: str) -> str:
    flags = [cells.present(spec.flat(n), clean=True) for n in names]
    return flags[0] if len(flags) == 1 else f"greatest({', '.join(flags)})"


def _true(condition: str) -> str:
    """0/1 of a condition; unknown counts as 0."""
    return f"if({condition}, 1, 0)"


def row_features() -> dict[str, str]:
    """SQL of the features that need no other row, keyed by their dotted names.

    Reads the stripped raw columns and the normalised addresses ``_sa``, ``_da``, ``_ta``, ``_bssid``.
    """
    ssid = "wlan_ssid"
    return {
        "radio.freq_mhz": _num("radiotap.channel.freq"),
        "radio.is_5ghz": _true(f"{_num('radiotap.channel.freq')} >= 5000"),
        "radio.cck": _flag("radiotap.channel.flags.cck"),
        "radio.ofdm": _flag("radiotap.channel.flags.ofdm"),
        "radio.datarate": f"coalesce({_num('radiotap.datarate')}, {_num('wlan_radio.data_rate')})",
        "radio.signal_dbm": f"coalesce({_num('wlan_radio.signal_dbm')}, {_num('radiotap.dbm_antsignal')})",
        "radio.rt_len": _num("radiotap.length"),
        "radio.has_tsft": _true(
            f"{_num('radiotap.present.tsft')} = 1 or {_present('radiotap.mactime')} = 1"
        ),
        "radio.has_rate": _present("radiotap.datarate"),
        "radio.has_signal": _present("wlan_radio.signal_dbm", "radiotap.dbm_antsignal"),
        "frame.len": _num("frame.len"),
        "fc.type": f"coalesce({_int('wlan.fc.type')}, -1)",
        "fc.subtype": f"coalesce({_int('wlan.fc.subtype')}, -1)",
        "fc.ds": _flag("wlan.fc.ds"),
        "fc.retry": _flag("wlan.fc.retry"),
        "fc.protected": _flag("wlan.fc.protected"),
        "fc.pwrmgt": _flag("wlan.fc.pwrmgt"),
        "fc.moredata": _flag("wlan.fc.moredata"),
        "fc.frag": _flag("wlan.fc.frag"),
        "fc.order": _flag("wlan.fc.order"),
        "wlan.duration": _num("wlan.duration"),
        "addr.da_broadcast": cells.mac_is_broadcast("_da"),
        "addr.da_multicast": cells.mac_is_group("_da"),
        "addr.sa_is_bssid": _true("_sa = _bssid"),
        "addr.sa_local_admin": cells.mac_is_local("_sa"),
        "addr.ta_eq_sa": _true("_ta = _sa"),
        "mgmt.has_reason": _true(f"{_int('wlan.fixed.reason_code')} is not null"),
        "mgmt.reason_code": _int("wlan.fixed.reason_code"),
        "mgmt.beacon_interval": _num("wlan.fixed.beacon"),
        "mgmt.cap_ess": _flag("wlan.fixed.capabilities.ess"),
        "mgmt.cap_ibss": _flag("wlan.fixed.capabilities.ibss"),
        "mgmt.ssid_len": f"if({cells.present(ssid, clean=True)} = 1, char_length({ssid}), null)",
        "mgmt.tag_len": cells.sum_number("wlan_tag_length", clean=True),
        "rsn.mfpc": _flag("wlan.rsn.capabilities.mfpc"),
        "rsn.has_pmkid": _present("wlan.rsn.ie.pmkid"),
        "rsn.country_present": _present("wlan.country_info.code"),
        "eapol.present": _true(f"{_int('eapol.type')} is not null or {_present('eapol.len')} = 1"),
        "eapol.type": _int("eapol.type"),
        "eapol.len": _num("eapol.len"),
        "eapol.msgnr": _int("wlan_rsna_eapol.keydes.msgnr"),
        "eapol.key_len": _num("eapol.keydes.key_len"),
        "eapol.replay_counter": _num("eapol.keydes.replay_counter"),
    }


# What one frame leaves behind for the next: a sequence number, a BSSID, a time stamp.
STATE = ["seq", "bssid", "epoch"]
STATE_TYPES = {"seq": "bigint", "bssid": "string", "epoch": "double"}
_ADDRESSES = ["sa", "da", "ta", "bssid"]
_SCRATCH = ["_seq", "_epoch", "_delta"] + [f"_{a}" for a in _ADDRESSES]


def with_row_features(df: DataFrame) -> DataFrame:
    """Raw records -> other columns, the features that need no other row, and what the delta
    features compare. Parsing comes before any shuffle, so only parsed numbers travel.

    A time stamp is only left behind by a frame that has no time delta of its own.
    """
    missing = [c for c in RAW_COLUMNS if c not in df.columns]
    if missing:
        df = df.selectExpr("*", *[f"cast(null as string) as {c}" for c in missing])
    keep = [c for c in df.columns if c not in RAW_COLUMNS]
    # Cells are stripped once, in a projection of their own, as each is looked at many times.
    stripped = df.selectExpr(
        *[f"`{c}`" for c in keep],
        *[f"{cells.strip(c)} as {c}" for c in RAW_COLUMNS],
        *[f"{cells.norm_mac(f'wlan_{a}')} as _{a}" for a in _ADDRESSES],
    )
    delta = _num("frame.time_delta")
    return stripped.selectExpr(
        *[f"`{c}`" for c in keep],
        *[f"cast({sql} as float) as {spec.flat(name)}" for name, sql in row_features().items()],
        f"{_int('wlan.seq')} as _seq",
        "_bssid",
        f"{delta} as _delta",
        f"if({delta} is null, {_num('frame.time_epoch')}, null) as _epoch",
    )


def carry_columns() -> dict:
    return {name: F.col(f"_{name}") for name in STATE}


def with_delta_features(laid: DataFrame, initial: bool = False) -> DataFrame:
    """The features that look back, on rows with a layout, in model order behind the others.

    The previous value is the last non-null one inside the tile, else the one carried to the
    tile, else (``initial``) the one the stream was left with.
    """
    w = tile_window().rowsBetween(Window.unboundedPreceding, -1)
    prev = laid.withColumns({f"_prev_{n}": F.last(f"_{n}", ignorenulls=True).over(w) for n in STATE})

    def before(name: str) -> str:
        start = f", _initial_{name}" if initial else ""
        return f"coalesce(_prev_{name}, {carried(name)}{start})"

    step = f"pmod(_seq - {before('seq')}, 4096)"
    made = {
        "wlan_seq_delta": f"if({step} < 2048, {step}, {step} - 4096)",
        "addr_same_bssid_as_prev": _true(f"_bssid = {before('bssid')}"),
        # if() and not greatest(), which would turn a missing gap into 0.
        "frame_dt": "_dt",
        "frame_dt_log": "log1p(if(_dt < 0, 0D, _dt))",
    }
    gap = f"_epoch - {before('epoch')}"
    prev = prev.selectExpr("*", f"coalesce(_delta, if({gap} < 0, 0D, {gap})) as _dt")
    keep = [
        c
        for c in laid.columns
        if c not in spec.FLAT_FEATURES and c not in _SCRATCH and not c.startswith("_initial_")
    ]
    return prev.selectExpr(
        *[f"`{c}`" for c in keep],
        *[f"cast({made[f]} as float) as {f}" if f in made else f for f in spec.FLAT_FEATURES],
    )


def derive_frame_features(df: DataFrame, **tiling) -> DataFrame:
    """Raw records -> keys, label (when present) and 46 features.

    ``df`` holds the raw columns under their flat names plus ``session_id``, ``block_id``
    and ``frame_number``. Rows to be dropped must be dropped before: the delta features
    look at the previous row that is there.
    """
    return finish_features(with_row_features(df), **tiling)


def finish_features(parsed: DataFrame, **tiling) -> DataFrame:
    """Rows of :func:`with_row_features` -> complete features.

    A separate step, so that a costly scan can be parsed once and stored in between.
    """
    return own_rows(with_delta_features(tile_rows(parsed, carry=carry_columns(), **tiling)))


def observed_times(df: DataFrame, ts: str = "epoch", **tiling) -> DataFrame:
    """Delta to the previous frame that had a time, and seconds since the stream began.

    Frames without a time get neither; the first timed frame gets 0 for both.
    """
    laid = tile_rows(df, carry={"ts": F.col(ts)}, **tiling)
    before = tile_window().rowsBetween(Window.unboundedPreceding, -1)
    timed = own_rows(
        laid.withColumn("_before", F.last(ts, ignorenulls=True).over(before)).selectExpr(
            "*", f"coalesce(_before, {carried('ts')}) as prev_ts"
        )
    ).drop("_before")
    start = (
        df.filter(F.col(ts).isNotNull())
        .groupBy("block_id")
        .agg(F.min_by(ts, "frame_number").alias("_begin"))
    )
    return (
        timed.join(start, "block_id", "left")
        .selectExpr(
            "*",
            f"if({ts} is null, null, coalesce(greatest(0D, {ts} - prev_ts), 0D)) as time_delta",
            f"if({ts} is null, null, greatest(0D, {ts} - _begin)) as time_relative",
        )
        .drop("prev_ts", "_begin")
    )


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Absent is NULL inside the engine: a NaN would spoil every aggregate it meets."""
    return df.withColumns({c: F.expr(f"if(isnan({c}), null, {c})") for c in columns})


def null_to_nan(df: DataFrame, columns: list[str]) -> DataFrame:
    """Absent is NaN on export."""
    return df.withColumns({c: F.expr(f"coalesce({c}, cast('NaN' as float))") for c in columns})


def with_dotted_names(df: DataFrame) -> DataFrame:
    """Give features their dotted names back, for export."""
    names = {spec.flat(c): c for c in spec.MODEL_COLUMNS}
    return df.withColumnsRenamed({f: d for f, d in names.items() if f in df.columns})
