"""Row listings: newest first, by confidence, paged, merged and deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from wlanlake.functions import radio
from wlanlake.functions.labels import attack_type, severity
from wlanlake.functions.payload import is_simulated, raw_field
from wlanlake.functions.util import strip

PAGE_ROWS = 25


def list_detections(df: DataFrame, limit: int = 5000, offset: int = 0) -> DataFrame:
    """Newest rows first, one page of them."""
    if not 1 <= limit <= 100000 or offset < 0:
        raise ValueError("limit must be 1..100000 and offset not negative")
    return df.orderBy(F.desc("id")).offset(offset).limit(limit)


def detections_before(df: DataFrame, id: int | None = None, limit: int = 5000) -> DataFrame:
    """The next page of the newest-first list behind the row ``id``; no rows are read only to be passed over."""
    return (df if id is None else df.filter(F.col("id") < id)).orderBy(F.desc("id")).limit(limit)


def rows_after(df: DataFrame, last_id: int, *, sim_only: bool = False, limit: int = 500) -> DataFrame:
    """The next rows after an id. The limit counts rows before the simulated ones are picked."""
    rows = df.filter(F.col("id") > last_id).orderBy("id").limit(limit)
    return rows.filter(is_simulated("raw")) if sim_only else rows


THREAT_ORDERS = {
    "newest": lambda: [F.desc("ts"), F.desc("id")],
    "oldest": lambda: [F.asc("ts"), F.asc("id")],
    "confidence": lambda: [F.desc_nulls_last("proba_attack"), F.desc("id")],
}


def query_threats(df: DataFrame, order: str = "newest", limit: int = 50) -> DataFrame:
    """Detections in one of three orders, with the payload's network name and simulated flag."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1..200")
    rows = df.orderBy(*THREAT_ORDERS[order]()).limit(limit)
    return rows.withColumns({"ssid": raw_field("raw", "ssid"), "sim": is_simulated("raw")}).drop("raw")


def query_threats_report(df: DataFrame, order: str = "newest", limit: int = 50) -> DataFrame:
    """Row count of a threat query and whether the limit cut it."""
    rows = query_threats(df, order, limit)
    n = F.count(F.lit(1))
    return rows.agg(n.alias("row_count"), (n >= limit).alias("truncated"))


def _text(c: str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def _fraction(c: str) -> Column:
    value = F.col(c).try_cast("double")
    return F.when(value.between(0, 1), value)


def detection_view(df: DataFrame) -> DataFrame:
    """Rows as the screens show them: impossible readings and blank texts become NULL."""
    kind = attack_type("predicted_label")
    signal = F.col("signal_dbm").try_cast("double")
    return df.select(
        F.col("id").cast("string").alias("id"),
        "ts",
        kind.alias("type"),
        _text("predicted_label").alias("raw_label"),
        severity(kind).alias("severity"),
        *[_text(c).alias(c) for c in ("src_mac", "dst_mac", "bssid", "iface")],
        F.nullif(strip(raw_field("raw", "ssid")), F.lit("")).alias("ssid"),
        radio.freq_to_channel_ui("channel_freq").alias("channel"),
        F.col("channel_freq").cast("double").alias("freq"),
        F.when(signal.between(-110, 0), F.floor(signal + 0.5).cast("int")).alias("rssi"),
        F.col("frame_len").cast("double").alias("frame_len"),
        F.col("datarate").cast("double").alias("data_rate"),
        F.col("wlan_type").cast("double").alias("wlan_type"),
        F.col("wlan_subtype").cast("double").alias("wlan_subtype"),
        (F.col("wlan_retry") == 1).alias("retry"),
        _fraction("proba_attack").alias("confidence"),
        _fraction("proba_anomaly").alias("anomaly"),
        is_simulated("raw").alias("sim"),
    )


LEDGER_SORTS = {"time": "ts", "confidence": "confidence", "channel": "channel", "rssi": "rssi"}


def ledger_order(column: str = "time", descending: bool = True) -> list[Column]:
    """Absent values last in both directions, ties newest first, then by id."""
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in _ledger_keys(column, descending)]


def _ledger_keys(column: str, descending: bool) -> list[tuple[Column, bool]]:
    """The sort columns, and whether each falls."""
    return [(F.col(LEDGER_SORTS[column]), descending), (F.col("ts"), True), (F.col("id").cast("long"), False)]


def _behind(keys: list[tuple[Column, bool]], last: list) -> Column:
    """Rows that come after the one with the sort values ``last``, absent values last."""
    behind, same = F.lit(False), F.lit(True)
    for (key, down), value in zip(keys, last):
        if value is None:
            further, equal = F.lit(False), key.isNull()
        else:
            further = key.isNull() | (key < F.lit(value) if down else key > F.lit(value))
            equal = key.isNotNull() & (key == F.lit(value))
        behind, same = behind | (same & further), same & equal
    return behind


def ledger_after(
    view: DataFrame, last: Row | None, column: str = "time", descending: bool = True, rows: int = PAGE_ROWS
) -> DataFrame:
    """The page of a sorted view behind the row ``last``, which ended the page before; the first page without it.

    A comparison with the row's sort values stands in for an offset, so every page costs what the first
    one does: a task keeps as many rows as the page has. Ids tell all rows apart.
    """
    if last is not None:
        values = [last[LEDGER_SORTS[column]], last["ts"], None if last["id"] is None else int(last["id"])]
        view = view.filter(_behind(_ledger_keys(column, descending), values))
    return view.orderBy(*ledger_order(column, descending)).limit(rows)


def ledger_page(view: DataFrame, page: int, order: list[Column], rows: int = PAGE_ROWS) -> DataFrame:
    """One page of a sorted view; a page past the end is the last one.

    Clamping needs the row count, which is one aggregate over the same filter.
    """
    pages = max(1, -(-view.count() // rows))
    current = min(max(page, 1), pages)
    return view.orderBy(*order).offset((current - 1) * rows).limit(rows)


def dedupe_latest(df: DataFrame, key: str = "id", arrival: str = "arrival") -> DataFrame:
    """One row per key, the latest arrival; a missing arrival is earlier than any. Of rows that arrived at
    once the one of the greatest values counts, column by column, so the order of rows decides nothing.

    An aggregate rather than a window: copies of one row are combined before the shuffle,
    so a row with very many copies is no hot task.
    """
    rest = [c for c in df.columns if c != key]
    latest = F.struct(F.col(arrival).isNotNull().alias("known"), F.col(arrival).alias("at"), F.struct(*rest).alias("row"))
    kept = df.groupBy(key).agg(F.max(latest)["row"].alias("_row"))
    return kept.select(key, "_row.*").select(*df.columns)


def merge_tape(stream: DataFrame, poll: DataFrame, rows: int) -> DataFrame:
    """Streamed and polled rows as one list: the streamed copy wins, newest rows first.

    Both inputs have ``id``, ``ts`` and the same further columns.
    """
    both = stream.withColumn("_priority", F.lit(1)).unionByName(poll.withColumn("_priority", F.lit(0)))
    merged = dedupe_latest(both.filter("id is not null and cast(id as string) != ''"), "id", "_priority")
    return merged.drop("_priority").orderBy(F.desc_nulls_last("ts"), F.asc("id")).limit(rows)
