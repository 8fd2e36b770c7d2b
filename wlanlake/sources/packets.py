"""The detections table: reading, normalising, writing, ad-hoc SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions.payload import RAW_SCHEMA
from wlanlake.functions.timeparts import api_time

PACKET_SCHEMA = (
    "id bigint, ts timestamp, iface string, src_mac string, dst_mac string, bssid string, "
    "frame_len int, channel_freq int, datarate double, signal_dbm double, wlan_ds int, "
    "wlan_retry int, wlan_type int, wlan_subtype int, wlan_duration int, "
    "proba_anomaly double, proba_attack double, predicted_label string, raw string"
)


def normalise_packets(df: DataFrame) -> DataFrame:
    """Payload text to a struct, time text to an instant; what cannot be read becomes NULL."""
    ts = F.col("ts") if dict(df.dtypes)["ts"] == "timestamp" else api_time("ts")
    return df.withColumns({"ts": ts, "raw": F.from_json("raw", RAW_SCHEMA, {"mode": "PERMISSIVE"})})


def _as_double(c: Column) -> Column:
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def _as_int(c: Column) -> Column:
    """Whole number, halves to even."""
    return F.bround(_as_double(c)).cast("int")


def to_packets(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Scored frames -> rows of the detections table.

    ``df`` has features and raw cells under flat names, ``id``, ``ts``, ``iface``, ``sa``,
    ``da``, ``bssid``, ``raw`` and the verdict. Of the names a column is known by, the
    first that holds a value wins; the -1 of a missing type is absent again.
    """

    def found(column: str) -> Column:
        names = [spec.flat(a) for a in spec.PACKET_ALIASES[column] if spec.flat(a) in df.columns]
        value = F.coalesce(*[_as_double(F.col(n)) for n in names]) if names else F.lit(None)
        if column in ("wlan_type", "wlan_subtype"):
            value = F.when(value >= 0, value)
        return value

    return df.select(
        "id",
        "ts",
        "iface",
        F.col("sa").alias("src_mac"),
        F.col("da").alias("dst_mac"),
        "bssid",
        _as_int(found("frame_len")).alias("frame_len"),
        _as_int(found("channel_freq")).alias("channel_freq"),
        found("datarate").cast("double").alias("datarate"),
        found("signal_dbm").cast("double").alias("signal_dbm"),
        *[
            _as_int(found(c)).alias(c)
            for c in ("wlan_ds", "wlan_retry", "wlan_type", "wlan_subtype", "wlan_duration")
        ],
        _as_double(F.col(f"{verdict}.p1")).alias("proba_anomaly"),
        _as_double(F.col(f"{verdict}.p2")).alias("proba_attack"),
        F.col(f"{verdict}.label").alias("predicted_label"),
        "raw",
    )


def read_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKET_SCHEMA).parquet(path)


def write_packets(df: DataFrame, path: str) -> None:
    """Append by day, sorted by time inside each file so that time filters skip row groups."""
    (
        df.withColumn("day", F.to_date("ts"))
        .sortWithinPartitions("day", "ts")
        .write.mode("append")
        .partitionBy("day")
        .parquet(path)
    )


def run_sql(spark: SparkSession, packets: DataFrame, sql: str, max_rows: int | None = None) -> DataFrame:
    """One SELECT over the view ``packets``; with ``max_rows``, a statement without its own LIMIT gets that one."""
    statement = sql.strip().rstrip(";")
    if not re.match(r"(?is)^\s*(select|with)\b", statement):
        raise ValueError("only SELECT statements are allowed")
    packets.createOrReplaceTempView("packets")
    rows = spark.sql(statement)
    own = re.search(r"(?is)\blimit\s+(all|\d+)(\s+offset\s+\d+)?\s*$", statement)
    return rows if max_rows is None or own else rows.limit(max_rows)
