"""Where a source probably is: signal averages per access point and their weighted centre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wlanlake.functions.timeparts import since

FALLBACK_RSSI = -90.0


def source_rssi(
    df: DataFrame, as_of=None, *, minutes: int | None = None, src_mac: str | None = None
) -> DataFrame:
    """Average signal and frames per source and BSSID.

    An absent average, and one of exactly 0, counts as the fallback.
    """
    if minutes:
        df = df.filter(F.col("ts") >= since(as_of, minutes=minutes))
    if src_mac is not None:
        df = df.filter(F.col("src_mac") == src_mac)
    avg = F.avg("signal_dbm")
    return (
        df.filter((F.col("bssid") != "") & (F.col("src_mac") != ""))
        .groupBy("src_mac", "bssid")
        .agg(
            F.when(avg != 0, avg).otherwise(FALLBACK_RSSI).alias("avg_rssi"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def placed_aps(aps: DataFrame) -> DataFrame:
    """Inventory entries with a usable place."""
    return aps.select(
        "bssid",
        "name",
        F.col("lat").try_cast("double").alias("lat"),
        F.col("lng").try_cast("double").alias("lng"),
    ).filter("bssid != '' and lat is not null and lng is not null")


def _weight() -> Column:
    return 1.0 / F.greatest(F.lit(1.0), F.abs("avg_rssi") + 1.0)


def rssi_ap_join(rssi: DataFrame, aps: DataFrame) -> DataFrame:
    """Signal averages at access points of known place, with their weight.

    The inventory is not hinted: the planner broadcasts it when it is small enough.
    """
    return rssi.join(placed_aps(aps), "bssid").withColumn("weight", _weight())


def estimate_origin(
    df: DataFrame,
    aps: DataFrame,
    as_of=None,
    *,
    minutes: int | None = None,
    src_mac: str | None = None,
) -> DataFrame:
    """Weighted centre of the access points that heard each source; NULL when none is placed.

    The inventory has one row per BSSID when it is joined, so every signal average stays one
    row, and counts and centre come from the same pass.
    """
    sites = placed_aps(aps).groupBy("bssid").agg(
        F.count(F.lit(1)).alias("_aps"), F.sum("lat").alias("_lat"), F.sum("lng").alias("_lng")
    )
    heard = source_rssi(df, as_of, minutes=minutes, src_mac=src_mac).join(sites, "bssid", "left")
    total = F.sum(F.col("_aps") * _weight())
    return heard.groupBy("src_mac").agg(
        F.count(F.lit(1)).alias("points"),
        F.sum("n").alias("frames"),
        F.coalesce(F.sum("_aps"), F.lit(0)).cast("long").alias("used"),
        (F.sum(F.col("_lat") * _weight()) / total).alias("lat"),
        (F.sum(F.col("_lng") * _weight()) / total).alias("lng"),
    )
