"""Counts, shares, heatmaps, series and summaries over the detections table.

Everything groups first and joins the small zero-filled spine afterwards, so what crosses
the shuffle is one partial count per group and task, however hot a group is.
"""

from __future__ import annotations

from datetime import timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions.labels import attack_type, front_type, severity
from wlanlake.functions.timeparts import (
    as_of_utc,
    bucket_key,
    check_zone,
    day_index,
    day_name,
    local_time,
    ts_lit,
)
from wlanlake.operators.filters import filter_days


def _count() -> Column:
    return F.count(F.lit(1)).alias("count")


def spine(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A fixed, small list of rows as a local relation."""
    return spark.createDataFrame(values, schema)


def zero_fill(frame: DataFrame, counts: DataFrame, keys: list[str], value: str = "count") -> DataFrame:
    """Every row of the spine with its count, 0 where there was nothing to count.

    Counts outside the spine are dropped.
    """
    return frame.join(counts, keys, "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def _one_row_spine(spark: SparkSession, expression: str, name: str) -> DataFrame:
    return spark.range(1).select(F.expr(expression).alias(name))


# ---- counts ------------------------------------------------------------------------


def packets_count(df: DataFrame) -> DataFrame:
    return df.agg(_count())


def attack_analysis(df: DataFrame) -> DataFrame:
    """Count of every attack class, zero-filled; labels outside the class list are dropped."""
    counts = df.groupBy(F.col("predicted_label").alias("label")).agg(_count())
    classes = spine(
        df.sparkSession, [(i, c) for i, c in enumerate(spec.ATTACK_CLASSES)], "pos int, label string"
    )
    return zero_fill(classes, counts, ["label"]).orderBy("pos").select("label", "count")


def top_offenders(df: DataFrame, as_of=None, *, days: int | None = None, limit: int = 50) -> DataFrame:
    """Busiest source addresses, ties by address so that a limit means something."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1..500")
    rows = filter_days(df, as_of, days).filter(F.col("src_mac") != "")
    return (
        rows.groupBy(F.col("src_mac").alias("wlan_sa"))
        .agg(_count())
        .orderBy(F.desc("count"), F.asc("wlan_sa"))
        .limit(limit)
    )


def channel_usage(df: DataFrame, as_of=None, *, days: int | None = None) -> DataFrame:
    rows = filter_days(df, as_of, days).filter(F.col("channel_freq").isNotNull())
    return rows.groupBy("channel_freq").agg(_count()).orderBy(F.desc("count"), "channel_freq")


GROUP_COLUMNS = {
    "label": "predicted_label",
    "src_mac": "src_mac",
    "bssid": "bssid",
    "channel_freq": "channel_freq",
    "iface": "iface",
}


def aggregate_by(df: DataFrame, dimension: str, top_n: int = 20) -> DataFrame:
    """Counts by one dimension, largest first; absent values form a group of their own.

    Each row also tells the rows and groups there are in all, and whether groups were left out.
    """
    key = F.col(GROUP_COLUMNS[dimension]).cast("string").alias("key")
    groups = df.groupBy(key).agg(_count())
    # One row.
    whole = groups.agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("groups"))
    first = groups.orderBy(F.desc("count"), F.asc_nulls_last("key")).limit(top_n)
    return first.crossJoin(F.broadcast(whole)).withColumn("truncated", F.col("groups") > top_n)


def classes_without_detections(df: DataFrame) -> DataFrame:
    return attack_analysis(df).filter(F.col("count") == 0).select("label")


# ---- time --------------------------------------------------------------------------


def heatmap(df: DataFrame, as_of=None, *, days: int | None = None, zone: str = "UTC") -> DataFrame:
    """Counts by weekday (Sunday first) and hour in a zone, all 168 cells."""
    local = local_time("ts", zone)
    rows = filter_days(df, as_of, days).filter(F.col("ts").isNotNull())
    counts = rows.groupBy(day_index(local).alias("day_no"), F.hour(local).alias("hour")).agg(_count())
    grid = (
        _one_row_spine(df.sparkSession, "explode(sequence(0, 6))", "day_no")
        .select("day_no", F.expr("explode(sequence(0, 23))").alias("hour"))
    )
    return (
        zero_fill(grid, counts, ["day_no", "hour"])
        .orderBy("day_no", "hour")
        .select(day_name(F.col("day_no")).alias("day"), "hour", F.col("count").alias("intensity"))
    )


def heatmap_nested(grid: DataFrame) -> DataFrame:
    """The heatmap as seven rows of 24 cells."""
    cell = F.struct("hour", "intensity")
    return grid.groupBy("day").agg(F.sort_array(F.collect_list(cell)).alias("hours"))


def hour_of_day(df: DataFrame) -> DataFrame:
    counts = df.filter(F.col("ts").isNotNull()).groupBy(F.hour("ts").alias("key")).agg(_count())
    hours = _one_row_spine(df.sparkSession, "explode(sequence(0, 23))", "key")
    return zero_fill(hours, counts, ["key"]).orderBy("key").select("key", "count")


def day_of_week(df: DataFrame) -> DataFrame:
    index = day_index(F.col("ts")).alias("day_no")
    counts = df.filter(F.col("ts").isNotNull()).groupBy(index).agg(_count())
    days = _one_row_spine(df.sparkSession, "explode(sequence(0, 6))", "day_no")
    return (
        zero_fill(days, counts, ["day_no"])
        .orderBy("day_no")
        .select(day_name(F.col("day_no")).alias("key"), "count")
    )


def series_spine(spark: SparkSession, as_of, days: int, bucket: str, zone: str) -> DataFrame:
    """Every bucket of the window, in order.

    Days step over calendar dates, since a local day may have 23 or 25 hours. Hours are
    the distinct wall-clock hours of the window, so an hour the clocks repeat is one bucket.
    """
    here = ZoneInfo(check_zone(zone))
    now = as_of_utc(as_of).replace(tzinfo=timezone.utc).astimezone(here)
    if bucket == "day":
        first = now.date() - timedelta(days=days - 1)
        keys = [(first + timedelta(days=i)).isoformat() for i in range(days)]
    else:
        top = now.replace(minute=0, second=0, microsecond=0, tzinfo=None)
        hours = (top - timedelta(hours=h) for h in range(days * 24 - 1, -1, -1))
        keys = list(dict.fromkeys(h.strftime("%Y-%m-%dT%H") for h in hours))
    return spine(spark, [(k,) for k in keys], "bucket string")


def _bucket_counts(df, as_of, days, bucket, zone, label) -> DataFrame:
    if days > spec.MAX_BUCKET_DAYS[bucket]:
        raise ValueError(f"at most {spec.MAX_BUCKET_DAYS[bucket]} days per {bucket}")
    rows = filter_days(df, as_of, days).filter(F.col("ts").isNotNull())
    if label is not None:
        if label not in spec.ATTACK_CLASSES:
            raise ValueError(f"unknown attack class {label!r}")
        rows = rows.filter(F.col("predicted_label") == label)
    return rows.groupBy(bucket_key(local_time("ts", zone), bucket).alias("bucket")).agg(_count())


def attack_series(
    df: DataFrame, as_of, *, days: int = 7, bucket: str = "hour", zone: str = "UTC", label: str | None = None
) -> DataFrame:
    """Zero-filled counts per wall-clock hour or day of a zone."""
    counts = _bucket_counts(df, as_of, days, bucket, zone, label)
    frame = series_spine(df.sparkSession, as_of, days, bucket, zone)
    return zero_fill(frame, counts, ["bucket"]).orderBy("bucket")


def attack_series_totals(
    df: DataFrame, as_of, *, days: int = 7, bucket: str = "hour", zone: str = "UTC", label: str | None = None
) -> DataFrame:
    """Rows plotted, rows of the window that fall outside every bucket, first and last bucket."""
    counts = _bucket_counts(df, as_of, days, bucket, zone, label)
    frame = series_spine(df.sparkSession, as_of, days, bucket, zone).withColumn("plotted", F.lit(True))
    joined = frame.join(counts, "bucket", "full")
    n, plotted = F.coalesce("count", F.lit(0)), F.coalesce("plotted", F.lit(False))
    shown = F.when(plotted, F.col("bucket"))
    return joined.agg(
        F.coalesce(F.sum(F.when(plotted, n)), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum(F.when(~plotted, n)), F.lit(0)).cast("long").alias("outside_range"),
        F.min(shown).alias("start"),
        F.max(shown).alias("end"),
    )


def compare_previous(df: DataFrame, as_of, minutes: int) -> DataFrame:
    """This window against the equally long one before it, in one pass."""
    now = as_of_utc(as_of)
    start, earlier = ts_lit(now - timedelta(minutes=minutes)), ts_lit(now - timedelta(minutes=2 * minutes))
    ts = F.col("ts")
    current = F.count_if(ts >= start)
    previous = F.count_if((ts >= earlier) & (ts < start))
    return df.filter(ts >= earlier).agg(
        current.alias("current_total"),
        previous.alias("previous_total"),
        (current - previous).alias("change"),
    )


# ---- summaries ---------------------------------------------------------------------


def report_summary(df: DataFrame, as_of, *, days: int = 30) -> DataFrame:
    """Headline row: totals by front key, their sum, the commonest, peak hour, unique sources.

    Totals and peak hour come from one count per front key and hour, at most 225 rows.
    """
    rows = filter_days(df, as_of, days)
    cells = rows.groupBy(front_type("predicted_label").alias("type"), F.hour("ts").alias("hour")).agg(_count())
    by_type = cells.groupBy("type").agg(F.sum("count").alias("count"))
    frame = spine(
        df.sparkSession, [(i, t) for i, t in enumerate(spec.FRONT_TYPES + ["other"])], "pos int, type string"
    )
    # A front key's first place among equals is its display position.
    rank = F.struct(F.col("count"), -F.col("pos"))
    totals = zero_fill(frame, by_type, ["type"]).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "count")))).alias("totals"),
        F.sum("count").alias("total_attacks"),
        F.max_by("type", rank).alias("_most"),
    )
    by_hour = cells.groupBy("hour").agg(F.sum("count").alias("count"))
    # Rows without a time are told apart here and not by a filter, which would be pushed into
    # the scan and keep the counts above from being shared.
    first = F.when(F.col("hour").isNotNull(), F.struct(F.col("count"), -F.col("hour")))
    peak = by_hour.agg(F.coalesce(F.max_by("hour", first), F.lit(0)).alias("peak_hour"))
    sources = rows.agg(F.count_distinct("src_mac").alias("unique_sources"))
    most = F.when(F.col("total_attacks") > 0, F.col("_most")).otherwise("other")
    # Three single-row results side by side.
    return totals.crossJoin(peak).crossJoin(sources).select(
        F.lit(f"Last {days} day(s)").alias("period"),
        "totals",
        "total_attacks",
        most.alias("most_frequent_type"),
        "peak_hour",
        "unique_sources",
    )


def flat_summary(summary: DataFrame) -> DataFrame:
    """The headline row with one column per front key instead of a map."""
    keys = spec.FRONT_TYPES + ["other"]
    return summary.select("*", *[F.col("totals")[k].alias(f"n_{k}") for k in keys]).drop("totals")


def threat_overview(df: DataFrame, as_of, *, days: int = 30) -> DataFrame:
    """The report row, all-time counts per class, and the span of the stored rows."""
    stored = df.agg(
        F.count(F.lit(1)).alias("stored_all_time"),
        F.min("ts").alias("earliest_ts"),
        F.max("ts").alias("latest_ts"),
        *[
            F.count_if(F.col("predicted_label") == c).alias(f"all_time_{spec.FRONT_KEY_OF[c]}")
            for c in spec.ATTACK_CLASSES
        ],
    )
    return report_summary(df, as_of, days=days).crossJoin(stored)


def sensor_health(df: DataFrame) -> DataFrame:
    """Row count, latest time, and what the newest row was heard on."""
    newest = F.max_by(F.struct("iface", "channel_freq"), F.col("id"))
    return df.agg(
        F.count(F.lit(1)).alias("packets"), F.max("ts").alias("latest_ts"), newest.alias("newest")
    ).select(
        "packets",
        "latest_ts",
        F.col("newest.iface").alias("observed_iface"),
        F.col("newest.channel_freq").alias("observed_channel_freq"),
    )


def severity_totals(df: DataFrame) -> DataFrame:
    counts = df.groupBy(severity(attack_type("predicted_label")).alias("severity")).agg(_count())
    frame = spine(df.sparkSession, [(i, s) for i, s in enumerate(spec.SEVERITIES)], "pos int, severity string")
    return zero_fill(frame, counts, ["severity"]).orderBy("pos").select("severity", "count")


def class_share(df: DataFrame) -> DataFrame:
    """Ranked classes with their share; a class with nothing found is still listed, ``other`` is not."""
    counts = df.groupBy(attack_type("predicted_label").alias("type")).agg(_count())
    frame = spine(df.sparkSession, [(i, t) for i, t in enumerate(spec.UI_TYPES)], "pos int, type string")
    ranked = zero_fill(frame, counts, ["type"]).filter((F.col("type") != "other") | (F.col("count") > 0))
    total = ranked.agg(F.sum("count").alias("_total"))
    return (
        ranked.crossJoin(total)
        .orderBy(F.desc("count"), "pos")
        .select(
            "type",
            "count",
            F.when(F.col("_total") > 0, F.col("count") / F.col("_total")).otherwise(0.0).alias("share"),
        )
    )


def label_dimension(spark: SparkSession) -> DataFrame:
    """Class, front key and severity as a small table."""
    rows = [(c, k, spec.SEVERITY_OF[k]) for c, k in spec.FRONT_KEY_OF.items()]
    return spine(spark, rows, "predicted_label string, front_key string, severity string")


def with_label_dimension(df: DataFrame) -> DataFrame:
    """Left join with the class table (eight fixed rows); unknown classes become other/info."""
    return df.join(F.broadcast(label_dimension(df.sparkSession)), "predicted_label", "left").withColumns(
        {
            "front_key": F.coalesce("front_key", F.lit("other")),
            "severity": F.coalesce("severity", F.lit("info")),
        }
    )


def field_presence(df: DataFrame, fields=("ssid", "src_mac", "dst_mac", "bssid")) -> DataFrame:
    """How many rows carry a value in each field a sender can choose."""
    wide = df.agg(*[F.count_if(F.col(f) != "").alias(f) for f in fields])
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("rows")) for f in fields])
    return wide.select(F.inline(pairs))


def top_classes(df: DataFrame, dimension: str, k: int = 3) -> DataFrame:
    """The k commonest classes of each value of a dimension, ties by class order."""
    classes = spine(
        df.sparkSession, [(c, i) for i, c in enumerate(spec.ATTACK_CLASSES)], "predicted_label string, pos int"
    )
    counts = df.groupBy(dimension, "predicted_label").agg(_count()).join(F.broadcast(classes), "predicted_label")
    # At most eight rows per value are left when the window runs.
    order = Window.partitionBy(dimension).orderBy(F.desc("count"), "pos")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(dimension, "predicted_label", "count", "rank")
    )
