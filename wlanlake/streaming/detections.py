"""Streams over the detections table: sink, tail, counts over time, duplicates, counters."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from wlanlake.sources.packets import PACKET_SCHEMA
from wlanlake.streaming.state import BucketTable


def read_packet_stream(
    spark: SparkSession, path: str, *, since_id: int | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """New rows of the detections table as they arrive.

    The checkpoint of the reading query is its resume point; ``since_id`` only matters for
    its first start.
    """
    reader = spark.readStream.schema(PACKET_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.parquet(path)
    return rows if since_id is None else rows.filter(F.col("id") > since_id)


def start_packet_sink(
    rows: DataFrame, path: str, checkpoint: str, *, available_now: bool = True, interval: str = "2 seconds"
) -> StreamingQuery:
    """Append a stream to a table; the trigger interval is the batching."""
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**trigger)
        .start()
    )


def _started(rows: DataFrame, work, root: str, available_now: bool, interval: str) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(work).option("checkpointLocation", f"{root}/checkpoint")
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


@dataclass
class CountTable:
    """Counts per time and key that every micro-batch adds to; no time is ever closed, so no row comes too late.

    ``times`` gives the start of each time a row counts for (one, or several that overlap). A batch is
    counted down to its times and keys first; only the buckets these fall into are rewritten. Times of one
    ``stretch`` share ``spread`` buckets, so new rows leave the buckets of older times alone.
    """

    root: str
    times: Column
    key: str
    key_type: str = "string"
    stretch: str = "day"
    spread: int = 4
    buckets: int = 64

    def _table(self, spark: SparkSession) -> BucketTable:
        schema = f"start timestamp, {self.key} {self.key_type}, count bigint"
        return BucketTable(spark, f"{self.root}/counts", schema, self.buckets)

    def add(self, rows: DataFrame, batch: int) -> None:
        table = self._table(rows.sparkSession)
        bucket = table.bucket_of(F.date_trunc(self.stretch, "start"), F.pmod(F.xxhash64(self.key), F.lit(self.spread)))
        new = (
            rows.select(F.explode(self.times).alias("start"), self.key)
            .groupBy("start", self.key)
            .agg(F.count(F.lit(1)).alias("count"))
            .withColumn("bucket", bucket)
            .persist()
        )
        before = table.version(batch - 1)
        touched = table.touched(new)
        old = table.read(before, touched).withColumn("bucket", bucket)
        merged = old.unionByName(new).groupBy("bucket", "start", self.key).agg(F.sum("count").alias("count"))
        table.write(merged, batch, touched, before)
        new.unpersist()

    def start(self, rows: DataFrame, *, available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
        return _started(rows, self.add, self.root, available_now, interval)

    def read(self, spark: SparkSession) -> DataFrame:
        """(start, key, count) over all that has arrived so far."""
        table = self._table(spark)
        return table.read(table.version(table.latest()))


def hourly_counts(root: str, **options) -> CountTable:
    """Rows per class and hour."""
    return CountTable(root, F.array(F.date_trunc("hour", "ts")), "predicted_label", **options)


def deauth_rate(root: str, length: int = 10, step: int = 1, **options) -> CountTable:
    """Frames per BSSID in every window of ``length`` seconds that begins on a whole ``step``.

    The stream has ``ts`` and ``bssid``; leave only frames with a reason code in it.
    """
    last = F.unix_seconds("ts") - F.pmod(F.unix_seconds("ts"), F.lit(step))
    back = F.sequence(F.lit(0), F.lit(length - step), F.lit(step))
    starts = F.transform(back, lambda s: F.timestamp_seconds(last - s))
    return CountTable(root, F.filter(starts, lambda s: F.unix_micros("ts") < F.unix_micros(s) + length * 1_000_000), "bssid", stretch="hour", **options)


@dataclass
class Deduplication:
    """The first copy of every id goes to ``unique``; all other rows to ``set_aside`` with a ``reason``.

    An id is known until the stream's latest time is ``lateness`` seconds past the row that was kept. Rows
    older than that when their batch begins are ``late``: whether they are copies can no longer be told.
    Others are a ``copy`` of a kept row. Among the copies of one batch the one of the least time is kept.
    Rows without an id are copies of nothing; rows without a time are never late. Every row goes to one
    of the two tables.
    """

    root: str
    lateness: float = 3600.0
    buckets: int = 64

    def _table(self, spark: SparkSession) -> BucketTable:
        return BucketTable(spark, f"{self.root}/known", "id bigint, seen double", self.buckets, seen="seen")

    def add(self, rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        table = self._table(spark)
        before = table.version(batch - 1)
        time = F.unix_micros("ts") / 1e6
        bound = None if before.clock is None else before.clock - self.lateness
        late = F.lit(False) if bound is None else F.coalesce(time < bound, F.lit(False))
        staged = f"{self.root}/staged"
        marked = rows.withColumns(
            {"_late": late, "_time": time, "_mark": F.xxhash64(*rows.columns), "_row": F.monotonically_increasing_id()}
        )
        marked.write.mode("overwrite").parquet(staged)
        marked = spark.read.schema(marked.schema).parquet(staged)
        named = marked.filter("id is not null and not _late").withColumn("bucket", table.bucket_of("id"))
        # Only the buckets' numbers and the latest time come to the driver.
        touched = table.touched(named)
        newest = marked.agg(F.max("_time")).first()[0]
        clock = max((t for t in (before.clock, newest) if t is not None), default=None)

        known = table.read(before, touched)
        first = named.groupBy("bucket", "id").agg(F.min(F.struct("_time", "_mark", "_row")).alias("first"))
        new = first.join(known.select("id"), "id", "left_anti")
        kept = new.select(F.col("first._row").alias("_row"), F.lit(True).alias("_kept"))
        reason = F.when(F.col("_late"), "late").when(F.col("id").isNotNull() & F.col("_kept").isNull(), "copy")
        told = marked.join(kept, "_row", "left").withColumn("reason", reason)
        unique = told.filter("reason is null").select(*rows.columns)
        unique.write.mode("overwrite").parquet(f"{self.root}/unique/batch_id={batch}")
        aside = told.filter("reason is not null").select(*rows.columns, "reason")
        aside.write.mode("overwrite").parquet(f"{self.root}/set_aside/batch_id={batch}")

        limit = None if clock is None else clock - self.lateness
        rewritten = sorted({*touched, *before.due(limit)})
        seen = F.coalesce("first._time", F.lit(clock).cast("double"))
        both = table.read(before, rewritten).withColumn("bucket", table.bucket_of("id")).unionByName(
            new.select("id", seen.alias("seen"), "bucket")
        )
        alive = both if limit is None else both.filter(F.coalesce(F.col("seen") >= limit, F.lit(True)))
        table.write(alive, batch, rewritten, before, clock)

    def start(self, rows: DataFrame, *, available_now: bool = True, interval: str = "10 seconds") -> StreamingQuery:
        return _started(rows, self.add, self.root, available_now, interval)


COUNTERS = "frame_counters"


def with_counters(frames: DataFrame, kept: str = "is_attack", filtered: str = "ssid_filtered") -> DataFrame:
    """Attach counters of frames seen, saved and filtered to a stream."""
    return frames.observe(
        COUNTERS,
        F.count(F.lit(1)).alias("seen"),
        F.count_if(F.col(kept) & ~F.col(filtered)).alias("saved"),
        F.count_if(F.col(filtered)).alias("filtered"),
    )


class CounterListener(StreamingQueryListener):
    """Adds up the counters of all batches of all queries it hears of."""

    def __init__(self) -> None:
        self.totals = {"seen": 0, "saved": 0, "filtered": 0}
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(COUNTERS)
        if row is not None:
            for name, value in row.asDict().items():
                self.totals[name] += value or 0

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()
