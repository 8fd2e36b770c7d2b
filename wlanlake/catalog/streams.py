"""Checks of the streaming queries: each runs until its input is used up, and its results
must be those of the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.adapters import BSSID, detections, events, labelled_frames
from wlanlake.catalog.common import FRAME_KEYS, rounded, rounded_sql, stamp, stamp_sql, with_detections, with_frames
from wlanlake.catalog.frames import ROLLS, _roll_sql
from wlanlake.catalog.models import FIT, follows_rule, keyed
from wlanlake.operators.rollups import model_rows_from_raw
from wlanlake.plans import training
from wlanlake.session import store, work_dir
from wlanlake.sources.packets import read_packets
from wlanlake.streaming import detections as D
from wlanlake.streaming.features import StreamPaths, start_feature_stream

QUERIES = {}
ORACLES = {}
BATCHES = 3
FILES_PER_BATCH = 4


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def in_files(df, order: str, name: str) -> str:
    """The rows as a folder of files written one after the other, in order of arrival."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    stored = store(df, f"{name}-all")
    top = stored.agg(F.max(order)).first()[0] + 1
    for i in range(BATCHES):
        low, high = top * i // BATCHES, top * (i + 1) // BATCHES
        part = stored.filter((F.col(order) >= low) & (F.col(order) < high))
        part.repartition(FILES_PER_BATCH).write.mode("append").parquet(path)
    return path


def stream_of(df, order: str, name: str):
    """A stream that delivers the rows in several micro-batches."""
    path = in_files(df, order, name)
    reader = df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
    return reader.parquet(path)


def run_features(spark, sf_dir, score=None, frames=None) -> StreamPaths:
    frames = labelled_frames(spark, sf_dir) if frames is None else frames
    root = work_dir(spark, "stream")
    # The batch twin forgets nothing, and some streams are silent for days.
    start_feature_stream(stream_of(frames, "frame_number", "raw"), root, score=score, keep_for=None).awaitTermination()
    return StreamPaths(root)


def sink(stream, name: str, schema):
    """Write a stream to a table and read it back."""
    spark = stream.sparkSession
    path = work_dir(spark, name)
    D.start_packet_sink(stream, path, path + "-checkpoint").awaitTermination()
    return spark.read.schema(schema).parquet(path)


@query(
    "stream_frame_features",
    with_frames(f"SELECT block_id, frame_number, {rounded_sql(spec.FLAT_FEATURES)} FROM frames"),
)
def _features(spark, sf_dir):
    paths = run_features(spark, sf_dir)
    out = spark.read.parquet(paths.table("features"))
    return out.selectExpr("block_id", "frame_number", *rounded(spec.FLAT_FEATURES))


@query(
    "stream_rollups",
    with_frames(
        f"SELECT block_id, frame_number, {rounded_sql(ROLLS, 3)} FROM r",
        f"r AS (SELECT block_id, frame_number, {_roll_sql()} FROM frames)",
    ),
)
def _rollups(spark, sf_dir):
    paths = run_features(spark, sf_dir)
    out = spark.read.parquet(paths.table("model_rows"))
    return out.selectExpr("block_id", "frame_number", *rounded(ROLLS, 3))


def _scorer(spark, sf_dir):
    rows = store(model_rows_from_raw(labelled_frames(spark, sf_dir)), "model_rows")
    fitted = training.train_multiclass(rows, None, **FIT)
    return lambda df: training.score_frames(fitted, df)


@query("stream_score", f"WITH {FRAME_KEYS} SELECT block_id, event_id AS frame_number, label, TRUE AS holds FROM f0")
def _score(spark, sf_dir):
    """All frames, and whether their verdicts follow from their probabilities."""
    paths = run_features(spark, sf_dir, _scorer(spark, sf_dir))
    return keyed(spark.read.parquet(paths.table("scored")), follows_rule())


@query("stream_detect", f"WITH {FRAME_KEYS} SELECT event_id AS id, TRUE AS holds FROM f0")
def _detect(spark, sf_dir):
    """All frames, and whether exactly those judged an attack are in the packets, once, under the class of the verdict."""
    frames = labelled_frames(spark, sf_dir).withColumns(
        {
            "id": F.col("frame_number"),
            "ts": F.timestamp_micros((F.col("frame_time_epoch").cast("double") * 1000000).cast("long")),
            "iface": F.lit("wlan0"),
            "sa": F.col("wlan_sa"),
            "da": F.col("wlan_da"),
            "bssid": F.col("wlan_bssid"),
        }
    )
    paths = run_features(spark, sf_dir, _scorer(spark, sf_dir), frames)
    told = spark.read.parquet(paths.table("packets")).groupBy("id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("predicted_label").alias("_class")
    )
    verdicts = spark.read.parquet(paths.table("scored")).select("id", "verdict")
    attack = F.col("verdict.is_attack")
    right = F.when(attack, (F.col("_n") == 1) & (F.col("_class") == F.col("verdict.label"))).otherwise(F.col("_n").isNull())
    return verdicts.join(told, "id", "left").select("id", F.coalesce(right, F.lit(False)).alias("holds"))


_PACKET_SQL = f"SELECT id, {stamp_sql()} AS ts, src_mac, predicted_label FROM detections"


@query("packet_sink", with_detections(_PACKET_SQL))
def _sink(spark, sf_dir):
    rows = detections(spark, sf_dir)
    out = sink(stream_of(rows, "id", "detections"), "packets", rows.schema)
    return out.select("id", stamp().alias("ts"), "src_mac", "predicted_label")


@query("stream_tail", with_detections(f"{_PACKET_SQL} WHERE id > 1000"))
def _tail(spark, sf_dir):
    """A tail that is stopped after the first files and picks up where it was."""
    path = in_files(detections(spark, sf_dir), "id", "detections")
    out, checkpoint = work_dir(spark, "tail"), work_dir(spark, "tail-checkpoint")
    for _ in range(2):
        rows = D.read_packet_stream(spark, path, since_id=1000, files_per_trigger=1)
        D.start_packet_sink(rows, out, checkpoint).awaitTermination()
    return read_packets(spark, out).select("id", stamp().alias("ts"), "src_mac", "predicted_label")


@query(
    "stream_series",
    with_detections(
        "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H') AS hour, predicted_label, count(*) AS count FROM detections "
        "GROUP BY ALL"
    ),
)
def _series(spark, sf_dir):
    counts = D.hourly_counts(work_dir(spark, "hourly"))
    counts.start(stream_of(detections(spark, sf_dir), "id", "detections")).awaitTermination()
    return counts.read(spark).select(F.date_format("start", "yyyy-MM-dd'T'HH").alias("hour"), "predicted_label", "count")


@query(
    "stream_deauth_rate",
    with_frames(
        f"SELECT {stamp_sql('s')} AS start, bssid, count(*) AS frames FROM (SELECT bssid, unnest([date_trunc('hour', ts) "
        "- to_hours(CAST(i AS INTEGER)) FOR i IN range(0, 6)]) AS s FROM ev) w GROUP BY ALL",
        "ev AS (SELECT ts, printf('aa:aa:aa:aa:aa:%02x', 1 + user_id % 5) AS bssid FROM e WHERE event_type = 'signup')",
    ),
)
def _rate(spark, sf_dir):
    frames = events(spark, sf_dir).filter("event_type = 'signup'").selectExpr("event_id", "ts", f"{BSSID} as bssid")
    # The events are minutes apart, so hours stand in for seconds.
    rate = D.deauth_rate(work_dir(spark, "rate"), 6 * 3600, 3600)
    rate.start(stream_of(frames, "event_id", "frames")).awaitTermination()
    return rate.read(spark).select(stamp("start").alias("start"), "bssid", F.col("count").alias("frames"))


@query(
    "stream_dedupe",
    with_detections(
        "SELECT id, predicted_label, 'kept' AS reason FROM detections UNION ALL "
        "SELECT id, predicted_label, 'copy' FROM detections WHERE id % 3 = 0"
    ),
)
def _dedupe(spark, sf_dir):
    """The kept rows and those set aside: together all that came in."""
    rows = detections(spark, sf_dir)
    twice = rows.unionByName(rows.filter("id % 3 = 0"))
    root = work_dir(spark, "dedupe")
    D.Deduplication(root, 3600).start(stream_of(twice, "id", "twice")).awaitTermination()
    kept = spark.read.parquet(f"{root}/unique").withColumn("reason", F.lit("kept"))
    aside = spark.read.parquet(f"{root}/set_aside")
    return kept.unionByName(aside).select("id", "predicted_label", "reason")


@query(
    "stream_metrics",
    with_detections(
        "SELECT count(*) AS seen, count(*) FILTER (coalesce(ssid = 'net3', true) AND coalesce(proba_attack >= 0.8, false)) AS saved, "
        "count(*) FILTER (ssid <> 'net3') AS filtered FROM detections"
    ),
)
def _metrics(spark, sf_dir):
    rows = detections(spark, sf_dir).selectExpr(
        "id",
        "coalesce(get_json_object(raw, '$.ssid') <> 'net3', false) as ssid_filtered",
        "coalesce(proba_attack >= 0.8, false) as is_attack",
    )
    stream = D.with_counters(stream_of(rows, "id", "counted"))
    listener = D.CounterListener()
    spark.streams.addListener(listener)
    try:
        path = work_dir(spark, "counted-out")
        D.start_packet_sink(stream, path, path + "-checkpoint").awaitTermination()
        listener.ended.wait(30)
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([tuple(listener.totals.values())], "seen bigint, saved bigint, filtered bigint")
