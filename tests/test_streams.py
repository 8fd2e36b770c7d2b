"""Streams against their batch twins, over several micro-batches."""

from wlanlake.catalog.streams import FILES_PER_BATCH, in_files
from wlanlake.operators import frames, rollups
from wlanlake.streaming.features import StreamPaths, start_feature_stream

from test_frames import raw_table


def test_feature_stream_equals_batch_across_batches(spark, tmp_path):
    rows = []
    for i in range(260):
        # One stream carries most frames; the quiet one pauses for a whole batch.
        block = "hot" if i % 13 or 90 <= i < 180 else "quiet"
        rows.append({
            "block_id": block, "frame_number": i, "wlan.seq": None if i % 7 == 0 else str(i * 37 % 4096),
            "wlan.bssid": None if i % 5 == 0 else f"aa:0{i % 3}", "frame.time_epoch": str(100 + i * 0.5),
            "frame.time_delta": None if i % 2 else "0.1", "frame.len": None if i % 11 == 0 else str(60 + i % 40),
            "wlan.fc.retry": str(i % 2),
        })
    raw = raw_table(spark, rows)
    path = in_files(raw, "frame_number", "raw")
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(path)
    # The second start finds everything done: it resumes, and adds nothing.
    for _ in range(2):
        query = start_feature_stream(stream, str(tmp_path / "out"), chunk=4, rows=80)
        query.awaitTermination()
        assert query.exception() is None

    paths = StreamPaths(str(tmp_path / "out"))
    want = rollups.model_rows(frames.derive_frame_features(raw))
    got = spark.read.parquet(paths.table("model_rows"))
    assert got.select("batch_id").distinct().count() == 3
    keep = ["block_id", "frame_number", "wlan_seq_delta", "addr_same_bssid_as_prev", "frame_dt", "roll16_frame_len_mean",
            "roll64_frame_len_mean", "roll16_fc_retry_rate", "roll64_fc_retry_rate"]
    a = {(r.block_id, r.frame_number): r for r in got.select(*keep).collect()}
    b = {(r.block_id, r.frame_number): r for r in want.select(*keep).collect()}
    assert a.keys() == b.keys() and len(a) == 260
    for key, r in b.items():
        for c in keep[2:]:
            x, y = a[key][c], r[c]
            assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-4), (key, c, x, y)


def _folders(root):
    return {p.relative_to(root).as_posix() for p in root.rglob("bucket=*")}


def test_silent_streams_are_forgotten_and_only_touched_buckets_rewritten(spark, tmp_path):
    from wlanlake.streaming.features import CONTEXT_SCHEMA, LEFT_SCHEMA
    from wlanlake.streaming.state import BucketTable

    rows = []
    for i in range(400):
        # "early" sends in the first quarter only, "late" comes back at the very end; b0..b9 take turns.
        block = "early" if i < 100 and i % 2 else "late" if (i < 10 or i > 390) else f"b{i // 100}"
        rows.append({"block_id": block, "frame_number": i, "wlan.seq": str(i), "frame.time_epoch": str(1000 + i * 10), "frame.len": "60"})
    raw = raw_table(spark, rows)
    path = str(tmp_path / "raw")
    for k in range(4):
        raw.filter(f"frame_number >= {100 * k} and frame_number < {100 * k + 100}").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(path)
    start_feature_stream(stream, str(tmp_path / "out"), keep_for=1500, buckets=16).awaitTermination()

    for name, schema in (("state_values", LEFT_SCHEMA), ("state_context", CONTEXT_SCHEMA)):
        table = BucketTable(spark, str(tmp_path / "out" / name), schema, 16, seen="seen")
        assert table.latest() == 3
        version = table.version(3)
        held = {r["block_id"]: r["n"] for r in table.read(version).groupBy("block_id").count().withColumnRenamed("count", "n").collect()}
        # The newest frame is at 4990 s: streams silent since before 3490 s are gone.
        assert set(held) == {"b2", "b3", "late"}
        if name == "state_context":
            assert held["b2"] == held["b3"] == 64 and held["late"] == 9
        # Each batch wrote a few buckets, and only the last two versions are there.
        assert _folders(tmp_path / "out" / name / "data") <= {
            f"written={w}/bucket={b}" for v in (version, table.version(2)) for b, w in v.written.items()
        }
        assert not (tmp_path / "out" / name / "manifest" / "version=1").exists()
    # Back after its state is gone, "late" starts anew: no step from the sequence number it once had.
    first = spark.read.parquet(str(tmp_path / "out" / "features")).filter("block_id = 'late' and frame_number = 391").first()
    assert first["wlan_seq_delta"] is None


def test_counts_take_late_rows_and_repeated_batches(spark, tmp_path):
    from wlanlake.streaming.detections import deauth_rate, hourly_counts

    def batch(*rows):
        return spark.createDataFrame(list(rows), "t string, predicted_label string, bssid string").selectExpr(
            "cast(t as timestamp) as ts", "predicted_label", "bssid"
        )

    batches = [
        batch(("2024-01-01 10:59:59.5", "a", "x"), ("2024-01-03 00:00:00", None, None)),
        batch(("2024-01-01 10:00:00", "a", "x"), (None, "a", "x"), ("2024-01-03 00:00:01", "b", "x")),
        batch(("2023-12-31 23:59:59", "b", "y")),
    ]
    hours, rate = hourly_counts(str(tmp_path / "hours"), buckets=8), deauth_rate(str(tmp_path / "rate"), 3, 1, buckets=8)
    assert hours.times is not None
    for n, rows in enumerate(batches):
        for table in (hours, rate):
            table.add(rows, n)
            # A batch that is run again, as after a failure, adds nothing.
            table.add(rows, n)
    got = {(str(r["start"]), r["predicted_label"], r["count"]) for r in hours.read(spark).filter("start is not null").collect()}
    assert got == {("2024-01-01 10:00:00", "a", 2), ("2024-01-03 00:00:00", None, 1), ("2024-01-03 00:00:00", "b", 1), ("2023-12-31 23:00:00", "b", 1)}
    assert hours.read(spark).filter("start is null").first()["count"] == 1
    got = {(str(r["start"]), r["count"]) for r in rate.read(spark).filter("bssid = 'x'").collect()}
    assert got == {("2024-01-01 10:59:57", 1), ("2024-01-01 10:59:58", 1), ("2024-01-01 10:59:59", 1), ("2024-01-01 09:59:58", 1), ("2024-01-01 09:59:59", 1),
                   ("2024-01-01 10:00:00", 1), ("2024-01-02 23:59:59", 1), ("2024-01-03 00:00:00", 1), ("2024-01-03 00:00:01", 1)}


def test_each_row_is_unique_or_set_aside(spark, tmp_path):
    from wlanlake.streaming.detections import Deduplication

    def batch(*rows):
        return spark.createDataFrame(list(rows), "id long, s long, x string").selectExpr("id", "timestamp_seconds(s) as ts", "x")

    batches = [
        batch((1, 1000, "a"), (1, 1000, "b"), (2, 1050, "c"), (None, 1000, "d"), (None, 1000, "d"), (3, None, "e")),
        batch((1, 1001, "f"), (4, 1200, "g"), (3, None, "h"), (2, 1060, "i")),
        batch((5, 1050, "late"), (4, 1200, "k"), (6, 1190, "l"), (None, 900, "late too"), (6, 1150, "m")),
    ]
    dedup = Deduplication(str(tmp_path / "dedup"), lateness=100, buckets=4)
    for n, rows in enumerate(batches):
        dedup.add(rows, n)
        dedup.add(rows, n)
    unique = sorted(r["x"] for r in spark.read.parquet(str(tmp_path / "dedup" / "unique")).collect())
    aside = sorted((r["x"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "dedup" / "set_aside")).collect())
    assert len(unique) + len(aside) == 15
    first = "a" if "a" in unique else "b"
    assert unique == sorted([first, "c", "d", "d", "e", "g", "m"])
    assert aside == sorted([({"a": "b", "b": "a"}[first], "copy"), ("f", "copy"), ("h", "copy"), ("i", "copy"), ("late", "late"), ("k", "copy"), ("l", "copy"), ("late too", "late")])
    table = dedup._table(spark)
    # 1 and 2 lie more than 100 s behind the newest row; an id without a time is as old as the newest one then.
    assert {r["id"] for r in table.read(table.version(2)).collect()} == {4, 6}
