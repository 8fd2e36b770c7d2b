"""Frame features, rolling columns and windows against plain Python, on blocks of very
different size and with tiles small enough that every block is cut many times."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.operators import frames, rollups, windows
from wlanlake.operators.layout import rank_by_hash, with_position
from wlanlake.operators.quantiles import exact_quantiles

SMALL = {"chunk": 4, "rows": 80}


def raw_table(spark, rows):
    """Raw records from dicts of dotted names."""
    cols = ["session_id", "block_id", "frame_number"] + [spec.flat(c) for c in spec.SOURCE_COLUMNS]
    data = []
    for r in rows:
        flat = {spec.flat(k): v for k, v in r.items()}
        flat["session_id"] = r.get("session_id", "s")
        flat["block_id"] = r.get("block_id", "s:0001")
        data.append(tuple(flat.get(c) for c in cols))
    schema = "session_id string, block_id string, frame_number bigint, " + ", ".join(f"{c} string" for c in cols[3:])
    return spark.createDataFrame(data, schema)


def derive(spark, records, **tiling):
    out = frames.derive_frame_features(raw_table(spark, records), **tiling)
    return out.orderBy("block_id", "frame_number").collect()


def numbered(rows):
    return [{"frame_number": i, **r} for i, r in enumerate(rows)]


@pytest.mark.parametrize("tiling", [{}, {"chunk": 2, "rows": 2}])
def test_sequence_steps(spark, tiling):
    seqs = ["10", "11", "4095", None, "0", "0", "4090", "5"]
    got = [r.wlan_seq_delta for r in derive(spark, numbered([{"wlan.seq": s} for s in seqs]), **tiling)]
    assert got == [None, 1, -12, None, 1, 0, -6, 11]


@pytest.mark.parametrize("tiling", [{}, {"chunk": 2, "rows": 2}])
def test_same_bssid_skips_frames_without_one(spark, tiling):
    macs = ["aa:01", None, "AA:01", "?", "aa:02", "aa:02"]
    got = [r.addr_same_bssid_as_prev for r in derive(spark, numbered([{"wlan.bssid": m} for m in macs]), **tiling)]
    assert got == [0, 0, 1, 0, 0, 1]


@pytest.mark.parametrize("tiling", [{}, {"chunk": 2, "rows": 2}])
def test_gap_falls_back_to_frames_that_had_no_delta(spark, tiling):
    rows = [
        {"frame.time_epoch": "100.0"},
        {"frame.time_epoch": "150.0", "frame.time_delta": "0.5"},
        {"frame.time_epoch": "103.0"},
        {},
        {"frame.time_epoch": "101.0"},
    ]
    got = derive(spark, numbered(rows), **tiling)
    assert [r.frame_dt for r in got] == [None, 0.5, 3.0, None, 0.0]
    assert got[0].frame_dt_log is None and got[4].frame_dt_log == 0.0


def test_absent_is_not_zero(spark):
    r = derive(spark, numbered([{}]))[0]
    assert r.frame_len is None and r.radio_signal_dbm is None and r.mgmt_tag_len is None
    assert (r.fc_type, r.fc_subtype) == (-1, -1)
    assert (r.fc_retry, r.radio_has_rate, r.mgmt_has_reason, r.eapol_present) == (0, 0, 0, 0)


def test_values_that_are_easy_to_get_wrong(spark):
    rows = [
        {"wlan.fixed.reason_code": "0", "wlan.tag.length": "0-8-26-12", "radiotap.present.tsft": "0-0-0"},
        {"radiotap.present.tsft": "1-0-0", "radiotap.dbm_antsignal": "-29-32-29", "wlan.ssid": "  net "},
        {"wlan.da": "FF:FF:FF:FF:FF:FF", "wlan.sa": "02:00:00:00:00:01", "wlan.ta": "02:00:00:00:00:01", "wlan.bssid": "02:00:00:00:00:01"},
        {"wlan_radio.signal_dbm": "-40", "radiotap.dbm_antsignal": "-29", "radiotap.channel.freq": "5180", "wlan_radio.data_rate": "6"},
        {"eapol.len": "95,117"},
    ]
    a, b, c, d, e = derive(spark, numbered(rows))
    assert (a.mgmt_has_reason, a.mgmt_reason_code, a.mgmt_tag_len, a.radio_has_tsft) == (1, 0, 46, 0)
    assert (b.radio_has_tsft, b.radio_signal_dbm, b.mgmt_ssid_len, b.radio_has_signal) == (1, -29, 3, 1)
    assert (c.addr_da_broadcast, c.addr_da_multicast, c.addr_sa_is_bssid, c.addr_sa_local_admin, c.addr_ta_eq_sa) == (1, 1, 1, 1, 1)
    assert (d.radio_signal_dbm, d.radio_is_5ghz, d.radio_datarate, d.radio_has_rate) == (-40, 1, 6, 0)
    assert (e.eapol_present, e.eapol_len, e.eapol_type) == (1, 95, None)


# ---- rolling columns ---------------------------------------------------------------------


def feature_table(spark, blocks, seed=1):
    """Feature rows with gaps in the frame numbers and absent values; {block: rows}."""
    rng = np.random.default_rng(seed)
    rows = []
    for block, n in blocks.items():
        numbers = np.sort(rng.choice(n * 3, size=n, replace=False))
        for i in range(n):
            x = [float(np.float32(v)) if rng.random() > 0.15 else None for v in rng.normal(50, 20, 6)]
            flags = [float(v) for v in rng.integers(0, 2, 6)]
            rows.append(("s", block, int(numbers[i]), *x, *flags))
    schema = "session_id string, block_id string, frame_number bigint, " + ", ".join(f"{c} float" for c in rollups.INPUTS)
    return spark.createDataFrame(rows, schema), rows


def expected_rolls(rows, windows_=(16, 64)):
    """Direct sums over the last n + 1 rows of a block."""
    out = {}
    by_block = {}
    for r in rows:
        by_block.setdefault(r[1], []).append(r)
    for block, rs in by_block.items():
        for i, r in enumerate(rs):
            values = []
            for n in windows_:
                part = rs[max(i - n, 0) : i + 1]
                cols = [[p[3 + j] for p in part if p[3 + j] is not None] for j in range(12)]
                means = [sum(c) / len(c) if c else None for c in cols]
                stds = [float(np.std(c)) if len(c) > 1 else None for c in cols[:6]]
                values += means[:6] + stds + means[6:]
            out[(block, r[2])] = values
    return out


def check_rolls(df, rows):
    want = expected_rolls(rows)
    got = df.collect()
    assert len(got) == len(want)
    names = [spec.flat(c) for c in spec.roll_names()]
    for r in got:
        for name, w in zip(names, want[(r.block_id, r.frame_number)], strict=True):
            g = r[name]
            if w is None or g is None:
                assert g is None and w is None, name
            else:
                assert math.isclose(g, w, rel_tol=1e-5, abs_tol=1e-4), (name, g, w)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 64, 65, 66, 300])
def test_rolls_of_one_block(spark, n):
    df, rows = feature_table(spark, {"b": n}, seed=n)
    check_rolls(rollups.causal_rollups(df), rows)


def test_rolls_do_not_change_when_a_huge_block_is_cut(spark):
    # One block holds nearly all rows; tiles of about 80 rows cut it more than ten times.
    df, rows = feature_table(spark, {"hot": 900, "a": 70, "b": 3, "c": 100})
    check_rolls(rollups.causal_rollups(df, **SMALL), rows)


def test_window_covers_n_plus_one_rows(spark):
    rows = [("s", "b", i, *([0.0] * 6), *([1.0 if i == 0 else 0.0] + [0.0] * 5)) for i in range(40)]
    schema = "session_id string, block_id string, frame_number bigint, " + ", ".join(f"{c} float" for c in rollups.INPUTS)
    out = rollups.causal_rollups(spark.createDataFrame(rows, schema)).orderBy("frame_number").collect()
    first = spec.flat(f"roll16.{spec.ROLL_RATE[0]}.rate")
    assert math.isclose(out[16][first], 1 / 17, rel_tol=1e-6)
    assert out[17][first] == 0.0


def test_constant_and_absent_columns(spark):
    rows = [("s", "b", i, 3244.0, None, 1e-7 * i, 5.0, None, None, *([0.0] * 6)) for i in range(120)]
    schema = "session_id string, block_id string, frame_number bigint, " + ", ".join(f"{c} float" for c in rollups.INPUTS)
    out = rollups.causal_rollups(spark.createDataFrame(rows, schema), **SMALL).collect()
    assert all(r.roll16_frame_len_std in (None, 0.0) for r in out)
    assert all(r.roll64_frame_dt_log_mean is None and r.roll64_frame_dt_log_std is None for r in out)


def test_rolls_are_causal(spark):
    df, _ = feature_table(spark, {"b": 200})
    assert rollups.future_leaks(df, "frame_len", 300, 1000.0).count() == 0


def test_one_pass_model_rows_equal_two_passes(spark):
    rows = [
        {"block_id": f"s:{b}", "frame_number": i, "wlan.seq": str(i * 7 % 4096), "frame.len": str(60 + i % 9), "frame.time_epoch": str(i * 0.1)}
        for b, n in (("hot", 400), ("cold", 30))
        for i in range(n)
    ]
    raw = raw_table(spark, rows)
    one = rollups.model_rows_from_raw(raw, **SMALL)
    two = rollups.model_rows(frames.derive_frame_features(raw))
    assert one.select(*sorted(one.columns)).exceptAll(two.select(*sorted(one.columns))).count() == 0
    assert one.count() == 430


# ---- positions and windows -----------------------------------------------------------------


def positions(spark, blocks, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for block, n in blocks.items():
        for i, f in enumerate(np.sort(rng.choice(n * 5, size=n, replace=False))):
            rows.append((block, int(f), i, int(rng.random() < 0.2)))
    return spark.createDataFrame(rows, "block_id string, frame_number bigint, place bigint, label int"), rows


BLOCKS = {"hot": 700, "a": 64, "b": 63, "c": 1, "d": 200}


def test_positions_are_exact(spark):
    df, _ = positions(spark, BLOCKS)
    got = with_position(df, chunk=8, rows=8)
    assert got.filter("rn <> place").count() == 0
    assert got.count() == sum(BLOCKS.values())


def starts_of(n, window, stride):
    return sorted({*range(0, n - window, stride), n - window}) if n >= window else []


def test_training_windows(spark):
    df, _ = positions(spark, BLOCKS)
    got = windows.training_windows(df, 64, 16, chunk=8, rows=32)
    want = {(b, s) for b, n in BLOCKS.items() for s in starts_of(n, 64, 16)}
    assert {(r.block_id, r.start) for r in got.collect()} == want


@pytest.mark.parametrize("window, stride", [(64, 16), (10, 16), (7, 3)])
def test_attack_flags_per_window(spark, window, stride):
    df, rows = positions(spark, BLOCKS)
    labels = {}
    for b, _, i, label in rows:
        labels.setdefault(b, []).append(label)
    got = {(r.block_id, r.start): r.attack_rows for r in windows.windows_with_attack(df, window, stride, chunk=8, rows=32).collect()}
    want = {(b, s): sum(labels[b][s : s + window]) for b, n in BLOCKS.items() for s in starts_of(n, window, stride)}
    assert got == want


def test_gathered_windows(spark):
    df, _ = positions(spark, BLOCKS)
    got = windows.gather_windows(df.withColumn("x", F.col("place").cast("float")), ["x"], 64, 32, chunk=8, rows=32).collect()
    assert {(r.block_id, r.start) for r in got} == {(b, s) for b, n in BLOCKS.items() for s in starts_of(n, 64, 32)}
    for r in got:
        assert r.features == [[float(x) for x in range(r.start, r.start + 64)]]


def test_inference_tiles_predict_every_frame_once(spark):
    df, _ = positions(spark, BLOCKS)
    seen = {}
    for r in windows.inference_chunks(df, 50, 20, chunk=8, rows=32).collect():
        assert r.ctx_start == max(0, r.pred_start - 20)
        seen.setdefault(r.block_id, []).extend(range(r.pred_start, r.pred_end))
    assert {b: sorted(v) for b, v in seen.items()} == {b: list(range(n)) for b, n in BLOCKS.items()}


def test_densest_window(spark):
    df, rows = positions(spark, BLOCKS)
    labels = {}
    for b, _, _, label in rows:
        labels.setdefault(b, []).append(label)
    got = {
        r.block_id: (r.lo, r.hi, r.hits)
        for r in windows.densest_window(df, F.col("label") == 1, 16, 64, 12, chunk=8, rows=80).collect()
    }
    for b, xs in labels.items():
        size = 16
        while True:
            if len(xs) <= size:
                best = (0, len(xs), sum(xs))
            else:
                sums = [sum(xs[i : i + size]) for i in range(len(xs) - size + 1)]
                lo = sums.index(max(sums))
                best = (lo, lo + size, max(sums))
            if best[2] >= 12 or size >= 64:
                break
            size *= 2
        assert got[b] == best


def test_context(spark):
    df, _ = positions(spark, {"hot": 300, "a": 5})
    got = windows.context_window(df.withColumn("x", F.col("place").cast("float")), ["x"], 12, chunk=4, rows=16).collect()
    place = {(b, f): i for b, f, i, _ in positions(spark, {"hot": 300, "a": 5})[1]}
    for r in got:
        i = place[(r.block_id, r.frame_number)]
        assert r.context == [[float(x)] for x in range(max(0, i - 12), i + 1)]


def test_escaping_windows_are_found(spark):
    sizes = spark.createDataFrame([("a", 100)], "block_id string, n_rows bigint")
    starts = spark.createDataFrame([("a", 36), ("a", 37), ("z", 0)], "block_id string, start bigint")
    assert {(r.block_id, r.start) for r in windows.escaping_windows(starts, sizes, 64).collect()} == {("a", 37), ("z", 0)}
    with pytest.raises(AssertionError):
        windows.assert_no_cross_block(starts, sizes, 64)


# ---- exact ranks and quantiles ----------------------------------------------------------------


def test_rank_by_hash_is_a_permutation(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"))
    got = rank_by_hash(df.withColumn("h", F.xxhash64("id")), "h", "id", by=["g"], buckets=16)
    rows = got.collect()
    for g, n in (("hot", 900), ("cold", 100)):
        mine = sorted((r.h, r.id, r.rk) for r in rows if r.g == g)
        assert [m[2] for m in mine] == list(range(n))


def test_rank_by_hash_deals_no_rows_by_the_group_alone(spark, capsys):
    df = spark.range(600).select("id", F.when(F.col("id") < 500, 1).otherwise(2).alias("g"), F.rand(1).alias("wide"))
    df = df.withColumn("h", F.xxhash64("id"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = rank_by_hash(df, "h", "id", by=["g"])
        got.explain("formatted")
        rows = got.collect()
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)
    steps = [s for s in capsys.readouterr().out.split("\n\n") if ") Exchange" in s]
    wide = [s for s in steps if "wide#" in s or "_others#" in s]
    assert wide and all("_slice#" in s.split("hashpartitioning(")[1] for s in wide)
    assert got.columns == ["g", "id", "wide", "h", "n_group", "rk"]
    for g, n in ((1, 500), (2, 100)):
        mine = [r for r in rows if r.g == g]
        assert [r.rk for r in sorted(mine, key=lambda r: (r.h, r.id))] == list(range(n)) and {r.n_group for r in mine} == {n}


def test_exact_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(4000, 7.0), rng.normal(0, 100, 5000), rng.integers(0, 5, 1000).astype(float)])
    rows = [(float(v), None if i % 3 else float(i), float("nan") if i % 2 else -float(i), 2**53 + i % 2, None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "x double, y double, z double, w long, empty double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    y = np.array([i for i in range(len(x)) if i % 3 == 0], dtype=float)
    z = np.array([-i for i in range(len(x)) if i % 2 == 0], dtype=float)
    # Small bounds on what a bracket may hold make it narrow several times.
    for most in (1_000_000, 2_000, 30, 1):
        got = {(r.feature, r.q): r.value for r in exact_quantiles(df, ["x", "y", "z", "w", "empty"], probs, most=most).collect()}
        for q in probs:
            assert math.isclose(got[("x", q)], np.quantile(x, q), rel_tol=1e-12, abs_tol=1e-12), (most, q)
            assert math.isclose(got[("y", q)], np.quantile(y, q), rel_tol=1e-12)
            assert math.isclose(got[("z", q)], np.quantile(z, q), rel_tol=1e-12, abs_tol=1e-9)
        assert len(got) == 4 * len(probs)


def test_brackets_leave_little_to_shuffle(spark):
    from wlanlake.operators import quantiles

    df = spark.range(200_000).selectExpr("cast(xxhash64(id) as double) as x", "id as i")
    seen = []
    count = quantiles._count
    try:
        quantiles._count = lambda wide, brackets: (count(wide, brackets), seen.append(max(b.inside for b in brackets)))
        got = {(r.feature, r.q): r.value for r in quantiles.exact_quantiles(df, ["x", "i"], [0.5], most=1000).collect()}
    finally:
        quantiles._count = count
    assert seen[-1] <= 1000 and got[("i", 0.5)] == 99999.5


def test_small_blocks_take_one_exchange(spark, tmp_path):
    """No block is large: neither features nor positions shuffle the rows more than once, and nothing is joined."""
    rows = [{"block_id": f"b{i % 5}", "frame_number": i, "wlan.seq": str(i), "frame.len": "60"} for i in range(300)]
    path = str(tmp_path / "raw")
    raw_table(spark, rows).write.parquet(path)
    raw = spark.read.parquet(path)
    plans = {
        "features": frames.derive_frame_features(raw),
        "model rows": rollups.model_rows_from_raw(raw),
        "positions": with_position(raw.select("block_id", "frame_number")),
    }
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in plans.items():
            assert df.count() == 300
            df.write.format("noop").mode("overwrite").save()
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, (name, plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = {(r.block_id, r.frame_number): (r.rn, r.n_rows) for r in plans["positions"].collect()}
    assert got == {(f"b{i % 5}", i): (i // 5, 60) for i in range(300)}
    tiled = with_position(raw.select("block_id", "frame_number"), chunk=4, rows=16)
    assert {(r.block_id, r.frame_number): (r.rn, r.n_rows) for r in tiled.collect()} == got
