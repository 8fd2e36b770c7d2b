"""Scans and sinks on files written by hand."""

import json

import pytest

from wlanlake import spec
from wlanlake.plans.prepare import prepare_features, read_report
from wlanlake.sources import capture, inventory, shards

HEADER = ["frame.number", "frame.len", "wlan.fc.retry", "wlan.seq", "wlan.ssid", "unused", "Label"]


def write_capture(root, folder, index, lines, header=HEADER):
    path = root / folder
    path.mkdir(parents=True, exist_ok=True)
    name = folder.split(".", 1)[1]
    text = ",".join(header) + "\n" + "\n".join(lines) + "\n"
    (path / f"{name}_{index}.csv").write_bytes(text.encode("latin-1"))


@pytest.fixture
def root(tmp_path):
    write_capture(tmp_path, "1.Deauth", 0, ["1,60,0,10,caf\xe9,x,Normal", '2,61,1,11,"a,b",x,Deauth', "3,62,1", "4,63,0,13,n,x,Normal,extra", "5,64,0,14,?,x,SDDP"])
    write_capture(tmp_path, "1.Deauth", 12, ["7,60,0,20,n,x,Botnet", "8,60,0,21,n,x,deauth"])
    write_capture(tmp_path, "7.SSH", 0, ["1,60,0,1,n,x,Normal"])
    write_capture(tmp_path, "11.SSDP", 3, ["1,60,True,1,n,x,Normal", "2,60,False,1,n,x,SSDP"])
    return tmp_path


def scan(spark, root, **kw):
    return capture.read_capture_csv(spark, str(root) + "/*/*.csv", **kw)


def test_scan_places_rows_and_fills_missing_columns(spark, root):
    rows = scan(spark, root, skip_sessions=["7.SSH"])
    got = {(r.block_id, r.frame_number): r for r in rows.collect()}
    assert {b for b, _ in got} == {"Deauth:0000", "Deauth:0012", "SSDP:0003"}
    assert got[("Deauth:0000", 1)].wlan_ssid == "caf\xe9" and got[("Deauth:0000", 2)].wlan_ssid == "a,b"
    assert got[("Deauth:0012", 8)].wlan_bssid is None
    assert set(spec.flat(c) for c in spec.SOURCE_COLUMNS) <= set(rows.columns)


def test_scan_reads_only_what_is_used(spark, root):
    plan = scan(spark, root).select("frame_number", "wlan_seq")._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan.split("ReadSchema")[1]


def test_files_with_other_headers_are_read_by_name(spark, root):
    write_capture(root, "1.Deauth", 13, ["60,5,0,9,n,x,Normal", "62,6,0,10,n,x"], [HEADER[1], HEADER[0], *HEADER[2:]])
    write_capture(root, "1.Deauth", 14, ["Normal,3,70"], ["Label", "wlan.seq", "frame.len"])
    write_capture(root, "1.[odd]+ name", 1, ["7,Deauth,8"], ["frame.number", "Label", "frame.number"])
    (root / "1.Deauth" / "Deauth_15.csv").write_text("")
    rows = scan(spark, root, malformed=True, place=True)
    got = {(r.block_id, r.frame_number): r for r in rows.filter("not _malformed").collect()}
    one = got[("Deauth:0013", 5)]
    assert (one.frame_len, one.wlan_seq, one.raw_label) == ("60", "9", "Normal")
    assert [(r.frame_len, r.wlan_seq) for k, r in got.items() if k[0] == "Deauth:0014"] == [("70", "3")]
    assert [k[1] for k, r in got.items() if k[0].startswith("[odd]+ name") and r.raw_label == "Deauth"] == [7]
    assert ("Deauth:0012", 8) in got and sum(k[0] == "Deauth:0013" for k in got) == 1
    assert {r.block_id: r.malformed for r in capture.split_malformed(rows)[1].collect()}["Deauth:0013"] == 1


def test_headers_are_read_by_a_task_for_each_file_that_stops(spark, root):
    write_capture(root, "2.Long", 1, [f"{i},60,0,1,n,x,Normal" for i in range(50_000)])
    got = capture.header_catalogue(spark, str(root) + "/*/*.csv")
    assert got.count() == 5 and got.select("header").distinct().count() == 1
    assert spark.conf.get("spark.sql.files.openCostInBytes") != str(1 << 60)


def test_a_file_without_label_is_named(spark, root):
    write_capture(root, "1.Deauth", 13, ["60,1"], ["frame.len", "frame.number"])
    with pytest.raises(ValueError, match="no Label column in 1 files.*Deauth_13"):
        scan(spark, root)


def test_malformed_rows_are_counted(spark, root):
    good, counts = capture.split_malformed(scan(spark, root, malformed=True))
    got = {r.block_id: (r.rows, r.malformed) for r in counts.collect()}
    assert got["Deauth:0000"] == (5, 2) and got["Deauth:0012"] == (2, 0)
    assert sorted(r.frame_number for r in good.filter("block_id = 'Deauth:0000'").collect()) == [1, 2, 5]


def test_word_booleans_are_refused(spark, root):
    rows = scan(spark, root)
    assert [r.block_id for r in capture.check_export_format(rows).filter("rejected").collect()] == ["SSDP:0003"]
    with pytest.raises(ValueError):
        capture.require_export_format(rows)


def test_numbers_by_place_rise_within_a_file(spark, tmp_path):
    write_capture(tmp_path, "1.Deauth", 0, [f"60,0,{i},n,x,Normal" for i in range(500)], HEADER[1:])
    rows = scan(spark, tmp_path).orderBy("frame_number").collect()
    assert [int(r.wlan_seq) for r in rows] == list(range(500))
    assert len({r.frame_number for r in rows}) == 500


def test_prepare_drops_before_it_derives(spark, root, tmp_path):
    target = str(tmp_path / "features")
    summary = prepare_features(spark, str(root) + "/*/*.csv", target).first()
    assert (summary.rows, summary.malformed, summary.unknown_label_rows, summary.rejected_blocks) == (4, 2, 1, 1)
    assert (summary.n_normal, summary.n_deauth, summary.n_ssdp) == (1, 2, 1)
    got = {(r.block_id, r.frame_number): r for r in shards.read_features(spark, target).collect()}
    # Frames 3 and 4 are malformed, so frame 5 follows frame 2.
    assert got[("Deauth:0000", 5)].wlan_seq_delta == 3
    assert got[("Deauth:0012", 8)].wlan_seq_delta is None
    again = prepare_features(spark, str(root) + "/*/*.csv", target).first()
    assert (again.rows, again.blocks, again.n_deauth) == (0, 0, 0)
    assert shards.read_features(spark, target).count() == 4


def test_report_tells_files_and_spellings(spark, root, tmp_path):
    target = str(tmp_path / "features")
    prepare_features(spark, str(root) + "/*/*.csv", target)
    files = {r.block_id: r for r in read_report(spark, target).collect()}
    assert (files["Deauth:0000"].rows, files["Deauth:0000"].malformed, files["Deauth:0012"].unknown_label_rows) == (5, 2, 1)
    assert [b for b, r in files.items() if r.rejected] == ["SSDP:0003"] and files["SSDP:0003"].odd_rows == 2
    tally = {(r.spelling, r.label): r.rows for r in read_report(spark, target, "labels").collect()}
    assert tally[("deauth", 1)] == 1 and tally[("Botnet", None)] == 1 and tally[("SDDP", spec.CLASSES.index("SSDP"))] == 1


def test_folders_do_not_grow_with_blocks_and_repeated_writes_add_nothing(spark, tmp_path):
    from wlanlake.operators.frames import derive_frame_features

    def rows(blocks, length):
        raw = spark.range(40).selectExpr(
            f"concat('b', id % {blocks}) as block_id", "'s' as session_id", "id as frame_number", f"string({length}) as frame_len",
            "cast(0 as tinyint) as label",
        )
        return derive_frame_features(raw)

    path = str(tmp_path / "features")
    first = shards.write_features(rows(20, 60), path)
    assert len(list((tmp_path / "features" / "data").glob("**/"))) == 2
    again = shards.write_features(rows(20, 60), path)
    assert shards.read_run(spark, path, again).count() == 0 and shards.read_run(spark, path, first).count() == 40
    # A run that broke off before its manifest is not read.
    rows(3, 99).write.parquet(path + "/data/run=000009-broken")
    assert shards.read_features(spark, path).count() == 40
    assert shards.existing_blocks(spark, path).count() == 20
    # Written anew, a block is read from its newest run.
    shards.write_features(rows(40, 70).filter("block_id = 'b7'"), path, skip_existing=False)
    got = shards.read_features(spark, path).groupBy("block_id", "frame_len").count().collect()
    assert {(r.block_id, r.frame_len) for r in got if r.frame_len != 60} == {("b7", 70.0)} and len(got) == 20


def test_the_first_good_row_decides_on_the_format(spark, root, tmp_path):
    late = [f"{k},60,0,{k},n,x,Normal" for k in range(1, 50)] + ["50,60,True,50,n,x,Normal", "51,60,1,51,n,x,Normal"]
    write_capture(root, "1.Deauth", 21, late)
    write_capture(root, "1.Deauth", 22, ["1,60,True", "2,60,False,2,n,x,unheard", "3,60,1,3,n,x,Normal"])
    target = str(tmp_path / "features")
    summary = prepare_features(spark, str(root) + "/*/*.csv", target).first()
    assert (summary.rejected_blocks, summary.odd_rows, summary.malformed) == (2, 1, 3)
    blocks = {r.block_id: r["count"] for r in shards.read_features(spark, target).groupBy("block_id").count().collect()}
    assert blocks["Deauth:0021"] == 51 and not {"SSDP:0003", "Deauth:0022"} & set(blocks)


def test_inventory_shapes(spark, tmp_path):
    good = {"bssid": "a", "name": "one", "lat": "1.5", "lng": 2}
    entries = [good, {"bssid": "b", "name": "two", "lat": "north", "lng": 2}, {"name": "three", "lat": 1, "lng": 1}]
    for i, document in enumerate((entries, {"aps": entries})):
        path = tmp_path / f"aps{i}.json"
        path.write_text(json.dumps(document, indent=2))
        got = inventory.read_ap_locations(spark, str(path)).collect()
        assert [(r.bssid, r.name, r.lat, r.lng) for r in got] == [("a", "one", 1.5, 2.0)]
    assert inventory.read_ap_locations(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("no json")
    assert inventory.read_ap_locations(spark, str(tmp_path / "bad.json")).count() == 0


def test_analysis_columns():
    names = ["frame.len", "frame.number", "wlan.sa", "wlan.fc.type", "eapol.type", "tcp.port", "wlan_radio.start_tsf", "Label"]
    assert capture.analysis_columns(names) == ["frame.len", "wlan.fc.type", "Label"]
    assert capture.excluded_columns(["wlan.sa", "frame.len"]) == [("wlan.sa", spec.BANNED_COLUMNS["wlan.sa"])]
    with pytest.raises(ValueError):
        capture.require_no_excluded(["wlan.sa"])


def test_shards_must_hold_one_block(spark):
    df = spark.createDataFrame([("f1", "a"), ("f1", "a"), ("f2", "a"), ("f2", "b")], "_shard string, block_id string")
    assert [r["_shard"] for r in shards.shard_integrity(df).collect()] == ["f2"]
    with pytest.raises(ValueError):
        shards.assert_single_block(df)
