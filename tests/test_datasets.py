"""Splits, sampling, statistics, metrics and profiles against plain Python."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.operators import dataset, metrics, quality
from wlanlake.plans import training
from wlanlake.sources import shards


def counts_table(spark, counts):
    schema = "block_id string, " + ", ".join(f"c{i} bigint" for i in range(9))
    return spark.createDataFrame([(b, *c) for b, c in counts.items()], schema)


def block_hash(block, seed=0):
    return hashlib.md5(f"{seed}:{block}".encode()).hexdigest()[:15]


def rarest(counts):
    """(rows, id) of each block's rarest attack class, or None."""
    totals = [sum(c[i] for c in counts.values()) for i in range(9)]
    return {b: min(((totals[i], i) for i in range(1, 9) if c[i]), default=None) for b, c in counts.items()}


def split_plainly(counts, shares):
    groups = {}
    for b, found in rarest(counts).items():
        g = found[1] if found else 0
        groups.setdefault(g, []).append((counts[b][g], b))
    out = {}
    for blocks in groups.values():
        blocks.sort()
        out[blocks.pop()[1]] = "train"
        if blocks:
            out[blocks[0][1]] = "test" if len(blocks) == 1 else "val"
        rest = sorted(blocks[1:], key=lambda x: block_hash(x[1]))
        total, before = sum(n for n, _ in rest), 0
        for k, (n, b) in enumerate(rest):
            at = (before + n / 2) / total
            before += n
            if k == 0 or shares["train"] <= at < shares["train"] + shares["test"]:
                out[b] = "test"
            else:
                out[b] = "train" if at < shares["train"] else "val"
    return out


def select_plainly(counts, most):
    rare = rarest(counts)
    used, out = 0, set()
    for b in sorted(counts, key=lambda b: (rare[b] is None, rare[b] and rare[b][0], -sum(counts[b][1:]), block_hash(b))):
        if not out or used + sum(counts[b]) <= most:
            out.add(b)
            used += sum(counts[b])
    return out


def block_counts(seed=2, n=40):
    rng = np.random.default_rng(seed)
    out = {}
    for b in range(n):
        row = [int(rng.integers(100, 1000))] + [0] * 8
        for i in rng.choice(range(1, 9), size=2, replace=False):
            row[i] = int(rng.integers(1, 300)) + b * 1000
        out[f"b{b:03d}"] = row
    return out


def test_grouped_split_follows_the_rule(spark):
    counts = block_counts()
    got = {r.block_id: r.split for r in dataset.split_by_rarest(counts_table(spark, counts)).collect()}
    assert got == split_plainly(counts, dataset.FRACTIONS)
    # One block moves, as it closes a gap of a class that is nowhere the rarest.
    final = {r.block_id: r.split for r in dataset.grouped_split(counts_table(spark, counts)).collect()}
    assert sum(final[b] != got[b] for b in got) == 1


def test_split_is_near_its_fractions_and_holds_every_class(spark):
    counts = {f"b{b}": [1000] + [(b % 8 == i) * 50 for i in range(8)] for b in range(800)}
    got = {r.block_id: r.split for r in dataset.grouped_split(counts_table(spark, counts)).collect()}
    assert got == split_plainly(counts, dataset.FRACTIONS)
    for i in range(8):
        n = Counter(got[f"b{b}"] for b in range(i, 800, 8))
        assert abs(n["train"] - 60) <= 3 and abs(n["val"] - 15) <= 3 and abs(n["test"] - 25) <= 3


def test_rare_class_goes_to_train_then_test(spark):
    counts = {f"n{i}": [1000] + [0] * 8 for i in range(6)}
    counts |= {"r1": [10, 0, 0, 0, 0, 7, 0, 0, 0], "r2": [10, 0, 0, 0, 0, 5, 0, 0, 0]}
    got = {r.block_id: r.split for r in dataset.grouped_split(counts_table(spark, counts)).collect()}
    assert got["r1"] == "train" and got["r2"] == "test"


def test_no_class_of_three_blocks_misses_a_split(spark):
    """Classes that are nowhere the rarest: the first placement leaves them out of a split."""
    first = {"X": [0, 10, 50] + [0] * 6, "Y": [0, 0, 70] + [0] * 6, "Z": [0, 0, 60] + [0] * 6}
    chained = {f"b{i}": [100] + [20 + i if j in (i % 8, (i + 1) % 8) else 0 for j in range(8)] for i in range(9)}
    rng = np.random.default_rng(3)
    mixed = {f"m{i}": [int(n) for n in rng.integers(0, 40, 9) * (rng.random(9) < 0.25)] for i in range(14)}
    for counts in (first, chained, mixed):
        table = counts_table(spark, counts)
        split = dataset.grouped_split(table)
        assert {r.block_id for r in split.collect()} == set(counts)
        for r in dataset.split_coverage(table, split).collect():
            assert r.splits == min(3, r.blocks), (r, counts)
    assert dataset._closing_moves(counts_table(spark, first), dataset.split_by_rarest(counts_table(spark, first)))


def test_select_blocks_takes_rare_classes_first_and_whole_blocks(spark):
    counts = {"a": [500] + [0] * 8, "b": [100, 5] + [0] * 7, "c": [100, 0, 50] + [0] * 6, "d": [300, 0, 40] + [0] * 6}
    table = counts_table(spark, counts)
    assert {r.block_id for r in dataset.select_blocks(table, None).collect()} == set(counts)
    # b (rarest) and c fit, d does not any more, a neither.
    assert {r.block_id for r in dataset.select_blocks(table, 300).collect()} == {"b", "c"}
    # The first block is taken even when it is too large.
    assert {r.block_id for r in dataset.select_blocks(table, 10).collect()} == {"b"}


@pytest.mark.parametrize("share", [0.1, 0.5, 0.97])
def test_select_blocks_equals_a_plain_walk(spark, share):
    counts = block_counts(seed=3, n=60) | {f"plain{i}": [50 + 7 * i] + [0] * 8 for i in range(40)}
    most = int(share * sum(map(sum, counts.values())))
    table = counts_table(spark, counts)
    assert {r.block_id for r in dataset.select_blocks(table, most).collect()} == select_plainly(counts, most)


def frame_rows(spark, n=3000, hot=0.8):
    return spark.range(n).select(
        F.col("id").alias("frame_number"),
        F.when(F.col("id") < n * hot, "hot").otherwise("cold").alias("block_id"),
        F.when(F.col("id") % 10 < 8, 0).when(F.col("id") % 10 == 8, 1).otherwise(7).alias("label"),
    )


def test_stratified_split_is_exact_per_class(spark):
    got = dataset.stratified_split(frame_rows(spark), "label")
    n = Counter((r.label, r.split) for r in got.collect())
    assert n == {(0, "train"): 1920, (0, "test"): 480, (1, "train"): 240, (1, "test"): 60, (7, "train"): 240, (7, "test"): 60}


def test_folds_are_even_per_class(spark):
    n = Counter((r.label, r.fold) for r in dataset.stratified_folds(frame_rows(spark), "label").collect())
    assert {n[(0, f)] for f in range(5)} == {480} and {n[(7, f)] for f in range(5)} == {60}


def test_shuffled_labels_are_a_permutation(spark):
    df = frame_rows(spark)
    got = dataset.shuffle_labels(df, "label")
    assert Counter(r.label for r in got.collect()) == Counter(r.label for r in df.collect())
    moved = got.join(df.withColumnRenamed("label", "old"), "frame_number").filter("label <> old").count()
    assert moved > 300 and got.select("frame_number").distinct().count() == 3000


def test_oversample_reaches_the_share_and_keeps_every_row(spark):
    df = frame_rows(spark).withColumn("binary_label", F.when(F.col("label") == 7, 1).otherwise(0))
    rows = dataset.oversample_minority(df, share=0.3).collect()
    n = Counter(r.binary_label for r in rows)
    assert n[0] == 2700 and n[1] == math.floor(2700 * (0.3 / 0.7))
    copies = Counter(r.frame_number for r in rows if r.binary_label)
    assert len(copies) == 300 and max(copies.values()) - min(copies.values()) <= 1


def test_subsample_keeps_every_attack(spark):
    df = frame_rows(spark)
    got = dataset.subsample_rows(df, 0.25)
    assert got.filter("label > 0").count() == 600
    assert 480 < got.filter("label = 0").count() < 720
    assert dataset.keep_share(df, 300) == 0.1 and dataset.keep_share(df, None) == 1.0


def test_select_windows_budget(spark):
    df = frame_rows(spark).withColumn("label", F.when(F.col("frame_number") < 200, 1).otherwise(0))
    got = dataset.select_windows(df, 16, 8, ratio=2.0, chunk=8, rows=32)
    n = Counter(r.has_attack for r in got.collect())
    assert n[False] == 2 * n[True]


def test_split_report_and_missing_blocks(spark, tmp_path):
    df = frame_rows(spark)
    split = spark.createDataFrame([("hot", "train"), ("cold", "test")], "block_id string, split string")
    got = {r["class"]: r for r in dataset.split_report(df, split).collect()}
    assert got["Deauth"].blocks == 2 and got["Deauth"].absent_from == "val"
    assert got["Normal"].train + got["Normal"].test == 2400
    shards.save_split(split, str(tmp_path / "split"))
    assert shards.load_split(spark, str(tmp_path / "split"), df).count() == 2
    with pytest.raises(ValueError):
        shards.load_split(spark, str(tmp_path / "split"), df.filter("block_id = 'hot'"))


def test_spread_sample(spark):
    blocks = spark.createDataFrame([("s", f"s:{i:04d}") for i in range(23)] + [("t", "t:0000")], "session_id string, block_id string")
    for n in (1, 4, 7, 23, 30):
        got = sorted(r.block_id for r in shards.sample_blocks_spread(blocks, n).collect() if r.session_id == "s")
        want = sorted({int(i * (23 / n)) for i in range(n)}) if n < 23 else range(23)
        assert got == [f"s:{i:04d}" for i in want]


def test_norm_stats(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (3.0, None, 5.0), (None, None, 5.0)], "a double, b double, c double")
    got = {r.feature: r for r in dataset.stats_long(dataset.norm_stats(df, ["a", "b", "c"])).collect()}
    assert (got["a"]["mean"], got["a"]["std"], got["a"].can_be_absent) == (2.0, 1.0, True)
    assert (got["b"]["mean"], got["b"]["std"], got["b"].can_be_absent) == (0.0, 1.0, True)
    assert (got["c"]["mean"], got["c"]["std"], got["c"].can_be_absent) == (5.0, 1.0, False)


def test_class_weights_are_capped(spark):
    df = spark.range(20001).select(F.when(F.col("id") == 0, 5).otherwise(0).alias("label"))
    got = {r.label: r.weight for r in dataset.class_weights(df, alpha=1.0).collect()}
    assert got[5] == 100.0 and got[0] == pytest.approx(20001 / (2 * 20000))


def test_metrics_on_a_known_confusion(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(1, 0)] + [(0, 8)]
    df = spark.createDataFrame(pairs, "label int, prediction int")
    got = {r.label: r for r in metrics.per_class_metrics(df).collect()}
    assert got[1].precision == pytest.approx(3 / 5) and got[1].recall == pytest.approx(3 / 4)
    assert got[8].f1 is None and got[8].absent_false_positives == 1
    assert metrics.macro_f1(df).first()[0] == pytest.approx((2 * 5 / (10 + 1 + 3) + 6 / (6 + 2 + 1)) / 2)
    assert metrics.macro_f1(df.filter("label > 99")).first()[0] == 0.0
    matrix = {r.truth: r for r in metrics.confusion_matrix(df).collect()}
    assert (matrix[0].pred_0, matrix[0].pred_1, matrix[0].pred_8, matrix[7].pred_7) == (5, 2, 1, 0)


def test_auc_with_ties(spark):
    rng = np.random.default_rng(0)
    score = np.round(rng.random(2000), 2)
    truth = (rng.random(2000) < score).astype(int)
    df = spark.createDataFrame([(int(t), float(s)) for t, s in zip(truth, score, strict=True)], "truth int, score double")
    got = metrics.auc_report(df, "truth", "score").first()
    pos, neg = score[truth == 1], score[truth == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got.roc_auc == pytest.approx(want)
    ap, last = 0.0, 0.0
    for s in sorted(set(score), reverse=True):
        hit = truth[score >= s]
        ap, last = ap + (hit.sum() / len(pos) - last) * hit.mean(), hit.sum() / len(pos)
    assert got.average_precision == pytest.approx(ap)


def test_piled_up_scores_are_dealt_out_evenly(spark):
    x = "if(id % 100 = 0, id / 200000D, if(id % 2 = 0, 1e-6 * id / 200000D, 1 - 1e-6 * id / 200000D))"
    df = spark.range(200_000).selectExpr("cast(id % 3 = 0 as int) as truth", f"{x} as score")
    odd = spark.createDataFrame([(1, float("nan")), (0, None)], "truth int, score double")
    slices = metrics.score_points(df.unionByName(odd), "truth", "score").groupBy("slice").count().collect()
    assert len(slices) > 500 and max(r["count"] for r in slices) < 2000
    assert metrics.auc_report(df.unionByName(odd), "truth", "score").first() == metrics.auc_report(df, "truth", "score").first()


def test_best_threshold_is_the_first(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.6), (0, 0.2)], "truth int, score double")
    best = metrics.best_threshold(metrics.threshold_sweep(df, "truth", "score")).first()
    assert best.f1 == 1.0 and best.threshold == pytest.approx(0.225)


def test_overlap_and_duplicates(spark):
    a = spark.createDataFrame([(1, None)] * 3 + [(2, "x")], "a int, b string")
    b = spark.createDataFrame([(1, None), (3, "x")], "a int, b string")
    r = dataset.split_overlap(a, b, ["a", "b"]).first()
    assert (r.train_rows, r.test_rows, r.overlap) == (2, 2, 1)
    assert quality.duplicate_rows(a).first().duplicates == 2


def test_outliers_count_absent_rows_in_the_denominator(spark):
    x = [1.0, 2.0, 3.0, 4.0, 100.0, None, None, None]
    got = quality.iqr_outliers(spark.createDataFrame([(v,) for v in x], "x double"), ["x"]).first()
    assert got.outlier_pct == pytest.approx(12.5)


def test_nan_is_no_value(spark):
    nan = float("nan")
    rows = [(1.0, nan), (nan, 2.0), (3.0, 2.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    assert quality.iqr_outliers(df, ["x"]).first().outlier_pct == 0.0
    got = {r.feature: r for r in quality.column_profile(df, ["x", "y"]).collect()}
    assert (got["x"].rows, got["x"].nulls, got["x"].distinct, got["x"].mean, got["x"].max, got["x"].p50) == (3, 1, 2, 2.0, 3.0, 2.0)
    assert {(r.feature, r.x, r.n) for r in quality.top_values(df, ["x", "y"]).collect()} == {("x", 1.0, 1), ("x", 3.0, 1), ("y", 2.0, 2)}
    a, b, c = [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0, nan, 4.0, 5.0], [5.0, 4.0, 3.0, 1.0, 2.0]
    three = spark.createDataFrame(list(zip(a, b, c)), "a double, b double, c double")
    alone = {(r.a, r.b): r.rho for r in quality.spearman(three, ["a", "c"]).collect()}
    got = {(r.a, r.b): r.rho for r in quality.spearman(three, ["a", "b", "c"]).collect()}
    assert got["a", "c"] == pytest.approx(alone["a", "c"]) and got["a", "b"] == pytest.approx(1.0)


def test_large_whole_numbers_are_told_apart(spark):
    df = spark.createDataFrame([(2**53,), (2**53 + 1,), (2**53 + 1,), (None,)], "i long")
    assert quality.column_profile(df, ["i"]).first().distinct == 2
    assert [r.n for r in quality.top_values(df, ["i"]).orderBy("rank").collect()] == [2, 1]
    empty = quality.column_profile(df.filter("i is null"), ["i"]).first()
    assert (empty.rows, empty.nulls, empty.distinct, empty["mean"], empty["std"], empty.p50) == (1, 1, 0, None, None, None)


def test_coerce_mixed(spark):
    train = spark.createDataFrame([("0x10", "a"), ("2", "b"), ("3", "4"), ("4", "c"), ("5", "d")], "n string, t string")
    test = spark.createDataFrame([("x", "1")], "n string, t string")
    (a, b), numeric, text = dataset.coerce_mixed(train, [test])
    assert (numeric, text) == (["n"], ["t"])
    assert [r.n for r in a.collect()] == [10.0, 2.0, 3.0, 4.0, 5.0] and b.first().n is None


def test_categories_are_shared_and_alphabetical(spark):
    a = spark.createDataFrame([("b",), (None,)], "c string")
    b = spark.createDataFrame([("a",)], "c string")
    codes = dataset.category_table([a, b], "c")
    assert {r.category: r.code for r in codes.collect()} == {"__NA__": 0, "a": 1, "b": 2}
    assert dataset.align_categories(b, codes, "c").first().c_code == 1


def test_spearman(spark):
    rows = [(float(i), float(i**3), None if i % 2 else float(-i)) for i in range(50)]
    got = {(r.a, r.b): r.rho for r in quality.spearman(spark.createDataFrame(rows, "x double, y double, z double"), ["x", "y", "z"]).collect()}
    assert got[("x", "y")] == pytest.approx(1.0) and got[("x", "z")] == pytest.approx(-1.0) and got[("z", "z")] == 1.0


def test_contract_faults_are_all_told(spark):
    columns = ["frame_len", "fc_type", "fc_ds"]
    good = spark.createDataFrame([(1.0, 2.0, 3.0, 0)], "frame_len float, fc_type float, fc_ds float, label int")
    assert training.contract_check(good, columns).count() == 0
    bad = spark.createDataFrame([(1.0, float("nan"), 9)], "fc_type double, frame_len float, label int")
    kinds = Counter(r.kind for r in training.contract_check(bad, columns).collect())
    assert kinds == {"count": 1, "missing": 1, "type": 1, "class id": 1, "nan": 1}
    swapped = good.select("fc_type", "frame_len", "fc_ds", "label")
    assert [r.kind for r in training.contract_check(swapped, columns).collect()] == ["order"]
    with pytest.raises(ValueError):
        training.require_contract(swapped, columns)


def test_without_validation_rows_one_size_has_to_be_given(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0)], "label int, signal float")
    with pytest.raises(ValueError, match="no validation rows"):
        training.train_multiclass(rows, None, ["signal"], trees=[5, 10])


def test_training_learns_a_simple_rule_and_loses_it_on_shuffled_labels(spark):
    df = spark.range(1200).select(
        F.col("id").alias("frame_number"), F.lit("b").alias("block_id"),
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 3 == 1, 1).otherwise(8).alias("label"),
        F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("float")).alias("signal"),
        (F.col("id") % 7).cast("float").alias("noise"),
    )
    train, test = df.filter("frame_number % 4 > 0"), df.filter("frame_number % 4 = 0")
    fitted = training.train_multiclass(train, None, ["signal", "noise"], trees=[5], depth=4)
    assert training.score_of(training.predict(fitted, test)) == pytest.approx(1.0)
    assert training.top_features(fitted, 1) == ["signal"]
    probs = training.predict(fitted, test).first().probability
    assert len(probs) == len(spec.CLASSES)
    check = {r.labels: r.macro_f1 for r in training.shuffled_label_check(train, test, ["signal", "noise"], trees=[5], depth=4).collect()}
    assert check["true labels"] > 0.99 and check["shuffled labels"] < 0.6


def test_boosted_classes_and_their_bundle(spark, tmp_path):
    names = ["signal", "noise"]
    rows = spark.range(600).selectExpr(
        "id", "float(pmod(hash(id), 3)) as signal", "float(pmod(hash(id, 7), 11)) as noise", "cast(pmod(hash(id), 3) as int) as label"
    )
    train, val = rows.filter("id % 3 > 0"), rows.filter("id % 3 = 0")
    # A class that training never saw is no reason to lose its validation rows.
    val = val.withColumn("label", F.expr("if(id = 0, 8, label)"))
    fitted = training.train_boosted(train, val, names, rounds=4, depth=2)
    losses = [x for _, x in fitted.history]
    assert len(losses) > 1 and all(a > b for a, b in zip(losses, losses[1:]))
    out = training.predict(fitted, train).collect()
    assert all(len(r.probability) == training.N_CLASSES and sum(r.probability) == pytest.approx(1) for r in out)
    assert all(r.prediction == r.label for r in out)
    assert sorted(fitted.model.models) == [0, 1, 2] and all(r.probability[8] == 0 for r in out)
    assert training.top_features(fitted, 1) == ["signal"]

    path = training.save_bundle(fitted, str(tmp_path / "bundle"))
    again, cuts = training.load_bundle(spark, path, names)
    assert cuts == (spec.STAGE1_THRESHOLD, spec.STAGE2_THRESHOLD) and again.history == fitted.history
    assert [r.probability for r in training.predict(again, train).orderBy("id").collect()] == [
        r.probability for r in training.predict(fitted, train).orderBy("id").collect()
    ]
    with pytest.raises(training.BundleMismatch, match="column 0 is signal, not noise"):
        training.load_bundle(spark, path, names[::-1])
    with pytest.raises(training.BundleMismatch, match="lacks column third.*asks for column noise"):
        training.load_bundle(spark, path, ["signal", "third"])
    contract = training.read_contract(spark, path)
    for change in ({"classes": ["Normal"]}, {"thresholds": [0.4, 1.5]}, {"kind": "tree"}, {"models": []}, {"absent": 0.0}):
        assert len(training.bundle_faults(contract | change, names)) == 1
    assert training.bundle_faults(contract, names) == []


def test_rank_correlation_with_a_constant_column(spark):
    df = spark.createDataFrame([(1.0, 3.0, 7.0), (2.0, 2.0, 7.0), (3.0, 1.0, 7.0)], "x double, y double, k double")
    got = {(r.a, r.b): r.rho for r in quality.spearman(df, ["x", "y", "k"]).collect()}
    assert math.isclose(got["x", "y"], -1) and got["x", "x"] == 1
    assert [got["x", "k"], got["k", "y"], got["k", "k"]] == [None] * 3


def test_only_a_missing_path_counts_as_nothing(spark, tmp_path):
    assert not shards._exists(spark, str(tmp_path / "none")) and not shards._exists(spark, str(tmp_path))
    (tmp_path / "part.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception):
        shards._exists(spark, str(tmp_path))


def test_few_values_are_broadcast(spark, monkeypatch):
    rows = [(float(i % 3), float((i * 7919) % 101), None if i % 9 == 0 else float(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    columns, hints, plain = ["x", "y", "z"], [], quality.F.broadcast
    monkeypatch.setattr(quality.F, "broadcast", lambda d: hints.append(d.columns) or plain(d))

    def found(few):
        monkeypatch.setattr(quality, "FEW_VALUES", few)
        hints.clear()
        got = {(r.a, r.b): round(r.rho, 9) for r in quality.spearman(df, columns).collect()}
        return got, {c for names in hints for c in names if c.startswith("_x_")}

    dealt, none = found(0)
    mixed, few = found(10)
    assert none == set() and few == {"_x_x", "_x_z"}
    assert dealt == mixed and len(mixed) == 9
