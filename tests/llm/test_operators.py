"""The training-data operators: edge cases, and results against brute force or SQL on small tables."""

import collections
import hashlib
import itertools
import math
import os
import re
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

import corpus_pipeline
from verify import connect, rows_of
from wlanlake.llm import common, language, line_crf, packing, pairwise_quality, parity_join, rans, warc
from wlanlake.llm.components import components
from wlanlake.llm.exact_dedup import exact_dedup
from wlanlake.llm.licenses import scan_licenses
from wlanlake.llm.mixing import mix_sources
from wlanlake.llm.pairwise_quality import rank_quality
from wlanlake.llm.parity_join import near_duplicates
from wlanlake.llm.queries import ORACLES, QUERIES
from wlanlake.llm.textstats import text_stats
from wlanlake.llm.tokens import WordEncoder, default_path

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CLASHING = ["kept", "size", "node", "salt", "digest", "content", "rank", "_key", "label", "_mark", "row", "x"]
DOCS = StructType(
    [StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())]
    + [StructField("source", StringType()), StructField("n_chars", LongType())]
)
LONG = " ".join(f"word{k % 977} the of and" for k in range(30_000))
ROWS = [
    (1, "The same text of a few words, once more.\nAnd a line.", "en", "a", 1),
    (2, "THE SAME text of a few words, once more.\nAnd a line.", "en", "a", 1),
    (2, "THE SAME text of a few words, once more.\nAnd a line.", "en", "a", 1),
    (3, "", "en", "b", 0),
    (4, None, None, None, None),
    (None, "a text whose id is not known at all", "xx", "b", 3),
    (None, None, None, None, None),
    (5, LONG, "en", "b", 9),
    (6, "  \n\t ", "fr", "", 5),
    (7, "été où ça naïve ß ÀÉÎ ẖ H̱ İ <|endoftext|> <|EndOfText|> it's 12,5 %&$", "fr", "c", 5),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty, very long, equal and repeated rows, and columns with names that operators use inside."""
    df = spark.createDataFrame(ROWS, DOCS)
    return df.withColumns({c: F.lit("?") for c in CLASHING})


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (7, 0, None), (None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = connect(SF_DIR).execute(ORACLES[name])
    assert got == rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_exact_dedup_edges(docs, nothing):
    rows = exact_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [r["keep_id"] for r in by[1]] == [2] and by[1][0]["group_size"] == 3
    assert sorted(r["kept"] for r in by[2]) == [False, True]
    assert by[3][0]["keep_id"] == by[4][0]["keep_id"] == 4 and by[4][0]["group_size"] == 3
    assert exact_dedup(nothing).count() == 0


def test_exact_dedup_tells_texts_of_one_digest_apart(docs):
    plain = {tuple(r) for r in exact_dedup(docs).collect()}
    assert {tuple(r) for r in exact_dedup(docs, digest=F.substring("text_sha256", 1, 1)).collect()} == plain
    assert {tuple(r) for r in exact_dedup(docs, digest=F.lit("same")).collect()} == plain


def brute_components(rows):
    sets, low = [], []
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
        low.append(doc)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i in range(len(rows)):
        least[find(i)].append(low[i])
    known = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return collections.Counter(
        (low[i], len(sets[i]), known[find(i)] if sets[i] else low[i]) for i in range(len(rows))
    )


def test_near_duplicates_equal_brute_force(spark, docs, documents, nothing):
    cases = documents.select("doc_id", "text").collect()
    # Chains of small and of large texts, each step a few words on, and one group that shares a passage.
    rng = np.random.default_rng(5)
    at = 10_000
    for size in (4, 9, 30, 66, 90, 300, 700):
        words = [f"w{rng.integers(10**9)}" for _ in range(size)]
        for _ in range(12):
            cases.append((at, " ".join(words)))
            at += 1
            for k in rng.integers(size, size=max(1, size // 120)):
                words[k] = f"w{rng.integers(10**9)}"
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(40):
        cases.append((at + k, passage + " " + " ".join(f"q{rng.integers(10**9)}" for _ in range(60))))
    df = spark.createDataFrame([(r[0], r[1]) for r in cases], "doc_id long, text string")
    for options in ({}, {"small_group": 3, "block": 16}):
        got = near_duplicates(df, **options).select("doc_id", "n_shingles", "component_id").collect()
        assert collections.Counter(map(tuple, got)) == brute_components([(r[0], r[1]) for r in cases])
    got = near_duplicates(docs)
    assert collections.Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == brute_components(
        [(r[0], r[1]) for r in ROWS]
    )
    assert near_duplicates(nothing).count() == 0


def test_components_of_long_paths(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)}


def test_word_encoder_equals_the_tokenizer(documents):
    from tokenizers import Tokenizer

    texts = [r["text"] or "" for r in documents.select("text").collect()] + [r[1] or "" for r in ROWS]
    texts += ["don't they'LL A'B \x85 x y z", "É́ é ǅ ﬁ ½ ١٢", "…—«»", "a\x00b \x1f c", "<|startoftext|>a<|endoftext|>"]
    whole = Tokenizer.from_file(default_path())
    for encoder in (WordEncoder(default_path()), WordEncoder(default_path(), most=50, at_once=100)):
        for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def whole_ids(rows):
    got = WordEncoder(default_path()).encode([(t or "").encode() for _, t in rows])
    return [(doc, ids + np.array([2], "<u4").tobytes()) for (doc, _), ids in zip(rows, got)]


def test_packing_places_every_id_once(docs, documents, nothing):
    for df in (docs, documents):
        rows = packing.pack(df).collect()
        want = collections.Counter()
        for doc, ids in whole_ids([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]):
            for at in range(0, len(ids), 4 * 4096):
                part = ids[at : at + 4 * 4096]
                want[(doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4)] += 1
        assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == want
        full = collections.defaultdict(list)
        for r in rows:
            full[r["sequence_id"]].append((r["offset"], r["length"]))
        for pieces in full.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
            assert end <= 4096
    assert packing.pack(nothing).count() == 0


def test_packing_plan_holds_every_item_with_little_room_left():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(3.6, 0.9, 20_000).astype(int) + 1, 1, 256)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(sizes, return_counts=True))}
    plan = packing.packing_plan(histogram, 256)
    held = collections.Counter()
    for pattern, times in plan:
        assert sum(s * n for s, n in pattern.items()) <= 256
        for s, n in pattern.items():
            held[s] += n * times
    assert held == histogram
    assert sum(t for _, t in plan) <= 1.005 * sizes.sum() / 256 + 2
    assert packing.packing_plan({}, 256) == [] and packing.packing_plan({256: 3}, 256) == [({256: 1}, 3)]


@pytest.mark.parametrize("n", [0, 1, 5, 256, 257, 5000])
@pytest.mark.parametrize("kinds", [1, 2, 3000])
def test_rans_round_trip_and_checkpoints(n, kinds):
    rng = np.random.default_rng(n + kinds)
    ids = np.minimum(rng.geometric(0.01, n) - 1, kinds - 1).astype(np.uint32)
    table = rans.Table(rans.scaled(np.bincount(np.concatenate([ids, [0]]), minlength=kinds)))
    raw = rans.block_bytes([7], ids, [n], table, 0, 0, lanes=16, stride=8) + b"\n"
    (block,) = rans.read_blocks(raw)
    assert np.array_equal(block.ids(table), ids)
    parts = [block.part(k, table) for k in range(len(block.states))]
    assert np.array_equal(np.concatenate(parts) if parts else np.zeros(0), ids)
    if n > 100:
        damaged = bytearray(raw)
        damaged[-10] ^= 1
        with pytest.raises(ValueError):
            list(rans.read_blocks(bytes(damaged)))


def test_token_files_round_trip(docs, documents, nothing):
    for df in (docs, documents):
        rows = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0]))
        got = sorted(rans.token_files(df, block_tokens=500, file_tokens=20_000).collect(), key=lambda r: r["start"])
        start = 0
        for r in got:
            assert r["start"] == start
            start += r["n_tokens"]
        assert [r["doc_id"] for r in got] == [r["doc_id"] for r in rows]
        want = collections.Counter((doc, len(ids) // 4, zlib.crc32(ids)) for doc, ids in whole_ids(rows))
        assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert rans.token_files(nothing).count() == 0


def test_mixture_edges(docs, nothing):
    rows = mix_sources(docs).collect()
    assert len(rows) == len(ROWS)
    taken, target = collections.Counter(), {}
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(taken[s] == int(t) for s, t in target.items())
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs).collect()))
    assert all(r["taken"] in {k * r["size"] for k in range(4)} for r in mix_sources(docs, whole=True).collect())
    assert mix_sources(nothing).count() == 0


def base_figures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    found = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    in_repeat = {j for i in range(len(w) - 4) if found[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    failed = len(w) < 10 or 100 * len(in_repeat) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(in_repeat), failed


def test_line_quality(spark, docs, labels, documents, nothing):
    known = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    for df, told in ((docs, labels), (documents, known)):
        rows = line_crf.line_quality(df, told).collect()
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
        got = collections.Counter((r["doc_id"], *[r[c] for c in names]) for r in rows)
        want = collections.Counter((r["doc_id"], *base_figures(r["text"])) for r in df.select("doc_id", "text").collect())
        assert got == want
        assert not any(r["kept"] and r["base_failed"] for r in rows)
    good = {r["doc_id"]: r["quality"] for r in known.collect()}
    right = [r["kept"] == bool(good[r["doc_id"]]) for r in rows if r["doc_id"] in good and not r["base_failed"]]
    assert np.mean(right) > 0.9
    assert line_crf.line_quality(nothing, labels).count() == 0
    assert line_crf.line_quality(docs, labels.limit(0)).count() == len(ROWS)


def plant(spark, folder):
    """Texts of label 1 with four lines of a text of label 0 behind their fourth line, and the true state of each line."""
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows = documents.select("doc_id", "text").join(known, "doc_id").filter("text <> ''").orderBy("doc_id").collect()
    good = [r["text"].split("\n") for r in rows if r["quality"] == 1 and r["text"].count("\n") > 6]
    bad = [r["text"].split("\n")[:4] for r in rows if r["quality"] == 0 and r["text"].count("\n") > 3]
    chains = [(line_crf.line_features(text_stats([r["text"].encode()])), r["quality"]) for r in rows]
    planted = [("\n".join(g[:4] + b + g[4:]), [1] * 4 + [0] * 4 + [1] * (len(g) - 4)) for g, b in zip(good, bad)]
    return chains, planted


def test_boilerplate_inside_of_content_is_found_line_by_line(spark):
    # The smallest tables have too few labelled texts to plant in.
    chains, planted = plant(spark, "/root/testdata/sf0.01")
    assert len(planted) > 20
    model = line_crf.fit_lines(chains)
    wrong = lines = 0
    for text, truth in planted:
        states = model.viterbi(line_crf.line_features(text_stats([text.encode()])))
        assert 0 < states.mean() < 1
        wrong += int((states != np.array(truth)).sum())
        lines += len(truth)
    assert wrong <= 0.1 * lines


def test_kept_equals_the_words_on_the_best_path(spark, docs, labels, monkeypatch):
    rng = np.random.default_rng(11)
    fixed = line_crf.LineModel(rng.normal(size=(14, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    monkeypatch.setattr(line_crf, "fit_lines", lambda chains: fixed)
    got = {(r["doc_id"], r["n_lines"], r["n_words"]): r for r in line_crf.line_quality(docs, labels).collect()}
    tried = 0
    for row in docs.select("doc_id", "text").collect():
        stats = text_stats([(row["text"] or "").encode()])
        x = line_crf.line_features(stats)
        if not 1 <= len(x) <= 8:
            continue

        def worth(path):
            moves = sum(fixed.move[a, b] for a, b in zip(path, path[1:]))
            return fixed.start[path[0]] + moves + sum((x @ fixed.emit)[t, s] for t, s in enumerate(path))

        best = max(itertools.product((0, 1), repeat=len(x)), key=worth)
        words = stats.lines["words"]
        share = float((words * np.array(best)).sum() / max(words.sum(), 1))
        r = got[(row["doc_id"], len(x), int(words.sum()))]
        assert r["content_share"] == pytest.approx(share) and r["n_content_lines"] == sum(best)
        assert r["kept"] == (not r["base_failed"] and share >= 0.5)
        tried += 1
    assert tried > 3


def test_gradient_of_the_marginal_likelihood():
    """Against differences of the likelihood summed over all paths."""
    rng = np.random.default_rng(5)
    n, width, mark = 4, 3, 1.2
    x, y = rng.normal(size=(1, n, width)), np.array([[0, 1, 1, 0]])
    x[0, :, line_crf.NO_WORDS] = [0, 0, 1, 0]
    weights = [rng.normal(size=(width, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)]

    def loss(emit, move, start):
        def total(bonus):
            worth = []
            for path in itertools.product((0, 1), repeat=n):
                v = start[path[0]] + sum(move[a, b] for a, b in zip(path, path[1:]))
                v += sum((x[0] @ emit)[t, s] for t, s in enumerate(path))
                worth.append(v + bonus * sum(path[t] == y[0, t] and x[0, t, line_crf.NO_WORDS] == 0 for t in range(n)))
            return np.logaddexp.reduce(worth)

        return total(0.0) - total(mark)

    got = line_crf._gradient(x, np.ones((1, n)), y, mark, *weights)
    for k, w in enumerate(weights):
        for at in np.ndindex(w.shape):
            up, down = [v.copy() for v in weights], [v.copy() for v in weights]
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert got[k][at] == pytest.approx((loss(*up) - loss(*down)) / 2e-5, abs=1e-5)


def test_a_hash_sample_is_the_smallest_keys(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "id % 7 as x")
    got = [r["doc_id"] for r in common.hash_sample(rows, 200, "doc_id", seed="s", ties=("x",)).collect()]
    want = sorted(range(5000), key=lambda i: hashlib.md5(f"s:{i}".encode()).hexdigest())[:200]
    assert sorted(got) == sorted(want)
    assert common.hash_sample(rows, 9000, "doc_id", seed="s").count() == 5000
    assert common.hash_sample(rows.limit(0), 5, "doc_id", seed="s").count() == 0


def test_scores_equal_weights_added_one_by_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    model = pairwise_quality.fit_pairs(x, y)
    for row, score in zip(x[:40], model.score(x[:40])):
        raw = sum(w[sum(v >= e for e in edges)] for v, edges, w in zip(row, model.edges, model.weights))
        z = model.slope * (raw - model.cut) + math.log(0.3 / 0.7)
        assert score == pytest.approx(1 / (1 + math.exp(-z)))
    assert (model.score(x) >= 0.3).mean() == pytest.approx(y.mean(), abs=0.02)


def test_short_texts_leave_little_room(spark):
    short = spark.range(3000).selectExpr("id as doc_id", "'the cat sat on a mat' as text")
    rows = packing.pack(short).agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("ids")).first()
    assert rows["n"] <= -(-rows["ids"] // 4096) + 1
    assert packing.rounding({7: 3000}, 4096, 0.015) == 1 and packing.rounding({4096: 5}, 4096, 0.015) == 16


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    model = line_crf.LineModel(rng.normal(size=(4, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for n in (1, 2, 7):
        x = rng.normal(size=(n, 4))
        scores = x @ model.emit

        def worth(path):
            moves = sum(model.move[a, b] for a, b in zip(path, path[1:]))
            return model.start[path[0]] + moves + sum(scores[t, s] for t, s in enumerate(path))

        paths = [[(k >> t) & 1 for t in range(n)] for k in range(2**n)]
        assert list(model.viterbi(x)) == max(paths, key=worth)


def test_rank_quality(spark, docs, labels, documents, nothing):
    rows = rank_quality(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    known = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = rank_quality(documents, known).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    good = {r["doc_id"]: r["quality"] for r in known.collect()}
    tested = [(r["score"], good[r["doc_id"]]) for r in rows if r["doc_id"] in good and r["held_out"]]
    ones, zeros = [s for s, y in tested if y], [s for s, y in tested if not y]
    assert np.mean([[a > b for b in zeros] for a in ones]) > 0.85
    # Labels of held-out rows change nothing.
    turned = known.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(map(tuple, rank_quality(documents, turned).collect())) == sorted(map(tuple, rows))
    assert rank_quality(nothing, labels).count() == 0
    assert len({r["score"] for r in rank_quality(docs, labels.limit(0)).collect()}) == 1


def test_rank_quality_learns_from_every_label(spark):
    # Texts with a mark, all of label 0, are those of the last hashes: the first 20,000 rows have none.
    ids = [i for i in range(30000) if zlib.crc32(str(i).encode()) % 5]
    marked = sorted(ids, key=lambda i: hashlib.md5(f"rank:{i}".encode()).hexdigest())[20000:]
    assert len(marked) > 3000
    kinds = spark.createDataFrame([(i,) for i in marked], "doc_id long").withColumn("marked", F.lit(True))
    rows = spark.range(30000).withColumnRenamed("id", "doc_id").join(kinds, "doc_id", "left")
    texts = rows.selectExpr("doc_id", "if(marked, 'alpha beta gamma!', 'alpha beta gamma') as text")
    told = rows.selectExpr("doc_id", "if(marked or doc_id % 10 = 0, 0, 1) as quality")
    scores = rank_quality(texts, told).join(kinds, "doc_id", "left").groupBy("marked").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    got = {r["marked"]: r for r in scores.collect()}
    assert got[True]["high"] < 0.3 <= got[None]["low"]


def test_every_row_is_in_a_pair(spark):
    for n_bad in (1, 5, 60):
        rows = [(i, int(i >= n_bad), bytes([i])) for i in range(100)]
        binned = spark.createDataFrame(rows, "doc_id long, label int, bins binary")
        pairs = pairwise_quality.preference_pairs(binned, 100 - n_bad, n_bad, 8).collect()
        assert len(pairs) == pairwise_quality.pairs_of(100 - n_bad, n_bad, 8) == {1: 99, 5: 95, 60: 320}[n_bad]
        assert {p["bad"][0] for p in pairs} == set(range(n_bad))
        assert {p["good"][0] for p in pairs} == set(range(n_bad, 100))


def test_column_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=1501), rng.integers(5, size=1501).astype(float)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = pairwise_quality.column_quantiles(df, ["a", "b"], [0.0, 0.07, 0.5, 0.91, 1.0])
    for name, x in (("a", a), ("b", b)):
        assert got[name] == pytest.approx(np.quantile(x, [0.0, 0.07, 0.5, 0.91, 1.0]))


def test_language_evidence(spark, docs, documents, nothing):
    rows = language.identify_documents(docs).collect()
    assert len(rows) == len(ROWS)
    assert {r["doc_id"] for r in rows if r["lang"] == "und"} == {3, 4, 6, None}
    assert not any(r["kept"] for r in rows if r["lang"] == "und")
    assert language.identify_documents(nothing).count() == 0
    found = {r["doc_id"]: r for r in language.identify_documents(documents).collect()}
    right = [found[r["doc_id"]]["lang"] == r["lang"] for r in documents.collect()]
    assert np.mean(right) > 0.97 and all(r["kept"] for r in found.values())
    pages = spark.createDataFrame(
        [(1, "http://a.example.de/x", "<html lang='de'><script>the of and</script>der die das und nicht</html>"), (2, None, None), (3, "::", "")],
        "page_id long, url string, html string",
    )
    got = {r["page_id"]: r for r in language.identify(documents, pages).filter("page_id is not null").collect()}
    assert got[1]["lang"] == "de" and got[2]["lang"] == got[3]["lang"] == "und"


def test_a_weak_text_follows_its_host_and_declaration(spark):
    rows = [(k, "abab", "aa", "one.org", "org") for k in range(50)] + [(k, "cdcd", "bb", "two.org", "org") for k in range(50, 100)]
    rows += [(100, "ac", None, "one.org", "org"), (101, "ac", None, "two.org", "org"), (102, "ac", "bb", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    model = language.fit_trigrams(df.filter("doc_id < 100"), ("aa", "bb"), "doc_id", "text", "declared")
    got = {r["doc_id"]: r["lang"] for r in language.fuse_languages(df, model, ("aa", "bb")).collect()}
    assert (got[100], got[101], got[102]) == ("aa", "bb", "bb")


def test_languages_come_from_the_table_and_other_texts_are_rejected(spark, documents):
    strange = {
        "pl": "Litwo, Ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił",
        "nl": "De regering heeft gisteren besloten dat de nieuwe wet aan het einde van het jaar zal worden ingevoerd",
        "zh": "政府昨天决定新法律将于年底实施但是很多人不同意这个决定因为他们认为这不公平",
        "ru": "Правительство вчера решило что новый закон будет введен в конце года но многие люди не согласны",
        None: "qzx vkjw pqmz xxcv bnrq wplk zzqj fhgk vbnm qwrt plkj hgfd zxcv qmwn ebrv tcyx uzia opsk",
    }
    italian = "Il governo ha detto che la nuova legge sarà approvata entro la fine dell'anno, ma molti non sono d'accordo"
    rows = [(-k - 1, text, lang, "elsewhere", 0) for k, (lang, text) in enumerate(strange.items())]
    rows += [(-k - 100, f"{italian} {k}", "it-IT", "here", 0) for k in range(20)]
    df = documents.select(*DOCS.names).unionByName(spark.createDataFrame(rows, DOCS))
    assert language.declared_languages(df) == ("de", "en", "es", "fr", "it")
    got = {r["doc_id"]: r for r in language.identify_documents(df).filter("doc_id < 0").collect()}
    assert [(got[-k - 1]["lang"], got[-k - 1]["kept"]) for k in range(len(strange))] == [("other", False)] * len(strange)
    assert all(got[-k - 100]["lang"] == "it" and got[-k - 100]["kept"] for k in range(20))
    undeclared = documents.withColumn("lang", F.lit(None).cast("string"))
    assert language.identify_documents(undeclared).filter("kept or lang not in ('other', 'und')").count() == 0


def test_warc_edges(spark, tmp_path):
    rows = [(3, "http://h/a?b#c", "<p>x</p>"), (1, None, "<p>x</p>"), (1, "http://h/\r\nWARC-Type: no", "<p>x</p>")]
    rows += [(None, "bad", None), (5, "http://h", ""), (6, "http://h/é", "WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n" * 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit("?")).coalesce(1)
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(rows) and all(r["n_requests"] == r["n_metadata"] == 1 for r in got)
    seen = collections.Counter((r["metadata"]["page_id"], r["response"]["type"], r["refers_to_page"], r["response"]["payload_bytes"]) for r in got)
    assert seen == collections.Counter(
        [(3, "revisit", 1, 8), (1, "response", None, 8), (1, "revisit", 1, 8), (None, "revisit", 5, 0), (5, "response", None, 0), (6, "response", None, len(rows[5][2]))]
    )
    assert warc.archive_pages(pages.limit(0)).count() == 0
    large = warc.archive_pages(pages, revisit_from=1).filter("response.payload_bytes = 0").select("response.type").collect()
    assert [r[0] for r in large] == ["response"] * 2


def test_payloads_survive_the_archive(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    folder = corpus_pipeline.work_dir(spark, "warc-test")
    warc.write_warc(pages, folder, revisit_from=10**9)
    captures = warc.assemble(warc.read_warc(spark, folder, with_payload=True))
    got = {r["metadata"]["page_id"]: bytes(r["response"]["payload"]).decode() for r in captures.collect()}
    assert got == {r["page_id"]: r["html"] for r in pages.collect()}


def test_assembly_follows_either_direction_and_chains(spark):
    schema = warc.RECORD
    none = (None,) * 6
    rows = [("r", "response", [], *none), ("q", "request", ["r"], *none), ("m", "metadata", ["q"], *none)]
    rows += [("r2", "response", ["q2"], *none), ("q2", "request", [], *none), ("lost", "metadata", ["gone"], *none)]
    rows += [("q3", "request", ["r"], *none)]
    got = {r["capture_id"]: r for r in warc.assemble(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"r", "r2", "lost"}
    assert got["r"]["n_requests"] == 2 and got["r"]["request"]["record_id"] == "q" and got["r"]["metadata"]["record_id"] == "m"
    assert got["r2"]["request"]["record_id"] == "q2" and got["lost"]["response"] is None


def test_licences(spark, docs, nothing):
    from wlanlake.llm.licenses import KNOWN

    mit = KNOWN[0][1]
    other = mit.replace("Copyright (c) <year> <copyright holders>", "Copyright (C) 2020 Someone Else\n(c) 2021 more").upper().replace(" ", "\n  ")
    other = other.replace("COPYRIGHT\n  (C)\n  2020\n  SOMEONE\n  ELSE", "(C) 2020 SOMEONE ELSE").replace("(C)\n  2021\n  MORE", "(c) 2021")
    texts = [(1, mit), (2, other), (3, mit + " more"), (4, "prose\nReleased under the MIT licence!\n"), (5, None), (None, "Licensed under CC BY-NC 4.0.")]
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: ("MIT", ""), 3: (None, ""), 4: (None, "MIT"), 5: (None, ""), None: ("CC-BY-NC-4.0", "CC-BY-NC-4.0")}
    assert scan_licenses(docs).count() == len(ROWS) and scan_licenses(nothing).count() == 0


def test_whole_licences_titles_spellings_and_given_texts(spark):
    from wlanlake.llm import licenses

    texts = {f.stem: f.read_text("utf-8") for f in Path(licenses.__file__).with_name("license_texts").glob("*.txt")}
    mit = licenses.KNOWN[0][1].split("\n", 1)[1]
    apache, bsd = texts["Apache-2.0"], texts["BSD-3-Clause"]
    rows = [(name, text) for name, text in texts.items()]
    rows += [("MIT", mit), ("MIT", f"The MIT License (MIT)\n\n{mit}"), ("MIT", mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT"))]
    rows += [("MIT", mit.replace("sublicense", "sub-licence")), ("BSD-3-Clause", bsd.replace("HOLDER OR", "OWNER OR").replace("\n1. ", "\n* ").replace("\n2. ", "\n* ").replace("\n3. ", "\n* "))]
    rows += [("Apache-2.0", apache.replace("[yyyy] [name of copyright owner]", "2020 Someone")), ("Apache-2.0", apache[: apache.index("   APPENDIX")])]
    rows += [("Unlicense", texts["Unlicense"].replace("http:", "https:")), (None, apache + "x")]
    df = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in scan_licenses(df).collect()}
    assert [got[k] for k in range(len(rows))] == [name for name, _ in rows]
    assert all(any(a in text.lower() for a in licenses.ANCHORS) for _, text in licenses.KNOWN)
    known = licenses.known_digests(spark, spark.createDataFrame([("own", "All of this is free.")], "license string, text string"))
    own = scan_licenses(spark.createDataFrame([(1, "prose\nall of THIS is free\n")], "doc_id long, text string"), known).first()
    assert (own["license"], own["notices"]) == (None, "own")


def test_pipeline_stages(spark, docs, nothing, documents, tmp_path):
    plain = [c for c in docs.columns if c not in CLASHING]
    for at, df in enumerate((docs, nothing, documents)):
        now, names = df, plain if df is not docs else docs.columns
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before = now
            stage(spark, now, SF_DIR).write.parquet(str(tmp_path / f"{at}-{name}"))
            now = spark.read.parquet(str(tmp_path / f"{at}-{name}"))
            if k < 4:
                assert now.columns == names
            if df is documents:
                texts = [(r["doc_id"], r["text"]) for r in before.collect()]
                if name == "exact_dedup":
                    last = {}
                    for doc, text in texts:
                        key = (text or "").encode().lower()
                        last[key] = max(doc, last.get(key, -1))
                    assert sorted(r["doc_id"] for r in now.collect()) == sorted(last.values())
                if name == "ngram_jaccard_join":
                    want = {c for (d, n, c) in brute_components(texts) if n}
                    assert {r["doc_id"] for r in now.collect()} == want
        if df is nothing:
            assert now.count() == 0


def test_a_large_group_whose_hub_is_far_from_most_is_joined_in_rounds(spark, monkeypatch):
    """Near copies of one text, each with some words of its own, and texts that only share half of it."""
    from wlanlake.llm import parity_join

    rng = np.random.default_rng(8)
    base = [f"b{k}" for k in range(120)]
    cases = []
    for k in range(600):
        words = list(base)
        for at in rng.integers(120, size=2):
            words[at] = f"x{rng.integers(10**9)}"
        cases.append((k, " ".join(words)))
    for k in range(200):
        cases.append((1000 + k, " ".join(base[:60] + [f"y{rng.integers(10**9)}" for _ in range(60)])))
    offers = []
    offered = parity_join._verify

    def counted(pairs, *rest):
        got = offered(pairs, *rest)
        offers.append(got.count())
        return got

    monkeypatch.setattr(parity_join, "_verify", counted)
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = near_duplicates(df, small_group=2, block=128).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == brute_components(cases)
    # Far fewer pairs than the 180,000 of the group are compared.
    assert sum(offers) < 20 * len(cases)


def test_far_members_of_a_large_group_are_linked(spark):
    """Texts that only just link with the near copies of a group, and not with each other."""
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(400)]
    cases = []
    for k in range(60):
        words, edits = list(base), 1 if k % 3 else 11
        for at in rng.choice(400, size=edits, replace=False):
            words[at] = f"x{rng.integers(10**9)}"
        cases.append((k, " ".join(words)))
    df = spark.createDataFrame(cases, "doc_id long, text string")
    got = near_duplicates(df, small_group=2).select("doc_id", "n_shingles", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == brute_components(cases)
    bits = np.array([[0] * 16, [-(1 << 63)] * 3 + [1] * 13])
    members = pd.DataFrame(
        {"key": 1, "node": [5, 6], "n": 200, "label": [5, 6], "block": 0, "lo": 0, "hi": 0, "cursor": -(1 << 63), "bits": list(bits)}
    )
    # 16 bits apart, signs among them.
    assert parity_join._offered(members, 16)[["a", "b"]].values.tolist() == [[5, 6]]


def test_token_files_take_each_text_once(spark):
    taken = spark.sparkContext.accumulator(0)

    def text(k):
        taken.add(1)
        return f"word {k}"

    df = spark.range(50).select(F.col("id").alias("doc_id"), F.udf(text, "string").asNondeterministic()("id").alias("text"))
    got = rans.token_files(df).collect()
    assert len(got) == 50
    assert taken.value == 50


def test_ids_of_two_and_of_four_bytes():
    import pyarrow as pa

    ids = [np.array([2, 65535], "<u2").tobytes(), np.array([2, 65536], "<u4").tobytes()]
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([False, True])], ["ids", "wide"])
    assert [x.tolist() for x in rans.ids_of(batch)] == [[2, 65535], [2, 65536]]
