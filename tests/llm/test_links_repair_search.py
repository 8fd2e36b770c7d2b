"""Vector links, conversation repair and ranked search against brute force, with their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wlanlake.llm import embedding_links
from wlanlake.llm.conversations import cheapest_edits, damaged, repair_conversations
from wlanlake.llm.embedding_links import near_vectors, spanning
from wlanlake.llm.ranked_search import ranked_search, term_hashes

CLASHING = ["kept", "node", "label", "links", "tile", "a", "b", "group", "weight", "vector", "digest", "gone", "code", "copy"]
CLASHING += ["kind", "audit", "item", "shard", "rank", "score", "term", "block", "docs", "floor", "places", "best", "nth"]


def clashing(df):
    return df.withColumns({c: F.lit("?") for c in CLASHING})


def brute_links(rows, threshold=0.9):
    units = []
    for _, x in rows:
        fine = x and all(c is not None and math.isfinite(c) for c in x) and any(x)
        u = np.array(x, float) / np.abs(x).max() if fine else None
        units.append(u / np.sqrt(u @ u) if fine else None)
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, u in enumerate(units):
        for j, v in enumerate(units[:i]):
            if u is not None and v is not None and len(u) == len(v) and u @ v >= threshold:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for k, (vec, _) in enumerate(rows):
        if vec is not None:
            least[find(k)] = min(vec, least.get(find(k), vec))
    low = [least.get(find(k)) for k in range(len(rows))]
    return collections.Counter((vec, links[k], low[k], vec == low[k]) for k, (vec, _) in enumerate(rows))


@pytest.fixture(scope="module")
def vectors():
    """Noise, a tight and a loose group, a chain, and all kinds of vectors that link with nothing."""
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(size=16).tolist()) for k in range(200)]
    centre = rng.normal(size=16)
    rows += [(1000 + k, (centre + 0.03 * rng.normal(size=16)).tolist()) for k in range(120)]
    rows += [(1500 + k, (centre + 0.3 * rng.normal(size=16)).tolist()) for k in range(60)]
    x = rng.normal(size=16)
    for k in range(80):
        rows.append((2000 + k, x.tolist()))
        x = x + 0.25 * rng.normal(size=16)
    rows += [(None, rows[0][1]), (None, rows[0][1]), (3, rows[3][1]), (300, (np.array(rows[4][1]) * 8).tolist())]
    rows += [(5, None), (6, [0.0] * 16), (7, []), (8, [None] + [1.0] * 15), (9, [math.nan] * 16), (9, [math.inf] * 16), (None, None)]
    rows += [(3000, [1e200, 1e200]), (3001, [1e-200, 1e-200]), (3002, [1.0]), (3005, [-0.0, 1.0]), (3006, [0.0, 1.0])]
    return rows


@pytest.mark.parametrize("options", [{}, {"tile_rows": (32, 64), "block": 16}])
def test_vectors_equal_brute_force(spark, vectors, options):
    df = clashing(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))
    assert collections.Counter(map(tuple, near_vectors(df, **options).collect())) == brute_links(vectors)


def test_single_precision_and_empty_tables(spark, vectors):
    rows = [(v, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for v, x in vectors if not x or abs(x[0] or 0) < 1e9]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert collections.Counter(map(tuple, near_vectors(df).collect())) == brute_links(rows)
    assert near_vectors(df.limit(0)).count() == 0
    none = near_vectors(df.filter("embedding is null"))
    assert collections.Counter(map(tuple, none.collect())) == brute_links([r for r in rows if r[1] is None])


def test_tight_blocks_are_counted_without_comparison(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=12) + 0.01 * rng.normal(size=(300, 12))
    basis = embedding_links.Basis(np.eye(12), [3, 6, 12], 0.9)
    data = x.astype(np.float64).tobytes()
    tile = embedding_links.Tile(12, np.arange(300).tobytes(), np.ones(300, np.int64).tobytes(), data, basis, False, 64)
    assert embedding_links.block_links(tile, tile, 0, 1, basis, True) is None
    nodes, links, roots = embedding_links.tile_links(tile, tile, basis, True)
    assert len(nodes) == 300 and set(links) == {299} and set(roots) == {0}


def test_steps_stop_early_and_lose_nothing():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 32)) * np.linspace(2, 0.2, 32)
    x[200:] = x[:200] + 0.2 * rng.normal(size=(200, 32))
    basis = embedding_links.Basis(np.eye(32), [4, 8, 16, 32], 0.9)
    tile = embedding_links.Tile(32, np.arange(400).tobytes(), np.ones(400, np.int64).tobytes(), x.tobytes(), basis, False, 50)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    close = np.argwhere(np.triu(u @ u.T >= 0.9, 1))
    nodes, links, _ = embedding_links.tile_links(tile, tile, basis, True)
    want = collections.Counter(close.ravel().tolist())
    assert dict(zip(nodes.tolist(), links.tolist())) == dict(want)


def test_spanning_labels_are_the_smallest_places():
    assert spanning(6, np.array([5, 4, 1]), np.array([4, 3, 2])).tolist() == [0, 1, 1, 3, 3, 3]
    assert spanning(0, np.zeros(0, int), np.zeros(0, int)).tolist() == []


SPACE = " \t\n\x0b\x0c\r"
MOVES = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NAMES = {"u": "user", "a": "assistant"}


def brute_repair(rows):
    """Damage, faults, and the best edits by dynamic programming over (cost, audit) from the last row."""
    conversations = {}
    for conv, turn, role, text in rows:
        kept = conversations.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = collections.Counter()
    for conv, kept in conversations.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.strip(SPACE)
            faults.append("b" if not bare else "d" if (role, text) in seen else "" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [role[:1] for _, role, _ in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        after = {}
        for i in range(len(kept), -1, -1):
            now = {0: (0, "", ()), 3: (0, "", ())} if i == len(kept) else {}
            for state in range(4) if i < len(kept) else ():
                ways = [(after[state][0] + 2, "D" + after[state][1], after[state][2])]
                more, text = 5 * (faults[i] == "t"), kept[i][2]
                for initial, to in MOVES[state].items() if faults[i] not in ("b", "d") else ():
                    cost, audit, lines = after[to]
                    if initial in NAMES:
                        ways.append((cost + 1 + more, "R" + audit, (f"{NAMES[initial]}:{text}", *lines)))
                    if initial == initials[i]:
                        ways.append((cost + more, "K" + audit, (f"{kept[i][1]}:{text}", *lines)))
                now[state] = min(ways)
            for _ in range(4):
                for state in range(4):
                    for initial, to in MOVES[state].items():
                        if initial in NAMES and to in now:
                            cost, audit, lines = now[to]
                            way = (cost + 5, "I" + audit, (NAMES[initial] + ":", *lines))
                            now[state] = min(now.get(state, way), way)
            after = now
        cost, audit, lines = after[0]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[(conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, sha)] += 1
    return out


def test_repair_equals_dynamic_programming(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    said = ["Yes.", "No", "ok!", " ", "", None, "a {}.", "b {}", "c{}. \n", "é?", "\x00.\x1f"]
    rows = []
    for conv in range(800):
        for turn in range(rng.choice([1, 2, 3, 5, 8, 13])):
            rows.append((conv or None, rng.choice([None, turn, turn, turn + 2, turn]), rng.choice(roles), rng.choice(said)))
            if rows[-1][3]:
                rows[-1] = (*rows[-1][:3], rows[-1][3].format(turn))
    rows += [(9999, t, ["user", "assistant"][t % 2] if t % 7 else "system", f"x{t}" + "." * (t % 3)) for t in range(500)]
    rows += [(10_000, 1, "user", "long " * 400_000 + "."), (10_000, 1, "user", "long " * 400_000 + ".")]
    df = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert collections.Counter(map(tuple, repair_conversations(damaged(df)).collect())) == brute_repair(rows)
    assert repair_conversations(damaged(df.limit(0))).count() == 0


def test_cheapest_edits_equal_all_paths():
    """Every short conversation of sound, truncated and blank rows."""

    def best(codes):
        ways = {(0, 0): {(0, "")}}
        for node in ((i, s) for i in range(len(codes) + 1) for s in (0, 1, 2, 3, 2, 3, 2)):
            for cost, audit in list(ways.get(node, ())):
                i, s = node
                if cost > 2 * len(codes):
                    continue
                steps = [((i, (2, 2, 3, 2)[s]), 5, "I")]
                if i < len(codes):
                    steps.append(((i + 1, s), 2, "D"))
                    fault, initial = codes[i] >> 4, "suao"[codes[i] & 15]
                    if fault in (0, 3):
                        more = 5 * (fault == 3)
                        steps.append(((i + 1, (2, 2, 3, 2)[s]), 1 + more, "R"))
                        if initial in MOVES[s]:
                            steps.append(((i + 1, MOVES[s][initial]), more, "K"))
                for to, more, letter in steps:
                    ways.setdefault(to, set()).add((cost + more, audit + letter))
        return min(way for state in (0, 3) for way in ways.get((len(codes), state), ()))

    kinds = [0, 1, 2, 3, 0x31, 0x32, 0x11]
    rng = random.Random(6)
    cases = [bytes(rng.choice(kinds) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6) for _ in range(60)]
    for codes in cases:
        assert cheapest_edits(codes) == best(codes)


def brute_search(docs, items, top=10):
    def terms(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)

    counted = [(doc, collections.Counter(terms(text))) for doc, text in docs]
    sizes = [sum(c.values()) for _, c in counted]
    n_docs, n_terms = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for _, c in counted for t in c)
    out = collections.Counter()
    for item, text in items:
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(terms(text)) if df[t]}
        found = []
        for (doc, c), n in zip(counted, sizes):
            m = 10 + (90 * n * n_docs) // n_terms if n else 0
            score = sum(w * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights.items() if c[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort(key=lambda f: f[:3])
        out.update((item, rank, f[3], -f[0]) for rank, f in enumerate(found[:top], 1))
    return out


DOCS = [(1, "The cat; sat on the mat."), (2, "THE CAT"), (2, "the cat"), (None, "the cat"), (3, ""), (4, None)]
DOCS += [(5, "été É ß naïve the"), (6, " ".join(f"w{k % 977} the of" for k in range(300_000))), (7, "... \x00 !!"), (8, "cat")]
DOCS += [(k, f"same words here w{k % 5}") for k in range(100, 130)]
ITEMS = [(1, "the cat"), (1, "The CAT sat"), (2, None), (None, "été W5"), (3, "nothing elsewhere"), (4, ""), (5, "Same here; w3, w4!")]


@pytest.mark.parametrize("options", [{}, {"shard_docs": 3, "block_items": 2}, {"owners": ()}, {"shard_bytes": 1}])
def test_search_equals_brute_force(spark, options):
    docs = clashing(spark.createDataFrame(DOCS, "doc_id long, text string"))
    items = clashing(spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("item_name", F.lit("?")))
    got = collections.Counter(map(tuple, ranked_search(docs, items, **options).collect()))
    assert got == brute_search(DOCS, ITEMS)


def test_search_of_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked_search(docs.limit(0), items).count() == 0
    assert ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search(docs.filter("text is null"), items).count() == 0


def test_long_texts_are_cut_between_terms():
    text = b"alpha beta,gamma " * 1000 + b"x" * 500
    (whole,) = term_hashes([text])
    parts = list(term_hashes([text], piece=100))
    assert len(parts) > 100 and np.array_equal(np.concatenate([h for _, h in parts]), whole[1])
