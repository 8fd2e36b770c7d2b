"""Quality of documents by pairwise ranking: Bradley-Terry scores, learnt from preferences between pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wlanlake.llm.common import global_rank, order_key
from wlanlake.llm.linear import one_thread
from wlanlake.llm.shingles import in_parts
from wlanlake.llm.textstats import share, text_stats
from wlanlake.llm.tokens import texts_of
from wlanlake.operators.layout import value_slices
from wlanlake.session import store

THRESHOLD = 0.3
#: parts in which a pair's gradient and curvature are counted; and pairs whose differences are held at once
SCALE = 1 << 24
PAIRS_AT_ONCE = 4096


def text_features(texts: list[bytes]) -> np.ndarray:
    """A row of figures for each text; no figure depends on its length alone but the first."""
    s = text_stats(texts)
    n, chars = s.n_words, s.word_chars
    lines = np.diff(s.line_begin)
    return np.stack(
        [
            np.log1p(n),
            share(chars, n),
            share(s.distinct_words, np.sqrt(np.maximum(n, 1)) * 4),
            share(s.twins, n),
            share(s.n_repeat_words, n),
            share(s.n_symbols, chars),
            share(s.sums["upper"], s.sums["letters"]),
            share(s.sums["digits"], chars),
            share(s.sums["bangs"], n),
            share(s.sums["bars"], n),
            share(s.sums["stops"], n),
            share(s.n_dup_lines, lines),
            share(n, lines),
            share(s.sums["letters"], chars),
        ],
        axis=1,
    ).astype(float)


@dataclass
class RankModel:
    """Weights by feature and quantile bin; ``cut`` is the score that gets THRESHOLD, ``slope`` its steepness."""

    edges: list[np.ndarray]
    weights: list[np.ndarray]
    cut: float = 0.0
    slope: float = 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((w[np.searchsorted(e, x[:, k], "right")] for k, (e, w) in enumerate(zip(self.edges, self.weights))), np.zeros(len(x)))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Conjugate gradients for a positive definite matrix; no threaded library, which can hang beside a JVM."""
    x, r = np.zeros_like(b), b.copy()
    d, size = r.copy(), float((r * r).sum())
    for _ in range(4 * len(b)):
        if size < 1e-18:
            break
        turned = np.einsum("ij,j->i", a, d)
        step = size / float((d * turned).sum())
        x += step * d
        r -= step * turned
        size, before = float((r * r).sum()), size
        d = r + size / before * d
    return x


def _places(edges: list[np.ndarray]) -> np.ndarray:
    """Where the weights of each feature's bins begin, and the end of all."""
    return np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each figure, as the place of its weight among those of all features."""
    starts = _places(edges)
    return np.stack([np.searchsorted(e, x[:, k], "right") + starts[k] for k, e in enumerate(edges)], axis=1).astype("<u4")


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss over pairs, in whole parts of SCALE.

    Whole numbers have the same sum in any order, so the fit does not depend on how pairs are dealt to tasks.
    """
    n = len(w)
    gradient, curve = np.zeros(n, np.int64), np.zeros((n, n), np.int64)
    rows = np.arange(PAIRS_AT_ONCE)[:, None]
    for k in range(0, len(good), PAIRS_AT_ONCE):
        one, other = good[k : k + PAIRS_AT_ONCE], bad[k : k + PAIRS_AT_ONCE]
        difference = np.zeros((len(one), n))
        difference[rows[: len(one)], one] += 1
        difference[rows[: len(one)], other] -= 1
        p = 1 / (1 + np.exp(w[one].sum(axis=1) - w[other].sum(axis=1)))
        with one_thread():
            gradient += (np.rint(p * SCALE) @ difference).astype(np.int64)
            curve += (difference.T @ (difference * np.rint(p * (1 - p) * SCALE)[:, None])).astype(np.int64)
    return gradient, curve


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], pairs: int, n: int, penalty: float) -> np.ndarray:
    """Weights at which the penalised mean loss of ``pairs`` pairs is least; ``sums`` is ``pair_sums`` over all of them."""
    w = np.zeros(n)
    for _ in range(25):
        gradient, curve = (s / (SCALE * pairs) for s in sums(w))
        step = _solve(curve + penalty * np.eye(n), gradient - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _without_order(n_bad: int, n: int) -> RankModel:
    """The model where labels of one kind, or none, leave no pairs: all scores are equal."""
    return RankModel([], [], cut=-np.log(4) if n == 0 or n_bad < n - n_bad else np.log(4))


def _model(edges: list[np.ndarray], w: np.ndarray) -> RankModel:
    starts = _places(edges)
    return RankModel(edges, [w[a:b] for a, b in zip(starts[:-1], starts[1:])])


def fit_pairs(x: np.ndarray, y: np.ndarray, bins: int = 12, pairs_each: int = 8, penalty: float = 1e-3, seed: int = 7) -> RankModel:
    """The model of figures and labels that are in memory; see ``fit_all`` for tables."""
    n_bad = int((y == 0).sum())
    if n_bad in (0, len(y)):
        return _without_order(n_bad, len(y))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    of = bins_of(x, edges)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    m = min(len(good), len(bad)) * pairs_each
    drawn = np.random.default_rng(seed).integers(max(len(good), len(bad)), size=m)
    one, other = (good[drawn], np.repeat(bad, pairs_each)) if len(bad) <= len(good) else (np.repeat(good, pairs_each), bad[drawn])
    w = newton(lambda w: pair_sums(of[one], of[other], w), m, int(_places(edges)[-1]), penalty)
    model = _model(edges, w)
    model.cut = float(np.quantile(model.raw(x), n_bad / len(y)))
    return model


def column_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Exact quantiles over all rows, with linear interpolation; two numbers per column and quantile reach the driver."""
    values, slices = value_slices(df, columns)
    inside = Window.partitionBy("feature", "slice").orderBy("x")
    # At most 1024 slices per column.
    placed = values.join(F.broadcast(slices.select("feature", "slice", "before", "total")), ["feature", "slice"]).withColumn(
        "end", F.col("before") + F.sum("n").over(inside)
    )
    ends = []
    for k, q in enumerate(probs):
        at = F.lit(float(q)) * (F.col("total") - 1)
        for name, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            held = (rank >= F.col("end") - F.col("n")) & (rank < F.col("end"))
            ends.append(F.max(F.when(held, F.col("x"))).alias(f"{name}{k}"))
    found = {r["feature"]: r for r in placed.groupBy("feature").agg(F.max("total").alias("total"), *ends).collect()}

    def value(r, k: int, q: float) -> float:
        part = q * (r["total"] - 1) % 1
        return r[f"a{k}"] + (r[f"b{k}"] - r[f"a{k}"]) * part

    return {c: [value(found[c], k, q) for k, q in enumerate(probs)] for c in columns}


def preference_pairs(binned: DataFrame, n_good: int, n_bad: int, pairs_each: int) -> DataFrame:
    """(good, bad) bins of pairs in which every row takes part, ``pairs_of`` in number.

    ``binned`` has doc_id, label and bins. Texts of each label are numbered in hash order. Those of the rarer
    one meet the next ``pairs_each`` of the other, around and around; where that would not reach all of the
    other, each of these meets one of the rarer.
    """
    keyed = binned.withColumn("_key", order_key("doc_id", seed="rank"))
    sizes = {0: n_bad, 1: n_good}
    rare = 0 if n_bad <= n_good else 1
    each = pairs_each if sizes[rare] * pairs_each >= sizes[1 - rare] else 1
    base = rare if each > 1 else 1 - rare

    def numbered(label: int, name: str) -> DataFrame:
        own = global_rank(keyed.filter(F.col("label") == label), F.col("_key"), F.col("bins"), name="place")
        return own.select("place", F.col("bins").alias(name))

    names = {0: "bad", 1: "good"}
    drawn = (
        numbered(base, names[base])
        .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(each - 1))))
        .withColumn("place", F.pmod(F.col("place") * each + F.col("draw"), F.lit(sizes[1 - base])))
    )
    return drawn.join(numbered(1 - base, names[1 - base]), "place").select("good", "bad")


def pairs_of(n_good: int, n_bad: int, pairs_each: int) -> int:
    return max(n_good, n_bad, min(n_good, n_bad) * pairs_each)


def _total_sums(pairs: DataFrame, w: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """``pair_sums`` over a table of pairs: a task hands on the numbers that are not 0, at most n * (n + 1)."""
    n = len(w)

    def bins(batch, name: str) -> np.ndarray:
        return np.frombuffer(b"".join(batch.column(name).to_pylist()), "<u4").reshape(-1, features)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        gradient, curve = np.zeros(n, np.int64), np.zeros((n, n), np.int64)
        for batch in batches:
            g, c = pair_sums(bins(batch, "good"), bins(batch, "bad"), w)
            gradient, curve = gradient + g, curve + c
        every = np.concatenate([gradient, curve.ravel()])
        place = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(every[place])], ["place", "value"])

    rows = pairs.mapInArrow(work, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).collect()
    every = np.zeros(n * (n + 1), np.int64)
    for r in rows:
        every[r["place"]] = r["value"]
    return every[:n], every[n:].reshape(n, n)


def fit_all(told: DataFrame, bins: int = 12, pairs_each: int = 8, penalty: float = 1e-3) -> RankModel:
    """The model of all rows of ``told`` (doc_id, x, label), which is read several times.

    Newton steps on the logistic loss of feature differences between preferred and other texts; the
    threshold is the quantile of the scores that leaves below it as many texts as have label 0. Edges of the
    bins and the threshold are exact quantiles of all rows, each row is in a pair, each step sums over all pairs; the driver sees
    the edges and, per step, sums whose number follows from the bins alone.
    """
    sizes = told.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 0).alias("bad"), F.max(F.size("x")).alias("k")).first()
    n, n_bad, features = sizes["n"], sizes["bad"], sizes["k"]
    if n_bad in (0, n):
        return _without_order(n_bad, n)
    names = [f"x{k}" for k in range(features)]
    wide = told.select(*[F.col("x")[k].alias(name) for k, name in enumerate(names)])
    found = column_quantiles(wide, names, np.linspace(0, 1, bins + 1)[1:-1].tolist())
    edges = [np.unique(found[name]) for name in names]

    def put(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(batch.num_rows, features)
            own = [row.tobytes() for row in bins_of(x, edges)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(own, pa.binary())], ["doc_id", "label", "bins"])

    binned = store(told.select("doc_id", "label", "x").mapInArrow(put, "doc_id long, label int, bins binary"), "bins")
    pairs = store(preference_pairs(binned, n - n_bad, n_bad, pairs_each), "pairs")
    w = newton(lambda w: _total_sums(pairs, w, features), pairs_of(n - n_bad, n_bad, pairs_each), int(_places(edges)[-1]), penalty)
    model = _model(edges, w)

    def raw(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(batch.num_rows, features)
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x))], ["raw"])

    model.cut = column_quantiles(told.select("x").mapInArrow(raw, "raw double"), ["raw"], [n_bad / n])["raw"][0]
    return model


def rank_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A row is held out when crc32 of its id as text is divisible by 5; labels of such rows are not used.
    Scores come from the text alone. The model is fitted on all labelled rows that are not held
    out; every row is scored on its whole text.

    Null and empty texts have the figures of an empty text and get a score. A null id is not held out and
    has no label; rows that repeat an id are rows of their own; of labels that repeat an id the largest
    counts. Without labels of both kinds all scores are equal. An empty table gives no rows. Other
    columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            parts = [text_features(part) for _, part in in_parts(texts_of(batch))]
            x = np.concatenate(parts) if parts else np.zeros((0, 1))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], ["doc_id", "x"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    measured = store(rows.mapInArrow(measure, "doc_id long, x array<double>").withColumn("held_out", held_out), "figures")
    known = labels.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label")).filter("label is not null")
    told = measured.filter("not held_out").join(known, "doc_id").select("doc_id", "x", F.expr("int(label > 0)").alias("label"))
    model = fit_all(store(told, "told"))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            got = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return measured.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
