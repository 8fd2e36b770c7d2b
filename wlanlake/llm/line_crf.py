"""Content and boilerplate lines by a linear-chain conditional random field."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wlanlake.llm.common import hash_sample
from wlanlake.llm.shingles import in_parts
from wlanlake.llm.textstats import Stats, share, text_stats
from wlanlake.llm.tokens import texts_of

QUALITY = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"
)


# Place of the feature that says a line has no words.
NO_WORDS = 1


def line_features(stats: Stats) -> np.ndarray:
    """A row for each line, values from 0 to about 1."""
    x = stats.lines
    n = x["words"]
    return np.stack(
        [
            np.ones(len(n)),
            (n == 0).astype(float),
            np.minimum(np.log1p(n) / 6, 1),
            np.minimum(share(x["points"], n) / 12, 1),
            share(x["symbols"], x["points"]) * 4,
            share(x["upper"], x["letters"]),
            share(x["digits"], x["points"]),
            np.minimum(share(x["bangs"], n), 1),
            np.minimum(share(x["bars"], n), 1),
            np.minimum(share(x["stops"], n) * 4, 1),
            share(x["twins"], n),
            share(x["repeated"], n),
            x["dup"].astype(float),
            x["closed"].astype(float),
        ],
        axis=1,
    )


@dataclass
class LineModel:
    """Weights of features by state, of a line's state after another, and of the first line's state."""

    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The most probable states; state 1 is content, and wins ties."""
        scores = (features @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = scores[0][0] + self.start[0], scores[0][1] + self.start[1]
        back = []
        for s0, s1 in scores[1:]:
            from_a, from_b = a + m00, b + m10
            to_a, to_b = a + m01, b + m11
            back.append((from_b >= from_a, to_b >= to_a))
            a, b = max(from_a, from_b) + s0, max(to_a, to_b) + s1
        state = int(b >= a)
        states = [state]
        for choice in reversed(back):
            state = int(choice[state])
            states.append(state)
        return np.array(states[::-1])


def spliced(chains: list[tuple[np.ndarray, int]], seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chains with a mark for each line: every text as it is, and with a stretch of one of the other label put into it.

    Texts are labelled whole, so they show no change from content to boilerplate; these show some. The
    stretch is a fifth to a half as long as the text, and begins anywhere.
    """
    rng = np.random.default_rng(seed)
    marked = [(f, np.full(len(f), y)) for f, y in chains]
    of = [[m for m, (_, y) in zip(marked, chains) if y == k] for k in (0, 1)]
    if not all(of):
        return marked
    for (f, s), (_, y) in zip(list(marked), chains):
        g, t = of[1 - y][rng.integers(len(of[1 - y]))]
        n = min(len(g), max(1, int(len(f) * rng.uniform(0.2, 0.5))))
        at, first = rng.integers(len(f) + 1), rng.integers(len(g) - n + 1)
        marked.append((np.concatenate([f[:at], g[first : first + n], f[at:]]), np.concatenate([s[:at], t[:n], s[at:]])))
    return marked


def fit_lines(
    chains: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.1, penalty: float = 1e-3, trust: float = 0.9
) -> LineModel:
    """Marginal likelihood by gradient steps (Adam); a chain is the features of a text's lines and its label.

    The field is fitted on the texts and on splices of texts of both labels (``spliced``). States of lines
    are hidden: a label is a noisy mark of each line of its text that has words, right with probability
    ``trust``, so a line that looks like those of the other label may be one of them.
    """
    width = chains[0][0].shape[1] if chains else 14
    emit, move, start = np.zeros((width, 2)), np.zeros((2, 2)), np.zeros(2)
    if not chains:
        return LineModel(emit, move, start)
    chains = sorted(spliced(chains), key=lambda c: len(c[0]))
    groups = []
    for at in range(0, len(chains), 256):
        part = chains[at : at + 256]
        longest = len(part[-1][0])
        x = np.zeros((len(part), longest, width))
        on, y = np.zeros((len(part), longest)), np.zeros((len(part), longest))
        for k, (f, marks) in enumerate(part):
            x[k, : len(f)] = f
            on[k, : len(f)] = 1
            y[k, : len(f)] = marks
        groups.append((x, on, y))
    weights = [emit, move, start]
    slow, fast = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, rounds + 1):
        grads = [penalty * w for w in weights]
        for x, on, y in groups:
            one = _gradient(x, on, y, math.log(trust / (1 - trust)), *weights)
            grads = [g + o / len(chains) for g, o in zip(grads, one)]
        for w, g, s, f in zip(weights, grads, slow, fast):
            s += 0.1 * (g - s)
            f += 0.001 * (g * g - f)
            w -= rate * (s / (1 - 0.9**step)) / (np.sqrt(f / (1 - 0.999**step)) + 1e-8)
    return LineModel(*weights)


def _sums(scores, on, move, start):
    """Probabilities of the states of padded chains, and the expected number of moves, by forward-backward sums."""
    docs, longest, _ = scores.shape
    add = lambda z, axis: np.logaddexp.reduce(z, axis=axis)
    ahead = np.zeros((docs, longest, 2))
    ahead[:, 0] = scores[:, 0] + start
    for t in range(1, longest):
        step = add(ahead[:, t - 1, :, None] + move, 1) + scores[:, t]
        ahead[:, t] = np.where(on[:, t, None] > 0, step, ahead[:, t - 1])
    behind = np.zeros((docs, longest, 2))
    for t in range(longest - 2, -1, -1):
        step = add(move + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(on[:, t + 1, None] > 0, step, 0)
    total = add(ahead[:, -1], 1)
    state = np.exp(ahead + behind - total[:, None, None]) * on[:, :, None]
    if longest == 1:
        return state, np.zeros((2, 2))
    pair = ahead[:, :-1, :, None] + move + (scores[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
    return state, (np.exp(np.minimum(pair, 0)) * on[:, 1:, None, None]).sum(axis=(0, 1))


def _gradient(x, on, y, mark, emit, move, start):
    """Expected counts without the marks minus those with them, of a group of padded chains."""
    scores = x @ emit
    told = scores + (mark * on * (1 - x[:, :, NO_WORDS]))[:, :, None] * np.stack([y == 0, y == 1], axis=2)
    (free, free_moves), (held, held_moves) = _sums(scores, on, move, start), _sums(told, on, move, start)
    return np.einsum("dtf,dts->fs", x, free - held), free_moves - held_moves, (free - held)[:, 0].sum(axis=0)


def training_chains(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int, fit_lines_most: int
) -> list[tuple[np.ndarray, int]]:
    """Line features of at most ``fit_rows`` hash-chosen labelled texts of up to ``fit_lines_most`` lines."""
    known = labels.groupBy(id_col).agg(F.max(label_col).alias("label")).filter("label is not null")
    chosen = hash_sample(known, fit_rows, id_col, seed="lines")
    few = F.size(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")) <= fit_lines_most
    rows = docs.select(id_col, F.col(text_col).alias("text")).filter(few).join(chosen, id_col).select("text", "label")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            labels_, out = batch.column("label").to_pylist(), []
            for at, part in in_parts(texts_of(batch)):
                stats = text_stats(part)
                features = line_features(stats).astype(np.float32)
                for k in range(len(part)):
                    own = features[stats.line_begin[k] : stats.line_begin[k + 1]]
                    out.append((own.tobytes(), len(own), labels_[at + k]))
            columns = list(zip(*out)) or [[]] * 3
            kinds = (pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["f", "n", "label"])

    got = rows.mapInArrow(work, "f binary, n long, label long").collect()
    got = sorted((bytes(r["f"]), r["n"], r["label"]) for r in got)[:fit_rows]
    return [(np.frombuffer(f, np.float32).reshape(n, -1).astype(float), int(y > 0)) for f, n, y in got if n]


def line_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    fit_rows: int = 4000,
    fit_lines_most: int = 400,
    least_content: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: figures of the text, base_failed, kept, content_share, n_lines, n_content_lines.

    Lines are labelled content or boilerplate by Viterbi decoding; a text is kept when content lines have
    at least ``least_content`` of its words and the base rules hold: 10 words or more, and at most 20 % of
    the words in 5-word windows that the text has twice or more. The field is fitted on at most
    ``fit_rows`` labelled texts, chosen by hash of the id among all; those of more than ``fit_lines_most``
    lines take no part in the fit. Every text is labelled whole, however long.

    Null and empty texts have no words and fail the base rules. Without labelled texts all lines count as
    content. A null id is kept; rows that repeat an id are rows of their own. An empty table gives no
    rows. Other columns are not read.
    """
    chains = training_chains(docs, labels, id_col, text_col, label_col, fit_rows, fit_lines_most)
    model = fit_lines(chains)

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in QUALITY.split(", ")]
        for batch in batches:
            parts = []
            for _, part in in_parts(texts_of(batch)):
                stats = text_stats(part)
                features = line_features(stats)
                n = stats.n_words
                content, lines, marked = np.zeros(len(part)), np.diff(stats.line_begin), np.zeros(len(part), np.int64)
                for k in range(len(part)):
                    own = slice(stats.line_begin[k], stats.line_begin[k + 1])
                    states = model.viterbi(features[own])
                    content[k] = (stats.lines["words"][own] * states).sum() / max(int(n[k]), 1)
                    marked[k] = states.sum()
                failed = (n < 10) | (100 * stats.n_repeat_words > 20 * n)
                kept = ~failed & (content >= least_content)
                parts.append([n, stats.word_chars, stats.n_symbols, stats.n_dup_lines, stats.n_repeat_words, failed, kept, content, lines, marked])
            if parts:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, QUALITY)
