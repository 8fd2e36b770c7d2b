"""Packing documents into sequences as a cutting-stock problem, by column generation."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wlanlake.llm.common import order_key, running_total
from wlanlake.llm.tokens import default_path, texts_of, word_encoder
from wlanlake.session import store

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(df: DataFrame, id_col: str, text_col: str, path: str, end_id: int, length: int) -> DataFrame:
    """Cuts each document, an end id behind it, into pieces of ``length`` ids and a shorter last one."""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = word_encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch))):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    rows.append((doc, at, len(part) // 4, zlib.crc32(part), n))
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECE)


def best_pattern(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the most valuable multiset of sizes within the capacity."""
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fits = np.searchsorted(sizes, room, "right")
        if fits:
            worth = best[room - sizes[:fits]] + values[:fits]
            k = int(np.argmax(worth))
            if worth[k] > best[room] + 1e-12:
                best[room], last[room] = worth[k], k
    pattern = np.zeros(len(sizes))
    room = capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int = 5000):
    """Fractional solution of: fewest sequences whose patterns hold each size as often as demanded.

    Revised simplex over the patterns in the basis; the knapsack prices new ones with the duals. Ends
    when no pattern has a value above one, or when Farley's bound says the rest is within ``gap``.
    """
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    amount = inverse @ demand
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        value, pattern = best_pattern(np.maximum(duals, 0), sizes, capacity)
        if value <= 1 + gap:
            break
        entering = inverse @ pattern
        ratios = np.full(m, np.inf)
        positive = entering > 1e-9
        ratios[positive] = amount[positive] / entering[positive]
        leaving = int(np.argmin(ratios))
        step = ratios[leaving]
        if not np.isfinite(step):
            break
        amount = np.maximum(amount - step * entering, 0)
        amount[leaving] = step
        basis[:, leaving] = pattern
        inverse[leaving] /= entering[leaving]
        others = np.arange(m) != leaving
        inverse[others] -= np.outer(entering[others], inverse[leaving])
    return basis, amount


def packing_plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (size: how often) and how many sequences take each; together they hold every item once.

    The linear program's amounts are rounded down; what is left, at most one pattern's items for each
    size, is filled largest first.
    """
    sizes = np.array(sorted(k for k, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    basis, amount = column_generation(sizes, left.astype(float), capacity)
    plan = []
    for j in np.argsort(-amount, kind="stable"):
        pattern = basis[:, j].astype(np.int64)
        used = pattern > 0
        times = int(min(math.floor(amount[j] + 1e-6), (left[used] // pattern[used]).min()))
        if times > 0:
            plan.append(({int(s): int(a) for s, a in zip(sizes, pattern) if a}, times))
            left -= times * pattern
    while left.any():
        room, pattern = capacity, np.zeros_like(left)
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], room // sizes[k])
            room -= pattern[k] * sizes[k]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append(({int(s): int(a) for s, a in zip(sizes, pattern) if a}, times))
        left -= times * pattern
    return plan


class Seats:
    """Where the n-th item of each size goes: the plan as sorted lists, as large as the plan."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        spans: dict[int, list[tuple[int, int, int, int]]] = {}
        taken: dict[int, int] = {}
        first = 0
        for pattern, times in plan:
            slot = 0
            for size in sorted(pattern, reverse=True):
                each = pattern[size]
                spans.setdefault(size, []).append((taken.get(size, 0), each, first, slot))
                taken[size] = taken.get(size, 0) + each * times
                slot += each
            first += times
        self.spans = {size: np.array(rows, dtype=np.int64) for size, rows in spans.items()}

    def find(self, size: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans = self.spans[size]
        at = spans[np.searchsorted(spans[:, 0], rank, "right") - 1]
        nth = rank - at[:, 0]
        return at[:, 2] + nth // at[:, 1], at[:, 3] + nth % at[:, 1]


def rounding(lengths: dict[int, int], length: int, most: float, coarsest: int = 256) -> int:
    """The coarsest unit, a power of two of which ``coarsest`` fill a sequence at least, that costs little.

    Rounding lengths up to it may add a share of ``most`` to all ids; where each coarser one adds more, it is 1.
    """
    total = sum(n * k for k, n in lengths.items())
    unit = 1 << max((length // coarsest).bit_length() - 1, 0)
    while unit > 1 and (length % unit or sum(n * (-k % unit) for k, n in lengths.items()) > most * total):
        unit //= 2
    return unit


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end_id: int = 2,
    length: int = 4096,
    most_lost: float = 0.015,
    seed: str = "pack",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents longer than a sequence are cut into whole sequences and a rest. Pieces are counted by length
    (at most ``length`` counts, whatever the input) and lengths rounded up to a unit that adds no more
    than a share of ``most_lost`` to all ids, so short texts keep their exact lengths. A linear program over
    patterns of these lengths, with columns priced by a knapsack, says which patterns to use how often.
    Pieces are ranked within their length in hash-random order by running totals, and the rank picks
    sequence and slot; offsets follow from the pieces' true lengths.

    Null text counts as empty: such a document is its end id. A null id is kept as it is. Rows that
    repeat an id are documents of their own; repeated rows change places with each other freely. An
    empty table gives no rows. Other columns are not read.
    """
    pieces = store(
        token_pieces(df, id_col, text_col, path or default_path(), end_id, length)
        .withColumn("_key", order_key("doc_id", "start", seed=seed)),
        "pieces",
    )
    lengths = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    unit = rounding(lengths, length, most_lost)
    pieces = pieces.withColumn("size", F.ceil(F.col("length") / unit).cast("long"))
    counts = pieces.groupBy("size").agg(F.count(F.lit(1)).alias("rows_in_group"))
    seats = Seats(packing_plan({r["size"]: r["rows_in_group"] for r in counts.collect()}, length // unit))

    def seat(frames: Iterator) -> Iterator:
        for pdf in frames:
            sequence, slot = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            sizes, ranks = pdf["size"].to_numpy(), pdf["rank"].to_numpy()
            for size in np.unique(sizes):
                own = sizes == size
                sequence[own], slot[own] = seats.find(int(size), ranks[own])
            yield pdf.drop(columns=["size", "rank"]).assign(sequence_id=sequence, slot=slot)

    ranked = running_total(pieces, "size", counts, F.lit(1), "_key", "rank").drop("_key")
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranked.mapInPandas(seat, PIECE + ", sequence_id long, slot long")
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
        .drop("slot")
    )
