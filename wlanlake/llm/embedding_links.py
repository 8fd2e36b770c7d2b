"""Near-duplicate vectors by tiled comparison in the order of principal components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wlanlake.llm.components import components
from wlanlake.llm.linear import one_thread
from wlanlake.session import store

#: leading components that order the vectors, and that bound a tile
ORDERING, BOXED = 4, 8
#: room for rounding: of sums in single precision, and of bounds in double
SLACK, TINY = 2e-5, 1e-7
#: pairs compared one by one at a time, and the share of a block above which all of it is multiplied out
AT_ONCE, DENSE = 50_000, 0.1


@dataclass
class Basis:
    """Directions (columns) by falling energy, and how many of them each step of a comparison adds up to."""

    directions: np.ndarray
    steps: list[int]
    threshold: float


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite, at least one of them not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def directions_of(flat: np.ndarray, size: int) -> np.ndarray:
    """Rows of ``size`` numbers as unit vectors in double precision."""
    x = flat.astype(np.float64).reshape(-1, size)
    # By powers of two, which is exact: squares then neither overflow nor vanish.
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_size(batch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, places in the batch, components in a row) for the vectors of each size in a batch."""
    vectors = batch.column("vector")
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        places = np.flatnonzero(sizes == size)
        part = vectors if len(places) == len(sizes) else vectors.take(places)
        yield int(size), places, part.flatten().to_numpy(zero_copy_only=False)


def principal_basis(vectors: DataFrame, threshold: float) -> Basis:
    """Principal directions of all unit vectors; shorter ones count as filled up with zeros.

    Every task adds up its products, four tasks add up the tasks' sums, and the driver gets four matrices.
    """
    size = vectors.agg(F.max(F.size("vector"))).first()[0] or 1

    def moments(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros((size, size))
        with one_thread():
            for batch in batches:
                for own, _, flat in by_size(batch):
                    u = directions_of(flat, own)
                    total[:own, :own] += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    def together(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(size * size)
        for batch in batches:
            for part in batch.column("total").to_pylist():
                total += np.frombuffer(part)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = vectors.select("vector").mapInArrow(moments, "total binary").repartition(4).mapInArrow(together, "total binary")
    total = sum(np.frombuffer(r["total"]) for r in parts.collect()).reshape(size, size)
    with one_thread():
        energy, directions = np.linalg.eigh(total)
    energy, directions = energy[::-1], np.ascontiguousarray(directions[:, ::-1])
    # The first step ends where the rest of two vectors of mean energy can no longer reach the threshold alone.
    left = 1 - np.cumsum(energy) / max(energy.sum(), 1e-300)
    first = int(np.searchsorted(-left, -max(threshold - 0.15, 0.05))) + 1
    steps = [min(size, max(1, first))]
    while steps[-1] < size:
        steps.append(min(size, 2 * steps[-1]))
    return Basis(directions, steps, threshold)


def _ordered(batches: Iterator, basis: Basis) -> Iterator:
    """Adds the place of each vector along the leading components: coarse cells, then the last of them."""
    import pyarrow as pa

    width = np.sqrt(2 * (1 - basis.threshold)) / 2
    with one_thread():
        for batch in batches:
            cells = np.zeros((batch.num_rows, ORDERING))
            for own, places, flat in by_size(batch):
                z = directions_of(flat, own) @ basis.directions[:own, :ORDERING]
                cells[places, : z.shape[1]] = z
            cells[:, : ORDERING - 1] = np.floor(cells[:, : ORDERING - 1] / width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(np.ascontiguousarray(cells[:, k])) for k in range(ORDERING))],
                [*batch.schema.names, *(f"o{k}" for k in range(ORDERING))],
            )


TILE = "tile long, size int, nodes binary, weights binary, data binary, lo array<double>, hi array<double>"


def _tiles(batches: Iterator, basis: Basis, rows: int) -> Iterator:
    """One row per ``rows`` vectors that follow each other, with bounds along the leading components."""
    import pyarrow as pa
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 32, 0
    held: dict[int, list] = {}

    def row(own: int, count: int):
        nonlocal made
        nodes, weights, data = (np.concatenate(part) for part in zip(*held[own]))
        held[own] = [(nodes[count:], weights[count:], data[count * own :])]
        nodes, weights, data = nodes[:count], weights[:count], data[: count * own]
        z = directions_of(data, own) @ basis.directions[:own, :BOXED]
        made += 1
        return pa.RecordBatch.from_pylist(
            [{"tile": base | made, "size": own, "nodes": nodes.tobytes(), "weights": weights.tobytes(), "data": data.tobytes(),
              "lo": z.min(axis=0).tolist(), "hi": z.max(axis=0).tolist()}],
            schema=pa.schema([("tile", pa.int64()), ("size", pa.int32()), ("nodes", pa.binary()), ("weights", pa.binary()),
                              ("data", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))]),
        )

    with one_thread():
        for batch in batches:
            nodes, weights = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
            for own, places, flat in by_size(batch):
                held.setdefault(own, []).append((nodes[places], weights[places], flat))
                while sum(len(part[0]) for part in held[own]) >= rows:
                    yield row(own, rows)
        for own in held:
            if sum(len(part[0]) for part in held[own]):
                yield row(own, sum(len(part[0]) for part in held[own]))


class Tile:
    """The vectors of a tile in unit length, turned into the basis, and what is left of them after each step."""

    def __init__(self, size: int, nodes: bytes, weights: bytes, data: bytes, basis: Basis, single: bool, block: int):
        self.nodes, self.weights = np.frombuffer(nodes, np.int64), np.frombuffer(weights, np.int64)
        self.unit = directions_of(np.frombuffer(data, np.float32 if single else np.float64), size)
        turned = self.unit @ basis.directions[:size]
        after = np.sqrt(np.maximum(np.cumsum(turned[:, ::-1] ** 2, axis=1)[:, ::-1], 0))
        self.left = [np.append(after, np.zeros((len(after), 1)), axis=1)[:, k].astype(np.float32) for k in basis.steps]
        self.turned = turned.astype(np.float32)
        # What is left is one more component: its product bounds the product of the components not added yet.
        self.head = np.concatenate([self.turned[:, : basis.steps[0]], self.left[0][:, None]], axis=1)
        self.blocks = [slice(k, min(k + block, len(after))) for k in range(0, len(after), block)]
        self.low = [turned[b, :BOXED].min(axis=0) for b in self.blocks]
        self.high = [turned[b, :BOXED].max(axis=0) for b in self.blocks]
        self.centre, self.radius = [], []
        for b in self.blocks:
            mean = self.unit[b].mean(axis=0)
            mean /= max(np.sqrt((mean * mean).sum()), 1e-300)
            self.centre.append(mean)
            self.radius.append(np.arccos(np.clip((self.unit[b] @ mean).min(), -1, 1)))


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest place that links lead to, for each of ``n`` places."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while True:
            shorter = label[label]
            if np.array_equal(shorter, label):
                break
            label = shorter
        open_ = label[left] != label[right]
        left, right = left[open_], right[open_]
    return label


def block_links(a: Tile, b: Tile, i: int, j: int, basis: Basis, same: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Places (in the blocks) of the linked pairs of block ``i`` of ``a`` and ``j`` of ``b``; None if all are linked."""
    rows, columns = a.blocks[i], b.blocks[j]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.maximum(0, np.maximum(a.low[i] - b.high[j], b.low[j] - a.high[i]))
    if (gap * gap).sum() > 2 * (1 - basis.threshold) + TINY:
        return none
    between = np.arccos(np.clip((a.centre[i] * b.centre[j]).sum(), -1, 1))
    if between + a.radius[i] + b.radius[j] < np.arccos(min(1.0, basis.threshold + TINY)) - TINY:
        return None
    reach = basis.threshold - SLACK
    bound = a.head[rows] @ b.head[columns].T
    found = np.flatnonzero(bound.ravel() >= reach)
    if not len(found):
        return none
    if len(found) > DENSE * bound.size:
        r, c = np.nonzero(a.unit[rows] @ b.unit[columns].T >= basis.threshold)
        above = r < c if same and i == j else np.ones(len(r), bool)
        return r[above], c[above]
    r, c = np.divmod(found, bound.shape[1])
    if same and i == j:
        r, c, found = r[r < c], c[r < c], found[r < c]
    parts = []
    for k in range(0, len(r), AT_ONCE):
        x, y = r[k : k + AT_ONCE], c[k : k + AT_ONCE]
        total = bound.ravel()[found[k : k + AT_ONCE]] - a.left[0][rows][x] * b.left[0][columns][y]
        for step, (done, upto) in enumerate(zip(basis.steps, basis.steps[1:]), 1):
            total = total + np.einsum("ij,ij->i", a.turned[rows][x, done:upto], b.turned[columns][y, done:upto])
            may = total + a.left[step][rows][x] * b.left[step][columns][y] >= reach
            x, y, total = x[may], y[may], total[may]
        sure = np.einsum("ij,ij->i", a.unit[rows][x], b.unit[columns][y]) >= basis.threshold
        parts.append((x[sure], y[sure]))
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else none


def tile_links(a: Tile, b: Tile, basis: Basis, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of the vectors of two tiles that link with some other: counts, and a tree in place of all pairs."""
    shift = 0 if same else len(a.nodes)
    nodes = a.nodes if same else np.concatenate([a.nodes, b.nodes])
    weights = a.weights if same else np.concatenate([a.weights, b.weights])
    links = np.zeros(len(nodes), np.int64)
    tree = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, rows in enumerate(a.blocks):
        for j, columns in enumerate(b.blocks):
            if same and j < i:
                continue
            got = block_links(a, b, i, j, basis, same)
            left = np.arange(rows.start, rows.stop)
            right = np.arange(columns.start, columns.stop) + shift
            if got is None:
                if same and i == j:
                    links[left] += weights[left].sum() - weights[left]
                else:
                    links[left] += weights[right].sum()
                    links[right] += weights[left].sum()
                every = np.concatenate([left, right])
                tree.append((np.full(len(every), every.min()), every))
            elif len(got[0]):
                x, y = got
                # Sums of whole numbers below 2^53 are exact in double precision.
                links[left] += np.bincount(x, weights[right][y], len(left)).astype(np.int64)
                links[right] += np.bincount(y, weights[left][x], len(right)).astype(np.int64)
                if same and i == j:
                    tree.append((spanning(len(left), x, y) + rows.start, left))
                else:
                    label = spanning(len(left) + len(right), x, y + len(left))
                    places = np.concatenate([left, right])
                    tree.append((places[label], places))
    label = spanning(len(nodes), *(np.concatenate(p) for p in zip(*tree)))
    some = np.flatnonzero(links)
    return nodes[some], links[some], nodes[label[some]]


def _compared(batches: Iterator, basis: Basis, single: bool, block: int) -> Iterator:
    import pyarrow as pa

    def tile(batch, k: int, side: str) -> Tile:
        parts = [batch.column(f"{side}_{name}")[k].as_py() for name in ("size", "nodes", "weights", "data")]
        return Tile(*parts, basis, single, block)

    with one_thread():
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column("a")[k] == batch.column("b")[k]
                a = tile(batch, k, "a")
                got = tile_links(a, a if same else tile(batch, k, "b"), basis, same)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in got], ["node", "links", "root"])


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    tile_rows: tuple[int, int] = (1024, 16384),
    tiles: int = 12,
    block: int = 1024,
) -> DataFrame:
    """One row per row of ``df``: vec_id, n_links, component_id, kept.

    Two vectors link when their cosine in double precision is ``threshold`` or more.

    Equal vectors are one node, whose number of copies is its weight. Nodes are sorted by range along the
    principal components of all of them, and cut into tiles: about ``tiles`` of them within the bounds
    ``tile_rows``, so the number of tiles grows with the table once the upper bound is met. Tiles whose
    boxes along the leading components are further apart than linked vectors can be never meet. Tiles
    that meet are compared block by block. The leading components are multiplied first; what two vectors
    have left is bounded by the product of its norms, and a pair goes on to more components only while
    the sum and that bound can reach the threshold. What remains is decided by the whole vectors in
    double precision. Blocks so narrow that all their pairs link are counted without comparison.

    A pair of tiles gives one row for each vector that links, with its count and its root in a tree, never
    all pairs. Vectors without any structure leave nothing for the boxes to tell apart; then each tile
    meets each, and the work grows with the square of the table.

    Vectors that are null, empty, zero, or hold a null or a number that is not finite link with nothing, as do
    vectors of different sizes: component_id is their own id. A null id is the smallest of its component
    only if there is no other. Rows that repeat an id are rows of their own; ``kept`` holds for all rows
    whose id is the component's. An empty table gives no rows. Other columns are not read.
    """
    number = df.schema[vector_col].dataType.elementType.simpleString()
    vector = F.col(vector_col) if number in ("float", "double") else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    # Both zeros are equal.
    clean = rows.filter(usable(F.col("vector"))).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0).cast(number if number == "float" else "double")))
    nodes = store(
        clean.groupBy("vector")
        .agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id()),
        "vectors",
    )
    count = nodes.count()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    basis = principal_basis(nodes, threshold)
    many = min(max(-(-count // tiles), tile_rows[0]), tile_rows[1])
    order = [f"o{k}" for k in range(ORDERING)]
    ordered = nodes.select("node", "weight", "vector").mapInArrow(
        partial(_ordered, basis=basis), f"node long, weight long, vector array<{number if number == 'float' else 'double'}>, " + ", ".join(f"{o} double" for o in order)
    )
    sorted_ = ordered.repartitionByRange(-(-count // (4 * many)), *order, "node").sortWithinPartitions(*order, "node")
    cut = store(sorted_.select("node", "weight", "vector").mapInArrow(partial(_tiles, basis=basis, rows=many), TILE), "tiles")

    near = F.aggregate(
        F.zip_with(
            F.zip_with("lo", "b_hi", lambda x, y: x - y),
            F.zip_with("b_lo", "hi", lambda x, y: x - y),
            lambda x, y: F.pow(F.greatest(F.lit(0.0), x, y), 2),
        ),
        F.lit(0.0),
        lambda total, x: total + x,
    ) <= 2 * (1 - threshold) + TINY
    # Every tile meets every other through the group that its number falls into.
    groups = max(1, int(cut.count() ** 0.5))
    bounds = cut.select("tile", "size", "lo", "hi")
    other = bounds.select(
        F.col("tile").alias("b"), F.col("size").alias("b_size"), F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"),
        F.pmod(F.xxhash64("tile"), F.lit(groups)).alias("group"),
    )
    pairs = (
        bounds.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
        .join(other, "group")
        .filter((F.col("tile") <= F.col("b")) & (F.col("size") == F.col("b_size")) & near)
        .select(F.col("tile").alias("a"), "b")
    )
    side = {s: cut.select(F.col("tile").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("size", "nodes", "weights", "data"))) for s in "ab"}
    compared = store(
        pairs.join(side["a"], "a").join(side["b"], "b").repartition(F.col("a"), F.col("b"))
        .mapInArrow(partial(_compared, basis=basis, single=number == "float", block=block), "node long, links long, root long"),
        "links",
    )
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(compared.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = store(
        nodes.join(links, "node", "left").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        .select("vector", "weight", "least", "links", "label"),
        "placed",
    )
    low = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    found = placed.join(low, "label").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    result = rows.filter(usable(F.col("vector"))).join(found, "vector").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable(F.col("vector"))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
