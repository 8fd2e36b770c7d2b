"""Laying rows out so that ordered operators never need one task per group.

A block (one capture file) is normally small, but nothing here relies on it: one block
may hold a third of all rows. Ordered work is therefore done per *tile*: a stretch of
one block with a bounded number of rows. Three things make tiles exact:

* positions come from counts per chunk (a slice of the order column), added up over the
  small chunk table, so no task ever sees a whole block;
* rows a moving frame has to look back on are copied into the next tile (the halo);
* values carried over from any distance ("last seen sequence number") are found on the
  chunk table too, and handed to each tile as its starting value.

Blocks that fit in one tile need none of it: blocks are counted first, which reads no
column but the block, and where none is large the rows are left as they are. Their window
is then the only exchange.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wlanlake.functions.util import col_of
from wlanlake.session import store

CHUNK = 8192
TILE_ROWS = 131072


def carried(name: str) -> str:
    return f"_carry_{name}"


def tile_rows(
    df: DataFrame,
    group: str = "block_id",
    order: str = "frame_number",
    *,
    lookback: int = 0,
    lookahead: int = 0,
    carry: dict[str, Column] | None = None,
    chunk: int = CHUNK,
    rows: int = TILE_ROWS,
) -> DataFrame:
    """Add ``_tile``, ``_own``, ``_base``, ``_total`` and ``_carry_*`` to every row.

    ``_tile`` numbers the tiles of a block. A row is copied (``_own`` false) into the
    next tile when a frame of ``lookback`` rows may need it there, and into the previous
    one for ``lookahead``. ``_base`` is the position in the block of the tile's first
    row, copies included, ``_total`` the rows of a block of several tiles (NULL for others).
    ``_carry_x`` is the last non-null ``carry["x"]`` before that first row. The order column must be a non-negative whole number, unique in its block.
    """
    halo = max(lookback, lookahead)
    if rows < chunk + halo:
        raise ValueError("a tile must hold at least one chunk and its halo")
    carry = carry or {}
    large = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    if not large.head(1):
        types = dict(df.select(*[value.alias(name) for name, value in carry.items()]).dtypes)
        return df.withColumns(
            {
                "_tile": F.lit(0).cast("long"),
                "_own": F.lit(True),
                "_base": F.lit(0).cast("long"),
                "_total": F.lit(None).cast("long"),
            }
            | {carried(name): F.lit(None).cast(t) for name, t in types.items()}
        )
    chunked = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("long"))

    counts = chunked.groupBy(group, "_chunk").agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.max_by(value, F.when(value.isNotNull(), F.col(order))).alias(f"_last_{name}")
            for name, value in carry.items()
        ],
    )
    block = Window.partitionBy(group)
    before = block.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    upto = block.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    counts = (
        counts.select(
            "*",
            F.sum("_n").over(upto).alias("_end"),
            F.sum("_n").over(block).alias("_total"),
            *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(carried(n)) for n in carry],
        )
        .filter(F.col("_total") > rows)
        .withColumn("_start", F.col("_end") - F.col("_n"))
        .withColumn("_home", F.floor(F.col("_start") / rows).cast("long"))
    )
    home = Window.partitionBy(group, "_home")
    counts = counts.withColumn("_home_end", F.max("_end").over(home)).withColumn(
        "_home_start", F.min("_start").over(home)
    )
    targets = [F.array("_home")]
    if lookback:
        # The next tile starts where this one ends, which also tells its number.
        reaches = (F.col("_home_end") < F.col("_total")) & (
            F.col("_home_end") - F.col("_end") < lookback
        )
        following = F.floor(F.col("_home_end") / rows).cast("long")
        targets.append(F.when(reaches, F.array(following)).otherwise(F.array().cast("array<long>")))
    if lookahead:
        reaches = (F.col("_home_start") > 0) & (F.col("_start") - F.col("_home_start") < lookahead)
        preceding = F.floor((F.col("_home_start") - 1) / rows).cast("long")
        # Tile numbers may skip one where a chunk ran over the edge of a tile.
        prior = F.coalesce(
            F.max("_home").over(
                block.orderBy("_home").rangeBetween(Window.unboundedPreceding, -1)
            ),
            preceding,
        )
        targets.append(F.when(reaches, F.array(prior)).otherwise(F.array().cast("array<long>")))
    tile_map = counts.withColumn("_tile", F.explode(F.concat(*targets)))
    first = Window.partitionBy(group, "_tile")
    from_first = first.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    tile_map = tile_map.select(
        group,
        "_chunk",
        "_tile",
        (F.col("_tile") == F.col("_home")).alias("_own"),
        F.min("_start").over(first).alias("_base"),
        "_total",
        *[F.first(carried(n)).over(from_first).alias(carried(n)) for n in carry],
    )
    return (
        chunked.join(tile_map, [group, "_chunk"], "left")
        .withColumn("_tile", F.coalesce("_tile", F.lit(0).cast("long")))
        .withColumn("_own", F.coalesce("_own", F.lit(True)))
        .withColumn("_base", F.coalesce("_base", F.lit(0).cast("long")))
        .drop("_chunk")
    )


def tile_window(group: str = "block_id", order: str = "frame_number"):
    """The one window specification all tiled operators share: one shuffle, one sort."""
    return Window.partitionBy(group, "_tile").orderBy(order)


def drop_layout(df: DataFrame) -> DataFrame:
    extra = [c for c in df.columns if c in ("_tile", "_own", "_base", "_total") or c.startswith("_carry_")]
    return df.drop(*extra)


def own_rows(df: DataFrame) -> DataFrame:
    """Leave out the copies and the layout columns."""
    return drop_layout(df.filter("_own"))


def with_position(
    df: DataFrame, group: str = "block_id", order: str = "frame_number", **tiling
) -> DataFrame:
    """Add ``rn`` (0-based position in the block) and ``n_rows`` (block length).

    The length of a block of several tiles comes with its tiles, that of others is the length of their
    one tile; so both need no exchange but the tiles' own.
    """
    laid = tile_rows(df, group, order, **tiling)
    rn = F.col("_base") + F.row_number().over(tile_window(group, order)) - 1
    length = F.coalesce("_total", F.count(F.lit(1)).over(Window.partitionBy(group, "_tile")))
    return own_rows(laid.withColumns({"rn": rn.cast("long"), "n_rows": length}))


def with_place(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """Add the place of each row (from 1) in the whole order, by a range sort.

    Only the row counts of the partitions meet, on the driver. Ties take any order.
    """
    rows = store(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "places"
    ).withColumn("_part", F.shiftright("_at", 33))
    # One row per partition.
    sizes = sorted(map(tuple, rows.groupBy("_part").count().collect()))
    before = [(part, sum(n for _, n in sizes[:k])) for k, (part, _) in enumerate(sizes)]
    bases = df.sparkSession.createDataFrame(before, "_part bigint, _base bigint")
    place = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(bases), "_part").withColumn(name, place).drop("_part", "_at", "_base")


def pack(df: DataFrame, used: list[str], passed: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The ``used`` columns as they are and all other ``passed`` ones as one, and the SQL that gets each back.

    A window or join copies its rows several times, and one column costs less than its many parts.
    """
    used = list(dict.fromkeys(used))
    others = [c for c in passed if c not in used]
    one = [f"struct({', '.join(f'`{c}`' for c in others)}) as _others"] if others else []
    place = {c: f"`{c}`" for c in used} | {c: f"_others.`{c}`" for c in others}
    return df.selectExpr(*[f"`{c}`" for c in used], *one), place


def rank_by_hash(
    df: DataFrame,
    hash_col: str,
    tie_col: str,
    by: list[str] | None = None,
    buckets: int | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Add ``rk``: exact 0-based rank by hash within each group of ``by``, and ``n_group``.

    The hash range is cut into equal slices; ranks inside a slice come from a window over
    that slice only, and the slices' offsets from their counts. There are as many slices
    as the root of all rows, unless ``buckets`` says how many. With ``weight``, its sum over
    the rows of smaller rank and over the whole group come along as ``before`` and ``total``.

    Rows meet nothing but the counts of their group's slice, so they are dealt by group and slice
    and never by the group alone, of which there may be few. Columns that are only passed on
    travel as one.
    """
    by = by or []
    weighed = F.col(weight) if weight else F.lit(0)
    packed, place = pack(df, [*by, hash_col, tie_col, *([weight] if weight else [])], df.columns)
    unit = F.col(hash_col) / F.lit(2.0**64) + F.lit(0.5)
    if buckets:
        sized, slices = packed, F.lit(buckets)
    else:
        # One number.
        root = df.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("_slices"))
        sized, slices = packed.crossJoin(F.broadcast(root)), F.col("_slices")
    sliced = sized.withColumn("_slice", F.least(F.floor(unit * slices), slices - 1).cast("long")).drop("_slices")
    counts = sliced.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"), F.sum(weighed).alias("_w"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by,
        "_slice",
        F.sum("_n").over(group).alias("n_group"),
        F.sum("_w").over(group).alias("total"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("_below"),
    )
    within = Window.partitionBy(*by, "_slice").orderBy(hash_col, tie_col)
    ranked = sliced.join(offsets, [*by, "_slice"]).withColumn("rk", F.col("_offset") + F.row_number().over(within) - 1)
    added = ["n_group", "rk"]
    if weight:
        upto = within.rowsBetween(Window.unboundedPreceding, -1)
        ranked = ranked.withColumn("before", F.col("_below") + F.coalesce(F.sum(weighed).over(upto), F.lit(0)))
        added = ["n_group", "total", "rk", "before"]
    return ranked.selectExpr(*[place[c] for c in [*by, *(c for c in df.columns if c not in by)]], *added)


def value_cuts(values: DataFrame, by: list[str], x: str = "x", coarse: int = 32) -> DataFrame:
    """Approximate quantiles that cut the values of each group into at most coarse * coarse slices of about
    as many rows: ``cuts``, and every ``coarse``-th of them as ``marks``."""
    splits = coarse * coarse
    grid = [i / splits for i in range(1, splits)]
    cuts = values.groupBy(*by).agg(F.percentile_approx(x, F.array(*[F.lit(g) for g in grid]), splits * 5).alias("cuts"))
    steps = F.sequence(F.lit(coarse), F.lit(splits - 1), F.lit(coarse))
    return cuts.withColumn("marks", F.transform(steps, lambda i: F.get("cuts", i - 1)))


def slice_of(x: str, coarse: int = 32) -> Column:
    """The slice of a value between ``cuts``, found in two short steps instead of one long one."""

    def below(array: Column) -> Column:
        return F.aggregate(array, F.lit(0), lambda a, c: a + F.when(c < F.col(x), 1).otherwise(0))

    step = below(F.col("marks")) * coarse
    return step + below(F.slice("cuts", step + 1, F.lit(coarse)))


def value_slices(df: DataFrame, columns: list[str], coarse: int = 32) -> tuple[DataFrame, DataFrame]:
    """Distinct values of columns, cut into slices of the value range.

    Returns the values ``(feature, x, n, slice)`` and the slices ``(feature, slice, before,
    n_slice, total)``, where ``before`` counts the rows below the slice. Equal values are
    counted before anything else; approximate quantiles place the cuts, the counts are exact.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), col_of(c).cast("double").alias("x")) for c in columns]
    )
    long = df.select(F.explode(pairs).alias("p")).select("p.feature", "p.x").filter(
        F.col("x").isNotNull() & ~F.isnan("x")
    )
    counts = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))
    # One row per feature, each of fixed length: small by construction.
    cuts = F.broadcast(value_cuts(long, ["feature"], coarse=coarse))
    values = counts.join(cuts, "feature").select("feature", "x", "n", slice_of("x", coarse).alias("slice"))
    order = Window.partitionBy("feature").orderBy("slice")
    slices = values.groupBy("feature", "slice").agg(F.sum("n").alias("n_slice")).select(
        "feature",
        "slice",
        (F.sum("n_slice").over(order) - F.col("n_slice")).alias("before"),
        "n_slice",
        F.sum("n_slice").over(Window.partitionBy("feature")).alias("total"),
    )
    return values, slices


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank of every distinct value, the mean rank among equals: rows ``(feature, x, rank)``."""
    values, slices = value_slices(df, columns)
    inside = Window.partitionBy("feature", "slice").orderBy("x")
    upto = F.col("before") + F.sum("n").over(inside)
    # At most 1024 slices per column.
    offsets = F.broadcast(slices.select("feature", "slice", "before"))
    return values.join(offsets, ["feature", "slice"]).select(
        "feature", "x", (upto - (F.col("n") - 1) / 2.0).alias("rank")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
