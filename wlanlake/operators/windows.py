"""Model windows over the frames of a block, addressed by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wlanlake.functions.util import col_of
from wlanlake.operators.layout import CHUNK, TILE_ROWS, own_rows, tile_rows, tile_window, with_position


def _position_tiling(tiling: dict) -> dict:
    return {k: v for k, v in tiling.items() if k in ("chunk", "rows")}


def training_windows(df: DataFrame, window: int, stride: int, **tiling) -> DataFrame:
    """Start positions ``(block_id, start)``: every stride, and always the block's tail.

    A window lies inside one block; blocks shorter than it have none.
    """
    placed = with_position(df.select("block_id", "frame_number"), **_position_tiling(tiling))
    last = F.col("n_rows") - window
    rn = F.col("rn")
    starts = ((rn % stride == 0) & (rn < last)) | (rn == last)
    return placed.filter(starts).select("block_id", rn.alias("start"), "frame_number", "n_rows")


def rows_in_windows(placed: DataFrame, window: int, stride: int) -> DataFrame:
    """Each row once per window that holds it, with that window's ``start``.

    The starts follow from the row's position, so no join and no window over the block is
    needed; a row meets about window/stride of them.
    """
    rn, last = F.col("rn"), F.col("n_rows") - window
    low = F.ceil(F.greatest(F.lit(0), rn - window + 1) / stride).cast("long") * stride
    high = F.least(rn, last - 1)
    empty = F.array().cast("array<long>")
    regular = F.when(low <= high, F.sequence(low, high, F.lit(stride).cast("long"))).otherwise(empty)
    tail = F.when((last >= 0) & (rn >= last), F.array(last)).otherwise(empty)
    starts = F.when(last >= 0, F.concat(regular, tail)).otherwise(empty)
    return placed.withColumn("start", F.explode(starts))


def gather_windows(
    df: DataFrame, columns: list[str], window: int, stride: int, **tiling
) -> DataFrame:
    """Windows as matrices: ``features[f][t]`` for each ``(block_id, start)``."""
    placed = with_position(
        df.select("block_id", "frame_number", *columns), **_position_tiling(tiling)
    )
    row = F.struct("rn", F.array(*[F.col(c).cast("float") for c in columns]).alias("x"))
    # A group holds exactly one window.
    windows = (
        rows_in_windows(placed, window, stride)
        .groupBy("block_id", "start")
        .agg(F.sort_array(F.collect_list(row)).alias("rows"))
    )
    by_feature = F.transform(
        F.sequence(F.lit(0), F.lit(len(columns) - 1)),
        lambda f: F.transform("rows", lambda r: F.get(r["x"], f)),
    )
    return windows.select("block_id", "start", by_feature.alias("features"))


def inference_chunks(df: DataFrame, size: int, context: int, **tiling) -> DataFrame:
    """Tiles ``(ctx_start, pred_start, pred_end)`` that predict every frame exactly once."""
    placed = with_position(df.select("block_id", "frame_number"), **_position_tiling(tiling))
    rn = F.col("rn")
    return placed.filter(rn % size == 0).select(
        "block_id",
        F.greatest(F.lit(0), rn - context).cast("long").alias("ctx_start"),
        rn.alias("pred_start"),
        F.least(rn + size, F.col("n_rows")).cast("long").alias("pred_end"),
    )


def escaping_windows(starts: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    """Windows that leave their block; ``blocks`` has ``n_rows`` per block."""
    sizes = blocks.select("block_id", F.col("n_rows").alias("_size"))
    inside = (F.col("start") >= 0) & (F.col("start") + window <= F.col("_size"))
    return starts.join(sizes, "block_id", "left").filter(~F.coalesce(inside, F.lit(False))).drop("_size")


def assert_no_cross_block(starts: DataFrame, blocks: DataFrame, window: int) -> DataFrame:
    bad = escaping_windows(starts, blocks, window).limit(5).collect()
    if bad:
        raise AssertionError(f"windows that leave their block: {bad}")
    return starts


def windows_with_attack(df: DataFrame, window: int, stride: int, label: str = "label", **tiling) -> DataFrame:
    """Attack rows of every training window."""
    placed = with_position(df.select("block_id", "frame_number", label), **_position_tiling(tiling))
    attacks = F.count_if(F.col(label) > 0)
    return (
        rows_in_windows(placed, window, stride)
        .groupBy("block_id", "start")
        .agg(attacks.alias("attack_rows"))
        .withColumn("has_attack", F.col("attack_rows") > 0)
    )


def densest_window(
    df: DataFrame, wanted: Column, window: int, max_window: int, target: int, **tiling
) -> DataFrame:
    """Per block the stretch with most wanted rows, the first one among equals.

    The stretch doubles from ``window`` up to ``max_window`` until it holds ``target`` rows.
    All lengths are evaluated in one pass, as differences of one running count.
    """
    sizes = [window]
    while sizes[-1] < max_window:
        sizes.append(min(sizes[-1] * 2, max_window))
    reach = sizes[-1]
    tiling = {"chunk": CHUNK, "rows": max(TILE_ROWS, CHUNK + reach), **tiling}
    rows = df.select("block_id", "frame_number", F.coalesce(wanted.cast("int"), F.lit(0)).alias("_hit"))
    laid = tile_rows(rows, lookback=reach, **tiling)
    w = tile_window()
    laid = laid.select(
        "*",
        F.sum("_hit").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"),
        (F.col("_base") + F.row_number().over(w) - 1).alias("rn"),
    )
    laid = laid.select(
        "*",
        *[(F.col("_run") - F.coalesce(F.lag("_run", s).over(w), F.lit(0))).alias(f"_in{s}") for s in sizes],
    )
    ended = own_rows(laid)
    # Blocks no longer than the stretch are taken whole.
    best = [
        F.max_by(
            F.struct((F.col("rn") - s + 1).alias("lo"), F.col(f"_in{s}").alias("n")),
            F.when(F.col("rn") >= s - 1, F.struct(F.col(f"_in{s}"), -F.col("rn"))),
        ).alias(f"_best{s}")
        for s in sizes
    ]
    per_block = ended.groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_hit").alias("_all"), *best
    )

    def pick(s: int) -> Column:
        whole = F.struct(
            F.lit(0).cast("long").alias("lo"), F.col("n_rows").alias("hi"), F.col("_all").cast("long").alias("hits")
        )
        part = F.struct(
            F.col(f"_best{s}.lo").cast("long").alias("lo"),
            (F.col(f"_best{s}.lo") + s).cast("long").alias("hi"),
            F.col(f"_best{s}.n").cast("long").alias("hits"),
        )
        return F.when(F.col("n_rows") <= s, whole).otherwise(part)

    chosen = pick(sizes[-1])
    for s in reversed(sizes[:-1]):
        chosen = F.when(pick(s)["hits"] >= target, pick(s)).otherwise(chosen)
    return per_block.select("block_id", chosen.alias("_c")).select("block_id", "_c.*")


def context_window(df: DataFrame, columns: list[str], context: int = 126, **tiling) -> DataFrame:
    """Every row with the rows before it, oldest first, itself last."""
    laid = tile_rows(
        df.select("block_id", "frame_number", *columns), lookback=context, **tiling
    )
    row = F.array(*[col_of(c).cast("float") for c in columns])
    w = tile_window().rowsBetween(-context, 0)
    return own_rows(laid.withColumn("context", F.collect_list(row).over(w))).select(
        "block_id", "frame_number", "context"
    )
