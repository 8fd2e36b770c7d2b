"""Causal rolling aggregates over the frames of a block, and the model row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.operators.frames import KEYS, carry_columns, with_delta_features, with_row_features
from wlanlake.operators.layout import own_rows, tile_rows

INPUTS = [spec.flat(c) for c in spec.ROLL_MEAN_STD + spec.ROLL_RATE]
SPREAD_INPUTS = [spec.flat(c) for c in spec.ROLL_MEAN_STD]
_ORDER = "partition by block_id, _tile order by frame_number"


def _running(laid: DataFrame) -> DataFrame:
    """Running sums from the tile's first row on; each costs the same per row however wide
    the frame is, where a moving frame would be summed anew for every row."""
    upto = f"over ({_ORDER} rows between unbounded preceding and current row)"
    sums = []
    for c in INPUTS:
        x = f"coalesce(cast({c} as double), 0D)"
        sums.append(f"sum({x}) {upto} as _s_{c}")
        sums.append(f"count({c}) {upto} as _n_{c}")
        if c in SPREAD_INPUTS:
            sums.append(f"sum({x} * {x}) {upto} as _q_{c}")
    return laid.selectExpr("*", *sums)


def _moving(summed: DataFrame, keep: list[str], windows: list[int]) -> DataFrame:
    """Sums over the current row and the n rows before it, as differences of running sums."""
    running = [c for c in summed.columns if c[:3] in ("_s_", "_n_", "_q_")]
    return summed.selectExpr(
        *keep,
        *[
            f"{c} - coalesce(lag({c}, {n + 1}) over ({_ORDER}), 0) as _{n}{c}"
            for n in windows
            for c in running
        ],
    )


def _roll_column(n: int, c: str, kind: str) -> str:
    cnt, total = f"_{n}_n_{c}", f"_{n}_s_{c}"
    mean = f"{total} / nullif({cnt}, 0)"
    if kind != "std":
        return mean
    var = f"_{n}_q_{c} / nullif({cnt}, 0) - ({mean}) * ({mean})"
    return f"if({cnt} > 1, sqrt(greatest({var}, 0D)), null)"


def with_rollups(laid: DataFrame, keep: list[str], windows=spec.ROLL_WINDOWS) -> DataFrame:
    """Rolling columns in model order on rows that already have a layout.

    ``rollN`` covers N + 1 frames: the current one and N before it. Absent values count
    neither above nor below the line; no value gives no mean, one value no spread.
    """
    moved = _moving(_running(laid), keep, list(windows))
    rolled = []
    for n in windows:
        for names, kind in (
            (spec.ROLL_MEAN_STD, "mean"),
            (spec.ROLL_MEAN_STD, "std"),
            (spec.ROLL_RATE, "rate"),
        ):
            for name in names:
                target = spec.flat(f"roll{n}.{name}.{kind}")
                rolled.append(f"cast({_roll_column(n, spec.flat(name), kind)} as float) as {target}")
    return moved.selectExpr(*keep, *rolled)


def causal_rollups(
    features: DataFrame, windows=spec.ROLL_WINDOWS, keep: list[str] | None = None, **tiling
) -> DataFrame:
    """Feature rows -> keys (or ``keep``) and the rolling columns."""
    keep = keep or KEYS
    needed = list(dict.fromkeys(keep + ["block_id", "frame_number"] + INPUTS))
    laid = tile_rows(features.select(*needed), lookback=max(windows), **tiling)
    return own_rows(with_rollups(laid, keep + ["_own"], windows))


def model_rows(features: DataFrame, **tiling) -> DataFrame:
    """Feature rows -> every column of ``features`` plus the rolling columns."""
    return causal_rollups(features, keep=features.columns, **tiling)


def model_rows_from_raw(raw: DataFrame, **tiling) -> DataFrame:
    """Raw records -> the 82-column model row in one shuffle and one sort.

    The copies of the tile layout get their delta features from the carried state, so the
    rolling columns can be computed right away on the same layout.
    """
    laid = tile_rows(
        with_row_features(raw), carry=carry_columns(), lookback=max(spec.ROLL_WINDOWS), **tiling
    )
    features = with_delta_features(laid)
    return own_rows(with_rollups(features, features.columns))


def future_leaks(features: DataFrame, column: str, cut: int, shift: float, **tiling) -> DataFrame:
    """Rows at or before ``cut`` whose rolling columns change when later rows are perturbed.

    Empty for a causal operator.
    """
    changed = features.withColumn(
        column,
        F.when(F.col("frame_number") > cut, F.col(column) + F.lit(shift))
        .otherwise(F.col(column))
        .cast("float"),
    )
    past = F.col("frame_number") <= cut
    before = causal_rollups(features, **tiling).filter(past)
    after = causal_rollups(changed, **tiling).filter(past)
    return before.exceptAll(after)
