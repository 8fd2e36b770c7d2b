"""Exact quantiles by selection: sketches narrow a bracket around each rank, counts make it exact."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wlanlake.functions.util import col_of

#: a sketch's rank is right to one part in ACCURACY; brackets reach two parts to either side
ACCURACY = 10_000
MARGIN = 2 / ACCURACY
WHOLE = ("tinyint", "smallint", "int", "bigint")


def present_value(df: DataFrame, c: str) -> Column:
    """A column's value as bigint or double, whichever holds it exactly; NaN is no value."""
    if dict(df.dtypes)[c] in WHOLE:
        return col_of(c).cast("bigint")
    x = col_of(c).cast("double")
    return F.when(~F.isnan(x), x)


@dataclass
class _Bracket:
    """Two values between which the wanted ranks of a column lie; None is open."""

    feature: str
    x: str
    q: float
    total: int
    low: float | int | None = None
    high: float | int | None = None
    below: int = 0
    inside: int = 0
    counted: bool = False
    may_narrow: bool = True

    @property
    def at(self) -> float:
        return self.q * (self.total - 1)

    def holds(self) -> Column:
        x, inside = F.col(self.x), F.col(self.x).isNotNull()
        inside = inside if self.low is None else inside & (x >= F.lit(self.low))
        return inside if self.high is None else inside & (x <= F.lit(self.high))

    def under(self) -> Column:
        return F.lit(False) if self.low is None else F.col(self.x) < F.lit(self.low)

    def wide(self, most: int) -> bool:
        return self.inside > most and self.may_narrow and (self.low is None or self.high is None or self.low < self.high)


def _points(p: float) -> list[float]:
    return [max(0.0, p - MARGIN), min(1.0, p + MARGIN)]


def _sketch(x: Column, points: list[float]) -> Column:
    return F.percentile_approx(x, F.array(*[F.lit(float(p)) for p in points]), ACCURACY)


def _count(wide: DataFrame, brackets: list[_Bracket]) -> None:
    """Rows below and inside of each bracket; one that misses a wanted rank is opened and counted again."""
    open_ = [b for b in brackets if not b.counted]
    while open_:
        row = wide.agg(
            *[F.count_if(b.under()).alias(f"u{k}") for k, b in enumerate(open_)],
            *[F.count_if(b.holds()).alias(f"i{k}") for k, b in enumerate(open_)],
        ).first()
        for k, b in enumerate(open_):
            b.below, b.inside, b.counted = row[f"u{k}"], row[f"i{k}"], True
            if floor(b.at) < b.below:
                b.low, b.counted, b.may_narrow = None, False, False
            if ceil(b.at) >= b.below + b.inside:
                b.high, b.counted, b.may_narrow = None, False, False
        open_ = [b for b in open_ if not b.counted]


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], most: int = 1_000_000) -> DataFrame:
    """Exact quantiles with linear interpolation: rows ``(feature, q, value)``.

    The first pass makes one mergeable sketch per column, which gives a bracket of values for each
    quantile; the second counts the rows below and inside of it. Brackets that hold more than ``most``
    rows are narrowed by sketches of their inside until they do not, or hold one value only. Only values
    inside of brackets are then shuffled, counted per distinct value. Every pass but the last is an
    aggregate to one row; the bounds, two numbers per column and quantile, are all that the driver sees.
    ``df`` is read three times or more, so store it if it is costly.

    Whole numbers are compared as such. NULL and NaN are no values; columns without any have no rows in
    the result.
    """
    spark = df.sparkSession
    wide = df.select(*[present_value(df, c).alias(f"x{k}") for k, c in enumerate(columns)])
    points = [p for q in probs for p in _points(q)]
    row = wide.agg(
        *[F.count(f"x{k}").alias(f"n{k}") for k in range(len(columns))],
        *[_sketch(F.col(f"x{k}"), points).alias(f"s{k}") for k in range(len(columns))],
    ).first()
    brackets = []
    for k, c in enumerate(columns):
        total = row[f"n{k}"]
        for j, q in enumerate(probs if total else []):
            b = _Bracket(c, f"x{k}", float(q), total, inside=total, counted=total <= most)
            if not b.counted:
                b.low, b.high = row[f"s{k}"][2 * j : 2 * j + 2]
            brackets.append(b)
    _count(wide, brackets)
    while any(b.wide(most) for b in brackets):
        narrow = [b for b in brackets if b.wide(most)]
        inner = [_points((b.at - b.below) / max(1, b.inside - 1)) for b in narrow]
        row = wide.agg(
            *[_sketch(F.when(b.holds(), F.col(b.x)), p).alias(f"s{k}") for k, (b, p) in enumerate(zip(narrow, inner))]
        ).first()
        for k, b in enumerate(narrow):
            bounds = row[f"s{k}"]
            b.may_narrow = bounds != [b.low, b.high]
            (b.low, b.high), b.counted = bounds, False
        _count(wide, narrow)

    schema = "feature string, q double, value double"
    single = [b for b in brackets if b.low is not None and b.low == b.high]
    done = spark.createDataFrame([(b.feature, b.q, float(b.low)) for b in single], schema)
    rest = [b for b in brackets if not (b.low is not None and b.low == b.high)]
    if not rest:
        return done
    kinds = dict(wide.dtypes)
    entries = []
    for k, b in enumerate(rest):
        whole = kinds[b.x] == "bigint"
        value = F.struct(
            F.lit(k).alias("k"),
            (F.col(b.x) if whole else F.lit(None).cast("bigint")).alias("i"),
            (F.lit(None).cast("double") if whole else F.col(b.x)).alias("d"),
        )
        entries.append(F.when(b.holds(), value))
    held = (
        wide.select(F.explode(F.filter(F.array(*entries), lambda e: e.isNotNull())).alias("e"))
        .groupBy("e.k", "e.i", "e.d")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # One row per column and quantile.
    wanted = spark.createDataFrame(
        [(k, b.feature, b.q, b.below, floor(b.at), ceil(b.at), b.at - floor(b.at)) for k, b in enumerate(rest)],
        "k int, feature string, q double, below bigint, first bigint, last bigint, part double",
    )
    upto = Window.partitionBy("k").orderBy("i", "d")
    placed = (
        held.join(F.broadcast(wanted), "k")
        .withColumn("end", F.col("below") + F.sum("n").over(upto))
        .withColumn("start", F.col("end") - F.col("n"))
        .withColumn("x", F.coalesce(F.col("i").cast("double"), "d"))
    )

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(rank) >= F.col("start")) & (F.col(rank) < F.col("end")), F.col("x")))

    ends = placed.groupBy("feature", "q").agg(at("first").alias("a"), at("last").alias("b"), F.max("part").alias("part"))
    value = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part"))
    return done.unionByName(ends.select("feature", "q", value.alias("value")))
