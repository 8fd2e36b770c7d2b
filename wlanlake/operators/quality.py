"""Profiles of a table: coverage, nulls, duplicates, outliers, correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wlanlake.operators.layout import average_ranks
from wlanlake.operators.quantiles import exact_quantiles, present_value
from wlanlake.session import store


def _long(wide: DataFrame, columns: list[str], fields: list[str]) -> DataFrame:
    """A one-row result with columns ``field__column`` as one row per column."""
    pairs = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"{f}__{c}").alias(f) for f in fields])
        for c in columns
    ]
    return wide.select(F.inline(F.array(*pairs)))


def feature_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of rows in which each column holds a value, in one pass."""
    wide = df.selectExpr(
        *[f"100D * avg(if({c} is null, 0, 1)) as coverage_pct__{c}" for c in columns]
    )
    return _long(wide, columns, ["coverage_pct"])


def null_profile(df: DataFrame, columns: list[str], threshold: float = 0.98) -> DataFrame:
    """Nulls per column, and whether the column is empty enough to be dropped."""
    wide = df.selectExpr(
        *[
            e
            for c in columns
            for e in (
                f"count_if({c} is null) as nulls__{c}",
                f"avg(if({c} is null, 1D, 0D)) as null_ratio__{c}",
            )
        ]
    )
    return _long(wide, columns, ["nulls", "null_ratio"]).withColumn(
        "drop", F.col("null_ratio") > threshold
    )


def drop_sparse(train: DataFrame, others: list[DataFrame], columns: list[str], threshold: float = 0.98):
    """Drop the columns that are almost empty in train, everywhere alike."""
    # One row per column of the schema.
    sparse = [r.feature for r in null_profile(train, columns, threshold).filter("drop").collect()]
    return [d.drop(*sparse) for d in [train, *others]], sparse


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one; copies are combined before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"),
    )


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Percentage of rows outside 1.5 interquartile ranges; columns without spread are left out.

    Rows without a value (NULL or NaN) count in the denominator, as they are rows of the table.
    """
    q = exact_quantiles(df, columns, [0.25, 0.75])
    # Two numbers per column of the schema.
    ends = {
        r["feature"]: (r["q1"], r["q3"])
        for r in q.groupBy("feature").agg(F.min_by("value", "q").alias("q1"), F.max_by("value", "q").alias("q3")).collect()
    }
    spread = [c for c in columns if c in ends and ends[c][0] != ends[c][1]]
    if not spread:
        return df.sparkSession.createDataFrame([], "feature string, outlier_pct double")

    def outside(c: str) -> Column:
        low, high = ends[c]
        x, reach = present_value(df, c).cast("double"), 1.5 * (high - low)
        return F.coalesce((x < low - reach) | (x > high + reach), F.lit(False)).cast("int")

    wide = df.agg(*[(100.0 * F.avg(outside(c))).alias(f"outlier_pct__{c}") for c in spread])
    return _long(wide, spread, ["outlier_pct"])


FEW_VALUES = 50_000


def _rank_correlations(df: DataFrame, columns: list[str]) -> list[tuple[str, str, float]]:
    """Rank correlation of every two columns over rows that have all of them.

    Values are ranked, not rows: each column meets the table of its distinct values. A column of at
    most ``FEW_VALUES`` gets them broadcast, as its rows would otherwise be dealt to as few tasks as
    it has values; others are dealt by value, after all that need not be.
    """
    ranks = store(average_ranks(df, columns), "ranks")
    # One row per column.
    distinct = {r["feature"]: r["count"] for r in ranks.groupBy("feature").count().collect()}
    ranked = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    for c in sorted(columns, key=lambda c: distinct.get(c, 0)):
        of_column = ranks.filter(F.col("feature") == c).select(
            F.col("x").alias(f"_x_{c}"), F.col("rank").alias(f"_rank_{c}")
        )
        few = distinct.get(c, 0) <= FEW_VALUES
        ranked = ranked.join(F.broadcast(of_column) if few else of_column, F.col(c) == F.col(f"_x_{c}"))
    pairs = list(combinations(columns, 2))

    def rho(a: str, b: str) -> Column:
        x, y = f"_rank_{a}", f"_rank_{b}"
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    row = ranked.agg(*[rho(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [(a, b, row[i]) for i, (a, b) in enumerate(pairs)]


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rank correlation of all the columns; a pair uses the rows in which both have a value, which NaN is not.

    It is NULL where a column does not vary over them.
    """
    df = df.select(*[present_value(df, c).alias(c) for c in columns])
    varies = df.selectExpr(*[f"min({c}) < max({c}) as {c}" for c in columns]).first()
    counts = df.selectExpr(*[f"count_if({c} is null) as {c}" for c in columns]).first()
    full = [c for c in columns if counts[c] == 0]
    found = _rank_correlations(df, full) if len(full) > 1 else []
    for a, b in combinations(columns, 2):
        if a not in full or b not in full:
            found += _rank_correlations(df.select(a, b).dropna(), [a, b])
    both_ways = found + [(b, a, r) for a, b, r in found] + [(c, c, 1.0 if varies[c] else None) for c in columns]
    return df.sparkSession.createDataFrame(both_ways, "a string, b string, rho double")


def _value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows per distinct value; whole numbers (``i``) are told apart as such, others (``d``) as doubles."""
    whole = {c for c in columns if dict(df.select(present_value(df, c).alias("x")).dtypes)["x"] == "bigint"}
    pairs = [
        F.struct(
            F.lit(c).alias("feature"),
            (present_value(df, c) if c in whole else F.lit(None).cast("bigint")).alias("i"),
            (F.lit(None).cast("double") if c in whole else present_value(df, c)).alias("d"),
        )
        for c in columns
    ]
    return (
        df.select(F.explode(F.array(*pairs)).alias("p"))
        .groupBy("p.feature", "p.i", "p.d")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: rows, nulls, distinct, min, max, mean, std, quartiles; NaN is no value.

    All but the count of distinct values is aggregated on the spot. Deviations are taken around the mean
    in a second pass, as a difference of large squares would lose digits.
    """
    x = {c: present_value(df, c).cast("double") for c in columns}
    fields = ["rows", "nulls", "min", "max", "mean"]
    basic = df.agg(
        *[
            e
            for c in columns
            for e in (
                F.count(F.lit(1)).alias(f"rows__{c}"),
                F.count_if(x[c].isNull()).alias(f"nulls__{c}"),
                F.min(x[c]).alias(f"min__{c}"),
                F.max(x[c]).alias(f"max__{c}"),
                F.avg(x[c]).alias(f"mean__{c}"),
            )
        ]
    )
    # One row: a few numbers per column of the schema.
    mean = basic.first()
    around = {c: x[c] - F.lit(mean[f"mean__{c}"]).cast("double") for c in columns}
    spread = df.agg(
        *[
            F.when(F.count(x[c]) > 1, F.sqrt(F.sum(around[c] * around[c]) / (F.count(x[c]) - 1))).alias(f"std__{c}")
            for c in columns
        ]
    )
    has = F.coalesce(F.col("i").cast("double"), "d").isNotNull()
    distinct = _value_counts(df, columns).groupBy("feature").agg(F.count_if(has).alias("distinct"))
    q = (
        exact_quantiles(df, columns, [0.25, 0.5, 0.75])
        .groupBy("feature")
        .pivot("q", [0.25, 0.5, 0.75])
        .agg(F.first("value"))
        .toDF("feature", "p25", "p50", "p75")
    )
    profile = _long(basic, columns, fields).join(_long(spread, columns, ["std"]), "feature")
    profile = profile.join(distinct, "feature", "left").join(q, "feature", "left")
    return profile.select(
        "feature", "rows", "nulls", F.coalesce("distinct", F.lit(0)).cast("long").alias("distinct"),
        "min", "max", "mean", "std", "p25", "p50", "p75",
    )


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The commonest values of each column; each task keeps only its own k before the shuffle."""
    order = Window.partitionBy("feature").orderBy(F.desc("n"), F.asc("i"), F.asc("d"))
    return (
        _value_counts(df, columns)
        .withColumn("x", F.coalesce(F.col("i").cast("double"), "d"))
        .filter("x is not null")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("feature", "x", "n", "rank")
    )
