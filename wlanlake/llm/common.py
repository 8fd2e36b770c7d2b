"""Parts the operators share: tables, words, exact ranks and running totals without a hot task."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wlanlake.session import store

WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII takes the fast built-in, which does the same there."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def n_words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def unit_hash(*cols, seed: str = "") -> Column:
    """A number in [0, 1) from md5, so that other engines can compute the same order."""
    return F.conv(F.substring(order_key(*cols, seed=seed), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def order_key(*cols, seed: str = "") -> Column:
    """Hash-random key as text: md5 of the seed and the columns, null as an empty part."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("")) for c in cols]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


def hash_sample(df: DataFrame, most: int, *cols, seed: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """At most ``most`` rows, those with the smallest ``order_key``; ``df`` is read twice.

    A threshold that follows from the number of rows goes first, so a partition hands on its share of the
    sample and not ``most`` rows. It is six deviations wide; ties of the key are ordered by ``ties``.
    """
    n = df.count()
    share = most / max(n, 1)
    rows = df.withColumn("_key", order_key(*cols, seed=seed))
    if share < 1:
        rows = rows.filter(unit_hash(*cols, seed=seed) < min(1.0, share + 6 * (share / n) ** 0.5))
    return rows.orderBy("_key", *ties).limit(most).drop("_key")


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Adds the place (from 0) of each row in the whole order, by a range sort.

    Only the row counts of the partitions meet in one place.
    """
    rows = store(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id()),
        "rank",
    ).withColumn("_part", F.shiftright("_row", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    in_part = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        rows.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + in_part)
        .drop("_part", "_row", "_offset")
    )


def running_total(rows: DataFrame, group: str, counts: DataFrame, value: Column, key: str, name: str) -> DataFrame:
    """Adds the total of ``value`` over the rows of the same group that come before in order of ``key``.

    ``key`` is an ``order_key`` column, ``counts`` has (group, rows_in_group), ``rows`` must be cheap
    to read again. A group's key range is cut into sqrt(n) even slices: the totals of the slices and
    the rows of one slice are about sqrt(n) each, so no task sees a whole group. Rows whose keys tie
    are taken in any order. Columns that begin with an underscore are used inside.
    """
    unit = F.conv(F.substring(key, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
    cut = rows.join(counts, group).withColumn(
        "_slice", F.floor(unit * F.ceil(F.sqrt("rows_in_group"))).cast("long")
    ).drop("rows_in_group").withColumn("_value", value)
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        cut.groupBy(group, "_slice")
        .agg(F.sum("_value").alias("_total"))
        .select(group, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    )
    inside = Window.partitionBy(group, "_slice").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(bases, [group, "_slice"])
        .withColumn(name, (F.col("_base") + F.col("_inside")).cast("long"))
        .drop("_slice", "_value", "_inside", "_base")
    )
