"""Deleting rows, as a rewrite of the table without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wlanlake.functions.payload import is_simulated, raw_field
from wlanlake.functions.timeparts import since
from wlanlake.operators.filters import threat_condition


def purge_condition(
    scope: str, as_of=None, *, minutes: int | None = None, batch: str | None = None
) -> Column:
    """Which rows a purge removes: ``all``, or the ``simulated`` ones."""
    if scope == "all":
        return F.lit(True)
    if scope != "simulated":
        raise ValueError("scope is 'all' or 'simulated'")
    condition = is_simulated("raw")
    if minutes:
        condition &= F.col("ts") >= since(as_of, minutes=minutes)
    if batch and batch.strip():
        condition &= F.coalesce(raw_field("raw", "sim_batch"), F.lit("")) == batch.strip()
    return condition


def delete_condition(as_of=None, **filters) -> Column:
    """Which rows a filtered delete removes; without a time, class or source it is refused."""
    if not any(filters.get(k) for k in ("minutes", "label", "src_mac")):
        raise ValueError("a delete needs at least one of minutes, label or src_mac")
    return threat_condition(as_of, **filters)


def remaining(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that stay; a row the condition cannot decide on stays."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def purge_counts(df: DataFrame, condition: Column) -> DataFrame:
    """How many rows go and how many stay, in one pass."""
    hit = F.coalesce(condition, F.lit(False))
    return df.agg(F.count_if(hit).alias("deleted"), F.count_if(~hit).alias("remaining"))


def rewrite(df: DataFrame, condition: Column, path: str) -> DataFrame:
    """Write the remaining rows to a new path; the old files are left as they are."""
    remaining(df, condition).write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
