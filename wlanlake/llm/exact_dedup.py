"""Exact duplicates by skew-safe combining, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wlanlake.llm.common import ascii_lower
from wlanlake.session import store


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Column | None = None,
) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; the largest id of equal texts stays.

    Copies are combined three times, each time by digest *and* full content: within a map task (by the
    map side of the first aggregate, whose salt is the task's number), among the tasks of one salt, and
    among the salts. A group of copies of any size reaches the last step as one row per salt. The small
    table of winners is stored; rows then find their winner by digest alone where only one content has
    that digest, which the combining has shown, and by content as well where several have.

    ``digest`` replaces the digest that groups are formed by (SHA-256), over the column ``content``.

    Null text counts as empty, so null and empty texts are equal. A null id is smaller than any other;
    if a group has no other, keep_id is null and one such row stays. Rows that repeat id and text are
    copies of each other: one is kept. An empty table gives no rows. Other columns are not read.
    """
    rows = df.select(
        F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("content")
    ).withColumn("text_sha256", F.sha2("content", 256))
    rows = rows.withColumn("digest", F.col("text_sha256") if digest is None else digest)

    combined = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("salt", "digest", "content")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        .groupBy("digest", "content")
        .agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    )
    winners = store(combined.select("digest", "keep_id", "group_size"), "winners")
    per_digest = winners.groupBy("digest").agg(
        F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
    )
    # Repeated rows (same id, same text) are numbered before the join, where no group is hot.
    again = Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(1))
    narrow = rows.select("doc_id", "digest", "text_sha256").withColumn("nth", F.row_number().over(again))
    result = narrow.join(per_digest.filter("contents = 1").drop("contents"), "digest")
    shared = per_digest.filter("contents > 1").select("digest")
    if shared.head(1):
        by_content = rows.join(shared, "digest", "left_semi")
        exact = combined.join(shared, "digest", "left_semi")
        result = result.unionByName(
            by_content.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "content").orderBy(F.lit(1))))
            .join(exact, ["digest", "content"])
            .drop("content")
        )
    return result.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
    )
