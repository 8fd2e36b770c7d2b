"""Mixing sources to target weights, with exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wlanlake.llm.common import global_rank, n_words, order_key, running_total
from wlanlake.session import store


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """(source, source_size, rows_in_group) -> the same with sid, weight and target.

    Sources in order of code points, null last, weigh ``weights`` in turn and share the sum of all
    sizes. A target stops at ``epochs`` times its source's size; what is above is shared anew by weight
    until none is above. Each round is one aggregate over the table of sources.
    """
    ranked = global_rank(sizes, F.col("source").isNull().asc(), F.col("source").asc(), name="sid")
    choice = F.array(*[F.lit(int(w)) for w in weights])
    ranked = store(
        ranked.withColumn("weight", F.element_at(choice, (F.col("sid") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("most", F.col("source_size") * epochs),
        "sources",
    )
    everything = ranked.agg(F.sum("source_size")).first()[0] or 0
    rest, weight = everything, ranked.agg(F.sum("weight")).first()[0] or 1
    while True:
        # above its cap at the present level: weight * rest / total weight > most
        above = F.col("weight").cast("decimal(38,0)") * F.lit(rest) > F.col("most").cast("decimal(38,0)") * F.lit(weight)
        free = ranked.agg(
            F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("weight"),
        ).first()
        if free["weight"] == 0 or (everything - free["capped"], free["weight"]) == (rest, weight):
            break
        rest, weight = everything - free["capped"], free["weight"]
    level = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(weight))
    return ranked.withColumn("target", F.when(above, F.col("most").cast("double")).otherwise(level)).drop("most")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    epochs: int = 3,
    whole: bool = False,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``df``: doc_id, size, source, source_size, target, taken, text_hash.

    A source's documents stand in order of a hash-random key; running totals of their sizes (sums per
    slice of the key range, then inside each slice) say how many words come before each. The budget, the
    whole part of the target, is spent on full epochs of the source and then on its first documents, up
    to exactly the last word. ``whole`` takes the document at the cut either whole or not at all,
    whichever is nearer.

    Null and empty texts have size 0 and give nothing. Null is a source of its own. Rows that repeat an
    id are rows of their own; keys that tie are taken in order of size and then in any order, which
    changes no total. An empty table gives no rows. Other columns are not read. ``text_hash`` is xxhash64
    of the text.
    """
    sized = store(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            F.xxhash64(text_col).alias("text_hash"),
        ),
        "sizes",
    )
    sources = source_targets(
        sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows_in_group")),
        weights,
        epochs,
    )
    named = sources.withColumnRenamed("source", "_source")
    rows = (
        sized.join(named, F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "source", "size", "text_hash", "sid", "source_size", "target")
        .withColumn("_key", order_key("doc_id", seed=seed))
    )
    placed = running_total(rows, "sid", sources.select("sid", "rows_in_group"), F.col("size"), "_key", "before")
    budget = F.floor("target").cast("long")
    size = F.col("source_size")
    rounds = F.when(size > 0, F.floor(budget / F.greatest(size, F.lit(1)))).otherwise(0).cast("long")
    left = budget - rounds * size - F.col("before")
    if whole:
        last = F.when(left * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    else:
        last = F.least(F.greatest(left, F.lit(0)), F.col("size"))
    return placed.select(
        "doc_id",
        "size",
        "source",
        "source_size",
        "target",
        (rounds * F.col("size") + last).cast("long").alias("taken"),
        "text_hash",
    )
