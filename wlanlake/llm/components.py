"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wlanlake.session import store


def components(links: DataFrame) -> DataFrame:
    """(a, b) long -> (node, label): the smallest node that links lead to, for each node with a link.

    Each round ties every node's larger neighbours, then its smaller ones, to the smallest; the rounds
    grow with the logarithm of the longest path. Each round is stored, and a node's neighbours are only
    ever counted down to their minimum.
    """
    edges = store(
        links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
            )
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = store(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = store(
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars"
        )
        least = store(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        edges = store(
            small.filter("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "stars",
        )
