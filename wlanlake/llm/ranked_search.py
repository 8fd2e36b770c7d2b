"""Ranked lexical search: bundles of items carry accumulators through the owners of their terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wlanlake.llm.shingles import words
from wlanlake.llm.tokens import texts_of
from wlanlake.session import store

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAKS = np.ones(256, bool)
_BREAKS[128:] = False
_BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
_BREAK = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
#: weights at which the next owner begins: a term held by one document in 245, in 30 and in 3.7
OWNERS = (5500, 3400, 1300)
#: bits of the table that tells terms of no item apart before anything is written: half a megabyte, whatever the items
FILTER_BITS = 1 << 22
BUNDLE = (
    "shard long, block int, item long, docs int, terms array<long>, weights array<long>, bounds array<long>, "
    "owners array<int>, places array<int>, scores array<long>, best array<long>"
)


def term_hashes(texts: list[bytes], piece: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of texts, hashes) of the terms of texts, about ``piece`` bytes at a time; long texts are cut between terms."""
    held, places, size = [], [], 0

    def hashed():
        got, begin = words(held, breaks=_BREAKS)
        return np.repeat(np.array(places, np.int64), np.diff(begin)), got.view(np.int64)

    for place, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > piece:
                stop = _BREAK.search(text, at + piece)
                end = stop.start() if stop else end
            held.append(text[at:end])
            places.append(place)
            size, at = size + end - at, end
            if size >= piece:
                yield hashed()
                held, places, size = [], [], 0
    if held:
        yield hashed()


def item_terms(items: DataFrame) -> DataFrame:
    """Adds the distinct terms of each item's text, as 64-bit hashes."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            terms = [np.zeros(0, np.int64)] * batch.num_rows
            for places, hashes in term_hashes(texts_of(batch)):
                for k in np.unique(places):
                    terms[k] = np.union1d(terms[k], hashes[places == k])
            yield pa.RecordBatch.from_arrays(
                [batch.column("item"), batch.column("item_id"), pa.array(terms, pa.list_(pa.int64()))], ["item", "item_id", "terms"]
            )

    return items.mapInArrow(work, "item long, item_id long, terms array<long>")


SHARD = "shard long, ids array<long>, lengths array<int>, term long, places array<int>, counts array<int>, sizes array<int>"


def _shards(batches: Iterator, wanted: np.ndarray, most: int, room: int) -> Iterator:
    """Shards of documents as rows: one with the documents' ids and lengths, and one for each term of some item."""
    import pyarrow as pa
    from pyspark import TaskContext

    base, made = TaskContext.get().partitionId() << 32, 0
    ids: list = []
    texts: list[bytes] = []

    def listed(values, offsets):
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

    def shard():
        nonlocal made
        # In order of id, so that equal scores are in order of place.
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k]))
        lengths = np.zeros(len(ids), np.int64)
        place_parts, hash_parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for places, hashes in term_hashes([texts[k] for k in order]):
            lengths += np.bincount(places, minlength=len(ids))
            bit = hashes & (FILTER_BITS - 1)
            may = wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
            place_parts.append(places[may])
            hash_parts.append(hashes[may])
        places, hashes = np.concatenate(place_parts), np.concatenate(hash_parts)
        by_term = np.lexsort((places, hashes))
        places, hashes = places[by_term], hashes[by_term]
        new = np.ones(len(places), bool)
        new[1:] = (places[1:] != places[:-1]) | (hashes[1:] != hashes[:-1])
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(places)))
        places, hashes = places[starts], hashes[starts]
        cut = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        offsets, n = np.append(cut, len(places)), len(cut) + 1
        number = base | made
        made += 1
        empty = np.concatenate([[0], offsets])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, number)), pa.array([[ids[k] for k in order]] + [None] * (n - 1), pa.list_(pa.int64())),
             pa.array([lengths.tolist()] + [None] * (n - 1), pa.list_(pa.int32())),
             pa.array([None] + hashes[cut].tolist(), pa.int64()), listed(places, empty), listed(counts, empty),
             listed(lengths[places], empty)],
            ["shard", "ids", "lengths", "term", "places", "counts", "sizes"],
        )
        ids.clear()
        texts.clear()

    held = 0
    for batch in batches:
        for own, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            ids.append(own)
            texts.append(text)
            held += len(text)
            if len(ids) >= most or held >= room:
                yield from shard()
                held = 0
    if ids:
        yield from shard()


def _stage(owner: int, last: bool, top: int, total_docs: int, total_terms: int):
    def work(bundles, postings):
        return _owned(bundles, postings, owner, last, top, total_docs, total_terms)

    return work


def _owned(bundles, postings, owner: int, last: bool, top: int, total_docs: int, total_terms: int):
    """One owner's stage for the bundles of one block of items and the documents of one shard.

    Adds the owner's contributions, then lets go of documents that the remaining terms cannot lift to the
    item's floor, which at least ``top`` documents have already met.
    """
    import pyarrow as pa

    term = postings.column("term").to_numpy()
    order = np.argsort(term)
    term = term[order]
    lists = []
    for k in order:
        places, tf, n = (postings.column(c)[int(k)].values.to_numpy() for c in ("places", "counts", "sizes"))
        tf, n = tf.astype(np.int64), n.astype(np.int64)
        m = 10 + (90 * n * total_docs) // total_terms
        lists.append((places, (1_000_000_000 * tf) // (1000 * tf + 8 * m)))
    kept = {"places": [], "scores": [], "best": []}
    for row in bundles.select(["docs", "terms", "weights", "bounds", "owners", "floor", "places", "scores"]).to_pylist():
        total = np.zeros(row["docs"], np.int64)
        total[np.array(row["places"], np.int64)] = row["scores"]
        own, owners = np.array(row["terms"], np.int64), np.array(row["owners"])
        at = np.searchsorted(term, own)
        for k in np.flatnonzero((owners == owner) & (at < len(term))):
            if term[at[k]] == own[k]:
                places, factor = lists[at[k]]
                total[places] += row["weights"][k] * factor
        to_come = sum(b for b, o in zip(row["bounds"], row["owners"]) if o > owner)
        some = np.flatnonzero(total > max(0, (row["floor"] or 0) - to_come - 1))
        scores = total[some]
        if len(some) > top:
            # The highest; of equal ones the first places.
            best = np.lexsort((some, -scores))[:top] if last else np.argpartition(-scores, top - 1)[:top]
        else:
            best = np.arange(len(some))
        if last:
            some, scores = some[best], scores[best]
            best = np.arange(len(some))
        kept["places"].append(some.astype(np.int32))
        kept["scores"].append(scores)
        kept["best"].append(np.zeros(0, np.int64) if last else scores[best])
    types = {"places": pa.int32(), "scores": pa.int64(), "best": pa.int64()}
    same = ["shard", "block", "item", "docs", "terms", "weights", "bounds", "owners"]
    columns = [bundles.column(c) for c in same] + [pa.array(v, pa.list_(types[c])) for c, v in kept.items()]
    return pa.table(columns, names=same + list(kept))


def _floors(bundles: DataFrame, top: int) -> DataFrame:
    """(item, floor): the score that ``top`` documents of all shards have reached; items with fewer have none."""
    place = Window.partitionBy("item").orderBy(F.col("score").desc())
    reached = bundles.select("item", F.explode("best").alias("score")).withColumn("nth", F.row_number().over(place))
    return reached.filter(F.col("nth") <= top).filter(F.col("nth") == top).select("item", F.col("score").alias("floor"))


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    top: int = 10,
    shard_docs: int = 4096,
    shard_bytes: int = 64 << 20,
    block_items: int = 256,
    owners: tuple[int, ...] = OWNERS,
) -> DataFrame:
    """The ``top`` documents of each item: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of all characters above x7F, with A-Z lower-cased. Weight,
    length norm and score are whole numbers as the registered query's contract has them; they come from
    counts over all documents.

    One scan counts the terms of each document and writes, for each shard of at most ``shard_docs`` documents,
    a list of places and counts for each term that some item has. A term has an owner by its weight: the
    first owner has the rarest terms. Items are blocks of bundles; a bundle goes to each shard and carries
    the item's terms and the shard's documents met so far through the owners' stages, where it meets the
    owner's lists of that shard by a cogroup. Between stages the highest scores so far set a floor for each
    item; documents that the terms still to come cannot lift to it are let go, which loses none of the
    result. The last stage leaves ``top`` documents of each shard, from which each item's are taken.

    A cogroup holds one shard and one block of items, whatever the table; a common term's list is cut by
    shard. Terms are told apart by 64-bit hashes.

    Null and empty texts have no terms. A null id comes after all others among equal scores; rows that
    repeat an id are documents of their own, as items that repeat an id are. An item without a term, or whose
    terms no document has, gives no rows, as does an empty table. Very long texts are cut between terms while
    their terms are counted. Other columns are not read.
    """
    numbered = store(
        items.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).withColumn(
            "item", F.monotonically_increasing_id()
        ),
        "items",
    )
    asked = store(item_terms(numbered), "asked")
    used = (
        asked.select(F.explode("terms").alias("term"))
        .groupBy(F.expr(f"(term & {FILTER_BITS - 1}) div 8").alias("byte"))
        .agg(F.expr("bit_or(shiftleft(1, cast(term & 7 as int)))").alias("bits"))
    )
    wanted = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in used.collect():
        wanted[row["byte"]] = row["bits"]

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shards = store(texts.mapInArrow(partial(_shards, wanted=wanted, most=shard_docs, room=shard_bytes), SHARD), "shards")
    named = shards.filter("term is null")
    n = F.aggregate("lengths", F.lit(0).cast("long"), lambda total, x: total + x)
    held = F.size(F.filter("lengths", lambda x: x > 0))
    total_docs, total_terms = named.agg(F.sum(held), F.sum(n)).first()
    total_docs, total_terms = int(total_docs or 0), int(total_terms or 0)
    schema = "item_id long, rank int, doc_id long, score long"
    if not total_docs:
        return docs.sparkSession.createDataFrame([], schema)

    factor = F.expr(
        "array_max(zip_with(counts, sizes, (t, n) -> (1000000000L * t) div (1000L * t + 8 * (10 + "
        f"(90L * n * {total_docs}L) div {total_terms}L))))"
    )
    lists = shards.filter("term is not null")
    weight = F.floor(1000 * F.log(F.lit(float(2 * total_docs + 2)) / (2 * F.col("df") + 1)))
    owner = sum(((F.col("weight") < edge).cast("int") for edge in owners), F.lit(0))
    weights = (
        lists.groupBy("term")
        .agg(F.sum(F.size("places")).cast("double").alias("df"), F.max(factor).alias("most"))
        .withColumn("weight", weight.cast("long"))
        .filter("weight > 0")
        .select("term", "weight", (F.col("weight") * F.col("most")).alias("bound"), owner.alias("owner"))
    )
    weights = store(weights, "weights")
    found = asked.select("item", F.explode("terms").alias("term")).join(weights, "term").groupBy("item")
    packed = found.agg(F.sort_array(F.collect_list(F.struct("term", "weight", "bound", "owner"))).alias("t"))
    count = max(1, numbered.count())
    blocks = -(-count // block_items)
    packed = store(
        packed.select(
            F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), "item",
            F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), F.col("t.bound").alias("bounds"),
            F.col("t.owner").alias("owners"),
        ),
        "bundles",
    )
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    bundles = (
        named.select("shard", F.size("ids").alias("docs"), everywhere.alias("block"))
        .join(packed, "block")
        .withColumns({"places": F.array().cast("array<int>"), "scores": F.array().cast("array<long>")})
    )
    floors = None
    for k in range(len(owners) + 1):
        floor = F.lit(None).cast("long")
        if floors is not None:
            bundles, floor = bundles.drop("floor").join(floors, "item", "left"), F.col("floor")
        bundles = bundles.select(
            "shard", "block", "item", "docs", "terms", "weights", "bounds", "owners", floor.alias("floor"), "places", "scores"
        )
        own = weights.filter(F.col("owner") == k).select("term")
        postings = lists.join(own, "term").select(
            F.col("shard").alias("at"), everywhere.alias("for"), "term", "places", "counts", "sizes"
        )
        # A shard that an owner has no list for still has its bundles; one without bundles has nothing to do.
        met = bundles.groupBy("shard", "block").cogroup(postings.groupBy("at", "for"))
        bundles = store(met.applyInArrow(_stage(k, k == len(owners), top, total_docs, total_terms), BUNDLE), "stage")
        floors = _floors(bundles, top)
    best = bundles.filter(F.size("places") > 0).select(
        "shard", "item", F.explode(F.arrays_zip("places", "scores")).alias("hit")
    )
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (
        best.join(named.select("shard", "ids"), "shard")
        .select("item", F.expr("get(ids, hit.places)").alias("doc_id"), F.col("hit.scores").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .join(numbered.select("item", "item_id"), "item")
        .select("item_id", "rank", "doc_id", "score")
    )
