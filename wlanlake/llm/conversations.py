"""Repair of conversation structure by shortest paths over a lattice of edits."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wlanlake.session import store

#: a row's fault, as counted
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: states of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a
ACCEPTED = (0, 3)
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: where a user or assistant turn leads from each state: the pattern leaves no choice
_TURN = (2, 2, 3, 2)
_BEFORE = ((), (), (0, 1, 3), (2,))
_FAR = 1 << 40
REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
)


def damaged(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """The rows of ``df`` (conv_id, turn, role, text) after damage by crc32 of ``conv_id:turn``, modulo 20.

    0: ``gone``; 1: empty text; 2: no ``.``, ``!`` and ``?``; 3: there twice; 4: role user. Nulls are one
    space, but in conv_id and turn, where they are so for the checksum only.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id_col, "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    rows = df.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("kind"),
    )
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit(""))
        .when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
        .alias("text"),
        (F.col("kind") == 0).alias("gone"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def digest(role: Column, text: Column) -> Column:
    """Tells apart what a turn says: md5 of the role's length, the role and the text."""
    return F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))


def _edges(codes: bytes, node: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next node) of the edits at a node, which is four times the rows read and the state."""
    at, state = divmod(node, 4)
    yield "I", 5, 4 * at + _TURN[state]
    if at < len(codes):
        fault, initial = codes[at] >> 4, "suao"[codes[at] & 15]
        yield "D", 2, node + 4
        if fault not in (BLANK, DUPLICATE):
            more = 5 if fault == TRUNCATED else 0
            yield "R", 1 + more, 4 * at + 4 + _TURN[state]
            if initial in _KEEP[state]:
                yield "K", more, 4 * at + 4 + _KEEP[state][initial]


def _edges_back(codes: bytes, node: int) -> Iterator[tuple[int, int]]:
    """(cost, node before) of the edits that lead to a node."""
    at, state = divmod(node, 4)
    for before in _BEFORE[state]:
        yield 5, 4 * at + before
    if at:
        fault, initial = codes[at - 1] >> 4, "suao"[codes[at - 1] & 15]
        yield 2, node - 4
        if fault not in (BLANK, DUPLICATE):
            more = 5 if fault == TRUNCATED else 0
            for before in _BEFORE[state]:
                yield 1 + more, 4 * at - 4 + before
            for before in range(4):
                if _KEEP[before].get(initial) == state:
                    yield more, 4 * at - 4 + before


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a conversation; of equal ones the ASCII-least audit.

    A row's code is 16 times its fault, and the place of its role's initial in ``suao`` (o for others).

    Two searches, from nothing read and from all read in an accepted state, each take the nearest node from
    their heap. When the two nearest together cost more than the best meeting, each cheapest path has an
    edge from a node of the first search to one of the second, and all those crossings are known. From
    them the edges of cheapest paths are traced to both ends. The audit is then read off letter by letter,
    over all nodes that the least audit so far leads to, since audits differ in length.
    """
    size = 4 * (len(codes) + 1)
    ahead, behind = array("q", [_FAR]) * size, array("q", [_FAR]) * size
    forward, reverse = [0], []
    ahead[0] = 0
    for state in ACCEPTED:
        behind[size - 4 + state] = 0
        heappush(reverse, size - 4 + state)
    best = min(_FAR, ahead[size - 4] + behind[size - 4])
    while forward and reverse and forward[0] // size + reverse[0] // size <= best:
        if forward[0] // size <= reverse[0] // size:
            cost, node = divmod(heappop(forward), size)
            if cost == ahead[node]:
                for _, more, after in _edges(codes, node):
                    if cost + more < ahead[after]:
                        ahead[after] = cost + more
                        best = min(best, cost + more + behind[after])
                        heappush(forward, (cost + more) * size + after)
        else:
            cost, node = divmod(heappop(reverse), size)
            if cost == behind[node]:
                for more, before in _edges_back(codes, node):
                    if cost + more < behind[before]:
                        behind[before] = cost + more
                        best = min(best, cost + more + ahead[before])
                        heappush(reverse, (cost + more) * size + before)

    on_path: dict[int, set[tuple[str, int]]] = {}
    to_start, to_end = [], []
    for node in range(size):
        if ahead[node] <= best:
            for letter, more, after in _edges(codes, node):
                if ahead[node] + more + behind[after] == best:
                    on_path.setdefault(node, set()).add((letter, after))
                    to_start.append(node)
                    to_end.append(after)
    seen = set(to_start)
    while to_start:
        node = to_start.pop()
        for more, before in _edges_back(codes, node):
            if ahead[before] + more == ahead[node]:
                letters = [x for x, cost, after in _edges(codes, before) if after == node and cost == more]
                on_path.setdefault(before, set()).update((x, node) for x in letters)
                if before not in seen:
                    seen.add(before)
                    to_start.append(before)
    seen = set(to_end)
    while to_end:
        node = to_end.pop()
        for letter, more, after in _edges(codes, node):
            if behind[after] + more == behind[node]:
                on_path.setdefault(node, set()).add((letter, after))
                if after not in seen:
                    seen.add(after)
                    to_end.append(after)
    audit, places = [], {0}
    while all(place in on_path for place in places):
        least = min(letter for place in places for letter, _ in on_path[place])
        places = {after for place in places for letter, after in on_path[place] if letter == least}
        audit.append(least)
    return best, "".join(audit)


_short = lru_cache(maxsize=65536)(cheapest_edits)


def _diagnosed(batches: Iterator) -> Iterator:
    """One report per conversation, from rows sorted by conversation and turn."""
    import pyarrow as pa

    reports: list[tuple] = []

    def report(conv, codes: bytearray, first, last, distinct: int) -> None:
        faults = [sum(code >> 4 == kind for code in codes) for kind in (BLANK, DUPLICATE, TRUNCATED)]
        initials = ["suao"[code & 15] for code in codes]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        gaps = 0 if first is None else min(last - first + 1 - distinct, 2**63 - 1)
        cost, audit = (_short if len(codes) <= 64 else cheapest_edits)(bytes(codes))
        reports.append((conv, gaps, *faults, illegal, cost, audit))

    def flush():
        names = [field.split()[0] for field in REPORT.split(", ")]
        types = [pa.int64()] * 7 + [pa.string()]
        columns = list(zip(*reports)) or [()] * len(names)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
        reports.clear()
        return batch

    none = object()
    conv, codes, first, last, distinct = none, bytearray(), None, None, 0
    for batch in batches:
        for own, turn, code in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "code"))):
            if own != conv:
                if conv is not none:
                    report(conv, codes, first, last, distinct)
                conv, codes, first, last, distinct = own, bytearray(), None, None, 0
            if code is None:
                continue
            codes.append(code)
            if turn is not None and turn != last:
                first, last, distinct = turn if first is None else first, turn, distinct + 1
        yield flush()
    if conv is not none:
        report(conv, codes, first, last, distinct)
    yield flush()


class Rewriter:
    """Hashes the repaired conversation line by line, as its rows pass by."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.lines, self.hash = audit, 0, 0, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1

    def turn(self, text: str) -> None:
        self.line("assistant" if self.state == 2 else "user", text)
        self.state = _TURN[self.state]

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.turn("")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            self.turn(text)
        elif letter == "K":
            self.line(role, text)
            self.state = _KEEP[self.state][role[0]]

    def digest(self) -> str:
        self.inserted()
        return self.hash.hexdigest()


def _rewritten(batches: Iterator) -> Iterator:
    """(conv_id, repaired_sha256) from rows sorted by conversation, each conversation's audit first."""
    import pyarrow as pa

    done: list[tuple] = []

    def flush():
        columns = list(zip(*done)) or [(), ()]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], ["conv_id", "repaired_sha256"]
        )
        done.clear()
        return batch

    conv, rewriter = None, None
    for batch in batches:
        for own, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
            if audit is not None:
                if rewriter:
                    done.append((conv, rewriter.digest()))
                conv, rewriter = own, Rewriter(audit)
            else:
                rewriter.row(role, text)
        yield flush()
    if rewriter:
        done.append((conv, rewriter.digest()))
    yield flush()


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, gone): faults, cheapest edits, repaired text.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows with
    ``gone`` only tell that their conversation exists; one without other rows has zeros, an empty audit and
    the hash of an empty text.

    Rows stand in order of turn, nulls first; those of one turn in order of their ``digest``, so equal rows
    stand together. A row's faults are found by built-in functions and one window over equal turns of a
    conversation, so only a code of a row's fault and initial goes to the lattice. Conversations are read as
    a stream of sorted rows: a task holds the codes of one conversation (a byte a row, and about 100 while it
    is searched, while the audit itself has a letter for each row), never its texts, which are hashed as
    they pass in a second stream behind their audit. However many rows one conversation has, they are sorted
    on disk; its audit and its hash are the work of one task, as each is a single value over all rows.

    Initials are first characters of roles; all but s, u and a are equally foreign to the pattern. An empty
    role has none. Very long texts are hashed whole. Rows that repeat are duplicates of each other. A null
    conv_id is a conversation. An empty table gives no rows. Other columns are not read.
    """
    said = rows.select("conv_id", "turn", "role", "text", "gone", digest(F.col("role"), F.col("text")).alias("digest"))
    first = Window.partitionBy("conv_id", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(F.col("blank"), BLANK).when(F.col("nth") > 1, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(SOUND)
    )
    initial = F.expr("CASE substring(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END")
    codes = (
        said.select(
            "conv_id", "turn", "digest", "gone", initial.alias("initial"),
            (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
        )
        .withColumn("nth", F.row_number().over(first))
        .select("conv_id", "turn", "digest", F.when(~F.col("gone"), 16 * fault + F.col("initial")).alias("code"))
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    # The first column alone deals out the rows, so a conversation is in one task.
    reports = (
        codes.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "code").mapInArrow(_diagnosed, REPORT)
    )
    reports = store(reports, "reports")
    nothing = F.lit(None).cast("string")
    stream = reports.select(
        "conv_id", F.lit(None).cast("long").alias("turn"), nothing.alias("digest"), "audit", nothing.alias("role"), nothing.alias("text")
    ).unionByName(said.filter("not gone").select("conv_id", "turn", "digest", nothing.alias("audit"), "role", "text"))
    hashes = (
        stream.repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("audit").isNull(), *order[1:])
        .select("conv_id", "audit", "role", "text")
        .mapInArrow(_rewritten, "conv_id long, repaired_sha256 string")
    )
    return reports.join(
        hashes.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv"))
    ).drop("_conv")
