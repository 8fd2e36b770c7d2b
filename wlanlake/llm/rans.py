"""Token ids in files coded by a static range asymmetric numeral system.

A folder holds ``table/``, one record with the frequencies that all blocks share, and ``blocks/``, files
of independent blocks. A record ends with a line feed, which readers skip. All numbers are little-endian.

table record: b"RTAB", u32 symbols, u32 crc32 of the frequencies, u32 frequency of each symbol (sum 2^20)
block record: the header HEADER, then i64 ids of the documents, u8 whether the id is null, u64 tokens of
each document, u64 word position of each checkpoint, u64 states of its lanes, u32 words

A block holds whole documents. Symbol t of a block is coded in lane t modulo the number of lanes, with
64-bit states and 32-bit words. A checkpoint has the states and the word position before every
``stride``-th step, so that parts of a block can be decoded at once.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wlanlake.llm.tokens import default_path, texts_of, word_encoder
from wlanlake.session import store, work_dir

SCALE_BITS = 20
LOW = 1 << 32
#: magic, bytes of the record, file, block, documents, lanes, steps between checkpoints, checkpoints, tokens,
#: words, crc32 of the ids, crc32 of what follows the header
HEADER = struct.Struct("<4sQIIIIIIQQII")


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2^20, at least one for each symbol that occurs."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(len(counts), np.uint32)
    freq = np.where(counts > 0, np.maximum(1, (counts.astype(object) << SCALE_BITS) // total), 0).astype(np.int64)
    over = int(freq.sum()) - (1 << SCALE_BITS)
    for k in np.argsort(-freq, kind="stable"):
        if over == 0:
            break
        less = min(over, int(freq[k]) - 1)
        freq[k] -= less
        over -= less
    return freq.astype(np.uint32)


class Table:
    """Frequencies and what follows from them."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self._symbols = None

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbols

    def to_bytes(self) -> bytes:
        body = self.freq.astype("<u4").tobytes()
        return b"RTAB" + struct.pack("<II", len(self.freq), zlib.crc32(body)) + body

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        n, crc = struct.unpack_from("<II", raw, 4)
        body = raw[12 : 12 + 4 * n]
        if raw[:4] != b"RTAB" or zlib.crc32(body) != crc:
            raise ValueError("damaged frequency table")
        return cls(np.frombuffer(body, "<u4"))


def encode_ids(ids: np.ndarray, table: Table, lanes: int, stride: int):
    """Words, and the states and word position before each checkpoint's step."""
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    bits, limit, half = np.uint64(SCALE_BITS), np.uint64(64 - SCALE_BITS), np.uint64(32)
    words, states = [], []
    for t in range(steps - 1, -1, -1):
        symbols = ids[t * lanes : (t + 1) * lanes]
        x, f = state[: len(symbols)], table.freq[symbols]
        full = (x >> limit) >= f
        words.append((x[full] & np.uint64(LOW - 1)).astype("<u4"))
        x = np.where(full, x >> half, x)
        whole = x // f
        state[: len(symbols)] = (whole << bits) + (x - whole * f) + table.first[symbols]
        if t % stride == 0:
            states.append(state.copy())
    words.reverse()
    states.reverse()
    ends = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.uint64)
    return (
        np.concatenate(words) if words else np.zeros(0, "<u4"),
        np.array(states, np.uint64).reshape(-1, lanes),
        ends[:steps:stride],
    )


def decode_ids(words, state, position: int, table: Table, n: int) -> np.ndarray:
    """``n`` symbols from a checkpoint's states and word position."""
    lanes = len(state)
    state = state.astype(np.uint64)
    out = np.empty(n, np.uint32)
    bits, mask, half = np.uint64(SCALE_BITS), np.uint64((1 << SCALE_BITS) - 1), np.uint64(32)
    wide = words.astype(np.uint64)
    for at in range(0, n, lanes):
        k = min(lanes, n - at)
        x = state[:k]
        slot = x & mask
        symbols = table.symbols[slot]
        out[at : at + k] = symbols
        x = table.freq[symbols] * (x >> bits) + slot - table.first[symbols]
        low = np.flatnonzero(x < np.uint64(LOW))
        x[low] = (x[low] << half) | wide[position : position + len(low)]
        position += len(low)
        state[:k] = x
    return out


def block_bytes(docs: list, ids: np.ndarray, tokens: list[int], table: Table, file: int, block: int, lanes: int, stride: int):
    words, states, positions = encode_ids(ids, table, lanes, stride)
    body = b"".join([
        np.array([d or 0 for d in docs], "<i8").tobytes(),
        np.array([d is None for d in docs], "u1").tobytes(),
        np.array(tokens, "<u8").tobytes(),
        positions.astype("<u8").tobytes(),
        states.astype("<u8").tobytes(),
        words.tobytes(),
    ])
    return HEADER.pack(
        b"RBLK", HEADER.size + len(body), file, block, len(docs), lanes, stride, len(states), len(ids), len(words),
        zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body),
    ) + body


@dataclass
class Block:
    """A block as read; ``ids`` decodes all of it, ``part`` what follows one checkpoint."""

    file: int
    block: int
    docs: list
    tokens: np.ndarray
    lanes: int
    stride: int
    positions: np.ndarray
    states: np.ndarray
    words: np.ndarray
    n: int
    crc: int

    def part(self, checkpoint: int, table: Table) -> np.ndarray:
        each = self.lanes * self.stride
        n = min(each, self.n - checkpoint * each)
        return decode_ids(self.words, self.states[checkpoint], int(self.positions[checkpoint]), table, n)

    def ids(self, table: Table) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.uint32)
        ids = decode_ids(self.words, self.states[0], int(self.positions[0]), table, self.n)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.crc:
            raise ValueError(f"checksum of file {self.file}, block {self.block} differs")
        return ids


def read_blocks(raw: bytes) -> Iterator[Block]:
    at = 0
    while at < len(raw):
        magic, size, file, block, docs, lanes, stride, marks, n, words, crc, body_crc = HEADER.unpack_from(raw, at)
        body = memoryview(raw)[at + HEADER.size : at + size]
        if magic != b"RBLK" or zlib.crc32(body) != body_crc:
            raise ValueError(f"damaged block at byte {at}")
        parts, from_ = [], 0
        for kind, count in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u8", marks), ("<u8", marks * lanes), ("<u4", words)):
            parts.append(np.frombuffer(body, kind, count, from_))
            from_ += count * np.dtype(kind).itemsize
        names = [None if null else int(d) for d, null in zip(parts[0], parts[1])]
        yield Block(file, block, names, parts[2].astype(np.int64), lanes, stride, parts[3], parts[4].reshape(marks, lanes), parts[5], n, crc)
        at += size + 1


def token_ids(df: DataFrame, path: str, end_id: int) -> DataFrame:
    """One row per document: doc_id, its ids with the end id, and whether they take four bytes each or two."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = word_encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [np.frombuffer(own + end, "<u4") for own in encoder.encode(texts_of(batch))]
            wide = [int(own.max()) >= 1 << 16 for own in ids]
            ids = [own.astype("<u4" if w else "<u2").tobytes() for own, w in zip(ids, wide)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(wide, pa.bool_())], ["doc_id", "ids", "wide"]
            )

    return df.select("doc_id", "text").mapInArrow(work, "doc_id long, ids binary, wide boolean")


def ids_of(batch) -> list[np.ndarray]:
    """The ids of each row of ``token_ids``."""
    rows = zip(batch.column("ids").to_pylist(), batch.column("wide").to_pylist())
    return [np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4") for ids, wide in rows]


def token_counts(ids: DataFrame, end_id: int) -> np.ndarray:
    """How often each id occurs in all rows of ``token_ids``; at most the vocabulary comes to the driver."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(end_id + 1, np.int64)
        for batch in batches:
            got = np.bincount(np.concatenate([np.zeros(0, "<u4"), *ids_of(batch)]), minlength=len(total))
            if len(got) > len(total):
                total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
            total += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["id", "n"])

    rows = ids.select("ids", "wide").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r["id"] for r in rows], default=end_id) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_records(df: DataFrame, path: str) -> None:
    """Writes a binary column, a line feed behind each value, to one file for each partition."""
    df.select(F.col(df.columns[0]).cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def write_tokens(
    df: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end_id: int = 2,
    file_tokens: int = 4_000_000,
    block_tokens: int = 1 << 18,
    lanes: int = 1024,
    stride: int = 128,
) -> None:
    """Writes all documents, each with the end id, in ascending order of their ids.

    Texts are tokenized once: their ids are stored, counted, and sorted by range, one file for each range. A
    block is closed behind the document that reaches ``block_tokens``; a longer document is one block.
    """
    path = path or default_path()
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stored = store(token_ids(docs, path, end_id), "ids")
    counts = token_counts(stored, end_id)
    freq = scaled(counts)
    spark = df.sparkSession
    table_bytes = Table(freq).to_bytes()
    write_records(spark.createDataFrame([(bytearray(table_bytes),)], "value binary").coalesce(1), f"{folder}/table")

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = Table.from_bytes(table_bytes)
        file, block = TaskContext.get().partitionId(), 0
        names, tokens, ids, n = [], [], [], 0

        def close():
            value = block_bytes(names, np.concatenate(ids), tokens, table, file, block, lanes, stride)
            return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

        for batch in batches:
            for doc, own in zip(batch.column("doc_id").to_pylist(), ids_of(batch)):
                names.append(doc)
                ids.append(own)
                tokens.append(len(own))
                n += tokens[-1]
                if n >= block_tokens:
                    yield close()
                    names, tokens, ids, n, block = [], [], [], 0, block + 1
        if names:
            yield close()

    files = max(1, -(-int(counts.sum()) // file_tokens))
    ordered = stored.repartitionByRange(files, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first()
    )
    write_records(ordered.mapInArrow(encode, "value binary"), f"{folder}/blocks")


def read_table(spark, folder: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(f"{folder}/table").filter("length > 0").select("content").first()[0])


def read_tokens(spark, folder: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids_crc32, file_no, block_no, and ``ids`` if asked for.

    Every block is decoded and its checksums are verified. A first look at the blocks' headers gives
    the tokens of each file, from which the files' places in the whole follow.
    """
    table_bytes = read_table(spark, folder)
    files = spark.read.format("binaryFile").load(f"{folder}/blocks").filter("length > 0").select("content")
    fields = [("doc_id", "long"), ("in_file", "long"), ("n_tokens", "long"), ("ids_crc32", "long"), ("file_no", "long"), ("block_no", "long")]
    fields += [("ids", "binary")] * with_ids

    def sizes(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [(b.file, b.n) for raw in texts_of(batch, "content") for b in read_blocks(raw)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(2)], ["file_no", "tokens"]
            )

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = Table.from_bytes(table_bytes)
        for batch in batches:
            for raw in texts_of(batch, "content"):
                before = 0
                for b in read_blocks(raw):
                    ids = b.ids(table).astype("<u4")
                    ends = np.cumsum(b.tokens)
                    own = [ids[e - n : e].tobytes() for e, n in zip(ends, b.tokens)]
                    columns = [b.docs, before + ends - b.tokens, b.tokens, [zlib.crc32(x) for x in own]]
                    columns += [[b.file] * len(own), [b.block] * len(own)]
                    arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(own, pa.binary())] * with_ids
                    yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])
                    before += b.n

    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        files.mapInArrow(sizes, "file_no long, tokens long")
        .groupBy("file_no")
        .agg(F.sum("tokens").alias("tokens"))
        .select("file_no", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    )
    docs = files.mapInArrow(decode, ", ".join(f"{n} {t}" for n, t in fields))
    return docs.join(bases, "file_no").withColumn("start", F.col("base") + F.col("in_file")).drop("base", "in_file")


def token_files(df: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the files (see ``write_tokens``) and reads them back (see ``read_tokens``).

    Null text counts as empty: such a document is its end id. Null ids come first. Rows that repeat an
    id are documents of their own, in any order among themselves. An empty table gives no rows. Other
    columns are not read. Without ``folder``, files go to the folder that all executors share.
    """
    folder = folder or work_dir(df.sparkSession, "tokens")
    write_tokens(df, folder, **options)
    return read_tokens(df.sparkSession, folder)
