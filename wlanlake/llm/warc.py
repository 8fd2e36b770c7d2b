"""WARC archives: one request, one response or revisit, and one metadata record per page; reading and assembly."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wlanlake.llm.tokens import texts_of
from wlanlake.session import store, work_dir

CRLF = "\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource")
RECORD = (
    "record_id string, type string, concurrent_to array<string>, target string, refers_to string, "
    "payload_bytes long, payload_digest string, page_id long, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: 20 bits, or five hex digits, are four letters."""
    digest = F.sha1(payload.cast("binary"))
    parts = [F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(digest: Column) -> Column:
    parts = [F.substring(digest, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record but for its last line end; headers whose value is null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, length), F.lit(CRLF * 2), block, F.lit(CRLF))


def write_warc(
    pages: DataFrame, folder: str, revisit_from: int = 0, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip"
) -> None:
    """Writes the records of all pages (page_id, url, html); every file is a series of whole records.

    Of pages whose payloads are equal and have at least ``revisit_from`` bytes, the one of the smallest
    page_id (null last, then the first row) is a response; the others are revisits that refer to it. The
    id of such a response is made of its payload's SHA-256, so revisits know it without a look-up. Spark's
    text sink writes the records; its line end is the records' last one.
    """
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        url.alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("same", F.sha2("payload", 256))
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    firsts = rows.groupBy("same").agg(F.min(place).alias("first"))
    size = F.octet_length("payload")
    told = (
        rows.join(firsts, "same")
        .withColumn("shared", size >= revisit_from)
        .withColumn("response", ~F.col("shared") | (F.col("row") == F.col("first.row")))
    )
    own = lambda kind: _urn(F.md5(F.concat_ws(":", F.lit(kind), "page_id", "row").cast("binary")))
    original = _urn(F.col("same"))
    anchor = F.when(~F.col("response"), own("revisit")).when(F.col("shared"), original).otherwise(own("response"))
    # Each record but the first takes these.
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        size.cast("string"),
        F.lit(CRLF * 2),
    )
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    get = F.concat(
        F.lit("GET "), F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)),
        F.lit(f" HTTP/1.1{CRLF}Host: "), host, F.lit(CRLF * 2),
    )
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit(date))]
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("payload")))
    revisit = ~F.col("response")
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", anchor),
            *common,
            ("WARC-Profile", F.when(revisit, IDENTICAL)),
            ("WARC-Refers-To", F.when(revisit, original)),
            ("WARC-Payload-Digest", digest),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", own("request")),
            *common,
            ("WARC-Concurrent-To", anchor),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.coalesce(get, F.lit(f"GET / HTTP/1.1{CRLF * 2}")),
    )
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", own("metadata")),
            *common,
            ("WARC-Concurrent-To", anchor),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")),
    )
    records = told.select(F.explode(F.array(request, response, metadata)).alias("value"))
    records.write.option("lineSep", CRLF).option("compression", compression).text(folder)


def _plain(raw: bytes) -> bytes:
    """Undoes gzip, be it one member for the file or one for each record."""
    out = []
    while raw[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        raw = member.unused_data
    return b"".join(out) if out else raw


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names, all values) and block of each record; lengths alone say where a record ends."""
    raw = _plain(raw)
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        version, *lines = raw[at:end].decode("utf-8", "replace").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers: dict[str, list[str]] = {}
        for line in lines:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        n = int(headers["content-length"][0])
        yield headers, raw[end + 4 : end + 4 + n]
        at = end + 4 + n + 4


def _fields(headers: dict, block: bytes, with_payload: bool) -> tuple:
    first = lambda name: headers.get(name, [None])[0]
    kind, size, digest, page, payload = first("warc-type"), None, None, None, None
    if kind in ("response", "revisit"):
        head, _, body = block.partition(b"\r\n\r\n")
        told = first("warc-payload-digest")
        digest = told.removeprefix("sha1:") if told else None
        if kind == "response":
            size, found = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
            if digest not in (None, found):
                raise ValueError(f"payload of {first('warc-record-id')} does not have its digest")
            digest, payload = found, body if with_payload else None
        else:
            sizes = [x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            size = int(sizes[0].partition(b":")[2]) if sizes else None
    elif kind == "metadata":
        pages = [x for x in block.split(b"\r\n") if x.startswith(b"page-id:")]
        page = int(pages[0].partition(b":")[2]) if pages else None
    return (
        first("warc-record-id"), kind, headers.get("warc-concurrent-to", []), first("warc-target-uri"),
        first("warc-refers-to"), size, digest, page, payload,
    )


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record, whole files to a task; payload digests are computed anew and compared."""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for raw in texts_of(batch, "content"):
                rows = [_fields(headers, block, with_payload) for headers, block in parse_warc(raw)]
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").load(folder).filter("length > 0").select("content")
    return files.mapInArrow(work, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, request, response, metadata, n_requests, n_metadata.

    A capture is a response, revisit or resource record with the records that are concurrent to it: those
    that name it or that it names, and those so tied to a request or metadata record that is. Records tied
    to no such record are captures of their own. Of several requests or metadata records of a capture, the
    one with the smallest id is shown; the counts tell how many there are.
    """
    ties = records.select(F.col("record_id").alias("one"), F.explode("concurrent_to").alias("other"))
    ties = ties.unionByName(ties.select(F.col("other").alias("one"), F.col("one").alias("other"))).distinct()
    anchors = records.filter(F.col("type").isin(*ANCHORS)).select(F.col("record_id").alias("other")).distinct()
    near = ties.join(anchors, "other").groupBy("one").agg(F.min("other").alias("near"))
    via = near.select(F.col("one").alias("other"), "near")
    far = ties.join(via, "other").groupBy("one").agg(F.min("near").alias("far"))
    root = F.when(F.col("type").isin(*ANCHORS), F.col("record_id")).otherwise(F.coalesce("near", "far", "record_id"))
    tied = (
        records.join(near.withColumnRenamed("one", "record_id"), "record_id", "left")
        .join(far.withColumnRenamed("one", "record_id"), "record_id", "left")
        .withColumn("capture_id", root)
    )
    kind = F.col("type")
    shown = F.struct("record_id", "type", "target", "refers_to", "payload_bytes", "payload_digest", "payload")
    return tied.groupBy("capture_id").agg(
        F.min(F.when(kind == "request", F.struct("record_id", "target"))).alias("request"),
        F.min(F.when(kind.isin(*ANCHORS), shown)).alias("response"),
        F.min(F.when(kind == "metadata", F.struct("record_id", "page_id"))).alias("metadata"),
        F.count(F.when(kind == "request", 1)).alias("n_requests"),
        F.count(F.when(kind == "metadata", 1)).alias("n_metadata"),
    )


def archive_pages(pages: DataFrame, folder: str | None = None, revisit_from: int = 0) -> DataFrame:
    """Writes the archives, reads them back and assembles them; adds refers_to_page to the captures.

    Null html is an empty payload, null or empty urls give no target; a null page_id is the last of equal
    pages. Rows that repeat an id are pages of their own. An empty table gives no rows. Other columns are
    not read. Without ``folder``, files go to the folder that all executors share. Rows must come in the
    same order whenever ``pages`` is read, as from files.
    """
    spark = pages.sparkSession
    folder = folder or work_dir(spark, "warc")
    write_warc(pages, folder, revisit_from)
    captures = store(assemble(read_warc(spark, folder)), "captures")
    originals = captures.filter("response.type = 'response'").select(
        F.col("response.record_id").alias("original"), F.col("metadata.page_id").alias("refers_to_page")
    )
    return captures.join(originals, F.col("response.refers_to") == F.col("original"), "left").drop("original")
