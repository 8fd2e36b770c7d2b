"""Scanning capture CSV files."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.operators.layout import union_all
from wlanlake.session import store

CORRUPT = "_corrupt_record"
MALFORMED = "_malformed"
BOOLEAN_CELLS = ["wlan.fc.retry", "wlan.fc.protected", "radiotap.channel.flags.cck"]


def _reader(spark: SparkSession):
    return (
        spark.read.option("header", True)
        .option("encoding", "ISO-8859-1")
        .option("mode", "PERMISSIVE")
        # Python-style quoting: a doubled quote inside a quoted cell.
        .option("escape", '"')
    )


def header_catalogue(spark: SparkSession, path) -> DataFrame:
    """One row per file that is not empty: ``path`` and its first line.

    A task for each file reads the beginning of it and stops; the files are not scanned. A first line
    goes over one line of text.
    """

    def first_rows(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    # One split per file and one file per task, for this small read only.
    wide = {"spark.sql.files.maxPartitionBytes": str(1 << 60), "spark.sql.files.openCostInBytes": str(1 << 60)}
    before = {k: spark.conf.get(k) for k in wide}
    for k, v in wide.items():
        spark.conf.set(k, v)
    try:
        lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("header"))
        return store(lines.mapInArrow(first_rows, "path string, header string"), "headers")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _file_path() -> Column:
    """The path as readers take it: the metadata column has it with percent signs, and a plus is a plus."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def _groups(spark: SparkSession, path) -> list[tuple[list[str], object]]:
    """Distinct headers, each with the paths of its files; with one header these are what was asked for."""
    files = header_catalogue(spark, path).groupBy("header").agg(
        F.array_sort(F.collect_list(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))).alias("paths")
    )
    found = [(next(csv.reader([r["header"].lstrip("\ufeff")]), []), r["paths"]) for r in files.orderBy("header").collect()]
    if not found:
        raise ValueError("no file with a header")
    without = sorted(p for header, paths in found if "Label" not in header for p in paths)
    if without:
        raise ValueError(f"no Label column in {len(without)} files, {without[0]} for one")
    if len(found) == 1:
        return [(found[0][0], path)]
    # Names that look like a pattern are meant as they stand.
    return [(header, [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]) for header, paths in found]


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def with_block_ids(df: DataFrame, path_column: str = "_path") -> DataFrame:
    """Session and block of every row, from where its file lies.

    ``.../1.Deauth/Deauth_12.csv`` is block 12 of session Deauth; the file may also be a
    folder of part files.
    """
    file = F.regexp_replace(path_column, "/part-[^/]*$", "")
    folder = F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)
    session = F.regexp_replace(folder, r"^[^.]*\.", "")
    index = F.coalesce(F.regexp_extract(file, r"_([0-9]+)\.[^./]*$", 1).try_cast("int"), F.lit(0))
    return df.withColumn("session_id", session).withColumn(
        "block_id", F.format_string("%s:%04d", session, index)
    )


def _is_malformed() -> Column:
    """Whether a row has another width than the header.

    The length test is always true; a scan that reads nothing but the record Spark could
    not parse is refused, so one real column has to be looked at.
    """
    looked_at = F.coalesce(F.char_length(_quoted("Label")), F.lit(0)) >= 0
    return (F.col(CORRUPT).isNotNull() & looked_at).alias(MALFORMED)


def read_capture_csv(
    spark: SparkSession, path, *, skip_sessions: list[str] | None = None, malformed: bool = False, place: bool = False
) -> DataFrame:
    """Capture rows as text cells under flat names, with session, block and frame number.

    Only the columns the features consume are parsed; one the file lacks becomes NULL. Files need
    not agree in their headers: the files of each distinct header are one scan, and columns are
    found by name. Every file must have a Label.
    With ``malformed`` the scan also carries the flag ``_malformed``, for which every column
    has to be parsed. With ``place`` it carries ``_split`` and ``_line``, by which the rows of a
    file have their order.
    """
    out = union_all([_scan(spark, header, files, malformed) for header, files in _groups(spark, path)])
    if skip_sessions:
        # The session of a folder to skip is the name behind its number.
        out = out.filter(~F.col("session_id").isin([s.split(".", 1)[-1] for s in skip_sessions]))
    return out if place else out.drop("_split", "_line")


def _scan(spark: SparkSession, header: list[str], files, malformed: bool) -> DataFrame:
    """Rows of files that share a header. A name that comes again is another column, which nothing asks for."""
    names = [c if c not in header[:i] else f"{c}#{i}" for i, c in enumerate(header)]
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in names)
    reader = _reader(spark)
    if malformed:
        schema += f", {CORRUPT} string"
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT).option("columnPruning", False)
    rows = reader.schema(schema).csv(files)
    cells = [
        (_quoted(c) if c in header else F.lit(None).cast("string")).alias(spec.flat(c))
        for c in spec.SOURCE_COLUMNS
    ]
    number = (
        F.floor(_quoted("frame.number").try_cast("double")).cast("long")
        if "frame.number" in header
        else F.lit(None).cast("long")
    )
    scanned = rows.select(
        *cells,
        number.alias("frame_number"),
        _file_path().alias("_path"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_line"),
        *([_is_malformed()] if malformed else []),
    )
    out = with_block_ids(scanned)
    return out if "frame.number" in header else _number_by_place(out)


def _number_by_place(df: DataFrame) -> DataFrame:
    """Frame numbers for files without them: byte offset of the split plus row in the split.

    A row takes at least one byte, so numbers of one file rise and never meet.
    """
    first = df.groupBy("_path", "_split").agg(F.min("_line").alias("_first"))
    return (
        df.drop("frame_number")
        .join(first, ["_path", "_split"])
        .withColumn("frame_number", F.col("_split") + F.col("_line") - F.col("_first"))
        .drop("_first")
    )


def skip_sessions(df: DataFrame, names: list[str]) -> DataFrame:
    return df.filter(~F.col("session_id").isin(names))


def split_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the count of rows whose width is not that of the header, per block.

    ``df`` is a scan made with ``malformed=True``.
    """
    counts = df.groupBy("session_id", "block_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(MALFORMED).alias("malformed")
    )
    return df.filter(~F.col(MALFORMED)).drop(MALFORMED), counts


def has_word_booleans() -> Column:
    """Whether a row spells its booleans as words: its export would silently read as all zero."""
    words = [
        F.coalesce(F.lower(F.left(F.btrim(spec.flat(c)), F.lit(4))).isin("true", "fals"), F.lit(False))
        for c in BOOLEAN_CELLS
    ]
    return F.greatest(*words)


def check_export_format(df: DataFrame, order: str = "frame_number") -> DataFrame:
    """Blocks, whether their first row spells its booleans as words, and how many rows do.

    The first row tells the export format of a block, as in ``check_first_rows``; rows without a number
    come last.
    """
    first = F.struct(F.col(order).isNull(), F.col(order))
    return df.groupBy("session_id", "block_id").agg(
        F.min_by(has_word_booleans(), first).alias("rejected"), F.count_if(has_word_booleans()).alias("odd_rows")
    )


def check_first_rows(df: DataFrame, words: str) -> DataFrame:
    """Blocks, whether their first row has the flag ``words``, and how many rows have it.

    The first row tells the export format of a file. ``df`` has the good rows of a scan made with
    ``place=True``; splits are combined first, so only as many rows are compared by their path.
    """
    splits = df.groupBy("block_id", "_path", "_split").agg(
        F.min("_line").alias("_first"), F.min_by(words, "_line").alias("_flag"), F.count_if(F.col(words)).alias("_n")
    )
    return splits.groupBy("block_id").agg(
        F.min_by("_flag", F.struct("_path", "_split", "_first")).alias("rejected"), F.sum("_n").alias("odd_rows")
    )


def require_export_format(df: DataFrame) -> DataFrame:
    """The rows, or an error that tells how many blocks have the wrong export format and names the first 20."""
    bad = store(check_export_format(df).filter("rejected").select("block_id"), "rejected")
    n = bad.count()
    if n:
        names = ", ".join(r["block_id"] for r in bad.orderBy("block_id").limit(20).collect())
        raise ValueError(f"booleans are True/False instead of 1/0 in {n} blocks ({names}); export again")
    return df


# What an analysis may look at.
ANALYSIS_PREFIXES = ("frame.", "radiotap.", "wlan.", "wlan_radio.")
ANALYSIS_BLOCKED = {
    "frame.number", "frame.time", "frame.time_epoch",
    "radiotap.mactime", "radiotap.present.tsft", "radiotap.timestamp.ts",
    "wlan.bssid", "wlan.da", "wlan.ra", "wlan.sa", "wlan.ta", "wlan.ssid", "wlan.tag", "wlan.tag.length",
    "wlan.analysis.kck", "wlan.analysis.kek", "wlan.rsn.ie.gtk.key", "wlan.rsn.ie.igtk.key",
    "wlan.rsn.ie.pmkid", "wlan.fixed.timestamp", "wlan_rsna_eapol.keydes.msgnr",
    "wlan_rsna_eapol.keydes.data", "wlan_rsna_eapol.keydes.data_len",
    "wlan_rsna_eapol.keydes.key_info.key_mic", "wlan_rsna_eapol.keydes.nonce",
}
ANALYSIS_PATTERNS = [
    r"\b(bssid|ssid|mac|addr|oui|vendor|station|ra|ta|sa|da)\b",
    r"^(ip\.|ipv6\.|arp|tcp\.|udp\.|dns|http|json|ssh|tls|smb2?|nbns|nbss|ldap|dhcp|mdns|ssdp)\b",
    r"(payload|data\.data|llc|eapol|key|nonce|pmkid|gtk|igtk|kck|kek)",
    r"(pcap|source_file|capture|interface)",
    r"(start_tsf|end_tsf|timestamp)",
]


_IDENTIFYING = re.compile("|".join(f"(?:{p})" for p in ANALYSIS_PATTERNS), re.IGNORECASE)


def analysis_columns(columns: list[str], target: str = "Label") -> list[str]:
    """Dotted column names an analysis may use: link-layer fields that identify nobody; the target is always one."""
    link = {c for c in columns if c.lower().startswith(ANALYSIS_PREFIXES)}
    usable = link - ANALYSIS_BLOCKED - set(filter(_IDENTIFYING.search, link)) | {target}
    return [*filter(usable.__contains__, columns), *{target}.difference(columns)]


def select_analysis_columns(df: DataFrame, target: str = "Label") -> DataFrame:
    """The allowed columns of a table with flat names."""
    dotted = {spec.flat(c): c for c in spec.SOURCE_COLUMNS}
    names = [dotted.get(c, c) for c in df.columns]
    return df.select(*[spec.flat(c) for c in analysis_columns(names, target)])


def null_sentinels(df: DataFrame, sentinel: str = "?") -> DataFrame:
    return df.replace(sentinel, None)


def excluded_columns(columns: list[str]) -> list[tuple[str, str]]:
    """Banned columns among the given ones, with the reason."""
    return [(c, spec.BANNED_COLUMNS[c]) for c in columns if c in spec.BANNED_COLUMNS]


def require_no_excluded(columns: list[str]) -> None:
    if found := excluded_columns(columns):
        raise ValueError(f"columns that must not become features: {found}")


def excluded_report(df: DataFrame) -> DataFrame:
    """Banned columns a raw table carries, the reason, and how many rows carry a value."""
    dotted = {spec.flat(c): c for c in spec.SOURCE_COLUMNS}
    found = excluded_columns([dotted.get(c, c) for c in df.columns])
    wide = df.agg(*[F.count(spec.flat(c)).alias(spec.flat(c)) for c, _ in found])
    pairs = [
        F.struct(F.lit(c).alias("column"), F.lit(why).alias("reason"), F.col(spec.flat(c)).alias("rows"))
        for c, why in found
    ]
    return wide.select(F.inline(F.array(*pairs)))
