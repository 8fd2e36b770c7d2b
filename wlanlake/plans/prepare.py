"""From capture files to a feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wlanlake import spec
from wlanlake.functions.labels import label_id, normalise_label
from wlanlake.operators.frames import finish_features, with_row_features
from wlanlake.session import store
from wlanlake.sources.capture import MALFORMED, check_first_rows, has_word_booleans, read_capture_csv
from wlanlake.sources.shards import existing_blocks, read_run, write_features


def parse_capture(scan: DataFrame) -> DataFrame:
    """Rows of a scan with everything that can be told from the row alone: its features, its
    class, and the flags that decide whether it is used."""
    flagged = scan.withColumns(
        {
            "label": label_id(normalise_label("raw_label")),
            "spelling": F.col("raw_label"),
            "_words": has_word_booleans(),
        }
    )
    return with_row_features(flagged)


def prepare_features(
    spark: SparkSession,
    source: str,
    target: str,
    *,
    skip_sessions: list[str] | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Write the features of all capture files; returns one summary row about this run.

    The text files are read once; the parsed rows are stored, and every further step reads
    the few columns it needs of them. Blocks already in ``target`` are skipped. ``blocks``
    restricts the job to a sample. A block whose first good row spells booleans as words is
    rejected; later rows that do are kept, and ``odd_rows`` is their count. What each file had, and each
    spelling of a label, is in the run's report (``read_report``) beside the features.
    """
    skipped = spec.SKIP_FOLDERS if skip_sessions is None else skip_sessions
    scan = read_capture_csv(spark, source, skip_sessions=skipped, malformed=True, place=True)
    if blocks is not None:
        scan = scan.join(blocks.select("block_id"), "block_id", "left_semi")
    fresh = scan.join(existing_blocks(spark, target), "block_id", "left_anti")
    parsed = store(parse_capture(fresh), "parsed")

    good = parsed.filter(~F.col(MALFORMED))
    formats = store(check_first_rows(good, "_words"), "formats")
    rejected = formats.filter("rejected").select("block_id")
    # Everything to be dropped goes before the deltas, which look at the previous row.
    usable = good.drop("_split", "_line").filter("label is not null").join(rejected, "block_id", "left_anti")
    run = write_features(finish_features(usable), target)
    _report(parsed, formats, f"{target}/report/run={run}")

    n = F.count(F.lit(1))
    counts = read_run(spark, target, run).agg(
        n.alias("rows"),
        F.count_distinct("block_id").alias("blocks"),
        *[
            F.count_if(F.col("label") == i).alias(f"n_{spec.FRONT_KEY_OF.get(c, c.lower())}")
            for i, c in enumerate(spec.CLASSES)
        ],
    )
    dropped = parsed.agg(
        F.count_if(MALFORMED).alias("malformed"),
        F.count_if(~F.col(MALFORMED) & F.col("label").isNull()).alias("unknown_label_rows"),
    )
    refused = formats.agg(
        F.count_if("rejected").alias("rejected_blocks"),
        F.coalesce(F.sum(F.expr("if(rejected, 0, odd_rows)")), F.lit(0)).alias("odd_rows"),
    )
    return counts.crossJoin(dropped).crossJoin(refused)


def _report(parsed: DataFrame, formats: DataFrame, path: str) -> None:
    """Rows per file and what was wrong with them; rows per spelling of a label and the class it was taken for."""
    n = F.count(F.lit(1))
    files = (
        parsed.groupBy("session_id", "block_id")
        .agg(
            n.alias("rows"),
            F.count_if(MALFORMED).alias("malformed"),
            F.count_if(~F.col(MALFORMED) & F.col("label").isNull()).alias("unknown_label_rows"),
        )
        .join(formats, "block_id", "left")
        .withColumns({"rejected": F.coalesce("rejected", F.lit(False)), "odd_rows": F.coalesce("odd_rows", F.lit(0))})
    )
    files.write.parquet(f"{path}/part=files")
    good = parsed.filter(~F.col(MALFORMED))
    good.groupBy("spelling", "label").agg(n.alias("rows")).write.parquet(f"{path}/part=labels")


def read_report(spark: SparkSession, target: str, part: str = "files") -> DataFrame:
    """The reports of all runs, by ``files`` or by ``labels``, with the ``run`` each row is of."""
    return spark.read.option("basePath", f"{target}/report").parquet(f"{target}/report/run=*/part={part}").drop("part")
