"""Feature tables on disk, their blocks, and split files."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wlanlake import spec

FEATURE_SCHEMA = T.StructType(
    [T.StructField(f, T.FloatType()) for f in spec.FLAT_FEATURES]
    + [
        T.StructField("label", T.ByteType()),
        T.StructField("frame_number", T.LongType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("block_id", T.StringType()),
    ]
)


def _exists(spark: SparkSession, path: str) -> bool:
    """False for a path that is missing or has no files; any other fault is raised."""
    try:
        spark.read.parquet(path).schema  # noqa: B018
        return True
    except AnalysisException as fault:
        if fault.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False


MANIFEST = "run string, at bigint, session_id string, block_id string, rows bigint"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a feature table, one row for each run that wrote them."""
    place = f"{path}/manifest"
    return spark.read.schema(MANIFEST).parquet(place) if _exists(spark, place) else spark.createDataFrame([], MANIFEST)


def existing_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks a feature table already holds; only its manifest is read."""
    return read_manifest(spark, path).select("block_id").distinct()


def write_features(df: DataFrame, path: str, *, skip_existing: bool = True) -> str:
    """Write the features of whole blocks as one run, zstd, and return the run's name.

    A run is a folder of files as its tasks make them, sorted by block, so the folders do not grow with the
    blocks, and readers of one block pass over files and row groups by their statistics. The rows arrive
    spread by block and tile, so a large block is written by many tasks. A run counts once its blocks are
    in the manifest, which is written last: what a broken run left is never read. Blocks that the manifest
    already holds are left out, so the same write again adds nothing; without ``skip_existing`` they are
    written anew and the newest run of a block is the one that is read.
    """
    spark = df.sparkSession
    held = read_manifest(spark, path)
    at = (held.agg(F.max("at")).first()[0] or 0) + 1
    if skip_existing:
        df = df.join(held.select("block_id").distinct(), "block_id", "left_anti")
    run = f"{at:06d}-{uuid.uuid4().hex[:8]}"
    folder = f"{path}/data/run={run}"
    df.select(*FEATURE_SCHEMA.fieldNames()).sortWithinPartitions("block_id", "frame_number").write.option(
        "compression", "zstd"
    ).parquet(folder)
    blocks = (
        spark.read.schema(FEATURE_SCHEMA).parquet(folder)
        .groupBy("session_id", "block_id")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(run).alias("run"), F.lit(at).cast("long").alias("at"), "session_id", "block_id", "rows")
    )
    blocks.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return run


def read_run(spark: SparkSession, path: str, run: str) -> DataFrame:
    """What one run wrote."""
    return spark.read.schema(FEATURE_SCHEMA).parquet(f"{path}/data/run={run}")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """All blocks, each from the newest run that wrote it."""
    held = read_manifest(spark, path)
    newest = held.groupBy("block_id").agg(F.max_by("run", "at").alias("newest"))
    stale = held.join(newest, "block_id").filter("run != newest").select("run", "block_id")
    # As many as there were runs.
    runs = sorted(r["run"] for r in held.select("run").distinct().collect())
    if not runs:
        return spark.createDataFrame([], FEATURE_SCHEMA)
    rows = spark.read.schema(FEATURE_SCHEMA).option("basePath", f"{path}/data").parquet(*[f"{path}/data/run={r}" for r in runs])
    if stale.head(1):
        rows = rows.join(stale, ["run", "block_id"], "left_anti")
    return rows.select(*FEATURE_SCHEMA.fieldNames())


def block_label_counts(df: DataFrame) -> DataFrame:
    """Rows per block and class; reads two columns only."""
    return df.groupBy("session_id", "block_id", "label").agg(F.count(F.lit(1)).alias("count"))


def shard_integrity(df: DataFrame, shard: str = "_shard") -> DataFrame:
    """Files that hold more than one block."""
    return (
        df.groupBy(shard)
        .agg(F.count_distinct("block_id").alias("blocks"))
        .filter(F.col("blocks") > 1)
    )


def assert_single_block(df: DataFrame, shard: str = "_shard") -> DataFrame:
    bad = shard_integrity(df, shard).limit(5).collect()
    if bad:
        raise ValueError(f"files with more than one block: {[r[shard] for r in bad]}")
    return df


def sample_blocks_spread(blocks: DataFrame, n: int) -> DataFrame:
    """n blocks of each session, evenly spaced over the capture.

    ``blocks`` has one row per block; the window runs over blocks, not over frames.
    """
    place = Window.partitionBy("session_id").orderBy("block_id")
    total = F.count(F.lit(1)).over(Window.partitionBy("session_id"))
    rank = (F.row_number().over(place) - 1).cast("long")
    ranked = blocks.withColumn("_i", rank).withColumn("_n", total)
    # Pick j sits at floor(j * total / n), so i is picked when the ceiling hits it.
    pick = F.floor(F.ceil(F.col("_i") * n / F.col("_n")) * F.col("_n") / n)
    return ranked.filter((F.col("_n") <= n) | (pick == F.col("_i"))).drop("_i", "_n")


def save_split(assignment: DataFrame, path: str) -> None:
    """Write the split of every block as JSON lines."""
    assignment.select("block_id", "split").write.mode("errorifexists").json(path)


def missing_blocks(assignment: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks a split names that the data does not have."""
    return assignment.join(blocks.select("block_id").distinct(), "block_id", "left_anti")


def load_split(spark: SparkSession, path: str, blocks: DataFrame) -> DataFrame:
    assignment = spark.read.schema("block_id string, split string").json(path)
    missing = [r.block_id for r in missing_blocks(assignment, blocks).limit(5).collect()]
    if missing:
        raise ValueError(f"the split names blocks absent from the data: {missing}")
    return assignment


def rows_by_split(df: DataFrame, assignment: DataFrame) -> DataFrame:
    """Rows with the split of their block; blocks without one are left out."""
    return df.join(assignment.select("block_id", "split"), "block_id")
