"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on; all of them can be changed at run time."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # The JVM does not compile methods above 8000 bytes; wide projections such as the 46
    # features then run faster outside one whole-stage method.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def spread(df, key: str):
    """Spread a scan that has fewer splits than there are cores, before costly parsing.

    Large inputs have enough splits and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def build_session(app: str = "wlanlake", cores: str = "*") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return prepare(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def work_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only in local mode, where every task runs on this machine, is a folder made when the
    setting is missing; on a cluster the setting is required.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="wlanlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder; nothing is ever overwritten in it."""
    return os.path.join(work_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def store(df, name: str):
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, and makes sure
    a result used several times is computed once.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own, in whatever store it is; one that is missing is no fault."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
