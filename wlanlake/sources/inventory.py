"""The access point inventory."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AP_SCHEMA = "bssid string, name string, lat double, lng double"


def read_ap_locations(spark: SparkSession, path: str, *, per_line: bool = False) -> DataFrame:
    """Access points from a JSON array, or from an object with the array under ``aps``.

    A file is one document, or with ``per_line`` every line is one, for large inventories.
    Entries that lack a field or a place are skipped; a missing or unreadable file gives no rows.
    """
    empty = spark.createDataFrame([], AP_SCHEMA)
    entry = "struct<bssid:string,name:string,lat:string,lng:string>"
    try:
        text = spark.read.text(path, wholetext=not per_line)
        listed = F.from_json("value", f"array<{entry}>")
        wrapped = F.from_json("value", f"struct<aps:array<{entry}>>")["aps"]
        is_list = F.startswith(F.ltrim("value"), F.lit("["))
        rows = text.select(F.explode(F.when(is_list, listed).otherwise(wrapped)).alias("e"))
    except Exception as exc:
        if not re.search("PATH_NOT_FOUND", str(exc)):
            raise
        return empty
    return rows.select(
        "e.bssid",
        "e.name",
        F.col("e.lat").try_cast("double").alias("lat"),
        F.col("e.lng").try_cast("double").alias("lng"),
    ).filter("bssid is not null and name is not null and lat is not null and lng is not null")
