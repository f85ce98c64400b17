"""Readers of the library's own tables, and a listing of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_calls(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Call metadata under the schema of calls; columns that the files lack are null.

    A call without an id gets one made of all that is known of it, so reruns agree.
    """
    rows = spark.read.format(form).schema(schemas.CALLS).load(path)
    known = F.to_json(F.struct(*(c for c in rows.columns if c != "call_id")))
    return rows.withColumn("call_id", F.coalesce(F.nullif("call_id", F.lit("")), F.substring(F.md5(known), 1, 8)))


def list_recordings(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modified, bytes) of the files below ``path``; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
