"""Tables that jobs write for themselves in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir.

    Where it is unset, a local session gets a folder of its own; any other cluster gets one
    beside its warehouse, if that is shared: a folder of the driver's machine is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            base = "file://" + tempfile.mkdtemp(prefix="callspark-")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
            if base.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that no other run uses."""
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: its lineage ends there."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def unsettle(*tables: DataFrame) -> None:
    """Delete tables of :func:`settle` that no later step reads."""
    for df in tables:
        path = getattr(df, "_settled_at", None)
        if not path:
            continue
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
