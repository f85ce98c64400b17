"""Whole-call jobs over arriving rows, with a sink that a repeated batch leaves as it is.

Rows of a call may come in any number of files and batches. Each batch stores what arrived under
its own number, then gathers all stored rows of the calls it touched, runs the batch job over
them, and writes the results under its number too. All folders of a batch are overwritten, so a
batch that Spark runs again after a failure ends up the same. A commit is written last. Readers
take each call's results from the newest committed batch that touched it.

Stored rows are laid out by a hash of the call, so that a batch reads only the parts that hold
calls it touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

#: Parts that stored rows are dealt into by call.
BUCKETS = 64
Job = Callable[[dict[str, DataFrame], Callable[[DataFrame, str], DataFrame]], dict[str, DataFrame]]


def _bucket(call: Column) -> Column:
    return F.pmod(F.xxhash64(call.cast("string")), F.lit(BUCKETS)).cast("int")


def together(sources: dict[str, DataFrame]) -> DataFrame:
    """One stream of (kind, call_id, a struct column for each source, null where a row is of another)."""
    out = None
    for kind, rows in sources.items():
        own = rows.select(F.lit(kind).alias("kind"), F.col("call_id").cast("string").alias("call"), F.struct(*rows.columns).alias(kind))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


class Calls:
    """The stored rows and results below ``target``; ``schemas`` are those of the sources."""

    def __init__(self, spark: SparkSession, target: str, schemas: dict[str, StructType], job: Job):
        self.spark, self.target, self.schemas, self.job = spark, target.rstrip("/"), schemas, job

    def _write(self, rows: DataFrame, name: str, batch: int, *by: str) -> str:
        path = f"{self.target}/{name}/batch={batch}"
        rows.write.mode("overwrite").partitionBy(*by).parquet(path) if by else rows.write.mode("overwrite").parquet(path)
        return path

    def _stored(self, kind: str, batch: int) -> DataFrame:
        schema = StructType([*self.schemas[kind].fields]).add("batch", LongType()).add("bucket", IntegerType())
        return self.spark.read.schema(schema).parquet(f"{self.target}/_arrived/{kind}").where(F.col("batch") <= batch)

    def process(self, arrived: DataFrame, batch: int) -> None:
        """What foreachBatch calls; running it again for a batch changes nothing."""
        touched = None
        for kind in self.schemas:
            rows = arrived.where(F.col("kind") == kind).select(f"{kind}.*").withColumn("bucket", _bucket(F.col("call_id")))
            self._write(rows, f"_arrived/{kind}", batch, "bucket")
            own = self._stored(kind, batch).where(F.col("batch") == batch).select("call_id", "bucket")
            touched = own if touched is None else touched.unionByName(own)
        at = self._write(touched.distinct(), "_touched", batch)
        touched = self.spark.read.schema(touched.schema).parquet(at)
        # At most BUCKETS numbers.
        parts = [r[0] for r in touched.select("bucket").distinct().collect()]
        calls = touched.select(F.col("call_id").alias("_call"))
        rows = {}
        for kind in self.schemas:
            kept = self._stored(kind, batch).where(F.col("bucket").isin(parts))
            rows[kind] = kept.join(calls, kept["call_id"].eqNullSafe(calls["_call"]), "left_semi").drop("batch", "bucket")

        def keep(df: DataFrame, name: str) -> DataFrame:
            return self.spark.read.schema(df.schema).parquet(self._write(df, f"_kept/{name}", batch))

        for name, found in self.job(rows, keep).items():
            self._write(found, name, batch)
        self._write(self.spark.range(1).select(F.lit(batch).cast("long").alias("done")), "_commits", batch)


def stream_whole_calls(spark: SparkSession, sources: dict[str, DataFrame], job: Job, target: str, state: str) -> StreamingQuery:
    """Runs ``job`` over the calls that the streams ``sources`` bring, and ends with what is there.

    Each source has call_id. ``job(rows, keep)`` gets all rows of the touched calls by source, and
    returns tables with call_id by name; ``keep(df, name)`` settles what it needs more than once.
    A query that starts again with the same ``state`` goes on where the last one ended.
    """
    calls = Calls(spark, target, {kind: rows.schema for kind, rows in sources.items()}, job)
    return together(sources).writeStream.foreachBatch(calls.process).option("checkpointLocation", state).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, name: str) -> DataFrame:
    """The table ``name`` of results: of each call the rows of the newest committed batch that touched it."""
    target = target.rstrip("/")
    done = spark.read.parquet(f"{target}/_commits").select(F.col("done").alias("batch"))
    newest = spark.read.parquet(f"{target}/_touched").withColumn("batch", F.col("batch").cast("long")).join(done, "batch").groupBy("call_id").agg(F.max("batch").alias("batch"))
    rows = spark.read.parquet(f"{target}/{name}").withColumn("batch", F.col("batch").cast("long"))
    newest = newest.select(F.col("call_id").alias("_call"), F.col("batch").alias("_batch"))
    return rows.join(newest, rows["call_id"].eqNullSafe(newest["_call"]) & (rows["batch"] == newest["_batch"]), "left_semi").drop("batch")
