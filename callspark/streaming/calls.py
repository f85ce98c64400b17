"""Arriving files of chunks: stateless cleaning and keyword alerts with the batch operators."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.segments import clean_chunks
from ..operators.speakers import keyword_hits
from ..schemas import CHUNKS


def stream_alerts(spark: SparkSession, source: str, target: str, state: str, lexicon: dict, schema: str = CHUNKS) -> StreamingQuery:
    """Cleans the chunk files of ``source``, of ``schema`` (call_id may be of any type), and writes keyword hits to ``target``; ends with what is there."""
    chunks = clean_chunks(spark.readStream.schema(schema).parquet(source)).where("reason IS NULL")
    rows = chunks.select("call_id", F.col("chunk_idx").alias("seg_idx"), F.lit(None).cast("string").alias("speaker"), (F.col("start") * 1000).cast("long").alias("start_ms"), "text")
    hits = keyword_hits(rows, lexicon)
    return hits.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
