"""Exact dedup: groups by a 128-bit content hash, with the bytes compared inside each group.

Texts are grouped by hash and bytes in one aggregate that is combined before its shuffle, so each
task sends a text once however often it holds it. Hashes with one text are then all that a row
needs to find its group; rows of a hash that stands for several texts find theirs by the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle

LOT = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # Of ASCII alone, lower() changes the same letters, and much faster.
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, stays: str = "largest", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``.

    ``docs`` needs doc_id and text; other columns are ignored. Rows are equal when their texts are,
    after A-Z is lower-cased; a null text counts as empty, and empty texts are a group. keep_id is
    the smallest or the ``largest`` doc_id of a group; null ids count only where a group has no
    others. Of rows that repeat the id that stays, one has kept true. An empty table gives an empty
    table. ``hashed`` may be any hash: collisions cost time, not results.
    """
    text = normalised(F.col("text"))
    rows = docs.select(F.col("doc_id").alias("doc_id"), text.alias("norm")).select("doc_id", "norm", hashed(F.col("norm")).alias("h"))
    best = {"smallest": F.min, "largest": F.max}[stays]
    own = (F.count("*").alias("group_size"), best("doc_id").alias("keep_id"))
    texts = rows.groupBy("h", "norm").agg(*own)
    # Small rows from here on. texts counts the different ones of a hash.
    groups = texts.groupBy("h").agg(F.count("*").alias("texts"), F.sum("group_size").alias("group_size"), best("keep_id").alias("keep_id"))
    groups = settle(groups, "groups")
    # Rows that repeat id and text are one row until the end, so that one of them is kept.
    told = rows.select("doc_id", "h", F.sha2("norm", 256).alias("text_sha256")).groupBy("doc_id", "h", "text_sha256").agg(F.count("*").alias("times"))
    out = told.join(groups.where("texts = 1").drop("texts"), "h")
    met = groups.where("texts > 1").select("h")
    if not met.isEmpty():
        met = rows.join(met, "h", "left_semi")
        own_text = met.groupBy("h", "norm").agg(*own)
        told = met.groupBy("doc_id", "h", "norm").agg(F.count("*").alias("times"))
        out = out.unionByName(told.join(own_text, ["h", "norm"]).withColumn("text_sha256", F.sha2("norm", 256)).drop("norm"))
    # Rows come back in lots of at most LOT, so that no array is long.
    out = out.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {LOT}"))).alias("lot"))
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.least(F.col("times") - F.col("lot") * LOT, F.lit(LOT)).cast("int"))).alias("place"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("lot") == 0) & (F.col("place") == 1)
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: all documents; the largest doc_id of each group stays."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_exact_dedup": op11_exact_dedup}
SQL = {
    "op11_exact_dedup": f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM t WINDOW w AS (PARTITION BY x)
""",
}
