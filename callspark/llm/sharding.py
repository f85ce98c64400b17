"""Sharding by a permutation-filled lookup table.

Each shard prefers the table's slots in an order of its own: a start and a step modulo the prime
table size visit every slot once. Shards take turns claiming their first free slot until the
table is full, so all hold as many slots, give or take one, and few slots move when a shard comes
or goes. The table is as large as its parameter says, whatever the input's size; broadcast, it
places each row by one lookup without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots (a prime, over a hundred times the shards) and shards of the query.
SLOTS, SHARDS = 2039, 16
#: The most slots that may be broadcast (12 bytes each).
MOST_SLOTS = 1 << 20


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: int, slots: int) -> list[int]:
    """The shard of each slot."""
    if not 1 < slots <= MOST_SLOTS or any(slots % p == 0 for p in range(2, int(slots**0.5) + 1)) or not 1 <= shards <= slots:
        raise ValueError("slots must be a prime of at most MOST_SLOTS, and shards from 1 to slots")
    start = [_number(f"start{i}") % slots for i in range(shards)]
    step = [_number(f"step{i}") % (slots - 1) + 1 for i in range(shards)]
    at, table, free = start[:], [-1] * slots, slots
    while True:
        for i in range(shards):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step[i]) % slots
            table[at[i]] = i
            free -= 1
            if not free:
                return table


def table_frame(spark: SparkSession, shards: int, slots: int) -> DataFrame:
    """(slot, shard) rows of the lookup table."""
    listed = ",".join(map(str, lookup_table(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def sharded(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``docs`` with columns slot and shard, which replace columns of those names.

    The slot is a hash of the key as a string modulo the slots, so equal keys share a shard
    (rows that repeat too), and null keys share the shard of the empty string. An empty table
    gives an empty table. Nothing is shuffled.
    """
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    slot = (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots).cast("int")
    placed = docs.drop("slot", "shard").withColumn("slot", slot)
    return placed.join(F.broadcast(table_frame(docs.sparkSession, shards, slots)), "slot").select(*[c for c in placed.columns if c != "slot"], "slot", "shard")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """The query: the shard of every document."""
    return sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"))


QUERIES = {"op2_sharding": op2_sharding}

SQL = {
    "op2_sharding": f"""
WITH RECURSIVE shards AS (SELECT i, CAST(('0x' || substr(md5('start' || i), 1, 8)) AS BIGINT) % {SLOTS} AS o,
  CAST(('0x' || substr(md5('step' || i), 1, 8)) AS BIGINT) % {SLOTS - 1} + 1 AS s FROM range({SHARDS}) r(i)),
prefs AS (SELECT list(p ORDER BY i) AS prefs FROM (SELECT i, list_transform(range({SLOTS}), lambda j: (o + j * s) % {SLOTS}) AS p FROM shards)),
turns(n, taken, slot) AS (
  SELECT 0, list_transform(range({SLOTS}), lambda j: false), CAST(-1 AS BIGINT)
  UNION ALL
  SELECT n + 1, list_transform(taken, lambda t, j: t OR j = p + 1), p FROM (
    SELECT n, taken, list_filter(prefs[n % {SHARDS} + 1], lambda x: NOT taken[x + 1])[1] AS p FROM turns, prefs WHERE n < {SLOTS})),
filled AS (SELECT slot, (n - 1) % {SHARDS} AS shard FROM turns WHERE n > 0)
SELECT doc_id, source, CAST(slot AS INT) AS slot, CAST(shard AS INT) AS shard
FROM (SELECT doc_id, source, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) % {SLOTS} AS slot FROM documents)
JOIN filled USING (slot)
""",
}
