"""Tables of calls from the driver's tables; FIXTURES.md has their schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Of an event: its value in cents, its property k, and its place in a call of 900 seconds.
CENTS, K = "CAST(round(value * 100) AS BIGINT)", "CAST(get_json_object(props, '$.k') AS BIGINT)"
AT = "(unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(TIMESTAMP '2024-01-01 00:00:00')) div 2880000"
SQL_AT = "(epoch_us(ts) - 1704067200000000) // 2880000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the conversations: call_id, seg_idx, start_ms, end_ms, text, speaker."""
    return segments_of(table(spark, sf_dir, "conversations"))


def segments_of(conversations: DataFrame) -> DataFrame:
    """The same of given rows."""
    rows = conversations.selectExpr(
        "conv_id AS call_id", "turn AS seg_idx", "text", "IF(conv_id % 10 = 0, NULL, concat('S', (conv_id + turn div 2) % 3)) AS speaker",
        "400 + (length(text) * 37 + conv_id * 131 + turn * 57) % 6000 AS dur", "((conv_id * 17 + turn * 29) % 3) * 900 AS gap",
    )
    order = Window.partitionBy("call_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end_ms", F.sum(F.col("dur") + F.col("gap")).over(order) - F.col("gap"))
    return rows.select("call_id", "seg_idx", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms", "text", "speaker")


#: The same in DuckDB.
SEGMENTS_SQL = """
raw AS (SELECT conv_id AS call_id, turn AS seg_idx, text, CASE WHEN conv_id % 10 = 0 THEN NULL ELSE 'S' || ((conv_id + turn // 2) % 3) END AS speaker,
  400 + (length(text) * 37 + conv_id * 131 + turn * 57) % 6000 AS dur, ((conv_id * 17 + turn * 29) % 3) * 900 AS gap FROM conversations),
seg AS (SELECT call_id, seg_idx, CAST(e - dur AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms, text, speaker FROM
  (SELECT *, sum(dur + gap) OVER (PARTITION BY call_id ORDER BY seg_idx) - gap AS e FROM raw))
"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as segments: call_id, seg_idx, text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("call_id"), F.posexplode(F.split("text", "\n")).alias("seg_idx", "text"))


LINES_SQL = "lines AS (SELECT doc_id AS call_id, CAST(unnest(range(0, len(string_split(text, chr(10))))) AS INT) AS seg_idx, unnest(string_split(text, chr(10))) AS text FROM documents)"


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments with integer measures from events: call_id, seg_idx, speaker, pitch, std, energy (1e-4), rate.

    Every eleventh was not measured.
    """
    known = lambda x, name: f"IF(event_id % 11 = 0, NULL, {x}) AS {name}"
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS call_id", "event_id AS seg_idx", "concat('S', event_id % 3) AS speaker",
        known(f"80 + {CENTS} % 220", "pitch"), known(f"({CENTS} div 7 + {K}) % 80", "std"), known(f"20 + ({CENTS} * 3 + {K} * 11) % 1000", "energy"), known(f"({CENTS} + {K}) % 10", "rate"),
    )


MEASURED_SQL = """
ev AS (SELECT user_id AS call_id, event_id AS seg_idx, 'S' || (event_id % 3) AS speaker, CAST(round(value * 100) AS BIGINT) AS v, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
mall AS (SELECT call_id, seg_idx, speaker, 80 + v % 220 AS pitch, (v // 7 + k) % 80 AS std, 20 + (v * 3 + k * 11) % 1000 AS energy, (v + k) % 10 AS rate FROM ev),
mea AS (SELECT * FROM mall WHERE seg_idx % 11 <> 0)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from events: call_id, t_ms, f0, rms (1e-4), onset; a call for each user."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS call_id", f"{AT} AS t_ms", f"{CENTS} % 600 AS f0", f"{K} * 7 % 1000 AS rms", "event_id % 5 = 0 AS onset")


FRAMES_SQL = f"""
fr AS (SELECT user_id AS call_id, {SQL_AT} AS t_ms, CAST(round(value * 100) AS BIGINT) % 600 AS f0,
  CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 % 1000 AS rms, event_id % 5 = 0 AS onset FROM events)
"""


def spans(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Intervals of the calls in events, a segment and a turn (with speaker) for each event."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "user_id AS call_id", f"{AT} AS start_ms", f"{CENTS} AS v")
    if kind == "segments":
        return rows.selectExpr("call_id", "event_id AS seg_idx", "start_ms", "start_ms + 800 + v % 600 * 100 AS end_ms", "concat('S', event_id % 3) AS speaker")
    return rows.selectExpr("call_id", "start_ms - 900 AS start_ms", "start_ms + 1000 + v % 400 * 100 AS end_ms", "concat('S', v % 3) AS speaker")


SPANS_SQL = f"""
ei AS (SELECT event_id, user_id AS call_id, {SQL_AT} AS start_ms, CAST(round(value * 100) AS BIGINT) AS v FROM events),
sg AS (SELECT call_id, event_id AS seg_idx, start_ms, start_ms + 800 + v % 600 * 100 AS end_ms, 'S' || (event_id % 3) AS speaker FROM ei),
tn AS (SELECT call_id, start_ms - 900 AS start_ms, start_ms + 1000 + v % 400 * 100 AS end_ms, 'S' || (v % 3) AS speaker FROM ei)
"""


# Texts that each filter of chunks takes, by seg_idx % 9; the others are what is said.
SPOILED = {1: "'abcabcabcabcabcabc'", 2: "'no yes no yes no yes no'", 3: "' 구독과 좋아요 a '", 4: "'ok'", 8: "concat(text, '  한글자막 제공 ')"}


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text chunks of the conversations: call_id, chunk_idx, start, end, text; many that cleaning drops or cuts."""
    return chunks_of(segments(spark, sf_dir))


def chunks_of(rows: DataFrame) -> DataFrame:
    """The same of given segments."""
    text = "CASE seg_idx % 9 " + " ".join(f"WHEN {k} THEN {x}" for k, x in SPOILED.items()) + " ELSE text END"
    end = "CASE seg_idx % 9 WHEN 5 THEN NULL WHEN 6 THEN start_ms / 1000 WHEN 7 THEN start_ms / 1000 + 0.1 ELSE end_ms / 1000 END"
    return rows.selectExpr("call_id", "seg_idx AS chunk_idx", "start_ms / 1000 AS start", f"{end} AS end", f"{text} AS text")


CHUNKS_SQL = f"""
ch AS (SELECT call_id, seg_idx AS chunk_idx, start_ms / 1000 AS start,
  CASE seg_idx % 9 WHEN 5 THEN NULL WHEN 6 THEN start_ms / 1000 WHEN 7 THEN start_ms / 1000 + CAST(0.1 AS DOUBLE) ELSE end_ms / 1000 END AS stop,
  CASE seg_idx % 9 {" ".join(f"WHEN {k} THEN {x}" for k, x in SPOILED.items())} ELSE text END AS text FROM seg)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who speaks when in the conversations, a little beside their segments: call_id, start_ms, end_ms, speaker."""
    return turns_of(segments(spark, sf_dir))


def turns_of(rows: DataFrame) -> DataFrame:
    """The same of given segments."""
    return rows.where("speaker IS NOT NULL").selectExpr("call_id", "start_ms - 300 AS start_ms", "end_ms - 150 AS end_ms", "speaker")


TURNS_SQL = "tu AS (SELECT call_id, start_ms - 300 AS start_ms, end_ms - 150 AS end_ms, speaker FROM seg WHERE speaker IS NOT NULL)"
