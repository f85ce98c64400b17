"""Roles of speakers, transcripts, keywords and danger flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lexicons import DANGER_KEYWORDS, MANAGER_KEYWORDS, POLITE_SUFFIXES
from ..functions.text import clock, strip


def said(text: Column, keywords: list[str]) -> Column:
    """The keywords that the text contains, each once."""
    return F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(text, k))


def role_name(rank: Column) -> Column:
    return F.when(rank == 1, "매니저").when(rank == 2, "시니어").otherwise(F.format_string("동거인_%d", rank - 1))


def with_roles(segments: DataFrame, keywords: list[str] = MANAGER_KEYWORDS, suffixes: list[str] = POLITE_SUFFIXES) -> DataFrame:
    """Segments with their speaker's score, rank and role; one shuffle on call_id serves all windows."""
    rows = segments.withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN"))).repartition("call_id")
    polite = F.lit(False)
    for s in suffixes:
        polite = polite | F.coalesce(F.endswith(strip(F.col("text")), F.lit(s)), F.lit(False))
    rows = rows.withColumn("points", F.size(said(F.coalesce("text", F.lit("")), keywords)) + F.when(polite, 0.5).otherwise(0.0))
    own = Window.partitionBy("call_id", "speaker")
    rows = rows.withColumn("score", F.sum("points").over(own)).withColumn("first_seg", F.min("seg_idx").over(own))
    rows = rows.withColumn("rank", F.dense_rank().over(Window.partitionBy("call_id").orderBy(F.col("score").desc(), "first_seg")))
    return rows.withColumn("role", role_name(F.col("rank"))).drop("points")


def role_ranks(segments: DataFrame, **lexicon) -> DataFrame:
    """(call_id, speaker, score, rank, role); speakers without points are ranked too."""
    return with_roles(segments, **lexicon).groupBy("call_id", "speaker").agg(*(F.first(c).alias(c) for c in ("score", "rank", "role")))


def in_order(lines: DataFrame, name: str = "transcript") -> DataFrame:
    """(call_id, ``name``): the ``lines(call_id, seg_idx, line)`` of each call, one below the other."""
    rows = lines.select("call_id", F.struct("seg_idx", "line").alias("x"))
    return rows.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]), "\n").alias(name))


def timed_line(name: str | None = None) -> Column:
    """[start --> end], who speaks by the column ``name`` (UNKNOWN where null), and the stripped text (empty where null)."""
    who = F.concat(F.lit("["), F.coalesce(F.col(name).cast("string"), F.lit("UNKNOWN")), F.lit("] ")) if name else F.lit("")
    text = F.coalesce(strip(F.col("text")), F.lit(""))
    return F.concat(F.lit("["), clock(F.col("start_ms") / 1000), F.lit(" --> "), clock(F.col("end_ms") / 1000), F.lit("] "), who, text)


def transcripts(segments: DataFrame, name: str | None = None) -> DataFrame:
    """(call_id, transcript): a :func:`timed_line` per segment in order."""
    return in_order(segments.select("call_id", "seg_idx", timed_line(name).alias("line")))


def keyword_hits(segments: DataFrame, lexicon: dict[str, list[str]] = DANGER_KEYWORDS) -> DataFrame:
    """(call_id, seg_idx, type_ord, kw_ord, type, keyword, speaker, start_ms, text): one row per keyword said."""
    listed = F.array(*(F.struct(F.lit(i).alias("type_ord"), F.lit(j).alias("kw_ord"), F.lit(t).alias("type"), F.lit(k).alias("keyword")) for i, (t, ks) in enumerate(lexicon.items()) for j, k in enumerate(ks)))
    rows = segments.withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN"))).withColumn("hit", F.explode(F.filter(listed, lambda x: F.contains(F.col("text"), x["keyword"]))))
    return rows.select("call_id", "seg_idx", "hit.*", "speaker", "start_ms", "text")


#: Characters of a keyword that it is looked up by; shorter keywords are looked up whole.
SEED = 3
#: Bytes of a lexicon that is sent to the executors whole.
SENT = 1 << 20


def lexicon_table(spark: SparkSession, lexicon: dict[str, list[str]]) -> DataFrame:
    """The rows of :func:`lexicon_hits` for a lexicon that is given as lists."""
    rows = [(i, j, t, k) for i, (t, ks) in enumerate(lexicon.items()) for j, k in enumerate(ks)]
    return spark.createDataFrame(rows, "type_ord int, kw_ord int, type string, keyword string")


def lexicon_hits(segments: DataFrame, lexicon: DataFrame, sent: int = SENT) -> DataFrame:
    """As :func:`keyword_hits`, for a ``lexicon(type_ord, kw_ord, type, keyword)`` of any size.

    A keyword is looked up by its first SEED characters in the distinct ones of each text, by an
    equi-join, so a text meets the keywords that may be in it and no others; those in it are kept.
    Null and empty keywords are in no text. A keyword that is listed twice is hit twice, once per
    text that has it each time.

    Seeds are many times their texts, which Spark can't foresee, so how they are joined isn't left to
    it: a lexicon of at most ``sent`` bytes goes to the executors, where segments meet it as they are
    read; a larger one is sorted by seed, and what it meets by segment. Its size takes a job to know.
    """
    words = lexicon.where("keyword <> ''").withColumn("seed", F.substring("keyword", 1, SEED))
    told = segments.select("call_id", "seg_idx", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker"), "start_ms", "text")
    if (words.agg(F.sum(F.octet_length("keyword") + F.octet_length("type") + 64)).first()[0] or 0) <= sent:
        hits = _with_seeds(told, words).join(F.broadcast(words), "seed").where(F.contains("text", "keyword"))
    else:
        # Segments of one id, or of none, share their seeds; each is then looked through by itself.
        seeds = _with_seeds(told, words).select(F.col("call_id").alias("call"), F.col("seg_idx").alias("seg"), "seed").distinct()
        met = seeds.join(words.hint("merge"), "seed")
        hits = met.join(told.hint("merge"), F.col("call").eqNullSafe(F.col("call_id")) & F.col("seg").eqNullSafe(F.col("seg_idx"))).where(F.contains("text", "keyword"))
    return hits.select("call_id", "seg_idx", "type_ord", "kw_ord", "type", "keyword", "speaker", "start_ms", "text")


def _with_seeds(told: DataFrame, words: DataFrame) -> DataFrame:
    """A row for each distinct seed of a text, of the lengths that seeds of the lexicon have."""
    # At most SEED numbers.
    sizes = words.agg(F.collect_set(F.length("seed"))).scalar()
    rows = told.where("text <> ''").withColumn("sizes", sizes)
    # Pieces keep the work of a long text in proportion to its length.
    piece = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int")), lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE + SEED - 1)))
    seeds = lambda t, n: F.filter(F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, n)), lambda x: F.length(x) == n)
    found = F.flatten(F.transform(piece, lambda t: F.flatten(F.transform("sizes", lambda n: F.array_distinct(seeds(t, n))))))
    return rows.select(*told.columns, F.explode(F.array_distinct(found)).alias("seed"))


#: Characters of a text that are looked through at a time.
PIECE = 512

DETAILS = "array<struct<seg_idx:bigint,type_ord:int,kw_ord:int,type:string,keyword:string,speaker:string,start_ms:bigint,text:string>>"


def danger(hits: DataFrame, *flags: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """(call_id, detected, flags, details): keyword hits and further ``flags(call_id, flag)`` of each call.

    Flags are distinct and sorted, details in order of segment, type and keyword. With ``calls``,
    each of its call_ids has a row, detected or not; else calls without any flag have none.
    """
    detail = F.struct(F.col("seg_idx").cast("long").alias("seg_idx"), "type_ord", "kw_ord", "type", "keyword", "speaker", F.col("start_ms").cast("long").alias("start_ms"), "text")
    # One aggregate over all that is known: each row has a flag, a detail, both, or stands for a call.
    rows = hits.select("call_id", F.concat("type", F.lit(" 키워드 감지")).alias("flag"), detail.cast(DETAILS[6:-1]).alias("detail"), F.lit(False).alias("asked"))
    for more in flags:
        rows = rows.unionByName(more.select("call_id", "flag", F.lit(None).cast(DETAILS[6:-1]).alias("detail"), F.lit(False).alias("asked")))
    if calls is not None:
        rows = rows.unionByName(calls.select("call_id", F.lit(None).cast("string").alias("flag"), F.lit(None).cast(DETAILS[6:-1]).alias("detail"), F.lit(True).alias("asked")))
    found = rows.groupBy("call_id").agg(F.array_sort(F.collect_set("flag")).alias("flags"), F.array_sort(F.collect_list("detail")).alias("details"), F.max("asked").alias("asked"))
    if calls is not None:
        found = found.where("asked")
    return found.select("call_id", (F.size("flags") > 0).alias("detected"), "flags", "details")


def danger_json(found: DataFrame) -> DataFrame:
    """(call_id, danger_info): what prompts and reports show of :func:`danger`; null where nothing was detected."""
    return found.select("call_id", danger_text().alias("danger_info"))


def danger_text() -> Column:
    """The JSON of a row with detected, flags and details; null where nothing was detected."""
    told = F.transform("details", lambda d: F.struct(d["type"].alias("type"), d["keyword"].alias("keyword"), d["speaker"].alias("speaker"), (d["start_ms"] / 1000).alias("time"), d["text"].alias("text")))
    return F.when(F.col("detected"), F.to_json(F.struct("detected", "flags", told.alias("details"))))


def worklists(calls: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``calls`` with a detected danger, and all others: each call is in one of them.

    ``found`` is a :func:`danger`; calls that it doesn't have, and those without an id, are others.
    """
    flagged = found.where("detected").select("call_id")
    return calls.join(flagged, "call_id", "left_semi"), calls.join(flagged, "call_id", "left_anti")
