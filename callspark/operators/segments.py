"""Cleaning, attributing, merging and thinning of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip_to_duration, is_hallucination, strip, strip_phrases, words
from .intervals import overlapping

#: Segments that one inner fold merges, so that lists are copied in short pieces.
LOT = 64


def _in_order():
    return Window.partitionBy("call_id").orderBy("seg_idx")


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """``chunks(call_id, chunk_idx, start, end, text)`` with reason: why a chunk goes, or null.

    Narrow: no shuffle. Null bounds count as 0, so an open last chunk goes.
    """
    c = chunks.withColumn("text", strip(F.col("text"))).withColumns({x: F.coalesce(x, F.lit(0.0)) for x in ("start", "end")})
    c = c.withColumn("bad", is_hallucination(F.col("text"))).withColumn("stripped", strip_phrases(F.col("text")))
    c = c.withColumn("clipped", clip_to_duration(F.col("stripped"), F.col("end") - F.col("start")))
    reason = F.when(F.col("bad"), "hallucination").when(F.length("stripped") < 3, "phrases").when(F.col("end") <= F.col("start"), "time").when(F.length("clipped") < 3, "clipped")
    return c.select("call_id", "chunk_idx", "start", "end", F.col("clipped").alias("text"), reason.alias("reason"))


def assign_speakers(segments: DataFrame, turns: DataFrame, like: DataFrame | None = None) -> DataFrame:
    """Each segment with the speaker whose turns overlap it most; ties by name, none stays null.

    ``like`` is for :func:`overlapping`: intervals as long as the segments, but cheaper to read.
    """
    found = overlapping(segments.select("call_id", "seg_idx", "start_ms", "end_ms"), turns, like)
    found = found.groupBy("call_id", "seg_idx", "speaker").agg(F.sum(F.least("end_ms", "b_end") - F.greatest("start_ms", "b_start")).alias("ms"))
    best = found.groupBy("call_id", "seg_idx").agg(F.min(F.struct((-F.col("ms")).alias("less"), "speaker"))["speaker"].alias("speaker"))
    return segments.drop("speaker").join(best, ["call_id", "seg_idx"], "left")


def merge_adjacent(segments: DataFrame, gap_ms: int = 1500, short_ms: int = 2000) -> DataFrame:
    """Merges neighbours of one speaker: near in time, or one of them short.

    ``segments`` has call_id (of any type), seg_idx, start_ms, end_ms, text and speaker. Texts that
    merge are stripped and joined by a space; null counts as empty. The rule reads the duration
    merged so far, so neighbours are folded in order. Segments never merge over a change of
    speaker, so each run of one speaker is a group of its own, folded in lots of LOT.
    """
    rows = segments.select("call_id", *(F.col(c).cast("long").alias(c) for c in ("seg_idx", "start_ms", "end_ms")), F.col("text").cast("string").alias("text"), F.col("speaker").cast("string").alias("speaker"))
    goes_on = F.lag("speaker").over(_in_order()).eqNullSafe(F.col("speaker")) & F.lag(F.lit(True)).over(_in_order()).isNotNull()
    rows = rows.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("new").over(_in_order()))
    item = F.struct("seg_idx", F.col("start_ms").alias("s"), F.col("end_ms").alias("e"), F.col("text").alias("t"), F.coalesce(strip(F.col("text")), F.lit("")).alias("u"))
    runs = rows.groupBy("call_id", "run").agg(F.first("speaker").alias("speaker"), F.array_sort(F.collect_list(item)).alias("items"))

    def kept(x: Column) -> Column:
        return F.struct(*(x[c].alias(c) for c in "setu"))

    def step(state: Column, x: Column) -> Column:
        last = state["last"]
        near = (x["s"] - last["e"] < gap_ms) | (last["e"] - last["s"] < short_ms) | (x["e"] - x["s"] < short_ms)
        said = F.when(last["u"] == "", x["u"]).otherwise(F.concat(last["u"], F.lit(" "), x["u"]))
        adds = (x["u"] != "") & (x["u"] != last["u"])
        both = F.struct(last["s"].alias("s"), x["e"].alias("e"), F.when(adds, said).otherwise(last["t"]).alias("t"), F.when(adds, said).otherwise(last["u"]).alias("u"))
        return F.struct(F.when(near, state["done"]).otherwise(F.concat(state["done"], F.array(last))).alias("done"), F.when(near, both).otherwise(kept(x)).alias("last"))

    def lot(state: Column, k: Column) -> Column:
        none = F.array().cast("array<struct<s:bigint,e:bigint,t:string,u:string>>")
        found = F.aggregate(F.slice("items", k * LOT + 2, F.lit(LOT)), F.struct(none.alias("done"), state["last"].alias("last")), step)
        # An array of one entry binds what was found once for both fields.
        return F.get(F.transform(F.array(found), lambda x: F.struct(F.concat(state["done"], F.array(x["done"])).alias("done"), x["last"].alias("last"))), F.lit(0))

    none = F.array().cast("array<array<struct<s:bigint,e:bigint,t:string,u:string>>>")
    start = F.struct(none.alias("done"), kept(F.get("items", F.lit(0))).alias("last"))
    lots = F.sequence(F.lit(0), F.floor((F.size("items") - 1) / LOT).cast("int"))
    merged = F.aggregate(lots, start, lot, lambda x: F.concat(F.flatten(x["done"]), F.array(x["last"])))
    out = runs.select("call_id", "run", "speaker", F.posexplode(merged).alias("place", "x"))
    place = F.row_number().over(Window.partitionBy("call_id").orderBy("run", "place")) - 1
    return out.select("call_id", place.cast("long").alias("seg_idx"), F.col("x.s").alias("start_ms"), F.col("x.e").alias("end_ms"), F.col("x.t").alias("text"), "speaker")


def drop_repeats(segments: DataFrame, likeness: float = 0.8, keep: int = 2) -> DataFrame:
    """Drops the third and later of neighbours that say the same (word sets over ``likeness``).

    Texts are compared stripped; a null text counts as empty.
    """
    text = F.coalesce(strip(F.col("text")), F.lit(""))
    rows = segments.withColumn("own", text)
    rows = rows.withColumn("before", F.coalesce(F.lag("own").over(_in_order()), F.lit("")))
    a, b = words(F.col("own")), words(F.col("before"))
    jaccard = F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))).otherwise(0.0)
    rows = rows.withColumn("same", (F.col("own") == F.col("before")) | (jaccard > likeness))
    rows = rows.withColumn("run", F.sum((~F.col("same")).cast("int")).over(_in_order()))
    place = F.row_number().over(Window.partitionBy("call_id", "run").orderBy("seg_idx")) + (F.col("run") == 0).cast("int")
    return rows.withColumn("place", place).where(F.col("place") <= keep).drop("own", "before", "same", "run", "place")


def at_least(segments: DataFrame, ms: int) -> DataFrame:
    """Segments that last ``ms`` or longer: 1500 to measure voices, 1000 to judge emotions."""
    return segments.where(F.col("end_ms") - F.col("start_ms") >= ms)


def counters(chunks: DataFrame, merged: DataFrame, kept: DataFrame) -> DataFrame:
    """(call_id, n_chunks, n_cleaned, n_merged, n_removed, n_segments, n_speakers) of each call.

    ``chunks`` comes from :func:`clean_chunks`, ``merged`` from :func:`merge_adjacent` and ``kept``
    from :func:`drop_repeats`. n_merged segments went into their neighbours and n_removed repeated.
    """
    named = F.coalesce("speaker", F.lit("UNKNOWN"))
    n = chunks.groupBy("call_id").agg(F.count("*").alias("n_chunks"), F.count_if(F.col("reason").isNull()).alias("n_cleaned"))
    n = n.join(merged.groupBy("call_id").agg(F.count("*").alias("m")), "call_id", "left")
    n = n.join(kept.groupBy("call_id").agg(F.count("*").alias("k"), F.countDistinct(named).alias("s")), "call_id", "left").na.fill(0, ["m", "k", "s"])
    gone = (F.col("n_cleaned") - F.col("m")).alias("n_merged"), (F.col("m") - F.col("k")).alias("n_removed")
    return n.select("call_id", "n_chunks", "n_cleaned", *gone, F.col("k").alias("n_segments"), F.col("s").alias("n_speakers"))


def first_per_speaker(segments: DataFrame, n: int = 3, longer_ms: int = 2000) -> DataFrame:
    """The first n segments of each speaker that are longer than ``longer_ms``."""
    rank = F.row_number().over(Window.partitionBy("call_id", "speaker").orderBy("seg_idx"))
    return segments.where(F.col("end_ms") - F.col("start_ms") > longer_ms).withColumn("rank", rank).where(F.col("rank") <= n)


def call_spans(segments: DataFrame) -> DataFrame:
    """Segments, speakers and whole seconds of each call, by its last segment in order."""
    named = F.coalesce("speaker", F.lit("UNKNOWN"))
    return segments.groupBy("call_id").agg(F.count("*").alias("n_segments"), F.countDistinct(named).alias("n_speakers"), F.floor(F.max_by("end_ms", "seg_idx") / 1000).cast("long").alias("seconds"))


def explode_chunks(results: DataFrame) -> DataFrame:
    """``results(call_id, chunks)`` to a row for each chunk: trimmed text, and 0 for null bounds.

    chunks is an array of structs (start, end, text). A call without chunks has no rows.
    """
    rows = results.select("call_id", F.posexplode("chunks").alias("chunk_idx", "c"))
    return rows.select("call_id", "chunk_idx", *(F.coalesce(F.col(f"c.{x}"), F.lit(0.0)).alias(x) for x in ("start", "end")), strip(F.col("c.text")).alias("text"))


def run_report(segments: DataFrame, first: int = 20, *parts: DataFrame) -> DataFrame:
    """(call_id, num_segments, segments_sample): all segments counted, the ``first`` ones shown in order, beside the columns of ``parts``.

    The rank is filtered before anything is gathered, so that a task sends ``first`` segments of a
    call at most. ``parts`` are tables by call_id, such as roles, moods and voices of its speakers.
    """
    shown = segments.select("call_id", "seg_idx", "start_ms", "end_ms", "speaker", "text").withColumn("place", F.row_number().over(_in_order())).where(F.col("place") <= first)
    shown = shown.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start_ms", "end_ms", "speaker", "text"))).alias("segments_sample"))
    out = segments.groupBy("call_id").agg(F.count("*").alias("num_segments")).join(shown, "call_id")
    for part in parts:
        out = out.join(part, "call_id", "left")
    return out
