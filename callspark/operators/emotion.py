"""Emotion scores per segment and per speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import EMOTIONS, TONES


def softmax(logits: Column) -> Column:
    """Probabilities of an array of logits."""
    # Arrays of one entry bind the maximum and the sum once for all labels.
    powers = F.get(F.transform(F.array(F.array_max(logits)), lambda top: F.transform(logits, lambda x: F.exp(x - top))), F.lit(0))
    whole = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.get(F.transform(F.array(powers), lambda p: F.get(F.transform(F.array(whole(p)), lambda n: F.transform(p, lambda x: x / n)), F.lit(0))), F.lit(0))


def scores(probabilities: Column, labels: list[str] = EMOTIONS) -> Column:
    """Label to probability; classes past the labels are called label_i."""
    names = F.transform(probabilities, lambda _, i: F.coalesce(F.get(F.array(*map(F.lit, labels)), i), F.concat(F.lit("label_"), i.cast("string"))))
    return F.map_from_arrays(names, probabilities)


def best_label(probabilities: Column, labels: list[str] = EMOTIONS, least: float = 0.4, neutral: str = "중립") -> Column:
    """The first label of the highest probability; neutral if that is under ``least``, unknown past the labels and without any."""
    top = F.array_max(probabilities)
    named = F.get(F.array(*map(F.lit, labels)), F.array_position(probabilities, top).cast("int") - 1)
    return F.when(top < least, neutral).otherwise(F.coalesce(named, F.lit("unknown")))


def emotion_by_speaker(segments: DataFrame, labels: list[str] = EMOTIONS, tones: dict[str, str] = TONES, mixed: float = 0.1) -> DataFrame:
    """``segments(call_id, speaker, probabilities)`` to dominant emotion, shares and tone of each speaker.

    Segments labelled unknown (or without probabilities) don't count; a speaker with no others
    gets unknown, no shares and the tone 분석 불가. Filter by length first, with ``at_least``.
    """
    known = F.col("probabilities").isNotNull() & (best_label(F.col("probabilities"), labels) != "unknown")
    part = lambda i: F.when(known, F.round(F.get("probabilities", F.lit(i)) * 1e6).cast("long"))
    totals = segments.groupBy("call_id", "speaker").agg(*(F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"p{i}") for i in range(len(labels))))
    whole = sum((F.col(f"p{i}") for i in range(1, len(labels))), F.col("p0"))
    share = lambda i: F.coalesce(F.floor(F.col(f"p{i}") * 1000 / F.nullif(whole, F.lit(0)) + 0.5) / 1000, F.lit(0.0))
    listed = F.array(*(F.struct((-share(i)).alias("less"), F.lit(i).alias("ord"), F.lit(x).alias("label")) for i, x in enumerate(labels)))
    rows = totals.select("call_id", "speaker", (whole > 0).alias("known"), F.array_sort(listed).alias("ranked"))
    tone = F.create_map(*(F.lit(x) for pair in tones.items() for x in pair))
    name = lambda k: F.get("ranked", F.lit(k))["label"]
    close = F.get("ranked", F.lit(1))["less"] - F.get("ranked", F.lit(0))["less"] < mixed
    text = F.when(close, F.concat(F.coalesce(F.element_at(tone, name(0)), name(0)), F.lit(" + "), F.coalesce(F.element_at(tone, name(1)), name(1)), F.lit(" 혼합"))).otherwise(F.coalesce(F.element_at(tone, name(0)), F.lit("차분함")))
    shares = F.map_from_entries(F.transform("ranked", lambda x: F.struct(x["label"], -x["less"])))
    none = F.create_map().cast("map<string,double>")
    return rows.select(
        "call_id", "speaker", F.when(F.col("known"), name(0)).otherwise("unknown").alias("dominant_emotion"),
        F.when(F.col("known"), shares).otherwise(none).alias("emotion_distribution"), F.when(F.col("known"), text).otherwise("분석 불가").alias("tone_description"),
    )


def emotion_flags(speakers: DataFrame, rules=(("angry", 0.4, "강한 분노 감정 감지"), ("sad", 0.5, "심한 우울/슬픔 감지"))) -> DataFrame:
    """(call_id, flag) where a rule's label dominates by more than its share."""
    found = [speakers.where((F.col("dominant_emotion") == x) & (F.element_at("emotion_distribution", x) > share)).select("call_id", F.concat_ws(" ", "speaker", F.lit(flag)).alias("flag")) for x, share, flag in rules]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def ranked_shares(speakers: DataFrame, top: int = 2) -> DataFrame:
    """The ``top`` emotions of each speaker as rows."""
    rows = speakers.select("call_id", "speaker", F.explode("emotion_distribution").alias("label", "share"))
    order = Window.partitionBy("call_id", "speaker").orderBy(F.col("share").desc(), "label")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
