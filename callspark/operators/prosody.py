"""Pitch, energy and rate: per segment, against a speaker's baseline, and per speaker.

Energies are in units of 1e-4 and pitches in Hz, as integers where they are measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicons import ENERGY_TONES, RATES, RELATIVE_PITCH, VARIABILITY
from ..functions.text import clock, strip
from .intervals import overlapping
from .segments import at_least

UNKNOWN = "unknown"
MEASURES = ["pitch", "std", "energy"]
VALUES = {"relative_pitch": list(RELATIVE_PITCH), "pitch_var_level": list(VARIABILITY), "energy_level": list(ENERGY_TONES), "speech_rate": list(RATES)}
MODES = list(VALUES)


def level(x: Column, low: float, high: float, names=("low", "normal", "high")) -> Column:
    return F.when(x.isNull(), None).when(x < low, names[0]).when(x > high, names[2]).otherwise(names[1])


def segment_prosody(frames: DataFrame, segments: DataFrame, least: int = 50, shortest_ms: int = 1500) -> DataFrame:
    """Measures of each segment from the frames in it: a range join on time buckets, then one aggregate.

    Segments under ``shortest_ms`` aren't measured: their measures are null. Those with fewer than
    ``least`` frames (half a second, at 10 ms a frame) are unknown: measures 0, levels unknown.
    Without voiced frames the pitch is 0 and low, which is known. Levels come from unrounded values.
    """
    asked = at_least(segments, shortest_ms).select("call_id", "seg_idx", "start_ms", "end_ms")
    points = frames.withColumn("start_ms", F.col("t_ms")).withColumn("end_ms", F.col("t_ms") + 1)
    # Frames are all of the first level; no need to read them for that.
    point = frames.sparkSession.range(1).select(F.lit(0).alias("start_ms"), F.lit(1).alias("end_ms"))
    met = overlapping(points, asked, a_like=point)
    f0 = F.when((F.col("f0") > 50) & (F.col("f0") < 500), F.col("f0"))
    out = met.groupBy("call_id", "seg_idx").agg(F.count("*").alias("n"), F.count(f0).alias("nv"), F.sum(f0).alias("s"), F.sum(f0 * f0).alias("q"), F.avg("rms").alias("energy"), F.count_if("onset").alias("o"))
    out = segments.select("call_id", "seg_idx", (F.col("end_ms") - F.col("start_ms")).alias("dur")).join(out, ["call_id", "seg_idx"], "left")
    n, enough = F.nullif("nv", F.lit(0)), F.coalesce(F.col("n"), F.lit(0)) >= least
    spread = F.sqrt(F.greatest(n * F.col("q") - F.col("s") * F.col("s"), F.lit(0))) / n
    out = out.select("call_id", "seg_idx", "dur", enough.alias("known"), F.coalesce(F.col("s") / n, F.lit(0.0)).alias("p"), F.coalesce(spread, F.lit(0.0)).alias("d"), F.coalesce("energy", F.lit(0.0)).alias("e"), (F.col("o") * 1000 / F.nullif("dur", F.lit(0))).alias("r"))
    put = lambda value, none, name: F.when(F.col("dur") >= shortest_ms, F.when(F.col("known"), value).otherwise(none)).alias(name)
    return out.select(
        "call_id", "seg_idx",
        put(F.bround("p", 1), 0.0, "pitch_mean"), put(F.bround("d", 1), 0.0, "pitch_std"), put(level(F.col("p"), 100, 250), UNKNOWN, "pitch_level"),
        put(F.bround("e", 0), 0.0, "energy_mean"), put(level(F.col("e"), 100, 800), UNKNOWN, "energy_level"), put(level(F.col("r"), 3, 7, ("slow", "normal", "fast")), UNKNOWN, "speech_rate"),
    )


def measured(segments: DataFrame, prosody: DataFrame) -> DataFrame:
    """``segments(call_id, seg_idx, speaker)`` with a :func:`segment_prosody`; unknown measures become null."""
    known = F.col("pitch_level") != UNKNOWN
    pick = lambda c, name: F.when(known, F.col(c)).alias(name)
    values = prosody.select("call_id", "seg_idx", pick("pitch_mean", "pitch"), pick("pitch_std", "std"), pick("energy_mean", "energy"), pick("energy_level", "energy_level"), pick("speech_rate", "speech_rate"))
    return segments.select("call_id", "seg_idx", F.coalesce("speaker", F.lit("UNKNOWN")).alias("speaker")).join(values, ["call_id", "seg_idx"], "left")


def with_baselines(rows: DataFrame) -> DataFrame:
    """Exact medians of pitch, std and energy of each speaker's measured segments, beside the segments: no join."""
    own = Window.partitionBy("call_id", "speaker")
    return rows.withColumns({f"base_{c}": F.median(c).over(own) for c in MEASURES})


def value_counts(rows: DataFrame) -> DataFrame:
    """(call_id, speaker, measure, value, n): how often each speaker's measured segments have a value.

    Measures are rounded where they are taken, so a speaker has few values however long the calls.
    Tables of several runs are added up by :func:`merged_counts`.
    """
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in MEASURES)))
    out = rows.select("call_id", "speaker", each.alias("x")).where("x.value IS NOT NULL")
    return out.groupBy("call_id", "speaker", "x.measure", "x.value").agg(F.count("*").alias("n"))


def merged_counts(*runs: DataFrame) -> DataFrame:
    """The value counts of all ``runs`` together."""
    out = runs[0]
    for more in runs[1:]:
        out = out.unionByName(more)
    return out.groupBy("call_id", "speaker", "measure", "value").agg(F.sum("n").alias("n"))


def baselines(counts: DataFrame) -> DataFrame:
    """(call_id, speaker, base_pitch, base_std, base_energy): exact medians from value counts.

    The middle values are those whose ranks, summed up in order, reach the middle; of an even
    number the two in the middle are averaged. A speaker without a measure has no row.
    """
    own = Window.partitionBy("call_id", "speaker", "measure")
    upto = F.sum("n").over(own.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.where("n > 0").withColumns({"upto": upto, "total": F.sum("n").over(own)})
    holds = lambda rank: (rank > F.col("upto") - F.col("n")) & (rank <= F.col("upto"))
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    rows = rows.where(holds(low) | holds(high))
    out = rows.groupBy("call_id", "speaker", "measure").agg(((F.min("value") + F.max("value")) / 2).alias("middle"))
    pick = lambda c: F.max(F.when(F.col("measure") == c, F.col("middle"))).alias(f"base_{c}")
    return out.groupBy("call_id", "speaker").agg(*(pick(c) for c in MEASURES))


def enriched(rows: DataFrame, before: int = 3, pitch_jump: float = 0.25, energy_jump: float = 0.4, table: DataFrame | None = None) -> DataFrame:
    """Segments against their baseline and the ``before`` earlier measured ones of the same speaker.

    ``rows`` has call_id, seg_idx, speaker, pitch, std, energy, and either energy_level and
    speech_rate or rate, the onsets a second. Segments whose pitch is null were not measured: they
    come through with nulls, and are no reference of later ones. Baselines are those of the rows
    themselves, or of a ``table`` of :func:`baselines`; measured segments of speakers that it
    doesn't have come through as those that weren't measured, with their measures.
    """
    known = F.col("pitch").isNotNull()
    if "energy_level" not in rows.columns:
        rows = rows.withColumn("energy_level", level(F.col("energy"), 100, 800))
    if "speech_rate" not in rows.columns:
        rows = rows.withColumn("speech_rate", level(F.col("rate"), 3, 7, ("slow", "normal", "fast")))
    # Measured segments are counted by themselves, so that the window skips the others.
    recent = Window.partitionBy("call_id", "speaker", "known").orderBy("seg_idx").rowsBetween(-before, -1)
    if table is None:
        m = with_baselines(rows).withColumn("known", known)
    else:
        has = table.select("call_id", "speaker", *(f"base_{c}" for c in MEASURES), F.lit(True).alias("has"))
        m = rows.join(has, ["call_id", "speaker"], "left").withColumn("known", known & F.coalesce("has", F.lit(False))).drop("has")
    m = m.withColumns({f"ref_{c}": F.coalesce(F.avg(c).over(recent), F.col(f"base_{c}")) for c in ("pitch", "energy")})
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.nullif(F.col(b), F.lit(0)))
    ratio, loud = F.coalesce(over("pitch", "base_pitch"), F.lit(1.0)), F.coalesce(over("energy", "base_energy"), F.lit(1.0))

    def jump(c: str, name: str, most: float) -> Column:
        share = F.coalesce(F.when(F.col(f"ref_{c}") > 0, F.abs(F.col(c) - F.col(f"ref_{c}")) / F.nullif(F.col(f"ref_{c}"), F.lit(0))), F.lit(0.0))
        return F.when(share >= most, F.concat(F.lit(name), F.when(F.col(c) > F.col(f"ref_{c}"), "↑").otherwise("↓")))

    labels = {
        "relative_pitch": F.when(ratio < 0.85, "much_lower").when(ratio < 0.95, "lower").when(ratio <= 1.05, "normal").when(ratio <= 1.15, "higher").otherwise("much_higher"),
        "pitch_var_level": F.when(F.col("std") >= F.greatest(F.col("base_std") * 1.5, F.lit(50)), "high").when(F.col("std") <= F.least(F.col("base_std") * 0.8, F.lit(25)), "low").otherwise("normal"),
        "pitch_pct": F.bround((ratio - 1) * 100, 1), "energy_pct": F.bround((loud - 1) * 100, 1),
        "change_hint": F.concat_ws("+", jump("pitch", "피치", pitch_jump), jump("energy", "에너지", energy_jump)),
        "energy_level": F.col("energy_level"), "speech_rate": F.col("speech_rate"),
    }
    # Without a baseline, what a segment has by itself stays.
    own = lambda name: F.col("pitch").isNotNull() if name in ("energy_level", "speech_rate") else F.col("known")
    m = m.withColumns({name: F.when(own(name), value) for name, value in labels.items()})
    return m.withColumn("sudden_change", F.col("change_hint") != "").drop("known")


def speaker_summary(segments: DataFrame) -> DataFrame:
    """Per speaker of an :func:`enriched`: baselines, means, number of sudden changes, modes and the voice in words.

    Only measured segments count; a speaker without any has no row. Of values that are as
    frequent, the one seen first is the mode. Levels other than those of VALUES aren't counted.
    """
    rows = segments.where("pitch IS NOT NULL")
    # Fields have few values, so how often and where first each occurs are plain aggregates of one pass.
    is_ = lambda c, v: F.col(c).isNull() if v is None else F.coalesce(F.col(c) == v, F.lit(False))
    places = {(c, i): (v, f"_{c}{i}") for c in MODES for i, v in enumerate([*VALUES[c], None])}
    seen = [x for (c, _), (v, name) in places.items() for x in (F.count_if(is_(c, v)).alias(f"{name}n"), F.min(F.when(is_(c, v), F.col("seg_idx"))).alias(f"{name}f"))]
    most = lambda c: F.array_max(F.array(*(F.struct(F.col(f"{name}n").alias("n"), (-F.col(f"{name}f")).alias("f"), F.lit(v).cast("string").alias("value")) for (x, _), (v, name) in places.items() if x == c)))["value"]
    # Decimals add up to the same sum in any order.
    mean = lambda c, name, digits: F.bround(F.sum(F.col(c).cast("decimal(18,4)")) / F.count("*"), digits).cast("double").alias(name)
    first = lambda c, digits: F.bround(F.first(f"base_{c}").cast("decimal(18,4)"), digits).cast("double").alias(f"base_{c}")
    means = rows.groupBy("call_id", "speaker").agg(first("pitch", 1), first("energy", 0), mean("pitch", "avg_pitch", 1), mean("std", "pitch_variability", 1), mean("energy", "avg_energy", 0), F.count_if("sudden_change").alias("sudden_change_count"), *seen)
    out = means.select("call_id", "speaker", *(c for c in means.columns if c not in ("call_id", "speaker") and not c.startswith("_")), *(most(c).alias(c) for c in MODES))
    return out.withColumn("voice_description", voice_description())


def prosody_flags(summary: DataFrame) -> DataFrame:
    """(call_id, flag): raised voices and frequent sudden changes."""
    loud = summary.where((F.col("energy_level") == "high") & F.col("relative_pitch").isin("higher", "much_higher")).select("call_id", F.concat("speaker", F.lit(" 고성 가능성")).alias("flag"))
    often = summary.where("sudden_change_count >= 3").select("call_id", F.format_string("%s 운율 급변 다발 (%d회)", "speaker", "sudden_change_count").alias("flag"))
    return loud.unionByName(often)


def _word(names: dict[str, str], key: str, default: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col(key)), F.lit(default))


def _whole(x: Column, signed: bool = False) -> Column:
    """A number without decimals, halves to even; with its sign, if ``signed``."""
    text = F.format_string("%.0f", F.bround(F.abs(x).cast("double"), 0))
    return F.concat(F.when(x < 0, "-").otherwise("+" if signed else ""), text)


def inline_tag() -> Column:
    """The short note on pitch, energy and rate beside an utterance; null where nothing was measured."""
    pitch = F.concat(F.lit("피치="), _whole(F.col("pitch")), F.lit("Hz("), _word(RELATIVE_PITCH, "relative_pitch", "평소"), F.lit(","), _whole(F.col("pitch_pct"), True), F.lit("%)"))
    spread = F.concat(F.lit("변동="), _word(VARIABILITY, "pitch_var_level", "보통"), F.lit("(std="), _whole(F.col("std")), F.lit(")"))
    energy = F.concat(F.lit("에너지="), "energy_level", F.lit("("), _whole(F.col("energy_pct"), True), F.lit("%)"))
    sudden = F.when(F.col("sudden_change"), F.concat(F.lit("급변="), "change_hint"))
    return F.when(F.col("pitch").isNotNull(), F.concat_ws(", ", pitch, spread, energy, F.concat(F.lit("말속도="), "speech_rate"), sudden))


def tagged_lines(segments: DataFrame, measures: DataFrame, name: str = "speaker", *more: str) -> DataFrame:
    """(call_id, seg_idx, line): segments with clocks, the column ``name`` of who speaks, and the inline tag, if measured.

    ``measures`` is a result of :func:`enriched` for the same call_id and seg_idx; ``name`` is role
    after ``with_roles``. Columns ``more`` of the segments come along.
    """
    tags = measures.select("call_id", "seg_idx", inline_tag().alias("tag"))
    told = F.when(F.col("tag").isNotNull(), F.concat(F.lit("  |운율: "), "tag", F.lit("|")))
    line = F.concat(
        F.lit("["), clock(F.col("start_ms") / 1000, 1), F.lit("~"), clock(F.col("end_ms") / 1000, 1), F.lit("] ["), F.coalesce(F.col(name), F.lit("UNKNOWN")), F.lit("] "),
        F.coalesce(strip(F.col("text")), F.lit("")), F.coalesce(told, F.lit("")),
    )
    return segments.join(tags, ["call_id", "seg_idx"], "left").select("call_id", "seg_idx", line.alias("line"), *more)


def voice_description() -> Column:
    """The voice in words, of a row with base_pitch, the modes and sudden_change_count."""
    text = F.concat(
        F.lit("평소피치 "), _whole(F.coalesce("base_pitch", F.lit(0.0))), F.lit("Hz, 전체 "), _word(RELATIVE_PITCH, "relative_pitch", "평소"), F.lit(", 변동 "), _word(VARIABILITY, "pitch_var_level", "보통"),
        F.lit(", "), _word(ENERGY_TONES, "energy_level", ""), F.lit(", "), _word(RATES, "speech_rate", ""),
    )
    return F.concat(text, F.when(F.col("sudden_change_count") > 0, F.format_string(", 급변 %d회", "sudden_change_count")).otherwise(""))


def sample_averages(sample: DataFrame) -> DataFrame:
    """(call_id, speaker, avg_pitch, avg_energy) of sampled segments; pitch 0 is unvoiced and not counted."""
    voiced = F.when(F.col("pitch") > 0, F.col("pitch"))
    return sample.groupBy("call_id", "speaker").agg(F.coalesce(F.avg(voiced), F.lit(0.0)).alias("avg_pitch"), F.coalesce(F.avg("energy"), F.lit(0.0)).alias("avg_energy"))
