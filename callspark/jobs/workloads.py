"""The jobs end to end: transcripts from chunks, voices from frames, documents from both, and all of them for arriving calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import emotion, prosody, report, segments, speakers


def _unwatched(rows: DataFrame, *_) -> DataFrame:
    return rows


def attributed(chunks: DataFrame, turns: DataFrame, watch=_unwatched) -> DataFrame:
    """Clean segments of ``chunks(call_id, chunk_idx, start, end, text)``, given to the speakers of ``turns``, merged and thinned.

    ``watch(rows, name, *aggregates)`` gets what each step leaves.
    """
    cleaned = watch(segments.clean_chunks(chunks), "cleaned", F.count("*").alias("n_chunks"), F.count_if(F.col("reason").isNull()).alias("n_cleaned"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    rows = cleaned.where("reason IS NULL").select("call_id", F.col("chunk_idx").cast("long").alias("seg_idx"), ms("start"), ms("end"), "text")
    long = chunks.select(ms("start"), ms("end"))
    merged = watch(segments.merge_adjacent(segments.assign_speakers(rows, turns, long)), "merged", F.count("*").alias("merged"))
    return watch(segments.drop_repeats(merged), "kept", F.count("*").alias("n_segments"))


def transcript_job(chunks: DataFrame, turns: DataFrame, **lexicon) -> DataFrame:
    """(call_id, transcript_plain, transcript_labeled, transcript_enriched): three texts of each call with clean segments."""
    return transcripts_of(attributed(chunks, turns), **lexicon)


def gated_transcript_job(calls: DataFrame, chunks: DataFrame, turns: DataFrame, most: float, **lexicon) -> DataFrame:
    """A record (call_id, success, the three transcripts, error) of each of ``calls(call_id, duration_sec)``.

    Calls longer than ``most`` seconds fail at once: none of their chunks and turns is looked at.
    """
    judged = report.duration_gate(calls, most)
    ok, _ = report.split_failed(judged)
    let = lambda rows: rows.join(ok.select("call_id"), "call_id", "left_semi")
    return report.api_record(judged.select("call_id", "error"), transcript_job(let(chunks), let(turns), **lexicon))


class Metrics:
    """Counters of a job from the pass that makes its result: ``watch`` observes rows, :meth:`get` waits for one action."""

    def __init__(self) -> None:
        self.seen: list[Observation] = []

    def watch(self, rows: DataFrame, name: str, *aggregates: Column) -> DataFrame:
        self.seen.append(Observation(name))
        return rows.observe(self.seen[-1], *aggregates)

    def get(self) -> dict[str, int]:
        """n_chunks, n_cleaned, n_merged, n_removed, n_segments and n_speakers over all calls of a :func:`watched_transcript_job`."""
        n = {k: v for x in self.seen for k, v in x.get.items()}
        return {"n_chunks": n["n_chunks"], "n_cleaned": n["n_cleaned"], "n_merged": n["n_cleaned"] - n["merged"], "n_removed": n["merged"] - n["n_segments"], "n_segments": n["n_segments"], "n_speakers": n["n_speakers"]}


def watched_transcript_job(chunks: DataFrame, turns: DataFrame, **lexicon) -> tuple[DataFrame, Metrics]:
    """:func:`transcript_job` and its counters, known once the transcripts are written: no second scan."""
    seen = Metrics()
    named = speakers.with_roles(attributed(chunks, turns, seen.watch), **lexicon)
    return texts_of(seen.watch(named, "named", F.count_if(F.col("seg_idx") == F.col("first_seg")).alias("n_speakers"))), seen


def transcripts_of(rows: DataFrame, **lexicon) -> DataFrame:
    """The same of clean segments."""
    return texts_of(speakers.with_roles(rows, **lexicon))


def texts_of(rows: DataFrame) -> DataFrame:
    """The same of segments with roles."""
    names = {"transcript_plain": None, "transcript_labeled": "speaker", "transcript_enriched": "role"}
    # One aggregate gathers all three, so the segments are made once.
    lines = rows.select("call_id", F.struct("seg_idx", *(speakers.timed_line(who).alias(name) for name, who in names.items())).alias("x"))
    told = lines.groupBy("call_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return told.select("call_id", *(F.array_join(F.col(f"x.{name}"), "\n").alias(name) for name in names))


def voice_job(frames: DataFrame, rows: DataFrame, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """Segments against their speaker's baseline, and the summary of each speaker, from ``frames`` and segments."""
    beside = prosody.enriched(prosody.measured(rows, prosody.segment_prosody(frames, rows, least)))
    return beside, prosody.speaker_summary(beside)


def danger_job(rows: DataFrame, moods: DataFrame, voices: DataFrame, lexicon: dict, rules) -> DataFrame:
    """Dangers of every call of the segments ``rows``, from what is said, felt and heard."""
    return speakers.danger(speakers.keyword_hits(rows, lexicon), prosody.prosody_flags(voices), emotion.emotion_flags(moods, rules), calls=rows)


def prompt_job(calls: DataFrame, rows: DataFrame, beside: DataFrame, voices: DataFrame, found: DataFrame, template: str, **lexicon) -> DataFrame:
    """(call_id, prompt) of every one of ``calls``: inline transcript by role, voices, and dangers where detected."""
    named = speakers.with_roles(rows, **lexicon)
    # One row a call from each table, so each is read once.
    lines = prosody.tagged_lines(named.select("*", F.struct("rank", "speaker", "role").alias("who")), beside, "role", "who")
    told = lines.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "line"))).alias("x"), F.collect_set("who").alias("roles"))
    told = told.select("call_id", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("transcript"), "roles")
    out = calls.join(told, "call_id", "left").join(report.speaker_map(voices.select("call_id", "speaker", "base_pitch", "voice_description"), "voices"), "call_id", "left").join(found, "call_id", "left")
    meta = report.meta_text(F.col("roles"), F.col("voices"), F.coalesce("flags", F.array().cast("array<string>")))
    return report.prompts(out.withColumns({"meta": meta, "danger_info": speakers.danger_text()}), template)


def report_job(responses: DataFrame, rows: DataFrame, moods: DataFrame, voices: DataFrame, danger: DataFrame, **lexicon) -> DataFrame:
    """(call_id, report): the models' ``responses(call_id, response)`` parsed to a VARIANT, with tones and dangers put in.

    ``danger`` is (call_id, danger_info): what the caller knows, as JSON of the field 위험요소.
    """
    roles = speakers.role_ranks(rows, **lexicon)
    out = report.reports(responses).join(report.tones(roles, moods, voices), "call_id", "left").join(danger, "call_id", "left")
    return report.filled(out).select("call_id", "report")


def whole_calls(lexicon: dict, rules, least: int = 50, **roles):
    """The job of ``stream_whole_calls`` on chunks, turns, frames and moods (call_id, speaker, start_ms, end_ms, probabilities).

    Its tables: segments, transcripts, roles, voices, moods and dangers, each as the batch jobs make it.
    """

    def job(rows: dict[str, DataFrame], keep) -> dict[str, DataFrame]:
        seg = keep(attributed(rows["chunks"], rows["turns"]), "segments")
        _, voices = voice_job(rows["frames"], seg, least)
        voices = keep(voices, "voices")
        moods = keep(emotion.emotion_by_speaker(segments.at_least(rows["moods"], 1000)), "moods")
        return {
            "segments": seg, "transcripts": transcripts_of(seg, **roles), "roles": speakers.role_ranks(seg, **roles),
            "voices": voices, "moods": moods, "dangers": danger_job(seg, moods, voices, lexicon, rules),
        }

    return job
