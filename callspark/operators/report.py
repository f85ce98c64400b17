"""Gates, visit windows, prompts, parsed responses and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType, VariantType

from ..functions.text import parse_response
from ..schemas import DANGER_FIELD, MAIN_ROLES, RESULT_DEFAULTS, TONE_FIELDS

FIELDS = ["admin_name", "admin_phone", "patient_name", "age", "gender", "address"]
PLAIN = ["start_time", "end_time", "duration_sec"]
NULLS = {"ignoreNullFields": "false"}
VOICES_HEAD = "[화자별 운율 종합 (baseline 기준)]"


def duration_gate(calls: DataFrame, most: float) -> DataFrame:
    """Calls with ``error``: null, or the message for those strictly longer than ``most`` seconds."""
    told = F.concat(F.lit("오디오가 너무 깁니다 ("), F.format_string("%.0f", F.bround(F.col("duration_sec").cast("double"), 0)), F.lit(f"초). 최대 {int(most)}초"))
    return calls.withColumn("error", F.when(F.col("duration_sec") > most, told))


def split_failed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and the quarantined rest; a frame without the column ``error`` has no rest."""
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL")


def visit_window(start: Column, seconds: Column, now: Column) -> tuple[Column, Column]:
    """Start and end of a visit to the second; both ``now`` where the start can't be read."""
    read = F.try_to_timestamp(start, F.lit("yyyy-MM-dd HH:mm:ss"))
    end = F.when(read.isNotNull(), F.timestamp_add("MICROSECOND", (seconds * 1e6).cast("long"), read)).otherwise(now)
    return F.date_format(F.coalesce(read, now), "yyyy-MM-dd HH:mm:ss"), F.date_format(end, "yyyy-MM-dd HH:mm:ss")


def full_years(birth: Column, day: Column) -> Column:
    return F.floor(F.months_between(day, birth) / 12).cast("int")


def _meta(head: str, line: Column, rows: DataFrame, flags: DataFrame, mark: str) -> DataFrame:
    rows = rows.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("rank", "speaker", line.alias("line")))).alias("x"))
    listed = F.array_join(F.transform("x", lambda x: x["line"]), "\n")
    told = F.when(F.size("flags") > 0, F.concat(F.lit(f"- {mark}위험 플래그: "), F.array_join("flags", ", ")))
    return rows.join(flags.select("call_id", "flags"), "call_id", "left").select("call_id", F.concat_ws("\n", F.lit(head), listed, told).alias("meta"))


def meta_lines(roles: DataFrame, voices: DataFrame, flags: DataFrame) -> DataFrame:
    """(call_id, meta): a header, a line per role by rank with baseline and voice, and the flags, if any.

    ``voices`` is a ``speaker_summary``, ``flags`` a ``danger``.
    """
    line = _voice_line(*(F.col(c) for c in ("role", "speaker", "base_pitch", "voice_description")))
    rows = roles.join(voices.select("call_id", "speaker", "base_pitch", "voice_description"), ["call_id", "speaker"], "left")
    return _meta(VOICES_HEAD, line, rows, flags, "")


def _voice_line(role: Column, speaker: Column, pitch: Column, words: Column) -> Column:
    whole = F.format_string("%.0f", F.coalesce(F.bround(pitch, 0), F.lit(0.0)))
    return F.concat(F.lit("- "), role, F.lit("("), speaker, F.lit("): baseline "), whole, F.lit("Hz, "), F.coalesce(words, F.lit("분석 불가")))


def meta_text(roles: Column, voices: Column, flags: Column) -> Column:
    """The meta of :func:`meta_lines` from one row a call: roles is an array of (rank, speaker, role), voices a map of speakers; null without roles."""

    def line(r: Column) -> Column:
        voice = F.element_at(voices, r["speaker"])
        return _voice_line(r["role"], r["speaker"], voice["base_pitch"], voice["voice_description"])

    told = F.when(F.size(flags) > 0, F.concat(F.lit("- 위험 플래그: "), F.array_join(flags, ", ")))
    return F.when(roles.isNotNull(), F.concat_ws("\n", F.lit(VOICES_HEAD), F.array_join(F.transform(F.array_sort(roles), line), "\n"), told))


def mood_lines(roles: DataFrame, moods: DataFrame, voices: DataFrame, flags: DataFrame) -> DataFrame:
    """(call_id, meta): as :func:`meta_lines`, with each role's emotion and voice in words."""
    rows = roles.join(moods.select("call_id", "speaker", "tone_description"), ["call_id", "speaker"], "left")
    rows = rows.join(voices.select("call_id", "speaker", "voice_description"), ["call_id", "speaker"], "left")
    told = lambda c: F.coalesce(c, F.lit("분석 불가"))
    line = F.concat(F.lit("- "), "role", F.lit("("), "speaker", F.lit("): 감정="), told("tone_description"), F.lit(", 음성="), told("voice_description"))
    return _meta("[음성 분석 결과]", line, rows, flags, "⚠ ")


def _pieces(template: str) -> list[tuple[str, str]]:
    """The template as texts and field names in turn; {{ and }} stand for braces."""
    import string

    return [(text, name) for text, name, _, _ in string.Formatter().parse(template)]


def prompts(calls: DataFrame, template: str, most: int = 50_000) -> DataFrame:
    """(call_id, prompt) of ``calls``: the fields of ``template`` filled; long transcripts are cut to fit.

    ``calls`` has admin_name, admin_phone, patient_name, age, gender, address, start_time,
    end_time, duration_sec, meta and transcript, and may have danger_info (JSON), which is added at
    the end where it isn't null. Empty fields are 미확인. Values are put in as they are: braces in
    them are no fields.
    """
    shown = {c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("미확인")) for c in FIELDS}
    shown |= {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in PLAIN}
    shown["analysis_meta"] = F.coalesce(F.nullif("meta", F.lit("")), F.lit("분석 데이터 없음"))
    danger = F.concat(F.lit("\n\n## 위험요소 사전 감지 정보\n"), "danger_info") if "danger_info" in calls.columns else F.lit(None)

    def fill(transcript: Column) -> Column:
        parts = [x for text, name in _pieces(template) for x in (F.lit(text), *([{**shown, "transcript": transcript}[name]] if name else []))]
        return F.concat(*parts, F.coalesce(danger, F.lit("")))

    text = F.coalesce("transcript", F.lit(""))
    calls = calls.withColumn("transcript", text)
    over = F.length(fill(F.col("transcript"))) - most
    return calls.select("call_id", fill(capped("transcript", over)).alias("prompt"))


def capped(name: str, over: Column) -> Column:
    """A text shortened by ``over`` characters and 200 more, if over 500 would be left."""
    left = F.length(name) - over - 200
    return F.when((over > 0) & (left > 500), F.concat(F.substring(F.col(name), F.lit(1), left.cast("int")), F.lit("\n... (이하 생략)"))).otherwise(F.col(name))


def reports(responses: DataFrame) -> DataFrame:
    """``responses(call_id, response)`` with report, the strict JSON of a response, or else raw_response, its text.

    Where the frame has an ``error`` (the model's call failed), the report is {"error": ...}.
    """
    parsed = parse_response(F.col("response"))
    if "error" in responses.columns:
        parsed = F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(parsed)
        responses = responses.withColumn("response", F.when(F.col("error").isNull(), F.col("response")))
    rows = responses.withColumn("report", parsed)
    return rows.withColumn("raw_response", F.when(F.col("report").isNull(), F.col("response"))).drop("response", "error")


def _variant(c: Column, kind: DataType) -> Column:
    """A value as VARIANT: JSON text as what it says, other text as text."""
    if isinstance(kind, StringType):
        return F.coalesce(F.try_parse_json(c), c.cast("variant"))
    return c if isinstance(kind, VariantType) else F.to_variant_object(c) if isinstance(kind, (StructType, MapType, ArrayType)) else c.cast("variant")


def filled(rows: DataFrame) -> DataFrame:
    """``rows(call_id, report, raw_response, tones, danger_info)`` with report as a VARIANT that keeps every field of the model.

    tones maps 매니저 and 시니어 to their tone and voice, a struct (tone, voice): a known tone replaces the
    report's, a voice is added to it, and without either the field stays as it is, of whatever
    type. Without the key 위험요소, danger_info (JSON) fills it. A response that was no JSON
    object, or one that names a key twice, is kept whole in the field raw_response.
    """
    text = F.coalesce("raw_response", "report")
    parsed = F.coalesce(F.try_parse_json("report"), F.try_parse_json(F.to_json(F.struct(text.alias("raw_response")))))
    rows = rows.withColumn("v", parsed).withColumn("m", F.col("v").cast("map<string,variant>"))
    put = []
    for role in MAIN_ROLES:
        known, name = F.element_at("tones", role), TONE_FIELDS[role]
        held = F.element_at("m", name)
        # What isn't text is shown as its JSON.
        existing = F.coalesce(F.try_variant_get(held, "$", "string"), F.to_json(held))
        put.append((name, F.when(F.coalesce(known["tone"], known["voice"]).isNotNull(), toned(known["tone"], known["voice"], existing)).cast("variant")))
    put.append((DANGER_FIELD, F.when(~F.map_contains_key("m", F.lit(DANGER_FIELD)), F.try_parse_json("danger_info"))))
    new = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in put)), lambda x: x["value"].isNotNull())
    rows = rows.withColumn("new", F.map_from_entries(new))
    kept = F.map_filter("m", lambda k, _: ~F.array_contains(F.map_keys("new"), k))
    whole = F.to_variant_object(F.map_concat(kept, F.col("new")))
    return rows.withColumn("report", whole).drop("v", "m", "new", "raw_response", "tones", "danger_info")


def toned(tone: Column, voice: Column, existing: Column) -> Column:
    """A role's tone field: a known tone replaces it, a voice description is added."""
    base = F.coalesce(tone, existing, F.lit(""))
    return F.when(voice.isNotNull(), F.concat(base, F.lit(" ("), voice, F.lit(")"))).otherwise(F.coalesce(tone, existing))


def tones(roles: DataFrame, moods: DataFrame, voices: DataFrame) -> DataFrame:
    """(call_id, tones): of the two main roles, what is known of their tone and voice."""
    rows = roles.where(F.col("role").isin(*MAIN_ROLES)).select("call_id", "speaker", "role")
    rows = rows.join(moods.select("call_id", "speaker", "tone_description"), ["call_id", "speaker"], "left").join(voices.select("call_id", "speaker", "voice_description"), ["call_id", "speaker"], "left")
    entry = F.struct("role", F.struct(F.col("tone_description").alias("tone"), F.col("voice_description").alias("voice")).alias("known"))
    return rows.groupBy("call_id").agg(F.map_from_entries(F.collect_list(entry)).alias("tones"))


def tone_overrides(roles: DataFrame, moods: DataFrame, voices: DataFrame, existing: Column | None = None) -> DataFrame:
    """(call_id, role, tone) of the two main roles: what is known of their speakers replaces ``existing``."""
    rows = tones(roles, moods, voices).select("call_id", F.explode("tones").alias("role", "known"))
    return rows.select("call_id", "role", toned(F.col("known.tone"), F.col("known.voice"), F.lit(None).cast("string") if existing is None else existing).alias("tone"))


def _document(results: DataFrame, defaults: dict) -> Column:
    failed = F.coalesce(~F.col("success"), F.lit(False))

    def field(name: str, default) -> Column:
        kind = results.schema[name].dataType if name in results.columns else None
        if default == {}:
            none = F.parse_json(F.lit("{}"))
            return F.coalesce(_variant(F.col(name), kind), none) if kind else none
        none = F.lit(default).cast("string") if default is None else F.lit(default)
        return F.coalesce(F.col(name), none) if kind else none

    data = F.when(~failed, F.struct(*(field(name, x).alias(name) for name, x in defaults.items())))
    message = F.when(failed, "오디오 처리 실패").otherwise("오디오 처리 완료 (v2)")
    good = [(~failed).alias("success"), message.alias("message"), data.alias("data")]
    error = F.coalesce("error", F.lit("알 수 없는 오류")) if "error" in results.columns else F.lit("알 수 없는 오류")
    return F.when(failed, F.to_json(F.struct(*good, error.alias("error")), NULLS)).otherwise(F.to_json(F.struct(*good), NULLS))


def envelope(results: DataFrame, defaults: dict = RESULT_DEFAULTS) -> DataFrame:
    """(call_id, document): the result document of each call; a null ``success`` counts as success.

    ``defaults`` has the fields of a document and what stands for those that ``results`` lacks, or
    where they are null; where that is an object, text in a field is put in as the JSON it is. A
    failed call has no data but its error.
    """
    return results.select("call_id", _document(results, defaults).alias("document"))


def write_results(results: DataFrame, path: str, day: Column, defaults: dict = RESULT_DEFAULTS) -> None:
    """Writes the envelopes of ``results`` as lines of JSON, in a folder for each ``day``.

    Days that are written are replaced whole and others stay, so a run of the same days leaves one
    line a call however often it is repeated.
    """
    rows = results.select(_document(results, defaults).alias("value"), day.cast("date").alias("day"))
    rows.write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def write_run(rows: DataFrame, path: str, day: Column, defaults: dict = RESULT_DEFAULTS) -> None:
    """Writes the documents of all ``rows`` below results, and those with an error as they are below rejected.

    ``rows`` may have error; without one a call has succeeded. Both folders have one for each day, and a
    day that is written again loses what was rejected before. A failed call has a document too.
    """
    rows = rows.withColumn("day", day.cast("date"))
    if "error" not in rows.columns:
        rows = rows.withColumn("error", F.lit(None).cast("string"))
    if "success" not in rows.columns:
        rows = rows.withColumn("success", F.col("error").isNull())
    write_results(rows, f"{path}/results", F.col("day"), defaults)
    # Few: one row a day.
    for (day_,) in rows.select("day").distinct().collect():
        _delete(rows, f"{path}/rejected/day={'__HIVE_DEFAULT_PARTITION__' if day_ is None else day_}")
    rows.where("error IS NOT NULL").write.partitionBy("day").mode("append").json(f"{path}/rejected")


def _delete(rows: DataFrame, path: str) -> None:
    context = rows.sparkSession.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def api_record(calls: DataFrame, *parts: DataFrame) -> DataFrame:
    """One wide record for each of ``calls(call_id, error)``: the columns of all ``parts``, joined by call_id.

    A call with an error keeps only that; success says which. All joins are on call_id.
    """
    out = calls
    for part in parts:
        out = out.join(part, "call_id", "left")
    bad = F.col("error").isNotNull()
    names = [c for c in out.columns if c not in ("call_id", "error")]
    return out.select("call_id", (~bad).alias("success"), *(F.when(~bad, F.col(c)).alias(c) for c in names), "error")


def role_map(roles: DataFrame) -> DataFrame:
    """(call_id, speaker_roles): speaker to role, in order of rank."""
    found = roles.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("rank", "speaker", "role"))).alias("x"))
    return found.select("call_id", F.map_from_entries(F.transform("x", lambda x: F.struct(x["speaker"], x["role"]))).alias("speaker_roles"))


def speaker_map(rows: DataFrame, name: str) -> DataFrame:
    """(call_id, ``name``): speaker to a struct of all other columns."""
    entry = F.struct("speaker", F.struct(*(c for c in rows.columns if c not in ("call_id", "speaker"))).alias("x"))
    return rows.groupBy("call_id").agg(F.map_from_entries(F.collect_list(entry)).alias(name))
