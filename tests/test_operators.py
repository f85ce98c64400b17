"""Hand-derived cases of FIXTURES.md and plan checks."""

import contextlib
import io
import json
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from callspark.functions import text as T
from callspark import schemas
from callspark.jobs import workloads
from callspark.operators import emotion, prosody, report, segments, speakers
from callspark.sources import readers
from callspark.streaming.calls import stream_alerts


def one(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_hallucinations(spark):
    texts = ["공지부공지부공지부공지부공지부", "오늘은 날씨가 참 좋아서 산책을 다녀왔습니다", "abcdefxabcdefy", "abcdefgabcdef1234567890ab", "", None, "ab", "네 아 네 아 네 아"]
    assert one(spark, texts, "string", T.is_hallucination) == [True, False, True, False, True, True, True, True]


def test_phrases_and_clipping(spark):
    assert one(spark, ["한글자막 제공 및 협조"], "string", T.strip_phrases) == ["및 협조"]
    cases = [("aaaa bbbb cccc dddd eeee ffff", 1.0, "aaaa bbbb"), ("abcdefghijklmnopqrstuvwxyz", 1.0, "abcdefghij"), ("ab cdefghijklmnopqrst", 1.0, "ab cdefghi"), ("short text", 1.0, "short text"), ("abcdefghijklmnop", 0.0, "abcdefghijklmnop")]
    rows = spark.createDataFrame(cases, "t string, s double, want string")
    assert [r.t for r in rows.where(T.clip_to_duration(F.col("t"), F.col("s")) != F.col("want")).collect()] == []


CALL = [(0, 1000, "네", "A"), (3000, 5500, "혈압 재볼까요?", "A"), (8000, 11000, "좋아요", "A"), (11200, 14000, "아파요", "B"), (16000, 19000, "그래요", "B"), (21000, 22000, "그래요", "B"), (22500, 26000, "x y z", None), (30000, 33000, "x y z", None), (33100, 36000, "", None)]


def test_merge(spark):
    rows = [(1, i, *r) for i, r in enumerate(CALL)]
    random.Random(3).shuffle(rows)
    out = segments.merge_adjacent(spark.createDataFrame(rows, "call_id long, seg_idx long, start_ms long, end_ms long, text string, speaker string")).orderBy("seg_idx").collect()
    assert [(r.start_ms, r.end_ms, r.text, r.speaker) for r in out] == [(0, 5500, "네 혈압 재볼까요?", "A"), (8000, 11000, "좋아요", "A"), (11200, 14000, "아파요", "B"), (16000, 22000, "그래요", "B"), (22500, 26000, "x y z", None), (30000, 36000, "x y z", None)]


@pytest.mark.parametrize(("texts", "kept"), [(list("aaaaba"), [0, 1, 4, 5]), (["", "", "x"], [0, 2]), (["a b c d e f", "a b c d e f g", "a b c d e f g h", "q"], [0, 1, 3]), (["a b c d", "a b c d e", "a b c d e"], [0, 1, 2])])
def test_repeats(spark, texts, kept):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "call_id long, seg_idx long, text string")
    assert sorted(r.seg_idx for r in segments.drop_repeats(rows).collect()) == kept


def test_roles_and_danger(spark):
    rows = spark.createDataFrame([(1, 0, "혈압 재볼까요?", "A", 0, 1), (1, 1, "아파요", "B", 1, 2), (1, 2, "네", "C", 2, 3)], "call_id long, seg_idx long, text string, speaker string, start_ms long, end_ms long")
    assert {(r.speaker, r.score, r.role) for r in speakers.role_ranks(rows).collect()} == {("A", 2.5, "매니저"), ("B", 0.0, "시니어"), ("C", 0.0, "동거인_2")}
    rows = spark.createDataFrame([(1, 0, "어제 넘어졌어요 허리가 아파요", None, 0, 1)], rows.schema)
    found = speakers.danger(speakers.keyword_hits(rows)).first()
    assert found.flags == ["낙상 키워드 감지", "통증 키워드 감지"] and [d.keyword for d in found.details] == ["넘어졌", "아파"]


def test_responses(spark):
    texts = ['```json\n{"a":{"b":1}}\n```', 'pre {"a":1} post', '{"a":1} x {"b":2}', '```json\n{bad}\n``` {"a":1}', "no json", None]
    assert one(spark, texts, "string", T.parse_response) == ['{"a":{"b":1}}', '{"a":1}', None, None, None, None]


def test_clocks_and_visits(spark):
    assert one(spark, [75.5, 59.9996], "double", T.clock) == ["01:15.500", "00:60.000"]
    start, end = report.visit_window(F.lit("2024-01-01 00:00:00"), F.lit(61.5), F.lit("2020-01-01").cast("timestamp"))
    assert tuple(spark.range(1).select(start, end).first()) == ("2024-01-01 00:00:00", "2024-01-01 00:01:01")


def test_emotions(spark):
    p = [0.46, 0.0, 0.0, 0.0, 0.16, 0.38]
    rows = spark.createDataFrame([(1, "A", p)], "call_id long, speaker string, probabilities array<double>")
    out = emotion.emotion_by_speaker(rows).first()
    assert out.dominant_emotion == "기쁨" and out.tone_description == "밝음, 긍정적 + 차분함, 담담함 혼합"
    assert one(spark, [[0.39, 0.3, 0.1, 0.1, 0.1, 0.01]], "array<double>", emotion.best_label) == ["중립"]


def test_range_joins_are_equi_joins(spark):
    rows = spark.createDataFrame([(1, 0, 0, 10, "A")], "call_id long, seg_idx long, start_ms long, end_ms long, speaker string")
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        segments.assign_speakers(rows, rows.drop("seg_idx")).explain()
    assert "NestedLoop" not in shown.getvalue() and "Cartesian" not in shown.getvalue()


def test_short_clock_rounds_binary_values(spark):
    x = [75.5, 0.0, 0.05, 0.15, 0.25, 0.35, 0.75, 0.95, 26.25, 59.96, 61.45]
    assert one(spark, x, "double", lambda c: T.clock(c, 1)) == [f"{int(v // 60):02d}:{v % 60:04.1f}" for v in x]


def test_explode_and_report(spark):
    rows = spark.createDataFrame([(1, [(None, 1.5, " a "), (1.5, None, "b")]), (2, [])], "call_id long, chunks array<struct<start double, end double, text string>>")
    assert [tuple(r) for r in segments.explode_chunks(rows).orderBy("chunk_idx").collect()] == [(1, 0, 0.0, 1.5, "a"), (1, 1, 1.5, 0.0, "b")]
    rows = spark.createDataFrame([(1, i, i, i + 1, "A", str(i)) for i in (2, 0, 1)], "call_id long, seg_idx long, start_ms long, end_ms long, speaker string, text string")
    out = segments.run_report(rows, 2).first()
    assert out.num_segments == 3 and [x.text for x in out.segments_sample] == ["0", "1"]


def test_inline_tag(spark):
    row = (1, 0, 122.0, 55.0, "much_lower", "normal", -30.5, -0.4, "normal", "fast", True, "피치↓")
    rows = spark.createDataFrame([row, (1, 1, *[None] * 10)], "call_id long, seg_idx long, pitch double, std double, relative_pitch string, pitch_var_level string, pitch_pct double, energy_pct double, energy_level string, speech_rate string, sudden_change boolean, change_hint string")
    tags = [r.t for r in rows.select("seg_idx", prosody.inline_tag().alias("t")).orderBy("seg_idx").collect()]
    assert tags == ["피치=122Hz(훨씬낮음,-30%), 변동=보통(std=55), 에너지=normal(-0%), 말속도=fast, 급변=피치↓", None]


def test_sample_without_voice(spark):
    rows = spark.createDataFrame([(1, "A", 0, 4), (1, "A", 100, 6), (1, "B", 0, None)], "call_id long, speaker string, pitch long, energy long")
    assert {tuple(r) for r in prosody.sample_averages(rows).collect()} == {(1, "A", 100.0, 5.0), (1, "B", 0.0, 0.0)}


@pytest.mark.parametrize(("kind", "one", "two"), [("string", "a", "b"), ("long", 1, 2)])
def test_stream_alerts(spark, tmp_path, kind, one, two):
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = schemas.CHUNKS.replace("call_id string", f"call_id {kind}")
    spark.createDataFrame([(one, 0, 0.0, 3.0, "어제 넘어졌어요 많이"), (one, 1, 3.0, 5.0, "날씨가 좋아요"), (one, 2, 5.0, None, "또 넘어졌어요")], schema).write.parquet(source)
    stream_alerts(spark, source, target, state, {"낙상": ["넘어졌"]}, schema).awaitTermination()
    assert [(r.seg_idx, r.keyword) for r in spark.read.parquet(target).collect()] == [(0, "넘어졌")]
    spark.createDataFrame([(two, 0, 0.0, 3.0, "그만 넘어졌어요")], schema).write.mode("append").parquet(source)
    stream_alerts(spark, source, target, state, {"낙상": ["넘어졌"]}, schema).awaitTermination()
    assert sorted(r.call_id for r in spark.read.parquet(target).collect()) == [one, two]


def test_merge_takes_any_call_id_and_null_texts(spark):
    rows = [("a1b2c3d4", 0, 0, 500, None, "A"), ("a1b2c3d4", 1, 600, 900, " hello ", "A"), ("a1b2c3d4", 2, 1000, 1500, None, "A"), ("ffff", 0, 0, 100, None, None)]
    out = segments.merge_adjacent(spark.createDataFrame(rows, "call_id string, seg_idx int, start_ms int, end_ms int, text string, speaker string")).orderBy("call_id").collect()
    assert [(r.call_id, r.end_ms, r.text) for r in out] == [("a1b2c3d4", 1500, "hello"), ("ffff", 100, None)]


def test_transcripts_keep_lines_without_speaker_or_text(spark):
    rows = spark.createDataFrame([("c", 0, 0, 1000, " hi\n", None), ("c", 1, 1000, 2000, None, "A")], "call_id string, seg_idx long, start_ms long, end_ms long, text string, speaker string")
    assert speakers.transcripts(rows, "speaker").first().transcript == "[00:00.000 --> 00:01.000] [UNKNOWN] hi\n[00:01.000 --> 00:02.000] [A] "
    roles = {r.speaker: (r.score, r.role) for r in speakers.role_ranks(rows.withColumn("text", F.when(F.col("text").isNotNull(), F.lit("괜찮죠?\n")))).collect()}
    assert roles == {"UNKNOWN": (0.5, "매니저"), "A": (0.0, "시니어")}
    assert segments.drop_repeats(rows).count() == 2


def test_text_edges(spark):
    assert one(spark, ["\u001c a b\n\t", " ", None], "string", T.strip) == ["a b", "", None]
    words = "a b " * 8 + "c d e"
    assert one(spark, ["x " * 10, words, "a b c d e f g h i j k l", None], "string", T.bigram_share) == [0.0, 8 / 18, 1 / 11, 0.0]
    assert one(spark, ["[" * 20000, "{" * 5000 + "}" * 5000, '{"a":' * 20000 + "1" + "}" * 20000], "string", T.parse_response) == [None, None, None]


def test_coverage_of_any_symbols():
    """Against counting, for few and for so many symbols that n-grams don't fit one number."""
    rng = random.Random(5)
    letters = ["a", "ab", "abcdefghij", "한국어 말 ", [chr(0x4E00 + i) for i in range(9000)], ["a", "\U0001f600", "\U0010ffff", "\ud800"]]
    texts = [None, "", " ", "a", *("".join(rng.choice(x) for _ in range(rng.choice([1, 5, 12, 13, 14, 60, 700]))) for x in letters for _ in range(60))]
    rng.shuffle(texts)

    def counted(t):
        t = (t or "").replace(" ", "")
        return max(Counter(t[i : i + n] for i in range(len(t) - n + 1)).most_common(1)[0][1] * n / len(t) for n in range(2, 7)) if len(t) > 12 else 0.0

    assert T.ngram_coverage.func(pd.Series(texts)).tolist() == [counted(t) for t in texts]


def test_coverage_is_cheap():
    """Less than ranking twice; n-grams and their counts were ranked once each for every length."""
    rng = random.Random(6)
    texts = pd.Series(["".join(rng.choice("etaoinshrdlu cm") for _ in range(rng.randint(20, 600))) for _ in range(2000)])
    numbers = np.random.default_rng(6).integers(0, 1 << 40, int(texts.str.len().sum()))

    def seconds(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(lambda: T.ngram_coverage.func(texts)) < 2 * seconds(lambda: np.unique(numbers, return_inverse=True))


def test_coverage_by_hand(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab c한𝄞") for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "a" * 5000]

    def want(t):
        s = (t or "").replace(" ", "")
        if len(s) <= 12:
            return 0.0
        grams = lambda n: [s[i : i + n] for i in range(len(s) - n + 1)]
        return max(max(map(grams(n).count, set(grams(n)))) * n / len(s) for n in range(2, 7))

    got = one(spark, texts, "string", T.ngram_coverage)
    assert all(abs(a - b) < 1e-12 for a, b in zip(got, map(want, texts), strict=True))


FRAMES = "call_id string, t_ms long, f0 double, rms double, onset boolean"
SPANS = "call_id string, seg_idx long, start_ms long, end_ms long, speaker string"


def test_segment_prosody_validity(spark):
    """Short segments aren't measured, those with under half a second of frames are unknown, unvoiced ones are low."""
    frames = [("c", t * 10, 200.0 + t % 2, 0.02 * 10_000, t % 10 == 0) for t in range(200)] + [("c", 5000 + t * 10, 600.0, 10.0, None) for t in range(160)] + [("c", 9000, 100.0, None, True)]
    rows = spark.createDataFrame([("c", 0, 0, 2000, "A"), ("c", 1, 0, 1499, "A"), ("c", 2, 5000, 6600, "A"), ("c", 3, 8000, 10000, "A")], SPANS)
    got = {r.seg_idx: tuple(r)[2:] for r in prosody.segment_prosody(spark.createDataFrame(frames, FRAMES), rows).collect()}
    assert got[0] == (200.5, 0.5, "normal", 200.0, "normal", "fast")
    assert got[1] == (None,) * 6
    assert got[2] == (0.0, 0.0, "low", 10.0, "low", "slow")
    assert got[3] == (0.0, 0.0, "unknown", 0.0, "unknown", "unknown")
    beside = {r.seg_idx: r for r in prosody.enriched(prosody.measured(rows, prosody.segment_prosody(spark.createDataFrame(frames, FRAMES), rows))).collect()}
    assert beside[1].relative_pitch is beside[3].relative_pitch is beside[3].sudden_change is beside[3].energy_level is None
    assert beside[0].base_pitch == 100.25 and beside[0].relative_pitch == "much_higher"


def test_rolling_reference_skips_unmeasured(spark):
    rows = [("c", 0, "A", 100, 5, 100, 5)] + [("c", i, "A", None, None, None, None) for i in (1, 2, 3)] + [("c", 4, "A", 200, 5, 100, 5)]
    out = prosody.enriched(spark.createDataFrame(rows, "call_id string, seg_idx long, speaker string, pitch long, std long, energy long, rate long"))
    got = {r.seg_idx: r for r in out.collect()}
    assert got[4].ref_pitch == 100 and got[4].change_hint == "피치↑" and got[1].change_hint is None
    summary = prosody.speaker_summary(out).first()
    assert (summary.base_pitch, summary.avg_pitch, summary.sudden_change_count, summary.relative_pitch) == (150.0, 150.0, 2, "much_lower")


def test_unknown_emotions(spark):
    rows = spark.createDataFrame([("c", "A", None), ("c", "B", [0.0, 0.1, 0.1, 0.0, 0.0, 0.1, 0.7]), ("c", "B", [0.1, 0.1, 0.6, 0.1, 0.1, 0.0, 0.0])], "call_id string, speaker string, probabilities array<double>")
    got = {r.speaker: tuple(r)[2:] for r in emotion.emotion_by_speaker(rows).collect()}
    assert got["A"] == ("unknown", {}, "분석 불가") and got["B"][0] == "분노" and abs(sum(got["B"][1].values()) - 1) < 0.01
    assert one(spark, [[0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.3]], "array<double>", lambda p: emotion.scores(p)["label_6"]) == [0.3]
    assert one(spark, [[0.0, 0.0, 0.0]], "array<double>", lambda x: F.array_max(F.transform(emotion.softmax(x), lambda p: F.round(p, 6)))) == [0.333333]


def test_danger_of_every_call(spark):
    rows = spark.createDataFrame([("a", 0, "넘어졌어요", "A", 0), ("b", 0, "좋아요", None, 0)], "call_id string, seg_idx long, text string, speaker string, start_ms long")
    moods = spark.createDataFrame([("a", "A", "angry", {"angry": 0.41}), ("b", "B", "sad", {"sad": 0.5})], "call_id string, speaker string, dominant_emotion string, emotion_distribution map<string,double>")
    found = speakers.danger(speakers.keyword_hits(rows), emotion.emotion_flags(moods), calls=rows)
    assert {r.call_id: (r.detected, r.flags, len(r.details)) for r in found.collect()} == {"a": (True, ["A 강한 분노 감정 감지", "낙상 키워드 감지"], 1), "b": (False, [], 0)}
    told = {r.call_id: r.danger_info for r in speakers.danger_json(found).collect()}
    assert told["b"] is None and '"time":0.0' in told["a"]


CALL_COLUMNS = ["admin_name", "admin_phone", "patient_name", "age", "gender", "address", "start_time", "end_time", "duration_sec", "meta", "transcript", "danger_info"]


def test_prompts_keep_braces_of_values(spark):
    row = ("c", "", None, "{address}", "80", "F", "x {transcript}", "s", "e", "9", "", "t" * 900, None)
    calls = spark.createDataFrame([row, ("d", *row[1:12], '{"detected":true}')], "call_id string, " + ", ".join(f"{c} string" for c in CALL_COLUMNS))
    template = "{admin_name}|{patient_name}|{address}|{{}}|{analysis_meta}|{transcript}"
    got = {r.call_id: r.prompt for r in report.prompts(calls, template).collect()}
    assert got["c"] == "미확인|{address}|x {transcript}|{}|분석 데이터 없음|" + "t" * 900
    assert got["d"] == got["c"] + '\n\n## 위험요소 사전 감지 정보\n{"detected":true}'
    assert report.prompts(calls, template, 900).first().prompt.endswith("t\n... (이하 생략)")


def test_reports_and_failures(spark):
    rows = spark.createDataFrame([("a", '{"대화요약": "s"}', None), ("b", None, "timeout"), ("c", "no json", None)], "call_id string, response string, error string")
    got = {r.call_id: (r.report, r.raw_response) for r in report.reports(rows).collect()}
    assert got == {"a": ('{"대화요약": "s"}', None), "b": ('{"error":"timeout"}', None), "c": (None, "no json")}
    ok, bad = report.split_failed(rows)
    assert (ok.count(), [r.call_id for r in bad.collect()]) == (2, ["b"])
    gate = report.duration_gate(spark.createDataFrame([("a", 3600.0), ("b", 3600.5)], "call_id string, duration_sec double"), 3600)
    assert [r.error for r in gate.orderBy("call_id").collect()] == [None, "오디오가 너무 깁니다 (3600초). 최대 3600초"]


def test_records_and_envelopes(spark, tmp_path):
    calls = spark.createDataFrame([("a", None), ("b", "broken")], "call_id string, error string")
    roles = spark.createDataFrame([("a", "S1", 0.0, 2, "시니어"), ("a", "S0", 1.0, 1, "매니저"), ("b", "S0", 1.0, 1, "매니저")], "call_id string, speaker string, score double, rank int, role string")
    record = {r.call_id: r for r in report.api_record(calls, report.role_map(roles), report.speaker_map(roles, "roles")).collect()}
    assert record["a"].success and record["a"].speaker_roles == {"S0": "매니저", "S1": "시니어"} and record["a"].roles["S1"].rank == 2
    assert not record["b"].success and record["b"].speaker_roles is None and record["b"].error == "broken"
    results = calls.withColumns({"success": F.col("error").isNull(), "transcript": F.lit("말")})
    report.write_results(results, str(tmp_path / "out"), F.lit("2024-01-02"))
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines[0] == '{"success":false,"message":"오디오 처리 실패","data":null,"error":"broken"}' and '"transcript":"말"' in lines[1] and lines[1].count(":null") == 2 and lines[1].count(":{}") == 6


def test_readers(spark, tmp_path):
    spark.createDataFrame([("x", 5.0), (None, 6.0), ("", 6.0)], "call_id string, duration_sec double").write.parquet(str(tmp_path / "calls"))
    rows = readers.read_calls(spark, str(tmp_path / "calls")).collect()
    assert rows[0].asDict().keys() == {c.split()[0] for c in schemas.CALLS.split(", ")} and len({r.call_id for r in rows} - {"x"}) == 1 and all(len(r.call_id) in (1, 8) for r in rows)
    (tmp_path / "audio").mkdir()
    (tmp_path / "audio" / "a.wav").write_bytes(b"abc")
    assert [(r.path.rsplit("/", 1)[1], r.bytes) for r in readers.list_recordings(spark, str(tmp_path / "audio"), "*.wav").collect()] == [("a.wav", 3)]


def test_jobs_end_to_end(spark):
    chunks = spark.createDataFrame([("c", 0, 0.0, 3.0, "혈압 재볼까요?"), ("c", 1, 3.0, 6.0, "네 어제 넘어졌어요"), ("c", 2, 6.0, 6.0, "시간이 없는 말"), ("c", 3, 6.5, None, "끝나지 않은 말")], schemas.CHUNKS)
    turns = spark.createDataFrame([("c", 0, 3000, "A"), ("c", 2900, 7000, "B")], schemas.TURNS)
    texts = workloads.transcript_job(chunks, turns).first()
    assert texts.transcript_enriched == "[00:00.000 --> 00:03.000] [매니저] 혈압 재볼까요?\n[00:03.000 --> 00:06.000] [시니어] 네 어제 넘어졌어요"
    rows = workloads.attributed(chunks, turns)
    frames = spark.createDataFrame([("c", t * 10, 150.0 + 100 * (t >= 300), 300.0, t % 20 == 0) for t in range(600)], schemas.FRAMES)
    beside, voices = workloads.voice_job(frames, rows)
    moods = emotion.emotion_by_speaker(spark.createDataFrame([("c", "B", [0.0, 0.0, 0.0, 0.9, 0.1, 0.0])], "call_id string, speaker string, probabilities array<double>"))
    found = workloads.danger_job(rows, moods, voices, {"낙상": ["넘어졌"]}, (("불안", 0.5, "불안"),))
    assert found.first().flags == ["B 불안", "낙상 키워드 감지"]
    calls = spark.createDataFrame([("c", *["x"] * 9), ("empty", *["x"] * 9)], "call_id string, " + ", ".join(f"{c} string" for c in CALL_COLUMNS[:9]))
    got = {r.call_id: r.prompt for r in workloads.prompt_job(calls, rows, beside, voices, found, "{analysis_meta}\n{transcript}").collect()}
    assert "[00:03.0~00:06.0] [시니어] 네 어제 넘어졌어요  |운율: 피치=250Hz(평소,+0%)" in got["c"] and "- 위험 플래그: B 불안, 낙상 키워드 감지" in got["c"] and '"keyword":"넘어졌"' in got["c"]
    assert got["empty"] == "분석 데이터 없음\n"
    answers = spark.createDataFrame([("c", '{"시니어의 대화 분위기, 톤": "old", "대화시간_초": 6}')], "call_id string, response string")
    known = spark.createDataFrame([("c", '{"감지여부": true, "내용": ["k"]}')], "call_id string, danger_info string")
    report_ = json.loads(workloads.report_job(answers, rows, moods, voices, known).select(F.to_json("report")).first()[0])
    assert report_["시니어의 대화 분위기, 톤"].startswith("불안, 두려움 (평소피치 250Hz") and report_["매니저의 대화 분위기, 톤"].startswith(" (평소피치 150Hz") and report_["위험요소"]["내용"] == ["k"] and report_["대화시간_초"] == 6


def test_shuffles_of_the_transcript(spark):
    """Roles, ranks and transcripts share one exchange on call_id."""
    rows = spark.createDataFrame([("c", 0, 0, 10, "x", "A")], "call_id string, seg_idx long, start_ms long, end_ms long, text string, speaker string")
    with contextlib.redirect_stdout(io.StringIO()) as shown:
        speakers.transcripts(speakers.with_roles(rows), "role").explain()
    assert shown.getvalue().count("Exchange hashpartitioning") == 1
