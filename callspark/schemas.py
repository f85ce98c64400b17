"""Schemas of the tables that jobs read and write, as DDL."""

from __future__ import annotations

CALLS = "call_id string, path string, admin_name string, admin_phone string, patient_name string, birth_date string, age string, gender string, address string, conversation_start string, duration_sec double, skip_llm boolean, danger_info string"
CHUNKS = "call_id string, chunk_idx long, start double, end double, text string"
TURNS = "call_id string, start_ms long, end_ms long, speaker string"
SEGMENTS = "call_id string, seg_idx long, start_ms long, end_ms long, text string, speaker string"
FRAMES = "call_id string, t_ms long, f0 double, rms double, onset boolean"

# Fields of results and reports, which must equal the reference's.
RESULT_DEFAULTS = {
    "transcript": "", "transcript_labeled": "", "summary": {}, "speaker_roles": {}, "emotion_data": {}, "prosody_data": {}, "danger_detection": {},
    "processing_time": 0, "audio_duration": 0, "timing": {}, "audio_gcs_path": None, "input_gcs_path": None,
}
RESULT_FIELDS = list(RESULT_DEFAULTS)
MAIN_ROLES = ["매니저", "시니어"]
TONE_FIELDS = {"매니저": "매니저의 대화 분위기, 톤", "시니어": "시니어의 대화 분위기, 톤"}
DANGER_FIELD = "위험요소"
REPORT = """`방문일시` string, `대화시간_초` long, `매니저` struct<`이름`: string, `연락처`: string>,
`시니어` struct<`이름`: string, `나이`: string, `성별`: string, `주소`: string>, `대화요약` string,
`시니어_상태` struct<`건강상태`: string, `식사`: string, `운동`: string, `약복용`: string, `기분상태`: string>,
`매니저의 대화 분위기, 톤` string, `시니어의 대화 분위기, 톤` string, `위험요소` struct<`감지여부`: boolean, `내용`: array<string>>, `특이사항` string"""
