"""Lexicons and baselines as tables, reports that keep every field, repeated writes, observed counters, bounded previews, folds against a loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from callspark import schemas
from callspark.functions import text
from callspark.jobs import queries, workloads
from callspark.operators import prosody, report, segments, speakers

SEGMENTS = "call_id long, seg_idx long, start_ms long, end_ms long, text string, speaker string"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def talk(seed, n, words):
    rng = random.Random(seed)
    return [(i % 7, i, i * 1000, i * 1000 + 900, None if i % 50 == 0 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), None if i % 3 else f"S{i % 2}") for i in range(n)]


def test_lexicon_of_many_keywords(spark):
    """50,000 keywords from a table: once per keyword and segment, by an equi-join."""
    rng = random.Random(1)
    letters = "abcdeé한국"
    keywords = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(60_000)} | {"a b", "x" * 900})[:50_000]
    rows = talk(2, 120, [*rng.sample(keywords, 30), "aaaa", "한국한국", "zz"]) + [(1, 999, 0, 1, "a" * 3000 + " " + "x" * 900, "S1")]
    table = spark.createDataFrame([(i % 5, i, f"t{i % 5}", k) for i, k in enumerate(keywords)] + [(9, 0, "none", ""), (9, 1, "none", None)], "type_ord int, kw_ord int, type string, keyword string")
    hits = speakers.lexicon_hits(spark.createDataFrame(rows, SEGMENTS), table)
    assert "NestedLoop" not in plan_of(hits) and "Cartesian" not in plan_of(hits)
    got = sorted((r.seg_idx, r.kw_ord, r.keyword, r.speaker) for r in hits.collect())
    assert got == sorted((r[1], i, k, r[5] or "UNKNOWN") for r in rows if r[4] for i, k in enumerate(keywords) if k in r[4])


def test_lexicon_lists_and_tables_agree(spark):
    lexicon = {"b": ["s", "one two", "two"], "a": ["two", "three"]}
    rows = spark.createDataFrame(talk(3, 200, ["one", "two", "three", "s"]), SEGMENTS)
    got = speakers.lexicon_hits(rows, speakers.lexicon_table(spark, lexicon))
    assert sorted(got.collect()) == sorted(speakers.keyword_hits(rows, lexicon).select(got.columns).collect())


def test_lexicon_joins_send_no_segments(spark):
    """Only a small lexicon goes through the driver, whatever Spark takes the segments' size to be."""
    table = speakers.lexicon_table(spark, {"b": ["s", "one two", "two"], "a": ["two", "three"]})
    rows = spark.createDataFrame(talk(3, 200, ["one", "two", "three", "s"]), SEGMENTS)
    small, large = speakers.lexicon_hits(rows, table), speakers.lexicon_hits(rows, table, sent=0)
    assert plan_of(small).count("BroadcastExchange") == 1 and "SortMergeJoin" not in plan_of(small)
    assert "Broadcast" not in plan_of(large)
    assert sorted(small.collect()) == sorted(large.collect())


@pytest.mark.parametrize("sent", [0, speakers.SENT])
def test_lexicon_segments_of_one_id(spark, sent):
    """Segments that share an id, or have none, are hit by what is in their own text, once."""
    rows = [(1, 1, 0, 1, "one two", "A"), (1, 1, 0, 1, "one three", "B"), (None, 1, 0, 1, "two", "C"), (2, None, 0, 1, "two two", "D")]
    hits = speakers.lexicon_hits(spark.createDataFrame(rows, SEGMENTS), speakers.lexicon_table(spark, {"a": ["one", "two", "three"]}), sent=sent)
    assert sorted((r.speaker, r.keyword) for r in hits.collect()) == [("A", "one"), ("A", "two"), ("B", "one"), ("B", "three"), ("C", "two"), ("D", "two")]


def test_clipping_at_the_fastest_rate(spark, tmp_path):
    """Texts of just the fastest rate: doubles decide, as in SQL, whatever type the seconds have."""
    duckdb = pytest.importorskip("duckdb")
    rows = spark.createDataFrame([("x" * 21, 1.4), ("x" * 24, 1.6)], "t string, s double")
    for kind in ("double", "decimal(18,3)"):
        assert [r[0] for r in rows.select(text.clip_to_duration(F.col("t"), F.col("s").cast(kind))).collect()] == ["x" * 14, "x" * 24]
    # Texts of each duration that the conversations can have.
    talks = [(6000 * i + c, 0, "user", "x" * n) for i, n in enumerate((21, 24, 42, 69, 84)) for c in range(6000)]
    spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = queries.QUERIES["clip_to_duration"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.SQL["clip_to_duration"]).fetchall())


def measured(spark, seed=4, n=300):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, 0.0, *(round(rng.uniform(60, 300), 1) for _ in range(4))])
    rows = [(i % 3, i, f"S{i % 4}", *((value(),) * 3 if rng.random() < 0.5 else (150.0, 20.0, 300.0)), float(i % 9)) for i in range(n)]
    return spark.createDataFrame(rows, "call_id long, seg_idx long, speaker string, pitch double, std double, energy double, rate double")


def test_baselines_of_merged_runs(spark):
    rows = measured(spark)
    names = [f"base_{c}" for c in prosody.MEASURES]
    whole = {tuple(r[:2]): tuple(r[2:]) for r in rows.groupBy("call_id", "speaker").agg(*(F.median(c) for c in prosody.MEASURES)).collect()}
    halves = [prosody.value_counts(rows.where(F.col("seg_idx") % 2 == k)) for k in (0, 1)]
    table = prosody.baselines(prosody.merged_counts(*halves))
    assert {(r.call_id, r.speaker): tuple(r[c] for c in names) for r in table.collect()} == whole
    # Joined back they are what the window finds.
    order = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert order(prosody.enriched(rows, table=table)) == order(prosody.enriched(rows))
    part = prosody.enriched(rows, table=table.where("speaker <> 'S1'"))
    lost = part.where("speaker = 'S1' AND pitch IS NOT NULL")
    assert lost.count() > 0 and lost.where("relative_pitch IS NULL AND base_pitch IS NULL AND sudden_change IS NULL AND energy_level IS NOT NULL AND energy IS NOT NULL").count() == lost.count()
    assert part.count() == rows.count()


def test_reports_keep_every_field(spark):
    tone = "시니어의 대화 분위기, 톤"
    answers = {
        "typed": '{"대화시간_초": "7분", "새 필드": {"b": [1, null, {"c": "é"}]}, "위험요소": null}', "list": json.dumps({tone: ["calm", 1]}, ensure_ascii=False), "bare": "no json",
        "twice": '{"a": 1, "a": 2}', "tail": '{"a": 1} and {"b": 2}', "none": None,
    }
    rows = spark.createDataFrame(list(answers.items()), "call_id string, response string")
    known = spark.createDataFrame([("typed", "sad", None), ("list", None, "voice"), ("bare", "sad", "voice")], "call_id string, tone string, voice string")
    tones = known.select("call_id", F.create_map(F.lit("시니어"), F.struct("tone", "voice")).alias("tones"))
    out = report.reports(rows).join(tones, "call_id", "left").withColumn("danger_info", F.when(F.col("call_id") != "none", '{"감지여부": true}'))
    got = {r.call_id: json.loads(r.j) for r in report.filled(out).select("call_id", F.to_json("report").alias("j")).collect()}
    danger = {"위험요소": {"감지여부": True}}
    assert got == {
        "typed": {"대화시간_초": "7분", "새 필드": {"b": [1, None, {"c": "é"}]}, "위험요소": None, tone: "sad"}, "list": {tone: '["calm",1] (voice)', **danger},
        "bare": {"raw_response": "no json", tone: "sad (voice)", **danger}, "twice": {"raw_response": '{"a": 1, "a": 2}', **danger}, "tail": {"raw_response": '{"a": 1} and {"b": 2}', **danger}, "none": {},
    }


def test_defaults_and_repeated_writes(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "2024-01-01", "말", '{"x": 1}', None), ("b", "2024-01-01", None, None, "broken"), ("c", "2024-01-02", "", None, None)], "call_id string, d string, transcript string, summary string, error string")
    rows = rows.withColumn("speaker_roles", F.create_map(F.lit("S0"), F.lit("매니저")))
    for _ in range(2):
        report.write_run(rows, path, F.col("d"))
    lines = [json.loads(r.value) for r in spark.read.text(f"{path}/results").collect()]
    assert len(lines) == 3 and sorted(x["success"] for x in lines) == [False, True, True]
    data = next(x["data"] for x in lines if x["data"] and x["data"]["transcript"])
    assert data == {**schemas.RESULT_DEFAULTS, "transcript": "말", "summary": {"x": 1}, "speaker_roles": {"S0": "매니저"}} and list(data) == schemas.RESULT_FIELDS
    bad = spark.read.json(f"{path}/rejected").collect()
    assert [(r.call_id, r.error) for r in bad] == [("b", "broken")]
    # A day that is written again without its failure; the other day stays.
    report.write_run(rows.where("d = '2024-01-01'").withColumn("error", F.lit(None).cast("string")), path, F.col("d"))
    assert spark.read.text(f"{path}/results").count() == 3
    assert spark.read.schema("call_id string, day date").json(f"{path}/rejected").count() == 0


def test_counters_of_the_same_pass(spark):
    rows = talk(5, 90, ["하나", "둘셋", "넷다섯"])
    chunks = spark.createDataFrame([(str(r[0]), r[1], r[2] / 1000, r[3] / 1000, r[4]) for r in rows], schemas.CHUNKS)
    turns = spark.createDataFrame([(str(r[0]), r[2], r[3], f"S{r[1] // 4 % 2}") for r in rows], schemas.TURNS)
    out, seen = workloads.watched_transcript_job(chunks, turns)
    assert out.count() > 0
    cleaned = segments.clean_chunks(chunks)
    ms = [F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms") for c in ("start", "end")]
    merged = segments.merge_adjacent(segments.assign_speakers(cleaned.where("reason IS NULL").select("call_id", F.col("chunk_idx").alias("seg_idx"), *ms, "text"), turns))
    want = segments.counters(cleaned, merged, segments.drop_repeats(merged))
    assert seen.get() == want.agg(*(F.sum(c).alias(c) for c in want.columns if c != "call_id")).first().asDict()


def test_previews_are_cut_before_they_are_sent(spark):
    out = segments.run_report(spark.createDataFrame(talk(6, 100, ["a"]), SEGMENTS), 3, spark.createDataFrame([(1, "x")], "call_id long, more string"))
    assert "WindowGroupLimit" in plan_of(out)
    assert {r.call_id: (r.num_segments, [x.seg_idx for x in r.segments_sample], r.more) for r in out.collect()} == {c: (len(range(c, 100, 7)), [c, c + 7, c + 14], "x" if c == 1 else None) for c in range(7)}


def folded(rows):
    """The merge rule as a loop over one call."""
    out = []
    for _, _, s, e, text, who in sorted(rows, key=lambda r: r[1]):
        last = out[-1] if out else None
        if last and last[3] == who and (s - last[1] < 1500 or last[1] - last[0] < 2000 or e - s < 2000):
            last[1] = e
            before, text = (last[2] or "").strip(), (text or "").strip()
            if text and text != before:
                last[2] = f"{before} {text}" if before else text
        else:
            out.append([s, e, text, who])
    return [(i, *x) for i, x in enumerate(out)]


@pytest.mark.parametrize("lot", [2, 64])
def test_merge_against_a_loop(spark, monkeypatch, lot):
    monkeypatch.setattr(segments, "LOT", lot)
    rng = random.Random(lot)
    rows, at = [], 0
    for i in range(700):
        long = rng.choice([500, 1900, 2000, 2600, 4000])
        rows.append((rng.choice([1, 1, 1, 2, None]), i, at, at + long, rng.choice([None, "", " ", "yes", " yes ", "no no", "x"]), rng.choice(["A", "A", "A", "B", None])))
        at += long + rng.choice([-300, 0, 1400, 1500, 9000])
    out = segments.merge_adjacent(spark.createDataFrame(rows, SEGMENTS))
    assert "InArrow" not in plan_of(out)
    for call in (1, 2, None):
        got = sorted((r.seg_idx, r.start_ms, r.end_ms, r.text, r.speaker) for r in out.collect() if r.call_id == call)
        assert got == folded([r for r in rows if r[0] == call])


def test_worklists_part_all_calls(spark):
    calls = spark.createDataFrame([(1,), (2,), (3,), (None,)], "call_id long")
    found = spark.createDataFrame([(1, True), (2, False), (None, True)], "call_id long, detected boolean")
    urgent, others = (sorted((r.call_id for r in x.collect()), key=str) for x in speakers.worklists(calls, found))
    assert (urgent, others) == ([1], [2, 3, None])
