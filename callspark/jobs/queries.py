"""Registered queries of the library's operators on the driver's tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lexicons as X
from ..functions import text as T
from ..operators import emotion, prosody, report, segments, speakers
from ..schemas import RESULT_DEFAULTS
from ..sources import calls as C
from ..sources import readers
from ..sources.work import new_folder, settle
from ..streaming.whole_calls import latest, stream_whole_calls
from . import workloads

MANAGER, SUFFIXES = ["the", "and", "der", "les"], ["er.", "en."]
DANGER = {"a": ["er.", "the"], "b": ["ion"]}
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def json_default(x) -> str:
    return "NULL" if x is None else "json('{}')" if x == {} else f"'{x}'" if isinstance(x, str) else str(x)


CLOCK = "printf('%02d:%06.3f', {0} // 60000, ({0} % 60000) / 1000.0)"
ROLES_SQL = f"""WITH {C.SEGMENTS_SQL}, named AS (SELECT *, coalesce(speaker, 'UNKNOWN') AS sp,
  {' + '.join(f"contains(text, '{k}')::INT" for k in MANAGER)} + CASE WHEN {' OR '.join(f"suffix(trim(text), '{s}')" for s in SUFFIXES)} THEN 0.5 ELSE 0 END AS p FROM seg),
sc AS (SELECT call_id, sp, CAST(sum(p) AS DOUBLE) AS score, min(seg_idx) AS f FROM named GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, f) AS rank FROM sc),
ro AS (SELECT call_id, sp AS speaker, score, CAST(rank AS INT) AS rank, CASE rank WHEN 1 THEN '매니저' WHEN 2 THEN '시니어' ELSE '동거인_' || (rank - 1) END AS role FROM rk)"""


@query(f"{ROLES_SQL} SELECT call_id, string_agg('[' || {CLOCK.format('start_ms')} || ' --> ' || {CLOCK.format('end_ms')} || '] [' || role || '] ' || text, chr(10) ORDER BY seg_idx) AS transcript FROM named n JOIN ro USING (call_id) WHERE ro.speaker = n.sp GROUP BY 1")
def transcript_labeled(spark, d):
    rows = speakers.with_roles(C.segments(spark, d), keywords=MANAGER, suffixes=SUFFIXES)
    return speakers.transcripts(rows, "role")


@query(f"WITH {C.SEGMENTS_SQL} SELECT call_id, string_agg('[' || {CLOCK.format('start_ms')} || ' --> ' || {CLOCK.format('end_ms')} || '] ' || text, chr(10) ORDER BY seg_idx) AS transcript FROM seg GROUP BY 1")
def transcript_plain(spark, d):
    return speakers.transcripts(C.segments(spark, d))


@query(f"{ROLES_SQL} SELECT * FROM ro")
def role_ranks(spark, d):
    return speakers.role_ranks(C.segments(spark, d), keywords=MANAGER, suffixes=SUFFIXES)


@query(f"WITH {C.LINES_SQL}, w AS (SELECT *, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM lines) SELECT call_id, seg_idx, coalesce(length(text), 0) < 3 AS short, len(w) > 5 AND len(list_distinct(w)) <= 2 AS low FROM w")
def low_vocab(spark, d):
    return C.lines(spark, d).select("call_id", "seg_idx", T.too_short(F.col("text")).alias("short"), T.low_vocabulary(F.col("text")).alias("low"))


@query(f"""WITH {C.LINES_SQL}, s AS (SELECT call_id, seg_idx, replace(coalesce(text, ''), ' ', '') AS t FROM lines),
ch AS (SELECT call_id, seg_idx, length(t) AS len, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM s WHERE length(t) > 12),
g AS ({' UNION ALL '.join(f"SELECT call_id, seg_idx, len, {n} AS n, {' || '.join(['c', *(f'lead(c, {k}) OVER w' for k in range(1, n))])} AS gram FROM ch WINDOW w AS (PARTITION BY call_id, seg_idx ORDER BY i)" for n in range(2, 7))}),
r AS (SELECT call_id, seg_idx, max(k * n / len) > 0.5 AS repeats FROM (SELECT call_id, seg_idx, len, n, count(*) AS k FROM g WHERE gram IS NOT NULL GROUP BY call_id, seg_idx, len, n, gram) GROUP BY 1, 2)
SELECT call_id, seg_idx, coalesce(repeats, false) AS repeats FROM s LEFT JOIN r USING (call_id, seg_idx)""")
def ngram_repetition(spark, d):
    return C.lines(spark, d).select("call_id", "seg_idx", (F.coalesce(T.ngram_coverage(F.col("text")), F.lit(0.0)) > 0.5).alias("repeats"))


@query(f"WITH {C.SEGMENTS_SQL} SELECT call_id, seg_idx, trim(regexp_replace(replace(replace(text, 'the', ''), 'en', ''), '\\s+', ' ', 'g')) AS text FROM seg")
def strip_phrases(spark, d):
    return C.segments(spark, d).select("call_id", "seg_idx", T.strip_phrases(F.col("text"), ["the", "en"]).alias("text"))


@query(f"""WITH {C.SEGMENTS_SQL}, p AS (SELECT *, (end_ms - start_ms) / 1000.0 AS sec, (end_ms - start_ms) // 100 AS m FROM seg), q AS (SELECT *, left(text, m) AS h FROM p),
r AS (SELECT *, CASE WHEN contains(h, ' ') THEN length(h) - strpos(reverse(h), ' ') ELSE -1 END AS sp FROM q)
SELECT call_id, seg_idx, CASE WHEN sec > 0 AND length(replace(text, ' ', '')) / sec > 15 AND m < length(text) THEN CASE WHEN sp > m * 0.5 THEN left(h, sp) ELSE h END ELSE text END AS text FROM r""")
def clip_to_duration(spark, d):
    rows = C.segments(spark, d).withColumn("sec", (F.col("end_ms") - F.col("start_ms")) / 1000)
    return rows.select("call_id", "seg_idx", T.clip_to_duration(F.col("text"), F.col("sec")).alias("text"))


SPLIT = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"
SHORTER = "CASE WHEN sec > 0 AND length(replace({0}, ' ', '')) / sec > 15 AND m < length({0}) THEN CASE WHEN {1} > m * 0.5 THEN left({0}, {1}) ELSE left({0}, m) END ELSE {0} END"
CLEAN_SQL = f"""{C.SEGMENTS_SQL}, {C.CHUNKS_SQL},
c0 AS (SELECT call_id, chunk_idx, coalesce(start, 0) AS start, coalesce(stop, 0) AS stop, trim(text) AS text, replace(trim(text), ' ', '') AS t, {SPLIT.format('text')} AS w FROM ch),
c1 AS (SELECT call_id, chunk_idx, length(t) AS len, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM c0 WHERE length(t) > 12),
c2 AS ({' UNION ALL '.join(f"SELECT call_id, chunk_idx, len, {n} AS n, {' || '.join(['c', *(f'lead(c, {k}) OVER w' for k in range(1, n))])} AS gram FROM c1 WINDOW w AS (PARTITION BY call_id, chunk_idx ORDER BY i)" for n in range(2, 7))}),
c3 AS (SELECT call_id, chunk_idx, max(k * n / len) > 0.5 AS again FROM (SELECT call_id, chunk_idx, len, n, count(*) AS k FROM c2 WHERE gram IS NOT NULL GROUP BY call_id, chunk_idx, len, n, gram) GROUP BY 1, 2),
c4 AS (SELECT call_id, chunk_idx, max(k) / any_value(n) > 0.6 AS pairs FROM (SELECT call_id, chunk_idx, p, len(w) - 1 AS n, count(*) AS k
  FROM (SELECT call_id, chunk_idx, w, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM c0 WHERE len(w) > 10) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
c5 AS (SELECT c0.*, coalesce(length(text), 0) < 3 OR (len(w) > 5 AND len(list_distinct(w)) <= 2) OR coalesce(again, false) OR coalesce(pairs, false) AS bad, stop - start AS sec, CAST(trunc((stop - start) * 10) AS INT) AS m,
  trim(regexp_replace({''.join('replace(' for _ in X.FOREIGN_PHRASES)}text{''.join(f", '{p}', '')" for p in X.FOREIGN_PHRASES)}, '\\s+', ' ', 'g')) AS u FROM c0 LEFT JOIN c3 USING (call_id, chunk_idx) LEFT JOIN c4 USING (call_id, chunk_idx)),
c6 AS (SELECT *, CASE WHEN contains(left(u, greatest(m, 0)), ' ') THEN length(left(u, m)) - strpos(reverse(left(u, m)), ' ') ELSE -1 END AS sp FROM c5),
c7 AS (SELECT *, {SHORTER.format('u', 'sp')} AS cut FROM c6),
cc AS (SELECT call_id, chunk_idx, start, stop, cut AS text, CASE WHEN bad THEN 'hallucination' WHEN length(u) < 3 THEN 'phrases' WHEN stop <= start THEN 'time' WHEN length(cut) < 3 THEN 'clipped' END AS reason FROM c7)"""


@query(f"WITH {CLEAN_SQL} SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM cc GROUP BY 1")
def drop_reasons(spark, d):
    rows = segments.clean_chunks(C.chunks(spark, d))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f'WITH {CLEAN_SQL} SELECT call_id, chunk_idx, start, stop AS "end", text FROM cc WHERE reason IS NULL')
def clean_chunks(spark, d):
    return segments.clean_chunks(C.chunks(spark, d)).where("reason IS NULL").drop("reason")


@query(f"""WITH {C.LINES_SQL}, w AS (SELECT call_id, seg_idx, {SPLIT.format('text')} AS w FROM lines),
p AS (SELECT call_id, seg_idx, len(w) - 1 AS n, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS p FROM w WHERE len(w) > 10),
g AS (SELECT call_id, seg_idx, max(k) / any_value(n) AS share FROM (SELECT call_id, seg_idx, n, p, count(*) AS k FROM p GROUP BY ALL) GROUP BY 1, 2)
SELECT w.call_id, w.seg_idx, coalesce(share, 0) AS share FROM w LEFT JOIN g ON w.call_id = g.call_id AND w.seg_idx = g.seg_idx""")
def bigram_share(spark, d):
    return C.lines(spark, d).select("call_id", "seg_idx", T.bigram_share(F.col("text")).alias("share"))


@query(f"WITH {C.SEGMENTS_SQL} SELECT call_id, seg_idx, end_ms - start_ms >= 1500 AS voice, end_ms - start_ms >= 1000 AS mood FROM seg WHERE end_ms - start_ms >= 1000")
def min_lengths(spark, d):
    rows = segments.at_least(C.segments(spark, d), 1000)
    return rows.join(segments.at_least(rows, 1500).select("call_id", "seg_idx", F.lit(True).alias("voice")), ["call_id", "seg_idx"], "left").select("call_id", "seg_idx", F.coalesce("voice", F.lit(False)).alias("voice"), F.lit(True).alias("mood"))


def _merged(source: str) -> str:
    """mg(call_id, seg_idx, start_ms, end_ms, text, speaker): ``source`` merged, one segment after the other."""
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) AS k FROM {source}),
fd(call_id, k, o, s, e, t, sp) AS (SELECT call_id, k, CAST(0 AS BIGINT), start_ms, end_ms, text, speaker FROM num WHERE k = 1
  UNION ALL SELECT call_id, k, o + (NOT m)::INT, CASE WHEN m THEN s ELSE start_ms END, end_ms, CASE WHEN NOT m THEN text WHEN text = '' OR text = t THEN t ELSE t || ' ' || text END, speaker
  FROM (SELECT n.*, f.o, f.s, f.t, n.speaker IS NOT DISTINCT FROM f.sp AND (n.start_ms - f.e < 1500 OR f.e - f.s < 2000 OR n.end_ms - n.start_ms < 2000) AS m
    FROM fd f JOIN num n ON n.call_id = f.call_id AND n.k = f.k + 1)),
mg AS (SELECT call_id, o AS seg_idx, arg_max(s, k) AS start_ms, arg_max(e, k) AS end_ms, arg_max(t, k) AS text, any_value(sp) AS speaker FROM fd GROUP BY 1, 2)"""


def _thinned(source: str) -> str:
    """kp: the rows of ``source`` that :func:`drop_repeats` keeps."""
    return f"""t0 AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY call_id ORDER BY seg_idx), '') AS b FROM {source}),
t1 AS (SELECT *, list_distinct({SPLIT.format('text')}) AS x, list_distinct({SPLIT.format('b')}) AS y FROM t0),
t2 AS (SELECT *, text = b OR (len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) > 0.8) AS same FROM t1),
t3 AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY call_id ORDER BY seg_idx) AS run FROM t2),
t4 AS (SELECT *, row_number() OVER (PARTITION BY call_id, run ORDER BY seg_idx) + (run = 0)::INT AS place FROM t3), kp AS (SELECT * FROM t4 WHERE place <= 2)"""


@query(f"WITH RECURSIVE {C.SEGMENTS_SQL}, {_merged('seg')} SELECT * FROM mg")
def merge_adjacent(spark, d):
    return segments.merge_adjacent(C.segments(spark, d))


@query(f"WITH ln AS (WITH {C.LINES_SQL} SELECT call_id, seg_idx, text AS raw, trim(text, ' \t\r\n') AS text FROM lines), {_thinned('ln')} SELECT call_id, seg_idx, raw AS text FROM kp")
def drop_repeats(spark, d):
    return segments.drop_repeats(C.lines(spark, d))


def _given(source: str, turns: str, name: str) -> str:
    """``name``: the segments of ``source`` with the speaker that ``turns`` gives them."""
    return f"""gv AS (SELECT s.call_id, seg_idx, t.speaker, sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS ms
  FROM {source} s JOIN {turns} t ON s.call_id = t.call_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms GROUP BY ALL),
gb AS (SELECT *, row_number() OVER (PARTITION BY call_id, seg_idx ORDER BY ms DESC, speaker) AS k FROM gv),
{name} AS (SELECT s.*, gb.speaker FROM (SELECT COLUMNS(lambda c: c <> 'speaker') FROM {source}) s
  LEFT JOIN gb ON s.call_id = gb.call_id AND s.seg_idx = gb.seg_idx AND k = 1)"""


@query(f"WITH {C.SPANS_SQL}, {_given('sg', 'tn', 'given')} SELECT * FROM given")
def assign_speakers(spark, d):
    return segments.assign_speakers(C.spans(spark, d, "segments"), C.spans(spark, d, "turns"))


LEVEL = "CASE WHEN {0} < {1} THEN '{3}' WHEN {0} > {2} THEN '{4}' ELSE 'normal' END"


PROSODY_SQL = f"""{C.SPANS_SQL}, {C.FRAMES_SQL},
pj AS (SELECT s.call_id, seg_idx, CASE WHEN f0 > 50 AND f0 < 500 THEN f0 END AS f0, rms, onset
  FROM sg s JOIN fr f ON s.call_id = f.call_id AND t_ms >= start_ms AND t_ms < end_ms WHERE end_ms - start_ms >= 1500),
pa AS (SELECT call_id, seg_idx, count(*) AS n, count(f0) AS nv, sum(f0) AS s, sum(f0 * f0) AS q, sum(rms) / count(rms) AS e, sum(onset::INT) AS o FROM pj GROUP BY 1, 2),
pb AS (SELECT sg.*, end_ms - start_ms AS dur, coalesce(n, 0) >= 2 AS known, CASE WHEN nv > 0 THEN s / nv ELSE 0 END AS p,
  CASE WHEN nv > 0 THEN sqrt(greatest(nv * q - s * s, 0)) / nv ELSE 0 END AS sd, coalesce(e, 0) AS e, o * 1000 / (end_ms - start_ms) AS r FROM sg LEFT JOIN pa USING (call_id, seg_idx)),
sp AS (SELECT call_id, seg_idx, speaker, CASE WHEN dur >= 1500 THEN CASE WHEN known THEN round_even(p, 1) ELSE 0 END END AS pitch_mean, CASE WHEN dur >= 1500 THEN CASE WHEN known THEN round_even(sd, 1) ELSE 0 END END AS pitch_std,
  CASE WHEN dur >= 1500 THEN CASE WHEN known THEN {LEVEL.format('p', 100, 250, 'low', 'high')} ELSE 'unknown' END END AS pitch_level,
  CASE WHEN dur >= 1500 THEN CASE WHEN known THEN round_even(e, 0) ELSE 0 END END AS energy_mean, CASE WHEN dur >= 1500 THEN CASE WHEN known THEN {LEVEL.format('e', 100, 800, 'low', 'high')} ELSE 'unknown' END END AS energy_level,
  CASE WHEN dur >= 1500 THEN CASE WHEN known THEN {LEVEL.format('r', 3, 7, 'slow', 'fast')} ELSE 'unknown' END END AS speech_rate FROM pb)"""


@query(f"WITH {PROSODY_SQL} SELECT * EXCLUDE (speaker) FROM sp")
def segment_prosody(spark, d):
    """Events are far apart, so two frames are enough here."""
    return prosody.segment_prosody(C.frames(spark, d), C.spans(spark, d, "segments"), 2)


@query(f"WITH {C.MEASURED_SQL} SELECT call_id, speaker, median(pitch) AS base_pitch, median(std) AS base_std, median(energy) AS base_energy FROM mea GROUP BY 1, 2")
def speaker_baselines(spark, d):
    return C.measured(spark, d).groupBy("call_id", "speaker").agg(*(F.median(c).alias(f"base_{c}") for c in ("pitch", "std", "energy")))


@query(f"WITH {C.MEASURED_SQL} SELECT call_id, speaker, median(pitch) AS base_pitch, median(std) AS base_std, median(energy) AS base_energy FROM mea GROUP BY 1, 2")
def baseline_runs(spark, d):
    """The same medians from the value counts of three runs, which are merged."""
    rows = C.measured(spark, d)
    return prosody.baselines(prosody.merged_counts(*(prosody.value_counts(rows.where(F.col("seg_idx") % 3 == k)) for k in range(3))))


def _enriched(source: str, e_level: str, rate: str) -> str:
    """en: the measured rows of ``source`` beside their baselines and earlier segments."""
    return f"""bs AS (SELECT *, median(pitch) OVER (PARTITION BY call_id, speaker) AS bp, median(std) OVER (PARTITION BY call_id, speaker) AS bsd, median(energy) OVER (PARTITION BY call_id, speaker) AS be,
  avg(pitch) OVER w AS rp, avg(energy) OVER w AS re FROM {source} WINDOW w AS (PARTITION BY call_id, speaker ORDER BY seg_idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
rf AS (SELECT *, coalesce(rp, bp) AS fp, coalesce(re, be) AS fe, CASE WHEN bp > 0 THEN pitch / bp ELSE 1 END AS rt, CASE WHEN be > 0 THEN energy / be ELSE 1 END AS et FROM bs),
en AS (SELECT * EXCLUDE (speech_rate, energy_level), CASE WHEN rt < 0.85 THEN 'much_lower' WHEN rt < 0.95 THEN 'lower' WHEN rt <= 1.05 THEN 'normal' WHEN rt <= 1.15 THEN 'higher' ELSE 'much_higher' END AS relative_pitch,
  CASE WHEN std >= greatest(bsd * 1.5, 50) THEN 'high' WHEN std <= least(bsd * 0.8, 25) THEN 'low' ELSE 'normal' END AS pitch_var_level,
  round_even((rt - 1) * 100, 1) + 0 AS pitch_pct, round_even((et - 1) * 100, 1) + 0 AS energy_pct,
  concat_ws('+', CASE WHEN fp > 0 AND abs(pitch - fp) / fp >= 0.25 THEN '피치' || CASE WHEN pitch > fp THEN '↑' ELSE '↓' END END,
    CASE WHEN fe > 0 AND abs(energy - fe) / fe >= 0.4 THEN '에너지' || CASE WHEN energy > fe THEN '↑' ELSE '↓' END END) AS change_hint,
  {e_level} AS energy_level, {rate} AS speech_rate FROM (SELECT *, NULL AS speech_rate, NULL AS energy_level FROM rf))"""


MEASURES = "relative_pitch, pitch_var_level, pitch_pct, energy_pct, change_hint"
ENRICHED_SQL = f"WITH {C.MEASURED_SQL}, " + _enriched("mea", LEVEL.format("energy", 100, 800, "low", "high"), LEVEL.format("rate", 3, 7, "slow", "fast"))


@query(f"{ENRICHED_SQL} SELECT m.call_id, m.seg_idx, m.speaker, {MEASURES}, change_hint <> '' AS sudden_change FROM mall m LEFT JOIN en USING (call_id, seg_idx)")
def rolling_sudden_change(spark, d):
    return prosody.enriched(C.measured(spark, d)).select("call_id", "seg_idx", "speaker", *MEASURES.split(", "), "sudden_change")


def _words(names: dict[str, str], c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def _mode(c: str) -> str:
    return f"(SELECT call_id, speaker, {c} FROM (SELECT call_id, speaker, {c}, row_number() OVER (PARTITION BY call_id, speaker ORDER BY count(*) DESC, min(seg_idx)) AS k FROM en GROUP BY 1, 2, 3) WHERE k = 1)"


def _mean(c: str, digits: int) -> str:
    """The mean of values of so many decimals, rounded to as many, half to even, in whole numbers."""
    total = f"CAST(sum(CAST(round({c} * {10**digits}) AS BIGINT)) AS BIGINT)"
    up = f"2 * ({total} % count(*)) > count(*) OR (2 * ({total} % count(*)) = count(*) AND {total} // count(*) % 2 = 1)"
    return f"({total} // count(*) + CASE WHEN {up} THEN 1 ELSE 0 END) / {10**digits}"


WHOLE = "printf('%.0f', round_even(CAST({0} AS DOUBLE), 0))"
SUMMARY_SQL = f"""vs AS (SELECT * FROM (SELECT call_id, speaker, round_even(round(any_value(bp) * 10, 3), 0) / 10 AS base_pitch, round_even(round(any_value(be), 3), 0) AS base_energy, {_mean('pitch', 1)} AS avg_pitch, {_mean('std', 1)} AS pitch_variability,
  {_mean('energy', 0)} AS avg_energy, count(*) FILTER (change_hint <> '') AS sudden_change_count FROM en GROUP BY 1, 2)
  {" ".join(f"JOIN {_mode(c)} USING (call_id, speaker)" for c in prosody.MODES)}),
vo AS (SELECT *, '평소피치 ' || {WHOLE.format("base_pitch")} || 'Hz, 전체 ' || {_words(X.RELATIVE_PITCH, "relative_pitch")} || ', 변동 ' || {_words(X.VARIABILITY, "pitch_var_level")} || ', ' || {_words(X.ENERGY_TONES, "energy_level")}
  || ', ' || {_words(X.RATES, "speech_rate")} || CASE WHEN sudden_change_count > 0 THEN ', 급변 ' || sudden_change_count || '회' ELSE '' END AS voice_description FROM vs)"""


@query(f"{ENRICHED_SQL}, {SUMMARY_SQL} SELECT * FROM vo")
def speaker_summary(spark, d):
    return prosody.speaker_summary(prosody.enriched(C.measured(spark, d)))


@query(f"WITH {C.SEGMENTS_SQL} SELECT * FROM (" + " UNION ALL ".join(f"SELECT call_id, seg_idx, {i} AS type_ord, {j} AS kw_ord, '{t}' AS type, '{k}' AS keyword, coalesce(speaker, 'UNKNOWN') AS speaker, start_ms, text FROM seg WHERE contains(text, '{k}')" for i, (t, ks) in enumerate(DANGER.items()) for j, k in enumerate(ks)) + ")")
def keyword_hits(spark, d):
    return speakers.keyword_hits(C.segments(spark, d), DANGER)


@query(f"""WITH {C.SEGMENTS_SQL}, lx AS (SELECT dense_rank() OVER (ORDER BY left(w, 1)) AS t, row_number() OVER (PARTITION BY left(w, 1) ORDER BY w) AS k, left(w, 1) AS type, w FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE w <> '')
SELECT call_id, seg_idx, CAST(t - 1 AS INT) AS type_ord, CAST(k - 1 AS INT) AS kw_ord, type, w AS keyword, coalesce(speaker, 'UNKNOWN') AS speaker, start_ms, text FROM seg JOIN lx ON contains(text, w)""")
def lexicon_hits(spark, d):
    """Keywords from a table: all words of the benchmark, those that begin alike as one type."""
    words = C.table(spark, d, "benchmark").select(F.explode(F.split("text", " ")).alias("keyword")).where("keyword <> ''").distinct().withColumn("type", F.substring("keyword", 1, 1))
    place = F.row_number().over(Window.partitionBy("type").orderBy("keyword")) - 1
    types = words.select("type").distinct().withColumn("type_ord", F.row_number().over(Window.orderBy("type")) - 1)
    return speakers.lexicon_hits(C.segments(spark, d), words.withColumn("kw_ord", place).join(types, "type"))


KEYWORD_FLAGS = " UNION ALL ".join(f"SELECT call_id, '{t} 키워드 감지' AS flag, sum({' + '.join(f"contains(text, '{k}')::INT" for k in ks)}) AS n FROM seg GROUP BY 1" for t, ks in DANGER.items())


@query(f"""WITH {C.SEGMENTS_SQL}, f AS (SELECT call_id, string_agg(flag, ',' ORDER BY flag) AS flags, sum(n)::BIGINT AS n_details FROM ({KEYWORD_FLAGS}) WHERE n > 0 GROUP BY 1)
SELECT call_id, flags IS NOT NULL AS detected, coalesce(flags, '') AS flags, coalesce(n_details, 0) AS n_details FROM (SELECT DISTINCT call_id FROM seg) LEFT JOIN f USING (call_id)""")
def danger_rollup(spark, d):
    rows = C.segments(spark, d)
    found = speakers.danger(speakers.keyword_hits(rows, DANGER), calls=rows)
    return found.select("call_id", "detected", F.array_join("flags", ",").alias("flags"), F.size("details").cast("long").alias("n_details"))


def _emotions(spark, d):
    """Logits are sums over every sixth dimension of a vector, ten times them, in whole 1e-3; ten vectors are a call's."""
    part = lambda k: F.aggregate(F.filter("embedding", lambda x, i: i % 6 == k), F.lit(0).cast("long"), lambda a, x: a + F.floor(x.cast("double") * 10_000)) / F.lit(1000.0)
    logits = F.array(*(part(k) for k in range(6)))
    rows = C.table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 10).cast("long").alias("call_id"), F.concat(F.lit("S"), F.col("label") % 3).alias("speaker"), F.col("vec_id").alias("seg_idx"), logits.alias("logits"))
    return rows.select("call_id", "speaker", "seg_idx", emotion.softmax(F.col("logits")).alias("probabilities"))


PROBABILITIES_SQL = """e AS (SELECT vec_id // 10 AS call_id, 'S' || (label % 3) AS speaker, vec_id AS seg_idx,
  list_transform(range(6), lambda k: CAST(list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 6 = k), lambda x: CAST(floor(CAST(x AS DOUBLE) * 10000) AS BIGINT))) AS DOUBLE) / CAST(1000 AS DOUBLE)) AS l FROM embeddings),
x AS (SELECT *, list_transform(l, lambda v: exp(v - list_max(l))) AS p FROM e), pr AS (SELECT call_id, speaker, seg_idx, list_transform(p, lambda v: v / list_sum(p)) AS p FROM x)"""
LABELS_SQL = "[" + ", ".join(f"'{x}'" for x in emotion.EMOTIONS) + "]"


@query(f"WITH {PROBABILITIES_SQL} SELECT call_id, seg_idx, round(list_max(p), 6) AS score, CASE WHEN list_max(p) < 0.4 THEN '중립' ELSE {LABELS_SQL}[list_position(p, list_max(p))] END AS label FROM pr")
def emotion_softmax(spark, d):
    return _emotions(spark, d).select("call_id", "seg_idx", F.round(F.array_max("probabilities"), 6).alias("score"), emotion.best_label(F.col("probabilities")).alias("label"))


@query(f"WITH {PROBABILITIES_SQL} SELECT call_id, seg_idx, {LABELS_SQL}[i] AS label, round(p[i], 6) AS score FROM pr, range(1, 7) r(i)")
def emotion_scores(spark, d):
    """Label to probability of each segment, as rows."""
    rows = _emotions(spark, d).select("call_id", "seg_idx", F.explode(emotion.scores(F.col("probabilities"))).alias("label", "p"))
    return rows.select("call_id", "seg_idx", "label", F.round("p", 6).alias("score"))


MOODS_SQL = f"""{PROBABILITIES_SQL}, mt AS (SELECT call_id, speaker, i, sum(CAST(round(p[i] * 1e6) AS BIGINT)) AS s FROM pr, range(1, 7) r(i) GROUP BY ALL),
mh AS (SELECT call_id, speaker, i, floor(s * 1000 / sum(s) OVER (PARTITION BY call_id, speaker) + 0.5) / 1000 AS share FROM mt),
mk AS (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY share DESC, i) AS k, {LABELS_SQL}[i] AS label, {_words(X.TONES, LABELS_SQL + '[i]')} AS tone FROM mh),
mo AS (SELECT call_id, speaker, max(label) FILTER (k = 1) AS dominant, max(share) FILTER (k = 1) AS share, max(share) FILTER (k = 2) AS second,
  CASE WHEN max(share) FILTER (k = 1) - max(share) FILTER (k = 2) < 0.1 THEN max(tone) FILTER (k = 1) || ' + ' || max(tone) FILTER (k = 2) || ' 혼합' ELSE max(tone) FILTER (k = 1) END AS tone FROM mk GROUP BY 1, 2)"""
MOOD_RULES = (("분노", 0.2, "강한 분노 감정 감지"), ("슬픔", 0.2, "심한 우울/슬픔 감지"))
MOOD_FLAGS = " UNION ALL ".join(f"SELECT call_id, speaker || ' {flag}' AS flag FROM mo WHERE dominant = '{x}' AND share > {share}" for x, share, flag in MOOD_RULES)
VOICE_FLAGS = """SELECT call_id, speaker || ' 고성 가능성' AS flag FROM vo WHERE energy_level = 'high' AND relative_pitch IN ('higher', 'much_higher')
  UNION ALL SELECT call_id, speaker || ' 운율 급변 다발 (' || sudden_change_count || '회)' FROM vo WHERE sudden_change_count >= 3"""
FOUND_SQL = f"""kw AS (SELECT call_id, flag FROM ({KEYWORD_FLAGS}) WHERE n > 0), fl AS (SELECT DISTINCT * FROM (FROM kw UNION ALL {MOOD_FLAGS} UNION ALL {VOICE_FLAGS})),
fo AS (SELECT call_id, string_agg(flag, ', ' ORDER BY flag) AS flags FROM fl GROUP BY 1)"""


@query(f"WITH {MOODS_SQL} SELECT call_id, speaker, dominant AS dominant_emotion, share, second, tone AS tone_description FROM mo")
def emotion_by_speaker(spark, d):
    out = emotion.emotion_by_speaker(_emotions(spark, d))
    ranked = F.sort_array(F.map_values("emotion_distribution"), False)
    return out.select("call_id", "speaker", "dominant_emotion", F.get(ranked, F.lit(0)).alias("share"), F.get(ranked, F.lit(1)).alias("second"), "tone_description")


@query(f"WITH {MOODS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY share DESC, label) AS rank FROM mk) SELECT call_id, speaker, label, share, CAST(rank AS INT) AS rank FROM r WHERE rank <= 2")
def top_emotions(spark, d):
    return emotion.ranked_shares(emotion.emotion_by_speaker(_emotions(spark, d)))


@query(f"WITH {MOODS_SQL} {MOOD_FLAGS}")
def emotion_danger(spark, d):
    return emotion.emotion_flags(emotion.emotion_by_speaker(_emotions(spark, d)), MOOD_RULES)


@query(f"{ENRICHED_SQL}, {SUMMARY_SQL} {VOICE_FLAGS}")
def prosody_danger(spark, d):
    return prosody.prosody_flags(speaker_summary(spark, d))


@query(f"{ENRICHED_SQL}, {C.SEGMENTS_SQL}, {SUMMARY_SQL}, {MOODS_SQL}, {FOUND_SQL} SELECT call_id, coalesce(flags, '') AS flags, flags IS NOT NULL AS detected FROM (SELECT DISTINCT call_id FROM seg) LEFT JOIN fo USING (call_id)")
def danger_flags(spark, d):
    """Flags of keywords, emotions and voices of the same call ids, united."""
    return _found(spark, d).select("call_id", F.array_join("flags", ", ").alias("flags"), "detected")


@query(f"{ENRICHED_SQL}, {C.SEGMENTS_SQL}, {SUMMARY_SQL}, {MOODS_SQL}, {FOUND_SQL} SELECT c_custkey AS call_id, c_name AS patient_name, fo.call_id IS NOT NULL AS urgent FROM customer LEFT JOIN fo ON fo.call_id = c_custkey AND c_custkey IN (SELECT call_id FROM seg)")
def worklists(spark, d):
    """Calls to look at first, and the others."""
    urgent, others = speakers.worklists(_people(spark, d).select("call_id", "patient_name"), _found(spark, d))
    return urgent.withColumn("urgent", F.lit(True)).unionByName(others.withColumn("urgent", F.lit(False)))


def _found(spark, d):
    return workloads.danger_job(C.segments(spark, d), emotion.emotion_by_speaker(_emotions(spark, d)), speaker_summary(spark, d), DANGER, MOOD_RULES)


@query(f"WITH {C.SEGMENTS_SQL} SELECT call_id, seg_idx, speaker, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY seg_idx) AS k FROM seg WHERE end_ms - start_ms > 2000) WHERE k <= 3")
def first_n_per_speaker(spark, d):
    return segments.first_per_speaker(C.segments(spark, d)).select("call_id", "seg_idx", "speaker", "rank")


@query(f"WITH {C.SEGMENTS_SQL} SELECT call_id, count(*) AS n_segments, count(DISTINCT coalesce(speaker, 'UNKNOWN')) AS n_speakers, arg_max(end_ms, seg_idx) // 1000 AS seconds FROM seg GROUP BY 1")
def call_span(spark, d):
    return segments.call_spans(C.segments(spark, d))


@query(f"WITH {C.SEGMENTS_SQL}, c AS (SELECT call_id, max(end_ms) / 1000 AS s FROM seg GROUP BY 1) SELECT call_id, CASE WHEN s > 20 THEN '오디오가 너무 깁니다 (' || {WHOLE.format('s')} || '초). 최대 20초' END AS error FROM c")
def duration_gate(spark, d):
    calls = C.segments(spark, d).groupBy("call_id").agg((F.max("end_ms") / 1000).alias("duration_sec"))
    return report.duration_gate(calls, 20).select("call_id", "error")


@query("""SELECT o_orderkey AS call_id, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(o_orderdate + to_microseconds(CAST(o_orderkey % 5000 * 500000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS end_time FROM orders""")
def visit_window(spark, d):
    start, end = report.visit_window(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.col("o_orderkey") % 5000 * 0.5, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return C.table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), start.alias("start_time"), end.alias("end_time"))


@query("SELECT o_orderkey AS call_id, CAST(date_sub('year', DATE '1940-01-01' + CAST(o_custkey % 20000 AS INT), CAST(o_orderdate AS DATE)) AS INT) AS age FROM orders")
def age(spark, d):
    birth = F.date_add(F.lit("1940-01-01").cast("date"), (F.col("o_custkey") % 20000).cast("int"))
    return C.table(spark, d, "orders").select(F.col("o_orderkey").alias("call_id"), report.full_years(birth, F.to_date("o_orderdate")).alias("age"))


WRAPPED = """CASE seg_idx % 5 WHEN 0 THEN 'x ```json' || chr(10) || '{"a": "' || length(text) || '"}' || chr(10) || '```' WHEN 1 THEN 'pre {"a": ' || length(text) || '} post'
  WHEN 2 THEN '{"a": 1} x {"b": 2}' WHEN 3 THEN '```json' || chr(10) || '{bad}' || chr(10) || '``` {"a": 1}' ELSE text END"""


@query(f"""WITH {C.SEGMENTS_SQL}, r AS (SELECT call_id, seg_idx, {WRAPPED} AS t FROM seg), b AS (SELECT *, regexp_extract(t, '(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1) AS f,
  CASE WHEN contains(t, '{{') AND contains(t, '}}') THEN t[strpos(t, '{{'):length(t) - strpos(reverse(t), '}}') + 1] END AS g FROM r),
p AS (SELECT *, CASE WHEN f <> '' AND json_valid(f) THEN f WHEN g IS NOT NULL AND json_valid(g) THEN g END AS report FROM b) SELECT call_id, seg_idx, report, CASE WHEN report IS NULL THEN t END AS raw_response FROM p""")
def parse_response(spark, d):
    return report.reports(C.segments(spark, d).selectExpr("call_id", "seg_idx", f"{WRAPPED} AS response"))


@query(f"WITH {C.SEGMENTS_SQL}, c AS (SELECT call_id, string_agg(text, chr(10) ORDER BY seg_idx) AS t FROM seg GROUP BY 1), o AS (SELECT *, length(t) - 1000 AS o FROM c) SELECT call_id, CASE WHEN o > 0 AND length(t) - o - 200 > 500 THEN left(t, length(t) - o - 200) || chr(10) || '... (이하 생략)' ELSE t END AS t FROM o")
def prompt_cap(spark, d):
    rows = C.segments(spark, d).groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return rows.select("call_id", report.capped("t", F.length("t") - 1000).alias("t"))


def _signed(c: str) -> str:
    return f"CASE WHEN {c} < 0 THEN '-' ELSE '+' END || {WHOLE.format(f'abs({c})')}"


SHORT_CLOCK = "printf('%02d:%04.1f', {0} // 60000, ({0} % 60000) / 1000.0)"
TAG_SQL = f"""concat_ws(', ', '피치=' || pitch || 'Hz(' || {_words(X.RELATIVE_PITCH, 'relative_pitch')} || ',' || {_signed('pitch_pct')} || '%)', '변동=' || {_words(X.VARIABILITY, 'pitch_var_level')} || '(std=' || std || ')',
  '에너지=' || energy_level || '(' || {_signed('energy_pct')} || '%)', '말속도=' || speech_rate, CASE WHEN change_hint <> '' THEN '급변=' || change_hint END)"""


@query(f"{ENRICHED_SQL}, {SUMMARY_SQL} SELECT call_id, speaker, voice_description FROM vo")
def voice_descriptions(spark, d):
    return speaker_summary(spark, d).select("call_id", "speaker", "voice_description")


TONES_SQL = f"""{ROLES_SQL}, {ENRICHED_SQL.removeprefix("WITH ")}, {SUMMARY_SQL}, {MOODS_SQL}"""
TONED = "CASE WHEN voice_description IS NULL THEN coalesce(tone, {0}) ELSE coalesce(tone, {0}, '') || ' (' || voice_description || ')' END"


@query(f"{TONES_SQL} SELECT ro.call_id, role, {TONED.format(chr(39) + '미상' + chr(39))} AS tone FROM ro LEFT JOIN mo USING (call_id, speaker) LEFT JOIN vo USING (call_id, speaker) WHERE ro.rank <= 2")
def tone_override(spark, d):
    roles = speakers.role_ranks(C.segments(spark, d), keywords=MANAGER, suffixes=SUFFIXES)
    return report.tone_overrides(roles, emotion.emotion_by_speaker(_emotions(spark, d)), speaker_summary(spark, d), F.lit("미상"))


@query(f"WITH {C.MEASURED_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY call_id, speaker ORDER BY seg_idx) AS k FROM mea WHERE std * 100 > 2000) SELECT call_id, speaker, sum(pitch) / count(*) AS avg_pitch, sum(energy) / count(*) AS avg_energy FROM f WHERE k <= 3 GROUP BY 1, 2")
def sample_averages(spark, d):
    rows = C.measured(spark, d).withColumn("start_ms", F.lit(0)).withColumn("end_ms", F.col("std") * 100)
    return prosody.sample_averages(segments.first_per_speaker(rows))


@query(f"WITH {C.SEGMENTS_SQL} SELECT call_id, CAST(row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) - 1 AS INT) AS chunk_idx, CASE WHEN seg_idx % 3 = 0 THEN 0.0 ELSE start_ms / 1000 END AS start, end_ms / 1000 AS end, trim(text) AS text FROM seg")
def explode_chunks(spark, d):
    chunk = F.struct("seg_idx", F.when(F.col("seg_idx") % 3 != 0, F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")
    calls = C.segments(spark, d).groupBy("call_id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"))
    return segments.explode_chunks(calls)


SHOWN_SQL = f"""rm AS (SELECT call_id, string_agg(role || '=' || speaker, ',' ORDER BY role || '=' || speaker) AS speaker_roles FROM ro GROUP BY 1),
em AS (SELECT call_id, string_agg(dominant || '=' || speaker, ',' ORDER BY dominant || '=' || speaker) AS emotions FROM mo GROUP BY 1),
vm AS (SELECT call_id, string_agg(voice_description || '=' || speaker, ',' ORDER BY voice_description || '=' || speaker) AS voices FROM vo GROUP BY 1)"""


def _shown(name: str, field: str | None = None):
    """A map of speakers as text: what the ``field`` of each is, with the speaker."""
    told = F.transform(F.map_entries(name), lambda x: F.concat(x["value"][field] if field else x["value"], F.lit("="), x["key"]))
    return F.array_join(F.array_sort(told), ",")


def _by_call(spark, d):
    """Roles, moods and voices of the speakers of each call, as maps."""
    moods = report.speaker_map(emotion.emotion_by_speaker(_emotions(spark, d)), "emotions")
    return report.role_map(role_ranks(spark, d)), moods, report.speaker_map(speaker_summary(spark, d), "voices")


@query(f"""{TONES_SQL}, {SHOWN_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) AS k FROM seg),
sn AS (SELECT call_id, count(*) AS num_segments, string_agg(seg_idx || ':' || text, chr(10) ORDER BY seg_idx) FILTER (k <= 3) AS sample FROM n GROUP BY 1)
SELECT * FROM sn LEFT JOIN rm USING (call_id) LEFT JOIN em USING (call_id) LEFT JOIN vm USING (call_id)""")
def run_report(spark, d):
    out = segments.run_report(C.segments(spark, d), 3, *_by_call(spark, d))
    sample = F.array_join(F.transform("segments_sample", lambda x: F.concat(x["seg_idx"].cast("string"), F.lit(":"), x["text"])), "\n")
    return out.select("call_id", "num_segments", sample.alias("sample"), _shown("speaker_roles").alias("speaker_roles"), _shown("emotions", "dominant_emotion").alias("emotions"), _shown("voices", "voice_description").alias("voices"))


@query(f"{ROLES_SQL} SELECT call_id, string_agg('[' || {CLOCK.format('start_ms')} || ' --> ' || {CLOCK.format('end_ms')} || '] [' || sp || '] ' || text, chr(10) ORDER BY seg_idx) AS transcript FROM named GROUP BY 1")
def transcript_speakers(spark, d):
    return speakers.transcripts(C.segments(spark, d), "speaker")


def _tagged(spark, d):
    """Measures of as many segments of each call as there are, in order."""
    return _numbered(prosody.enriched(C.measured(spark, d)))


def _numbered(beside):
    return beside.withColumn("seg_idx", F.row_number().over(Window.partitionBy("call_id").orderBy("seg_idx")) - 1)


TAGS_SQL = f"""tg AS (SELECT call_id, seg_idx, {TAG_SQL} AS tag FROM (SELECT en.* EXCLUDE (seg_idx), k AS seg_idx
  FROM (SELECT call_id, seg_idx AS sx, row_number() OVER (PARTITION BY call_id ORDER BY seg_idx) - 1 AS k FROM mall) JOIN en USING (call_id) WHERE en.seg_idx = sx))"""


@query(f"""{ENRICHED_SQL}, {C.SEGMENTS_SQL}, {TAGS_SQL}
SELECT s.call_id, s.seg_idx, '[' || {SHORT_CLOCK.format('start_ms')} || '~' || {SHORT_CLOCK.format('end_ms')} || '] [' || coalesce(speaker, 'UNKNOWN') || '] ' || text || coalesce('  |운율: ' || tag || '|', '') AS line
FROM seg s LEFT JOIN tg ON s.call_id = tg.call_id AND s.seg_idx = tg.seg_idx""")
def tagged_lines(spark, d):
    return prosody.tagged_lines(C.segments(spark, d), _tagged(spark, d))


INLINE_SQL = f"""{TAGS_SQL},
il AS (SELECT n.call_id, string_agg('[' || {SHORT_CLOCK.format('start_ms')} || '~' || {SHORT_CLOCK.format('end_ms')} || '] [' || role || '] ' || text || coalesce('  |운율: ' || tag || '|', ''), chr(10) ORDER BY n.seg_idx) AS transcript
  FROM named n JOIN ro ON n.call_id = ro.call_id AND n.sp = ro.speaker LEFT JOIN tg ON n.call_id = tg.call_id AND n.seg_idx = tg.seg_idx GROUP BY 1)"""


@query(f"{ROLES_SQL}, {ENRICHED_SQL.removeprefix('WITH ')}, {INLINE_SQL} SELECT * FROM il")
def transcript_inline(spark, d):
    rows = speakers.with_roles(C.segments(spark, d), keywords=MANAGER, suffixes=SUFFIXES)
    return speakers.in_order(prosody.tagged_lines(rows, _tagged(spark, d), "role"))


ALL_SQL = f"{TONES_SQL}, {FOUND_SQL}"
META_SQL = f"""ml AS (SELECT ro.call_id, '[화자별 운율 종합 (baseline 기준)]' || chr(10) || string_agg('- ' || role || '(' || ro.speaker || '): baseline ' || {WHOLE.format('coalesce(base_pitch, 0)')} || 'Hz, ' || coalesce(voice_description, '분석 불가'), chr(10) ORDER BY ro.rank)
  || coalesce(chr(10) || '- 위험 플래그: ' || any_value(flags), '') AS meta FROM ro LEFT JOIN vo USING (call_id, speaker) LEFT JOIN fo ON fo.call_id = ro.call_id GROUP BY 1)"""


@query(f"{ALL_SQL}, {META_SQL} SELECT * FROM ml")
def meta_lines(spark, d):
    roles = speakers.role_ranks(C.segments(spark, d), keywords=MANAGER, suffixes=SUFFIXES)
    return report.meta_lines(roles, speaker_summary(spark, d), _found(spark, d))


@query(f"""{ALL_SQL} SELECT ro.call_id, '[음성 분석 결과]' || chr(10) || string_agg('- ' || role || '(' || ro.speaker || '): 감정=' || coalesce(tone, '분석 불가') || ', 음성=' || coalesce(voice_description, '분석 불가'), chr(10) ORDER BY ro.rank)
  || coalesce(chr(10) || '- ⚠ 위험 플래그: ' || any_value(flags), '') AS meta FROM ro LEFT JOIN mo USING (call_id, speaker) LEFT JOIN vo USING (call_id, speaker) LEFT JOIN fo ON fo.call_id = ro.call_id GROUP BY 1""")
def mood_lines(spark, d):
    roles = speakers.role_ranks(C.segments(spark, d), keywords=MANAGER, suffixes=SUFFIXES)
    return report.mood_lines(roles, emotion.emotion_by_speaker(_emotions(spark, d)), speaker_summary(spark, d), _found(spark, d))


TEMPLATE = "Report {{}} of {patient_name}, {age}, {gender}, {address} by {admin_name} ({admin_phone})\n{start_time} to {end_time}, {duration_sec} s\n{analysis_meta}\n\n{transcript}\n"


def _people(spark, d):
    """Calls of the customers: call_id and form fields, some empty; their visits begin with the year."""
    return C.table(spark, d, "customer").select(
        F.col("c_custkey").alias("call_id"), F.col("c_name").alias("patient_name"), F.lit("").alias("admin_name"), F.lit(None).cast("string").alias("admin_phone"), F.col("c_nationkey").cast("string").alias("age"),
        F.lit("F").alias("gender"), F.concat(F.lit("{"), "c_mktsegment", F.lit("} {address}")).alias("address"),
    )


@query("""SELECT CASE WHEN c_custkey % 10 > 0 THEN CAST(c_custkey AS VARCHAR) ELSE substr(md5('{"admin_name":"","patient_name":"' || c_name || '","age":"' || c_nationkey || '","gender":"F","address":"{' || c_mktsegment || '} {address}"}'), 1, 8) END AS call_id,
  c_name AS patient_name, CAST(c_nationkey AS VARCHAR) AS age, CAST(NULL AS VARCHAR) AS path FROM customer""")
def calls_read(spark, d):
    """Call metadata written and read again; each tenth call has no id of its own."""
    path = new_folder(spark, "calls")
    _people(spark, d).withColumn("call_id", F.when(F.col("call_id") % 10 > 0, F.col("call_id").cast("string"))).write.parquet(path)
    return readers.read_calls(spark, path).select("call_id", "patient_name", "age", "path")


@query("""SELECT count(*) AS n, count(*) FILTER (c_custkey % 7 > 0) AS succeeded, count(*) FILTER (c_custkey % 7 = 0) AS rejected, strftime(DATE '2024-01-01' + CAST(c_custkey % 3 AS INT), '%Y-%m-%d') AS day FROM customer GROUP BY ALL""")
def written_results(spark, d):
    """Documents and rejected calls of each day, of a run that was written twice."""
    path = new_folder(spark, "results")
    rows = _people(spark, d).withColumn("error", F.when(F.col("call_id") % 7 == 0, "x"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("call_id") % 3).cast("int"))
    for _ in range(2):
        report.write_run(rows, path, day)
    read = spark.read.text(f"{path}/results").groupBy("day").agg(F.count("*").alias("n"), F.count_if(F.get_json_object("value", "$.success") == "true").alias("succeeded"))
    bad = spark.read.schema("call_id long, error string, day date").json(f"{path}/rejected").groupBy("day").agg(F.count("*").alias("rejected"))
    return read.join(bad, "day").select("n", "succeeded", "rejected", F.date_format("day", "yyyy-MM-dd").alias("day"))


DETAILS_SQL = f"""hk AS ({" UNION ALL ".join(f"SELECT call_id, seg_idx, {i} AS ti, {j} AS ki, '{t}' AS type, '{k}' AS keyword, coalesce(speaker, 'UNKNOWN') AS speaker, start_ms / 1000 AS time, text FROM seg WHERE contains(text, '{k}')" for i, (t, ks) in enumerate(DANGER.items()) for j, k in enumerate(ks))}),
hd AS (SELECT call_id, list({{'type': type, 'keyword': keyword, 'speaker': speaker, 'time': time, 'text': text}} ORDER BY seg_idx, ti, ki) AS details FROM hk GROUP BY 1),
hf AS (SELECT call_id, list(flag ORDER BY flag) AS flags FROM fl GROUP BY 1),
di AS (SELECT call_id, to_json({{'detected': true, 'flags': flags, 'details': coalesce(details, [])}}) AS danger_info FROM hf LEFT JOIN hd USING (call_id))"""


@query(f"""{ALL_SQL}, {META_SQL}, {INLINE_SQL}, {DETAILS_SQL}, cs AS (SELECT call_id, arg_max(end_ms, seg_idx) // 1000 AS n FROM seg GROUP BY 1)
SELECT c_custkey AS call_id, 'Report {{}} of ' || c_name || ', ' || c_nationkey || ', F, {{' || c_mktsegment || '}} {{address}} by 미확인 (미확인)' || chr(10) || '2024-01-01 00:00:00 to ' || strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(n, 0)), '%Y-%m-%d %H:%M:%S') || ', ' || coalesce(n, 0) || ' s'
  || chr(10) || coalesce(meta, '분석 데이터 없음') || chr(10) || chr(10) || coalesce(transcript, '') || chr(10) || coalesce(chr(10) || chr(10) || '## 위험요소 사전 감지 정보' || chr(10) || danger_info, '') AS prompt
FROM customer LEFT JOIN cs ON cs.call_id = c_custkey LEFT JOIN ml ON ml.call_id = c_custkey LEFT JOIN il ON il.call_id = c_custkey LEFT JOIN di ON di.call_id = c_custkey AND cs.call_id IS NOT NULL""")
def prompt_build(spark, d):
    """Prompts of all calls, also of those without segments. What several steps read is made once."""
    seg, beside = settle(C.segments(spark, d), "segments"), settle(prosody.enriched(C.measured(spark, d)), "beside")
    voices = settle(prosody.speaker_summary(beside), "voices")
    found = settle(workloads.danger_job(seg, emotion.emotion_by_speaker(_emotions(spark, d)), voices, DANGER, MOOD_RULES), "found")
    calls = _people(spark, d).join(segments.call_spans(seg), "call_id", "left").withColumn("duration_sec", F.coalesce("seconds", F.lit(0)))
    start, end = report.visit_window(F.lit("2024-01-01 00:00:00"), F.col("duration_sec"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    calls = calls.select("*", start.alias("start_time"), end.alias("end_time"))
    return workloads.prompt_job(calls, seg, _numbered(beside), voices, found, TEMPLATE, keywords=MANAGER, suffixes=SUFFIXES)


@query(f"""{ALL_SQL}, {DETAILS_SQL} SELECT call_id, danger_info IS NOT NULL AS detected, coalesce(CAST(danger_info AS VARCHAR), '') AS danger_info FROM (SELECT DISTINCT call_id FROM seg) LEFT JOIN di USING (call_id)""")
def danger_json(spark, d):
    found = speakers.danger_json(_found(spark, d))
    return found.select("call_id", F.col("danger_info").isNotNull().alias("detected"), F.coalesce("danger_info", F.lit("")).alias("danger_info"))


@query(f"""WITH {C.SEGMENTS_SQL}, c AS (SELECT call_id, string_agg('[' || {CLOCK.format('start_ms')} || ' --> ' || {CLOCK.format('end_ms')} || '] ' || text, chr(10) ORDER BY seg_idx) AS transcript, arg_max(end_ms, seg_idx) // 1000 AS seconds FROM seg GROUP BY 1)
SELECT call_id, CASE WHEN call_id % 7 = 0 THEN to_json({{'success': false, 'message': '오디오 처리 실패', 'data': NULL, 'error': CASE WHEN call_id % 14 = 0 THEN 'x' ELSE '알 수 없는 오류' END}})
  ELSE to_json({{'success': true, 'message': '오디오 처리 완료 (v2)', 'data': {{{", ".join(f"'{c}': {dict(transcript='transcript', audio_duration='seconds').get(c) or json_default(x)}" for c, x in RESULT_DEFAULTS.items())}}}}}) END AS document FROM c""")
def result_envelope(spark, d):
    rows = segments.call_spans(C.segments(spark, d)).withColumnRenamed("seconds", "audio_duration").join(transcript_plain(spark, d), "call_id")
    rows = rows.withColumn("success", F.when(F.col("call_id") % 7 == 0, False).when(F.col("call_id") % 7 == 1, True)).withColumn("error", F.when(F.col("call_id") % 14 == 0, "x"))
    return report.envelope(rows)


def _texts(source: str, name: str, who: str) -> str:
    return f"string_agg('[' || {CLOCK.format('start_ms')} || ' --> ' || {CLOCK.format('end_ms')} || '] ' || {who} || text, chr(10) ORDER BY {source}.seg_idx) AS {name}"


PARTS = ["transcript", "transcript_labeled", "transcript_enriched", "speaker_roles", "emotions", "voices", "flags", "n_segments", "n_speakers", "seconds"]


@query(f"""{ALL_SQL}, {SHOWN_SQL}, tx AS (SELECT named.call_id, {_texts('named', 'transcript', "''")}, {_texts('named', 'transcript_labeled', "'[' || sp || '] '")}, {_texts('named', 'transcript_enriched', "'[' || role || '] '")},
  count(*) AS n_segments, count(DISTINCT sp) AS n_speakers, arg_max(end_ms, seg_idx) // 1000 AS seconds FROM named JOIN ro ON named.call_id = ro.call_id AND sp = ro.speaker GROUP BY 1)
SELECT tx.call_id, tx.call_id % 7 <> 0 AS success, {", ".join(f"CASE WHEN tx.call_id % 7 <> 0 THEN {'coalesce(flags, chr(39)||chr(39))' if c == 'flags' else c} END AS {c}" for c in PARTS)}, CASE WHEN tx.call_id % 7 = 0 THEN 'x' END AS error
FROM tx LEFT JOIN rm USING (call_id) LEFT JOIN em USING (call_id) LEFT JOIN vm USING (call_id) LEFT JOIN fo USING (call_id)""".replace("chr(39)||chr(39)", "''"))
def api_record(spark, d):
    """All parts of each call's record; every seventh call failed."""
    seg = C.segments(spark, d)
    calls = seg.select("call_id").distinct().withColumn("error", F.when(F.col("call_id") % 7 == 0, "x"))
    named = lambda rows, name: rows.withColumnRenamed("transcript", name)
    texts = transcript_plain(spark, d), named(transcript_speakers(spark, d), "transcript_labeled"), named(transcript_labeled(spark, d), "transcript_enriched")
    flags = _found(spark, d).select("call_id", F.array_join("flags", ", ").alias("flags"))
    out = report.api_record(calls, *texts, *_by_call(spark, d), flags, segments.call_spans(seg))
    shown = {"speaker_roles": _shown("speaker_roles"), "emotions": _shown("emotions", "dominant_emotion"), "voices": _shown("voices", "voice_description")}
    return out.select("call_id", "success", *(shown.get(c, F.col(c)).alias(c) for c in PARTS), "error")


ANSWER = """CASE call_id % 4 WHEN 0 THEN concat('x {"대화요약": "', call_id, '", "시니어의 대화 분위기, 톤": "old", "위험요소": {"감지여부": true, "내용": ["a"]}}') WHEN 1 THEN '{"대화시간_초": "7분", "매니저": {"이름": "m"}, "more": {"b": [1, null]}}' WHEN 2 THEN 'none' ELSE '{"매니저의 대화 분위기, 톤": "old"}' END"""
SUMMED = "CASE WHEN call_id % 4 = {0} THEN {1} END"


@query(f"""{TONES_SQL}, tn AS (SELECT ro.call_id, max(tone) FILTER (role = '매니저') AS mt, max(voice_description) FILTER (role = '매니저') AS mv, max(tone) FILTER (role = '시니어') AS st, max(voice_description) FILTER (role = '시니어') AS sv
  FROM ro LEFT JOIN mo USING (call_id, speaker) LEFT JOIN vo USING (call_id, speaker) GROUP BY 1), rs AS (SELECT *, CASE WHEN call_id % 4 = 3 THEN 'old' END AS mo_, CASE WHEN call_id % 4 = 0 THEN 'old' END AS so_ FROM tn)
SELECT call_id, {SUMMED.format(0, 'CAST(call_id AS VARCHAR)')} AS summary, {SUMMED.format(1, "'7분'")} AS seconds, {SUMMED.format(1, "'" + '{"b":[1,null]}' + "'")} AS more, {SUMMED.format(1, "'m'")} AS manager, {SUMMED.format(2, "'none'")} AS raw_response,
  CASE WHEN mv IS NULL THEN coalesce(mt, mo_) ELSE coalesce(mt, mo_, '') || ' (' || mv || ')' END AS manager_tone, CASE WHEN sv IS NULL THEN coalesce(st, so_) ELSE coalesce(st, so_, '') || ' (' || sv || ')' END AS senior_tone,
  CASE WHEN call_id % 4 = 0 THEN 'a' ELSE 'known' END AS dangers FROM rs""")
def report_fill(spark, d):
    seg = C.segments(spark, d)
    calls = seg.select("call_id").distinct()
    known = calls.withColumn("danger_info", F.lit('{"감지여부": true, "내용": ["known"]}'))
    out = workloads.report_job(calls.withColumn("response", F.expr(ANSWER)), seg, emotion.emotion_by_speaker(_emotions(spark, d)), speaker_summary(spark, d), known, keywords=MANAGER, suffixes=SUFFIXES)
    at = lambda *path: F.try_variant_get("report", "$" + "".join(f"['{x}']" for x in path), "string")
    return out.select(
        "call_id", at("대화요약").alias("summary"), at("대화시간_초").alias("seconds"), F.to_json(F.try_variant_get("report", "$.more", "variant")).alias("more"), at("매니저", "이름").alias("manager"), at("raw_response").alias("raw_response"),
        at("매니저의 대화 분위기, 톤").alias("manager_tone"), at("시니어의 대화 분위기, 톤").alias("senior_tone"), F.array_join(F.try_variant_get("report", "$['위험요소']['내용']", "array<string>"), ",").alias("dangers"),
    )


W1_SQL = f"""WITH RECURSIVE {CLEAN_SQL}, {C.TURNS_SQL},
ck AS (SELECT call_id, chunk_idx AS seg_idx, CAST(round(start * 1000) AS BIGINT) AS start_ms, CAST(round(stop * 1000) AS BIGINT) AS end_ms, text FROM cc WHERE reason IS NULL),
{_given('ck', 'tu', 'ga')}, {_merged('ga')}, {_thinned('mg')}"""
W1_ROLES = ROLES_SQL[ROLES_SQL.index("named AS") :].replace("FROM seg", "FROM kp")


@query(f"""{W1_SQL}, {W1_ROLES} SELECT named.call_id, {_texts('named', 'transcript_plain', "''")}, {_texts('named', 'transcript_labeled', "'[' || sp || '] '")}, {_texts('named', 'transcript_enriched', "'[' || role || '] '")}
FROM named JOIN ro ON named.call_id = ro.call_id AND sp = ro.speaker GROUP BY 1""")
def job_transcripts(spark, d):
    """Chunks and turns to three transcripts of each call."""
    return workloads.transcript_job(C.chunks(spark, d), C.turns(spark, d), keywords=MANAGER, suffixes=SUFFIXES)


@query(f"""{W1_SQL} SELECT call_id, n_chunks, n_cleaned, n_cleaned - m AS n_merged, m - k AS n_removed, k AS n_segments, s AS n_speakers
FROM (SELECT call_id, count(*) AS n_chunks, count(*) FILTER (reason IS NULL) AS n_cleaned FROM cc GROUP BY 1) LEFT JOIN (SELECT call_id, count(*) AS m FROM mg GROUP BY 1) USING (call_id)
LEFT JOIN (SELECT call_id, count(*) AS k, count(DISTINCT coalesce(speaker, 'UNKNOWN')) AS s FROM kp GROUP BY 1) USING (call_id) WHERE m IS NOT NULL
UNION ALL SELECT call_id, count(*), 0, 0, 0, 0, 0 FROM cc GROUP BY 1 HAVING count(*) FILTER (reason IS NULL) = 0""")
def run_counters(spark, d):
    cleaned = segments.clean_chunks(C.chunks(spark, d))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long").alias(f"{c}_ms")
    rows = cleaned.where("reason IS NULL").select("call_id", F.col("chunk_idx").alias("seg_idx"), ms("start"), ms("end"), "text")
    merged = segments.merge_adjacent(segments.assign_speakers(rows, C.turns(spark, d)))
    return segments.counters(cleaned, merged, segments.drop_repeats(merged))


TEXTS = ["transcript_plain", "transcript_labeled", "transcript_enriched"]


@query(f"SELECT call_id, error IS NULL AS success, {', '.join(f'CASE WHEN error IS NULL THEN {c} END AS {c}' for c in TEXTS)}, error FROM ({SQL['duration_gate']}) LEFT JOIN ({SQL['job_transcripts']}) USING (call_id)")
def job_gated(spark, d):
    """Transcripts of the calls that aren't too long, and the others' errors."""
    calls = C.segments(spark, d).groupBy("call_id").agg((F.max("end_ms") / 1000).alias("duration_sec"))
    return workloads.gated_transcript_job(calls, C.chunks(spark, d), C.turns(spark, d), 20, keywords=MANAGER, suffixes=SUFFIXES)


COUNTED = ["n_chunks", "n_cleaned", "n_merged", "n_removed", "n_segments", "n_speakers"]


@query(f"SELECT {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}' for c in COUNTED)} FROM ({SQL['run_counters']})")
def run_metrics(spark, d):
    """Counters of the transcript job over all calls, observed while it runs."""
    out, seen = workloads.watched_transcript_job(C.chunks(spark, d), C.turns(spark, d), keywords=MANAGER, suffixes=SUFFIXES)
    out.write.format("noop").mode("overwrite").save()
    found = seen.get()
    return spark.createDataFrame([tuple(found[c] for c in COUNTED)], ", ".join(f"{c} long" for c in COUNTED))


@query(SQL["job_transcripts"])
def stream_transcripts(spark, d):
    """The same of a stream of turns of speech, call by call as they arrive."""
    raw = C.table(spark, d, "conversations")  # a pattern, as one file is no folder to watch
    said = spark.readStream.schema(raw.schema).parquet(f"{d}/conversation[s].parquet").withColumn("call_id", F.col("conv_id"))

    def job(rows, keep):
        seg = C.segments_of(rows["said"])
        return {"transcripts": workloads.transcript_job(C.chunks_of(seg), C.turns_of(seg), keywords=MANAGER, suffixes=SUFFIXES)}

    folder = new_folder(spark, "stream")
    stream_whole_calls(spark, {"said": said}, job, f"{folder}/out", f"{folder}/state").awaitTermination()
    return latest(spark, f"{folder}/out", "transcripts")


W2_SQL = f"WITH {PROSODY_SQL}, sq AS (SELECT call_id, seg_idx, speaker, pitch_mean AS pitch, pitch_std AS std, energy_mean AS energy, energy_level AS el, speech_rate AS sr FROM sp WHERE pitch_level <> 'unknown'), {_enriched('sq', 'el', 'sr')}"


@query(f"{W2_SQL} SELECT sg.call_id, sg.seg_idx, sg.speaker, {MEASURES} FROM sg LEFT JOIN en USING (call_id, seg_idx)")
def job_voices(spark, d):
    """Frames and segments to each segment's voice beside its speaker's own."""
    beside, _ = workloads.voice_job(C.frames(spark, d), C.spans(spark, d, "segments"), 2)
    return beside.select("call_id", "seg_idx", "speaker", *MEASURES.split(", "))


@query(f"{W2_SQL}, {SUMMARY_SQL} SELECT * FROM vo")
def job_voice_summaries(spark, d):
    return workloads.voice_job(C.frames(spark, d), C.spans(spark, d, "segments"), 2)[1]
