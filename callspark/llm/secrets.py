"""Secret scans that link the parts of a credential.

Sure findings are reported on sight: assignments to a secret's name, access identifiers of the
AKIA form and long hexadecimal runs. Weak candidates (a user name or client id, a short password
or a token-like word, an endpoint) are each too common to report. Within a document the intervals
of candidates are joined with those of complementary parts, sure ones included, whose scopes
(SCOPE code points around them) meet; only candidates with such a partner are reported.

Everything is a native expression on the row: the matches of a pattern, and the lengths of what
lies between them, give spans in code points. Spans of one kind are disjoint and in order, so
the interval join bisects them: n log n for n candidates of a text. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 200
QUOTE = "[\"']?"
NAMED = rf"{QUOTE}\x20*[:=]\x20*{QUOTE}"
#: Kinds in order: name, pattern, group whose length counts, least length.
SURE = (
    ("assign", rf"(?i)(password|passwd|secret|token|api_?key){NAMED}([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
WEAK = (
    ("identifier", rf"(?i)(?:user_?name|user_?id|user|login|account_?id|client_?id|access_?key_?id){NAMED}[A-Za-z0-9@._-]+", 0, 6),
    ("secret", rf"(?i)(?:pass|pwd|passwd|password|secret|secret_?access_?key|client_?secret|auth|token){NAMED}[A-Za-z0-9+/_.=-]+", 0, 10),
    ("blob", r"[A-Za-z0-9+/]{40,}", 0, 40),
    ("account", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0, 6),
    ("endpoint", r"(?i)(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+", 0, 8),
)
KINDS = [k[0] for k in SURE + WEAK]
#: What a weak kind needs beside it.
PARTNERS = {
    "identifier": ("secret", "blob", "assign", "hex"),
    "secret": ("identifier", "account", "access", "endpoint"),
    "blob": ("identifier", "account", "access", "endpoint"),
    "account": ("secret", "assign"),
    "endpoint": ("secret", "blob", "assign", "access", "hex"),
}
#: Strings of which a text holds one wherever the pattern of a kind matches; other texts aren't searched.
HINTS = {"assign": ":=", "access": ["AKIA"], "identifier": ":=", "secret": ":=", "account": "@", "endpoint": ["://"]}
#: Spans that one fold builds; a fold copies what it has built so far.
LOT = 256
SPAN = "struct<start:long,rank:int,end:long,kind:string>"


def _matches(kind: str, pattern: str) -> Column:
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    if kind not in HINTS:
        return found
    return F.when(_any(*(F.contains("text", F.lit(x)) for x in HINTS[kind])), found).otherwise(F.array().cast("array<string>"))


def _spans(rows: DataFrame, kind: str, pattern: str, group: int, least: int) -> DataFrame:
    """``rows`` with the spans of a kind in place of its matches.

    Matches are folded in lots, each from where its lot begins in the text, because a fold copies
    what it has built at every step.
    """
    m, rank = f"m_{kind}", KINDS.index(kind)
    rows = rows.withColumn("pieces", F.when(F.size(m) > 0, F.split("text", pattern, -1))).withColumn("pattern", F.lit(pattern))
    length = f"length(regexp_extract(m, pattern, {group}))" if group else "length(m)"
    each = f"zip_with({m}, slice(pieces, 1, size({m})), (m, gap) -> struct(bigint(length(gap)) AS gap, bigint(length(m)) AS size, {length} >= {least} AS whole))"
    rows = rows.withColumn(m, F.expr(f"if(size({m}) > 0, {each}, NULL)"))
    rows = rows.withColumn(m, F.expr(f"if({m} IS NULL, NULL, transform(sequence(0, int((size({m}) - 1) div {LOT})), k -> slice({m}, k * {LOT} + 1, {LOT})))"))
    ends = f"transform({m}, lot -> aggregate(lot, 0L, (at, x) -> at + x.gap + x.size))"
    rows = rows.withColumn("begin", F.expr(f"if({m} IS NULL, NULL, aggregate({ends}, array(0L), (seen, n) -> concat(seen, array(element_at(seen, -1) + n))))"))
    span = f"named_struct('start', s.at + x.gap, 'rank', {rank}, 'end', s.at + x.gap + x.size, 'kind', '{kind}')"
    step = f"named_struct('at', s.at + x.gap + x.size, 'spans', if(x.whole, concat(s.spans, array({span})), s.spans))"
    none = f"cast(array() AS array<{SPAN}>)"
    folded = f"transform({m}, (lot, k) -> aggregate(lot, named_struct('at', get(begin, k), 'spans', {none}), (s, x) -> {step}, s -> s.spans))"
    return rows.withColumn(kind, F.expr(f"if({m} IS NULL, {none}, flatten({folded}))")).drop(m, "begin", "pieces", "pattern")


def _beside(kind: str, scope: int) -> str:
    """Whether a span of ``kind`` lies within ``scope`` of span w: the last that begins before its scope ends decides."""
    middle = "int((s.low + s.high) div 2)"
    halve = f"CASE WHEN s.low >= s.high THEN s WHEN get({kind}, {middle}).start < w.end + {scope} THEN struct({middle} + 1 AS low, s.high AS high) ELSE struct(s.low AS low, {middle} AS high) END"
    below = f"aggregate(sequence(1, length(bin(size({kind})))), struct(0 AS low, size({kind}) AS high), (s, i) -> {halve}, s -> s.low)"
    return f"(size({kind}) > 0 AND coalesce(get({kind}, {below} - 1).end + {scope} > w.start, false))"


def scanned(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, base, spans): sure spans, and those with the linked weak ones, of each row.

    ``docs`` needs doc_id and text; other columns are ignored. Spans are
    struct(start, rank, end, kind) in code points, end exclusive, by start and then kind. Matches
    of one kind don't overlap, leftmost first. A weak span that overlaps a sure one is not reported
    again, but is a partner of others. Null texts count as empty: no spans. Rows that repeat are
    scanned each; an empty table gives an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *(_matches(k, p).alias(f"m_{k}") for k, p, _, _ in _patterns()))
    for pattern in _patterns():
        rows = _spans(rows, *pattern)

    def linked(kind: str) -> Column:
        again = " OR ".join(_beside(k, 0) for k, *_ in SURE)
        near = " OR ".join(_beside(k, scope) for k in PARTNERS[kind])
        return F.expr(f"if(size({kind}) > 0, filter({kind}, w -> NOT ({again}) AND ({near})), {kind})").alias(kind)

    rows = rows.select("doc_id", *(k for k, *_ in SURE), *(linked(k) for k, *_ in WEAK))
    return rows.select("doc_id", F.array_sort(F.concat(*(k for k, *_ in SURE))).alias("base"), F.array_sort(F.concat(*KINDS)).alias("spans"))


def _any(*flags: Column) -> Column:
    out = flags[0]
    for f in flags[1:]:
        out = out | f
    return out


def _patterns() -> list[tuple[str, str, int, int]]:
    """All kinds; runs of at least n characters are asked for where that finds the same matches."""
    fast = {"access": (r"AKIA[A-Z0-9]{14,}", 0, 18), "hex": (r"[0-9a-f]{16,}", 0, 16)}
    return [(k, *fast.get(k, (p, g, n))) for k, p, g, n in SURE + WEAK]


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    out = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *(count(k) for k, _, _, _ in SURE), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


QUERIES = {"op9_secret_scan": op9_secret_scan}


def _found(kind: str, pattern: str, group: int, least: int) -> str:
    """The spans of one kind in DuckDB."""
    p, rank = "'" + pattern.replace("'", "''") + "'", KINDS.index(kind)
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m, CAST(sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS BIGINT) AS s
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, {p})) AS m, unnest(string_split_regex(text, {p})) AS gap, unnest(range(length(text) + 2)) AS i FROM d WHERE regexp_matches(text, {p}))
  WHERE m IS NOT NULL QUALIFY length(regexp_extract(m, {p}, {group})) >= {least}"""


_PAIRS = ", ".join(f"('{k}', '{p}')" for k, ps in PARTNERS.items() for p in ps)
SQL = {
    "op9_secret_scan": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join(_found(*k) for k in SURE + WEAK)}),
a AS (SELECT doc_id, rank, kind, s, s + length(m) AS e FROM f),
pair(kind, partner) AS (VALUES {_PAIRS}),
weak AS (SELECT DISTINCT w.* FROM a w JOIN pair USING (kind) JOIN a p ON p.doc_id = w.doc_id AND p.kind = partner AND p.s - {SCOPE} < w.e AND w.s < p.e + {SCOPE}
  WHERE NOT EXISTS (SELECT 1 FROM a x WHERE x.doc_id = w.doc_id AND x.rank < {len(SURE)} AND x.s < w.e AND w.s < x.e)),
base AS (SELECT * FROM a WHERE rank < {len(SURE)}),
b AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in SURE)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS t FROM base GROUP BY 1),
l AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS t FROM (FROM base UNION ALL FROM weak) GROUP BY 1)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, *_ in SURE)}, sha256(coalesce(b.t, '')) AS base_sha256, coalesce(l.t, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN l USING (doc_id)
""",
}
