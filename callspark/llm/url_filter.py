"""URL filter: host and path rules, and a character language-model ratio for all other URLs.

URLs that a rule allows or blocks are the accepted and the rejected corpus. Each gets a smoothed
variable-order Markov model of characters: contexts of ORDER characters back off, order by order,
to none and then to a uniform choice. A URL's score is the difference of its log-likelihoods under
the two models by characters. The threshold is calibrated on rule-decided URLs that the models
haven't seen: it lies midway between the score that all but MISSED of the accepted ones reach and
the one that all but MISSED of the rejected ones stay below.

All counts cover the whole corpus. They are grouped sums of n-grams, combined before each
shuffle, and a URL meets its n-grams' scores in a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle, unsettle

#: Rules as (verdict, host and path prefix).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER = 5
#: Weight of the shorter context's estimate, in counts; characters that a URL may choose from.
PRIOR, ALPHABET = 2.0, 256.0
MISSED = 0.05
#: Hex digits of the hash of a URL that hold it back for calibration.
HELD = "012"
START = "\x02"
#: Characters of a URL that are taken apart at a time.
PIECE = 1024
#: Contexts up to this order are few and asked for by most grams: each is dealt to so many tasks.
SHORT, SALTS = 2, 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The parts of a URL that rules see; both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"(?s)^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    known = url.isNotNull() & (at > 0)
    return F.when(known, F.translate(host, upper, lower)).otherwise(""), F.when(known, path).otherwise("")


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages(page_id, url)`` with host, path, rule and decided (allow, block or null)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = decided = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, prefix = text.partition("/")
        fits = ((F.col("host") == name) | F.endswith(F.col("host"), F.lit(f".{name}"))) & F.startswith(F.col("path"), F.lit(slash + prefix))
        rule, decided = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(decided)
    return rows.select("*", rule.alias("rule"), decided.alias("decided"))


def _named() -> list[Column]:
    """A URL's name in other tables: 128 bits, however long the URL."""
    told = F.coalesce("url", F.lit("")), F.col("url").isNull()
    return [F.xxhash64(*told).alias("u1"), F.xxhash64(F.lit(1), *told).alias("u2")]


def _grams(rows: DataFrame, *more: str) -> DataFrame:
    """One row for each character of the URL and its end, with the ORDER characters before it; URLs are cut into pieces first."""
    text = F.concat(F.lit(START * ORDER), F.coalesce("url", F.lit("")), F.lit("\x03"))
    starts = F.sequence(F.lit(0), F.floor(F.length(F.coalesce("url", F.lit(""))) / PIECE).cast("int"))
    pieces = rows.select(*more, F.explode(F.transform(starts, lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE + ORDER)))).alias("piece"))
    grams = F.transform(F.sequence(F.lit(1), F.length("piece") - ORDER), lambda i: F.substring(F.col("piece"), i, F.lit(ORDER + 1)))
    return pieces.select(*more, F.explode(grams).alias("gram"))


def _keys(gram: str = "gram") -> Column:
    """Of a gram: for each order the context (c) and the context with its character (g)."""
    out = []
    for k in range(ORDER + 1):
        whole = F.substring(gram, ORDER + 1 - k, k + 1)
        out += [F.struct(F.lit(k).alias("k"), F.lit("g").alias("what"), whole.alias("key")), F.struct(F.lit(k).alias("k"), F.lit("c").alias("what"), F.substring(whole, 1, k).alias("key"))]
    return F.array(*out)


def gram_scores(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """(gram, ratio) for each of ``grams(gram)``, from ``counts(gram, allow, block)``."""
    totals = counts.select("allow", "block", F.explode(_keys()).alias("x")).groupBy("x.k", "x.what", "x.key").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    asked = grams.select("gram", F.explode(_keys()).alias("x")).select("gram", "x.*")
    asked = asked.withColumn("salt", F.when(F.col("k") <= SHORT, F.pmod(F.xxhash64("gram"), F.lit(SALTS))).otherwise(0).cast("int"))
    totals = totals.withColumn("salt", F.explode(F.when(F.col("k") <= SHORT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    met = asked.join(totals, ["k", "what", "key", "salt"], "left")
    by = lambda what, k, side: F.coalesce(F.max(F.when((F.col("what") == what) & (F.col("k") == k), F.col(side))), F.lit(0)).alias(f"{what}{k}{side}")
    wide = met.groupBy("gram").agg(*(by(w, k, s) for w in "gc" for k in range(ORDER + 1) for s in ("allow", "block")))

    def log(side: str) -> Column:
        p = reduce(lambda p, k: (F.col(f"g{k}{side}") + PRIOR * p) / (F.col(f"c{k}{side}") + PRIOR), range(ORDER + 1), F.lit(1 / ALPHABET))
        return F.log(p)

    return wide.select("gram", (log("allow") - log("block")).alias("ratio"))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of ``pages``.

    ``pages`` needs page_id and url; other columns are ignored. The longest rule that fits wins;
    URLs without one are allowed if their score reaches the threshold. score is null where a rule
    decided. A null URL counts as empty. Where the rules decide no URL, or none of one kind, the
    ratio still holds (the empty model is uniform), and with none of a kind to calibrate on the
    threshold is 0. Rows that repeat are counted and judged each; an empty table gives an empty
    table.
    """
    pages = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = ruled(pages, rules)
    held = F.substring(F.md5(F.coalesce("url", F.lit(""))), 1, 1).isin(*HELD)
    # One row for each URL: copies count, but are scored once.
    urls = settle(rows.groupBy("url", "decided").agg(F.count("*").alias("n")).select("*", held.alias("held"), *_named()), "urls")
    learn = _grams(urls.where("decided is not null and not held"), "decided", "n")
    side = lambda d: F.sum(F.when(F.col("decided") == d, F.col("n")).otherwise(0)).alias(d)
    counts = learn.groupBy("gram").agg(side("allow"), side("block"))
    asked = urls.where("decided is null or held")
    grams = settle(_grams(asked, "u1", "u2"), "grams")
    ratios = gram_scores(counts, grams.select("gram").distinct())
    scores = grams.join(ratios, "gram").groupBy("u1", "u2").agg((F.sum(F.round(F.col("ratio") * 1e6).cast("long")) / F.count("*") / 1e6).alias("score"))
    scores = settle(scores, "scores")
    known = urls.where("held and decided is not null").join(scores, ["u1", "u2"])
    at = lambda d, p: F.percentile_approx(F.when(F.col("decided") == d, F.col("score")), p, 10_000)
    low, high = known.agg(at("allow", MISSED), at("block", 1 - MISSED)).first()
    line = 0.0 if low is None or high is None else (low + high) / 2
    unsettle(urls, grams)
    scores = scores.withColumnsRenamed({"u1": "s1", "u2": "s2"})
    rows = rows.select("*", *_named())
    out = rows.join(scores, F.col("decided").isNull() & (rows["u1"] == scores["s1"]) & (rows["u2"] == scores["s2"]), "left")
    verdict = F.coalesce("decided", F.when(F.col("score") >= line, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    """The query: every page's URL."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op1_url_filter": op1_url_filter}
SQL: dict[str, str] = {}
