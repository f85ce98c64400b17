"""Expressions on the text of one segment, and the two vectorised text helpers."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .lexicons import FOREIGN_PHRASES

SPACE = r"(?U)[\s\x{1c}-\x{1f}]+"
#: Code points that n-grams are counted over at a time; sorts of so many stay in a core's cache.
PIECE = 1 << 16


def strip(text: Column) -> Column:
    """The text without white space at its ends, line ends and U+001C to U+001F included."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")


def words(text: Column) -> Column:
    """White-space words; an empty text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def too_short(text: Column, least: int = 3) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) < least


def low_vocabulary(text: Column) -> Column:
    """Over five words of at most two kinds."""
    w = words(text)
    return (F.size(w) > 5) & (F.size(F.array_distinct(w)) <= 2)


def bigram_share(text: Column) -> Column:
    """Share of the most frequent word pair among all pairs of texts of over ten words, else 0.

    Sorted pairs are counted run by run, so a text costs one sort.
    """
    w = words(text)
    pairs = F.array_sort(F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))

    def count(state: Column, pair: Column) -> Column:
        run = F.when(pair == state["last"], state["run"] + 1).otherwise(1)
        return F.struct(pair.alias("last"), run.alias("run"), F.greatest(state["most"], run).alias("most"))

    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most"))
    return F.when(F.size(w) > 10, F.aggregate(pairs, start, count, lambda state: state["most"]) / F.greatest(F.size(w) - 1, F.lit(1))).otherwise(0.0)


@F.pandas_udf(DoubleType())
def ngram_coverage(text: pd.Series) -> pd.Series:
    """Largest n * count / length over n-grams of 2 to 6 characters, of texts of over 12 without spaces.

    Texts are joined to pieces of about PIECE code points; each n-gram length is one sort of a piece's
    n-grams as numbers: the text's place, then the symbols.
    """
    texts = [(t or "").replace(" ", "") for t in text]
    size = np.array([len(t) for t in texts])
    out, ends = np.zeros(len(texts)), np.cumsum(size)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE, "right")))
        out[first:last] = _coverage(texts[first:last], size[first:last])
        first = last
    return pd.Series(out)


def _coverage(texts: list[str], size: np.ndarray) -> np.ndarray:
    best = np.zeros(len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return best
    known = np.zeros(int(code.max()) + 1, bool)
    known[code] = True
    symbols = (np.cumsum(known) - 1)[code]
    row, bits = np.repeat(np.arange(len(texts)), size), int(symbols.max()).bit_length()
    gram, width = row << bits | symbols, len(texts).bit_length() + bits
    for n in range(2, 7):
        if width + bits > 63:  # too many symbols for one number: ranks are shorter, and in the same order
            gram = np.unique(gram, return_inverse=True)[1].astype(np.int64)
            width = len(gram).bit_length()
        gram, width = gram[:-1] << bits | symbols[n - 1 :], width + bits
        found = np.sort(gram[row[: len(gram)] == row[n - 1 :]])
        if not len(found):
            break
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        count = np.diff(first, append=len(found))
        # Sorted n-grams lie text by text.
        held = np.maximum(size - n + 1, 0)
        some = np.flatnonzero(held)
        most = np.maximum.reduceat(count, np.searchsorted(first, (np.cumsum(held) - held)[some]))
        best[some] = np.maximum(best[some], most * n / size[some])
    return np.where(size > 12, best, 0.0)


def is_hallucination(text: Column) -> Column:
    """Short, of few words, or repeating itself; only texts that no cheap rule takes go to Python."""
    cheap = too_short(text) | low_vocabulary(text) | (bigram_share(text) > 0.6)
    return cheap | (ngram_coverage(F.when(~cheap, text)) > 0.5)


def strip_phrases(text: Column, phrases: list[str] = FOREIGN_PHRASES) -> Column:
    """Removes the phrases one after another, then joins words by single spaces."""
    for phrase in phrases:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clip_to_duration(text: Column, seconds: Column, fastest: float = 15, speed: float = 10) -> Column:
    """Cuts texts that no one can say in the time, at the last space past half of what fits.

    Seconds are doubles, as of decimals another rate can be just not too fast: 21 characters in 1.4 s.
    """
    seconds = seconds.cast("double")
    most = (seconds * speed).cast("int")
    head = F.substring(text, F.lit(1), most)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    space = F.when(F.instr(head, " ") > 0, space).otherwise(-1)
    cut = F.when(space > most * 0.5, F.substring(head, F.lit(1), space)).otherwise(head)
    fast = F.when(seconds > 0, F.length(F.replace(text, F.lit(" "), F.lit(""))) / F.when(seconds > 0, seconds) > fastest).otherwise(False)
    return F.when(fast & (most < F.length(text)), cut).otherwise(text)


def clock(seconds: Column, digits: int = 3) -> Column:
    """mm:ss with decimals; the seconds may round up to 60.

    One decimal is rounded from the exact binary value (0.95 s is just under, so 0.9), where
    format_string would round its shortest decimal form; milliseconds never lie between three.
    """
    if digits == 1:
        # Under 60 s, a double times 2^57 is a whole long.
        n = ((seconds % 60) * F.lit(2.0**57)).cast("long").cast("decimal(20,0)") * F.lit(10)
        one = F.lit(1 << 57).cast("decimal(20,0)")
        over = (n % one) * F.lit(2)
        below = ((n - n % one) / one).cast("int")
        tenths = below + F.when((over > one) | ((over == one) & (below % 2 == 1)), 1).otherwise(0)
        return F.format_string("%02d:%02d.%d", F.floor(seconds / 60).cast("int"), F.floor(tenths / 10).cast("int"), tenths % 10)
    return F.format_string(f"%02d:%0{digits + 3}.{digits}f", F.floor(seconds / 60).cast("int"), seconds % 60)


@F.pandas_udf(StringType())
def json_object(text: pd.Series) -> pd.Series:
    """The text if it is one strict JSON value, else null."""

    def one(t):
        try:
            json.loads(t)
            return t
        except (TypeError, ValueError, RecursionError):
            return None

    return text.map(one)


def parse_response(text: Column) -> Column:
    """The JSON of a model's response: a fenced block, or the first { to the last }; else null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    bare = F.when((first > 0) & (F.instr(text, "}") > 0), F.substring(text, first, last - first + 1))
    return F.coalesce(json_object(F.nullif(fenced, F.lit(""))), json_object(bare))
