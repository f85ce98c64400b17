"""A one-hash bitmap of bounded size that tells tasks which 64-bit keys can be skipped.

It never decides a result: a key it lets through without need is only extra work. Its size
follows the number of keys up to MOST_BITS (16 MB), whatever the input's size.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 27


def bitmap(keys: DataFrame, column: str, count: int, each: int = 8) -> np.ndarray:
    """The bits of the keys in ``column`` (long), as uint64 words: ``each`` or more of them per key."""
    bits = 1 << 13
    while bits < min(MOST_BITS, each * count):
        bits *= 2
    at = keys.select(F.pmod(F.col(column), F.lit(bits)).alias("at"))
    words = at.select(F.expr("int(at div 64)").alias("word"), F.expr("shiftleft(1L, int(at % 64))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bit").to_numpy()
    return out.view(np.uint64)


def held(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys may be in the bitmap."""
    at = keys & np.uint64(len(words) * 64 - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
