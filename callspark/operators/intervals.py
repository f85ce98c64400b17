"""Overlap join of intervals by an equi-join on cells of a hierarchy of grids.

Each level's cells are eight times as wide as those of the level before, and the last level has
one cell. An interval is at home on the first level whose cells are as wide as it is long, so it
touches two cells of it at most. Two intervals meet on the coarser one's home level: besides its
home cells, an interval visits its cells (two at most again) on the coarser levels on which the
other side has homes, and on no others. So where all intervals are short, as most are, each is
sent once or twice, and a long one costs as many rows as a short one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Width of the cells of the first level in milliseconds, how much wider each next level's are, and levels with more than one cell.
FINEST, WIDER, LEVELS = 30_000, 8, 7


def level(start: Column, end: Column, finest: int = FINEST) -> Column:
    """The home level of an interval."""
    out = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        out = F.when(end - start <= finest * WIDER**k, k).otherwise(out)
    return out.cast("int")


def _cell(at: Column, on: Column, finest: int) -> Column:
    width = reduce(lambda out, k: F.when(on == k, finest * WIDER**k).otherwise(out), range(LEVELS), F.lit(None).cast("long"))
    return F.coalesce(F.floor(at / width), F.lit(0))


def levels_of(intervals: DataFrame, finest: int = FINEST) -> Column:
    """The home levels of ``intervals(start_ms, end_ms)``, as a subquery: at most LEVELS + 1 numbers."""
    found = intervals.where("start_ms < end_ms").agg(F.collect_set(level(F.col("start_ms"), F.col("end_ms"), finest)).alias("levels"))
    return found.scalar()


def cells(intervals: DataFrame, others: Column, finest: int = FINEST) -> DataFrame:
    """``intervals`` with home, level and cell: a row for each cell at home, and on each coarser level of ``others``. Empty ones have none."""
    rows = intervals.where("start_ms < end_ms").withColumn("home", level(F.col("start_ms"), F.col("end_ms"), finest)).withColumn("others", others)
    coarser = F.filter("others", lambda x: x > F.col("home"))
    rows = rows.withColumn("level", F.explode(F.concat(F.array("home"), coarser))).drop("others")
    return rows.withColumn("cell", F.explode(F.sequence(_cell(F.col("start_ms"), F.col("level"), finest), _cell(F.col("end_ms") - 1, F.col("level"), finest))))


def overlapping(a: DataFrame, b: DataFrame, a_like: DataFrame | None = None, b_like: DataFrame | None = None, finest: int = FINEST) -> DataFrame:
    """Pairs of ``a`` and ``b`` (call_id, start_ms, end_ms) that share a moment, each once: a's columns, then b's with b_start and b_end.

    ``a_like`` and ``b_like`` are tables whose intervals have all home levels of a and b, for where
    those are dear to compute twice. The join is on (call_id, level, cell) and nothing above it
    needs a key's rows together, so adaptive execution splits cells that hold much of a side.
    """
    left = cells(a, levels_of(b if b_like is None else b_like, finest), finest)
    right = cells(b, levels_of(a if a_like is None else a_like, finest), finest).withColumnsRenamed({"start_ms": "b_start", "end_ms": "b_end", "home": "b_home"})
    met = left.join(right, ["call_id", "level", "cell"]).where("start_ms < b_end AND b_start < end_ms AND level = greatest(home, b_home)")
    # A pair that shares two cells is met in the later one, where both have begun.
    met = met.where(F.col("cell") == _cell(F.greatest("start_ms", "b_start"), F.col("level"), finest))
    return met.drop("level", "cell", "home", "b_home")
