"""Phrase collocations: candidates by sketch upper bounds, counted exactly by Aho-Corasick automata.

A count-min sketch bounds how often each phrase of a language occurs from above. It has a cell for so
many words, so that it doesn't fill up as the corpus grows, and is kept in parts by hash: tasks
send each part the hashes that they meet, with counts up to ``least``, and no task holds more
than one part. What is sent back to tasks is one bit a cell: whether ``least`` is reached.
Words and pairs are sketched first; longer phrases only where all pairs in them passed, in a
sketch of their own. Phrases that pass are candidates: all with enough occurrences, and a few others.
They are gathered from a part of the texts first; tasks on the rest don't spell those again.

Candidates are sorted and cut into lots of LOT. For each lot, every task compiles an automaton from
them and counts all matches in its texts, overlapping ones too; texts of other languages than the
lot's are left out. Texts and phrases are spelt in a
short alphabet for that: each word of a candidate has a code of as many letters, the first of
which starts no other place of a code and so delimits words, and all other words and the ends of
pieces are a letter that no phrase has. Summed counts are exact (words are told apart by 64-bit
hashes), so candidates under ``least`` go. Everything after that works on the phrases that are
left, by joins and grouped sums.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import groupby, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, unsettle
from .textops import LOWER, U, chunks, grams, hashes, kinds, mix, powers, words

DELIMITERS = ".,;:!?\x0a\x0b\x0c\x0d"
DELIMITER = kinds(*((ord(c), ord(c)) for c in DELIMITERS))
WORD = ~(DELIMITER | kinds((0x20, 0x20), (0x09, 0x09)))
WORDS = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
LONGEST = 4
#: Cells of each of the ROWS rows of a sketch, at least and at most, and those of a part of it (2^16 at most).
WIDTH, WIDEST, ROWS, BLOCK = 1 << 23, 1 << 28, 4, 1 << 15
#: Words for each cell, of ``least``: a word and the pair that it begins fill four fifths of it at most, on average.
FILL = 0.4
#: Hashes that a task gathers before it sends them, and phrases.
HELD, SPELT = 1 << 21, 1 << 19
#: The part of the texts that is searched for candidates first is one in EARLY; candidates found there that tasks on the rest are told of, at most.
EARLY, KNOWN = 8, 1 << 22
#: Phrases that the automaton of one pass over the texts holds.
LOT = 1 << 20
#: Ranges of hashes in which candidates of all tasks meet.
BUCKETS = 256
#: Letters of a place of a word's code: nodes of the automaton have no more children.
BASE = 64
UND = "und"
#: Parts of a language that are ranked by themselves first.
SALTS = 16


def _languages(column: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    codes = column.fill_null(UND).dictionary_encode()
    names = [x.encode() for x in codes.dictionary.to_pylist()]
    ends = np.cumsum([0, *map(len, names)])
    own = hashes(np.frombuffer(b"".join(names) or b"-", np.uint8), ends[:-1], ends[1:])
    # Not the hash of the same text as a word: words are told apart by both, in either order.
    return mix(own + U(0x9E3779B97F4A7C15))[codes.indices.to_numpy()]


def _words(lang: pa.Array, text: pa.Array):
    """Of each group of rows: its bytes, row of the first, starts, ends, rows, pieces and hashes of words, and the hash of each row's language."""
    languages = _languages(lang)
    for first, last, data, offsets in chunks(text):
        data = LOWER[data]
        starts, ends, row = words(data, offsets, WORD)
        pieces = np.cumsum(DELIMITER[data])
        piece = pieces[starts] + row * (len(data) + 1) if len(starts) else row
        yield data, first, starts, ends, row, piece, hashes(data, starts, ends), languages[first:last]


def _phrases(piece: np.ndarray, row: np.ndarray, h: np.ndarray, languages: np.ndarray, lengths):
    """For each length the hashes of the phrases of so many words, and their first words."""
    for n in lengths:
        g = grams(h, n)
        at = np.flatnonzero(piece[: len(g)] == piece[n - 1 :]) if len(g) else np.zeros(0, np.int64)
        yield mix(g[at] ^ languages[row[at]]), at


def _blocks(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of the sketch of each hash; larger hashes have no smaller parts."""
    return (h >> U(32)) * U(parts) >> U(32)


def _cells(h: np.ndarray):
    """For each row the cells of hashes within their part of the sketch, by their lower 32 bits."""
    x = mix(h & U(0xFFFFFFFF))
    for row in range(ROWS):
        yield (x >> U(16 * row) & U(BLOCK - 1)).astype(np.int64) + row * BLOCK


def _passed(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes' upper bounds reach the least."""
    out, size = np.ones(len(h), bool), ROWS * BLOCK
    first = _blocks(h, len(bits) * 8 // size).astype(np.int64) * size
    for cell in _cells(h):
        cell += first
        out &= (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _longer(piece, row, h, languages, bits: np.ndarray):
    """As :func:`_phrases`, of three and more words of which all pairs passed ``bits``."""
    ((pairs, at),) = _phrases(piece, row, h, languages, [2])
    good = np.zeros(len(h) + LONGEST, bool)
    good[at[_passed(bits, pairs)]] = True
    for n in range(3, LONGEST + 1):
        good = good[:-1] & good[1:]
        at = np.flatnonzero(good)
        # Pairs that follow each other are in one piece.
        g = np.zeros(len(at), U)
        p = powers(n + 1)
        for i in range(n):
            g += h[at + i] * p[i + 1]
        yield mix(mix(g + U(n)) ^ languages[row[at]]), at


def _rows(batches):
    """The rows of batches as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


CELLS = "block int, few boolean, cells binary"


def _sent(cells: np.ndarray):
    """An array of counts as rows of CELLS: the blocks with any, as they are or, where few are set, as places and counts."""
    for k in range(-(-len(cells) // BLOCK)):
        block = cells[k * BLOCK : (k + 1) * BLOCK]
        at = np.flatnonzero(block)
        if len(at):
            few = len(at) * (2 + block.itemsize) < block.nbytes
            data = at.astype(np.uint16).tobytes() + block[at].tobytes() if few else block.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([few]), pa.array([data], pa.binary())], ["block", "few", "cells"])


def _added(batches, kind: np.dtype):
    """(block, counts) of rows of CELLS in order of block, one row held at a time."""
    for k, met in groupby(_rows(batches), itemgetter(0)):
        total = np.zeros(BLOCK, np.int64)
        for _, few, data in met:
            if few:
                n = len(data) // (2 + kind.itemsize)
                total[np.frombuffer(data[: 2 * n], np.uint16)] += np.frombuffer(data[2 * n :], kind)
            else:
                part = np.frombuffer(data, kind)
                total[: len(part)] += part
        yield k, total


def _tallied(held: list, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts, ``least`` at most, of several such pairs."""
    h, n = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.minimum(np.add.reduceat(n[order], first, dtype=np.int64), least).astype(n.dtype)


def sketched(docs: DataFrame, least: int, parts: int, bits=None) -> np.ndarray:
    """One bit for each cell of the count-min sketch, in ``parts``, of ``docs(lang, text)``: whether it reaches ``least``.

    Without ``bits`` the sketch is of words and pairs, else of longer phrases whose pairs pass them.
    """
    kind = np.dtype(np.uint8) if least < 256 else np.dtype(np.uint32)

    def send(h, n):
        blocks = _blocks(h, parts)
        first = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
        low = h.astype(np.uint32)
        data = [low[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(h)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(blocks[first].astype(np.int32)), pa.array(data, pa.binary())], ["block", "cells"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, _, _, row, piece, h, languages in _words(batch.column(0), batch.column(1)):
                for found, _ in _phrases(piece, row, h, languages, [1, 2]) if bits is None else _longer(piece, row, h, languages, bits.value):
                    found, n = np.unique(found, return_counts=True)
                    held.append((found, np.minimum(n, least).astype(kind)))
                    size += len(found)
                if size > HELD:
                    held = [_tallied(held, least)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield send(*held[0])
                        held, size = [], 0
        if size:
            yield send(*_tallied(held, least))

    def add(batches):
        for k, met in groupby(_rows(batches), itemgetter(0)):
            total = np.zeros(ROWS * BLOCK, np.int64)
            for _, data in met:
                n = len(data) // (4 + kind.itemsize)
                counts = np.frombuffer(data[4 * n :], kind).astype(np.int64)
                for cell in _cells(np.frombuffer(data[: 4 * n], np.uint32).astype(U)):
                    np.add.at(total, cell, counts)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], ["block", "bits"])

    sent = docs.select("lang", "text").mapInArrow(run, "block int, cells binary")
    met = sent.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, bits binary").toArrow()
    out = np.zeros((parts, ROWS * BLOCK // 8), np.uint8)
    for batch in met.to_batches():
        for k, data in _rows([batch]):
            out[k] = np.frombuffer(data, np.uint8)
    return out.reshape(-1)


def _spelt(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, n: int) -> pa.Array:
    """The phrases of n words from the words ``at``, joined by single spaces."""
    size = np.stack([ends[at + j] - starts[at + j] for j in range(n)])
    offsets = np.concatenate(([0], np.cumsum(size.sum(0) + n - 1)))
    out, place = np.full(offsets[-1], 0x20, np.uint8), offsets[:-1].copy()
    for j in range(n):
        within = np.arange(size[j].sum()) - np.repeat(np.cumsum(size[j]) - size[j], size[j])
        out[np.repeat(place, size[j]) + within] = data[np.repeat(starts[at + j], size[j]) + within]
        place += size[j] + 1
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


def _keys(lang: pa.Array, phrase: pa.Array) -> np.ndarray:
    """The hash of each phrase, as :func:`_phrases` has it."""
    out = np.zeros(len(phrase), U)
    for _, first, _, _, row, piece, h, languages in _words(lang, phrase):
        size = np.bincount(row, minlength=len(languages))
        for n, (g, at) in enumerate(_phrases(piece, row, h, languages, range(1, LONGEST + 1)), 1):
            whole = size[row[at]] == n
            out[first + row[at[whole]]] = g[whole]
    return out


def _within(ordered: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes are among sorted ones."""
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h if len(ordered) else np.zeros(len(h), bool)


def candidates(docs: DataFrame, short, long, known=None) -> DataFrame:
    """(lang, phrase, key, sent) of one to LONGEST words whose bounds, the bits ``short`` and ``long``, reach the least: its hash, and how often it was sent.

    A task sends what it has seen in packed lists of SPELT phrases or somewhat more, one for each language and
    each of BUCKETS ranges of hashes; lists of a range meet and are united. Hashes in ``known`` are left out.
    """

    def packed(names, phrases, keys):
        codes = pa.concat_arrays(names).dictionary_encode()
        phrases, langs = pa.concat_arrays(phrases), codes.dictionary
        group = ((np.concatenate(keys) >> U(32)) % U(BUCKETS)).astype(np.int64) * len(langs) + codes.indices.to_numpy()
        phrases = phrases.take(pa.array(np.argsort(group, kind="stable")))
        kinds, n = np.unique(group, return_counts=True)
        rows = []
        for k, last, size in zip(kinds.tolist(), np.cumsum(n).tolist(), n.tolist(), strict=True):
            listed = "\n".join(sorted(phrases.slice(last - size, size).to_pylist()))
            rows.append((k // len(langs), langs[k % len(langs)].as_py(), zlib.compress(listed.encode(), 1)))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], ["bucket", "lang", "phrases"])

    def run(batches):
        seen, names, phrases, keys = np.zeros(0, U), [], [], []
        for batch in batches:
            langs = batch.column(0).fill_null(UND)
            for data, first, starts, ends, row, piece, h, languages in _words(batch.column(0), batch.column(1)):
                fresh = [seen]
                found = [*_phrases(piece, row, h, languages, [1, 2]), *_longer(piece, row, h, languages, short.value)]
                for n, (g, at) in enumerate(found, 1):
                    g, one = np.unique(g, return_index=True)
                    new = ~_within(seen, g)
                    new[new] = _passed((short if n < 3 else long).value, g[new])
                    if known is not None:
                        new[new] = ~_within(known.value, g[new])
                    if new.any():
                        at = at[one[new]]
                        names.append(langs.take(pa.array(first + row[at])))
                        phrases.append(_spelt(data, starts, ends, at, n))
                        fresh.append(g[new])
                keys += fresh[1:]
                seen = np.sort(np.concatenate(fresh))
                if len(seen) > SPELT:
                    yield packed(names, phrases, keys)
                    seen, names, phrases, keys = np.zeros(0, U), [], [], []
        if keys:
            yield packed(names, phrases, keys)

    def unite(batches):
        for _, met in groupby(_rows(batches), itemgetter(0)):
            times = Counter()
            for _, lang, data in met:
                # No phrase has a line feed.
                times.update(zip(repeat(lang), zlib.decompress(data).decode().split("\n")))
            langs, phrases = (pa.array(x, pa.string()) for x in zip(*times, strict=True))
            yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(_keys(langs, phrases).view(np.int64)), pa.array(times.values(), pa.int64())], ["lang", "phrase", "key", "sent"])

    sent = docs.select("lang", "text").mapInArrow(run, "bucket int, lang string, phrases binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(unite, "lang string, phrase string, key long, sent long")


def most_sent(found: DataFrame) -> np.ndarray:
    """The sorted hashes of KNOWN :func:`candidates` at most, those that were sent most often."""
    often, size = 1, 0
    for sent, n in found.groupBy("sent").count().orderBy(F.col("sent").desc()).toLocalIterator():
        size += n
        if size > KNOWN:
            often = sent + 1
            break
    return np.sort(found.where(F.col("sent") >= often).select("key").toArrow().column("key").to_numpy().view(U))


def _letters(ids: np.ndarray, places: int) -> np.ndarray:
    """The code of each word: a letter for each place, from an alphabet of that place; id -1 is all letter 0."""
    out = np.stack([ids // BASE**k % BASE + 1 + k * BASE for k in range(places)], -1)
    out[ids < 0] = 0
    return out.astype(np.uint32)


def _automaton(lot: dict):
    """(hashes of words, places of a code, automaton of places in the lot), built once in each worker from a broadcast ``lot`` of (id, lang, phrase) columns."""
    import ahocorasick

    if "built" not in lot:
        key, row = [], []
        for _, first, _, _, at, _, h, languages in _words(lot["lang"], lot["phrase"]):
            key.append(mix(h ^ languages[at]))
            row.append(first + at)
        key, row = (np.concatenate(x or [np.zeros(0, U)]) for x in (key, row))
        known, ids = np.unique(key, return_inverse=True)
        places = 1
        while BASE**places < len(known):
            places += 1
        letters = _letters(ids, places).tobytes().decode("utf-32-le")
        bounds = (np.searchsorted(row, np.arange(len(lot["id"]) + 1)) * places).tolist()
        automaton = ahocorasick.Automaton()
        for place, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            automaton.add_word(letters[a:b], place)
        automaton.make_automaton()
        lot["built"] = known, places, automaton
        del lot["lang"], lot["phrase"]
    return lot["built"]


def counted(docs: DataFrame, lot) -> DataFrame:
    """(id, n): occurrences of the phrases of a broadcast ``lot``; a task sends an array of its counts."""

    def run(batches):
        counts = np.zeros(len(lot.value["id"]), np.int64)
        for batch in batches:
            known, places, automaton = _automaton(lot.value)
            for _, _, _, _, row, piece, h, languages in _words(batch.column(0), batch.column(1)):
                if not len(known) or not len(h):
                    continue
                key = mix(h ^ languages[row])
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                ids = np.where(known[at] == key, at, -1)
                # A delimiter where a piece ends, and no more than one where several words are unknown.
                ids = np.insert(ids, np.flatnonzero(np.diff(piece)) + 1, -1)
                ids = ids[np.concatenate(([True], (ids[1:] >= 0) | (ids[:-1] >= 0)))]
                found = map(itemgetter(1), automaton.iter(_letters(ids, places).tobytes().decode("utf-32-le")))
                np.add.at(counts, np.fromiter(found, np.int64), 1)
        yield from _sent(counts)

    def add(batches):
        for k, total in _added(batches, np.dtype(np.int64)):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(lot.value["id"][k * BLOCK + at]), pa.array(total[at])], ["id", "n"])

    sent = docs.select("lang", "text").mapInArrow(run, CELLS)
    return sent.repartition("block").sortWithinPartitions("block").mapInArrow(add, "id long, n long")


def word_totals(docs: DataFrame) -> DataFrame:
    """(lang, n): all words of each language."""
    return docs.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORDS))).cast("long").alias("n"))


def lots(listed: DataFrame) -> list[int]:
    """The first id of each LOT rows of ``listed``, of which monotonically_increasing_id has numbered the rows, and one beyond all."""
    bounds, place = [], 0
    for part, n in listed.groupBy(F.shiftright("id", 33).alias("part")).count().orderBy("part").toLocalIterator():
        bounds += [(part << 33) + k - place for k in range(-(-place // LOT) * LOT, place + n, LOT)]
        place += n
    return [*(bounds or [0]), (1 << 63) - 1]


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of one to LONGEST words that occur ``least`` times or more, and (lang, n) of all words."""
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    send = docs.sparkSession.sparkContext.broadcast
    totals = settle(word_totals(docs), "totals")
    parts = math.ceil(min(max(WIDTH, (totals.agg(F.sum("n")).first()[0] or 0) / (FILL * least)), WIDEST) / BLOCK)
    short = send(sketched(docs, least, parts))
    long = send(sketched(docs, least, parts, short))
    turn = F.pmod(F.xxhash64("text"), F.lit(EARLY))
    early = settle(candidates(docs.where(turn == 0), short, long), "candidates")
    known = send(most_sent(early))
    both = early.unionByName(candidates(docs.where(turn != 0), short, long, known)).select("lang", "phrase").distinct()
    listed = settle(both.orderBy("lang", "phrase").select(F.monotonically_increasing_id().alias("id"), "lang", "phrase"), "candidates")
    short.destroy(), long.destroy(), known.destroy()
    unsettle(early)
    counts, bounds = [], lots(listed)
    for first, after in zip(bounds[:-1], bounds[1:], strict=True):
        rows = listed.where((F.col("id") >= first) & (F.col("id") < after)).toArrow()
        lot = send({"id": rows.column("id").to_numpy(), "lang": rows.column("lang").combine_chunks(), "phrase": rows.column("phrase").combine_chunks()})
        # Candidates are in order of their languages' bytes, as strings are compared.
        low, high = (pc.min_max(rows.column("lang"))[x].as_py() for x in ("min", "max"))
        counts.append(settle(counted(docs.where(F.col("lang").between(low, high)), lot), "counts"))
        lot.destroy()
    met = counts[0]
    for more in counts[1:]:
        met = met.unionByName(more)
    found = listed.join(met.where(F.col("n") >= least).withColumnRenamed("n", "f"), "id")
    found = settle(found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), "f"), "phrases")
    unsettle(listed, *counts)
    return found, totals


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two to four words.

    ``docs`` needs lang and text; other columns are ignored. A-Z is lower-cased, texts are cut at
    DELIMITERS, and words are what spaces and tabs separate. a counts a phrase's occurrences in
    the language (null: und), overlaps included, n all its words. Cutting a phrase in two gives
    l and r, the counts of its parts, and the score 2000000 * a / (l + r), rounded down; the cut with
    the lowest counts, of ties the first. Phrases that occur under ``least`` times don't count,
    nor do those of which a longer counted phrase covers ``percent`` of the occurrences or more.
    Ranks are by score and a, descending, then by the phrase's bytes. Null and empty texts have no
    words; rows that repeat count each; an empty table gives an empty table.
    """
    found, totals = phrase_counts(docs, least)
    w = F.split("phrase", " ")
    cut = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    several = found.where("words > 1")
    cuts = several.select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("first"), cut(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    part = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * 2000000) DIV (CAST(l AS DECIMAL(20, 0)) + r)")
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: cut(i, n))))
    longer = several.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    covered = F.expr(f"CAST(over AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {percent}")
    best = best.join(longer, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # The first of each of SALTS parts first, so that a language's last window has few rows.
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    best = best.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    best = best.withColumn("rank", place("lang", "salt")).where(F.col("rank") <= top).withColumn("rank", place("lang").cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op12_collocations": op12_collocations}
SQL = {
    "op12_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, range(1, 5) r(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 30),
s AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
c AS (SELECT lang, phrase, w, m, f AS a, unnest(range(1, m)) AS k FROM s),
x AS (SELECT c.lang, c.phrase, a, k, p.f AS l, q.f AS r, CAST((CAST(a AS HUGEINT) * 2000000) // (p.f + q.f) AS BIGINT) AS score FROM c
  JOIN f p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:k], ' ') JOIN f q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(f) AS over FROM (SELECT lang, w, f, n, unnest(range(1, m - n + 2)) AS i FROM s, range(2, 4) r(n) WHERE n < m) GROUP BY 1, 2),
k AS (SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE over IS NULL OR 100 * over < 80 * a),
z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000
""",
}
