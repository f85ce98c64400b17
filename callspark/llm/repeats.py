"""Substring dedup and line dedup by seeds over winnowed anchors.

A unit is a word or a line. Each window of ``window`` units selects the smallest hash among its
runs of ``seed`` units (the rightmost of ties), so equal windows select equal anchors: a repeat
of ``window`` units can't be missed. Occurrences of an anchor that is in the corpus more than once
meet by its hash. Each brings the units to its left and right that its windows reach. For each
way a window can lie about the anchor, occurrences whose units agree over it are found by a hash
of them, and then unit by unit: of these, all but the first are repeats. So an occurrence is
held against all earlier ones at once, and no pair of them is extended by itself. Windows that
overlap or touch unite to the runs that go, which are the maximal repeats of ``window`` units or more.

Occurrences that agree inside one Arrow batch are settled there, so a passage of every document
sends few of them to its anchor's task. Anchors that are more than a small share of all are hot:
their occurrences meet window by window instead, so that no task holds all their contexts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap, held
from .shared import settle, unsettle
from .textops import LINES, SPACED, U, chunks, grams, hashes, mix, words

KINDS = {"word": (SPACED, " "), "line": (LINES, "\n")}
LAST = np.iinfo(np.int64).max
#: Occurrences that a task gathers before it settles their repeats, or compares at a time.
GATHER, MEET = 40_000, 100_000
#: An anchor is hot with more occurrences than this, and than this share of all: so few are hot.
HOT, SHARE = 100_000, 1e-6
#: Bytes of a unit's hash in a context. Units are compared in aligned pairs only.
UNIT = 5


def _anchors_of(column: pa.Array, kind: np.ndarray, window: int, seed: int, least: int):
    """Of each group of rows, its selected anchors: row, first unit, hash, reach to the left (least, most), hashes of all units, and the unit's index.

    A window reaches ``left`` units before its anchor. With ``least``, only windows of so many words count.
    """
    for first, last, data, offsets in chunks(column):
        starts, ends, row = words(data, offsets, kind)
        if len(row) < window:
            continue
        h = hashes(data, starts, ends)
        g = grams(h, seed)
        size = len(h) - window + 1
        low = g[:size].copy()
        at = np.zeros(size, np.int64)
        for j in range(1, window - seed + 1):
            nxt = g[j : j + size]
            lower = nxt <= low
            low[lower] = nxt[lower]
            at[lower] = j
        good = row[:size] == row[window - 1 :]
        if least:
            # A unit's words begin where a word byte follows another, or the unit itself does.
            spaced = SPACED[data]
            begins = spaced.copy()
            begins[1:] &= ~spaced[:-1]
            begins[starts] = spaced[starts]
            count = np.concatenate(([0], np.cumsum(begins)))
            good &= count[ends[window - 1 :]] - count[starts[:size]] >= least
        inside = np.flatnonzero(good)
        if not len(inside):
            continue
        anchor = inside + at[inside]
        new = np.flatnonzero(np.concatenate(([True], (np.diff(anchor) > 0) | (np.diff(inside) > 1))))
        end = np.append(new[1:] - 1, len(inside) - 1)
        begin = np.searchsorted(row, np.arange(last - first))
        place = anchor[new]
        yield first + row[place], place - begin[row[place]], g[place], anchor[end] - inside[end], place - inside[new], h, place


def _repeated_anchors(docs: DataFrame, kind: np.ndarray, window: int, seed: int, least: int) -> DataFrame:
    """(key, n): anchor hashes that occur more than once."""

    def run(batches):
        for batch in batches:
            for _, _, key, _, _, _, _ in _anchors_of(batch.column(0), kind, window, seed, least):
                key, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")


def _contexts(h: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Hashes of the units that the windows of each anchor reach: the nearest first, left and then right; 0 beyond."""
    reach = window - seed
    out = np.zeros((len(place), 2 * reach), U)
    for j in range(reach):
        left, right = np.flatnonzero(high > j), np.flatnonzero(reach - low > j)
        out[left, j] = h[place[left] - 1 - j] | U(1)
        out[right, reach + j] = h[place[right] + seed + j] | U(1)
    return out & U((1 << 8 * UNIT) - 1)


def _first_windows(key, doc, pos, low, high, ctx, reach: int, seen: dict):
    """Which windows of the occurrences, as a bit for each reach to the left, are in an earlier one too.

    Occurrences of a key come in order. seen keeps the hashes and contexts of windows of the last
    key, whose occurrences may go on.
    """
    found = np.zeros(len(key), np.int64)
    weights = mix(np.arange(1, 2 * reach + 2, dtype=U) * U(0x9E3779B97F4A7C15))
    for left in range(reach + 1):
        rows = np.flatnonzero((low <= left) & (left <= high))
        if not len(rows):
            continue
        near = np.concatenate([np.arange(left), reach + np.arange(reach - left)])
        units = ctx[rows][:, near]
        code = mix(key[rows] + (units * weights[near]).sum(1, dtype=U) + U(left))
        order = np.lexsort((pos[rows], doc[rows], code))
        rows, units, code = rows[order], units[order], code[order]
        again = np.zeros(len(rows), bool)
        again[1:] = code[1:] == code[:-1]
        lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(rows))))
        # Equal hashes only say where to look: the units themselves decide.
        same = again & (units == units[lead]).all(1)
        later = same & ((doc[rows] != doc[rows[lead]]) | (pos[rows] != pos[rows[lead]]))
        old = seen.get(left)
        if old is not None and len(old[0]):
            k = np.minimum(np.searchsorted(old[0], code), len(old[0]) - 1)
            before = (old[0][k] == code) & (old[1][k] == units).all(1) & ((old[2][k] != doc[rows]) | (old[3][k] != pos[rows]))
            later |= before
        found[rows[later]] |= 1 << left
        open_ = key[rows] == key[-1]
        kept = np.flatnonzero(open_ & ~again)
        part = code[kept], units[kept], doc[rows[kept]], pos[rows[kept]]
        if old is not None and seen.get("key") == key[-1]:
            fresh = ~np.isin(part[0], old[0])
            part = tuple(np.concatenate([a, b[fresh]]) for a, b in zip(old, part, strict=True))
            order = np.argsort(part[0], kind="stable")
            part = tuple(x[order] for x in part)
        seen[left] = part
    return found


OCCURRENCE = "key long, doc long, pos long, low int, high int, mask long, ctx binary"
NAMES = ["key", "doc", "pos", "low", "high", "mask", "ctx"]


def _sent(key, doc, pos, low, high, mask, ctx) -> pa.RecordBatch:
    """Rows of OCCURRENCE; what is settled needs no context."""
    blob = np.ascontiguousarray(ctx[:, :, None].view(np.uint8).reshape(len(key), ctx.shape[1], 8)[:, :, :UNIT]).reshape(len(key), -1)
    size = np.where(mask > 0, 0, blob.shape[1])
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    flat = np.ascontiguousarray(blob[mask == 0]).reshape(-1)
    data = pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(pos), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)), pa.array(mask), data], NAMES)


def _settled(parts: list, hot: np.ndarray, reach: int) -> pa.RecordBatch:
    """Occurrences of a gathering to send on: whole blocks of windows that an earlier one here has too are done."""
    key, doc, pos, low, high, ctx = (np.concatenate(x) for x in zip(*parts, strict=True))
    weights = mix(np.arange(1, 2 * reach + 2, dtype=U) * U(0x9E3779B97F4A7C15))
    code = mix(key + (ctx * weights[: 2 * reach]).sum(1, dtype=U)) + (low * 64 + high).astype(U)
    order = np.lexsort((pos, doc, code))
    key, doc, pos, low, high, ctx, code = (x[order] for x in (key, doc, pos, low, high, ctx, code))
    again = np.zeros(len(key), bool)
    again[1:] = code[1:] == code[:-1]
    lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
    later = again & (key == key[lead]) & (ctx == ctx[lead]).all(1) & ((doc != doc[lead]) | (pos != pos[lead]))
    mask = np.where(later, (1 << high + 1) - (1 << low), 0)
    split = np.flatnonzero(np.isin(key, hot) & ~later)
    stay = np.ones(len(key), bool)
    stay[split] = False
    out = [[x[stay] for x in (key, doc, pos, low, high, mask, ctx)]]
    for left in range(reach + 1) if len(split) else []:
        k = split[(low[split] <= left) & (left <= high[split])]
        near = np.concatenate([np.arange(left), reach + np.arange(reach - left)])
        only = np.zeros_like(ctx[k])
        only[:, near] = ctx[k][:, near]
        each = np.full(len(k), left)
        out.append([mix(key[k] + (only * weights[: 2 * reach]).sum(1, dtype=U) + U(left + 1)), doc[k], pos[k], each, each, mask[k], only])
    key, doc, pos, low, high, mask, ctx = (np.concatenate(x) for x in zip(*out, strict=True))
    # Settled rows go anywhere.
    key = np.where(mask > 0, mix(doc.view(U) ^ pos.view(U)), key)
    return _sent(key, doc, pos, low, high, mask, ctx)


def repeated_windows(docs: DataFrame, unit: str, window: int, seed: int, least: int = 0) -> DataFrame:
    """(doc_id, version, start, mask): windows of units that start earlier elsewhere too.

    Bit b of mask stands for the window that begins b units before unit ``start``, an anchor. Earlier
    is a smaller doc_id, or a smaller first unit in the same document; null ids come last. version
    tells texts of one doc_id apart. With ``least``, only windows of so many words count.
    """
    kind, reach = KINDS[unit][0], window - seed
    docs = _versions(docs)
    shared = settle(_repeated_anchors(docs, kind, window, seed, least), "anchors")
    count, total = shared.agg(F.count("*"), F.sum("n")).first()
    only = docs.sparkSession.sparkContext.broadcast(bitmap(shared, "key", count))
    # At most 1 / SHARE anchors are hot, whatever the input.
    hot = np.sort(shared.where(F.col("n") > max(HOT, SHARE * (total or 0))).select("key").toArrow().column("key").to_numpy().view(U))
    unsettle(shared)

    def seeds(batches):
        parts, size = [], 0
        for batch in batches:
            ids = batch.column(0).fill_null(LAST).to_numpy()
            version = batch.column(2).to_numpy().astype(np.int64) & 0xFFFFFFFF
            for row, start, key, low, high, h, place in _anchors_of(batch.column(1), kind, window, seed, least):
                may = np.flatnonzero(held(only.value, key))
                for k in np.array_split(may, len(may) // GATHER + 1) if len(may) else []:
                    ctx = _contexts(h, place[k], low[k], high[k], window, seed)
                    parts.append((key[k], ids[row[k]], start[k] << 32 | version[row[k]], low[k], high[k], ctx))
                    size += len(k)
                    if size > GATHER:
                        yield _settled(parts, hot, reach)
                        parts, size = [], 0
        if parts:
            yield _settled(parts, hot, reach)

    def extend(batches):
        seen: dict = {}
        for batch in batches:
            for a in range(0, len(batch), MEET):
                part = batch.slice(a, MEET)
                key = part.column(0).to_numpy().view(U)
                doc, pos, low, high, mask = (part.column(i).to_numpy() for i in range(1, 6))
                mask = mask.copy()
                rows = np.flatnonzero(mask == 0)
                if len(rows):
                    blob = np.frombuffer(b"".join(part.column(6).take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), 2 * reach, UNIT)
                    ctx = np.zeros((len(rows), 2 * reach, 8), np.uint8)
                    ctx[:, :, :UNIT] = blob
                    ctx = ctx.view(U).reshape(len(rows), 2 * reach) if reach else np.zeros((len(rows), 0), U)
                    if seen.get("key") != key[rows[0]]:
                        seen = {}
                    mask[rows] = _first_windows(key[rows], doc[rows], pos[rows], low[rows], high[rows], ctx, reach, seen)
                    if seen.get("key") != key[rows[-1]]:
                        seen["key"] = key[rows[-1]]
                k = np.flatnonzero(mask)
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array((pos[k] & 0xFFFFFFFF).astype(np.int32)), pa.array((pos[k] >> 32).astype(np.int32)), pa.array(mask[k].astype(np.int32))], ["doc_id", "version", "start", "mask"])

    found = docs.select("doc_id", "text", "version").mapInArrow(seeds, OCCURRENCE)
    met = found.repartition("key").sortWithinPartitions("key", "doc", "pos")
    return met.mapInArrow(extend, "doc_id long, version int, start int, mask int")


def _versions(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    version = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(0x7FFFFFFF).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), version.alias("version"))


#: Windows of each unit that must go when they repeat, as (units, units of a seed, least words).
RULES = {"word": ((20, 8, 0),), "line": ((3, 2, 0), (1, 1, 20))}


def without_repeats(docs: DataFrame, unit: str = "word", rules=None) -> DataFrame:
    """(doc_id, n_units, n_removed, kept): each document without later repeats of whole windows.

    ``docs`` needs doc_id and text; other columns are ignored. Words are runs of characters other
    than U+0020 and U+0009-U+000D; lines are non-empty runs between line feeds. ``rules`` lists the
    windows (units, units of a seed, least words) of which all but the first go. Windows are judged
    on the input. kept joins the other units with one space (or line feed). Null and empty texts
    have no units and keep ''. Texts shorter than all windows stay. Rows that repeat doc_id and text
    are the same document: neither is earlier. Rows of one doc_id with other texts compare by first
    unit. Null doc_ids count as later than any other. An empty table gives an empty table.
    """
    kind, joint = KINDS[unit]
    found = None
    for window, seed, least in rules or RULES[unit]:
        part = repeated_windows(docs, unit, window, seed, least).withColumn("size", F.lit(window))
        found = part if found is None else found.unionByName(part)
    starts = found.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "mask", "size")).alias("found"))

    def run(batches):
        for batch in batches:
            texts, found = batch.column(1).to_pylist(), batch.column(2)
            n, removed, kept = [], [], []
            for i, text in enumerate(texts):
                data = (text or "").encode()
                units = data.split() if unit == "word" else [x for x in data.split(b"\n") if x]
                n.append(len(units))
                if found[i].is_valid:
                    start, mask, size = (x.to_numpy() for x in found[i].values.flatten())
                    cover = np.zeros(len(units) + 1, np.int32)
                    for bit in range(int(mask.max()).bit_length()):
                        k = np.flatnonzero(mask >> bit & 1)
                        np.add.at(cover, start[k] - bit, 1)
                        np.add.at(cover, start[k] - bit + size[k], -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    units = [units[j] for j in np.flatnonzero(stay).tolist()]
                removed.append(n[-1] - len(units))
                kept.append(joint.encode().join(units))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_units", "n_removed", "kept"])

    rows = _versions(docs).withColumn("at", F.coalesce("doc_id", F.lit(LAST)))
    joined = rows.join(starts.withColumnRenamed("doc_id", "at"), ["at", "version"], "left")
    return joined.select("doc_id", "text", "found").mapInArrow(run, "doc_id long, n_units long, n_removed long, kept string")


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: windows of 20 words over all documents."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The query: over all documents, runs of three lines or more, and single lines of 20 words or more."""
    out = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), "line")
    return out.select("doc_id", F.col("n_units").alias("n_lines"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op4_substring_dedup": op4_substring_dedup, "op6_line_dedup": op6_line_dedup}


def _sql(unit: str, split: str, joint: str) -> str:
    """The query in DuckDB; each rule has its own windows."""
    words = r"len(regexp_extract_all(array_to_string(w[i:i+{0}], ' '), '[^\x20\x09-\x0D]+')) >= {1}"
    win = " UNION ALL ".join(
        f"SELECT doc_id, i, {n} AS n, array_to_string(w[i:i+{n - 1}], {joint}) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM toks WHERE len(w) >= {n})" + (f" WHERE {words.format(n - 1, least)}" if least else "")
        for n, _, least in RULES[unit]
    )
    return rf"""
WITH toks AS (SELECT doc_id, {split} AS w FROM documents),
win AS ({win}),
hit AS (SELECT doc_id, i, n FROM (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
pos AS (SELECT doc_id, unnest(w) AS u, unnest(range(1, len(w) + 1)) AS p FROM toks),
kept AS (SELECT doc_id, string_agg(u, {joint} ORDER BY p) AS k, count(*) AS n FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_{unit}s, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM toks t LEFT JOIN kept USING (doc_id)
"""


SQL = {
    "op4_substring_dedup": _sql("word", r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')", "' '"),
    "op6_line_dedup": _sql("line", r"regexp_extract_all(coalesce(text, ''), '[^\x0A]+')", "chr(10)"),
}
