"""Benchmark decontamination with suffix arrays over the training texts.

Each task keeps a suffix array of its shard of documents, SHARD bytes at a time: the positions of
words in the order of the texts that follow them. Every suffix of the benchmark items is searched
in it by bisection. Where it falls, its neighbours share the most words with it; so each training
position gets its longest verbatim match in any item, and all positions that share a window with
an item are found. Training words around which no SEED words occur in any item can't match; they
end the suffixes before them and stay out of the array. Items under a window are looked up whole.

The items are a stated query set: they are handled in blocks of bounded size, each sent to all
tasks, and what is found for all blocks is merged per document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle
from .textops import ALNUM, LOWER, U, chunks, grams, hashes, text_bytes, words

#: Characters of benchmark text that one block may hold, and bytes of text of a suffix array.
BLOCK_CHARS, SHARD = 8 << 20, 2 << 20
SEED = 4
TABLE = 1 << 20


def suffix_order(text: np.ndarray, most: int) -> np.ndarray:
    """Positions of ``text`` (ids, 0 ends a run) in the order of their next ``most`` ids, by prefix doubling."""
    rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while k < most and len(text) and rank.max() + 1 < len(text):
        after = np.zeros(len(text), np.int64)
        after[:-k] = rank[k:] + 1
        rank = np.unique(rank * (int(after.max()) + 1) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable")


def shared_words(x: np.ndarray, at: np.ndarray, y: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many ids follow alike from ``at`` in x and from ``other`` in y, before either run ends."""
    n = np.zeros(len(at), np.int64)
    alive = np.arange(len(at))
    while len(alive):
        a = x[at[alive] + n[alive]]
        alive = alive[(a == y[other[alive] + n[alive]]) & (a != 0)]
        n[alive] += 1
    return n


class Suffixes:
    """The items of one block: their suffixes in order, which begin a window, and short items whole."""

    def __init__(self, names: list, texts: list, window: int):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        data = LOWER[data]
        starts, ends, row = words(data, offsets, ALNUM)
        h = hashes(data, starts, ends)
        self.names, self.window = names, window
        n = np.bincount(row, minlength=len(texts))
        first = np.cumsum(n) - n
        self.vocabulary = np.unique(h)
        ids = (np.searchsorted(self.vocabulary, h) + 1).astype(np.int64)
        long = np.flatnonzero(n >= window)
        seed = min(SEED, window)
        # Long items one after the other, each ended by 0.
        self.text = np.concatenate([np.append(ids[first[i] : first[i] + n[i]], 0) for i in long.tolist()] or [np.zeros(1, np.int64)])
        item = np.repeat(long, n[long] + 1)
        left = np.concatenate([np.arange(n[i], -1, -1) for i in long.tolist()] or [np.zeros(1, np.int64)])
        order = suffix_order(self.text, int(n.max(initial=1)))
        self.order = order[left[order] >= window]
        new = np.ones(len(self.order), bool)
        if len(self.order) > 1:
            new[1:] = shared_words(self.text, self.order[:-1], self.text, self.order[1:]) < window
        self.kind = np.cumsum(new) - 1
        pair = np.unique(np.stack([self.kind, item[self.order]], 1), axis=0) if len(self.order) else np.zeros((0, 2), np.int64)
        self.item, self.held = pair[:, 1], np.searchsorted(pair[:, 0], np.arange(int(self.kind[-1]) + 2 if len(self.kind) else 1))
        p = grams(h, seed)
        same = row[: len(p)] == row[seed - 1 :] if len(p) else np.zeros(0, bool)
        self.head = np.unique(p[same & (n[row[: len(p)]] >= window)])
        self.of = item[self.order]
        self.heads = grams(self.vocabulary[self.text[(self.order[:, None] + np.arange(seed)).reshape(-1)] - 1], seed)[::seed] if len(self.order) else np.zeros(0, U)
        self.table = np.zeros(TABLE, bool)
        self.table[(self.head & U(TABLE - 1)).astype(np.int64)] = True
        self.seed = seed
        # Short items by length: hashes of the whole, in order, with the items of each.
        self.short = {}
        for size in np.unique(n[(n > 0) & (n < window)]).tolist():
            these = np.flatnonzero(n == size)
            whole = np.array([grams(h[first[i] : first[i] + size], size)[0] for i in these], U)
            key, of = np.unique(whole, return_inverse=True)
            self.short[size] = key, [these[of == k].tolist() for k in range(len(key))], np.stack([h[first[these[of == k][0]] : first[these[of == k][0]] + size] for k in range(len(key))])

    def array(self, h: np.ndarray, row: np.ndarray):
        """The words of a shard that can match, as ids in runs ended by 0, where each is, and their suffix array."""
        p = grams(h, self.seed)
        at = np.flatnonzero(self.table[(p & U(TABLE - 1)).astype(np.int64)] & (row[: len(p)] == row[self.seed - 1 :])) if len(p) and len(self.head) else np.zeros(0, np.int64)
        at = at[np.isin(p[at], self.head)]
        if not len(at):
            return np.zeros(0, np.int64), at, at
        new = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (np.diff(row[at]) > 0))))
        start, end = at[new], at[np.append(new[1:] - 1, len(at) - 1)] + self.seed
        size = end - start + 1
        place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        text = np.searchsorted(self.vocabulary, h[np.minimum(place, len(h) - 1)]) + 1
        text[np.cumsum(size) - 1] = 0
        return text, place, suffix_order(text, int(size.max()))

    def search(self, h: np.ndarray, row: np.ndarray):
        """(position, size, length, item, windows) of what occurs in the words ``h`` of the rows ``row``.

        size is that of the window at the position, length that of its longest verbatim match, in
        the item; windows names the items that hold the window, as a key of :meth:`holders`.
        """
        found = []
        text, place, order = self.array(h, row)
        if len(order):
            order = order[text[order] != 0]
            heads = grams(self.vocabulary[text[text != 0] - 1], self.seed)
            asked = np.flatnonzero(np.isin(self.heads, heads))
            low = self._bisect(text, order, self.order[asked])
            # low rises with the suffixes, so each training suffix lies between two of them.
            after = np.searchsorted(low, np.arange(len(order)), "right")
            best, of = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
            for beside, there in ((after - 1, after > 0), (after, after < len(asked))):
                k = np.flatnonzero(there)
                n = shared_words(text, order[k], self.text, self.order[asked[beside[k]]])
                more = n > best[k]
                best[k[more]], of[k[more]] = n[more], asked[beside[k[more]]]
            hit = np.flatnonzero(best >= self.window)
            found.append((place[order[hit]], np.full(len(hit), self.window), best[hit], self.of[of[hit]], self.kind[of[hit]]))
        for size, (key, items, content) in self.short.items():
            g = grams(h, size)
            at = np.flatnonzero(np.isin(g, key)) if len(g) else np.zeros(0, np.int64)
            at = at[row[at] == row[at + size - 1]]
            which = np.searchsorted(key, g[at])
            same = (h[at[:, None] + np.arange(size)] == content[which]).all(1) if len(at) else np.zeros(0, bool)
            at, which = at[same], which[same]
            first = np.array([x[0] for x in items], np.int64)
            found.append((at, np.full(len(at), size), np.full(len(at), size), first[which], -1 - (which * self.window + size)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5

    def holders(self, key: int) -> list:
        """The items that hold a window found by :meth:`search`."""
        if key >= 0:
            return self.item[self.held[key] : self.held[key + 1]].tolist()
        which, size = divmod(-1 - key, self.window)
        return self.short[size][1][which]

    def _bisect(self, text: np.ndarray, order: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """How many of the suffixes of ``text``, in ``order``, are below each suffix of the items that begins at ``asked``."""
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(order))
        while len(k := np.flatnonzero(low < high)):
            middle = (low[k] + high[k]) // 2
            n = shared_words(text, order[middle], self.text, asked[k])
            below = text[order[middle] + n] < self.text[asked[k] + n]
            low[k[below]] = middle[below] + 1
            high[k[~below]] = middle[~below]
        return low


def _merge(starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Union of spans as (start, length), in order."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate((starts + sizes)[order])
    new = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))
    last = np.append(new[1:] - 1, len(starts) - 1)
    return list(zip(starts[new].tolist(), (reach[last] - starts[new]).tolist(), strict=True))


SPANS = "array<struct<start:long,length:long>>"
ROW = f"doc_id long, version long, n_words long, n_hit long, longest long, longest_start long, longest_item string, spans {SPANS}, items array<string>"
KINDS = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.list_(pa.string())]
NAMES = ["doc_id", "version", "n_words", "n_hit", "longest", "longest_start", "longest_item", "spans", "items"]


def _batch(rows: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], NAMES)


def _row(spans, longest, items):
    """n_hit, the longest match, spans and items, in the order of ROW."""
    return sum(x[1] for x in spans), *longest, [{"start": a, "length": b} for a, b in spans], items


def _scan(docs: DataFrame, asked) -> DataFrame:
    def run(batches):
        suffixes = Suffixes.__new__(Suffixes)
        suffixes.__dict__ = asked.value
        for batch in batches:
            ids, versions, out = batch.column(0).to_pylist(), batch.column(2).to_pylist(), []
            for first, last, data, offsets in chunks(batch.column(1), SHARD):
                data = LOWER[data]
                starts, ends, row = words(data, offsets, ALNUM)
                at, size, length, item, key = suffixes.search(hashes(data, starts, ends), row)
                begin = np.searchsorted(row, np.arange(last - first + 1))
                order = np.lexsort((at, row[at]))
                at, size, length, item, key = at[order], size[order], length[order], item[order], key[order]
                bounds = np.searchsorted(row[at], np.arange(last - first + 1))
                for i in range(last - first):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    spans, longest, items = [], (0, None, None), []
                    if b > a:
                        spans = _merge(at[a:b] - begin[i], size[a:b])
                        best = a + int(np.argmax(length[a:b]))
                        longest = int(length[best]), int(at[best] - begin[i]), suffixes.names[item[best]]
                        items = sorted({suffixes.names[x] for k in np.unique(key[a:b]).tolist() for x in suffixes.holders(k)} - {None})
                    out.append((ids[first + i], versions[first + i], int(begin[i + 1] - begin[i]), *_row(spans, longest, items)))
            yield _batch(out)

    return docs.mapInArrow(run, ROW)


def verbatim_matches(docs: DataFrame, items: DataFrame, window: int = 13, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, version, n_words, n_hit, longest, longest_start, longest_item, spans, items): what each document shares with the items.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns are ignored. Words
    are runs of a-z, 0-9 and characters above U+007F after A-Z are lower-cased. A window is
    ``window`` consecutive words of one item, or a whole shorter item. spans (in words) unite the
    occurrences of windows and n_hit is their length. longest is the length of the longest run of
    words that is verbatim in one item and holds a window; longest_start is where the document has
    it first, longest_item an item that holds it. items are the distinct ids of items with windows
    that occur, sorted as strings. Items without an id count for spans but aren't listed. Null and
    empty texts have no words and no hits; empty tables give no rows or no hits. Rows that repeat
    are judged each. version is a hash of the text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(chars / block_chars * 1.25))
    found = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        asked = spark.sparkContext.broadcast(vars(Suffixes([r[0] for r in rows], [r[1] for r in rows], window)))
        if blocks == 1:
            return _scan(docs, asked)
        # A block is built, met with all documents, settled and released before the next one.
        found.append(settle(_scan(docs, asked), "matches"))
        asked.destroy()
        del rows, asked
    out = found[0]
    for x in found[1:]:
        out = out.union(x)

    def unite(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                spans = [(s["start"], s["length"]) for part in r["spans"] for s in part]
                spans = _merge(*map(np.array, zip(*spans, strict=True))) if spans else []
                longest = (-r["best"]["less"], r["best"]["start"], r["best"]["item"]) if spans else (0, None, None)
                row = _row(spans, longest, sorted({x for part in r["items"] for x in part}))
                out += [(r["doc_id"], r["version"], r["n_words"], *row)] * (r["copies"] // blocks)
            yield _batch(out)

    best = F.min(F.struct((-F.col("longest")).alias("less"), F.col("longest_start").alias("start"), F.col("longest_item").alias("item"))).alias("best")
    out = out.groupBy("doc_id", "version", "n_words").agg(F.count("*").alias("copies"), F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"), best)
    return out.mapInArrow(unite, ROW)


def contaminated():
    """The rule: hit words are a twentieth of the document or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` without the contaminated rows; all columns come through, null doc_ids too."""
    bad = verbatim_matches(docs, items, window).where(contaminated()).select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(text) == F.col("_version"))
    return docs.join(bad, same, "left_anti")


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The query: 13-word windows of the whole benchmark in all documents."""
    found = verbatim_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"), "longest")


QUERIES = {"op7_decontaminate": op7_decontaminate}

SQL = {
    "op7_decontaminate": r"""
WITH lowered AS (
  SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
toks AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
items AS (SELECT id, w, least(len(w), 13) AS n FROM toks WHERE kind = 1 AND len(w) > 0),
iw AS (SELECT id, n, i, array_to_string(w[i:i+n-1], ' ') AS s FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
win AS (SELECT DISTINCT id AS item_id, n, s FROM iw),
sizes AS (SELECT DISTINCT n FROM win),
docs AS (SELECT id AS doc_id, w FROM toks WHERE kind = 0),
occ AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, o.n, item_id FROM occ o JOIN win USING (n, s)),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
pairs AS (SELECT o.doc_id, o.i, o.n, w.id, w.i AS j FROM occ o JOIN iw w USING (n, s)),
runs AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, n + count(*) - 1 AS c FROM (SELECT doc_id, n, id, i, i - j AS d, i - row_number() OVER (PARTITION BY doc_id, n, id, i - j ORDER BY i) AS g FROM pairs) GROUP BY doc_id, n, id, d, g) GROUP BY 1),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM docs d LEFT JOIN cover USING (doc_id) LEFT JOIN held USING (doc_id) LEFT JOIN runs USING (doc_id)
""",
}
