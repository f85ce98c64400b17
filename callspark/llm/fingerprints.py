"""Document fingerprints by locally consistent parsing with deterministic coin tossing.

A text is a sequence of code points. At each level runs of one symbol become one symbol, coin
tossing reduces neighbouring symbols to labels of 0 to 5 that differ, and the local minima of the
labels begin phrases. Whether a position begins a phrase depends on a few symbols around it, so
equal substrings get equal phrases inside, at any offset. A phrase's name, a hash of its symbols,
is a symbol of the next level. The fingerprint lists the smallest names of the levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textops import U, mix, powers

LEVELS = 3
#: Names kept of each level, and the number from which a level alone tells texts apart.
KEPT, ENOUGH = 64, 8
GROUP = 400_000
#: Ranges, by a hash of the text, of the rows of one doc_id or none (a power of two).
LOTS = 64


def _toss(labels: np.ndarray, before: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """One round on labels under 128: the lowest bit that differs from the left, and its value."""
    before[1:] = labels[:-1]
    before[edge] = 127
    return _ROUND[labels.astype(np.uint16) << 7 | before]


def _round_table() -> np.ndarray:
    x, y = np.divmod(np.arange(1 << 14), 1 << 7)
    d = x ^ y
    low = np.where(d > 0, np.bitwise_count((d & -d) - 1), 7).astype(np.int64)
    return (2 * low + (x >> low & 1)).astype(np.uint8)


_ROUND = _round_table()


def parse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level over texts that begin at ``first`` (rising, none empty): phrase names and where texts begin."""
    edge = np.zeros(len(symbols), bool)
    edge[first] = True
    new = edge.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    if len(at) < len(symbols):
        run = np.diff(np.append(at, len(symbols)))
        symbols, edge = symbols[at], edge[at]
        many = run > 1
        symbols = symbols.astype(U)
        symbols[many] = mix(symbols[many] + run[many].astype(U) * U(0x9E3779B97F4A7C15))
    differ = np.empty_like(symbols)
    differ[1:] = symbols[1:] ^ symbols[:-1]
    differ[edge] = 1
    low = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1))
    labels = (low << np.uint8(1)) | (symbols >> low.astype(symbols.dtype) & symbols.dtype.type(1)).astype(np.uint8)
    at = np.flatnonzero(edge)
    before = np.zeros(len(labels), np.uint8)
    for _ in range(3):
        labels = _toss(labels, before, at)
    cut = edge.copy()
    cut[1:-1] |= (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:])
    begin = np.flatnonzero(cut)
    size = np.diff(np.append(begin, len(symbols)))
    within = np.arange(len(symbols)) - np.repeat(begin, size)
    value = (symbols.astype(U) + U(1)) * U(0x9E3779B97F4A7C15) * powers(int(size.max()) + 1)[within]
    return mix(np.add.reduceat(value, begin) + size.astype(U)), np.searchsorted(begin, at)


def _signature(levels: list[np.ndarray]) -> str:
    """Hex names by level, lowest level last; lower levels only where a higher one is short."""
    out = []
    for names in reversed(levels):
        names = np.unique(names.astype(np.uint32))
        out.append(f"{len(names)}:{names[:KEPT].astype('>u4').tobytes().hex()}")
        if len(names) >= ENOUGH:
            break
    return "/".join(out)


def fingerprints(texts: list[str]) -> list[str]:
    """A fingerprint for each text; an empty text's is empty. Equal texts have equal ones."""
    out = [""] * len(texts)
    todo, total = [], 0
    for i, text in enumerate(texts):
        if text:
            todo.append(i)
            total += len(text)
        if todo and (total > GROUP or i == len(texts) - 1):
            symbols = np.frombuffer("".join(texts[j] for j in todo).encode("utf-32-le", "surrogatepass"), np.uint32)
            n = np.array([len(texts[j]) for j in todo])
            first, levels = np.cumsum(n) - n, []
            for _ in range(LEVELS):
                symbols, first = parse(symbols, first)
                levels.append(np.split(symbols, first[1:]))
            for k, j in enumerate(todo):
                out[j] = _signature([x[k] for x in levels])
            todo, total = [], 0
    return out


def _level(part: str) -> tuple[int, np.ndarray]:
    n, _, names = part.partition(":")
    return int(n), np.frombuffer(bytes.fromhex(names), ">u4")


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard likeness (0 to 1) of two fingerprints, on the highest level that is rich enough."""
    if a == b or not a or not b:
        return float(a == b)
    for x, y in zip(a.split("/"), b.split("/"), strict=False):
        (n, p), (m, q) = _level(x), _level(y)
        if max(n, m) >= ENOUGH:
            break
    k = KEPT if max(n, m) > KEPT else len(p) + len(q)
    union = np.union1d(p, q)[:k]
    return len(np.intersect1d(np.intersect1d(p, q), union)) / len(union)


OUT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(ids, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
    """Rows of OUT for texts whose next documents' texts are given."""
    edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts, strict=True)]
    own = fingerprints([*texts, nexts[-1]])
    following = own[1:] if nexts[:-1] == texts[1:] else fingerprints(nexts)
    changed = fingerprints(edited)
    columns = [
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(edited), pa.array(own[:-1]), pa.array(changed),
        pa.array([likeness(a, b) for a, b in zip(own, changed, strict=False)]), pa.array([likeness(a, b) for a, b in zip(own, following, strict=False)]),
    ]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])


def compared(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    ``docs`` needs doc_id and text; other columns are ignored. Documents go by falling doc_id,
    nulls last, equal ids by a hash of their text; after the last comes the first. In the edited
    text the last third (floored) makes way for the first as many code points of the next
    document. Null texts count as empty; an empty text is like an empty one (1) and no other (0).
    A single row is its own next. An empty table gives an empty table.

    The order is dealt into ranges of ids and sorted in each; only the first and last row of each
    range travel once more, to meet their neighbour.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or []
    # An id that is more than one of the cuts fills a range by itself, which its texts' hashes divide, as those of null ids.
    heavy = sorted({x for x, y in zip(found, found[1:], strict=False) if x == y})
    cuts = sorted({*found, *(x + 1 for x in heavy)})
    docs = docs.withColumn("tie", F.xxhash64("text"))
    lot = F.lit(LOTS // 2 - 1) - F.shiftright("tie", 64 - LOTS.bit_length() + 1).cast("int")
    at = F.when(F.col("doc_id").isNull(), lot - LOTS).otherwise(_place(F.col("doc_id"), cuts) * LOTS + F.when(F.col("doc_id").isin(heavy), lot).otherwise(0))
    ranged = docs.withColumn("range", at)
    order = [F.col("range").desc(), F.col("doc_id").desc_nulls_last(), F.col("tie")]
    ranged = ranged.repartition(parts // 3, "range").sortWithinPartitions(*order).select("range", "doc_id", "text")

    def inner(batches):
        """All rows whose next is in their range."""
        held = None
        for batch in batches:
            place, ids, texts = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            if held is not None:
                place, ids, texts = [held[0], *place], pa.concat_arrays([held[1], ids]), [held[2], *texts]
            for a in range(0, len(texts) - 1, 1000):
                b = min(a + 1000, len(texts) - 1)
                rows = [i for i in range(a, b) if place[i] == place[i + 1]]
                if rows:
                    yield _judge(ids.take(rows), [texts[i] for i in rows], [texts[i + 1] for i in rows])
            if texts:
                held = place[-1], ids[len(texts) - 1 :], texts[-1]

    def ends(batches):
        """The first and the last row of each range."""
        last = None
        for batch in batches:
            place = batch.column(0).to_pylist()
            new = [i for i in range(len(place)) if place[i] != (place[i - 1] if i else last[0] if last else None)]
            for i in new:
                if i or last:
                    a = (place[i - 1], batch.column(1)[i - 1].as_py(), batch.column(2)[i - 1].as_py()) if i else last
                    yield row(*a, False)
                yield row(place[i], batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), True)
            if place:
                last = place[-1], batch.column(1)[-1].as_py(), batch.column(2)[-1].as_py()
        if last:
            yield row(*last, False)

    def row(place, doc, text, first):
        return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([doc], pa.int64()), pa.array([text]), pa.array([first])], ["range", "doc_id", "text", "first"])

    def across(batches):
        for batch in batches:
            for i in range(len(batch)):
                yield _judge(batch.column(0)[i : i + 1], [batch.column(1)[i].as_py()], [batch.column(2)[i].as_py()])

    edges = ranged.mapInArrow(ends, "range int, doc_id long, text string, first boolean")
    firsts = edges.where("first").select(F.col("range").alias("next_range"), F.col("text").alias("next_text"))
    # One row for each range, so one task can put them in order.
    named = firsts.select("next_range")
    falling = Window.orderBy(F.col("next_range").desc())
    named = named.select(F.col("next_range").alias("range"), F.coalesce(F.lead("next_range").over(falling), F.max("next_range").over(Window.partitionBy())).alias("next_range"))
    met = edges.where("not first").join(named, "range").join(firsts, "next_range").select("doc_id", "text", "next_text")
    return ranged.mapInArrow(inner, OUT).union(met.mapInArrow(across, OUT))


def _place(column, cuts: list[int]):
    """How many of the rising ``cuts`` are at or below the column: a balanced tree of comparisons."""
    if not cuts:
        return F.lit(0)

    def tree(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column < cuts[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(cuts))


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """The query: all documents."""
    out = compared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op5_fingerprints": op5_fingerprints}
SQL: dict[str, str] = {}


def edited_sha256(text: str, following: str) -> str:
    """What the query's digest must be, for tests."""
    return hashlib.sha256((text[: len(text) - len(text) // 3] + following[: len(text) // 3]).encode()).hexdigest()
