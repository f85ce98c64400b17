"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and their first letters, hashed; each counts once. On a
bounded sample of labelled rows (the driver gets each row's hashed terms, never a text) a
factorization machine learns a weight of every term and, as products of short vectors, those of
pairs: an insult beside a group's name weighs more than both alone. No term is chosen beforehand;
shrinking weights (L1) and vectors (L2) decides. Terms of no sampled row weigh nothing. All
documents are scored whole, in one pass without a shuffle; the model's size is a parameter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from .shared import settle, unsettle
from .textops import ALNUM, U, chunks, hashes, words

#: Hash space of terms, and length of their vectors.
SPACE, RANK = 1 << 18, 8
#: The most labelled rows that are fitted on: those with the smallest hashes of their doc_id.
SAMPLE = 12_000
PREFIX = 5


def _terms(column: pa.Array):
    """(first row, last row, rows, terms) of groups of rows: distinct terms of each, sorted by row."""
    lowered = pa.array([t.lower() if t else "" for t in column.to_pylist()], pa.string())
    for first, last, data, offsets in chunks(lowered):
        starts, ends, row = words(data, offsets, ALNUM)
        term = np.concatenate([hashes(data, starts, ends), hashes(data, starts, np.minimum(ends, starts + PREFIX)) + U(PREFIX)])
        key = np.unique(np.concatenate([row, row]) * SPACE + (term % U(SPACE)).astype(np.int64))
        yield first, last, key // SPACE, key % SPACE


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of so many ``values``."""
    out = np.zeros((len(size), *values.shape[1:]))
    if len(values):
        out[size > 0] = np.add.reduceat(values, (np.cumsum(size) - size)[size > 0], axis=0)
    return out


def _predict(bias: float, weight: np.ndarray, vectors: np.ndarray, size: np.ndarray):
    """Scores of rows with so many terms, given the weight and vector of each term; and the rows' sums of vectors."""
    total = _sums(vectors, size)
    pairs = (total**2).sum(1) - _sums((vectors * vectors).sum(1), size)
    return 1 / (1 + np.exp(-np.clip(bias + _sums(weight, size) + 0.5 * pairs, -30, 30))), total


def _bias(toxic: int, rows: int) -> float:
    base = (toxic + 0.5) / (rows + 1) if rows else 0.0
    return float(np.log((base + 1e-9) / (1 - base)))


def train(size: np.ndarray, term: np.ndarray, y: np.ndarray, epochs: int = 25, step: float = 0.2, turn: float = 0.003, l1: float = 0.05, l2: float = 0.1) -> dict:
    """A model from labels y and the terms of each row, so many a row; AdaGrad with steps ``step`` for weights and ``turn`` for vectors.

    The defaults were chosen on a split of the rows that may be learnt from, never on held-out ones.
    """
    bias, bias_seen = _bias(y.sum(), len(y)), 1e-2
    # By a table of all terms: sorting millions of entries would take many times their memory.
    place = np.zeros(SPACE, np.int32)
    place[term] = 1
    known = np.flatnonzero(place)
    place[known] = np.arange(len(known), dtype=np.int32)
    term = place[term]
    random = np.random.default_rng(7)
    weight, vectors = np.zeros(len(known)), random.normal(0, 0.01, (len(known), RANK))
    weight_seen, vectors_seen = np.full(len(known), 1e-4), np.full(len(known), 1e-4)
    begin, where = np.cumsum(size) - size, np.zeros(len(known), np.int64)
    # Chance makes a term differ by as much as the root of 1 / rows.
    least, batch = l1 / np.sqrt(len(y)), min(512, max(32, len(y) // 24))
    mean = [0.0, 0.0, 0.0]
    for epoch in range(epochs):
        order = random.permutation(len(y))
        for a in range(0, len(y), batch):
            rows = order[a : a + batch]
            n = size[rows]
            t = term[np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            seen = np.zeros(len(known), bool)
            seen[t] = True
            used = np.flatnonzero(seen)
            where[used] = np.arange(len(used))
            at, v = where[t], vectors[used]
            p, total = _predict(bias, weight[t], v[at], n)
            g = (p - y[rows]) / len(rows)
            each = np.repeat(g, n)
            d = np.bincount(at, each, len(used))
            dv = np.stack([np.bincount(at, each * np.repeat(total[:, f], n), len(used)) for f in range(RANK)], 1) - d[:, None] * v
            weight_seen[used] += d * d
            vectors_seen[used] += (dv * dv).mean(1)
            weight[used] -= step * d / np.sqrt(weight_seen[used])
            vectors[used] -= turn * dv / np.sqrt(vectors_seen[used])[:, None]
            # Every term shrinks in every step, those absent from its rows too.
            weight = np.sign(weight) * np.maximum(np.abs(weight) - step * least / np.sqrt(weight_seen), 0)
            vectors /= (1 + turn * l2 / np.sqrt(vectors_seen))[:, None]
            bias_seen += g.sum() ** 2
            bias -= step * g.sum() / np.sqrt(bias_seen)
        # Single steps are noisy: the model is the mean of the later epochs.
        if epoch >= epochs // 2:
            mean = [m + x / (epochs - epochs // 2) for m, x in zip(mean, (bias, weight, vectors), strict=True)]
    model = _blank(mean[0])
    model["weight"][known], model["vectors"][known] = mean[1:]
    return model


def _blank(bias: float) -> dict:
    """A model in which no term weighs anything."""
    return {"bias": bias, "weight": np.zeros(SPACE, np.float32), "vectors": np.zeros((SPACE, RANK), np.float32)}


def held_out():
    """Rows that no model may learn from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame) -> dict:
    """A model from at most SAMPLE labelled rows of ``docs`` that aren't held out.

    Rows without a label or a doc_id teach nothing; of several labels of one doc_id the highest
    counts, and of several texts of one doc_id one counts.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The sample is bounded, so its ids may be broadcast.
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    taken = rows.join(F.broadcast(sample), "doc_id").groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text"))
    held = settle(_listed(taken), "terms")
    labelled = {r["toxic"]: r["n"] for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rows, toxic = sum(labelled.values()), labelled.get(1, 0)
    if not 0 < toxic < rows:
        unsettle(held)
        return _blank(_bias(toxic, rows))
    # At most SAMPLE rows of int hashes: the driver never sees a text.
    listed = held.orderBy("doc_id").toArrow()
    unsettle(held)
    size = np.concatenate([np.diff(x.offsets.to_numpy()) for x in listed.column("terms").chunks]).astype(np.int64)
    term = np.concatenate([x.flatten().to_numpy() for x in listed.column("terms").chunks])
    y = listed.column("toxic").to_numpy().astype(float)
    del listed
    return train(size, term, y)


def _listed(taken: DataFrame) -> DataFrame:
    """(doc_id, toxic, terms) of ``taken(doc_id, toxic, text)``: the distinct hashed terms of each text."""

    def run(batches):
        for batch in batches:
            for first, last, row, term in _terms(batch.column(2)):
                bounds = np.searchsorted(row, np.arange(last - first + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(first, last - first) for i in (0, 1)), lists], ["doc_id", "toxic", "terms"])

    schema = StructType([*taken.schema.fields[:2], StructField("terms", ArrayType(IntegerType()))])
    return taken.mapInArrow(run, schema)


def scored(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with a column score (0 to 1), which replaces a column of that name.

    ``docs`` needs text; all other columns come through. Null and empty texts have no terms and
    get the model's bias. Rows that repeat are scored each; an empty table gives an empty table.
    """
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            score = np.zeros(len(batch))
            bias, weight, vectors = (sent.value[k] for k in ("bias", "weight", "vectors"))
            for first, last, row, term in _terms(batch.column(at).cast(pa.string())):
                score[first:last] = _predict(bias, weight[term], vectors[term], np.bincount(row, minlength=last - first))[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all their columns come through."""
    held = docs.withColumnRenamed("score", "_score")
    kept = scored(held, fitted(docs, labels)).where(F.col("score") < threshold).drop("score")
    return kept.withColumnRenamed("_score", "score").select(*docs.columns)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """The query: all documents, by a model of their labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scored(docs, fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
