"""Streaming over whole calls equals the batch job, over restarts and repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from callspark.jobs import workloads
from callspark.sources.work import settle
from callspark.streaming.whole_calls import Calls, latest, stream_whole_calls, together

LEXICON, RULES = {"a": ["word1"], "b": ["word2 word3"]}, (("분노", 0.2, "anger"), ("슬픔", 0.2, "grief"))
JOB = workloads.whole_calls(LEXICON, RULES, 2, keywords=["word1"], suffixes=["word2"])
NAMES = ["segments", "transcripts", "roles", "voices", "moods", "dangers"]


def tables(spark, seed=2, calls=6):
    rng = random.Random(seed)
    out = {k: [] for k in ("chunks", "turns", "frames", "moods")}
    for c in range(calls):
        at = 0.0
        for i in range(rng.randint(1, 12)):
            long = rng.choice([0.7, 2.5, 4.0])
            out["chunks"].append((f"c{c}", i, at, at + long, " ".join(f"word{rng.randrange(5)}" for _ in range(rng.randint(1, 6)))))
            out["turns"].append((f"c{c}", int(at * 1000) - 100, int((at + long) * 1000), f"S{rng.randrange(2)}"))
            out["moods"].append((f"c{c}", f"S{rng.randrange(2)}", int(at * 1000), int((at + long) * 1000), [rng.random() for _ in range(6)]))
            out["frames"] += [(f"c{c}", int(at * 1000) + 90 * k, float(rng.randrange(40, 520)), float(rng.randrange(900)), k % 7 == 0) for k in range(int(long * 10))]
            at += long + rng.choice([0, 0.5, 3])
    schema = {
        "chunks": "call_id string, chunk_idx long, start double, end double, text string", "turns": "call_id string, start_ms long, end_ms long, speaker string",
        "frames": "call_id string, t_ms long, f0 double, rms double, onset boolean", "moods": "call_id string, speaker string, start_ms long, end_ms long, probabilities array<double>",
    }
    return {k: spark.createDataFrame(rows, schema[k]) for k, rows in out.items()}


def shown(df):
    return sorted(df.select(*(F.to_json(F.struct(c)) if c in ("emotion_distribution", "details", "flags") else c for c in sorted(df.columns))).toPandas().astype(str).values.tolist())


def same(spark, target, batch):
    for name in NAMES:
        assert shown(latest(spark, target, name)) == shown(batch[name]), name


def expected(rows):
    return JOB(rows, settle)


def parts(rows, k, n):
    """Rows of every call in each of n parts: calls go on from part to part."""
    return rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(n)) == k)


def test_restart(spark, tmp_path):
    """Two runs over growing files, with a failed one between them."""
    rows = tables(spark)
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def arrive(k):
        for name, df in rows.items():
            parts(df, k, 2).coalesce(1).write.mode("append").parquet(f"{source}/{name}")

    def run(job):
        streams = {name: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/{name}") for name, df in rows.items()}
        stream_whole_calls(spark, streams, job, target, state).awaitTermination()

    arrive(0)
    run(JOB)
    first = expected({name: parts(df, 0, 2) for name, df in rows.items()})
    same(spark, target, first)
    arrive(1)

    def broken(found, keep):
        out = JOB(found, keep)
        # Some tables of the batch are written, then it fails.
        return {**out, "dangers": out["dangers"].withColumn("x", F.raise_error(F.lit("lost")))}

    with pytest.raises(Exception, match="lost"):
        run(broken)
    same(spark, target, first)
    run(JOB)
    same(spark, target, expected(rows))


def test_a_batch_runs_twice(spark, tmp_path):
    rows = tables(spark, 5, 3)
    calls = Calls(spark, str(tmp_path), {k: df.schema for k, df in rows.items()}, JOB)
    for batch, k in ((0, 0), (1, 1), (1, 1)):
        calls.process(together({name: parts(df, k, 2) for name, df in rows.items()}), batch)
    same(spark, str(tmp_path), expected(rows))
