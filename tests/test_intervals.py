"""The overlap join against all pairs, and how many rows it sends."""

import random

import pytest

from callspark.operators import intervals, segments

HOUR = 3_600_000


def made(seed, n, calls, longest):
    rng = random.Random(seed)
    return [(rng.randrange(calls), i, s, s + rng.choice([0, 1, rng.randrange(1, 5000), rng.randrange(1, longest)])) for i in range(n) for s in [rng.randrange(-HOUR, 4 * HOUR)]]


def pairs(a, b):
    return sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))


@pytest.mark.parametrize(("longest_a", "longest_b"), [(20_000, 20_000), (10 * HOUR, 20_000), (20_000, 10 * HOUR), (10 * HOUR, 10 * HOUR), (10**11, 10**12)])
def test_all_pairs(spark, longest_a, longest_b):
    a, b = made(1, 250, 3, longest_a), made(2, 250, 3, longest_b)
    frame = lambda rows, i: spark.createDataFrame(rows, f"call_id long, {i} long, start_ms long, end_ms long")
    got = intervals.overlapping(frame(a, "i"), frame(b, "j")).select("i", "j").collect()
    assert sorted(map(tuple, got)) == pairs(a, b)


def test_copies_of_long_intervals_are_few(spark):
    """A segment of ten hours is sent as often as its levels allow, not once for each half minute."""
    long = spark.createDataFrame([(1, 0, 10 * HOUR), (1, 17, 17 + 40 * HOUR)], "call_id long, start_ms long, end_ms long")
    short = spark.range(2000).selectExpr("1L AS call_id", "id * 18000 AS start_ms", "id * 18000 + 10 AS end_ms")
    sent = intervals.cells(long, intervals.levels_of(short)).groupBy("start_ms").count().collect()
    assert max(r["count"] for r in sent) <= 2
    # The short ones visit the two levels of the long ones besides their own.
    assert intervals.cells(short, intervals.levels_of(long)).count() <= 2000 * 3 + 2000
    # Without long ones beside them they are sent once, or twice over a cell's border.
    assert intervals.cells(short, intervals.levels_of(short)).count() <= 2100


def test_hot_call_is_split(spark):
    """One call holds nearly all frames and a long segment; adaptive execution splits its cell."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        frames = spark.range(60_000).selectExpr("IF(id % 50 = 0, id % 40, -1L) AS call_id", "id * 7 AS start_ms", "id * 7 + 1 AS end_ms", "md5(string(id)) AS load").repartition(4)
        long = spark.range(40).selectExpr("id AS call_id", "0L AS start_ms", "50L AS end_ms").unionByName(spark.createDataFrame([(-1, 0, 10 * HOUR)], "call_id long, start_ms long, end_ms long"))
        out = intervals.overlapping(frames, long)
        assert out.where("call_id = -1").count() == 58_800
        assert "skew=true" in plan_of(out)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def plan_of(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_speakers_of_long_turns(spark):
    rows = spark.range(500).selectExpr("1L AS call_id", "id AS seg_idx", "id * 60000 AS start_ms", "id * 60000 + 50000 AS end_ms", "'x' AS text", "CAST(NULL AS STRING) AS speaker")
    turns = spark.createDataFrame([(1, 0, 8 * HOUR, "A"), (1, 60_000, 115_000, "B")], "call_id long, start_ms long, end_ms long, speaker string")
    got = {r.seg_idx: r.speaker for r in segments.assign_speakers(rows, turns).collect()}
    # B speaks as long as A in segment 1: the smaller name.
    assert got == {i: "A" if i < 480 else None for i in range(500)}
