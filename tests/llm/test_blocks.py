"""Decontamination block by block: one broadcast lives at a time, and the rows are those of one block."""

import random

from pyspark import SparkContext

from callspark.llm import decontaminate


def test_twenty_blocks(spark, monkeypatch):
    rng = random.Random(3)
    say = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    items = [(i, say(rng.choice([3, 14, 30]))) for i in range(60)]
    texts = [say(40) + " " + rng.choice(items)[1] + " " + say(30) for _ in range(40)] + [None, "", items[0][1]]
    rows, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.verbatim_matches(rows, asked).collect()))
    live, most, blocks, send = set(), [], [], SparkContext.broadcast

    def counted(context, value):
        out = send(context, value)
        live.add(id(out))
        blocks.append(out)
        most.append(len(live))
        end = out.destroy
        out.destroy = lambda *a: (live.discard(id(out)), end(*a))
        return out

    monkeypatch.setattr(SparkContext, "broadcast", counted)
    chars = sum(len(t) for _, t in items)
    got = decontaminate.verbatim_matches(rows, asked, block_chars=int(chars * 1.25 / 20))
    assert len(blocks) >= 20 and max(most) == 1 and not live
    assert sorted(map(str, got.collect())) == whole
