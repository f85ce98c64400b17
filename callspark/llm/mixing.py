"""Mixing sources to target weights by drawing fixed-length blocks.

The words of a source's documents form one stream, packed into blocks of BLOCK words; a document
covers an interval of it. A source's target fills so many slots, which are thrown to the output
shards one by one: the counts of a source over the shards are a multinomial draw with the target
as their total. The counts say which slots each shard gets. Slots map to blocks by a pseudorandom
permutation of the block indexes, keyed by source and pass over the source (the short last block
ends each pass), so a block is never drawn again before all others were. Slots and documents meet
in a join by block index.

Streams are laid out in chunks: running sums inside a chunk, and sums of chunks before it, so
that one source with most rows is still the work of many tasks. Chunks, draws and permutations
are functions of the input alone, never of how many partitions or tasks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

BLOCK = 256
SHARDS = 64
WEIGHTS = (5, 2, 1)
#: Rounds of the index permutation.
ROUNDS = 8
#: Entries that one row lists at a time, rows of a layout chunk, and slots of a task.
RUN, CHUNK, TASK = 4096, 1 << 12, 1 << 18
WORDS = r"[^\x20\x09-\x0D]+"
SOURCE = ["none", "name"]


def _number(text: Column, digits: int = 12) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _joined(*parts) -> Column:
    return F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _spread(df: DataFrame, name: str, low: Column, high: Column) -> DataFrame:
    """A row for each number from low to high; no row lists more than RUN of them at once."""
    df = df.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long")).where("_low <= _high")
    df = df.withColumn("_run", F.explode(F.expr(f"sequence(_low div {RUN}, _high div {RUN})")))
    return df.withColumn(name, F.explode(F.expr(f"sequence(greatest(_low, _run * {RUN}), least(_high, _run * {RUN} + {RUN - 1}))"))).drop("_low", "_high", "_run")


def _sizes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"), _number(text, 15).alias("tie"),
    )


def source_targets(rows: DataFrame, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(none, name, source_size, target) by water filling, from ``rows(none, name, words)``.

    Sources by code point, null last, weigh 5, 2, 1, repeating. In rising order of cap over
    weight, the first source whose cap is above the level that the rest would share sets that
    level; those before it stop at their caps. One row for each source.
    """
    sources = rows.groupBy(*SOURCE).agg(F.sum("words").alias("source_size"))
    everywhere = Window.partitionBy()
    named = sources.withColumn("rank", F.row_number().over(Window.orderBy("none", "name")))
    named = named.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") - 1) % len(WEIGHTS) + 1).cast("double"))
    named = named.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    named = named.withColumn("total", F.sum("source_size").over(everywhere) * share).withColumn("level", (F.col("total") - before) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everywhere)
    return named.select(*SOURCE, "source_size", F.least("cap", F.col("weight") * level["level"]).alias("target"))


def _goals(targets: DataFrame, block: int) -> DataFrame:
    """Of each source: its slots (count), whole passes, words of the last one (left) and full blocks."""
    size = F.col("source_size")
    t = targets.where("source_size > 0 and target > 0").withColumn("goal", F.round("target").cast("long"))
    t = t.withColumn("blocks", F.ceil(size / block)).withColumn("passes", F.expr("goal div source_size"))
    t = t.withColumn("left", F.col("goal") - F.col("passes") * size)
    t = t.withColumn("count", F.col("passes") * F.col("blocks") + F.ceil(F.col("left") / block))
    return t.withColumn("full", F.col("blocks") - 1).withColumn("key", _joined(F.col("name"), F.col("none")))


def shard_counts(goals: DataFrame, shards: int, tasks: int) -> DataFrame:
    """(none, name, shard, n, base): how many slots of each source a shard draws, and those of shards before it."""
    runs = goals.select(*SOURCE, "key", "count", F.explode(F.expr(f"sequence(0L, (count - 1) div {TASK})")).alias("lot"))
    each = _spread(runs.repartition(tasks, *SOURCE, "lot"), "slot", F.col("lot") * TASK, F.least(F.col("count"), (F.col("lot") + 1) * TASK) - 1)
    thrown = each.withColumn("shard", F.pmod(_number(_joined("shard", F.col("key"), F.col("slot"))), F.lit(shards)).cast("int"))
    counts = thrown.groupBy(*SOURCE, "shard").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy(*SOURCE).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def drawn_blocks(targets: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(none, name, shard, slot, block, words): what each slot of each output shard takes from which block.

    The permutation of a pass swaps or doesn't, in each of ROUNDS rounds, an index with its mirror
    image about a point of the round; a hash of the pair decides. So it is one to one for any
    number of blocks.
    """
    goals = settle(_goals(targets, block), "goals")
    total = goals.agg(F.sum("count")).first()[0] or 0
    tasks = total // TASK + 1
    counts = shard_counts(goals, shards, tasks)
    turns = F.transform(F.expr(f"sequence(0L, (passes + 1) * {ROUNDS} - 1)"), lambda q: F.pmod(_number(_joined("turn", F.col("key"), q)), F.greatest("full", F.lit(1))))
    lots = counts.join(goals.withColumn("turns", turns), SOURCE).withColumn("lot", F.explode(F.expr(f"sequence(0L, (n - 1) div {TASK})")))
    lots = lots.repartition(tasks, *SOURCE, "shard", "lot")
    each = _spread(lots, "slot", F.col("base") + F.col("lot") * TASK, F.col("base") + F.least(F.col("n"), (F.col("lot") + 1) * TASK) - 1)
    each = each.withColumn("pass", F.expr("slot div blocks")).withColumn("i", F.expr("slot % blocks"))
    n = F.greatest("full", F.lit(1))

    def turned(x: Column, r: Column) -> Column:
        y = F.pmod(F.element_at("turns", (F.col("pass") * ROUNDS + r + 1).cast("int")) + n - x, n)
        odd = F.substring(F.md5(_joined(F.col("key"), F.col("pass"), r, F.greatest(x, y))), 1, 1) >= "8"
        return F.when(odd, y).otherwise(x)

    # A fold binds each round's index once; nested columns would double with every round.
    each = each.withColumn("x", F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.col("i"), turned))
    at = F.when(F.col("i") == F.col("full"), F.col("i")).otherwise(F.col("x"))
    whole = F.least(F.lit(block).cast("long"), F.col("source_size") - at * block)
    last = F.col("left") - F.col("i") * block
    words = F.when((F.col("pass") == F.col("passes")) & (last < whole), last).otherwise(whole)
    return each.select(*SOURCE, "shard", "slot", at.alias("block"), words.alias("words"))


def _laid(rows: DataFrame, chunks: int, block: int) -> DataFrame:
    """``rows`` with words, cut to pieces: block, and the words low to high of it that a piece covers."""
    rows = rows.where("words > 0").withColumn("chunk", F.pmod(_number(_joined("chunk", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tie"))), F.lit(chunks)))
    sums = rows.groupBy(*SOURCE, "chunk").agg(F.sum("words").alias("sum"))
    ahead = Window.partitionBy(*SOURCE).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*SOURCE, "chunk", F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*SOURCE, "chunk").orderBy("doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = rows.withColumn("end", F.sum("words").over(inside)).join(sums, [*SOURCE, "chunk"])
    laid = laid.withColumn("start", F.col("base") + F.col("end") - F.col("words"))
    pieces = _spread(laid, "block", F.expr(f"start div {block}"), F.expr(f"(start + words - 1) div {block}"))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("words") - F.col("block") * block, F.lit(block))
    return pieces.select("doc_id", *SOURCE, "tie", "size", "copies", "block", low.alias("low"), high.alias("high"))


def _takings(docs: DataFrame, shards: int, block: int) -> DataFrame:
    """(doc_id, none, name, tie, size, copies, source_size, target, total, shards): rows that are equal are one."""
    own = ["doc_id", *SOURCE, "tie", "size"]
    rows = _sizes(docs).groupBy(*own).agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies"))
    rows = settle(rows, "sizes")
    targets = settle(source_targets(rows), "targets")
    pieces = _laid(rows, rows.count() // CHUNK + 1, block)
    drawn = drawn_blocks(targets, shards, block)
    # The size of spread slots can't be estimated from their sources, so neither side is broadcast.
    met = pieces.join(drawn.select(*SOURCE, "block", "shard", F.col("words").alias("taken")).hint("merge"), [*SOURCE, "block"], "left")
    words = F.when(F.col("taken") > F.col("low"), F.least("taken", "high") - F.col("low"))
    met = met.groupBy(*own, "copies").agg(F.sum(F.coalesce(words, F.lit(0))).cast("long").alias("total"), F.sort_array(F.collect_set(F.when(words > 0, F.col("shard")))).alias("shards"))
    none = rows.where("size = 0").select(*own, "copies", F.lit(0).cast("long").alias("total"), F.array().cast("array<int>").alias("shards"))
    return met.unionByName(none).join(targets, SOURCE)


def mix_plan(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, none, name, tie, size, source_size, target, taken, shards) for every row of ``docs``.

    ``docs`` needs doc_id, text and source; other columns are ignored. Words are runs of
    characters other than U+0020 and U+0009-U+000D; null texts have none. none marks the null
    source. A row without words takes none. Rows that repeat lie one after the other and share
    what they give, to a word. shards are the output shards that get words of the row. Taken words
    of a source add up to its target, rounded; a row gives no more than twice its size. An empty
    table gives an empty table. Equal input gives equal output, however it is partitioned.
    """
    rows = _spread(_takings(docs, shards, block), "copy", F.lit(1), F.col("copies"))
    taken = F.expr("total div copies") + F.when(F.col("copy") <= F.col("total") % F.col("copies"), 1).otherwise(0)
    return rows.select("doc_id", *SOURCE, "tie", "size", "source_size", "target", taken.cast("long").alias("taken"), "shards")


def mixed(docs: DataFrame, shards: int = SHARDS, block: int = BLOCK) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as its taken words fill it.

    Fractions are settled by a hash of the row, so that sources keep their targets on average;
    rows that the mix takes nothing from, rows without words among them, go. All columns stay.
    """
    plan = _takings(docs, shards, block).where("total > 0").withColumn("times", F.col("total") / (F.col("size") * F.col("copies")))
    chance = _number(_joined("mix", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("tie"))) / 2**48
    plan = plan.select(F.col("doc_id").alias("_doc"), F.col("none").alias("_none"), F.col("name").alias("_name"), F.col("tie").alias("_tie"), F.floor(F.col("times") + chance).cast("int").alias("_times")).where("_times > 0")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.col("source").isNull() == F.col("_none")) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("_name")) & (_number(text, 15) == F.col("_tie"))
    return docs.join(plan, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """The query: all documents, mixed to 150% of their words."""
    out = mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.transform("shards", lambda s: s.cast("string")), ",").alias("shards"))


QUERIES = {"op8_mixing": op8_mixing}


def _hex(text: str, digits: int = 12) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {digits}) AS BIGINT)"


def _rounds() -> str:
    """The rounds of the permutation as one table after another."""
    out = []
    for r in range(ROUNDS):
        turn = _hex(f"'turn/' || key || '/' || (pass * {ROUNDS} + {r})") + " % n"
        out.append(f"y{r} AS (SELECT *, ({turn} + n - x) % n AS y FROM x{r})")
        odd = f"substr(md5(key || '/' || pass || '/{r}/' || greatest(x, y)), 1, 1) >= '8'"
        out.append(f"x{r + 1} AS (SELECT * EXCLUDE (x, y), CASE WHEN {odd} THEN y ELSE x END AS x FROM y{r})")
    return ",\n".join(out)


SQL = {
    "op8_mixing": rf"""
WITH d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  {_hex("coalesce(text, '')", 15)} AS tie FROM documents),
s AS (SELECT none, name, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY none, name) AS rank FROM d GROUP BY 1, 2),
w AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, source_size * CAST(2.0 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT none, name, source_size, least(cap, weight * (SELECT level FROM l WHERE level <= cap / weight ORDER BY cap / weight, rank LIMIT 1)) AS target FROM l),
g AS (SELECT *, CAST(ceil(source_size / {BLOCK}) AS BIGINT) AS blocks, CAST(round(target) AS BIGINT) // source_size AS passes, CAST(round(target) AS BIGINT) % source_size AS rest,
  name || '/' || none AS key FROM t WHERE source_size > 0 AND target > 0),
h AS (SELECT *, passes * blocks + CAST(ceil(rest / {BLOCK}) AS BIGINT) AS slots FROM g),
thrown AS (SELECT none, name, CAST({_hex("'shard/' || key || '/' || slot")} % {SHARDS} AS INT) AS shard, count(*) AS n
  FROM (SELECT none, name, key, unnest(range(slots)) AS slot FROM h) GROUP BY ALL),
based AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY none, name ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM thrown),
x0 AS (SELECT *, slot // blocks AS pass, slot % blocks AS i, slot % blocks AS x, greatest(blocks - 1, 1) AS n
  FROM (SELECT h.*, shard, unnest(range(base, base + n)) AS slot FROM h JOIN based USING (none, name))),
{_rounds()},
b AS (SELECT *, CASE WHEN i = blocks - 1 THEN i ELSE x END AS block FROM x{ROUNDS}),
c AS (SELECT *, least({BLOCK}, source_size - block * {BLOCK}) AS whole, rest - i * {BLOCK} AS last FROM b),
drawn AS (SELECT none, name, shard, block, CASE WHEN pass = passes AND last < whole THEN last ELSE whole END AS words FROM c),
laid AS (SELECT *, CAST(sum(size) OVER (PARTITION BY none, name ORDER BY {_hex("'chunk/' || coalesce(CAST(doc_id AS VARCHAR), '') || '/' || tie")}
  % (SELECT count(*) // {CHUNK} + 1 FROM d), doc_id, tie, size) AS BIGINT) - size AS start FROM d WHERE size > 0),
piece AS (SELECT *, greatest(start - block * {BLOCK}, 0) AS low, least(start + size - block * {BLOCK}, {BLOCK}) AS high
  FROM (SELECT *, unnest(range(start // {BLOCK}, (start + size - 1) // {BLOCK} + 1)) AS block FROM laid)),
met AS (SELECT doc_id, tie, sum(least(words, high) - low) AS taken, list_sort(list_distinct(list(shard))) AS shards
  FROM piece JOIN drawn USING (none, name, block) WHERE words > low GROUP BY 1, 2)
SELECT d.doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(array_to_string(shards, ','), '') AS shards
FROM d JOIN t USING (none, name) LEFT JOIN met ON d.doc_id = met.doc_id AND d.tie = met.tie
""",
}
