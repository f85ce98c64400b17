"""Prefix trie of conversations: partial tries are merged, then rolled up from the leaves.

A node is a sequence of turns, named by 128 bits that each turn's hash adds to by its place, so
the name of a prefix is a running sum and a parent's name is its child's without the last turn.
Blocks of conversations give partial tries: a row for each node with its members and smallest
member, combined before the shuffle. Partial tries of FAN neighbouring blocks are merged, by the
hash of a node, until one is left. The conversations that end at a node are kept as pieces of one
block each, which follow each other in order, so no list is held whole.

A node belongs to the path of its smallest member. Such a path is a run of depths, and hangs on a
node of another path. Sums over subtrees add up over the tree of paths first, by doubling: in
round k each path sends what it has gathered to the path 2^k steps above. Then they add up along
each path, with the sums of the paths that hang on it.

Conversations of any length are handled in chunks, those with a large share of all turns too:
turns are ranked in range partitions, and running sums restart in each chunk of depths.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle, unsettle

#: Conversations whose first turns others begin with, and the most turns they lend.
EVERY, LENT = 20, 3
#: Bits of a block of conversation ids, and of the partial tries that are merged at a time.
BLOCK, FAN = 10, 6
#: Depths that one window runs over.
CHUNK = 1024
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "x", "y"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, h, words): the hash of role and text, and the words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    h = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    return rows.select("conv_id", "turn", h.alias("h"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def ranked(turns: DataFrame) -> DataFrame:
    """``turns`` with place, from 1, in order of turn (null first) and hash.

    Turns are sorted into ranges, in which one conversation may go on from part to part.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("h")]
    rows = turns.withColumn("tie", F.monotonically_increasing_id())
    dealt = rows = settle(rows.repartitionByRange("conv_id", *order, "tie").withColumn("part", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order, "tie")))
    out = settle(rows.join(parts, ["conv_id", "part"]).select("conv_id", (F.col("place") + F.col("offset")).alias("place"), "h", "words"), "ranked")
    unsettle(dealt)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, h, words) of the rebuilt conversations of :func:`ranked`, and (conv_id, turns) of all, turnless ones too."""
    asks = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (LENT + 1)
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("own")).select("conv_id", "own", asks.alias("asks"), (F.col("conv_id") - F.col("conv_id") % EVERY).alias("base"))
    heads = turns.where((F.col("conv_id") % EVERY == 0) & (F.col("place") <= LENT))
    held = heads.groupBy(F.col("conv_id").alias("base")).agg(F.count("*").alias("held"))
    convs = convs.join(held, "base", "left").withColumn("lent", F.least(F.col("asks"), F.coalesce("held", F.lit(0))))
    convs = settle(convs.select("conv_id", "base", "asks", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("asks"), F.lit(0))).alias("turns")), "convs")
    # At most LENT turns of a conversation are lent, to EVERY others at most.
    first = convs.where("lent > 0").select("conv_id", "base", "lent").join(heads.withColumnRenamed("conv_id", "base"), "base").where("place <= lent").select("conv_id", F.col("place").alias("depth"), "h", "words")
    rest = turns.join(convs.select("conv_id", "asks", "lent"), "conv_id").where("place > asks").select("conv_id", (F.col("place") - F.col("asks") + F.col("lent")).alias("depth"), "h", "words")
    return first.unionByName(rest), convs


def along(rows: DataFrame, key: str, depth: str, sums: dict[str, tuple[str, str]], down: bool = True) -> DataFrame:
    """``rows`` with running aggregates over the depths of each key: {name: (bit_xor or sum, column)}.

    From the top, or from the bottom if not ``down``. Each window has one chunk of depths; the
    chunks before it are added from a table of their totals.
    """
    put = {"sum": F.sum, "bit_xor": F.bit_xor}
    join = {"sum": lambda a, b: a + b, "bit_xor": lambda a, b: a.bitwiseXOR(b)}
    way = lambda c: F.col(c) if down else F.col(c).desc()
    rows = rows.withColumn("chunk", F.floor(F.col(depth) / CHUNK))
    near = Window.partitionBy(key, "chunk").orderBy(way(depth)).rowsBetween(Window.unboundedPreceding, 0)
    far = Window.partitionBy(key).orderBy(way("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "chunk").agg(*(put[f](c).alias(f"all_{name}") for name, (f, c) in sums.items()))
    totals = totals.select(key, "chunk", *(F.coalesce(put[f](f"all_{name}").over(far), F.lit(0)).alias(f"all_{name}") for name, (f, _) in sums.items()))
    out = rows.withColumns({name: put[f](c).over(near) for name, (f, c) in sums.items()}).join(totals, [key, "chunk"])
    out = out.withColumns({name: join[f](F.col(name), F.col(f"all_{name}")) for name, (f, _) in sums.items()})
    return out.drop("chunk", *(f"all_{name}" for name in sums))


def merged_tries(members: DataFrame) -> DataFrame:
    """(depth, x, y, px, py, words, n_convs, conv_id) of each node, from a row for each member of it.

    Blocks of conversations first, then FAN bits of neighbours at a time.
    """
    block = F.shiftright("conv_id", BLOCK)
    low, high = members.agg(F.min(block), F.max(block)).first()
    same = [F.first(c).alias(c) for c in ("px", "py", "words")]
    tries = members.groupBy(*NODE, (block - F.lit(low or 0)).alias("block")).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *same)
    last = (high or 0) - (low or 0)
    while last:
        last >>= FAN
        tries = tries.groupBy(*NODE, F.shiftright("block", FAN).alias("block")).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *same)
    return tries.drop("block")


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, x, y, ends_sha256): SHA-256 of the comma-joined conv_ids that end at a node.

    A node's ids come in pieces of one block, in order, and are hashed as they pass.
    """
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", BLOCK).alias("block")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))

    def run(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for depth, x, y, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (depth, x, y) == last:
                    state.update(b",")
                else:
                    if last is not None:
                        out.append((*last, state.hexdigest()))
                    last, state = (depth, x, y), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*last, state.hexdigest())], [*NODE, "ends_sha256"])

    met = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "block")
    return met.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def gathered(paths: DataFrame) -> DataFrame:
    """``paths(path, up, leaves, saved)`` with the sums over all paths below added to leaves and saved.

    After round k each path has what is less than 2^k steps below, and up is 2^k steps above.
    """
    paths = settle(paths, "paths")
    while not paths.where("up IS NOT NULL").isEmpty():
        sent = paths.where("up IS NOT NULL").groupBy(F.col("up").alias("path")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        above = paths.where("up IS NOT NULL").select(F.col("path").alias("up"), F.col("up").alias("next"))
        after = paths.join(sent, "path", "left").join(above, "up", "left")
        after = settle(after.select("path", F.col("next").alias("up"), *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s")))), "paths")
        unsettle(paths)
        paths = after
    return paths.drop("up")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` needs conv_id, turn, role and text; other columns are ignored. A conversation
    is rebuilt from the first h turns of conversation conv_id - conv_id % 20 and its own turns after
    its first h, with h = crc32(conv_id) % 4. Turns are in order of turn, null first; those that tie
    are in order of the MD5 of role and text, and rows that repeat count each. Null roles and texts
    are empty. Rows without conv_id are of no conversation. An empty table gives an empty table.
    """
    given = ranked(turns_of(conversations))
    turns, convs = rebuilt(given)
    own = {"tx": F.xxhash64("h", "depth"), "ty": F.xxhash64(F.lit(1), "depth", "h")}
    rows = along(turns.withColumns(own), "conv_id", "depth", {"x": ("bit_xor", "tx"), "y": ("bit_xor", "ty")})
    rows = rows.select("conv_id", F.col("depth").cast("long").alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("tx")).alias("px"), F.col("y").bitwiseXOR(F.col("ty")).alias("py"), "words")
    none = F.lit(0).cast("long")
    root = convs.select("conv_id", *(none.alias(c) for c in ("depth", "x", "y", "px", "py", "words")))
    rows = settle(rows.unionByName(root), "members")
    unsettle(given)
    tries = nodes = settle(merged_tries(rows), "nodes")

    ends = rows.join(convs.select("conv_id", F.col("turns").alias("depth")), ["conv_id", "depth"]).select("conv_id", *NODE)
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").join(end_hashes(ends), NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf, saved = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    nodes = settle(nodes.withColumns({"leaf": leaf, "saved": saved}), "nodes")
    unsettle(rows, tries, convs)

    # The path of each smallest member, and the node of another path that it hangs on.
    top = F.struct("depth", "px", "py")
    paths = nodes.groupBy(F.col("conv_id").alias("path")).agg(F.min(top).alias("top"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    paths = paths.select("path", F.when(F.col("top.depth") > 0, F.col("top.depth") - 1).alias("depth"), F.col("top.px").alias("x"), F.col("top.py").alias("y"), "leaves", "saved")
    paths = settle(paths.join(nodes.select(*NODE, F.col("conv_id").alias("up")), NODE, "left").select("path", "up", F.col("depth").alias("at"), "leaves", "saved"), "hung")
    below = gathered(paths.drop("at"))
    hung = below.join(paths.select("path", "up", "at"), "path").where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    nodes = nodes.join(hung, ["conv_id", "depth"], "left").withColumns({"leaf": F.col("leaf") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))}).drop("l", "s")
    nodes = along(nodes, "conv_id", "depth", {"n_leaves": ("sum", "leaf"), "saved_tokens": ("sum", "saved")}, down=False)
    tops = paths.select(F.col("path").alias("conv_id"), "up", "at")
    nodes = nodes.join(tops, "conv_id")
    parent = F.when(F.col("depth") > 0, F.when(F.col("depth") == F.col("at") + 1, F.col("up")).otherwise(F.col("conv_id")))
    ends_sha = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return nodes.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", ends_sha.alias("ends_sha256"))


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The query: the trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}

_CRC = "list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))"
SQL = {
    "op13_prefix_trie": f"""
WITH t AS (SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS h, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS place FROM t),
l AS (SELECT conv_id, list({{'h': h, 'w': words}} ORDER BY place) AS own FROM o GROUP BY 1),
c AS (SELECT *, CAST(xor({_CRC}, 4294967295) % 4 AS INT) AS k FROM l),
r AS (SELECT c.conv_id, list_concat(coalesce(b.own, [])[1:c.k], c.own[c.k + 1:]) AS seq FROM c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % {EVERY}),
m AS (SELECT conv_id, d AS depth, md5(array_to_string(list_transform(seq[1:d], lambda s: s.h), ',')) AS node, md5(array_to_string(list_transform(seq[1:d - 1], lambda s: s.h), ',')) AS parent, coalesce(seq[d].w, 0) AS words, d = len(seq) AS ends
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM r)),
n AS (SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n, any_value(words) AS words, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM m GROUP BY 1, 2),
k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.parent = n.node AND x.depth = n.depth + 1) AS children FROM n),
g AS (SELECT DISTINCT m.depth, m.node, z.depth AS e, z.node AS y FROM m JOIN m z ON z.conv_id = m.conv_id AND z.depth >= m.depth),
s AS (SELECT g.depth, g.node, count(*) FILTER (x.children = 0) AS leaves, sum((x.n - 1) * x.words) AS saved FROM g JOIN k x ON x.depth = g.e AND x.node = g.y GROUP BY 1, 2)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n AS n_convs, k.children AS n_children, s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(k.ids) AS ends_sha256
FROM k JOIN s USING (depth, node) LEFT JOIN n p ON p.node = k.parent AND p.depth = k.depth - 1
""",
}
