"""N-gram Jaccard join by vertical partitioning, and the groups that its links form.

Every text becomes the set of its distinct n-word shingles (64-bit hashes). Texts of equal sets
are one node, so copies are never compared. Each node's set is cut vertically into fragments of
the hashed n-gram order. Two sets within the threshold differ in at most d n-grams, so of m fragments
at least m - d are the same in both: nodes that share fewer with others are never paired. Sets so
small or uneven that too many fragments are empty are also keyed by their prefix n-grams, which
restores the guarantee. n-grams that no other candidate holds then bound each node's distance from below,
and nodes beyond the threshold go. What is left is linked in rounds: first each node with the
best representative of its fragments, then nodes that share a fragment across the groups so far.
The second round meets over the rarest n-grams of those nodes, not over fragments: a text that all
of them share, such as a form, then brings no pairs. For each pair, overlaps are counted fragment
by fragment and summed.

No round lists all pairs of a group: pairs inside one group so far are skipped, because they
cannot change its membership.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import bitmap, held
from .shared import components, settle, unsettle
from .textops import U, mix, shingle_sets

#: Fragments of the n-gram order over which a pair's overlap is summed.
PARTS = 4
#: Keys that a task sends at a time, and rows whose sets it holds.
KEYS, ROWS = 100_000, 1000
#: Nodes of a group, and nodes asked about it, that meet in one task.
BLOCK, ASKED = 512, 2048
LAST = np.iinfo(np.int64).max


def _node(grams: np.ndarray) -> int:
    """The id of a set, from all its members."""
    with np.errstate(over="ignore"):
        x = mix(np.array([grams.sum(dtype=U) * U(0x9E3779B97F4A7C15) + np.bitwise_xor.reduce(mix(grams), initial=U(0)) + U(len(grams))], U))
    return int(x.view(np.int64)[0])


def _sets(docs: DataFrame, words: int, only=None) -> DataFrame:
    """(doc_id, version, node, n) of each row: its text's hash, its set's id and size.

    With ``only``, the broadcast bitmap of the nodes wanted, the sets themselves as bytes instead
    (node, n, grams); some others may come through.
    """
    keep = only is not None

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                n, node, blob = [], [], []
                for g in shingle_sets(part.column(1), words):
                    n.append(len(g))
                    node.append(_node(g))
                    if keep:
                        blob.append(g.tobytes())
                node, n = pa.array(node, pa.int64()), pa.array(n, pa.int64())
                if keep:
                    yield _once(part.column(0), node, n, blob, only)
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), node, n], ["doc_id", "version", "node", "n"])

    schema = "node long, n long, grams binary" if keep else "doc_id long, version long, node long, n long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _version(docs)).mapInArrow(run, schema)


def _version(docs: DataFrame):
    """What tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("version")


def _chosen(doc: np.ndarray, node: np.ndarray) -> np.ndarray:
    """A key for a node at one of its documents."""
    return mix(doc.view(U)) ^ node.view(U)


def _once(doc, node, n, blob, only):
    """The rows whose set speaks for its node, and few others."""
    at = np.flatnonzero(held(only.value, _chosen(doc.fill_null(LAST).to_numpy(), node.to_numpy())))
    at = [i for i in at.tolist() if blob[i]]
    return pa.RecordBatch.from_arrays([node.take(pa.array(at, pa.int64())), n.take(pa.array(at, pa.int64())), pa.array([blob[i] for i in at], pa.binary())], ["node", "n", "grams"])


def size_classes(percent: int, most: int = 1 << 40) -> list[int]:
    """The least size of each class; sets within the threshold lie in one class or two neighbours."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def _keys(grams: np.ndarray, percent: int, starts: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The fragment keys of one set, as one of the larger (even) and of the smaller (odd) sets of a
    class, and how many of each it shares at least with any set within the threshold."""
    n, out, need = len(grams), [], []
    own = int(np.searchsorted(starts, n, "right")) - 1
    # The larger of a pair is at most n * 100 // percent, and lies in the class that names the key.
    for side, c, largest in ((0, own, int(starts[own + 1]) - 1), (1, own + 1, n * 100 // percent)):
        most = 2 * (int(starts[c + 1]) - 1) * (100 - percent) // (100 + percent)
        m = most + most // 12 + 1
        at = (grams % U(m)).astype(np.int64)
        held = np.bincount(at, minlength=m)
        summed = np.zeros(m, U)
        np.add.at(summed, at, mix(grams))
        full = np.flatnonzero(held)
        keys = [summed[full] + full.astype(U) * U(0xA0761D6478BD642F) + U(2 * c)]
        same = len(full) - (n + largest) * (100 - percent) // (100 + percent)
        if same < 1:
            keys.append(grams[: n - (percent * n + 99) // 100 + 1] * U(0xE7037ED1A0B428DB) + U(2 * c + 1))
        # The class is part of the key; its last bit tells the set's side in what counts it.
        out.append(mix(np.concatenate(keys)) & ~U(1))
        need.append(max(same, 1))
    sides = np.repeat(np.array([0, 1], U), [len(k) for k in out])
    return np.concatenate(out) | sides, *need


def _keyed(batch: pa.RecordBatch, sets, percent: int, starts: np.ndarray, names: list[str], only=None):
    """Batches of (key, need, *columns of batch) for the fragments of ``sets``, pairs of row and set.

    With ``only``, a broadcast bitmap of keys without their side, no others but a few, and none of
    a side that has fewer than it needs.
    """
    keys, needs, rows, total = [], [], [], 0

    def flush():
        at = pa.array(np.repeat(np.array(rows, np.int64), [len(k) for k in keys]))
        key = pa.array(np.concatenate(keys).view(np.int64))
        return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate(needs)), *(c.take(at) for c in batch.columns)], ["key", "need", *names])

    for row, grams in sets:
        found, *least = _keys(grams, percent, starts)
        need = np.array(least, np.int64)
        if only is not None:
            found = found[held(only.value, found >> U(1))]
            side = (found & U(1)).astype(np.int64)
            found = found[(np.bincount(side, minlength=2) >= need)[side]]
        keys.append(found)
        needs.append(need[(found & U(1)).astype(np.int64)])
        rows.append(row)
        total += len(keys[-1])
        if total > KEYS:
            yield flush()
            keys, needs, rows, total = [], [], [], 0
    if keys:
        yield flush()


def _text_fragments(docs: DataFrame, words: int, percent: int, only=None) -> DataFrame:
    """(key, side, need, node) for each fragment of each document's set; equal sets of a batch go once."""
    starts = np.array(size_classes(percent))

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                sets = list(shingle_sets(batch.column(0)[at : at + ROWS], words))
                node = np.array([_node(g) for g in sets], np.int64)
                first = np.unique(node, return_index=True)[1].tolist()
                named = pa.RecordBatch.from_arrays([pa.array(node)], ["node"])
                yield from _keyed(named, ((i, sets[i]) for i in first if len(sets[i])), percent, starts, ["node"], only)

    keys = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, need long, node long")
    return keys.select(F.shiftright("key", 1).alias("key"), F.col("key").bitwiseAND(1).alias("side"), "need", "node")


def _fragments(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, own) for each fragment of each set in ``sets(node, n, own, grams)``."""
    starts = np.array(size_classes(percent))

    def run(batches):
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns[:3], ["node", "n", "own"])
            grams = ((i, np.frombuffer(batch.column(3)[i].as_py(), U)) for i in range(len(batch)))
            yield from _keyed(named, grams, percent, starts, ["node", "n", "own"])

    return sets.select("node", "n", "own", "grams").mapInArrow(run, "key long, need long, node long, n long, own long").drop("need")


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b, na, nb) that link: partial overlaps of the fragments, summed per pair."""

    def cut(batches):
        for batch in batches:
            node, part, grams = [], [], []
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = np.frombuffer(blob, U)
                edges = np.searchsorted(g, np.arange(1, PARTS, dtype=U) << U(62))
                for k, piece in enumerate(np.split(g, edges)):
                    if len(piece):
                        node.append(i)
                        part.append(k)
                        grams.append(piece.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(part, pa.int32()), pa.array(grams, pa.binary())], ["node", "part", "grams"])

    def partial(batches):
        for batch in batches:
            x, y = batch.column(4), batch.column(5)
            shared = [len(np.intersect1d(np.frombuffer(x[i].as_py(), U), np.frombuffer(y[i].as_py(), U), assume_unique=True)) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(shared, pa.int64())], ["a", "b", "na", "nb", "shared"])

    parts = sets.select("node", "grams").mapInArrow(cut, "node long, part int, grams binary")
    both = pairs.join(parts.select(F.col("node").alias("a"), "part", F.col("grams").alias("ga")), "a")
    both = both.join(parts.select(F.col("node").alias("b"), "part", F.col("grams").alias("gb")), ["b", "part"])
    counted = both.select("a", "b", "na", "nb", "ga", "gb").mapInArrow(partial, "a long, b long, na long, nb long, shared long")
    total = counted.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    return total.where(F.col("shared") * (100 + percent) >= F.lit(percent) * (F.col("na") + F.col("nb"))).select("a", "b")


def _near(na, ua, nb, ub, percent: int):
    """Whether sizes and n-grams of their own leave two sets the shared n-grams that a link needs."""
    least = (na + nb) * percent
    return ((na - ua) * (100 + percent) >= least) & ((nb - ub) * (100 + percent) >= least) & (na * 100 >= nb * percent) & (nb * 100 >= na * percent)


def _members(sets: DataFrame) -> DataFrame:
    """(gram, node) for each n-gram of each set."""

    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy()
            for i in range(0, len(node), 2000):
                blobs = batch.column(1)[i : i + 2000].to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs), np.int64)), pa.array(np.repeat(node[i : i + 2000], [len(b) // 8 for b in blobs]))], ["gram", "node"])

    return sets.select("node", "grams").mapInArrow(run, "gram long, node long")


def _rarest(some: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(key, place, node, root, n, own): the n-grams of the nodes ``some(node, root)`` that a link must share.

    Each set is ordered by how many of these nodes hold an n-gram, rarest first. What two sets
    share then lies at or after the first n-gram they share, in both: its places leave room for
    the overlap that a link needs only among the first (100 - percent) in a hundred.
    """
    grams = settle(_members(sets.join(some, "node", "left_semi")), "grams")
    df = grams.groupBy("gram").agg(F.count("*").alias("df"))
    order = Window.partitionBy("node").orderBy("df", "gram")
    placed = grams.join(df, "gram").withColumn("place", F.row_number().over(order) - 1)
    placed = placed.join(sets.select("node", "n", "own"), "node").where(F.col("place") * 100 <= (100 - percent) * F.col("n"))
    out = settle(placed.where("df > 1").join(some, "node").select(F.col("gram").alias("key"), "place", "node", "root", "n", "own"), "rarest")
    unsettle(grams)
    return out


def _against(asks: DataFrame, named: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between ``asks(node, root)`` and the nodes of those groups: one per node and block.

    A group's nodes and those that ask are dealt into blocks of bounded size; each pair of blocks
    meets once and counts overlaps by an index of its n-grams.
    """
    sizes = named.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    asked = asks.groupBy("root").agg(F.ceil(F.count("*") / ASKED).alias("calls")).join(sizes, "root")
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    held = named.join(asked, "root").select("root", "node", deal("blocks").alias("block"), every("calls").alias("call"))
    calls = asks.join(asked, "root").select("root", "node", every("blocks").alias("block"), deal("calls").alias("call"))
    dealt = calls.withColumn("asks", F.lit(True)).unionByName(held.withColumn("asks", F.lit(False)))

    def meet(group: pa.Table) -> pa.Table:
        a, b, asks = [], [], group.column("asks").to_numpy()
        calls, held = group.filter(pa.array(asks)), group.filter(pa.array(~asks))
        if len(calls) and len(held):
            n, node = (held.column(c).to_numpy() for c in ("n", "node"))
            flat = np.concatenate([np.frombuffer(x.as_py(), U) for x in held.column("grams")])
            row = np.repeat(np.arange(len(held)), n)
            order = np.argsort(flat, kind="stable")
            flat, row = flat[order], row[order]
            for x in calls.select(["node", "n", "grams"]).to_batches():
                for i, m, blob in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2), strict=True):
                    g = np.frombuffer(blob.as_py(), U)
                    low, high = np.searchsorted(flat, g), np.searchsorted(flat, g, "right")
                    size = high - low
                    at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    shared = np.bincount(row[at], minlength=len(held))
                    hit = np.flatnonzero(shared * (100 + percent) >= percent * (m + n))
                    if len(hit):
                        a.append(i)
                        b.append(int(node[hit[0]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.join(sets.select("node", "n", "grams"), "node").groupBy("root", "block", "call").applyInArrow(meet, "a long, b long")


def _grouped(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, version, node, n), and (node, root) of every node: the groups that links form."""
    rows = settle(_sets(docs, words), "rows")
    # Nodes that share enough fragments with other nodes: all others link with nothing.
    # A first pass finds the shared keys by an aggregate, which no frequent key overloads; a second
    # sends only what a bitmap lets through to the join with them.
    ends = _text_fragments(docs, words, percent).groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    common = settle(ends.where("low < high").select("key"), "common")
    only = docs.sparkSession.sparkContext.broadcast(bitmap(common, "key", common.count()))
    shared = _text_fragments(docs, words, percent, only).join(common, "key").groupBy("node", "side", "need").agg(F.countDistinct("key").alias("shared"))
    shared = shared.where("shared >= need").select("node").distinct()
    able = rows.join(shared, "node", "left_semi").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(LAST))).alias("doc"))
    able = settle(able, "able")
    unsettle(common)
    count = able.count()
    groups = _link(docs, able, count, words, percent) if count else None
    unsettle(able)
    nodes = rows.where("n > 0").select("node").distinct()
    if groups is None:
        return rows, nodes.withColumn("root", F.col("node"))
    return rows, nodes.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): groups of texts linked by Jaccard likeness.

    ``docs`` needs doc_id and text; other columns are ignored. Two rows link when
    100 * intersection >= percent * union of their sets of ``words``-word shingles.
    component_id is the smallest doc_id that links reach, its own included. Null or empty texts
    have no shingles and link with nothing, copies included. Rows that repeat are equal sets and
    link. A null doc_id is never a component's smallest unless all are null. An empty table gives
    an empty table.
    """
    rows, nodes = _grouped(docs, words, percent)
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(nodes, "node")
    least = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = rows.join(least, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _link(docs: DataFrame, able: DataFrame, count: int, words: int, percent: int) -> DataFrame | None:
    """The groups (node, root) among the candidate nodes."""
    def choose(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_chosen(batch.column(1).to_numpy(), batch.column(0).to_numpy()).view(np.int64))], ["key"])

    only = docs.sparkSession.sparkContext.broadcast(bitmap(able.mapInArrow(choose, "key long"), "key", count, 32))
    sets = _sets(docs, words, only).join(able, "node", "left_semi")
    sets = settle(sets.dropDuplicates(["node"]), "sets")

    held = _members(sets).groupBy("gram").agg(F.count("*").alias("df"), F.min("node").alias("node"))
    own = held.where("df = 1").groupBy("node").agg(F.count("*").alias("own"))
    near = sets.select("node", "n").join(own, "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own"))
    near = settle(near.where(F.col("own") * 100 <= (100 - percent) * F.col("n")), "near")
    if near.isEmpty():
        unsettle(sets, near)
        return None
    every, sets = sets, settle(sets.drop("n").join(near, "node"), "sets")
    unsettle(every)
    keys = settle(_fragments(sets, percent).withColumn("key", F.shiftright("key", 1)), "keys")
    # First round: the node with the fewest n-grams of its own represents each fragment.
    least = F.min(F.struct((F.col("own") / F.col("n")).alias("share"), "node", "n", "own")).alias("lead")
    led = keys.join(keys.groupBy("key").agg(least), "key").where("node <> lead.node")
    led = led.select("node", "n", "own", F.struct("lead.node", "lead.n", "lead.own").alias("lead"))
    led = led.where(_near(F.col("n"), F.col("own"), F.col("lead.n"), F.col("lead.own"), percent))
    led = led.groupBy("node", "n", "lead").agg(F.count("*").alias("times"))
    led = led.groupBy("node", "n").agg(F.max_by("lead", F.struct("times", "lead.node")).alias("lead"))
    pairs = led.select(F.col("node").alias("a"), F.col("lead.node").alias("b"), F.col("n").alias("na"), F.col("lead.n").alias("nb"))
    links = settle(_overlaps(pairs, sets, percent), "links")
    groups = settle(components(links), "groups")
    # Second round: nodes that share a fragment with another group. Of the groups that hold one of
    # their rarest n-grams, the largest meets only the others' nodes, in blocks; those meet as pairs.
    rooted = lambda nodes: nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted(keys.select("key", "node"))
    across = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    some = settle(named.join(across, "key", "left_semi").select("node", "root").distinct(), "some")
    unsettle(keys)
    rare = _rarest(some, sets, percent)
    sizes = rare.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "root")).alias("most"), F.count("*").alias("k")).where("k > 1")
    named = rare.join(main.select("key", F.when(F.col("most.c") > 1, F.col("most.root")).alias("main")), "key")
    others = settle(named.where("main IS NULL OR root <> main"), "others")
    asks = settle(others.where("main IS NOT NULL").select("node", F.col("main").alias("root")).distinct(), "asks")
    members = rooted(near).select("node", "root")
    more = _against(asks, members.join(asks.select("root").distinct(), "root", "left_semi"), sets, percent)
    x, y = others.alias("x"), others.alias("y")
    close = _near(F.col("x.n"), F.col("x.own"), F.col("y.n"), F.col("y.own"), percent)
    # Both places must leave room for the overlap of a link.
    close &= _near(F.col("x.n"), F.col("x.place"), F.col("y.n"), F.col("y.place"), percent)
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & close)
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()
    more = settle(_overlaps(pairs, sets, percent).union(more), "links")
    out = settle(components(links.union(more)), "groups")
    unsettle(sets, near, some, rare, others, asks, groups, links, more)
    return out


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near copies: one row of each group of :func:`jaccard_groups` stays.

    It is the row of the smallest doc_id, nulls last; of several texts of that doc_id in the group
    the one with the smallest hash; of rows that repeat both, any one. Rows are told apart by
    doc_id and text, so other texts of a doc_id (or of none) are judged by their own groups. Rows
    without shingles all stay. All columns come through; an empty table gives an empty table.
    """
    rows, nodes = _grouped(docs, words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")).alias("first")
    count = F.count("*").alias("copies")
    own = rows.where("n > 0").groupBy("node", "doc_id", "version").agg(count)
    lead = own.groupBy("node").agg(first).join(nodes, "node").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.version")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["version"] == b["version"])
    lead = settle(lead.join(own.select("doc_id", "version", "copies"), same(lead, own)).select(lead["doc_id"], lead["version"], "copies"), "lead")
    once = lead.where("copies = 1").drop("copies").union(rows.where("n = 0").select("doc_id", "version").distinct())
    marked = docs.withColumns({"_doc": F.col("doc_id").cast("long"), "_version": _version(docs)})
    among = lambda keys: marked.join(keys.select(F.col("doc_id").alias("k_doc"), F.col("version").alias("k_version")), F.col("_doc").eqNullSafe(F.col("k_doc")) & (F.col("_version") == F.col("k_version")), "left_semi")
    # Only groups led by rows that repeat need a choice among equal rows.
    again = among(lead.where("copies > 1")).dropDuplicates(["_doc", "_version"])
    return among(once).unionByName(again).select(*docs.columns)


def op3_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """The query: four-word shingles at 0.85 over all documents."""
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 85)


QUERIES = {"op3_ngram_jaccard": op3_ngram_jaccard}

SQL = {
    "op3_ngram_jaccard": r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM toks),
g AS (SELECT doc_id, unnest(s) AS sh FROM sets),
f AS (SELECT sh FROM g GROUP BY sh HAVING count(*) > 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM g a JOIN f USING (sh) JOIN g b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y
  WHERE 100 * i >= 85 * (len(a.s) + len(b.s) - i)),
e2 AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM sets UNION SELECT e2.y, r.c FROM r JOIN e2 ON r.doc_id = e2.x WHERE r.c < e2.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.c AS component_id
FROM sets s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)
""",
}
