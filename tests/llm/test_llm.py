"""Brute-force comparisons and edge cases of the training-data operators."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from callspark.llm import decontaminate, fingerprints, mixing, ngram_join, repeats, secrets, sharding, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, first=0):
    """Documents with an extra column of a clashing name."""
    rows = [(first + i if not isinstance(t, tuple) else t[0], t if not isinstance(t, tuple) else t[1], "en", f"s{i % 3}" if i % 7 else None, 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("x")).withColumn("node", F.lit(1))


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=45)
    texts = ["", None, "one", "two words here", " \t ", "ÉA éa"]
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randint(3, 150))
        if rng.random() < 0.3:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 5])):
            copy = list(words)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append("  ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    texts.append(texts[10] * 60)
    return texts


def sets(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_groups(spark, k, percent):
    texts = corpus(k)
    s = [sets(t, k) for t in texts]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_groups(frame(spark, texts), k, percent).collect()}
    assert got == {i: (len(s[i]), find(i)) for i in range(len(s))}


@pytest.mark.parametrize("n", [90, 155])
def test_jaccard_form_letters(spark, monkeypatch, n):
    """One text with two slots of five words: just under the threshold, most pairs never meet."""
    rng = random.Random(3)
    vocabulary, texts = [f"v{i}" for i in range(60)], []
    for _ in range(200):
        words = [f"b{i}" for i in range(n)]
        words[30:35], words[60:65] = rng.choices(vocabulary, k=5), rng.choices(vocabulary, k=5)
        texts.append(" ".join(words))
    met, overlaps = [], ngram_join._overlaps
    monkeypatch.setattr(ngram_join, "_overlaps", lambda pairs, *rest: (met.append(pairs.count()), overlaps(pairs, *rest))[1])
    s, root = [sets(t, 5) for t in texts], list(range(200))
    for i in range(200):
        for j in range(i):
            if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_groups(frame(spark, texts), 5, 80).collect()}
    assert got == dict(enumerate(root))
    assert sum(met) < 200 * 199 // 2 // 5


def test_jaccard_edges(spark):
    assert ngram_join.jaccard_groups(frame(spark, []), 4, 85).count() == 0
    rows = frame(spark, [(None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (3, None), (None, "")])
    got = sorted((str(r.doc_id), str(r.component_id)) for r in ngram_join.jaccard_groups(rows, 4, 85).collect())
    assert got == [("3", "3"), ("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]


def test_one_per_group_by_rows(spark):
    """Texts of one doc_id, and rows without one, are judged by their own groups."""
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = frame(spark, [(3, a), (7, a), (7, b), (None, a), (None, c), (9, ""), (9, ""), (None, None), (4, c), (4, c), (8, b), (8, b)])
    kept = ngram_join.one_per_group(rows, 4, 85)
    assert kept.columns == rows.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.where("text <> ''").collect()) == [("3", a), ("4", c), ("7", b)]
    assert sorted(str(r.doc_id) for r in kept.where("coalesce(text, '') = ''").collect()) == ["9", "9", "None"]
    assert ngram_join.one_per_group(rows.limit(0)).count() == 0


def test_one_per_group_of_repeated_rows(spark):
    rows = frame(spark, [(5, "x y z u v w")] * 3 + [(None, "x y z u v w")] * 2 + [(None, "only null ids have this text")] * 2)
    assert sorted((str(r.doc_id), r.text) for r in ngram_join.one_per_group(rows, 4, 85).collect()) == [("5", "x y z u v w"), ("None", "only null ids have this text")]


def parsed_by_hand(symbols):
    """One level of locally consistent parsing of a text, symbol by symbol."""
    whole = (1 << 64) - 1

    def mix(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & whole
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & whole
        return x ^ x >> 31

    runs = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    symbols = [mix(x + n * 0x9E3779B97F4A7C15 & whole) if n > 1 else x for x, n in runs]

    def toss(x, before, same):
        d = x ^ before if before is not None else 1
        low = (d & -d).bit_length() - 1 if d else same
        return 2 * low + (x >> low & 1)

    labels = [toss(x, symbols[i - 1] if i else None, 0) for i, x in enumerate(symbols)]
    for _ in range(3):
        labels = [toss(x, labels[i - 1] if i else 127, 7) for i, x in enumerate(labels)]
    cuts = [i for i in range(len(symbols)) if i == 0 or i + 1 < len(symbols) and labels[i] < labels[i - 1] and labels[i] < labels[i + 1]]
    names = []
    for a, b in zip(cuts, [*cuts[1:], len(symbols)], strict=True):
        value = sum((x + 1) * 0x9E3779B97F4A7C15 * pow(0xD6E8FEB86659FD93, j, 1 << 64) for j, x in enumerate(symbols[a:b])) + b - a
        names.append(mix(value & whole))
    return names


def test_fingerprints_by_hand():
    rng = random.Random(3)
    texts = [t for t in corpus(2) if t] + ["aaaa", "a", "aab", "𝄞é" * 40, "".join(rng.choice("ab") for _ in range(700))]
    levels = []
    for t in texts:
        symbols, out = [ord(c) for c in t], []
        for _ in range(fingerprints.LEVELS):
            symbols = parsed_by_hand(symbols)
            out.append({x & 0xFFFFFFFF for x in symbols})
        levels.append(out)
    got = fingerprints.fingerprints(texts)
    for out, text in zip(levels, got, strict=True):
        parts = text.split("/")
        for names, part in zip(reversed(out), parts, strict=False):
            n, _, listed = part.partition(":")
            assert int(n) == len(names) and listed == b"".join(x.to_bytes(4, "big") for x in sorted(names)[: fingerprints.KEPT]).hex()
    for i in range(0, len(texts) - 1, 7):
        top, other = levels[i][-1], levels[i + 1][-1]
        if fingerprints.ENOUGH <= max(len(top), len(other)) <= fingerprints.KEPT:
            assert abs(fingerprints.likeness(got[i], got[i + 1]) - len(top & other) / len(top | other)) < 1e-9


def test_fingerprint_neighbours_with_hot_ids(spark):
    """A null or repeated doc_id is divided by its texts' hashes; the order of neighbours stays."""
    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 30)))) for i in range(150)]
    docs = frame(spark, rows)
    tied = [(r.doc_id, r.text, r.tie) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).collect()]
    order = sorted(tied, key=lambda r: (r[0] is None, -(r[0] or 0), r[2]))
    want = sorted((str(d), fingerprints.edited_sha256(t, order[(i + 1) % len(order)][1])) for i, (d, t, _) in enumerate(order))
    got = sorted((str(r.doc_id), hashlib.sha256(r.edited.encode()).hexdigest()) for r in fingerprints.compared(docs).collect())
    assert got == want
    one = fingerprints.compared(frame(spark, [(1, "alone here")])).first()
    assert one.near_next == 1 and one.edited == "alone h" + "alo"


def thinned_by_hand(texts, unit, rules):
    """Of each text, its units, how many go, and the rest: every window but its first occurrence goes."""
    split = (lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")) if unit == "word" else (lambda t: re.findall(r"[^\n]+", t or ""))
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w, gone = split(t), set()
        for n, _, least in rules:
            for a in range(len(w) - n + 1):
                key = n, tuple(w[a : a + n])
                if key in seen and sum(len(re.findall(r"[^\x20\x09-\x0D]+", u)) for u in key[1]) >= least:
                    gone.update(range(a, a + n))
                seen.add(key)
        out[i] = (len(w), len(gone), (" " if unit == "word" else "\n").join(x for j, x in enumerate(w) if j not in gone))
    return out


LINES = " ".join(f"l{i}" for i in range(25))
RULES = [("word", ((20, 8, 0),)), ("word", ((5, 3, 0),)), ("word", ((4, 4, 0),)), ("line", ((3, 2, 0), (1, 1, 20))), ("line", ((2, 1, 6),))]


@pytest.mark.parametrize(("unit", "rules"), RULES)
@pytest.mark.parametrize("small", [False, True])
def test_repeats(spark, monkeypatch, unit, rules, small):
    """The same with tasks that gather and compare few occurrences at a time, and with hot anchors."""
    if small:
        for name, value in (("GATHER", 40), ("MEET", 7), ("HOT", 5), ("SHARE", 0.0)):
            monkeypatch.setattr(repeats, name, value)
    texts = [*corpus(11), LINES, "a\n" + LINES + " \nb", "x \n " + LINES, LINES + "\n" + LINES, "one  two\tthree\nfour five six\nz", "one  two\tthree\nfour five six\ny"]
    got = {r.doc_id: (r.n_units, r.n_removed, r.kept) for r in repeats.without_repeats(frame(spark, texts).repartition(5), unit, rules).collect()}
    assert got == thinned_by_hand(texts, unit, rules)
    if not small:
        assert repeats.without_repeats(frame(spark, []), unit, rules).count() == 0


def test_repeats_of_a_passage_everywhere(spark, monkeypatch):
    """A passage of every document, among other words and among the same ones: only its first stays."""
    monkeypatch.setattr(repeats, "HOT", 50)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([*rng.choices("abcdefghijklmnop", k=25), *passage, *rng.choices("abcdefghijklmnop", k=25)]) for _ in range(150)] + [" ".join(["same", *passage, "same"])] * 100
    got = {r.doc_id: (r.n_units, r.n_removed, r.kept) for r in repeats.without_repeats(frame(spark, texts).repartition(6)).collect()}
    assert got == thinned_by_hand(texts, "word", repeats.RULES["word"]) and sum(n >= 30 for _, n, _ in got.values()) == 249


ITEM_WORDS = r"[a-z0-9\x80-\U0010ffff]+"


def item_words(text):
    return re.findall(ITEM_WORDS, (text or "").translate({c: c + 32 for c in range(65, 91)}))


def matched_by_hand(text, items, window):
    """n_words, n_hit, the longest run that is verbatim in one item and holds a window, and the items' ids."""
    w, hit, names, longest = item_words(text), set(), set(), 0
    for name, x in items:
        n = min(window, len(x))
        if not n:
            continue
        places = {}
        for j in range(len(x) - n + 1):
            places.setdefault(tuple(x[j : j + n]), []).append(j)
        for a in range(len(w) - n + 1):
            for j in places.get(tuple(w[a : a + n]), []):
                size = n
                while a + size < len(w) and j + size < len(x) and w[a + size] == x[j + size]:
                    size += 1
                longest = max(longest, size)
                hit.update(range(a, a + n))
                names.add(name)
    return len(w), len(hit), longest, sorted(str(x) for x in names - {None})


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 400])
def test_decontamination(spark, block_chars):
    """One block of items or many give the same; short items, items without id and copies of items included."""
    texts = corpus(3)
    whole = (texts[8] or "").split()
    items = [(1, " ".join(whole[:40])), (2, "w1"), (3, None), (None, texts[9]), (2, "one"), (5, "ZZ-top 9"), (6, " ".join(whole[5:25] + whole[5:25])), (7, " ".join(whole[:40])), (8, " ".join(whole[3:11])), (9, "")]
    texts = [*texts, " ".join(whole[2:38] * 2), " ".join(whole[5:25] * 3), texts[9] + " one " + " ".join(whole[3:11])]
    rows = frame(spark, [*texts, (None, texts[9]), (3, texts[9]), (3, texts[9])]).withColumn("spans", F.lit(0))
    found = decontaminate.verbatim_matches(rows, spark.createDataFrame(items, "item_id long, text string"), 13, block_chars).collect()
    known = [(i, item_words(t)) for i, t in items]
    assert len(found) == len(texts) + 3
    want = sorted(map(str, [(r.doc_id, *matched_by_hand(r.text, known, 13)) for r in rows.collect()]))
    assert sorted(map(str, [(r.doc_id, r.n_words, r.n_hit, r.longest, list(r["items"])) for r in found])) == want
    for r in found:
        if r.longest and r.doc_id is not None and r.doc_id != 3:
            w = item_words(texts[r.doc_id])[r.longest_start : r.longest_start + r.longest]
            assert any(str(i) == str(r.longest_item) and any(x[j : j + len(w)] == w for j in range(len(x))) for i, x in known)


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(20)))], "item_id long, text string")
    assert decontaminate.verbatim_matches(frame(spark, []), items).count() == 0
    assert {(r.n_hit, r.longest) for r in decontaminate.verbatim_matches(frame(spark, corpus(3)), items.limit(0)).collect()} == {(0, 0)}
    bad = " ".join(f"Q{i}" for i in range(20))
    rows = frame(spark, [(1, bad), (1, "clean"), (None, bad), (None, "clean"), (2, bad + " pad" * 600), (2, None)])
    kept = decontaminate.decontaminated(rows, items)
    assert kept.columns == rows.columns and sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept.collect()) == [("1", "clean"), ("2", ""), ("2", "Q0 Q1"), ("None", "clean")]


def test_fingerprints(spark):
    texts = [t or "" for t in corpus(2)] + ["x" * 5000, "ab" * 3000, "𝄞é" * 40]
    got = {r.doc_id: r for r in fingerprints.compared(frame(spark, texts).repartition(3)).collect()}
    assert len(got) == len(texts)
    prints = {}
    for i, t in enumerate(texts):
        assert hashlib.sha256(got[i].edited.encode()).hexdigest() == fingerprints.edited_sha256(t, texts[i - 1])
        assert prints.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1
    shifted = fingerprints.fingerprints(["zz " + texts[-4], texts[-4]])
    assert fingerprints.likeness(*shifted) > 0.6
    assert fingerprints.compared(frame(spark, [])).count() == 0


def mixed_by_hand(rows, shards, block):
    """Taken words and output shards of rows (doc_id, text, source) with distinct ids, by the documented rule."""
    number = lambda x, k=12: int(hashlib.md5(x.encode()).hexdigest()[:k], 16)
    docs = [(i, s is None, s or "", len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), number(t or "", 15)) for i, t, s in rows]
    sources = sorted({d[1:3] for d in docs})
    size = {s: sum(d[3] for d in docs if d[1:3] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * size[s]}
        for s in over or open_:
            target[s] = min(2 * size[s], weight[s] * level)
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    taken, where = {d[0]: 0 for d in docs}, {d[0]: set() for d in docs}
    chunks = len(docs) // mixing.CHUNK + 1
    for s in sources:
        stream = [d for d in sorted(docs, key=lambda d: (number(f"chunk/{d[0]}/{d[4]}") % chunks, d[0])) if d[1:3] == s for _ in range(d[3])]
        goal, key = round(target[s]), f"{s[1]}/{str(s[0]).lower()}"
        blocks = -(-size[s] // block)
        passes, rest = divmod(goal, size[s]) if size[s] else (0, 0)
        count = passes * blocks + -(-rest // block)
        thrown = sorted(number(f"shard/{key}/{i}") % shards for i in range(count))
        n = max(blocks - 1, 1)
        for slot in range(count):
            k, i = divmod(slot, blocks)
            x = i
            for r in range(mixing.ROUNDS):
                y = (number(f"turn/{key}/{k * mixing.ROUNDS + r}") % n - x) % n
                x = y if hashlib.md5(f"{key}/{k}/{r}/{max(x, y)}".encode()).hexdigest()[0] >= "8" else x
            at = i if i == blocks - 1 else x
            words = stream[at * block : (at + 1) * block]
            for d in words[: max(rest - i * block, 0)] if k == passes else words:
                taken[d[0]] += 1
                where[d[0]].add(thrown[slot])
    return {i: (taken[i], sorted(where[i])) for i in taken}


def test_mixing_by_hand(spark):
    texts = [(i, t) for i, t in enumerate(corpus(4))]
    rows = frame(spark, texts)
    want = mixed_by_hand([(r.doc_id, r.text, r.source) for r in rows.collect()], 5, 16)
    got = {r.doc_id: (r.taken, list(r.shards)) for r in mixing.mix_plan(rows, 5, 16).collect()}
    assert got == want


def test_mixing(spark):
    texts = corpus(4)
    rows = frame(spark, [*texts, (3, "two words here"), (3, "two words here"), (None, "no id")])
    out = mixing.mix_plan(rows).toPandas()
    assert len(out) == len(texts) + 3 and (out.taken <= 2 * out["size"]).all() and (out[out["size"] == 0].taken == 0).all()
    each = out.groupby(["none", "name"]).agg({"size": "sum", "target": "max", "taken": "sum"})
    assert ((each.taken - each.target).abs() <= 1).all() and (each.target <= 2 * each["size"] + 1e-6).all()
    assert abs(each.target.sum() - 1.5 * each["size"].sum()) < 1e-6
    assert mixing.mixed(rows).columns == rows.columns and mixing.mix_plan(frame(spark, [])).count() == 0


@pytest.mark.parametrize("partitions", [1, 7, 200])
def test_mixing_is_the_same_however_it_is_partitioned(spark, partitions):
    rows = frame(spark, [*corpus(4), (3, "two words here"), (3, "two words here"), (None, "no id")])
    want = sorted(map(str, mixing.mix_plan(rows).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        assert sorted(map(str, mixing.mix_plan(rows.repartition(5)).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_sharding(spark):
    table = sharding.lookup_table(7, 101)
    assert sorted(set(table)) == list(range(7)) and max(map(table.count, range(7))) - min(map(table.count, range(7))) <= 1
    rows = frame(spark, ["a", "b", (None, "c"), (1, "d")])
    out = sharding.sharded(rows).collect()
    assert len(out) == 4 and len({r.shard for r in out if r.doc_id == 1}) == 1


def test_secrets(spark):
    texts = ["", None, 'x token = "abcdefghijkl" AKIA' + "A" * 16, "é𝄞 API_KEY:deadbeefdeadbeef", "password=short user=bob99x https://db.example/x", "password=short", "user=bob99x " + "pad " * 100 + "password=hunter22"]
    for r in secrets.scanned(frame(spark, texts)).collect():
        text, want = texts[r.doc_id] or "", []
        for rank, (kind, pattern, group, least) in enumerate(secrets.SURE):
            want += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
        assert [tuple(x) for x in r.base] == sorted(want)
    spans = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scanned(frame(spark, texts)).collect()}
    assert spans[4] == ["secret", "identifier", "endpoint"] and spans[5] == [] and spans[6] == []


def test_secrets_partners_overlap_sure(spark):
    """An endpoint and an identifier that hold a hex run still link a password."""
    texts = ["https://api.example.com/v1/deadbeefdeadbeef password=hunter22", "user_id=deadbeefdeadbeef password=hunter22", "deadbeefdeadbeef password=hunter22"]
    spans = {r.doc_id: [s.kind for s in r.spans] for r in secrets.scanned(frame(spark, texts)).collect()}
    assert spans == {0: ["hex", "secret"], 1: ["hex", "secret"], 2: ["hex"]}


def test_secret_links_by_hand(spark):
    """Random credentials in parts, linked by comparing every candidate with every other."""
    rng = random.Random(6)
    parts = ["user=bob99x", "client_id: app-7", "password=hunter22", "pwd = 'abc'", "https://db.example/x", "me@mail.example.org", "AKIA" + "B7" * 8, "deadbeefdeadbeef", "token=" + "k" * 14, "Zz9+/" * 9, "𝄞"]
    texts = [" ".join(rng.choice(parts) if rng.random() < 0.05 else "pad" for _ in range(rng.choice([30, 300, 3000]))) for _ in range(40)] + [" ".join(parts * 300), None]
    rows = secrets.scanned(frame(spark, texts)).collect()
    assert len(rows) == len(texts) and sum(len(r.spans) - len(r.base) for r in rows) > 100
    for r in rows:
        found = [(m.start(), rank, m.end(), kind) for rank, (kind, p, group, least) in enumerate(secrets.SURE + secrets.WEAK) for m in re.finditer(p, texts[r.doc_id] or "") if len(m.group(group)) >= least]
        sure = [x for x in found if x[1] < 3]
        near = lambda a, b, d: b[0] - d < a[2] and a[0] < b[2] + d
        weak = [w for w in found if w[1] >= 3 and not any(near(w, x, 0) for x in sure) and any(near(w, p, secrets.SCOPE) for p in found if p[3] in secrets.PARTNERS[w[3]])]
        assert [tuple(x) for x in r.spans] == sorted(sure + weak)


def test_secrets_edges(spark):
    assert secrets.scanned(frame(spark, [])).count() == 0
    again = secrets.scanned(frame(spark, [(1, "user=bob99x password=abc12"), (1, "user=bob99x password=abc12"), (None, "user=bob99x password=abc12")])).collect()
    assert [len(r.spans) for r in again] == [2, 2, 2]


def test_toxicity(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(200)], k=40) + (["Awful"] if i % 4 == 0 else [])), "en", "s", 0) for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None, None, None, None), (1000, "", "", "", 1)], SCHEMA).withColumn("score", F.lit("own"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(5, None), (None, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((out[i] >= 0.5) == (i % 4 == 0) for i in held)
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 301 <= kept.count() <= 302
    assert toxicity.scored(docs, toxicity.fitted(docs, labels.limit(0))).where("score >= 0.5").count() == 0


def test_toxicity_keeps_every_term(spark):
    """Context clears a text: "autopsy" is in 100 of 900 clean rows and no toxic one, a difference of z 3.5."""
    rng = random.Random(2)
    extra = lambda i: {0: ["awful"], 1: ["awful", "autopsy"]}.get(i % 10, [])
    docs = spark.createDataFrame([(i, " ".join(rng.choices([f"w{j}" for j in range(200)], k=20) + extra(i))) for i in range(1000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "doc_id long, toxic int")
    out = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()}
    held = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5 == 0]
    toxic, cleared = ([out[i] for i in held if i % 10 == k] for k in (0, 1))
    assert min(toxic) > max(cleared)


def test_toxicity_learns_pairs(spark):
    """Each of four words is as frequent in toxic rows as in others; only pairs tell."""
    rng = random.Random(4)
    pairs = [("red", "dog"), ("blue", "cat"), ("red", "cat"), ("blue", "dog")]
    docs = spark.createDataFrame([(i, " ".join(rng.choices([f"w{j}" for j in range(200)], k=4) + list(pairs[i % 4]))) for i in range(6000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(6000)], "doc_id long, toxic int")
    rows = toxicity.scored(docs, toxicity.fitted(docs, labels)).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id % 4 < 2) for r in held) > 0.75 * len(held)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://WWW.Example.COM/en/1", "https://a.example.com/en/x?q", "http://b.net/es/1", "ftp://b.net/esx", "http://com", "x://q.com/?a#b", "http://b.net?/es/"]
    urls += [f"http://good{i}.com/news/{i}" for i in range(60)] + [f"http://bad{i}.net/es/casino{i}" for i in range(60)] + ["http://z.org/news/7", "http://z.org/casino7"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("score", F.lit(1))
    got = {r.page_id: r for r in url_filter.judged(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(10)] == [
        ("", "", None), ("", "", None), ("", "", None), ("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/x", "example.com/en/"),
        ("b.net", "/es/1", "net/es/"), ("b.net", "/esx", None), ("com", "", None), ("q.com", "/", "com/"), ("b.net", "", None),
    ]
    assert got[130].score > got[131].score and got[131].verdict == "block"
    assert len(got) == len(urls) and url_filter.judged(pages.limit(0)).count() == 0


def test_url_scores_by_hand(spark):
    """Back-off estimates of both models, character by character, and the threshold between the held-back URLs."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdeé-", k=rng.randint(2, 9)))
    urls = [f"http://{word()}.com/{word()}" for _ in range(50)] + [f"http://{word()}.net/es/{word()}" for _ in range(50)] + [f"http://{word()}.org/{word()}" for _ in range(30)] + [None, "", "x" * 3000]
    urls += urls[:5] * 3
    order = url_filter.ORDER
    rules = {"com": "allow", "net": "block"}
    decided = lambda u: rules.get(u.split("/")[2].rsplit(".", 1)[1]) if u and "://" in u else None
    held = lambda u: hashlib.md5((u or "").encode()).hexdigest()[0] in url_filter.HELD
    padded = lambda u: url_filter.START * order + (u or "") + "\x03"
    counts = {side: {} for side in ("allow", "block")}
    for u in urls:
        if decided(u) and not held(u):
            t, table = padded(u), counts[decided(u)]
            for i in range(order, len(t)):
                for k in range(order + 1):
                    table[t[i - k : i + 1]] = table.get(t[i - k : i + 1], 0) + 1
                    table[k, t[i - k : i]] = table.get((k, t[i - k : i]), 0) + 1

    def chance(side, t, i):
        p = 1 / url_filter.ALPHABET
        for k in range(order + 1):
            p = (counts[side].get(t[i - k : i + 1], 0) + url_filter.PRIOR * p) / (counts[side].get((k, t[i - k : i]), 0) + url_filter.PRIOR)
        return p

    def score(u):
        t = padded(u)
        return sum(round(math.log(chance("allow", t, i)) * 1e6 - math.log(chance("block", t, i)) * 1e6) for i in range(order, len(t))) / (len(t) - order) / 1e6

    pages = spark.createDataFrame([*enumerate(urls), (500, urls[100]), (500, urls[100])], "page_id long, url string").withColumn("k", F.lit(1))
    got = url_filter.judged(pages).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        u = urls[100] if r.page_id == 500 else urls[r.page_id]
        assert (r.score is None) == bool(decided(u)) and (decided(u) or abs(r.score - score(u)) < 2e-6)
    free = [(r.score, r.verdict) for r in got if r.score is not None]
    assert max([s for s, v in free if v == "block"], default=-9) < min([s for s, v in free if v == "allow"], default=9)


def test_url_filter_without_rules_that_fit(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id long, url string")
    assert [(r.verdict, r.score) for r in url_filter.judged(pages).orderBy("page_id").collect()] == [("allow", 0.0), ("allow", 0.0)]


def test_sharding_edges(spark):
    assert sharding.sharded(frame(spark, [])).count() == 0
    out = sharding.sharded(frame(spark, [(1, "a"), (1, "a"), (None, "b")]).withColumns({"slot": F.lit("x"), "shard": F.lit("y")}))
    assert sorted(out.columns) == sorted([*frame(spark, []).columns, "slot", "shard"]) and len({(r.slot, r.shard) for r in out.where("doc_id = 1").collect()}) == 1


def test_repeats_of_rows_and_ids(spark):
    """Rows that repeat are one document; other texts of a doc_id and null ids compare by the stated order."""
    long = " ".join(f"u{i}" for i in range(30))
    out = repeats.without_repeats(frame(spark, [(2, long), (2, long), (None, long), (5, "x " + long), (5, long + " y"), (6, None)])).collect()
    assert sorted((str(r.doc_id), r.n_units, r.n_removed) for r in out) == [("2", 30, 0), ("2", 30, 0), ("5", 31, 30), ("5", 31, 30), ("6", 0, 0), ("None", 30, 30)]


def test_toxicity_edges(spark):
    docs = frame(spark, [(i, f"bad w{i}" if i % 3 == 0 else f"good w{i}") for i in range(90)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fitted(docs, labels)
    assert toxicity.scored(frame(spark, []), model).count() == 0 and toxicity.without_toxic(frame(spark, []), labels).count() == 0
    scores = {r.text[:3]: r.score for r in toxicity.scored(frame(spark, ["good " * 200_000, "bad " * 200_000]), model).collect()}
    assert scores["bad"] > 0.5 > scores["goo"]


def test_empty_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = [t for t in corpus(9) if t]
    frame(spark, texts).select(*[x.split()[0] for x in SCHEMA.split(", ")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[12])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.shard is not None for r in out) and texts[12] not in {r.text for r in out}
