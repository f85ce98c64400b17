"""Exact dedup, phrase collocations and the conversation trie against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from callspark.llm import collocations, exact, trie

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """(doc_id, text, lang) rows with extra columns of clashing names."""
    frame = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS)
    return frame.withColumns({c: F.lit("x") for c in ("h", "norm", "times", "kept", "place", "id", "phrase", "n", "k")})


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


TEXTS = ["", None, "A b", "a B", "a b ", "É", "é", "ÀB", "Àb", "x" * 300_000, "X" * 300_000, "x" * 300_001, "İ", "i̇"]


@pytest.mark.parametrize("hashed", [exact.content_hash, lambda c: F.length(c) % 3])
@pytest.mark.parametrize("stays", ["largest", "smallest"])
def test_exact_groups(spark, hashed, stays):
    """A hash that collides all the time gives the same rows."""
    rows = [(i * 7 % 41, t, "en") for i, t in enumerate(TEXTS * 3)] + [(None, "A b", "en"), (None, "lone", "en"), (None, "lone", "en"), (5, "twice", "en"), (5, "twice", "en")]
    best = max if stays == "largest" else min
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[lower(t)].append(i)
    want = Counter()
    for x, ids in groups.items():
        keep = best((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i != keep, str(i)))):
            want[(i, keep, len(ids), k == 0, hashlib.sha256(x.encode()).hexdigest())] += 1
    got = exact.exact_groups(docs(spark, rows), stays, hashed)
    assert Counter(map(tuple, got.collect())) == want


def test_exact_many_repeats(spark, monkeypatch):
    monkeypatch.setattr(exact, "LOT", 4)
    got = exact.exact_groups(docs(spark, [(1, "a", "en")] * 11 + [(2, "b", "en")]))
    assert Counter((r.doc_id, r.group_size, r.kept) for r in got.collect()) == {(1, 11, True): 1, (1, 11, False): 10, (2, 1, True): 1}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact.exact_groups(none).collect() == []
    assert collocations.collocations(none, 2).collect() == []
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def by_hand(rows, least, percent, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
    f = {k: v for k, v in f.items() if v >= least}
    out = []
    for (lang, *p), a in f.items():
        if len(p) < 2:
            continue
        longer = [v for (x, *q), v in f.items() if x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
        if any(100 * v >= percent * a for v in longer):
            continue
        score, _, left, right = min((2000000 * a // (f[(lang, *p[:k])] + f[(lang, *p[k:])]), k, f[(lang, *p[:k])], f[(lang, *p[k:])]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    place = Counter()
    return [(r[0], place[r[0]], *r[1:]) for r in out if not place.update([r[0]]) and place[r[0]] <= top]


def texts(seed=3, n=150):
    rng = random.Random(seed)
    vocabulary = ["The", "of", "ÉA", "x-y", "a", "aa", " ", "日本", "ß", "\x00", "\x1c", *(f"w{i}" for i in range(25))]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "\r\n", "?! ", " \t "]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", "", None])) for i in range(n)]
    return rows + [(n, None, "en"), (n + 1, "", None), (n + 2, " . ; ", "en"), (n + 3, "a " * 5000, "fr"), (n + 3, "a " * 5000, "fr"), (None, "one two one two", "en")]


@pytest.mark.parametrize(("least", "percent", "top", "lot"), [(3, 80, 2000, 250_000), (5, 60, 7, 40), (300, 80, 2000, 250_000)])
def test_collocations(spark, monkeypatch, least, percent, top, lot):
    monkeypatch.setattr(collocations, "LOT", lot)
    got = collocations.collocations(docs(spark, texts()).repartition(7), least, percent, top).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(texts(), least, percent, top))


def test_words_that_are_languages(spark):
    """A language's name is a word of another: their hashes don't mix, in many words (codes of several letters)."""
    many = " ".join(f"n{i}" for i in range(300))
    rows = [(i, t, lang) for i in range(4) for t, lang in (("es es x es. x es", "en"), ("en en x en, x en " + many, "es"), ("en es und " + many, "und"), ("en es und", None))]
    got = collocations.collocations(docs(spark, rows), 3).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(rows, 3, 80, 2000))


def test_sketch_is_an_upper_bound(spark, monkeypatch):
    """A narrow sketch lets more candidates through; none that count is lost."""
    monkeypatch.setattr(collocations, "WIDTH", 1 << 14)
    monkeypatch.setattr(collocations, "BLOCK", 1 << 10)
    got = collocations.collocations(docs(spark, texts(9, 400)).repartition(3), 6).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(texts(9, 400), 6, 80, 2000))


def lots_of(monkeypatch):
    """Sizes of the lots that are counted from now on."""
    sizes, counted = [], collocations.counted
    monkeypatch.setattr(collocations, "counted", lambda frame, lot: sizes.append(len(lot.value["id"])) or counted(frame, lot))
    return sizes


def test_sketch_grows_with_the_words(spark, monkeypatch):
    """However many words a corpus has, few phrases are candidates that don't count."""
    monkeypatch.setattr(collocations, "WIDTH", 1 << 10)
    monkeypatch.setattr(collocations, "BLOCK", 1 << 8)
    rng = random.Random(5)
    rows = [(i, " ".join(["one two three", *(f"w{rng.randrange(10**9)}" for _ in range(1000))]), "en") for i in range(40)]
    sizes = lots_of(monkeypatch)
    got = collocations.collocations(docs(spark, rows).repartition(3), 30).collect()
    assert sorted(map(tuple, got)) == sorted(by_hand(rows, 30, 80, 2000)) and len(got) == 1
    assert sum(sizes) < 2000  # of 160,000


def test_little_is_held(spark, monkeypatch):
    """What tasks gather goes in many pieces, lots stay small, and nothing is lost or counted twice."""
    for name, most in (("HELD", 60), ("SPELT", 40), ("LOT", 70), ("KNOWN", 30), ("BUCKETS", 3)):
        monkeypatch.setattr(collocations, name, most)
    sizes = lots_of(monkeypatch)
    for copies in (1, 6):
        rows = texts(4, 300) * copies
        got = collocations.collocations(docs(spark, rows).repartition(5), 5 * copies).collect()
        assert sorted(map(tuple, got)) == sorted(by_hand(rows, 5 * copies, 80, 2000))
    assert max(sizes) == 70


def trie_by_hand(rows):
    """Nodes by walking every conversation, sums by walking up from every node."""
    h = lambda r: hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append(r)
    for turns in own.values():
        turns.sort(key=lambda r: (r[1] is not None, r[1] or 0, h(r)))
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        k = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = [(r[2] or "", r[3] or "") for r in own.get(base, [])[:k] + turns[k:]]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = Counter(s[:-1] for s in members if s)
    leaves, saved = Counter(), Counter()
    for s, m in members.items():
        tokens = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += not children[s]
            saved[s[:d]] += tokens
    sha = lambda s: hashlib.sha256(",".join(map(str, sorted(ends[s]))).encode()).hexdigest()
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), children[s], leaves[s], saved[s], sha(s)) for s, m in members.items()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_prefix_trie(spark, monkeypatch, small):
    """Small blocks and chunks: many partial tries, conversations over many chunks."""
    if small:
        for name, value in (("BLOCK", 2), ("FAN", 1), ("CHUNK", 3)):
            monkeypatch.setattr(trie, name, value)
    rng = random.Random(4)
    said = [f"t{i} " * rng.randint(0, 4) for i in range(3)] + [None, "", "é \x0b x"]
    rows = [(c, rng.choice([t, t, None, 1]), rng.choice(["u", "a", None]) if rng.random() < 0.2 else "u", rng.choice(said)) for c in range(-25, 90) for t in range(rng.choice([1, 2, 3, 5, 8]))]
    rows += [(200, t, "u", f"long {t % 3}") for t in range(60)] + [(201, t, "u", f"long {t % 3}") for t in range(57)] + [(300, 1, "u", "same")] * 9
    rows += [(None, 1, "u", "lost"), (7000, 1, "u", "no base")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("depth", "h", "words", "n", "x", "part")})
    got = sorted(map(tuple, trie.prefix_trie(frame.repartition(5)).collect()), key=str)
    assert got == trie_by_hand(rows)


def test_rank_goes_on_over_parts(spark):
    """One conversation holds nearly all turns; its ranges are ranked apart and go on from one another."""
    rows = spark.range(5000).selectExpr("1L AS conv_id", "id % 2500 AS turn", "md5(string(id)) AS h", "1L AS words")
    got = trie.ranked(rows)
    assert got.selectExpr("count(*)", "count(DISTINCT place)", "min(place)", "max(place)").first() == (5000, 5000, 1, 5000)
