"""Scores of the factorization machine, pair by pair."""

import math
import re

import numpy as np

from callspark.llm import toxicity
from callspark.llm.textops import hashes


def number(text: bytes) -> int:
    return int(hashes(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))[0])


def by_pairs(model, text):
    """Bias, weights, and the product of each two terms' vectors, one after the other."""
    words = re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").lower().encode())
    terms = sorted({number(w) % toxicity.SPACE for w in words} | {(number(w[: toxicity.PREFIX]) + toxicity.PREFIX) % 2**64 % toxicity.SPACE for w in words})
    total = float(model["bias"]) + sum(float(model["weight"][t]) for t in terms)
    for i, a in enumerate(terms):
        for b in terms[:i]:
            total += sum(float(x) * float(y) for x, y in zip(model["vectors"][a], model["vectors"][b], strict=True))
    return 1 / (1 + math.exp(-total))


def test_scores_pair_by_pair(spark):
    rng = np.random.default_rng(5)
    model = {"bias": -0.3, "weight": rng.normal(0, 0.2, toxicity.SPACE).astype(np.float32), "vectors": rng.normal(0, 0.1, (toxicity.SPACE, toxicity.RANK)).astype(np.float32)}
    texts = ["", None, "one", "One one ONE", "a b c d e f g", "ÉÀ ß é-x", "longerword longerthing 123", "tie tie " * 50 + "end", "İstanbul"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.scored(rows, model).collect():
        assert abs(r.score - by_pairs(model, r.text)) < 1e-5, r.text
