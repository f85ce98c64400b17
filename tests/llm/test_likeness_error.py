"""How far the likeness of short fingerprints is from that of all names of the same level."""

import os

import numpy as np
import pytest

from callspark.llm import fingerprints

DATA = "/root/testdata/sf0.001/documents.parquet"


def likenesses(texts, kept, monkeypatch):
    """Of each text to itself with its last third replaced, and to the next text."""
    monkeypatch.setattr(fingerprints, "KEPT", kept)
    nexts = [*texts[1:], texts[0]]
    edited = [t[: len(t) - len(t) // 3] + x[: len(t) // 3] for t, x in zip(texts, nexts, strict=True)]
    own, changed = fingerprints.fingerprints(texts), fingerprints.fingerprints(edited)
    following = [*own[1:], own[0]]
    return np.array([[fingerprints.likeness(a, b), fingerprints.likeness(a, c)] for a, b, c in zip(own, changed, following, strict=True)])


@pytest.mark.skipif(not os.path.exists(DATA), reason="no driver tables")
def test_error_of_64_names(monkeypatch):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(DATA, columns=["text"])["text"].to_pylist() if t]
    near, exact = likenesses(texts, 64, monkeypatch), likenesses(texts, 1 << 40, monkeypatch)
    error = np.abs(near - exact)
    # A sample of 64 of a share p is off by the root of p (1 - p) / 64, which is 0.0625 at most.
    assert np.sqrt((error**2).mean(0))[0] <= 0.0625 and error[:, 1].max() < 0.2
    assert error.max() < 0.3
    # Rich texts tell an edited copy from the next document.
    rich = np.array([len(t) > 400 for t in texts])
    assert (near[rich, 0] > near[rich, 1]).mean() > 0.98
    print("mean, root mean square, largest error:", error.mean(0), np.sqrt((error**2).mean(0)), error.max(0), "rows", len(texts))
