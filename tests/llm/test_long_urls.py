"""URLs of any length beside short ones."""

import math

from callspark.llm import url_filter


def test_a_million_characters(spark, monkeypatch):
    short = [f"http://a{i}.example.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'fr'}/p{i}" for i in range(60)]
    rows = [*short, None, "", "x" * 1023, "y" * 1024, "z" * 1025, "http://long.org/" + "ab" * 500_000]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judged(pages).collect()}
    assert len(got) == len(rows) and got[65].host == "long.org" and len(got[65].path) == 1_000_001 and math.isfinite(got[65].score)
    # Pieces of any size give the same scores.
    monkeypatch.setattr(url_filter, "PIECE", 7)
    again = {r.page_id: r for r in url_filter.judged(pages.where("page_id < 65")).collect()}
    monkeypatch.setattr(url_filter, "PIECE", 100_000)
    whole = {r.page_id: r for r in url_filter.judged(pages.where("page_id < 65")).collect()}
    assert again == whole and sum(r.score is not None for r in whole.values()) == 5
