"""The pipeline's near-dedup takes pairs by SimHash first."""

import random

import pytest

pytest.importorskip("xxhash")

from specledger.llm import simhash  # noqa: E402
from specledger.llm.words import shingles  # noqa: E402


def test_near_dedup_compares_close_fingerprints(spark, monkeypatch):
    """Without the search by shingles, texts whose fingerprints are within two bits are still found, and only those that are similar."""
    rng = random.Random(7)

    def tail(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))

    text = tail(3000)
    edited = " ".join([*text.split()[:-1], "changed"])
    # Equal fingerprints, unlike sets.
    core = "alpha beta gamma " * 300
    one, two = core + tail(12), core + tail(12)
    for a, b in ((text, edited), (one, two)):
        assert (simhash.simhash(shingles(a, 3)) ^ simhash.simhash(shingles(b, 3))).bit_count() <= 2
    empty = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "candidate_pairs", lambda nodes, least: (empty, empty))
    docs = spark.createDataFrame([(1, one), (2, two), (3, text), (4, edited), (5, tail(150)), (6, one.upper())], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup(docs).collect()) == [1, 2, 3, 5]
