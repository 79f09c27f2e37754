"""Very long texts go through every operator whole."""

from __future__ import annotations

import random

import pytest

from cadenza.llm import decontaminate, exact_dedup, language_model, packing, quality, simhash, substrings, token_counts
from cadenza.llm.queries import byte_bpe, piece_file

N = 60_000


@pytest.fixture(scope="module")
def long(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(3000)]
    text = " ".join(rng.choice(words) for _ in range(N))
    rows = [(1, text), (2, text + " end"), (3, "z" * 400_000), (4, "short")]
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1)], "doc_id long, quality int")
    tests = spark.createDataFrame([(1, " ".join(text.split()[N - 30 : N - 5]))], "item_id long, text string")
    return spark.createDataFrame(rows, "doc_id long, text string"), labels, tests


def test_long_texts(long):
    docs, labels, tests = long
    assert {r.doc_id: r.group_size for r in exact_dedup.exact_dedup(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    pieces = packing.pack(docs, byte_bpe()).groupBy("doc_id").sum("length").collect()
    assert dict(map(tuple, pieces))[4] == 2 and dict(map(tuple, pieces))[1] > N
    hit = {r.doc_id: r.n_hit for r in decontaminate.decontaminate(docs, tests).collect()}
    assert hit == {1: 25, 2: 25, 3: 0, 4: 0}
    assert language_model.score(docs).where("score < 0").count() == 4
    assert quality.classify(docs, labels).where("score between 0 and 1").count() == 4
    base, changed = substrings.dedup_substrings(docs)
    assert {r.doc_id: r.n_removed for r in changed.collect()} == {2: N}
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}
    counts = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, piece_file()).collect()}
    assert counts[1] > N and 0 < counts[3] <= 400_001 and counts[2] > counts[1]
