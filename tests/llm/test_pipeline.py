"""The pipeline against the stages' decisions, made one by one in plain Python."""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from cadenza.llm import quality
from cadenza.llm.queries import ACCEPT, byte_bpe
from tests.llm.test_dedup import fingerprint, normal, roots
from tests.llm.test_text import hits

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="sample tables are not here")


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in quality.classify(docs, labels).collect() if r.score >= ACCEPT]
    assert 0.3 * docs.count() < len(rows) < docs.count()
    first: dict = {}
    for i, t in sorted(rows):
        first.setdefault(normal(t), (i, t))
    rows = sorted(first.values())
    fps = {i: fingerprint(t) for i, t in rows}
    root = roots(set(fps.values()), 4)
    first = {}
    for i, t in rows:
        first.setdefault(root[fps[i]], (i, t))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    shingles = {w for _, t in items for w in re.findall(r"\w+", t.lower())}
    kept = [(i, t) for i, t in sorted(first.values()) if not (shingles & set(re.findall(r"\w+", t.lower())) and hits(t, items)[1])]
    tok = Tokenizer.from_file(byte_bpe())
    want = Counter({(i, len(tok.encode(t, add_special_tokens=False).ids) + 1): 1 for i, t in kept})
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter({(r.doc_id, r.doc_tokens): 1 for r in got}) == want
    assert sum(r.length for r in got) == sum(n for _, n in want)


def test_stages_keep_columns(spark, docs):
    for name, step in corpus_pipeline.STAGES[:-1]:
        kept = step(spark, docs, DATA)
        assert kept.columns == docs.columns and kept.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).where("doc_id is null").count() >= 2


def test_pipeline_of_odd_tables(spark, docs, empty, tmp_path):
    """Empty tables give no pieces; without labels and benchmark only copies go; null and empty texts are packed."""
    labels, items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for name, some in (("none", empty), ("some", docs)):
        for table, rows in (("documents", some), ("labels", labels), ("benchmark", items)):
            rows.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    ids = {r.doc_id for r in pieces}
    assert {0, 3, 404} <= ids and not {401, 402} & ids  # of texts without words the one with the least id
    assert all(r.length <= 1024 for r in pieces)
