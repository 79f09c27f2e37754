"""Language model and quality classifier: exact figures by brute force, learned ones on held-out rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import language_model, quality, wire
from cadenza.llm.queries import op4_deleted_interpolation, op5_quality

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="sample tables are not here")


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def check_base(rows, got):
    counts = Counter(w for i, t in rows if fold(i) != 1 for w in tokens(t))
    n, v = counts.total(), len(counts)
    base = lambda w: math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1)))
    want = Counter((i, fold(i) == 1, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(map(base, tokens(t))), 5)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want


def test_base_scores(docs, rows):
    got = language_model.score(docs).collect()
    check_base(rows, got)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_by_plain_counts(docs, rows, order, monkeypatch):
    """The mixture, worked out word by word from whole counts and the weights of the run."""
    kept = []
    learn = language_model.learn
    monkeypatch.setattr(language_model, "learn", lambda *args: kept.append(learn(*args)) or kept[-1])
    got = language_model.score(docs, order).collect()
    train = [tokens(t) for i, t in rows if fold(i) != 1]
    grams = lambda ts, n: zip(*([*["START"] * (n - 1), *ts][k:] for k in range(n)), strict=False)
    counts = [Counter(g for ts in train for g in grams(ts, n)) for n in range(1, order + 1)]
    n, v, w = counts[0].total(), len(counts[0]), kept[0]
    assert w.words.sum() == pytest.approx(1) and len(w.longer) == order - 1

    def text(ts):
        s = 0.0
        for k, t in enumerate(ts):
            c = counts[0][t,]
            p = w.words @ [c / n, 1 / (v + 1), float(c == 0)]
            for m in range(1, order):
                context = ([*["START"] * m, *ts])[k : k + m]
                seen = len(train) if k == 0 else counts[m - 1][tuple(context)]
                own = w.longer[m - 1][0 if not seen else min(int(math.log2(seen)) + 1, language_model.BUCKETS - 1)]
                p = own * (counts[m][(*context, t)] / seen if seen else 0) + (1 - own) * p
            s += math.log10(p)
        return s

    assert Counter((r.doc_id, round(r.score, 5)) for r in got) == Counter((i, round(text(tokens(t)), 5)) for i, t in rows)


def test_estimates_are_distributions():
    """For a seen context the estimates of all words and the unknown one add up to 1 at each level."""
    total = language_model.Totals(3, 10, 4)
    # context seen 5 times; four words of 4, 3, 2, 1 tokens, after it 3, 2, 0, 0 times, and an unknown one
    one, two = np.array([4.0, 3, 2, 1, 0]), np.array([3.0, 2, 0, 0, 0])
    assert np.allclose(language_model.word_estimates(one, total).sum(axis=0), 1)
    ml = [language_model.level_estimates(np.array([2]), [np.array([5.0, a]), np.array([5.0, b])], total, 1)[1][1] for a, b in zip(one, two, strict=True)]
    assert sum(ml) == pytest.approx(1)


@needs_data
def test_model_beats_base(spark):
    got = op4_deleted_interpolation(spark, DATA).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s / got.n > got.b / got.n + 0.05


def test_language_model_of_little(spark, empty):
    assert language_model.score(empty).count() == 0
    alone = spark.createDataFrame([(next(i for i in range(99) if fold(i) == 1), "held out")], "doc_id long, text string")
    row = language_model.score(alone).first()
    assert row.train_tokens == 0 and row.n_known == 0 and row.held_out and math.isfinite(row.score)


def test_weights_are_learned_by_buckets():
    w = language_model.learn_level(np.array([5, 2, 2, 0]), np.array([0.5, 0.5, 0, 0]), np.array([1e-4, 1e-4, 0.01, 0.1]), np.array([100.0, 60, 40, 9]))
    assert w[5] > 0.99 and w[2] == pytest.approx(0.6, abs=0.01) and w[0] == 0 and w[9] == pytest.approx(0.5)
    w = language_model.learn_words(np.array([[0.01, 1e-4, 0], [0, 1e-4, 1]]), np.array([60.0, 40]))
    assert w[0] == pytest.approx(0.6, abs=0.02) and w[2] == pytest.approx(0.4, abs=0.02)
    codes = language_model.grid(np.array([1, 1, 2]), np.array([0.5, 0.49, 0.5]), np.array([0, 0, 1e-20]))
    assert codes[0] == codes[1] != codes[2] and codes.max() < language_model.MOST_CELLS


def test_packing_of_numbers():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    assert (wire.unpacked_keys(wire.packed_keys(keys)) == keys).all()
    assert wire.numbers(wire.packed(np.zeros(0, np.uint32)), np.uint32).size == 0
    found, start, end = wire.ranges(keys, 3)
    assert found == list(range(8)) and all((keys[a:z] >> np.uint64(61) == r).all() for r, a, z in zip(found, start, end, strict=True))


@needs_data
def test_quality_on_held_out(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = op5_quality(spark, DATA).where("held_out").join(labels.drop("toxic"), "doc_id").select("score", "predicted", "quality").collect()
    right = np.mean([r.predicted == r.quality for r in rows])
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.9 and right > 0.85, (auc, right)


def test_quality_edge_cases(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (7, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels)
    assert got.columns == docs.columns
    scores = [r.score for r in got.collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    assert quality.classify(docs, labels.where("quality = 1")).select("score").distinct().collect()[0].score == 1
    assert quality.classify(docs, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
    assert quality.classify(empty, labels).count() == 0


def plain_score(net, text):
    """The forward pass in loops, place by place."""
    b = list(text) + [0] * (max(quality.WIDTH, len(text) + len(text) % quality.STRIDE) - len(text))
    starts = range(0, len(b) - quality.WIDTH + 1, quality.STRIDE)
    acts = [[sum(net.embedding[b[s + j], k] * net.filters[j * quality.DIMS + k, f] for j in range(quality.WIDTH) for k in range(quality.DIMS)) for f in range(quality.FILTERS)] for s in starts]
    half = quality.CHUNK // 2
    halves = [acts[i : i + half] for i in range(0, len(acts), half)]
    chunks = [x + y for x, y in zip(halves, halves[1:], strict=False)] or halves
    pooled = [[max(0.0, max(a[f] for a in c) + net.bias[f]) for f in range(quality.FILTERS)] for c in chunks]
    features = [how(p[f] for p in pooled) for how in (lambda x: sum(x) / len(pooled), max, min) for f in range(quality.FILTERS)]
    return 1 / (1 + math.exp(-(sum(w * x for w, x in zip(net.out, features, strict=True)) + net.out_bias[0])))


def network(seed):
    net = quality.Network.new(np.random.default_rng(seed))
    return quality.Network(*(getattr(net, k).astype(np.float64) for k in quality.PARTS))


@pytest.mark.parametrize("size", [0, 1, 7, 8, 9, 130, 257, 700])
def test_forward_pass(size, monkeypatch):
    text = bytes(np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8))
    net = network(3)
    want = plain_score(net, text)
    assert net.score(text) == pytest.approx(want, rel=1e-9)
    monkeypatch.setattr(quality, "BLOCK", quality.CHUNK)  # block borders within the text
    assert net.score(text) == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("block", [quality.BLOCK, quality.CHUNK])
@pytest.mark.parametrize("part", quality.PARTS)
def test_network_gradients(part, block, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", block)
    net = network(1)
    text = bytes(np.random.default_rng(1).integers(0, 256, 900, dtype=np.uint8))
    sums = {k: np.zeros_like(getattr(net, k)) for k in quality.PARTS}
    net.gradients(text, 1, sums, 2.0)
    v = getattr(net, part)
    for at in np.argsort(-np.abs(sums[part]), axis=None)[:10]:
        at = tuple(int(x) for x in np.unravel_index(at, v.shape))
        old, ends = v[at], []
        for d in (1e-6, -1e-6):
            v[at] = old + d
            ends.append(-2 * math.log(net.score(text)))
        v[at] = old
        assert sums[part][at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-3, abs=1e-6)


def test_sample_is_of_documents_that_are_there(spark):
    """Labels of other ids take no place in the sample, and texts are learned from whole."""
    docs = spark.createDataFrame([(i, f"text {i} " * (20_000 if i == 5 else 1)) for i in range(400)] + [(5, "again"), (None, "no id")], "doc_id long, text string")
    labels = spark.range(300_000).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    rows = quality.sample(docs, labels, "doc_id", "text", "quality").collect()
    assert {r.id for r in rows} == {i for i in range(400) if fold(i) != 0} and len(rows) > 300
    assert len({r.id: r.text for r in rows}[5]) in (5, 140_000)
    few = quality.SAMPLE_ROWS
    try:
        quality.SAMPLE_ROWS = 7
        assert Counter(r.label for r in quality.sample(docs, labels, "doc_id", "text", "quality").collect()) == {0: 7, 1: 7}
    finally:
        quality.SAMPLE_ROWS = few


def test_fit_is_the_same_on_any_partitions(spark):
    rows = spark.createDataFrame([(i, i % 2, ("good words here " if i % 2 else "zzz qqq ") * (i % 7 + 1)) for i in range(60)], "id long, label int, text string")
    a, b = (quality.fit(t, {0: 1200, 1: 1200}) for t in (rows.repartition(1), rows.repartition(7)))
    assert all((getattr(a, k) == getattr(b, k)).all() for k in quality.PARTS)
    assert a.score(b"good words here good words here ") > 0.5 > a.score(b"zzz qqq zzz qqq ")


def test_whole_text_counts():
    """Bytes at the very end change the score; chunks cover the whole document."""
    net = quality.Network.new(np.random.default_rng(0))
    a = b"x" * 70_001
    assert net.score(a + b"Q?!zzzq") != net.score(a + b"xxxxxxx")
