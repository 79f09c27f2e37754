"""Exact, near and substring deduplication against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from cadenza.llm import decontaminate, exact_dedup, simhash, substrings
from cadenza.llm.queries import op1_exact_dedup, op7_substring_dedup, op9_simhash

BIG = float("inf")


def save(df, path):
    df.select("doc_id", "text").write.parquet(f"{path}/documents.parquet")
    return str(path)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact(docs, rows, weak):
    digest = (lambda c: F.substring(F.sha2(c, 256), 1, 1)) if weak else exact_dedup.sha256
    found = exact_dedup.exact_dedup(docs, digest=digest).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    key = lambda i: (i is None, i or 0)
    want = Counter((i, min(groups[normal(t)], key=key), len(groups[normal(t)])) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in found) == want
    assert sum(r.kept for r in found) == len(groups)


def test_exact_keeps_first(docs, rows):
    kept = exact_dedup.keep_first(docs, exact_dedup.exact_dedup(docs))
    assert kept.columns == docs.columns
    texts = [normal(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({normal(t) for _, t in rows})


def test_exact_tells_texts_apart_that_share_an_id(spark):
    """Under one digest for all texts: null ids alone, and the kept id repeated with another text."""
    for rows in ([(None, "a"), (None, "b"), (None, "b "), (None, "a"), (None, None)], [(1, "x"), (1, "y"), (2, "y"), (3, "x"), (1, "x"), (None, "z")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        result = exact_dedup.exact_dedup(docs, digest=lambda c: F.substring(F.sha2(c, 256), 1, 0))
        groups = defaultdict(list)
        for i, t in rows:
            groups[normal(t)].append(i)
        key = lambda i: (i is None, i or 0)
        want = Counter((i, min(groups[normal(t)], key=key), len(groups[normal(t)])) for i, t in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in result.collect()) == want
        kept = exact_dedup.keep_first(docs, result).collect()
        assert Counter((r.doc_id, normal(r.text)) for r in kept) == Counter((min(ids, key=key), t) for t, ids in groups.items())


@pytest.mark.parametrize("weak", [False, True])
def test_deliveries(spark, docs, rows, tmp_path, weak):
    """A second call meets the first one's rows; what stayed then stays, also where digests collide."""
    digest = (lambda t: F.substring(t, 1, 1)) if weak else exact_dedup.sha256
    rng = random.Random(2)
    parts = [[], []]
    for r in sorted(set(rows), key=str):
        parts[rng.randrange(2)].append(r)
    parts[1] += [(i and i - 1000, t) for i, t in parts[0][:20]]
    seen, counts = {}, Counter()
    key = lambda r: (r[0] is None, r[0] or 0)
    for part in parts:
        fresh = {}
        for r in sorted(part, key=key):
            counts[normal(r[1])] += 1
            if normal(r[1]) not in seen:
                fresh.setdefault(normal(r[1]), r[0])
        seen |= fresh
        table = spark.createDataFrame(part, "doc_id long, text string").repartition(3)
        got = exact_dedup.exact_dedup(table, digest=digest, state=f"file://{tmp_path}/state").collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == Counter((i, seen[normal(t)], counts[normal(t)]) for i, t in part)
        assert sum(r.kept for r in got) == len(fresh)


def test_stages_keep_clashing_columns(spark, docs, rows):
    """Columns may have any names, those of helpers too."""
    names = ["b_id", "b_key", "g_id", "g_key", "k_id", "k_digest", "text_key", "first", "n", "file", "place", "fp", "kept", "digest"]
    wide = docs.drop("n", "digest").select("*", *(F.lit(1).alias(x) for x in names))
    kept = exact_dedup.keep_first(wide, exact_dedup.exact_dedup(wide))
    assert kept.columns == wide.columns and kept.count() == len({normal(t) for _, t in rows})
    near = simhash.keep_first(wide, simhash.near_duplicates(wide))
    assert near.columns == wide.columns and near.count() == len(set(roots({fingerprint(t) for _, t in rows}, 4).values()))
    tests = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    clean = decontaminate.keep_clean(wide, decontaminate.decontaminate(wide, tests))
    assert clean.columns == wide.columns


def test_exact_query(spark, docs, rows, tmp_path):
    got = {(r.doc_id, r.text_sha256) for r in op1_exact_dedup(spark, save(docs, tmp_path)).collect()}
    assert got == {(i, hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows}


def test_empty_tables(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.keep_first(empty, exact_dedup.exact_dedup(empty)).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_first(empty, simhash.near_duplicates(empty)).count() == 0
    base, changed = substrings.dedup_substrings(empty)
    assert base.count() == 0 and changed.count() == 0


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, bits):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    nodes = list(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if (a ^ b).bit_count() <= bits:
                parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, rows, tmp_path):
    fps = [(i, fingerprint(t)) for i, t in rows]
    root = roots({f for _, f in fps}, 4)
    least = defaultdict(lambda: None)
    for i, f in fps:
        if i is not None and (least[root[f]] is None or i < least[root[f]]):
            least[root[f]] = i
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in op9_simhash(spark, save(docs, tmp_path)).collect())
    assert got == Counter((i, f"{f:016x}", least[root[f]]) for i, f in fps)
    kept = simhash.keep_first(docs, simhash.near_duplicates(docs)).collect()
    assert len(kept) == len({root[f] for _, f in fps})
    assert kept and sorted(r.doc_id for r in kept) == sorted(least[x] for x in {root[f] for _, f in fps})


def test_simhash_keeps_one_of_each_component(spark):
    """Null ids, and ids that repeat with unrelated texts, are no reason to merge components."""
    import random

    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(300)) for _ in range(6)]
    a, b, c, x, y, z = texts
    rows = [(None, a), (None, b), (None, c), (None, c + " end"), (7, x), (7, y), (8, x + " end"), (9, y + " end"), (None, y.upper()), (5, z), (5, z), (4, None), (4, "")]
    root = roots({fingerprint(t) for _, t in rows}, 4)
    assert len(set(root.values())) == 7
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in simhash.keep_first(docs, simhash.near_duplicates(docs)).collect()]
    assert sorted(root[fingerprint(t)] for _, t in kept) == sorted(set(root.values()))
    assert {(7, x), (7, y), (5, z)} < set(kept) and Counter(i for i, _ in kept) == {None: 3, 7: 2, 5: 1, 4: 1}


def test_all_links_of_dense_fingerprints(spark):
    """Many fingerprints close together, in parts small enough to be taken apart further."""
    import random

    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(8)]
    fps = set()
    for _ in range(500):
        f = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    root = roots(fps, 4)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    table = spark.createDataFrame(signed, "fp long")
    before = simhash.HELD
    try:
        simhash.HELD = 100_000
        import numpy as np

        arr = np.array(sorted(fps), np.uint64)
        a, b = simhash.meet(arr, 0, 0, 2)
        edges = list(zip(a.tolist(), b.tolist(), strict=True))
    finally:
        simhash.HELD = before
    parts = simhash.components(simhash.links(table, len(fps), 2), simhash.scratch(spark, "t")).collect()
    for pairs in (edges, [(r.node % 2**64, r.root % 2**64) for r in parts]):
        own = {f: f for f in fps}

        def find(n, own=own):
            while own[n] != n:
                n = own[n]
            return n

        for x, y in pairs:
            own[find(x)] = find(y)
        assert len({find(f) for f in fps}) == len(set(root.values()))
        assert len({(find(f), root[f]) for f in fps}) == len(set(root.values()))


def removed(rows, window):
    """Words of each row that are left; rows in order of id."""
    seen, out = set(), []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone |= set(range(k, k + window))
            seen.add(g)
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def longest(rows, window):
    """The greatest doubling of window at which a window of each row is repeated anywhere."""
    words, out, length = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}, {i: 0 for i, _ in rows}, window
    while True:
        counts = Counter(tuple(w[k : k + length]) for w in words.values() for k in range(len(w) - length + 1))
        found = [i for i, w in words.items() if any(counts[tuple(w[k : k + length])] > 1 for k in range(len(w) - length + 1))]
        if not found:
            return out
        out |= dict.fromkeys(found, length)
        length *= 2


@pytest.mark.parametrize("each", [1_000_000, 50])
def test_substrings(spark, docs, rows, tmp_path, monkeypatch, each):
    monkeypatch.setattr(substrings, "RANGE_WINDOWS", each)
    unique = sorted({i: t for i, t in rows if i is not None}.items())
    table = spark.createDataFrame(unique, "doc_id long, text string")
    got = sorted(map(tuple, op7_substring_dedup(spark, save(table, tmp_path)).collect()))
    lengths = longest(unique, 20)
    assert got == [(*r, lengths[r[0]]) for r in removed(unique, 20)]
    assert sum(r[2] for r in got) > 300 and {0, 20, 40, 320} <= set(lengths.values())


def test_substrings_of_repeated_rows(spark, docs, rows, tmp_path):
    """Null and repeated ids: every row has a result, equal rows equal ones."""
    got = op7_substring_dedup(spark, save(docs, tmp_path)).collect()
    assert len(got) == len(rows) and Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)


def test_lengths_double(spark, docs, rows):
    found = substrings.repeated_lengths(docs, 20)
    counts = Counter(r.length for r in found.collect())
    assert counts[20] > counts[40] > 0 and set(counts) <= {20 * 2**k for k in range(12)}
    windows = defaultdict(int)
    for _, t in set(rows):
        w = (t or "").encode().split()
        for k in range(len(w) - 39):
            windows[tuple(w[k : k + 40])] += 1
    got = found.where("length = 40").select("doc_id", "text_key", "pos").distinct().count()
    assert got == sum(n for n in windows.values() if n > 1)


def test_exploded_and_united_rows(spark, tmp_path):
    """Rows that share a place in a file are rows of their own."""
    spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "c")], "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/d.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/d.parquet")
    assert exact_dedup.bare_scan(docs) and exact_dedup.bare_scan(docs.where("doc_id > 1").select("text", (F.col("doc_id") + 1).alias("doc_id")))
    words = docs.select((F.col("doc_id") * 10).alias("doc_id"), F.explode(F.split("text", " ")).alias("text"))
    both = docs.unionByName(docs)
    joined = docs.join(spark.range(2), F.lit(True))
    for some in (words, both, joined.drop("id"), docs.limit(2), docs.orderBy("text"), docs.withColumn("text", F.concat("text", F.rand().cast("string")))):
        assert not exact_dedup.bare_scan(some)
    got = exact_dedup.exact_dedup(words).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == Counter([(10, 10, 1, True), (10, 10, 2, True), (20, 10, 2, False), (20, 20, 2, True), (30, 20, 2, False)])
    got = exact_dedup.exact_dedup(both).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 3 and {r.group_size for r in got} == {2}


@pytest.mark.parametrize("fails", ["content", "stream", "after"])
def test_failed_delivery(spark, tmp_path, monkeypatch, fails):
    """A delivery that failed at any point is tried again, or another comes first; no row is lost or counted twice."""
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first, second = [(i, f"text {i % 7}") for i in range(20)], [(i, f"text {i % 11}") for i in range(100, 130)]
    state = f"file://{tmp_path}/state"
    exact_dedup.exact_dedup(table(first), state=state)

    def broken(*args, f={"content": exact_dedup.located, "stream": exact_dedup.run_stream, "after": exact_dedup.collisions}[fails]):
        if fails != "content":
            f(*args)
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(exact_dedup, {"content": "located", "stream": "run_stream", "after": "collisions"}[fails], broken)
        for _ in range(2):
            with pytest.raises(RuntimeError, match="lost"):
                exact_dedup.exact_dedup(table(second), state=state)
    other = exact_dedup.exact_dedup(table([(50, "text 2"), (51, "text 9")]), state=state).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in other} == {(50, 2, 4, False), (51, 51, 1, True)}
    got = exact_dedup.exact_dedup(table(second), state=state, delivery="a/b=c").collect()
    earlier = {f"text {k}": k for k in range(7)} | {"text 9": 51}
    want = set()
    for i, t in second:
        keep = earlier.setdefault(t, i)
        want.add((i, keep, keep == i))
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == want and sum(k for *_, k in want) == 3
    again = exact_dedup.exact_dedup(table(second), state=state, delivery="a/b=c").collect()
    assert sorted(again) == sorted(got)
