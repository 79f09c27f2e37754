"""Filter audit, centroids and vector near-duplicates against brute force on small tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cadenza.llm import filter_audit, vector_dups, yinyang


def audited(rows, labels):
    """rows: (doc_id, text, lang); every row against every order."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    has = {k: {i for i, *v in labels if v[n] == 1 and i is not None} for n, k in enumerate(("good", "toxic"))}
    out = defaultdict(Counter)
    shapley = Counter()
    orders = ["".join(p) for p in itertools.permutations("ABCDE")]
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t],
        }
        for o in orders:
            gone = False
            for k, f in enumerate(o):
                c = out[lang or "", o, k + 1]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["redundant"] += fails[f] and gone
                if fails[f] and not gone:
                    gone = True
                    c["removed"] += 1
                    c["good_lost"] += i in has["good"]
                    c["toxic_lost"] += i in has["toxic"]
                    shapley[lang or "", f] += 1
                c["kept"] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(*key, *(c[n] for n in names), shapley[key[0], key[1][key[2] - 1]]) for key, c in out.items()}


def audit_rows():
    rng = random.Random(3)
    words = [*("river stone cloud bread lamp".split()), "UPPER", "ÄPFEL", "a|b", "東京", "100%"]
    prose = lambda n, m: " ".join(rng.choice(words[:m]) if rng.random() < 0.3 else f"w{rng.randint(0, 10**6)}" for _ in range(n))
    rows = [(i, prose(rng.choice([0, 1, 99, 100, 101, 150]), rng.choice([5, 10])), rng.choice(["en", "de", None, ""])) for i in range(60)]
    same = "word " * 100 + "Z" * 60
    rows += [(200 + i, same, rng.choice(["en", "fr"])) for i in range(40)] + [(200, same, "en"), (200, same, "en"), (None, same, "en"), (None, same, "de")]
    rows += [(300, None, "fr"), (299, "", "fr"), (None, None, None), (301, " \t\n", "en"), (302, "x" * 50_000, "en"), (303, "ab " * 30_000, "de"), (304, "A" * 10 + " b" * 45, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 240, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (200, 1, 1)]
    return rows, labels


def test_audit(spark):
    rows, labels = audit_rows()
    docs = spark.createDataFrame([(*r, 1, "m", 2, "w") for r in rows], "doc_id long, text string, lang string, n int, mask string, bit int, words string").repartition(5)
    marks = spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, toxic int, key int")
    got = filter_audit.audit(docs, marks)
    assert set(map(tuple, got.collect())) == audited(rows, labels)
    assert got.count() == 600 * len({r[2] or "" for r in rows})


def test_audit_of_little(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lang = empty.selectExpr("doc_id", "text", "'en' AS lang")
    assert filter_audit.audit(lang, none).isEmpty()
    one = spark.createDataFrame([("b", "ok", "en"), ("a", "ok", "en")], "doc_id string, text string, lang string")
    got = filter_audit.audit(one, none.selectExpr("cast(doc_id AS string) AS doc_id", "quality", "toxic")).where("filter_order = 'EABCD' AND step = 1").collect()
    assert [(r.kept, r.removed, r.unique_fails, r.shapley) for r in got] == [(1, 1, 0, 60)]
    two = (filter_audit.Filter("S", lambda text, words: text == "ok"), filter_audit.Filter("X", None))
    assert filter_audit.audit(one, none.selectExpr("cast(doc_id AS string) AS doc_id", "quality", "toxic"), two).count() == 4
    with pytest.raises(ValueError):
        filter_audit.audit(one, none, two + two)


def lloyd(rows, k, rounds, dims, scale, salt):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{salt}{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centres = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        near = [min((dist(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            own = defaultdict(list)
            for (_, v), (_, n) in zip(kept, near, strict=True):
                own[n].append(v)
            centres = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else c for n, c in enumerate(centres)]
    sums = Counter()
    for d, n in near:
        sums[n] += d
    return Counter((i, n, d, sums[n], sums.total(), tuple(centres[n])) for (i, _), (d, n) in zip(kept, near, strict=True))


@pytest.mark.parametrize("k,spread", [(1, 3), (7, 2), (23, 6), (500, 3)])
def test_centroids(spark, k, spread):
    rng = random.Random(k)
    # a coarse lattice: many equal distances and repeated vectors
    rows = [(i, [float(rng.randint(-spread, spread)) / 2 for _ in range(3)]) for i in range(300)]
    rows += [(7, [1.0, 1.0, 1.0]), (None, [0.5, 0.5, 0.5]), (None, [0.25, -0.25, 2.0]), (400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 2.0])]
    rows += [(404, [1.0, float("nan"), 2.0]), (405, [float("inf"), 0.0, 0.0]), (406, [1e4, -1e4, 3.0])] + [(500, [0.5, 0.0, 0.5])] * 40
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, v int, cluster int").repartition(4)
    got = yinyang.cluster(vectors, k, 4, 3, 2, "s:")
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in got.collect()) == lloyd(rows, k, 4, 3, 2, "s:")


def test_centroids_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert yinyang.cluster(none).isEmpty()
    with pytest.raises(Exception, match="after scaling"):
        yinyang.cluster(spark.createDataFrame([(1, [1e12] * 64)], "vec_id long, embedding array<double>"))


def test_bounds_spare_distances():
    rng = np.random.default_rng(0)
    means = rng.integers(-4000, 4000, (40, 16))
    v = (means[rng.integers(0, 40, 5000)] + rng.integers(-300, 300, (5000, 16))).astype(np.int64)
    centres, bounds, drift, measured = v[:40].copy(), None, None, []
    groups = yinyang.grouped(centres)
    assert 2 <= groups.max() + 1 <= 4
    for _ in range(6):
        bounds = yinyang.assign(v, bounds, centres, groups, drift)
        every = ((v[:, None] - centres[None]) ** 2).sum(axis=2)
        assert (bounds.cluster == every.argmin(axis=1)).all()
        near = np.sqrt(every.min(axis=1))
        assert (bounds.upper >= near).all()
        every[np.arange(len(v)), bounds.cluster] = np.iinfo(np.int64).max
        for g in range(groups.max() + 1):
            assert (bounds.lower[:, g] <= np.sqrt(every[:, groups == g].min(axis=1).astype(float))).all()
        measured.append(bounds.measured)
        new = np.stack([v[bounds.cluster == c].sum(axis=0) // max(1, (bounds.cluster == c).sum()) if (bounds.cluster == c).any() else centres[c] for c in range(40)])
        drift, centres = np.sqrt(((new - centres) ** 2).sum(axis=1)), new
    assert measured[-1] < 0.5 * measured[0]


def linked(rows, cosine):
    """rows: (id, vector, label) by all pairs."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and k is not None for _, v, k in rows]
    near = defaultdict(set)
    for (a, x), (b, y) in itertools.combinations(enumerate(rows), 2):
        if fine[a] and fine[b] and x[2] == y[2] and len(x[1]) == len(y[1]):
            u, v = np.array(x[1], float), np.array(y[1], float)
            if (u / np.abs(u).max()) @ (v / np.abs(v).max()) / np.linalg.norm(u / np.abs(u).max()) / np.linalg.norm(v / np.abs(v).max()) >= cosine:
                near[a].add(b), near[b].add(a)
    out = Counter()
    for a, r in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b), todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out[r[0], len(near[a]), least, r[0] == least] += 1
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    rows, at = [], itertools.count()
    for label in (0, 0, 0, 1, 2):  # clouds, loose to dense
        centre = rng.normal(size=6)
        for _ in range(60):
            rows.append((next(at), (centre + rng.normal(size=6) * rng.choice([0.02, 0.1, 0.3])).tolist(), label))
    dense = rng.normal(size=6)
    rows += [(next(at), (dense + rng.normal(size=6) * 0.01).tolist(), 3) for _ in range(150)]  # all linked to all
    rows += [(next(at), rows[0][1], 0) for _ in range(100)]  # copies
    rows += [(next(at), [3 * x for x in rows[1][1]], 0), (next(at), rows[2][1], 1), (next(at), rows[2][1][:5], 0), (next(at), rows[3][1], None)]
    rows += [(next(at), v, 0) for v in (None, [], [0.0] * 6, [None] * 6, [float("nan")] * 6, [1.0, float("inf"), 0, 0, 0, 0], [1e-200] * 6, [1e300] * 6)]
    rows += [(None, rows[5][1], 0), (None, [0.0, 0, 0, 0, 1, -5], 2), (None, [0.0, 0, 0, 0, 1, -5], 2), (4, rows[4][1], 0), (4, [9.0, -1, 0, 0, 0, 0], 2)]
    return [(i, v and [x if x is None else float(x) for x in v], k) for i, v, k in rows]


@pytest.mark.parametrize("limit,cosine", [(2048, 0.98), (40, 0.98), (16, 0.995), (25, 0.9)])
def test_near_vectors(spark, vectors, monkeypatch, limit, cosine):
    monkeypatch.setattr(vector_dups, "LIMIT", limit)
    cuts = []
    monkeypatch.setattr(vector_dups, "cut", lambda rows, pivots, r, f=vector_dups.cut: cuts.append(pivots) or f(rows, pivots, r))
    table = spark.createDataFrame([(*r, "u", 1) for r in vectors], "vec_id long, embedding array<double>, label int, u string, n int").repartition(6)
    got = vector_dups.near_vectors(table, cosine)
    assert Counter(map(tuple, got.collect())) == linked(vectors, cosine)
    assert bool(cuts) == (limit < 2048)


def test_pivots_leave_no_partner_out():
    rng = np.random.default_rng(1)
    u = vector_dups.unit(rng.normal(size=(800, 4)))
    pivots = u[:20]
    home, near = vector_dups.reached(u, pivots, r := float(np.sqrt(2 - 2 * 0.98)))
    x, y = np.nonzero(u @ u.T >= 0.98)
    assert near[x, home[y]].all()
    assert near.sum() < 0.5 * near.size and r < 0.2001


def test_near_vectors_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_dups.near_vectors(none).isEmpty()
    odd = spark.createDataFrame([(2, None, 1), (1, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(tuple, vector_dups.near_vectors(odd).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_vectors_that_pivots_do_not_cut(spark, monkeypatch):
    monkeypatch.setattr(vector_dups, "LIMIT", 50)
    dealt, cuts = [], []
    monkeypatch.setattr(vector_dups, "blocks", lambda *a, f=vector_dups.blocks: dealt.append(f(*a)) or dealt[-1])
    monkeypatch.setattr(vector_dups, "cut", lambda rows, pivots, r, f=vector_dups.cut: cuts.append(pivots) or f(rows, pivots, r))
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=64).tolist(), i % 2) for i in range(400)]
    rows += [(400 + i, (np.array(rows[i][1]) + rng.normal(size=64) * 0.05).tolist(), i % 2) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = vector_dups.near_vectors(table, 0.98)
    assert Counter(map(tuple, got.collect())) == linked(rows, 0.98)
    # copies in nearly all smaller cells would cost more than blocks: a vector goes to as many as its label has parts
    assert not cuts and dealt[0].count() == len(rows) * 5


@pytest.mark.parametrize("limit", [10, 1000])
def test_pairs_meet_in_one_block(spark, monkeypatch, limit):
    monkeypatch.setattr(vector_dups, "LIMIT", limit)
    rows = [(c, 100 * n + i, 1, i < homes, [1.0, float(i)]) for n, (c, homes) in enumerate((("a", 35), ("b", 12), ("c", 0))) for i in range(60)]
    cells = spark.createDataFrame(rows, "cell string, node long, n long, home boolean, u array<double>")
    sizes = cells.selectExpr("*", "int(home) AS h").groupBy("cell").agg({"h": "sum", "*": "count"}).selectExpr("cell", "`sum(h)` AS homes", "`count(1)` AS n", "2 AS dims")
    found = defaultdict(list)
    for r in vector_dups.blocks(cells, sizes).collect():
        found[r.cell, r.a, r.b].append((r.node, r.role))
    met = Counter()
    for some in found.values():
        for (x, p), (y, q) in itertools.combinations(some, 2):
            if p & 1 and q & 2 or p & 2 and q & 1:
                met[min(x, y), max(x, y)] += 1
    home = {node: stays for _, node, _, stays, _ in rows}
    assert met == Counter((x, y) for x, y in itertools.combinations(sorted(home), 2) if x // 100 == y // 100 and (home[x] or home[y]))
    assert all(bool(role & 4) == home[node] for some in found.values() for node, role in some)
    assert limit > 60 or max(map(len, found.values())) < 50


def test_doubles_decide_at_the_limit(spark):
    # pairs (2i, 2i + 1) whose cosines are too near 0.98 for single precision, on both sides of it
    rng = np.random.default_rng(2)
    rows = []
    for i, off in enumerate((3e-8, -3e-8, 1e-12, -1e-12, 1e-6, -1e-6)):
        a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
        c = 0.98 + off
        rows += [(2 * i, a.tolist(), i), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist(), i)]
    got = vector_dups.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98)
    assert {r.vec_id for r in got.collect() if r.n_links} == {0, 1, 4, 5, 8, 9}
