"""Centroid clustering of integer vectors by Yinyang bounds, with exact results.

Vectors become integers, so distances are exact and ties have one answer. The starting centroids are
clustered into groups once. A vector carries an upper bound of the distance to its own centroid and, for
each group, a lower bound of the distance to the group's others. As centroids move, the bounds move by how
far they went; while the upper bound is below all lower ones the vector is left alone (global filter), else
only groups whose bound it reaches are looked at (group filter), and their centroids are measured exactly.

A round is one pass without a shuffle: it reads the last round's table (vectors with their bounds) from the
shared folder and writes the next. Centroids' sums change only by the vectors that moved, so what is
aggregated after a round are these moves, as one row for each centroid and component of a task. The driver
holds centroids times components, which are parameters, and never a vector besides the first centroids.

Defined results: only vectors of `dims` components are kept, none of them null or not finite; rows may
repeat, and each is a vector; equal hashes (repeated ids) are ordered by components; a null id counts as an
empty text in the hash; with fewer vectors than centroids there are as many centroids as vectors; tables
may be empty and have any further columns. A component of LIMIT or more after scaling is an error, as
distances would not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import remove, scratch, stage

#: Components are smaller, so that the squares of their differences sum to a long.
LIMIT = 1 << 26
#: Centroids of a group, about.
GROUP = 10
#: What rounding may add to or take from a bound, relative to it; square roots are good to about 1e-16.
SLACK = 1e-12


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows of v by rows of c."""
    most = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0))
    if 4 * v.shape[1] * int(most) ** 2 < 1 << 53:  # then doubles hold every sum of the product
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)


def grouped(centres: np.ndarray, size: int = GROUP, turns: int = 5) -> np.ndarray:
    """The group of each centroid, by a few turns of means from every size-th centroid; exactness does not rest on it."""
    means = centres[::size].astype(np.float64)
    near = np.zeros(len(centres), np.int64)
    for _ in range(turns):
        near = ((centres[:, None] - means[None]) ** 2).sum(axis=2).argmin(axis=1)
        means = np.stack([centres[near == g].mean(axis=0) if (near == g).any() else means[g] for g in range(len(means))])
    return np.unique(near, return_inverse=True)[1]


@dataclass
class Bounds:
    """Of a batch of vectors: own centroid, upper bound of its distance, lower bounds by group, distances computed."""

    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    measured: int = 0


def scan(v: np.ndarray, rows: np.ndarray, members: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For some rows and a group: least distance, its centroid (the smallest number of equals), and the least of the others."""
    d = squared(v[rows], centres[members])
    at = d.argmin(axis=1)
    least = d[np.arange(len(d)), at]
    d[np.arange(len(d)), at] = np.iinfo(np.int64).max
    return least, members[at], d.min(axis=1)


def root(d: np.ndarray) -> np.ndarray:
    """Distances from squared ones; endless where there was no other centroid."""
    return np.where(d == np.iinfo(np.int64).max, np.inf, np.sqrt(d.astype(np.float64)))


def assign(v: np.ndarray, old: Bounds | None, centres: np.ndarray, groups: np.ndarray, drift: np.ndarray) -> Bounds:
    """The nearest centroid of each vector (ties: the smaller number), exactly; old: bounds for centroids that since moved by drift."""
    n, kinds = len(v), groups.max() + 1
    members = [np.flatnonzero(groups == g) for g in range(kinds)]
    if old is None:
        todo = np.arange(n)
        cluster, best = np.full(n, -1), np.full(n, np.iinfo(np.int64).max)
        lower, wanted, measured = np.zeros((n, kinds)), np.ones((n, kinds), bool), 0
        upper = np.zeros(n)
    else:
        far = np.array([drift[m].max() for m in members])
        upper = (old.upper + drift[old.cluster]) * (1 + SLACK)
        lower = old.lower - far - SLACK * np.where(np.isinf(old.lower), 0, np.abs(old.lower) + far)
        cluster, measured = old.cluster.copy(), 0
        todo = np.flatnonzero(upper >= lower.min(axis=1))
        # the distance to the own centroid itself may be enough
        best = np.zeros(n, np.int64)
        best[todo] = ((v[todo] - centres[cluster[todo]]) ** 2).sum(axis=1)
        measured += len(todo)
        upper[todo] = np.sqrt(best[todo].astype(np.float64)) * (1 + SLACK)
        todo = todo[upper[todo] >= lower[todo].min(axis=1)]
        wanted = np.zeros((n, kinds), bool)
        wanted[todo] = lower[todo] <= upper[todo, None]
    was, own = cluster.copy(), best.copy()
    least, where, other = (np.full((n, kinds), x, np.int64) for x in (0, -1, 0))
    for g in range(kinds):
        rows = np.flatnonzero(wanted[:, g])
        if len(rows):
            least[rows, g], where[rows, g], other[rows, g] = scan(v, rows, members[g], centres)
            measured += len(rows) * len(members[g])
            better = (least[rows, g] < best[rows]) | ((least[rows, g] == best[rows]) & (where[rows, g] < cluster[rows]))
            cluster[rows[better]], best[rows[better]] = where[rows[better], g], least[rows[better], g]
    seen = root(np.where(where == cluster[:, None], other, least)) * (1 - SLACK)
    lower = np.where(wanted, seen, lower)
    moved = np.flatnonzero((cluster != was) & (was >= 0))
    home = groups[was[moved]]
    unseen = ~wanted[moved, home]  # the centroid that a vector left is one of its group's others now
    lower[moved[unseen], home[unseen]] = np.minimum(lower[moved[unseen], home[unseen]], np.sqrt(own[moved[unseen]].astype(np.float64)) * (1 - SLACK))
    upper[todo] = np.sqrt(best[todo].astype(np.float64)) * (1 + SLACK)
    return Bounds(cluster, upper, lower, measured)


def matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(kind)


def lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())


def whole(vector: Column, dims: int) -> Column:
    """Whether a vector has dims components, all of them finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.size(vector) == dims, F.lit(False)) & F.forall(vector, finite)


def scaled(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that are kept, as integers."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fits = lambda x: F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component is {LIMIT} or more after scaling")).cast("int"))
    return own.where(whole(F.col("v"), dims)).select("vec_id", F.transform("v", fits).alias("v"))


def moves(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """By centroid: how many vectors it gained, and by how much its sums grew."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = {}, {}
        for b in batches:
            v, was, now = matrix(b.column(0), dims), b.column(1).to_numpy(), b.column(2).to_numpy()
            for side, sign in ((was, -1), (now, 1)):
                for c in np.unique(side[side >= 0]).tolist():
                    rows = side == c
                    n[c] = n.get(c, 0) + sign * int(rows.sum())
                    sums[c] = sums.get(c, 0) + sign * v[rows].sum(axis=0)
        for c in n:
            yield pa.RecordBatch.from_arrays([pa.array([c] * (dims + 1), pa.int32()), pa.array(range(-1, dims), pa.int32()), pa.array([n[c], *sums[c].tolist()], pa.int64())], ["cluster", "k", "x"])

    moved = state.where("cluster <> was").select("v", "was", "cluster").mapInArrow(run, "cluster int, k int, x long")
    found: dict[int, dict[int, int]] = {}
    # centroids times components
    for r in moved.groupBy("cluster", "k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        found.setdefault(r["cluster"], {})[r["k"]] = int(r["x"])
    return {c: (x[-1], [x[k] for k in range(dims)]) for c, x in found.items()}


def one_round(state: DataFrame, kind: str, dims: int, centres: np.ndarray, groups: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """state (vec_id, v, and from the second round on was, cluster, upper, lower) after an assignment, with exact distances."""
    kinds = int(groups.max()) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, old = matrix(b.column(1), dims), None
            if drift is not None:
                old = Bounds(b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy(), matrix(b.column(5), kinds, np.float64))
            new = assign(v, old, centres, groups, drift)
            was = old.cluster if old else np.full(len(v), -1)
            distance = ((v - centres[new.cluster]) ** 2).sum(axis=1)
            columns = [b.column(0), b.column(1), pa.array(was.astype(np.int32)), pa.array(new.cluster.astype(np.int32)), pa.array(new.upper), lists(new.lower), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "was", "cluster", "upper", "lower", "distance"])

    return state.mapInArrow(run, f"vec_id {kind}, v array<int>, was int, cluster int, upper double, lower array<double>, distance long")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid): one row for each vector that is kept.

    The first centroids are the k vectors of the smallest SHA-256 of salt and id. Each round assigns every
    vector and moves each centroid that has vectors to the floor of their mean; then they are assigned once
    more. distance is squared; centroid: its final components.
    """
    spark = vectors.sparkSession
    kind, path = vectors.schema[id_col].dataType.simpleString(), scratch(spark, "yinyang")
    state = stage(scaled(vectors, dims, scale, id_col, vector_col), f"{path}/vectors")
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = state.select(hashed.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    if not first:
        return state.select(F.col("vec_id").alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))))
    centres = np.array([r["v"] for r in first], np.int64)
    groups, drift = grouped(centres), None
    counts, sums = [0] * len(centres), [[0] * dims for _ in centres]
    before = f"{path}/vectors"
    for turn in range(rounds + 1):
        state = stage(one_round(state, kind, dims, centres, groups, drift), f"{path}/round{turn}")
        remove(spark, before)
        before = f"{path}/round{turn}"
        if turn == rounds:
            break
        for c, (n, x) in moves(state, dims).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], x, strict=True)]
        new = np.array([[x // counts[c] for x in sums[c]] if counts[c] else centres[c] for c in range(len(centres))], np.int64)
        drift = np.sqrt(((new - centres) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        centres = new
    totals = {r["cluster"]: int(r["s"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    # a row for each centroid
    about = [(c, s, sum(totals.values()), centres[c].tolist()) for c, s in totals.items()]
    about = F.broadcast(spark.createDataFrame(about, "c int, cluster_inertia long, inertia long, centroid array<long>"))
    return state.join(about, F.col("cluster") == F.col("c")).select(F.col("vec_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")

