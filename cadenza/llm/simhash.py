"""Near-duplicate documents by SimHash fingerprints and meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly if their balls of radius r share a value. So each
distinct fingerprint emits every variant within r bits of it; fingerprints that meet in a variant
are linked, each to the smallest there. Variants are shuffled by their leading bits: a fingerprint
goes to each leading part that one of its variants has, and the trailing bits are varied at the
receiver, where the same variants would arrive otherwise, one row each.

Defined results: a null text has no words; texts without words have fingerprint zero and are linked
like any other; a null id is smaller than none (a component of null ids has a null component_id);
rows that repeat a document belong to one component; very long texts are read whole, their shingles in blocks;
tables may be empty and have any further columns.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import remove, scratch, stage, with_unique
from cadenza.llm.exact_dedup import stay, text_key

#: Shingles whose hashes are spread to bits at once.
BLOCK = 1 << 15
#: Variants that a task holds at once; more are taken in parts, by further leading bits.
HELD = 2_000_000
#: Fingerprints that one leading part should get, about; sets the number of leading bits.
PER_PART = 30_000


def fingerprint(text: str | None, shingle: int, seed: int) -> int:
    """64 bits, each set if more than half of the text's shingle hashes have it set."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = ends - [len(w) + 1 for w in words]
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :] - 1
    hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BLOCK):
        bits = np.unpackbits(np.array(hashes[i : i + BLOCK], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, fp): fp is the fingerprint as a signed number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found)], ["doc_id", "text_key", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    return own.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


@functools.lru_cache(maxsize=128)
def flips(bits: int, most: int) -> np.ndarray:
    """All masks of `bits` bits with at most `most` set."""
    sets = itertools.chain.from_iterable(itertools.combinations(range(bits), k) for k in range(most + 1))
    return np.array([sum(1 << i for i in s) for s in sets], np.uint64)


@functools.lru_cache(maxsize=None)
def ball(bits: int, most: int) -> int:
    return sum(len(list(itertools.combinations(range(bits), k))) for k in range(most + 1))


def star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges a-b as (node, smallest node that it reaches), without the smallest themselves."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    moved = low != np.arange(len(nodes))
    return nodes[moved], nodes[low[moved]]


def meet(fps: np.ndarray, part: int, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among distinct fps by the variants that lead with `part` (of `bits` bits), as star()."""
    none = np.array([], np.uint64)
    lead = (fps >> np.uint64(64 - bits)) if bits else np.zeros_like(fps)
    left = radius - np.bitwise_count(lead ^ np.uint64(part)).astype(np.int64)
    fps, left = fps[left >= 0], left[left >= 0]
    if len(fps) < 2:
        return none, none
    rest = 64 - bits
    sizes = [ball(rest, k) for k in range(radius + 1)]
    if sum(int((left == k).sum()) * sizes[k] for k in range(radius + 1)) > HELD and rest:
        both = [meet(fps, part << 1 | x, bits + 1, radius) for x in (0, 1)]
        a, b = (np.concatenate(x) for x in zip(*both, strict=True))
        return star(a, b) if len(a) else (none, none)
    low = np.uint64((1 << rest) - 1)
    values, owners = [], []
    for k in range(radius + 1):
        own = np.flatnonzero(left == k)
        masks = flips(rest, k)
        values.append(((fps[own] & low)[:, None] ^ masks).ravel())
        owners.append(np.repeat(own, len(masks)))
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(values)
    values = values[order]
    same = values[1:] == values[:-1]
    # nearly all variants have one owner, so the rest is done for the others alone
    shared = np.flatnonzero(np.append(same, False) | np.append(False, same))
    if not len(shared):
        return none, none
    values, own = values[shared], fps[owners[order[shared]]]
    opens = np.append(True, values[1:] != values[:-1])
    smallest = np.minimum.reduceat(own, np.flatnonzero(opens))[np.cumsum(opens) - 1]
    far = (own != smallest) & (np.bitwise_count(own ^ smallest) <= 2 * radius)
    return star(own[far], smallest[far]) if far.any() else (none, none)


def leading_bits(n: int, radius: int) -> int:
    """Fewest leading bits, 8 at least, that leave each part PER_PART fingerprints on average."""
    return next(b for b in range(8, 49) if n * ball(b, radius) <= PER_PART << b or b == 48)


def links(distinct: DataFrame, n: int, radius: int) -> DataFrame:
    """(a, b): fingerprints and smaller ones in the same component; all links of the n distinct ones."""
    bits = leading_bits(n, radius)
    masks = flips(bits, radius)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = b.column(0).to_numpy().view(np.uint64)
            for fps in np.array_split(whole, len(whole) // 1000 + 1):
                parts = ((fps >> np.uint64(64 - bits))[:, None] ^ masks).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.repeat(fps, len(masks)).view(np.int64))], ["part", "fp"])

    def receive(t: pa.Table) -> pa.Table:
        fps = np.unique(t.column("fp").to_numpy().view(np.uint64))
        a, b = meet(fps, t.column("part")[0].as_py(), bits, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return distinct.select("fp").mapInArrow(emit, "part long, fp long").groupBy("part").applyInArrow(receive, "a long, b long").distinct()


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, root): connected components by turns of large stars and small stars.

    Each turn links neighbours to the smallest of a node's neighbourhood: minima with partial sums, then joined
    to the edges by node. Nodes of very many edges are told by their counts and joined by broadcast, their edges
    dealt out, so a hub is not gathered anywhere.
    """
    spark = edges.sparkSession
    edges = stage(edges.select("a", "b").distinct(), f"{path}/turn0")
    state, turn = None, 0

    def with_least(pairs: DataFrame, rows: int, name: str) -> DataFrame:
        """pairs with m, the least b of each a."""
        least = stage(pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), f"{path}/{name}{turn}")
        return with_unique(pairs, least, "a", "n", rows, F.col("b"))

    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, turn = now, turn + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, 2 * now[0], "large").withColumn("m", F.least("m", "a")).where("b > a")
        down = large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = stage(down.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), f"{path}/down{turn}")
        small = with_least(down, now[0], "small")
        # every b of a node goes to the node's least, and so does the node
        small = small.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b"))))).where("a <> b").distinct()
        edges = stage(small, f"{path}/turn{turn}")
        remove(spark, *(f"{path}/{x}" for x in (f"turn{turn - 1}", f"large{turn}", f"down{turn}", f"small{turn}")))
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def near_duplicates(
    docs: DataFrame, bits: int = 4, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of docs: id, text_key, fp (signed), component_id (smallest id reachable), first_key.

    Fingerprints of `bits` (even) or fewer differing bits are linked. component_id and first_key
    are the id and text_key of the component's first row by (id is null, id, text_key); components
    may share a component_id, if ids are null or repeat, but not both.
    """
    spark = docs.sparkSession
    path = scratch(spark, "simhash")
    own = stage(fingerprints(docs, shingle, seed, id_col, text_col), f"{path}/fingerprints")
    row = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key")
    distinct = stage(own.groupBy("fp").agg(F.min(row).alias("least"), F.count(F.lit(1)).alias("rows")), f"{path}/distinct")
    n = distinct.agg(F.count(F.lit(1)).alias("fps"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    edges = stage(links(distinct, n["fps"], bits // 2), f"{path}/edges")
    roots = components(edges, path)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root"))
    named = stage(named, f"{path}/roots")
    first = named.groupBy("root").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("size"))
    found = with_unique(named, stage(first, f"{path}/first"), "root", "size", n["fps"], F.col("fp"))
    found = found.select("fp", "rows", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("first_key"))
    spread = F.xxhash64("doc_id", "text_key")
    out = with_unique(own, stage(found, f"{path}/components"), "fp", "rows", n["rows"], spread)
    return out.select(F.col("doc_id").alias(id_col), "text_key", "fp", "component_id", "first_key")


def keep_first(docs: DataFrame, result: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, its first by (id is null, id, text_key), with docs' own columns.

    Of rows that repeat both id and text one stays; a null text is an empty one.
    """
    # equal ids and texts are one component's, so both tell its first row from other components' rows
    stays = F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key"))
    rows = result.groupBy(F.col(id_col).alias("__k_id"), F.col("text_key").alias("__k_key"), stays.alias("__stays")).agg(F.count(F.lit(1)).alias("__n"))
    return stay(docs, rows, text_key(F.col(text_col)), id_col, scratch(docs.sparkSession, "simhash-kept"))
