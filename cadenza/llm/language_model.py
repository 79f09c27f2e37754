"""Language-model scores by deleted interpolation of word n-grams.

A token's probability is interpolated from the shortest estimate up. The first level mixes the words'
maximum-likelihood estimate, the uniform distribution over the training words and one unknown word,
and an estimate that knows only the unknown word. Each further level, up to `order` words, mixes its
n-grams' maximum-likelihood estimate with the level below, by a weight that differs by how often the
context was seen (buckets of powers of two); an unseen context has none. Weights are learned level by
level by expectation-maximisation on a deleted part of the training texts, with counts of the rest;
the final estimates count both.

Documents are dealt to blocks of one part each (counted, held out, deleted), and a block is kept as
numbered words. Every block sends each of its different n-grams once, as sorted 64-bit hashes packed
by range of the hash; a range adds up all blocks' counts and answers each block with the totals of its
n-grams in the same order. So a frequent n-gram arrives once a block, not once a token, and nothing is
gathered but one range's or one block's numbers. Packets never outnumber the n-grams in them: with so
many ranges that one holds a single n-gram, what is shuffled is a row an n-gram and block.

To the driver come, for each level, the deleted tokens' sums on a grid of bucket, estimate and the
level below's estimate (STEPS a decade, DECADES at most): MOST_CELLS rows, whatever the input and order.
Expectation-maximisation takes a cell's tokens as its means, so weights are those of estimates rounded
to a tenth of a decade; the scores themselves are not rounded.

Defined results: a null text is an empty one, of one token; a null id belongs to the training part
(its text is the empty one's crc32, 0); rows that repeat are counted and scored each for itself;
without training texts every token is the unknown word, of equal chance with none; very long texts are read
whole; tables may be empty and have any further columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import scratch, stage
from cadenza.llm.wire import Numbers, numbers, packed, packed_keys, range_bits, ranges, unpacked_keys

#: Tokens of a block, and documents at most.
BLOCK_TOKENS, BLOCK_DOCS = 2_000_000, 131_072
#: N-grams that a range gets, about.
RANGE_NGRAMS = 1_500_000
#: Context-frequency buckets: by the binary logarithm of the count.
BUCKETS = 24
#: Steps of the grid of estimates, in a decade, and decades.
STEPS, DECADES = 10, 12
MOST_CELLS = BUCKETS * (STEPS * DECADES + 2) ** 2
ROUNDS = 60
COUNTED, HELD_OUT, DELETED = 0, 1, 2
#: Hashes of the end of a text and of what stands before its first word.
END_HASH, START_HASH = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
#: What counts of a longer n-gram's hash: 56 bits, so that packets are a byte an n-gram shorter.
TOLD = np.uint64(0xFFFFFFFFFFFFFF00)
# Odd multipliers of the mixing, any will do.
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def part_of(doc_id: object) -> int:
    """The part of a document: held out by contract; of the rest one in ten is deleted."""
    c = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    return HELD_OUT if c % 5 == 1 else DELETED if c // 5 % 10 == 0 else COUNTED


def blocks_of(docs: DataFrame, path: str) -> DataFrame:
    """Write and read (block, part, n_tokens, doc_ids, sizes, words, tokens): one row a block.

    sizes: tokens of each document; words: hashes of the block's words; tokens: their numbers.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh3_64_intdigest

        first, made = TaskContext.get().partitionId() << 32, 0
        held = {p: ([], [], Numbers({b"": 0}), [0]) for p in (COUNTED, HELD_OUT, DELETED)}

        def flush(p: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, tokens, words, size = held[p]
            held[p] = ([], [], Numbers({b"": 0}), [0])
            if not ids:
                return
            hashes = np.array([int(END_HASH), *(xxh3_64_intdigest(w) for w in words if w)], np.uint64)
            sizes = np.array([len(t) for t in tokens], np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + made]), pa.array([p], pa.int32()), pa.array([size[0]]), pa.array([ids], pa.list_(kind)),
                    pa.array([packed(sizes)], pa.binary()), pa.array([hashes.tobytes()], pa.binary()), pa.array([packed(np.concatenate(tokens))], pa.binary()),
                ],
                ["block", "part", "n_tokens", "doc_ids", "sizes", "words", "tokens"],
            )
            made += 1

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                p = part_of(i)
                ids, tokens, words, size = held[p]
                own = (t.as_py() or "").encode().lower().split()
                own.append(b"")
                tokens.append(np.array(list(map(words.__getitem__, own)), np.int32))
                ids.append(i)
                size[0] += len(own)
                if size[0] >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                    yield from flush(p)
        for p in held:
            yield from flush(p)

    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    table = docs.mapInArrow(run, f"block long, part int, n_tokens long, doc_ids array<{doc_kind}>, sizes binary, words binary, tokens binary")
    return stage(table, path)


def ngrams(sizes: np.ndarray, words: np.ndarray, tokens: np.ndarray, order: int) -> list[np.ndarray]:
    """Hashes of the n-gram that ends at each token, of one word to `order`; texts have starts before them.

    Words are told apart by 64 bits, longer n-grams by 56.
    """
    hashes = words[tokens]
    opens = np.cumsum(sizes) - sizes
    place = np.arange(len(tokens)) - np.repeat(opens, sizes)
    out = [hashes]
    for n in range(1, order):
        before = np.concatenate([np.full(n, START_HASH), hashes[: len(hashes) - n]])[: len(hashes)]
        before = np.where(place < n, START_HASH, before)
        mixed = (out[-1] + before * MIX_A) * MIX_B
        out.append(mixed ^ (mixed >> np.uint64(29)))
    return [out[0], *(x & TOLD for x in out[1:])]


def sent(table: DataFrame, order: int, bits: int) -> DataFrame:
    """(range, block, part, keys, counts): each block's different n-grams, by order and range."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                sizes, words = numbers(r["sizes"], np.int32), np.frombuffer(r["words"], np.uint64)
                for n, grams in enumerate(ngrams(sizes, words, numbers(r["tokens"], np.int32), order)):
                    keys, counts = np.unique(grams, return_counts=True)
                    found, start, end = ranges(keys, bits)
                    counts = counts.astype(np.uint32)
                    cut = lambda pack, v: pa.array([pack(v[a:z]) for a, z in zip(start, end, strict=True)], pa.binary())  # noqa: E731, B023
                    cols = [
                        pa.array(np.array(found) | n << 40), pa.array(np.full(len(found), r["block"])), pa.array(np.full(len(found), r["part"], np.int32)),
                        cut(packed_keys, keys), cut(packed, counts),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["range", "block", "part", "keys", "counts"])

    return table.select("block", "part", "sizes", "words", "tokens").mapInArrow(run, "range long, block long, part int, keys binary, counts binary")


def answered(rows: DataFrame) -> DataFrame:
    """(block, part, range, main, deleted, types_main, types): totals of each block's n-grams in order.

    types and types_main: different n-grams of the range in the training texts, on one of its rows.
    """

    def run(t: pa.Table) -> pa.Table:
        keys = [unpacked_keys(k) for k in t.column("keys").to_pylist()]
        counts = np.concatenate([numbers(c, np.uint32) for c in t.column("counts").to_pylist()]).astype(float)
        lengths = np.array([len(k) for k in keys])
        part = np.repeat(t.column("part").to_numpy(), lengths)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        main = np.bincount(place, counts * (part == COUNTED), len(distinct)).astype(np.uint64)
        deleted = np.bincount(place, counts * (part == DELETED), len(distinct)).astype(np.uint64)
        ends = np.append(0, np.cumsum(lengths))
        pack = lambda totals: pa.array([packed(totals[place[a:z]]) for a, z in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
        once = np.arange(len(keys)) == 0
        return pa.table(
            {
                "block": t.column("block"), "part": t.column("part"), "range": t.column("range"), "main": pack(main), "deleted": pack(deleted),
                "types_main": pa.array(once * int((main > 0).sum())), "types": pa.array(once * int((main + deleted > 0).sum())),
            }
        )

    return rows.groupBy("range").applyInArrow(run, "block long, part int, range long, main binary, deleted binary, types_main long, types long")


def bucket(counts: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + its count's binary logarithm."""
    return np.minimum(np.log2(np.maximum(counts, 0.5)).astype(np.int64) + 1, BUCKETS - 1)


@dataclass
class Totals:
    """Of training texts: documents, tokens and different words."""

    documents: int
    tokens: int
    types: int


@dataclass
class Weights:
    """words: of the first level's three estimates; longer: of each further level's n-grams, by bucket of the context."""

    words: np.ndarray
    longer: list[np.ndarray] = field(default_factory=list)


def token_counts(block: dict, replies: list[dict], order: int, fields: tuple[str, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(sizes, counts): training counts of the n-gram that ends at each token, for each order.

    fields: what to add up, the counted part alone or the deleted one as well.
    """
    sizes, words = numbers(block["sizes"], np.int32), np.frombuffer(block["words"], np.uint64)
    replies = sorted(replies, key=lambda r: r["range"])
    out = []
    for n, grams in enumerate(ngrams(sizes, words, numbers(block["tokens"], np.int32), order)):
        totals = np.concatenate([sum(numbers(r[f], np.uint64) for f in fields) for r in replies if r["range"] >> 40 == n])
        _, place = np.unique(grams, return_inverse=True)
        out.append(totals[place].astype(float))
    return sizes, out


def word_estimates(counts: np.ndarray, total: Totals) -> np.ndarray:
    """Each token's three estimates of the first level: its word, the uniform distribution, the unknown word."""
    known = counts > 0
    return np.stack([counts / max(1, total.tokens), np.full(len(known), 1 / (total.types + 1)), (~known).astype(float)], axis=1)


def level_estimates(sizes: np.ndarray, counts: list[np.ndarray], total: Totals, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of the context, estimate) of each token by its n-gram of n + 1 words."""
    # a context's count is that of the shorter n-gram that ends a token before; of starts alone, the documents
    seen = np.append(0.0, counts[n - 1][:-1])
    seen[np.cumsum(sizes) - sizes] = total.documents
    return bucket(seen), np.minimum(np.divide(counts[n], seen, out=np.zeros(len(seen)), where=seen > 0), 1)


def mixture(sizes: np.ndarray, counts: list[np.ndarray], total: Totals, weights: Weights) -> np.ndarray:
    """Each token's probability by the levels that have weights."""
    p = word_estimates(counts[0], total) @ weights.words
    for n, own in enumerate(weights.longer, 1):
        buckets, ml = level_estimates(sizes, counts, total, n)
        p = own[buckets] * ml + (1 - own[buckets]) * p
    return p


def grid(buckets: np.ndarray, *estimates: np.ndarray) -> np.ndarray:
    """Each token's cell: its bucket and its estimates' logarithms to 1/STEPS of a decade."""
    code = buckets.astype(np.int64)
    for x in estimates:
        level = np.where(x > 0, 1 + np.clip(np.round(-np.log10(np.maximum(x, 1e-300)) * STEPS), 0, STEPS * DECADES), 0)
        code = code * (STEPS * DECADES + 2) + level.astype(np.int64)
    return code


def learn_words(ml: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the first level's estimates; ml: tokens' (or cells') estimates, n: how many each stands for."""
    weights = np.full(3, 1 / 3)
    for _ in range(ROUNDS):
        shares = weights * ml
        shares *= (n / np.maximum(shares.sum(axis=1), 1e-300))[:, None]
        # a little of each, so that every token has a probability
        sums = shares.sum(axis=0) + 1e-2
        weights = sums / sums.sum()
    return weights


def learn_level(buckets: np.ndarray, ml: np.ndarray, below: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of one level's n-grams by bucket; a bucket without tokens keeps an even weight, an unseen context has none."""
    weights = np.full(BUCKETS, 0.5)
    weights[0] = 0
    for _ in range(ROUNDS):
        own = weights[buckets]
        share = n * own * ml / np.maximum(own * ml + (1 - own) * below, 1e-300)
        weights = (np.bincount(buckets, share, BUCKETS) + 1e-2) / (np.bincount(buckets, n, BUCKETS) + 2e-2)
        weights[0] = 0
    return weights


def per_block(table: DataFrame, replies: DataFrame, run, schema: str) -> DataFrame:
    """run(block, replies) for each block; what a block gets is bounded by its tokens."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left.to_pylist()[0], right.to_pylist())

    return table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(both, schema)


def learn(deleted: DataFrame, order: int, total: Totals) -> Weights:
    """Weights of all levels from the deleted tokens; deleted: sizes and counts (packed, by order) of each block."""

    def cells(weights: Weights | None, n: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    sizes, counts = numbers(r["sizes"], np.int32), [numbers(c, np.uint64).astype(float) for c in r["counts"]]
                    if weights is None:
                        buckets = np.zeros(len(counts[0]), np.int64)
                        ml = below = counts[0]
                        code = grid(buckets, ml / max(1, total.tokens))
                    else:
                        below = mixture(sizes, counts, total, weights)
                        buckets, ml = level_estimates(sizes, counts, total, n)
                        code = grid(buckets, ml, below)
                    _, first, place, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
                    sums = [np.bincount(place, x, len(times)) for x in (ml, below)]
                    yield pa.RecordBatch.from_arrays([pa.array(code[first]), pa.array(buckets[first]), pa.array(times), *map(pa.array, sums)], ["code", "bucket", "n", "ml", "below"])

        table = deleted.mapInArrow(run, "code long, bucket long, n long, ml double, below double")
        # MOST_CELLS rows at most
        got = table.groupBy("code", "bucket").agg(*(F.sum(c).alias(c) for c in ("n", "ml", "below"))).toArrow()
        n = got.column("n").to_numpy().astype(float)
        return got.column("bucket").to_numpy(), n, *(got.column(c).to_numpy() / n for c in ("ml", "below"))

    _, n, counts, _ = cells(None, 0)
    weights = Weights(learn_words(word_estimates(counts, total), n))
    for k in range(1, order):
        buckets, n, ml, below = cells(weights, k)
        weights = Weights(weights.words, [*weights.longer, learn_level(buckets, ml, below, n)])
    return weights


def score(docs: DataFrame, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    path = scratch(spark, "lm")
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = blocks_of(own, f"{path}/blocks")
    sums = {r["part"]: r for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.sum(F.size("doc_ids")).alias("docs")).collect()}
    total = lambda what, *parts: sum(int(sums[p][what]) for p in parts if p in sums)
    bits = range_bits(total("n", COUNTED, HELD_OUT, DELETED), RANGE_NGRAMS)
    replies = stage(answered(sent(table, order, bits)), f"{path}/replies")
    types = replies.where(F.shiftright("range", 40) == 0).agg(F.coalesce(F.sum("types_main"), F.lit(0)).alias("main"), F.coalesce(F.sum("types"), F.lit(0)).alias("all")).first()
    main = Totals(total("docs", COUNTED), total("n", COUNTED), types["main"])
    train = Totals(total("docs", COUNTED, DELETED), total("n", COUNTED, DELETED), types["all"])
    replies = replies.select("block", "part", "range", "main", "deleted")

    def counted(block: dict, own: list[dict]) -> pa.Table:
        _, counts = token_counts(block, own, order, ("main",))
        return pa.table({"sizes": pa.array([block["sizes"]], pa.binary()), "counts": pa.array([[packed(c.astype(np.uint64)) for c in counts]], pa.list_(pa.binary()))})

    part = F.col("part") == DELETED
    deleted = stage(per_block(table.where(part), replies.where(part).drop("deleted"), counted, "sizes binary, counts array<binary>"), f"{path}/deleted")
    weights = learn(deleted, order, main)

    def scores(block: dict, own: list[dict]) -> pa.Table:
        sizes, counts = token_counts(block, own, order, ("main", "deleted"))
        logs = np.log10(mixture(sizes, counts, train, weights))
        base = np.log10((counts[0] + 0.5) / (train.tokens + 0.5 * (train.types + 1)))
        first = np.cumsum(sizes) - sizes
        return pa.table(
            {
                "doc_id": pa.array(block["doc_ids"], kind), "held_out": np.full(len(sizes), block["part"] == HELD_OUT), "n_tokens": sizes.astype(np.int64),
                "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), first), "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(logs, first),
            }
        )

    kind = to_arrow_type(own.schema["doc_id"].dataType)
    doc_kind = own.schema["doc_id"].dataType.simpleString()
    found = per_block(table, replies, scores, f"doc_id {doc_kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("doc_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(train.tokens).cast("long").alias("train_tokens"), "base_score", "score")
