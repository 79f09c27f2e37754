"""Substring deduplication by level-wise doubling.

Level one are windows of half the length. They are not taken at every word: of the half windows
inside each full window the one with the least hash is its anchor, so equal full windows have equal
anchors wherever they stand, and one half window in six is enough. Only full windows whose anchor is
repeated are extended to the full length; of those that repeat, every one but the first loses its
words. Then windows that are repeated, and whose neighbour one length on is repeated too, are extended to
twice that length, again and again, until no candidates survive. Longer levels remove no further word (their
words are in repeated windows of the full length already); they give each document the longest length at
which a window of it is repeated. An extended window's hash is made of its halves', so texts are read for
the first two levels alone.

Texts of equal words are one text: the first row stands for all, and the others lose every window.
A task sends each level's windows sorted, in packets by range of their hash, each different window
once, so a passage that very many documents share arrives once a task and not once a document. A
range finds the windows that several texts have (level one), or which windows are repeated and which of
these are not the first (later levels), and answers with those alone.

Words have 128-bit hashes. Candidates of level one are told by 64 bits of them and different texts by 63, so
that a collision costs time, or with odds of 2 to the 63 a window; windows whose words are removed by 128.

Defined results: a null text has no words; texts with fewer words than a window keep all; a null id
counts as larger than any other; rows that share an id are ordered by a hash of their text, and of
rows that repeat id and text one comes first; tables may be empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import remove, scratch, small, stage
from cadenza.llm.wire import numbers, packed, packed_keys, range_bits, ranges, unpacked_keys

#: Words that a task hashes together, and windows that it sends together.
BLOCK_WORDS, SENT = 400_000, 1_500_000
#: Windows that one range gets, about.
RANGE_WINDOWS = 1_000_000
#: Words whose hash a Python worker remembers.
REMEMBERED = 400_000
#: Texts are answered in blocks of neighbouring numbers, of so many bits (8 at most).
BLOCK_BITS = 8
#: Bytes of lists by document up to which these are broadcast.
BROADCAST_BYTES = 64_000_000
# Odd multipliers of the mixing, any will do.
STEPS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Words(dict):
    """Words numbered as they come, and their hashes, for as long as they are remembered."""

    def __init__(self):
        super().__init__()
        self.digests = bytearray()

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_128_digest

        self.digests += xxh3_128_digest(word)
        n = self[word] = len(self)
        return n

    def hashes(self, words: list[list[bytes]]) -> np.ndarray:
        """Two 64-bit hashes of each word of the texts, one text after the other."""
        if len(self) > REMEMBERED:
            self.clear()
            self.digests = bytearray()
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
        return np.frombuffer(bytes(self.digests), np.uint64).reshape(-1, 2)[at].T.copy()


_words = Words()


def grams(hashes: np.ndarray, n: int, step: int = STEPS[0]) -> np.ndarray:
    """Hash of the n words from each place on."""
    if len(hashes) < n:
        return np.array([], np.uint64)
    out, count, done = None, len(hashes) - n + 1, 0
    # by doubling: the words of each binary digit of n in turn
    power, block, width = step, hashes, 1
    while done < n:
        if n & width:
            part = block[done : done + count]
            scale = np.uint64(pow(step, done, 1 << 64))
            out = part * scale if out is None else out + part * scale
            done += width
        if done < n:
            block = block[: len(block) - width] + block[width:] * np.uint64(power)
            power, width = power * power % (1 << 64), width * 2
    out = out ^ (out >> np.uint64(30))
    out = out * MIX_A
    out ^= out >> np.uint64(27)
    out *= MIX_B
    out ^= out >> np.uint64(31)
    return out


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Least of each n neighbours, by doubling."""
    width = 1
    while width * 2 <= n:
        values, width = np.minimum(values[: len(values) - width], values[width:]), width * 2
    return values if width == n else np.minimum(values[: len(values) - (n - width)], values[n - width :])


class Block:
    """The words of some documents, one after the other, and their windows."""

    def __init__(self, words: list[list[bytes]], window: int):
        self.half, self.window = window // 2, window
        self.counts = np.array([len(w) for w in words], np.int64)
        self.starts = np.append(0, np.cumsum(self.counts))
        self.lanes = _words.hashes(words)
        self.doc = np.repeat(np.arange(len(words)), self.counts)
        n = max(0, len(self.doc) - window + 1)
        #: Windows lie in one document.
        self.whole = np.flatnonzero(self.doc[:n] == self.doc[window - 1 : window - 1 + n])
        self.halves = grams(self.lanes[0], self.half) | np.uint64(1)
        self.least = sliding_min(self.halves, window - self.half + 1) if n else self.halves[:0]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(doc, hash) of the half windows that are the least of some whole window, in order of place."""
        least = np.zeros(len(self.halves), np.uint64)
        least[self.whole] = self.least[self.whole]
        span = self.window - self.half + 1
        # the greatest least value among the windows that a half window lies in
        padded = np.append(np.zeros(span - 1, np.uint64), least)
        best = ~sliding_min(~padded, span) if len(padded) >= span else least
        at = np.flatnonzero((best == self.halves) & (best > 0))
        return self.doc[at], self.halves[at]

    def windows(self, anchors: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, pos, hash, other hash) of the windows whose anchor is among their document's."""
        # a document's anchors are looked up with its number mixed in
        mixed = lambda doc, h: h ^ (doc.astype(np.uint64) * MIX_A)
        own = np.fromiter(chain.from_iterable(anchors), np.int64, sum(map(len, anchors))).view(np.uint64)
        wanted = mixed(np.repeat(np.arange(len(anchors)), [len(a) for a in anchors]), own)
        at = self.whole[np.isin(mixed(self.doc[self.whole], self.least[self.whole]), wanted)]
        doc = self.doc[at]
        both = [grams(lane, self.window, step)[at] for lane, step in zip(self.lanes, STEPS, strict=True)]
        return doc, at - self.starts[doc], *both


def kind_of(docs: DataFrame, col: str) -> tuple[str, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[col].dataType
    return kind.simpleString(), to_arrow_type(kind)


def some_words(batches: Iterable[pa.RecordBatch], columns: int) -> Iterator[tuple[list[list], list[list[bytes]]]]:
    """Documents of about BLOCK_WORDS words at a time: their first columns as lists, and words; texts come last."""
    for b in batches:
        cols, words, size = [[] for _ in range(columns)], [], 0
        for i in range(b.num_rows):
            for c, x in zip(cols, b.columns, strict=False):
                c.append(x[i].as_py())
            words.append((b.column(columns)[i].as_py() or "").encode().split())
            size += len(words[-1])
            if size >= BLOCK_WORDS:
                yield cols, words
                cols, words, size = [[] for _ in range(columns)], [], 0
        if words:
            yield cols, words


def keyed(docs: DataFrame, id_col: str, text_col: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, text) of all rows, and of all but those that repeat both id and text.

    text_key tells rows apart that share an id, and is 0 where none does.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    again = own.groupBy(F.col("doc_id").alias("g_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = stage(again.select("g_id", F.lit(True).alias("shared")), f"{path}/shared-ids")
    if again.isEmpty():
        own = own.select("doc_id", F.lit(0).cast("long").alias("text_key"), "text")
        return own, own
    own = own.join(small(again), F.col("doc_id").eqNullSafe(F.col("g_id")), "left")
    key = F.when(F.col("shared"), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long"))
    own = own.select("doc_id", key.alias("text_key"), "text", F.coalesce("shared", F.lit(False)).alias("shared"))
    once = own.where("not shared").unionByName(own.where("shared").dropDuplicates(["doc_id", "text_key"]))
    return own.drop("shared"), once.drop("shared")


def with_lists(docs: DataFrame, lists: DataFrame, size: str) -> DataFrame:
    """docs (doc_id, text_key, text) with their lists: broadcast up to BROADCAST_BYTES in all, else joined by a shuffle.

    size: the bytes of a row's list, as SQL.
    """
    lists = lists.withColumnsRenamed({"doc_id": "l_id", "text_key": "l_key"})
    n = lists.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.expr(size)), F.lit(0)).alias("bytes")).first()
    held = F.broadcast(lists) if 64 * n["rows"] + n["bytes"] <= BROADCAST_BYTES else lists
    return docs.join(held, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_key") == F.col("l_key"))).drop("l_id", "l_key")


class Anchors:
    """The anchors of different texts, gathered by a task until it sends them."""

    def __init__(self, base: int, bits: int):
        self.base, self.bits = base, bits
        self.texts: dict[bytes, int] = {}
        self.owners: list[tuple[tuple, int]] = []
        self.doc: list[np.ndarray] = []
        self.hash: list[np.ndarray] = []
        self.size = 0

    def is_new(self, digest: bytes, order: tuple, row: int) -> bool:
        """Whether a text was not here before; the first row of equal texts owns it."""
        at = self.texts.setdefault(digest, len(self.owners))
        if at < len(self.owners):
            self.owners[at] = min(self.owners[at], (order, row))
            return False
        self.owners.append((order, row))
        return True

    def add(self, texts: np.ndarray, hashes: np.ndarray) -> None:
        self.doc.append(texts)
        self.hash.append(hashes)
        self.size += len(hashes)

    def send(self) -> tuple[pa.Table | None, pa.Table | None]:
        """(rows and anchors that repeat among the texts here, packets of each different anchor)."""
        if not self.size:
            return None, None
        doc, keys = np.concatenate(self.doc), np.concatenate(self.hash)
        order = np.argsort(keys, kind="stable")
        doc, keys = doc[order], keys[order]
        rows = np.array([r for _, r in self.owners], np.int64)
        tids = np.frombuffer(b"".join(d[:8] for d in self.texts), np.uint64) | np.uint64(1)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        times = np.diff(np.append(first, len(keys)))
        many = np.repeat(times > 1, times)
        # of a text that has an anchor twice one row is enough
        many[1:] &= (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
        here = pa.table({"row": rows[doc[many]], "hash": keys[many].view(np.int64)})
        keys, doc = keys[first], doc[first]
        tid, row = np.where(times > 1, np.uint64(0), tids[doc]), (rows[doc] - self.base).astype(np.uint32)
        found, start, end = ranges(keys, self.bits)
        cut = lambda pack, values: pa.array([pack(values[a:z]) for a, z in zip(start, end, strict=True)], pa.binary())
        return here, pa.table(
            {"range": found, "base": [self.base] * len(found), "keys": cut(packed_keys, keys), "tids": cut(packed, tid), "rows": cut(packed, row)}
        )


def first_level(docs: DataFrame, window: int, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, anchors): row, doc_id, text_key, n_words and sha of all words by document; row and hash of
    the repeated anchors of each different text, on its first row (or on a row of an equal text besides)."""
    from hashlib import sha256

    spark = docs.sparkSession
    name, kind = kind_of(docs, "doc_id")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # a word has six bytes, about, and an anchor in window - half + 2 words is two of them
    bits = range_bits(size // 6 * 2 // (window - window // 2 + 2), RANGE_WINDOWS)
    schema = f"kind int, row long, doc_id {name}, text_key long, n_words long, sha string, hash long, range long, base long, keys binary, tids binary, rows binary"
    types = dict(kind=pa.int32(), row=pa.int64(), doc_id=kind, text_key=pa.int64(), n_words=pa.int64(), sha=pa.string(), hash=pa.int64(), range=pa.int64(), base=pa.int64(), keys=pa.binary(), tids=pa.binary(), rows=pa.binary())

    def batch(of: int, cols: dict) -> pa.RecordBatch:
        n = len(next(iter(cols.values())))
        cols = {"kind": np.full(n, of, np.int32)} | cols
        full = [c.combine_chunks() if isinstance(c := cols.get(k), pa.ChunkedArray) else pa.nulls(n, t) if c is None else pa.array(c, t) for k, t in types.items()]
        return pa.RecordBatch.from_arrays(full, list(types))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seen = TaskContext.get().partitionId() << 32, 0
        held = Anchors(base, bits)

        def sent() -> Iterator[pa.RecordBatch]:
            for of, t in zip((1, 2), held.send(), strict=True):
                if t is not None and t.num_rows:
                    yield batch(of, {c: t.column(c) for c in t.column_names})

        for (ids, keys), words in some_words(batches, 2):
            whole = [sha256(b" ".join(w)) for w in words]
            n = len(words)
            yield batch(0, {"row": np.arange(n) + base + seen, "doc_id": ids, "text_key": keys, "n_words": [len(w) for w in words], "sha": [d.hexdigest() for d in whole]})
            new = [i for i in range(n) if len(words[i]) >= window and held.is_new(whole[i].digest(), (ids[i] is None, ids[i], keys[i]), base + seen + i)]
            seen += n
            if new:
                doc, hashes = Block([words[i] for i in new], window).anchors()
                held.add(doc + len(held.owners) - len(new), hashes)
            if held.size >= SENT:
                yield from sent()
                held = Anchors(base, bits)
        yield from sent()

    level = docs.mapInArrow(run, schema)
    level.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/level")
    level = spark.read.schema(level.schema).parquet(f"{path}/level")

    def repeated(t: pa.Table) -> pa.Table:
        keys = [unpacked_keys(k) for k in t.column("keys").to_pylist()]
        rows = [numbers(r, np.uint32).astype(np.int64) + b for r, b in zip(t.column("rows").to_pylist(), t.column("base").to_pylist(), strict=True)]
        keys, rows, tids = np.concatenate(keys), np.concatenate(rows), np.concatenate([numbers(x, np.uint64) for x in t.column("tids").to_pylist()])
        order = np.argsort(keys)
        keys, rows, tids = keys[order], rows[order], tids[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        # several texts here, or several in a task, which sends 0
        least, most = np.minimum.reduceat(tids, first), np.maximum.reduceat(tids, first)
        again = np.repeat((least == 0) | (least != most), np.diff(np.append(first, len(keys)))) & (tids != 0)
        return pa.table({"row": rows[again], "hash": keys[again].view(np.int64)})

    replies = level.where("kind = 2").select("range", "base", "keys", "tids", "rows").groupBy("range").applyInArrow(repeated, "row long, hash long")
    return level.where("kind = 0").select("row", "doc_id", "text_key", "n_words", "sha"), level.where("kind = 1").select("row", "hash").unionByName(replies)


def candidates(documents: DataFrame, anchors: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(firsts, found): the first row of each different text and how many rows have it; and of those with
    repeated anchors doc_id, text_key, rank (a number in order of id and text_key), row and anchors."""
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "text_key", "row")
    firsts = stage(documents.groupBy("sha").agg(F.min(order).alias("f"), F.count(F.lit(1)).alias("copies")).select("f.*", "copies"), f"{path}/firsts")
    # a document has no more anchors than words
    by_row = anchors.groupBy("row").agg(F.collect_list("hash").alias("anchors"))
    found = by_row.join(firsts, "row").repartitionByRange("no_id", "doc_id", "text_key").sortWithinPartitions("no_id", "doc_id", "text_key")
    # partitions are ranges in order, so these numbers are in order too
    found = found.select("doc_id", "text_key", F.monotonically_increasing_id().alias("rank"), "row", "anchors")
    return firsts.select("row", "copies"), stage(found, f"{path}/candidates")


def places_of(data: bytes) -> np.ndarray:
    """Places that were packed as differences, which may wrap around."""
    return np.cumsum(numbers(data, np.uint32), dtype=np.uint32).astype(np.int64)


def repeated(rank: np.ndarray, pos: np.ndarray, keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, mask in that order of each window's first, and of those firsts that others repeat)."""
    order = np.lexsort((pos, rank, others, keys))
    k, o = keys[order], others[order]
    first = np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])) if len(order) else np.array([], bool)
    return order, first, first & np.append(~first[1:], False) if len(order) else first


def told(order: np.ndarray, masks: dict[bool, np.ndarray], rank: np.ndarray, pos: np.ndarray) -> tuple[list, list, list, list]:
    """(blocks, late, ranks, places) of the windows in each mask: a packet for each block of texts."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    for late, mask in masks.items():
        r, p = rank[order[mask]], pos[order[mask]]
        by = np.lexsort((p, r))
        r, p = r[by], p[by].astype(np.uint32)
        block = r >> BLOCK_BITS
        if not len(r):
            continue
        cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(r)], strict=True):
            packet = (int(block[i]), late, packed((r[i:j] & ((1 << BLOCK_BITS) - 1)).astype(np.uint8)), packed(np.diff(p[i:j], prepend=np.uint32(0))))
            for part, x in zip(out, packet, strict=True):
                part.append(x)
    return out


STATE = "rank long, n long, places binary, keys binary, others binary"


def state_rows(ranks: np.ndarray, doc: np.ndarray, pos: np.ndarray, keys: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
    """A row for each text that has windows; doc: numbers of texts in order, each one's windows in order of place."""
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.array([], int)
    parts = [np.split(x, cuts[1:]) if len(doc) else [] for x in (pos.astype(np.uint32), keys, others)]
    cols = [ranks[doc[cuts]] if len(doc) else ranks[:0], np.diff(np.append(cuts, len(doc))), [packed(np.diff(p, prepend=np.uint32(0))) for p in parts[0]], *([packed(x) for x in p] for p in parts[1:])]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["rank", "n", "places", "keys", "others"])


def windows_of(texts: DataFrame, window: int) -> DataFrame:
    """STATE of the windows whose half is repeated; texts: rank, anchors, text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ranks, anchors), words in some_words(batches, 2):
            yield state_rows(np.array(ranks, np.int64), *Block(words, window).windows(anchors))

    return texts.select("rank", "anchors", "text").mapInArrow(run, STATE)


def repeats(state: DataFrame, n_windows: int) -> DataFrame:
    """(block, late, ranks, places): windows that are repeated, by block of texts; late if they also start earlier."""
    bits = range_bits(n_windows, RANGE_WINDOWS)
    names = ("range", "block", "late", "own", "places", "keys", "others", "ranks", "at")
    types = (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 6)

    def send(held: list[tuple], task: int) -> Iterator[pa.RecordBatch]:
        rank, pos, keys, others = (np.concatenate(x) for x in zip(*held, strict=True))
        order, first, early = repeated(rank, pos, keys, others)
        # what a task knows by itself goes along as it is, in a range of its own
        parts = told(order, {True: ~first, False: early}, rank, pos)
        none = [None] * len(parts[0])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([-1 - task] * len(none), *parts, *[none] * 4), types, strict=True)], names)
        at = order[first]
        found, start, end = ranges(keys[at], bits)
        cut = lambda pack, v: [pack(v[at[a:z]]) for a, z in zip(start, end, strict=True)]
        none = [None] * len(found)
        cols = (found, *[none] * 4, cut(packed_keys, keys), cut(packed, others), cut(packed, rank), cut(packed, pos.astype(np.uint32)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size = TaskContext.get().partitionId(), [], 0
        for b in batches:
            for rank, n, places, keys, others in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append((np.full(n, rank), places_of(places), numbers(keys, np.uint64), numbers(others, np.uint64)))
                size += n
                if size >= SENT:
                    yield from send(held, task)
                    held, size = [], 0
        if held:
            yield from send(held, task)

    def answer(t: pa.Table) -> pa.Table:
        if t.column("range")[0].as_py() < 0:
            return t.select(["block", "late", "own", "places"])
        keys = np.concatenate([unpacked_keys(k) for k in t.column("keys").to_pylist()])
        others, rank, pos = (np.concatenate([numbers(x, k) for x in t.column(c).to_pylist()]) for c, k in (("others", np.uint64), ("ranks", np.int64), ("at", np.uint32)))
        order, first, early = repeated(rank, pos, keys, others)
        parts = told(order, {True: ~first, False: early}, rank, pos)
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("block", "late", "own", "places"), parts, types[1:5], strict=True)})

    sent = state.select("rank", "n", "places", "keys", "others").mapInArrow(run, "range long, block long, late boolean, own binary, places binary, keys binary, others binary, ranks binary, at binary")
    return sent.groupBy("range").applyInArrow(answer, "block long, late boolean, own binary, places binary")


def joined(a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Hashes of windows from those of their halves."""
    out = (a * np.uint64(step)) ^ (b + np.uint64(STEPS[0]) + (a >> np.uint64(7)))
    out = (out ^ (out >> np.uint64(30))) * MIX_A
    out = (out ^ (out >> np.uint64(27))) * MIX_B
    return out ^ (out >> np.uint64(31))


def extended(state: DataFrame, replies: DataFrame, length: int) -> DataFrame:
    """A row for each text with repeated windows: rank, late (packed places of the late ones), and, as STATE, its
    windows of twice the length of which both halves are repeated (n may be 0)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        told = {True: [], False: []}
        for late, own, places in zip(*(right.column(c).to_pylist() for c in ("late", "own", "places")), strict=True):
            told[late].append((numbers(own, np.uint8).astype(np.int64), places_of(places)))
        # a text and a place in it as one number
        spots = {k: np.unique(np.concatenate([np.zeros(0, np.int64), *(r << 32 | p for r, p in v)])) for k, v in told.items()}
        every = np.union1d(spots[True], spots[False])
        rows = []
        for rank, places, keys, others in zip(*(left.column(c).to_pylist() for c in ("rank", "places", "keys", "others")), strict=True):
            number = (rank & ((1 << BLOCK_BITS) - 1)) << 32
            own = {k: x[slice(*np.searchsorted(x, (number, number + (1 << 32))))] - number for k, x in ((True, spots[True]), (None, every))}
            if not len(own[None]):
                continue
            at = places_of(places)
            kept = np.isin(at, own[None], assume_unique=True)
            at, keys, others = at[kept], numbers(keys, np.uint64)[kept], numbers(others, np.uint64)[kept]
            right_ = np.minimum(np.searchsorted(at, at + length), len(at) - 1)
            two = np.flatnonzero(at[right_] == at + length)
            second = right_[two]
            pack = lambda p: packed(np.diff(p.astype(np.uint32), prepend=np.uint32(0)))
            rows.append((rank, pack(own[True]), len(two), pack(at[two]), packed(joined(keys[two], keys[second], STEPS[0])), packed(joined(others[two], others[second], STEPS[1]))))
        types = (pa.int64(), pa.binary(), pa.int64(), *[pa.binary()] * 3)
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.table({c: pa.array(list(x), k) for c, x, k in zip(("rank", "late", "n", "places", "keys", "others"), cols, types, strict=True)})

    by = state.withColumn("block", F.shiftright("rank", BLOCK_BITS)).groupBy("block")
    return by.cogroup(replies.groupBy("block")).applyInArrow(run, STATE.replace("rank long,", "rank long, late binary,"))


def levels(texts: DataFrame, window: int, n_windows: int, path: str) -> Iterator[tuple[int, DataFrame]]:
    """(length, texts with repeated windows of it: rank, late) of the full length and each doubling of it, until no candidates survive."""
    spark, state, length, n = texts.sparkSession, stage(windows_of(texts, window), f"{path}/state-{window}"), window, n_windows
    while n:
        replies = stage(repeats(state.where("n > 0"), n), f"{path}/replies-{length}")
        state = stage(extended(state.where("n > 0"), replies, length), f"{path}/state-{2 * length}")
        remove(spark, f"{path}/replies-{length}", *([f"{path}/state-{window}"] if length == window else []))
        yield length, state.select("rank", "late")
        n, length = state.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], 2 * length


def cut(texts: DataFrame, window: int) -> DataFrame:
    """(row, doc_id, n_removed, kept): texts without the words of late windows; texts: row, doc_id, late, text."""
    name, kind = kind_of(texts, "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (rows, ids, late), words in some_words(batches, 3):
            removed, kept = [], []
            for own, w in zip(late, words, strict=True):
                gone = np.zeros(len(w) + 1, np.int64)
                at = places_of(own)
                gone[at] += 1
                gone[at + window] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w[i] for i in np.flatnonzero(~gone).tolist()]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, kind), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["row", "doc_id", "n_removed", "kept"])

    return texts.select("row", "doc_id", "late", "text").mapInArrow(run, f"row long, doc_id {name}, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables by row (a number): every row's doc_id, text_key, n_words, sha (hex SHA-256 of its words
    joined by one space) and longest (the greatest of window, 2 * window, 4 * window ... at which a window of it is
    repeated, or 0); and doc_id, n_removed and kept (words left, joined by one space) of rows that lose words.

    window must be even, 4 at least.
    """
    if window % 2 or window < 4:
        raise ValueError("window must be even, 4 at least")
    spark = docs.sparkSession
    path = scratch(spark, "substrings")
    own, once = keyed(docs, id_col, text_col, path)
    documents, anchors = first_level(own, window, path)
    firsts, found = candidates(documents, anchors, path)
    remove(spark, f"{path}/level/kind=1", f"{path}/level/kind=2")
    n = found.agg(F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()[0] * (window - window // 2 + 1)
    first, seen = None, found.select("rank", F.lit(0).alias("length")).limit(0)
    for length, again in levels(with_lists(once, found, "8 * size(anchors)"), window, n, path):
        first = first or again
        seen = seen.unionByName(again.select("rank", F.lit(length).alias("length")))
    late = found.join(first.where("octet_length(late) > 4"), "rank") if first else found.withColumn("late", F.lit(None).cast("binary")).limit(0)
    gone = stage(late.select("doc_id", "text_key", "row", "late"), f"{path}/gone")
    lengths = seen.groupBy("rank").agg(F.max("length").alias("length")).join(found.select("rank", "row"), "rank").select("row", "length")
    about = stage(firsts.join(lengths, "row", "left").select(F.col("row").alias("f_row"), "copies", "length"), f"{path}/lengths")
    remove(spark, f"{path}/candidates", f"{path}/firsts", *(f"{path}/state-{window << k}" for k in range(40)))
    # all of a text that several rows have is repeated; such rows but the first are in no other table
    ladder = F.coalesce(F.array_max(F.filter(F.lit([window << k for k in range(32)]), lambda x: x <= F.col("n_words"))), F.lit(0))
    whole = F.when(F.col("copies").isNull() | (F.col("copies") > 1), ladder).otherwise(0)
    documents = documents.join(about, F.col("row") == F.col("f_row"), "left").withColumn("longest", F.greatest(whole, F.coalesce("length", F.lit(0))).cast("long"))
    copies = documents.where((F.col("n_words") >= window) & F.col("f_row").isNull())
    changed = cut(with_lists(once, gone, "octet_length(late)"), window)
    changed = changed.unionByName(copies.select("row", "doc_id", F.col("n_words").alias("n_removed"), F.lit("").alias("kept")))
    return documents.select("row", "doc_id", "text_key", "n_words", "sha", "longest"), changed


def repeated_lengths(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, pos, length): starts of repeated stretches of window, 2*window, 4*window, ... words.

    Each level's windows are pairs of neighbouring repeated windows of the level below; it ends when
    none is left. Only the windows that are repeated themselves go on. Rows that repeat an id and text,
    but not rows of equal texts, are one document.
    """
    spark = docs.sparkSession
    path = scratch(spark, "lengths")
    _, once = keyed(docs, id_col, text_col, path)
    name, kind = kind_of(once, "doc_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids, keys), words in some_words(batches, 2):
            b = Block(words, window)
            doc = b.doc[b.whole]
            at, cols = pa.array(doc), (pa.array(ids, kind), pa.array(keys, pa.int64()))
            hashes = [pa.array(grams(lane, window, step)[b.whole].view(np.int64)) for lane, step in zip(b.lanes, STEPS, strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in cols), *hashes, pa.array((b.whole - b.starts[doc]).astype(np.int32))], ["doc_id", "text_key", "hash", "other", "pos"])

    now, length, out = once.mapInArrow(run, f"doc_id {name}, text_key long, hash long, other long, pos int"), window, None
    while True:
        repeated = now.groupBy("hash", "other").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash", "other")
        now = stage(now.join(repeated, ["hash", "other"]).select("doc_id", "text_key", "hash", "other", "pos"), f"{path}/length={length}")
        if now.isEmpty():
            break
        rows = now.select("doc_id", "text_key", "pos", F.lit(length).alias("length"))
        out = rows if out is None else out.unionByName(rows)
        right = now.select(F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"), (F.col("pos") - length).alias("r_pos"), F.col("hash").alias("r_hash"), F.col("other").alias("r_other"))
        on = F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")) & (F.col("pos") == F.col("r_pos"))
        now = now.join(right, on).select("doc_id", "text_key", F.xxhash64("hash", "r_hash").alias("hash"), F.xxhash64("other", "r_other").alias("other"), "pos")
        length *= 2
    return now.select("doc_id", "text_key", "pos", F.lit(0).alias("length")) if out is None else out
