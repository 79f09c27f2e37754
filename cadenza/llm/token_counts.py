"""Token counts by a trie that shares unigram forward scores.

The distinct pre-tokens (words, with a mark for the space before them) are the words of a trie. A node
is a prefix; its forward score is the best sum of piece scores over all ways to cut the prefix into
pieces, and is computed once for all pre-tokens that begin with it. A pre-token's last node holds its
terminal count: the pieces of its best cut.

Documents are dealt to blocks, kept as numbered words. Each block sends its different words once, in
packets by range of the words themselves, so words that begin alike are in one range; a range walks the
trie of all its words in order, holding the path to the present one alone, and answers each block with its
words' terminal counts. A document's count is the sum over its words. So a word is cut once in all, a
prefix that ends inside a range is computed once in all, and only the few nodes on the path to where two ranges
meet are made in both. A task holds a range's words or a block's. Terminal counts can be stored as a table.

Ranges are cut at words of a bounded sample (CUT_WORDS words of CUT_BLOCKS blocks at most); this decides how evenly
they are filled, and nothing else.

The vocabulary is a public one and is not trained; a piece's score is the logarithm of its
probability by Zipf's law, from its rank. Letters without a piece stand for their UTF-8 bytes.

Defined results: a null or empty text has no words and no tokens; of equally good cuts the one with
the fewest pieces counts; rows that repeat are counted each for itself; a null id stays null; tables
may be empty and have further columns.
"""

from __future__ import annotations

import math
import os
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import scratch, stage
from cadenza.llm.wire import Numbers, numbers, packed

#: Fixed mark of the piece files for the space before a word.
MARK = "▁"
#: Letters from which on a pre-token is cut on its own, as no path of so many nodes is worth holding.
LONG = 256
#: Words of a block, and documents at most.
BLOCK_WORDS, BLOCK_DOCS = 1_000_000, 65_536
#: Words that a range gets, about, and ranges at most.
RANGE_WORDS, RANGES = 500_000, 1 << 16
#: Bound of the sample of words that ranges are cut at.
CUT_BLOCKS, CUT_WORDS = 1000, 256
#: Score of a byte that stands for a part of a letter, below the least score of a piece.
BYTE_PENALTY = 10.0


def zipf_scores(pieces: Iterable[str]) -> dict[str, float]:
    """Log probabilities of pieces in order of rank, as 1 / (rank + 1) makes them."""
    ranked = list(pieces)
    total = sum(1 / (r + 1) for r in range(len(ranked)))
    return {p: -math.log((r + 1) * total) for r, p in enumerate(ranked)}


def pieces_of(path: str) -> list[str]:
    """The pieces of a SentencePiece file in order of rank, without control signs and bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    own = range(sp.get_piece_size())
    return [sp.id_to_piece(i) for i in own if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Trie:
    """Terminal counts of pre-tokens in order: the nodes of one path, each with (forward score, pieces)."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - BYTE_PENALTY
        self.path, self.nodes = "", [(0.0, 0)]
        #: Nodes computed so far.
        self.made = 0

    def extended(self, nodes: list[tuple[float, int]], token: str, j: int) -> tuple[float, int]:
        """The node of token[:j]; the last of nodes is that of token[:j - 1]."""
        size = len(token[j - 1].encode())
        score, count = nodes[-1]
        # a letter without a piece is as many bytes as its UTF-8 has
        best, pieces = score + self.unknown * size, count + size
        find = self.scores.get
        for k in range(1, min(self.longest, j, len(nodes)) + 1):
            s = find(token[j - k : j])
            if s is not None:
                score, count = nodes[-k]
                if score + s > best or score + s == best and count + 1 < pieces:
                    best, pieces = score + s, count + 1
        self.made += 1
        return best, pieces

    def count(self, word: bytes) -> int:
        """Terminal count of a word; only nodes that the word before does not share are computed."""
        token = MARK + word.decode()
        if len(token) > LONG:
            return self.alone(token)
        have = len(os.path.commonprefix([self.path, token]))
        nodes = self.nodes
        del nodes[have + 1 :]
        for j in range(have + 1, len(token) + 1):
            nodes.append(self.extended(nodes, token, j))
        self.path = token
        return nodes[-1][1]

    def alone(self, token: str) -> int:
        """Terminal count of a very long pre-token, with the nodes that its pieces can reach alone."""
        recent: list[tuple[float, int]] = [(0.0, 0)]
        for j in range(1, len(token) + 1):
            recent.append(self.extended(recent, token, j))
            if len(recent) > self.longest:
                del recent[0]
        return recent[-1][1]


_scores: dict[str, dict[str, float]] = {}


def scores_of(path: str) -> dict[str, float]:
    """One table for each Python worker, which several tasks use in turn."""
    if path not in _scores:
        _scores[path] = zipf_scores(pieces_of(path))
    return _scores[path]


def words_of(data: bytes) -> list[bytes]:
    """Words do not hold a space, so they are kept joined by one."""
    return data.split(b" ") if data else []


def blocks_of(docs: DataFrame, path: str) -> DataFrame:
    """Write and read (block, doc_ids, sizes, n_distinct, words, tokens): one row a block.

    sizes: words of each document; words: the different ones in order; tokens: numbers of
    each document's words in that order, ascending, as differences.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(docs.schema["id"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, made = TaskContext.get().partitionId() << 32, 0
        ids, sizes, tokens, seen, size = [], [], [], Numbers(), 0

        def block() -> pa.RecordBatch:
            words = list(seen)
            order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
            place = np.empty(len(words), np.int64)
            place[order] = np.arange(len(words))
            whole = place[np.concatenate(tokens)] if words else np.array([], np.int64)
            # by document, then by number
            whole = np.sort(np.repeat(np.arange(len(sizes)), sizes) << 32 | whole) & 0xFFFFFFFF
            cols = ([first + made], [ids], [packed(np.array(sizes, np.int32))], [len(words)], [b" ".join([words[i] for i in order.tolist()])], [packed(np.diff(whole, prepend=0).astype(np.int32))])
            kinds = (pa.int64(), pa.list_(kind), pa.binary(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["block", "doc_ids", "sizes", "n_distinct", "words", "tokens"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = (t.as_py() or "").encode().split()
                tokens.append(np.fromiter(map(seen.__getitem__, own), np.int64, len(own)))
                ids.append(i)
                sizes.append(len(own))
                size += len(own)
                if size >= BLOCK_WORDS or len(ids) >= BLOCK_DOCS:
                    yield block()
                    made += 1
                    ids, sizes, tokens, seen, size = [], [], [], Numbers(), 0
        if ids:
            yield block()

    name = docs.schema["id"].dataType.simpleString()
    return stage(docs.mapInArrow(run, f"block long, doc_ids array<{name}>, sizes binary, n_distinct long, words binary, tokens binary"), path)


def cuts_of(table: DataFrame, ranges: int) -> list[bytes]:
    """Words, in order, at which the blocks' words are cut into so many ranges, about evenly by the sample."""
    some = table.orderBy(F.xxhash64("block"), "block").limit(CUT_BLOCKS).select("words")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                words = words_of(data.as_py())
                at = np.unique(np.linspace(0, len(words) - 1, min(CUT_WORDS, len(words))).astype(int)) if words else []
                yield pa.RecordBatch.from_arrays([pa.array([words[k] for k in at], pa.binary())], ["word"])

    found = sorted(bytes(r["word"]) for r in some.mapInArrow(run, "word binary").collect())
    return sorted({found[k * len(found) // ranges] for k in range(1, ranges)}) if found else []


def counted(table: DataFrame, cuts: list[bytes], pieces_path: str) -> DataFrame:
    """(block, range, words, counts): terminal counts of each block's words, by range in order; and, without a
    block, of all different words of a range, with these."""
    shared = table.sparkSession.sparkContext.broadcast(cuts)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                words = words_of(r["words"])
                ends = [bisect_left(words, c) for c in shared.value] + [len(words)]
                parts = [(k, a, z) for k, (a, z) in enumerate(zip([0, *ends], ends, strict=False)) if a < z]
                if parts:
                    cells = [b" ".join(words[a:z]) for _, a, z in parts]
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in parts], pa.int64()), pa.array([r["block"]] * len(parts), pa.int64()), pa.array(cells, pa.binary())], ["range", "block", "words"])

    def answer(t: pa.Table) -> pa.Table:
        packets = [words_of(w) for w in t.column("words").to_pylist()]
        trie, whole = Trie(scores_of(pieces_path)), sorted(set().union(*packets))
        terminal = {w: trie.count(w) for w in whole}
        reply = lambda words: packed(np.fromiter(map(terminal.__getitem__, words), np.uint32, len(words)))
        n = len(packets)
        return pa.table({
            "block": pa.array([*t.column("block").to_pylist(), None], pa.int64()), "range": pa.array(t.column("range").to_pylist()[:1] * (n + 1), pa.int64()),
            "words": pa.array([None] * n + [b" ".join(whole)], pa.binary()), "counts": pa.array([*map(reply, packets), reply(whole)], pa.binary()),
        })

    return table.select("block", "words").mapInArrow(send, "range long, block long, words binary").groupBy("range").applyInArrow(answer, "block long, range long, words binary, counts binary")


def terminals(found: DataFrame) -> DataFrame:
    """(word, n_tokens) of each different word, from what counted() gives."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own, n = words_of(words), numbers(counts, np.uint32)
                for k in range(0, len(own), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in own[k : k + 50_000]]), pa.array(n[k : k + 50_000].astype(np.int64))], ["word", "n_tokens"])

    return found.where("block is null").select("words", "counts").mapInArrow(run, "word string, n_tokens long")


def count_tokens(docs: DataFrame, pieces_path: str, id_col: str = "doc_id", text_col: str = "text", store: str | None = None) -> DataFrame:
    """One row for each row of docs: id, n_words, n_tokens. store: a folder for the terminal counts, as a table (word, n_tokens)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    path = scratch(spark, "token-counts")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, name = to_arrow_type(own.schema["id"].dataType), own.schema["id"].dataType.simpleString()
    table = blocks_of(own, f"{path}/blocks")
    words = table.agg(F.coalesce(F.sum("n_distinct"), F.lit(0))).first()[0]
    found = stage(counted(table, cuts_of(table, min(RANGES, -(-words // RANGE_WORDS))), pieces_path), f"{path}/counted")
    if store:
        terminals(found).write.parquet(store)

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        block, replies = left.to_pylist()[0], sorted(right.to_pylist(), key=lambda r: r["range"])
        sizes = numbers(block["sizes"], np.int32).astype(np.int64)
        counts = np.concatenate([np.zeros(0, np.uint32), *(numbers(r["counts"], np.uint32) for r in replies)]).astype(np.int64)
        sums = np.append(0, np.cumsum(counts[np.cumsum(numbers(block["tokens"], np.int32).astype(np.int64))]))
        ends = np.cumsum(sizes)
        return pa.table({"id": pa.array(block["doc_ids"], kind), "n_words": pa.array(sizes), "n_tokens": pa.array(sums[ends] - sums[ends - sizes])})

    blocks = table.select("block", "doc_ids", "sizes", "tokens").groupBy("block")
    replies = found.where("block is not null").select("block", "range", "counts").groupBy("block")
    return blocks.cogroup(replies).applyInArrow(summed, f"id {name}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
