"""Packing by power-of-two decomposition.

A document of n tokens is cut into whole sequences and the binary digits of the rest: pieces of
1024, ..., 4, 2, 1 tokens. Every piece is a sequence of its own, a power of two long, so nothing is
padded and no sequence crosses documents; pieces of one length form a bucket, which is what a
training batch draws from.

Sequence numbers are dealt by bucket and scan task, without a pass over all pieces. They repeat for
as long as the input is split in the same way; write the pieces to fix them.

Defined results: a null or empty text has the end id alone (one piece of one token); the content of
an added token inside a text is that token, as the tokenizer file has it by default; rows that repeat
a document are packed each for itself; a null id stays null; very long texts are cut into pieces whole, a text
being held by one task; an empty table gives no pieces, and further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose ids a Python worker remembers (about 250 bytes each); the older half goes when it is full.
REMEMBERED = 600_000
#: Bytes of ids in an output batch, about.
BATCH_BYTES = 4_000_000
#: Bits of a sequence number: bucket (4), task (24), count within the task's bucket (35).
TASK_BITS, COUNT_BITS = 24, 35


class Remembered(dict):
    """Ids of words after a space, encoded when they are first met; the older half goes when it is full."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordTokenizer:
    """Ids of whole texts from a byte-level BPE file, each different word encoded once.

    A space that a non-space follows always starts a new pre-token, so a text may be cut there and
    the parts encoded on their own. Ids are kept as little-endian unsigned 32-bit numbers.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        # the pattern of byte-level BPE, as the installed tokenizers split
        self.pre_tokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        # a space that no word follows at once; here a white-space letter too many does no harm
        self.spaces = re.compile(r" (?=\s|$)").search
        self.cut = regex.compile(r" (?=\S)").split
        # bytes as letters: printable ones stand for themselves, the others follow from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in set(shown))}
        self.words = Remembered(lambda word: b"".join(map(self.encode_part, self.pre_tokens(" " + word))))
        self.parts: dict[str, bytes] = {}

    def encode_part(self, part: str) -> bytes:
        """Ids of one pre-token."""
        ids = self.parts.get(part)
        if ids is None:
            if len(self.parts) >= REMEMBERED // 4:
                self.parts.clear()
            spelled = part.encode().decode("latin-1").translate(self.letters)
            ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled))
            if len(part) <= 64:
                self.parts[part] = ids
        return ids

    def encode_text(self, text: str) -> bytes:
        """Ids as the file gives them: a text that holds an added token goes to its own tokenizer whole."""
        if any(t in text for t in self.added):
            return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        return self.encode(text)

    def encode(self, text: str) -> bytes:
        """Ids of the text's characters; added tokens are not looked for."""
        first, *rest = (self.cut if self.spaces(text) else str.split)(text, *(() if self.spaces(text) else (" ",)))
        return b"".join([*map(self.encode_part, self.pre_tokens(first)), *map(self.words.__getitem__, rest)])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which several tasks use in turn."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def decompose(n: int, size: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, then falling powers of two."""
    start = 0
    while n - start >= size:
        yield start, size
        start += size
    while start < n:
        length = 1 << ((n - start).bit_length() - 1)
        yield start, length
        start += length


def packer(path: str, size: int, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = tokenizer(path).encode_text, end_id.to_bytes(4, "little")
        task, counts, rows, held, kind = TaskContext.get().partitionId(), [0] * size.bit_length(), [], 0, None

        def batch() -> pa.RecordBatch:
            names = ("doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset")
            kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            kind = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start, length in decompose(n, size):
                    k = length.bit_length() - 1
                    number = ((k << TASK_BITS | task) << COUNT_BITS) + counts[k]
                    counts[k] += 1
                    rows.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n, k, number, 0))
                held += len(ids)
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: id, start, length, ids (little-endian uint32), doc_tokens, bucket, sequence_id, offset.

    size must be a power of two; bucket is the length's logarithm.
    """
    if size & (size - 1) or size < 1:
        raise ValueError("size must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"
    pieces = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(packer(tokenizer_path, size, end_id), schema)
    return pieces.withColumnRenamed("doc_id", id_col)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces so that a reader of one length reads that bucket alone."""
    pieces.write.partitionBy("bucket").parquet(path)
