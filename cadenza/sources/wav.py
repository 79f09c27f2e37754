"""WAV files as a Spark data source: spark.read.format("wav") and df.write.format("wav").

    register(spark)
    spark.read.format("wav").option("chunk", 1 << 16).load(folder).where("sr = 16000 and n > 8000")
    clips.write.format("wav").option("width", 24).mode("append").save(folder)

Reading. A row is a clip or, with `chunk`, so many frames of one: filepath, sr, channels, width (bits),
n (frames of the clip), start (of the chunk) and y, samples from -1 to 1. The driver lists files with
their sizes; it packs small ones into partitions of `split_bytes` and reads the headers only of larger ones, to
cut these into ranges of whole chunks, so one file of hours is read by many tasks and none of them holds it whole.
A .schema() may leave columns out, or ask for y in doubles or as an array of channels; samples are read only
if y is asked for, and conditions on the other columns are pushed down to the headers. y is otherwise the mean of the
channels, or the first with the option `mono` false. Values of a chunk hold no neighbours' samples; see operators.chunks.

Writing. Rows are name (a path below the folder), y, and sr or the option `sr`; y is one channel or an array of
channels. Each attempt of a task writes below a hidden folder; the commit moves what successful ones wrote, and
the abort takes all of it away (but for what a task that is killed later still writes there; reading passes
over hidden folders). A name that is there already fails the write, which undoes its moves, unless
the option `replace` is set; mode "overwrite" first removes the folder's WAV files.

Files are opened by pyarrow's file systems, so on whatever these know (local, HDFS, S3 and so on).

Defined results: an empty clip is a row with n = 0 and an empty y; a null y is written as an empty clip; a
null name, an absolute one or one with `..` is an error; a file that can't be read is an error, or with
mode "PERMISSIVE" a row of nulls besides its path; an empty folder gives no rows.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import ArrayType, StructType

SCHEMA = "filepath string, sr int, channels int, width int, n long, start long, y array<float>"
#: Bytes of samples of a batch that a task returns, about.
BATCH_BYTES = 4_000_000
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


@dataclass(frozen=True)
class Header:
    sr: int
    channels: int
    width: int  # bits of a sample
    floating: bool
    at: int  # place of the first sample
    n: int  # frames

    @property
    def frame(self) -> int:
        return self.channels * self.width // 8


def header(f: BinaryIO, size: int) -> Header:
    """Walks the chunks of a RIFF file up to its samples; a size that the file does not have is cut to what is there."""
    if (first := f.read(12))[:4] != b"RIFF" or first[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    about, at = None, 12
    while len(head := f.read(8)) == 8:
        kind, length = struct.unpack("<4sI", head)
        at += 8
        if kind == b"data":
            if about is None:
                raise ValueError("samples before their format")
            tag, channels, sr, width = about
            if tag not in (PCM, FLOAT) or not channels or width not in ((32, 64) if tag == FLOAT else (8, 16, 24, 32)):
                raise ValueError(f"samples of kind {tag} with {width} bits and {channels} channels")
            return Header(sr, channels, width, tag == FLOAT, at, min(length, size - at) // (channels * width // 8))
        if kind == b"fmt ":
            tag, channels, sr, _, _, width = struct.unpack("<HHIIHH", (body := f.read(length))[:16])
            about = (struct.unpack("<H", body[24:26])[0] if tag == EXTENSIBLE else tag), channels, sr, width
        at += length + length % 2
        f.seek(at)
    raise ValueError("no samples")


def samples(raw: bytes, h: Header) -> np.ndarray:
    """Frames by channels, from -1 to 1."""
    if h.floating:
        x = np.frombuffer(raw, f"<f{h.width // 8}").astype(float)
    elif h.width == 8:
        x = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    elif h.width == 24:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((parts[:, 2] << 24 | parts[:, 1] << 16 | parts[:, 0] << 8) >> 8) / 2.0**23
    else:
        x = np.frombuffer(raw, f"<i{h.width // 8}") / 2.0 ** (h.width - 1)
    return x.reshape(-1, h.channels)


def encoded(y: np.ndarray, sr: int, width: int = 16) -> bytes:
    """A PCM file of frames by channels (or one channel); samples beyond -1 and 1 are cut."""
    y = y[:, None] if y.ndim == 1 else y
    whole = np.rint(np.clip(y, -1, 1) * (2.0 ** (width - 1) - 1)).astype(np.int64)
    if width == 8:
        raw = (whole + 128).astype(np.uint8).tobytes()
    elif width == 24:
        raw = whole.astype("<i4").tobytes()
        raw = np.frombuffer(raw, np.uint8).reshape(-1, 4)[:, :3].tobytes()
    elif width in (16, 32):
        raw = whole.astype(f"<i{width // 8}").tobytes()
    else:
        raise ValueError(f"samples of {width} bits")
    channels, frame = y.shape[1], y.shape[1] * width // 8
    about = struct.pack("<4sIHHIIHH", b"fmt ", 16, PCM, channels, sr, sr * frame, frame, width)
    return struct.pack("<4sI4s", b"RIFF", 28 + len(about) - 16 + len(raw) + len(raw) % 2, b"WAVE") + about + struct.pack("<4sI", b"data", len(raw)) + raw + b"\0" * (len(raw) % 2)


def place(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path on it, what to put before such paths to name them in full)."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), posixpath.abspath(path), ""
    files, inner = pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return files, inner, path[: len(path.rstrip("/")) - len(inner.rstrip("/"))] if path.rstrip("/").endswith(inner.rstrip("/")) else ""


#: Conditions that headers can answer, by what they are called in a plan.
ANSWERED = {
    ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b, ds.StringStartsWith: lambda a, b: a.startswith(b), ds.StringEndsWith: lambda a, b: a.endswith(b),
}


class WavPartition(ds.InputPartition):
    """Files with their sizes; of each the frames from first up to last (None: all)."""

    def __init__(self, parts: list[tuple[str, int, int, int | None]]) -> None:
        self.parts = parts


class WavReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.names = schema.fieldNames()
        self.types = schema
        self.path, self.mode = options["path"], options.get("mode", "FAILFAST").upper()
        self.chunk, self.split = int(options.get("chunk", 0)), int(options.get("split_bytes", 64 << 20))
        self.mono = options.get("mono", "true").lower() == "true"
        self.conditions: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in ANSWERED and column in ("filepath", "sr", "channels", "width", "n") and f.value is not None:
                self.conditions.append((column, type(f), f.value))
            else:
                yield f

    def answers(self, **known: object) -> bool:
        return all(ANSWERED[kind](known[c], value) for c, kind, value in self.conditions if c in known)

    def listed(self) -> list[tuple[str, int]]:
        """(path in full, size) of the files below the folder, or that the glob names, in order."""
        parts = self.path.split("/")
        wild = next((k for k, p in enumerate(parts) if any(c in p for c in "*?[")), len(parts))
        files, base, before = place("/".join(parts[:wild]) or "/")
        about = files.get_file_info(base)
        if about.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [about] if about.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(base, recursive=True))
        pattern = "/".join([base.rstrip("/"), *parts[wild:]])
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(base) :].split("/"))
        wanted = lambda f: f.type == pafs.FileType.File and not hidden(f.path) and f.path.lower().endswith(".wav") and (wild == len(parts) or fnmatch.fnmatch(f.path, pattern))
        return sorted((before + f.path, f.size) for f in found if wanted(f))

    def partitions(self) -> list[WavPartition]:
        out: list[WavPartition] = []
        some: list[tuple[str, int, int, int | None]] = []
        held = 0
        files = [f for f in self.listed() if self.answers(filepath=f[0])]
        large = [f for f in files if self.chunk and "y" in self.names and f[1] > self.split]
        with ThreadPoolExecutor(16) as pool:
            headers = dict(zip(large, pool.map(self.header_of, large), strict=True))
        for path, size in files:
            if (h := headers.get((path, size))) is not None:
                step = max(1, self.split // h.frame // self.chunk) * self.chunk
                out += [WavPartition([(path, size, first, min(first + step, h.n))]) for first in range(0, h.n, step)]
                continue
            if some and held + size > self.split:
                out.append(WavPartition(some))
                some, held = [], 0
            some.append((path, size, 0, None))
            held += size
        return [*out, WavPartition(some)] if some else out or [WavPartition([])]

    def header_of(self, file: tuple[str, int]) -> Header | None:
        files, inner, _ = place(file[0])
        try:
            with files.open_input_file(inner) as f:
                return header(f, file[1])
        except (ValueError, struct.error):
            return None  # the task that reads it says so

    def read(self, partition: WavPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, held = to_arrow_schema(self.types), [], 0
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], schema.field(c).type) for c in self.names], schema=schema)
        for path, size, first, last in partition.parts:
            for row in self.rows_of(path, size, first, last):
                rows.append(row)
                held += 100 + 4 * row.get("size", 0)
                if held > BATCH_BYTES:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)

    def rows_of(self, path: str, size: int, first: int, last: int | None) -> Iterator[dict]:
        files, inner, _ = place(path)
        with files.open_input_file(inner) as f:
            try:
                h = header(f, size)
            except (ValueError, struct.error) as e:
                if self.mode != "PERMISSIVE":
                    raise ValueError(f"{path}: {e}") from e
                if not self.conditions:  # a null meets no condition
                    yield {"filepath": path}
                return
            about = {"filepath": path, "sr": h.sr, "channels": h.channels, "width": h.width, "n": h.n}
            if not self.answers(**about):
                return
            last = h.n if last is None else last
            step = self.chunk or max(1, last)
            for start in range(first, max(last, first + 1), step):
                row = about | {"start": start}
                if "y" in self.names:
                    f.seek(h.at + start * h.frame)
                    n = min(step, last - start)
                    x = samples(f.read(n * h.frame), h)
                    y = x.T if isinstance(self.types["y"].dataType.elementType, ArrayType) else x.mean(axis=1) if self.mono else x[:, 0]
                    row |= {"y": list(y) if y.ndim > 1 else y, "size": x.size}
                yield row


@dataclass
class Written(ds.WriterCommitMessage):
    folder: str
    names: list[str]


class WavWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.sr, self.width = options["path"], options.get("sr"), int(options.get("width", 16))
        self.columns, self.overwrite = set(schema.fieldNames()), overwrite
        self.replace = options.get("replace", "false").lower() == "true"
        self.job = f"_temporary-{uuid.uuid4().hex}"
        if not {"name", "y"} <= self.columns or ("sr" not in self.columns and not self.sr):
            raise ValueError("rows need name, y, and sr or the option sr")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base, _ = place(self.path)
        folder, names = f"{base.rstrip('/')}/{self.job}/{uuid.uuid4().hex}", []  # an attempt's own
        for b in iterator:
            column = lambda c, b=b: b.column(b.schema.get_field_index(c))
            for k, name in enumerate(column("name").to_pylist()):
                if not name or name.startswith("/") or ".." in name.split("/"):
                    raise ValueError(f"not the name of a file below the folder: {name}")
                y = column("y")[k]
                value = lambda c, other: other if c not in self.columns else column(c)[k].as_py()  # noqa: B023, E731
                sr, width = value("sr", self.sr), value("width", self.width)
                nested = pa.types.is_nested(y.type.value_type)
                parts = [] if not y.is_valid else [c.values.to_numpy(zero_copy_only=False) for c in y.values] if nested else [y.values.to_numpy(zero_copy_only=False)]
                sound = np.stack(parts, axis=1).astype(float) if parts else np.zeros((0, 1))
                target = f"{folder}/{name}"
                files.create_dir(posixpath.dirname(target), recursive=True)
                with files.open_output_stream(target) as f:
                    f.write(encoded(sound, int(sr), int(width or self.width)))
                names.append(name)
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        files, base, _ = place(self.path)
        base, moved = base.rstrip("/"), []
        files.create_dir(base, recursive=True)
        try:
            if self.overwrite:
                for f in files.get_file_info(pafs.FileSelector(base, recursive=True)):
                    if f.type == pafs.FileType.File and f.path.lower().endswith(".wav") and f"/{self.job}/" not in f.path:
                        files.delete_file(f.path)
            for m in filter(None, messages):
                for name in m.names:
                    target = f"{base}/{name}"
                    if not self.replace and files.get_file_info(target).type != pafs.FileType.NotFound:
                        raise FileExistsError(f"{target}: this name is there already, or twice in the rows")
                    files.create_dir(posixpath.dirname(target), recursive=True)
                    files.move(f"{m.folder}/{name}", target)
                    moved.append(target)
        except Exception:
            for target in moved if not self.replace else []:
                files.delete_file(target)
            raise
        finally:
            self.clean(files, base)

    def abort(self, messages: list[Written | None]) -> None:
        files, base, _ = place(self.path)
        self.clean(files, base.rstrip("/"))

    def clean(self, files: pafs.FileSystem, base: str) -> None:
        if files.get_file_info(f"{base}/{self.job}").type == pafs.FileType.Directory:
            files.delete_dir(f"{base}/{self.job}")


class WavSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WavReader:
        if not set(schema.fieldNames()) <= {"filepath", "sr", "channels", "width", "n", "start", "y"}:
            raise ValueError(f"columns are {SCHEMA}")
        return WavReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WavSource)
