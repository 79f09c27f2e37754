"""PCM WAV files as rows of samples, and back."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.dsp import resample
from cadenza.sources import wav


def decode(content: bytes, sr: int, mono: bool = True) -> np.ndarray:
    """Samples from -1 to 1, the mean of the channels (or the first), at a rate of sr."""
    h = wav.header(io.BytesIO(content), len(content))
    x = wav.samples(content[h.at : h.at + h.n * h.frame], h)
    return resample(x.mean(axis=1) if mono else x[:, 0], h.sr, sr).astype(np.float32)


def decoded(files: DataFrame, sr: int = 16000, mono: bool = True, content: str = "content") -> DataFrame:
    """files with y, their samples, and sr, in place of their bytes."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda c: None if c is None else decode(bytes(c), sr, mono))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return files.withColumns({"y": F.pandas_udf(run, "array<float>")(content), "sr": F.lit(sr)}).drop(content)


def read_wav(spark: SparkSession, path: str, sr: int = 16000, mono: bool = True) -> DataFrame:
    """(filepath, y, sr) of all files below a path or glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return decoded(files.select(F.col("path").alias("filepath"), "content"), sr, mono)


def read_clips(spark: SparkSession, manifest: DataFrame, root: str, sr: int = 16000) -> DataFrame:
    """The manifest's rows with their samples; a file that is missing leaves y null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(root)
    files = files.select(F.col("path").alias("found"), "content")
    name = F.regexp_replace("filepath", r"^(\./)+", "")
    joined = manifest.withColumn("__end", F.concat(F.lit(root.rstrip("/") + "/"), name))
    tail = F.regexp_replace("found", r"^[a-z]+:/+", "/")
    want = F.regexp_replace("__end", r"^[a-z]+:/+", "/")
    return decoded(joined.join(files, want == tail, "left").drop("__end", "found"), sr)


def encoded(clips: DataFrame, sr: int = 16000, samples: str = "y") -> DataFrame:
    """clips with content, the bytes of a WAV file, in place of their samples."""

    def run(y: pd.Series) -> pd.Series:
        return y.map(lambda v: None if v is None else wav.encoded(np.asarray(v, float), sr))

    return clips.withColumn("content", F.pandas_udf(run, "binary")(samples)).drop(samples)


def write_wav(clips: DataFrame, folder: str, sr: int = 16000, name: str = "name", samples: str = "y") -> None:
    """One file for each row, below a folder that all executors share; files of the same names are replaced."""
    wav.register(clips.sparkSession)
    rows = clips.select(F.col(name).alias("name"), F.col(samples).alias("y"), F.lit(sr).alias("sr"))
    rows.write.format("wav").mode("append").option("replace", "true").save(folder)
