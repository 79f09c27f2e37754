"""Quality scores by a byte-level convolutional network in numpy.

Each byte is a few learned numbers. Learned filters of eight bytes move over the text two bytes at a
time; a chunk is 128 places of the filters, and neighbouring chunks overlap by half, so the chunks
cover the whole document and whatever stands on one's border is inside another. Filters are
max-pooled in each chunk; the mean, the greatest and the least over the chunks are combined into one
probability. A text is taken in blocks of places, for scores and for gradients, so beyond its own bytes
it costs memory by its chunks (about one byte a byte), however long it is.

The network is fitted on a bounded sample of labelled rows: of those documents that have a label,
SAMPLE_ROWS of each label at most, chosen by a hash of the id, and the whole texts of these. They are
learned from in tasks: up to SHARDS shards, dealt by a hash of the id, each walk their rows from the common weights, and
the mean of the shards' weights begins the next epoch. Texts are streamed through the tasks and never meet
on the driver. The result depends on neither partitions nor retries. Then every whole text is scored.

Defined results: a null text is an empty one, and an empty text has a score like any other (of the
padding alone); rows with a null label or id are not learned from; of documents that repeat an id one is
learned from, that of the least text hash; repeated rows have equal scores; if a label has no rows, every score
is the share of label 1 among those there are (0.5 without any); tables may be empty and have any further columns.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import fold, remove, scratch, stage

#: Bound of the sample that the network is fitted on: rows of each label.
SAMPLE_ROWS = 1200
FILTERS, WIDTH, STRIDE, CHUNK, DIMS = 32, 8, 2, 128, 4
EPOCHS, BATCH, RATE = 8, 8, 0.015
#: Shards at most, and rows that a shard has at least, about: a walk of few steps learns little before it is averaged.
SHARDS, SHARD_ROWS = 8, 300
#: Places of the filters that are computed at once.
BLOCK = CHUNK * 512
#: The parts of a network that are learned.
PARTS = ("embedding", "filters", "bias", "out", "out_bias")


@dataclass
class Network:
    embedding: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDTH * DIMS x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 3 * FILTERS
    out_bias: np.ndarray  # 1

    @classmethod
    def new(cls, rng: np.random.Generator) -> Network:
        f32 = lambda *s: rng.normal(size=s).astype(np.float32)
        return cls(f32(256, DIMS) * 0.5, f32(WIDTH * DIMS, FILTERS) * 0.3, np.zeros(FILTERS, np.float32), f32(3 * FILTERS) * 0.1, np.zeros(1, np.float32))

    def pool(self, b: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Chunks x filters: greatest activation of each filter in each chunk, and its place if asked."""
        n, half, best, off = (len(b) - WIDTH) // STRIDE + 1, CHUNK // 2, [], []
        for i in range(0, n, BLOCK):
            m = min(BLOCK, n - i)
            x = np.ascontiguousarray(self.embedding[b[i * STRIDE : (i + m - 1) * STRIDE + WIDTH]])
            y = np.lib.stride_tricks.as_strided(x, (m, WIDTH * DIMS), (STRIDE * DIMS * x.itemsize, x.itemsize)) @ self.filters
            # by half chunks, of which two neighbours are a chunk
            cuts = np.arange(0, m, half)
            best.append(np.maximum.reduceat(y, cuts, axis=0))
            if places:
                filled = np.full((len(cuts) * half, FILTERS), -np.inf, y.dtype)
                filled[:m] = y
                off.append(filled.reshape(len(cuts), half, FILTERS).argmax(axis=1).astype(np.uint8))
        best, at = np.concatenate(best), np.concatenate(off) if places else None
        if len(best) > 1:
            later = best[1:] > best[:-1]
            at = np.where(later, at[1:] + half, at[:-1]).astype(np.uint8) if places else None
            best = np.maximum(best[:-1], best[1:])
        return np.maximum(best + self.bias, 0), at

    def combine(self, pooled: np.ndarray) -> np.ndarray:
        return np.concatenate([pooled.mean(axis=0), pooled.max(axis=0), pooled.min(axis=0)])

    def odds(self, features: np.ndarray) -> float:
        z = float(features @ self.out) + float(self.out_bias[0])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def score(self, text: bytes) -> float:
        return self.odds(self.combine(self.pool(padded(text))[0]))

    def gradients(self, text: bytes, label: int, sums: dict[str, np.ndarray], weight: float = 1.0) -> None:
        """Add the gradient of one text's weighted cross-entropy to sums."""
        b = padded(text)
        pooled, at = self.pool(b, places=True)
        features = self.combine(pooled)
        d = weight * (self.odds(features) - label)
        sums["out"] += d * features
        sums["out_bias"] += d
        mean, most, least = (d * self.out).reshape(3, FILTERS)
        up = np.repeat(mean[None] / len(pooled), len(pooled), axis=0)
        f = np.arange(FILTERS)
        up[pooled.argmax(axis=0), f] += most
        up[pooled.argmin(axis=0), f] += least
        up *= pooled > 0
        sums["bias"] += up.sum(axis=0)
        for i in range(0, len(up), 512):
            some = up[i : i + 512]
            place = at[i : i + 512].astype(np.int64) + (i + np.arange(len(some)))[:, None] * (CHUNK // 2)
            rows = b[place[:, :, None] * STRIDE + np.arange(WIDTH)]  # chunks x filters x WIDTH
            sums["filters"] += np.einsum("cfk,cf->kf", self.embedding[rows].reshape(len(some), FILTERS, -1), some)
            back = (some[:, :, None] * self.filters.T[None]).reshape(-1, DIMS)
            for k, column in enumerate(back.T):
                sums["embedding"][:, k] += np.bincount(rows.ravel(), column, 256)


def padded(text: bytes) -> np.ndarray:
    """The bytes, with zero bytes up to a filter's width at least and to whole strides."""
    b = np.zeros(max(WIDTH, len(text) + len(text) % STRIDE), np.uint8)
    b[: len(text)] = np.frombuffer(text, np.uint8)
    return b


@dataclass
class Learner:
    """A network and Adam's moments; flat() and of() turn it into one list of numbers and back."""

    net: Network
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    steps: int = 0

    @classmethod
    def new(cls, seed: int = 0) -> Learner:
        net = Network.new(np.random.default_rng(seed))
        none = lambda: {k: np.zeros_like(getattr(net, k)) for k in PARTS}
        return cls(net, none(), none())

    def flat(self) -> np.ndarray:
        return np.concatenate([np.ravel(x) for k in PARTS for x in (getattr(self.net, k), self.first[k], self.second[k])])

    def of(self, flat: np.ndarray, steps: int) -> Learner:
        parts, at = {}, 0
        for k in PARTS:
            like = getattr(self.net, k)
            parts[k] = [flat[at + i * like.size : at + (i + 1) * like.size].reshape(like.shape).astype(np.float32) for i in range(3)]
            at += 3 * like.size
        return Learner(Network(*(parts[k][0] for k in PARTS)), {k: parts[k][1] for k in PARTS}, {k: parts[k][2] for k in PARTS}, steps)

    def step(self, sums: dict[str, np.ndarray], n: int, rate: float) -> None:
        self.steps += 1
        for k in PARTS:
            now = getattr(self.net, k)
            g = sums[k] / n + (1e-4 * now if k in ("out", "filters") else 0)
            self.first[k] = 0.9 * self.first[k] + 0.1 * g
            self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
            move = rate * (self.first[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[k] / (1 - 0.999**self.steps)) + 1e-8)
            setattr(self.net, k, (now - move).astype(np.float32))

    def walk(self, rows: Iterable[tuple[bytes, int, float]], rate: float) -> int:
        """Mini-batches over (text, label, weight) in their order; how many rows there were."""
        none, n = lambda: {k: np.zeros(getattr(self.net, k).shape) for k in PARTS}, 0
        sums = none()
        for n, (text, label, weight) in enumerate(rows, 1):
            self.net.gradients(text, label, sums, weight)
            if n % BATCH == 0:
                self.step(sums, BATCH, rate)
                sums = none()
        if n % BATCH:
            self.step(sums, n % BATCH, rate)
        return n


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, label, text): at most SAMPLE_ROWS labelled documents of each label, from the rows that may be learned from."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1) and id is not null")
    marks = marks.where(fold(F.col("id")) != 0).distinct()
    # ids alone move here, each once
    there = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    marks = marks.join(there, "id", "left_semi")
    chosen = [marks.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS) for k in (0, 1)]
    # at most SAMPLE_ROWS ids of each label: a bound that does not grow with the data
    wanted = F.broadcast(chosen[0].unionByName(chosen[1]).withColumnRenamed("id", "l_id"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(wanted, F.col("id") == F.col("l_id"))
    return rows.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def epoch(rows: DataFrame, state: Learner, number: int, weights: dict[int, float], rate: float) -> Learner:
    """The mean of what each shard's walk over its rows makes of the common state."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, steps = state.flat(), state.steps
        source = ((s.as_py(), t.as_py().encode(), k.as_py()) for b in batches for s, t, k in zip(b.column(0), b.column(1), b.column(2), strict=True))
        held = next(source, None)
        while held is not None:
            shard, own = held[0], state.of(flat, steps)

            def of_shard() -> Iterator[tuple[bytes, int, float]]:
                nonlocal held
                while held is not None and held[0] == shard:
                    yield held[1], held[2], weights[held[2]]
                    held = next(source, None)

            n = own.walk(of_shard(), rate)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n]), pa.array([own.steps]), pa.array([own.flat().astype(np.float64)])], ["shard", "n", "steps", "flat"])

    dealt = rows.repartitionById(SHARDS, F.col("shard")).sortWithinPartitions("shard", F.xxhash64("id", F.lit(number)), "id", "label")
    # a row of a few thousand numbers from each shard
    done = sorted(dealt.select("shard", "text", "label").mapInArrow(run, "shard int, n long, steps long, flat array<double>").collect())
    total = sum(r["n"] for r in done)
    return state.of(sum(np.array(r["flat"]) * (r["n"] / total) for r in done), max(r["steps"] for r in done))


def fit(rows: DataFrame, counts: dict[int, int], seed: int = 0) -> Network:
    """Adam on cross-entropy; rows: id, label, text; counts: rows of each label, which weigh the same altogether."""
    total = sum(counts.values())
    weights = {k: total / 2 / n for k, n in counts.items()}
    shards = max(1, min(SHARDS, total // SHARD_ROWS))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(-1)), F.lit(shards)).cast("int"))
    state = Learner.new(seed)
    for k in range(EPOCHS):
        state = epoch(rows, state, k, weights, RATE * (1 - k / EPOCHS))
    return state.net


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", out: str = "score"
) -> DataFrame:
    """docs with out, the probability of label 1; a column of that name is replaced."""
    spark = docs.sparkSession
    rows = stage(sample(docs, labels, id_col, text_col, label_col), path := scratch(spark, "quality"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        remove(spark, path)
        return docs.withColumn(out, F.lit(float(next(iter(counts), 0.5))))
    # a few thousand weights
    net = spark.sparkContext.broadcast(fit(rows, counts))
    remove(spark, path)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([net.value.score((t.as_py() or "").encode()) for t in texts], pa.float64())

    return docs.withColumn(out, run(F.col(text_col)))
