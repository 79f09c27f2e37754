"""The library's queries over the sample tables, and the SQL that they are held against.

Signals: E is events by user (short clips), L lineitem by supplier (longer ones), V the vectors of
embeddings, as rows of one label in order of vec_id. Results are rounded to six places, as sums
differ in the last bits from engine to engine.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cadenza.functions import arrays, dsp
from cadenza.operators import activity, batching, chunks, framing, labels, mergeable, metrics, scans, series, spectral
from cadenza.operators.sequence_model import Shape
from cadenza.plans.features import feature_table, lpcc_of
from cadenza.plans.predict import predict, report_lines
from cadenza.plans.train import evaluate, steps_together
from cadenza.session import ROCKSDB, materialised, shared_folder
from cadenza.sources import audio, checkpoint, manifest, wav
from cadenza.sources.config import from_dict, load_config
from cadenza.streaming.activity import idle_segments, read_frames, streamed_segments

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, ints: str = ""):
    """Register a query; ints names the columns of its SQL that are 32-bit integers here."""
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ints.split())

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return f

    return add


# ------------------------------------------------------------------ signals

#: Frame and hop of each signal.
FRAME_E, HOP_E, FRAME_L, HOP_L = 16, 4, 64, 16
LIMITS_E = activity.Thresholds(1.5, 0.8, 0.63, 0.42)
LIMITS_L = activity.Thresholds(1.15, 0.8, 0.58, 0.45)
EVENT_TYPES = ["view", "click", "signup", "purchase", "error"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signal_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.signal_from(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], (F.col("value") - 50) / 50)


def signal_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
    return framing.signal_from(table(spark, sf_dir, "lineitem"), "l_suppkey", order, (F.col("l_extendedprice") - 50000) / 30000)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, v)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", arrays.doubles(F.col("embedding")).alias("v"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, f, k, c): the vectors of a label are its frames."""
    rows = vectors(spark, sf_dir).withColumn("f", F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1)
    return rows.select(F.col("label").alias("clip_id"), "f", F.posexplode("v").alias("k", "c"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", "label", F.col("v").alias("z"))


def frames_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.frame_signal(signal_e(spark, sf_dir), FRAME_E, HOP_E)


def bins_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.polar(spectral.dft(spectral.window_frames(frames_e(spark, sf_dir), FRAME_E), FRAME_E))


def r6(c: Column | str) -> Column:
    """Rounded, without a negative zero."""
    c = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def s6(x: str) -> str:
    return f"(CASE WHEN round({x}, 6) = 0 THEN 0.0 ELSE round({x}, 6) END)"


SIG_E = """sig AS (
  SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (value - 50) / 50 AS x,
    count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
SIG_L = """sig AS (
  SELECT l_suppkey AS clip_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) - 1 AS i,
    (l_extendedprice - 50000) / 30000 AS x, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem)"""


def sql_frames(length: int, hop: int) -> str:
    """Frames by range join, for clips of one frame at least."""
    return f"""nf AS (
  SELECT clip_id, n, unnest(range(0, CAST((n - {length}) // {hop} + 1 AS BIGINT))) AS f FROM (SELECT DISTINCT clip_id, n FROM sig)),
fr AS (
  SELECT nf.clip_id, nf.n, nf.f, s.i - nf.f * {hop} AS j, s.x
  FROM nf JOIN sig s ON s.clip_id = nf.clip_id AND s.i >= nf.f * {hop} AND s.i < nf.f * {hop} + {length})"""


def sql_stats(length: int) -> str:
    return f"""st AS (
  SELECT clip_id, n, f, sum(x * x) / {length} AS ste, count(*) FILTER (WHERE p < 0) / {length - 1}.0 AS zcr
  FROM (SELECT *, x * lag(x) OVER (PARTITION BY clip_id, f ORDER BY j) AS p FROM fr) GROUP BY clip_id, n, f)"""


def sql_latch(t: activity.Thresholds) -> str:
    return f"""la AS (
  SELECT *, coalesce(last_value(CASE WHEN ste > {t.energy_hi} OR zcr > {t.zcr_hi} THEN true WHEN ste < {t.energy_lo} AND zcr < {t.zcr_lo} THEN false END IGNORE NULLS)
    OVER (PARTITION BY clip_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS voiced FROM st)"""


def sql_segments(length: int, hop: int) -> str:
    return f"""SELECT clip_id, CAST(min(f) * {hop} AS INTEGER) AS seg_start, CAST(least(max(n), (max(f) + 1) * {hop} + {length}) AS INTEGER) AS seg_end
FROM (SELECT *, f - row_number() OVER (PARTITION BY clip_id ORDER BY f) AS run FROM la WHERE voiced) GROUP BY clip_id, run"""


FR_E = f"WITH {SIG_E},\n{sql_frames(FRAME_E, HOP_E)}"
ST_E = f"{FR_E},\n{sql_stats(FRAME_E)}"
VAD_E = f"{ST_E},\n{sql_latch(LIMITS_E)}\n{sql_segments(FRAME_E, HOP_E)}"
VAD_L = f"WITH {SIG_L},\n{sql_frames(FRAME_L, HOP_L)},\n{sql_stats(FRAME_L)},\n{sql_latch(LIMITS_L)}\n{sql_segments(FRAME_L, HOP_L)}"
MAT = """m AS (
  SELECT label AS clip_id, f, k - 1 AS k, CAST(embedding[k] AS DOUBLE) AS c
  FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"""
DFT_E = f"""{FR_E},
ks AS (SELECT unnest(range(0, {FRAME_E // 2 + 1})) AS k),
b AS (
  SELECT clip_id, n, f, k, sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {FRAME_E})) * cos(2 * pi() * k * j / {FRAME_E})) AS re,
    -sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {FRAME_E})) * sin(2 * pi() * k * j / {FRAME_E})) AS im FROM fr, ks GROUP BY clip_id, n, f, k),
p AS (SELECT *, sqrt(re * re + im * im) AS mag FROM b)"""

# ------------------------------------------------------------------ framing and activity


@query(f"{FR_E} SELECT clip_id, f, j, {s6('x')} AS x FROM fr", ints="f j")
def frame_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_e(spark, sf_dir).select("clip_id", "f", "j", r6("x").alias("x"))


@query(f"{ST_E} SELECT clip_id, f, {s6('ste')} AS ste FROM st", ints="f")
def short_time_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.frame_statistics(signal_e(spark, sf_dir), FRAME_E, HOP_E).select("clip_id", "f", r6("ste").alias("ste"))


@query(f"{ST_E} SELECT clip_id, f, {s6('zcr')} AS zcr FROM st", ints="f")
def zero_crossing_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.frame_statistics(signal_e(spark, sf_dir), FRAME_E, HOP_E).select("clip_id", "f", r6("zcr").alias("zcr"))


@query(f"{ST_E},\n{sql_latch(LIMITS_E)} SELECT clip_id, f, voiced FROM la", ints="f")
def hysteresis_latch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.latch(activity.frame_statistics(signal_e(spark, sf_dir), FRAME_E, HOP_E), LIMITS_E).select("clip_id", "f", "voiced")


@query(VAD_E)
def vad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.detect(signal_e(spark, sf_dir), FRAME_E, HOP_E, LIMITS_E)


@query(VAD_L)
def vad_segments_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.detect(signal_l(spark, sf_dir), FRAME_L, HOP_L, LIMITS_L)


@query(
    f"""WITH s AS ({VAD_L}),
o AS (SELECT *, max(seg_end) OVER (PARTITION BY clip_id ORDER BY seg_start, seg_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR seg_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY seg_start, seg_end) AS grp FROM o)
SELECT clip_id, min(seg_start) AS seg_start, max(seg_end) AS seg_end FROM g GROUP BY clip_id, grp"""
)
def vad_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.detect(signal_l(spark, sf_dir), FRAME_L, HOP_L, LIMITS_L, merge=True)


def feed_files(spark: SparkSession, feed: str) -> int:
    """Files of half a feed: batches are two or so at any size, as each costs a turn of all state partitions."""
    return max(1, len(spark.read.parquet(feed).inputFiles()) // 2)


@query(VAD_E)
def vad_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same segments from a stream in which frames come out of order."""
    stats = materialised(activity.frame_statistics(signal_e(spark, sf_dir), FRAME_E, HOP_E), "frames")
    feed, out = shared_folder(spark, "feed"), shared_folder(spark, "segments")
    for part in (stats.where("f % 2 = 1"), stats.where("f % 2 = 0")):
        part.write.mode("append").parquet(feed)
    stream = read_frames(stats, feed, feed_files(spark, feed))
    found = streamed_segments(stream, FRAME_E, HOP_E, LIMITS_E)
    write = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    write.awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query(VAD_E.replace(f"least(max(n), (max(f) + 1) * {HOP_E} + {FRAME_E})", f"(max(f) + 1) * {HOP_E} + {FRAME_E}"))
def vad_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but for the clip's end, from a stream that does not tell how long clips are: timers close idle ones."""
    stats = activity.frame_statistics(signal_e(spark, sf_dir), FRAME_E, HOP_E)
    rows = materialised(stats.select("clip_id", F.lit(None).cast("int").alias("n"), F.col("f").cast("int").alias("f"), "ste", "zcr", F.timestamp_seconds(F.col("f") + 100_000).alias("at")), "frames")
    feed, out = shared_folder(spark, "feed"), shared_folder(spark, "segments")
    # a frame of no clip, much later, lets the time of the others pass
    later = spark.sql("SELECT CAST(-1 AS BIGINT) AS clip_id, CAST(NULL AS INT) AS n, CAST(NULL AS INT) AS f, 0.0D AS ste, 0.0D AS zcr, timestamp_seconds(1000000) AS at")
    for part in (rows.where("f % 2 = 1"), rows.where("f % 2 = 0"), later):
        part.write.mode("append").parquet(feed)
    found = idle_segments(read_frames(rows, feed, feed_files(spark, feed)), FRAME_E, HOP_E, LIMITS_E, "20 minutes", "15 minutes")
    before = spark.conf.get(provider := "spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(provider, ROCKSDB)
    try:
        write = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
        write.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(found.schema).parquet(out)


@query("""SELECT vec_id, f, j, CASE WHEN j < 10 THEN CAST(embedding[j + 1] AS DOUBLE) ELSE 0.0 END AS x
FROM (SELECT vec_id, embedding, 0 AS f, unnest(range(0, 16)) AS j FROM embeddings)""", ints="j")
def frame_pad_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of ten samples are one frame of sixteen, padded."""
    framed = vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.frames_of(F.slice("v", 1, 10), 16, 4)).alias("f", "frame"))
    return framed.select("vec_id", "f", F.posexplode("frame").alias("j", "x"))


@query("""SELECT vec_id, f, j, CAST(embedding[f * 8 + j + 1] AS DOUBLE) AS x
FROM (SELECT vec_id, embedding, f, unnest(range(0, 24)) AS j FROM (SELECT vec_id, embedding, unnest(range(0, 6)) AS f FROM embeddings))""", ints="f j")
def frame_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of signals that must be as long as one: no padding."""
    framed = vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.frames_of(F.col("v"), 24, 8, pad_short=False)).alias("f", "frame"))
    return framed.select("vec_id", "f", F.posexplode("frame").alias("j", "x"))


# ------------------------------------------------------------------ shapes and labels


@query("SELECT vec_id, k, CAST(embedding[k + 1] AS DOUBLE) AS c FROM (SELECT vec_id, embedding, unnest(range(0, 26)) AS k FROM embeddings)", ints="k")
def head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.head(F.col("v"), 26)).alias("k", "c"))


@query("""SELECT vec_id, size, p, CASE WHEN p < 64 THEN CAST(embedding[p + 1] AS DOUBLE) ELSE 0.0 END AS x
FROM (SELECT vec_id, embedding, size, unnest(range(0, size)) AS p FROM embeddings, (VALUES (40), (72)) AS t(size))""", ints="p")
def fix_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    cut = lambda n: v.select("vec_id", F.lit(n).alias("size"), F.posexplode(arrays.fix_length(F.col("v"), n)).alias("p", "x"))
    return cut(40).unionByName(cut(72))


@query("SELECT vec_id, p, CAST(embedding[p + 16] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(0, 33)) AS p FROM embeddings)", ints="p")
def center_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.center_crop(F.col("v"), 33)).alias("p", "x"))


@query("""SELECT vec_id, p, CAST(embedding[p + 1 + start] AS DOUBLE) AS x FROM (
  SELECT vec_id, embedding, CAST(('0x' || substr(md5('3407:2:' || vec_id), 1, 8)) AS BIGINT) % 33 AS start, unnest(range(0, 32)) AS p FROM embeddings)""", ints="p")
def random_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.random_crop(F.col("v"), 32, F.col("vec_id"), 3407, 2)).alias("p", "x"))


@query("SELECT vec_id, k, f, CAST(embedding[f * 8 + k + 1] AS DOUBLE) AS c FROM (SELECT vec_id, embedding, k, unnest(range(0, 8)) AS f FROM (SELECT vec_id, embedding, unnest(range(0, 8)) AS k FROM embeddings))", ints="f k")
def transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.transpose(arrays.frames_of(F.col("v"), 8, 8))).alias("k", "r"))
    return turned.select("vec_id", "k", F.posexplode("r").alias("f", "c"))


TYPES_SQL = ", ".join(f"'{t}'" for t in EVENT_TYPES)


@query(f"SELECT event_id, CAST(list_position([{TYPES_SQL}], event_type) - 1 AS INTEGER) AS label_id FROM events")
def label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.encode(table(spark, sf_dir, "events"), EVENT_TYPES, "event_type").select("event_id", "label_id")


@query(f"SELECT event_id, ([{TYPES_SQL}])[user_id % 5 + 1] AS label FROM events")
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 5).alias("label_id"))
    return labels.decode(rows, EVENT_TYPES).select("event_id", "label")


SHUFFLED = "SELECT event_id, row_number() OVER (ORDER BY md5('3407:1:' || event_id), event_id) - 1 AS place FROM events"


@query(f"SELECT event_id, CAST(place // 32 AS BIGINT) AS batch, CAST(place % 32 AS INTEGER) AS slot FROM ({SHUFFLED})")
def hash_shuffle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batches(table(spark, sf_dir, "events").select("event_id"), "event_id", 32, 3407, 1)


@query("SELECT event_id, CAST(place // 32 AS BIGINT) AS batch, CAST(place % 32 AS INTEGER) AS slot FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events)")
def sequential_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batches(table(spark, sf_dir, "events").select("event_id"), "event_id", 32, shuffle=False)


@query(f"SELECT event_id, CAST(place // 32 AS BIGINT) AS batch, CAST(place % 32 AS INTEGER) AS slot FROM ({SHUFFLED}) WHERE place // 32 < (SELECT count(*) // 32 FROM events)")
def drop_last_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.batches(table(spark, sf_dir, "events").select("event_id"), "event_id", 32, 3407, 1, drop_last=True)


@query(f"""SELECT batch, CAST(count(*) AS BIGINT) AS rows, CAST(sum(place % 32 * user_id) AS BIGINT) AS weighted
FROM (SELECT place // 32 AS batch, place, user_id FROM ({SHUFFLED}) s JOIN events USING (event_id)) GROUP BY batch""")
def collate_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = batching.batches(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 32, 3407, 1)
    whole = batching.collated(rows, "event_id", "user_id")
    weighted = F.aggregate("y", F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("s")), lambda a, v: F.struct((a["i"] + 1).alias("i"), (a["s"] + a["i"] * v).alias("s")))
    return whole.select("batch", F.size("x").cast("long").alias("rows"), weighted["s"].alias("weighted"))


@query(f"SELECT event_id, CAST(place // 512 AS BIGINT) AS batch, CAST(place % 512 AS INTEGER) AS slot FROM ({SHUFFLED})")
def batch_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that are stored so that each is read alone."""
    rows = batching.batches(table(spark, sf_dir, "events").select("event_id"), "event_id", 512, 3407, 1)
    batching.store(rows, path := shared_folder(spark, "batches"))
    return batching.stored(spark, path)


@query("SELECT count(*) AS n FROM events")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 1 OFFSET 41")
def row_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row by its place; the limit is the feature."""
    return manifest.row_at(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", 41)


# ------------------------------------------------------------------ spectra


def hann_sums(periodic: bool) -> str:
    below = FRAME_L if periodic else FRAME_L - 1
    x = f"sum(x * (0.5 - 0.5 * cos(2 * pi() * j / {below})))"
    return f"WITH {SIG_L},\n{sql_frames(FRAME_L, HOP_L)} SELECT clip_id, f, {s6(x)} AS s FROM fr GROUP BY clip_id, f"


def windowed_sums(spark: SparkSession, sf_dir: str, periodic: bool) -> DataFrame:
    frames = framing.frame_signal(signal_l(spark, sf_dir), FRAME_L, HOP_L)
    return spectral.window_frames(frames, FRAME_L, periodic).groupBy("clip_id", "f").agg(r6(F.sum("x")).alias("s"))


@query(hann_sums(False), ints="f")
def hann_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_sums(spark, sf_dir, False)


@query(hann_sums(True), ints="f")
def hann_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windowed_sums(spark, sf_dir, True)


@query(f"{DFT_E} SELECT clip_id, f, k, {s6('re')} AS re, {s6('im')} AS im, {s6('mag')} AS mag FROM p", ints="f k")
def dft_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase is left out where it is that of a rounding error; recombine has it."""
    return bins_e(spark, sf_dir).select("clip_id", "f", "k", r6("re").alias("re"), r6("im").alias("im"), r6("mag").alias("mag"))


@query(f"{DFT_E} SELECT clip_id, f, k, {s6('re')} AS re, {s6('im')} AS im FROM p", ints="f k")
def polar_recombine(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = spectral.cartesian(bins_e(spark, sf_dir).drop("re", "im"))
    return whole.select("clip_id", "f", "k", r6("re").alias("re"), r6("im").alias("im"))


@query(f"{DFT_E} SELECT clip_id, k, {s6('avg(mag)')} AS noise FROM p WHERE f < 3 GROUP BY clip_id, k", ints="k")
def noise_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.with_noise_profile(bins_e(spark, sf_dir), 3).where("f = 0").select("clip_id", "k", r6("noise").alias("noise"))


@query(f"{DFT_E} SELECT clip_id, f, k, {s6('greatest(mag - 0.8 * noise, 0.0)')} AS mag FROM (SELECT *, avg(mag) FILTER (WHERE f < 3) OVER (PARTITION BY clip_id, k) AS noise FROM p)", ints="f k")
def spectral_subtract_mag(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = spectral.subtract_noise(spectral.with_noise_profile(bins_e(spark, sf_dir), 3), 0.8)
    return quiet.select("clip_id", "f", "k", r6("mag").alias("mag"))


@query(f"""{FR_E}, w AS (SELECT clip_id, f * {HOP_E} + j AS i, x, 0.5 - 0.5 * cos(2 * pi() * j / {FRAME_E}) AS w FROM fr)
SELECT clip_id, i, CASE WHEN sum(w * w) > 1e-12 THEN {s6('sum(x * w * w) / sum(w * w)')} ELSE 0.0 END AS x FROM w GROUP BY clip_id, i""", ints="i")
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spectral.overlap_add(spectral.window_frames(frames_e(spark, sf_dir), FRAME_E), FRAME_E, HOP_E)
    return out.select("clip_id", "i", r6("x").alias("x"))


@query(f"{FR_E} SELECT clip_id, f, j, {s6(f'x * (0.5 - 0.5 * cos(2 * pi() * j / {FRAME_E}))')} AS x FROM fr", ints="f j")
def inverse_dft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform and its inverse give the windowed frames again."""
    return spectral.inverse_dft(bins_e(spark, sf_dir), FRAME_E).select("clip_id", "f", "j", r6("x").alias("x"))


BANDS = f"""{DFT_E}, tri AS (
  SELECT band, k, greatest(0.0, 1 - abs(k - (band + 1) * 1.6) / 1.6) AS w FROM (SELECT unnest(range(0, 4)) AS band) b, ks),
fb AS (SELECT clip_id, f, band, sum(w * mag * mag) AS v FROM p JOIN tri USING (k) WHERE w > 0 GROUP BY clip_id, f, band)"""


@query(f"{BANDS} SELECT clip_id, f, band, {s6('v')} AS v FROM fb", ints="band f")
def filterbank_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = bins_e(spark, sf_dir)
    return spectral.filterbank(bins, spectral.triangles(bins, 4, 1.6)).select("clip_id", "f", "band", r6("v").alias("v"))


@query(f"""WITH {MAT}, v AS (SELECT clip_id, f, k, c * c AS v FROM m)
SELECT clip_id, f, k, {s6('greatest(10 * log10(greatest(v, 1e-10)) - 10 * log10(greatest(max(v) OVER (PARTITION BY clip_id), 1e-10)), -80.0)')} AS db FROM v""", ints="f k")
def power_to_db(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matrix(spark, sf_dir).withColumn("v", F.col("c") * F.col("c"))
    return spectral.power_to_db(rows).select("clip_id", "f", "k", r6("db").alias("db"))


@query(f"""SELECT vec_id, k, {s6('sum(v * cos(pi() * k * (2 * j + 1) / 128)) * CASE WHEN k = 0 THEN sqrt(1 / 64.0) ELSE sqrt(2 / 64.0) END')} AS c
FROM (SELECT vec_id, CAST(embedding[j + 1] AS DOUBLE) AS v, j FROM (SELECT vec_id, embedding, unnest(range(0, 64)) AS j FROM embeddings)), (SELECT unnest(range(0, 26)) AS k)
GROUP BY vec_id, k""", ints="k")
def dct2_ortho(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), F.lit(0).alias("f"), F.posexplode("v").alias("band", "v"))
    return spectral.dct2(rows, 64, 26).select(F.col("clip_id").alias("vec_id"), "k", r6("c").alias("c"))


@query(f"WITH {MAT} SELECT clip_id, f, k, {s6('ln(CASE WHEN c <= 0 THEN 1e-12 ELSE c END)')} AS c FROM m", ints="f k")
def log_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select("clip_id", "f", "k", r6(arrays.log_floor(F.col("c"))).alias("c"))


def lpcc_sql(sign: str, full: bool) -> str:
    """The recursion written out for order 4 and coefficients 0 to 6."""
    steps = []
    for n in range(1, 7):
        last = n - 1 if full else min(n, 4) - 1
        terms = [f"{k}.0 / {n} * c{k} * a{n - k}" for k in range(max(1, n - 4), last + 1)]
        own = f"-a{n}" if n <= 4 else "0.0"
        steps.append(f"{own} {sign} ({' + '.join(terms) or '0.0'}) AS c{n}")
    sql = "SELECT vec_id, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS a{k}" for k in range(1, 5)) + " FROM embeddings"
    for s in steps:
        sql = f"SELECT *, {s} FROM ({sql})"
    return f"SELECT vec_id, k, {s6('c')} AS c FROM (SELECT vec_id, unnest(range(0, 7)) AS k, unnest([0.0, {', '.join(f'c{n}' for n in range(1, 7))}]) AS c FROM ({sql}))"


def cepstra(spark: SparkSession, sf_dir: str, textbook: bool) -> DataFrame:
    a = F.concat(F.array(F.lit(1.0)), F.slice("v", 2, 4))
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(arrays.cepstrum_of_prediction(a, 7, textbook)).alias("k", "c"))
    return rows.select("vec_id", "k", r6("c").alias("c"))


@query(lpcc_sql("+", False), ints="k")
def lpcc_recursion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cepstra(spark, sf_dir, False)


@query(lpcc_sql("-", True), ints="k")
def lpcc_textbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cepstra(spark, sf_dir, True)


# ------------------------------------------------------------------ coefficient series


def sql_delta(weights: str) -> str:
    """(clip_id, f, k, d): weighted sums of nine frames, the ends taking the nearest inner one."""
    lags = ", ".join(f"lag(c, {4 - m}) OVER w" for m in range(9))
    return f"""e AS (
  SELECT clip_id, f, k, CASE WHEN lag(c, 4) OVER w IS NOT NULL AND lead(c, 4) OVER w IS NOT NULL THEN list_dot_product([{lags}], {weights}) END AS d
  FROM m WINDOW w AS (PARTITION BY clip_id, k ORDER BY f)),
g AS (
  SELECT clip_id, f, k, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY clip_id, k ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(d IGNORE NULLS) OVER (PARTITION BY clip_id, k ORDER BY f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS d FROM e)"""


FIRST = "[" + ", ".join(f"{t}.0 / 60" for t in range(-4, 5)) + "]"
SECOND = "[" + ", ".join(f"{t}.0 / 462" for t in (28, 7, -8, -17, -20, -17, -8, 7, 28)) + "]"


@query(f"WITH {MAT}, {sql_delta(FIRST)} SELECT clip_id, f, k, {s6('d')} AS c FROM g", ints="f k")
def delta1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.delta(matrix(spark, sf_dir)).select("clip_id", "f", "k", r6("c").alias("c"))


@query(f"WITH {MAT}, {sql_delta(SECOND)} SELECT clip_id, f, k, {s6('d')} AS c FROM g", ints="f k")
def delta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.delta(matrix(spark, sf_dir), 2).select("clip_id", "f", "k", r6("c").alias("c"))


@query(f"WITH {MAT}, {sql_delta(FIRST)} SELECT clip_id, f, k, {s6('c')} AS c FROM (SELECT * FROM m UNION ALL SELECT clip_id, f, k + 64, d FROM g)", ints="f k")
def stack_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.stack_deltas(matrix(spark, sf_dir), 64).select("clip_id", "f", "k", r6("c").alias("c"))


@query(f"""WITH {MAT}, t AS (SELECT clip_id, max(f) - 3 AS last FROM m GROUP BY clip_id)
SELECT clip_id, f, k, {s6('c')} AS c FROM m JOIN t USING (clip_id) WHERE f <= last""", ints="f k")
def frame_concat_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two families, one of three frames less: the frames that both have."""
    m = matrix(spark, sf_dir)
    last = F.max("f").over(W.partitionBy("clip_id"))
    right = m.withColumn("last", last).where("k >= 32 and f <= last - 3").select("clip_id", "f", (F.col("k") - 32).alias("k"), "c")
    return series.concat_families(m.where("k < 32"), right, 32).select("clip_id", "f", "k", r6("c").alias("c"))


@query(f"WITH {MAT} SELECT clip_id, f, k, {s6('(c - avg(c) OVER w) / (stddev_pop(c) OVER w + 1e-6)')} AS c FROM m WINDOW w AS (PARTITION BY clip_id, k)", ints="f k")
def cmvn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.standardise(matrix(spark, sf_dir)).select("clip_id", "f", "k", r6("c").alias("c"))


@query(f"WITH {MAT} SELECT clip_id, f, k, {s6('(c - avg(c) OVER w) / (stddev_pop(c) OVER w + 1e-6)')} AS c FROM m WINDOW w AS (PARTITION BY clip_id, k)", ints="f k")
def cmvn_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by moments that three deliveries of frames were merged into."""
    rows, keys = matrix(spark, sf_dir), ["clip_id", "k"]
    kept = mergeable.Kept(spark, shared_folder(spark, "moments"), keys)
    for part in range(3):
        kept.deliver(mergeable.moments(rows.where(F.col("f") % 3 == part), keys), f"part {part}")
    return mergeable.standardised(rows, kept.read(), keys).select("clip_id", "f", "k", r6("c").alias("c"))


@query(f"WITH {MAT} SELECT clip_id, k, {s6('avg(c)')} AS mean, {s6('max(c)')} AS greatest FROM m GROUP BY clip_id, k", ints="k")
def mean_max_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.mean_max_pool(matrix(spark, sf_dir)).select("clip_id", "k", r6("mean").alias("mean"), r6("greatest").alias("greatest"))


@query(f"WITH {MAT} SELECT clip_id, f, k, {s6('c * least(1.0, 5.0 / (sqrt(sum(c * c) OVER (PARTITION BY clip_id)) + 1e-6))')} AS c FROM m", ints="f k")
def grad_norm_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.clip_norm(matrix(spark, sf_dir), 5.0).select("clip_id", "f", "k", r6("c").alias("c"))


# ------------------------------------------------------------------ class scores and metrics

LOGITS = "z AS (SELECT vec_id, label, k, CAST(embedding[k + 1] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(0, 64)) AS k FROM embeddings))"
SOFT = f"{LOGITS}, s AS (SELECT vec_id, label, k, v, exp(v - max(v) OVER w) / sum(exp(v)) OVER w * exp(max(v) OVER w) AS p FROM z WINDOW w AS (PARTITION BY vec_id))"


def exploded(rows: DataFrame, values: Column) -> DataFrame:
    return rows.select("vec_id", F.posexplode(values).alias("k", "v")).select("vec_id", "k", r6("v").alias("v"))


@query(f"WITH {LOGITS} SELECT vec_id, k, {s6('(v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5)')} AS v FROM z WINDOW w AS (PARTITION BY vec_id)", ints="k")
def layer_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(rows := logits(spark, sf_dir), arrays.layer_norm(rows["z"]))


@query(f"WITH {SOFT} SELECT vec_id, k, {s6('p')} AS v FROM s", ints="k")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(rows := logits(spark, sf_dir), arrays.softmax(rows["z"]))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS pred_id FROM embeddings")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).select("vec_id", arrays.argmax_first(F.col("z")).alias("pred_id"))


@query(f"WITH {SOFT} SELECT label, {s6('avg(-ln(p))')} AS loss FROM s WHERE k = label GROUP BY label")
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).groupBy("label").agg(r6(F.avg(arrays.cross_entropy(F.col("z"), F.col("label")))).alias("loss"))


@query("SELECT vec_id, k, v FROM (SELECT vec_id, unnest([0, 1, 2]) AS k, unnest([round(greatest(h1, 0.0), 6), round(greatest(h2, 0.0), 6), round(greatest(h3, 0.0), 6)]) AS v FROM (SELECT vec_id, 0.5 * e1 - 0.25 * e2 + 0.1 AS h1, e1 + e2 - 0.2 AS h2, 2.0 * e2 AS h3 FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2 FROM embeddings)))")
def dense_relu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small linear layer and its half-wave."""
    h = arrays.dense(F.slice("v", 1, 2), [[0.5, -0.25], [1.0, 1.0], [0.0, 2.0]], [0.1, -0.2, 0.0])
    return exploded(vectors(spark, sf_dir), F.transform(h, arrays.half_wave))


@query(f"WITH {SOFT} SELECT vec_id, k, printf('%-12s: %.3f', 'class' || k, p) AS line FROM s", ints="k")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = logits(spark, sf_dir).select("vec_id", arrays.softmax(F.col("z")).alias("probs"))
    return report_lines(scored, [f"class{k}" for k in range(64)], "vec_id")


@query(f"WITH {SIG_E} SELECT clip_id, {s6('sum(0.1 * pow(0.9, n - 1 - i) * x)')} AS ema FROM sig GROUP BY clip_id")
def ema_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal_e(spark, sf_dir).groupBy("clip_id").agg(r6(series.ema_of_rows("x", "i", "n")).alias("ema"))


@query(f"WITH {LOGITS} SELECT vec_id, {s6('sum(0.1 * pow(0.9, 63 - k) * v)')} AS ema FROM z GROUP BY vec_id")
def ema_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", r6(arrays.ema(F.col("v"))).alias("ema"))


CONFUSION = f"""c AS (SELECT user_id % 5 AS y, list_position([{TYPES_SQL}], event_type) - 1 AS p, count(*) AS n FROM events GROUP BY 1, 2),
k AS (
  SELECT cls, sum(CASE WHEN y = cls AND p = cls THEN n ELSE 0 END) AS tp, sum(CASE WHEN y <> cls AND p = cls THEN n ELSE 0 END) AS fp, sum(CASE WHEN y = cls AND p <> cls THEN n ELSE 0 END) AS fn
  FROM c, (SELECT y AS cls FROM c UNION SELECT p FROM c) GROUP BY cls)"""


def event_scores(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    rows = labels.encode(table(spark, sf_dir, "events"), EVENT_TYPES, "event_type", "p")
    rows = rows.withColumns({"y": (F.col("user_id") % 5).cast("int"), "epoch": F.col("event_id") % 20})
    return metrics.macro_scores(metrics.confusion(rows, "y", "p", by), by)


@query(f"WITH {CONFUSION} SELECT {s6('avg(tp / (tp + fn))')} AS macro_accuracy FROM k")
def macro_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_scores(spark, sf_dir).select(r6("macro_accuracy").alias("macro_accuracy"))


@query(f"WITH {CONFUSION} SELECT {s6('avg(2 * tp / (2 * tp + fp + fn))')} AS macro_f1 FROM k")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_scores(spark, sf_dir).select(r6("macro_f1").alias("macro_f1"))


@query(f"WITH {CONFUSION} SELECT {s6('avg(tp / (tp + fn))')} AS macro_accuracy, {s6('avg(2 * tp / (2 * tp + fp + fn))')} AS macro_f1 FROM k")
def confusion_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both scores from counts that three deliveries were merged into, one of them sent twice."""
    rows = labels.encode(table(spark, sf_dir, "events"), EVENT_TYPES, "event_type", "p").withColumn("y", (F.col("user_id") % 5).cast("int"))
    kept = mergeable.Kept(spark, shared_folder(spark, "counts"), ["y", "p"], mergeable.merged_counts)
    for part in (0, 1, 1, 2):
        kept.deliver(metrics.confusion(rows.where(F.col("event_id") % 3 == part), "y", "p"), f"part {part}")
    return metrics.macro_scores(kept.read()).select(r6("macro_accuracy").alias("macro_accuracy"), r6("macro_f1").alias("macro_f1"))


@query(f"""WITH c AS (SELECT event_id % 20 AS epoch, user_id % 5 AS y, avg(CASE WHEN list_position([{TYPES_SQL}], event_type) - 1 = user_id % 5 THEN 1.0 ELSE 0.0 END) AS r FROM events GROUP BY 1, 2),
s AS (SELECT epoch, {s6('avg(r)')} AS macro_accuracy FROM c GROUP BY epoch)
SELECT epoch, macro_accuracy FROM s WHERE macro_accuracy > 0 ORDER BY macro_accuracy DESC, epoch LIMIT 1""")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = event_scores(spark, sf_dir, ["epoch"]).select("epoch", r6("macro_accuracy").alias("macro_accuracy"))
    return metrics.best_epoch(scores)


# ------------------------------------------------------------------ sources


@query("SELECT 'clips/' || event_id || '.wav' AS filepath, event_type AS label FROM events")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest written as CSV, with a further column, and read again."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("label"), F.concat(F.lit("clips/"), "event_id", F.lit(".wav")).alias("filepath"))
    rows.write.option("header", True).csv(path := shared_folder(spark, "manifest"))
    return manifest.read_manifest(spark, path)


@query("""SELECT 'centre' || label AS name, CAST(k - 1 AS INTEGER) AS p, round(avg(CAST(embedding[k] AS DOUBLE)) * 1024) / 1024 AS v
FROM (SELECT label, embedding, unnest(range(1, 65)) AS k FROM embeddings) GROUP BY label, k
UNION ALL SELECT 'sizes', CAST(label AS INTEGER), CAST(count(*) AS DOUBLE) FROM embeddings GROUP BY label""")
def checkpoint_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model of class centres, learned from the vectors, written and read again, its names and shapes checked."""
    v = vectors(spark, sf_dir)
    centres = v.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col("v")[k]).alias(f"c{k}") for k in range(64))).orderBy("label").collect()  # a row a class
    params = {f"centre{r['label']}": np.round(np.array([r[f"c{k}"] for k in range(64)]) * 1024) / 1024 for r in centres} | {"sizes": np.array([r["n"] for r in centres], float)}
    checkpoint.save(spark, path := shared_folder(spark, "model"), params, {"labels": [r["label"] for r in centres]})
    back, _ = checkpoint.load(spark, path, {k: x.shape for k, x in params.items()})
    rows = spark.createDataFrame([(k, x.ravel().astype(float).tolist()) for k, x in back.items()], "name string, v array<double>")
    return rows.select("name", F.posexplode("v").alias("p", "v"))


@query(f"""WITH {SIG_E} SELECT clip_id, any_value(n) AS n, CAST((any_value(n) - {FRAME_E}) // {HOP_E} + 1 AS INTEGER) AS frames, 48 AS samples, 2 * (5 + 6) AS dim,
  (SELECT count(DISTINCT event_type) FROM events) AS classes FROM sig GROUP BY clip_id""", ints="n samples dim classes")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings written as YAML, the classes from the table, and what follows from them for each clip."""
    kinds = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").collect()]
    text = f"data: {{labels: {kinds}, sr: 1600, segment_sec: 0.03}}\nfeatures: {{n_mfcc: 5, n_gfcc: 6, hop: {HOP_E}, win: {FRAME_E}}}\n"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path := shared_folder(spark, "settings"))
    cfg = load_config(spark, path)
    sizes = signal_e(spark, sf_dir).groupBy("clip_id").agg(F.first("n").alias("n"))
    frames = framing.frame_count(F.col("n"), cfg.features.win, cfg.features.hop)
    return sizes.select("clip_id", "n", frames.alias("frames"), F.lit(cfg.data.samples).alias("samples"), F.lit(cfg.features.dim).alias("dim"), F.lit(len(cfg.data.labels)).alias("classes"))


# ------------------------------------------------------------------ whole clips: transforms and the model

#: Suppliers' and users' series are short for audio: frames and filters are scaled down with them.
SMALL = {"sr": 1600, "hop": 16, "win": 40}


def clips_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.clips_of(signal_l(spark, sf_dir)).select("clip_id", "y")


def clips_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return framing.clips_of(signal_e(spark, sf_dir)).select("clip_id", "y")


def spread(rows: DataFrame, cell: str) -> DataFrame:
    frames = rows.select("clip_id", F.posexplode(cell).alias("f", "r"))
    return frames.select("clip_id", "f", F.posexplode("r").alias("k", "c")).select("clip_id", "f", "k", r6("c").alias("c"))


def sql_stft(n_fft: int, hop: int, win: int, source: str = "sig", out: str = "sp") -> str:
    """out (clip_id, n, f, k, re, im): centred frames under a window in their middle, transformed."""
    left = (n_fft - win) // 2
    return f"""{out}_nf AS (SELECT clip_id, n, unnest(range(0, n // {hop} + 1)) AS f FROM (SELECT DISTINCT clip_id, n FROM {source})),
{out}_fr AS (
  SELECT a.clip_id, a.n, a.f, s.i + {n_fft // 2} - a.f * {hop} AS j, s.x * (0.5 - 0.5 * cos(2 * pi() * (s.i + {n_fft // 2} - a.f * {hop} - {left}) / {win})) AS x
  FROM {out}_nf a JOIN {source} s ON s.clip_id = a.clip_id AND s.i + {n_fft // 2} - a.f * {hop} >= {left} AND s.i + {n_fft // 2} - a.f * {hop} < {left + win}),
{out}_some AS (
  SELECT clip_id, n, f, k, sum(x * cos(2 * pi() * k * j / {n_fft})) AS re, -sum(x * sin(2 * pi() * k * j / {n_fft})) AS im
  FROM {out}_fr, (SELECT unnest(range(0, {n_fft // 2 + 1})) AS k) GROUP BY clip_id, n, f, k),
{out} AS (
  SELECT clip_id, n, f, k, coalesce(re, 0.0) AS re, coalesce(im, 0.0) AS im
  FROM {out}_nf CROSS JOIN (SELECT unnest(range(0, {n_fft // 2 + 1})) AS k) LEFT JOIN (SELECT clip_id, f, k, re, im FROM {out}_some) USING (clip_id, f, k))"""


def sql_cosines(source: str, size: int, keep: int, out: str) -> str:
    """out (clip_id, f, k, c): orthonormal cosine transform of source's v over band."""
    return f"""{out} AS (
  SELECT clip_id, f, k, sum(v * cos(pi() * k * (2 * band + 1) / (2 * {size}))) * CASE WHEN k = 0 THEN sqrt(1.0 / {size}) ELSE sqrt(2.0 / {size}) END AS c
  FROM {source}, (SELECT unnest(range(0, {keep})) AS k) GROUP BY clip_id, f, k)"""


def sql_mfcc(sr: int, keep: int, mels: int, low: float, high: float, hop: int, win: int, n_fft: int, source: str = "sig") -> str:
    """mfcc (clip_id, f, k, c)."""
    to_mel = lambda hz: hz * 3 / 200 if hz < 1000 else 15 + 27 * np.log(hz / 1000) / np.log(6.4)
    a, z = float(to_mel(low)), float(to_mel(high))
    return f"""{sql_stft(n_fft, hop, win, source, "ms")},
edge AS (SELECT e, CASE WHEN m < 15 THEN m * 200 / 3 ELSE 1000 * pow(6.4, (m - 15) / 27) END AS hz FROM (SELECT e, {a!r} + e * ({z!r} - {a!r}) / {mels + 1} AS m FROM (SELECT unnest(range(0, {mels + 2})) AS e))),
tri AS (
  SELECT a.e AS band, k, greatest(0.0, least((k * {sr / n_fft} - a.hz) / (b.hz - a.hz), (c.hz - k * {sr / n_fft}) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS w
  FROM edge a JOIN edge b ON b.e = a.e + 1 JOIN edge c ON c.e = a.e + 2, (SELECT unnest(range(0, {n_fft // 2 + 1})) AS k)),
mel AS (SELECT clip_id, f, band, sum(w * (re * re + im * im)) AS v FROM ms JOIN tri USING (k) GROUP BY clip_id, f, band),
db AS (SELECT clip_id, f, band, greatest(-80.0, 10 * log10(greatest(v, 1e-10)) - 10 * log10(greatest(max(v) OVER (PARTITION BY clip_id), 1e-10))) AS v FROM mel),
{sql_cosines("db", mels, keep, "mfcc")}"""


def sql_gfcc(sr: int, keep: int, bands: int, win: int, hop: int, low: float, source: str = "sig") -> str:
    """gfcc (clip_id, f, k, c) of clips of win samples at least: impulse responses from the filters' responses, then sums over them."""
    c, n_fft, taps = 9.26449 * 24.7, dsp.gammatone_size(sr, low), dsp.gammatone_taps(sr, bands, low)[0].shape[1]
    return f"""gb AS (
  SELECT band, fc, 2 * pi() * fc / {sr} AS arg, exp(-2 * pi() * 1.019 * 24.7 * (4.37 * fc / 1000 + 1) / {sr}) AS r
  FROM (SELECT band, -{c!r} + exp(({bands} - band) * (ln({low} + {c!r}) - ln({sr / 2} + {c!r})) / {bands}) * ({sr / 2} + {c!r}) AS fc FROM (SELECT unnest(range(0, {bands})) AS band))),
gk AS (SELECT {n_fft} AS size, unnest(range(0, {n_fft // 2 + 1})) AS k),
-- angles at which filters are wanted: the bins', and each band's centre for unit gain
ga AS (SELECT band, arg, r, size, k, 2 * pi() * k / size AS a FROM gb, gk UNION ALL SELECT band, arg, r, 0, 0, arg FROM gb),
gs AS (SELECT *, r * (cos(arg) + sgn * sqrt(3 + outer_ * pow(2, 1.5)) * sin(arg)) AS q FROM ga, (VALUES (1, 1), (1, -1), (-1, 1), (-1, -1)) AS t(sgn, outer_)),
gr AS (
  SELECT band, size, k, exp(sum(ln(sqrt(pow(1 - q * cos(a), 2) + pow(q * sin(a), 2))))) AS up, sum(atan2(q * sin(a), 1 - q * cos(a))) AS up_phase,
    any_value(1 - 2 * cos(arg) * r * cos(a) + r * r * cos(2 * a)) AS dre, any_value(2 * cos(arg) * r * sin(a) - r * r * sin(2 * a)) AS dim
  FROM gs GROUP BY band, size, k, a),
gh AS (SELECT band, size, k, up / pow(dre * dre + dim * dim, 2) AS gain, up_phase - 4 * atan2(dim, dre) AS phase FROM gr),
gw AS (SELECT h.band, h.size, h.k, h.gain / u.gain * cos(h.phase) AS hre, h.gain / u.gain * sin(h.phase) AS him FROM gh h JOIN gh u ON u.band = h.band AND u.size = 0 WHERE h.size > 0),
gtaps AS (
  SELECT band, j, sum((hre * cos(2 * pi() * k * j / {n_fft}) - him * sin(2 * pi() * k * j / {n_fft})) * CASE WHEN k = 0 OR 2 * k = {n_fft} THEN 1.0 ELSE 2.0 END) / {n_fft} AS h
  FROM gw, (SELECT unnest(range(0, {taps})) AS j) GROUP BY band, j),
gt AS (SELECT clip_id, n, band, i + j AS i, sum(x * h) AS x FROM {source} JOIN gtaps ON i + j < n GROUP BY clip_id, n, band, i + j),
gl AS (
  SELECT clip_id, band, f, sqrt(sum(x * x) / {win}) AS v
  FROM (SELECT clip_id, n, unnest(range(0, (n - {win}) // {hop} + 1)) AS f FROM (SELECT DISTINCT clip_id, n FROM {source})) JOIN gt USING (clip_id) WHERE i >= f * {hop} AND i < f * {hop} + {win} GROUP BY clip_id, band, f),
gv AS (SELECT clip_id, f, band, ln(CASE WHEN v <= 0 THEN 1e-12 ELSE v END) AS v FROM gl),
{sql_cosines("gv", bands, keep, "gfcc")}"""


DENOISE_FFT, DENOISE_HOP = 128, 32


@query(f"""WITH {SIG_L}, {sql_stft(DENOISE_FFT, DENOISE_HOP, DENOISE_FFT)},
size AS (SELECT *, sqrt(re * re + im * im) AS mag, greatest(1, least((n // {DENOISE_HOP} + 1) // 4, {int(0.2 * SMALL["sr"] / DENOISE_HOP)})) AS m FROM sp),
quiet AS (SELECT *, greatest(mag - avg(mag) FILTER (WHERE f < m) OVER (PARTITION BY clip_id, k), 0.0) / CASE WHEN mag = 0 THEN 1.0 ELSE mag END * CASE WHEN k = 0 OR k = {DENOISE_FFT // 2} THEN 1.0 ELSE 2.0 END AS g FROM size),
back AS (
  SELECT clip_id, n, f, j, sum(g * (re * cos(2 * pi() * k * j / {DENOISE_FFT}) - im * sin(2 * pi() * k * j / {DENOISE_FFT}))) / {DENOISE_FFT} AS x
  FROM quiet, (SELECT unnest(range(0, {DENOISE_FFT})) AS j) GROUP BY clip_id, n, f, j),
w AS (SELECT clip_id, n, f * {DENOISE_HOP} + j - {DENOISE_FFT // 2} AS i, x, 0.5 - 0.5 * cos(2 * pi() * j / {DENOISE_FFT}) AS w FROM back)
SELECT clip_id, i, CASE WHEN sum(w * w) > 1e-12 THEN {s6('sum(w * x) / sum(w * w)')} ELSE 0.0 END AS x FROM w WHERE i >= 0 AND i < n // {DENOISE_HOP} * {DENOISE_HOP} GROUP BY clip_id, i""", ints="i")
def denoise_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = clips_l(spark, sf_dir).select("clip_id", dsp.denoise(F.col("y"), SMALL["sr"], DENOISE_FFT, DENOISE_HOP, DENOISE_FFT, number="double").alias("y"))
    return quiet.select("clip_id", F.posexplode("y").alias("i", "x")).select("clip_id", "i", r6("x").alias("x"))


#: Rate, coefficients, bands, lowest and highest frequency, hop, window, transform: bands above 1 kHz are logarithmic.
MFCC = (4000, 13, 26, 50, 2000, SMALL["hop"], SMALL["win"], 128)
GFCC = (SMALL["sr"], 6, 8, FRAME_E, HOP_E, 50)


@query(f"WITH {SIG_L}, {sql_mfcc(*MFCC)} SELECT clip_id, f, k, {s6('c')} AS c FROM mfcc", ints="f k")
def mfcc_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(clips_l(spark, sf_dir).select("clip_id", dsp.mfcc_of(F.col("y"), *MFCC, number="double").alias("m")), "m")


@query(f"WITH {SIG_E}, {sql_gfcc(*GFCC)} SELECT clip_id, f, k, {s6('c')} AS c FROM gfcc", ints="f k")
def gfcc_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    sr, keep, bands, win, hop, low = GFCC
    return spread(clips_e(spark, sf_dir).select("clip_id", dsp.gfcc_of(F.col("y"), sr, keep, bands, win / sr, hop / sr, low, "double").alias("m")), "m")


BURG, CEPSTRA = 8, 12


def sql_burg(order: int) -> str:
    """bg (clip_id, f, a): prediction coefficients of frames under a symmetric window, order after order."""
    win = SMALL["win"]
    sql = f"SELECT clip_id, f, [1.0] AS a, y[2:{win}] AS u, y[1:{win - 1}] AS b FROM (SELECT clip_id, f, list(x * (0.5 - 0.5 * cos(2 * pi() * j / {win - 1})) ORDER BY j) AS y FROM fr GROUP BY clip_id, f)"
    for m in range(1, order + 1):
        below = "list_dot_product(u, u) + list_dot_product(b, b)"
        sql = f"SELECT *, CASE WHEN {below} > 0 THEN -2 * list_dot_product(u, b) / ({below}) ELSE 0.0 END AS r, list_append(a, 0.0) AS o FROM ({sql})"
        sql = f"""SELECT clip_id, f, [o[i] + r * o[{m + 2} - i] for i in range(1, {m + 2})] AS a,
  [u[i + 1] + r * b[i + 1] for i in range(1, {win - m})] AS u, [b[i] + r * u[i] for i in range(1, {win - m})] AS b FROM ({sql})"""
    return f"WITH {SIG_L}, {sql_frames(win, SMALL['hop'])}, bg AS ({sql})"


@query(f"{sql_burg(BURG)} SELECT clip_id, f, k - 1 AS k, {s6('a[k]')} AS a FROM (SELECT clip_id, f, a, unnest(range(1, {BURG + 2})) AS k FROM bg)", ints="f k")
def burg_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction coefficients, the first being 1."""
    win = SMALL["win"]
    frames = F.transform(arrays.frames_of(F.col("y"), win, SMALL["hop"], pad_short=False), lambda frame: F.transform(frame, lambda v, j: v * (0.5 - 0.5 * F.cos(2 * F.pi() * j / (win - 1)))))
    return spread(clips_l(spark, sf_dir).select("clip_id", dsp.burg_of(frames, BURG).alias("m")), "m").withColumnRenamed("c", "a")


def sql_lpcc(order: int, keep: int) -> str:
    sql = "SELECT clip_id, f, " + ", ".join(f"a[{k + 1}] AS a{k}" for k in range(1, order + 1)) + " FROM bg"
    for n in range(1, keep):
        terms = [f"{k}.0 / {n} * c{k} * a{n - k}" for k in range(max(1, n - order), min(n, order))]
        sql = f"SELECT *, {f'-a{n}' if n <= order else '0.0'} + ({' + '.join(terms) or '0.0'}) AS c{n} FROM ({sql})"
    return f"SELECT clip_id, f, k, {s6('c')} AS c FROM (SELECT clip_id, f, unnest(range(0, {keep})) AS k, unnest([0.0, {', '.join(f'c{n}' for n in range(1, keep))}]) AS c FROM ({sql}))"


@query(f"{sql_burg(BURG)} {sql_lpcc(BURG, CEPSTRA)}", ints="f k")
def lpcc_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(clips_l(spark, sf_dir).select("clip_id", lpcc_of(F.col("y"), BURG, CEPSTRA, SMALL["hop"], SMALL["win"], number="double").alias("m")), "m")


#: Features of the users' series: 72 samples, so that clips are cut or padded.
SEQUENCES = {
    "data": {"sr": SMALL["sr"], "segment_sec": 0.045},
    "preprocess": {"denoise": False, "crop": "head"},
    "features": {"n_mfcc": 5, "n_mels": 8, "n_gfcc": GFCC[1], "n_filters": GFCC[2], "fmin": 50, "fmax": 800, "hop": HOP_E, "win": FRAME_E, "n_fft": 64},
}
CUT_E = """cut AS (
  SELECT clip_id, CAST(i AS BIGINT) AS i, coalesce(x, 0.0) AS x, CAST(72 AS BIGINT) AS n
  FROM (SELECT DISTINCT clip_id FROM sig) CROSS JOIN (SELECT unnest(range(0, 72)) AS i) LEFT JOIN (SELECT clip_id, i, x FROM sig) USING (clip_id, i))"""


def sql_family(name: str, size: int, up: int) -> str:
    """A family and its deltas, as coefficients from `up` on."""
    own = sql_delta(FIRST).replace("FROM m ", f"FROM {name} ").replace("FROM e)", f"FROM {name}_e)").replace("e AS (", f"{name}_e AS (", 1).replace("g AS (", f"{name}_g AS (", 1)
    return f"{own}, {name}_all AS (SELECT clip_id, f, k + {up} AS k, c FROM {name} UNION ALL SELECT clip_id, f, k + {up + size}, d FROM {name}_g)"


@query(f"""WITH {SIG_E}, {CUT_E}, {sql_mfcc(SMALL["sr"], 5, 8, 50, 800, HOP_E, FRAME_E, 64, "cut")}, {sql_gfcc(*GFCC, "cut")},
{sql_family("mfcc", 5, 0)}, {sql_family("gfcc", GFCC[1], 10)},
both_ AS (SELECT * FROM mfcc_all UNION ALL SELECT * FROM gfcc_all),
same AS (SELECT * FROM both_ WHERE f < {(72 - FRAME_E) // HOP_E + 1})
SELECT clip_id, f, k, {s6('(c - avg(c) OVER w) / (stddev_pop(c) OVER w + 1e-6)')} AS c FROM same WINDOW w AS (PARTITION BY clip_id, k)""", ints="f k")
def feature_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both families with deltas, the frames that both have, standardised: one pass over each clip."""
    return spread(feature_table(clips_e(spark, sf_dir), from_dict(SEQUENCES), number="double"), "x")


#: A small model of the usual make, for the sample tables.
SETTINGS = {
    "data": {"sr": SMALL["sr"], "segment_sec": 0.3},
    "preprocess": {"noise_sec": 0.02},
    "features": {"n_mfcc": 8, "n_mels": 16, "n_gfcc": 8, "n_filters": 16, "fmin": 20, "fmax": 800, "hop": SMALL["hop"], "win": SMALL["win"]},
    "model": {"hidden_size": 16},
}


@query()
def bilstm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = from_dict(SETTINGS)
    shape = Shape(cfg.features.dim, cfg.model.hidden_size, cfg.model.num_layers, len(cfg.data.labels))
    scored = predict(feature_table(clips_l(spark, sf_dir), cfg), shape.new(cfg.train.seed), shape, list(cfg.data.labels))
    return scored.select("clip_id", F.transform("probs", lambda p: F.round(p, 4)).alias("probs"), "pred_id", "pred")


#: A model small enough to be written out in SQL, over vectors as eight steps of eight values.
TINY = Shape(8, 2, 2, 3)


def tiny_params() -> dict[str, np.ndarray]:
    return {k: 2 * v.astype(float) for k, v in TINY.new(7).items()}


def sql_bilstm(shape: Shape, params: dict[str, np.ndarray], steps: int, hidden: bool = False) -> str:
    """The model's forward pass written out: a layer's direction is one select a step. hidden: ends in (vec_id, d, o) lists."""
    h = shape.hidden
    sum_of = lambda names, weights: " + ".join(f"{n} * ({float(w)!r})" for n, w in zip(names, weights, strict=True)) or "0.0"
    sql = "SELECT vec_id, " + ", ".join(f"CAST(embedding[{t * shape.inputs + k + 1}] AS DOUBLE) AS y{t}_{k}" for t in range(steps) for k in range(shape.inputs)) + " FROM embeddings"
    width, y = shape.inputs, "y"
    for layer in range(shape.layers):
        for way in ("forward", "backward"):
            wx, wh, b = (params[f"lstm{layer}.{way}.{x}"] for x in "xhb")
            last = None
            name = f"l{layer}{way[0]}"
            for t in range(steps) if way == "forward" else reversed(range(steps)):
                ins = [f"{y}{t}_{k}" for k in range(width)]
                state = [f"{name}{last}_h{k}" for k in range(h)] if last is not None else ["0.0"] * h
                cell = [f"{name}{last}_c{k}" for k in range(h)] if last is not None else ["0.0"] * h
                z = [f"{sum_of([*ins, *state], [*wx[:, g], *wh[:, g]])} + ({float(b[g])!r})" for g in range(4 * h)]
                gates = [f"1 / (1 + exp(-({x})))" if g < 3 * h else f"tanh({x})" for g, x in enumerate(z)]
                sql = f"SELECT *, {', '.join(f'{x} AS {name}{t}_g{g}' for g, x in enumerate(gates))} FROM ({sql})"
                sql = f"SELECT *, {', '.join(f'{name}{t}_g{h + k} * {cell[k]} + {name}{t}_g{k} * {name}{t}_g{3 * h + k} AS {name}{t}_c{k}' for k in range(h))} FROM ({sql})"
                sql = f"SELECT *, {', '.join(f'{name}{t}_g{2 * h + k} * tanh({name}{t}_c{k}) AS {name}{t}_h{k}' for k in range(h))} FROM ({sql})"
                last = t
        joined = [f"l{layer}{w}{t}_h{k} AS n{layer}_{t}_{j * h + k}" for t in range(steps) for j, w in enumerate("fb") for k in range(h)]
        sql, width, y = f"SELECT vec_id, {', '.join(joined)} FROM ({sql})", 2 * h, f"n{layer}_"
    over = [[f"{y}{t}_{k}" for t in range(steps)] for k in range(2 * h)]
    pooled = [f"({' + '.join(o)}) / {steps}" for o in over] + [f"greatest({', '.join(o)})" for o in over]
    sql = f"SELECT vec_id, {', '.join(f'{x} AS p{k}' for k, x in enumerate(pooled))} FROM ({sql})"

    def linear(sql: str, source: str, name: str, out: str, relu: bool = False) -> str:
        w, b = params[f"{name}.w"], params[f"{name}.b"]
        rows = [f"{sum_of([f'{source}{k}' for k in range(len(w))], w[:, g])} + ({float(b[g])!r})" for g in range(w.shape[1])]
        return f"SELECT vec_id, {', '.join((f'greatest({x}, 0.0)' if relu else x) + f' AS {out}{g}' for g, x in enumerate(rows))} FROM ({sql})"

    sql = linear(sql, "p", "project", "z")
    zs = [f"z{k}" for k in range(2 * h)]
    mean = f"({' + '.join(zs)}) / {2 * h}"
    sql = f"SELECT *, {mean} AS zm FROM ({sql})"
    sql = f"SELECT *, sqrt(({' + '.join(f'(z{k} - zm) * (z{k} - zm)' for k in range(2 * h))}) / {2 * h} + 1e-5) AS zd FROM ({sql})"
    sql = f"SELECT vec_id, {', '.join(f'(z{k} - zm) / zd * ({float(params["norm.gain"][k])!r}) + ({float(params["norm.bias"][k])!r}) AS u{k}' for k in range(2 * h))} FROM ({sql})"
    sql = linear(sql, "u", "dense", "d", relu=True)
    dense, names = [f"d{k}" for k in range(h)], [f"o{k}" for k in range(shape.classes)]
    if hidden:
        outs = ", ".join(f"{sum_of(dense, params['out.w'][:, g])} + ({float(params['out.b'][g])!r})" for g in range(shape.classes))
        return f"SELECT vec_id, [{', '.join(dense)}] AS d, [{outs}] AS o FROM ({sql})"
    sql = linear(sql, "d", "out", "o")
    total = " + ".join(f"exp({n})" for n in names)
    return f"SELECT vec_id, k, {s6('p')} AS p FROM (SELECT vec_id, unnest(range(0, {shape.classes})) AS k, unnest([{', '.join(f'exp({n}) / ({total})' for n in names)}]) AS p FROM ({sql}))"


@query(sql_bilstm(TINY, tiny_params(), 8), ints="k")
def bilstm_tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers of both directions, pooled, projected, normalised and classified."""
    steps = vectors(spark, sf_dir).select("vec_id", arrays.frames_of(F.col("v"), 8, 8).alias("x"))
    scored = predict(steps, tiny_params(), TINY, ["a", "b", "c"])
    return scored.select("vec_id", F.posexplode("probs").alias("k", "p")).select("vec_id", "k", r6("p").alias("p"))


#: One step of training: rate, decay.
STEP = {"lr": 0.01, "weight_decay": 1e-4}


def sql_first_step(shape: Shape, params: dict[str, np.ndarray]) -> str:
    """Loss, and the last layer's weights after one step of Adam whose batch is the whole table; the first step goes by a gradient's sign, nearly."""
    w, c = params["out.w"], shape.classes
    old = ", ".join(f"({j}, {k}, {float(w[j, k] if j < shape.hidden else params['out.b'][k])!r})" for j in range(shape.hidden + 1) for k in range(c))
    return f"""WITH fwd AS ({sql_bilstm(shape, params, 8, hidden=True)}),
rows AS (SELECT label % {c} AS y, list_append(d, 1.0) AS d, list_transform(o, lambda v: exp(v) / list_sum(list_transform(o, lambda u: exp(u)))) AS p FROM fwd JOIN embeddings USING (vec_id)),
old AS (SELECT * FROM (VALUES {old}) AS t(j, k, v)),
g AS (SELECT j, k, any_value(v) AS v, avg(d[j + 1] * (p[k + 1] - CASE WHEN y = k THEN 1.0 ELSE 0.0 END)) + {STEP["weight_decay"]} * any_value(v) AS g FROM rows, old GROUP BY j, k)
SELECT 'loss' AS name, 0 AS p, round(-avg(ln(p[y + 1])), 5) AS v FROM rows
UNION ALL SELECT CASE WHEN j = {shape.hidden} THEN 'out.b' ELSE 'out.w' END, CASE WHEN j = {shape.hidden} THEN k ELSE j * {c} + k END, round(v - {STEP["lr"]} * g / (abs(g) + 1e-8), 5) FROM g"""


@query(sql_first_step(TINY, TINY.new(3407)), ints="p")
def train_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step of training whose gradient two tasks sum between them: the batch's loss and the last layer after it."""
    rows = vectors(spark, sf_dir).select(F.col("vec_id").alias("clip_id"), (F.col("label") % TINY.classes).alias("label_id"), arrays.frames_of(F.col("v"), 8, 8).alias("x"))
    n = rows.count()
    cfg = from_dict({"train": STEP | {"batch_size": n, "workers": 2, "grad_clip": 0.0, "together": "step"}, "model": {"dropout": 0.0}})
    dealt = batching.batches(rows, "clip_id", n, cfg.train.seed, 0)
    state, losses = steps_together(dealt, {"params": TINY.new(cfg.train.seed), "first": {}, "second": {}, "step": 0}, TINY, cfg, 0, 1)
    out = [("loss", [float(x) for x in losses])] + [(k, state["params"][k].ravel().astype(float).tolist()) for k in ("out.w", "out.b")]
    return spark.createDataFrame(out, "name string, v array<double>").select("name", F.posexplode("v").alias("p", "v")).select("name", "p", F.round("v", 5).alias("v"))


@query(f"""WITH fwd AS ({sql_bilstm(TINY, tiny_params(), 8, hidden=True)}),
c AS (SELECT label % {TINY.classes} AS y, list_position(o, list_max(o)) - 1 AS p FROM fwd JOIN embeddings USING (vec_id)),
k AS (SELECT cls, count(*) FILTER (WHERE y = cls AND p = cls) AS tp, count(*) FILTER (WHERE y <> cls AND p = cls) AS fp, count(*) FILTER (WHERE y = cls AND p <> cls) AS fn
  FROM c, (SELECT y AS cls FROM c UNION SELECT p FROM c) GROUP BY cls)
SELECT {s6('avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END)')} AS macro_accuracy, {s6('avg(2 * tp / (2 * tp + fp + fn))')} AS macro_f1 FROM k""")
def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation of the model: its predictions for all vectors against their classes."""
    rows = vectors(spark, sf_dir).select("vec_id", (F.col("label") % TINY.classes).alias("label_id"), arrays.frames_of(F.col("v"), 8, 8).alias("x"))
    scores = evaluate(rows, tiny_params(), TINY, ["a", "b", "c"])
    return spark.createDataFrame([(scores["macro_accuracy"], scores["macro_f1"])], "macro_accuracy double, macro_f1 double").select(r6("macro_accuracy").alias("macro_accuracy"), r6("macro_f1").alias("macro_f1"))


@query(f"WITH {SIG_L} SELECT clip_id, i, {s6('round(greatest(-1.0, least(1.0, x / 4)) * 32767) / 32768')} AS x FROM sig", ints="i")
def wav_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips, scaled to the range of samples, written as WAV bytes and read again."""
    scaled = clips_l(spark, sf_dir).select("clip_id", F.transform("y", lambda v: v / 4).alias("y"))
    back = audio.decoded(audio.encoded(scaled))
    return back.select("clip_id", F.posexplode("y").alias("i", "x")).select("clip_id", "i", r6(F.col("x").cast("double")).alias("x"))


# ------------------------------------------------------------------ series and clips of any length

#: Samples of a chunk, and rows of a range: small here, so that the tables' series have several.
CHUNK_L, RANGE_L = 256, 512


@query(f"WITH {SIG_L}, {sql_stft(DENOISE_FFT, DENOISE_HOP, DENOISE_FFT)} SELECT clip_id, f, k, {s6('re')} AS re, {s6('im')} AS im FROM sp", ints="k")
def stft_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of clips that are rows of chunks."""
    rows = chunks.stft(chunks.of_rows(signal_l(spark, sf_dir), CHUNK_L), DENOISE_FFT, DENOISE_HOP, DENOISE_FFT, CHUNK_L)
    bins = rows.select("clip_id", "f", F.posexplode(F.arrays_zip("re", "im")).alias("k", "s"))
    return bins.select("clip_id", "f", "k", r6("s.re").alias("re"), r6("s.im").alias("im"))


@query(ORACLES["denoise_clips"].replace("CAST(i AS INTEGER)", "CAST(i AS BIGINT)"))
def denoise_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as denoise_clips, chunk by chunk."""
    rows = chunks.of_rows(signal_l(spark, sf_dir), CHUNK_L)
    quiet = chunks.denoise(rows, SMALL["sr"], DENOISE_FFT, DENOISE_HOP, DENOISE_FFT, size=CHUNK_L)
    return chunks.samples_of(quiet).select("clip_id", "i", r6("x").alias("x"))


@query(f"WITH {SIG_L}, {sql_gfcc(*GFCC)} SELECT clip_id, f, k, {s6('c')} AS c FROM gfcc", ints="k")
def gfcc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gammatone coefficients of clips that are rows of chunks, by overlap-save."""
    sr, keep, bands, win, hop, low = GFCC
    rows = chunks.gfcc(chunks.of_rows(signal_l(spark, sf_dir), 2 * CHUNK_L), sr, keep, bands, win / sr, hop / sr, low, 2 * CHUNK_L)
    return rows.select("clip_id", "f", F.posexplode("c").alias("k", "c")).select("clip_id", "f", "k", r6("c").alias("c"))


#: Rates that clips are brought to.
RATES = (1000, 2400)


def sql_resampled(old: int, rates: tuple[int, ...]) -> str:
    """Each sample as a sum over the filter's weights of its phase, a table of (rate, phase, j, w)."""
    terms = [(new, *dsp.ratio(old, new)) for new in rates]
    return f"""rates AS (SELECT * FROM (VALUES {", ".join(map(str, terms))}) AS r(rate, up, down, reach)),
taps AS (
  SELECT rate, phase, j, (j - phase / up) * least(1.0, up / down) AS d
  FROM (SELECT *, unnest(range(1 - reach, reach + 1)) AS j FROM (SELECT *, unnest(range(0, up)) AS phase FROM rates))),
raw AS (
  SELECT rate, phase, j, CASE WHEN abs(d) < {dsp.CROSSINGS} THEN CASE WHEN d = 0 THEN 1.0 ELSE sin(pi() * d) / (pi() * d) END * pow(cos(pi() * d / {2 * dsp.CROSSINGS}), 2) ELSE 0.0 END AS w FROM taps),
bank AS (SELECT rate, phase, j, w / sum(w) OVER (PARTITION BY rate, phase) AS w FROM raw),
places AS (
  SELECT clip_id, rate, m, m * down // up AS base, m * down % up AS phase
  FROM (SELECT clip_id, rate, up, down, unnest(range(0, CAST(ceil(n * up / down) AS BIGINT))) AS m FROM (SELECT DISTINCT clip_id, n FROM sig), rates)),
made AS (
  SELECT p.clip_id, p.rate, m, sum(w * x) AS x FROM places p JOIN bank b ON b.rate = p.rate AND b.phase = p.phase JOIN sig s ON s.clip_id = p.clip_id AND s.i = base + j
  GROUP BY p.clip_id, p.rate, m)"""


@query(f"WITH {SIG_L}, {sql_resampled(SMALL['sr'], RATES)} SELECT clip_id, rate, m AS i, {s6('x')} AS x FROM made", ints="rate")
def resample_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips brought to other rates by polyphase filters, chunk by chunk."""
    rows = chunks.of_rows(signal_l(spark, sf_dir), CHUNK_L)
    made = [chunks.samples_of(chunks.resample(rows, SMALL["sr"], new, CHUNK_L)).withColumn("rate", F.lit(new)) for new in RATES]
    return made[0].unionByName(made[1]).select("clip_id", "rate", "i", r6("x").alias("x"))


ONE = SIG_L.replace("SELECT l_suppkey AS clip_id", "SELECT 0 AS clip_id").replace("PARTITION BY l_suppkey ORDER BY", "ORDER BY l_suppkey,").replace("PARTITION BY l_suppkey", "")


@query(f"WITH {ONE},\n{sql_frames(FRAME_L, HOP_L)},\n{sql_stats(FRAME_L)},\n{sql_latch(LIMITS_L)}\n{sql_segments(FRAME_L, HOP_L)}".replace("AS INTEGER) AS seg", "AS BIGINT) AS seg"), ints="clip_id")
def vad_one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as one series, which many tasks order, latch and cut into segments."""
    order = ["l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]
    rows = table(spark, sf_dir, "lineitem").withColumn("clip", F.lit(0))
    signal = scans.ordered(rows, "clip", order, (F.col("l_extendedprice") - 50000) / 30000)
    return scans.detect(signal, FRAME_L, HOP_L, LIMITS_L, RANGE_L)


#: Share of the average that a sample leaves; no short fraction, so that no sum ends halfway between two roundings.
KEEP = 0.9048374180359595


@query(f"WITH {SIG_L} SELECT a.clip_id, a.i, {s6(f'sum({1 - KEEP!r} * pow({KEEP!r}, a.i - b.i) * b.x)')} AS ema FROM sig a JOIN sig b ON a.clip_id = b.clip_id AND b.i <= a.i GROUP BY a.clip_id, a.i", ints="i")
def running_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving average after every sample, by ranges of 64."""
    return scans.running_average(signal_l(spark, sf_dir), keep=KEEP, size=64).select("clip_id", "i", r6("ema").alias("ema"))


#: Rates and widths of the clips of events, by their number.
WAV_RATES, WAV_WIDTHS = (8000, 16000, 44100), (8, 16, 24, 32)


@query(f"""WITH {SIG_E},
own AS (SELECT clip_id, i, n, x / 5 AS x, [8000, 16000, 44100][clip_id % 3 + 1] AS sr, [8, 16, 24, 32][clip_id % 4 + 1] AS width, clip_id % 2 + 1 AS channels FROM sig),
whole AS (SELECT *, pow(2, width - 1) AS k, greatest(-1.0, least(1.0, x)) AS a, greatest(-1.0, least(1.0, -x / 2)) AS b FROM own)
SELECT clip_id, sr, channels, width, n, i // 32 * 32 AS start, i,
  {s6('CASE WHEN channels = 1 THEN round_even(a * (k - 1), 0) / k ELSE (round_even(a * (k - 1), 0) + round_even(b * (k - 1), 0)) / 2 / k END')} AS x FROM whole""", ints="sr channels width")
def wav_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of several rates, widths and channels, written as files and read again in chunks of 32 frames."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("clip_id") % n + 1).cast("int"))
    y = F.transform("y", lambda v: v / 5)
    channels = F.when(F.col("clip_id") % 2 == 0, F.array(y)).otherwise(F.array(y, F.transform("y", lambda v: -v / 10)))
    clips = clips_e(spark, sf_dir).select(F.concat(F.lit("of-events/"), "clip_id", F.lit(".wav")).alias("name"), pick(WAV_RATES, 3).alias("sr"), pick(WAV_WIDTHS, 4).alias("width"), channels.alias("y"))
    wav.register(spark)
    folder = shared_folder(spark, "wav")
    clips.write.format("wav").mode("append").save(folder)
    back = spark.read.format("wav").schema(wav.SCHEMA.replace("float", "double")).option("chunk", 32).load(folder)
    rows = back.select(F.regexp_extract("filepath", r"(\d+)\.wav$", 1).cast("long").alias("clip_id"), "sr", "channels", "width", "n", "start", F.posexplode("y").alias("j", "x"))
    return rows.select("clip_id", "sr", "channels", "width", "n", "start", (F.col("start") + F.col("j")).alias("i"), r6("x").alias("x"))


#: The query that entry() runs.
FLAGSHIP = "vad_segments"
