"""Framing, activity and coefficient series against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from cadenza.functions import arrays
from cadenza.operators import activity, batching, framing, labels, metrics, series, spectral


def clips(spark, signals: dict):
    rows = [(k, i, float(x), len(v)) for k, v in signals.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "clip_id string, i int, x double, n int")


def frames(y: list[float], length: int, hop: int) -> list[list[float]]:
    if len(y) < length:
        return [y + [0.0] * (length - len(y))]
    return [y[a : a + length] for a in range(0, len(y) - length + 1, hop)]


rng = random.Random(5)
SIGNALS = {
    "short": [0.5, -0.5, 0.25],
    "one": [1.0],
    "exact": [rng.uniform(-1, 1) for _ in range(8)],
    "tail": [rng.uniform(-1, 1) for _ in range(30)],
    "zeros": [0.0] * 20,
    "alternating": [(-1.0) ** i for i in range(21)],
    "bursts": [0.0] * 16 + [1.0, -1.0] * 9 + [0.0] * 11 + [2.0] * 9 + [0.0] * 20,
    "noise": [rng.gauss(0, 0.6) for _ in range(200)],
}


@pytest.mark.parametrize(("length", "hop"), [(8, 4), (8, 3), (5, 8), (1, 1)])
def test_frames_and_statistics(spark, length, hop):
    signal = clips(spark, SIGNALS)
    got: dict = {}
    for r in framing.frame_signal(signal, length, hop).collect():
        got.setdefault(r.clip_id, {}).setdefault(r.f, {})[r.j] = r.x
    stats = {(r.clip_id, r.f): (r.ste, r.zcr) for r in activity.frame_statistics(signal, length, hop).collect()}
    for k, y in SIGNALS.items():
        want = frames(y, length, hop)
        assert [[got[k][f][j] for j in range(length)] for f in range(len(want))] == want and len(got[k]) == len(want)
        for f, frame in enumerate(want):
            crossings = sum(a * b < 0 for a, b in zip(frame, frame[1:]))
            assert stats[k, f] == pytest.approx((sum(v * v for v in frame) / length, crossings / max(1, length - 1)))


def segments(stats, n, length, hop, t):
    on, runs, start = False, [], 0
    for f, (e, z) in enumerate([*stats, (None, None)]):
        if e is None:
            now = False
        elif on:
            now = not (e < t.energy_lo and z < t.zcr_lo)
        else:
            now = e > t.energy_hi or z > t.zcr_hi
        if now and not on:
            start = f
        if on and not now:
            runs.append((start * hop, min(n, start * hop + (f - start) * hop + length)))
        on = now
    return runs


@pytest.mark.parametrize("limits", [activity.Thresholds(0.4, 0.2, 0.6, 0.3), activity.Thresholds(0.2, 0.6, 0.3, 0.7), activity.Thresholds(0.0, 0.0, 0.0, 0.0)])
def test_segments(spark, limits):
    signal = clips(spark, SIGNALS)
    stats: dict = {}
    for r in activity.frame_statistics(signal, 8, 4).orderBy("clip_id", "f").collect():
        stats.setdefault(r.clip_id, []).append((r.ste, r.zcr))
    want = {(k, *s) for k, y in SIGNALS.items() for s in segments(stats[k], len(y), 8, 4, limits)}
    assert {tuple(r) for r in activity.detect(signal, 8, 4, limits).collect()} == want
    merged = activity.detect(signal, 8, 4, limits, merge=True).orderBy("clip_id", "seg_start").collect()
    for a, b in zip(merged, merged[1:]):
        assert a.clip_id != b.clip_id or a.seg_end < b.seg_start
    covered = lambda segs: {(k, i) for k, a, b in segs for i in range(a, b)}
    assert covered(map(tuple, merged)) == covered(want)


def test_empty_signal(spark):
    assert activity.detect(clips(spark, {}), 8, 4, activity.Thresholds()).count() == 0


def test_threshold_is_strict(spark):
    signal = clips(spark, {"a": [1.0] * 8})
    assert activity.detect(signal, 8, 4, activity.Thresholds(1.0, 0.5, 0.5, 0.1)).count() == 0


def test_deltas(spark):
    rows = [("ramp", f, 0, 2.0 * f) for f in range(12)] + [("flat", f, 0, 3.0) for f in range(9)] + [("few", f, 0, 1.0) for f in range(8)] + [("square", f, 0, float(f * f)) for f in range(15)]
    table = spark.createDataFrame(rows, "clip_id string, f int, k int, c double")
    one = {(r.clip_id, r.f): r.c for r in series.delta(table).collect()}
    assert all(one["ramp", f] == pytest.approx(2) for f in range(12)) and all(one["flat", f] == pytest.approx(0) for f in range(9))
    assert all(one["few", f] is None for f in range(8))
    assert [one["square", f] for f in range(15)] == pytest.approx([8] * 5 + [2.0 * f for f in range(5, 10)] + [20] * 5)
    two = {(r.clip_id, r.f): r.c for r in series.delta(table, 2).collect()}
    assert all(two["square", f] == pytest.approx(2) for f in range(15))
    stacked = series.stack_deltas(table, 1, True, True)
    assert {r.k for r in stacked.select("k").distinct().collect()} == {0, 1, 2}
    assert series.stack_deltas(table, 1, False, False).count() == len(rows)


def test_deltas_read_a_series_once(spark):
    """Gaps take the nearest delta before them, or else the series' first; no frame is read anew for each row up to the end."""
    c = [None, None, *(float(f * f) for f in range(2, 30))]
    c[15] = None
    table = spark.createDataFrame([("a", f, 0, v) for f, v in enumerate(c)] + [("b", f, 0, None) for f in range(9)], "clip_id string, f int, k int, c double")
    d = [None if f < 4 or f > 25 or None in (window := c[f - 4 : f + 5])[:4] + window[5:] else sum((m - 4) * v for m, v in enumerate(window) if m != 4) / 60 for f in range(30)]
    want = [next((x for x in reversed(d[: f + 1]) if x is not None), next((x for x in d if x is not None), None)) for f in range(30)]
    for rows in (series.delta(table), series.stack_deltas(table, 1).where("k = 1")):
        got = {(r.clip_id, r.f): r.c for r in rows.collect()}
        assert [got["a", f] for f in range(30)] == pytest.approx(want) and all(got["b", f] is None for f in range(9))
        assert "currentrow$(), unboundedfollowing$()" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()


def test_standardise_and_norm(spark):
    rows = [("a", f, 0, float(f)) for f in range(5)] + [("b", f, 0, 7.0) for f in range(3)]
    table = spark.createDataFrame(rows, "clip_id string, f int, k int, c double")
    got = {(r.clip_id, r.f): r.c for r in series.standardise(table).collect()}
    sd = math.sqrt(2)
    assert [got["a", f] for f in range(5)] == pytest.approx([(f - 2) / (sd + 1e-6) for f in range(5)])
    assert all(got["b", f] == 0 for f in range(3))
    clipped = [r.c for r in series.clip_norm(table, 1.0).where("clip_id = 'a'").collect()]
    assert math.sqrt(sum(c * c for c in clipped)) == pytest.approx(1, abs=1e-5)
    assert series.clip_norm(table, None).collect() == table.collect()


def test_transform_round_trip(spark):
    signal = clips(spark, {"a": [math.sin(2 * math.pi * 2 * i / 16) for i in range(64)]})
    bins = spectral.polar(spectral.dft(framing.frame_signal(signal, 16, 16), 16))
    peak = bins.where("f = 0").orderBy(F.desc("mag")).first()
    assert peak.k == 2 and peak.mag == pytest.approx(8)
    back = spectral.inverse_dft(bins, 16).orderBy("f", "j").collect()
    assert [r.x for r in back] == pytest.approx([r.x for r in signal.orderBy("i").collect()], abs=1e-12)


def test_batches(spark):
    rows = spark.range(101).withColumnRenamed("id", "k")
    whole = batching.batches(rows, "k", 10, 1, 2).collect()
    assert sorted(r.k for r in whole) == list(range(101)) and sorted(r.batch * 10 + r.slot for r in whole) == list(range(101))
    assert {r.k: r.batch for r in batching.batches(rows.repartition(7), "k", 10, 1, 2).collect()} == {r.k: r.batch for r in whole}
    assert batching.batches(rows, "k", 10, 1, 2, drop_last=True).count() == 100
    assert [r.k for r in batching.batches(rows, "k", 10, 1, 3).orderBy("batch", "slot").collect()] != [r.k for r in batching.batches(rows, "k", 10, 1, 2).orderBy("batch", "slot").collect()]


def test_sequential_batches(spark):
    rows = spark.range(101).select((100 - F.col("id")).alias("k")).repartition(7)
    assert all(r.k == r.batch * 10 + r.slot for r in batching.batches(rows, "k", 10, shuffle=False).collect())
    assert batching.batches(rows, "k", 10, drop_last=True, shuffle=False).agg(F.max("k")).first()[0] == 99


def test_wide_arrays(spark):
    """Class scores and norms of wide layers take time in proportion to their width."""
    wide = spark.range(200).select(F.transform(F.sequence(F.lit(0), F.lit(2047)), lambda i: (i % 7 + F.col("id")).cast("double")).alias("v"))
    row = wide.select(F.aggregate(arrays.softmax(F.col("v")), F.lit(0.0), lambda a, x: a + x).alias("s"), F.aggregate(arrays.layer_norm(F.col("v")), F.lit(0.0), lambda a, x: a + x * x).alias("n")).agg(F.max("s").alias("s"), F.max("n").alias("n")).first()
    assert row.s == pytest.approx(1) and row.n == pytest.approx(2048, rel=1e-3)


def test_labels(spark):
    rows = spark.createDataFrame([("b",), ("a",)], "label string")
    coded = labels.encode(rows, ["b", "a"])
    assert [r.label_id for r in coded.collect()] == [0, 1]
    assert [r.back for r in labels.decode(coded, ["b", "a"], out="back").collect()] == ["b", "a"]
    for bad in ("c", None):
        with pytest.raises(Exception, match="unknown label"):
            labels.encode(spark.createDataFrame([(bad,)], "label string"), ["b", "a"]).collect()


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1), (None, 1)], "y int, p int")
    row = metrics.macro_scores(metrics.confusion(rows, "y", "p")).first()
    assert row.macro_accuracy == pytest.approx((0.5 + 1 + 0) / 3) and row.macro_f1 == pytest.approx((2 / 3 + 2 / 4 + 0) / 3)
    scores = spark.createDataFrame([(0, 0.0), (1, 0.5), (2, 0.5)], "epoch int, macro_accuracy double")
    assert metrics.best_epoch(scores).first().epoch == 1
    assert metrics.best_epoch(scores.where("epoch = 0")).count() == 0


def test_array_functions(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0], 1)], "v array<double>, y int").select(
        arrays.softmax(F.col("v")).alias("p"), arrays.argmax_first(F.col("v")).alias("a"), arrays.cross_entropy(F.col("v"), F.col("y")).alias("e"),
        arrays.center_crop(F.col("v"), 5).alias("long"), arrays.center_crop(F.col("v"), 2).alias("short"), arrays.ema(F.col("v")).alias("ema"),
    ).first()
    z = [math.exp(v) for v in (1, 3, 3)]
    assert list(row.p) == pytest.approx([v / sum(z) for v in z]) and row.a == 1 and row.e == pytest.approx(-math.log(z[1] / sum(z)))
    assert row.long == [1, 3, 3, 0, 0] and row.short == [1, 3] and row.ema == pytest.approx(0.9 * (0.9 * 0.1 + 0.3) + 0.3)
    starts = spark.range(400).select(arrays.hashed_start(F.col("id"), F.lit(10), 7, 1, 0).alias("s")).distinct().collect()
    assert sorted(r.s for r in starts) == [0, 1, 2, 3]


@pytest.mark.parametrize("textbook", [False, True])
def test_cepstrum(spark, textbook):
    a = [1.0, 0.5, -0.25, 0.125]
    p, c = 3, [0.0]
    for n in range(1, 8):
        ks = range(1, n if textbook else min(n, p))
        s = sum(k / n * c[k] * a[n - k] for k in ks if n - k <= p)
        own = -a[n] if n <= p else 0
        c.append(own - s if textbook else own + s)
    got = spark.createDataFrame([(a,)], "a array<double>").select(arrays.cepstrum_of_prediction(F.col("a"), 8, textbook).alias("c")).first().c
    assert got == pytest.approx(c)


def test_streamed_segments(spark, tmp_path):
    """Frames in any order, the length in a closing row that may come first."""
    from cadenza.streaming.activity import read_frames, streamed_segments

    limits = activity.Thresholds(0.4, 0.2, 0.6, 0.3)
    signal = clips(spark, SIGNALS)
    stats = activity.frame_statistics(signal, 8, 4).select("clip_id", "n", "f", "ste", "zcr").cache()
    open_ended = stats.withColumn("n", F.lit(None).cast("int"))
    ends = stats.select("clip_id", "n").distinct().selectExpr("clip_id", "n", "CAST(NULL AS INT) AS f", "CAST(NULL AS DOUBLE) AS ste", "CAST(NULL AS DOUBLE) AS zcr")
    half = ends.where("clip_id < 'n'")
    for part in (half, open_ended.where("f % 3 = 2"), open_ended.where("f % 3 < 2"), ends.subtract(half)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    found = streamed_segments(read_frames(stats, f"{tmp_path}/feed"), 8, 4, limits)
    found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, activity.detect(signal, 8, 4, limits).collect()))
