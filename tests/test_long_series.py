"""Series and clips that many tasks share, against the same done whole; WAV files as a data source."""

from __future__ import annotations

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import dsp
from cadenza.operators import activity, batching, chunks, framing, mergeable, scans
from cadenza.session import ROCKSDB
from cadenza.sources import wav
from cadenza.streaming.activity import idle_segments, read_frames

rng = np.random.default_rng(4)
WEIRD = activity.Thresholds(0.5, 0.9, 0.3, 0.5)  # a frame may begin and end activity


@pytest.fixture(scope="module")
def series(spark):
    """Clips of many lengths, one of them most of all rows, as rows in no order."""
    rows = [(c, int(t), float(x)) for c, n in ((1, 5000), (2, 16), (3, 3), (None, 64), (4, 1), (5, 129)) for t, x in enumerate(np.repeat(rng.choice([0.1, 2.0], n), 7)[:n] * rng.normal(size=n))]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[k] for k in order], "id int, t int, v double").repartition(5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_order_by_ranges(spark, series):
    whole = framing.signal_from(series, "id", ["t"], F.col("v")).select("clip_id", "i", "x", F.col("n").cast("long"))
    assert rows_of(scans.ordered(series, "id", ["t"], F.col("v")).select("clip_id", F.col("i").cast("int"), "x", "n")) == rows_of(whole)


@pytest.mark.parametrize("limits", [activity.Thresholds(1.5, 0.8, 0.63, 0.42), WEIRD])
@pytest.mark.parametrize("size", [8, 64, 4096])
def test_activity_by_ranges(spark, series, size, limits):
    signal = framing.signal_from(series, "id", ["t"], F.col("v")).cache()
    stats = activity.frame_statistics(signal, 16, 4).cache()
    assert rows_of(scans.frame_statistics(signal, 16, 4, size).select(*(F.round(c, 9) if c in ("ste", "zcr") else c for c in stats.columns))) == rows_of(stats.select(*(F.round(c, 9) if c in ("ste", "zcr") else c for c in stats.columns)))
    latched = activity.latch(stats, limits).cache()
    assert rows_of(scans.latch(stats, limits, size)) == rows_of(latched)
    want = rows_of(activity.segments(latched, 16, 4))
    assert rows_of(scans.segments(latched, 16, 4, size)) == want and len(want) > 20
    assert rows_of(scans.detect(signal, 16, 4, limits, size)) == want


@pytest.mark.parametrize("keep,size", [(0.9, 64), (0.9, 4096), (0.5, 4096), (0.9999, 16), (0.999, 7), (1e-3, 100)])
def test_running_average(spark, series, keep, size):
    got = {}
    for r in scans.running_average(framing.signal_from(series, "id", ["t"], F.col("v")), keep=keep, size=size).collect():
        got.setdefault(r.clip_id, {})[r.i] = (r.x, r.ema)
    for values in got.values():
        e = 0.0
        for i in range(len(values)):
            e = keep * e + (1 - keep) * values[i][0]
            assert values[i][1] == pytest.approx(e, rel=1e-9, abs=1e-12)


def clips(spark, lengths, size):
    y = {k: rng.normal(size=n) for k, n in enumerate(lengths)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in y.items()] + [(99, None), (98, [])], "clip_id int, y array<double>")
    return y, chunks.of_arrays(rows, size=size)


def joined(rows):
    """Whole clips of their chunks."""
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r.start):
        have = out.setdefault(r.clip_id, [])
        assert r.start == len(have)
        have += r.y
        out.setdefault(("n", r.clip_id), r.n)
    return {k: np.array(v) for k, v in out.items() if not isinstance(k, tuple)}, {k[1]: v for k, v in out.items() if isinstance(k, tuple)}


LENGTHS = (1, 31, 64, 127, 128, 129, 256, 300, 640, 1000)


def test_chunks_and_halos(spark):
    y, rows = clips(spark, LENGTHS, 128)
    whole, n = joined(rows)
    assert all((whole[k] == v).all() and n[k] == len(v) for k, v in y.items()) and len(whole) == len(y)
    for left, right in ((0, 0), (5, 9), (128, 128), (0, 3)):
        for r in chunks.with_halo(rows, left, right, 128).collect():
            v = np.pad(y[r.clip_id], (left, right))
            assert r.y == v[r.start : r.start + left + min(128, r.n - r.start) + right].tolist()
    with pytest.raises(ValueError):
        chunks.with_halo(rows, 129, 0, 128)


def test_spectra_by_chunks(spark):
    y, rows = clips(spark, LENGTHS, 128)
    got = {}
    for r in chunks.stft(rows, 64, 16, 48, 128).collect():
        got.setdefault(r.clip_id, {})[r.f] = np.array(r.re) + 1j * np.array(r.im)
    for k, v in y.items():
        want = dsp.stft(v, 64, 16, 48)
        assert sorted(got[k]) == list(range(want.shape[1]))
        assert np.abs(np.stack([got[k][f] for f in range(want.shape[1])], axis=1) - want).max() < 1e-12


def test_denoising_by_chunks(spark):
    y, rows = clips(spark, LENGTHS, 128)
    got, n = joined(chunks.denoise(rows, 1600, 64, 16, 64, 0.2, 1.0, 128))
    for k, v in y.items():
        want = dsp.subtract_noise(v, 1600, 64, 16, 64, 0.2, 1.0)
        assert len(want) == len(got.get(k, [])) and (not len(want) or np.abs(got[k] - want).max() < 1e-10) and n.get(k, 0) == len(want)


def test_gammatone_coefficients_by_chunks(spark):
    y, rows = clips(spark, (1, 15, 16, 17, 400, 511, 512, 513, 2000), 512)
    got = {}
    for r in chunks.gfcc(rows, 1600, 6, 8, 16 / 1600, 4 / 1600, 50, 512).collect():
        got.setdefault(r.clip_id, {})[r.f] = r.c
    for k, v in y.items():
        want = dsp.gfcc(v, 1600, 6, 8, 16 / 1600, 4 / 1600, 50)
        assert sorted(got[k]) == list(range(len(want))) and np.abs(np.array([got[k][f] for f in range(len(want))]) - want).max() < 1e-6


@pytest.mark.parametrize("old,new", [(1600, 1000), (1600, 2400), (44100, 16000), (7, 5), (1600, 1600)])
def test_resampling_by_chunks(spark, old, new):
    y, rows = clips(spark, LENGTHS, 128)
    got, n = joined(chunks.resample(rows, old, new, 128))
    for k, v in y.items():
        want = dsp.resample(v, old, new)
        assert len(want) == len(got[k]) == n[k] == -(-len(v) * new // old) and np.abs(got[k] - want).max() < 1e-12


def test_long_clip_of_many_chunks(spark):
    """Millions of samples in one clip: no row is longer than a chunk with its halo, and nothing differs at the borders."""
    n, size = 3_000_000, 1 << 16
    x = np.sin(np.arange(n) * 0.05) * np.repeat(rng.uniform(0, 1, n // 1000), 1000) + 0.05 * np.sin(np.arange(n) ** 2 * 1e-3)
    rows = spark.range(-(-n // size)).selectExpr("0 AS clip_id", "id AS chunk", f"id * {size} AS start", f"cast({n} AS bigint) AS n")
    cell = lambda p: np.sin(np.arange(p, min(p + size, n)) * 0.05)  # noqa: E731, F841

    def fill(batches):
        for b in batches:
            b["y"] = [x[s : s + size] for s in b["start"]]
            yield b

    rows = rows.mapInPandas(fill, "clip_id int, chunk long, start long, n long, y array<double>")
    out = chunks.denoise(rows)
    assert out.agg(F.max(F.size("y"))).first()[0] <= size and out.rdd.getNumPartitions() > 1
    got = joined(out)[0][0]
    assert np.abs(got - dsp.subtract_noise(x, 16000, 1024, 256, 1024, 0.2, 1.0)).max() < 1e-9


def test_resampling_keeps_tones():
    t = np.arange(44100)
    for old, new in ((44100, 16000), (16000, 44100), (8000, 8001)):
        tone = np.sin(2 * np.pi * 440 * t / old)
        out = dsp.resample(tone, old, new)
        assert len(out) == -(-len(tone) * new // old)
        want = np.sin(2 * np.pi * 440 * np.arange(len(out)) / new)
        assert np.abs(out - want)[200:-200].max() < 2e-3
    assert np.abs(dsp.resample(np.sin(2 * np.pi * 7900 * t / 16000), 16000, 8000)[200:-200]).max() < 0.01  # what the new rate can't hold goes
    assert dsp.resample(np.ones(100), 3, 7)[50] == pytest.approx(1)


def riff(sr=8000, channels=1, width=16, tag=1, raw=b"\0\0", extra=b"", size=None):
    about = struct.pack("<HHIIHH", tag, channels, sr, sr * channels * width // 8, channels * width // 8, width)
    if tag == 0xFFFE:
        about += struct.pack("<HHIH14s", 22, width, 0, 1, b"\0" * 14)
    return b"RIFF\0\0\0\0WAVE" + extra + b"fmt " + struct.pack("<I", len(about)) + about + b"data" + struct.pack("<I", len(raw) if size is None else size) + raw


@pytest.mark.parametrize("width", [8, 16, 24, 32])
@pytest.mark.parametrize("channels", [1, 2, 3])
def test_wav_bytes(width, channels):
    y = rng.uniform(-1.2, 1.2, (101, channels))
    data = wav.encoded(y, 22050, width)
    with wave.open(io.BytesIO(data)) as f:
        assert (f.getsampwidth(), f.getnchannels(), f.getframerate(), f.getnframes()) == (width // 8, channels, 22050, 101)
    h = wav.header(io.BytesIO(data), len(data))
    assert (h.sr, h.channels, h.width, h.n) == (22050, channels, width, 101) and struct.unpack("<I", data[4:8])[0] == len(data) - 8
    assert np.abs(wav.samples(data[h.at : h.at + h.n * h.frame], h) - np.clip(y, -1, 1)).max() <= 1.6 / 2 ** (width - 1)


def test_wav_headers():
    x = np.arange(-4, 4).astype("<f4") / 4
    cases = [riff(tag=3, width=32, raw=x.tobytes()), riff(tag=0xFFFE, raw=b"\0\x40" * 8), riff(extra=b"LIST\x03\0\0\0abc\0", raw=b"\0\x40" * 8), riff(raw=b"\0\x40" * 8, size=0xFFFFFFFF)]
    for k, data in enumerate(cases):
        h = wav.header(io.BytesIO(data), len(data))
        got = wav.samples(data[h.at : h.at + h.n * h.frame], h)[:, 0]
        assert (got == (x if k == 0 else 0.5)).all() and h.n == 8
    for bad in (b"", b"RIFF", riff(tag=85), riff(width=12), riff(channels=0), b"RIFF\0\0\0\0WAVEdata\0\0\0\0", riff()[:36]):
        with pytest.raises((ValueError, struct.error)):
            wav.header(io.BytesIO(bad), len(bad))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("wav")
    wav.register(spark)
    rows = [(f"d{k % 3}/{k}.wav", [8000, 16000][k % 2], (np.arange(k * 50) % 100 / 100).tolist()) for k in range(12)]
    clips = spark.createDataFrame([*rows, ("none.wav", 8000, None)], "name string, sr int, y array<double>").repartition(4)
    clips.write.format("wav").mode("append").save(f"file://{root}")
    return root, rows


def test_wav_source(spark, folder):
    root, rows = folder
    assert not [p for p in root.iterdir() if p.name.startswith("_")]
    got = {r.filepath.removeprefix(f"file://{root}/"): r for r in spark.read.format("wav").load(f"file://{root}").collect()}
    assert set(got) == {r[0] for r in rows} | {"none.wav"}
    for name, sr, y in rows:
        r = got[name]
        assert (r.sr, r.channels, r.width, r.n, r.start) == (sr, 1, 16, len(y), 0) and np.abs(np.array(r.y) - y).max(initial=0) < 1e-4
    assert got["none.wav"].n == 0 and got["none.wav"].y == []
    for path in (f"{root}", f"{root}/d1", f"file://{root}/d?/1*.wav", f"{root}/d1/1.wav"):
        want = {f"{root}/{r[0]}" for r in rows if "/1" in r[0] or "?" not in path} | {f"{root}/none.wav"}
        found = {r.filepath.removeprefix("file://") for r in spark.read.format("wav").load(path).select("filepath").collect()}
        assert found and found <= want


def test_wav_chunks_share_a_file(spark, folder):
    root, rows = folder
    read = spark.read.format("wav").option("chunk", 64).option("split_bytes", 256)
    part = read.load(f"{root}/d2/11.wav")
    assert part.rdd.getNumPartitions() == 5 and sorted(r.start for r in part.collect()) == list(range(0, 550, 64))
    for size in (256, 1 << 20):
        all_rows = spark.read.format("wav").option("chunk", 64).option("split_bytes", size).load(str(root))
        whole, n = joined(chunks.of_files(all_rows, 64).withColumn("clip_id", F.regexp_extract("clip_id", r"(\d+)\.wav", 1).cast("int")))
        for k in range(1, 12):
            assert n[k] == len(whole[k]) == 50 * k and np.abs(whole[k] - rows[k][2]).max() < 1e-4


def test_wav_conditions_reach_the_headers(spark, folder):
    root, rows = folder
    some = spark.read.format("wav").schema("n long, sr int, filepath string").load(str(root)).where("sr = 16000 AND n > 300 AND n <= 500 AND filepath LIKE '%.wav'")
    assert {(r.n, r.sr) for r in some.collect()} == {(len(y), sr) for _, sr, y in rows if sr == 16000 and 300 < len(y) <= 500}
    left = list(wav.WavReader({"path": str(root)}, some.schema).pushFilters([wav.ds.EqualTo(("sr",), 16000), wav.ds.EqualTo(("y",), 1), wav.ds.In(("n",), (1, 2))]))
    assert [type(f) for f in left] == [wav.ds.EqualTo]
    reader = wav.WavReader({"path": str(root)}, some.schema)
    list(reader.pushFilters([wav.ds.StringEndsWith(("filepath",), "/7.wav")]))
    assert sum(len(p.parts) for p in reader.partitions()) == 1  # other files aren't opened


def test_wav_channels_and_broken_files(spark, tmp_path):
    wav.register(spark)
    y = [[0.5, 0.25, -1.0], [0.0, -0.25, 1.0]]
    spark.createDataFrame([("a.wav", y)], "name string, y array<array<double>>").write.format("wav").option("sr", 8000).option("width", 24).mode("append").save(str(tmp_path))
    read = spark.read.format("wav")
    r = read.schema("channels int, y array<array<double>>").load(str(tmp_path)).first()
    assert r.channels == 2 and np.abs(np.array(r.y) - y).max() < 1e-6
    assert np.abs(np.array(spark.read.format("wav").load(str(tmp_path)).first().y) - np.mean(y, axis=0)).max() < 1e-6
    read = spark.read.format("wav")
    (tmp_path / "b.wav").write_bytes(b"nothing")
    (tmp_path / "_c.wav").write_bytes(b"hidden")
    with pytest.raises(Exception, match="not a WAV file"):
        spark.read.format("wav").load(str(tmp_path)).collect()
    got = spark.read.format("wav").option("mode", "PERMISSIVE").load(str(tmp_path)).collect()
    assert {(r.filepath[-5:], r.n) for r in got} == {("a.wav", 3), ("b.wav", None)}
    assert spark.read.format("wav").load(str(tmp_path / "d" / "..")).schema["n"].dataType.typeName() == "long"
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("wav").load(str(tmp_path / "none")).collect()


def test_wav_writes_are_whole_or_not_at_all(spark, tmp_path):
    wav.register(spark)
    rows = lambda *names: spark.createDataFrame([(n, [0.1] * k) for k, n in enumerate(names, 1)], "name string, y array<double>").repartition(2)
    save = lambda df, mode="append": df.write.format("wav").option("sr", 8000).mode(mode).save(str(tmp_path))
    there = lambda: sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not str(p.relative_to(tmp_path)).startswith("_"))
    save(rows("a.wav", "b/c.wav"))
    for bad in (rows("d.wav", "../e.wav"), rows("d.wav", None), rows("d.wav", "/e.wav"), rows("d.wav", "d.wav"), rows("d.wav", "a.wav")):
        with pytest.raises(Exception, match="name"):
            save(bad)
        assert there() == ["a.wav", "b/c.wav"]
    save(rows("z.wav"), "overwrite")
    assert there() == ["z.wav"]
    with pytest.raises(Exception, match="need name"):
        spark.range(1).write.format("wav").mode("append").save(str(tmp_path))


def test_a_stored_batch_is_read_alone(spark, tmp_path):
    rows = batching.batches(spark.range(1000).withColumnRenamed("id", "k"), "k", 32, 5, 2)
    batching.store(rows, str(tmp_path / "one"))
    batching.store(rows, str(tmp_path / "eight"), 8)
    whole = {(r.batch, r.slot): r.k for r in rows.collect()}
    for path, per in (("one", 1), ("eight", 8)):
        assert {(r.batch, r.slot): r.k for r in batching.stored(spark, str(tmp_path / path)).collect()} == whole
        step = batching.stored(spark, str(tmp_path / path), 17, per)
        got = {(r.batch, r.slot): r.k for r in step.collect()}
        assert got == {k: v for k, v in whole.items() if k[0] == 17}
        plan = step._jdf.queryExecution().executedPlan()
        scan = plan.collectLeaves().head()
        assert scan.metrics().apply("numOutputRows").value() <= 32 * per and scan.metrics().apply("numFiles").value() == 1


def test_idle_clips_are_closed(spark, tmp_path):
    """Frames out of order, late and missing; clips that end are told by a length, by silence, or not yet."""
    loud, quiet = (2.0, 0.0), (0.0, 0.0)
    rows = []
    frame = lambda clip, f, v, s, n=None: rows[-1].append((clip, n, f, *v, s))
    rows.append([])
    for f in (0, 1, 3, 2, 5):
        frame("gap", f, loud if f in (1, 2, 3, 5) else quiet, f)  # frame 4 never comes
    frame("known", 1, quiet, 1, 24)
    frame("open", 0, loud, 2)
    rows.append([])
    frame("known", 0, loud, 0)
    frame("known", 2, loud, 2)
    frame("open", 1, loud, 5000)
    rows.append([])
    frame("open", 2, loud, 5001)
    frame("gap", 6, loud, 9)  # too late: the clip is closed, and the row behind the watermark
    feed, out = f"file://{tmp_path}/feed", f"file://{tmp_path}/out"
    schema = "clip_id string, n int, f int, ste double, zcr double, s int"
    typed = lambda part: spark.createDataFrame(part, schema).selectExpr("clip_id", "n", "f", "ste", "zcr", "timestamp_seconds(s + 100000) AS at")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        for part in rows:
            typed(part).coalesce(1).write.mode("append").parquet(feed)
            found = idle_segments(read_frames(typed(part), feed, 1), 16, 4, activity.Thresholds(1.5, 0.8, 0.63, 0.42), "2 minutes", "1 minute")
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
            got = {tuple(r) for r in spark.read.schema(found.schema).parquet(out).collect()}
            if part is rows[0]:
                assert got == set()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    # the gap keeps the state on: one run of frames 1 to 5; known: frames 0 and 2, cut at the clip's end
    assert got == {("gap", 4, 40), ("known", 0, 20), ("known", 8, 24)}


def test_frames_that_wait_are_kept_in_blocks():
    """Frames whose turn it is never go to the state; others go there a block at a time, and only blocks whose turn it is are read."""
    import pandas as pd

    from cadenza.streaming.activity import BLOCK, IdleClips

    class Value:
        kept = None

        def get(self):
            return self.kept

        def update(self, v):
            self.kept = v

        def clear(self):
            self.kept = None

    class Map(dict):
        calls = 0

        def containsKey(self, k):
            self.calls += 1
            return k in self

        def getValue(self, k):
            self.calls += 1
            return self[k]

        def updateValue(self, k, v):
            self.calls += 1
            self[k] = v

        def removeKey(self, k):
            self.calls += 1
            self.pop(k, None)

        def iterator(self):
            return iter(self.items())

    class Handle:
        def registerTimer(self, t):
            pass

        deleteTimer = registerTimer

    clips = IdleClips(16, 4, activity.Thresholds(1.5, 0.8, 0.63, 0.42), 1000)
    clips.run, clips.waiting, clips.handle = Value(), Map(), Handle()
    voiced = [f % 7 < 3 for f in range(3 * BLOCK)]
    frame = lambda f: (f, None, 2.0 if voiced[f] else 0.1, 0.0, pd.Timestamp(100 + f, unit="s"))
    got = []
    for places in (range(1, 3 * BLOCK, 2), range(0, BLOCK, 2), range(BLOCK, 3 * BLOCK, 2)):
        part = pd.DataFrame([frame(f) for f in places], columns=["f", "n", "ste", "zcr", "at"])
        got += [tuple(map(int, r)) for found in clips.handleInputRows((5,), iter([part]), None) for r in found.itertuples(index=False)]
    got += [tuple(map(int, r)) for found in clips.handleExpiredTimer((5,), None, None) for r in found.itertuples(index=False)]
    starts = [f for f in range(3 * BLOCK) if voiced[f] and (f == 0 or not voiced[f - 1])]
    assert got == [(5, 4 * a, 4 * min(a + 3, 3 * BLOCK) + 16) for a in starts] and not clips.waiting and clips.run.kept is None
    assert clips.waiting.calls < 40


def test_moments_of_deliveries(spark, tmp_path, monkeypatch):
    """Two deliveries equal one pass; a failed or repeated one counts once or not at all; large offsets lose nothing."""
    values = 1e9 + rng.normal(size=400)
    rows = spark.createDataFrame([(int(k) % 3 if k % 10 else None, float(v) if k % 7 else None, int(k)) for k, v in enumerate(values)], "key int, c double, i int")
    kept = mergeable.Kept(spark, f"file://{tmp_path}/m", ["key"])
    assert kept.read() is None
    first, second = (mergeable.moments(rows.where(w), ["key"]) for w in ("i < 150", "i >= 150"))
    kept.deliver(first, "a/b")
    with monkeypatch.context() as m:
        m.setattr(kept, "_files", lambda below, f=kept._files: (_ for _ in ()).throw(RuntimeError("lost")) if "=" in below else f(below))
        with pytest.raises(RuntimeError):
            kept.deliver(second, "c")
    assert {r.key: r.n for r in kept.read().collect()} == {r.key: r.n for r in first.collect()}
    kept.deliver(mergeable.moments(rows.limit(0), ["key"]), "empty")
    kept.deliver(second, "c")
    kept.deliver(second, "c")
    for r in kept.read().collect():
        own = np.array([v for k, v in enumerate(values) if k % 7 and (k % 3 if k % 10 else None) == r.key])
        assert (r.n, r.mean) == (len(own), pytest.approx(own.mean(), rel=1e-15)) and r.m2 / r.n == pytest.approx(own.var(), rel=1e-6)
    kept.drop_versions()
    assert sorted(kept.versions().values()) == ["a/b", "c", "empty"] and kept.read().count() == 4
    out = mergeable.standardised(rows, kept.read(), ["key"]).where("key is null and c is not null")
    assert abs(out.agg(F.avg("c")).first()[0]) < 1e-5 and out.agg(F.stddev_pop("c")).first()[0] == pytest.approx(1, rel=1e-4)
