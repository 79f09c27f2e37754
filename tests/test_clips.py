"""Whole-clip kernels, files, the model and the plans."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cadenza.functions import dsp
from cadenza.operators import activity, series
from cadenza.operators import sequence_model as sm
from cadenza.plans import features, predict, train
from cadenza.sources import audio, checkpoint, manifest
from cadenza.sources.config import Config, from_dict, read_config

rng = np.random.default_rng(2)


def test_transform_is_inverted():
    y = rng.normal(size=32077)
    back = dsp.istft(dsp.stft(y, 1024, 256, 1024), 1024, 256, 1024)
    assert len(back) == 32000 and np.abs(back - y[:32000]).max() < 1e-12


def test_noise_goes():
    noise = rng.normal(size=16000) * 0.1
    tone = np.where(np.arange(16000) > 8000, np.sin(2 * np.pi * 440 * np.arange(16000) / 16000), 0)
    quiet = dsp.subtract_noise(noise + tone, 16000, 1024, 256, 1024, 0.2, 1.0)
    assert np.std(quiet[4000:7000]) < 0.6 * np.std(noise) and np.std(quiet[9000:15000]) > 0.6


def test_filters():
    m = dsp.mel_filters(16000, 2048, 64, 50, 8000)
    assert m.shape == (64, 1025) and (m >= 0).all() and (m.max(axis=1) > 0).all()
    assert dsp.hertz(dsp.mel([50.0, 999, 1000, 7000])) == pytest.approx([50, 999, 1000, 7000])
    c = dsp.cosines(64, 64)
    assert np.abs(c @ c.T - np.eye(64)).max() < 1e-12
    centres = dsp.erb_centres(50, 8000, 64)[::-1]
    assert centres[0] == pytest.approx(50) and (np.diff(centres) > 0).all()


def test_gammatone_by_blocks():
    """Cut impulse responses stay within their bound of the whole filter, in groups of frames of any size."""
    for sr, bands, low, win, hop in ((8000, 6, 100.0, 200, 80), (16000, 64, 50.0, 400, 160)):
        y = rng.normal(size=30_001)
        taps, bound = dsp.gammatone_taps(sr, bands, low)
        n_fft = 1 << 16
        whole = np.fft.irfft(np.fft.rfft(y, n_fft) * np.fft.rfft(np.fft.irfft(dsp.gammatone_response(sr, bands, low, n_fft), n_fft)[:, : n_fft // 2], n_fft), n_fft)[:, : len(y)]
        assert bound < 1e-9 and taps.shape[1] < 8192
        last = (len(y) - win) // hop
        want = np.stack([np.sqrt((whole[:, f * hop : f * hop + win] ** 2).mean(axis=1)) for f in range(last + 1)], axis=1)
        for group in (1, 7, 64, 10_000):
            end = last if group > 1 else 40
            got = dsp.gammatone_levels(y, 0, end, 0, sr, bands, low, win, hop, group)
            assert np.abs(got - want[:, : end + 1]).max() < 1e-9


def test_gammatone_matches_recurrence():
    """The product of spectra equals four second-order sections run sample by sample."""
    sr, y = 8000, rng.normal(size=600)
    fc = dsp.erb_centres(100, sr / 2, 6)[::-1]
    n_fft = 2048
    response = dsp.gammatone_response(sr, 6, 100.0, n_fft)
    got = np.fft.irfft(np.fft.rfft(y, n_fft) * response, n_fft)[:, :600]
    for b, f in enumerate(fc):
        width, t, arg = 2 * np.pi * 1.019 * 24.7 * (4.37 * f / 1000 + 1), 1 / sr, 2 * np.pi * f / sr
        r, x, gain = np.exp(-width * t), y, 1.0
        z = np.exp(-1j * arg)
        for sign in (1, -1):
            for outer in (1, -1):
                top = (t, -t * r * (np.cos(arg) + sign * np.sqrt(3 + outer * 2**1.5) * np.sin(arg)))
                low = (1, -2 * np.cos(arg) * r, r * r)
                gain *= (top[0] + top[1] * z) / (low[0] + low[1] * z + low[2] * z * z)
                out = np.zeros(len(x))
                for i in range(len(x)):
                    at = lambda v, k, i=i: v[i - k] if i >= k else 0.0
                    out[i] = top[0] * x[i] + top[1] * at(x, 1) - low[1] * at(out, 1) - low[2] * at(out, 2)
                x = out
        want = x / abs(gain)
        assert np.abs(got[b] - want).max() < 1e-3 * np.abs(want).max()


def test_linear_prediction():
    x = np.zeros(4000)
    for i in range(2, len(x)):
        x[i] = 1.3 * x[i - 1] - 0.6 * x[i - 2] + rng.normal()
    a = dsp.burg(np.stack([x, np.zeros(4000)]), 2)
    assert a[0] == pytest.approx([1, -1.3, 0.6], abs=0.05) and a[1].tolist() == [1, 0, 0]


def test_resampling():
    t = np.arange(800) / 8000
    up = dsp.resample(np.sin(2 * np.pi * 200 * t), 8000, 16000)
    assert len(up) == 1600 and np.abs(up - np.sin(2 * np.pi * 200 * np.arange(1600) / 16000)).max() < 1e-6


def test_wav_files(spark, tmp_path):
    y = {f"d/{k}.wav": np.sin(np.arange(1600) * (k + 1) / 9).astype(np.float32) for k in range(3)}
    clips = spark.createDataFrame([(k, v.tolist()) for k, v in y.items()], "name string, y array<float>")
    audio.write_wav(clips, str(tmp_path))
    (tmp_path / "m.csv").write_text("label,filepath\n" + "".join(f"grunt,{k}\n" for k in y) + "grunt,none.wav\n")
    rows = manifest.read_manifest(spark, str(tmp_path / "m.csv"))
    assert rows.columns == ["filepath", "label"] and manifest.clip_count(rows) == 4
    got = {r.filepath: r.y for r in audio.read_clips(spark, rows, str(tmp_path)).collect()}
    assert got["none.wav"] is None
    assert all(np.abs(np.array(got[k]) - v).max() < 1e-4 for k, v in y.items())
    assert audio.read_wav(spark, str(tmp_path), 8000).select(F.size("y").alias("n")).distinct().first().n == 800


def test_wav_widths():
    import io
    import wave

    for width, raw in ((1, b"\x80\xff\x80\x00"), (3, b"\x00\x00\x40" * 4), (4, b"\x00\x00\x00\x40" * 4)):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(2)
            f.setsampwidth(width)
            f.setframerate(16000)
            f.writeframes(raw)
        y = audio.decode(out.getvalue(), 16000)
        assert len(y) == 2 and y == pytest.approx([0.496, -0.5] if width == 1 else [0.5, 0.5], abs=1e-3)


def test_empty_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text("filepath,label\n")
    assert manifest.read_manifest(spark, str(tmp_path / "m.csv")).count() == 0


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("data: {labels: [a, b], sr: 8000}\nfeatures: {delta_delta: true}\n")
    cfg = read_config(str(tmp_path / "c.yaml"))
    assert cfg.data.labels == ("a", "b") and cfg.data.samples == 16000 and cfg.features.dim == 174 and Config().features.dim == 116
    for bad in ({"other": {}}, {"data": {"rate": 1}}, {"preprocess": {"crop": "tail"}}):
        with pytest.raises(ValueError):
            from_dict(bad)


def test_parameters():
    sizes = sm.Shape(116).sizes()
    assert sum(int(np.prod(s)) for k, s in sizes.items() if k.startswith("lstm0")) == 2 * 512 * (116 + 128 + 1)
    assert sizes["project.w"] == (512, 256)


def test_gradients():
    shape = sm.Shape(3, 4, 2, 3)
    p = {k: v.astype(np.float64) for k, v in shape.new(1).items()}
    x, y = rng.normal(size=(5, 6, 3)), np.array([0, 1, 2, 1, 0])
    _, g = sm.loss_and_gradients(p, shape, x, y)
    for k in p:
        at = tuple(int(rng.integers(n)) for n in p[k].shape)
        ends = []
        for d in (1e-2, -1e-2):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += d
            ends.append(sm.loss_and_gradients(q, shape, x, y)[0])
        assert g[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-2, abs=2e-4)


def test_checkpoint(spark, tmp_path):
    shape = sm.Shape(3, 4, 1, 2)
    params = shape.new(0)
    checkpoint.save(spark, str(tmp_path / "m"), params, {"labels": ["a", "b"]})
    back, meta = checkpoint.load(spark, str(tmp_path / "m"), shape.sizes())
    assert meta["labels"] == ["a", "b"] and all((back[k] == params[k]).all() for k in params)
    with pytest.raises(ValueError):
        checkpoint.load(spark, str(tmp_path / "m"), sm.Shape(4, 4, 1, 2).sizes())


def settings(**more):
    raw = {
        "data": {"labels": ["low", "high"], "sr": 1600, "segment_sec": 0.3},
        "features": {"n_mfcc": 6, "n_mels": 12, "n_gfcc": 6, "n_filters": 12, "fmin": 20, "fmax": 800, "hop": 16, "win": 40},
        "train": {"batch_size": 8, "epochs": 6, "lr": 0.01, "workers": 1},
        "model": {"hidden_size": 8, "num_layers": 1},
        "preprocess": {"denoise": False},
    }
    return from_dict({k: raw.get(k, {}) | more.get(k, {}) for k in raw | more})


def tones(spark, n: int):
    rows = []
    for i in range(n):
        label = i % 2
        y = np.sin(2 * np.pi * (90 + 300 * label) * np.arange(520 + i) / 1600 + i) + 0.2 * rng.normal(size=520 + i)
        rows.append((f"c{i}", label, y.astype(float).tolist()))
    return spark.createDataFrame(rows, "clip_id string, label_id int, y array<double>")


def test_features(spark):
    clips = tones(spark, 2)
    for crop in ("head", "center", "random"):
        cfg = settings(preprocess={"crop": crop, "denoise": True, "noise_sec": 0.01})
        got = features.feature_table(clips, cfg).collect()
        # the shorter family decides how many frames there are: 1 + (480 - 40) // 16
        assert len(got) == 2 and all(len(r.x) == 28 and len(r.x[0]) == cfg.features.dim for r in got)
    x = np.array(got[0].x)
    assert np.abs(x.mean(axis=0)).max() < 1e-3
    cfg = settings(features={"lpcc": True, "lpc_order": 6, "n_lpcc": 5, "delta_delta": True}, preprocess={"vad": True})
    row = features.feature_table(clips, cfg).first()
    assert len(row.x[0]) == cfg.features.dim == 17 * 3


def test_active_parts(spark):
    """The samples inside the segments of activity, in order; a quiet clip stays whole."""
    cfg = settings(preprocess={"vad": True})
    loud = [np.concatenate([np.zeros(300), np.sin(np.arange(200)), np.zeros(900), np.sin(np.arange(90) * 2), np.zeros(200)]), np.zeros(400)]
    clips = spark.createDataFrame([(k, v.tolist(), "u") for k, v in enumerate(loud)], "clip_id int, y array<double>, seg_start string")
    got = {r.clip_id: np.array(r.y) for r in features.active_parts(clips, cfg).collect()}
    signal = [(k, i, float(x), len(v)) for k, v in enumerate(loud) for i, x in enumerate(v)]
    found = activity.detect(spark.createDataFrame(signal, "clip_id int, i int, x double, n int"), 40, 16, activity.Thresholds(), merge=True).collect()
    want = np.concatenate([loud[0][s.seg_start : s.seg_end] for s in sorted(found, key=lambda s: s.seg_start) if s.clip_id == 0])
    assert len(found) == 2 and (got[0] == want).all() and len(want) < 600 and (got[1] == loud[1]).all()


def test_one_pass_equals_operators_on_rows(spark):
    """Kernels, deltas, the joining of families and standardising, against the operators of series on rows."""
    cfg = settings(features={"lpcc": True, "lpc_order": 6, "n_lpcc": 5, "delta_delta": True}, preprocess={"crop": "head"})
    clips = tones(spark, 3)
    got = {(r.clip_id, f, k): c for r in features.feature_table(clips, cfg, number="double").collect() for f, row in enumerate(r.x) for k, c in enumerate(row)}
    joined, size = None, 0
    for kernel, *args in features.families(cfg):
        rows = [(r.clip_id, f, k, float(c)) for r in features.cropped(clips, cfg).collect() for f, row in enumerate(kernel(np.array(r.y), *args)) for k, c in enumerate(row)]
        n = 1 + max(r[2] for r in rows)
        table = series.stack_deltas(spark.createDataFrame(rows, "clip_id string, f int, k int, c double"), n, True, True)
        joined, size = (table if joined is None else series.concat_families(joined, table, size)), size + 3 * n
    want = {(r.clip_id, r.f, r.k): r.c for r in series.standardise(joined).collect()}
    assert want.keys() == got.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    plan = features.feature_table(clips, cfg)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_results_of_a_batch_leave_in_parts(spark, monkeypatch):
    """A batch's results are not held together; nulls, clips of any length and a batch without rows keep their places."""
    clips = [None, *(rng.normal(size=n) for n in (40, 400, 90)), None]
    column = dsp.as_column(dsp.mfcc, "array<array<double>>", 1600, 4, 8, 20, 800, 16, 40, 64)
    monkeypatch.setattr(dsp, "BATCH_NUMBERS", 20)
    answers = list(column.func(iter([pa.array(clips, pa.list_(pa.float64())), pa.array([], pa.list_(pa.float64()))])))
    assert [len(a) for a in answers] == [3, 1, 1, 0] or [len(a) for a in answers] == [2, 1, 1, 1, 0]
    got = [y for a in answers for y in a.to_pylist()]
    for y, m in zip(clips, got, strict=True):
        assert (y is None and m is None) or np.array_equal(m, dsp.mfcc(y, 1600, 4, 8, 20, 800, 16, 40, 64))
    table = spark.createDataFrame([(k, None if y is None else y.tolist()) for k, y in enumerate(clips)], "k int, y array<double>").coalesce(1)
    rows = {r.k: r.m for r in table.select("k", dsp.mfcc_of(F.col("y"), 1600, 4, 8, 20, 800, 16, 40, 64, "double").alias("m")).collect()}
    assert [rows[k] for k in range(len(clips))] == got


def test_workers_that_meet_each_step_are_one(spark):
    """Gradients summed over three workers' parts give the steps that one worker takes."""
    more = {"epochs": 2, "together": "step"}
    table = features.feature_table(tones(spark, 20), settings()).cache()
    one, three = (train.fit(table, table, settings(train=more | {"workers": w}, model={"dropout": 0.0})) for w in (1, 3))
    assert all(a["loss"] == pytest.approx(b["loss"], rel=1e-4) for a, b in zip(one.history, three.history, strict=True))
    again = train.fit(table, table, settings(train={"epochs": 2, "workers": 1}, model={"dropout": 0.0}))
    assert again.history[1]["loss"] == pytest.approx(one.history[1]["loss"], rel=1e-3)


def test_ring_sums(spark):
    """Every task of a barrier stage gets the same sums, in shares that don't divide evenly."""
    import pyarrow as pa

    from cadenza.plans.ring import Ring

    def run(parts):
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        for _ in parts:
            pass
        with Ring() as ring:
            sums = [ring.sum(np.arange(n) * (k + 1.0)) for n in (1, 2, 7, 100_003)]
        yield pa.RecordBatch.from_arrays([pa.array([float(s.sum()) for s in sums]), pa.array([int(hash(s.tobytes())) for s in sums])], ["s", "h"])

    for w in (1, 2, 3, 4):
        got = spark.range(40).repartition(w).mapInArrow(run, "s double, h long", barrier=True).collect()
        want = [sum(range(n)) * w * (w + 1) / 2 for n in (1, 2, 7, 100_003)]
        assert len(got) == 4 * w and all([r.s for r in got[4 * k : 4 * k + 4]] == pytest.approx(want) for k in range(w))


def test_command_lines(spark, tmp_path, capsys):
    from cadenza.__main__ import main

    rows = tones(spark, 24).select(F.concat("clip_id", F.lit(".wav")).alias("name"), "label_id", F.transform("y", lambda v: v / 4).alias("y")).cache()
    audio.write_wav(rows, str(tmp_path / "wav"), 1600)
    lines = [f"{r.name},{['low', 'high'][r.label_id]}" for r in rows.collect()]
    (tmp_path / "m.csv").write_text("\n".join(["filepath,label", *lines]))
    (tmp_path / "c.yaml").write_text("data: {labels: [low, high], sr: 1600, segment_sec: 0.3}\nfeatures: {n_mfcc: 4, n_mels: 8, n_gfcc: 4, n_filters: 8, fmin: 20, fmax: 800, hop: 16, win: 40}\ntrain: {batch_size: 8, epochs: 1}\nmodel: {hidden_size: 4, num_layers: 1}\npreprocess: {denoise: false, crop: random}\n")
    common = ["--model", str(tmp_path / "model"), "--config", str(tmp_path / "c.yaml")]
    main(["train", "--train", str(tmp_path / "m.csv"), "--valid", str(tmp_path / "m.csv"), "--root", str(tmp_path / "wav"), *common])
    assert "epoch 0: loss" in capsys.readouterr().out
    main(["predict", "--wav", str(tmp_path / "wav"), *common])
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 24 * 3 and "c0.wav: " in "".join(out) and sum(x.startswith("high        : ") for x in out) == 24


def test_training(spark, tmp_path):
    cfg = settings()
    table = features.feature_table(tones(spark, 48), cfg).cache()
    model = train.fit(table.where("clip_id < 'c35'"), table.where("clip_id >= 'c35'"), cfg)
    assert len(model.history) == 6 and max(h["macro_accuracy"] for h in model.history) > 0.8
    model.save(spark, str(tmp_path / "model"))
    again = train.load(spark, str(tmp_path / "model"))
    scored = predict.predict(table, again.params, again.shape, again.labels)
    assert scored.where("pred_id = label_id").count() > 38
    lines = predict.report_lines(scored.limit(1), again.labels).orderBy("k").collect()
    assert [r.line[:14] for r in lines] == ["low         : ", "high        : "]
    with pytest.raises(ValueError, match="training needs"):
        train.fit(table.limit(3), table, cfg)
    two = train.fit(table, table.limit(8), settings(train={"workers": 2, "epochs": 1}))
    assert two.history[0]["loss"] > 0
