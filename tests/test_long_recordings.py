"""Recordings in chunks, loudness from samples, resampling: against whole signals, definitions and plain loops."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonequarry.functions import dsp
from tonequarry.operators import chunks as K
from tonequarry.operators import loudness, rules
from tonequarry.plans import media as queries
from tonequarry.sources import external, media

CFG = rules.Thresholds(clip_min_run=2, dc_offset_max=0.02, silence_floor_dbfs=-20.0, head_silence_max_ms=5.0, tail_silence_max_ms=5.0, loop_step_ratio_max=0.5, silence_window_ms=10.0, dropout_min_ms=10.0)
SIGNAL = "path string, sample_rate int, full_scale long, lsb long, chans array<array<long>>"


def wav(path, chans, rate=48000, width=2, cut=0):
    """PCM of channels of whole numbers; ``cut`` bytes are missing at the end."""
    x = np.stack(chans, 1)
    if width == 3:
        raw = (x.astype("<i4").reshape(-1, 1).view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()
    else:
        raw = (x + 128 if width == 1 else x).astype({1: "u1", 2: "<i2", 4: "<i4"}[width]).tobytes()
    n = len(chans)
    head = b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, n, rate, rate * n * width, n * width, 8 * width) + b"data" + struct.pack("<I", len(raw))
    path.write_bytes((head + raw)[: len(head) + len(raw) - cut])


def odd_signals():
    rng = random.Random(3)
    rows = [("none.wav", []), ("empty.wav", [[]]), ("one.wav", [[5]]), ("two.wav", [[19, 19]]), ("silent.wav", [[0] * 50]), ("rail.wav", [[-20] * 40]), ("loop_same.wav", [[3, 9, -4] * 9] * 2)]
    for k in range(40):
        n, parts = rng.randrange(1, 90), []
        while len(parts) < n:
            parts += [rng.choice([0, 0, 1, 19, -19, -20, rng.randrange(-20, 20)])] * rng.randrange(1, 12)
        other = parts[:n] if k % 5 == 0 else [rng.randrange(-20, 20) if rng.random() < 0.4 else 0 for _ in range(n)]
        rows.append((f"{'loop' if k % 3 else 'hit'}_{k}.wav", [parts[:n], other] if k % 2 else [parts[:n]]))
    return [(p, 400, 20, 1, c) for p, c in rows]


@pytest.mark.parametrize("frames", [1, 7])
def test_chunks_measure_as_wholes(spark, frames):
    whole = spark.createDataFrame(odd_signals(), SIGNAL)
    want = {r["path"]: r for r in rules.judge(rules.measure(whole, CFG), CFG).collect()}
    got = {r["path"]: r for r in rules.judge(K.measure(K.split(whole, frames), CFG), CFG).collect()}
    assert want.keys() == got.keys()
    for path, w in want.items():
        g = got[path].asDict(True)
        for name, value in w.asDict(True).items():
            if name != "chans":
                assert g[name] == (pytest.approx(value, abs=1e-12) if isinstance(value, float) else value), (path, name)


@pytest.mark.parametrize("name", ["a04_clip_runs", "a05_edge_silence", "a06_silence_gaps", "a07_trailing_zeros", "a08_loop_seam"])
def test_chunked_queries_equal_whole(spark, sf, name, monkeypatch):
    chunked = {"a04": "s02_chunked_clip_runs", "a05": "s02_chunked_edges", "a06": "s02_chunked_gaps", "a07": "s02_chunked_zeros", "a08": "s02_chunked_seams"}[name[:3]]
    want = sorted(map(tuple, queries.QUERIES[name](spark, sf).collect()))
    for frames in (1,):
        monkeypatch.setattr(queries, "_chunks", lambda s, d, n=frames: K.split(queries.signals(s, d).drop("path"), n, "vec_id"))
        assert sorted(map(tuple, queries.QUERIES[chunked](spark, sf).collect())) == want


def test_long_files_are_read_in_stretches(spark, tmp_path):
    rng = np.random.default_rng(1)
    tone = (9000 * np.sin(np.arange(5000) / 9)).astype(int)
    tone[1990:2010] = 32767
    tone[3100:3900] = 0
    wav(tmp_path / "a.wav", [tone, tone[::-1]])
    wav(tmp_path / "b.wav", [rng.integers(-100, 100, 999)], width=1, rate=8000)
    wav(tmp_path / "c.wav", [rng.integers(-(1 << 20), 1 << 20, 777)] * 2, width=3)
    wav(tmp_path / "cut.wav", [tone], cut=101)
    (tmp_path / "bad.wav").write_bytes(b"RIFFjunk")
    whole, rows = media.read_audio(spark, str(tmp_path)), media.read_audio_chunks(spark, str(tmp_path), 1000)
    same = ("size_bytes", "content_sha256", "sample_rate", "bit_depth", "channels", "frames", "full_scale", "lsb", "error")
    want = {r["path"].rsplit("/", 1)[1]: r for r in whole.collect()}
    for r in rows.collect():
        w, at = want[r["path"].rsplit("/", 1)[1]], r["first_frame"]
        assert tuple(r[c] for c in same) == tuple(w[c] for c in same)
        assert [c[at : at + 1000] for c in w["chans"]] == r["chans"] and (w["error"] or r["file_sha256"] == w["file_sha256"])
    assert rows.filter("path like '%/a.wav'").count() == 5
    cfg = rules.Thresholds(dropout_min_ms=10.0)
    a = {r["path"]: sorted((f["check"], f["severity"]) for f in r["findings"]) for r in rules.judge(rules.measure(whole, cfg), cfg).collect()}
    b = {r["path"]: sorted((f["check"], f["severity"]) for f in r["findings"]) for r in rules.judge(K.measure(rows, cfg), cfg).collect()}
    assert a == b and any(("clipping", "FAIL") in f for f in a.values()) and any(f[0][0] == "silence_gap" or ("silence_gap", "WARN") in f for f in a.values() if f)


# --- loudness ---------------------------------------------------------------------


def tone(rate, parts, hz=997.0):
    """A sine of (seconds, peak dBFS) parts, phase going on."""
    n = [round(rate * s) for s, _ in parts]
    gain = np.repeat([10 ** (db / 20) for _, db in parts], n)
    return gain * np.sin(2 * np.pi * hz * np.arange(sum(n)) / rate)


def measured(spark, tmp_path, signals, frames=50_000):
    for name, (rate, chans) in signals.items():
        wav(tmp_path / f"{name}.wav", [np.clip(np.round(c * 2147483647), -2147483648, 2147483647).astype(np.int64) for c in chans], rate, 4)
    chunks = media.read_audio_chunks(spark, str(tmp_path), frames, lead=loudness.lead_frames())
    return {r["path"].rsplit("/", 1)[1][:-4]: r for r in loudness.meter(chunks).collect()}


def test_loudness_of_published_tones(spark, tmp_path):
    pair = lambda rate, parts: (rate, [tone(rate, parts)] * 2)
    got = measured(
        spark,
        tmp_path,
        {
            "one": pair(48000, [(5, -23.0)]),
            "two": pair(48000, [(5, -33.0)]),
            "three": pair(48000, [(2, -36.0), (30, -23.0), (2, -36.0)]),
            "other_rate": pair(44100, [(5, -23.0)]),
            "range": pair(48000, [(8, -20.0), (8, -30.0)]),
            "mono": (48000, [tone(48000, [(3, -20.0)])]),
            "short": pair(48000, [(0.3, -20.0)]),
            "silent": (48000, [np.zeros(48000)]),
        },
    )
    assert abs(got["one"]["lufs"] + 23) < 0.1 and abs(got["two"]["lufs"] + 33) < 0.1 and abs(got["other_rate"]["lufs"] + 23) < 0.1
    assert abs(got["three"]["lufs"] + 23) < 0.1
    assert abs(got["range"]["lra"] - 10) < 1
    assert abs(got["mono"]["lufs"] + 23.01) < 0.1
    assert got["short"]["lufs"] is None and got["silent"]["lufs"] is None and got["silent"]["true_peak_dbtp"] is None
    assert abs(got["mono"]["true_peak_dbtp"] + 20) < 0.1


def test_true_peak_lies_between_samples(spark, tmp_path):
    # a quarter of the rate, samples at 45 degrees: no sample comes near the wave's top
    x = 0.5 * np.sin(2 * np.pi * np.arange(48000) / 4 + np.pi / 4) * np.minimum(1, np.arange(48000) / 4800)
    x *= np.minimum(1, np.arange(48000)[::-1] / 4800)
    for frames in (48000, 4801):
        got = measured(spark, tmp_path, {"quarter": (48000, [x])}, frames)["quarter"]["true_peak_dbtp"]
        assert abs(got - 20 * np.log10(0.5)) < 0.1 and np.abs(x).max() < 0.36


def test_chunks_do_not_change_loudness(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 0.1, 48000 * 2) * np.repeat([1.0, 0.2, 0.7, 0.05], 24000)
    a, b = (measured(spark, tmp_path, {"noise": (48000, [x, x[::-1]])}, n)["noise"] for n in (1 << 20, 7777))
    for c in ("lufs", "true_peak_dbtp"):
        assert a[c] == pytest.approx(b[c], abs=1e-6)


def test_weighting_equals_its_recursion():
    x = np.random.default_rng(0).normal(size=3000)
    y = x
    for b, a in dsp._biquads(48000):
        z = np.zeros_like(y)
        for n in range(len(y)):
            z[n] = b[0] * y[n] + sum(b[i] * y[n - i] - a[i] * z[n - i] for i in (1, 2) if n >= i)
        y = z
    assert np.abs(dsp.filtered(x, dsp.weighting(48000)) - y).max() < 1e-9


# --- one rate ---------------------------------------------------------------------


@pytest.mark.parametrize(("rate", "to", "hz"), [(44100, 48000, 1000.0), (44100, 48000, 12000.0), (96000, 48000, 5000.0), (22050, 48000, 440.0)])
def test_resampled_sine(rate, to, hz):
    y = dsp.resampled(np.sin(2 * np.pi * hz * np.arange(rate) / rate), rate, to)
    want = np.sin(2 * np.pi * hz * np.arange(len(y)) / to)
    assert len(y) == to and np.abs(y - want)[1000:-1000].max() < 1e-3


def test_what_a_lower_rate_cannot_hold_is_left_out():
    y = dsp.resampled(np.sin(2 * np.pi * 30000.0 * np.arange(96000) / 96000), 96000, 48000)
    assert np.abs(y[1000:-1000]).max() < 1e-3
    assert len(dsp.resampled(np.empty(0), 44100, 48000)) == 0


def test_mono_at_one_rate(spark, tmp_path):
    x = np.round(20000 * np.sin(2 * np.pi * 500 * np.arange(44100) / 44100)).astype(int)
    wav(tmp_path / "a.wav", [x, x], 44100)
    r = external.read_mono(spark, str(tmp_path), rate=48000).first()
    want = 20000 / 32768 * np.sin(2 * np.pi * 500 * np.arange(48000) / 48000)
    assert r["sample_rate"] == 48000 and np.abs(np.array(r["samples"]) - want)[500:-500].max() < 1e-3
    assert external.read_mono(spark, str(tmp_path)).select(F.size("samples")).first()[0] == 44100
