"""Measurements, rules, joins and sequences on given values, and every query against its SQL."""

import math
import os
import struct
import wave

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tonequarry import plans
from tonequarry.functions import stats
from tonequarry.functions import text as X
from tonequarry.operators import intervals as I
from tonequarry.operators import library as L
from tonequarry.operators import rules as R
from tonequarry.operators import sequences as Q
from tonequarry.operators import spectral
from tonequarry.sources import media
from tonequarry.streaming import recorder

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", list(plans.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    df = plans.queries()[name](spark, sf)
    cols = sorted(df.columns)
    r = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_entry_has_every_query():
    assert set(plans.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def write_wav(path, channels, rate=48000, width=2):
    full = {1: 128, 2: 1 << 15, 3: 1 << 23, 4: 1 << 31}[width]
    with wave.open(str(path), "wb") as w:
        w.setnchannels(len(channels))
        w.setsampwidth(width)
        w.setframerate(rate)
        x = np.stack([np.clip(np.round(np.asarray(c) * full), -full, full - 1) for c in channels], axis=1).astype(np.int64).ravel()
        w.writeframes(b"".join(struct.pack("<i", int(v))[:width] if width > 1 else bytes([int(v) + 128]) for v in x))


def sine(seconds, amplitude, rate=8000):
    return amplitude * np.sin(2 * np.pi * 1000 * np.arange(int(seconds * rate)) / rate)


CASES = {
    "clean.wav": ([sine(1, 0.5)], set()),
    "clipped.wav": ([sine(1, 1.6)], {"clipping"}),
    "late.wav": ([np.r_[np.zeros(2400), sine(0.7, 0.5)]], {"head_silence"}),
    "long.wav": ([np.r_[np.zeros(16000), sine(8, 0.5)]], {"head_offset"}),
    "padded.wav": ([np.r_[sine(0.5, 0.5), np.zeros(9600)]], {"tail_silence"}),
    "biased.wav": ([sine(1, 0.4) + 0.05], {"dc_offset"}),
    "silent.wav": ([np.zeros(8000)], {"silent_file"}),
    "half.wav": ([sine(1, 0.5), np.zeros(8000)], {"channel_silent"}),
    "same.wav": ([sine(1, 0.5), sine(1, 0.5)], {"fake_stereo"}),
    "dropout.wav": ([np.r_[sine(0.5, 0.5), np.zeros(2400), sine(0.5, 0.5)]], {"silence_gap"}),
    "wind_loop.wav": ([np.linspace(-0.3, 0.3, 8000)], {"loop_discontinuity"}),
}


def test_scan_of_files(spark, tmp_path):
    for name, (chans, _) in CASES.items():
        write_wav(tmp_path / name, chans, 8000)
    for width in (1, 3, 4):
        write_wav(tmp_path / f"w{width}.wav", [sine(1, 0.5)], 8000, width)
    (tmp_path / "bad.wav").write_bytes(b"RIFFjunk")
    (tmp_path / "句_copy.wav").write_bytes(b"x")
    (tmp_path / "note.txt").write_text("x")
    audio = media.drop_work_copies(media.read_audio(spark, str(tmp_path)))
    got = {os.path.basename(r["path"]): r for r in R.judge(R.measure(audio, R.Thresholds(dropout_min_ms=100.0)), R.Thresholds(dropout_min_ms=100.0)).collect()}
    assert len(got) == len(CASES) + 4
    for name, (_, want) in CASES.items():
        found = {f["check"] for f in got[name]["findings"]}
        assert found - {"loop_discontinuity", "tail_decay"} == want - {"loop_discontinuity"} and want <= found, name
    for name in ("clean.wav", "w1.wav", "w3.wav", "w4.wav"):
        assert abs(got[name]["peak_dbfs"] + 6.02) < 0.15
    assert got["bad.wav"]["findings"][0]["check"] == "decode" and got["bad.wav"]["status"] == "FAIL"
    assert got["clean.wav"]["status"] == "PASS"
    gap = got["dropout.wav"]["gaps"][0]
    assert abs(gap["start"] / 8000 - 0.5) < 0.011 and abs(gap["length"] / 8000 - 0.3) < 0.021
    assert {r["path"].rsplit("/", 1)[1] for r in media.list_files(spark, str(tmp_path)).collect()} == {*got, "句_copy.wav"}
    media.write_report(R.judge(R.measure(audio)), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").count() == len(got)


def test_clip_runs_are_listed(spark):
    import json as js

    full = 1 << 15
    chan = lambda step, n: [x for k in range(n) for x in ([full - 1] * 3 + [0] * step)]
    a, b = chan(7, 30), chan(2, 60)
    df = spark.createDataFrame([("x.wav", 1000, full, 1, [a, b])], "path string, sample_rate int, full_scale long, lsb long, chans array<array<long>>")
    f = next(f for f in R.judge(R.measure(df)).first()["findings"] if f["check"] == "clipping")
    want = sorted([(k * 0.01, 0, 3) for k in range(20)] + [(round(k * 0.005, 4), 1, 3) for k in range(20)])[:20]
    assert f["detail"]["runs"] == "90" and [(r["time_s"], r["channel"], r["samples"]) for r in js.loads(f["detail"]["first_runs"])] == [(round(t, 4), c, n) for t, c, n in want]


def test_edges_equal_plain_python(spark):
    """Silence gaps against a plain reading of the rule, on seeded signals."""
    rng = np.random.default_rng(20260910)
    rows = []
    for k in range(60):
        x = np.where(np.arange(400) % 2, 8000, -8000)
        for _ in range(rng.integers(1, 5)):
            a = rng.integers(0, 380)
            x[a : a + rng.integers(1, 90)] = 0
        rows.append((k, [x.tolist()]))
    df = spark.createDataFrame(rows, "k int, chans array<array<long>>")
    from tonequarry.operators import signals as S

    got = {r["k"]: [tuple(g) for g in r["g"]] for r in df.select("k", S.silence_gaps(F.col("chans"), F.lit(30), F.lit(10), F.lit(20)).alias("g")).collect()}
    for k, (x,) in rows:
        loud = [max(map(abs, x[i : i + 10])) > 30 for i in range(0, 400, 10)]
        want, i = [], 0
        while i < 40:
            j = i
            while j < 40 and not loud[j]:
                j += 1
            if j > i and i > 0 and j < 40 and (j - i) * 10 >= 20:
                want.append((i * 10, (j - i) * 10))
            i = max(j, i + 1)
        assert got[k] == want


def test_names_and_numbers(spark):
    row = spark.range(1).select(
        *[X.is_loop_name(F.lit(n)).alias(n) for n in ("wind_loop", "Loop 01", "looped", "a-loop.2", "sloop")],
        X.category(F.lit("x/UI/click.wav")).alias("ui"), X.category(F.lit("x/y.wav")).alias("none"),
        X.canonical_name(F.lit("a/Suling_E#5.wav")).alias("e5"), X.canonical_name(F.lit("b/Suling_F5.wav")).alias("f5"),
        X.similarity(F.lit(""), F.lit("")).alias("both"), X.similarity(F.lit("a"), F.lit(None).cast("string")).alias("one"), X.similarity(F.lit("abcd"), F.lit("bcde")).alias("part"),
        X.normalized(F.lit("Ｈello, Wörld ①")).alias("nfkc"), X.timecode(F.lit(83.4567)).alias("tc"),
    ).first()
    assert [row[n] for n in ("wind_loop", "Loop 01", "looped", "a-loop.2", "sloop")] == [True, True, False, True, False]
    assert (row["ui"], row["none"], row["e5"] == row["f5"], row["both"], row["one"], row["part"], row["nfkc"], row["tc"]) == ("ui", "uncategorized", True, 1.0, 0.0, 0.75, "hellowörld1", "01:23.457")
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    r = v.agg(stats.upper_median("v").alias("u"), stats.nearest_rank("v", 0.5).alias("n"), stats.floor_rank("v", 0.95).alias("f")).first()
    assert tuple(r) == (3.0, 3.0, 4.0)
    assert stats.ranked_value(v.withColumn("k", F.lit(1)), ["k"], "v", 0.9).first()["value"] == 4.0


def test_compare_changes(spark):
    schema = "path string, content_sha256 string, sample_rate int, bit_depth int, channels int, duration_s double, peak_dbfs double, lufs double, true_peak_dbtp double, fails array<string>"
    a = spark.createDataFrame([("keep", "h", 48000, 16, 1, 1.0, -6.0, None, None, []), ("changed", "x", 48000, 16, 1, 1.0, -6.0, None, None, []), ("gone", "g", 48000, 16, 1, 1.0, -6.0, None, None, []), ("same", "", 48000, None, 1, 1.0, -6.0, None, None, [])], schema)
    b = spark.createDataFrame([("keep", "h", 96000, 16, 1, 1.0, -6.0, None, None, []), ("changed", "y", 48000, 16, 1, 1.0, -26.0, -20.0, None, ["clipping"]), ("new", "n", 48000, 16, 1, 1.0, -6.0, None, None, []), ("same", "", 48000, None, 1, 1.0, -6.2, None, None, [])], schema)
    d = L.compare(a, b)
    assert tuple(L.compare_summary(d).first()) == (1, 1, 2, 1)
    r = {x["path"]: x for x in d.collect()}
    assert r["changed"]["severity"] == "FAIL" and [m["metric"] for m in r["changed"]["deltas"]] == ["peak_dbfs"] and r["changed"]["new_fails"] == ["clipping"]
    assert r["same"]["severity"] == "INFO"


def test_alignment(spark):
    rows = spark.createDataFrame(
        [("c", "1", None, None, 1.0, 2.0, "你好世界", None), ("c", "2", 4.0, 5.0, 4.4, 5.4, "第二句话", "已确认"), ("c", "3", None, None, 8.0, 9.0, "没有声音", None), ("c", "4", None, None, 11.0, 12.0, "abc def", None), ("c", "5", 14.0, 15.0, None, None, None, None), ("c", "6", 20.0, 21.0, 20.2, 21.0, "late 200", None)],
        "clip string, idx string, speech_start double, speech_end double, subtitle_start double, subtitle_end double, subtitle_text string, note string",
    )
    seg = spark.createDataFrame([("c", 1.0, 2.0, "你好世界"), ("c", 4.0, 5.0, "第二句话"), ("c", 11.0, 12.0, "zzzzzz"), ("c", 14.1, 14.9, "heard"), ("c", 17.0, 18.0, "orphan"), ("c", 20.0, 21.0, "Late 200!")], "clip string, start double, end double, text string")
    found = I.differences(rows, seg, ["clip"], 4.0)
    got = {r["idx"]: r for r in found.collect()}
    assert got["1"]["category"] is None and got["1"]["offset_ms"] == 0
    assert (got["2"]["category"], got["2"]["severity"], round(got["2"]["offset_ms"]), got["2"]["confirmed"]) == ("offset", "FAIL", 400, True)
    assert [got[i]["category"] for i in "345"] == ["missing_speech", "misordered", "missing_subtitle"]
    assert (got["6"]["category"], got["6"]["severity"]) == ("offset", "WARN") and got["ASR#5"]["category"] == "missing_subtitle"
    counts = {r["category"]: (r["total"], r["confirmed"]) for r in I.difference_counts(found.filter("category is not null")).collect()}
    assert counts == {"missing_speech": (1, 0), "missing_subtitle": (2, 0), "misordered": (1, 0), "offset": (2, 1)}
    s = I.offset_stats(found).first()
    assert (s["evaluated"], round(s["median_ms"]), round(s["p90_ms"]), s["n_exceed"], s["n_fail"]) == (3, 200, 400, 2, 1)


def test_interval_plans_are_equi_joins(spark, sf):
    for name in ("j03_overlap_join", "j04_covered", "j05_orphans", "j06_best_overlap", "j07_least_covered", "j08_nearest"):
        plan = plans.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_folds_equal_plain_python(spark, sf):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for k in range(40):
        t, states = 0.0, []
        for _ in range(rng.integers(1, 12)):
            d = round(float(rng.choice([0.1, 0.2, 0.5, 1.0])), 1)
            states.append([round(t, 1), round(t + d, 1)])
            t += d + 0.1
        rows += [(k, *s) for s in states]
        out, eat = [], False
        for s in states:
            short = round(s[1] - s[0], 3) < 0.4
            if out and (short or eat):
                out[-1][1] = s[1]
                eat = short
            else:
                out.append(list(s))
                eat = False
        want[k] = [tuple(s) for s in out]
    got = {}
    for r in Q.debounce(spark.createDataFrame(rows, "k int, start double, end double"), ["k"]).collect():
        got.setdefault(r["k"], []).append((r["start"], r["end"]))
    assert {k: sorted(v) for k, v in got.items()} == want
    vals = rng.integers(0, 9, 300).astype(float)
    picked, last = [], None
    for i in range(1, 299):
        if vals[i] >= 6 and vals[i] >= vals[i - 1] and vals[i] >= vals[i + 1] and (last is None or i - last >= 5):
            picked.append(i)
            last = i
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(vals)], "k int, i int, v double")
    assert sorted(r["i"] for r in Q.greedy_peaks(df, ["k"], "i", "v", F.lit(6.0), 5).collect()) == picked


def test_states_split_and_schedules(spark):
    fr = [("a", i, 5.0 if 5 <= i < 25 or 30 <= i < 50 else 0.0, 0.0) for i in range(60)] + [("b", i, 5.0, 1.0 if i == 20 else 0.0) for i in range(40)]
    got = sorted((r["clip"], r["start"], r["end"]) for r in Q.text_states(spark.createDataFrame(fr, "clip string, idx int, bright double, change double"), ["clip"], 10.0).collect())
    assert got == [("a", 0.5, 2.5), ("a", 3.0, 5.0), ("b", 0.0, 2.0), ("b", 2.0, 4.0)]
    steps = spark.createDataFrame([("p", i, float(d)) for i, d in enumerate((8, 8, 8, 10, 10, 10, 8, 8))], "p string, i int, dwell double")
    assert [r["at"] for r in Q.schedule(steps, ["p"], "i", "dwell").orderBy("i").collect()] == [8, 16, 24, 32, 42, 52, 62, 70]
    m = [("c", i / 10, -20.0 - abs(i - 45) / 10 if i < 80 else -10.0 - abs(i - 95) / 10) for i in range(120)] + [("c", 12.5, -120.0)]
    assert sorted(r["start"] for r in Q.loudest_windows(spark.createDataFrame(m, "clip string, t double, m double"), ["clip"], 4, 2).collect()) == [4, 8]


def test_logs_and_tables(spark, tmp_path):
    logs = spark.createDataFrame([("c", 1, "x t: 0.1 TARGET:-23 M: -20.5 S:-1"), ("c", 2, "[silencedetect] silence_start: -0.01"), ("c", 3, "silence_end: 1.5 | silence_duration: 1.5"), ("c", 4, "silence_start: 3"), ("c", 5, "I: -20.0 I: -inf I: -18.5")], "clip string, line int, value string")
    assert [tuple(r) for r in media.momentary(logs).collect()] == [("c", 0.1, -20.5)]
    dur = spark.createDataFrame([("c", 4.0)], "clip string, duration double")
    assert sorted(tuple(r) for r in media.silences(logs, dur).collect()) == [("c", 0.0, 1.5), ("c", 3.0, 4.0)]
    assert logs.filter("line = 5").select(media.last_match("value", r"I:\s*(-?[\d.]+)")).first()[0] == -18.5
    p = tmp_path / "s.tsv"
    p.write_text("\ufeff" + "\t".join(media.SUBTITLE_COLUMNS) + "\nA\t1\t2\t1.5\t2.5\t文字\t\n\t\t\t\t\t\t\n\t3\t\t\t\t无\t已确认\n", encoding="utf-8")
    got = media.read_subtitles(spark, str(p)).orderBy("line").collect()
    assert [(r["idx"], r["speech_start"], r["subtitle_end"], r["note"]) for r in got] == [("A", 1.0, 2.5, ""), ("L4", 3.0, None, "已确认")]
    (tmp_path / "bad.tsv").write_text("a\tb\n1\t2\n")
    with pytest.raises(Exception, match="header"):
        media.read_subtitles(spark, str(tmp_path / "bad.tsv")).collect()
    for body in ('{"segments":[{"start":1,"end":2,"text":"a"}]}', '[{"start":1,"end":2,"text":"a"}]'):
        (tmp_path / "s.json").write_text(body)
        assert [tuple(r) for r in media.read_segments(spark, str(tmp_path / "s.json")).collect()] == [(1.0, 2.0, "a")]
    (tmp_path / "s.json").write_text('[{"start":3,"end":2,"text":"a"}]')
    with pytest.raises(Exception, match="ends before"):
        media.read_segments(spark, str(tmp_path / "s.json")).collect()
    texts = spark.createDataFrame([("f", '<Obj Name="a"/> vol=3 <Obj Name="b"/> vol=5'), ("g", None)], "path string, value string")
    assert [(r["value"], r["owner"]) for r in media.owners(texts, r'Name="(\w+)"', r"vol=(\d)").collect()] == [("3", "a"), ("5", "b")]


def test_onsets_and_materials(spark):
    rate, rng = 48000, np.random.default_rng(3)
    x = rng.standard_normal(rate * 6) * 1e-4
    for k in range(10):
        n = int(0.12 * rate)
        t = np.arange(n) / rate
        burst = np.sin(2 * np.pi * (3000 if k < 5 else 150) * t) * np.exp(-t / (0.01 if k < 5 else 0.03))
        at = int((0.3 + 0.5 * k) * rate)
        x[at : at + n] += burst * 0.4
    clips = spark.createDataFrame([("c", rate, x.tolist()), ("none", rate, None), ("short", rate, [0.0] * 10)], "clip string, sample_rate int, samples array<double>")
    f = spectral.onset_features(clips)
    rows = f.orderBy("onset").collect()
    assert len(rows) == 10 and all(abs(r["onset"] - 0.3 - 0.5 * k) < 0.03 for k, r in enumerate(rows))
    s = Q.change_points(f, ["clip"], ["onset"], Q.step_vector(F.col("centroid_hz"), F.col("low_ratio"), F.col("decay")))
    assert [r["n"] for r in s.groupBy("segment").agg(F.count("*").alias("n")).orderBy("segment").collect()] == [5, 5]
    assert [(r["boundary_step"], r["is_transition"]) for r in Q.transitions(s, ["clip"]).collect()] == [(6, False)]
    fr = spark.createDataFrame([("c", 0, bytearray([0, 200, 255, 10])), ("c", 1, bytearray([200, 200, 0, 10]))], "clip string, idx int, pixels binary")
    assert [(r["bright"], r["change"]) for r in spectral.frame_signals(fr, ["clip"]).orderBy("idx").collect()] == [(50.0, 0.0), (50.0, 50.0)]
    bands = spark.createDataFrame([("c", 0.72, 0.0, 9.0), ("c", 0.74, 3.0, 4.0), ("c", 0.76, 3.0, 5.0), ("d", 0.72, 0.0, 9.0), ("d", 0.74, 0.0, 9.0)], "clip string, start double, score double, amplitude double")
    assert sorted((r["clip"], r["start"], r["fallback"]) for r in spectral.best_band(bands, ["clip"]).collect()) == [("c", 0.74, False), ("d", 0.72, True)]
    assert spectral.candidate_bands()[0] == (0.72, 0.78) and spectral.candidate_bands()[-1] == (0.9, 0.96)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text('{"eventType":"RecordStateChanged","eventData":{"outputActive":false,"outputState":"X_OUTPUT_STOPPED","outputPath":"p"}}\n{"eventType":"Other","eventData":{}}\n')
    q = recorder.recorder_events(spark, str(src)).writeStream.format("memory").queryName("rec").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("rec").collect()] == [("stopped", "p", True)]
    q = recorder.watch_files(spark, str(src), "*.json").writeStream.format("memory").queryName("watched").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("watched").count() == 1
    e = spark.createDataFrame([("r", 1.0, "started", None), ("r", 2.0, "stopped", "a"), ("r", 3.0, "stopped", "b"), ("r", 4.0, "started", None), ("r", 9.0, "stopped", "c")], "recorder string, t double, state string, path string")
    assert [(r["take"], r["started"], r["stopped"], r["path"]) for r in recorder.takes(e.withColumn("seq", F.lit(0))).collect()] == [(1, 1.0, 2.0, "a"), (2, 4.0, 9.0, "c")]


def test_windowed_counts_of_a_batch(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert recorder.windowed_counts(e, "ts", ["user_id"]).agg(F.sum("n")).first()[0] == e.count()


def test_look_ups_and_reports(spark, tmp_path):
    from tonequarry.operators import predicates as P
    from tonequarry.sources import reports as W

    d = spark.createDataFrame([(1, "Mic A"), (1, "Line"), (2, "Mic A"), (2, "mic b"), (3, None)], "k int, name string")
    assert [tuple(r) for r in P.the_one(d.filter("k <> 2"), ["k"], "name", F.lit("MIC")).collect()] == [(1, "Mic A")]
    with pytest.raises(Exception, match="2 names match"):
        P.the_one(d, ["k"], "name", F.lit("mic")).collect()
    assert {r["name"] for r in P.off_convention(d, F.col("name"), "mic .").collect()} == {"Line", None}
    names = d.limit(1).select(P.clip_name(F.lit("c"), F.lit("s"), F.lit(123), F.lit(".wav")).alias("n")).first()["n"]
    assert names == "raw_c_s_r123.wav"
    lines = W.markdown_table(spark.createDataFrame([("b|c", None), ("a\r\nb", 1)], "x string, y int"), "T", ["x", "y"], ["x"])
    assert [r["line"] for r in lines.collect()] == ["## T", "", "| x | y |", "|---|---|", "| a b | 1 |", "| b\\|c |  |"]
    W.write_markdown(lines, f"{tmp_path}/md")
    assert spark.read.text(f"{tmp_path}/md").count() == 6
    states = spark.createDataFrame([(1, 2.0, 3.5), (1, 0.5, 1.0)], "k int, start double, end double")
    W.write_ground_truth(W.ground_truth(states, ["k"]), f"{tmp_path}/tsv")
    got = spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/tsv").orderBy("idx").collect()
    assert [(r["idx"], r["subtitle_start"], r["subtitle_end"]) for r in got] == [("D-01", "0.500", "1.000"), ("D-02", "2.000", "3.500")]
    assert [tuple(r)[3:] for r in W.evidence_plan(states).orderBy("start").collect()] == [(0.0, 1.5), (1.5, 2.5)]
