"""Cross-checks, takes, devices, macros, faults, waits, replies and reports on given values."""

import json
import math
import struct
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonequarry.functions import stats
from tonequarry.functions import text as X
from tonequarry.operators import crosscheck as C
from tonequarry.operators import edits
from tonequarry.operators import injection as J
from tonequarry.operators import intervals as I
from tonequarry.operators import library as L
from tonequarry.operators import sequences as Q
from tonequarry.operators import spectral
from tonequarry.operators import takes as K
from tonequarry.sources import external, media, sections
from tonequarry.streaming import recorder


def test_crosscheck(spark):
    states = spark.createDataFrame([("c", 1, 2.2, 3.0), ("c", 2, 5.0, 5.9), ("c", 3, 20.0, 21.0)], "clip string, idx int, start double, end double")
    acts = spark.createDataFrame([("c", 1, 2.0, 3.0), ("c", 2, 5.3, 5.8), ("c", 3, 6.0, 6.1), ("c", 4, 8.0, 9.0), ("d", 5, 1.0, 2.0)], "clip string, act int, start double, end double")
    got = sorted(tuple(r) for r in C.findings(states, acts, ["clip"], 4.0, "idx", "act").collect())
    # activity of 0.1 s is noise for the search of text, not for pauses; a clip without text has nothing to miss
    assert got == [("c", "no_gap_between", "2", 5.8), ("c", "text_without_voice", "3", 20.0), ("c", "voice_without_text", "4", 8.0)]
    rows = {r["idx"]: r for r in C.state_rows(states, acts, ["clip"], 4.0, "idx", "act").collect()}
    assert rows[1]["offset_ms"] == -200 and rows[2]["offset_ms"] == 300 and rows[3]["voice_start"] is None
    assert spark.range(1).select(C.usable(F.lit(0.05)), C.usable(F.lit(0.04))).first() == (True, False)
    lines = [r["line"] for r in sections.in_order(sections.crosscheck_report(C.state_rows(states, acts, ["clip"], 4.0, "idx", "act"), C.findings(states, acts, ["clip"], 4.0, "idx", "act"), "idx")).collect()]
    assert lines[2] == "| state | start s | end s | covered | voice s | offset ms |" and lines[4] == "| 1 | 2.20 | 3.00 | 100% | 2.00 | -200 |" and lines[6].endswith("| — | — |")


def test_triage_and_takes(spark):
    gaps = spark.createDataFrame([("a", 1, 1.1, None), ("a", 2, 2.0, 1.0), ("b", 3, 1.0, None), ("a", 4, 3.0, None)], "clip string, g int, time_s double, inside_kb double")
    act = spark.createDataFrame([("a", 0.0, 10.0), ("a", 1.0, 2.0), ("a", 2.0, 12.0), ("a", 4.0, 9.0)], "clip string, t double, kb double")
    got = {r["g"]: r["verdict"] for r in K.triage(gaps, act, ["clip"], "g").collect()}
    v = K.GAP_VERDICTS
    assert got == {1: v[1], 2: v[1], 3: v[0], 4: v[2]}  # 4: two samples as near, the earlier counts
    measured = spark.createDataFrame([("x/b.wav", 1000, [(2000, 300), (500, 100)], 3.0), ("x/a.wav", 1000, [(1, 1)] * 25, None)], "path string, sample_rate int, gaps array<struct<start:int,length:int>>, duration_s double")
    e = K.gap_entries(measured)
    assert [tuple(r) for r in K.gaps_in_order(e).filter("stem = 'b'").select("gap", "time_s", "duration_ms").collect()] == [(1, 0.5, 100.0), (2, 2.0, 300.0)]
    assert e.filter("stem = 'a'").count() == 20
    stems = spark.createDataFrame([("b",), ("a",), ("z",)], "stem string")
    assert [r["stem"] for r in K.take_gaps(e, stems.filter("stem = 'b'")).collect()] == ["b", "b"]
    assert {r["stem"]: r["duration_s"] for r in K.take_durations(measured, stems).collect()} == {"a": 0.0, "b": 3.0, "z": 0.0}
    names = spark.createDataFrame([("c", "raw_1_c_r07.mkv"[:-4]), ("c", "raw_1_c_r2"), ("c", "other_rx"), ("d", "none")], "k string, name string")
    assert {r["k"]: r["next_take"] for r in K.next_take(names, ["k"], "name").collect()} == {"c": 8, "d": 1}


def test_roles(spark):
    dev = [(1, "h", "Headset A"), (2, "s", "Speaker"), (3, "m", "Monitor")]
    devices = spark.createDataFrame([(k, o, i, n) for k in range(9) for o, i, n in (dev if k not in (7, 8) else dev[:1] if k == 8 else [])], "k int, ord int, id string, name string")
    wanted = spark.createDataFrame(
        [(0, "h", None, None), (1, "s", "", ""), (2, "x", None, None), (3, "x", "HEAD", "mon"), (4, "h", None, "e"), (5, "h", "zz", None), (6, "h", None, "headset"), (7, "h", None, None), (8, "h", None, None)],
        "k int, default_id string, headset_pattern string, other_pattern string",
    )
    got = {r["k"]: (r["headset"], r["other"], r["error"]) for r in K.resolve_roles(devices, wanted, ["k"]).collect()}
    assert got == {
        0: ("Headset A", "Speaker", None), 1: ("Speaker", "Headset A", None), 2: (None, None, "no_default"), 3: ("Headset A", "Monitor", None), 4: (None, None, "other_ambiguous"),
        5: (None, None, "headset_not_found"), 6: (None, None, "same_device"), 7: (None, None, "no_device"), 8: (None, None, "no_other"),
    }


def test_macros_and_records(spark):
    steps = spark.createDataFrame([("m", 0, "wait", 1.5), ("m", 1, "key", 0.2), ("m", 2, "click", None), ("m", 3, "mark", None)], "k string, i int, kind string, value double")
    assert K.scenario_duration(steps, ["k"]).first()["seconds"] == 1.88
    t = K.macro_timeline(steps, ["k"], "i")
    assert [r["at"] for r in t.orderBy("i").collect()] == [0.0, 1.5, 1.78, 1.88]
    assert [tuple(r) for r in K.macro_marks(t.withColumn("label", F.lit("x")), ["k"], "label").collect()] == [("m", "x", 1.88)]
    rng = np.random.default_rng(1)
    plan, want = [], {}
    for k in range(20):
        at, now = 8.0, 0.0
        for i in range(rng.integers(1, 9)):
            took = float(rng.integers(0, 12))
            plan.append((k, i, at, took))
            issued = max(now, at)
            now = issued + took
            want[k, i] = issued, now, issued - at
            at += float(rng.integers(1, 9))
    r = K.run_records(spark.createDataFrame(plan, "k int, i int, at double, took double"), ["k"], "i").collect()
    assert {(x["k"], x["i"]): (x["issued_at"], x["effective_at"], x["late_by"]) for x in r} == want
    rec = spark.createDataFrame([("s1", 1, 8.0, 8.0, 8.5, 0.0, True, "unplug", "A", "B"), ("s2", 2, 9.0, 9.5, 9.9, 0.5, False, "plug", "B", "A")], "step string, i int, at double, issued_at double, effective_at double, late_by double, ok boolean, label string, before string, after string")
    lines = [x["line"] for x in sections.in_order(sections.device_report(rec, "i")).collect()]
    assert lines[4] == "| s1 | 8.00 | 8.000 | 8.500 | 0.00 | effective | unplug | A → B |" and lines[-1] == "- `s2`"


def test_waits_and_replies(spark):
    polls = spark.createDataFrame([("a", 0.0, 0), ("a", 1.0, 5), ("a", 2.0, 5), ("b", 0.0, 1), ("b", 1.0, 2), ("c", 0.0, 0), ("c", 1.0, 0), ("d", 0.0, 1), ("d", 30.0, 1)], "f string, t double, size long")
    assert {r["f"]: (r["ready_at"], r["ready"], r["settled"]) for r in K.stable_files(polls.withColumn("seq", F.lit(0)), ["f"]).collect()} == {"a": (2.0, True, True), "b": (1.0, True, False), "c": (1.0, False, False), "d": (0.0, True, False)}
    checks = spark.createDataFrame([("a", 0.0, False), ("a", 1.0, True), ("b", 0.0, None), ("b", 2.5, False), ("b", 3.0, True), ("c", 0.0, False)], "k string, e double, ok boolean")
    assert {r["k"]: (r["met"], r["elapsed"]) for r in K.poll_result(checks, ["k"], "e", F.col("ok"), 2.0).collect()} == {"a": (True, 1.0), "b": (False, 2.5)}
    req = spark.createDataFrame([("s", 1, 0), ("s", 2, 0), ("s", 3, 0), ("s", 4, 0)], "session string, request_id int, after int")
    msg = spark.createDataFrame([("s", 1, 36, None, 1, "event"), ("s", 2, 50, None, 2, "two"), ("s", 3, 8, 48, 1, "bad"), ("s", 4, 50, None, 1, "late"), ("s", 5, 8, 32, 3, "other"), ("s", 21, 50, None, 3, "too late")], "session string, seq int, kind int, ref int, request_id int, body string")
    got = {r["request_id"]: (r["outcome"], r["body"]) for r in K.correlate(req, msg, ["session"]).collect()}
    assert got == {1: ("error", "bad"), 2: ("result", "two"), 3: ("none", None), 4: ("none", None)}


def test_replies_of_streams(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "a").mkdir()
    (tmp_path / "q" / "x.json").write_text('{"session":"s","request_id":1,"ts":"2024-01-01T00:00:00Z"}\n{"session":"s","request_id":2,"ts":"2024-01-01T00:00:00Z"}\n')
    (tmp_path / "a" / "x.json").write_text('{"session":"s","request_id":1,"ts":"2024-01-01T00:00:05Z","body":"one"}\n{"session":"s","request_id":2,"ts":"2024-01-01T00:05:00Z","body":"late"}\n')
    read = lambda d, more="": spark.readStream.schema("session string, request_id int, ts timestamp" + more).json(f"{tmp_path}/{d}")
    out = K.correlate_stream(read("q"), read("a", ", body string"), "session")
    q = out.writeStream.format("memory").queryName("replies").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["request_id"], r["body"]) for r in spark.table("replies").collect()] == [(1, "one")]


def test_takes_with_marks(spark):
    e = spark.createDataFrame([("r", float(t), s, None) for t, s in enumerate(["mark", "started", "mark", "started", "mark", "mark", "stopped", "mark", "stopped", "started", "stopped"])], "recorder string, t double, state string, path string")
    assert [(r["take"], r["started"], r["stopped"], r["n_marks"], r["first_mark"]) for r in recorder.takes_with_marks(e.withColumn("seq", F.lit(0))).orderBy("take").collect()] == [(1, 3.0, 6.0, 2, 1.0), (2, 9.0, 10.0, 0, None)]


def test_properties(spark):
    text = '<x/><Property Name="V" Value="0"/><Sound Name="a"><Property Name="V" Type="t" Value="1"/><Property Name="W" Value="7"/><Property Name="V"/></Sound>\n<ActorMixer ShortID="1"/><MusicTrack  Name="b"><Property Name="V" Type="t">\n <ValueList><Value> 2\n</Value><Value>3</Value></ValueList></Property><Property Name="V"></Property>'
    got = [tuple(r) for r in J.properties(spark.createDataFrame([("p", text), ("q", None)], "path string, value string"), "V").orderBy("ord").drop("ord").collect()]
    assert got == [("p", "", "", "0"), ("p", "Sound", "a", "1"), ("p", "Sound", "a", ""), ("p", "MusicTrack", "b", "2"), ("p", "MusicTrack", "b", "")]
    hits = J.with_targets(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "owner_name string, n int"), spark.createDataFrame([("a",), ("a",)], "owner_name string"))
    assert J.target_counts(hits, []).first() == (3, 2, 1)


def test_ranks_of_a_whole_table(spark):
    rng = np.random.default_rng(3)
    for values in ([5.0], [1.0, 2.0], [0.0] * 50 + [3.0], rng.exponential(300, 2000).round(2).tolist(), (rng.standard_normal(999) * 1e6).tolist()):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "a double")
        last = F.col("n") - 1
        got = {r["pick"]: r["value"] for r in stats.exact_ranks(df, "a", {"p90": F.bround(0.9 * last, 0), "low": F.floor(last / 2), "max": last}).collect()}
        s, n = sorted(values), len(values) - 1
        assert got == {"p90": s[int(np.rint(0.9 * n))], "low": s[n // 2], "max": s[n]}
    assert stats.exact_ranks(spark.createDataFrame([], "a double"), "a", {"x": F.lit(0)}).count() == 0
    s = I.offset_stats(spark.createDataFrame([(float(x),) for x in (10, -200, 400, 30)], "offset_ms double")).first()
    assert tuple(s) == (4, 115.0, 400.0, 400.0, 2, 1)


def test_orders_of_reports(spark):
    d = spark.createDataFrame([("offset", "10"), ("missing_speech", "9"), ("offset", "9"), ("missing_speech", "ASR#2")], "category string, idx string")
    assert [tuple(r) for r in I.in_report_order(d).collect()] == [("missing_speech", "9"), ("missing_speech", "ASR#2"), ("offset", "10"), ("offset", "9")]
    g = spark.createDataFrame([("INFO", "a"), ("WARN", "c"), ("WARN", "b")], "severity string, keeper string")
    assert [r["keeper"] for r in L.duplicates_in_order(g).collect()] == ["b", "c", "a"]
    assert [r["path"] for r in L.results_in_order(spark.createDataFrame([("b",), ("a",)], "path string")).collect()] == ["a", "b"]
    f = spark.createDataFrame([("x/a.wav",), ("x/b.mkv",), ("y/c.mp4",)], "path string")
    assert sorted(r["path"] for r in L.audio_else_video(f, X.suffix(F.col("path")) == ".wav").collect()) == ["x/a.wav", "y/c.mp4"]


def test_spaced_peaks_and_features():
    assert spectral._spaced(np.array([1, 2, 5, 6, 11, 30]), 5).tolist() == [1, 6, 11, 30]
    assert spectral.pick(np.zeros(2)).size == 0 and spectral.features(np.ones(10), np.zeros(0), 48000).shape == (0, 6)
    f = spectral.features(np.sin(2 * np.pi * 100 * np.arange(48000) / 48000), np.array([0.0, 0.9]), 48000)
    assert f[0, 3] > 0.9 and abs(f[0, 2] - 100) < 40 and f[1, 5] == 0.0  # the last chunk is padded


def test_long_keys_of_peaks(spark):
    df = spark.range(60_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(1.0).alias("v"))
    assert Q.greedy_peaks(df, ["k"], "i", "v", F.lit(1.0), 2).count() == 29_999


def test_cells(spark):
    r = spark.range(1).select(
        X.general(F.lit(1234567.0)).alias("a"), X.general(F.lit(0.5)).alias("b"), X.general(F.lit(None).cast("double")).alias("c"), X.dbfs_cell(F.lit(-6.0206)).alias("d"), X.dbfs_cell(F.lit(float("-inf"))).alias("e"),
        X.quoted(F.lit("it's")).alias("f"), X.first_line(F.lit("  one \r\ntwo")).alias("g"), X.first_line(F.lit("x" * 99)).alias("h"), X.first_line(F.lit(None).cast("string")).alias("i"),
        X.json_get(F.lit('{"a":{"b":3}}'), "$.a.b", F.lit("0")).alias("j"), X.json_get(F.lit("no"), "$.a", F.lit("0")).alias("k"), X.clip_stamp(F.lit("2024-03-05").cast("date")).alias("l"), X.two_decimals(F.lit(None).cast("double")).alias("m"),
    ).first()
    assert tuple(r) == ("1.23457e+06", "0.5", "—", "-6.02 dBFS", "-inf dBFS", "it''s", "one", "x" * 80, "", "3", "0", "20240305", "—")


def test_outside_tools(spark, tmp_path):
    logs = ["  Stream #0:0: Audio: vorbis, 44100 Hz, stereo, fltp", "Stream #0:1(eng): Audio: aac (LC), 48000 Hz, 5.1(side), s16", "Stream #0:0: Audio: pcm, 8000 Hz, 3 channels, s16", "Stream #0:0: Audio: x, 8000 Hz, odd, s16", "nothing"]
    got = [tuple(r["i"]) for r in spark.createDataFrame(list(enumerate(logs)), "k int, v string").orderBy("k").select(external.stream_info(F.col("v")).alias("i")).collect()]
    assert got == [("vorbis", 44100, 2, "fltp"), ("aac", 48000, 6, "s16"), ("pcm", 8000, 3, "s16"), ("x", 8000, 1, "s16"), ("unknown", 44100, 2, "s16")]
    assert [external.parse_stream(x) for x in logs] == [(r, c) for _, r, c, _ in got]
    meter = "  I:  -70.0 LUFS\n...\n  I:         -20.1 LUFS\n  LRA:  3.2 LU\n  True peak:\n    Peak:       -inf dBFS\n"
    assert tuple(external.loudness(spark.createDataFrame([("a", meter), ("b", "")], "path string, value string")).orderBy("path").first()) == ("a", -20.1, 3.2, None)
    pcm = struct.pack("<4h", 1, -1, 2, -2)
    script = f"import sys; sys.stdin.buffer.read(); sys.stderr.write('Stream #0:0: Audio: ogg, 8000 Hz, stereo, fltp'); sys.stdout.buffer.write({pcm!r})"
    (tmp_path / "a.ogg").write_bytes(b"x")
    (tmp_path / "b.ogg").write_bytes(b"y")
    r = media.read_audio(spark, str(tmp_path), [".ogg"], external.command_decoder([sys.executable, "-c", script])).first()
    assert (r["sample_rate"], r["channels"], r["chans"], r["decoded_via"], r["error"]) == (8000, 2, [[1, 2], [-1, -2]], "external", None)
    bad = media.read_audio(spark, str(tmp_path), [".ogg"], external.command_decoder([sys.executable, "-c", "import sys; sys.exit('broken')"])).first()
    assert bad["error"] == "exit code 1, 0 bytes decoded; log: broken" and bad["chans"] == []
    mono = external.read_mono(spark, str(tmp_path), lambda b: (4, np.array([0.5, -0.5])), [".ogg"])
    heard = external.transcribe(mono, lambda: lambda rate, x: [(0.0, len(x) / rate, "hi")]).collect()
    assert sorted((r["start"], r["end"], r["text"]) for r in heard) == [(0.0, 0.5, "hi")] * 2
    assert external.read_mono(spark, str(tmp_path), None, [".ogg"]).filter("error is not null and samples is null").count() == 2
    assert external.read_frames(spark, str(tmp_path), lambda b: [b, b"z"], [".ogg"]).filter("clip like '%a.ogg'").orderBy("idx").select("pixels").first()[0] == b"x"
    frames = spark.createDataFrame([("f/c/f_00002.jpg", 2048), ("f/c/f_00001.jpg", 1024)], "path string, length long")
    assert [tuple(r) for r in external.complexity(frames, 2.0).orderBy("t").collect()] == [("f/c", 0.0, 1.0), ("f/c", 0.5, 2.0)]


def test_snapshots_and_folders(spark, tmp_path):
    on = {"capturedAt": "t1", "connection": {"remote": {"isConnected": True}}, "performanceMonitor": {"return": [{"id": "1", "name": "cpu", "value": 2.5}]}, "voices": {"return": [{"objectName": "o", "gameObjectID": 7, "isVirtual": False}]}}
    off = on | {"capturedAt": "t0", "connection": {}}
    (tmp_path / "s.json").write_text("\n".join(map(json.dumps, (on, off))))
    s = external.read_snapshots(spark, f"{tmp_path}/s.json")
    assert [(r["captured_at"], r["connected"]) for r in s.orderBy("captured_at").collect()] == [("t0", False), ("t1", True)]
    assert [tuple(r) for r in external.counters(s).collect()] == [("t1", "1", "cpu", 2.5)] and external.voices(s).first()["gameObjectID"] == 7
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "old.wav").write_bytes(b"1")
    poll = lambda **k: sorted(r["path"].rsplit("/", 1)[1] for r in external.poll_folder(spark, f"{tmp_path}/w", f"{tmp_path}/seen", **k).collect())
    assert poll(first=True) == []
    (tmp_path / "w" / "new.wav").write_bytes(b"2")
    assert poll(settle_s=3600) == [] and poll(settle_s=0) == ["new.wav"] and poll(settle_s=0) == []
    (tmp_path / "bad.json").write_text("{")
    assert media.read_report(spark, f"{tmp_path}/bad.json", tolerant=True).count() == 0
    with pytest.raises(Exception):  # noqa: B017
        media.read_report(spark, f"{tmp_path}/bad.json").collect()


def test_reports_sections_and_state(spark, tmp_path):
    states = spark.createDataFrame([("c", 10.0, 11.0, 1.0, 5.0), ("c", 9.5, 9.8, 0.3, 2.0)], "clip string, start double, end double, duration double, bright double")
    bands = spark.createDataFrame([(0.72, 1.0, 3.0), (0.74, 2.0, 1.0)], "start double, score double, amplitude double")
    lines = [r["line"] for r in sections.in_order(sections.timeline_report(states, "clip", bands)).collect()]
    assert lines[4].startswith("| 0.74") and lines[9] == "| c | 9.50 | 9.80 | 0.30 | 2.00 |" and lines[10].startswith("| c | 10.00")
    schema = "path string, change string, severity string, deltas array<struct<metric:string,before:double,after:double,delta:double>>, notes array<string>, new_fails array<string>"
    diff = spark.createDataFrame([("n", "added", None, [], [], []), ("x", "changed", "FAIL", [("lufs", -20.0, -18.0, 2.0)], ["channels"], ["clipping"])], schema)
    lines = [r["line"] for r in sections.in_order(sections.compare_report(diff, L.compare_summary(diff))).collect()]
    assert "| 1 | 0 | 1 | 1 |" in lines and lines[-1] == "| x | FAIL | channels | lufs -20.0 → -18.0 | clipping |"
    found = spark.createDataFrame([("offset", "FAIL", "2", 0.9, 400.0, True)], "category string, severity string, idx string, similarity double, offset_ms double, confirmed boolean")
    lines = [r["line"] for r in sections.in_order(sections.alignment_report(found, I.difference_counts(found), I.offset_stats(found))).collect()]
    assert "| offset | 0 | 1 |" in lines and lines[-1] == "| 2 | FAIL | 400 | 0.9 | confirmed |"
    d = spark.createDataFrame([("c", 5, -20.0, 0.4)], "clip string, n long, median double, loud_share double")
    w = spark.createDataFrame([("c", 8, 12, -10.0), ("c", 4, 8, -11.0)], "clip string, start int, end int, mean double")
    assert sections.in_order(sections.profile_report(d, w, "clip")).collect()[-1]["line"] == "| c | 5 | -20.0 | 40% | 4–8 (-11.0), 8–12 (-10.0) |"
    seg = spark.createDataFrame([("c", 1, 1, 5, 5, 0.1, 2.0, 100.0, 0.5, 0.2, None)], "clip string, segment int, first_step int, last_step int, steps long, start_s double, end_s double, mean_centroid_hz double, mean_low_ratio double, mean_decay double, boundary_step int")
    tr = spark.createDataFrame([], "clip string, boundary_step int, distance_to_previous double, distance_to_next double, is_transition boolean")
    assert sections.in_order(sections.steps_report(seg, tr, "clip")).collect()[4]["line"].endswith("| 0.2 | — |")
    judged = spark.createDataFrame([("p", "WARN", [("a", "INFO", {}), ("b", "WARN", {"k": "v"})]), ("q", "PASS", [])], "path string, status string, findings array<struct<check:string,severity:string,detail:map<string,string>>>")
    assert [json.loads(r["payload"])["findings"] for r in sections.defect_payload(judged).collect()] == [[{"check": "b", "severity": "WARN", "detail": {"k": "v"}}]]
    m = spark.createDataFrame([("p.wav", 2.0, None, 1000, [(500, 100)])], "path string, duration_s double, peak_dbfs double, sample_rate int, gaps array<struct<start:int,length:int>>")
    lines = [r["line"] for r in sections.in_order(sections.session_skeleton(m, K.gap_entries(m), "case 1")).collect()]
    assert "| p.wav | 2.00 | — | 1 |" in lines and "| p.wav | 00:00.500 | 100 |  |  |" in lines
    log = spark.createDataFrame([(0, "# a"), (1, "## 7 old"), (2, "x")], "n long, line string")
    part = spark.createDataFrame([(0, "## 7 new"), (1, "y")], "n long, line string")
    once = sections.with_section(log, "## 7", part)
    for got in (once, sections.with_section(once, "## 7", part)):
        assert [r["line"] for r in got.orderBy("n").collect()] == ["# a", "## 7 new", "y"]
    rec = spark.createDataFrame([("a", 1), ("b", 2)], "clip string, at int")
    for df in (rec, rec.filter("clip = 'a'").withColumn("at", F.lit(9))):
        sections.write_timeline(df, f"{tmp_path}/tl")
    assert {r["clip"]: r["at"] for r in spark.read.json(f"{tmp_path}/tl").collect()} == {"a": 9, "b": 2}
    for k in (1, 2):
        sections.write_state(spark, f"file://{tmp_path}/state.json", {"k": k})
    assert json.loads((tmp_path / "state.json").read_text()) == {"k": 2} and not math.isnan(1.0)


HEADER = "句号,语音起,语音止,字幕出现,字幕消失,字幕原文,备注"


def subtitles(spark, tmp_path, text, name="t.csv"):
    (tmp_path / name).write_text(text, encoding="utf-8")
    return [tuple(r)[1:] for r in media.read_subtitles(spark, str(tmp_path / name)).orderBy("line").collect()]


def test_subtitle_tables_as_people_save_them(spark, tmp_path):
    rows = subtitles(spark, tmp_path, "\ufeff" + HEADER.replace(",", " , ") + ',更多\r\n1,1.5,2,1.4,,"hello, world",note,extra\r\n\r\n,nan,inf, 3 ,4,"two\nlines ""said""", \r\n')
    assert rows == [("1", 1.5, 2.0, 1.4, None, "hello, world", "note"), ("L4", None, None, 3.0, 4.0, 'two\nlines "said"', "")]
    assert subtitles(spark, tmp_path, HEADER.replace(",", "\t") + "\nA\t1\t2\t\t\ta, b\t\n", "t.tsv") == [("A", 1.0, 2.0, None, None, "a, b", "")]
    for bad in (" ", HEADER, HEADER + "\n\n", "a,b\n1,2", HEADER + "\n1,2", HEADER + "\n1,one,2,3,4,text,", HEADER.replace("备注", "别的") + "\n1,1,2,3,4,t,"):
        with pytest.raises(Exception, match="t.csv"):
            subtitles(spark, tmp_path, bad)


def test_transcripts_that_are_cut_off_are_errors(spark, tmp_path):
    def read(text):
        (tmp_path / "s.json").write_text(text, encoding="utf-8")
        return [tuple(r) for r in media.read_segments(spark, str(tmp_path / "s.json")).collect()]

    assert read('{"segments": [{"start": "1.5", "end": 2, "text": "  said\\n"}, {"start": 2, "end": 2, "text": null}]}') == [(1.5, 2.0, "said"), (2.0, 2.0, "")]
    assert read('[{"start": 0, "end": 1, "text": "  "}]') == [(0.0, 1.0, "")] and read('{"segments": []}') == []
    for bad in ('{"segments": [{"start": 1, "end": 2, "text": "a"}, {"sta', "[1, 2", " ", '{"other": []}', '[{"start": 1, "text": "a"}]', '[{"start": "x", "end": 2}]', '[{"start": 2, "end": 1}]', "[null]"):
        with pytest.raises(Exception):  # noqa: B017
            read(bad)


def test_edits_are_kept_in_new_reports(spark):
    old = """## 一、环境（待填）
| 项目 | 值 |
| --- | --- |
| 游戏 / 版本 | 1.2 |
| `a` | 00:01 | 200 | dark | |
| `a` | 00:01 | 210 | dark room | by design |
| `b` | 00:02 | 9 | | |
- 执行次数：2（本目录内 2 个片段）
- 复现率：1 / 2（twice seen）
- 结论（PASS / FAIL / BLOCKED / 未复现）：
- 预期：
  it goes on
    and on
not under it
- 实际（写可观察事实 + 时间码）：
- 其它备注：said once
- 其它备注：said twice"""
    new = """## 一、环境（待填）
| 游戏 / 版本 |  |
| 设备 |  |
| `a` | 00:01 | 300 |  |  |
| `b` | 00:02 | 9 |  |  |
| `c` | 00:03 | 1 |  |  |
- 执行次数：3（本目录内 3 个片段）
- 复现率：__ / 3
## 四、结论（待填）
- 结论（PASS / FAIL / BLOCKED / 未复现）：
- 预期：
  a hint
- 实际（写可观察事实 + 时间码）：
  another hint
- 其它备注："""
    want = """## 一、环境
| 游戏 / 版本 | 1.2 |
| 设备 |  |
| `a` | 00:01 | 300 | dark room | by design |
| `b` | 00:02 | 9 |  |  |
| `c` | 00:03 | 1 |  |  |
- 执行次数：3（本目录内 3 个片段）
- 复现率：1 / 3（twice seen）
## 四、结论（待填）
- 结论（PASS / FAIL / BLOCKED / 未复现）：
- 预期：
  it goes on
    and on
- 实际（写可观察事实 + 时间码）：
  another hint
- 其它备注：said twice"""
    rows = lambda text, doc: [(doc, n, line) for n, line in enumerate(text.split("\n"))]
    kind = "doc string, n int, line string"
    got = edits.merge_reports(spark.createDataFrame(rows(new, "r") + rows(new, "alone"), kind), spark.createDataFrame(rows(old, "r"), kind)).orderBy("doc", "n").collect()
    assert "\n".join(r["line"] for r in got if r["doc"] == "r") == want
    assert "\n".join(r["line"] for r in got if r["doc"] == "alone") == new
    again = edits.merge_reports(spark.createDataFrame(rows(new, "r"), kind), spark.createDataFrame(rows(want, "r"), kind)).orderBy("n").collect()
    assert "\n".join(r["line"] for r in again) == want
    custom = rows("- 复现率：always", "r")
    kept = edits.merge_reports(spark.createDataFrame(rows(new, "r"), kind), spark.createDataFrame(custom, kind)).filter("line like '- 复现率%'").collect()
    assert [r["line"] for r in kept] == ["- 复现率：always"]


def test_stored_timelines_are_rendered_again(spark, tmp_path):
    rec = spark.createDataFrame([("a", "s1", 1.0, 1.25, 1.5, 0.25, True, "plug", "x", "y"), ("a", "s2", 2.0, 2.0, 2.5, 0.0, False, "pull", "y", "x"), ("b", "s1", 1.0, 1.0, 1.0, 0.0, True, "plug", "x", "y")], f"clip string, {sections.TIMELINE}")
    sections.write_timeline(rec, f"{tmp_path}/tl")
    reports = spark.createDataFrame([("a", 0, "# a"), ("a", 1, "## Device timeline"), ("a", 2, "old"), ("c", 0, "# c"), ("c", 1, "## Device timeline"), ("c", 2, "stays")], "clip string, n long, line string")
    once = sections.refresh_timelines(spark, f"{tmp_path}/tl", reports)
    lines = lambda df, clip: [r["line"] for r in df.filter(F.col("clip") == clip).orderBy("n").collect()]
    assert lines(once, "a")[0] == "# a" and "old" not in lines(once, "a") and lines(once, "a")[-1] == "- `s2` was not controlled" and lines(once, "c") == ["# c", "## Device timeline", "stays"]
    assert lines(once, "b")[0] == "## Device timeline"
    twice = sections.refresh_timelines(spark, f"{tmp_path}/tl", once)
    assert all(lines(once, c) == lines(twice, c) for c in "abc")
    sections.write_timeline(rec.filter("clip = 'a' and step = 's1'"), f"{tmp_path}/tl")
    assert len(lines(sections.refresh_timelines(spark, f"{tmp_path}/tl", reports), "a")) == 6
    # records of the first form have no version and no late_by; a later form is refused
    (tmp_path / "old" / "clip=z").mkdir(parents=True)
    (tmp_path / "old" / "clip=z" / "x.json").write_text('{"step":"s1","at":1.0,"issued_at":1.5,"ok":true}\n')
    assert sections.read_timelines(spark, f"{tmp_path}/old").first()["late_by"] == 0.5
    (tmp_path / "old" / "clip=z" / "x.json").write_text('{"step":"s1","at":1.0,"version":99}\n')
    with pytest.raises(Exception, match="later form"):
        sections.read_timelines(spark, f"{tmp_path}/old").collect()
