"""Streams with state and timers: replayed in pieces, out of order, over restarts; the log as a data source."""

import json
import random
import time

from pyspark.sql import functions as F

from tonequarry.operators import takes as K
from tonequarry.streaming import event_log, live, recorder

EVENTS = "recorder string, ts timestamp, seq long, state string, path string"


def replay(spark, home, rows, schema, fold, batches=3, ahead=True):
    """Write rows in batches, each followed by a run of the stream from its checkpoint; what the sink holds at last."""
    out = []
    for k in range(batches):
        spark.createDataFrame(rows[k::batches], schema).coalesce(1).write.mode("append").parquet(f"{home}/in")
        out.append(_run(spark, home, schema, fold))
    if ahead:
        far = spark.createDataFrame(rows[:1], schema).withColumn("ts", F.lit("2100-01-01").cast("timestamp"))
        far.select(*[F.lit("none").alias(c) if c in ("recorder", "path") and c == schema.split()[0] else c for c in far.columns]).coalesce(1).write.mode("append").parquet(f"{home}/in")
        out.append(_run(spark, home, schema, fold))
    return spark.read.parquet(f"{home}/out"), out


def _run(spark, home, schema, fold):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    q = fold(stream).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{home}/out").count()


def test_takes_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    rng = random.Random(4)
    rows, seq = [], 0
    for name in ("a", "b", "c"):
        t = 1_700_000_000
        for _ in range(60):
            t += rng.choice([0, 1, 5])  # some at one instant
            seq += 1
            rows.append((name, t, seq, rng.choice(["started", "stopped", "stopping", "mark"]), f"{name}{seq}.mkv"))
    batch = spark.createDataFrame([(n, float(t), s, e, p) for n, t, s, e, p in rows], "recorder string, t double, seq long, state string, path string")
    cols = ["recorder", "take", "started", "stopped", "path", "n_marks", "first_mark"]
    want = sorted(tuple(r[c] for c in cols) for r in recorder.takes_with_marks(batch).collect())
    rng.shuffle(rows)
    stamped = [(n, _time(t), s, e, p) for n, t, s, e, p in rows]
    got, counts = replay(spark, tmp_path, stamped, EVENTS, lambda s: live.live_takes(s, "10 minutes"))
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == want and len(want) > 20
    assert counts[:-1] == [0, 0, 0]  # nothing comes before the watermark has passed it


def _time(s):
    import datetime

    return datetime.datetime.fromtimestamp(s, datetime.UTC)


def test_takes_come_as_the_watermark_passes(spark, tmp_path):
    e = lambda n, t, s, x: (n, _time(1_700_000_000 + t), s, x, "p")
    rows = [e("a", 0, 1, "started"), e("a", 4, 2, "mark"), e("a", 9, 3, "stopped"), e("b", 100, 4, "started"), e("b", 200, 5, "started"), e("b", 230, 6, "stopped"), e("a", 300, 7, "stopped")]
    got, counts = replay(spark, tmp_path, rows, EVENTS, lambda s: live.live_takes(s, "20 seconds"), batches=1)
    assert counts == [2, 2]  # both are closed twenty seconds before the last event
    assert sorted((r["recorder"], r["take"], r["stopped"] - r["started"], r["n_marks"], r["first_mark"]) for r in got.collect()) == [("a", 1, 9.0, 1, 4.0), ("b", 1, 30.0, 0, None)]


def test_stable_files_of_a_stream(spark, tmp_path):
    polls = [("a", 0, 5), ("a", 1, 9), ("a", 2, 9), ("a", 3, 9), ("b", 0, 0), ("b", 1, 0), ("b", 30, 7), ("c", 5, 1), ("c", 6, 2), ("d", 0, None), ("d", 1, 4), ("d", 1, 4)]
    rows = [(p, _time(1_700_000_000 + t), k, s) for k, (p, t, s) in enumerate(polls)]
    got, _ = replay(spark, tmp_path, rows[::-1], "path string, ts timestamp, seq long, size long", lambda s: live.live_stable_files(s, 25.0, "1 hour").filter("path <> 'none'"), ahead=True)
    batch = spark.createDataFrame([(p, 1.7e9 + t, k, s) for k, (p, t, s) in enumerate(polls)], "path string, t double, seq long, size long")
    cols = ["path", "ready_at", "ready", "settled"]
    want = sorted(tuple(r[c] for c in cols) for r in K.stable_files(batch, ["path"], timeout=25.0).collect())
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == want


def test_growing_file_comes_once_when_it_has_settled(spark, tmp_path):
    src, sink = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for name in ("grows.wav", "still.wav", "empty.wav"):
        (src / name).write_bytes(b"x" if name != "empty.wav" else b"")
    sizes = tmp_path / "grown"
    sizes.write_text("0")

    def size(path):
        if not path.endswith("grows.wav"):
            return live.file_size(path)
        n = int(sizes.read_text()) + 1  # it grows at each of the first four looks
        sizes.write_text(str(n))
        return min(n, 4)

    files = recorder.watch_files(spark, str(src), "*.wav")
    q = live.settled_files(files, 0.2, 60.0, size).writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="200 milliseconds").start()
    told = lambda: spark.read.schema("path string, settled boolean, length long, elapsed double").parquet(str(sink)).collect() if (sink / "_spark_metadata").exists() else []
    try:
        limit, rows = time.time() + 90, []
        while time.time() < limit and len(rows) < 2:
            time.sleep(0.5)
            rows = told()
        time.sleep(1.5)
        rows = told()
    finally:
        q.stop()
    found = {r["path"].rsplit("/", 1)[1]: (r["settled"], r["length"]) for r in rows}
    # Spark's file source passes over files of no bytes
    assert found == {"grows.wav": (True, 4), "still.wav": (True, 1)} and len(rows) == 2


def test_what_never_holds_comes_at_its_timeout(spark, tmp_path):
    home = str(tmp_path)
    spark.createDataFrame([("never",), ("later",), ("fails",)], "name string").coalesce(1).write.parquet(f"{home}/in")
    asked = tmp_path / "asked"
    asked.write_text("")

    def probe(name, last):
        if name == "fails":
            raise OSError("not there")
        n = int(last or 0) + 1
        return name == "later" and n >= 3, str(n)

    stream = spark.readStream.schema("name string").parquet(f"{home}/in")
    q = live.polled(stream, "name", probe, 0.1, 2.0).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(processingTime="100 milliseconds").start()
    try:
        limit = time.time() + 90
        rows = []
        while time.time() < limit and len(rows) < 3:
            time.sleep(0.5)
            rows = spark.read.schema("name string, met boolean, answer string, tries long, elapsed double").parquet(f"{home}/out").collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    finally:
        q.stop()
    found = {r["name"]: r for r in rows}
    assert len(rows) == 3 and found["later"]["met"] and found["later"]["tries"] == 3
    for name in ("never", "fails"):
        assert not found[name]["met"] and found[name]["elapsed"] >= 2.0
    assert int(found["never"]["answer"]) == found["never"]["tries"] and found["fails"]["answer"] is None


def frame(recorder_, at, state, path=None, kind="RecordStateChanged"):
    return json.dumps({"recorder": recorder_, "at": at, "frame": {"op": 5, "d": {"eventType": kind, "eventData": {"outputActive": True, "outputState": state, "outputPath": path}}}})


def test_recorder_log_is_read_exactly_once_over_restarts(spark, tmp_path):
    spark.dataSource.register(event_log.RecorderLog)
    log = tmp_path / "log"
    log.mkdir()

    def run():
        s = spark.readStream.format("recorder_log").option("path", str(log)).option("partBytes", "300").load()
        q = s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["recorder"], r["seq"], r["state"], r["path"], bool(r["error"])) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["recorder"])

    first = [frame("a", 1.7e9 + k, "PREFIX_OUTPUT_STARTED" if k % 2 == 0 else "STOPPED", f"{k}.mkv") for k in range(20)]
    half = frame("a", 1.7e9 + 50, "STOPPING")
    (log / "a.log").write_text("\n".join(first) + "\n" + half[:40])  # a line that is still being written
    (log / "b.log").write_text(frame("b", 1.7e9, "PAUSED") + "\n" + frame("b", 1.7e9, "", kind="Other") + "\nno json\n\n")
    got = run()
    assert [r[2] for r in got if r[0] == "a"] == ["started", "stopped"] * 10 and [r[2] for r in got if r[0] == "b"] == ["other"]
    assert run() == got  # nothing new, nothing twice
    with (log / "a.log").open("a") as f:
        f.write(half[40:] + "\n" + frame("a", 1.7e9 + 60, "STARTED") + "\n")
    (log / "c.log").write_text(frame("c", 1.7e9, "STARTED") + "\n")
    more = run()
    assert len(more) == len(got) + 3 and set(got) < set(more) and [r[2] for r in more if r[0] == "a"][-2:] == ["stopping", "started"]
    assert len({(r[0], r[1]) for r in more}) == len(more)
    batch = spark.read.format("recorder_log").option("path", str(log)).load()
    assert sorted((r["recorder"], r["seq"], r["state"], r["path"], bool(r["error"])) for r in batch.collect() if r["recorder"]) == more
    assert [r["error"] for r in batch.filter("error is not null").collect()][0].startswith("JSONDecodeError")
    # a stretch of any length holds whole lines
    whole = event_log._Log({"path": str(log)})
    for size in (1, 7, 64, 10_000):
        some = event_log._Log({"path": str(log), "partBytes": size})
        assert [x for p in some.ranges({}, some.ends()) for x in some.read(p)] == [x for p in whole.ranges({}, whole.ends()) for x in whole.read(p)]


def test_state_is_kept_by_bucket_of_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "BUCKETS", 8)
    big = 2**53
    # long keys and values beyond what a double holds, beside nulls; sizes of two polls are equal or differ by one
    polls = [(None if k == 7 else big + k, _time(1_700_000_000 + t), t, None if t == 0 else big + t // (1 + k % 2)) for k in range(60) for t in range(3)]
    schema = "recorder long, ts timestamp, seq long, size long"
    spark.createDataFrame(polls, schema).repartition(2).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([(0, _time(2_000_000_000), 0, 1)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = live.live_stable_files(stream, 25.0, "1 hour", "recorder").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"]) <= 9
    got = {r["recorder"]: (r["ready_at"] - 1.7e9, r["ready"], r["settled"]) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r["recorder"] != 0}
    want = {}
    for k in range(60):
        sizes = [None, *[big + t // (1 + k % 2) for t in (1, 2)]]
        want[None if k == 7 else big + k] = (2.0, True, sizes[1] == sizes[2])
    assert got == want and not any(settled for _, _, settled in got.values())
