"""Operators that cut a long key into parts: the same results as a plain loop, and plans that gather no group."""

import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tonequarry.functions import stats
from tonequarry.operators import intervals as I
from tonequarry.operators import sequences as Q
from tonequarry.operators import takes as K
from tonequarry.plans import media
from tonequarry.sources import sections


def values(k, n):
    rng = random.Random(k)
    return [rng.choice([0.0, -1.0, 1e9 + k, rng.gauss(0, 1), rng.gauss(0, 1) * 1e-6, float(rng.randrange(5))]) for _ in range(n)]


def test_ranks_by_group(spark):
    groups = {"a": values(1, 5000), "b": [7.0] * 300, "c": [1.5], None: values(2, 41), "d": [None], "e": [1e9 + k / 8 for k in range(400)], "f": [float("nan"), 1.0, float("inf"), -float("inf"), 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double").repartition(5)
    n = F.col("n")
    got = {r["k"]: r for r in stats.ranks_by(df, ["k"], "v", {"low": (0.0, F.lit(0)), "mid": (0.5, F.floor(n / 2)), "p90": (0.9, F.bround(0.9 * (n - 1), 0)), "top": (1.0, n - 1)}).collect()}
    assert set(got) == set(groups) - {"d"}
    for k, r in got.items():
        v = sorted(groups[k], key=lambda x: (math.isnan(x), x))
        for pick, at in (("low", 0), ("mid", len(v) // 2), ("p90", round(0.9 * (len(v) - 1))), ("top", len(v) - 1)):
            assert r[pick] == v[at] or (math.isnan(r[pick]) and math.isnan(v[at])), (k, pick)
        assert r["n"] == len(v)
    weighted = df.filter("k in ('a', 'b')").groupBy("k", "v").count()
    for r in stats.ranks_of_counts(weighted, ["k"], "v", "count", {"mid": F.floor(n / 2)}).collect():
        assert r["mid"] == got[r["k"]]["mid"] and r["n"] == got[r["k"]]["n"]
    for r in stats.median_mad(df.filter("k <> 'f'"), ["k"], "v").collect():
        v = [x for x in groups[r["k"]] if x is not None]
        if v:
            assert r["median"] == pytest.approx(float(np.median(v))) and r["mad"] == pytest.approx(float(np.median(np.abs(np.array(v) - np.median(v)))))
        else:
            assert r["n"] == 0 and r["median"] is None and r["mad"] is None


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_plan_gathers_a_group(spark):
    e = spark.createDataFrame([(1, float(k), float(k % 7)) for k in range(50)], "u int, t double, v double")
    states = e.select("u", F.col("t").alias("start"), (F.col("t") + 0.5).alias("end"))
    seg = Q.change_points(e, ["u"], ["t"], F.array("v"))
    gaps = e.select("u", F.col("t").cast("long").alias("gap"), F.col("t").alias("time_s"), F.lit(None).cast("double").alias("inside_kb"))
    for df in (
        Q.density(e, ["u"], value="v"),
        I.gap_stats(states, ["u"]),
        seg,
        Q.transitions(seg, ["u"]),
        Q.step_gap_stats(Q.step_gaps(e, ["u"], "t"), ["u"]),
        K.triage(gaps, e.select("u", "t", F.col("v").alias("kb")), ["u"], "gap"),
        stats.median_mad(e, ["u"], "v"),
    ):
        text = plan(df)
        assert "collect_list" not in text and "percentile(" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_rolling_median_over_parts(spark, monkeypatch):
    monkeypatch.setattr(Q, "PART", 16)
    rng = random.Random(9)
    rows = [("a", float(k // 2), k, rng.choice([None, rng.random(), 1.0])) for k in range(150)] + [("b", 3.0, 0, 2.0), (None, 1.0, 0, 5.0), (None, 2.0, 1, 7.0)]
    df = spark.createDataFrame(rows, "k string, t double, i int, v double").repartition(4)
    got = {(r["k"], r["i"]): r["rolling_median"] for r in Q.rolling_median(df, ["k"], ["t", "i"], "v", 5, 10.0).collect()}
    by = defaultdict(list)
    for k, _, i, v in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        by[k].append((i, v))
    assert len(got) == len(rows)
    for k, own in by.items():
        for at, (i, _) in enumerate(own):
            near = [v for _, v in own[max(0, at - 5) : at + 6] if v is not None]
            assert got[k, i] == (pytest.approx(float(np.median(near))) if near else None)


@pytest.mark.parametrize("block", [5, 9, 64, None])
def test_greedy_peaks_over_blocks(spark, block):
    rng = random.Random(block)
    rows, want = [], set()
    for key in ("a", "b", "c", None):
        v = [rng.choice([0.0, 1.0, 2.0, 3.0]) for _ in range({"b": 2}.get(key, 220))]
        if key == "c":
            v[40:160] = [0.0] * 120  # blocks without candidates
        rows += [(key, k, x) for k, x in enumerate(v)]
        last = None
        for k in range(1, len(v) - 1):
            if v[k] >= 2 and v[k] >= v[k - 1] and v[k] >= v[k + 1] and (last is None or k - last >= 5):
                want.add((key, k))
                last = k
    df = spark.createDataFrame(rows, "u string, k int, v double").repartition(3)
    assert {(r["u"], r["k"]) for r in Q.greedy_peaks(df, ["u"], "k", "v", F.lit(2.0), 5, block).collect()} == want


def test_intervals_of_any_length(spark):
    rng = random.Random(2)
    side = lambda n, most: [(rng.choice(["a", "b"]), s := rng.random() * 1000, s + rng.choice([0.0, rng.random(), rng.random() * most])) for _ in range(n)]
    left, right = [*side(120, 300), ("a", 0.0, 1e6), ("a", 5.0, 4.0)], [*side(120, 30), ("b", -1e6, 1e6), ("c", 0.0, 1.0)]
    a = spark.createDataFrame([(k, *r) for k, r in enumerate(left)], "i int, k string, start double, end double")
    b = spark.createDataFrame([(k, *r) for k, r in enumerate(right)], "j int, k string, start double, end double")
    want = {(i, j) for i, (k, s, e) in enumerate(left) for j, (m, u, v) in enumerate(right) if k == m and s < v and u < e}
    for bucket in (0.25, 4.0, 1000.0):
        got = [(r["i"], r["j"]) for r in I.overlap_join(a, b, ["k"], bucket).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        hit = {i for i, _ in want}
        assert {r["i"] for r in I.covered(a, b, ["k"], bucket).collect()} == hit
        assert {r["i"] for r in I.covered(a, b, ["k"], bucket, missing=True).collect()} == set(range(len(left))) - hit
    # one row over everything costs two copies for each doubling at most
    levels = (I._levelled(x, "start", "end", 4.0) for x in (a, b))
    la, lb = levels
    copies = I._cells(la, lb, ["k"], "start", "end", 4.0, "1").groupBy("i").count().collect()
    assert max(r["count"] for r in copies) <= 2 * math.log2(2e6 / 4.0) + 2


def test_numbered_rows(spark):
    rows = [(k % 3, float(k % 50), k) for k in range(300)]
    df = spark.createDataFrame(rows, "k int, t double, i int").repartition(6)
    by = defaultdict(list)
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by[k].append(i)
    assert {(r["k"], r["i"]): r["_n"] for r in Q.numbered(df, ["k"], ["t", "i"], 7.0).collect()} == {(k, i): n for k, own in by.items() for n, i in enumerate(own)}


@pytest.mark.parametrize("name, source, order", [("t03_differences_in_order", "orders", lambda r: (r["o_orderkey"] % 4, str(r["o_orderkey"]))), ("t04_gaps_in_order", "events", lambda r: (r["user_id"], r["event_id"] / 4.0)), ("t01_results_in_order", "part", lambda r: r["p_name"] + str(r["p_partkey"])), ("t02_duplicates_in_order", "part", lambda r: (-(r["p_size"] % 4), r["p_name"] + str(r["p_partkey"])))])
def test_places_of_a_sort_by_few_samples(spark, sf, tmp_path, name, source, order):
    """Bounds from few samples differ from one sort of the same rows to the next; every row has its place all the same."""
    spark.read.parquet(f"{sf}/{source}.parquet").repartition(5).write.parquet(f"{tmp_path}/{source}.parquet")
    few = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        got = [tuple(r) for r in media.QUERIES[name](spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = sorted(spark.read.parquet(f"{sf}/{source}.parquet").collect(), key=order)
    assert sorted(got, key=lambda r: r[1]) == [(r[0], k) for k, r in enumerate(rows)]


def test_no_task_sorts_the_lines_of_a_clip(spark, monkeypatch):
    held, kept = {}, sections.stored

    def stored(df, tag):
        held[tag] = kept(df, tag)
        return held[tag]

    monkeypatch.setattr(sections, "stored", stored)
    monkeypatch.setattr(sections, "BROADCAST_ROWS", 3)  # some joins are by shuffle
    rows = [("long", f"s{k}", float(k * 7 % 400), k % 3 > 0 if k % 5 else None) for k in range(2000)] + [("short", "x", 1.0, False), (None, "y", 1.0, True)]
    rec = spark.createDataFrame([(c, s, t, t, t, 0.0, ok, "set", "a", "b") for c, s, t, ok in rows], f"clip string, {sections.TIMELINE}").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lines = sections.timeline_lines(rec)
        got = sorted((r["clip"] or "", r["n"], r["line"]) for r in lines.collect())
        again = sections.with_sections(lines.filter("clip is not null"), "## Device", lines.filter("clip is not null"))
        assert sorted((r["clip"], r["n"], r["line"]) for r in again.collect()) == [r for r in got if r[0]]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for clip in ("long", "short", None):
        own = [r for r in rows if r[0] == clip]
        body = [x[1] for x in sorted((t, s) for _, s, t, _ in own)] + [f"{s}!" for _, s in sorted((t, s) for _, s, t, ok in own if ok is False)]
        mine = [(n, line) for c, n, line in got if c == (clip or "")]
        assert [n for n, _ in mine] == list(range(len(body) + 4))
        assert [line.split(" | ")[0][2:] if line[0] == "|" else line.split("`")[1] + "!" for _, line in mine[4:]] == body
    of = held["lines"].groupBy(F.shiftright("_row", 33)).count().collect()
    assert len(of) == 4 and max(r["count"] for r in of) < 1200


@pytest.mark.parametrize("name, source, key, nulls", [("t01_results_in_order", "part", "p_partkey", ["p_name"]), ("t02_duplicates_in_order", "part", "p_partkey", ["p_name", "p_size"]), ("t04_gaps_in_order", "events", "event_id", ["user_id", "event_id"]), ("t03_differences_in_order", "orders", "o_orderkey", ["o_orderkey"])])
def test_nulls_come_last_as_in_sql(spark, sf, tmp_path, name, source, key, nulls):
    """One row for each column lacks its value; a null that came first would move every place."""
    rows = spark.read.parquet(f"{sf}/{source}.parquet")
    rows.withColumns({c: F.when(~F.col(key).eqNullSafe(3 + k), F.col(c)) for k, c in enumerate(nulls)}).write.parquet(f"{tmp_path}/{source}.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {source} AS SELECT * FROM read_parquet('{tmp_path}/{source}.parquet/*.parquet')")
    want = db.execute(media.SQL[name]).fetchall()
    assert sorted(map(tuple, media.QUERIES[name](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
