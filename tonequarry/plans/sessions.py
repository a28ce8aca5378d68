"""Queries on sessions: cross-checks, takes, devices, macros, injected faults, polls and replies, cells of reports, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.functions import text as X
from tonequarry.operators import crosscheck as C
from tonequarry.operators import edits as E
from tonequarry.operators import injection as J
from tonequarry.operators import intervals as I
from tonequarry.operators import library as L
from tonequarry.operators import predicates as P
from tonequarry.operators import rules as R
from tonequarry.operators import sequences as Q
from tonequarry.operators import takes as K
from tonequarry.plans import media, timelines
from tonequarry.plans.media import table
from tonequarry.plans.timelines import _EV, _HIT, _OV, _STEPS, BUCKET, _events, _segmented, _sides
from tonequarry.sources import sections as T
from tonequarry.sources.shared import shared_folder
from tonequarry.streaming import live, recorder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# --- text and activity ------------------------------------------------------------


@query(f"""WITH {_EV}, p AS (SELECT a.id, any_value(a.start) AS s, any_value(a."end") AS e, coalesce(max(CASE WHEN b.id IS NOT NULL THEN {_OV} END), 0) AS o FROM a LEFT JOIN b ON {_HIT} GROUP BY a.id),
v AS (SELECT b.id, any_value(b.start) AS s, any_value(b."end") AS e, coalesce(max(CASE WHEN a.id IS NOT NULL THEN {_OV} END), 0) AS o FROM b LEFT JOIN a ON {_HIT} WHERE b.user_id IN (SELECT user_id FROM a) GROUP BY b.id),
g AS (SELECT id, "end", lead(start) OVER (PARTITION BY user_id ORDER BY start, "end") - "end" AS gap FROM b)
SELECT 'text_without_voice' AS kind, CAST(id AS VARCHAR) AS subject, s AS at FROM p WHERE o / greatest(e - s, 0.001) < 0.2
UNION ALL SELECT 'voice_without_text', CAST(id AS VARCHAR), s FROM v WHERE e - s >= 0.15 AND o < 0.2 * (e - s)
UNION ALL SELECT 'no_gap_between', CAST(id AS VARCHAR), "end" FROM g WHERE gap >= 0 AND gap <= 20000""")
def r26_crosscheck(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return C.findings(a, b.withColumnRenamed("id", "act"), ["user_id"], BUCKET, "id", "act", 20000.0).select("kind", "subject", "at")


@query(f"""WITH {_EV}, s AS (SELECT id, user_id, start, start + value / 1000 AS "end" FROM b), m AS (SELECT s.id, max(greatest(0.0, least(a."end", s."end") - greatest(a.start, s.start))) AS most FROM a JOIN s ON a.user_id = s.user_id AND a.start < s."end" AND s.start < a."end" GROUP BY s.id)
SELECT s.id FROM s LEFT JOIN m ON s.id = m.id WHERE s.user_id IN (SELECT user_id FROM a) AND s."end" - s.start >= 0.15 AND coalesce(most, 0) < 0.2 * (s."end" - s.start)""")
def p11_min_activity(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    b = b.withColumn("end", F.col("start") + F.col("value") / 1000)
    return I.least_covered(b.select("user_id", "id", "start", "end"), a, ["user_id"], BUCKET, "id").select("id")


@query(f"""WITH {_EV} SELECT user_id, 1 - sum("end" - start) / 259200.0 >= 0.05 AS usable FROM ev GROUP BY user_id""")
def r28_usable(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = I.silence_share(e, e.select("user_id").distinct().withColumn("duration", F.lit(259200.0)), ["user_id"])
    return s.select("user_id", C.usable(F.col("silence_share")).alias("usable"))


# --- gaps and takes ---------------------------------------------------------------


_V = [v.replace("'", "''") for v in K.GAP_VERDICTS]


@query(f"""WITH {_EV}, act AS (SELECT user_id, start, value FROM b WHERE user_id % 10 <> 0), m AS (SELECT user_id, list_sort(list(value))[count(*) // 2 + 1] AS med FROM act GROUP BY 1),
n AS (SELECT a.id, act.value AS kb FROM a JOIN act ON a.user_id = act.user_id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(act.start - a.start), act.start, act.value) = 1)
SELECT a.id, CASE WHEN med IS NULL THEN '{_V[0]}' WHEN CASE WHEN a.id % 4 = 0 THEN a.value ELSE kb END < med * 0.5 THEN '{_V[1]}' ELSE '{_V[2]}' END AS verdict FROM a LEFT JOIN m ON a.user_id = m.user_id LEFT JOIN n ON n.id = a.id""")
def r24_gap_triage(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    gaps = a.select("user_id", "id", F.col("start").alias("time_s"), F.when(F.col("id") % 4 == 0, F.col("value")).alias("inside_kb"))
    activity = b.filter("user_id % 10 <> 0").select("user_id", F.col("start").alias("t"), F.col("value").alias("kb"))
    return K.triage(gaps, activity, ["user_id"], "id", step=86400.0).select("id", "verdict")


def _entries(spark, sf_dir):
    return K.gap_entries(R.measure(media.signals(spark, sf_dir), media.CFG))


@query(f"""WITH {media._SIG}, {media._GAP4}, g AS (SELECT vec_id, w0, k, row_number() OVER (PARTITION BY vec_id ORDER BY w0) AS gap FROM hi WHERE w0 > 0 AND w0 + k < 16)
SELECT replace(path, '.wav', '') AS stem, gap, CAST(w0 * 10 AS BIGINT) AS at_ms, CAST(k * 10 AS BIGINT) AS ms FROM g JOIN sig USING (vec_id) WHERE vec_id % 2 = 0""")
def j16_take_gaps(spark, sf_dir):
    stems = media.signals(spark, sf_dir).filter("vec_id % 2 = 0").select(X.stem(F.col("path")).alias("stem"))
    whole = lambda c: F.round(c).cast("long")
    return K.take_gaps(_entries(spark, sf_dir), stems).select("stem", F.col("gap").cast("long"), whole(F.col("time_s") * 1000).alias("at_ms"), whole(F.col("duration_ms")).alias("ms"))


@query("""SELECT lpad(CAST(s.p_partkey + 5 AS VARCHAR), 8, '0') AS stem, coalesce(p.p_size, 0)::DOUBLE AS duration_s FROM part s LEFT JOIN part p ON p.p_partkey = s.p_partkey + 5""")
def j16_take_durations(spark, sf_dir):
    files = media._part_files(spark, sf_dir).select("path", F.col("sample_rate").cast("double").alias("duration_s"))
    stems = table(spark, sf_dir, "part").select(F.format_string("%08d", F.col("p_partkey") + 5).alias("stem"))
    return K.take_durations(files, stems)


# --- steps ------------------------------------------------------------------------


@query(f"""WITH {_STEPS}, f AS (SELECT user_id, segment, step, event_id, round(value * 100) AS c, event_id % 100 AS l, event_id % 7 AS d0 FROM c)
SELECT user_id, CAST(segment AS BIGINT) AS segment, min(step) AS first_step, max(step) AS last_step, count(*) AS steps, min(event_id)::DOUBLE AS start_s, max(event_id)::DOUBLE AS end_s,
 CAST(round(round_even(avg(c), 1) * 10) AS BIGINT) AS c10, CAST(round(round_even(avg(l), 4) * 10000) AS BIGINT) AS l4, CAST(round(round_even(avg(d0), 4) * 10000) AS BIGINT) AS d4, CASE WHEN segment > 1 THEN min(step) END AS boundary_step FROM f GROUP BY user_id, segment""")
def g17_segment_means(spark, sf_dir):
    s = _segmented(spark, sf_dir).withColumns({"onset": F.col("event_id").cast("double"), "centroid_hz": F.round(F.col("value") * 100), "low_ratio": (F.col("event_id") % 100).cast("double"), "decay": (F.col("event_id") % 7).cast("double")})
    m = Q.segment_means(s, ["user_id"])
    whole = lambda c, k: F.round(F.col(c) * k).cast("long")
    steps = [F.col(c).cast("long").alias(c) for c in ("first_step", "last_step", "steps", "boundary_step")]
    return m.select("user_id", "segment", *steps, "start_s", "end_s", whole("mean_centroid_hz", 10).alias("c10"), whole("mean_low_ratio", 10000).alias("l4"), whole("mean_decay", 10000).alias("d4"))


@query(f"""WITH {_EV}, g AS (SELECT id, user_id, round_even(start - lag(start) OVER (PARTITION BY user_id ORDER BY start), 3) AS gap FROM ev) SELECT id, CAST(round(gap * 1000) AS BIGINT) AS gap_ms FROM g""")
def g19_step_gaps(spark, sf_dir):
    return Q.step_gaps(_events(spark, sf_dir), ["user_id"], "start").select("id", F.round(F.col("step_gap") * 1000).cast("long").alias("gap_ms"))


@query(f"""WITH {_EV}, g AS (SELECT user_id, round_even(start - lag(start) OVER (PARTITION BY user_id ORDER BY start), 3) AS gap FROM ev), l AS (SELECT user_id, list_sort(list(gap)) AS v FROM g WHERE gap IS NOT NULL GROUP BY 1) SELECT user_id, len(v) AS n_gaps, CAST(round(v[len(v) // 2 + 1] * 1000) AS BIGINT) AS median_ms FROM l""")
def g19_step_gap_stats(spark, sf_dir):
    g = Q.step_gap_stats(Q.step_gaps(_events(spark, sf_dir), ["user_id"], "start"), ["user_id"])
    return g.select("user_id", "n_gaps", F.round(F.col("median_gap") * 1000).cast("long").alias("median_ms"))


# --- macros and schedules -----------------------------------------------------------


def _macros(spark, sf_dir):
    key = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("wait", "key", "click", "mark")]), (key % 4 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", kind.alias("kind"), F.when(key % 4 == 0, (key % 9 + 1).cast("double")).otherwise((key % 5) / 10.0).alias("value"))


_MACRO = """m AS (SELECT o_custkey, o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey % 9 + 1.0::DOUBLE WHEN 1 THEN (o_orderkey % 5) / 10.0::DOUBLE + 0.08 WHEN 2 THEN 0.1 ELSE 0.0 END AS sec FROM orders)"""


@query(f"WITH {_MACRO} SELECT o_custkey, CAST(round(sum(sec) * 100) AS BIGINT) AS hundredths FROM m GROUP BY 1")
def g22_scenario_duration(spark, sf_dir):
    return K.scenario_duration(_macros(spark, sf_dir), ["o_custkey"]).select("o_custkey", F.round(F.col("seconds") * 100).cast("long").alias("hundredths"))


@query(f"WITH {_MACRO} SELECT o_orderkey, CAST(round(coalesce(sum(sec) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 1000) AS BIGINT) AS at_ms FROM m")
def w15_macro_timeline(spark, sf_dir):
    return K.macro_timeline(_macros(spark, sf_dir), ["o_custkey"], "o_orderkey").select("o_orderkey", F.round(F.col("at") * 1000).cast("long").alias("at_ms"))


@query(f"WITH {_MACRO}, t AS (SELECT *, coalesce(sum(sec) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS began FROM m) SELECT o_custkey, 'm' || (o_orderkey % 3) AS label, CAST(round(max(began) * 1000) AS BIGINT) AS at_ms FROM t WHERE o_orderkey % 4 = 3 GROUP BY ALL")
def w15_macro_marks(spark, sf_dir):
    t = K.macro_timeline(_macros(spark, sf_dir), ["o_custkey"], "o_orderkey").withColumn("label", F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")))
    return K.macro_marks(t, ["o_custkey"], "label").select("o_custkey", "label", F.round(F.col("at") * 1000).cast("long").alias("at_ms"))


@query("""WITH k AS (SELECT o_custkey AS c, o_orderkey AS k, 8 + coalesce(sum(o_orderkey % 9 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS due, o_orderkey % 5 * 3 AS took, sum(o_orderkey % 5 * 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s FROM orders),
e AS (SELECT y.k, any_value(y.due) AS due, any_value(y.took) AS took, max(x.due + x.took + y.s - x.s) AS done FROM k x JOIN k y ON x.c = y.c AND x.k <= y.k GROUP BY y.k) SELECT k AS o_orderkey, CAST(done - took - due AS BIGINT) AS late_by, CAST(done AS BIGINT) AS done FROM e""")
def w16_late_by(spark, sf_dir):
    """Each step waits for its time and for the steps before it, which take up to 12 seconds."""
    plan = timelines.w05_schedule(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").withColumn("took", (F.col("o_orderkey") % 5 * 3).cast("double"))
    r = K.run_records(plan, ["o_custkey"], "o_orderkey")
    return r.select("o_orderkey", F.col("late_by").cast("long").alias("late_by"), F.col("effective_at").cast("long").alias("done"))


# --- devices, names, voices -----------------------------------------------------------


_DEV = "d AS (SELECT p_brand, p_partkey AS id, 'Dev ' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r, min(p_partkey) OVER (PARTITION BY p_brand) AS m, count(*) OVER (PARTITION BY p_brand) AS n FROM part)"


@query(f"""WITH {_DEV}, g AS (SELECT p_brand, any_value(m) AS m, any_value(n) AS n, max(name) FILTER (r = 1) AS h, max(name) FILTER (r = 2) AS o FROM d GROUP BY 1),
e AS (SELECT *, CASE m % 5 WHEN 1 THEN 'no_default' WHEN 2 THEN CASE WHEN n > 1 THEN 'headset_ambiguous' ELSE 'no_other' END WHEN 3 THEN 'headset_not_found' WHEN 4 THEN 'same_device' ELSE CASE WHEN n = 1 THEN 'no_other' END END AS error FROM g)
SELECT p_brand, CASE WHEN error IS NULL THEN h END AS headset, CASE WHEN error IS NULL THEN o END AS other, error FROM e""")
def p20_roles(spark, sf_dir):
    name = F.format_string("Dev %08d", "p_partkey")
    devices = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("id"), name.alias("name"))
    m = F.col("m") % 5
    wanted = devices.groupBy("p_brand").agg(F.min("id").alias("m")).select(
        "p_brand", F.when(m == 1, -1).otherwise(F.col("m")).alias("default_id"), F.when(m == 2, "dev").when(m == 3, "zzz").otherwise("").alias("headset_pattern"), F.when(m == 4, F.format_string("dev %08d", "m")).alias("other_pattern")
    )
    return K.resolve_roles(devices, wanted, ["p_brand"])


_FRAG = "CASE n_regionkey % 3 WHEN 0 THEN 'zzz' WHEN 1 THEN '' ELSE substr(first, 2) END"


@query(f"""WITH f AS (SELECT n_regionkey, min(n_name) AS first FROM nation GROUP BY 1), h AS (SELECT n_regionkey, n_name, contains(lower(n_name), lower({_FRAG})) AS hit FROM nation JOIN f USING (n_regionkey))
SELECT n_regionkey, count(*) FILTER (hit) AS n_hits, CASE WHEN count(*) FILTER (hit) = 1 THEN min(n_name) FILTER (hit) END AS n_name FROM h GROUP BY 1""")
def p17_look_up(spark, sf_dir):
    """Fragments that no name holds, that all hold, and that are most of one name."""
    n = table(spark, sf_dir, "nation")
    n = n.join(n.groupBy("n_regionkey").agg(F.min("n_name").alias("first")), "n_regionkey")
    r = F.col("n_regionkey") % 3
    return P.look_up(n, ["n_regionkey"], "n_name", F.when(r == 0, "zzz").when(r == 1, "").otherwise(F.substring("first", 2, 1000)))


@query("""SELECT user_id, coalesce(max(try_cast(regexp_extract('take_r' || (event_id % 40), 'r(\\d+)$', 1) AS INT)), 0) + 1 AS next_take FROM events GROUP BY 1""")
def g21_next_take(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("take_r"), (F.col("event_id") % 40).cast("string")).alias("name"))
    return K.next_take(e, ["user_id"], "name")


@query("""WITH c AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, count(*) AS voices, count(*) FILTER (event_type = 'purchase') AS physical FROM events GROUP BY ALL) SELECT user_id, max(voices) AS peak_voices, max(physical) AS peak_physical FROM c GROUP BY 1""")
def g20_peak_voices(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("h", F.floor(F.col("start") / 3600))
    return K.peak_voices(e, ["user_id"], ["h"], F.col("kind") != "purchase")


# --- project files and faults ------------------------------------------------------------


def _projects(spark, sf_dir):
    """A project file per part: a property in either spelling, with others about it."""
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    more = (F.col("p_size") + 1).cast("string")
    text = F.concat(
        F.lit('<Sound Name="s'), k, F.lit('"><Property Name="Pitch" Type="int32" Value="9"/><Property Name="Volume" Type="Real64" Value="'), size, F.lit('"/></Sound>\n<ActorMixer Name="m'), k,
        F.lit('"><Property Name="Volume" Type="Real64">\n<ValueList><Value> '), more, F.lit(" </Value></ValueList></Property></ActorMixer>"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", k.alias("path"), text.alias("value"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS path, 'Sound' AS owner_type, 's' || p_partkey AS owner_name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'ActorMixer', 'm' || p_partkey, CAST(p_size + 1 AS VARCHAR) FROM part""")
def s21_properties(spark, sf_dir):
    return J.properties(_projects(spark, sf_dir), "Volume").drop("ord")


@query("""SELECT 'Sound' AS owner_type, count(*) AS total, count(*) FILTER (p_size > 25) AS targets, count(*) FILTER (NOT p_size > 25) AS controls FROM part UNION ALL SELECT 'ActorMixer', count(*), 0, count(*) FROM part""")
def j18_targets(spark, sf_dir):
    p = _projects(spark, sf_dir)
    targets = p.filter("p_size > 25").select(F.concat(F.lit("s"), F.col("path")).alias("owner_name"))
    return J.target_counts(J.with_targets(J.properties(p, "Volume"), targets), ["owner_type"])


@query("SELECT p_brand AS fault, count(*) AS changes, count(DISTINCT p_type) AS files FROM part GROUP BY 1")
def g24_injections(spark, sf_dir):
    return J.injection_summary(table(spark, sf_dir, "part").select(F.col("p_brand").alias("fault"), F.col("p_type").alias("file")))


@query("SELECT p_brand AS fault, p_type AS file, count(*) AS changes FROM part GROUP BY ALL")
def g24_injected_files(spark, sf_dir):
    return J.injected_files(table(spark, sf_dir, "part").select(F.col("p_brand").alias("fault"), F.col("p_type").alias("file")))


# --- sessions, waits, replies -----------------------------------------------------------


@query(f"""WITH {_EV}, e AS (SELECT user_id, start AS t, id, CASE id % 4 WHEN 0 THEN 'started' WHEN 3 THEN 'stopped' ELSE 'mark' END AS st FROM ev),
w AS (SELECT *, max(CASE WHEN st = 'started' THEN t END) OVER (PARTITION BY user_id ORDER BY t, id) AS s, max(CASE WHEN st = 'stopped' THEN t END) OVER (PARTITION BY user_id ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e),
k AS (SELECT user_id, s, t FROM w WHERE st = 'stopped' AND s IS NOT NULL AND (p IS NULL OR s > p)),
n AS (SELECT k.user_id, k.t, count(m.t) AS n_marks FROM k LEFT JOIN e m ON m.user_id = k.user_id AND m.st = 'mark' AND m.t > k.s AND m.t < k.t GROUP BY ALL)
SELECT k.user_id, row_number() OVER (PARTITION BY k.user_id ORDER BY k.t) AS take, s AS started, k.t AS stopped, n_marks FROM k JOIN n ON n.user_id = k.user_id AND n.t = k.t""")
def st3_takes(spark, sf_dir):
    e = _recorded(_events(spark, sf_dir)).select("recorder", F.col("start").alias("t"), F.col("id").alias("seq"), "state", "path")
    return recorder.takes_with_marks(e).select(F.col("recorder").alias("user_id"), F.col("take").cast("long"), "started", "stopped", "n_marks")


def _recorded(events):
    state = F.when(F.col("id") % 4 == 0, "started").when(F.col("id") % 4 == 3, "stopped").otherwise("mark")
    return events.withColumn("recorder", F.col("user_id")).withColumn("state", state).withColumn("path", F.lit("x"))


def _streamed(rows, live, late: str):
    """What ``live`` makes of ``rows`` (with ts) as a stream: they are written in parts that hold rows of all times and come one part a batch;
    a row far ahead closes what is open. Source, checkpoint and result lie in the shared folder."""
    spark = rows.sparkSession
    home = shared_folder(spark, "stream")
    rows.repartition(3).write.parquet(f"{home}/in")
    ahead = rows.agg(F.max("ts").alias("ts")).filter("ts is not null").select((F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts"))
    ahead.select(*[F.col("ts") if c == "ts" else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes]).repartition(1).write.mode("append").parquet(f"{home}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    q = live(stream, late).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{home}/out")


@query(SQL["st3_takes"])
def st3_live_takes(spark, sf_dir):
    e = _recorded(_events(spark, sf_dir)).select("recorder", F.timestamp_micros(F.round(F.col("start") * 1000000).cast("long")).alias("ts"), F.col("id").alias("seq"), "state", "path")
    return _streamed(e, live.live_takes, "60 days").select(F.col("recorder").alias("user_id"), "take", "started", "stopped", "n_marks")


@query(f"""WITH {_EV}, p AS (SELECT user_id, id, start AS t, id % 3 * 10 AS sz, min(start) OVER (PARTITION BY user_id) AS f FROM ev), q AS (SELECT *, coalesce(sz > 0 AND lag(sz) OVER (PARTITION BY user_id ORDER BY t, id) = sz, false) AS same FROM p WHERE t < f + 864000)
SELECT user_id, coalesce(min(t) FILTER (same), max(t)) AS ready_at, bool_or(same) OR arg_max(sz, t) > 0 AS ready, bool_or(same) AS settled FROM q GROUP BY 1""")
def st4_stable_files(spark, sf_dir):
    polls = _events(spark, sf_dir).select("user_id", F.col("start").alias("t"), F.col("id").alias("seq"), (F.col("id") % 3 * 10).alias("size"))
    return K.stable_files(polls, ["user_id"], timeout=864000.0)


@query(SQL["st4_stable_files"])
def st4_live_stable_files(spark, sf_dir):
    polls = _events(spark, sf_dir).select(F.col("user_id"), F.timestamp_micros(F.round(F.col("start") * 1000000).cast("long")).alias("ts"), F.col("id").alias("seq"), (F.col("id") % 3 * 10).alias("size"))
    return _streamed(polls, lambda s, late: live.live_stable_files(s, 864000.0, late, "user_id"), "60 days")


@query(f"""WITH {_EV}, c AS (SELECT user_id, start - min(start) OVER (PARTITION BY user_id) AS e, coalesce(CASE WHEN id % 11 > 0 THEN value > 150 END, false) AS okk FROM ev) SELECT user_id, arg_min(okk, e) AS met, min(e) AS elapsed FROM c WHERE okk OR e >= 432000 GROUP BY 1""")
def st5_polls(spark, sf_dir):
    first = F.min("start").over(Window.partitionBy("user_id"))
    checks = _events(spark, sf_dir).withColumn("e", F.col("start") - first)
    return K.poll_result(checks, ["user_id"], "e", F.when(F.col("id") % 11 > 0, F.col("value") > 150), 432000.0)


@query("""WITH m AS (SELECT event_type AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, CASE event_id % 5 WHEN 0 THEN 8 WHEN 1 THEN 24 ELSE 50 END AS kind, event_id AS body FROM events),
q AS (SELECT s, seq AS request_id, seq * 2 AS aft FROM m WHERE seq < 50), r AS (SELECT s, seq, kind, seq * 7 % 50 AS request_id, body FROM m WHERE kind IN (8, 50)),
f AS (SELECT q.s, q.request_id, r.seq, r.kind, r.body FROM q JOIN r ON r.s = q.s AND r.request_id = q.request_id AND r.seq > aft AND r.seq <= aft + 20 QUALIFY row_number() OVER (PARTITION BY q.s, q.request_id ORDER BY r.seq) = 1)
SELECT q.s AS event_type, q.request_id, CASE kind WHEN 50 THEN 'result' WHEN 8 THEN 'error' ELSE 'none' END AS outcome, f.seq, f.body FROM q LEFT JOIN f ON f.s = q.s AND f.request_id = q.request_id""")
def st6_replies(spark, sf_dir):
    seq = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")).cast("long")
    kind = F.when(F.col("event_id") % 5 == 0, 8).when(F.col("event_id") % 5 == 1, 24).otherwise(50)
    m = table(spark, sf_dir, "events").select("event_type", seq.alias("seq"), kind.alias("kind"), F.lit(48).alias("ref"), F.col("event_id").alias("body"))
    requests = m.filter("seq < 50").select("event_type", F.col("seq").alias("request_id"), (F.col("seq") * 2).alias("after"))
    return K.correlate(requests, m.withColumn("request_id", F.col("seq") * 7 % 50), ["event_type"]).drop("after")


# --- libraries, rules that need files of their own ------------------------------------------


@query(f"WITH {media._LOUD} SELECT category, count(lo.path) FILTER (evaluated AND abs(lo.lufs - basis) > tolerance) AS hits FROM lg JOIN lo ON lo.p_type = category GROUP BY 1")
def g11_loudness_hits(spark, sf_dir):
    f, by = media._part_files(spark, sf_dir), F.col("p_type")
    groups = L.loudness_groups(f, media._LOUD_CFG, by)
    return L.loudness_hits(groups, L.loudness_outliers(f, groups, media._LOUD_CFG, by)).select("category", "hits")


@query("""WITH t AS (SELECT source || '/' || (doc_id // 2) AS folder, source || '/' || (doc_id // 2) || '/f' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.mkv' ELSE '.mp4' END AS path, doc_id % 3 = 0 AS aud FROM documents)
SELECT path FROM t QUALIFY aud OR NOT bool_or(aud) OVER (PARTITION BY folder)""")
def s17_audio_else_video(spark, sf_dir):
    ext = F.element_at(F.array(F.lit(".wav"), F.lit(".mkv"), F.lit(".mp4")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), ext)
    return L.audio_else_video(table(spark, sf_dir, "documents").select(path.alias("path")), X.suffix(F.col("path")) == ".wav")


_SPECIAL = ["decode", "empty", "channel_silent", "clip_after_decode", "head_offset", "fake_stereo"]


@query(f"""WITH {media._SIG}, {media._CLIP}, b AS (SELECT vec_id, any_value(path) AS path, max(abs(v)) AS peak, coalesce(min(p) FILTER (abs(v) > {media.FLOOR}), any_value(n)) AS head FROM smp GROUP BY vec_id),
r AS (SELECT vec_id, count(*) AS n_runs FROM runs WHERE length >= 2 GROUP BY vec_id), z AS (SELECT b.*, coalesce(n_runs, 0) AS n_runs, b.vec_id % 6 AS k, peak > {media.FLOOR} AS loud FROM b LEFT JOIN r ON r.vec_id = b.vec_id)
SELECT path, 'decode' AS "check", 'FAIL' AS severity FROM z WHERE k = 0 UNION ALL SELECT path, 'empty', 'FAIL' FROM z WHERE k = 1 UNION ALL SELECT path, 'channel_silent', 'FAIL' FROM z WHERE k = 2 AND loud
UNION ALL SELECT path, 'clip_after_decode', 'INFO' FROM z WHERE k = 3 AND loud AND n_runs > 0 UNION ALL SELECT path, 'head_offset', 'INFO' FROM z WHERE k = 4 AND loud AND head * 250.0 > 5 UNION ALL SELECT path, 'fake_stereo', 'WARN' FROM z WHERE k = 5 AND loud""")
def r04_special_findings(spark, sf_dir):
    """Files that can't be decoded, are empty, have a dead or a doubled channel, came through another decoder, or are long."""
    s, k = media.signals(spark, sf_dir), F.col("vec_id") % 6
    c = F.get("chans", F.lit(0))
    chans = F.when(k == 1, F.array(F.slice(c, 1, 0), F.slice(c, 1, 0))).when(k == 2, F.array(c, F.transform(c, lambda v: v * 0))).when(k == 5, F.array(c, c)).otherwise(F.col("chans"))
    s = s.withColumns({"chans": chans, "error": F.when(k == 0, "bad header"), "decoded_via": F.when(k == 3, "external").otherwise("wave"), "sample_rate": F.when(k == 4, 4).otherwise(F.col("sample_rate")), "size_bytes": F.lit(100)})
    return R.findings_of(R.judge(R.measure(s, media.CFG), media.CFG)).filter(F.col("check").isin(_SPECIAL)).select("path", "check", "severity")


# --- cells ------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '-inf dBFS' ELSE printf('%+.2f dBFS', round_even(value - 100, 2)) END AS cell FROM events")
def f02_dbfs_cells(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.dbfs_cell(F.when(F.col("event_id") % 7 > 0, F.col("value") - 100)).alias("cell"))


@query("SELECT p_partkey, printf('%g', p_retailprice * 1000.0) AS big, printf('%g', p_size / 100000.0) AS small FROM part")
def f03_general_cells(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.general(F.col("p_retailprice") * 1000.0).alias("big"), X.general(F.col("p_size") / 100000.0).alias("small"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, 'none' AS missing FROM events")
def f04_json_get(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.json_get(F.col("props"), "$.k", F.lit("none")).alias("k"), X.json_get(F.col("props"), "$.a.b", F.lit("none")).alias("missing"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS stamp FROM orders")
def f05_clip_stamps(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.clip_stamp(F.col("o_orderdate")).alias("stamp"))


@query("SELECT doc_id, left(trim(regexp_replace(text, '[\\r\\n].*$', '', 's')), 80) AS line, replace(left(text, 20), '''', '''''') AS quoted FROM documents")
def f06_first_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.first_line(F.col("text")).alias("line"), X.quoted(F.left("text", F.lit(20))).alias("quoted"))


# --- reports that people write into, stored timelines ------------------------------------


_FRESH = ["## 一、环境（待填）", "| 项目 | 值 |", "| 游戏 / 版本 |  |", "| `a.mkv` | 00:01 | 300 |  |  |", "- 执行次数：3（本目录内 3 个片段）", "- 复现率：__ / 3", "## 四、结论（待填）", "- 结论（PASS / FAIL / BLOCKED / 未复现）：", "  to fill in", "- 预期："]


@query("""WITH c AS (SELECT c_custkey AS doc, c_custkey % 4 AS m, c_nationkey AS k, c_mktsegment AS seg FROM customer),
l AS (SELECT doc, unnest(list_concat([CASE WHEN m < 2 THEN '## 一、环境' ELSE '## 一、环境（待填）' END, '| 项目 | 值 |', CASE WHEN m < 2 THEN '| 游戏 / 版本 | v' || k || ' |' ELSE '| 游戏 / 版本 |  |' END,
 '| `a.mkv` | 00:01 | 300 | ' || CASE WHEN m % 2 = 0 THEN 'dark' ELSE '' END || ' |  |', '- 执行次数：3（本目录内 3 个片段）', CASE WHEN m IN (0, 3) THEN '- 复现率：' || k || ' / 3（' || seg || '）' ELSE '- 复现率：__ / 3' END,
 CASE WHEN m = 1 THEN '## 四、结论' ELSE '## 四、结论（待填）' END], CASE WHEN m = 1 THEN ['- 结论（PASS / FAIL / BLOCKED / 未复现）：PASS', '  because ' || seg, '  twice'] ELSE ['- 结论（PASS / FAIL / BLOCKED / 未复现）：', '  to fill in'] END,
 [CASE WHEN m >= 2 THEN '- 预期：loud' ELSE '- 预期：' END])) AS line, unnest(generate_series(0, CASE WHEN m = 1 THEN 10 ELSE 9 END)) AS n FROM c)
SELECT doc, n, line FROM l""")
def j11_report_edits(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 4).alias("m"), F.col("c_nationkey").cast("string").alias("k"), F.col("c_mktsegment").alias("seg"))
    m = F.col("m")
    when = lambda test, yes, no: F.when(test, yes).otherwise(no)
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    edited = F.array(
        when(m < 2, say("| 游戏 / 版本 | v", F.col("k"), " |"), "| 游戏 / 版本 |  |"),
        when(m % 2 == 0, "| `a.mkv` | 00:01 | 200 | dark |  |", "| `a.mkv` | 00:01 | 300 |  |  |"),
        F.lit("- 执行次数：2（本目录内 2 个片段）"),
        when(m.isin(0, 3), say("- 复现率：", F.col("k"), " / 2（", F.col("seg"), "）"), "- 复现率：__ / 2"),
        when(m == 1, "- 结论（PASS / FAIL / BLOCKED / 未复现）：PASS", "- 结论（PASS / FAIL / BLOCKED / 未复现）："),
        when(m == 1, say("  because ", F.col("seg")), ""),
        when(m == 1, "  twice", ""),
        when(m >= 2, "- 预期：loud", "- 预期："),
    )
    fresh = c.select("doc", F.posexplode(F.array(*map(F.lit, _FRESH))).alias("n", "line"))
    return E.merge_reports(fresh, c.select("doc", F.posexplode(edited).alias("n", "line"))).select("doc", F.col("n").cast("long").alias("n"), "line")


@query("""WITH r AS (SELECT o_orderpriority AS clip, 's' || o_orderkey AS step, o_orderkey % 50 + 1.0 AS t, o_orderkey % 5 > 0 AS ok, o_orderstatus AS st FROM orders),
l AS (SELECT DISTINCT clip, -1 AS part, 0.0 AS t, '' AS step, '# log of ' || clip AS line FROM r
UNION ALL SELECT DISTINCT clip, 0, k, '', CASE k WHEN 0 THEN '## Device timeline' WHEN 1 THEN '' WHEN 2 THEN '| step | planned s | issued s | effective s | late s | result | action | default device |' ELSE '| --- | --- | --- | --- | --- | --- | --- | --- |' END FROM r, unnest([0.0, 1.0, 2.0, 3.0]) AS u(k)
UNION ALL SELECT clip, 1, t, step, '| ' || step || ' | ' || printf('%.2f', t) || ' | ' || printf('%.3f', t + 0.25) || ' | ' || printf('%.3f', t + 0.5) || ' | 0.25 | ' || CASE WHEN ok THEN 'effective' ELSE '**not controlled**' END || ' | set | x → ' || st || ' |' FROM r
UNION ALL SELECT clip, 2, t, step, '- `' || step || '` was not controlled' FROM r WHERE NOT ok)
SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY part, t, step, line) - 1 AS n, line FROM l""")
def k06_refreshed_timelines(spark, sf_dir):
    at = F.col("o_orderkey") % 50 + 1.0
    o = table(spark, sf_dir, "orders")
    records = o.select(
        F.col("o_orderpriority").alias("clip"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("step"), at.alias("at"), (at + 0.25).alias("issued_at"), (at + 0.5).alias("effective_at"),
        F.lit(0.25).alias("late_by"), (F.col("o_orderkey") % 5 > 0).alias("ok"), F.lit("set").alias("label"), F.lit("x").alias("before"), F.col("o_orderstatus").alias("after"),
    )
    folder = shared_folder(spark, "timelines")
    T.write_timeline(records, folder)
    old = F.posexplode(F.array(F.concat(F.lit("# log of "), F.col("clip")), F.lit("## Device timeline"), F.lit("an older form")))
    once = T.refresh_timelines(spark, folder, records.select("clip").distinct().select("clip", old.alias("n", "line")))
    return T.refresh_timelines(spark, folder, once).select("clip", F.col("n").cast("long").alias("n"), "line")
