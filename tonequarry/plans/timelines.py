"""Queries on intervals, sequences and texts, bound to the tables at hand, each with its SQL.

Events serve as time series and, with a length of their own, as intervals; conversations as speech and
subtitles; orders as schedules.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tonequarry.functions import text as X
from tonequarry.operators import intervals as I
from tonequarry.operators import sequences as Q
from tonequarry.plans.media import table
from tonequarry.streaming import recorder

QUERIES: dict = {}
SQL: dict[str, str] = {}
BUCKET = 7200.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, sf_dir):
    """id, user_id, start, end, value, kind: seconds since 1970, whatever the session's time zone."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 1e6
    e = table(spark, sf_dir, "events").withColumn("start", t)
    return e.select(F.col("event_id").alias("id"), "user_id", "start", (F.col("start") + 3600 + F.col("event_id") % 7 * 1800).alias("end"), "value", F.col("event_type").alias("kind"))


_EV = """ev AS (SELECT event_id AS id, user_id, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + 3600 + event_id % 7 * 1800 AS "end", value, event_type AS kind FROM events),
a AS (SELECT * FROM ev WHERE id % 2 = 0), b AS (SELECT * FROM ev WHERE id % 2 = 1)"""
_HIT = 'a.user_id = b.user_id AND a.start < b."end" AND b.start < a."end"'


def _sides(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.filter("id % 2 = 0"), e.filter("id % 2 = 1")


@query(f"WITH {_EV} SELECT a.id AS left_id, b.id AS right_id FROM a JOIN b ON {_HIT}")
def j03_overlap_join(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return I.overlap_join(a.select("user_id", "start", "end", F.col("id").alias("left_id")), b.select("user_id", "start", "end", F.col("id").alias("right_id")), ["user_id"], BUCKET).select("left_id", "right_id")


@query(f"WITH {_EV} SELECT a.id, coalesce(string_agg(b.kind, ' ' ORDER BY b.start, b.kind), '') AS matched_text, count(b.id) AS n_matched FROM a LEFT JOIN b ON {_HIT} GROUP BY a.id")
def j03_matched_text(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return I.matched_text(a, b, ["user_id"], BUCKET, "id", "start", "kind").select("id", "matched_text", "n_matched")


@query(f"WITH {_EV} SELECT id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE {_HIT})")
def j04_covered(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return I.covered(a, b, ["user_id"], BUCKET).select("id")


@query(f"WITH {_EV} SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_HIT})")
def j05_orphans(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return I.covered(a, b, ["user_id"], BUCKET, missing=True).select("id")


_OV = 'greatest(0.0, least(a."end", b."end") - greatest(a.start, b.start))'


@query(f"""WITH {_EV}, p AS (SELECT a.id, b.id AS best, b.start AS bs, {_OV} AS o FROM a JOIN b ON {_HIT} QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {_OV} DESC, b.id) = 1)
SELECT a.id, best, CASE WHEN coalesce(o, 0) / greatest(a."end" - a.start, 0.001) >= 0.2 THEN bs END AS voice_start FROM a LEFT JOIN p ON a.id = p.id""")
def j06_best_overlap(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return I.best_overlap(a.select("user_id", "id", "start", "end"), b.select("user_id", F.col("id").alias("best"), "start", "end"), ["user_id"], BUCKET, "id", "best").select("id", "best", "voice_start")


@query(f"""WITH {_EV}, m AS (SELECT a.id, max({_OV}) AS most FROM a JOIN b ON {_HIT} GROUP BY a.id)
SELECT a.id FROM a LEFT JOIN m ON a.id = m.id WHERE a.user_id IN (SELECT user_id FROM b) AND coalesce(most, 0) < 0.2 * (a."end" - a.start)""")
def j07_least_covered(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return I.least_covered(a.select("user_id", "id", "start", "end"), b, ["user_id"], BUCKET, "id").select("id")


@query(f"""WITH {_EV}, x AS (SELECT a.id, a.start AS t, b.start AS st, b.id AS sid FROM a JOIN b ON a.user_id = b.user_id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY abs(b.start - a.start), b.start, b.id) = 1)
SELECT a.id, st AS nearest_t, sid FROM a JOIN x ON a.id = x.id""")
def j08_nearest(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    got = I.nearest(a.select("user_id", "id", F.col("start").alias("t")), b.select("user_id", F.col("start").alias("t"), F.col("id").alias("sid")), ["user_id"], "id", "sid", 86400.0)
    return got.filter("nearest_t is not null").select("id", "nearest_t", "sid")


@query(f"""WITH {_EV} SELECT a.id, (SELECT max_by(b.id, (b.start, b.id)) FROM b WHERE b.user_id = a.user_id AND b.start <= a.start) AS owner FROM a""")
def j09_last_preceding(spark, sf_dir):
    a, b = _sides(spark, sf_dir)
    return I.last_preceding(a.select("user_id", "id", F.col("start").alias("t")), b.select("user_id", F.col("start").alias("t"), F.col("id").alias("owner")), ["user_id"], "id", "owner").select("id", "owner")


@query(f"""WITH {_EV}, r AS (SELECT user_id, start, "end", coalesce(max("end") OVER (PARTITION BY user_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS reach FROM ev),
g AS (SELECT user_id, reach AS s, start AS e FROM r UNION ALL SELECT user_id, max("end"), 2e9 FROM ev GROUP BY user_id) SELECT user_id, s AS start, e AS "end" FROM g WHERE e - s >= 0.15""")
def w04_complement(spark, sf_dir):
    e = _events(spark, sf_dir)
    return I.complement(e, e.select("user_id").distinct().withColumn("duration", F.lit(2e9)), ["user_id"])


@query(f"""WITH {_EV} SELECT user_id, CAST(round((1 - sum("end" - start) / 2592000.0) * 1000000) AS BIGINT) AS micro_share FROM ev GROUP BY user_id""")
def g16_silence_share(spark, sf_dir):
    e = _events(spark, sf_dir)
    s = I.silence_share(e, e.select("user_id").distinct().withColumn("duration", F.lit(2592000.0)), ["user_id"])
    return s.select("user_id", F.round(F.col("silence_share") * 1000000).cast("long").alias("micro_share"))


@query(f"""WITH {_EV}, n AS (SELECT id, lead(start) OVER (PARTITION BY user_id ORDER BY start, "end") - "end" AS gap FROM ev) SELECT id FROM n WHERE gap >= 0 AND gap <= 20000""")
def w06_adjacent_gaps(spark, sf_dir):
    return I.adjacent_gaps(_events(spark, sf_dir), ["user_id"], 20000.0).select("id")


@query(f"""WITH {_EV}, n AS (SELECT user_id, lead(start) OVER (PARTITION BY user_id ORDER BY start, "end") - "end" AS gap FROM ev), l AS (SELECT user_id, list_sort(list(gap)) AS g FROM n WHERE gap >= 0 GROUP BY 1)
SELECT user_id, len(g) AS n_gaps, g[len(g) // 2 + 1] AS median_gap, g[1] AS min_gap, len(list_filter(g, lambda x: x <= 0.1)) AS n_tight, len(list_filter(g, lambda x: x <= 0.35)) AS n_near FROM l""")
def g15_gap_stats(spark, sf_dir):
    return I.gap_stats(_events(spark, sf_dir), ["user_id"])


@query("SELECT event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def w02_lag(spark, sf_dir):
    return Q.lagged_difference(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "delta")


@query("SELECT event_id, median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING) AS rolling_median FROM events")
def w03_rolling_median(spark, sf_dir):
    e = _events(spark, sf_dir).select("user_id", F.col("id").alias("event_id"), "start", "value")
    return Q.rolling_median(e, ["user_id"], ["start", "event_id"], "value", 60, 7 * 86400.0).select("event_id", "rolling_median")


@query("WITH h AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, max(value) AS m FROM events GROUP BY ALL) SELECT user_id, h, m FROM h")
def w01_tumbling(spark, sf_dir):
    e = _events(spark, sf_dir)
    return Q.tumbling(e, ["user_id"], "start", 3600.0, F.max("value").alias("m")).select("user_id", F.col("window").alias("h"), "m")


@query("""WITH h AS (SELECT user_id, epoch_us(ts) // 3600000000 AS h, max(value) AS m FROM events GROUP BY ALL), q AS (SELECT user_id, h, h - row_number() OVER (PARTITION BY user_id ORDER BY h) AS g FROM h WHERE m > 20)
SELECT user_id, min(h) AS start, count(*) AS length FROM q GROUP BY user_id, g""")
def w09_islands(spark, sf_dir):
    e = _events(spark, sf_dir)
    h = e.groupBy("user_id", F.floor(F.col("start") / 3600).alias("h")).agg(F.max("value").alias("m"))
    return Q.islands(h, ["user_id"], "h", F.col("m") > 20)


@query("""WITH d AS (SELECT user_id, (epoch_us(ts) // 86400000000) * 86400 AS start, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS mean, count(*) AS n FROM events WHERE value > 5 GROUP BY ALL)
SELECT user_id, CAST(start AS BIGINT) AS start, n FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY mean DESC, start DESC) <= 4""")
def w07_loudest_windows(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("v", F.round(F.col("value") * 100).cast("long")).filter("value > 5")
    return Q.loudest_windows(e, ["user_id"], 86400, 4, -1.0, "start", "v").select("user_id", F.col("start").cast("long").alias("start"), "n")


@query("""WITH l AS (SELECT user_id, list_sort(list(value)) AS v FROM events WHERE value > 5 GROUP BY 1) SELECT user_id, len(v) AS n, v[len(v) // 2 + 1] AS median, len(list_filter(v, lambda x: x > 50)) AS n_loud FROM l""")
def g14_density(spark, sf_dir):
    d = Q.density(_events(spark, sf_dir), ["user_id"], 5.0, 50.0, "value")
    return d.select("user_id", "n", "median", F.round(F.col("loud_share") * F.col("n")).cast("long").alias("n_loud"))


_STEPS = """v AS (SELECT user_id, event_id, ts, value, abs(value - lag(value) OVER w) AS d, row_number() OVER w AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
t AS (SELECT user_id, count(*) AS n, coalesce(nullif(list_sort(list(d) FILTER (d IS NOT NULL))[count(d) // 2 + 1], 0), 1e-9) AS typ FROM v GROUP BY 1),
c AS (SELECT v.*, typ, 1 + sum(CAST(coalesce(d > typ * 1.8 AND d > 0.25, false) AS INT)) OVER (PARTITION BY v.user_id ORDER BY step) AS segment FROM v JOIN t USING (user_id) WHERE n >= 4)"""


def _segmented(spark, sf_dir):
    return Q.change_points(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.array("value"))


@query(f"WITH {_STEPS} SELECT event_id, step, CAST(segment AS BIGINT) AS segment FROM c")
def w08_change_points(spark, sf_dir):
    return _segmented(spark, sf_dir).select("event_id", F.col("step").cast("long"), "segment")


@query(f"""WITH {_STEPS}, x AS (SELECT *, coalesce(lag(segment) OVER w <> segment, true) AS first, coalesce(lead(d) OVER w, 0.0) AS nxt FROM c WINDOW w AS (PARTITION BY user_id ORDER BY step)),
j AS (SELECT user_id, coalesce(list_sort(list(d) FILTER (NOT first AND d IS NOT NULL))[(count(d) FILTER (NOT first)) // 2 + 1], 0) AS jitter FROM x GROUP BY 1)
SELECT user_id, step AS boundary_step, least(d, nxt) > greatest(3 * jitter, 0.3) AS is_transition FROM x JOIN j USING (user_id) WHERE first AND segment > 1""")
def w12_transitions(spark, sf_dir):
    return Q.transitions(_segmented(spark, sf_dir), ["user_id"]).select("user_id", F.col("boundary_step").cast("long"), "is_transition")


def _frames(spark, sf_dir):
    w = F.row_number().over(Q.Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", w.alias("idx"), "value", (F.col("event_id") % 10 / 10).alias("change")).withColumn("bright", F.col("value"))


_STATES = """fr AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS bright, event_id % 10 / 10 AS change FROM events),
pk AS (SELECT user_id, greatest(0.2, max(bright) * 0.3) AS fl FROM fr GROUP BY 1),
tx AS (SELECT fr.*, bright >= fl AS txt, lag(bright >= fl) OVER (PARTITION BY fr.user_id ORDER BY idx) AS prev FROM fr JOIN pk USING (user_id)),
nb AS (SELECT *, sum(CAST(txt AND (NOT coalesce(prev, false) OR change > 0.75) AS INT)) OVER (PARTITION BY user_id ORDER BY idx) AS st FROM tx)"""


@query(f"WITH {_STATES} SELECT user_id, min(idx) / 5.0::DOUBLE AS start, (max(idx) + 1) / 5.0::DOUBLE AS \"end\" FROM nb WHERE txt GROUP BY user_id, st")
def w09_text_states(spark, sf_dir):
    return Q.text_states(_frames(spark, sf_dir), ["user_id"], 5.0, change=0.75).select("user_id", "start", "end")


@query(f"""WITH {_STATES}, s AS (SELECT user_id, min(idx) / 5.0::DOUBLE AS a, (max(idx) + 1) / 5.0::DOUBLE AS b FROM nb WHERE txt GROUP BY user_id, st),
k AS (SELECT *, row_number() OVER w AS k, round_even(b - a, 3) < 0.5 AND row_number() OVER w > 1 AS short FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, b)),
j AS (SELECT *, sum(CAST(NOT (short OR coalesce(lag_short, false)) AS INT)) OVER (PARTITION BY user_id ORDER BY k) AS g FROM (SELECT *, lag(short) OVER (PARTITION BY user_id ORDER BY k) AS lag_short FROM k))
SELECT user_id, min(a) AS start, arg_max(b, k) AS "end" FROM j GROUP BY user_id, g""")
def w10_debounce(spark, sf_dir):
    return Q.debounce(Q.text_states(_frames(spark, sf_dir), ["user_id"], 5.0, change=0.75), ["user_id"], 0.5)


@query("""WITH RECURSIVE fr AS (SELECT user_id, row_number() OVER w - 1 AS idx, value AS v, lag(value) OVER w AS p, lead(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS MATERIALIZED (SELECT user_id, idx FROM fr WHERE v >= 20 AND v >= p AND v >= n),
t AS (SELECT user_id, min(idx) AS idx FROM c GROUP BY 1 UNION ALL SELECT c.user_id, min(c.idx) FROM t JOIN c ON c.user_id = t.user_id AND c.idx >= t.idx + 5 GROUP BY 1)
SELECT user_id, idx FROM t""")
def w11_greedy_peaks(spark, sf_dir):
    return Q.greedy_peaks(_frames(spark, sf_dir), ["user_id"], "idx", "bright", F.lit(20.0), 5)


_W5 = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"SELECT o_orderkey, 8.0 + coalesce(sum(o_orderkey % 9 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey {_W5}), 0) AS at FROM orders")
def w05_schedule(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("dwell", (F.col("o_orderkey") % 9 + 1).cast("double"))
    return Q.schedule(o, ["o_custkey"], "o_orderkey", "dwell").select("o_orderkey", "at")


@query("SELECT o_custkey, 8.0 + sum(o_orderkey % 9 + 1) + 3 AS \"end\" FROM orders GROUP BY 1")
def w05_schedule_end(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("dwell", (F.col("o_orderkey") % 9 + 1).cast("double"))
    return Q.schedule_end(Q.schedule(o, ["o_custkey"], "o_orderkey", "dwell"), ["o_custkey"], "dwell", 3.0)


@query("""WITH s AS (SELECT o_custkey, o_orderkey, list_distinct(str_split(o_orderpriority || ',' || o_orderstatus, ',')) AS names FROM orders), f AS (SELECT o_custkey, arg_min(names, o_orderkey) AS n0 FROM s GROUP BY 1), x AS (SELECT o_custkey, unnest(n0) AS name FROM f)
SELECT o_custkey, name, count(*) FILTER (NOT list_contains(names, name)) > 0 AS vanished, coalesce(max(o_orderkey) FILTER (list_contains(names, name)) > max(o_orderkey) FILTER (NOT list_contains(names, name)), false) AS reappeared FROM x JOIN s USING (o_custkey) GROUP BY ALL""")
def w17_vanished(spark, sf_dir):
    s = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.array_distinct(F.split(F.concat_ws(",", "o_orderpriority", "o_orderstatus"), ",")).alias("names"))
    return Q.vanished(s, ["o_custkey"], "o_orderkey", "names")


@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1e6 % 86400 AS time_s, value * 10 AS duration_ms FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time_s, duration_ms) AS k FROM g), u AS (SELECT DISTINCT user_id FROM events)
SELECT user_id, 1 AS frame, 5.0::DOUBLE AS t FROM u UNION ALL SELECT user_id, 2 * k, greatest(0.0, time_s - 0.6) FROM n WHERE 1 + 2 * k <= 6 UNION ALL SELECT user_id, 2 * k + 1, least(time_s + greatest(0.05, duration_ms / 2000), 86399.95) FROM n WHERE 1 + 2 * k <= 6""")
def t06_keyframes(spark, sf_dir):
    e = _events(spark, sf_dir)
    gaps = e.select("user_id", (F.col("start") % 86400).alias("time_s"), (F.col("value") * 10).alias("duration_ms"))
    return Q.keyframes(gaps, e.select("user_id").distinct().withColumn("duration", F.lit(86400.0)), ["user_id"]).select("user_id", F.col("frame").cast("long"), "t")


@query("""SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '不可用' WHEN page_id % 2 + 1 < 2 OR page_id % 3 = 0 OR -40.0 - page_id % 11 < -45 OR page_id % 13 < 5 THEN '有警告但可用' ELSE '可用' END AS verdict FROM pages""")
def r23_capture_verdict(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 7 == 0, 0.0005).otherwise(0.5).alias("peak"), (F.col("page_id") % 2 + 1).alias("channels"), F.when(F.col("page_id") % 3 == 0, 44100).otherwise(48000).alias("sample_rate"), (-40.0 - F.col("page_id") % 11).alias("lufs"), (F.col("page_id") % 13).alias("duration_s"))
    return p.select("page_id", recorder.capture_verdict(F.col("peak"), F.lit(1.0), F.col("channels"), F.col("sample_rate"), F.col("lufs"), F.col("duration_s")).alias("verdict"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'started' WHEN 1 THEN 'starting' WHEN 2 THEN 'stopping' WHEN 3 THEN 'stopped' WHEN 4 THEN 'stopped' ELSE 'other' END AS state, event_id % 6 IN (3, 4) AS terminal FROM events""")
def st2_recorder_states(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    names = ["OBS_WEBSOCKET_OUTPUT_STARTED", "OBS_WEBSOCKET_OUTPUT_STARTING", "OUTPUT_STOPPING", "OBS_WEBSOCKET_OUTPUT_STOPPED", "STOPPED", "OBS_WEBSOCKET_OUTPUT_PAUSED"]
    state = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 6 + 1).cast("int"))
    s = recorder.recorder_state(state)
    return e.select("event_id", s.alias("state"), (s == "stopped").alias("terminal"))


@query("""WITH s AS (SELECT user_id, ts, event_id, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 7200000000, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM s)
SELECT user_id, CAST(s AS BIGINT) AS session, count(*) AS n FROM n GROUP BY ALL""")
def st3_sessions(spark, sf_dir):
    return recorder.sessions(_events(spark, sf_dir), ["user_id"], "start", "id", 7200.0).groupBy("user_id", "session").agg(F.count("*").alias("n"))


def _alignment(spark, sf_dir):
    """Turns as subtitles three seconds apart; what is heard is the same text, some of it late, missing or another."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    at = F.col("turn") * 3.0
    rows = c.select("conv_id", F.format_string("%04d", "turn").alias("idx"), F.lit(None).cast("double").alias("speech_start"), F.lit(None).cast("double").alias("speech_end"), at.alias("subtitle_start"), (at + 2).alias("subtitle_end"), F.col("text").alias("subtitle_text"), F.when(F.col("turn") % 4 == 0, "已确认").alias("note"))
    late = F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.2, 0.4, 0.1)]), (F.col("turn") % 4 + 1).cast("int"))
    heard = F.when(F.col("conv_id") % 5 == 3, F.lit("0123456789")).otherwise(F.col("text"))
    segments = c.filter("turn % 7 <> 6").select("conv_id", (at + late).alias("start"), (at + 1.5).alias("end"), heard.alias("text"))
    return rows, segments


@query()
def c04_alignment(spark, sf_dir):
    """Similarity has no form in SQL: tested on given values."""
    return I.differences(*_alignment(spark, sf_dir), ["conv_id"], 4.0).filter("category is not null")


@query("""WITH f AS (SELECT ['missing_speech', 'missing_subtitle', 'misordered', 'other'][event_id % 4 + 1] AS category, event_id % 3 = 0 AS confirmed FROM events), c(rank, category) AS (VALUES (0, 'missing_speech'), (1, 'missing_subtitle'), (2, 'misordered'), (3, 'offset'))
SELECT rank, c.category, count(f.category) AS total, count(*) FILTER (confirmed) AS confirmed, count(f.category) - count(*) FILTER (confirmed) AS suspected FROM c LEFT JOIN f ON f.category = c.category GROUP BY 1, 2""")
def g12_difference_counts(spark, sf_dir):
    """Events as findings: of three categories, of another, and none of the fourth."""
    kind = F.element_at(F.array(*[F.lit(c) for c in (*I.CATEGORIES[:3], "other")]), (F.col("event_id") % 4 + 1).cast("int"))
    return I.difference_counts(table(spark, sf_dir, "events").select(kind.alias("category"), (F.col("event_id") % 3 == 0).alias("confirmed")))


@query("""WITH a AS (SELECT abs(value * 4 - 300) AS a FROM events WHERE event_id % 7 > 0), l AS (SELECT list_sort(list(a)) AS v FROM a)
SELECT count(*) AS evaluated, median(a) AS median_ms, any_value(v[CAST(round_even(0.9 * (len(v) - 1), 0) AS INT) + 1]) AS p90_ms, max(a) AS max_ms, count(*) FILTER (a > 150) AS n_exceed, count(*) FILTER (a > 250) AS n_fail FROM a, l""")
def g13_offset_stats(spark, sf_dir):
    """Events as offsets, some without one."""
    return I.offset_stats(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 > 0, F.col("value") * 4 - 300).alias("offset_ms")))


@query()
def g13_alignment_offsets(spark, sf_dir):
    """The offsets of the alignment, which SQL has no similarity for."""
    return I.offset_stats(I.differences(*_alignment(spark, sf_dir), ["conv_id"], 4.0))


@query("SELECT event_id, lpad(CAST(CAST(round_even(value * 1000, 0) AS BIGINT) // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(round_even(value * 1000, 0) AS BIGINT) // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(CAST(round_even(value * 1000, 0) AS BIGINT) % 1000 AS VARCHAR), 3, '0') AS code FROM events")
def f01_timecode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.timecode(F.col("value")).alias("code"))
