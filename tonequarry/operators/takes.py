"""Takes of a recording session: their gaps and names, roles of devices, macros, what ran late, polls and replies.

Everything that reads like a loop over a clock is a window or an aggregate here: rows of a key are
sorted where needed, never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.functions.stats import medians_by
from tonequarry.functions.text import stem
from tonequarry.operators.intervals import nearest

#: The three verdicts on a gap.
GAP_VERDICTS = ["无法判定（未取到画面数据）", "疑似 design（画面很简单：菜单/加载/切窗口）", "疑似丢声（间隙期间画面仍是正常实机内容）"]
#: Seconds that a key takes beyond its hold, and a click; seconds to wait for a file; messages to skip.
KEY_S, CLICK_S, FILE_TIMEOUT_S, SKIPPED_MESSAGES = 0.08, 0.1, 25.0, 20


# --- gaps ----------------------------------------------------------------------


def gap_entries(measured: DataFrame, listed: int = 20) -> DataFrame:
    """path, stem, gap (its number in the file), time_s and duration_ms of each file's first ``listed`` gaps; ``measured`` has gaps and sample_rate."""
    at = lambda frames, digits, per: F.bround(frames / F.col("sample_rate") * per, digits)
    gaps = F.transform(F.slice("gaps", 1, listed), lambda g: F.struct(at(g["start"], 4, 1.0).alias("time_s"), at(g["length"], 1, 1000.0).alias("duration_ms")))
    rows = measured.select("path", stem(F.col("path")).alias("stem"), F.inline(gaps))
    return rows.withColumn("gap", F.row_number().over(Window.partitionBy("path").orderBy("time_s")))


def gaps_in_order(entries: DataFrame) -> DataFrame:
    """Gaps by path and time (null last), sorted by range."""
    return entries.orderBy(F.col("path").asc_nulls_last(), F.col("time_s").asc_nulls_last())


def take_gaps(entries: DataFrame, stems: DataFrame) -> DataFrame:
    """The gaps of the takes in ``stems`` (stem), by stem and time."""
    return entries.join(stems.select("stem").distinct(), "stem").orderBy("stem", "time_s")


def take_durations(files: DataFrame, stems: DataFrame) -> DataFrame:
    """duration_s of each stem, of its first file by path; 0 where there is none or it has none."""
    own = files.groupBy(stem(F.col("path")).alias("stem")).agg(F.min_by("duration_s", "path").alias("duration_s"))
    return stems.select("stem").distinct().join(own, "stem", "left").withColumn("duration_s", F.coalesce("duration_s", F.lit(0.0)))


def triage(gaps: DataFrame, activity: DataFrame, keys: list[str], gap_id: str, ratio: float = 0.5, step: float = 60.0) -> DataFrame:
    """gaps with verdict, inside_kb and median_kb.

    ``gaps`` has time_s and inside_kb (the picture's size within the gap; null: of the sample nearest in time), ``activity`` has t and kb.
    A picture below ``ratio`` of the take's upper median is simple: by design. Without activity there is no verdict.
    """
    mid = medians_by(activity, keys, "kb", "median_kb", upper=True)
    near = nearest(gaps.select(*keys, gap_id, F.col("time_s").alias("t")), activity.select(*keys, "t", "kb"), keys, gap_id, "kb", step)
    near = near.select(*keys, gap_id, F.col("kb").alias("_near"))
    j = gaps.join(near, [*keys, gap_id], "left").join(mid, keys, "left")
    j = j.withColumn("inside_kb", F.when(F.col("median_kb").isNotNull(), F.coalesce("inside_kb", "_near"))).drop("_near")
    verdict = F.when(F.col("median_kb").isNull(), GAP_VERDICTS[0]).when(F.col("inside_kb") < F.col("median_kb") * ratio, GAP_VERDICTS[1]).otherwise(GAP_VERDICTS[2])
    return j.withColumn("verdict", verdict)


# --- names, devices, voices -----------------------------------------------------


def next_take(files: DataFrame, keys: list[str], name: str) -> DataFrame:
    """By key one more than the largest number after the last ``_r`` of a name; 1 where no name has one."""
    number = F.regexp_extract(F.col(name), r"_r(\d+)$", 1).try_cast("int")
    return files.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_take"))


def peak_voices(voices: DataFrame, keys: list[str], sample: list[str], virtual: Column) -> DataFrame:
    """By key the most voices in one sample, and the most that aren't virtual."""
    by_sample = voices.groupBy(*keys, *sample).agg(F.count("*").alias("_v"), F.count_if(~virtual).alias("_p"))
    return by_sample.groupBy(*keys).agg(F.max("_v").alias("peak_voices"), F.max("_p").alias("peak_physical"))


def resolve_roles(devices: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """By key headset and other (names), or why there is none: error.

    ``devices`` has ord, id, name; ``wanted`` a row by key with default_id, headset_pattern, other_pattern (null or '': none given).
    The headset is the only device whose name holds the pattern, else the default one; the other is the only one
    that holds its pattern, else the first, in order, that isn't the headset.
    """
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    ranked = devices.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    d = wanted.select(*keys, "default_id", given("headset_pattern").alias("_hp"), given("other_pattern").alias("_op")).join(ranked, keys, "left")
    holds = lambda p: F.contains(F.lower("name"), F.lower(p))
    one = F.struct("id", "name")
    pick = lambda cond: F.min_by(one, F.when(cond, F.col("ord")))
    g = d.groupBy(*keys, "_hp", "_op").agg(
        F.count("id").alias("n"), F.count_if(holds("_hp")).alias("n_h"), F.count_if(holds("_op")).alias("n_o"), pick(holds("_hp")).alias("by_hp"), pick(holds("_op")).alias("by_op"),
        pick(F.col("id") == F.col("default_id")).alias("by_default"), pick(F.col("_rank") == 1).alias("first"), pick(F.col("_rank") == 2).alias("second"),
    )
    g = g.withColumn("h", F.when(F.col("_hp").isNotNull(), F.col("by_hp")).otherwise(F.col("by_default")))
    g = g.withColumn("o", F.when(F.col("_op").isNotNull(), F.col("by_op")).when(F.col("first.id") != F.col("h.id"), F.col("first")).otherwise(F.col("second")))
    many = lambda n, p, what: F.when(F.col(p).isNotNull() & (F.col(n) != 1), F.concat(F.lit(what), F.when(F.col(n) == 0, "_not_found").otherwise("_ambiguous")))
    error = F.coalesce(
        F.when(F.col("n") == 0, "no_device"), many("n_h", "_hp", "headset"), F.when(F.col("h").isNull(), "no_default"),
        many("n_o", "_op", "other"), F.when(F.col("o").isNull(), "no_other"), F.when(F.col("h.id") == F.col("o.id"), "same_device"),
    )
    g = g.withColumn("error", error)
    ok = lambda c: F.when(F.col("error").isNull(), F.col(c))
    return g.select(*keys, ok("h.name").alias("headset"), ok("o.name").alias("other"), "error")


# --- macros and schedules -------------------------------------------------------


def step_seconds(kind: Column, value: Column) -> Column:
    """How long a macro's step takes: a wait its value, a key its hold and a little, a click a little, a mark nothing."""
    return F.when(kind == "wait", value).when(kind == "key", value + KEY_S).when(kind == "click", F.lit(CLICK_S)).otherwise(F.lit(0.0))


def scenario_duration(steps: DataFrame, keys: list[str]) -> DataFrame:
    """By key the seconds that all steps (kind, value) take."""
    return steps.groupBy(*keys).agg(F.bround(F.sum(step_seconds(F.col("kind"), F.col("value"))), 2).alias("seconds"))


def macro_timeline(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add at: when each step begins, without doing any of them."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("at", F.bround(F.coalesce(F.sum(step_seconds(F.col("kind"), F.col("value"))).over(w), F.lit(0.0)), 3))


def macro_marks(timeline: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The marks of a macro's timeline: keys, label and at; of marks with one label the last."""
    return timeline.filter("kind = 'mark'").groupBy(*keys, label).agg(F.max("at").alias("at"))


def run_records(plan: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add issued_at, effective_at and late_by to planned steps (at, took).

    A step is issued at its own time, or when the one before it is done, whichever is later. With S the seconds of all
    steps up to one, that is S plus the largest of at - S (before the step) so far: two running windows, no loop.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = plan.withColumn("_s", F.sum("took").over(w)).withColumn("_m", F.max(F.col("at") - (F.col("_s") - F.col("took"))).over(w))
    p = p.withColumn("effective_at", F.bround(F.col("_s") + F.col("_m"), 3)).withColumn("issued_at", F.bround(F.col("_s") + F.col("_m") - F.col("took"), 3))
    return p.withColumn("late_by", F.bround(F.col("issued_at") - F.col("at"), 3)).drop("_s", "_m")


# --- waiting --------------------------------------------------------------------


def stable_files(polls: DataFrame, keys: list[str], t: str = "t", size: str = "size", timeout: float = FILE_TIMEOUT_S, seq: str = "seq") -> DataFrame:
    """By key of polls of a file's size, in the order of ``t`` and ``seq``: ready_at, the first with the size of the one before it and above 0; else whether the last one is above 0.

    Polls later than ``timeout`` after the first don't count. Columns: keys, ready_at, ready, settled. ``live.live_stable_files`` gives the same of a stream.
    """
    w = Window.partitionBy(*keys).orderBy(t, seq)
    p = polls.withColumn("_first", F.min(t).over(Window.partitionBy(*keys))).filter(F.col(t) < F.col("_first") + timeout)
    p = p.withColumn("_same", (F.col(size) > 0) & F.coalesce(F.lag(size).over(w) == F.col(size), F.lit(False)))
    g = p.groupBy(*keys).agg(F.min(F.when(F.col("_same"), F.col(t))).alias("_at"), F.max(t).alias("_last"), F.max_by(size, F.struct(t, seq)).alias("_size"))
    settled = F.col("_at").isNotNull()
    return g.select(*keys, F.coalesce("_at", "_last").alias("ready_at"), (settled | (F.col("_size") > 0)).alias("ready"), settled.alias("settled"))


def poll_result(checks: DataFrame, keys: list[str], elapsed: str, ok: Column, timeout: float) -> DataFrame:
    """By key the first check that holds or comes at or after the timeout: met and elapsed. A check that failed with an error doesn't hold."""
    done = checks.withColumn("_ok", F.coalesce(ok, F.lit(False))).filter(F.col("_ok") | (F.col(elapsed) >= timeout))
    return done.groupBy(*keys).agg(F.min(F.struct(F.col(elapsed).alias("e"), (~F.col("_ok")).alias("late"))).alias("m")).select(*keys, (~F.col("m.late")).alias("met"), F.col("m.e").alias("elapsed"))


def correlate(requests: DataFrame, messages: DataFrame, session: list[str], skipped: int = SKIPPED_MESSAGES) -> DataFrame:
    """Each request with its reply: outcome (result, error or none), seq and body.

    ``requests`` has request_id and after (messages that came before it), ``messages`` seq, kind (50 a result, 8 an error), ref (the kind of
    what an error answers) and request_id. Of the ``skipped`` messages after a request the first of its id counts; others are passed over.
    """
    reply = messages.filter((F.col("kind") == 50) | ((F.col("kind") == 8) & (F.col("ref") == 48))).select(*session, "request_id", "seq", "kind", "body")
    j = requests.join(reply, [*session, "request_id"]).filter((F.col("seq") > F.col("after")) & (F.col("seq") <= F.col("after") + skipped))
    first = j.groupBy(*session, "request_id", "after").agg(F.min(F.struct("seq", "kind", "body")).alias("m"))
    out = requests.join(first, [*session, "request_id", "after"], "left")
    outcome = F.when(F.col("m").isNull(), "none").when(F.col("m.kind") == 50, "result").otherwise("error")
    return out.withColumns({"outcome": outcome, "seq": F.col("m.seq"), "body": F.col("m.body")}).drop("m")


def correlate_stream(requests: DataFrame, replies: DataFrame, session: str, late: str = "30 seconds") -> DataFrame:
    """The same of two streams (session, request_id, ts): replies within ``late`` of their request; state is dropped by the watermarks."""
    q = requests.withWatermark("ts", late).select(F.col(session).alias("_s"), F.col("request_id").alias("_r"), F.col("ts").alias("asked_at"))
    a = replies.withWatermark("ts", late)
    return q.join(a, (F.col("_s") == F.col(session)) & (F.col("_r") == F.col("request_id")) & (F.col("ts") >= F.col("asked_at")) & (F.col("ts") <= F.col("asked_at") + F.expr(f"INTERVAL {late}"))).drop("_s", "_r")
