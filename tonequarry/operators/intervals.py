"""Interval joins and the timelines built on them.

Overlap is half-open and strict: a starts before b ends and b starts before a ends. Time is cut into cells of
``bucket`` seconds, of twice that, and so on. A row goes to the cells of the level that fits its length, and of
the levels of longer rows on the other side: at most two on each. The join is an equi-join on key, level and cell that a
cluster can deal out, and a pair meets once. A bucket near the usual length keeps the copies few; a row of any
length costs at most two for each doubling. A hot key is split by its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.functions.stats import exact_ranks, joined, medians_by
from tonequarry.functions.text import normalized, similarity


def overlaps(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 < b1) & (b0 < a1)


def overlap_seconds(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def _levelled(df: DataFrame, start: str, end: str, bucket: float) -> DataFrame:
    """Add _level: cells of the level, ``bucket`` x 2^level wide, are at least as long as the interval."""
    span = F.greatest(F.col(start), F.col(end)) - F.col(start)
    return df.withColumn("_level", F.when(span <= bucket, F.lit(0)).otherwise(F.ceil(F.log2(span / bucket))).cast("int"))


def _cells(df: DataFrame, other: DataFrame, keys: list[str], start: str, end: str, bucket: float, side: str) -> DataFrame:
    """A copy of each row for the cells that it touches on its own level and on each higher level that the other side's rows of its key
    are on: two to a level, and as many levels as the longest interval is doublings of ``bucket``."""
    levels = other.groupBy(*keys).agg(F.collect_set("_level").alias("_levels"))
    rows = df.join(levels, keys).withColumn("_at", F.explode(F.array_union(F.array("_level"), F.filter("_levels", lambda x: x > F.col("_level")))))
    width = bucket * F.pow(F.lit(2.0), "_at")
    low, high = F.floor(F.col(start) / width), F.floor(F.greatest(F.col(start), F.col(end)) / width)
    return rows.withColumn("_cell", F.explode(F.sequence(low, high))).drop("_levels").withColumn(f"_low{side}", low).withColumnRenamed("_level", f"_level{side}")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """Pairs of rows that overlap by ``keys``. Both have start and end; the right's other columns must have names of their own,
    its start and end come as right_start and right_end."""
    a = _levelled(left, "start", "end", bucket)
    b = _levelled(right.withColumnRenamed("start", "right_start").withColumnRenamed("end", "right_end"), "right_start", "right_end", bucket)
    pairs = _cells(a, b, keys, "start", "end", bucket, "1").join(_cells(b, a, keys, "right_start", "right_end", bucket, "2"), [*keys, "_at", "_cell"])
    hit = overlaps(F.col("start"), F.col("end"), F.col("right_start"), F.col("right_end"))
    # a pair meets on the longer one's level, in the first cell that both touch
    once = (F.col("_at") == F.greatest("_level1", "_level2")) & (F.col("_cell") == F.greatest("_low1", "_low2"))
    return pairs.filter(hit & once).drop("_at", "_cell", "_level1", "_level2", "_low1", "_low2")


def covered(segments: DataFrame, windows: DataFrame, keys: list[str], bucket: float, missing: bool = False) -> DataFrame:
    """The segments that some window overlaps (``missing``: that none does). Both have start and end."""
    ids = [*keys, "start", "end"]
    hit = overlap_join(segments.select(*ids).distinct(), windows.select(*ids), keys, bucket).select(*ids).distinct()
    on = [segments[c].eqNullSafe(hit[c]) for c in ids]
    return segments.join(hit, on, "left_anti" if missing else "left_semi")


def matched_text(rows: DataFrame, segments: DataFrame, keys: list[str], bucket: float, row_id: str, order: str, text: str) -> DataFrame:
    """For each row the texts of the segments that overlap it, in order, with spaces between; '' without any."""
    pairs = overlap_join(rows.select(*keys, row_id, "start", "end"), segments.select(*keys, "start", "end", F.col(order).alias("_order"), F.col(text).alias("_text")), keys, bucket)
    got = pairs.groupBy(*keys, row_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_order", "_text"))), lambda x: x["_text"]), " ").alias("matched_text"), F.min("right_start").alias("matched_start"), F.count("*").alias("n_matched"))
    return rows.join(got, [*keys, row_id], "left").withColumn("matched_text", F.coalesce("matched_text", F.lit(""))).withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))


def best_overlap(states: DataFrame, activity: DataFrame, keys: list[str], bucket: float, state_id: str, activity_id: str, share: float = 0.2, least: float = 0.001) -> DataFrame:
    """For each state the activity it overlaps most, of equals the first; ``voice_start`` is its start where it covers ``share`` of it."""
    pairs = overlap_join(states.select(*keys, state_id, "start", "end"), activity.select(*keys, "start", "end", activity_id), keys, bucket)
    pairs = pairs.withColumn("_seconds", overlap_seconds(F.col("start"), F.col("end"), F.col("right_start"), F.col("right_end")))
    best = pairs.groupBy(*keys, state_id).agg(F.max_by(F.struct(activity_id, "right_start", "right_end", "_seconds"), F.struct("_seconds", -F.col(activity_id))).alias("m"))
    out = states.join(best, [*keys, state_id], "left")
    span = F.greatest(F.col("end") - F.col("start"), F.lit(least))
    return out.withColumn(activity_id, F.col(f"m.{activity_id}")).withColumn("overlap", F.coalesce("m._seconds", F.lit(0.0))).withColumn("voice_start", F.when(F.col("overlap") / span >= share, F.col("m.right_start"))).drop("m")


def least_covered(activity: DataFrame, states: DataFrame, keys: list[str], bucket: float, activity_id: str, share: float = 0.2, least: float = 0.15) -> DataFrame:
    """Activities of ``least`` seconds or more of which no state covers ``share``, where the key has states at all."""
    activity = activity.filter(F.col("end") - F.col("start") >= least)
    pairs = overlap_join(activity.select(*keys, activity_id, "start", "end"), states.select(*keys, "start", "end"), keys, bucket)
    most = pairs.groupBy(*keys, activity_id).agg(F.max(overlap_seconds(F.col("start"), F.col("end"), F.col("right_start"), F.col("right_end"))).alias("most"))
    some = activity.join(states.select(*keys).distinct(), keys, "left_semi")
    out = some.join(most, [*keys, activity_id], "left").withColumn("most", F.coalesce("most", F.lit(0.0)))
    return out.filter(F.col("most") < share * (F.col("end") - F.col("start")))


def complement(intervals: DataFrame, durations: DataFrame, keys: list[str], least: float = 0.15) -> DataFrame:
    """What the intervals leave of [0, duration), pieces of ``least`` seconds at least. Overlapping intervals are taken together."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inner = intervals.select(*keys, reach.alias("_s"), F.col("start").alias("_e"))
    last = intervals.groupBy(*keys).agg(F.max("end").alias("_reach"))
    tail = durations.join(last, keys, "left").select(*keys, F.greatest(F.coalesce("_reach", F.lit(0.0)), F.lit(0.0)).alias("_s"), F.col("duration").alias("_e"))
    return inner.union(tail).filter(F.col("_e") - F.col("_s") >= least).select(*keys, F.col("_s").alias("start"), F.col("_e").alias("end"))


def silence_share(intervals: DataFrame, durations: DataFrame, keys: list[str]) -> DataFrame:
    """1 - active seconds / duration by key."""
    active = intervals.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("_active"))
    return durations.join(active, keys, "left").select(*keys, (1 - F.coalesce("_active", F.lit(0.0)) / F.col("duration")).alias("silence_share"))


def adjacent_gaps(states: DataFrame, keys: list[str], most: float | None = None) -> DataFrame:
    """Gaps from each state to the next, none below zero and, with ``most``, none above it."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    g = states.withColumn("next_start", F.lead("start").over(w)).withColumn("gap", F.col("next_start") - F.col("end")).filter("gap >= 0")
    return g if most is None else g.filter(F.col("gap") <= most)


def gap_stats(states: DataFrame, keys: list[str]) -> DataFrame:
    """n, upper median, least gap, and gaps of at most 0.1 and 0.35 seconds, by key."""
    gaps = adjacent_gaps(states, keys)
    counts = gaps.groupBy(*keys).agg(F.count("*").alias("n_gaps"), F.min("gap").alias("min_gap"), F.count_if(F.col("gap") <= 0.1).alias("n_tight"), F.count_if(F.col("gap") <= 0.35).alias("n_near"))
    return joined(counts, medians_by(gaps, keys, "gap", "median_gap", upper=True), keys, "left").select(*keys, "n_gaps", "median_gap", "min_gap", "n_tight", "n_near")


def nearest(points: DataFrame, samples: DataFrame, keys: list[str], point_id: str, value: str, step: float) -> DataFrame:
    """The sample nearest in time to each point, of equals the earliest. Both have t.

    Of all samples only the last at or before a point and the first after it can be nearest: one sorted pass over both, no pairs.
    ``step`` deals a key's time into runs; each run is told the last sample before it and the first after it.
    """
    run = F.floor(F.col("t") / step)
    s = samples.select(*keys, "t", F.lit(None).cast(points.schema[point_id].dataType).alias(point_id), F.struct(F.col("t").alias("st"), F.col(value).alias("sv")).alias("s"), run.alias("_run"))
    p = points.select(*keys, "t", point_id, F.lit(None).cast(s.schema["s"].dataType).alias("s"), run.alias("_run"))
    edges = s.groupBy(*keys, "_run").agg(F.min("s").alias("_first"), F.min_by("s", F.struct(-F.col("s.st"), "s.sv")).alias("_last"))
    runs = s.select(*keys, "_run").union(p.select(*keys, "_run")).distinct().join(edges, [*keys, "_run"], "left")
    by = Window.partitionBy(*keys).orderBy("_run")
    runs = runs.withColumn("_before", F.last("_last", True).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first("_first", True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    w = Window.partitionBy(*keys, "_run").orderBy("t")
    both = s.union(p.select(s.columns))
    # of samples at one time the least value stands for all
    low = Window.partitionBy(*keys, "_run", "t")
    both = both.withColumn("s", F.when(F.col("s").isNotNull(), F.min("s").over(low)))
    both = both.withColumn("_b", F.last("s", True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_a", F.first("s", True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    got = both.filter(F.col("s").isNull()).join(runs.select(*keys, "_run", "_before", "_after"), [*keys, "_run"])
    b, a = F.coalesce("_b", "_before"), F.coalesce("_a", "_after")
    use_b = a["st"].isNull() | (F.col("t") - b["st"] <= a["st"] - F.col("t"))
    return got.select(*keys, point_id, "t", F.when(use_b & b["st"].isNotNull(), b).otherwise(a).alias("n")).select(*keys, point_id, "t", F.col("n.st").alias("nearest_t"), F.col("n.sv").alias(value))


def last_preceding(points: DataFrame, marks: DataFrame, keys: list[str], point_id: str, value: str) -> DataFrame:
    """The last mark at or before each point, by key and position ``t``."""
    m = marks.select(*keys, "t", F.lit(None).cast(points.schema[point_id].dataType).alias(point_id), F.col(value), F.lit(0).alias("_kind"))
    p = points.select(*keys, "t", point_id, F.lit(None).cast(marks.schema[value].dataType).alias(value), F.lit(1).alias("_kind"))
    w = Window.partitionBy(*keys).orderBy("t", "_kind", value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return m.union(p).withColumn(value, F.last(value, True).over(w)).filter("_kind = 1").drop("_kind")


def differences(rows: DataFrame, segments: DataFrame, keys: list[str], bucket: float, least_similar: float = 0.6, warn_ms: float = 150.0, fail_ms: float = 250.0) -> DataFrame:
    """Where speech and subtitles part. Rows have idx, speech_start, speech_end, subtitle_start, subtitle_end, subtitle_text, note;
    segments have start, end, text. Columns: keys, category, severity, idx, similarity, offset_ms, confirmed, evaluated (the offset of every row that has one).

    missing_subtitle: text is heard in a row's speech window but the row has none, or a segment that no window overlaps (ASR#n);
    missing_speech: a row has text and nothing is heard; misordered: the texts differ; offset: the text
    shows further from the speech than ``warn_ms``. Rows within their limits come with a null category.
    """
    rows = rows.withColumn("confirmed", F.coalesce(F.contains("note", F.lit("已确认")), F.lit(False))).withColumn("_has", F.coalesce(F.col("subtitle_text") != "", F.lit(False)))
    own = F.col("subtitle_start").isNotNull() & F.col("subtitle_end").isNotNull() & F.col("_has")
    timed = rows.withColumn("start", F.when(own, F.col("subtitle_start")).otherwise(F.col("speech_start"))).withColumn("end", F.when(own, F.col("subtitle_end")).otherwise(F.col("speech_end"))).filter("start is not null and end is not null")
    spoken = segments.withColumn("_t", F.nullif(F.col("text"), F.lit("")))
    m = matched_text(timed, spoken, keys, bucket, "idx", "start", "_t")
    offset = (F.col("subtitle_start") - F.coalesce("speech_start", "matched_start")) * 1000
    m = m.withColumn("similarity", F.when(F.col("_has") & (F.col("matched_text") != ""), similarity(normalized(F.col("matched_text")), normalized(F.col("subtitle_text")))))
    alike = F.col("similarity") >= least_similar
    m = m.withColumn("offset_ms", F.when(alike, offset))
    kind = (
        F.when(~F.col("_has"), F.when(F.col("matched_text") != "", "missing_subtitle"))
        .when(F.col("matched_text") == "", "missing_speech")
        .when(~alike, "misordered")
        .when(F.abs("offset_ms") > warn_ms, "offset")
    )
    m = m.withColumn("category", kind).withColumn("severity", F.when(F.col("category").isNotNull(), F.when((F.col("category") == "offset") & (F.abs("offset_ms") > fail_ms), "FAIL").otherwise("WARN")))
    windows = rows.select(*keys, F.col("speech_start").alias("start"), F.col("speech_end").alias("end")).union(rows.select(*keys, "subtitle_start", "subtitle_end")).filter("start is not null and end is not null")
    numbered = segments.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "text")))
    orphan = covered(numbered.filter("text <> ''"), windows, keys, bucket, missing=True)
    none = F.lit(None).cast("double")
    cols = [*keys, "category", "severity", "idx", "similarity", "offset_ms", "confirmed"]
    orphan = orphan.select(*keys, F.lit("missing_subtitle").alias("category"), F.lit("WARN").alias("severity"), F.concat(F.lit("ASR#"), F.col("_i").cast("string")).alias("idx"), none.alias("similarity"), none.alias("offset_ms"), F.lit(False).alias("confirmed"))
    return m.withColumn("idx", F.col("idx").cast("string")).select(cols).union(orphan.select(cols))


#: Fixed value: the order of the categories in reports.
CATEGORIES = ["missing_speech", "missing_subtitle", "misordered", "offset"]


def difference_counts(found: DataFrame) -> DataFrame:
    """Findings by category in report order, zeros included: total, confirmed, suspected."""
    dim = found.sparkSession.createDataFrame(list(enumerate(CATEGORIES)), "rank int, category string")
    n = found.groupBy("category").agg(F.count("*").alias("total"), F.count_if("confirmed").alias("confirmed"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return dim.join(n, "category", "left").select("rank", "category", zero("total").alias("total"), zero("confirmed").alias("confirmed"), (zero("total") - zero("confirmed")).alias("suspected"))


def in_report_order(found: DataFrame) -> DataFrame:
    """Findings by category in report order, then by index as text (null last); sorted by range."""
    return found.orderBy(F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category")).asc_nulls_last(), F.col("idx").asc_nulls_last())


def offset_stats(df: DataFrame, offset: str = "offset_ms", warn_ms: float = 150.0, fail_ms: float = 250.0) -> DataFrame:
    """One row over all offsets: how many, median, 90th percentile (nearest rank) and largest of their sizes, how many are beyond the limits.

    Ranks are found by counting in bins, so no task holds the offsets.
    """
    a = df.filter(F.col(offset).isNotNull()).select(F.abs(offset).cast("double").alias("a"))
    last = F.col("n") - 1
    ranks = {"p90": F.greatest(F.lit(0), F.bround(0.9 * last, 0)), "low": F.floor(last / 2), "high": F.ceil(last / 2)}
    at = exact_ranks(a, "a", ranks).groupBy().agg(*[F.max(F.when(F.col("pick") == p, F.col("value"))).alias(p) for p in ranks])
    counts = a.agg(F.count("*").alias("evaluated"), F.max("a").alias("max_ms"), F.count_if(F.col("a") > warn_ms).alias("n_exceed"), F.count_if(F.col("a") > fail_ms).alias("n_fail"))
    one = counts.withColumn("_k", F.lit(1)).join(at.withColumn("_k", F.lit(1)), "_k")  # a row each
    return one.select("evaluated", ((F.col("low") + F.col("high")) / 2).alias("median_ms"), F.col("p90").alias("p90_ms"), "max_ms", "n_exceed", "n_fail")
