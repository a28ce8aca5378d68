"""Whole reports as lines of Markdown: headings, tables of a scan's results, sections that are replaced, small state files.

A report is a DataFrame of lines with their place; tables in it stay DataFrames until they are written, sorted
by range, so a table of any length is no task's or driver's burden.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.functions.stats import joined
from tonequarry.functions.text import general, timecode, two_decimals
from tonequarry.operators.intervals import CATEGORIES, in_report_order
from tonequarry.sources.shared import stored

DASH = "—"


@dataclass(frozen=True)
class Table:
    """Rows of a Markdown table: ``cells`` are text columns, ``order`` what sorts them."""

    rows: DataFrame
    header: list[str]
    cells: list[Column]
    order: list[Column | str]


def _text(cell: Column) -> Column:
    text = F.coalesce(cell.cast("string"), F.lit(DASH))
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit(r"\|")), r"\s*[\r\n]+\s*", " ")


def report(spark: SparkSession, parts: list[str | Table | DataFrame]) -> DataFrame:
    """Lines of a report with their place: fixed lines, tables, and DataFrames of one column (lines as they are, sorted).

    Each table keeps its own typed sort keys (``_k<part>_<n>``); ``in_order`` sorts the whole by range.
    """
    fixed, bodies = [], []
    for k, p in enumerate(parts):
        if isinstance(p, str):
            fixed.append((k, 0, p))
            continue
        if isinstance(p, Table):
            fixed += [(k, 0, f"| {' | '.join(p.header)} |"), (k, 1, "|" + " --- |" * len(p.header))]
            line = F.concat(F.lit("| "), F.concat_ws(" | ", *[_text(c) for c in p.cells]), F.lit(" |"))
            rows, order = p.rows, p.order
        else:
            rows, order, line = p, [p.columns[0]], F.col(p.columns[0])
        keys = [(F.col(o) if isinstance(o, str) else o).alias(f"_k{k}_{n}") for n, o in enumerate(order)]
        bodies.append(rows.select(F.lit(k).alias("part"), F.lit(2).alias("n"), line.alias("line"), *keys))
    lines = spark.createDataFrame(fixed, "part int, n int, line string")
    for b in bodies:
        lines = lines.unionByName(b, allowMissingColumns=True)
    return lines


def in_order(lines: DataFrame) -> DataFrame:
    """line of a report, sorted by range."""
    return lines.orderBy("part", "n", *[c for c in lines.columns if c.startswith("_k")]).select("line")


# --- the reports ----------------------------------------------------------------


def compare_report(diff: DataFrame, summary: DataFrame) -> DataFrame:
    """Two scans compared: counts, then what was added, removed and changed. ``diff`` and ``summary`` are ``library.compare``'s."""
    spark = diff.sparkSession
    of = lambda c: diff.filter(F.col("change") == c)
    listed = lambda c: Table(of(c), ["path"], [F.col("path")], ["path"])
    deltas = F.array_join(F.transform("deltas", lambda d: F.format_string("%s %s → %s", d["metric"], d["before"].cast("string"), d["after"].cast("string"))), "; ")
    changed = Table(of("changed"), ["path", "severity", "format", "deltas", "new FAIL"], [F.col("path"), F.col("severity"), F.array_join("notes", ", "), deltas, F.array_join("new_fails", ", ")], ["path"])
    counts = Table(summary, ["added", "removed", "changed", "regressions"], [F.col(c) for c in ("added", "removed", "changed", "regressions")], ["added"])
    return report(spark, ["# Comparison of two scans", "", counts, "", "## Added", "", listed("added"), "", "## Removed", "", listed("removed"), "", "## Changed", "", changed])


def alignment_report(found: DataFrame, counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Speech against subtitles: counts by category, offsets, then the findings of each category."""
    spark = found.sparkSession
    by = Table(counts, ["category", "suspected", "confirmed"], [F.col(c) for c in ("category", "suspected", "confirmed")], ["rank"])
    names = ["evaluated", "median_ms", "p90_ms", "max_ms", "n_exceed", "n_fail"]
    offsets = Table(stats, names, [general(F.col(c).cast("double")) for c in names], ["evaluated"])
    parts: list = ["# Speech and subtitles", "", by, "", "## Offsets", "", offsets]
    rows = in_report_order(found)
    for c in CATEGORIES:
        own = rows.filter(F.col("category") == c)
        parts += ["", f"## {c}", "", Table(own, ["index", "severity", "offset ms", "similarity", "review"], [F.col("idx"), F.col("severity"), general(F.col("offset_ms")), general(F.col("similarity")), F.when(F.col("confirmed"), "confirmed").otherwise("suspected")], ["idx"])]
    return report(spark, parts)


def crosscheck_report(rows: DataFrame, found: DataFrame, state_id: str) -> DataFrame:
    """Text against activity: a row per state, then what has to be heard again."""
    percent = F.format_string("%.0f%%", F.bround(F.col("covered_share") * 100, 0))
    states = Table(rows, ["state", "start s", "end s", "covered", "voice s", "offset ms"], [F.col(state_id), two_decimals(F.col("start")), two_decimals(F.col("end")), percent, two_decimals(F.col("voice_start")), F.col("offset_ms")], ["start", state_id])
    again = Table(found, ["kind", "at s", "subject"], [F.col("kind"), two_decimals(F.col("at")), F.col("subject")], ["kind", "at", "subject"])
    return report(rows.sparkSession, ["# Text and activity", "", states, "", "## To be heard again", "", again])


def profile_report(density: DataFrame, windows: DataFrame, clip: str) -> DataFrame:
    """Momentary loudness: a row per clip with its loudest windows, in time."""
    w = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "mean"))), lambda x: F.format_string("%.0f–%.0f (%.1f)", x["start"].cast("double"), x["end"].cast("double"), F.bround(x["mean"], 1))), ", ")
    rows = density.join(windows.groupBy(clip).agg(w.alias("loudest")), clip, "left")  # four windows a clip
    share = F.format_string("%.0f%%", F.bround(F.col("loud_share") * 100, 0))
    return report(density.sparkSession, ["# Momentary loudness", "", Table(rows, ["clip", "samples", "median LUFS", "above -20", "loudest windows"], [F.col(clip), F.col("n"), F.format_string("%.1f", F.bround(F.col("median"), 1)), share, F.col("loudest")], [clip])])


def steps_report(segments: DataFrame, transitions: DataFrame, clip: str) -> DataFrame:
    """Steps and materials: segments, then the steps at which they change."""
    names = ["segment", "first_step", "last_step", "steps", "start_s", "end_s", "mean_centroid_hz", "mean_low_ratio", "mean_decay", "boundary_step"]
    seg = Table(segments, [clip, *names], [F.col(clip), *[F.col(c) for c in names]], [clip, "segment"])
    turns = ["boundary_step", "distance_to_previous", "distance_to_next", "is_transition"]
    return report(segments.sparkSession, ["# Steps and materials", "", seg, "", "## Changes", "", Table(transitions, [clip, *turns], [F.col(clip), *[F.col(c) for c in turns]], [clip, "boundary_step"])])


def timeline_report(states: DataFrame, clip: str, bands: DataFrame | None = None) -> DataFrame:
    """Shown text: a row per state; with ``bands`` (start, score, amplitude) the five that fitted best, first."""
    parts: list = ["# Shown text", ""]
    if bands is not None:
        best = bands.orderBy(F.desc("score"), F.desc("amplitude")).limit(5)
        parts += [Table(best, ["band", "score", "amplitude"], [F.col("start"), F.col("score"), F.col("amplitude")], [-F.col("score"), -F.col("amplitude")]), ""]
    cells = [F.col(clip), *[two_decimals(F.col(c)) for c in ("start", "end", "duration", "bright")]]
    return report(states.sparkSession, [*parts, Table(states, ["clip", "start s", "end s", "duration s", "bright %"], cells, [clip, "start"])])


def device_report(records: DataFrame, order: str) -> DataFrame:
    """What was done to devices and when: planned, issued, effective, late, whether it took effect, and the default device before and after."""
    three = lambda c: F.format_string("%.3f", F.col(c))
    cells = [F.col("step"), two_decimals(F.col("at")), three("issued_at"), three("effective_at"), two_decimals(F.col("late_by")), F.when(F.col("ok"), "effective").otherwise("**not controlled**"), F.col("label"), F.concat_ws(" → ", "before", "after")]
    bad = records.filter(~F.col("ok")).select(F.concat(F.lit("- `"), F.col("step"), F.lit("`")).alias("line"))
    return report(records.sparkSession, ["# Device timeline", "", Table(records, ["step", "planned s", "issued s", "effective s", "late s", "result", "action", "default device"], cells, [order]), "", "## Not controlled", "", bad])


def session_skeleton(measured: DataFrame, entries: DataFrame, case: str) -> DataFrame:
    """A session's record to fill in: what was measured, the gaps to look at with blank cells, and the conclusion's headings."""
    blank = F.lit("")
    files = Table(measured, ["clip", "duration s", "peak dBFS", "gaps"], [F.col("path"), two_decimals(F.col("duration_s")), two_decimals(F.col("peak_dbfs")), F.size("gaps")], ["path"])
    gaps = Table(entries, ["clip", "time", "ms", "picture", "verdict"], [F.col("path"), timecode(F.col("time_s")), F.format_string("%.0f", F.col("duration_ms")), blank, blank], ["path", "time_s"])
    return report(measured.sparkSession, [f"# {case}", "", "## Environment", "", "| item | value |", "| --- | --- |", "| version |  |", "| device |  |", "", "## Measured", "", files, "", "## Gaps to look at", "", gaps, "", "## Conclusion", "", "- result:", "- reproduced:"])


def defect_payload(judged: DataFrame) -> DataFrame:
    """path and payload: the WARN and FAIL findings of each defective file as one JSON text, for whoever drafts the defect."""
    bad = F.filter("findings", lambda f: f["severity"].isin("WARN", "FAIL"))
    return judged.filter(F.col("status").isin("WARN", "FAIL")).select("path", F.to_json(F.struct("path", "status", bad.alias("findings"))).alias("payload"))


# --- stored timelines, replaced sections, state -----------------------------------


#: Stored records' form. A reader takes its own and older ones.
TIMELINE_VERSION = 2
TIMELINE = "step string, at double, issued_at double, effective_at double, late_by double, ok boolean, label string, before string, after string"


def write_timeline(records: DataFrame, folder: str, clip: str = "clip") -> None:
    """Store records (clip, ``TIMELINE``) as JSON by clip: clips that are written again are replaced, others stay."""
    marked = records.withColumn("version", F.lit(TIMELINE_VERSION))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(clip).json(folder)


def read_timelines(spark: SparkSession, folder: str, clip: str = "clip") -> DataFrame:
    """Stored records of all clips. Records without a version are of the first form, in which late_by was not kept; a later form than
    this reader's is an error."""
    raw = spark.read.schema(f"{TIMELINE}, version int, {clip} string").json(folder)
    known = F.when(F.coalesce("version", F.lit(1)) > TIMELINE_VERSION, F.raise_error(F.lit("the records are of a later form")).cast("boolean")).otherwise(True)
    late = F.coalesce("late_by", F.bround(F.col("issued_at") - F.col("at"), 3))
    return raw.filter(known).withColumn("late_by", late).drop("version")


#: Rows of a table that is broadcast.
BROADCAST_ROWS = 200_000


def _few(df: DataFrame, tag: str) -> DataFrame:
    """``df`` stored, and broadcast if it is small: lines that are joined with it stay where they are."""
    df = stored(df, tag)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def timeline_lines(records: DataFrame, clip: str = "clip") -> DataFrame:
    """(clip, n, line) of every clip's timeline, rendered from records at once: heading, table in the order of ``at`` and step, and what was not controlled.

    Lines are sorted by range and stored once; a range's lines count on from those of the ranges before it, so no task sorts a clip.
    """
    three = lambda c: F.format_string("%.3f", F.col(c))
    cells = [F.col("step"), two_decimals(F.col("at")), three("issued_at"), three("effective_at"), two_decimals(F.col("late_by")), F.when(F.col("ok"), "effective").otherwise("**not controlled**"), F.col("label"), F.concat_ws(" → ", "before", "after")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit("")) for c in cells]), F.lit(" |"))
    names = ["step", "planned s", "issued s", "effective s", "late s", "result", "action", "default device"]
    head = ["## Device timeline", "", f"| {' | '.join(names)} |", f"| {' | '.join(['---'] * len(names))} |"]
    bad = F.concat(F.lit("- `"), F.col("step"), F.lit("` was not controlled"))
    # what is ranged is ranged twice, once for its bounds, so lines are rendered afterwards
    parts = records.withColumn("_part", F.explode(F.when(~F.col("ok"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    rows = parts.repartitionByRange(clip, "_part", "at", "step").withColumn("line", F.when(F.col("_part") == 1, line).otherwise(bad)).sortWithinPartitions(clip, "_part", "at", "step", "line")
    laid = stored(rows.select(clip, F.monotonically_increasing_id().alias("_row"), "line"), "lines").withColumn("_range", F.shiftright("_row", 33))
    ranges = laid.groupBy(clip, "_range").agg(F.count("*").alias("_c"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(clip).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = _few(ranges.select(clip, "_range", (before + len(head) - F.col("_first")).alias("_shift")), "ranges")
    fixed = ranges.select(clip).distinct().select(clip, F.posexplode(F.array(*map(F.lit, head))).alias("n", "line")).withColumn("n", F.col("n").cast("long"))
    return fixed.union(joined(laid, ranges, [clip, "_range"]).select(clip, (F.col("_row") + F.col("_shift")).alias("n"), "line"))


def with_sections(lines: DataFrame, heading: str, sections: DataFrame, doc: str = "clip") -> DataFrame:
    """``with_section`` of many reports (doc, n, line): each keeps its lines before the heading and takes its own section, if it has one."""
    has = sections.select(doc).distinct().withColumn("_new", F.lit(True))
    cut = lines.filter(F.startswith("line", F.lit(heading))).groupBy(doc).agg(F.min("n").alias("_cut"))
    kept = lines.join(_few(has.join(cut, doc, "left"), "cuts"), doc, "left").filter("_new is null or _cut is null or n < _cut").select(doc, "n", "line")
    ends = _few(kept.groupBy(doc).agg((F.max("n") + 1).alias("_end")), "ends")
    added = sections.join(ends, doc, "left").select(doc, (F.col("n") + F.coalesce("_end", F.lit(0))).alias("n"), "line")
    return kept.union(added)


def refresh_timelines(spark: SparkSession, folder: str, reports: DataFrame, clip: str = "clip") -> DataFrame:
    """Reports (clip, n, line) with their timelines rendered again from the stored records: nothing is recorded anew when the form of a report
    changes, and a second time changes nothing."""
    return with_sections(reports, "## Device timeline", timeline_lines(read_timelines(spark, folder, clip), clip), clip)


def with_section(lines: DataFrame, heading: str, section: DataFrame) -> DataFrame:
    """Lines (n, line) up to the first that begins with ``heading``, then ``section`` (n, line): applied twice it changes nothing more."""
    cut = lines.filter(F.startswith("line", F.lit(heading))).agg(F.min("n").alias("cut"), F.lit(1).alias("_k"))
    kept = lines.withColumn("_k", F.lit(1)).join(F.broadcast(cut), "_k").filter("cut is null or n < cut").select("n", "line")
    end = kept.agg((F.coalesce(F.max("n"), F.lit(-1)) + 1).alias("end"), F.lit(1).alias("_k"))
    return kept.union(section.withColumn("_k", F.lit(1)).join(F.broadcast(end), "_k").select((F.col("n") + F.col("end")).alias("n"), "line"))


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """A small JSON file, whole or not at all: written beside its place and renamed over it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    pending = jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = place.getFileSystem(conf).create(pending, True)
    out.write(bytearray(json.dumps(state, ensure_ascii=False, indent=2).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(pending, place, options)
