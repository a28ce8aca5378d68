"""Recorder events and new files as streams, and the same state logic for batches.

Sessions are built by a gap and a running sum, not by filtering ``session_window`` columns: a filter on
those is pushed below the merge of sessions and drops events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The end of a recorder's state name, and what it means.
STATES = ["STARTED", "STARTING", "STOPPING", "STOPPED"]
#: The verdicts of a capture, worst first, and their limits.
VERDICTS = ["不可用", "有警告但可用", "可用"]
SILENT_DBFS, QUIET_LUFS, EXPECTED_RATE, MIN_DURATION_S = -60.0, -45.0, 48000, 5.0

EVENT = "eventType string, eventData struct<outputActive:boolean,outputState:string,outputPath:string>"


def recorder_state(name: Column) -> Column:
    """started, starting, stopping, stopped or other; any prefix of the state's name is allowed."""
    last = F.upper(F.substring_index(name, "_", -1))
    return F.when(last.isin(STATES), F.lower(last)).otherwise("other")


def capture_verdict(peak: Column, full_scale: Column, channels: Column, sample_rate: Column, lufs: Column, duration_s: Column) -> Column:
    """Unusable if silent; usable with warnings if mono, of another rate, very quiet or short; else usable."""
    silent = peak <= full_scale * F.lit(10.0 ** (SILENT_DBFS / 20.0))
    warned = (channels < 2) | (sample_rate != EXPECTED_RATE) | F.coalesce(lufs < QUIET_LUFS, F.lit(False)) | (duration_s < MIN_DURATION_S)
    return F.when(silent, VERDICTS[0]).when(warned, VERDICTS[1]).otherwise(VERDICTS[2])


def sessions(events: DataFrame, keys: list[str], t: str, tie: str, gap: float) -> DataFrame:
    """Add session (from 1): a new one begins where more than ``gap`` lies between an event and the one before."""
    w = Window.partitionBy(*keys).orderBy(t, tie)
    new = F.coalesce(F.col(t) - F.lag(t).over(w) > gap, F.lit(True))
    return events.withColumn("_new", new.cast("int")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def watch_files(spark: SparkSession, folder: str, pattern: str = "*", settle_s: int = 3) -> DataFrame:
    """New files of a folder as a stream: path, length, modificationTime. What was seen is in the query's checkpoint.

    Each file comes once, whole or not: ``live.settled_files`` waits until it is.
    """
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "length", "modificationTime", (F.col("modificationTime") <= F.current_timestamp() - F.expr(f"INTERVAL {int(settle_s)} SECONDS")).alias("settled"))


def recorder_events(spark: SparkSession, folder: str) -> DataFrame:
    """Recorder events in JSON files as a stream: event time of the file, state, path and whether it ends a take."""
    raw = spark.readStream.schema(EVENT).json(folder)
    state = recorder_state(F.col("eventData.outputState"))
    return raw.filter("eventType = 'RecordStateChanged'").select(state.alias("state"), F.col("eventData.outputPath").alias("path"), (state == "stopped").alias("terminal"))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by key and tumbling window of event time; later than ``late`` they are dropped. For streams and batches."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    return e.withWatermark("_ts", late).groupBy(*keys, F.window("_ts", width)).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("start"), "n")


def takes(events: DataFrame) -> DataFrame:
    """Takes from recorder states of a batch (recorder, t, seq, state, path), in the order of t and seq: each stop closes what began at the last start."""
    return takes_with_marks(events).drop("n_marks", "first_mark")


def takes_with_marks(events: DataFrame) -> DataFrame:
    """``takes`` with n_marks and first_mark (seconds from the start): what came, neither start nor stop, between a take's last start and its stop.
    ``live.live_takes`` gives the same of a stream."""
    w = Window.partitionBy("recorder").orderBy("t", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.struct("t", "seq")
    last = lambda state, over: F.last(F.when(F.col("state") == state, at), True).over(over)
    e = events.withColumn("_start", last("started", upto)).withColumn("_stop", last("stopped", w.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.filter("_start is not null and (_stop is null or _start > _stop) and state <> 'started'")
    mark = F.col("state") != "stopped"
    g = e.groupBy("recorder", "_start").agg(
        F.min(F.when(~mark, at)).alias("_end"), F.min_by("path", F.when(~mark, at)).alias("path"), F.count_if(mark).alias("n_marks"), F.min(F.when(mark, F.col("t"))).alias("_mark")
    )
    # a start that another start follows has no stop
    g = g.filter("_end is not null").withColumn("take", F.row_number().over(Window.partitionBy("recorder").orderBy("_end")))
    return g.select("recorder", "take", F.col("_start.t").alias("started"), F.col("_end.t").alias("stopped"), "path", "n_marks", (F.col("_mark") - F.col("_start.t")).alias("first_mark"))
