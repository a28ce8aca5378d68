"""Recordings of any length, measured chunk by chunk.

A chunk row has a key (``path``), ``chunk`` (from 0), ``first_frame`` and ``chans``: its samples by channel. ``summarize``
measures each chunk alone and keeps what a neighbour can change apart: runs that touch an edge, the first and last
loud frame, edge samples. The functions after it merge the summaries of a recording in the order of its chunks, so a run, a
gap or a step over an edge is one. Nothing but a summary leaves a chunk's task; windows run over summaries, a row for each
chunk. Results are those of ``signals`` on the whole recording, whatever the chunk's size. All channels of a chunk
are of one length; an empty recording is one chunk of no frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.functions.stats import joined, ranks_of_counts
from tonequarry.operators import rules as R
from tonequarry.operators import signals as S
from tonequarry.sources.shared import stored

#: Of a channel: its peak and sum, samples at a rail, whole runs of them, runs that touch an edge (``joins``), edge samples, loud frames' ends.
CHANNEL = "struct<channel:int,peak:long,total:double,n_rail:long,runs:array<struct<start:long,length:long>>,joins:array<struct<start:long,length:long>>,first:long,last:long,loud_first:long,loud_last:long>"
SUMMARY = f"n long, by_channel array<{CHANNEL}>, loud_first long, loud_last long, gaps array<struct<start:long,length:long>>, sound_last long, same boolean"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64())])
_ARROW = pa.struct(
    [("channel", pa.int32()), ("peak", pa.int64()), ("total", pa.float64()), ("n_rail", pa.int64()), ("runs", pa.list_(_RUN)), ("joins", pa.list_(_RUN))] + [(k, pa.int64()) for k in ("first", "last", "loud_first", "loud_last")]
)


def split(signals: DataFrame, frames: int, key: str = "path", lead: int = 0) -> DataFrame:
    """Chunks of so many frames of signals that fit a row: the same columns, with chunk, first_frame, frames (of the whole) and lead (up to
    so many frames before the chunk's own come first)."""
    rows = signals.withColumn("frames", F.coalesce(F.array_min(F.transform("chans", F.size)), F.lit(0)).cast("long"))
    n = F.greatest(F.lit(1), F.ceil(F.col("frames") / frames)).cast("long")
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("first_frame", F.col("chunk") * frames)
    rows = rows.withColumn("lead", F.least(F.lit(lead).cast("long"), "first_frame"))
    part = F.transform("chans", lambda c: F.slice(c, (F.col("first_frame") - F.col("lead") + 1).cast("int"), (F.least(F.lit(frames), F.col("frames") - F.col("first_frame")) + F.col("lead")).cast("int")))
    return rows.withColumn("chans", part)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (past the last) of the runs of true."""
    d = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _records(start: np.ndarray, length: np.ndarray) -> list[dict]:
    return [{"start": a, "length": b} for a, b in zip(start.tolist(), length.tolist(), strict=True)]


def _channel(x: np.ndarray, at: int, k: int, floor: float, full: int, lsb: int, least: int) -> dict:
    rail = (x == full - lsb) | (x == lsb - full) | (x == -full)
    lo, hi = _runs(rail)
    size = np.abs(x)
    loud = np.flatnonzero(size > floor)
    edge = (lo == 0) | (hi == len(x))
    whole = ~edge & (hi - lo >= least)
    out = {"channel": k, "peak": int(size.max(initial=0)), "total": float(x.sum()), "n_rail": int(rail.sum())}
    out |= {"runs": _records(lo[whole] + at, (hi - lo)[whole]), "joins": _records(lo[edge] + at, (hi - lo)[edge])}
    out |= {"first": int(x[0]), "last": int(x[-1])} if len(x) else {"first": None, "last": None}
    return out | ({"loud_first": int(loud[0]) + at, "loud_last": int(loud[-1]) + at} if len(loud) else {"loud_first": None, "loud_last": None})


def _gap(before: np.ndarray, after: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Silent windows between two loud frames: where they begin, and their frames (0: none)."""
    first = before // window + 1
    return first * window, np.maximum(after // window - first, 0) * window


def channels_of(chans: pa.Array) -> Iterator[list[np.ndarray]]:
    """Each row's channels as arrays over the batch's own memory."""
    rows, parts = chans.offsets.to_numpy(), chans.values
    ends, flat = parts.offsets.to_numpy(), np.asarray(parts.values.to_numpy(zero_copy_only=False), np.int64)
    for lo, hi in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        yield [flat[ends[k] : ends[k + 1]] for k in range(lo, hi)]


def _summaries(names: list[str], least: int, sound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"n": pa.int64(), "by_channel": pa.list_(_ARROW), "loud_first": pa.int64(), "loud_last": pa.int64(), "gaps": pa.list_(_RUN), "sound_last": pa.int64(), "same": pa.bool_()}
        for b in batches:
            rows = []
            told = (b[c].to_pylist() for c in ("first_frame", "_floor", "full_scale", "lsb", "_window", "_gap"))
            for x, at, floor, full, lsb, window, gap in zip(channels_of(b["chans"]), *told, strict=True):
                n = min(map(len, x), default=0)
                x = [c[:n] for c in x]
                most = np.abs(x).max(axis=0) if x else np.empty(0, np.int64)
                loud, heard = np.flatnonzero(most > floor) + at, np.flatnonzero(most > sound)
                start, length = _gap(loud[:-1], loud[1:], window)
                keep = length >= max(gap, 1)
                ends = (int(loud[0]), int(loud[-1])) if len(loud) else (None, None)
                rows.append((n, [_channel(c, at, k, floor, full, lsb, least) for k, c in enumerate(x)], *ends, _records(start[keep], length[keep]), int(heard[-1]) + at if len(heard) else None, len(x) == 2 and bool((x[0] == x[1]).all())))
            if rows:
                yield pa.record_batch([*(b[c] for c in names), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True))], names=[*names, *kinds])

    return run


def summarize(chunks: DataFrame, floor: Column, window: Column, gap: Column, min_run: int = 3, sound: int = 0) -> DataFrame:
    """A summary (``SUMMARY``) in place of each chunk's samples; other columns stay. ``floor`` is the amplitude up to which all is silent, ``window``
    its grid in frames, ``gap`` the least frames of a gap, ``min_run`` the least samples of a run at a rail, ``sound`` the size up to which a sample is zero."""
    held = chunks.withColumns({"_floor": floor.cast("double"), "_window": window.cast("long"), "_gap": gap.cast("long")})
    names = [c for c in held.columns if c != "chans"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields if f.name in names)
    return held.mapInArrow(_summaries(names, min_run, sound), f"{schema}, {SUMMARY}")


# --- merging --------------------------------------------------------------------


def _by_channel(found: DataFrame, key: str) -> DataFrame:
    return found.select(key, "chunk", "first_frame", "n", F.explode("by_channel").alias("c")).select(key, "chunk", "first_frame", "n", "c.*")


def clip_runs(found: DataFrame, min_run: int = 3, key: str = "path") -> DataFrame:
    """key, channel, start, length of every run at a rail of ``min_run`` samples at least; pieces on both sides of an edge are one run."""
    c = _by_channel(found, key)
    pieces = c.select(key, "channel", F.inline("joins"))
    w = Window.partitionBy(key, "channel").orderBy("start")
    new = F.coalesce(F.lag(F.col("start") + F.col("length")).over(w) != F.col("start"), F.lit(True))
    runs = pieces.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy(key, "channel", "_run").agg(F.min("start").alias("start"), F.sum("length").alias("length")).filter(F.col("length") >= min_run)
    return c.select(key, "channel", F.inline("runs")).union(runs.select(key, "channel", "start", "length"))


def silence_gaps(found: DataFrame, key: str = "path") -> DataFrame:
    """key, start, length of every gap: windows in which all channels are silent, with sound before and after."""
    before = F.last("loud_last", True).over(Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    first = F.floor(before / F.col("_window")) + 1
    over = found.withColumn("start", first * F.col("_window")).withColumn("length", (F.floor(F.col("loud_first") / F.col("_window")) - first) * F.col("_window"))
    return found.select(key, F.inline("gaps")).union(over.filter(F.col("length") >= F.greatest(F.col("_gap"), F.lit(1))).select(key, "start", "length"))


def edge_silence(found: DataFrame, key: str = "path") -> DataFrame:
    """key, channel, head, tail: frames of the silent windows at a channel's start and, on a grid from its end, at its end; a silent channel is all head."""
    c = found.select(key, "_window", "n", F.explode("by_channel").alias("c")).groupBy(key, "c.channel").agg(
        F.max("_window").alias("w"), F.sum("n").alias("n"), F.min("c.loud_first").alias("a"), F.max("c.loud_last").alias("b")
    )
    head = F.coalesce(F.floor(F.col("a") / F.col("w")) * F.col("w"), F.col("n"))
    tail = F.coalesce(F.floor((F.col("n") - 1 - F.col("b")) / F.col("w")) * F.col("w"), F.lit(0))
    return c.select(key, "channel", head.alias("head"), tail.alias("tail"))


def trailing_zeros(found: DataFrame, key: str = "path") -> DataFrame:
    """key, n_zeros: samples at the end that are zero in every channel."""
    return found.groupBy(key).agg((F.sum("n") - 1 - F.coalesce(F.max("sound_last"), F.lit(-1))).alias("n_zeros"))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = []
        for row, x in enumerate(channels_of(b["chans"])):
            for k, c in enumerate(x):
                size, n = np.unique(np.abs(np.diff(c)), return_counts=True)
                parts.append((np.full(len(size), row), np.full(len(size), k, np.int32), size, n))
        if parts:
            row, k, size, n = map(np.concatenate, zip(*parts, strict=True))
            yield pa.record_batch([b.column(0).take(pa.array(row)), pa.array(k), pa.array(size), pa.array(n)], names=["key", "channel", "step", "times"])


def loop_seams(chunks: DataFrame, found: DataFrame, key: str = "path") -> DataFrame:
    """key, channel, step (from the last sample to the first), slope (99th percentile, nearest rank, of the steps between neighbours); 0 below three samples.

    Each chunk counts its steps by size, the steps over edges come from the summaries, and the rank is found by counting.
    """
    kind = chunks.schema[key].dataType.simpleString()
    within = chunks.select(key, "chans").mapInArrow(_steps, f"key {kind}, channel int, step long, times long").withColumnRenamed("key", key)
    c = _by_channel(found, key).filter("n > 0")
    w = Window.partitionBy(key, "channel").orderBy("chunk")
    over = c.select(key, "channel", F.abs(F.col("first") - F.lag("last").over(w)).alias("step"), F.lit(1).cast("long").alias("times")).filter("step is not null")
    slopes = ranks_of_counts(within.union(over), [key, "channel"], "step", "times", {"slope": F.bround(0.99 * (F.col("n") - 1), 0)}).drop("n")
    ends = c.groupBy(key, "channel").agg(F.sum("n").alias("n"), F.abs(F.min_by("first", "chunk") - F.max_by("last", "chunk")).alias("step"))
    long = F.col("n") >= 3
    out = joined(ends, slopes, [key, "channel"], "left")
    return out.select(key, "channel", F.when(long, F.col("step")).otherwise(0).alias("step"), F.when(long, F.col("slope")).otherwise(0.0).alias("slope"))


def measure(chunks: DataFrame, cfg: R.Thresholds = R.Thresholds(), key: str = "path") -> DataFrame:
    """A row for each recording with the measurements of ``rules.measure``, ready for ``rules.judge``. Chunks carry sample_rate, full_scale, lsb and
    what else is of the file (the same in all its chunks)."""
    rate, fs = F.col("sample_rate"), F.col("full_scale").cast("double")
    floor = fs * F.lit(10.0 ** (cfg.silence_floor_dbfs / 20.0))
    window = F.greatest(F.lit(1), F.floor(rate * cfg.silence_window_ms / 1000.0))
    gap = F.greatest(F.lit(1), F.floor(rate * cfg.dropout_min_ms / 1000.0))
    # small rows that several merges read: samples are read twice in all, here and for their steps
    found = stored(summarize(chunks, floor, window, gap, cfg.clip_min_run), "summaries")
    of_file = [c for c in chunks.columns if c not in (key, "chunk", "first_frame", "chans", "frames", "lead")]
    ms = lambda c: c / rate * 1000.0
    one = found.groupBy(key).agg(*[F.first(c).alias(c) for c in (*of_file, "_floor")], F.sum("n").alias("frames"), F.coalesce(F.max("sound_last"), F.lit(-1)).alias("_sound"), F.every("same").alias("same_channels"))
    chan = _by_channel(found, key).groupBy(key, "channel").agg(
        F.max("peak").alias("peak"), F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("n_rail").alias("rail"), F.abs(F.min_by("first", F.when(F.col("n") > 0, F.col("chunk")))).alias("onset")
    )
    chan = joined(joined(chan, edge_silence(found, key), [key, "channel"], "left"), loop_seams(chunks, found, key), [key, "channel"], "left")
    chan = chan.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("channel", "peak"))).alias("_peaks"),  # a row for each channel
        F.max(F.when(F.col("n") > 0, F.abs(F.col("total") / F.col("n"))).otherwise(0.0)).alias("_dc"),
        F.min("head").alias("_head"), F.min("tail").alias("_tail"), F.max(F.coalesce("step", F.lit(0))).alias("_step"), F.max(F.coalesce("slope", F.lit(0.0))).alias("_slope"), F.max("onset").alias("_onset"), F.sum("rail").alias("clip_samples"),
    )
    runs = clip_runs(found, cfg.clip_min_run, key)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("start", "channel", "length"))
    n_runs = runs.groupBy(key).agg(F.count("*").alias("clip_runs"))
    listed = runs.withColumn("_k", rank).filter(F.col("_k") <= R.LISTED).groupBy(key).agg(F.collect_list(F.struct("start", "channel", "length")).alias("_runs"))
    gaps = silence_gaps(found, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length")))).alias("gaps"))
    out = joined(joined(joined(one, chan, [key], "left"), n_runs, [key], "left"), listed, [key], "left")
    none = F.array().cast("array<struct<start:int,length:int>>")
    out = joined(out, gaps, [key], "left").withColumn("gaps", F.coalesce("gaps", none)) if cfg.dropout_min_ms > 0 else out.withColumn("gaps", none)
    peaks = F.coalesce(F.transform("_peaks", lambda c: c["peak"]), F.array().cast("array<long>"))
    listed = F.transform("_runs", lambda r: F.struct(F.bround(r["start"] / rate, 4).alias("time_s"), r["channel"].alias("channel"), r["length"].cast("int").alias("samples")))
    peak = F.array_max(peaks)
    return out.withColumns(
        {
            "n_channels": F.size(peaks),
            "duration_s": F.col("frames") / rate,
            "dc_offset": F.col("_dc") / fs,
            "head_silence_ms": ms(F.col("_head")),
            "tail_silence_ms": ms(F.col("_tail")),
            "tail_zero_ms": ms(F.when(F.size(peaks) > 0, F.col("frames") - 1 - F.col("_sound")).otherwise(0)),
            "loop_step": F.col("_step") / fs,
            "slope_p99": F.col("_slope") / fs,
            "loop_onset": F.col("_onset") / fs,
            "peak": F.coalesce(peak, F.lit(0)),
            "peak_dbfs": S.to_dbfs(peak, fs),
            "silent_channels": F.filter(F.transform(peaks, lambda p, i: F.when(p <= F.col("_floor"), i)), lambda i: i.isNotNull()),
            "clip_runs": F.coalesce("clip_runs", F.lit(0)),
            "clip_samples": F.coalesce("clip_samples", F.lit(0)),
            "clip_list": F.coalesce(F.array_sort(listed), F.array().cast("array<struct<time_s:double,channel:int,samples:int>>")),
            "silent": F.coalesce(peak, F.lit(0)) <= F.col("_floor"),
        }
    ).drop("_floor", "_sound", "_peaks", "_dc", "_head", "_tail", "_step", "_slope", "_onset", "_runs")
