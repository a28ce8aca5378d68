"""Measurements of one signal: arrays of samples in, numbers out, all in the JVM.

A signal row has ``path``, ``sample_rate``, ``full_scale``, ``lsb`` and ``chans`` (array of arrays of
samples). The column functions take one channel, an array of longs or doubles. Samples stay in
their row: nothing here shuffles. Recordings too long for a row are read and measured in chunks
(``sources.media.read_audio_chunks``, ``operators.chunks``) with the same results.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonequarry.functions.stats import nearest_rank_of


def channel_peak(chan: Column) -> Column:
    """The largest absolute sample; 0 when empty."""
    return F.coalesce(F.array_max(F.transform(chan, F.abs)), F.lit(0))


def to_dbfs(amplitude: Column, full_scale: Column) -> Column:
    """20 log10(amplitude / full scale); null at or below zero, as a logarithm of zero has no value to report."""
    return F.when(amplitude > 0, 20 * F.log10(amplitude / full_scale))


def dc_offset(chan: Column, full_scale: Column) -> Column:
    total = F.aggregate(chan, F.lit(0).cast("double"), lambda a, x: a + x)
    return F.when(F.size(chan) > 0, total / F.size(chan) / full_scale).otherwise(F.lit(0.0))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once: an expression that stands in several places of a lambda is worked out in each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stretches(at: Column) -> Column:
    """(start, length) of each stretch of consecutive numbers in a sorted array; ``at`` stands in it several times."""
    rest = F.greatest(F.size(at) - 1, F.lit(0))
    before = F.concat(F.array(F.lit(-2)), F.slice(at, F.lit(1), rest))
    after = F.concat(F.slice(at, F.lit(2), rest), F.array(F.lit(-2)))
    starts = F.array_compact(F.zip_with(at, before, lambda p, b: F.when(p != b + 1, p)))
    ends = F.array_compact(F.zip_with(at, after, lambda p, a: F.when(a != p + 1, p)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s + 1).alias("length")))


def _places(values: Column, holds) -> Column:
    """Positions at which ``holds``."""
    return F.array_compact(F.transform(values, lambda v, i: F.when(holds(v), i)))


def full_scale_runs(chan: Column, full_scale: Column, lsb: Column, min_run: int = 3) -> Column:
    """struct(runs, total): runs of at least ``min_run`` samples at either rail (the top value, its negative, the bottom value), and all such samples."""
    at_rail = _places(chan, lambda v: (v == full_scale - lsb) | (v == lsb - full_scale) | (v == -full_scale))
    return _let(at_rail, lambda at: F.struct(F.filter(_stretches(at), lambda r: r["length"] >= min_run).alias("runs"), F.size(at).alias("total")))


def window_peaks(chan: Column, window: Column) -> Column:
    """Peak of each window of so many samples from the start; the last may be short."""
    n = F.ceil(F.size(chan) / window).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: channel_peak(F.slice(chan, k * window + 1, window)))).otherwise(F.slice(chan, 1, 0))


def head_silence(chan: Column, floor: Column, window: Column) -> Column:
    """Samples before the first window, from the start, that is above the floor; all of them if none is."""
    loud = F.array_position(F.transform(window_peaks(chan, window), lambda p: p > floor), True)
    return F.when(loud > 0, F.least((loud - 1) * window, F.size(chan))).otherwise(F.size(chan))


def tail_silence(chan: Column, floor: Column, window: Column) -> Column:
    """As ``head_silence`` from the end, windows aligned to it; 0 if all is silent, which the head then holds."""
    n = F.size(chan)
    last = lambda k: n - k * window
    first = lambda k: F.greatest(F.lit(0), last(k) - window)
    loud = F.transform(F.sequence(F.lit(0), F.ceil(n / window).cast("int") - 1), lambda k: channel_peak(F.slice(chan, first(k) + 1, last(k) - first(k))) > floor)
    at = F.array_position(loud, True)
    return F.when((n > 0) & (at > 0), F.least((at - 1) * window, n)).otherwise(F.lit(0))


def trailing_zeros(chans: Column) -> Column:
    """Samples at the end that are zero in every channel."""
    back = lambda c: F.array_position(F.transform(F.reverse(c), lambda v: v != 0), True)
    zeros = F.transform(chans, lambda c: F.when(back(c) > 0, back(c) - 1).otherwise(F.size(c)))
    return F.coalesce(F.array_min(zeros), F.lit(0))


def silence_gaps(chans: Column, floor: Column, window: Column, min_frames: Column) -> Column:
    """(start, length) of the runs of windows in which all channels are at or below the floor, with signal before and after, of ``min_frames`` at least."""
    loud = F.aggregate(chans, window_peaks(F.get(chans, F.lit(0)), window), lambda acc, c: F.zip_with(acc, window_peaks(c, window), lambda a, b: F.greatest(a, b)))
    n = F.ceil(F.array_max(F.transform(chans, F.size)) / window)
    loud = F.coalesce(loud, F.array().cast("array<long>"))  # no channels
    inner = F.filter(_let(_places(loud, lambda p: p <= floor), _stretches), lambda r: (r["start"] > 0) & (r["start"] + r["length"] < n))
    gaps = F.transform(inner, lambda r: F.struct((r["start"] * window).alias("start"), (r["length"] * window).alias("length")))
    return F.filter(gaps, lambda g: g["length"] >= min_frames)


def loop_step(chan: Column, full_scale: Column) -> Column:
    """How far the last sample is from the first; 0 below three samples."""
    return F.when(F.size(chan) >= 3, F.abs(F.get(chan, F.lit(0)) - F.element_at(chan, -1)) / full_scale).otherwise(F.lit(0.0))


def slope_p99(chan: Column, full_scale: Column) -> Column:
    """The 99th percentile (nearest rank) of the absolute steps between neighbours; 0 below three samples."""
    rest = F.greatest(F.size(chan) - 1, F.lit(0))
    steps = F.zip_with(F.slice(chan, F.lit(2), rest), F.slice(chan, F.lit(1), rest), lambda a, b: F.abs(a - b))
    return F.when(F.size(chan) >= 3, nearest_rank_of(F.array_sort(steps), 0.99) / full_scale).otherwise(F.lit(0.0))


def loop_onset(chans: Column, full_scale: Column) -> Column:
    return F.array_max(F.transform(chans, lambda c: F.abs(F.get(c, F.lit(0))) / full_scale))


def equal_channels(chans: Column) -> Column:
    return (F.size(chans) == 2) & (F.get(chans, F.lit(0)) == F.get(chans, F.lit(1)))


def frames_of(chan: Column, frame: int, hop: int) -> Column:
    """Whole frames of so many samples, a hop apart; what is left at the end goes."""
    n = F.floor((F.size(chan) - frame) / hop).cast("int")
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(chan, k * hop + 1, frame))).otherwise(F.slice(F.array(chan), 1, 0))
