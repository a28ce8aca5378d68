"""Onsets, step features and frame brightness: what needs an FFT or pixels, in Arrow batches.

One row holds one clip; a batch is worked on clip by clip, so memory follows the longest clip.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
HOP_MS, WIN_MS, FEATURE_MS, MIN_GAP_MS, THRESHOLD_RATIO = 5.0, 20.0, 200.0, 150.0, 2.2
LOW_BAND, HIGH_BAND = (20.0, 250.0), (2000.0, 8000.0)
BRIGHT_PIXEL = 180



def flux(samples: np.ndarray, rate: int) -> np.ndarray:
    """Sum of the rises of the magnitude spectrum from frame to frame; the first frame has none."""
    win, hop = max(1, int(rate * WIN_MS / 1000)), max(1, int(rate * HOP_MS / 1000))
    if len(samples) < win:
        return np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(samples, win)[::hop]
    out = np.zeros(len(frames))
    shape, before = np.hanning(win), None
    for at in range(0, len(frames), 512):  # a block of spectra at a time
        mags = np.abs(np.fft.rfft(frames[at : at + 512] * shape, axis=1))
        rows = mags if before is None else np.concatenate((before, mags))
        out[at + (before is None) : at + len(mags)] = np.maximum(np.diff(rows, axis=0), 0).sum(axis=1)
        before = mags[-1:]
    return out


def _spaced(places: np.ndarray, gap: int) -> np.ndarray:
    """Of ascending places the first, then always the next that is ``gap`` or more beyond the last one taken."""
    taken, at = [], 0
    while at < len(places):
        taken.append(places[at])
        at = int(np.searchsorted(places, places[at] + gap))
    return np.array(taken, np.int64)


def pick(envelope: np.ndarray) -> np.ndarray:
    """Seconds of the envelope's peaks that stand out of their surroundings, ``MIN_GAP_MS`` apart at least."""
    v = pd.Series(envelope, dtype=np.float64)
    if len(v) < 3:
        return np.zeros(0)
    width = 2 * max(3, int(300.0 / HOP_MS)) + 1
    floor = v.rolling(width, center=True, min_periods=1).median() * THRESHOLD_RATIO + max(v.median() * 0.5, 1e-9)
    peaks = v.ge(v.shift(1)) & v.ge(v.shift(-1)) & v.ge(floor)  # the ends have no neighbour, so they are none
    return np.round(_spaced(np.flatnonzero(peaks.to_numpy()), max(1, int(MIN_GAP_MS / HOP_MS))) * HOP_MS / 1000.0, 4)


def features(samples: np.ndarray, onsets: np.ndarray, rate: int, at_once: int = 64) -> np.ndarray:
    """A row per onset: its time, peak, spectral centroid, shares of the low and high band, tail-to-head energy (10 at most). What lies beyond the end counts as zero."""
    width = int(rate * FEATURE_MS / 1000)
    freqs = np.fft.rfftfreq(width, 1.0 / rate)
    bands = np.stack([np.ones_like(freqs), freqs, *((freqs >= lo) & (freqs < hi) for lo, hi in (LOW_BAND, HIGH_BAND))], axis=1)
    padded = np.append(samples, np.zeros(width))
    start = (np.asarray(onsets, np.float64) * rate).astype(np.int64)
    rows = [np.zeros((0, 6))]
    for k in range(0, len(start), at_once):
        chunk = padded[np.minimum(start[k : k + at_once, None], len(samples)) + np.arange(width)]
        sums = np.abs(np.fft.rfft(chunk * np.hanning(width), axis=1)) @ bands
        total = np.where(sums[:, 0] == 0, 1e-9, sums[:, 0])
        halves = np.add.reduceat(chunk * chunk, [0, width // 2], axis=1)
        decay = np.minimum(halves[:, 1] / np.where(halves[:, 0] == 0, 1e-9, halves[:, 0]), 10.0)
        rows.append(np.stack([onsets[k : k + at_once], np.abs(chunk).max(axis=1), *(sums[:, 1:] / total[:, None]).T, decay], axis=1))
    out = np.concatenate(rows)
    for c, digits in enumerate((4, 6, 1, 4, 4, 4)):
        out[:, c] = np.round(out[:, c], digits)
    return out


def envelopes(clips: DataFrame) -> DataFrame:
    """clip and its envelope of rises (``flux``, six digits), from (clip string, sample_rate int, samples array<double>); short clips have none."""

    def run(batches):
        for pdf in batches:
            rows = [(clip, np.round(flux(np.asarray(x, np.float64), int(rate)), 6).tolist()) for clip, rate, x in zip(pdf["clip"], pdf["sample_rate"], pdf["samples"], strict=True) if x is not None and rate and rate > 0]
            yield pd.DataFrame(rows, columns=["clip", "envelope"])

    return clips.select("clip", "sample_rate", "samples").mapInPandas(run, "clip string, envelope array<double>")


def onset_features(clips: DataFrame) -> DataFrame:
    """clip and a row per onset with its features, from (clip string, sample_rate int, samples array<double>); null and short clips have none."""

    def run(batches):
        for pdf in batches:
            rows = []
            for clip, rate, x in zip(pdf["clip"], pdf["sample_rate"], pdf["samples"], strict=True):
                if x is not None and rate and rate > 0:
                    x = np.asarray(x, np.float64)
                    rows += [(clip, *f) for f in features(x, pick(flux(x, int(rate))), int(rate)).tolist()]
            yield pd.DataFrame(rows, columns=["clip", "onset", "peak", "centroid_hz", "low_ratio", "high_ratio", "decay"])

    return clips.select("clip", "sample_rate", "samples").mapInPandas(run, "clip string, onset double, peak double, centroid_hz double, low_ratio double, high_ratio double, decay double")


@F.pandas_udf(T.DoubleType())
def bright_share(pixels: pd.Series) -> pd.Series:
    """Percent of a gray frame's bytes above ``BRIGHT_PIXEL``; null for no pixels."""
    return pixels.map(lambda b: None if not b else float((np.frombuffer(b, np.uint8) > BRIGHT_PIXEL).mean() * 100))


@F.pandas_udf(T.DoubleType())
def flip_share(a: pd.Series, b: pd.Series) -> pd.Series:
    """Percent of pixels that change between bright and dark from one frame to the next; 0 where there is none before or sizes differ."""

    def one(x, y):
        if not x or not y or len(x) != len(y):
            return 0.0
        return float(((np.frombuffer(x, np.uint8) > BRIGHT_PIXEL) != (np.frombuffer(y, np.uint8) > BRIGHT_PIXEL)).mean() * 100)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def frame_signals(frames: DataFrame, keys: list[str]) -> DataFrame:
    """idx, bright and change of gray frames (keys, idx, pixels)."""
    from pyspark.sql.window import Window

    before = F.lag("pixels").over(Window.partitionBy(*keys).orderBy("idx"))
    return frames.withColumn("_before", before).select(*keys, "idx", bright_share("pixels").alias("bright"), flip_share("_before", "pixels").alias("change"))


def band_amplitude(values: Column) -> Column:
    """Spread of a band's brightness: the value at rank floor(0.95 n) less that at floor(0.05 n) of a sorted array, 0 at least."""
    at = lambda f: F.try_element_at(values, (F.least(F.floor(f * F.size(values)), F.size(values) - 1) + 1).cast("int"))
    return F.when(F.size(values) > 0, F.greatest(F.lit(0.0), at(0.95) - at(0.05))).otherwise(F.lit(0.0))


def band_score(n_states: Column, median_s: Column, amplitude: Column) -> Column:
    """A band's amplitude if its states are neither too few nor too many (3 to 60) nor too short or long (0.4 to 20 s), else 0."""
    return F.when(n_states.between(3, 60) & median_s.between(0.4, 20.0), amplitude).otherwise(F.lit(0.0))


def best_band(bands: DataFrame, keys: list[str]) -> DataFrame:
    """The band (start, score, amplitude) of highest score, else of highest amplitude with fallback true; of equals the first."""
    best = F.max_by(F.struct("start", "score", "amplitude"), F.struct("score", F.when(F.col("score") > 0, 0.0).otherwise(F.col("amplitude")), -F.col("start")))
    return bands.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.start", "b.score", "b.amplitude", (F.col("b.score") <= 0).alias("fallback"))


def candidate_bands(region: tuple[float, float] = (0.72, 0.96), height: float = 0.06, step: float = 0.02) -> list[tuple[float, float]]:
    n = int((region[1] - region[0] - height) / step + 1e-9) + 1
    return [(round(region[0] + k * step, 4), round(region[0] + k * step + height, 4)) for k in range(max(0, n))]

