"""Filters on arrays of samples, a block at a time: the loudness weighting, oversampled peaks, one sample rate for all."""

from __future__ import annotations

from functools import lru_cache
from math import gcd

import numpy as np

#: Fixed values of the loudness weighting: a shelf and a high-pass (frequency in Hz, quality, and the shelf's gain in dB).
SHELF_HZ, SHELF_Q, SHELF_DB = 1681.974450955533, 0.7071752369554196, 3.999843853973347
HIGH_PASS_HZ, HIGH_PASS_Q = 38.13547087602444, 0.5003270373238773
#: What the weighting leaves of an impulse after this time is below 1e-12 of it.
WEIGHTING_S = 0.2
#: Outputs of a resampler that are worked out together.
BLOCK = 1 << 15


def _biquads(rate: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The two sections for any rate, by the bilinear transform."""
    k, v = np.tan(np.pi * SHELF_HZ / rate), 10 ** (SHELF_DB / 20)
    vb = v**0.4996667741545416
    a0 = 1 + k / SHELF_Q + k * k
    shelf = (np.array([v + vb * k / SHELF_Q + k * k, 2 * (k * k - v), v - vb * k / SHELF_Q + k * k]) / a0, np.array([1, 2 * (k * k - 1) / a0, (1 - k / SHELF_Q + k * k) / a0]))
    k = np.tan(np.pi * HIGH_PASS_HZ / rate)
    a0 = 1 + k / HIGH_PASS_Q + k * k
    return [shelf, (np.array([1.0, -2.0, 1.0]), np.array([1, 2 * (k * k - 1) / a0, (1 - k / HIGH_PASS_Q + k * k) / a0]))]


@lru_cache
def weighting(rate: int) -> np.ndarray:
    """The loudness weighting's response to an impulse, as long as it can be told from nothing: a filter without memory beyond it."""
    x = np.zeros(int(rate * WEIGHTING_S))
    x[0] = 1.0
    for b, a in _biquads(rate):
        y = np.zeros_like(x)
        for n in range(len(x)):
            y[n] = b[0] * x[n] + sum(b[i] * x[n - i] - a[i] * y[n - i] for i in (1, 2) if n >= i)
        x = y
    return x


def filtered(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``x`` convolved with ``h``, as long as ``x``, by overlapping transforms."""
    size = 1 << max(12, (4 * len(h) - 1).bit_length())
    step, spectrum = size - len(h) + 1, np.fft.rfft(h, size)
    out = np.empty(len(x))
    padded = np.concatenate((np.zeros(len(h) - 1), x))
    for at in range(0, len(x), step):
        y = np.fft.irfft(np.fft.rfft(padded[at : at + size], size) * spectrum, size)[len(h) - 1 :]
        out[at : at + step] = y[: len(out[at : at + step])]
    return out


@lru_cache
def _phases(up: int, cut: float, half: int) -> np.ndarray:
    """Windowed sincs at each of ``up`` places between two samples, passing ``cut`` of the band; rows sum to 1."""
    t = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    h = cut * np.sinc(cut * t) * np.i0(9.0 * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(9.0)
    return h / h.sum(axis=1, keepdims=True)


def resampled(x: np.ndarray, rate: int, to: int, half: int = 32) -> np.ndarray:
    """Samples at another rate, by a windowed sinc at each output's own place between samples (a filter for each of the places that occur).
    Going down, the band above the new rate's half is left out."""
    if rate == to or not len(x):
        return np.asarray(x, np.float64)
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    cut = min(1.0, to / rate) * 0.97
    half = int(np.ceil(half / min(1.0, to / rate)))
    h, n = _phases(up, cut, half), -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(half - 1), x, np.zeros(half + 1)))
    views = np.lib.stride_tricks.sliding_window_view(padded, 2 * half)
    out = np.empty(n)
    for at in range(0, n, BLOCK):
        k = np.arange(at, min(n, at + BLOCK)) * down
        out[at : at + BLOCK] = np.einsum("ij,ij->i", views[k // up], h[k % up])
    return out


#: Taps to either side of a place, and places to a sample, where peaks between samples are looked for.
PEAK_HALF, PEAK_UP = 16, 4


def peak_between(x: np.ndarray) -> float:
    """The largest absolute value of ``x`` four times oversampled, from ``PEAK_HALF`` samples after its start to as many before its end."""
    if len(x) < 2 * PEAK_HALF:
        return 0.0
    h = _phases(PEAK_UP, 1.0, PEAK_HALF)
    views = np.lib.stride_tricks.sliding_window_view(x, 2 * PEAK_HALF)
    return max(float(np.abs(views[at : at + BLOCK] @ h.T).max()) for at in range(0, len(views), BLOCK))
