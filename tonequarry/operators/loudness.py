"""Loudness measured from samples, in chunks: weighted energy of tenths of a second, gated blocks, range, true peak.

A chunk is read with ``lead`` frames before its own (``sources.media.read_audio_chunks``, ``chunks.split``), so the filters have what
they need. Each chunk gives the energy of the tenths that it holds; tenths that two chunks share are added up. Blocks of 0.4 and
3 seconds are sums of neighbouring tenths, a few thousand rows for a recording however long its samples are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.functions import dsp
from tonequarry.functions.stats import joined, ranks_by
from tonequarry.sources.shared import stored

#: Offset of the scale, gates, tenths in a block and in a short term, weights of surround channels.
OFFSET, GATE_LUFS, RELATIVE_LU, RANGE_LU = -0.691, -70.0, -10.0, -20.0
BLOCK_TENTHS, SHORT_TENTHS = 4, 30
CHANNEL_WEIGHTS = {5: [1.0, 1.0, 1.0, 1.41, 1.41], 6: [1.0, 1.0, 1.0, 0.0, 1.41, 1.41]}


def lead_frames(rate: int = 192_000) -> int:
    """Frames before a chunk's own that the filters need, for rates up to this."""
    return int(rate * dsp.WEIGHTING_S) + 2 * dsp.PEAK_HALF


def to_lufs(energy: Column) -> Column:
    return F.when(energy > 0, OFFSET + 10 * F.log10(energy))


def _tenths():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                rate, full, lead, at, frames = (one[c][0].as_py() for c in ("sample_rate", "full_scale", "lead", "first_frame", "frames"))
                chans = one["chans"][0].values
                x = [np.asarray(chans[k].values, np.float64) / full for k in range(len(chans) if chans is not None else 0)]
                n = min(map(len, x), default=0) - lead
                if n <= 0:
                    continue
                weights = CHANNEL_WEIGHTS.get(len(x), [1.0] * len(x))
                hop = max(1, round(rate / 10))
                tenth = np.arange(at, at + n) // hop
                energy = np.zeros(int(tenth[-1] - tenth[0]) + 1)
                peak = 0.0
                last = at + n >= frames
                for c, w in zip(x, weights, strict=True):
                    y = dsp.filtered(c[: lead + n], dsp.weighting(rate))[lead:]
                    energy += w * np.bincount(tenth - tenth[0], y * y, len(energy))
                    # places near this chunk's end are the next one's, which has them in its lead
                    ends = np.concatenate((np.zeros(2 * dsp.PEAK_HALF if at == 0 else 0), c[max(0, lead - 2 * dsp.PEAK_HALF) : lead + n], np.zeros(2 * dsp.PEAK_HALF if last else 0)))
                    peak = max(peak, dsp.peak_between(ends), float(np.abs(c[lead:]).max()))
                m = len(energy)
                keys = pa.array([one[0][0].as_py()] * m, one.schema[0].type)
                yield pa.record_batch([keys, pa.array(np.arange(m) + int(tenth[0])), pa.array(energy), pa.array(np.bincount(tenth - tenth[0], minlength=m)), pa.array(np.full(m, hop)), pa.array(np.full(m, peak))], names=["key", "tenth", "energy", "n", "hop", "peak"])

    return run


def tenths(chunks: DataFrame, key: str = "path") -> DataFrame:
    """key, tenth, energy (weighted, of all channels), n (frames), hop (frames of a whole tenth), peak (true, of the chunks that it lies in).
    ``chunks``: key, sample_rate, full_scale, lead, first_frame, frames (of the whole recording), chans."""
    kind = chunks.schema[key].dataType.simpleString()
    cols = [key, "sample_rate", "full_scale", "lead", "first_frame", "frames", "chans"]
    each = chunks.select(*cols).mapInArrow(_tenths(), f"key {kind}, tenth long, energy double, n long, hop long, peak double")
    return each.groupBy(F.col("key").alias(key), "tenth").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n"), F.max("hop").alias("hop"), F.max("peak").alias("peak"))


def _blocks(t: DataFrame, key: str, size: int) -> DataFrame:
    """Mean energy of every ``size`` neighbouring whole tenths."""
    w = Window.partitionBy(key).orderBy("tenth").rowsBetween(0, size - 1)
    b = t.filter("n = hop").select(key, "tenth", (F.sum("energy").over(w) / (size * F.col("hop"))).alias("energy"), F.count("*").over(w).alias("_size"))
    return b.filter(F.col("_size") == size).drop("_size").withColumn("lufs", to_lufs(F.col("energy"))).filter(F.col("lufs") > GATE_LUFS)


def _above(blocks: DataFrame, key: str, relative: float) -> DataFrame:
    """The blocks within so much of the mean of those above the gate."""
    mean = blocks.groupBy(key).agg((to_lufs(F.avg("energy")) + relative).alias("_gate"))
    return joined(blocks, mean, [key]).filter(F.col("lufs") > F.col("_gate"))


def meter(chunks: DataFrame, key: str = "path") -> DataFrame:
    """key, lufs, lra and true_peak_dbtp, as ``sources.external.loudness`` reads them from a meter's log. lufs and lra are null where no
    block is above the gates: recordings shorter than a block, or silent."""
    t = stored(tenths(chunks, key), "tenths")
    heard = _above(_blocks(t, key, BLOCK_TENTHS), key, RELATIVE_LU).groupBy(key).agg(to_lufs(F.avg("energy")).alias("lufs"))
    short = _above(_blocks(t, key, SHORT_TENTHS), key, RANGE_LU)
    last = F.col("n") - 1
    spread = ranks_by(short, [key], "lufs", {"_low": (0.1, F.bround(0.1 * last, 0)), "_high": (0.95, F.bround(0.95 * last, 0))}).select(key, (F.col("_high") - F.col("_low")).alias("lra"))
    peak = t.groupBy(key).agg(F.max("peak").alias("_peak"))
    out = joined(joined(peak, heard, [key], "left"), spread, [key], "left")
    return out.select(key, "lufs", "lra", F.when(F.col("_peak") > 0, 20 * F.log10("_peak")).alias("true_peak_dbtp"))
