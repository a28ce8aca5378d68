"""Sources whose reading is done by something outside: decoders, loudness meters, transcribers, frame grabbers, profilers.

What they print or leave behind is parsed here as DataFrames. Whatever runs them is a function that the caller
gives (``command_decoder`` makes one of a command), so nothing outside has to be installed to use the rest.
"""

from __future__ import annotations

import re
import subprocess
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.functions.dsp import resampled
from tonequarry.functions.text import base_name, parent, suffix
from tonequarry.sources.media import EXTENSIONS, list_files, parse_wav, pcm_samples

#: A decoder's line on an audio stream, channels by the name of a layout, and what counts without such a line.
STREAM = r"Stream #\d+:\d+[^:\n]*: Audio: ([\w.]+)[^,\n]*, (\d+) Hz, ([^,\n]+), (\w+)"
LAYOUTS = {"mono": 1, "stereo": 2, "2.1": 3, "quad": 4, "4.0": 4, "5.0": 5, "5.1": 6, "7.1": 8}
FALLBACK_RATE, FALLBACK_CHANNELS = 44100, 2
#: A loudness meter's summary; its last one counts.
INTEGRATED = r"(?m)^\s*I:\s+(-?[\d.]+|-?inf)\s+LUFS"
RANGE = r"(?m)^\s*LRA:\s+(-?[\d.]+|-?inf)\s+LU"
TRUE_PEAK = r"True peak:\s*\n\s*Peak:\s+(-?[\d.]+|-?inf)\s+dBFS"


def stream_info(log: Column) -> Column:
    """struct(codec, sample_rate, channels, sample_format) of a decoder's log: by the layout's name, else its number of channels, else 1; the usual values without such a line."""
    part = lambda k: F.regexp_extract(log, STREAM, k)
    found = F.coalesce(part(1) != "", F.lit(False))
    layout = F.trim(F.substring_index(part(3), "(", 1))
    named = F.try_element_at(F.create_map(*[F.lit(x) for kv in LAYOUTS.items() for x in kv]), layout)
    channels = F.coalesce(named, F.regexp_extract(part(3), r"^\s*(\d+) channels", 1).try_cast("int"), F.lit(1))
    pick = lambda value, other: F.when(found, value).otherwise(F.lit(other))
    return F.struct(pick(part(1), "unknown").alias("codec"), pick(part(2).try_cast("int"), FALLBACK_RATE).alias("sample_rate"), pick(channels, FALLBACK_CHANNELS).alias("channels"), pick(part(4), "s16").alias("sample_format"))


def layout_channels(layout: str | None) -> int:
    """Channels of a layout's name, or of "n channels"; one for what isn't known."""
    name = (layout or "").partition("(")[0].strip()
    count = name.partition(" ")[0]
    return LAYOUTS.get(name, int(count) if name.endswith("channels") and count.isdigit() else 1)


def parse_stream(log: str) -> tuple[int, int]:
    """(rate, channels) of a decoder's log; ``stream_info`` reads the same of a column of logs."""
    found = re.search(STREAM, log)
    return (int(found[2]), layout_channels(found[3])) if found else (FALLBACK_RATE, FALLBACK_CHANNELS)


#: Bytes of a failed command's log that its error repeats.
LOG_TAIL = 400


def command_decoder(command: list[str], timeout: float = 600.0) -> Callable[[bytes], tuple[int, int, int, bytes]]:
    """A decoder for ``read_audio`` of a command that reads a file from its input and writes 16-bit PCM; its log tells rate and channels."""

    def decode(content: bytes) -> tuple[int, int, int, bytes]:
        done = subprocess.run(command, input=content, capture_output=True, timeout=timeout, check=False)  # noqa: S603  the caller's command
        if not done.stdout or done.returncode != 0:
            raise ValueError(f"exit code {done.returncode}, {len(done.stdout)} bytes decoded; log: {done.stderr[-LOG_TAIL:].decode('utf-8', 'replace').strip()}")
        return (*parse_stream(done.stderr.decode("utf-8", "replace")), 2, done.stdout)

    return decode


def loudness(logs: DataFrame, path: str = "path", text: str = "value") -> DataFrame:
    """path, lufs, lra and true_peak_dbtp of a meter's whole logs: the last match of each; null for none and for what isn't finite."""

    def last(pattern: str) -> Column:
        found = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), -1).try_cast("double")
        return F.when(~F.isnan(found) & (F.abs(found) < float("inf")), found)

    return logs.select(path, last(INTEGRATED).alias("lufs"), last(RANGE).alias("lra"), last(TRUE_PEAK).alias("true_peak_dbtp"))


def read_mono(spark: SparkSession, root: str, decoder: Callable[[bytes], tuple[int, np.ndarray]] | None = None, extensions: list[str] = EXTENSIONS, rate: int | None = None) -> DataFrame:
    """clip, sample_rate, samples (doubles from -1 to 1, channels averaged) and error of each file. ``decoder`` gives (rate, samples); without one WAV is read.
    With ``rate`` all samples come at that rate (features of steps are measured at 48000)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(suffix(F.col("path")).isin([e.lower() for e in extensions])).select("path", "content")

    def wav(content: bytes) -> tuple[int, np.ndarray]:
        rate, channels, width, pcm = parse_wav(content)
        return rate, pcm_samples(pcm, width, channels).mean(axis=1) / float(1 << (31 if width == 3 else 8 * width - 1))

    def run(batches):
        for b in batches:
            for path, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                own, samples, error = None, None, None
                try:
                    own, samples = (decoder or wav)(content)
                    if rate:
                        own, samples = rate, resampled(samples, own, rate)
                except Exception as e:  # noqa: BLE001  one file's fault is its row's error
                    error = str(e) or type(e).__name__
                values = pa.nulls(1, pa.list_(pa.float64())) if samples is None else pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples, pa.float64()))
                yield pa.record_batch([pa.array([path]), pa.array([own], pa.int32()), values, pa.array([error], pa.string())], names=["clip", "sample_rate", "samples", "error"])

    return files.mapInArrow(run, "clip string, sample_rate int, samples array<double>, error string")


def transcribe(audio: DataFrame, model: Callable[[], Callable[[int, np.ndarray], Iterable[tuple[float, float, str]]]]) -> DataFrame:
    """clip, start, end and text of what ``model`` hears in (clip, sample_rate, samples); it is made once in each task."""

    def run(batches):
        hear = model()
        for pdf in batches:
            rows = [(clip, float(a), float(b), text) for clip, rate, x in zip(pdf["clip"], pdf["sample_rate"], pdf["samples"], strict=True) if x is not None for a, b, text in hear(int(rate), np.asarray(x, np.float64))]
            yield pd.DataFrame(rows, columns=["clip", "start", "end", "text"])

    return audio.select("clip", "sample_rate", "samples").mapInPandas(run, "clip string, start double, end double, text string")


def read_frames(spark: SparkSession, root: str, grab: Callable[[bytes], Iterable[bytes]], extensions: list[str]) -> DataFrame:
    """clip, idx and pixels (gray) of the frames that ``grab`` takes from each file, one frame a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(suffix(F.col("path")).isin(extensions)).select("path", "content")

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for k, pixels in enumerate(grab(content)):
                    yield pd.DataFrame({"clip": [path], "idx": [k], "pixels": [bytes(pixels)]})

    return files.mapInPandas(run, "clip string, idx int, pixels binary")


def complexity(files: DataFrame, fps: float) -> DataFrame:
    """clip (the folder of its frames), t and kb: a picture's size stands for how much is on it. Frames are counted by name; contents are not read."""
    at = (F.row_number().over(Window.partitionBy("clip").orderBy("_name")) - 1) / F.lit(float(fps))
    return files.select(parent(F.col("path")).alias("clip"), base_name(F.col("path")).alias("_name"), "length").select("clip", at.alias("t"), (F.col("length") / 1024).alias("kb"))


SNAPSHOT = (
    "capturedAt string, connection struct<remote:struct<isConnected:boolean>>, performanceMonitor struct<`return`:array<struct<id:string,name:string,value:double>>>, "
    "voices struct<`return`:array<struct<objectName:string,gameObjectName:string,gameObjectID:long,pipelineID:long,isVirtual:boolean>>>"
)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """captured_at, connected, counters and voices of a profiler's snapshots in JSON lines. Without a connection zeros would mean nothing: they are null."""
    raw = spark.read.schema(SNAPSHOT).json(path)
    on = F.coalesce(F.col("connection.remote.isConnected"), F.lit(False))
    only = lambda c: F.when(on, F.col(c).getField("return"))
    return raw.select(F.col("capturedAt").alias("captured_at"), on.alias("connected"), only("performanceMonitor").alias("counters"), only("voices").alias("voices"))


def counters(snapshots: DataFrame) -> DataFrame:
    """captured_at, id, name and value of each counter."""
    return snapshots.select("captured_at", F.inline("counters"))


def voices(snapshots: DataFrame) -> DataFrame:
    """captured_at and the fields of each voice."""
    return snapshots.select("captured_at", F.inline("voices"))


SEEN = "path string, length long, modificationTime timestamp, poll string"


def poll_folder(spark: SparkSession, folder: str, seen: str, extensions: list[str] = EXTENSIONS, settle_s: float = 3.0, first: bool = False) -> DataFrame:
    """New files of a folder whose last change is ``settle_s`` old, and a note of them in the table ``seen``; what is younger waits for the next poll.

    With ``first`` all files count as seen: what was there before the watch is not new. Two listings are joined, contents are not read; new
    files are written to ``seen`` once, under this poll's name, and read back from it. A poll adds one file, or none if nothing is new.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(seen)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    fresh = list_files(spark, folder, extensions)
    if there:
        fresh = fresh.join(spark.read.schema(SEEN).parquet(seen).select("path"), "path", "left_anti")
    if not first:
        fresh = fresh.filter(F.col("modificationTime") <= F.current_timestamp() - F.expr(f"INTERVAL {float(settle_s)} SECONDS"))
    poll = uuid.uuid4().hex
    if not there or not fresh.isEmpty():
        fresh.select("path", "length", "modificationTime", F.lit(poll).alias("poll")).repartition(1).write.mode("append").parquet(seen)
    return spark.read.schema(SEEN).parquet(seen).filter(F.lit(not first) & (F.col("poll") == poll)).drop("poll")
