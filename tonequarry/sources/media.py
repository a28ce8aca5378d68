"""Sources: files and their samples, measured logs, subtitle tables, transcripts, scan reports.

Readers name their schema; nothing is inferred. What can't be read becomes an error in its row, the
scan goes on. Decoding of formats other than PCM in WAV is left to a function that the caller gives.
"""

from __future__ import annotations

import csv
import hashlib
import io
import math
import struct
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.functions.text import base_name, suffix

#: Fixed values.
EXTENSIONS = [".wav", ".ogg", ".mp3", ".flac", ".aif", ".aiff", ".m4a", ".mka"]
VIDEO = [".mkv", ".mp4", ".mov"]
WORK_COPIES = ["句_", "语音片段_", "字幕截图_"]
SUBTITLE_COLUMNS = ["句号", "语音起", "语音止", "字幕出现", "字幕消失", "字幕原文", "备注"]
MOMENTARY = r"t:\s*([\d.]+)\s+.*?M:\s*(-?[\d.]+)"
SILENCE = r"silence_(start|end):\s*(-?[\d.]+)"

AUDIO = "path string, size_bytes long, file_sha256 string, content_sha256 string, decoded_via string, sample_rate int, bit_depth int, channels int, full_scale long, lsb long, frames long, chans array<array<long>>, error string"


def list_files(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS) -> DataFrame:
    """path, length and modificationTime of the files under a folder; contents are not read. Spark leaves out files of no bytes."""
    wanted = [e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.filter(suffix(F.col("path")).isin(wanted)).select("path", "length", "modificationTime")


def drop_work_copies(files: DataFrame) -> DataFrame:
    name = base_name(F.col("path"))
    keep = F.lit(True)
    for p in WORK_COPIES:
        keep = keep & ~F.startswith(name, F.lit(p))
    return files.filter(keep)


def pcm_samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Samples (frames x channels): unsigned bytes are centred, 24 bits stand in the upper bytes of 32. A cut-off frame at the end goes."""
    raw = raw[: len(raw) // (width * channels) * (width * channels)]
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    elif width == 3:
        three = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        four = np.zeros((len(three), 4), np.uint8)
        four[:, 1:] = three
        x = four.view("<i4").reshape(-1).astype(np.int64)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.int64)
    return x.reshape(-1, channels)


def wav_header(src) -> tuple[int, int, int, int, int]:
    """(rate, channels, bytes to a sample, where the PCM bytes begin, how many are said to follow) of a RIFF file that can be sought in."""
    head = src.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    fmt = None
    while len(h := src.read(8)) == 8:
        name, size = h[:4], struct.unpack("<I", h[4:])[0]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", src.read(size)[:16])
        elif name == b"data":
            if fmt is None or fmt[0] not in (1, 0xFFFE) or fmt[5] not in (8, 16, 24, 32) or not fmt[1]:
                raise ValueError("no PCM format")
            return fmt[2], fmt[1], fmt[5] // 8, src.tell(), size
        else:
            src.seek(size, 1)
        if size % 2:
            src.seek(1, 1)
    raise ValueError("no data")


def parse_wav(content: bytes) -> tuple[int, int, int, bytes]:
    """(rate, channels, bytes to a sample, PCM bytes) of a RIFF file; data cut short is taken as far as it goes."""
    rate, channels, width, at, size = wav_header(io.BytesIO(content))
    return rate, channels, width, content[at : at + size]


#: By bytes to a sample: full scale and the step between neighbouring values.
SCALES = {1: (128, 1), 2: (1 << 15, 1), 3: (1 << 31, 256), 4: (1 << 31, 1)}
CHUNKS = "path string, size_bytes long, file_sha256 string, content_sha256 string, sample_rate int, bit_depth int, channels int, full_scale long, lsb long, frames long, error string, chunk long, first_frame long, lead long"


def _open(path: str):
    store, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_file(name)


def _hashes(src, at: int, size: int) -> tuple[str, str]:
    """SHA-256 of a file and of its PCM bytes, read once in blocks."""
    whole, own, place = hashlib.sha256(), hashlib.sha256(), 0
    src.seek(0)
    while block := src.read(1 << 22):
        whole.update(block)
        own.update(block[max(0, at - place) : max(0, at + size - place)])
        place += len(block)
    return whole.hexdigest(), own.hexdigest()


def plan_chunks(files: DataFrame, frames: int, lead: int = 0) -> DataFrame:
    """A row (``CHUNKS``, byte_at, n_bytes) for each stretch of so many frames of the WAV ``files`` (path), with up to ``lead`` frames before it. Headers and hashes are read where
    the task runs, a block at a time; a file that can't be read is one row with its error."""

    def run(batches):
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split()[1]]) for c in f"{CHUNKS}, byte_at long, n_bytes long".split(", ")])
        for batch in batches:
            for path in batch["path"].to_pylist():
                row, rows = {"path": path, "file_sha256": "", "content_sha256": "", "frames": 0, "chunk": 0, "first_frame": 0, "lead": 0, "byte_at": 0, "n_bytes": 0}, []
                try:
                    with _open(path) as src:
                        row["size_bytes"] = src.size()
                        rate, channels, width, at, size = wav_header(src)
                        size = min(size, src.size() - at)
                        step, whole = width * channels, size // (width * channels)
                        full, lsb = SCALES[width]
                        row["file_sha256"], row["content_sha256"] = _hashes(src, at, size)
                    row |= {"sample_rate": rate, "bit_depth": 8 * width, "channels": channels, "full_scale": full, "lsb": lsb, "frames": whole}
                    for k, first in enumerate(range(0, max(whole, 1), frames)):
                        more = min(lead, first)
                        rows.append(row | {"chunk": k, "first_frame": first, "lead": more, "byte_at": at + (first - more) * step, "n_bytes": (more + min(frames, whole - first)) * step})
                except Exception as e:  # noqa: BLE001  one file's fault is its row's error
                    rows = [row | {"error": str(e) or type(e).__name__}]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema=schema)

    return files.select("path").mapInArrow(run, f"{CHUNKS}, byte_at long, n_bytes long")


def read_audio_chunks(spark: SparkSession, root: str, frames: int = 1 << 20, extensions: list[str] = EXTENSIONS, lead: int = 0) -> DataFrame:
    """WAV files of any length as rows (``CHUNKS``, chans) of at most ``frames`` frames, for ``operators.chunks``; with ``lead``, for ``operators.loudness``, samples
    before a chunk's own come first. Every task reads its own
    stretches; no row or task holds a whole recording."""
    plan = plan_chunks(list_files(spark, root, extensions), frames, lead).repartition("path", "chunk")

    def run(batches):
        kept = [c.split()[0] for c in CHUNKS.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                path, at, n, channels, bits = (one[c][0].as_py() for c in ("path", "byte_at", "n_bytes", "channels", "bit_depth"))
                x = np.zeros((0, channels or 0), np.int64)
                if n:
                    with _open(path) as src:
                        src.seek(at)
                        x = pcm_samples(src.read(n), bits // 8, channels)
                yield pa.record_batch([*(one[c] for c in kept), _channels(x)], names=[*kept, "chans"])

    return plan.mapInArrow(run, f"{CHUNKS}, chans array<array<long>>")


def _channels(x: np.ndarray) -> pa.Array:
    """One row's samples by channel, as they lie in memory."""
    ends = pa.array(np.arange(x.shape[1] + 1) * len(x), pa.int32())
    return pa.ListArray.from_arrays(pa.array([0, x.shape[1]], pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(x.T).ravel())))


def read_audio(spark: SparkSession, root: str, extensions: list[str] = EXTENSIONS, decoder: Callable[[bytes], tuple] | None = None) -> DataFrame:
    """A row (``AUDIO``) per file with its samples by channel. ``decoder`` gives (rate, channels, bytes to a sample, PCM) of other formats."""
    wanted = [e.lower() for e in extensions]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).filter(suffix(F.col("path")).isin(wanted)).select("path", "content")

    def run(batches):
        number = pa.int64()
        kinds = {"string": pa.string(), "int": pa.int32(), "long": number, "array<array<long>>": pa.list_(pa.list_(number))}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in AUDIO.split(", ")])
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                row = {"path": path, "size_bytes": len(content), "file_sha256": hashlib.sha256(content).hexdigest(), "content_sha256": "", "frames": 0, "error": None}
                samples = np.zeros((0, 0), np.int64)
                try:
                    via = "wave"
                    try:
                        rate, channels, width, pcm = parse_wav(content)
                    except ValueError:
                        if decoder is None:
                            raise
                        via, (rate, channels, width, pcm) = "external", decoder(content)
                    x = pcm_samples(pcm, width, channels)
                    full, lsb = SCALES[width]
                    row |= {"content_sha256": hashlib.sha256(pcm).hexdigest(), "decoded_via": via, "sample_rate": rate, "bit_depth": 8 * width, "channels": channels, "full_scale": full, "lsb": lsb, "frames": len(x)}
                    samples = x
                except Exception as e:  # noqa: BLE001  one file's fault is its row's error
                    row["error"] = str(e) or type(e).__name__
                # a file at a time: samples take many times a file's size
                chans = _channels(samples)
                yield pa.record_batch([chans if f.name == "chans" else pa.array([row.get(f.name)], f.type) for f in schema], schema=schema)

    return files.mapInArrow(run, AUDIO)


def momentary(logs: DataFrame, clip: str = "clip", line: str = "value") -> DataFrame:
    """clip, t and m of every momentary-loudness sample in log lines."""
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(MOMENTARY), F.lit(1)).alias("t"), F.regexp_extract_all(line, F.lit(MOMENTARY), F.lit(2)).alias("m"))
    return logs.select(clip, F.explode(pairs).alias("s")).select(clip, F.col("s")["t"].cast("double").alias("t"), F.col("s")["m"].cast("double").alias("m"))


def silences(logs: DataFrame, durations: DataFrame, clip: str = "clip", order: str = "line", line: str = "value") -> DataFrame:
    """Silent intervals from start and end lines in order: a start below 0 counts as 0, one with no end lasts to the clip's end."""
    e = logs.withColumn("_k", F.regexp_extract(line, SILENCE, 1)).filter("_k <> ''").withColumn("_t", F.regexp_extract(line, SILENCE, 2).cast("double"))
    w = Window.partitionBy(clip).orderBy(order)
    s = e.withColumn("_nk", F.lead("_k").over(w)).withColumn("_nt", F.lead("_t").over(w)).filter("_k = 'start'")
    return s.join(durations, clip).select(clip, F.greatest(F.lit(0.0), F.col("_t")).alias("start"), F.when(F.col("_nk") == "end", F.col("_nt")).otherwise(F.col("duration")).alias("end"))


def last_match(text, pattern: str):
    """The last match of a pattern's group as a number; null for none or a value that isn't finite."""
    v = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))), -1).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


SUBTITLES = "line int, idx string, speech_start double, speech_end double, subtitle_start double, subtitle_end double, subtitle_text string, note string"


def subtitle_rows(text: str, sep: str) -> list[tuple]:
    """The rows of one subtitle table: quoted cells may hold separators and line breaks, cells beyond the seventh are passed over, blank
    records go, a record without a key is named by its number. A blank or non-finite time is null; one that is no number, a short record,
    another header and a table without records are errors."""
    records = list(csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""), delimiter=sep))
    if not records or [c.strip() for c in records[0]][:7] != SUBTITLE_COLUMNS:
        raise ValueError(f"the header isn't the expected one: {', '.join(SUBTITLE_COLUMNS)}")
    rows = []
    for n, cells in enumerate(records[1:], 1):
        if not "".join(cells).strip():
            continue
        if len(cells) < 7:
            raise ValueError(f"record {n + 1} has {len(cells)} cells, not seven")
        cells = [c.strip() for c in cells]
        times = [float(c) if c else None for c in cells[1:5]]
        rows.append((n, cells[0] or f"L{n + 1}", *(t if t is not None and math.isfinite(t) else None for t in times), cells[5], cells[6]))
    if not rows:
        raise ValueError("no records")
    return rows


def read_subtitles(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Subtitle tables (``SUBTITLES``) under a fixed header of seven columns, separated by tabs if the name ends so (.tsv, .tab), else by commas.
    See ``subtitle_rows`` for what is an error; it names the file. Spark passes over a file of no bytes."""
    raw = spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("_path"))

    def run(batches):
        for pdf in batches:
            for text, name in zip(pdf["value"], pdf["_path"], strict=True):
                try:
                    rows = subtitle_rows(text, sep or ("\t" if name.lower().endswith((".tsv", ".tab")) else ","))
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUBTITLES.split(", ")])

    return raw.mapInPandas(run, SUBTITLES)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Transcript segments (start, end, text), of ``{"segments": [...]}`` or a bare array. Errors: text that is no JSON or cut off, no array of segments, a
    segment without a number as start or end, and one that ends before it starts. Texts are trimmed. Spark passes over a file of no bytes."""
    text = spark.read.text(path, wholetext=True)
    one = "struct<start:string,end:string,text:string>"
    wrong = lambda what: F.raise_error(F.lit(what))
    parsed = lambda schema: F.from_json("value", schema, {"mode": "FAILFAST"})
    items = F.when(F.startswith(F.ltrim("value"), F.lit("[")), parsed(f"array<{one}>")).otherwise(parsed(f"segments array<{one}>")["segments"])
    items = F.coalesce(items, wrong("the transcript has no array of segments").cast(f"array<{one}>"))
    rows = text.select(F.explode(items).alias("s"))
    time = lambda c: F.coalesce(F.col("s")[c].try_cast("double"), wrong(f"a segment has no {c}").cast("double"))
    rows = rows.select(time("start").alias("start"), time("end").alias("end"), F.regexp_replace(F.coalesce(F.col("s.text"), F.lit("")), r"(?U)^\s+|\s+$", "").alias("text"))
    return rows.withColumn("end", F.when(F.col("end") < F.col("start"), wrong("a segment ends before it starts").cast("double")).otherwise(F.col("end")))


REPORT = "files array<struct<path:string,status:string,findings:array<struct<check:string,severity:string,detail:map<string,string>>>>>"


def read_report(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """A row per file of scan reports in JSON. One that can't be read is an error; ``tolerant``: it has no files."""
    return spark.read.schema(REPORT).option("multiLine", True).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path).select(F.inline("files"))


def write_report(judged: DataFrame, path: str) -> None:
    """The judged files as JSON lines, one file a line, in parts."""
    judged.select("path", "status", "findings").write.mode("overwrite").json(path)


def owners(texts: DataFrame, owner: str, prop: str, key: str = "path", text: str = "value") -> DataFrame:
    """Matches of ``prop`` (one group: the value) in each whole text, each with the last match of ``owner`` (one group) before it."""

    def run(batches):
        import re

        po, pp = re.compile(owner), re.compile(prop)
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                marks = [(m.start(), 0, m[1]) for m in po.finditer(t or "")] + [(m.start(), 1, m[1]) for m in pp.finditer(t or "")]
                last = None
                for at, kind, value in sorted(marks):
                    if kind:
                        rows.append((k, at, value, last))
                    else:
                        last = value
            yield pd.DataFrame(rows, columns=["path", "offset", "value", "owner"])

    return texts.select(key, text).mapInPandas(run, "path string, offset long, value string, owner string")
