"""The rule set: measured signals in, graded findings out, in one projection without a shuffle.

Findings are evidence: a rule says what was measured against which limit. Severities are ordered
PASS < INFO < WARN < FAIL. ``measure`` and ``judge`` keep a row per file with an array of
findings; ``summarize`` counts files by their worst.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonequarry.functions.text import is_loop_name, stem
from tonequarry.operators import signals as S

#: Fixed values.
SEVERITIES = ["PASS", "INFO", "WARN", "FAIL"]
#: A finding lists so many runs or gaps; their number stands beside them.
LISTED = 20
FINDING = "struct<check:string,severity:string,detail:map<string,string>>"


@dataclass(frozen=True)
class Thresholds:
    """The limits that the rules start from."""

    clip_min_run: int = 3
    dc_offset_max: float = 0.01
    silence_floor_dbfs: float = -60.0
    head_silence_max_ms: float = 100.0
    tail_silence_max_ms: float = 500.0
    oneshot_max_duration_s: float = 8.0
    loop_step_ratio_max: float = 3.0
    loop_step_floor: float = 0.01
    loop_onset_max: float = 0.05
    true_peak_max_dbtp: float | None = None
    true_peak_overshoot_dbtp: float = 0.0
    true_peak_headroom_dbtp: float = -1.0
    lufs_target: float | None = None
    lufs_tolerance: float = 2.0
    lufs_min_group: int = 5
    lufs_spread_k: float = 3.0
    lufs_gate_floor: float = -69.0
    lufs_min_duration_s: float = 0.4
    silence_window_ms: float = 10.0
    dropout_min_ms: float = 0.0


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def worst(findings: Column) -> Column:
    """The worst severity of an array of findings; PASS without any."""
    top = F.array_max(F.transform(findings, lambda f: severity_rank(f["severity"])))
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (F.coalesce(top, F.lit(0)) + 1).cast("int"))


def measure(files: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """Add the measurements to signal rows (path, sample_rate, full_scale, lsb, chans); frames is the shortest channel's length."""
    fs, rate = F.col("full_scale").cast("double"), F.col("sample_rate")
    floor = fs * F.lit(10.0 ** (cfg.silence_floor_dbfs / 20.0))
    window = F.greatest(F.lit(1), F.floor(rate * cfg.silence_window_ms / 1000.0)).cast("int")
    ms = lambda frames: frames / rate * 1000.0
    per = lambda f: F.transform("chans", f)
    out = files.withColumns({"frames": F.coalesce(F.array_min(per(F.size)), F.lit(0)), "_floor": floor, "_window": window})
    floor, window = F.col("_floor"), F.col("_window")
    gap_min = F.greatest(F.lit(1), F.floor(rate * cfg.dropout_min_ms / 1000.0)).cast("int")
    clip = per(lambda c: S.full_scale_runs(c, fs, F.col("lsb"), cfg.clip_min_run))
    out = out.withColumns(
        {
            "duration_s": F.col("frames") / rate,
            "_peaks": per(S.channel_peak),
            "dc_offset": F.array_max(per(lambda c: F.abs(S.dc_offset(c, fs)))),
            "_clip": clip,
            "head_silence_ms": ms(F.array_min(per(lambda c: S.head_silence(c, floor, window)))),
            "tail_silence_ms": ms(F.array_min(per(lambda c: S.tail_silence(c, floor, window)))),
            "tail_zero_ms": ms(S.trailing_zeros(F.col("chans"))),
            "gaps": S.silence_gaps(F.col("chans"), floor, window, gap_min) if cfg.dropout_min_ms > 0 else F.array().cast("array<struct<start:int,length:int>>"),
            "loop_step": F.array_max(per(lambda c: S.loop_step(c, fs))),
            "slope_p99": F.array_max(per(lambda c: S.slope_p99(c, fs))),
            "loop_onset": S.loop_onset(F.col("chans"), fs),
            "same_channels": S.equal_channels(F.col("chans")),
        }
    )
    return out.withColumns(
        {
            "peak": F.coalesce(F.array_max("_peaks"), F.lit(0)),
            "peak_dbfs": S.to_dbfs(F.array_max("_peaks"), fs),
            "silent_channels": F.filter(F.transform("_peaks", lambda p, i: F.when(p <= floor, i)), lambda i: i.isNotNull()),
            "clip_runs": F.aggregate("_clip", F.lit(0), lambda a, c: a + F.size(c["runs"])),
            "clip_samples": F.aggregate("_clip", F.lit(0), lambda a, c: a + c["total"]),
            # the first LISTED runs of each channel, of these the first LISTED in time
            "clip_list": F.slice(F.array_sort(F.flatten(F.transform("_clip", lambda c, i: F.transform(F.slice(c["runs"], 1, LISTED), lambda r: F.struct(F.bround(r["start"] / rate, 4).alias("time_s"), i.alias("channel"), r["length"].alias("samples")))))), 1, LISTED),
            "silent": F.coalesce(F.array_max("_peaks"), F.lit(0)) <= floor,
        }
    ).drop("_floor", "_window", "_peaks", "_clip")


def _finding(when: Column, check: str, severity: Column | str, **detail: Column) -> Column:
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    sev = severity if isinstance(severity, Column) else F.lit(severity)
    return F.when(when, F.struct(F.lit(check).alias("check"), sev.alias("severity"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("detail")))


def judge(measured: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    """Add ``findings`` and ``status``. A decoding error, an empty file and a silent file each end the rules for their file.

    Optional columns: error, decoded_via (``external``: clipping is then only told), size_bytes, true_peak_dbtp.
    """
    # recordings measured in chunks have no samples left, but their number
    channels = F.size("chans") if "chans" in measured.columns else F.col("n_channels")
    have = set(measured.columns)
    opt = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    error, external = opt("error", "string"), F.coalesce(opt("decoded_via", "string") == "external", F.lit(False))
    tp, loop = opt("true_peak_dbtp", "double"), is_loop_name(stem(F.col("path")))
    c = F.col
    ratio = F.when(c("slope_p99") > 1e-9, c("loop_step") / c("slope_p99")).otherwise(0.0)
    seam = (c("loop_step") > cfg.loop_step_floor) & (ratio > cfg.loop_step_ratio_max)
    late = c("head_silence_ms") > cfg.head_silence_max_ms
    short = c("duration_s") <= cfg.oneshot_max_duration_s
    padded = c("tail_zero_ms") > cfg.tail_silence_max_ms
    rules = [
        _finding((F.size("silent_channels") > 0) & (F.size("silent_channels") < channels), "channel_silent", "FAIL", channels=F.to_json("silent_channels")),
        _finding((c("clip_runs") > 0) & external, "clip_after_decode", "INFO", runs=c("clip_runs"), samples=c("clip_samples"), first_runs=F.to_json("clip_list")),
        _finding((c("clip_runs") > 0) & ~external, "clipping", "FAIL", runs=c("clip_runs"), samples=c("clip_samples"), first_runs=F.to_json("clip_list")),
        _finding((c("clip_runs") == 0) & (c("clip_samples") > 0) & ~external, "clipping", "WARN", samples=c("clip_samples")),
        _finding(c("dc_offset") > cfg.dc_offset_max, "dc_offset", "FAIL", dc_offset=F.bround("dc_offset", 5)),
        _finding(late & short, "head_silence", "FAIL", head_silence_ms=F.bround("head_silence_ms", 1)),
        _finding(late & ~short, "head_offset", "INFO", head_silence_ms=F.bround("head_silence_ms", 1)),
        _finding(padded, "tail_silence", "WARN", tail_zero_ms=F.bround("tail_zero_ms", 1)),
        _finding(~padded & (c("tail_silence_ms") > cfg.tail_silence_max_ms), "tail_decay", "INFO", tail_below_floor_ms=F.bround("tail_silence_ms", 1)),
        _finding(F.size("gaps") > 0, "silence_gap", "WARN", gap_count=F.size("gaps"), gaps=F.to_json(F.slice("gaps", 1, LISTED))),
        _finding(seam, "loop_discontinuity", F.when(loop, "FAIL").otherwise("INFO"), loop_step=F.bround("loop_step", 4), ratio=F.bround(ratio, 2)),
        _finding(~seam & loop & (c("loop_onset") > cfg.loop_onset_max), "loop_onset", "WARN", onset=F.bround("loop_onset", 4)),
        _finding(c("same_channels"), "fake_stereo", "WARN", redundant_bytes=F.floor(opt("size_bytes", "long") / 2)),
    ]
    if cfg.true_peak_max_dbtp is not None:
        rules.append(_finding(tp > cfg.true_peak_max_dbtp, "true_peak", "FAIL", over_by_db=F.bround(tp - cfg.true_peak_max_dbtp, 2)))
    else:
        rules.append(_finding(tp > cfg.true_peak_overshoot_dbtp, "true_peak_overshoot", "FAIL", true_peak_dbtp=F.bround(tp, 2)))
        rules.append(_finding((tp > cfg.true_peak_headroom_dbtp) & (tp <= cfg.true_peak_overshoot_dbtp), "true_peak_headroom", "INFO", true_peak_dbtp=F.bround(tp, 2)))
    last = lambda check, **d: F.array(_finding(F.lit(True), check, "FAIL", **d))
    findings = (
        F.when(error.isNotNull() & (error != ""), last("decode", error=error))
        .when(F.col("frames") == 0, last("empty"))
        .when(F.col("silent"), last("silent_file", peak_dbfs=F.bround("peak_dbfs", 2)))
        .otherwise(F.array_compact(F.array(*rules)))
    )
    return measured.withColumn("findings", findings).withColumn("status", worst(F.col("findings")))


def findings_of(judged: DataFrame) -> DataFrame:
    """A row per finding: path, check, severity, detail."""
    # an inner generator would be told to skip empty lists first, and its filter would work every rule out once more
    return judged.select("path", F.inline_outer("findings")).filter(F.col("check").isNotNull())


def defects(judged: DataFrame) -> DataFrame:
    """Files whose status is WARN or FAIL, with their WARN and FAIL findings only."""
    bad = lambda s: s.isin("WARN", "FAIL")
    return judged.filter(bad(F.col("status"))).withColumn("findings", F.filter("findings", lambda f: bad(f["severity"])))


def same_severity(judged: DataFrame) -> DataFrame:
    """A row per finding that is as severe as its file's status."""
    return judged.select("path", "status", F.explode("findings").alias("f")).filter("f.severity = status").select("path", "status", "f.check", "f.detail")


def summarize(judged: DataFrame) -> DataFrame:
    """One row: total and files by status."""
    return judged.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in SEVERITIES])
