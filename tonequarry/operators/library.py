"""Consistency of a whole library: formats, duplicates, loudness; and the comparison of two scans.

Every function takes file rows and gives one table. Groups can be large (a hash that a third of the
files share, one category that holds most of them): sums and counts are combined before the
shuffle, a first row of a group is found by an aggregate, and only reports that list a group's
paths gather them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.functions.stats import median_mad
from tonequarry.functions.text import base_name, canonical_name, category, parent
from tonequarry.operators.rules import SEVERITIES, Thresholds, severity_rank

#: Differences that count between two scans.
COMPARE_TOLERANCE = {"duration_s": 0.01, "peak_dbfs": 0.5, "lufs": 0.5, "true_peak_dbtp": 0.5}
FORMAT = ["sample_rate", "bit_depth", "channels"]


def usable(files: DataFrame) -> DataFrame:
    """Files that were decoded and hold samples; silent ones stay."""
    return files.filter("error is null and frames > 0")


def formats(files: DataFrame) -> DataFrame:
    """Files by format; ``first_path`` breaks ties of the count."""
    return files.groupBy(*FORMAT).agg(F.count("*").alias("n_files"), F.min("path").alias("first_path"))


def dominant(df: DataFrame, value: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """The most frequent ``value`` (by ``keys``), of equals the one met first by ``order``."""
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    # max_by with a struct prefers large orders; the first is found by ranking the few distinct values
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), "_first") if keys else Window.orderBy(F.desc("_n"), "_first")
    return counts.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").select(*keys, F.col(value).alias(f"dominant_{value}"))


def format_outliers(files: DataFrame) -> DataFrame:
    """Files whose sample rate isn't the dominant one, if there is more than one format; a higher rate is worse."""
    main = dominant(files, "sample_rate", "path")
    several = files.select(*FORMAT).distinct().limit(2).agg((F.count("*") > 1).alias("several"))
    joined = files.select("path", "sample_rate").crossJoin(F.broadcast(main)).crossJoin(F.broadcast(several))  # one row each
    return joined.filter("several and sample_rate <> dominant_sample_rate").select(
        "path", "sample_rate", "dominant_sample_rate", F.when(F.col("sample_rate") > F.col("dominant_sample_rate"), "WARN").otherwise("INFO").alias("severity")
    )


def duplicate_groups(files: DataFrame) -> DataFrame:
    """Groups of files of one hash: by file, then by content where those are not the same files.

    A content group is told apart from a file group by its size and the sum of its paths' hashes, so no list of
    paths is compared. Columns: by, hash, n_files, keeper, one_name, one_dir, one_canonical, kind, severity, recoverable_bytes.
    """
    rows = files.withColumns({"_name": base_name(F.col("path")), "_dir": parent(F.col("path")), "_canon": canonical_name(F.col("path"))})
    both = rows.select(F.explode(F.array(F.struct(F.lit("file").alias("by"), F.col("file_sha256").alias("hash")), F.struct(F.lit("content").alias("by"), F.nullif(F.col("content_sha256"), F.lit("")).alias("hash")))).alias("g"), "path", "size_bytes", "_name", "_dir", "_canon").select("g.*", "path", "size_bytes", "_name", "_dir", "_canon").filter("hash is not null")
    groups = both.groupBy("by", "hash").agg(
        F.count("*").alias("n_files"),
        F.min("path").alias("keeper"),
        F.min_by("size_bytes", "path").alias("_keeper_size"),
        F.sum("size_bytes").alias("_size"),
        (F.min("_name") == F.max("_name")).alias("one_name"),
        (F.min("_dir") == F.max("_dir")).alias("one_dir"),
        (F.min("_canon") == F.max("_canon")).alias("one_canonical"),
        F.sum(F.xxhash64("path").cast("decimal(38,0)")).alias("_paths"),
    ).filter("n_files > 1")
    exact = groups.filter("by = 'file'").select("keeper", "n_files", "_paths")
    groups = groups.filter("by = 'file'").unionByName(groups.filter("by = 'content'").join(exact, ["keeper", "n_files", "_paths"], "left_anti").select(groups.columns))
    kind = F.when(F.col("one_name") & ~F.col("one_dir"), "redundant_copy").when(F.col("one_canonical"), "equivalent_naming").otherwise("duplicate_asset")
    groups = groups.withColumn("kind", kind)
    return groups.withColumn("severity", F.when(F.col("kind") == "equivalent_naming", "INFO").otherwise("WARN")).withColumn(
        "recoverable_bytes", F.when(F.col("kind") == "redundant_copy", F.col("_size") - F.col("_keeper_size")).otherwise(F.lit(0))
    ).drop("_size", "_keeper_size", "_paths")


def duplicate_findings(files: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each file of a group but its keeper: path, check, severity, duplicate_of, identical_bytes."""
    parts = []
    for by, col in (("file", "file_sha256"), ("content", "content_sha256")):
        own = groups.filter(F.col("by") == by).select(F.col("hash").alias(col), "keeper", "kind", "severity")
        parts.append(files.join(own, col).filter("path <> keeper").select("path", F.col("kind").alias("check"), "severity", F.col("keeper").alias("duplicate_of"), F.lit(by == "file").alias("identical_bytes")))
    return parts[0].union(parts[1])


def loudness_groups(files: DataFrame, cfg: Thresholds = Thresholds(), by: Column | None = None) -> DataFrame:
    """category, n_files, evaluated, basis, mad and tolerance of the files above the gate; one category with a given target."""
    loud = files.filter(F.col("lufs") > cfg.lufs_gate_floor)
    if cfg.lufs_target is not None:
        return loud.agg(F.count("*").alias("n_files")).filter("n_files > 0").select(
            F.lit("__all__").alias("category"), "n_files", F.lit(True).alias("evaluated"), F.lit(float(cfg.lufs_target)).alias("basis"), F.lit(None).cast("double").alias("mad"), F.lit(cfg.lufs_tolerance).alias("tolerance")
        )
    loud = loud.withColumn("category", category(F.col("path")) if by is None else by)
    g = median_mad(loud, ["category"], "lufs").withColumn("evaluated", F.col("n") >= cfg.lufs_min_group)
    only = lambda c: F.when(F.col("evaluated"), c)
    return g.select("category", F.col("n").alias("n_files"), "evaluated", only(F.col("median")).alias("basis"), only(F.col("mad")).alias("mad"), only(F.greatest(F.lit(cfg.lufs_tolerance), cfg.lufs_spread_k * F.col("mad"))).alias("tolerance"))


def loudness_outliers(files: DataFrame, groups: DataFrame, cfg: Thresholds = Thresholds(), by: Column | None = None) -> DataFrame:
    """Files further from their category's basis than its tolerance. ``groups`` has a row per category: small by its rules."""
    name = F.lit("__all__") if cfg.lufs_target is not None else category(F.col("path")) if by is None else by
    loud = files.filter(F.col("lufs") > cfg.lufs_gate_floor).select("path", "lufs", name.alias("category"))
    return loud.join(groups.filter("evaluated"), "category").withColumn("delta", F.col("lufs") - F.col("basis")).filter("abs(delta) > tolerance").select("path", "category", "lufs", "delta")


def loudness_hits(groups: DataFrame, outliers: DataFrame) -> DataFrame:
    """``groups`` with hits: the outliers of each category, zero included."""
    n = outliers.groupBy("category").agg(F.count("*").alias("hits"))
    return groups.join(n, "category", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))


def duplicates_in_order(groups: DataFrame) -> DataFrame:
    """Duplicate groups, the worst first, then by the file that is kept (null last); sorted by range."""
    return groups.orderBy(severity_order(F.col("severity")).asc_nulls_last(), F.col("keeper").asc_nulls_last())


def results_in_order(files: DataFrame) -> DataFrame:
    """Files by path (null last), sorted by range."""
    return files.orderBy(F.col("path").asc_nulls_last())


def audio_else_video(files: DataFrame, is_audio: Column) -> DataFrame:
    """Of each folder the audio files, or all of them where it has none: one small aggregate by folder, joined back."""
    f = files.withColumn("_folder", parent(F.col("path"))).withColumn("_audio", is_audio)
    some = f.groupBy("_folder").agg(F.bool_or("_audio").alias("_some"))
    return f.join(some, "_folder").filter("_audio or not _some").select(files.columns)


def below_gate(files: DataFrame, cfg: Thresholds = Thresholds()) -> DataFrame:
    return files.filter(F.col("lufs") <= cfg.lufs_gate_floor).select("path", "lufs")


# --- two scans ---------------------------------------------------------------


def compare(before: DataFrame, after: DataFrame, tolerance: dict[str, float] = COMPARE_TOLERANCE) -> DataFrame:
    """A row for each path that was added, removed or changed: path, change, severity, deltas, notes, new_fails.

    Both have path, content_sha256, the format's columns, the metrics of ``tolerance`` and ``fails`` (array of failed checks).
    Equal contents are no change. One equi-join on the path.
    """
    metrics = list(tolerance)
    cols = ["content_sha256", *FORMAT, *metrics, "fails"]
    b = before.select("path", F.struct(*cols).alias("b"))
    a = after.select("path", F.struct(*cols).alias("a"))
    j = b.join(a, "path", "full_outer")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    same = F.coalesce((F.col("b.content_sha256") != "") & (F.col("b.content_sha256") == F.col("a.content_sha256")), F.lit(False))
    j = j.filter(~(both & same))
    notes = F.array_compact(F.array(*[F.when(both & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in FORMAT]))
    moved = lambda m: F.col(f"a.{m}") - F.col(f"b.{m}")
    deltas = F.array_compact(F.array(*[F.when(both & (F.abs(moved(m)) > tol), F.struct(F.lit(m).alias("metric"), F.col(f"b.{m}").cast("double").alias("before"), F.col(f"a.{m}").cast("double").alias("after"), moved(m).cast("double").alias("delta"))) for m, tol in tolerance.items()]))
    fails = F.when(both, F.array_sort(F.array_except("a.fails", "b.fails"))).otherwise(F.array().cast("array<string>"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    out = j.select("path", change.alias("change"), deltas.alias("deltas"), notes.alias("notes"), fails.alias("new_fails"))
    worse = (F.size("deltas") > 0) | (F.size("notes") > 0) | (F.size("new_fails") > 0)
    return out.withColumn("severity", F.when(F.col("change") == "changed", F.when(worse, "FAIL").otherwise("INFO")))


def compare_summary(diff: DataFrame) -> DataFrame:
    is_ = lambda c: F.count_if(F.col("change") == c)
    return diff.agg(is_("added").alias("added"), is_("removed").alias("removed"), is_("changed").alias("changed"), F.count_if(F.coalesce(F.col("severity") == "FAIL", F.lit(False))).alias("regressions"))


def counter_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after and delta (where both are numbers) over a full join; values are text."""
    j = before.select(key, F.col(value).cast("string").alias("before")).join(after.select(key, F.col(value).cast("string").alias("after")), key, "full_outer")
    return j.withColumn("delta", F.col("after").try_cast("double") - F.col("before").try_cast("double"))


def same_rows(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """One row: whether both hold the same values by key, and how many keys differ."""
    j = before.select(key, F.col(value).alias("_b"), F.lit(True).alias("_in_b")).join(after.select(key, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), key, "full_outer")
    differs = ~F.col("_a").eqNullSafe(F.col("_b")) | F.col("_in_a").isNull() | F.col("_in_b").isNull()
    return j.agg(F.count_if(differs).alias("n_differing")).withColumn("identical", F.col("n_differing") == 0)


def merge_edits(fresh: DataFrame, edited: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``fresh`` rows with their empty cells filled from ``edited`` by key: what people wrote is kept, nothing is overwritten."""
    old = edited.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    j = fresh.join(old, keys, "left")
    return j.select(*[F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in fresh.columns])


def one_per_stem(files: DataFrame, stem_col: Column, is_audio: Column) -> DataFrame:
    """One file of each stem: video before audio, then by path. An aggregate, so a stem's files are not gathered."""
    return files.groupBy(stem_col.alias("stem")).agg(F.min(F.struct(is_audio.alias("is_audio"), F.col("path").alias("path"))).alias("m")).select("stem", "m.path", "m.is_audio")


def endpoint_changes(snapshots: DataFrame, before: str, after: str) -> DataFrame:
    """gone and back: what either array column lacks of the other, in order."""
    return snapshots.withColumn("gone", F.array_except(before, after)).withColumn("back", F.array_except(after, before))


def severity_order(severity: Column) -> Column:
    """For sorts: the worst first."""
    return -severity_rank(severity)


__all__ = [n for n in dir() if not n.startswith("_")] + ["SEVERITIES"]
