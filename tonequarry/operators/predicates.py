"""Choices of rows and names: conventions, case ids, lengths, markers, look-ups that must be unique, archive paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def off_convention(files: DataFrame, name: Column, pattern: str) -> DataFrame:
    """Files whose name doesn't match the whole pattern, whatever its case; a null name is off as well."""
    return files.filter(~F.coalesce(name.rlike(f"(?i)^(?:{pattern})$"), F.lit(False)))


def case_id(explicit: Column, name: Column, pattern: str, folder: Column) -> Column:
    """The id given, else the pattern's first group in the name, else the folder; empty ids count as none."""
    given = lambda c: F.when(c != "", c)
    return F.coalesce(given(explicit), given(F.regexp_extract(name, pattern, 1)), folder)


def voice_candidates(files: DataFrame, duration: str = "duration_s", least: float = 0.8, most: float = 12.0) -> DataFrame:
    """Files long enough and short enough for a voice line, both ends included."""
    return files.filter(F.col(duration).between(least, most))


def select_steps(steps: DataFrame, skipped: list[str], kind: str = "kind") -> DataFrame:
    """Steps but those of the kinds switched off; a step without a kind stays."""
    return steps.filter(~F.coalesce(F.col(kind).isin(skipped), F.lit(False)))


def has_marker(name: Column, markers: list[str]) -> Column:
    """Whether any marker stands in the name, whatever its case."""
    low = F.lower(F.coalesce(name, F.lit("")))
    return F.exists(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(low, m))


def look_up(items: DataFrame, keys: list[str], name: str, fragment: Column) -> DataFrame:
    """By key how many names hold the fragment, whatever its case (n_hits), and the name if it is the only one."""
    hit = F.coalesce(F.contains(F.lower(F.col(name)), F.lower(fragment)), F.lit(False))
    g = items.groupBy(*keys).agg(F.count_if(hit).alias("n_hits"), F.min(F.when(hit, F.col(name))).alias(name))
    return g.withColumn(name, F.when(F.col("n_hits") == 1, F.col(name)))


def the_one(items: DataFrame, keys: list[str], name: str, fragment: Column) -> DataFrame:
    """By key the only name that holds the fragment; the query fails where several do. Keys without a hit have none."""
    ambiguous = F.raise_error(F.format_string("%d names match", "n_hits")).cast("string")
    hits = look_up(items, keys, name, fragment).filter("n_hits > 0")
    return hits.select(*keys, F.when(F.col("n_hits") == 1, F.col(name)).otherwise(ambiguous).alias(name))


def first_item(items: DataFrame, keys: list[str], wanted: Column, order: str) -> DataFrame:
    """By key the first row, in order, that is wanted."""
    ranked = items.filter(wanted).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.filter("_r = 1").drop("_r")


def clip_name(case: Column, scene: Column, take: Column, suffix: Column) -> Column:
    """raw_<case>_<scene>_r<take><suffix>, the take with two digits at least."""
    return F.concat(F.lit("raw_"), case, F.lit("_"), scene, F.lit("_r"), F.format_string("%02d", take.cast("long")), suffix)


def archive_path(case: Column, folders: dict[str, str], other: str, name: Column) -> Column:
    """The folder of a case by its id's prefix (the longest that fits), then the name."""
    folder = F.lit(other)
    for prefix, path in sorted(folders.items(), key=lambda x: len(x[0])):
        folder = F.when(case.startswith(prefix), F.lit(path)).otherwise(folder)
    return F.concat(folder, F.lit("/"), name)


def truncation_note(listed: Column, total: Column) -> Column:
    """A note where fewer are listed than there are, else null."""
    return F.when(listed < total, F.concat(F.lit("listed "), listed.cast("string"), F.lit(" of "), total.cast("string")))


def covers_screen(width: Column, height: Column, screen_width: Column, screen_height: Column, tolerance: int = 2) -> Column:
    """Whether a window fills its screen but for a few pixels."""
    return (F.abs(width - screen_width) <= tolerance) & (F.abs(height - screen_height) <= tolerance)
