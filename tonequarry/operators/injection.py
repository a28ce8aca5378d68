"""Properties in project files: values in both spellings with the object that owns them, fault targets and what was changed.

Each file is one row of text. Object tags and property elements are matched by one pattern in the JVM, in
their order; a property's owner is the last object tag before it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The objects that own properties.
OBJECTS = ["Sound", "RandomSequenceContainer", "SwitchContainer", "BlendContainer", "ActorMixer", "MusicSegment", "MusicTrack", "MusicSwitchContainer", "MusicPlaylistContainer", "Attenuation"]


def properties(texts: DataFrame, prop: str, key: str = "path", text: str = "value") -> DataFrame:
    """path, ord, owner_type, owner_name and value of each ``prop`` in a file: an attribute of an empty element, or the first Value in its body; '' for none."""
    object_tag = rf'<(?:{"|".join(OBJECTS)})\s+Name="[^"]*"'
    element = rf'<Property\s+Name="{re.escape(prop)}"[^>]*?(?:\s*/>|\s*>.*?</Property>)'
    found = F.regexp_extract_all(text, F.lit(rf"(?s)({object_tag}|{element})"), F.lit(1))
    rows = texts.select(F.col(key).alias("path"), F.posexplode(found).alias("ord", "_m"))
    is_object = ~F.startswith("_m", F.lit("<Property"))
    owner = lambda group: F.last(F.when(is_object, F.regexp_extract("_m", r'<(\w+)\s+Name="([^"]*)"', group)), True).over(Window.partitionBy("path").orderBy("ord"))
    wrapped = F.rlike("_m", F.lit(r"</Property>$"))
    value = F.when(wrapped, F.trim(F.regexp_extract("_m", r"(?s)<Value>\s*(.*?)\s*</Value>", 1))).otherwise(F.regexp_extract("_m", r'\sValue="([^"]*)"', 1))
    rows = rows.withColumn("owner_type", F.coalesce(owner(1), F.lit(""))).withColumn("owner_name", F.coalesce(owner(2), F.lit("")))
    return rows.filter(~is_object).select("path", "ord", "owner_type", "owner_name", value.alias("value"))


def with_targets(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits with is_target: whether ``targets`` (owner_name) has their owner."""
    named = targets.select("owner_name", F.lit(True).alias("_t")).distinct()
    return hits.join(named, "owner_name", "left").withColumn("is_target", F.coalesce("_t", F.lit(False))).drop("_t")


def target_counts(hits: DataFrame, keys: list[str]) -> DataFrame:
    """By key hits in all, targets, and controls: the hits that keep their value."""
    return hits.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("is_target").alias("targets"), F.count_if(~F.col("is_target")).alias("controls"))


def injected_files(changes: DataFrame, fault: str = "fault", file: str = "file") -> DataFrame:
    """Each file that a fault changed, once, with its changes; in order."""
    return changes.groupBy(fault, file).agg(F.count("*").alias("changes")).orderBy(fault, file)


def injection_summary(changes: DataFrame, fault: str = "fault", file: str = "file") -> DataFrame:
    """By fault its changes and how many files they are in."""
    files = changes.groupBy(fault, file).agg(F.count("*").alias("_n"))
    return files.groupBy(fault).agg(F.sum("_n").alias("changes"), F.count("*").alias("files"))
