"""Text helpers: paths, names, normalised text and similarity."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The category of a file by the folders it is in, else by what its path holds; the first rule that holds counts.
DIRECTORY_RULES = [
    ("vo", ["/vo/", "/voice/", "/voices/", "/dialogue/", "/dialog/", "/lines/"]),
    ("bgm", ["/bgm/", "/music/", "/ost/", "/tracks/"]),
    ("ambience", ["/amb/", "/ambience/", "/ambient/", "/atmo/", "/atmosphere/"]),
    ("ui", ["/ui/", "/gui/", "/menu/", "/interface/", "/hud/"]),
    ("footstep", ["/footstep/", "/footsteps/", "/steps/", "/foley/"]),
    ("creature", ["/npc/", "/npcs/", "/monster/", "/monsters/", "/enemy/", "/enemies/", "/creature/", "/creatures/", "/mob/"]),
    ("combat", ["/battle/", "/combat/", "/fight/", "/attack/"]),
    ("weapon", ["/weapon/", "/weapons/", "/gun/", "/guns/"]),
    ("item", ["/inventory/", "/item/", "/items/", "/pickup/", "/pickups/", "/loot/"]),
    ("world", ["/world/", "/env/", "/environment/", "/props/", "/prop/"]),
    ("misc", ["/misc/", "/other/", "/uncategorized/"]),
]
NAME_RULES = [
    ("vo", ["_vo_", "voiceover", "vox_"]),
    ("bgm", ["bgm", "music_", "theme", "_ost"]),
    ("ambience", ["ambience", "ambient", "_amb_", "atmo"]),
    ("ui", ["ui_", "_ui_", "menu_", "interface", "button", "click", "hover"]),
    ("footstep", ["footstep", "step_", "_step_"]),
    ("weapon", ["weapon", "gun_", "rifle", "pistol", "shotgun", "reload", "sword", "melee", "swing"]),
    ("alarm", ["alarm", "siren", "warning"]),
    ("notification", ["notification", "notify", "toast", "chime", "ding", "alert"]),
]
#: Name parts that only annotate music, and note names with their semitones.
MUSIC_NOTES = r"(?i)\d+(?:\.\d+)?bpm\d+-\d+|L\d+M(?:-P\d+[A-Za-z]?)?|P\d+[A-Za-z]?"
NOTE = r"^([A-Ga-g])([#b]{0,2})(-?\d)$"
SEMITONES = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a name whose only dot begins it is kept whole."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix in lower case, with its dot; '' if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"(?<=.)(\.[^.]*)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def is_loop_name(name: Column) -> Column:
    """The word ``loop`` stands in the stem, parted by marks; digits may follow it."""
    return name.rlike(r"(?i)(^|[_\-. ])loop([_\-. 0-9]|$)")


def matches_fully(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})$")


def category(path: Column) -> Column:
    """The category of a path by ``DIRECTORY_RULES``, then ``NAME_RULES``, else ``uncategorized``."""
    whole = F.lower(F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/"))))
    where = F.concat(parent(whole), F.lit("/"))
    chain = F.when(F.lit(False), F.lit(""))
    for text, rules in ((where, DIRECTORY_RULES), (whole, NAME_RULES)):
        for label, marks in rules:
            hit = F.contains(text, F.lit(marks[0]))
            for m in marks[1:]:
                hit = hit | F.contains(text, F.lit(m))
            chain = chain.when(hit, label)
    return chain.otherwise("uncategorized")


def note_number(part: Column) -> Column:
    """Semitones of a note name such as ``E#5``, twelve to an octave; null for any other text."""
    step = F.try_element_at(F.create_map(*[F.lit(x) for kv in SEMITONES.items() for x in kv]), F.lower(F.regexp_extract(part, NOTE, 1)))
    marks = F.regexp_extract(part, NOTE, 2)
    sharp = 2 * F.length(F.regexp_replace(marks, "b", "")) - F.length(marks)
    return 12 * F.regexp_extract(part, NOTE, 3).try_cast("int") + step + sharp


def canonical_name(path: Column) -> Column:
    """A stem's parts (at ``_``) in one spelling: annotations go, notes become numbers, the rest is lower-cased."""
    name = stem(path)
    parts = F.filter(F.split(name, "_"), lambda p: ~matches_fully(p, MUSIC_NOTES))
    spelt = F.array_join(F.transform(parts, lambda p: F.coalesce(F.concat(F.lit("note"), note_number(p).cast("string")), F.lower(p))), "_")
    return F.when(F.size(parts) > 0, spelt).otherwise(F.lower(name))


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """NFKC, lower case, letters and digits only; null stays null."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKC", t).lower() if c.isalnum()))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts in this order; two empty texts are equal, one empty text is like nothing. Null counts as empty."""

    def one(x, y):
        x, y = x or "", y or ""
        if not x or not y:
            return float(x == y)
        return difflib.SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def general(number: pd.Series) -> pd.Series:
    """A number with six significant digits and no zeros at its end, as reports print it; a dash for null. Reports are short: this is for their cells."""
    return number.map(lambda x: "—" if pd.isna(x) else f"{x:g}")


def dbfs_cell(value: Column) -> Column:
    """A level with its sign and two decimals; -inf for null and what isn't finite."""
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.concat(F.format_string("%+.2f", F.bround(value, 2)), F.lit(" dBFS"))).otherwise("-inf dBFS")


def two_decimals(value: Column) -> Column:
    """Two decimals, a dash for null."""
    return F.when(value.isNull(), "—").otherwise(F.format_string("%.2f", F.bround(value.cast("double"), 2)))


def quoted(value: Column) -> Column:
    """Text for a shell's single quotes: each quote doubled."""
    return F.replace(value, F.lit("'"), F.lit("''"))


def first_line(text: Column, limit: int = 80) -> Column:
    """The first line without white space around it, ``limit`` characters at most; '' for null."""
    return F.left(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)[\r\n].*$", "")), F.lit(limit))


def json_get(document: Column, path: str, default: Column) -> Column:
    """What lies at a path such as ``$.a.b`` of a JSON text; ``default`` where it is missing, null or no JSON."""
    return F.coalesce(F.get_json_object(document, path), default)


def clip_stamp(when: Column) -> Column:
    """The day in a clip's name: yyyyMMdd."""
    return F.date_format(when, "yyyyMMdd")


def timecode(seconds: Column) -> Column:
    """MM:SS.mmm"""
    ms = F.bround(seconds * 1000, 0).cast("long")
    return F.format_string("%02d:%02d.%03d", F.floor(ms / 60000), F.floor(ms / 1000) % 60, ms % 1000)
