"""Shown text against heard activity: what either has without the other, and speech without a pause.

All joins are the bucketed interval joins of ``intervals``; nothing is gathered by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonequarry.operators.intervals import adjacent_gaps, best_overlap, least_covered

#: Shorter activity is noise; less silence than this means that activity says nothing; a pause this short may be none.
MIN_ACTIVITY_S, MIN_SILENCE_SHARE, GAP_TOLERANCE_S, LEAST_SHARE = 0.15, 0.05, 0.35, 0.2


def state_rows(states: DataFrame, activity: DataFrame, keys: list[str], bucket: float, state_id: str, activity_id: str) -> DataFrame:
    """Each state with covered_share, voice_start and offset_ms of the activity that it overlaps most; voice_start is null below ``LEAST_SHARE``."""
    m = best_overlap(states.select(*keys, state_id, "start", "end"), activity.select(*keys, activity_id, "start", "end"), keys, bucket, state_id, activity_id, LEAST_SHARE)
    share = F.col("overlap") / F.greatest(F.col("end") - F.col("start"), F.lit(0.001))
    return m.select(*keys, state_id, "start", "end", share.alias("covered_share"), "voice_start", F.bround((F.col("voice_start") - F.col("start")) * 1000, 0).cast("long").alias("offset_ms"))


def findings(states: DataFrame, activity: DataFrame, keys: list[str], bucket: float, state_id: str, activity_id: str, gap_tolerance: float = GAP_TOLERANCE_S) -> DataFrame:
    """keys, kind, subject (the id of the state or activity, as text) and at.

    text_without_voice: a state that no activity covers enough; voice_without_text: activity of ``MIN_ACTIVITY_S`` or more that
    no state covers enough, where the key has states; no_gap_between: activity followed by more within ``gap_tolerance``.
    """
    told = lambda df, kind, subject, at: df.select(*keys, F.lit(kind).alias("kind"), F.col(subject).cast("string").alias("subject"), F.col(at).alias("at"))
    silent = state_rows(states, activity, keys, bucket, state_id, activity_id).filter("voice_start is null")
    unseen = least_covered(activity.select(*keys, activity_id, "start", "end"), states, keys, bucket, activity_id, LEAST_SHARE, MIN_ACTIVITY_S)
    close = adjacent_gaps(activity, keys, gap_tolerance)
    return told(silent, "text_without_voice", state_id, "start").union(told(unseen, "voice_without_text", activity_id, "start")).union(told(close, "no_gap_between", activity_id, "end"))


def usable(silence_share: Column) -> Column:
    """Whether activity tells speech from its background at all."""
    return silence_share >= MIN_SILENCE_SHARE
