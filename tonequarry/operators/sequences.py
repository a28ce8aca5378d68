"""Sequence operators over time-ordered rows of a key: islands, windows, change points, folds, schedules.

Windows are partitioned by the key of one clip, user or device; their rows are sorted on disk where
needed. Debounce is a window. Rolling medians and greedy picks cut a long key into parts that are told what they need of
their neighbours.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from tonequarry.functions.stats import joined, medians_by, ranks_by


def islands(df: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """Runs of consecutive integers of ``order`` where ``flag`` holds: keys, start, length."""
    hit = df.filter(flag).select(*keys, F.col(order).cast("long").alias("_o"))
    run = hit.withColumn("_run", F.col("_o") - F.row_number().over(Window.partitionBy(*keys).orderBy("_o")))
    return run.groupBy(*keys, "_run").agg(F.min("_o").alias("start"), F.count("*").alias("length")).drop("_run")


def inner_islands(df: DataFrame, keys: list[str], order: str, flag: Column, least: int = 1) -> DataFrame:
    """Islands with a row on either side where the flag doesn't hold, of ``least`` rows at least."""
    loud = df.filter(~flag).groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    return islands(df, keys, order, flag).join(loud, keys).filter((F.col("start") > F.col("_lo")) & (F.col("start") < F.col("_hi")) & (F.col("length") >= least)).drop("_lo", "_hi")


def tumbling(df: DataFrame, keys: list[str], t: str, width: float, *aggregates: Column) -> DataFrame:
    """Aggregates by key and window [k width, (k + 1) width) of ``t``: keys, window (k) and the aggregates, combined before the shuffle."""
    return df.groupBy(*keys, F.floor(F.col(t) / width).alias("window")).agg(*aggregates)


def lagged_difference(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    return df.withColumn("delta", F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def numbered(df: DataFrame, keys: list[str], order: list[str], step: float, name: str = "_n") -> DataFrame:
    """Add each row's place (from 0) within its key by ``order``, whose first column is a number. Rows are placed within stretches of
    ``step`` of that column, and stretches by their counts: a key's rows are in as many tasks as it has stretches."""
    rows = df.withColumn("_stretch", F.floor(F.col(order[0]) / step))
    counts = rows.groupBy(*keys, "_stretch").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*keys, "_stretch", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy(*keys, "_stretch").orderBy(*order)) - 1
    return joined(rows.withColumn("_own", own), counts, [*keys, "_stretch"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_stretch", "_own", "_before")


#: Rows of a key that are worked on together.
PART = 4096


def _sliding_medians(reach: int, value: str):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("_n")
        at, x = t["_n"].to_pylist(), t[value].to_pylist()
        window, medians, first, upto = [], [], 0, 0
        for k, n in enumerate(at):
            # rows of a part are consecutive: the window moves a place at a time
            while upto < len(at) and at[upto] <= n + reach:
                if x[upto] is not None:
                    insort(window, x[upto])
                upto += 1
            while at[first] < n - reach:
                if x[first] is not None:
                    del window[bisect_left(window, x[first])]
                first += 1
            m = len(window)
            medians.append(None if not m else float(window[m // 2]) if m % 2 else 0.5 * window[m // 2 - 1] + 0.5 * window[m // 2])
        t = t.append_column("rolling_median", pa.array(medians, pa.float64()))
        return t.filter(pc.equal(pc.divide(t["_n"], PART), t["_part"])).drop_columns(["_n", "_part"])

    return run


def rolling_median(df: DataFrame, keys: list[str], order: list[str], value: str, reach: int, step: float) -> DataFrame:
    """Median of the rows up to ``reach`` before and after, fewer at the ends; nulls don't count.

    A key's rows are cut into parts of ``PART`` with ``reach`` rows of the neighbours beside each; in a part a sorted window moves from
    row to row. ``step``: see ``numbered``.
    """
    rows = numbered(df, keys, order, step)
    near = F.sequence(F.greatest(F.lit(0), F.expr(f"(_n - {reach}) div {PART}")), F.expr(f"(_n + {reach}) div {PART}"))
    rows = rows.withColumn("_part", F.explode(near))
    schema = StructType([*df.schema.fields, StructField("rolling_median", DoubleType())])
    return rows.groupBy(*keys, "_part").applyInArrow(_sliding_medians(reach, value), schema)


def loudest_windows(samples: DataFrame, keys: list[str], width: int = 4, top: int = 4, floor: float = -70.0, t: str = "t", value: str = "m") -> DataFrame:
    """The ``top`` windows [k width, (k+1) width) of highest mean above the floor, of equals the later; a whole width has windows that never overlap."""
    inside = samples.filter(F.col(value) > floor).withColumn("start", F.floor(F.col(t) / width) * width)
    means = inside.groupBy(*keys, "start").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("mean"), F.desc("start"))
    return means.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= top).drop("_rank").withColumn("end", F.col("start") + width)


def density(samples: DataFrame, keys: list[str], floor: float = -70.0, loud: float = -20.0, value: str = "m") -> DataFrame:
    """n, upper median and the share of samples above ``loud``, of the samples above the floor."""
    inside = samples.filter(F.col(value) > floor)
    counts = inside.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(value) > loud).cast("double")).alias("loud_share"))
    return joined(counts, medians_by(inside, keys, value, upper=True), keys, "left").select(*keys, "n", "median", "loud_share")


def feature_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def step_vector(centroid: Column, low_ratio: Column, decay: Column) -> Column:
    """What tells materials apart: log10 centroid, 4 x low ratio, log10 decay; logarithms from 1 Hz and 1e-3."""
    return F.array(F.log10(F.greatest(centroid, F.lit(1.0))), 4.0 * low_ratio, F.log10(F.greatest(decay, F.lit(1e-3))))


def change_points(rows: DataFrame, keys: list[str], order: list[str], vector: Column, ratio: float = 1.8, least: float = 0.25, rows_least: int = 4) -> DataFrame:
    """Add step (from 1), distance to the step before, typical (upper median of the distances) and segment (from 1), by key.

    A segment begins where the distance is above ``ratio`` x typical and above ``least``. Keys of fewer than ``rows_least`` rows have none.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    d = rows.withColumn("_v", vector).withColumn("step", F.row_number().over(w)).withColumn("distance", feature_distance(F.lag("_v").over(w), F.col("_v")))
    typical = joined(d.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= rows_least), medians_by(d, keys, "distance", "_m", upper=True), keys, "left")
    d = joined(d, typical.select(*keys, "_n", F.coalesce(F.nullif("_m", F.lit(0.0)), F.lit(1e-9)).alias("typical")), keys)
    new = F.coalesce((F.col("distance") > F.col("typical") * ratio) & (F.col("distance") > least), F.lit(False))
    return d.withColumn("segment", 1 + F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_n")


def segment_means(segmented: DataFrame, keys: list[str], onset: str = "onset", means: dict[str, int] = {"centroid_hz": 1, "low_ratio": 4, "decay": 4}) -> DataFrame:  # noqa: B006
    """A row per segment of ``change_points``: first and last step, steps, start_s, end_s, the mean of each feature (with so many digits) and boundary_step, the first step of all segments but the first."""
    means = [F.bround(F.avg(c), d).alias(f"mean_{c}") for c, d in means.items()]
    s = segmented.groupBy(*keys, "segment").agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.count("*").alias("steps"), F.min(onset).alias("start_s"), F.max(onset).alias("end_s"), *means)
    return s.withColumn("boundary_step", F.when(F.col("segment") > 1, F.col("first_step")))


def step_gaps(rows: DataFrame, keys: list[str], onset: str = "onset") -> DataFrame:
    """Add step_gap: seconds since the step before, to the millisecond; null for the first."""
    return rows.withColumn("step_gap", F.bround(F.col(onset) - F.lag(onset).over(Window.partitionBy(*keys).orderBy(onset)), 3))


def step_gap_stats(gaps: DataFrame, keys: list[str]) -> DataFrame:
    """By key the number of gaps and their upper median."""
    return ranks_by(gaps, keys, "step_gap", {"median_gap": (0.5, F.floor(F.col("n") / 2))}).withColumnRenamed("n", "n_gaps")


def transitions(segmented: DataFrame, keys: list[str], floor: float = 0.3) -> DataFrame:
    """The first step of each segment but the first: distances to the steps before and after, jitter, and whether it differs from both.

    jitter is the upper median of the distances within segments; the limit is max(3 jitter, ``floor``).
    """
    w = Window.partitionBy(*keys).orderBy("step")
    d = segmented.withColumn("_first", F.coalesce(F.lag("segment").over(w) != F.col("segment"), F.lit(True))).withColumn("distance_to_next", F.coalesce(F.lead("distance").over(w), F.lit(0.0)))
    jitter = medians_by(d.filter("not _first"), keys, "distance", "jitter", upper=True)
    d = joined(d.filter("_first and segment > 1"), jitter, keys, "left").na.fill(0.0, ["jitter"])
    return d.withColumn("is_transition", F.least("distance", "distance_to_next") > F.greatest(3.0 * F.col("jitter"), F.lit(floor))).select(*keys, F.col("step").alias("boundary_step"), F.col("distance").alias("distance_to_previous"), "distance_to_next", "jitter", "is_transition")


def text_states(frames: DataFrame, keys: list[str], fps: float, floor_least: float = 0.2, floor_share: float = 0.3, change: float = 0.15) -> DataFrame:
    """States in which text shows: frames (idx, bright, change) at or above the floor max(``floor_least``, ``floor_share`` x brightest), parted where ``change`` is above its limit.

    The first frame of a run parts nothing. Columns: keys, start, end, duration (seconds), bright (mean).
    """
    peak = frames.groupBy(*keys).agg(F.greatest(F.lit(floor_least), F.max("bright") * floor_share).alias("_floor"))
    f = frames.join(peak, keys).withColumn("_text", F.col("bright") >= F.col("_floor"))
    w = Window.partitionBy(*keys).orderBy("idx")
    begins = F.col("_text") & (~F.coalesce(F.lag("_text").over(w), F.lit(False)) | (F.col("change") > change))
    f = f.withColumn("_state", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("_text")
    s = f.groupBy(*keys, "_state").agg(F.min("idx").alias("_a"), (F.max("idx") + 1).alias("_b"), F.avg("bright").alias("bright"))
    return s.select(*keys, (F.col("_a") / fps).alias("start"), (F.col("_b") / fps).alias("end"), ((F.col("_b") - F.col("_a")) / fps).alias("duration"), "bright")


def debounce(states: DataFrame, keys: list[str], least: float = 0.4) -> DataFrame:
    """Take a state shorter than ``least``, and the one after it, into the state before; the first state always stands.

    Whether a state is taken in depends on its own length and on that of the one before alone: no key's states are gathered.
    """
    w = Window.partitionBy(*keys).orderBy("start", "end")
    s = states.select(*keys, F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    s = s.withColumn("_k", F.row_number().over(w)).withColumn("_short", (F.bround(F.col("end") - F.col("start"), 3) < least) & (F.col("_k") > 1))
    stands = ~(F.col("_short") | F.coalesce(F.lag("_short").over(w), F.lit(False)))
    s = s.withColumn("_state", F.sum(stands.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.groupBy(*keys, "_state").agg(F.min("start").alias("start"), F.max_by("end", "_k").alias("end")).drop("_state")


def local_maxima(df: DataFrame, keys: list[str], order: str, value: str, block: int) -> DataFrame:
    """Rows that are not below the row before nor the one after; the first and the last of a key have no such neighbour. Blocks of so many
    units of ``order`` are tasks of their own and are told their neighbours' edge rows."""
    b = df.withColumn("_block", F.floor(F.col(order) / block).cast("long"))
    edges = b.groupBy(*keys, "_block").agg(F.min_by(F.struct(value), order).alias("_head"), F.max_by(F.struct(value), order).alias("_tail"))
    by = Window.partitionBy(*keys).orderBy("_block")
    edges = edges.select(*keys, "_block", F.lag("_tail").over(by).alias("_before"), F.lead("_head").over(by).alias("_after"))
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    b = joined(b.withColumn("_p", F.lag(F.struct(value)).over(w)).withColumn("_q", F.lead(F.struct(value)).over(w)), edges, [*keys, "_block"])
    p, q = F.coalesce("_p", "_before")[value], F.coalesce("_q", "_after")[value]
    return b.filter((F.col(value) >= p) & (F.col(value) >= q)).drop("_p", "_q", "_before", "_after")


def greedy_peaks(df: DataFrame, keys: list[str], order: str, value: str, threshold: Column, gap: int, block: int | None = None) -> DataFrame:
    """Local maxima (not below either neighbour) at or above the threshold, each ``gap`` units of ``order`` at least after the last one taken: keys, order.

    What a block takes depends on the last one taken before it alone, and only through the first candidate that is far enough: each block
    tells for every candidate in its first ``gap`` units which would be its last one taken. A pass over these answers finds where each
    block begins, and all blocks then take theirs.
    """
    block = max(block or 4096 * gap, gap)
    c = local_maxima(df, keys, order, value, block).filter(F.col(value) >= threshold)
    c = c.select(*keys, F.col(order).cast("long").alias("_o"), "_block")
    names = [f.name for f in c.schema.fields if f.name in keys]
    key_fields = [c.schema[k] for k in names]
    long = LongType()

    def answers(t: pa.Table) -> pa.Table:
        o = np.sort(t["_o"].to_numpy())
        after = np.searchsorted(o, o + gap)  # the next candidate that may be taken
        last = o.copy()
        for k in range(len(o) - 1, -1, -1):
            if after[k] < len(o):
                last[k] = last[after[k]]
        edge = np.flatnonzero(o < o[0] // block * block + gap)
        # candidates beyond the first gap are all far enough from whatever came before
        rest = len(edge) if len(edge) < len(o) else None
        pick = np.append(edge, rest) if rest is not None else edge
        head = t.slice(0, 1)
        return pa.table([*(head[k] for k in names), head["_block"], pa.array([o[pick].tolist()]), pa.array([last[pick].tolist()])], names=[*names, "_block", "_enter", "_leave"])

    answered = StructType([*key_fields, StructField("_block", long), StructField("_enter", ArrayType(long)), StructField("_leave", ArrayType(long))])
    told = c.groupBy(*keys, "_block").applyInArrow(answers, answered)

    def chain(batches):
        own, last = None, None
        for b in batches:
            held = list(zip(*(b[k].to_pylist() for k in names), strict=True)) if names else [()] * b.num_rows
            begins = []
            for name, enter, leave in zip(held, b["_enter"].to_pylist(), b["_leave"].to_pylist(), strict=True):
                if name != own:
                    own, last = name, None
                at = 0 if last is None else bisect_left(enter, last + gap)
                begins.append(enter[at] if at < len(enter) else None)
                last = leave[at] if at < len(enter) else last
            yield pa.record_batch([*(b[k] for k in names), b["_block"], pa.array(begins, pa.int64())], names=[*names, "_block", "_begin"])

    begun = StructType([*key_fields, StructField("_block", long), StructField("_begin", long)])
    starts = told.repartition(*keys).sortWithinPartitions(*keys, "_block").mapInArrow(chain, begun) if keys else told.repartition(1).sortWithinPartitions("_block").mapInArrow(chain, begun)

    def take(t: pa.Table) -> pa.Table:
        o = np.sort(t["_o"].to_numpy())
        begin, kept = t["_begin"][0].as_py(), []
        at = len(o) if begin is None else int(np.searchsorted(o, begin))
        while at < len(o):
            kept.append(o[at])
            at = int(np.searchsorted(o, o[at] + gap))
        head = t.slice(0, 1)
        return pa.table([*(pa.array(head[k].to_pylist() * len(kept), head.schema.field(k).type) for k in names), pa.array(kept, pa.int64())], names=[*names, order])

    taken = StructType([*key_fields, StructField(order, long)])
    return joined(c, starts, [*keys, "_block"]).groupBy(*keys, "_block").applyInArrow(take, taken)


def schedule(steps: DataFrame, keys: list[str], order: str, dwell: str, lead_in: float = 8.0, scale: float = 1.0) -> DataFrame:
    """Add at: when each step begins, the lead-in and all dwells before it."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumn("at", lead_in + F.coalesce(F.sum(F.col(dwell) * scale).over(w), F.lit(0.0)))


def schedule_end(planned: DataFrame, keys: list[str], dwell: str, tail: float, scale: float = 1.0) -> DataFrame:
    return planned.groupBy(*keys).agg(F.max_by(F.col("at") + F.col(dwell) * scale, "at").alias("_end")).select(*keys, (F.col("_end") + tail).alias("end"))


def vanished(snapshots: DataFrame, keys: list[str], order: str, names: str) -> DataFrame:
    """By key and name of the first snapshot: whether it was missing later, and whether it came back after that."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = snapshots.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, F.explode(names).alias("name"))
    seen = snapshots.join(first, keys).withColumn("_has", F.array_contains(names, F.col("name")))
    g = seen.groupBy(*keys, "name").agg(F.max(F.when(~F.col("_has"), F.col(order))).alias("_last_missing"), F.max(F.when(F.col("_has"), F.col(order))).alias("_last_seen"))
    return g.select(*keys, "name", F.col("_last_missing").isNotNull().alias("vanished"), F.coalesce(F.col("_last_seen") > F.col("_last_missing"), F.lit(False)).alias("reappeared"))


def keyframes(gaps: DataFrame, durations: DataFrame, keys: list[str], most: int = 6, at: float = 5.0, before: float = 0.6) -> DataFrame:
    """Frames to take: one of the scene, then two for each gap (before it, in its middle) while they fit into ``most``."""
    w = Window.partitionBy(*keys).orderBy("time_s", "duration_ms")
    n = F.row_number().over(w)
    g = gaps.withColumn("_n", n).filter(1 + 2 * F.col("_n") <= most).join(durations, keys)
    lead = F.greatest(F.lit(0.0), F.col("time_s") - before)
    middle = F.least(F.col("time_s") + F.greatest(F.lit(0.05), F.col("duration_ms") / 2000), F.greatest(F.lit(0.0), F.col("duration") - 0.05))
    two = F.inline(F.array(F.struct((2 * F.col("_n")).alias("frame"), lead.alias("t")), F.struct((2 * F.col("_n") + 1).alias("frame"), middle.alias("t"))))
    scene = durations.select(*keys, F.lit(1).alias("frame"), F.least(F.lit(at), F.greatest(F.lit(0.0), F.col("duration") - 0.1)).alias("t"))
    return scene.union(g.select(*keys, two))
