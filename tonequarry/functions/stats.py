"""Order statistics under the conventions the measurements need, as aggregate columns.

Three percentile ranks and two medians are in use and they differ, so each has a name here.
The aggregates hold a group's values and are for groups known to be small. ``ranks_by`` finds ranks of groups of any size
between bounds from a sketch, ``ranks_of_counts`` and ``exact_ranks`` (of a whole table) by counting in bins, ``medians_by`` medians:
none gathers a group's values.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _sorted(col: Column | str) -> Column:
    return F.array_sort(F.collect_list(col))


def _at(values: Column, index: Column) -> Column:
    return F.try_element_at(values, (index + 1).cast("int"))


def nearest_rank(col: Column | str, fraction: float) -> Column:
    """The value at the rounded (half to even) rank fraction * (n - 1)."""
    v = _sorted(col)
    return nearest_rank_of(v, fraction)


def nearest_rank_of(values: Column, fraction: float) -> Column:
    """As ``nearest_rank``, of a sorted array; null when empty."""
    rank = F.bround(F.lit(float(fraction)) * (F.size(values) - 1), 0)
    return F.when(F.size(values) > 0, _at(values, F.greatest(F.lit(0), F.least(rank, F.size(values) - 1))))


def floor_rank(col: Column | str, fraction: float) -> Column:
    """The value at the rank floor(fraction * n), at most the last."""
    return floor_rank_of(_sorted(col), fraction)


def floor_rank_of(values: Column, fraction: float) -> Column:
    rank = F.least(F.floor(F.lit(float(fraction)) * F.size(values)), F.size(values) - 1)
    return F.when(F.size(values) > 0, _at(values, rank))


def upper_median(col: Column | str) -> Column:
    """The middle value, of two middle values the larger."""
    v = _sorted(col)
    return F.when(F.size(v) > 0, _at(v, F.floor(F.size(v) / 2)))


def exact_ranks(df: DataFrame, value: str, ranks: dict[str, Column]) -> DataFrame:
    """pick and value: the values of a whole table at given ranks (from 0; columns of ``n``, the number of values; a rank per pick).

    Equal values are counted together first. A value's bin is its size on a scale of logarithms, then its place among 4096 in
    the bin: two small tables of counts tell where a rank lies, and only the values of that place are ordered.
    """
    v = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    v = v.withColumn("b1", F.floor(F.asinh("x") * 64))
    upto = lambda w: F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    holds = (F.col("rank") >= F.col("upto") - F.col("c")) & (F.col("rank") < F.col("upto"))
    # a bin for each 64th of a logarithm: some thousands at most, however many rows
    bins = v.groupBy("b1").agg(F.sum("c").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    bins = bins.withColumn("upto", upto(Window.orderBy("b1"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("pick"), r.cast("long").alias("rank")) for p, r in ranks.items()]))
    bins = bins.withColumn("w", wanted).select("b1", "c", "lo", "hi", "upto", "w.*").filter(holds)
    bins = bins.select("b1", "lo", "hi", "pick", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"))
    b2 = F.least(F.lit(4095), F.floor((F.col("x") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * 4096))
    inner = v.join(F.broadcast(bins), "b1").withColumn("b2", b2)  # a row for each pick
    places = inner.groupBy("pick", "rank", "b2").agg(F.sum("c").alias("c")).withColumn("upto", upto(Window.partitionBy("pick").orderBy("b2"))).filter(holds)
    places = places.select("pick", "b2", (F.col("rank") - F.col("upto") + F.col("c")).alias("_r"))
    last = inner.drop("rank").join(F.broadcast(places), ["pick", "b2"]).withColumnRenamed("_r", "rank")
    return last.withColumn("upto", upto(Window.partitionBy("pick").orderBy("x"))).filter(holds).select("pick", F.col("x").alias("value"))


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` and ``right`` joined by ``keys``, of which nulls are alike, as they are for groupBy."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys], F.lit(True))
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


#: Groups of fewer values are ordered whole; of others what lies this share of the group around a rank. The sketch is off by a ten-thousandth.
WHOLE, AROUND, ACCURACY = 400, 0.005, 10_000


def ranks_by(df: DataFrame, keys: list[str], value: str, ranks: dict[str, tuple[float, Column]]) -> DataFrame:
    """By ``keys``: n, the number of values, and for each pick the value at its rank. A pick is (share, rank): the rank counts from 0, is a column of ``n``
    and lies within one of share x n. Nulls don't count; NaN is the largest.

    Nothing gathers a group: a sketch of each group, merged from all tasks, gives bounds around each rank; what is below them is
    counted before the shuffle, and only the values between them are put in order. A rank outside its bounds would be an error.
    """
    x = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    shares = sorted({min(1.0, max(0.0, f + d)) for f, _ in ranks.values() for d in (-AROUND, AROUND)})
    found = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", shares, ACCURACY).alias("_q"))

    def bound(f: float, end: str):
        inner = F.get("_q", F.lit(shares.index(min(1.0, max(0.0, f)))))
        return F.when((F.col("n") < WHOLE) | F.lit(f <= 0 or f >= 1), F.col(end)).otherwise(inner)

    picks = F.explode(F.array(*[F.struct(F.lit(p).alias("_pick"), r.cast("long").alias("_rank"), bound(f - AROUND, "_min").alias("_lo"), bound(f + AROUND, "_max").alias("_hi")) for p, (f, r) in ranks.items()]))
    near = joined(x, found.select(*keys, "n", picks.alias("_p")).select(*keys, "n", "_p.*"), keys).filter(F.col("_x") <= F.col("_hi"))
    counts = near.groupBy(*keys, "n", "_pick", "_rank", F.when(F.col("_x") >= F.col("_lo"), F.col("_x")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_pick").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = counts.withColumn("_upto", upto).filter((F.col("_rank") >= F.col("_upto") - F.col("_c")) & (F.col("_rank") < F.col("_upto")))
    out = at.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_pick") == p, F.col("_v"))).alias(p) for p in ranks])
    return out.select(*keys, "n", *[F.coalesce(F.col(p), F.raise_error(F.lit("a rank lies outside its bounds")).cast("double")).alias(p) for p in ranks])


def ranks_of_counts(df: DataFrame, keys: list[str], value: str, weight: str, ranks: dict[str, Column]) -> DataFrame:
    """``ranks_by`` of values that are counted already: ``weight`` is how many a row stands for.

    Nothing gathers a group: equal values are counted together, a value's bin is its size on a scale of logarithms and its place one
    of 4096 within the bin, both counted before the shuffle; only the values of the places that hold a rank are put in order.
    """
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.sum(weight).alias("_c"))
    ends = F.when(F.isnan("_x"), F.lit(1 << 62)).when(F.col("_x") == float("inf"), F.lit(1 << 61)).when(F.col("_x") == -float("inf"), F.lit(-(1 << 61)))
    v = v.withColumn("_b1", F.coalesce(ends, F.floor(F.asinh("_x") * 64)))
    upto = lambda w: F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    holds = (F.col("_rank") >= F.col("_upto") - F.col("_c")) & (F.col("_rank") < F.col("_upto"))
    own = Window.partitionBy(*keys)
    bins = v.groupBy(*keys, "_b1").agg(F.sum("_c").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    bins = bins.withColumn("_upto", upto(own.orderBy("_b1"))).withColumn("n", F.sum("_c").over(own))
    wanted = F.explode(F.array(*[F.struct(F.lit(p).alias("_pick"), r.cast("long").alias("_rank")) for p, r in ranks.items()]))
    bins = bins.withColumn("_w", wanted).select(*keys, "n", "_b1", "_c", "_lo", "_hi", "_upto", "_w.*").filter(holds)
    bins = bins.select(*keys, "n", "_b1", "_lo", "_hi", "_pick", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"))
    # a bin of one value is done; of the others each value comes once, whatever number of picks
    spread = bins.filter("_lo < _hi")
    place = F.least(F.lit(4095), F.floor((F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 4096))
    inner = joined(v, spread, [*keys, "_b1"]).withColumn("_b2", F.when(F.isnan(F.col("_hi") - F.col("_lo")) | (F.col("_hi") - F.col("_lo") == float("inf")), 0).otherwise(place))
    spots = inner.groupBy(*keys, "n", "_pick", "_rank", "_b2").agg(F.sum("_c").alias("_c"))
    spots = spots.withColumn("_upto", upto(Window.partitionBy(*keys, "_pick").orderBy("_b2"))).filter(holds)
    spots = spots.select(*keys, "_pick", "_b2", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_r"))
    last = joined(inner.drop("_rank"), spots, [*keys, "_pick", "_b2"]).withColumnRenamed("_r", "_rank")
    last = last.withColumn("_upto", upto(Window.partitionBy(*keys, "_pick").orderBy("_x"))).filter(holds)
    found = last.select(*keys, "n", "_pick", "_x").union(bins.filter("not _lo < _hi").select(*keys, "n", "_pick", F.col("_lo").alias("_x")))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("_pick") == p, F.col("_x"))).alias(p) for p in ranks])


def medians_by(df: DataFrame, keys: list[str], value: str, name: str = "median", upper: bool = False) -> DataFrame:
    """By ``keys`` the median of ``value``: the mean of two middle values, or with ``upper`` the larger. Keys without a value have none."""
    n = F.col("n")
    got = ranks_by(df, keys, value, {"_m1": (0.5, F.floor(n / 2))} | ({} if upper else {"_m0": (0.5, F.floor((n - 1) / 2))}))
    return got.select(*keys, (F.col("_m1") if upper else (F.col("_m0") + F.col("_m1")) / 2).alias(name))


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, median and median absolute deviation (both with averaged middles) of ``value`` by ``keys``; no group's values are held."""
    count = df.groupBy(*keys).agg(F.count(value).alias("n"))
    mid = joined(count, medians_by(df, keys, value), keys, "left")
    dev = joined(df.select(*keys, value), mid, keys).withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    return joined(mid, medians_by(dev, keys, "_dev", "mad"), keys, "left")


def ranked_value(df: DataFrame, keys: list[str], value: str, fraction: float) -> DataFrame:
    """Nearest-rank percentile for groups too large to hold: rows are sorted within the group and one is picked."""
    w = Window.partitionBy(*keys)
    n = F.count(value).over(w)
    rank = F.row_number().over(w.orderBy(value)) - 1
    pick = F.bround(F.lit(float(fraction)) * (n - 1), 0)
    return df.filter(F.col(value).isNotNull()).withColumn("_rank", rank).withColumn("_pick", pick).filter("_rank = _pick").select(*keys, F.col(value).alias("value"))


def finite_round(col: Column, digits: int) -> Column:
    """Rounded half to even; null and non-finite values give null."""
    x = col.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.bround(x, digits))
