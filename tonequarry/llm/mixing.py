"""Mixing sources to target weights: whole copies that are certain, and Pareto order sampling of the rest.

Sizes are counted in words. A source's target is its weight's share of all words, held at ``MOST`` times what the source has;
what is held back goes to the others by weight until none is above. A document's expected copies are in proportion to
its propensity (by default the number of binary digits of its size: longer documents are somewhat likelier) and at most
``MOST``; their whole part is certain, the fraction is its inclusion probability p. Documents are ranked by the odds
of a random number, u / (1 - u), divided by the odds p / (1 - p), and the first in rank are taken until the words reach the
source's target: a sample of fixed size in words, off by half a document at most. Random numbers are hashes of id and text, so a rerun takes the same.

No rank is sorted as a whole: words are added up by source and bin of rank, and only the bin in which a source reaches its
target is put in order. Sources are numbered and levelled as tables; a source that holds a third of all rows is sums and one bin.

Null texts have size 0 and are never taken. A null source is a source of its own, the last. Null and repeated ids with unlike
texts have ranks of their own; rows equal in id and text have one rank and are taken one by one, all in one bin. Texts of any
length are only counted. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.llm.common import n_parts, table, written

#: Copies of a document at most; weights of sources in turn; bins of rank; sources in a table that is broadcast.
MOST, WEIGHTS, BINS, BROADCAST_SOURCES = 3, (1, 2, 3), 4096, 100_000


#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, size, target of each row of ``sizes`` (source, size), sources by code point and null last, weights in turn."""
    spark = sizes.sparkSession
    laid = sizes.repartitionByRange(n_parts(spark), F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    laid = written(laid, "sources")
    before = laid.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    turn = ((F.col("at") + F.col("before")) % len(weights)).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1)
    got = written(laid.withColumn("at", at).join(F.broadcast(before), "part").select("source", "size", weight.cast("long").alias("weight")), "weights")
    # each round holds sources that are above at the present level; the level only rises, so none is let go again
    share, whole, held = 0, 0, -1
    total = got.agg(F.sum("size")).first()[0] or 0
    while True:
        above = F.lit(share) * F.col("weight") / F.lit(float(whole or 1)) > most * F.col("size")
        r = got.agg(F.sum(F.when(above, F.col("size")).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight"))), F.sum(F.when(above, 1).otherwise(0))).first()
        if r[2] == held or r[2] is None:
            break
        held, share, whole = r[2], total - most * r[0], r[1]
    level = F.lit(share) * F.col("weight") / F.lit(float(whole or 1))
    return got.select("source", "size", F.when(level > most * F.col("size"), most * F.col("size")).otherwise(level).cast("double").alias("target"))


def expected_copies(sums: DataFrame, most: int = MOST) -> DataFrame:
    """``sums`` (source, propensity, words, target) with copies: how often a document of that propensity is expected to be taken.

    The likeliest are held at ``most``: their words leave the target, and the rest share it by propensity."""
    down = Window.partitionBy("source").orderBy(F.desc("propensity"))
    up_to, rest = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    above = F.coalesce(F.sum("words").over(up_to), F.lit(0))
    left = F.sum(F.col("words") * F.col("propensity")).over(rest)
    rate = F.when(left > 0, (F.col("target") - most * above) / left).otherwise(0.0)
    held = sums.withColumn("rate", rate).withColumn("held", F.col("rate") * F.col("propensity") >= most)
    # the first that is not held sets the rate of all that follow
    free = F.min(F.when(~F.col("held"), F.struct((-F.col("propensity")).alias("k"), "rate"))).over(Window.partitionBy("source"))
    copies = F.when(F.col("propensity") > -free["k"], float(most)).otherwise(F.coalesce(free["rate"] * F.col("propensity"), F.lit(float(most))))
    return held.withColumn("copies", F.least(copies, F.lit(float(most)))).drop("rate", "held")


def random_rank(p: Column, digest: Column) -> Column:
    """u / (1 - u) divided by p / (1 - p); u in (0, 1) from twelve hexadecimal digits."""
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return u / (1 - u) * ((1 - p) / p)


def mix(docs: DataFrame, propensity: Column | None = None, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source). ``propensity`` is a whole number
    over zero of few values, of columns of ``docs``; by default the binary digits of the size."""
    id_, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.md5(text)))
    rows = docs.select("*" if propensity is not None else "doc_id", id_.alias("_id"), F.col("source").cast("string").alias("_source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("_size"), digest.alias("_digest"))
    rows = written(rows.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.substring("_digest", 1, 12).alias("digest"), (F.length(F.bin("_size")) if propensity is None else propensity).cast("long").alias("propensity")), "sizes")
    sums = written(rows.groupBy("source", "propensity").agg(F.sum("size").alias("words")), "sums")
    aims = written(targets(sums.groupBy("source").agg(F.sum("words").alias("size")), weights, most), "targets")
    aims = aims.select(F.col("source").alias("src"), F.col("size").alias("source_size"), "target")
    plan = expected_copies(sums.join(_few(aims), F.col("source").eqNullSafe(F.col("src"))).drop("src"), most)
    whole = F.floor("copies")
    plan = plan.select(F.col("source").alias("src"), F.col("propensity").alias("prop"), "source_size", "target", whole.alias("whole"), (F.col("copies") - whole).alias("p"), (F.col("words") * whole).alias("certain"))
    own = Window.partitionBy("src")
    plan = written(plan.withColumn("left", F.col("target") - F.sum("certain").over(own)).drop("certain"), "plan")
    ranked = rows.join(_few(plan), F.col("source").eqNullSafe(F.col("src")) & (F.col("propensity") == F.col("prop"))).select(
        "doc_id", "source", "size", "source_size", "target", "whole", "left", F.when((F.col("p") > 0) & (F.col("size") > 0), random_rank(F.col("p"), F.col("digest"))).alias("rank")
    )
    ranked = written(ranked.withColumn("bin", F.floor(BINS * F.col("rank") / (1 + F.col("rank"))).cast("int")), "ranked")
    # words before each bin; in the bin where they reach what is left, documents go in order
    bins = ranked.filter("rank is not null").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.max("left").alias("left"))
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the last bin that begins below what is left: a document stays while its middle does
    last = bins.filter("before < left").groupBy("source").agg(F.max_by(F.struct("bin", "before"), "bin").alias("at")).select(F.col("source").alias("src"), F.col("at.bin").alias("last"), F.col("at.before").alias("before"))
    last = _few(written(last, "last"))
    placed = ranked.join(last, F.col("source").eqNullSafe(F.col("src")), "left")
    extra = F.when(F.col("rank").isNull() | F.col("last").isNull() | (F.col("bin") > F.col("last")), 0).when(F.col("bin") < F.col("last"), 1)
    placed = placed.withColumn("extra", extra)
    order = Window.partitionBy("src").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    there = placed.filter("extra is null").withColumn("extra", F.when(2 * (F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))) + F.col("size") <= 2 * F.col("left"), 1).otherwise(0))
    out = placed.filter("extra is not null").union(there)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra"))).cast("long").alias("taken"))


def op12_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
