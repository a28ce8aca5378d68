"""SimHash near-duplicates by covering locality-sensitive hashing.

A 64-bit fingerprint takes the majority of each bit over the XXH64 of all word shingles. For radius
r, every bit position gets a vector of r + 1 bits; the table of a nonzero vector v keeps the
positions whose vector has an odd product with v. At most r differing positions leave some v whose
products with all of them are even, so each pair within the radius agrees in that table: no pair is
missed. Pairs are compared where they meet, and only spanning links leave. For
a wider radius the positions are cut into parts: some part differs in at most its share of them.

Null and empty texts have fingerprint zero and are linked like any other. A row with a null doc_id
gets its group's smallest doc_id (null if there is none). Repeated rows are kept. Very long texts are hashed
65,536 shingles at a time. Ties: a bit set in just half the hashes is 0. An empty table gives no rows. Extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import by_batch, clustered, free, table, written
from tonequarry.llm.components import connected_components, roots_of

SHINGLE, SEED, RADIUS, BLOCK, PAIRS_AT_ONCE = 3, 42, 3, 1024, 1 << 16
_MET = "a long, b long, tab int, key long, fp long, label long"


def set_bits(h: np.ndarray) -> np.ndarray:
    """For each of the 64 bits how many of the hashes have it."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint of ``n`` hashes of which ``ones`` have each bit."""
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    xxh = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return xxh(b" ".join(words), seed)
    ones = np.zeros(64, np.int64)
    n = len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        some = words[at : at + (1 << 16) + shingle - 1]
        ones += set_bits(np.array([xxh(b" ".join(g), seed) for g in zip(*(some[k:] for k in range(shingle)), strict=False)], "<u8"))
    return majority(ones, n)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t, shingle, seed) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
        return pa.record_batch([b["doc_id"], pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(by_batch(run), "doc_id long, fp long")


def covering_masks(radius: int = RADIUS, bits: int = 64, parts: int = 1) -> list[int]:
    """2^(radius+1) - 1 masks; positions take the nonzero vectors in turn, so each mask keeps about 8 of 15 bits.

    With ``parts`` each of so many equal parts of the bits has the masks of its share of the radius.
    """
    if parts > 1:
        own = bits // parts
        return [m << (p * own) for p in range(parts) for m in covering_masks(radius // parts, bits - p * own if p == parts - 1 else own)]
    size = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if (v & (i % size + 1)).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _span(fp: np.ndarray, first: np.ndarray, met: np.ndarray, radius: int, apart: np.ndarray | None = None) -> np.ndarray:
    """For each row the smallest row that it reaches by pairs within ``radius`` bits, where a row meets the ``met`` rows from ``first`` on; rows that ``apart`` calls the same don't link."""
    root, upto = np.arange(len(fp)), np.cumsum(met)
    cuts = np.searchsorted(upto, np.arange(PAIRS_AT_ONCE, upto[-1], PAIRS_AT_ONCE), "right")
    for s, e in itertools.pairwise(np.unique([0, *cuts, len(fp)]).tolist()):
        n = met[s:e]
        j = np.repeat(np.arange(s, e), n)
        i = np.repeat(first[s:e] - (np.cumsum(n) - n), n) + np.arange(len(j))
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        if apart is not None:
            near &= apart[i] != apart[j]
        i, j = root[i[near]], root[j[near]]
        if (i != j).any():
            x, y = np.concatenate((i, j)), np.concatenate((j, i))
            order = np.argsort(x, kind="stable")
            root = roots_of(x[order], y[order], len(fp))[root]
    return root


def _group_of(*ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row and the number of rows of each row's group, where equal ids lie together."""
    start = np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in ids], axis=0))))
    n = np.diff(np.append(start, len(ids[0])))
    return np.repeat(start, n), np.repeat(n, n)


def _met(radius: int, block: int):
    """Rows arrive by (tab, key), and each meets the first ``block`` rows of its bucket: links that span the pairs within the radius.

    That is all for a bucket of up to ``block`` rows. Those of a larger one leave as well, each with a fingerprint (``label``) that
    it is linked to; no more than a batch and ``block`` rows are held.
    """

    def out(rows: np.ndarray, old: int, labels: np.ndarray | None):
        tab, key, fp = rows
        first, n = _group_of(tab, key)
        place = np.arange(len(fp)) - first
        met = np.minimum(place, block)
        met[:old] = 0  # rows that have met before
        root = _span(fp.view(np.uint64), first, met, radius)
        known = fp if labels is None else np.concatenate((labels, fp[old:]))
        label = known[root]
        tied, left = np.flatnonzero(root != np.arange(len(fp))), np.flatnonzero((n > block) & (np.arange(len(fp)) >= old))
        link = lambda x: pa.array(np.concatenate((x, np.zeros(len(left), np.int64))), mask=np.repeat([False, True], [len(tied), len(left)]))
        row = lambda x, t=None: pa.array(np.concatenate((np.zeros(len(tied), np.int64), x[left])), t, mask=np.repeat([True, False], [len(tied), len(left)]))
        return pa.record_batch([link(fp[tied]), link(fp[root[tied]]), row(tab, pa.int32()), row(key), row(fp), row(label)], names=[x.split()[0] for x in _MET.split(", ")]), label

    def run(batches):
        held, hubs, labels = np.empty((3, 0), np.int64), None, None
        for b in batches:
            rows = np.concatenate((held, np.stack([b[c].to_numpy().astype(np.int64) for c in ("tab", "key", "fp")])), axis=1)
            if hubs is not None:  # the last bucket is a large one
                other = np.flatnonzero((rows[:2] != hubs[:2, :1]).any(axis=0))
                cut = int(other[0]) if len(other) else rows.shape[1]
                if cut:
                    yield out(np.concatenate((hubs, rows[:, :cut]), axis=1), block, labels)[0]
                rows = held = rows[:, cut:]
                if not rows.shape[1]:
                    continue
                hubs = None
            if not rows.shape[1]:
                continue
            cut = int(_group_of(rows[0], rows[1])[0][-1])
            if cut:
                yield out(rows[:, :cut], 0, None)[0]
            held = rows[:, cut:]
            if held.shape[1] > block:
                made, label = out(held, 0, None)
                yield made
                hubs, labels, held = held[:, :block], label[:block], held[:, :0]
        if held.shape[1]:
            yield out(held, 0, None)[0]

    return run


def _crossed(radius: int):
    """Links of the rows of side 0 with those of side 1 in each pair of blocks; rows of one label are linked already."""

    def run(batches):
        for rows in clustered(batches, ["tab", "key", "bx", "by"]):
            fp, label, side = (rows[c].to_numpy() for c in ("fp", "label", "side"))
            first = _group_of(*(rows[c].to_numpy() for c in ("tab", "key", "bx", "by")))[0]
            n_x = np.bincount(first, side == 0, len(fp)).astype(np.int64)
            root = _span(fp.view(np.uint64), first, np.where(side == 1, n_x[first], 0), radius, label)
            tied = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.record_batch([pa.array(fp[tied]), pa.array(fp[root[tied]])], names=["a", "b"])

    return run


def _rest(crowded: DataFrame, block: int) -> DataFrame:
    """Rows of large buckets in pairs of hashed blocks: those outside a bucket's most frequent label (side 0) meet all of it (side 1)."""
    by = ["tab", "key"]
    labels = crowded.groupBy(*by, "label").agg(F.count("*").alias("m"))
    open_ = labels.groupBy(*by).agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("label", F.struct("m", "label")).alias("main")).filter("n > most")
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    own = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "fp"), blocks(n)).cast("int")
    n, n_out = F.col("n"), F.col("n") - F.col("most")
    as_x = F.transform(F.sequence(F.lit(0), blocks(n) - 1), lambda j: F.struct(own(11, n_out).alias("bx"), j.alias("by"), F.lit(0).alias("side")))
    as_y = F.transform(F.sequence(F.lit(0), blocks(n_out) - 1), lambda i: F.struct(i.alias("bx"), own(13, n).alias("by"), F.lit(1).alias("side")))
    rows = crowded.join(open_, by).withColumn("c", F.explode(F.when(F.col("label") != F.col("main"), F.concat(as_x, as_y)).otherwise(as_y)))
    return rows.select(*by, "c.*", "fp", "label")


def near_links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK, parts: int = 1) -> DataFrame:
    """Links (a, b) that span every group of the distinct longs ``fp`` within ``radius`` bits of each other.

    A fingerprint is one row in each table, whatever lies in its bucket, and meets the first ``block`` of it, which ties dense groups in
    linear work. In a larger bucket those outside its largest group then meet all of it, dealt over pairs of hashed blocks,
    each compared in a task of its own.
    """
    masks = F.array(*[F.struct(F.lit(k).alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(covering_masks(radius, parts=parts))])
    rows = fps.select("fp", F.explode(masks).alias("m")).select("fp", "m.tab", "m.key")
    keys = ["tab", "key"]
    met = written(rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_met(radius, block), _MET), "tables")
    links, crowded = met.filter("a is not null").select("a", "b"), met.filter("tab is not null").drop("a", "b")
    if not crowded.isEmpty():
        keys = ["tab", "key", "bx", "by"]
        links = links.union(_rest(crowded, block).repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(_crossed(radius), "a long, b long"))
    out = written(links.distinct(), "links")
    free(met)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reached by links of at most ``radius`` bits) of each row."""
    fps = written(fingerprints(docs, shingle, seed), "fps")
    reps = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "reps")
    links = near_links(reps.select("fp"), radius, block)
    comp = connected_components(links).withColumnRenamed("node", "fp")
    reps = reps.join(comp, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lows = reps.groupBy("component").agg(F.min("low").alias("component_id"))
    reps = written(reps.join(lows, "component").select("fp", "component_id"), "groups")
    return fps.join(reps, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, of each group of near copies (see ``near_copies``): its smallest doc_id, a null id last,
    then the smallest hash of the text. Rows of one id with unlike texts are in different groups, so each group keeps its own.

    Groups are ranked on ids and hashes alone; texts are shuffled once, to meet the kept (id, hash), after repeats
    within a partition are gone (by the partial aggregate).
    """
    from tonequarry.llm.near_copies import near_copies  # it needs this module's tables

    rows = written(near_copies(docs), "copies")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("m"))
    keep = first.select(F.coalesce(F.col("m.doc_id").cast("string"), F.lit("")).alias("__tq_id"), F.col("m.mark").alias("__tq_mark"))
    keyed = docs.withColumn("__tq_id", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))).withColumn("__tq_mark", F.xxhash64(F.col("text").cast("string")))
    return keyed.dropDuplicates(["__tq_id", "__tq_mark"]).join(keep, ["__tq_id", "__tq_mark"], "left_semi").select(docs.columns)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
