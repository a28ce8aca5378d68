"""Prefix tries of conversations: succinct level-order tries (LOUDS) per shard of prefixes, rollups in reverse level order.

A node is a distinct sequence of first turns; turns are equal where role and text are. A node is named by 128 bits that
follow from the turns before it, so its members are counted by an aggregate. Nodes with many members (more than a quarter
of a partition's mean number of conversations) are the heavy upper levels; each subtree below them goes whole to one
of the shards, where numpy lays its nodes out in level order, keeps the tree as a LOUDS bit vector with arrays of
labels, and adds leaves and savings up from the last level. The upper levels are then a trie of their own, to which the
shards add what they found. A conversation's turns are spread by range, so a long one is in several tasks.

Turns stand by ``turn`` (null first), equal ones by role, then a hash of role and text. A null role or text is empty.
Rows without a conv_id belong to no conversation. Repeated rows are turns of their own. Texts of any length are only
measured and hashed. An empty table gives no rows. Extra columns, whatever their names, are ignored.

``trie_shards`` returns the tries of the shards themselves: bit vectors and label arrays as bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.llm.common import clustered, n_parts, table, written

#: A node is heavy with more than 1/HEAVY_SHARE of a partition's mean number of conversations; nodes a shard holds about; rows of a table that is broadcast.
HEAVY_SHARE, SHARD_NODES, BROADCAST_ROWS = 4, 250_000, 500_000

_NODE = "p1 long, p2 long, q1 long, q2 long, conv_id long, depth long, bytes long, n_convs long, kids long, leaves long, saved long"
_ROLLED = "p1 long, p2 long, q1 long, q2 long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def running(df: DataFrame, key: str, order: list[str], **totals: Column) -> DataFrame:
    """``df`` with aggregates over the rows of a key up to each row. Rows are laid out by range and a part adds what the
    parts before it hold of its first key, so no key is gathered in one task. ``totals`` are count, sum or bit_xor columns."""
    laid = df.repartitionByRange(n_parts(df.sparkSession), key, *order).withColumn("part", F.spark_partition_id())
    laid = written(laid, "laid")
    upto = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = written(laid.select("*", *[t.over(upto).alias(n) for n, t in totals.items()]), "running")
    # only a part's first key can begin before it
    ends = local.groupBy(key, "part").agg(*[F.max_by(n, F.struct(*order)).alias(n) for n in totals])
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    xored = {n: "bit_xor" in str(t) for n, t in totals.items()}
    carry = ends.select(key, "part", *[(F.bit_xor(n) if xored[n] else F.sum(n)).over(before).alias(f"{n}_before") for n in totals]).filter(" or ".join(f"{n}_before is not null" for n in totals))
    out = local.join(carry, [key, "part"], "left")
    for n in totals:
        b = F.coalesce(F.col(f"{n}_before"), F.lit(0))
        out = out.withColumn(n, F.col(n).bitwiseXOR(b) if xored[n] else F.col(n) + b)
    return out.drop("part", *[f"{n}_before" for n in totals])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, d (from 1), l1, l2 (the turn's label), bytes of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("l1"), F.xxhash64(F.lit(2), role, text).alias("l2"), F.octet_length(text).cast("long").alias("bytes")
    )
    return running(rows, "conv_id", ["turn", "role", "l1", "l2"], d=F.count(F.lit(1))).select("conv_id", "d", "l1", "l2", "bytes")


class Louds:
    """A tree in level order as a bit vector: a one for each child of a node, then a zero; node 0 is a root above the roots."""

    def __init__(self, degrees: np.ndarray):
        ends = np.cumsum(degrees + 1) - 1
        self.bits = np.ones(int(ends[-1]) + 1, bool)
        self.bits[ends] = False

    @classmethod
    def from_bytes(cls, raw: bytes, n_bits: int) -> Louds:
        out = cls.__new__(cls)
        out.bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n_bits, bitorder="little").astype(bool)
        return out

    def to_bytes(self) -> bytes:
        return np.packbits(self.bits, bitorder="little").tobytes()

    def parents(self) -> np.ndarray:
        """The parent of each node from node 1 on: the zeros before its one."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones))

    def children(self, node: int) -> range:
        """The nodes below one node: those whose ones stand between the zeros that end the node before it and itself."""
        zeros = np.flatnonzero(~self.bits)
        first = int(zeros[node - 1]) + 1 if node else 0
        return range(first - node + 1, int(zeros[node]) - node + 1)


def _places(p1: np.ndarray, p2: np.ndarray, q1: np.ndarray, q2: np.ndarray) -> np.ndarray:
    """Where each (q1, q2) stands among (p1, p2); -1 for none."""
    n, a, b = len(p1), np.concatenate((p1, q1)), np.concatenate((p2, q2))
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    code = np.empty(len(by), np.int64)
    code[by] = np.cumsum(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) - 1
    at = np.full(int(code.max()) + 1, -1)
    at[code[:n]] = np.arange(n)
    return at[code[n:]]


def level_order(parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Nodes in level order (siblings by label), the degrees of a root above them and of each, and where levels begin (from 1)."""
    by = np.lexsort((label, parent))  # children of one node together, roots (-1) first
    first = np.searchsorted(parent[by], np.arange(-1, len(parent)))
    n_below = np.diff(np.append(first, len(parent)))
    level, levels, starts = by[: n_below[0]], [], [1]
    while len(level):
        levels.append(level)
        starts.append(starts[-1] + len(level))
        n = n_below[level + 1]
        ends = np.cumsum(n)
        level = by[np.repeat(first[level + 1] - (ends - n), n) + np.arange(int(ends[-1]))]
    order = np.concatenate(levels) if levels else np.empty(0, np.int64)
    return order, np.concatenate((n_below[:1], n_below[order + 1])), starts


def roll_up(cols: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], Louds]:
    """Children, leaves and savings of each node of one trie, in level order."""
    parent = _places(cols["p1"], cols["p2"], cols["q1"], cols["q2"])
    parent[cols["depth"] == 0] = -1
    order, degrees, starts = level_order(parent, cols["p1"])
    trie = Louds(degrees)
    above = np.concatenate(([0], trie.parents()))
    c = {k: np.concatenate(([0], v[order])) for k, v in cols.items()}
    n_children = degrees + c["kids"]
    leaves = c["leaves"] + (n_children == 0)
    saved = c["saved"] + (c["n_convs"] - 1) * c["bytes"]
    for lo, hi in zip(starts[-2::-1], starts[:0:-1], strict=True):
        np.add.at(leaves, above[lo:hi], leaves[lo:hi])
        np.add.at(saved, above[lo:hi], saved[lo:hi])
    c |= {"above": above, "n_children": n_children, "n_leaves": leaves, "saved_tokens": saved}
    return {k: v[1:] for k, v in c.items()}, trie


def _numpy(t: pa.Table) -> dict[str, np.ndarray]:
    return {k.split()[0]: t[k.split()[0]].to_numpy().astype(np.int64) for k in _NODE.split(", ")}


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in clustered(batches, ["shard"]):
        c, _ = roll_up(_numpy(t))
        conv = np.concatenate(([0], c["conv_id"]))[c["above"]]
        cols = [c[k.split()[0]] for k in _ROLLED.split(", ") if k != "parent_conv_id long"]
        cols.insert(6, pa.array(conv, mask=c["above"] == 0))
        yield pa.record_batch(list(map(pa.array, cols)), names=[k.split()[0] for k in _ROLLED.split(", ")])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in clustered(batches, ["shard"]):
        c, trie = roll_up(_numpy(t))
        row = [[t["shard"][0].as_py()], [len(c["p1"])], [len(trie.bits)], [trie.to_bytes()], [np.stack((c["p1"], c["p2"]), 1).tobytes()], [c["conv_id"].tobytes()]]
        yield pa.record_batch([pa.array(x, y) for x, y in zip(row, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "n_nodes", "n_bits", "louds", "labels", "conv_ids"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decimal ids of a node's members, joined, a row for each run within a batch."""
    for b in batches:
        if not b.num_rows:
            continue
        p1, p2, ids = (b[k].to_numpy() for k in ("p1", "p2", "conv_id"))
        starts = np.flatnonzero(np.concatenate(([True], (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1]))))
        text = list(map(str, ids.tolist()))
        said = [",".join(text[i:j]) for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(text)], strict=True)]
        yield pa.record_batch([pa.array(p1[starts]), pa.array(p2[starts]), pa.array(ids[starts]), pa.array(said)], names=["p1", "p2", "first", "said"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, h, done = None, None, []
    for b in batches:
        for p1, p2, said in zip(b["p1"].to_pylist(), b["p2"].to_pylist(), b["said"].to_pylist(), strict=True):
            if now == (p1, p2):
                h.update(b"," + said.encode())
                continue
            if h:
                done.append((*now, h.hexdigest()))
            now, h = (p1, p2), hashlib.sha256(said.encode())
        if done:
            yield pa.record_batch([pa.array(x) for x in zip(*done, strict=True)], names=["p1", "p2", "ends_sha256"])
            done = []
    if h:
        yield pa.record_batch([pa.array([x]) for x in (*now, h.hexdigest())], names=["p1", "p2", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """p1, p2, ends_sha256 of ``ends`` (p1, p2, conv_id): ids go by range into blocks, only a node's blocks meet, and they are
    hashed as they come. A digest of one list is one sequence: the blocks of a node pass one task, a batch at a time."""
    blocks = ends.repartitionByRange(n_parts(ends.sparkSession), "p1", "p2", "conv_id").sortWithinPartitions("p1", "p2", "conv_id").mapInArrow(_blocks, "p1 long, p2 long, first long, said string")
    return blocks.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(_digests, "p1 long, p2 long, ends_sha256 string")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast only where the counted rows are few; else Spark joins as it likes."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _split(turns: DataFrame, n_convs: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paths (a row for each turn with its node), light nodes with their shard, heavy nodes."""
    spark = turns.sparkSession
    marked = turns.select("conv_id", "depth", "bytes", F.xxhash64("depth", "l1", "l2").alias("x1"), F.xxhash64(F.lit(3), "depth", "l1", "l2").alias("x2"))
    paths = written(running(marked, "conv_id", ["depth"], p1=F.bit_xor("x1"), p2=F.bit_xor("x2")), "paths")
    nodes = paths.groupBy("p1", "p2").agg(F.max("x1").alias("x1"), F.max("x2").alias("x2"), F.min("conv_id").alias("conv_id"), F.max("depth").cast("long").alias("depth"), F.max("bytes").alias("bytes"), F.count("*").alias("n_convs"))
    nodes = nodes.select("p1", "p2", F.col("p1").bitwiseXOR(F.col("x1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("q2"), "conv_id", "depth", "bytes", "n_convs")
    nodes = written(nodes, "nodes")
    bound = n_convs // (HEAVY_SHARE * n_parts(spark))
    heavy = nodes.filter(F.col("n_convs") > bound)
    light = nodes.filter(F.col("n_convs") <= bound)
    last = paths.join(_small(heavy.select("p1", "p2")), ["p1", "p2"], "left_semi").groupBy("conv_id").agg(F.max("depth").alias("last"))
    # all light nodes of a conversation lie below the first of them
    tops = paths.join(last, "conv_id", "left").filter("depth = coalesce(last, 0) + 1").select("conv_id", F.xxhash64("p1", "p2").alias("top"))
    shards = max(n_parts(spark), light.count() // SHARD_NODES)
    light = light.join(tops, "conv_id").withColumn("shard", F.pmod("top", F.lit(shards)))
    return paths, light.select(*[F.lit(0).cast("long").alias(c) if c in ("kids", "leaves", "saved") else c for c in (k.split()[0] for k in _NODE.split(", "))], "shard"), heavy


def _sharded(light: DataFrame) -> DataFrame:
    return light.repartition("shard").sortWithinPartitions("shard", "depth")


def trie_shards(turns: DataFrame, n_convs: int) -> DataFrame:
    """The light part of the trie as it is stored: shard, n_nodes, n_bits, louds, labels (two longs a node), conv_ids, all in level order."""
    _, light, _ = _split(turns, n_convs)
    return _sharded(light).mapInArrow(_stored, "shard long, n_nodes long, n_bits long, louds binary, labels binary, conv_ids binary")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node of the trie over ``turns`` (conv_id, depth, l1, l2, bytes) of the conversations ``convs`` (conv_id), the root
    with its members without turns included: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    n_convs, least = convs.agg(F.count("*"), F.min("conv_id")).first()
    paths, light, heavy = _split(turns, n_convs)
    shards = written(_sharded(light).mapInArrow(_rolled, _ROLLED), "shards")
    tops = shards.filter("parent_conv_id is null")
    found = tops.groupBy("q1", "q2").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    root = convs.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in {"p1": 0, "p2": 0, "q1": 0, "q2": 0, "conv_id": least, "depth": 0, "bytes": 0, "n_convs": n_convs}.items()]).filter(F.lit(bool(n_convs)))
    upper = heavy.union(root).join(found.withColumnsRenamed({"q1": "p1", "q2": "p2"}), ["p1", "p2"], "left").na.fill(0, ["kids", "leaves", "saved"])
    upper = upper.select(*[k.split()[0] for k in _NODE.split(", ")], F.lit(0).alias("shard"))
    # at most HEAVY_SHARE * partitions nodes on a level: a trie of its own
    upper = written(upper.repartition(1).sortWithinPartitions("depth").mapInArrow(_rolled, _ROLLED), "upper")
    above = _small(upper.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("above")))
    tops = tops.join(above, ["q1", "q2"]).withColumn("parent_conv_id", F.col("above")).select(shards.columns)
    ends = convs.join(paths.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("end")), "conv_id", "left")
    ends = ends.select(*[F.coalesce(F.col(f"end.{p}"), F.lit(0).cast("long")).alias(p) for p in ("p1", "p2")], "conv_id")
    out = shards.filter("parent_conv_id is not null").union(tops).union(upper).join(end_digests(ends), ["p1", "p2"], "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def grafted(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the first turns of every fifth: (conv_id, depth, l1, l2, bytes) and all conv_ids.
    A conversation c takes the first crc32(c) mod 9 turns of c - c mod 5 in place of as many of its own."""
    turns = written(turns, "turns")
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    plan = sizes.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    plan = plan.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    plan = written(plan.select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken")), "plan")
    heads = turns.filter("d <= 8").withColumnRenamed("conv_id", "base").join(plan, "base").filter("d <= h").select("conv_id", F.col("d").alias("depth"), "l1", "l2", "bytes")
    rest = turns.join(plan, "conv_id").filter("d > h").select("conv_id", (F.col("taken") + F.col("d") - F.col("h")).alias("depth"), "l1", "l2", "bytes")
    return heads.union(rest), plan.select("conv_id")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*grafted(ordered_turns(table(spark, sf_dir, "conversations"))))
