"""Groups of near copies: texts linked by a Jaccard similarity of 0.8 or more over their sets of five-word shingles.

Texts meet by SimHash first: sets whose 64-bit fingerprints differ in at most ``RADIUS`` bits meet in the covering tables of
``simhash.py`` (two halves of the bits, 15 masks each), and the sets of the links found there are compared.

Pairs at a similarity of 0.8 differ in about ten bits, so no radius that tables can cover finds all of them. The rest,
pairs of different groups, is found without a miss by what the sets share. The shingles of all texts have one
order, the common last; of two texts of a similarity of 0.8 the larger has one of its first b - ceil(0.8b) + 1 of
b shingles among the first a - ceil(8a/9) + 1 of the smaller's a (its short ones), so pairs are met where such
shingles are equal. A pair's sets differ in at least as many
shingles as the parity bits of their hashes do: pairs whose bits differ too much go, and the sets
of the rest are compared. Such texts' sizes are in one class or in neighbouring ones
(powers of 1.25), so a shingle's texts are met class by class. First each class's texts meet one of them, which
ties dense groups in linear work (more than ``DEALT`` texts are dealt over parts, so that a hot shingle isn't in one
task). Then texts that aren't in the class's largest component yet meet all others of it, in blocks of
``BLOCK``: pairs are compared where their blocks lie, and a pair leaves only if its bits allow the
similarity, in the first shingle that it has in common.

Words are runs without ASCII white space, A-Z lower-cased. Null and empty texts are copies of each
other; a text of at most five words is one shingle. Rows that repeat an id or a text are rows. An empty
table gives no rows. Of very long texts the whole set is held, one text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import clustered, free, written
from tonequarry.llm.components import connected_components
from tonequarry.llm.simhash import majority, near_links, set_bits
from tonequarry.llm.tokens import release

#: Differing bits of fingerprints that meet; each half of the bits is covered to half of it.
RADIUS, HALVES = 7, 2
SHINGLE, SEED, DEALT, BLOCK, PAIRS_AT_ONCE = 5, 42, 4096, 1024, 1 << 16
#: Up to so many texts' hashes are sent to all executors; more are joined.
SENT_MARKS = 1_000_000
#: Bits travel with each shingle of a text, so a very long text's are bounded; fewer bits sift less and lose nothing.
BITS = 1 << 12
#: So many shared shingles of a text travel with it, to tell whether a pair has met before.
TOLD = 4
#: Shingles found so often in one text of SAMPLE come last in the order: this changes the work, not the groups.
SAMPLE, COMMON, MOST_COMMON = 16, 3, 1 << 16


def shingle_set(text: bytes | None) -> np.ndarray:
    """The hashes of a text's shingles, ascending."""
    words = (text or b"").lower().split()
    xxh = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([xxh(b" ".join(words), SEED)], "<u8")
    return np.unique(np.array([xxh(b" ".join(g), SEED) for g in zip(*(words[k:] for k in range(SHINGLE)), strict=False)], "<u8"))


def fingerprint_of(s: np.ndarray) -> int:
    """The SimHash of a set's hashes."""
    return majority(sum(set_bits(s[at : at + (1 << 16)]) for at in range(0, len(s), 1 << 16)), len(s))


def parity_bits(s: np.ndarray) -> bytes:
    """For each value of the hashes' low bits whether an odd number of them has it; as many values as shingles, in a power of two, ``BITS`` at most."""
    n = min(BITS, max(64, 1 << (len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1).astype(np.uint8)).tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """At most the number of shingles that are in one set alone; the longer bits are folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def first_shingles(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which any text of a similarity of 0.8 shares one; ``common`` (ascending) come last."""
    late = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
    return np.concatenate((s[~late], s[late]))[: len(s) - -(-4 * len(s) // 5) + 1]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("mark"), F.col("text").cast("string").cast("binary"))


def _sets_of(b: pa.RecordBatch):
    """Slices of a batch with their shingle sets and hashes of these."""
    for at in range(0, b.num_rows, 512):
        some = b.slice(at, 512)
        sets = [shingle_set(t) for t in some["text"].to_pylist()]
        yield some, sets, np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)


def shingled(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, mark, node (a hash of the set), size, bits, fp and first (the shingles by which it can be met, in their order) of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        release()  # packing's encoders, if this worker ran it before
        for b in batches:
            for some, sets, node in _sets_of(b):
                first = [first_shingles(s, sent.value).view(np.int64) for s in sets]
                cols = [some["doc_id"], some["mark"], pa.array(node), pa.array([len(s) for s in sets], pa.int32()), pa.array([parity_bits(s) for s in sets], pa.binary())]
                cols += [pa.array(np.array([fingerprint_of(s) for s in sets], np.uint64).view(np.int64)), pa.array(first, pa.list_(pa.int64()))]
                yield pa.record_batch(cols, names=["doc_id", "mark", "node", "size", "bits", "fp", "first"])
        release()  # the memory of a batch of whole texts

    return _texts(docs).mapInArrow(run, "doc_id long, mark long, node long, size int, bits binary, fp long, first array<long>")


def _common(docs: DataFrame) -> np.ndarray:
    def run(batches):
        for b in batches:
            for _, sets, _ in _sets_of(b):
                yield pa.record_batch([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    some = _texts(docs).filter(F.pmod("mark", F.lit(SAMPLE)) == 0).select("mark", "text").dropDuplicates(["mark"])
    often = some.select("text").mapInArrow(run, "h long").groupBy("h").count().filter(F.col("count") >= COMMON)
    return np.sort(np.array([r["h"] for r in often.orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()], np.int64).view(np.uint64))


# --- first: texts meet by their fingerprints ------------------------------------


def _fingerprint_pairs(nodes: DataFrame, block: int) -> DataFrame:
    """Distinct pairs (a, b): the texts of one fingerprint with the smallest of them, and those of the links that span all groups within ``RADIUS`` bits."""
    reps = written(nodes.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("n")), "reps")
    same = nodes.select("node", "fp").join(reps.filter("n > 1").select("fp", "rep"), "fp").filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    links = near_links(reps.select("fp"), RADIUS, block, HALVES)
    side = lambda k: reps.select(F.col("fp").alias(k), F.col("rep").alias(f"r{k}"))
    near = links.join(side("a"), "a").join(side("b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
    out = written(same.union(near).distinct(), "met")
    free(reps, links)
    return out


# --- the rest: each shingle's texts meet one of them ----------------------------


def _meet(batches):
    """Rows arrive by (h, k, salt): each group's first text is its hub. Pairs (a, b) of a hub and another of a different component whose bits allow the similarity; hubs of parts as rows of their own."""
    hub = None
    for b in batches:
        rows: list[tuple] = []
        for h, k, salt, node, size, bits, component in zip(*(b[c].to_pylist() for c in ("h", "k", "salt", "node", "size", "bits", "component")), strict=True):
            if hub is None or hub[:3] != (h, k, salt):
                hub = h, k, salt, node, size, bits, component
                if salt:  # a part of a class's texts: its hub meets those of the other parts
                    rows.append((h, k, node, size, bits, component, None, None))
            elif component != hub[6] and 5 * min(size, hub[4]) >= 4 * max(size, hub[4]) and differing_bits(bits, hub[5]) <= (size + hub[4]) // 9:
                rows.append((None, None, None, None, None, None, min(node, hub[3]), max(node, hub[3])))
        if rows:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["h", "k", "node", "size", "bits", "component", "a", "b"])


def _members(nodes: DataFrame) -> DataFrame:
    """h, k (a class of sizes), base, node, size, short and n (texts of h and k): every first shingle of a text in which it can meet another.

    A text of class c is a base at k = c + 1 and a guest at k = c; two guests don't meet, they are bases elsewhere. Shingles
    are counted before they are joined (by a short hash: what it mixes up only stays), so a hot one is combined where it is read.
    """
    n_short = F.col("size") - F.ceil(8 * F.col("size") / 9) + 1
    rows = nodes.select(F.posexplode("first").alias("p", "h"), "node", "size").select("h", "node", "size", (F.col("p") < n_short).alias("short"), F.hash("h").alias("s"))
    shared = rows.groupBy("s").agg(F.count("*").alias("n"), F.bool_or("short").alias("short")).filter("n > 1 and short").select("s")
    size_class = F.floor(F.log("size") / F.log(F.lit(1.25)) + F.lit(1e-9)).cast("int")
    rows = rows.join(shared, "s", "left_semi").withColumn("c", size_class)
    two = F.array(F.struct((F.col("c") + 1).alias("k"), F.lit(True).alias("base")), F.struct(F.col("c").alias("k"), F.lit(False).alias("base")))
    rows = written(rows.withColumn("x", F.explode(two)).select("h", "x.*", "node", "size", "short"), "dealt")
    g = rows.groupBy("h", "k").agg(F.count("*").alias("n"), F.bool_or("base").alias("bases"), F.min(F.when(F.col("short"), F.col("size"))).alias("least"))
    # a text that isn't short here needs a smaller one that is
    out = written(rows.join(g.filter("n > 1 and bases and least is not null").drop("bases"), ["h", "k"]).filter("short or size >= least").drop("least"), "members")
    free(rows)
    return out


def _first_pairs(members: DataFrame, nodes: DataFrame, tied: DataFrame, dealt: int) -> DataFrame:
    """Distinct pairs (a, b) of each class's texts with one of them of a different component. More than ``dealt`` have a hub in each part of them, and one for the hubs."""
    schema = "h long, k int, node long, size int, bits binary, component long, a long, b long"
    parts = F.ceil(F.col("n") / F.lit(dealt)).cast("int")
    own = nodes.select("node", "bits").join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = members.join(own, "node").withColumn("salt", F.pmod(F.xxhash64(F.lit(3), "node"), parts).cast("int"))
    rows = rows.withColumn("salt", F.when(parts > 1, F.col("salt") + 1).otherwise(0))
    by, other = ["h", "k", "salt"], F.xxhash64("h", "node")  # a text is not the hub of all its shingles
    low = written(rows.repartition(*by).sortWithinPartitions(*by, other).select(*by, "node", "size", "bits", "component").mapInArrow(_meet, schema), "hubs")
    hubs = low.filter("node is not null").select("h", "k", F.lit(0).alias("salt"), "node", "size", "bits", "component")
    high = hubs.repartition("h", "k").sortWithinPartitions("h", "k", other).mapInArrow(_meet, schema)
    out = written(low.filter("a is not null").select("a", "b").union(high.filter("a is not null").select("a", "b")).distinct(), "pairs")
    free(low)
    return out


# --- then: those that aren't tied yet meet all others of a shingle, in blocks ----


def _rest_pairs(members: DataFrame, nodes: DataFrame, tied: DataFrame, block: int) -> DataFrame:
    """Pairs (a, b) of different components that share a first shingle, whose bits allow the similarity; each once."""
    by = ["h", "k"]
    rows = members.join(tied, "node", "left").select(*by, "base", "node", "size", "short", F.coalesce("component", "node").alias("component"))
    parts = rows.groupBy(*by, "component").agg(F.count("*").alias("m"))
    open_ = parts.groupBy(*by).agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1")
    rows = rows.join(open_, by).withColumn("out", F.col("component") != F.col("main"))
    # the lowest shingles in which a text is here, as the smaller of a pair and as the larger: a bounded part of its own
    lowest = lambda c: F.slice(F.array_sort(F.collect_set(c)), 1, TOLD)
    lists = rows.groupBy("node").agg(lowest(F.when(F.col("short"), F.col("h"))).alias("as_small"), lowest("h").alias("as_large"))
    wide = lists.join(nodes.select("node", "bits"), "node")
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    own = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "node"), blocks(n)).cast("int")
    n, n_out = F.col("n"), F.col("n") - F.col("most")
    as_x = F.transform(F.sequence(F.lit(0), blocks(n) - 1), lambda j: F.struct(own(5, n_out).alias("bx"), j.alias("by"), F.lit(0).alias("side")))
    as_y = F.transform(F.sequence(F.lit(0), blocks(n_out) - 1), lambda i: F.struct(i.alias("bx"), own(7, n).alias("by"), F.lit(1).alias("side")))
    rows = rows.withColumn("c", F.explode(F.when(F.col("out"), F.concat(as_x, as_y)).otherwise(as_y))).select(*by, "c.*", "base", "short", "node", "size", "component", "out")
    keys = [*by, "bx", "by"]
    return rows.join(wide, "node").repartition(*keys).sortWithinPartitions(*keys, "side").mapInArrow(_compare, "a long, b long")


class _Bits:
    """Parity bits of many rows, by their length: distances of pairs of rows."""

    def __init__(self, bits: list[bytes]):
        self.length = np.array([len(x) for x in bits])
        self.place = np.zeros(len(bits), np.int64)
        self.by: dict[int, np.ndarray] = {}
        for n in np.unique(self.length).tolist():
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            self.by[n] = np.frombuffer(b"".join(bits[k] for k in at.tolist()), np.uint8).reshape(-1, n)

    def differing(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        li, lj = self.length[i], self.length[j]
        for m, n in {*zip(li.tolist(), lj.tolist(), strict=True)}:
            at = np.flatnonzero((li == m) & (lj == n))
            x, y = self.by[m][self.place[i[at]]], self.by[n][self.place[j[at]]]
            if m > n:
                x, y = y, x
            while y.shape[1] > x.shape[1]:
                half = y.shape[1] // 2
                y = y[:, :half] ^ y[:, half:]
            out[at] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


def _earliest(small: pa.ListArray, large: pa.ListArray, i: np.ndarray, j: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each pair of rows (the smaller, the larger) whether none of the told shingles of both is below ``h``."""
    pair, shingle = [], []
    for lists, rows in ((small, i), (large, j)):
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        n = ends[rows + 1] - ends[rows]
        pair.append(np.repeat(np.arange(len(rows)), n))
        shingle.append(values[np.repeat(ends[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)])
    pair, shingle = np.concatenate(pair), np.concatenate(shingle)
    low = shingle < h[pair]
    pair, shingle = pair[low], shingle[low]
    order = np.lexsort((shingle, pair))
    pair, shingle = pair[order], shingle[order]
    out = np.ones(len(i), bool)
    out[pair[1:][(pair[1:] == pair[:-1]) & (shingle[1:] == shingle[:-1])]] = False
    return out


def _lists(rows: pa.Table, name: str) -> pa.ListArray:
    col = rows[name].combine_chunks()
    return col.chunk(0) if isinstance(col, pa.ChunkedArray) else col


def _compare(batches):
    """Pairs of the texts outside a class's largest component (side 0) with all of its texts (side 1), by block; two guests don't meet."""
    by = ["h", "k", "bx", "by"]
    for rows in clustered(batches, by):
        rows = rows.combine_chunks()
        h, k_, bx, by_, side, node, comp, size, out, base, short = (rows[c].to_numpy() for c in (*by, "side", "node", "component", "size", "out", "base", "short"))
        bits, small, large = _Bits(rows["bits"].to_pylist()), _lists(rows, "as_small"), _lists(rows, "as_large")
        start = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (k_[1:] != k_[:-1]) | (bx[1:] != bx[:-1]) | (by_[1:] != by_[:-1]))))
        n = np.diff(np.append(start, len(h)))
        ny = np.add.reduceat(side.astype(np.int64), start)
        nx = n - ny
        total = nx * ny
        upto = np.cumsum(total)
        a, b = [], []
        for at in range(0, int(upto[-1]), PAIRS_AT_ONCE):
            # pairs are numbered through all groups; so many at a time, wherever a group ends
            p = np.arange(at, min(at + PAIRS_AT_ONCE, int(upto[-1])))
            g = np.searchsorted(upto, p, "right")
            p -= upto[g] - total[g]
            i, j = start[g] + p // ny[g], start[g] + nx[g] + p % ny[g]
            ok = (comp[i] != comp[j]) & (base[i] | base[j]) & (5 * np.minimum(size[i], size[j]) >= 4 * np.maximum(size[i], size[j])) & (~out[j] | (node[i] < node[j]))
            i, j = i[ok], j[ok]
            swap = (size[i] > size[j]) | ((size[i] == size[j]) & (node[i] > node[j]))
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            ok = short[i]
            i, j = i[ok], j[ok]
            ok = bits.differing(i, j) <= (size[i] + size[j]) // 9
            i, j = i[ok], j[ok]
            ok = _earliest(small, large, i, j, h[i])
            a.append(np.minimum(node[i[ok]], node[j[ok]]))
            b.append(np.maximum(node[i[ok]], node[j[ok]]))
        if a:
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])


# --- the sets of what is left ---------------------------------------------------


def _alike(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b), a table, whose sets have the similarity."""

    def run(batches):
        for b in batches:
            for _, sets, node in _sets_of(b):
                yield pa.record_batch([pa.array(node), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    marks = written(nodes.join(wanted, "node", "left_semi").select("mark"), "marks")
    # texts are told apart in the JVM: batches of all of them would lie in memory beside a full heap
    texts = _texts(docs).select("mark", "text")
    if marks.count() <= SENT_MARKS:
        texts = texts.join(F.broadcast(marks), "mark", "left_semi").dropDuplicates(["mark"])
    else:
        texts = texts.dropDuplicates(["mark"]).join(marks, "mark", "left_semi")
    whole = written(texts.select("text").mapInArrow(run, "node long, shingles array<long>"), "whole")
    side = lambda k: whole.select(F.col("node").alias(k), F.col("shingles").alias(f"x{k}"))
    # sets meet in the JVM, a pair at a time: batches of them would be large
    similar = 9 * F.size(F.array_intersect("xa", "xb")) >= 4 * (F.size("xa") + F.size("xb"))
    out = written(pairs.join(side("a"), "a").join(side("b"), "b").filter(similar).select("a", "b"), "alike")
    free(marks, whole)
    return out


def near_copies(docs: DataFrame, block: int = BLOCK, dealt: int = DEALT) -> DataFrame:
    """doc_id, mark (a hash of the text) and component (of the links of a similarity of 0.8 or more) of each row."""
    sets = written(shingled(docs, _common(docs)), "shingled")
    nodes = written(sets.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("mark", "size", "bits", "fp", "first")]), "nodes")
    met = _fingerprint_pairs(nodes, block)
    near = _alike(met, docs, nodes)
    free(met)
    members = _members(nodes)
    first = _first_pairs(members, nodes, connected_components(near), dealt)
    links = near.union(_alike(first, docs, nodes))
    rest = written(_rest_pairs(members, nodes, connected_components(links), block).distinct().join(first, ["a", "b"], "left_anti"), "rest")
    free(members, first)
    more = _alike(rest, docs, nodes)
    free(rest, nodes)
    tied = connected_components(links.union(more))
    return sets.select("doc_id", "mark", "node").join(tied, "node", "left").select("doc_id", "mark", F.coalesce("component", "node").alias("component"))
