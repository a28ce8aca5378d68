"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, connected components.

Equal vectors are one row with a weight first. In each of several tables a vector's bucket is the
signs of its products with random hyperplanes. Vectors go to their buckets as 16-bit integers with a scale,
a quarter of their size. Within a bucket, blocks of vectors are compared by matrix products; what the
rounding leaves open, a hair around the threshold, is compared again with the whole vectors in double
precision, so no link is gained or lost by it. A pair counts in the first table in which it meets: planes
and vectors are whole numbers there, so signs come out the same wherever they are computed. Links
are counted without listing pairs, and only spanning links and open pairs leave a block. The number of signs
follows the number of vectors (about ``BUCKET`` to a bucket), the number of tables then follows
from the recall asked for at the threshold itself; nearer pairs are found more surely.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without an id,
link with nothing: n_links 0, component_id their own id (null id: null, kept false). Vectors of
different lengths don't link. Repeated rows are rows, each linked to the others of its vector. Ties: rows of
one id share its component and are all kept or none. An empty table gives no rows. Extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import clustered, table, written
from tonequarry.llm.components import connected_components, roots_of

THRESHOLD, RECALL, BUCKET, BLOCK, SEED = 0.9, 0.9999, 1000, 1024, 5
#: More buckets than this with several blocks are joined instead of broadcast.
BROADCAST_BUCKETS = 200_000
#: Rounding of a product of two unit vectors in single precision, generously: for each component, and for what comes before.
SLACK, SLACK_BEFORE = 2e-7, 1e-5


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Signs to a table and tables, for n vectors."""
    signs = min(30, max(4, round(math.log2(max(n, 1) / bucket)) if n > bucket else 4))
    agree = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def _signs_of(q: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """The bucket of each whole-numbered vector in each of the first ``tables`` tables. Sums stay below 2**53, so they are exact in any order."""
    planes = np.random.default_rng((SEED, q.shape[1])).standard_normal((tables * signs, q.shape[1]))
    planes = np.clip(np.rint(planes * 32), -127, 127).T
    above = (q.astype(np.float64) @ planes > 0).reshape(len(q), tables, signs)
    return (above * (1 << np.arange(signs, dtype=np.int64))).sum(axis=2).astype(np.int32)


def _by_length(some: pa.RecordBatch):
    """Slices of rows whose vectors have one length, with these as whole numbers."""
    vecs = some["q"].to_pylist()
    for dim in sorted({len(v) // 2 for v in vecs}):
        own = [k for k, v in enumerate(vecs) if len(v) == 2 * dim]
        yield dim, own, np.frombuffer(b"".join(vecs[k] for k in own), np.int16).reshape(-1, dim)


def _bucket_sizes(signs: int, tables: int):
    """Rows (tab, dim, sig, n): vectors of each bucket, some at a time."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                for dim, _, q in _by_length(b.slice(at, 4096)):
                    sig = _signs_of(q, signs, tables)
                    key, n = np.unique(sig.astype(np.int64) + (np.arange(tables, dtype=np.int64) << 32), return_counts=True)
                    yield pa.record_batch([pa.array((key >> 32).astype(np.int32)), pa.array(np.full(len(key), dim, np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["tab", "dim", "sig", "n"])

    return run


def _dealt(signs: int, tables: int):
    """Rows (tab, dim, sig, rep, weight, scale, q) of each vector, one a table."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                for dim, own, q in _by_length(some):
                    sig = _signs_of(q, signs, tables)
                    row = pa.array(np.repeat(own, tables))
                    cols = [pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))), pa.array(np.full(len(row), dim, np.int32)), pa.array(sig.ravel()), *(some[c].take(row) for c in ("rep", "weight", "scale", "q"))]
                    yield pa.record_batch(cols, names=["tab", "dim", "sig", "rep", "weight", "scale", "q"])

    return run


_FOUND = "rep long, links long, root long, other_links long, open boolean"


def _compare(threshold: float, signs: int):
    """For each block pair: links of other vectors' weights newly met here and a spanning link (rep, links, root),
    and the pairs too near to the threshold to tell (open: rep and root, with the weight that each gives the other)."""
    keys = ["tab", "dim", "sig", "bi", "bj"]

    def run(batches):
        for rows in clustered(batches, keys):
            ids = [rows[k].to_numpy() for k in keys]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in ids], axis=0)) + 1
            bounds = np.concatenate(([0], cut, [rows.num_rows]))
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                g = rows.slice(s, e - s)
                tab, dim, own = g["tab"][0].as_py(), g["dim"][0].as_py(), g["own"].to_numpy()
                q = np.frombuffer(b"".join(g["q"].to_pylist()), np.int16).reshape(-1, dim)
                scale = g["scale"].to_numpy()
                x = (q * scale[:, None]).astype(np.float32)
                cos = x @ x.T
                # a vector's rounding is at most half a step in each component
                doubt = float(scale.max()) * math.sqrt(dim) + SLACK * dim + SLACK_BEFORE
                near = cos >= threshold - doubt
                if g["bi"][0].as_py() != g["bj"][0].as_py():
                    near &= own[:, None] != own[None, :]  # pairs within a block are another task's
                np.fill_diagonal(near, False)
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                open_ = cos[i, j] <= threshold + doubt
                rep, weight = g["rep"].to_numpy(), g["weight"].to_numpy()
                sig = _signs_of(q, signs, tab) if tab else np.empty((e - s, 0), np.int32)
                fresh = _unmet(sig, i, j)
                links = np.bincount(i[fresh & ~open_], weight[j[fresh & ~open_]], e - s).astype(np.int64)
                root = roots_of(i[~open_], j[~open_], e - s)
                told = np.flatnonzero((links > 0) | (root != np.arange(e - s)))
                open_ &= fresh & (i < j)
                i, j = i[open_], j[open_]
                n, z = len(told), len(i)
                cols = [np.append(rep[told], rep[i]), np.append(links[told], weight[j]), np.append(rep[root[told]], rep[j]), np.append(np.zeros(n, np.int64), weight[i]), np.append(np.zeros(n, bool), np.ones(z, bool))]
                yield pa.record_batch([pa.array(c) for c in cols], names=["rep", "links", "root", "other_links", "open"])

    return run


def _unmet(sig: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows share no bucket of the tables in ``sig``."""
    out = np.ones(len(i), bool)
    for t in sig.T:
        out &= t[i] != t[j]
    return out


def _settle(threshold: float):
    """Open pairs whose whole vectors link, once in each direction."""

    def run(batches):
        for b in batches:
            keep = [float(np.frombuffer(x) @ np.frombuffer(y)) >= threshold for x, y in zip(b["va"].to_pylist(), b["vb"].to_pylist(), strict=True)]
            b = b.filter(pa.array(keep, pa.bool_()))
            for rep, links, root in (("rep", "links", "root"), ("root", "other_links", "rep")):
                yield pa.record_batch([b[rep], b[links], b[root]], names=["rep", "links", "root"])

    return run


def embedding_groups(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding)."""
    vec = F.col("embedding").cast("array<double>")
    ok = F.coalesce(F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(vec, lambda v: v != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(ok, vec).alias("v"))
    # -0.0 and 0.0 are equal; two hashes of 64 bits stand for the vector
    rows = rows.withColumn("v", F.transform("v", lambda v: v + F.lit(0.0))).withColumn("h1", F.xxhash64(F.lit(1), "v")).withColumn("h2", F.xxhash64(F.lit(2), "v"))
    reps = rows.filter("v is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.any_value("v").alias("v"))
    reps = written(reps.mapInArrow(_unit, "h1 long, h2 long, rep long, weight long, vec binary, scale double, q binary"), "vectors")
    signs, tables = plan_tables(reps.count(), threshold, recall)
    bucket = ["tab", "dim", "sig"]
    sizes = reps.select("q").mapInArrow(_bucket_sizes(signs, tables), "tab int, dim int, sig int, n long").groupBy(*bucket).agg(F.sum("n").alias("n"))
    big = written(sizes.filter(F.col("n") > block).withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")).drop("n"), "buckets")
    big = F.broadcast(big) if big.count() <= BROADCAST_BUCKETS else big
    dealt = reps.select("rep", "weight", "scale", "q").mapInArrow(_dealt(signs, tables), "tab int, dim int, sig int, rep long, weight long, scale double, q binary")
    met = dealt.join(big, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    met = met.withColumn("own", F.pmod(F.xxhash64(F.lit(3), "rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("blocks", "other")
    keys = ["tab", "dim", "sig", "bi", "bj"]
    found = written(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold, signs), _FOUND), "links")
    vec = lambda k, name: reps.select(F.col("rep").alias(k), F.col("vec").alias(name))
    open_ = found.filter("open").join(vec("rep", "va"), "rep").join(vec("root", "vb"), "root").select("rep", "links", "root", "other_links", "va", "vb")
    found = found.filter("not open").select("rep", "links", "root").union(written(open_.mapInArrow(_settle(threshold), "rep long, links long, root long"), "settled"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    groups = reps.select("h1", "h2", "rep", "weight").join(links, "rep", "left").join(comp, "rep", "left")
    groups = groups.select("h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h1")).alias("h1"), F.when(F.col("v").isNotNull(), F.col("h2")).alias("h2")).join(written(groups, "vecgroups"), ["h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _unit(batches):
    """Vectors as the bytes of unit vectors in double precision, and as whole numbers with a scale; one too small or large to square is scaled first."""
    for b in batches:
        vecs, scales, whole = [], [], []
        for v in b["v"].to_pylist():
            x = np.array(v, np.float64)
            x = x / np.abs(x).max()
            x = x / np.sqrt((x * x).sum())
            scale = np.abs(x).max() / 32767
            vecs.append(x.tobytes())
            scales.append(scale)
            whole.append(np.rint(x / scale).astype(np.int16).tobytes())
        yield pa.record_batch([b["h1"], b["h2"], b["rep"], b["weight"], pa.array(vecs, pa.binary()), pa.array(scales, pa.float64()), pa.array(whole, pa.binary())], names=["h1", "h2", "rep", "weight", "vec", "scale", "q"])


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))
