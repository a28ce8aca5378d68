"""Operators 11 to 13 against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonequarry.llm import alignment, mixing, prefix_trie, registry, tokens
from tonequarry.llm.common import table

# 11


def trie(rows):
    """Nodes of rebuilt conversations (conv, turn, role, text), each as the contract has it."""
    conv = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda z: z[:3])] for c, v in conv.items()}
    node, kids, out = defaultdict(list), defaultdict(list), {}
    for c in conv:
        h = zlib.crc32(str(c).encode()) % 9
        seq = conv.get(c - int(np.fmod(c, 5)), [])[:h] + conv[c][h:]
        for d in range(len(seq) + 1):
            node[tuple(seq[:d])].append((c, len(seq)))
    for k in node:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(node, key=len, reverse=True):
        m = node[k]
        own = (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
        ends = hashlib.sha256(",".join(str(c) for c in sorted(c for c, n in m if n == len(k))).encode()).hexdigest()
        parent = min(c for c, _ in node[k[:-1]]) if k else None
        out[k] = (min(c for c, _ in m), len(k), parent, len(m), len(kids[k]), sum(out[x][5] for x in kids[k]) or 1, own + sum(out[x][6] for x in kids[k]), ends)
    return sorted(out.values(), key=str)


COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def nodes(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_trie_equals_brute_force(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert nodes(registry.QUERIES["op11_prefix_trie"](spark, sf)) == trie(rows)


def test_trie_of_odd_and_hot_rows(spark):
    rng = random.Random(8)
    rows = [(None, 1, "user", "no conversation"), (7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None), (-3, 1, "user", "é"), (12, 2, "b", "tie"), (12, 2, "a", "tie")]
    # a third of all are one conversation, many share a first turn, one is long, and two branch from a long one's end
    rows += [(1000 + k, t, "user", f"same {t}") for k in range(60) for t in range(3)]
    rows += [(2000 + k, t, "user", "hello" if t == 0 else f"{rng.randrange(3)}") for k in range(60) for t in range(rng.randrange(1, 6))]
    rows += [(5000 + 5 * k, t, "user", f"long {t}" if t < 400 else f"{k}") for k in range(2) for t in range(401)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("depth", "p1", "part", "n", "h", "base"):
        df = df.withColumn(c, F.lit(-1))
    got = prefix_trie.prefix_trie(*prefix_trie.grafted(prefix_trie.ordered_turns(df)))
    assert nodes(got) == trie(rows)
    none = prefix_trie.prefix_trie(*prefix_trie.grafted(prefix_trie.ordered_turns(df.limit(0))))
    assert none.columns == COLUMNS and none.count() == 0


def test_louds_bits_hold_the_tree():
    parent = np.array([-1, 0, 0, 1, -1, 4, 1])
    order, degrees, starts = prefix_trie.level_order(parent, np.array([5, 3, 2, 9, 1, 0, 8]))
    trie = prefix_trie.Louds(degrees)
    assert order.tolist() == [4, 0, 5, 2, 1, 6, 3] and starts == [1, 3, 6, 8]
    assert "".join("01"[int(b)] for b in trie.bits) == "110101100011000"
    above = trie.parents()
    place = {n: k + 1 for k, n in enumerate(order.tolist())}
    assert [place.get(parent[n], 0) for n in order] == above.tolist()
    back = prefix_trie.Louds.from_bytes(trie.to_bytes(), len(trie.bits))
    for node in range(len(order) + 1):
        assert list(back.children(node)) == [k + 1 for k, a in enumerate(above) if a == node]


def test_stored_shards(spark, sf):
    turns, convs = prefix_trie.grafted(prefix_trie.ordered_turns(table(spark, sf, "conversations")))
    whole = prefix_trie.prefix_trie(turns, convs)
    stored = prefix_trie.trie_shards(turns, convs.count()).collect()
    n = sum(r["n_nodes"] for r in stored)
    assert 0 < n <= whole.count()
    for r in stored:
        trie = prefix_trie.Louds.from_bytes(r["louds"], r["n_bits"])
        assert len(trie.parents()) == r["n_nodes"] == len(r["labels"]) // 16 == len(r["conv_ids"]) // 8


def test_running_totals_over_parts(spark):
    rows = [(k % 3 if k < 50 else 9, k, (k * 37) % 11) for k in range(400)]
    got = prefix_trie.running(spark.createDataFrame(rows, "key long, at long, x long").repartition(7), "key", ["at"], n=F.count(F.lit(1)), s=F.sum("x"), b=F.bit_xor("x"))
    want, seen = set(), defaultdict(lambda: (0, 0, 0))
    for key, at, x in rows:
        n, s, b = seen[key]
        seen[key] = (n + 1, s + x, b ^ x)
        want.add((key, at, x, *seen[key]))
    assert {tuple(r[c] for c in ("key", "at", "x", "n", "s", "b")) for r in got.collect()} == want


# 12


def test_mixture_meets_its_targets(spark, sf):
    rows = registry.QUERIES["op12_mixing"](spark, sf).collect()
    docs = {r["doc_id"]: r for r in table(spark, sf, "documents").collect()}
    by, size = defaultdict(list), Counter()
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len((d["text"] or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")) - (d["text"] or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ").count("")
        assert r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        by[d["source"]].append(r)
        size[d["source"]] += r["size"]
    names = sorted(by, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    held = set()
    while True:
        level = (sum(size.values()) - 3 * sum(size[s] for s in held)) / sum(weight[s] for s in names if s not in held)
        over = {s for s in names if s not in held and level * weight[s] > 3 * size[s]}
        if not over:
            break
        held |= over
    for s in names:
        target = 3 * size[s] if s in held else level * weight[s]
        assert all(abs(r["target"] - target) < 1e-6 * target + 1e-9 and r["source_size"] == size[s] for r in by[s])
        # half of the document at which the target is reached
        assert abs(sum(r["taken"] for r in by[s]) - target) <= max(r["size"] for r in by[s]) / 2 + 1e-6
    assert sorted(map(tuple, rows)) == sorted(map(tuple, registry.QUERIES["op12_mixing"](spark, sf).collect()))


def test_mixture_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "a null id", None), (None, "another null id", None), (3, "w " * 5000, "b"), (4, "x y", "b"), (4, "x y", "b"), (5, "z", "c")] + [(100 + k, "one two three", "hot") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for c in ("size", "rank", "bin", "target", "src", "part", "weight"):
        df = df.withColumn(c, F.lit(-1))
    got = mixing.mix(df).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len((t or "").split())) for d, t, _ in rows)
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["target"], r["source_size"]] += r["taken"]
    # a has no words, c and the null source stop at three times theirs: b and hot share the rest, two to one
    (target,) = (t for t, size in taken if size == 900)
    assert target == pytest.approx((5911 - 3 * 7) / 3) and abs(taken[target, 900] - target) <= 1.5
    assert taken[3.0, 1] == 3 and taken[18.0, 6] == 18 and taken[0.0, 0] == 0
    assert mixing.mix(df.limit(0)).collect() == []
    # a propensity of one's own: what is likelier is taken first
    some = spark.createDataFrame([(k, "a b c d", "s" if k < 100 else "t") for k in range(110)], "doc_id long, text string, source string").withColumn("good", F.when(F.col("doc_id") % 2 == 0, 9).otherwise(1))
    by = Counter()
    for r in mixing.mix(some, F.col("good"), (1,)).collect():
        if r["doc_id"] < 100:
            by[r["doc_id"] % 2] += r["taken"]
    assert by[0] > 4 * by[1]


def test_inclusion_follows_probability(spark):
    ranks = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0.8).otherwise(0.2).alias("p"), F.md5(F.col("id").cast("string")).alias("d"))
    first = ranks.select("id", mixing.random_rank(F.col("p"), F.col("d")).alias("r")).orderBy("r").limit(10_000).select((F.col("id") % 2).alias("odd")).groupBy("odd").count().collect()
    share = {r["odd"]: r["count"] / 10_000 for r in first}
    assert abs(share[0] - 0.8) < 0.02 and abs(share[1] - 0.2) < 0.02


# 13

PATH_A, PATH_B = tokens.vocabulary_path("byte_bpe_50k.json"), tokens.vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(PATH_A, PATH_B, 1000)


def aligned(aligner, text):
    """Counts, digest and linked pairs by comparing every token of A with every token of B."""
    none = (0, 0, 0, 0, "", Counter())
    if not text:
        return none
    back = {c: b for b, c in aligner.a.wide.items()}
    spaced = " " + text
    a, b = aligner.a.tok.encode(spaced, add_special_tokens=False).ids, aligner.b.sp.encode(text)
    bytes_a = [bytes(back.get(c, ord(c)) for c in aligner.a.tok.id_to_token(i)) for i in a]
    bytes_b = [aligner.b.bytes[i] for i in b]
    if b"".join(bytes_a) != spaced.encode() or b"".join(bytes_b) != spaced.encode():
        return none

    def spans(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    span_a, span_b = spans(bytes_a), spans(bytes_b)
    links = Counter((a[i], b[j]) for i, (s, e) in enumerate(span_a) for j, (u, v) in enumerate(span_b) if s < v and u < e)
    low, said = 0, []
    for c in sorted({e for _, e in span_a} & {e for _, e in span_b}):
        said.append("|".join(",".join(str(ids[k]) for k, (s, e) in enumerate(span) if low <= s and e <= c) for ids, span in ((a, span_a), (b, span_b))))
        low = c
    return len(a), len(b), len(said), links.total(), hashlib.sha256(";".join(said).encode()).hexdigest(), links


PARTS = ["a", "it's", " ", "  ", "\n", "\n\n", "\t", "x", "é", "12", "!?", " ", "　", "<|endoftext|>", "don't", "\r\n", "\0", "ñ́", "'s", "...", "▁", "word", "The", "ization", "<s>", "<0x41>", "\U0001f642", ";\r", "\u0085"]


def test_aligner_equals_brute_force(aligner):
    rng = random.Random(5)
    texts = [None, "", "▁", " ", "\n"] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(25))) for _ in range(1500)]
    for _ in range(2):  # the second time units are known
        got = aligner.align(pa.array(range(len(texts)), pa.int64()), pa.array(texts)).to_pylist()
        for text, g in zip(texts, got, strict=True):
            links = {(p >> aligner.shift, p & ((1 << aligner.shift) - 1)): n for p, n in zip(g["pairs"], g["times"], strict=True)}
            want = aligned(aligner, text)
            assert (g["n_a"], g["n_b"], g["n_groups"], g["n_links"], g["groups_sha256"], links) == (*want[:5], dict(want[5])), text


def corpus(aligner, rows):
    each = [(d, aligned(aligner, t)) for d, t in rows]
    count = sum((w[5] for _, w in each), Counter())
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return sorted(((d, *w[:4], sum(n for p, n in w[5].items() if count[p] == most[p[1]]), sum(n * count[p] for p, n in w[5].items()), w[4]) for d, w in each), key=str)


def test_corpus_counts_equal_brute_force(spark, aligner, monkeypatch):
    rng = random.Random(6)
    rows = [(1, None), (2, ""), (None, "a null id"), (3, "same words here"), (3, "same words here"), (4, "▁ no tokens"), (5, "long text " * 200)] + [(10 + k, "".join(rng.choice(PARTS) for _ in range(rng.randrange(25)))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(-1) for c in ("pair", "row", "n_a", "pairs", "count", "best")})
    cols = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    for most in (alignment.BROADCAST_PAIRS, 0):
        monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
        found = alignment.align(df, PATH_A, PATH_B).cache()
        got = alignment.with_corpus_sums(found, alignment.pair_counts(found, aligner.shift))
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == corpus(aligner, rows)
    found = alignment.align(df.limit(0), PATH_A, PATH_B)
    assert alignment.with_corpus_sums(found, alignment.pair_counts(found, aligner.shift)).collect() == []


def test_alignment_query_is_whole(spark, sf, aligner):
    got = {r["doc_id"]: r for r in registry.QUERIES["op13_token_alignment"](spark, sf).collect()}
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    assert len(got) == len(rows)
    for d, t in sorted(rows, key=lambda r: len(r[1] or ""))[:60]:
        assert tuple(got[d][c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")) == aligned(aligner, t)[:5]
