"""The corpus operators against brute force, exact round trips and held-out rows."""

import math
import random
import tracemalloc
import warnings
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tonequarry.llm import decontamination, embeddings, html_extract, language_id, language_model, licenses, near_copies, packing, registry, sharding, simhash, token_files, tokens
from tonequarry.llm.common import free, give_back, table, written
from tonequarry.llm.components import connected_components, local_roots, roots_of

#: Rows every text operator must take: nulls, empties, no words, no letters, repeats, long texts.
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "12 34 !?"), (5, "word"), (5, "word"), (None, "a null id"), (6, "long words " * 3000), (7, "x" * 5000), (8, "Under the MIT License. under the mit license"), (9, "été ÀÉ ½")]


def odd(spark):
    """ODD with columns that clash with the operators' own names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    for c in ("n", "row", "ids", "fp", "shard", "words", "score", "part", "h", "component_id", "n_chars"):
        df = df.withColumn(c, F.lit(-1))
    return df


def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, extra int")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return table(spark, sf, "documents").cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def encoded(texts):
    tok = tokens.UnitEncoder(tokens.vocabulary_path()).tok
    return [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_components(spark):
    rng = random.Random(4)
    for n, m in ((40, 30), (200, 190), (60, 59)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(k, k + 1) for k in range(300, 340)]
        got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
        want = union(pairs, {x for p in pairs for x in p})
        assert {k: v for k, v in want.items() if k in got} == got
        assert all(v == k for k, v in want.items() if k not in got)


def test_local_roots():
    rng = np.random.default_rng(2)
    for n, share in ((1, 0.0), (30, 0.02), (60, 0.05), (40, 0.0), (50, 0.5)):
        m = rng.random((n, n)) < share
        m |= m.T
        np.fill_diagonal(m, False)
        want = union(list(zip(*np.nonzero(m), strict=True)), range(n))
        i, j = np.nonzero(m)
        assert local_roots(m).tolist() == roots_of(i, j, n).tolist() == [want[k] for k in range(n)]


def test_unit_encoder_equals_library():
    rng = random.Random(1)
    parts = ["a", "it's", " ", "  ", "\n", "\n\n", "\t", "x", "é", "12", "!?", " ", "　", "<|endoftext|>", "don't", "\r\n", "\0", "ñ́", "'s", "..."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    got = tokens.UnitEncoder(tokens.vocabulary_path(), 50).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == encoded(texts)
    for some in ([], [None], [""], ["\n"], [" "], [None, "a b", "", "\n\n", "a\0b"]):
        got = tokens.UnitEncoder(tokens.vocabulary_path()).encode(some)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == encoded([t or "" for t in some])
    batch = pa.record_batch([pa.array([None, "x" * 9, "y" * 9, "z" * 50, "", "w"])], names=["text"])
    assert [b["text"].to_pylist() for b in tokens.by_size(batch, 20)] == [[None, "x" * 9, "y" * 9], ["z" * 50], ["", "w"]]


# 1


def small_known(vocabulary, classes):
    words = [(b"w%d" % i, 50 - i) for i in range(40)] + [(language_model.END, 60)]
    bins = Counter(language_model.tail_bin(w) for w, _ in words)
    sums = {b: (sum(n for w, n in words if language_model.tail_bin(w) == b), v) for b, v in bins.items()}
    return words, language_model.Known(words, sum(n for _, n in words), len(words), sums, vocabulary, classes)


def test_language_model_is_a_distribution_and_gradients_hold():
    words, k = small_known(20, 5)
    net = language_model.Gru(k, 6)
    for name in net.NAMES:
        setattr(net, name, getattr(net, name).astype(np.float64))
    h = np.random.default_rng(0).standard_normal((1, 6))
    every = np.arange(k.size + language_model.BINS)
    lp = net.log_probs(np.repeat(h, len(every), 0), every)
    assert abs(np.exp(lp).sum() - 1) < 1e-9
    # within a tail class: the known tail tokens and one unseen share
    for b in range(language_model.BINS):
        tail = [10 ** k.tail[i] for i in range(k.size, len(words)) if k.bin[i] == b]
        assert abs(sum(tail) + 0.1 / (k.bin_n[b] + 0.1 * (k.bin_v[b] + 1)) - 1) < 1e-9
    ids = np.array([[1, 30], [2, 5], [7, 3]])
    out = np.array([[2, 5], [7, 3], [25, 0]])

    def loss():
        hs, _ = net.forward(ids, np.zeros((2, 6)))
        return -net.log_probs(hs.reshape(-1, 6).astype(np.float64), out.ravel()).sum()

    hs, gates = net.forward(ids, np.zeros((2, 6)))
    _, d, d_cls, _, d_out, d_out_bias = net.log_probs(hs.reshape(-1, 6).astype(np.float64), out.ravel(), True)
    d_in, d_rec = net.backward(ids, gates, d.reshape(3, 2, 6))
    for weights, grad in ((net.rec, d_rec), (net.cls, d_cls), (net.out, d_out), (net.out_bias, d_out_bias)):
        for at in [np.unravel_index(i, weights.shape) for i in (0, 3, weights.size // 2)]:
            old = weights[at]
            weights[at] = old + 1e-3
            up = loss()
            weights[at] = old - 1e-3
            down = loss()
            weights[at] = old
            assert abs((up - down) / 2e-3 - grad[at]) < 2e-2 * max(1, abs(grad[at]))


def test_language_model_scores(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in language_model.score_documents(docs).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs.collect()}
    held = {d for d in texts if zlib.crc32(str(d).encode()) % 10 == 0}
    c = Counter(w for d, ws in texts.items() if d not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for d, ws in texts.items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (d in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r["base_score"] - sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6 * len(ws)
    assert sum(got[d]["score"] for d in held) > sum(got[d]["base_score"] for d in held)


def test_lanes_carry_state_whole_documents():
    k = small_known(30, 4)[1]
    net, rng = language_model.Gru(k, 8), np.random.default_rng(2)
    texts = [rng.integers(0, 30, n).astype(np.int32) for n in (1, 700, 3, 50, 129, 64, 1)]
    alone = [language_model.lane_scores(net, [t], 1, 10_000)[0] for t in texts]
    assert np.allclose(language_model.lane_scores(net, texts, 3, 16), alone, rtol=1e-4)
    assert language_model.lane_scores(net, []) == []


def test_training_takes_every_token_and_carries_the_state():
    k = small_known(30, 4)[1]
    trainer, rng = language_model.Trainer(language_model.Gru(k, 8)), np.random.default_rng(2)
    docs = [rng.integers(0, 30, n).astype(np.int32) for n in (1, 700, 12, 13, 3000, 24)]
    inner, fed, cleared = trainer.net.forward, [], []

    def forward(ids, h, fresh):
        fed.append(h.copy())
        cleared.append(int(fresh.sum()))
        hs, gates = inner(ids, h, fresh)
        fed.append(hs[-1])
        return hs, gates

    trainer.net.forward = forward
    trainer.run(docs, 3)
    assert trainer.tokens == sum(map(len, docs))
    for before, after in zip(fed[1::2], fed[2::2], strict=False):  # a window begins with the states that the last one ended with
        assert (before[: len(after)] == after).all()
    assert sum(cleared) >= len(docs)  # places beyond a lane's end repeat the first


def test_gradients_stop_where_a_document_begins():
    k = small_known(20, 5)[1]
    net, rng = language_model.Gru(k, 6), np.random.default_rng(1)
    ids = rng.integers(0, 20, (6, 2))
    fresh = np.zeros((6, 2), bool)
    fresh[3, 0] = fresh[0, 1] = True
    h = rng.standard_normal((2, 6)).astype(np.float32)
    hs, gates = net.forward(ids, h, fresh)
    d = rng.standard_normal(hs.shape).astype(np.float32)
    d_in, d_rec = net.backward(ids, gates, d, fresh)
    want, total = np.zeros_like(d_in), np.zeros_like(d_rec)
    for lane, start, stop in ((0, 0, 3), (0, 3, 6), (1, 0, 6)):
        own, begin = ids[start:stop, lane : lane + 1], np.where(fresh[start, lane], 0, h[lane : lane + 1]).astype(np.float32)
        x, r = net.backward(own, net.forward(own, begin)[1], d[start:stop, lane : lane + 1])
        want[start:stop, lane : lane + 1] = x
        total += r
    assert np.allclose(d_in, want, atol=1e-5) and np.allclose(d_rec, total, atol=1e-4)


def test_a_window_is_trained_as_a_plain_adagrad_would():
    k = small_known(30, 12)[1]
    trainer, plain, rng = language_model.Trainer(language_model.Gru(k, 8)), language_model.Gru(k, 8), np.random.default_rng(6)
    for name, a in trainer.net.columns.items():  # a column's weights and bias lie together, and training changes them where they lie
        assert np.shares_memory(a, getattr(trainer.net, name)) and np.shares_memory(a, getattr(trainer.net, name + "_bias"))
    columns = dict(trainer.net.columns)
    docs = [rng.choice([3] * 20 + [*range(60)], 20).astype(np.int32) for _ in range(6)]
    trainer.run(docs, 6, 20)
    assert all(trainer.net.columns[n] is a for n, a in columns.items())
    laid = language_model.Lanes(docs, 6, plain.start, np.random.default_rng(0))
    ((at, real),) = laid.windows(20)
    inp, out, fresh = laid.inp[at], laid.out[at], laid.fresh[at]
    assert real is None and np.bincount(inp.ravel()).max() > language_model.SHORT  # long runs of one id and short ones
    hs, kept = plain.forward(inp, np.zeros((6, 8), np.float32), fresh)
    _, d, *grads = plain.log_probs(hs.reshape(-1, 8), out.ravel(), True)
    d_in, d_rec = plain.backward(inp, kept, d.reshape(hs.shape) / 6, fresh)
    d_inp = np.zeros_like(plain.inp)
    np.add.at(d_inp, inp.ravel(), d_in.reshape(-1, 24))
    want = {"inp": np.clip(d_inp, -1, 1), "rec": np.clip(d_rec, -1, 1)} | {n: g / 6 for n, g in zip(plain.NAMES[2:], grads, strict=True)}
    for name, g in want.items():
        after = getattr(plain, name) - trainer.rate * g / np.sqrt(1e-4 + g * g)
        assert np.allclose(getattr(trainer.net, name), after, atol=1e-4), name


def test_sums_by_id_of_long_and_short_runs():
    rng = np.random.default_rng(7)
    for sizes in ([1], [40], [1, 2, 8, 9, 3, 1, 100, 1, 2], [1] * 5, []):
        ids = np.repeat(np.arange(len(sizes)), sizes)
        rows = rng.standard_normal((len(ids), 6)).astype(np.float32)
        got = language_model._sums_by_id(rows, language_model._begins(ids)) if sizes else np.zeros((0, 6))
        want = np.zeros((len(sizes), 6))
        np.add.at(want, ids, rows)
        assert got.shape == want.shape and np.allclose(got, want, atol=1e-4)


def test_shut_gates_do_not_overflow():
    k = small_known(20, 5)[1]
    net = language_model.Gru(k, 6)
    net.inp[3], net.inp[4] = -1000, 1000
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        hs, _ = net.forward(np.array([[3, 4], [4, 3], [3, 3]]), np.zeros((2, 6), np.float32))
    assert np.isfinite(hs).all() and (hs[0, 0] == -1).all() and (hs[0, 1] == 0).all() and (hs[1] == [[-1], [-1]]).all()


def test_large_logits_stay_a_distribution():
    k = small_known(20, 5)[1]
    net = language_model.Gru(k, 6)
    net.cls *= 2000
    net.out *= 2000
    every = np.arange(k.size + language_model.BINS)
    lp = net.log_probs(np.repeat(np.ones((1, 6), np.float32), len(every), 0), every)
    assert np.isfinite(lp).all() and abs(np.exp(lp.astype(float)).sum() - 1) < 1e-3


def plain_score(net, k, counts, words):
    """log10 probability of a document, one token at a time from the counts and weights."""
    h, ln10, hid = np.zeros(net.hidden), np.log(10), net.hidden
    total, last = 0.0, net.start
    sig = lambda x: 1 / (1 + np.exp(-x))
    for w in words:
        a, g = net.inp[last].astype(float), h @ net.rec
        z, r = sig(a[:hid] + g[:hid]), sig(a[hid : 2 * hid] + g[hid : 2 * hid])
        h = z * h + (1 - z) * np.tanh(a[2 * hid :] + r * g[2 * hid :])
        logits = h @ net.cls + net.cls_bias
        rank, b = k.rank.get(w, -1), language_model.tail_bin(w)
        inside = 0 <= rank < k.size
        c = int(k.cls[rank]) if inside else k.n_classes + b
        total += (logits[c] - np.log(np.exp(logits).sum())) / ln10
        if inside:
            own = slice(k.bounds[c], k.bounds[c + 1])
            x = h @ net.out[:, own] + net.out_bias[own]
            total += (x[rank - own.start] - np.log(np.exp(x).sum())) / ln10
            last = rank
        else:
            total += np.log10((counts.get(w, 0) + 0.1) / (k.bin_n[b] + 0.1 * (k.bin_v[b] + 1)))
            last = k.size + b
    return total


def test_scores_equal_a_plain_recomputation(spark, docs):
    rows = docs.select("doc_id", (language_model.fold_crc("doc_id", 10) == 0).alias("held_out"), "text")
    learned = rows.filter("not held_out")
    counts = language_model.token_counts(learned).cache()
    k = language_model.known(counts, most=600, vocabulary=150, classes=12)
    weights = language_model.train(learned, k, rounds=1, hidden=8)
    net = language_model.Gru(k, 8)
    net.load(weights)
    plain = {bytes(r["word"]): r["n"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in language_model.score(rows, counts, k, weights, hidden=8).collect()}
    assert len(plain) > 2000  # most words are not among the known: their counts are joined
    for r in docs.collect():
        words = language_model.words_of((r["text"] or "").encode())
        if len(words) < 400:
            assert abs(got[r["doc_id"]] - plain_score(net, k, plain, words)) < 1e-3 * len(words), r["doc_id"]


def test_texts_are_looked_up_once_for_training_and_scoring(spark, docs):
    rows = docs.select("doc_id", (language_model.fold_crc("doc_id", 10) == 0).alias("held_out"), "text")
    counts = language_model.token_counts(rows.filter("not held_out")).cache()
    k = language_model.known(counts, most=600, vocabulary=150, classes=12)
    kept = written(language_model.resolved(rows, k), "ids")
    assert "text" not in kept.columns
    texts = {r["doc_id"]: language_model.words_of((r["text"] or "").encode()) for r in docs.collect()}
    got = {r["row"]: r for r in kept.filter("ids is not null").collect()}
    assert len(got) == len(texts) and all(r["word"] is None for r in got.values())
    rare: dict[int, Counter] = {}
    for r in kept.filter("word is not null").collect():
        rare.setdefault(got[r["row"]]["doc_id"], Counter())[bytes(r["word"])] += r["n"]
    for r in got.values():
        words = texts[r["doc_id"]]
        ranks = [k.rank.get(w, -1) for w in words]
        assert np.frombuffer(r["ids"], k.kind).tolist() == [x if 0 <= x < k.size else k.size + language_model.tail_bin(w) for x, w in zip(ranks, words, strict=True)]
        assert abs(r["base"] - sum(k.base[x] for x in ranks if x >= 0)) < 1e-8 * len(words)
        assert abs(r["tail"] - sum(k.tail[x] for x in ranks if x >= k.size)) < 1e-8 * len(words)
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(w in k.rank for w in words))
        assert rare.get(r["doc_id"], Counter()) == Counter(w for w in words if w not in k.rank)
    # what is kept is enough to train and to score, with the results of the texts
    weights = language_model.train_ids(kept.filter("ids is not null and not held_out").select("ids").coalesce(1), k, rounds=1, hidden=8)
    assert np.isfinite(weights).all()
    by_ids = {r["doc_id"]: r["score"] for r in language_model.score_ids(kept, counts, k, weights, hidden=8).collect()}
    by_text = {r["doc_id"]: r["score"] for r in language_model.score(rows, counts, k, weights, hidden=8).collect()}
    assert by_ids.keys() == by_text.keys() and all(abs(by_ids[d] - by_text[d]) < 1e-6 * len(texts[d]) for d in texts)


def test_words_of_a_column_are_those_of_each_text():
    odd_texts = [None, b"", b" ", b"\n", b"a", b" A\tb\x0b\x0cC\r\n", b"x\x1c\x1dy\x85z\xa0 \xff\xfe Q", "É\u00a0\u2003 Ünd\u0085X".encode(), b"\x00 \x00Z", b"end "]
    rng = np.random.default_rng(4)
    odd_texts += [bytes(rng.choice(np.frombuffer(b" \t\n\x0b\x0c\r\x1f\x80\xc3\xa9AZaz[@", np.uint8), n)) for n in range(60)]
    for kind in (pa.binary(), pa.large_binary()):
        texts = pa.array(odd_texts, kind)
        for cut in (texts, texts.slice(3, 20), texts.slice(0, 0), texts.slice(1, 3)):
            words, size = language_model.split_words(cut)
            plain = [language_model.words_of(t)[:-1] for t in cut.to_pylist()]
            assert words.to_pylist() == [w for ws in plain for w in ws] and size.tolist() == [len(ws) for ws in plain]


def test_sorted_targets_give_the_gradients_of_a_plain_softmax():
    k = small_known(30, 25)[1]  # most classes hold one token
    assert (np.diff(k.bounds) == 1).any() and (np.diff(k.bounds) > 1).any()
    net, rng = language_model.Gru(k, 6), np.random.default_rng(5)
    hs, ids = rng.standard_normal((400, 6)).astype(np.float32), rng.integers(0, k.size + language_model.BINS, 400)
    lp, d_h, d_cls, d_cls_bias, d_out, d_out_bias = net.log_probs(hs, ids, True)
    assert np.allclose(lp, net.log_probs(hs, ids), atol=1e-5)
    want = [np.zeros(x.shape) for x in (lp, d_h, d_cls, d_cls_bias, d_out, d_out_bias)]
    for i, (h, t) in enumerate(zip(hs.astype(float), ids.tolist(), strict=True)):
        c = int(k.cls[t]) if t < k.size else t - k.size + k.n_classes
        lo, hi = (int(k.bounds[c]), int(k.bounds[c + 1])) if t < k.size else (0, 0)
        for w, bias, own, d_w, d_b, cut in ((net.cls, net.cls_bias, c, want[2], want[3], slice(None)), (net.out, net.out_bias, t - lo, want[4], want[5], slice(lo, hi))):
            x = h @ w[:, cut] + bias[cut]
            if len(x):
                p = np.exp(x - x.max())
                p /= p.sum()
                want[0][i] += np.log(p[own])
                p[own] -= 1
                want[1][i] += w[:, cut] @ p
                d_w[:, cut] += np.outer(h, p)
                d_b[cut] += p
    for got, plain in zip((lp, d_h, d_cls, d_cls_bias, d_out, d_out_bias), want, strict=True):
        assert got.shape == plain.shape and np.allclose(got, plain, atol=2e-4)


def test_one_long_document_does_not_widen_the_lanes():
    k = small_known(30, 4)[1]
    net, rng = language_model.Gru(k, 8), np.random.default_rng(2)
    texts = [rng.integers(0, 30, n).astype(np.int32) for n in [20_000] + [5] * 255]
    tracemalloc.start()
    language_model.lane_scores(net, texts)
    assert tracemalloc.get_traced_memory()[1] < 20e6  # a matrix of lanes by steps would take 17 bytes by 256 by 20,000
    tracemalloc.stop()


def test_language_model_odd_rows(spark):
    got = language_model.score_documents(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert language_model.score_documents(nothing(spark)).count() == 0


# 2


def test_language_id(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.op2_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_mixture_and_odd_rows(spark, docs):
    model = language_id.learn(docs)
    texts = defaultdict(str)
    for r in docs.collect():
        texts[r["lang"]] += " " + r["text"]
    (a, sa, *_), (b, sb, mixture, _) = model([" ".join(texts["en"].split()[:300] + texts["fr"].split()[:100]), " ".join(texts["en"].split()[:100] + texts["fr"].split()[:300])])
    assert [k for k, _ in mixture] == ["fr", "en"] and abs(sum(x for _, x in mixture) - 1) < 1e-5
    assert (a, b) == ("en", "fr") and 0.6 < sa < 0.9 and 0.6 < sb < 0.9
    got = {r["doc_id"]: r for r in language_id.predict(odd(spark), model, "doc_id").collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (1, 2, 3, 4))
    kept = language_id.keep_identified(odd(spark), model)
    # the four without a letter go, and five thousand times the letter x
    assert kept.columns == odd(spark).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 5, 5, 6, 8, 9]
    assert language_id.predict(nothing(spark), model, "doc_id").count() == 0
    none = language_id.learn(nothing(spark))
    assert none(["text"]) == [language_id.Found()]
    assert language_id.keep_identified(odd(spark), none).count() == len(ODD) - 4
    odd_texts = spark.createDataFrame([(1, "xkqzj wvbnq zzzx qqkx jjwq", None), (2, texts["de"][:300], ""), (3, "ぶんしょうのなかに", "x")], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in language_id.keep_identified(odd_texts, model).collect()] == [2]
    assert language_id.learn(odd_texts).names == ["", "x"] and language_id.learn(odd_texts, 1).names == [""]


def plain_mixture(model, text):
    """The mixture of one text word by word, and the best of all sets of languages by penalised likelihood."""
    from itertools import combinations

    words = []
    low = (text or "").lower()
    for k, c in enumerate(low):
        if c.isalpha():
            around = [ord(x) if x.isalpha() else 0 for x in (low[k - 1] if k else " ", c, low[k + 1] if k + 1 < len(low) else " ")]
            b = (around[0] * 1_000_003 + around[1] * 8_191 + around[2] * 131_071 * 31) * 0x9E3779B1 >> 13 & language_id.BINS - 1
            if not around[0]:
                words.append(np.zeros(len(model.names)))
            words[-1] = words[-1] + model.log_p[b].astype(np.float64)
    if not words:
        return "und", 0.0
    ll = np.array(words)

    def em(langs):
        like = np.exp(ll[:, langs] - ll.max(axis=1, keepdims=True))
        pi = np.full(len(langs), 1 / len(langs))
        for _ in range(language_id.ROUNDS):
            part = like * pi
            pi = (part / np.maximum(part.sum(axis=1, keepdims=True), 1e-30)).mean(axis=0)
        return np.log(np.maximum((like * pi).sum(axis=1), 1e-30)).sum(), pi

    best = []
    for k in range(1, len(model.names) + 1):
        for langs in combinations(range(len(model.names)), k):
            value, pi = em(list(langs))
            best.append((value - (k - 1) * (0.5 * np.log(len(ll)) + language_id.SET_COST), model.names[langs[int(pi.argmax())]], float(pi.max())))
    _, lang, share = max(best)
    return lang, share


def test_language_mixture_equals_a_search_of_all_sets(spark, docs, rows):
    model = language_id.learn(docs)
    rng, texts = random.Random(4), [t for _, t in rows if len(t) < 3000]
    texts = texts[:60] + [" ".join(" ".join(rng.choice(texts).split()[: rng.randint(3, 60)]) for _ in range(rng.randint(2, 3))) for _ in range(60)]
    got, want = model(texts), [plain_mixture(model, t) for t in texts]
    same = [g.lang == w[0] and abs(g.score - w[1]) < 2e-3 for g, w in zip(got, want, strict=True)]
    assert sum(same) >= 0.97 * len(texts)  # sets are sought in the order of their languages' shares, not all of them
    assert all(g.lang == w[0] for g, w in zip(got[:60], want[:60], strict=True))


# 3


def license_words(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_licenses(spark, docs, rows):
    extra = [(900, "Released under the MIT License, or CC-BY-NC; Apache License, Version 2.0. under the mit license"), (901, "K under the mİt license"), (902, "Permission is hereby granted free of charge to all and any person obtaining a copy of this software and its associated documentation files (the Software), to deal in the Software without restriction")]
    got = {r["doc_id"]: r for r in licenses.scan(docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))).collect()}
    for d, t in [*rows, *extra]:
        ws, at, labels = license_words(t), [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            here = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        r = got[d]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
        assert labels <= set(filter(None, r["labels"].split(",")))
    assert got[902]["labels"] == "mit" and got[902]["n_base"] == 0


def test_licenses_odd_rows_and_plan(spark):
    got = licenses.scan(odd(spark)).collect()
    assert len(got) == len(ODD)  # repeated rows and null ids are rows of their own
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n_words"] == 0 and by[8]["n_base"] == 2 and by[8]["last_word"] == 4
    assert licenses.scan(nothing(spark)).count() == 0
    plan = licenses.scan(odd(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_votes_are_distinct_places_and_rows_stay_rows(spark):
    apache, cc = licenses.NOTICES[1][1], "this work is licensed under a creative commons attribution 4 0 international license"
    texts = ["of this software " * 20, "the license you may " * 12, f"{cc} " + "creative commons attribution 4 0\n" * 10, "apache license version", "apache license version", apache.replace("the license", "this same license"), "creative commons attribution 4 0 " * 10]
    got = {}
    for r in licenses.scan(spark.createDataFrame([(k // 2 if k in (2, 3) else None if k in (4, 5) else k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["labels"], r["n_base"]))
    assert got[0] == [("", 0)] and got[6] == [("cc-by", 0)]
    assert sorted(got[1]) == [("", 0), ("", 0), ("cc-by", 0)]  # the twelvefold line, and two texts under one id
    assert sorted(got[None]) == [("", 0), ("apache-2", 0)]
    spans = licenses.scan(spark.createDataFrame([(1, f"one two {apache} end")], "doc_id long, text string")).first()["spans"]
    assert [(s["label"], s["first"], s["last"], s["score"]) for s in spans] == [("apache-2", 2, 1 + len(apache.split()), 1.0)]


def test_license_scan_of_a_long_text_is_linear(spark):
    import time

    def took(n):
        df = spark.createDataFrame([(1, " ".join(f"w{k % 977}" for k in range(n)))], "doc_id long, text string")
        at = time.perf_counter()
        assert licenses.scan(df).first()["n_words"] == n
        return time.perf_counter() - at

    took(1000)
    assert took(400_000) < 4 * took(100_000) + 4


def test_short_license_notices(spark):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the GNU General Public License version 2 or later": "gpl",
        "Licensed under the GNU Lesser General Public License, version 2.1": "lgpl",
        "This program is licensed under the GNU Affero General Public License v3": "agpl",
        "The MIT License (MIT)": "mit",
        "Licensed under MIT.": "mit",
        "Licensed under the Apache License 2.0": "apache-2",
        "Text is under CC BY 4.0.": "cc-by",
        "Licensed under Creative Commons Attribution 4.0": "cc-by",
        "Creative Commons Attribution-NonCommercial": "cc-by-nc",
        "Creative Commons Attribution Non-Commercial 4.0": "cc-by-nc",
        "Licensed under the Apache License, Version 1.1": "",
    }
    rows = list(enumerate(lines))
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame([(k, f"Some words first. {t} And then more words.") for k, t in rows], "doc_id long, text string")).collect()}
    assert {t: got[k] for k, t in rows} == lines


# 4


def check_packing(pieces, texts):
    ids = dict(zip([d for d, _ in texts], [i + [1] for i in encoded([t for _, t in texts])], strict=True))
    by, seqs = defaultdict(list), defaultdict(list)
    for r in pieces:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    assert by.keys() == ids.keys()
    for d, own in by.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            cut = ids[d][at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids[d]) and r["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids[d])
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    return sum(map(len, ids.values())) / (2048 * len(seqs))


def test_packing(spark, docs, rows):
    assert check_packing(packing.pack(docs).collect(), rows) > 0.98
    assert check_packing(packing.pack(docs.repartition(7), open_windows=3, merged_partitions=2).collect(), rows) > 0.85
    got = packing.pack(odd(spark)).collect()
    assert Counter(r["doc_tokens"] for r in got if r["doc_id"] in (1, 2)) == {1: 2}
    assert sum(r["doc_id"] == 5 for r in got) == 2 and sum(r["doc_id"] is None for r in got) == 1
    assert packing.pack(nothing(spark)).count() == 0


def test_packer_emits_the_fullest():
    out = []
    p = packing.OnlinePacker(10, 2, out.append)
    for name, size in (("a", 6), ("b", 5), ("c", 4), ("d", 9), ("e", 8)):
        p.add((name,), size)
    assert out == [[("a",), ("c",)], [("d",)]] and sorted(map(len, p.leftovers())) == [1, 1]


# 5


def test_html():
    page = """<html><head><title>No</title></head><body><nav><a>Home</a></nav><div class="ad">Buy now</div>
    <article><h1>A &amp; B</h1><p>First  part<br>goes on &lt;here&gt;, with many words</p><div class="newsletter"><form>Sign up</form></div>
    <p>Second <b>bold</b> part has <a href='x'>some link</a> words<p>Third unclosed</article><script>var t="</p>";</script>
    <section id="comments"><p>reader says a lot of things about this text and goes on about it</p></section><footer>&copy; us</footer></body></html>"""
    assert html_extract.extract(page) == "A & B\n\nFirst part goes on <here>, with many words\n\nSecond bold part has some link words\n\nThird unclosed"
    for odd_page in (None, "", "   ", "<p", "<script>x", "<!-- a", "</p></p>", "<nav>a</nav>"):
        assert html_extract.extract(odd_page) == ""
    assert html_extract.extract("plain text only") == "plain text only"
    assert len(html_extract.extract("<p>" + "word " * 100_000).split()) == 100_000


def test_html_keeps_the_article_whatever_its_names():
    body, more = "<h1>Title</h1><p>Many words of an article stand here and go on for a while.</p>", "<p>More words that belong to the article too, and some.</p>"
    want = "Title\n\nMany words of an article stand here and go on for a while.\n\nMore words that belong to the article too, and some."
    for page in (
        f'<div class="post tag-news">{body}{more}</div>',
        f'<div class="page social-article">{body}{more}</div>',
        f'<article>{body}<p class="more">{more[3:]}</article>',
        f'<article><div class="header"><h1>Title</h1></div>{body[14:]}{more}</article>',
        f'<article>{body}<div class="side-by-side">{more}</div></article>',
        f'<div class="layout has-sidebar"><nav>x y</nav>{body}{more}<div class="sidebar">not this</div></div>',
        f"<form>{body}{more}</form>",
        f'<article>{body}<div class="newsletter">sign up</div>{more}<div class="social-share">share</div></article><section id="comments"><article><p>{"a reader says " * 40}</p></article></section>',
        f'<div class="ad-slot">buy</div><div class="content">{body}{more}</div><div class="comment-thread"><p>{"a reader says " * 40}</p></div>',
    ):
        assert html_extract.extract(page) == want, page


def test_best_region_equals_all_regions():
    rng = random.Random(3)
    for _ in range(400):
        x = [rng.choice((-3, -1, -0.5, 0, 0.5, 1, 2)) for _ in range(rng.randrange(14))]
        first, stop = html_extract.best_region(x)
        assert sum(x[first:stop]) == max([0.0, *(sum(x[a:b]) for a in range(len(x)) for b in range(a, len(x) + 1))])


def test_html_extract_equals_a_search_of_all_regions():
    rng = random.Random(8)
    parts = ["<p>some words here</p>", "<nav><a>x</a></nav>", "<div class='ad'>buy now</div>", "<h2>head</h2>", "<a>one</a>", "<ul><li>item of words</li></ul>", "</div>", "<table><tr><td>1</td></tr></table>", "text"]
    for _ in range(150):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        p = html_extract.Page(page)
        told, out = html_extract.keys(p, html_extract.WEIGHTS)
        scores = html_extract.scores(p, told, html_extract.WEIGHTS)
        all_ = [(round(sum(scores[a:b]), 9), -a, -b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1) if sum(scores[a:b]) > 1e-9]
        first, stop = (-max(all_)[1], -max(all_)[2]) if all_ else (0, 0)
        words = " ".join(t for (kind, _, t, _), o in zip(p.tokens[first:stop], out[first:stop], strict=True) if kind == "word" and not o).split()
        assert html_extract.extract(page).split() == words


def test_html_work_is_linear():
    import time

    for junk in ("<div></b>", "<select>", "<header>", '<p <a "', "<b><i></u>", "<article></div>"):
        at = time.perf_counter()
        html_extract.extract(junk * 16_000)
        assert time.perf_counter() - at < 1, junk


def test_html_pages(spark, sf):
    got = {r["page_id"]: r for r in html_extract.op5_html(spark, sf).collect()}
    import html
    import re

    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1].replace("<br>", " ")
        want = "\n\n".join(t for b in re.split(r"</?(?:p|h1)>", inner) if (t := " ".join(html.unescape(re.sub("<[^>]*>", "", b)).split())))
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    odd_pages = spark.createDataFrame([(1, None, None), (None, "u", ""), (1, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert html_extract.extract_pages(odd_pages).filter("text = '' and n_chars = 0").count() == 3


# 6


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(spark, sf, rows, tmp_path):
    got = sharding.op6_sharding(spark, sf).collect()
    texts = dict(rows)
    slots = defaultdict(list)
    for r in got:
        key = xxhash.xxh64_intdigest(int(r["doc_id"]).to_bytes(8, "little", signed=True), 42)
        raw = texts[r["doc_id"]].encode()
        assert (r["shard"], r["grown_shard"], r["size"], r["text_crc32"], r["law"]) == (jump(key, 16), jump(key, 17), len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    odd_got = sharding.shard_plan(odd(spark)).collect()
    assert len(odd_got) == len(ODD) and len({r["shard"] for r in odd_got if r["doc_id"] == 5}) == 1
    assert sharding.shard_plan(nothing(spark)).count() == 0
    sharding.write_shards(table(spark, sf, "documents"), f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)


# 7


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, docs, rows, tmp_path, bits):
    folder = f"file://{tmp_path}/planes"
    manifest = token_files.write_token_files(docs, folder, bits=bits, file_ids=40_000)
    got = sorted(token_files.read_token_files(manifest, folder).collect())
    at = 0
    rows = sorted(rows)
    for r, (d, _), ids in zip(got, rows, encoded([t for _, t in rows]), strict=True):
        ids = [*ids, 0]
        assert tuple(r) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_file_ranges_and_odd_rows(spark, tmp_path):
    import pyarrow.fs as pafs

    rng = np.random.default_rng(0)
    ids = [rng.integers(0, 1 << 32, n).astype("<u4") for n in (1, 70_000, 5, 140_000, 0, 9)]
    out = pafs.LocalFileSystem()
    w = token_files.PlaneWriter(out.open_output_stream(f"{tmp_path}/f"), block_ids=1000)
    for k, x in enumerate(ids):
        w.add(k, x.tobytes())
    assert w.close() == sum(map(len, ids))
    with out.open_input_file(f"{tmp_path}/f") as src:
        r = token_files.PlaneReader(src)
        flat = np.concatenate(ids)
        for a, b in ((0, 1), (999, 1001), (5, 5), (70_000, 200_123), (0, len(flat))):
            assert (r.read_ids(a, b) == flat[a:b]).all()
        assert [(d, len(x) // 4) for d, x in r.documents()] == [(k, len(x)) for k, x in enumerate(ids)]
    folder = f"file://{tmp_path}/odd"
    got = token_files.read_token_files(token_files.write_token_files(odd(spark), folder), folder).collect()
    assert len(got) == len(ODD) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {1}
    folder = f"file://{tmp_path}/none"
    assert token_files.read_token_files(token_files.write_token_files(nothing(spark), folder), folder).count() == 0


def test_token_files_end_at_a_number_of_documents(spark, tmp_path):
    folder = f"file://{tmp_path}/small"
    df = spark.createDataFrame([(k, None) for k in range(10)], "doc_id long, text string").coalesce(1)
    manifest = token_files.write_token_files(df, folder, file_docs=2)
    assert max(r["n_docs"] for r in manifest.collect()) == 2
    got = sorted(tuple(r) for r in token_files.read_token_files(manifest, folder).collect())
    assert got == [(k, k, 1, zlib.crc32(bytes(4))) for k in range(10)]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from tonequarry.llm.common import shared_dir

    def session(master):
        unset = SimpleNamespace(isDefined=lambda: False)
        context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)

    assert shared_dir(session("local[4]")).startswith("file://")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))


# 8


def edits_to_span(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != x)))
        row = new
    return min(row)


def test_best_span_equals_plain_alignment():
    rng = np.random.default_rng(3)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 8)), rng.integers(0, 4, rng.integers(0, 15))
        edits, a, b = decontamination.best_span(item, text)
        assert edits == edits_to_span(item.tolist(), text.tolist())
        row = edits_to_span(item.tolist(), text[a:b].tolist())
        assert row == edits


def test_decontamination(spark):
    rng = random.Random(5)
    common = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(rng.choices(common, k=rng.choice((3, 5, 9, 15, 30, 50))))) for k in range(40)]
    items += [(40, items[0][1]), (41, None), (42, "!!")]
    texts = []
    for k in range(300):
        body = rng.choices(common, k=rng.randrange(0, 120))
        if k % 2:
            words = rng.choice(items[:40])[1].split()
            for _ in range(rng.randint(0, len(words) // 5)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice(([], [rng.choice(common)], [words[at], "new"]))
            at = rng.randint(0, len(body))
            body[at:at] = words
        texts.append((k, ", ".join(body).title() if k % 3 else "\n".join(body)))
    want = set()
    for d, t in texts:
        ws = [w.decode() for w in decontamination.words_of(t.encode())]
        for i, x in items:
            own = [w.decode() for w in decontamination.words_of((x or "").encode())]
            if own and edits_to_span(own, ws) <= len(own) // 5:
                want.add((d, i))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(docs, bench).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 50
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.contamination(docs, bench, items_at_once=7).collect()} <= want
    kept = {r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect()}
    assert kept == {d for d, _ in texts} - {d for d, _ in got}


def test_decontamination_of_the_tables(spark, sf, rows):
    bench = {r["item_id"]: r["text"] for r in table(spark, sf, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.op8_decontamination(spark, sf).collect()}
    assert {(d, i) for d, t in rows for i, x in bench.items() if x in t} <= got
    bench_df = table(spark, sf, "benchmark")
    kept = decontamination.drop_contaminated(odd(spark), bench_df)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)
    assert decontamination.contamination(nothing(spark), bench_df).count() == 0
    assert decontamination.contamination(odd(spark), bench_df.limit(0)).count() == 0


def test_decontamination_of_the_tables_equals_every_alignment(spark, sf, rows):
    bench = [(r["item_id"], decontamination.words_of((r["text"] or "").encode())) for r in table(spark, sf, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["edits"]) for r in decontamination.op8_decontamination(spark, sf).collect()}
    want = {}
    for d, t in rows:
        ws = decontamination.words_of(t.encode())
        here = set(ws)
        for i, item in bench:
            if not item or len(item) - sum(w in here for w in item) > len(item) // 5:
                continue  # a word that is nowhere in the text is an edit
            vocab = {}
            number = lambda x, v=vocab: np.array([v.setdefault(w, len(v)) for w in x], np.int64)
            edits, a, b = decontamination.best_span(number(item), number(ws))
            if edits <= len(item) // 5:
                want[d, i] = a, b - a, edits
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) > 2
    assert all(got[k][2] == want[k][2] for k in got)


def test_short_items_of_common_words(spark):
    import time

    text = "of the and to " * 20_000
    items = decontamination.Items([(1, b"the"), (2, b"of the"), (3, b"and to of the"), (4, b"the of"), (5, b"x")])
    at = time.perf_counter()
    got = items.search([text.encode(), b"the x", None])
    assert time.perf_counter() - at < 2
    assert [(x, items.ids[i], start, n, edits) for x, i, start, n, edits in got] == [(0, 1, 1, 1, 0), (0, 2, 0, 2, 0), (0, 3, 2, 4, 0), (1, 1, 0, 1, 0), (1, 5, 1, 1, 0)]


# 9


def test_embeddings(spark):
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((25, 16))
    x = [(c + rng.standard_normal(16) * rng.choice((0.05, 0.2, 0.35))).astype(np.float32).tolist() for c in centres[rng.integers(0, 25, 700)]]
    x += [x[0]] * 40 + [[0.0] * 16, None, [], [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8]
    data = [(i, v) for i, v in enumerate(x)] + [(None, x[0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rep", F.lit(0)).withColumn("links", F.lit(1)).withColumn("label", F.lit(None).cast("int"))
    got = {r["vec_id"]: r for r in embeddings.embedding_groups(df, block=64).collect()}
    n = 740
    m = np.array(x[:n], np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    want = union(list(zip(*np.nonzero(near), strict=True)), range(n))
    assert near.sum() > 1000
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (near[i].sum(), want[i], want[i] == i) for i in range(n))
    for i in range(n, n + 6):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[n + 6]["n_links"] == got[n + 7]["n_links"] == 1
    assert (got[None]["n_links"], got[None]["component_id"], got[None]["kept"]) == (0, None, False)
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


def test_pairs_at_the_threshold_are_told_by_whole_vectors(spark):
    rng, rows = np.random.default_rng(11), []
    for k in range(60):  # pairs whose cosine is the threshold to within a few units of the last places
        x = rng.standard_normal(8)
        y = rng.standard_normal(8)
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        c = 0.9 + rng.choice((-1, 1)) * 10.0 ** -rng.integers(4, 13)
        rows += [(2 * k, x.tolist()), (2 * k + 1, (c * x + math.sqrt(1 - c * c) * y).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embeddings.embedding_groups(df).collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    cos = m @ m.T
    np.fill_diagonal(cos, 0)
    assert all(got[i] == (cos[i] >= 0.9).sum() for i in range(len(rows)) if abs(cos[i] - 0.9).min() > 1e-14)


# 10


def plain_fingerprint(text):
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_covering_masks_cover():
    rng, masks = random.Random(1), simhash.covering_masks()
    assert len(masks) == 15
    for _ in range(3000):
        diff = 0
        for b in rng.sample(range(64), rng.randint(0, 3)):
            diff |= 1 << b
        assert any(not diff & m for m in masks)


def test_simhash(spark, sf, rows):
    got = {r["doc_id"]: r for r in simhash.op10_simhash(spark, sf).collect()}
    fp = {d: plain_fingerprint(t) for d, t in rows}
    ids = sorted(fp)
    want = union([(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3], ids)
    assert all((got[d]["fingerprint"], got[d]["component_id"]) == (f"{fp[d]:016x}", want[d]) for d in ids)


def test_near_links_span_dense_groups(spark):
    rng = random.Random(9)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for c in [rng.getrandbits(64) for _ in range(6)]:
        fps |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)}
    signed = [simhash._signed(x) for x in sorted(fps)]
    for block in (16, 1024):
        links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block).collect()
        want = union([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3], signed)
        assert union([tuple(r) for r in links], signed) == want


def rows_made(spark, run):
    """The most rows that any operator of the plans run meanwhile made."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most, every = 0, store.executionsList()
    for k in range(before, store.executionsCount()):
        at = every.apply(k).executionId()
        values, nodes = store.executionMetrics(at), store.planGraph(at).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = node.metrics()
            for m in (metrics.apply(i) for i in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_near_links_make_a_row_for_each_table(spark):
    """Neither a dense group nor buckets that fill up by chance make more rows than two, itself and a link, for a fingerprint in a table."""
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    dense = [centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    for fps, block in ((rng.sample(dense, 1500), 16), ([rng.getrandbits(64) for _ in range(1500)], 16)):
        df = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
        assert rows_made(spark, lambda df=df, block=block: simhash.near_links(df, 7, block, 2).count()) <= 2 * 30 * len(fps)


def test_near_links_of_large_buckets_equal_all_pairs(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(30) for _ in range(1500)}  # one half of the bits is the same: buckets of all of them, and most are in no dense group
    for c in [rng.getrandbits(40) for _ in range(8)]:
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(100)}
    signed = [simhash._signed(x) for x in sorted(fps)]
    x = np.array(signed).view(np.uint64)
    for radius, parts, block in ((7, 2, 16), (3, 1, 64), (7, 2, 1024)):
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)
        want = union([(signed[p], signed[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True) if p < q], signed)
        links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3), radius, block, parts).collect()
        assert union([tuple(r) for r in links], signed) == want and len(set(want.values())) > 5


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    kept = simhash.drop_near_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 5, None} <= set(ids) and 2 not in ids
    assert simhash.near_duplicates(nothing(spark)).count() == 0
    assert simhash.drop_near_duplicates(nothing(spark)).count() == 0


def five_word_sets(rows):
    out = {}
    for d, t in rows:
        w = t.encode().lower().split()
        out[d] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    return out


def near_copy_groups(rows):
    sets = five_word_sets(rows)
    ids = sorted(sets)
    return union([(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])], ids)


def test_near_duplicate_stage_keeps_one_of_each_group_of_similarity(spark, docs, rows):
    rng, words = random.Random(5), [f"w{i}" for i in range(500)]
    common, more = "a line that stands in very many of the texts", []
    for k in range(40):
        base = rng.choices(words, k=rng.randint(8, 200)) + common.split()
        for _ in range(rng.randint(1, 8)):  # copies on both sides of the bound
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            more.append((10_000 + len(more), " ".join(copy)))
    for some in (rows, [*rows, *more]):
        kept = {r[0] for r in simhash.drop_near_duplicates(spark.createDataFrame(some, "doc_id long, text string")).collect()}
        assert kept == set(near_copy_groups(some).values())


def test_near_duplicate_stage_loses_no_text(spark):
    texts = [(1, "one text of its own here"), (1, "quite another text under the same id"), (None, "a text without an id"), (None, "and another text without an id at all"), (None, "a text without an id"), (2, "a text without an id"), (3, None), (None, ""), (4, "one text of its own here"), (4, "one text of its own here")]
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in simhash.drop_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert kept == sorted([("1", texts[0][1]), ("1", texts[1][1]), ("None", texts[3][1]), ("2", texts[2][1]), ("3", "")])


def test_near_copies_in_blocks_equal_all_pairs(spark):
    rng, words = random.Random(6), [f"w{i}" for i in range(300)]
    base, rows = rng.choices(words, k=90), []
    for k in range(150):  # a dense group in which few are linked to any one of them
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((k, " ".join(copy)))
    want = near_copy_groups(rows)
    got = defaultdict(set)
    for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=16, dealt=8).collect():
        got[r["component"]].add(r["doc_id"])
    by = defaultdict(set)
    for d, g in want.items():
        by[g].add(d)
    assert 1 < len(by) < 150 and sorted(map(sorted, got.values())) == sorted(map(sorted, by.values()))


def test_covering_masks_of_halves_cover():
    rng, masks = random.Random(3), simhash.covering_masks(7, parts=2)
    assert len(masks) == 30
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7)))
        assert any(not diff & m for m in masks)


def test_near_copies_meet_by_fingerprints(spark, monkeypatch):
    """What the covering tables find is linked without the rest's join, and nothing else is."""
    rng, words = random.Random(8), [f"w{i}" for i in range(2000)]
    rows = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(60, 300))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: near_copies.shingle_set(t.encode()) for d, t in rows}
    fp = {d: sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in s) > len(s)) for d, s in sets.items()}
    alike = lambda a, b: 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))
    want = union([(a, b) for a in sets for b in sets if a < b and (fp[a] ^ fp[b]).bit_count() <= 7 and alike(a, b)], sets)
    assert {d: near_copies.fingerprint_of(s) for d, s in sets.items()} == fp
    every = near_copies.near_copies(df).collect()
    monkeypatch.setattr(near_copies, "_members", lambda nodes, f=near_copies._members: f(nodes.limit(0)))
    met = near_copies.near_copies(df).collect()
    groups = lambda got: sorted(sorted(r["doc_id"] for r in got if r["component"] == c) for c in {r["component"] for r in got})
    assert groups(met) == sorted(sorted(d for d in want if want[d] == c) for c in set(want.values()))
    assert 40 <= len(groups(every)) < len(groups(met)) < len(rows)


# pipeline


def test_heap_is_given_back(spark):
    """A step's heap goes back once its tables are freed."""
    beans = lambda: sum(b.getCollectionCount() for b in spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    made, collected = written(spark.range(1000).select(F.col("id").alias("a")), "heap"), beans()
    free(made)
    assert beans() >= collected + 2  # the driver's and an executor's, one process here
    give_back(spark)
    assert beans() >= collected + 3


def test_pipeline(spark, sf, docs, rows):
    """Every stage by brute force on its own input: rejected texts, groups of five-word similarity, items found, packed ids."""
    import corpus_pipeline

    out = corpus_pipeline.run(spark, sf).collect()
    model = language_id.learn(docs)
    identified = [(d, t) for (d, t), f in zip(rows, model([t for _, t in rows]), strict=True) if f.lang != "und" and f.evidence >= language_id.UNSEEN_SHARE * model.unseen]
    assert {d for d, _ in identified} == {d for d, t in rows if any(c.isalpha() for c in t)}  # nothing but texts without a letter here
    firsts = set(near_copy_groups(identified).values())
    leaked = {r["doc_id"] for r in decontamination.op8_decontamination(spark, sf).collect()}
    check_packing(out, [(d, t) for d, t in rows if d in firsts - leaked])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "packing"]


# SQL


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_corpus_query_equals_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    want = con.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    cols = sorted(names)
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in want.fetchall()]
    got = registry.QUERIES[name](spark, sf)
    assert sorted(got.columns) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str) == sorted(want, key=str)


def test_token_files_are_read_on_heaps_that_were_given_back(spark, sf, monkeypatch):
    done = []
    for name in ("write_token_files", "give_back", "read_token_files"):
        monkeypatch.setattr(token_files, name, lambda *a, name=name, f=getattr(token_files, name), **k: (done.append(name), f(*a, **k))[1])
    token_files.op7_token_files(spark, sf)
    assert done == ["write_token_files", "give_back", "read_token_files"]
