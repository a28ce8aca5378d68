"""A gated recurrent language model that scores whole documents, with a unigram base beside it.

Tokens are the words of a text (runs without ASCII white space, A-Z lower-cased), then one end. The
counts of all training tokens give the base and the model's vocabulary. The model is a GRU in
numpy; its output softmax is factored: a class of the next token first, then the token within the
class. The ``vocabulary`` most frequent tokens are dealt over ``classes`` classes of about equal mass.
Every other token belongs to one of ``bins`` tail classes by its last two bytes; within such a class its
probability comes from the counts of the whole corpus, (c+0.1)/(n+0.1(v+1)), so unseen words have a share too.

Training is truncated backpropagation over every token of every training document, window by
window, the state carried from a document's start to its end. Each task trains a copy on its rows and
the copies are averaged by their tokens (two levels, in blocks of weights); then the next round begins.
A round that didn't see each training token once is an error. The weights depend on how rows are dealt
over tasks, as any training in parts does; counts and base don't. Scoring carries the state through the
whole document too: in both, documents are laid end to end in lanes of a matrix, and a lane's state is
cleared where a document begins.

Null and empty texts have the end alone. A null doc_id has crc32 zero, so it is held out. Repeated
rows are rows. Very long texts are one stretch of a lane: memory is linear in the ids. Ties in
frequency go to the smaller word. With no training text every token has the share of an unseen
one. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import copy
import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import fold_crc, table, written
from tonequarry.llm.tokens import by_size

FOLDS, END = 10, b"\n"
KNOWN, VOCABULARY, CLASSES, BINS, HIDDEN = 131_072, 4096, 64, 32, 32
WINDOW, ROUNDS, LANES_TRAINED, RATE = 20, 2, 96, 0.12
#: Logits up to this need no shift: their exponentials and sums stay in single precision.
SAFE = 60
#: ``SPLIT``: bytes of text split at once (one text at least), ``HELD_WORDS``: words counted at once.
#: ``SHORT``: rows of one id that are added place by place; ``STEPPED``: rows of weights changed at once.
SHORT, STEPPED = 8, 512
LANES, BUFFER, HELD_WORDS, SPLIT, WEIGHT_BLOCKS = 256, 1 << 21, 1 << 22, 1 << 23, 32


def tail_bin(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BINS


def tail_bin_column(word: str):
    """``tail_bin`` in the JVM."""
    return (F.crc32(F.substring(word, F.greatest(F.octet_length(word) - 1, F.lit(1)), F.lit(2))) % BINS).cast("int")


def words_of(text: bytes | None) -> list[bytes]:
    """A text's tokens; ``split_words`` does whole columns."""
    return [*(text or b"").lower().split(), END]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all ``texts`` (binary; null: none) in one column, and how many each has; the ends are left out."""
    kind = pa.large_string() if pa.types.is_large_binary(texts.type) else pa.string()
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(kind).fill_null("")))  # bytes stay as they are, valid UTF-8 or not
    size, words = parts.value_lengths().to_numpy(), parts.flatten().cast(pa.large_string()).view(pa.large_binary())
    real = pc.greater(pc.binary_length(words), 0)
    if not pc.all(real).as_py():  # white space at a text's begin or end leaves an empty part
        row = np.repeat(np.arange(len(size)), size)[real.to_numpy(zero_copy_only=False)]
        words, size = words.filter(real), np.bincount(row, minlength=len(size))
    return words, size.astype(np.int64)


# --- counts -----------------------------------------------------------------


def token_counts(docs: DataFrame) -> DataFrame:
    """word (binary) and n of every distinct token of ``docs`` (text), the end included; all rows are counted."""

    def count(batches):
        held: list = []
        size = ends = 0

        def out():
            got = pc.value_counts(pa.chunked_array(held, pa.large_binary()))
            words, n = got.field("values"), got.field("counts")
            yield pa.record_batch([pa.concat_arrays([words.cast(pa.binary()), pa.array([END])]), pa.concat_arrays([n, pa.array([ends], pa.int64())])], names=["word", "n"])

        for batch in batches:
            for b in by_size(batch, SPLIT):
                words, _ = split_words(b["text"])
                held.append(words)
                size, ends = size + len(words), ends + b.num_rows
                if size >= HELD_WORDS:
                    yield from out()
                    held.clear()
                    size = ends = 0
        if ends:
            yield from out()

    rows = docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


class Known:
    """The most frequent tokens with their counts, and sums over all: what every task gets. Bounded by ``KNOWN`` and ``BINS``."""

    def __init__(self, words: list[tuple[bytes, int]], total: int, distinct: int, bins: dict[int, tuple[int, int]], vocabulary: int = VOCABULARY, classes: int = CLASSES):
        words = sorted(words, key=lambda x: (-x[1], x[0]))
        self.rank = {w: k for k, (w, _) in enumerate(words)}
        self.count = np.array([n for _, n in words], np.float64)
        self.total, self.distinct = total, distinct
        self.size = min(vocabulary, len(words))
        self.bin = np.array([tail_bin(w) for w, _ in words], np.int64)
        self.base = np.log10((self.count + 0.1) / (total + 0.1 * (distinct + 1)))
        # the vocabulary's tokens leave their bins
        self.bin_n, self.bin_v = np.zeros(BINS), np.zeros(BINS)
        for b, (n, v) in bins.items():
            self.bin_n[b], self.bin_v[b] = n, v
        own = self.bin[: self.size]
        self.bin_n -= np.bincount(own, self.count[: self.size], BINS)
        self.bin_v -= np.bincount(own, minlength=BINS)
        self.bin_log = np.log10(self.bin_n + 0.1 * (self.bin_v + 1))
        self.tail = np.log10(self.count + 0.1) - self.bin_log[self.bin]
        # classes of about equal mass, frequent tokens first
        mass = np.cumsum(self.count[: self.size])
        k = min(classes, self.size)
        cuts = np.unique(np.searchsorted(mass, mass[-1] * np.arange(1, k) / k, "left") + 1) if k else np.empty(0, np.int64)
        self.bounds = np.concatenate(([0], cuts[cuts < self.size], [self.size])) if k else np.zeros(1, np.int64)
        self.n_classes = len(self.bounds) - 1
        self.cls = np.repeat(np.arange(self.n_classes), np.diff(self.bounds))

    def ids(self, ranks: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Input ids: a token of the vocabulary is its rank, any other its bin after them."""
        return np.where((ranks >= 0) & (ranks < self.size), ranks, self.size + bins).astype(self.kind)

    @property
    def kind(self) -> type:
        """What ids are kept as; the start's is the largest."""
        return np.int16 if self.size + BINS < 1 << 15 else np.int32

    def without_words(self) -> Known:
        """What the network needs; a task that has ids looks no word up."""
        out = copy.copy(self)
        out.rank = {}
        return out


def known(counts: DataFrame, most: int = KNOWN, vocabulary: int = VOCABULARY, classes: int = CLASSES) -> Known:
    """Sums over ``counts`` and its tokens above the lowest count that at most ``most`` tokens reach."""
    level = F.floor(F.log2("n") * 16).cast("int")
    bins, levels, total, distinct = {}, Counter(), 0, 0
    for r in counts.groupBy(tail_bin_column("word").alias("bin"), level.alias("level")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # at most 32 bins by 1000 levels
        n, v = bins.get(r["bin"], (0, 0))
        bins[r["bin"]] = n + r["n"], v + r["v"]
        levels[r["level"]] += r["v"]
        total, distinct = total + r["n"], distinct + r["v"]
    room, least = most, None
    for lv in sorted(levels, reverse=True):
        room -= levels[lv]
        if room < 0:
            break
        least = lv
    words = [] if least is None else [(bytes(r["word"]), r["n"]) for r in counts.filter(level >= least).select("word", "n").toLocalIterator()]
    return Known(words, total, distinct, bins, vocabulary, classes)


# --- the network -------------------------------------------------------------


def _begins(sorted_ids: np.ndarray) -> np.ndarray:
    """Where a run of equal ids begins."""
    return np.flatnonzero(np.concatenate((sorted_ids[:1] == sorted_ids[:1], sorted_ids[1:] != sorted_ids[:-1])))


def _sorting(ids: np.ndarray, most: int) -> np.ndarray:
    """The stable order of ids below ``most``; short integers are sorted by radix."""
    return np.argsort(ids.astype(np.int16) if most < 1 << 15 else ids, kind="stable")


def _sums_by_id(rows: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sums of the runs of ``rows`` that begin at ``begins``: a product for each long run, the short ones together, place by place."""
    size = np.diff(begins, append=len(rows))
    out = np.take(rows, begins, axis=0, mode="clip")
    some = np.flatnonzero((size > 1) & (size <= SHORT))
    some = some[np.argsort(-size[some], kind="stable")]
    more = out[some]
    for j in range(1, int(size[some].max(initial=1))):
        m = int(np.count_nonzero(size[some] > j))
        more[:m] += np.take(rows, begins[some[:m]] + j, axis=0, mode="clip")
    out[some] = more
    long = np.flatnonzero(size > SHORT)
    ones = np.ones(int(size.max(initial=0)), rows.dtype)
    for k, s, n in zip(long.tolist(), begins[long].tolist(), size[long].tolist(), strict=True):
        np.matmul(ones[:n], rows[s : s + n], out=out[k])
    return out


def _columns(name: str, part) -> property:
    """A part of the array that holds the weights and the bias of each column of a layer side by side."""

    def put(self, value):
        self.columns[name] = a = self.columns[name].astype(value.dtype, copy=False)
        part(a)[...] = value

    return property(lambda self: part(self.columns[name]), put)


class Gru:
    """Weights and arithmetic of the model, in single precision."""

    NAMES = ("inp", "rec", "cls", "cls_bias", "out", "out_bias")
    cls, out = (_columns(n, lambda a: a[:, :-1].T) for n in ("cls", "out"))
    cls_bias, out_bias = (_columns(n, lambda a: a[:, -1]) for n in ("cls", "out"))

    def __init__(self, k: Known, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.k, self.hidden = k, hidden
        n_in, n_out = k.size + BINS + 1, k.n_classes + BINS
        self.start = k.size + BINS
        small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        self.columns = {"cls": np.empty((n_out, hidden + 1), np.float32), "out": np.empty((k.size, hidden + 1), np.float32)}
        self.inp, self.rec, self.cls, self.out = small(n_in, 3 * hidden), small(hidden, 3 * hidden), small(hidden, n_out), small(hidden, k.size)
        self.inp[:, :hidden] += 1.0  # keep the state at first
        mass = np.concatenate((np.add.reduceat(k.count[: k.size], k.bounds[:-1]) if k.size else [], k.bin_n)) + 0.1
        self.cls_bias = np.log(mass / mass.sum()).astype(np.float32)
        self.out_bias = np.log(k.count[: k.size] + 0.1).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for n in self.NAMES:
            a = getattr(self, n)
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size

    def forward(self, ids: np.ndarray, h: np.ndarray, fresh: np.ndarray | None = None, keep: bool = True):
        """States (steps x lanes x hidden) after each input, and, with ``keep``, what the backward pass needs."""
        (n, lanes), hid = ids.shape, self.hidden
        hs, first = np.empty((n, lanes, hid), np.float32), h
        gates, cs = (np.empty((n if keep else 1, *x, lanes, hid), np.float32) for x in ((3,), ()))
        # a matrix and an input row for each gate, so that what a gate takes is one stretch of memory
        rec = np.ascontiguousarray(self.rec.reshape(hid, 3, hid).transpose(1, 0, 2))
        rec[:2] *= -1
        rows, a = self.inp.reshape(-1, hid), np.empty((3, lanes, hid), self.inp.dtype)
        at = 3 * ids[:, None, :].astype(np.intp) + np.arange(3)[:, None]
        starts = [False] * n if fresh is None else fresh.any(axis=1).tolist()
        with np.errstate(over="ignore"):  # an exponential without end is a gate that is shut
            for t in range(n):
                if starts[t]:
                    h = np.where(fresh[t][:, None], np.float32(0), h)
                np.take(rows, at[t], axis=0, out=a, mode="clip")
                gate, c, new = gates[t if keep else 0], cs[t if keep else 0], hs[t]
                np.matmul(h, rec, out=gate)
                zr = gate[:2]
                zr -= a[:2]
                np.exp(zr, out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                np.multiply(zr[1], gate[2], out=c)
                c += a[2]
                c *= -2  # the hyperbolic tangent by the exponential, which is faster
                np.exp(c, out=c)
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                np.subtract(h, c, out=new)
                new *= zr[0]
                new += c
                h = new
        if not keep:
            return hs, None
        before = np.empty_like(hs)
        before[0], before[1:] = first, hs[:-1]
        if fresh is not None:
            before[fresh] = 0
        return hs, (before, gates, cs)

    def target_class(self, ids: np.ndarray) -> np.ndarray:
        inside = ids < self.k.size
        return np.where(inside, self.k.cls[np.where(inside, ids, 0)] if self.k.size else 0, ids - self.k.size + self.k.n_classes)

    def log_probs(self, hs: np.ndarray, ids: np.ndarray, grads: bool = False):
        """Natural log probability of each target id after its state; with ``grads`` also the gradients of their negative sum."""
        lp, d_h, *layers = self.softmax(hs, ids, 1.0 if grads else None)
        return (lp, d_h, *(x for g in layers for x in (g[:, :-1].T, g[:, -1]))) if grads else lp

    def softmax(self, hs: np.ndarray, ids: np.ndarray, scale: float | None = None):
        """Natural log probability of each target id after its state, and the gradients of ``scale`` times their negative sum (None: none),
        by states and by the arrays of ``columns``.

        Targets are sorted, so those of a class lie together, and a state has a one behind it, by which a product takes in the bias.
        """
        order, hid, k = _sorting(ids, self.start), self.hidden, self.k
        ids = ids[order]
        at = np.empty((len(ids), hid + 1), hs.dtype)
        at[:, :hid], at[:, hid] = np.take(hs, order, axis=0, mode="clip"), 1
        got, d, d_cls = self._layer(at, self.target_class(ids), self.columns["cls"], [(0, len(ids), 0, len(self.columns["cls"]))], scale)
        # a class of one token says no more; the most frequent ones come first
        skip = int(np.argmax(np.append(np.diff(k.bounds) > 1, True)))
        ends = np.searchsorted(ids, k.bounds[skip:]).tolist()
        bounds, s, e = k.bounds[skip:].tolist(), ends[0], ends[-1]
        parts = [(x - s, y - s, lo, hi) for x, y, lo, hi in zip(ends[:-1], ends[1:], bounds[:-1], bounds[1:], strict=True) if x < y]
        more, d_more, d_out = self._layer(at[s:e], ids[s:e], self.columns["out"], parts, scale)
        got[s:e] += more
        lp = np.empty_like(got)
        lp[order] = got
        if scale is None:
            return lp, None, None, None
        d[s:e] += d_more
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return lp, np.take(d, back, axis=0, mode="clip"), d_cls, d_out

    def _layer(self, at: np.ndarray, own: np.ndarray, w: np.ndarray, parts: list, scale: float | None):
        """Log probabilities of the sorted columns ``own`` after the rows of ``at``, with the gradients (see ``softmax``) by states and by columns.

        A part (from, to, low, high) of the rows chooses among the columns from ``low`` on.
        """
        n, hid = len(at), self.hidden
        spans = np.array(parts, np.int64).reshape(-1, 4).T
        rows, wide = spans[1] - spans[0], spans[3] - spans[2]
        size = rows * wide
        flat = np.empty(int(size.sum()), np.result_type(at, w))
        xs = [flat[p : p + m].reshape(-1, v) for p, m, v in zip((np.cumsum(size) - size).tolist(), size.tolist(), wide.tolist(), strict=True)]
        for (s, e, lo, hi), x in zip(parts, xs, strict=True):
            np.matmul(at[s:e], w[lo:hi].T, out=x)
        each = np.repeat(wide, rows)
        begin = np.cumsum(each) - each
        places = begin + own - np.repeat(spans[2], rows)
        if n and max(flat.max(), -flat.min()) > SAFE:  # else neither they nor their sum leave single precision
            for x in xs:
                x -= x.max(axis=1, keepdims=True)
        got = flat[places]
        np.exp(flat, out=flat)
        one = len(parts) == 1
        total = xs[0] @ np.ones(xs[0].shape[1], flat.dtype) if one else np.add.reduceat(flat, begin) if n else got
        got -= np.log(total)
        if scale is None:
            return got, None, None
        share = np.asarray(scale / total, flat.dtype)
        if one:
            xs[0] *= share[:, None]
        else:
            flat *= np.repeat(share, each)
        flat[places] -= flat.dtype.type(scale)
        d, d_w = np.empty((n, hid), flat.dtype), np.zeros(w.shape, flat.dtype)
        for (s, e, lo, hi), x in zip(parts, xs, strict=True):
            np.matmul(x, w[lo:hi, :hid], out=d[s:e])
            np.matmul(x.T, at[s:e], out=d_w[lo:hi])
        return got, d, d_w

    def backward(self, ids: np.ndarray, kept: tuple, d_hs: np.ndarray, fresh: np.ndarray | None = None):
        """Gradients of the input rows (as ids and rows) and of the recurrent weights, through one window; none pass a document's start."""
        (n, lanes), hid = ids.shape, self.hidden
        before, gates, c = kept
        z, r, g_c = gates[:, 0], gates[:, 1], gates[:, 2]
        # what no later step changes, for the whole window at once: what a state's gradient is multiplied by for each gate
        by, keep = np.empty((n, lanes, 3, hid), np.float32), 1 - z
        by_c = 1 - c * c
        by_c *= keep
        keep *= z
        np.multiply(before - c, keep, out=by[:, :, 0])
        np.multiply(by_c, r, out=by[:, :, 2])
        np.multiply(by[:, :, 2], g_c * (1 - r), out=by[:, :, 1])
        d_in, ds = np.empty((n, lanes, 3, hid), np.float32), np.empty((n, lanes, hid), np.float32)
        d_h, passed, back = np.zeros((lanes, hid), np.float32), np.empty((lanes, hid), np.float32), np.ascontiguousarray(self.rec.T)
        starts = [False] * n if fresh is None else fresh.any(axis=1).tolist()
        for t in range(n - 1, -1, -1):
            d = ds[t]
            np.add(d_hs[t], d_h, out=d)
            np.multiply(d[:, None], by[t], out=d_in[t])
            np.matmul(d_in[t].reshape(lanes, 3 * hid), back, out=d_h)
            np.multiply(d, z[t], out=passed)
            d_h += passed
            if starts[t]:
                d_h[fresh[t]] = 0
        d_rec = before.reshape(-1, hid).T @ d_in.reshape(-1, 3 * hid)
        np.multiply(ds, by_c, out=d_in[:, :, 2])  # the input joins the candidate after the reset gate
        return d_in.reshape(n, lanes, 3 * hid), d_rec


class Trainer:
    """Adagrad over windows; input rows are changed where they occur."""

    def __init__(self, net: Gru, rate: float = RATE):
        self.net, self.rate, self.tokens = net, rate, 0
        self.seen = {n: np.full_like(a, 1e-4) for n, a in ({"inp": net.inp, "rec": net.rec} | net.columns).items()}

    def _step(self, name: str, weights: np.ndarray, grad: np.ndarray) -> None:
        """Change the weights; the gradient is used up. A few rows at once stay in the cache."""
        room = np.empty_like(grad[:STEPPED])
        for at in range(0, len(grad), STEPPED):
            g, seen, w = (x[at : at + STEPPED] for x in (grad, self.seen[name], weights))
            step = np.multiply(g, g, out=room[: len(g)])
            seen += step
            np.sqrt(seen, out=step)
            g /= step
            g *= self.rate
            w -= g

    def run(self, docs, lanes: int = LANES_TRAINED, window: int = WINDOW, buffer: int = BUFFER) -> None:
        """Train on every token of each of ``docs`` (arrays of ids), the state carried from a document's start to its end.

        About ``buffer`` ids are held at once, and laid out in lanes; the gradients of a window reach back to its begin.
        """
        held: list = []
        size = 0
        for ids in docs:
            held.append(ids)
            size += len(ids)
            if size >= buffer:
                self._run(held, lanes, window)
                held, size = [], 0
        if held:
            self._run(held, lanes, window)

    def _run(self, docs: list[np.ndarray], lanes: int, window: int) -> None:
        laid = Lanes(docs, lanes, self.net.start, np.random.default_rng(self.tokens))
        h = np.zeros((laid.n, self.net.hidden), np.float32)
        for at, real in laid.windows(window):
            h = self._window(laid, at, real, h[: at.shape[1]], min(lanes, laid.n))

    def _window(self, laid: Lanes, at: np.ndarray, real: np.ndarray | None, h: np.ndarray, lanes: int) -> np.ndarray:
        """Train on a window (places of ids, steps x lanes; ``real`` where a lane hasn't ended) and give the states after it."""
        net = self.net
        inp, fresh, out = laid.inp[at], laid.fresh[at], laid.out[at]
        hs, gates = net.forward(inp, h, fresh)
        flat_hs = hs.reshape(-1, net.hidden) if real is None else hs[real]
        _, d, d_cls, d_out = net.softmax(flat_hs, out.ravel() if real is None else out[real], 1 / lanes)
        if real is None:
            d_hs = d.reshape(hs.shape)
        else:
            d_hs = np.zeros_like(hs)
            d_hs[real] = d
        d_in, d_rec = net.backward(inp, gates, d_hs, fresh)
        ids = inp.ravel()
        order = _sorting(ids, net.start)
        ids = ids[order]
        begins = _begins(ids)
        rows = ids[begins]
        sums = _sums_by_id(np.take(d_in.reshape(-1, d_in.shape[-1]), order, axis=0, mode="clip"), begins)
        np.clip(sums, -1, 1, out=sums)
        seen = np.take(self.seen["inp"], rows, axis=0, mode="clip")
        step = sums * sums
        seen += step
        self.seen["inp"][rows] = seen
        np.sqrt(seen, out=seen)
        sums /= seen
        sums *= self.rate
        net.inp[rows] -= sums
        self._step("rec", net.rec, np.clip(d_rec, -1, 1))
        for name, g in (("cls", d_cls), ("out", d_out)):
            self._step(name, net.columns[name], g)
        self.tokens += len(flat_hs)
        return hs[-1]


class Lanes:
    """Documents laid end to end in lanes of about equal length, each lane a stretch of one flat row of ids.

    Memory is linear in the ids, however long one document is. The longest lanes come first: those still at work are a prefix.
    """

    def __init__(self, docs: list[np.ndarray], lanes: int, start: int, rng: np.random.Generator | None = None):
        self.n = lanes = min(lanes, len(docs))
        placed: list[list[int]] = [[] for _ in range(lanes)]
        heap = [(0, w) for w in range(lanes)]
        for d in sorted(range(len(docs)), key=lambda d: -len(docs[d])):
            n, w = heapq.heappop(heap)
            placed[w].append(d)
            heapq.heappush(heap, (n + len(docs[d]), w))
        if rng is not None:
            for ds in placed:
                rng.shuffle(ds)
        size = np.array([sum(len(docs[d]) for d in ds) for ds in placed])
        placed = [placed[w] for w in np.argsort(-size, kind="stable")]
        self.size = np.sort(size)[::-1]
        self.end = np.cumsum(self.size)
        self.order = [d for ds in placed for d in ds]
        self.out = np.concatenate([docs[d] for d in self.order])
        doc_size = np.array([len(docs[d]) for d in self.order])
        self.doc_at = np.cumsum(doc_size) - doc_size
        self.inp = np.append(self.out[:1], self.out[:-1])
        self.inp[self.doc_at] = start
        self.fresh = np.zeros(len(self.out), bool)
        self.fresh[self.doc_at] = True

    def windows(self, window: int):
        """(places, real): places of the ids of a window, steps x lanes; real is None where no lane ends, else which places are."""
        begin = self.end - self.size
        for t in range(0, int(self.size[0]), window):
            on = int(np.searchsorted(-self.size, -t, "left"))  # lanes longer than t
            at = begin[None, :on] + np.arange(t, min(t + window, int(self.size[0])))[:, None]
            if t + len(at) <= self.size[on - 1]:
                yield at, None
            else:
                real = at < self.end[None, :on]
                at[~real] = 0
                yield at, real


_RESOLVED = "doc_id long, row long, held_out boolean, n_tokens long, n_known long, base double, tail double, ids binary, word binary, n long"


def resolved(docs: DataFrame, k: Known) -> DataFrame:
    """What ``k`` says of the tokens of each row of ``docs`` (doc_id, held_out, text): a row with its ids, its counts and sums over the
    known tokens, and a row (word, n) for each distinct one of the others. So texts are split and looked up once for training and scoring."""
    sent = docs.sparkSession.sparkContext.broadcast(k)

    def run(batches):
        from pyspark import TaskContext

        know, names = sent.value, [x.split() for x in _RESOLVED.split(", ")]
        kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}
        known_words, end = pa.array(know.rank, pa.large_binary()), know.rank.get(END, -1)
        made = TaskContext.get().partitionId() << 33

        def out(rows, cols):
            return pa.record_batch([pa.nulls(rows, kinds[t]) if n not in cols else pa.array(c, kinds[t]) if isinstance(c := cols[n], np.ndarray) else c for n, t in names], names=[n for n, _ in names])

        for batch in batches:
            for b in by_size(batch, SPLIT):
                words, size = split_words(b["text"])
                found = pc.index_in(words, known_words).fill_null(-1).to_numpy()
                row = np.arange(made, made + len(size))
                made += len(size)
                # a row's tokens: its words, then its end
                own = np.repeat(np.arange(len(size)), size)
                begin = np.cumsum(size + 1) - (size + 1)
                ranks, bins = np.full(len(found) + len(size), end, np.int64), np.full(len(found) + len(size), tail_bin(END), np.int64)
                place = np.arange(len(found)) + own
                ranks[place] = found
                # the others, each distinct one once
                other = np.flatnonzero(found < 0)
                coded = words.take(pa.array(other)).dictionary_encode()
                distinct, code = coded.dictionary.cast(pa.binary()), coded.indices.to_numpy().astype(np.int64)
                bins[place[other]] = np.array([tail_bin(w) for w in distinct.to_pylist()], np.int64)[code]
                far = np.flatnonzero(ranks >= know.size)
                bins[far] = know.bin[ranks[far]]
                ids, inside = know.ids(ranks, bins), ranks >= 0
                base, tail = np.zeros(len(ranks)), np.zeros(len(ranks))
                base[inside], tail[far] = know.base[ranks[inside]], know.tail[ranks[far]]
                sums = lambda x, begin=begin: np.add.reduceat(x, begin)
                at = np.append(begin, len(ids)) * ids.itemsize
                cols = {"doc_id": b["doc_id"], "row": row, "held_out": b["held_out"], "n_tokens": size + 1, "n_known": sums(inside.astype(np.int64)), "base": sums(base), "tail": sums(tail)}
                yield out(len(size), cols | {"ids": pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])})
                pair, times = np.unique(own[other] * max(1, len(distinct)) + code, return_counts=True)
                of, word = np.divmod(pair, max(1, len(distinct)))
                cols = [(row[of], distinct.take(pa.array(word)), times)]
                if end < 0:  # so is the end, where none was learned
                    cols.append((row, pa.array([END] * len(size)), np.ones(len(size), np.int64)))
                for r, w, n in cols:
                    yield out(len(r), {"row": r, "word": w, "n": n})

    return docs.select(F.col("doc_id").cast("long"), "held_out", F.col("text").cast("string").cast("binary")).mapInArrow(run, _RESOLVED)


def train(docs: DataFrame, k: Known, rounds: int = ROUNDS, hidden: int = HIDDEN, rate: float = RATE) -> np.ndarray:
    """Weights of a ``Gru`` trained on every row of ``docs`` (text)."""
    rows = resolved(docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text"), k)
    return train_ids(rows.filter("ids is not null").select("ids"), k, rounds, hidden, rate)


def train_ids(rows: DataFrame, k: Known, rounds: int = ROUNDS, hidden: int = HIDDEN, rate: float = RATE) -> np.ndarray:
    """Weights of a ``Gru`` trained on every one of ``rows`` (ids, see ``resolved``)."""
    net, k = Gru(k, hidden), k.without_words()
    weights = net.flat()
    if not k.size:
        return weights
    for turn in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast((k, weights))

        def fit(batches, sent=sent, turn=turn):
            from pyspark import TaskContext

            know, begin = sent.value
            own = Gru(know, hidden)
            own.load(begin)
            trainer = Trainer(own, rate / (1 + turn))
            trainer.run(np.frombuffer(ids, know.kind) for b in batches for ids in b["ids"].to_pylist())
            if trainer.tokens:
                part = TaskContext.get().partitionId() % 16
                cuts = np.array_split(own.flat(), WEIGHT_BLOCKS)
                yield pa.record_batch([pa.array(range(WEIGHT_BLOCKS), pa.int32()), pa.array([part] * WEIGHT_BLOCKS, pa.int32()), pa.array([trainer.tokens] * WEIGHT_BLOCKS, pa.int64()), pa.array([c.tobytes() for c in cuts], pa.binary())], names=["block", "part", "tokens", "w"])

        copies = rows.mapInArrow(fit, "block int, part int, tokens long, w binary")
        some = copies.repartition("block", "part").mapInArrow(_mean, copies.schema)
        done = some.withColumn("part", F.lit(0)).repartition("block").mapInArrow(_mean, copies.schema).collect()  # WEIGHT_BLOCKS rows
        seen = {r["tokens"] for r in done}
        if seen != {k.total}:
            raise RuntimeError(f"trained on {sorted(seen)} tokens of {k.total}")
        if done:
            weights = np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(done, key=lambda r: r["block"])])
    return weights


def _mean(batches):
    """The mean of each block's weights by tokens, summed as they come."""
    sums: dict[tuple, list] = {}
    for b in batches:
        for r in b.to_pylist():
            s = sums.setdefault((r["block"], r["part"]), [0, 0.0])
            s[0] += r["tokens"]
            s[1] = s[1] + np.frombuffer(r["w"], np.float32).astype(np.float64) * r["tokens"]
    if sums:
        yield pa.record_batch([pa.array([b for b, _ in sums], pa.int32()), pa.array([p for _, p in sums], pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([(w / n).astype(np.float32).tobytes() for n, w in sums.values()], pa.binary())], names=["block", "part", "tokens", "w"])


# --- scoring -----------------------------------------------------------------


def lane_scores(net: Gru, docs: list[np.ndarray], lanes: int = LANES, window: int = 32) -> list[float]:
    """log10 probability of each document's ids, by the network alone, in lanes."""
    if not docs:
        return []
    laid = Lanes(docs, lanes, net.start)
    lp = np.zeros(len(laid.out), np.float64)
    h = np.zeros((laid.n, net.hidden), np.float32)
    for at, real in laid.windows(window):
        hs, _ = net.forward(laid.inp[at], h[: at.shape[1]], laid.fresh[at], keep=False)
        if real is None:
            lp[at.ravel()] = net.log_probs(hs.reshape(-1, net.hidden), laid.out[at.ravel()])
        else:
            lp[at[real]] = net.log_probs(hs[real], laid.out[at[real]])
        h = hs[-1]
    scores = np.empty(len(docs))
    scores[laid.order] = np.add.reduceat(lp, laid.doc_at) / np.log(10)
    return scores.tolist()


_SCORED = "doc_id long, row long, held_out boolean, n_tokens long, n_known long, base double, score double"


def score(docs: DataFrame, counts: DataFrame, k: Known, weights: np.ndarray, hidden: int = HIDDEN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, held_out, text)."""
    return score_ids(written(resolved(docs, k), "ids"), counts, k, weights, hidden)


def score_ids(rows: DataFrame, counts: DataFrame, k: Known, weights: np.ndarray, hidden: int = HIDDEN) -> DataFrame:
    """The same of ``rows`` (see ``resolved``), whose words that ``k`` doesn't hold are joined with ``counts``."""
    sent = rows.sparkSession.sparkContext.broadcast((k.without_words(), weights))

    def run(batches):
        know, w = sent.value
        net = Gru(know, hidden)
        net.load(w)
        held: list = []
        ids: list[np.ndarray] = []
        size = 0

        def out():
            t = pa.Table.from_batches(held)
            scores = np.array(lane_scores(net, ids)) + t["tail"].to_numpy()
            t = t.drop_columns(["tail", "ids"]).append_column("score", pa.array(scores, pa.float64()))
            return t.combine_chunks().to_batches()

        for b in batches:
            at = 0
            for x, own in enumerate(b["ids"].to_pylist()):
                ids.append(np.frombuffer(own, know.kind))
                size += len(ids[-1])
                if size >= BUFFER:
                    held.append(b.slice(at, x + 1 - at))
                    yield from out()
                    held.clear()
                    ids.clear()
                    at, size = x + 1, 0
            if at < b.num_rows:
                held.append(b.slice(at))
        if held:
            yield from out()

    own = [x.split()[0] for x in _SCORED.split(", ")][:-1]
    scored = rows.filter("ids is not null").select(*own, "tail", "ids").mapInArrow(run, _SCORED)
    share = float(np.log10(k.total + 0.1 * (k.distinct + 1)))
    tail = F.array(*[F.lit(float(x)) for x in k.bin_log])
    c = F.coalesce("c", F.lit(0))
    rare = rows.filter("word is not null").select("row", "word", "n").join(counts.select("word", F.col("n").alias("c")), "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * (F.log10(c + 0.1) - share)).alias("rare_base"),
        F.sum(F.col("n") * (F.log10(c + 0.1) - F.get(tail, tail_bin_column("word")))).alias("rare_score"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(int(k.total)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("score") + zero("rare_score")).alias("score"),
    )


def score_documents(docs: DataFrame, folds: int = FOLDS, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows whose fold is not 0 and score all rows (see ``score``)."""
    docs = docs.select(F.col("doc_id").cast("long"), (fold_crc("doc_id", folds) == 0).alias("held_out"), F.col("text").cast("string"))
    learned = docs.filter(~F.col("held_out"))
    counts = written(token_counts(learned), "counts")
    k = known(counts)
    rows = written(resolved(docs, k), "ids")
    return score_ids(rows, counts, k, train_ids(rows.filter("ids is not null and not held_out").select("ids"), k, rounds))


def op1_language_model(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
