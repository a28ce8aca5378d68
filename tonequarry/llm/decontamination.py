"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items become words (ASCII letters lower-cased; everything but letters, digits and
non-ASCII separates). An item of L words is found where some span of a text is within
floor(0.2 L) word edits of it. The CGK walk reads a window's words: at step j it writes the word it
stands on and moves on if a random bit of (walk, j, word) says so; few edits then leave few
differing steps. Each of ``walks`` walks samples ``sampled`` steps; a window that agrees with an
item on them in any walk is compared with it exactly.

Windows are embedded where they can match at all: of the d + 1 equal parts of an item, d edits leave
one whole, so a text with none of the parts' leading words (up to three) in a row can't hold it.
That sieve loses nothing; it is there because embedding every window of every length costs more
than the time allowed. An item too short for any edit is looked up as a whole by the sieve, and only its
first place in a text goes on: no later one can be nearer.

Items without words match nothing; null texts hold nothing. Repeated items are each reported,
repeated rows too. Ties: of equal spans the first. Very long texts are searched whole; work is linear in their words for
each item whose parts stand in them. Empty tables give no rows. Extra columns pass ``drop_contaminated`` unchanged.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import table

TOLERANCE, WALKS, SAMPLED, ITEMS_AT_ONCE, BYTES_AT_ONCE, DOCS_AT_ONCE = 0.2, 48, 2, 20_000, 1 << 23, 2000

_KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

HITS = "doc_id long, item_id long, start_word long, n_words long, edits long, similarity double"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_KEPT).split()


def best_span(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, stop) of the span of ``text`` nearest to ``item``; the first of the best, then the longest start to it."""
    n = len(text)
    row = np.zeros(n + 1, np.int64)
    origin = np.arange(n + 1)
    steps = np.arange(n + 1)
    for k, w in enumerate(item, 1):
        diagonal = row[:-1] + (text != w)
        above = row + 1
        new = above.copy()
        new[1:] = np.minimum(new[1:], diagonal)
        from_ = origin.copy()
        by_diagonal = diagonal <= above[1:]
        from_[1:][by_diagonal] = origin[:-1][by_diagonal]
        low = np.minimum.accumulate(new - steps)
        at = np.maximum.accumulate(np.where(new - steps == low, steps, 0))
        row, origin = low + steps, from_[at]
    stop = int(row.argmin())
    return int(row[stop]), int(origin[stop]), stop


class Items:
    """Benchmark items, indexed: vocabulary, sieve and the sampled steps of their embeddings."""

    def __init__(self, items: list[tuple[int, bytes]], tolerance: float = TOLERANCE, walks: int = WALKS, sampled: int = SAMPLED, seed: int = 11):
        self.vocab: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for item, text in items:
            if ws := words_of(text):
                self.ids.append(item)
                self.words.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.int64))
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.floor(tolerance * self.size + 1e-9).astype(np.int64)
        self.walks, self.sampled = walks, sampled
        rng = np.random.default_rng(seed)
        longest = int(self.size.max(initial=1))
        # coordinates in the first 2 L steps, ascending, the same for every window of a length
        self.share = np.sort(rng.random((walks, sampled)), axis=1)
        self.salt = rng.integers(1, 1 << 62, (2 * longest + 1, walks), np.int64) | 1
        self.mix = rng.integers(1, 1 << 62, (walks, sampled), np.int64) | 1
        self.base = len(self.vocab) + 2
        self._sieve()
        self.found: dict[tuple[int, int], list[int]] = defaultdict(list)
        if self.words:
            flat = np.concatenate(self.words)
            ends = np.cumsum(self.size)
            keys = self.embed(flat, ends - self.size, ends, self.size)
            for i, row in enumerate(keys):
                for w, key in enumerate(row.tolist()):
                    self.found[w, key].append(i)
        self.known = np.array(sorted({k for _, k in self.found}), np.int64)

    def _sieve(self) -> None:
        """For each gram size the sorted grams, and for each gram the (item, offset) of the parts it begins."""
        self.grams: dict[int, tuple[np.ndarray, list]] = {}
        places: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for i, (ws, d) in enumerate(zip(self.words, self.edits.tolist(), strict=True)):
            part = len(ws) // (d + 1)
            q = min(3, part)
            for k in range(d + 1):
                g = 0
                for w in ws[k * part : k * part + q].tolist():
                    g = g * self.base + w
                places[q][g].append((i, k * part))
        for q, by in places.items():
            grams = np.array(sorted(by), np.int64)
            self.grams[q] = grams, [by[g] for g in grams.tolist()]

    def embed(self, flat: np.ndarray, start: np.ndarray, stop: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Keys (window, walk) of the windows of ``size`` words at ``start``; words at ``stop`` and beyond are missing."""
        n = len(start)
        end = np.minimum(start + size, stop)
        coords = np.minimum((self.share[None] * (2 * size)[:, None, None]).astype(np.int64), (2 * size - 1)[:, None, None])
        at = np.repeat(start[:, None], self.walks, axis=1)
        keys = np.zeros((n, self.walks), np.int64)
        last = int(coords.max(initial=0))
        padded = np.append(flat, 0)
        with np.errstate(over="ignore"):
            for j in range(last + 1):
                inside = at < end[:, None]
                word = np.where(inside, padded[np.minimum(at, len(flat))], self.base - 1)
                for s in range(self.sampled):
                    hit = coords[:, :, s] == j
                    if hit.any():
                        keys[hit] += (word * self.mix[None, :, s])[hit]
                h = (word + 1) * self.salt[j][None]
                at += ((h ^ (h >> 29)) * np.int64(0x1B873593) >> 40) & 1
        return keys

    def search(self, texts: list[bytes | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, start, words, edits) of the best span of each item in each text that holds it."""
        if not self.words:
            return []
        get, parts, lens = self.vocab.get, [], []
        for t in texts:
            ws = words_of(t)
            lens.append(len(ws))
            parts.append(np.fromiter(map(get, ws, repeat(0)), np.int64, len(ws)))
        flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
        ends = np.cumsum(lens)
        windows, whole = set(), set()
        stops, edits_of, size_of = ends.tolist(), self.edits.tolist(), self.size.tolist()
        for q, (grams, places) in self.grams.items():
            if len(flat) < q:
                continue
            ok = flat[: len(flat) - q + 1] > 0
            for k in range(1, q):
                ok = ok & (flat[k : len(flat) - q + 1 + k] > 0)
            pos = np.flatnonzero(ok)
            g = np.zeros(len(pos), np.int64)
            for k in range(q):
                g = g * self.base + flat[pos + k]
            slot = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            hit = grams[slot] == g
            found = pos[hit]
            docs = np.searchsorted(ends, found, "right")
            for p, s, doc in zip(found.tolist(), slot[hit].tolist(), docs.tolist(), strict=True):
                high = stops[doc]
                if p + q > high:
                    continue
                low = high - lens[doc]
                for i, offset in places[s]:
                    d, size = edits_of[i], size_of[i]
                    if not d:
                        if (doc, i) not in whole and p + size <= high and (flat[p : p + size] == self.words[i]).all():
                            whole.add((doc, i))
                            windows.add((p, size, doc))
                        continue
                    windows.update((w, size, doc) for w in range(max(low, p - offset - d), min(p - offset + d, high - 1) + 1))
        if not windows:
            return []
        out: dict[tuple[int, int], tuple] = {}
        listed = sorted(windows)
        for at in range(0, len(listed), 5000):
            some = np.array(listed[at : at + 5000], np.int64)
            start, size, doc = some.T
            keys = self.embed(flat, start, ends[doc], size)
            slot = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
            agree: dict[tuple[int, int], set[int]] = defaultdict(set)
            for r, w in zip(*np.nonzero(self.known[slot] == keys), strict=True):
                for i in self.found.get((int(w), int(keys[r, w])), ()):
                    if self.size[i] == size[r]:
                        agree[int(doc[r]), i].add(int(start[r]))
            for (x, i), starts in agree.items():
                low, high, d, n = int(ends[x]) - lens[x], int(ends[x]), int(self.edits[i]), int(self.size[i])
                run: list[int] = []
                for s in [*sorted(starts), None]:
                    if run and (s is None or s > run[-1] + d):
                        a, b = max(low, run[0] - d), min(high, run[-1] + n + 2 * d)
                        edits, left, right = best_span(self.words[i], flat[a:b])
                        if edits <= d:
                            out[x, i] = min(out.get((x, i), (edits, a + left - low, right - left)), (edits, a + left - low, right - left))
                        run = []
                    run.append(s)
        return [(x, i, start, n, edits) for (x, i), (edits, start, n) in sorted(out.items())]


def _blocks(benchmark: DataFrame, at_once: int) -> Iterator[list]:
    """The items, so many and so many bytes at a time: no more of the benchmark is ever with the driver or in a task."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], bytes(r["text"] or b"")))
        size += len(held[-1][1])
        if len(held) == at_once or size >= BYTES_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _slices(b: pa.RecordBatch, n: int = DOCS_AT_ONCE):
    for at in range(0, b.num_rows, n):
        yield b.slice(at, n)


def contamination(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, walks: int = WALKS, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """A row (``HITS``) for each benchmark item in each row of ``docs`` that holds it: its best span, the first of equals.

    A benchmark of more than ``items_at_once`` items is searched in blocks, a pass over ``docs`` each.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], HITS)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    for block in _blocks(benchmark, items_at_once):
        sent = spark.sparkContext.broadcast((block, tolerance, walks))

        def run(batches, sent=sent):
            items = Items(*sent.value)
            for b in batches:
                for some in _slices(b):
                    hits = items.search(some["text"].to_pylist())
                    if hits:
                        doc = some["doc_id"].to_pylist()
                        rows = [(doc[x], items.ids[i], start, n, edits, 1 - edits / int(items.size[i])) for x, i, start, n, edits in hits]
                        yield pa.record_batch([pa.array(c, pa.float64() if k == 5 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))], names=[c.split()[0] for c in HITS.split(", ")])

        out = out.union(docs.mapInArrow(run, HITS))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, walks: int = WALKS, items_at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no benchmark item. No shuffle: each row is judged where it is read."""
    for block in _blocks(benchmark, items_at_once):
        sent = docs.sparkSession.sparkContext.broadcast((block, tolerance, walks))

        def run(batches, sent=sent):
            items = Items(*sent.value)
            for b in batches:
                for some in _slices(b):
                    texts = some["text"].cast(pa.binary()).to_pylist()
                    keep = np.ones(some.num_rows, bool)
                    keep[[h[0] for h in items.search(texts)]] = False
                    yield some.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
