"""Alignment of two tokenizers over the same bytes by byte-owner arrays.

The token of A that owns each byte is ``np.repeat`` of token numbers by token lengths, and so is B's. Where either owner
changes, a new pair of overlapping tokens begins; where both change, the tokens of both end: a cut between groups.
Texts are cut into units where neither vocabulary has a token across; distinct units are encoded and aligned together, and
a text's groups and links are those of its units. A pair of ids is counted over the whole corpus by an aggregate, and a document's
sums follow from a join on the pairs it holds, each once.

Null and empty texts, and texts whose tokens don't give the text's bytes again (U+2581 stands for a space in B), have no
tokens. Repeated rows and ids, and null ids, are rows of their own. A very long text is a row with as many distinct pairs as
it has. Ties: all pairs with the highest count of a B id are best. An empty table gives no rows. Extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import table, written
from tonequarry.llm.tokens import CACHED_CHARS, UnitEncoder, by_size, vocabulary_path

#: Units kept per Python worker and bytes of text aligned at once (neither changes a result), and pairs of ids in a table that is broadcast.
CACHED_UNITS, ALIGNED_BYTES, BROADCAST_PAIRS = 200_000, 1 << 20, 1_000_000

#: White space beyond ASCII, which A's pre-tokenizer knows.
WIDE_SPACE = r"[\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def byte_level_lengths(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary: its entry has a character for each byte; added tokens are plain text."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    vocabulary = said["model"]["vocab"]
    out = np.zeros(max([*vocabulary.values(), *(t["id"] for t in said["added_tokens"])]) + 1, np.int64)
    for piece, k in vocabulary.items():
        out[k] = len(piece)
    return out


def pair_shift(n_b: int) -> int:
    """A pair of ids is one number: A's id, then so many bits of B's."""
    return (n_b - 1).bit_length()


def _sums(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of ``n`` values."""
    upto = np.concatenate(([0], np.cumsum(x)))
    ends = np.cumsum(n)
    return upto[ends] - upto[ends - n]


class PieceVocabulary:
    """A sentencepiece model with byte fallback: ids of units, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.sp.get_piece_size()
        self.bytes = [b"" if self.sp.is_control(k) or self.sp.is_unknown(k) else bytes([int(p[3:5], 16)]) if self.sp.is_byte(k) else p.replace("▁", " ").encode() for k, p in ((k, self.sp.id_to_piece(k)) for k in range(n))]
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of units that begin with a space or a line feed. The model adds a space itself; before a line feed it is a piece alone."""
        got = self.sp.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [ids if u[0] == " " else ids[1:] for u, ids in zip(units, got, strict=True)]


class Aligner:
    """Aligns batches of texts; kept by a Python worker from task to task."""

    def __init__(self, path_a: str, path_b: str, cached: int = CACHED_UNITS):
        self.a, self.b = UnitEncoder(path_a, cached // 3), PieceVocabulary(path_b)
        self.len_a, self.len_b = byte_level_lengths(path_a), self.b.lengths
        self.shift = pair_shift(len(self.len_b))
        self.doc_shift = self.shift + pair_shift(len(self.len_a))
        self.cached = cached
        self.kept: dict[str, tuple] = {}
        k = np.arange(max(len(self.len_a), len(self.len_b)))
        self.width = np.char.str_len(k.astype(str))
        # a row for each id: its digits, and a place for the mark after it
        self.digits = np.frombuffer(k.astype(f"S{self.width.max() + 1}").tobytes(), np.uint8).reshape(len(k), -1)

    def _units(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Units of all texts, a space before each text, and the first unit of each. A cut lies before a single space or line feed
        between bytes above 32 (white space of other kinds is never at a cut)."""
        spaced = pc.binary_join_element_wise(" ", texts, "")
        size = pc.binary_length(spaced).to_numpy().astype(np.int64)
        start = np.concatenate(([0], np.cumsum(size)))
        raw = np.frombuffer(b"".join(spaced.cast(pa.binary()).to_pylist()), np.uint8)
        cut = np.zeros(len(raw), bool)
        cut[1:-1] = ((raw[1:-1] == 32) | (raw[1:-1] == 10)) & (raw[:-2] > 32) & (raw[2:] > 32)
        cut[start[1:] - 1] = False  # a text's last byte has no next one
        # other white space than ASCII's: the text stays whole
        for k in np.flatnonzero(pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)).tolist():
            cut[start[k] : start[k + 1]] = False
        cut[start[:-1]] = True
        at = np.append(np.flatnonzero(cut), len(raw)).astype(np.int32)
        units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw))
        return units, np.searchsorted(at, start)

    def _look_up(self, units: list[str]) -> list[tuple]:
        """What ``_learn`` says of each unit, kept or new."""
        got = list(map(self.kept.get, units))
        missed = [k for k, g in enumerate(got) if g is None]
        if missed:
            room = self.cached - len(self.kept)
            for k, new in zip(missed, self._learn([units[k] for k in missed]), strict=True):
                got[k] = new
                if room > 0 and len(units[k]) <= CACHED_CHARS:
                    self.kept[units[k]] = new
                    room -= 1
        return got

    def _learn(self, units: list[str]) -> list[tuple]:
        """For each unit: whether both vocabularies give its bytes, tokens of A, of B, groups, the pair of each link, the groups in decimal."""
        a_of = self.a._look_up(units)
        odd = [k for k, x in enumerate(a_of) if x is None]
        for k, x in zip(odd, self.a._encode_any([units[k] for k in odd]), strict=True):
            a_of[k] = x
        b_of = self.b.encode(units)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(units)) for x in (a_of, b_of))
        n_a //= 4
        a = np.frombuffer(b"".join(a_of), "<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(b_of), np.int64, int(n_b.sum()))
        want = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        # a mark for a space is three bytes in the text and one in B; all other pieces are the text's own
        good = (_sums(self.len_a[a], n_a) == want) & (_sums(self.len_b[b], n_b) == want)
        a, b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)]
        n_a, n_b = n_a * good, n_b * good
        owner_a, owner_b = np.repeat(np.arange(len(a)), self.len_a[a]), np.repeat(np.arange(len(b)), self.len_b[b])
        new_a, new_b = (np.diff(o, prepend=-1) != 0 for o in (owner_a, owner_b))
        at = np.flatnonzero(new_a | new_b)  # where links begin
        cut = (new_a & new_b)[at]
        link_a, link_b, group = owner_a[at], owner_b[at], np.cumsum(cut) - 1
        group_a, group_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
        group_a[link_a], group_b[link_b] = group, group
        unit = np.repeat(np.arange(len(units)), n_a)[link_a]
        n_links, n_groups = np.bincount(unit, minlength=len(units)), np.bincount(unit[cut], minlength=len(units))
        pairs = ((a[link_a] << self.shift) | b[link_b]).tobytes()
        ends = (8 * np.cumsum(n_links)).tolist()
        each = (pairs[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False))
        said = self._said(a, b, group_a, group_b, np.cumsum(n_a + n_b))
        return list(zip(good.tolist(), n_a.tolist(), n_b.tolist(), n_groups.tolist(), each, said, strict=True))

    def _said(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, last: np.ndarray) -> Iterator[bytes]:
        """The groups of each unit: A's ids, a bar, B's ids, a semicolon between groups. ``last``: tokens up to each unit's end."""
        n_a, n_b = np.bincount(group_a), np.bincount(group_b)
        place_a = np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(n_a)[group_b]
        ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[np.cumsum(n_a) - 1]], mark[place_b[np.cumsum(n_b) - 1]] = ord("|"), ord(";")
        width = self.width[ids]
        rows = self.digits[ids]
        rows[np.arange(len(ids)), width] = mark
        flat = rows[np.arange(rows.shape[1]) <= width[:, None]].tobytes()
        ends = np.concatenate(([0], np.cumsum(width + 1)))[last].tolist()
        for lo, hi in zip([0, *ends], ends, strict=False):
            yield flat[lo : hi - 1] if hi > lo else b""

    def align(self, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """A row of ``ALIGNED`` for each text."""
        n = len(texts)
        counts, sha, each = np.zeros((4, n), np.int64), [""] * n, np.zeros(n, np.int64)
        pairs, times = np.empty(0, np.int64), np.empty(0, np.int32)
        held = np.flatnonzero(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False))
        if len(held):
            units, first = self._units(texts.take(pa.array(held)))
            found = units.dictionary_encode()
            code = found.indices.to_numpy()
            good, n_a, n_b, n_groups, links, said = zip(*self._look_up(found.dictionary.to_pylist()), strict=True)
            n_links = np.fromiter(map(len, links), np.int64, len(links)) // 8
            right = np.minimum.reduceat(np.array(good)[code], first[:-1])
            counts[:, held] = right * np.stack([np.add.reduceat(np.array(x)[code], first[:-1]) for x in (n_a, n_b, n_groups, n_links)])
            parts, bounds = list(map(said.__getitem__, code.tolist())), first.tolist()
            for k, ok, lo, hi in zip(held.tolist(), right.tolist(), bounds, bounds[1:], strict=False):
                if ok:
                    sha[k] = hashlib.sha256(b";".join(parts[lo:hi])).hexdigest()
            pool, upto, per = np.frombuffer(b"".join(links), np.int64), np.cumsum(n_links), n_links[code]
            ends = np.cumsum(per)
            key = pool[np.repeat((upto - n_links)[code] - (ends - per), per) + np.arange(int(ends[-1]))]
            key |= np.repeat(np.repeat(np.arange(len(held)), np.diff(first)), per) << self.doc_shift
            key = np.sort(key[np.repeat(np.repeat(right, np.diff(first)), per)])
            new = np.flatnonzero(np.diff(key, prepend=-1))
            times = np.diff(np.append(new, len(key))).astype(np.int32)
            pairs = key[new] & ((1 << self.doc_shift) - 1)
            each[held] = np.bincount(key[new] >> self.doc_shift, minlength=len(held))
        upto = np.concatenate(([0], np.cumsum(each))).astype(np.int32)
        cols = [ids, *map(pa.array, counts), pa.array(sha), pa.ListArray.from_arrays(upto, pairs), pa.ListArray.from_arrays(upto, times)]
        return pa.record_batch(cols, names=[c.split()[0] for c in ALIGNED.split(", ")])


_aligners: dict[tuple[str, str], Aligner] = {}


def _aligned(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _aligners:
            _aligners[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _aligners[path_a, path_b]
        for b in batches:
            for some in by_size(b, ALIGNED_BYTES):
                yield aligner.align(some["doc_id"], some["text"])

    return run


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row (``ALIGNED``) for each of ``docs`` (doc_id, text): counts, the digest of its groups, and its distinct pairs of ids
    (``pair_shift``) with how often each is linked."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_aligned(path_a, path_b), ALIGNED)


def pair_counts(aligned: DataFrame, shift: int) -> DataFrame:
    """pair, count over all links of the corpus, best: whether no other pair of its B id has more."""
    counts = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("count"))
    counts = written(counts, "pairs")
    b = F.col("pair").bitwiseAND((1 << shift) - 1)
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return written(counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "best")


def with_corpus_sums(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Each row of ``aligned`` with n_best and count_sum over its links. ``counts`` is broadcast only if it is small; else both are shuffled."""
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = aligned.withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    known = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    sums = each.join(known, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("count") * F.col("times")).alias("count_sum"))
    return rows.select("row", *own).join(sums, "row", "left").na.fill(0, ["n_best", "count_sum"]).select(*own, "n_best", "count_sum")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    path_a, path_b = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    found = written(align(table(spark, sf_dir, "documents"), path_a, path_b), "aligned")
    return with_corpus_sums(found, pair_counts(found, pair_shift(len(PieceVocabulary(path_b).lengths))))
