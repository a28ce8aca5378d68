"""Language identification as inference in a mixture of languages.

Each learned language is a distribution over hashed letter trigrams. A document is a mixture: every
word comes from one of its languages, in unknown proportions. Expectation-maximisation estimates the
proportions; the set of languages is the one of highest likelihood less a penalty for each language
(half the logarithm of the number of words, and ``SET_COST``), sought among the languages in order of their proportion.
The prediction is the set's largest language; the score is its proportion in it. The whole set with its
proportions is told too, and the evidence: how much better the mixture explains a letter than chance.

A text that is null or has no letter is ``und`` with score 0. Ties go to the first language by name.
With no labelled text at all everything is ``und``. A blank label is a label; a null one teaches nothing. Of more
than ``LANGUAGES`` labels the most frequent are learned, so a dirty column can't grow the model (256 KB a language).
Very long texts are judged whole, one at a time. Repeated rows are rows, null ids too; extra columns, whatever their
names, are ignored by ``predict`` and kept by ``keep_identified``. An empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import by_batch, fold_crc, table

BINS, SMOOTH, ROUNDS, SET_COST, HELD_FOLD, FOLDS, CHARS_AT_ONCE, UNKNOWN, LANGUAGES, UNSEEN_SHARE = 1 << 16, 0.3, 8, 2.0, 2, 4, 1 << 19, "und", 256, 0.75

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the trigrams around each letter, in order; where each word begins in them; each word's text."""
    lowered = [(t or "").lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    codes = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _letter_table()[codes]
    codes = np.where(letter, codes, 0)
    at = np.flatnonzero(letter)
    if not at.size:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    bins = (codes[at - 1] * 1_000_003 + codes[at] * 8_191 + codes[at + 1] * 131_071 * 31) * 0x9E3779B1 >> 13 & BINS - 1
    begins = np.flatnonzero(~letter[at - 1])
    return bins, begins, np.searchsorted(ends, at[begins] - 1, "right")


def _chunks(texts: list):
    """Runs of texts of about CHARS_AT_ONCE characters, so that memory is bounded; a longer text stands alone."""
    at = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > at and size + n > CHARS_AT_ONCE:
            yield at, texts[at:k]
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, texts[at:]


class Found(NamedTuple):
    """What is found in one text: its language, that one's share, the set with each one's share (largest first), and how much better
    a letter is explained by them than by chance (the mean of natural logarithms; every trigram bin being equal)."""

    lang: str = UNKNOWN
    score: float = 0.0
    mixture: tuple[tuple[str, float], ...] = ()
    evidence: float = 0.0


class Model:
    def __init__(self, names: list[str], log_p: np.ndarray):
        self.names, self.log_p = names, log_p  # log_p: bins x languages
        #: The evidence of a letter whose trigram no language has.
        self.unseen = float(log_p.min(axis=0).max() + np.log(BINS)) if names else 0.0

    def __call__(self, texts: list[str | None]) -> list[Found]:
        out: list[Found] = []
        for _, some in _chunks(texts):
            out += self._infer(some)
        return out

    def _infer(self, texts: list[str | None]) -> list[Found]:
        out = [Found()] * len(texts)
        bins, begins, doc = trigrams(texts)
        if not bins.size or not self.names:
            return out
        ll = np.add.reduceat(self.log_p[bins], begins, axis=0)
        present, first, words = np.unique(doc, return_index=True, return_counts=True)
        of = np.repeat(np.arange(len(present)), words)
        top = ll.max(axis=1, keepdims=True)
        like = np.exp(ll - top).astype(np.float32)
        alone = np.add.reduceat((ll - top).astype(np.float64), first, axis=0)
        n_langs = len(self.names)
        pi, full = self._em(like, first, words, of, np.ones((len(present), n_langs), bool))
        letters = np.add.reduceat(np.diff(np.append(begins, len(bins))), first)
        evidence = (np.add.reduceat(top[:, 0].astype(np.float64), first) + full) / letters + np.log(BINS)
        order = np.argsort(-pi, axis=1, kind="stable")
        best, gain = alone.argmax(axis=1), alone.max(axis=1)
        cost = 0.5 * np.log(words) + SET_COST
        chosen = np.zeros_like(pi)
        chosen[np.arange(len(present)), best] = 1
        # more languages can't gain more than all of them do
        open_ = np.flatnonzero(full - gain > cost)
        for k in range(2, n_langs + 1):
            if not open_.size:
                break
            allowed = np.zeros((len(open_), n_langs), bool)
            np.put_along_axis(allowed, order[open_, :k], True, axis=1)
            rows = np.isin(of, open_)
            local = np.repeat(np.arange(len(open_)), words[open_])
            starts = np.concatenate(([0], np.cumsum(words[open_])[:-1]))
            some, value = self._em(like[rows], starts, words[open_], local, allowed)
            better = value - (k - 1) * cost[open_] > gain[open_]
            chosen[open_[better]], gain[open_[better]] = some[better], value[better] - (k - 1) * cost[open_[better]]
            open_ = open_[full[open_] - k * cost[open_] > gain[open_]]
        for d, shares, e in zip(present.tolist(), chosen, evidence.tolist(), strict=True):
            by_share = np.argsort(-shares, kind="stable")[: int((shares > 0).sum())].tolist()
            mixture = tuple((self.names[k], min(1.0, float(shares[k]))) for k in by_share)
            out[d] = Found(*mixture[0], mixture, e)
        return out

    @staticmethod
    def _em(like, first, words, of, allowed):
        pi = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
        for _ in range(ROUNDS):
            part = like * pi[of]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
            pi = (np.add.reduceat(part, first, axis=0) / words[:, None]).astype(np.float32)
        total = np.log(np.maximum((like * pi[of]).sum(axis=1), 1e-30).astype(np.float64))
        return pi, np.add.reduceat(total, first)


def learn(docs: DataFrame, languages: int = LANGUAGES) -> Model:
    """Trigram counts of every row of ``docs`` (text, lang) with both, of the ``languages`` most frequent labels (of equals the first by name).

    A task counts into one array for each language it meets; the driver gets only sums: languages times bins.
    """
    known = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).filter("text is not null and lang is not null")
    # the labels alone are read here; at most so many come to the driver
    wanted = [r["lang"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()]

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list] = {}
            for t, lang in zip(b["text"].to_pylist(), b["lang"].to_pylist(), strict=True):
                by.setdefault(lang, []).append(t)
            for lang, texts in by.items():
                own = held.setdefault(lang, np.zeros(BINS, np.int64))
                for _, some in _chunks(texts):
                    own += np.bincount(trigrams(some)[0], minlength=BINS)
        for lang, own in held.items():
            at = np.flatnonzero(own)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])], names=["lang", "bin", "n"])

    counts = known.filter(F.col("lang").isin(wanted)).mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("c")).orderBy("lang").toLocalIterator()
    names, cols = [], []
    for r in packed:
        own = np.zeros(BINS)
        for x in r["c"]:
            own[x["bin"]] = x["n"]
        names.append(r["lang"])
        cols.append(np.log((own + SMOOTH) / (own.sum() + SMOOTH * BINS)))
    return Model(names, np.array(cols, np.float32).T if cols else np.zeros((BINS, 0), np.float32))


_MIXTURE = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def predict(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """``keep`` columns of ``docs``, lang_pred, score, mixture (each language of the set with its share) and evidence, from each row's whole text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = sent.value(b["_text"].to_pylist())
        mixture = [[{"lang": lang, "share": share} for lang, share in x.mixture] for x in found]
        cols = [pa.array([x.lang for x in found], pa.string()), pa.array([x.score for x in found], pa.float64()), pa.array(mixture, _MIXTURE), pa.array([x.evidence for x in found], pa.float64())]
        return pa.record_batch([*(b[k] for k in keep), *cols], names=[*keep, "lang_pred", "score", "mixture", "evidence"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema), "lang_pred string, score double, mixture array<struct<lang:string,share:double>>, evidence double"])
    return rows.mapInArrow(by_batch(run), schema)


def keep_identified(docs: DataFrame, model: Model, unseen_share: float = UNSEEN_SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, in which a learned language is found.

    Texts without a letter go, and texts of no learned language: those whose evidence is at or below ``unseen_share`` of what a text
    has whose trigrams no language ever had. Where no language was learned every text with a letter stays.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b["text"].cast(pa.string()).to_pylist()
        if sent.value.names:
            keep = [x.lang != UNKNOWN and x.evidence >= unseen_share * sent.value.unseen for x in sent.value(texts)]
        else:
            keep = [any(map(str.isalpha, t or "")) for t in texts]
        return b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(by_batch(run), docs.schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(fold_crc("doc_id", FOLDS) != HELD_FOLD))
    rows = docs.select(F.col("doc_id").cast("long"), (fold_crc("doc_id", FOLDS) == HELD_FOLD).alias("held_out"), "text")
    return predict(rows, model, "doc_id", "held_out")
