"""Bounded-space online packing of tokenised documents into sequences of fixed length.

Each partition keeps ``open_windows`` windows open. A document's full windows leave at once; its
remainder goes to the open window where it fits best; where none fits, a new window opens, or, with
all of them open, the fullest leaves. What is still open at a partition's end is carried with its
ids and merged, some partitions at a time, into full windows, cut where needed.

Nulls and empty texts give one piece that holds the end id alone. Repeated rows and ids are packed
as often as they occur. A very long text is encoded whole and leaves in full windows at once. Ties: of windows that
fit equally well the one opened first. An empty table gives no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import clustered, table, written
from tonequarry.llm.tokens import by_size, encoder, vocabulary_path

LENGTH, END_ID, OPEN_WINDOWS, MERGED_PARTITIONS = 2048, 1, 128, 16
SEQUENCE_BITS = 33

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part")] + [("ids", pa.binary())])


class OnlinePacker:
    """Best fit into a bounded number of open windows. ``emit`` is called with each window that leaves: its list of pieces."""

    def __init__(self, length: int, open_windows: int, emit):
        self.length, self.open_windows, self.emit = length, open_windows, emit
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.held: dict[int, list] = {}
        self.made = 0

    def add(self, piece: tuple, size: int) -> None:
        if size == self.length:
            self.emit([piece])
            return
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, w = self.room.pop(at)
            self.held[w].append(piece)
            if room == size:
                self.emit(self.held.pop(w))
            else:
                insort(self.room, (room - size, w))
            return
        if len(self.room) >= self.open_windows:
            _, w = self.room.pop(0)
            self.emit(self.held.pop(w))
        w, self.made = self.made, self.made + 1
        self.held[w] = [piece]
        insort(self.room, (self.length - size, w))

    def leftovers(self) -> list:
        return [self.held[w] for _, w in self.room]


def _pack(path: str, length: int, end_id: int, open_windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc, end = encoder(path), np.array([end_id], "<u4").tobytes()
        rows: list[tuple] = []
        made = 0

        def emit(pieces: list) -> None:
            nonlocal made
            offset, seq = 0, (part << SEQUENCE_BITS) + made
            made += 1
            for doc, start, ids, total in pieces:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, seq, offset, None, None))
                offset += n

        packer = OnlinePacker(length, open_windows, emit)
        for b in batches:
            for some in by_size(b):
                for doc, ids in zip(some["doc_id"].to_pylist(), enc.encode(some["text"]), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for s in range(0, total, length):
                        cut = ids[4 * s : 4 * (s + length)]
                        packer.add((doc, s, cut, total), len(cut) // 4)
            if rows:
                yield _batch(rows)
                rows.clear()
        for pieces in packer.leftovers():
            for doc, start, ids, total in pieces:
                rows.append((doc, start, len(ids) // 4, None, total, None, None, part, ids))
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _merge(length: int):
    """Fill windows from the pieces of one group of partitions, whole where they fit, else cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in clustered(batches, ["merge"]):
            key, rows, seq, fill = group["merge"][0].as_py(), [], 0, 0
            seq = (1 << 62) + (key << SEQUENCE_BITS)
            for r in group.to_pylist():
                ids, start = r["ids"], r["start"]
                while ids:
                    cut = ids[: 4 * (length - fill)]
                    n = len(cut) // 4
                    rows.append((r["doc_id"], start, n, zlib.crc32(cut), r["doc_tokens"], seq, fill, None, None))
                    ids, start, fill = ids[len(cut) :], start + n, fill + n
                    if fill == length:
                        seq, fill = seq + 1, 0
            yield _batch(rows)

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, open_windows: int = OPEN_WINDOWS, merged_partitions: int = MERGED_PARTITIONS) -> DataFrame:
    """One row per piece (``PIECES``) of ``docs`` (doc_id, text); see the module's text for the method and its cases."""
    schema = PIECES + ", part long, ids binary"
    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_pack(path or vocabulary_path(), length, end_id, open_windows), schema)
    packed = written(packed, "packed")
    open_ = packed.filter("ids is not null").withColumn("merge", F.expr(f"part div {int(merged_partitions)}"))
    merged = open_.repartition("merge").sortWithinPartitions("merge", "part", F.desc("length"), "doc_id", "start").mapInArrow(_merge(length), schema)
    cols = [c.split()[0] for c in PIECES.split(", ")]
    return packed.filter("ids is null").select(cols).union(merged.select(cols))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
