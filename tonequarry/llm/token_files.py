"""Token-id files: fixed blocks of ids, transposed into byte or bit planes, each plane compressed, with a chunk index.

A file is ``MAGIC``, the compressed planes one after another, an index in JSON (compressed), the
index's length as eight bytes, and ``MAGIC`` again. The index has for each block its number of ids
and its planes' places and lengths, and for each document its id and length. Blocks are read on
their own: ``read_ids`` opens only those that a range needs.

A file ends at ``FILE_IDS`` ids or ``FILE_DOCS`` documents, so an index of a file is bounded and files of empty
texts are too. Null texts are empty; each document ends with the end id, so an empty one has one id. Rows of one id
stand in the order of their texts' hashes, equal rows one after the other; null ids come first. Very long texts are
encoded whole and written block by block. An empty table gives no files and no rows. Extra columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonequarry.llm.common import give_back, n_parts, shared_path, table, written
from tonequarry.llm.tokens import by_size, encoder, vocabulary_path

MAGIC, END_ID, BLOCK_IDS, FILE_IDS, FILE_DOCS = b"TQPLANE1", 0, 1 << 16, 1 << 23, 1 << 18


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of one block, lowest first: bit k (or byte k) of every id, together."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    flat = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(flat[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        flat = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw = np.packbits(flat, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(-1)


class PlaneWriter:
    """Streams ids to one file; holds a block of them and the index."""

    def __init__(self, out, bits: bool = False, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block = out, bits, 4 * block_ids
        self.held, self.size, self.at = [], 0, len(MAGIC)
        self.blocks: list = []
        self.docs: list = []
        self.packer = zstandard.ZstdCompressor(level=3)
        out.write(MAGIC)

    def add(self, doc, ids: bytes) -> None:
        self.docs.append((doc, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            raw = b"".join(self.held)
            whole = self.size - self.size % self.block
            for s in range(0, whole, self.block):
                self._write(raw[s : s + self.block])
            self.held, self.size = [raw[whole:]], self.size - whole

    def _write(self, raw: bytes) -> None:
        places = []
        for plane in to_planes(np.frombuffer(raw, "<u4"), self.bits):
            packed = self.packer.compress(plane)
            self.out.write(packed)
            places.append((self.at, len(packed)))
            self.at += len(packed)
        self.blocks.append((len(raw) // 4, places))

    def close(self) -> int:
        if self.size:
            self._write(b"".join(self.held))
        index = self.packer.compress(json.dumps({"blocks": self.blocks, "docs": self.docs, "block_ids": self.block // 4}).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return sum(n for n, _ in self.blocks)


class PlaneReader:
    def __init__(self, src):
        self.src, size = src, src.size()
        tail = src.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole token file")
        n = int.from_bytes(tail[:8], "little")
        self.unpack = zstandard.ZstdDecompressor()
        self.index = json.loads(self.unpack.decompress(src.read_at(n, size - 16 - n)))

    def block(self, k: int) -> np.ndarray:
        n, places = self.index["blocks"][k]
        return from_planes([self.unpack.decompress(self.src.read_at(size, at)) for at, size in places], n)

    def read_ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop`` of the file; only their blocks are read."""
        step = self.index["block_ids"]
        if stop <= start:
            return np.empty(0, "<u4")
        found = np.concatenate([self.block(k) for k in range(start // step, -(-stop // step))])
        return found[start - start // step * step :][: stop - start]

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document's id and ids, in order, one block held at a time."""
        held, k = b"", 0
        for doc, n in self.index["docs"]:
            parts, need = [], 4 * n
            while need > len(held):
                parts.append(held)
                need -= len(held)
                held, k = self.block(k).tobytes(), k + 1
            parts.append(held[:need])
            held = held[need:]
            yield doc, b"".join(parts)


def _write(vocabulary: str, folder: str, end_id: int, bits: bool, file_ids: int, file_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        w, done, n = None, [], 0

        def close():
            nonlocal w
            done.append((part, len(done), name, len(w.docs), w.close()))
            w = None

        for b in batches:
            for some in by_size(b):
                for doc, ids in zip(some["doc_id"].to_pylist(), enc.encode(some["text"]), strict=True):
                    if w is None:
                        # a name of its own for each attempt: files of lost tasks are in no manifest
                        name, n = f"part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.planes", 0
                        w = PlaneWriter(store.open_output_stream(f"{base}/{name}"), bits)
                    w.add(doc, ids + end)
                    n += len(ids) // 4 + 1
                    if n >= file_ids or len(w.docs) >= file_docs:
                        close()
        if w is not None:
            close()
        if done:
            yield pa.record_batch(dict(zip(("part", "file", "name", "n_docs", "n_ids"), map(list, zip(*done, strict=True)), strict=True)))

    return run


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, bits: bool = False, file_ids: int = FILE_IDS, file_docs: int = FILE_DOCS) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order to files in ``folder``; return the manifest, a row per file:
    part, file, name, n_docs, n_ids. Only files in the manifest count."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ranged = docs.repartitionByRange(n_parts(docs.sparkSession), F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    manifest = ranged.mapInArrow(_write(path or vocabulary_path(), folder, end_id, bits, file_ids, file_docs), "part long, file long, name string, n_docs long, n_ids long")
    return written(manifest, "manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 per document."""
    spark = manifest.sparkSession
    files, at = [], 0
    # one small row per file of millions of ids, not per document
    for r in manifest.orderBy("part", "file").toLocalIterator():
        files.append((r["name"], at))
        at += r["n_ids"]

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b["name"].to_pylist(), b["start"].to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{name}") as src:
                    found = PlaneReader(src).documents()
                    while True:
                        rows = []
                        for doc, ids in islice(found, 10_000):
                            rows.append((doc, start, len(ids) // 4, zlib.crc32(ids)))
                            start += len(ids) // 4
                        if not rows:
                            break
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(files, "name string, start long").repartition(max(1, min(len(files), 4 * n_parts(spark))))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "planes")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder)
    # the heap that the sort of whole texts has filled would stay beside the Python workers that read
    give_back(spark)
    return read_token_files(manifest, folder)
