"""Whole-text encoding with a public byte-level BPE vocabulary, one word-sized unit at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Units kept per Python worker, and the longest unit kept. Neither changes a result.
CACHED_UNITS, CACHED_CHARS = 500_000, 48
#: Bytes of text that are encoded at once: memory follows them, and the more there are the fewer units are distinct.
ENCODED_BYTES = 1 << 21

#: Marks that may follow a word in its unit: no letters, digits, apostrophes or white space, so they are pre-tokens of their own.
MARKS = ".,;:!?#$%&*)]}"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class UnitEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids.

    The vocabulary's pre-tokenizer never lets a token span the place before a single space that a
    non-space follows, nor either side of a lone line feed. Texts are cut there, and each distinct
    unit is encoded once. A text with any other white space is encoded whole.
    """

    def __init__(self, path: str, cached: int = CACHED_UNITS):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.cached = cached
        #: Byte-level vocabularies write bytes that don't print as the characters from 256 on, in order.
        prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.wide = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in prints)}
        self.kept: dict[str, bytes] = {"\n": self._encode_any(["\n"])[0]}

    def _encode(self, units: dict[str, bytes | None]) -> None:
        """Fill in the ids of each unit; None stays where a unit holds other white space than one space before it.

        Letters alone, after a space or not, are one pre-token and go to the model straight; marks after them are another.
        """
        kept, cached, longest = self.kept, self.cached, CACHED_CHARS
        tokenize, wide, space = self.tok.model.tokenize, self.wide, self.wide[32]
        rest = []
        for u in units:
            word = u.rstrip(MARKS)
            core = word[1:] if word[:1] == " " else word
            if not core.isalpha():
                if self._clean(u):
                    rest.append(u)
                continue
            ids = kept.get(word)
            if ids is None:
                if core.isascii():
                    t = tokenize(core if core is word else space + core)
                else:
                    t = tokenize(word.encode().decode("latin-1").translate(wide))
                ids = pack(f"<{len(t)}I", *[x.id for x in t])
                if len(kept) < cached and len(word) <= longest:
                    kept[word] = ids
            if len(word) < len(u):
                marks = u[len(word) :]
                more = kept.get(marks)
                if more is None:
                    more = self._encode_any([marks])[0]
                    if len(kept) < cached and len(marks) <= longest:
                        kept[marks] = more
                ids += more
            units[u] = ids
        units.update(zip(rest, self._encode_any(rest), strict=True))

    def _encode_any(self, units: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(units), 2000):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(units[i : i + 2000], add_special_tokens=False)]
        return out

    @staticmethod
    def _clean(unit: str) -> bool:
        """No white space but one space before."""
        rest = unit[1:] if unit[:1] == " " else unit
        return bool(rest) and len(rest.split()) == 1 and rest.strip() == rest

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Ids of each text; null is empty.

        Texts are cut and their units made distinct in Arrow; only distinct units are looked up, and ids are gathered by number.
        """
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        if not len(texts):
            return []
        marked = pc.fill_null(pc.match_substring(texts, "\0"), False)  # the mark of a cut stands in the text itself
        plain = pc.if_else(marked, "", pc.fill_null(texts, ""))
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, "\n", "\0\n\0"), " ", "\0 "), "\0")
        found = cut.values.dictionary_encode()
        code, start = found.indices.to_numpy(), cut.offsets.to_numpy()
        units = found.dictionary.to_pylist()
        ids = self._look_up(units)
        whole = marked.to_numpy(zero_copy_only=False)
        bad = np.zeros(len(units), bool)
        if "" in units:
            # an empty unit is nothing at a text's ends, and a second line feed within it
            empty = code == units.index("")
            empty[start[:-1]] = empty[start[1:] - 1] = False
            whole = whole | (np.add.reduceat(empty, start[:-1]) > 0)
        if None in ids:
            bad[[k for k, x in enumerate(ids) if x is None]] = True
            whole = whole | (np.add.reduceat(bad[code], start[:-1]) > 0)
            ids = [x or b"" for x in ids]
        pool = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = size[code]
        upto = np.cumsum(n)
        flat = pool[np.repeat((np.cumsum(size) - size)[code] - (upto - n), n) + np.arange(int(upto[-1]))]
        ends = upto[start[1:] - 1].tolist()
        raw = flat.tobytes()
        done = [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for k in np.flatnonzero(whole).tolist():
            done[k] = self._encode_any([texts[k].as_py()])[0]
        return done

    def _look_up(self, units: list[str]) -> list[bytes | None]:
        """Ids of distinct units, kept or new; None for one that can't stand alone."""
        kept = self.kept
        got = list(map(kept.get, units))
        if None in got:
            missed = [i for i, g in enumerate(got) if g is None]
            todo: dict[str, bytes | None] = {units[i]: None for i in missed if units[i]}
            self._encode(todo)
            # a word alone is kept by _encode; with marks it is worth a place only while there is much room
            for u, b in todo.items():
                if len(kept) >= self.cached // 2:
                    break
                if b is not None and len(u) <= CACHED_CHARS:
                    kept[u] = b
            todo[""] = b""
            for i in missed:
                got[i] = todo[units[i]]
        return got


def release() -> None:
    """Give back what earlier tasks of a Python worker keep: encoders with their units, and what the allocators hold."""
    _encoders.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another libc than glibc
        pass


def by_size(batch: pa.RecordBatch, most: int = ENCODED_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text; a longer text stands alone."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(upto[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """The encoder of this Python worker, made once."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]
