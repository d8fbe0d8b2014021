"""numpy kernels over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text that kernels hold as 8-byte numbers at a time (a longer text is taken alone).
CHUNK = 1 << 18
#: Bytes of a word that a polynomial stands for; longer ones get a digest.
LONG_WORD = 64
_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))

_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.Generator(np.random.PCG64(20240611)).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Every ASCII character but digits and letters.
_OTHER = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on between tasks, beside others and a JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        m = max(n, CHUNK + 64)
        for k, base in enumerate((_BASE, _INV)):
            a = np.full(m, base, U64)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _powers[k] = a
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """s with (s[e] - s[b]) * base**-b a hash of values[b:e]."""
    s = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=s[1:])
    return s


def spans(s: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mixed((s[end] - s[begin]) * powers(len(s))[1][begin] + U64(1))


class Texts:
    """Documents of a block in order of (doc_id, text): ids, all bytes, and where each text begins."""

    def __init__(self, table: pa.Table):
        table = table.select(["doc_id", "text"]).combine_chunks()
        ids = table.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        if len(ids) and (np.diff(ids[order]) == 0).any():
            texts = table.column("text").to_pylist()
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i].encode())))
        text = table.column("text").take(pa.array(order)).cast(pa.large_string()).combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_string())
        self.ids = ids[order]
        _, offsets, data = text.buffers()
        self.offsets = np.frombuffer(offsets, np.int64, len(text) + 1, text.offset * 8) if len(text) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = self.data[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]

    def __len__(self) -> int:
        return len(self.ids)

    def chunks(self, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first document, one after the last, their bytes, their offsets in those), in order."""
        first = 0
        while first < len(self):
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + size, "right")) - 1)
            a = self.offsets[first]
            yield first, last, self.data[a : self.offsets[last]], self.offsets[first : last + 1] - a
            first = last


class Words:
    """Maximal runs of bytes other than space, tab, LF, VT, FF and CR (alnum: of ASCII letters and digits and of bytes
    from 0x80), in the order of a block's texts; none crosses two texts.

    begin, end: bytes in texts.data; doc: the text's number; hash (if asked for): of the bytes, fold: with A-Z as a-z.
    Bytes are looked at CHUNK by CHUNK, wherever texts begin, so a long text takes no more memory than short ones.
    """

    def __init__(self, texts: Texts, fold: bool = False, hashes: bool = True, alnum: bool = False):
        data, between = texts.data, _OTHER if alnum else _SPACE
        parts = [self._edges(data, texts.offsets, at, min(at + CHUNK, len(data)), between) for at in range(0, len(data), CHUNK)]
        self.begin, self.end = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*parts, strict=True) if parts else ((), ())))
        self.doc = np.searchsorted(texts.offsets, self.begin, "right") - 1
        self.hash = self._hashes(data, fold) if hashes else np.zeros(0, U64)
        self.count = np.bincount(self.doc, minlength=len(texts))

    @staticmethod
    def _edges(data, offsets, a, b, between):
        """Where words begin in [a, b), and where words end whose last byte is there."""
        inside = np.zeros(b - a + 2, bool)  # with one byte before and one behind
        low, high = max(a - 1, 0), min(b + 1, len(data))
        inside[low - a + 1 : high - a + 1] = ~between[data[low:high]]
        edge = np.zeros(b - a + 1, bool)
        edge[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b, "right")] - a] = True
        begin = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        return begin + a, end + a

    def _hashes(self, data: np.ndarray, fold: bool) -> np.ndarray:
        """Polynomials of the bytes modulo 2**64; digests for long words, where such polynomials of two texts can be equal by construction."""
        values, out, first = _FOLDED if fold else _VALUES, np.empty(len(self.begin), U64), 0
        while first < len(out):
            at = int(self.begin[first])
            last = max(first + 1, int(np.searchsorted(self.end, at + CHUNK, "right")))
            if last > first + 1 or self.end[first] - at <= LONG_WORD:
                s = prefix_sums(values[data[at : self.end[last - 1]]])
                out[first:last] = spans(s, self.begin[first:last] - at, self.end[first:last] - at)
            first = last
        for k in np.flatnonzero(self.end - self.begin > LONG_WORD).tolist():
            word = data[self.begin[k] : self.end[k]].tobytes()
            out[k] = int.from_bytes(hashlib.blake2b(word.translate(_LOWER) if fold else word, digest_size=8).digest(), "little")
        return out

    def __len__(self) -> int:
        return len(self.begin)

    def windows(self, width: int, hashes: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """First words of the windows of `width` words of one text, and (if asked for) the windows' hashes."""
        n = len(self) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        first = np.flatnonzero(self.doc[:n] == self.doc[width - 1 :])
        return first, spans(prefix_sums(self.hash), first, first + width) if hashes else np.zeros(0, U64)

    def joined(self, data: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The (kept) words of each text joined by one space: all bytes, and where each word begins and ends in them."""
        begin, end, doc = (x if keep is None else x[keep] for x in (self.begin, self.end, self.doc))
        d = np.zeros(len(data) + 1, np.int8)
        d[begin] += 1
        d[end] -= 1
        inside = np.cumsum(d[:-1], dtype=np.int8).view(bool)
        gap = end[:-1][doc[:-1] == doc[1:]]
        inside[gap] = True
        out = data.copy()
        out[gap] = 0x20
        size = end - begin
        apart = np.zeros(len(begin), np.int64)
        apart[1:] = doc[:-1] == doc[1:]
        at = np.cumsum(size + apart) - size
        return out[inside], at, at + size


def slices(batches: Iterator[pa.RecordBatch], size: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """Arrow batches in turns of about `size` bytes of their column text (a longer text alone)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(first, last - first)
            first = last
    release()


def text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    """The documents of Arrow batches, in turns."""
    return (Texts(pa.Table.from_batches([part])) for part in slices(batches))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in [s, s + width) for some start."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:n]) > 0
