"""Vectorised tokenising and hashing of UTF-8 text columns, without a Python loop over words.

Texts of an Arrow batch lie in one buffer; words are found by a byte table. A word's hash is the sum,
modulo 2**64, of a pseudo-random value of each of its bytes at its place in the word, so that words
which differ anywhere differ by a random number: two share it with probability 2**-64, whatever
their lengths and pattern. Windows of words are hashed by prefix sums of a polynomial over word
hashes modulo 2**64; its base is 3 modulo 8, so two differing windows of up to 16 words share a hash
with probability 2**-59 at most.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPAN = 1 << 17
_WINDOW_BASE = 0xD1342543DE82EF93  # 3 modulo 8


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes (splitmix64)."""
    h = h + U64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, _SPAN + 1), _powers(pow(base, -1, 1 << 64), _SPAN + 1)


_WORD_POW, _WORD_INV = _tables(_WINDOW_BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: places in a word whose byte values are looked up; values of later ones are computed
_PLACES = 32


def _place_values(place: np.ndarray, byte: np.ndarray, second: bool) -> np.ndarray:
    """The pseudo-random value of a byte at a place of a word."""
    return mix((place.astype(U64) << U64(9)) + byte.astype(U64) + U64(256 * second))


_TABLES = [_place_values(np.repeat(np.arange(_PLACES), 256), np.tile(np.arange(256), _PLACES), second) for second in (False, True)]

#: Words [^\x20\x09-\x0D]+
NON_SPACE = np.ones(256, bool)
NON_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text whose A-Z are lower-cased
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True


def lower_az(text: bytes) -> bytes:
    """Lower-case A-Z only; on UTF-8 bytes, bytes.lower() does exactly that."""
    return text.lower()


class Texts:
    """Texts back to back in one byte buffer; text i is buf[off[i]:off[i + 1]]."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off

    def __len__(self) -> int:
        return len(self.off) - 1

    @classmethod
    def of_list(cls, texts: list[bytes]) -> Texts:
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        return cls(np.frombuffer(b"".join(texts), np.uint8), off)

    @classmethod
    def of_arrow(cls, col: pa.Array) -> Texts:
        """Null counts as empty. No copy of the text is made."""
        if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
            kind = np.int32
        else:
            col, kind = col.cast(pa.large_binary()), np.int64
        if col.null_count:
            col = pc.fill_null(col, "" if pa.types.is_string(col.type) else b"")
        if not len(col):
            return cls(np.empty(0, np.uint8), np.zeros(1, np.int64))
        _, offsets, data = col.buffers()
        off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
        return cls(buf[off[0] : off[-1]], off - off[0])

    def bytes_of(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()

    def joined(self, by: bytes) -> bytes:
        """All texts, with `by` between them."""
        data, at = memoryview(self.buf), self.off.tolist()
        return by.join(data[a:b] for a, b in zip(at[:-1], at[1:], strict=True))

    def pieces(self, most: int = 1 << 22) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about `most` bytes; a longer text stands alone."""
        i = 0
        while i < len(self):
            j = int(np.searchsorted(self.off, self.off[i] + most, "right")) - 1
            j = min(max(j, i + 1), len(self))
            yield i, j
            i = j

    def part(self, i: int, j: int) -> Texts:
        return Texts(self.buf[self.off[i] : self.off[j]], self.off[i : j + 1] - self.off[i])

    def words(self, table: np.ndarray = NON_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of words in the buffer, and each text's number of words."""
        n = len(self.buf)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(self), np.int64)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = table[self.buf]
        cut = np.zeros(n + 1, bool)  # a text begins here
        cut[self.off] = True
        now, before = inside[1:], inside[:-1]
        starts = np.flatnonzero(now & (~before | cut))
        ends = np.flatnonzero(before & (~now | cut))
        return starts, ends, np.diff(np.searchsorted(starts, self.off))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """64-bit hashes of the words buf[starts[i]:ends[i]]. `second` takes other byte values, for a
    hash that is independent of the first."""
    table = _TABLES[second]
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = int(np.searchsorted(ends, a + _SPAN, "right"))
        if j <= i:  # one word longer than a span
            total = np.zeros(1, U64)
            for k in range(int(a), int(ends[i]), _SPAN):
                part = buf[k : min(k + _SPAN, int(ends[i]))]
                total += _place_values(np.arange(k - a, k - a + len(part)), _LOWER[part] if lower else part, second).sum(dtype=U64)
            out[i] = total[0]
            i += 1
            continue
        seg = buf[a : ends[j - 1]]
        seg = _LOWER[seg] if lower else seg
        s, e = starts[i:j] - a, ends[i:j] - a
        place = np.arange(len(seg), dtype=np.int32) - np.repeat(s.astype(np.int32), np.diff(s, append=len(seg)))
        far = np.flatnonzero(place >= _PLACES)
        if len(far):
            late = place[far]
            place[far] = 0
        values = table[(place << 8) | seg]
        if len(far):
            values[far] = _place_values(late, seg[far], second)
        sums = np.zeros(len(seg) + 1, U64)
        np.cumsum(values, out=sums[1:])
        out[i:j] = sums[e] - sums[s]
        i = j
    return mix(out)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of n consecutive word hashes, len(h) - n + 1 of them."""
    total = len(h) - n + 1
    if total <= 0:
        return np.empty(0, U64)
    out = np.empty(total, U64)
    step = _SPAN - n
    for a in range(0, total, step):
        b = min(a + step, total)
        seg = h[a : b + n - 1]
        sums = np.zeros(len(seg) + 1, U64)
        np.cumsum(seg * _WORD_POW[: len(seg)], out=sums[1:])
        out[a:b] = (sums[n : n + b - a] - sums[: b - a]) * _WORD_INV[: b - a]
    return mix(out)


def fold(h: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One hash for each whole sequence h[begin:begin+count], equal to rolling(.., count) of it."""
    if not len(begin):
        return np.empty(0, U64)
    out = np.zeros(len(begin), U64)
    longest = int(count.max(initial=0))
    for k in range(longest):
        on = count > k
        out[on] += h[begin[on] + k] * _WORD_POW[k]
    return mix(out)


def windows(h: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows inside one text each, and the index of each window's first word."""
    all_h = rolling(h, n)
    if not len(all_h):
        return all_h, np.empty(0, np.int64)
    ends = np.repeat(np.cumsum(counts), counts)[: len(all_h)]
    at = np.flatnonzero(np.arange(len(all_h)) + n <= ends)
    return all_h[at], at


def batches_of(it: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of Arrow batches with about `most` bytes of column text each, and their texts."""
    for batch in it:
        texts = Texts.of_arrow(batch.column(batch.schema.get_field_index("text")))
        for i, j in texts.pieces(most):
            yield batch.slice(i, j - i), texts.part(i, j)


def free_memory() -> None:
    """Give what a task has freed back to the system: workers are kept for later tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own house
        pass


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
