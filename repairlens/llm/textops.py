"""Vectorised word and shingle arithmetic over the bytes of Arrow string columns.

Everything here works on a slice of whole texts at once: the UTF-8 bytes of all texts of
the slice stand one after another, ``offs`` has where each text begins (and where the last ends).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_STEP, _LEFT, _RIGHT = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U)


def _byte_table(word: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(word)] = True
    return out


#: Bytes of words: all but ASCII white space.
NON_SPACE = ~_byte_table(b" \t\n\v\f\r")
#: Bytes of words: a-z, A-Z, 0-9 and all above ASCII.
ALNUM = _byte_table(bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def give_back() -> None:
    """Returns freed memory to the system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = (1 << 20) - 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of slices with at most so many bytes of text, or of one longer text. Null counts as empty."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = col.fill_null("")
        if not len(col):
            continue
        wide = pa.types.is_large_string(col.type)
        offs = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to
    give_back()


def word_spans(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data; where each text's words begin among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = word[data]
    before = np.empty(len(data) + 1, bool)
    before[0] = False
    before[1:] = inside
    after = before.copy()
    after[:-1], after[-1] = inside, False
    before[offs] = False  # the byte before a text's first one, and after its last one, isn't in its words
    after[offs] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kinds: int = 1) -> list[np.ndarray]:
    """So many independent 64-bit hashes of each word's bytes (one byte at least): mixed sums over its chunks of 8 bytes, each mixed with its place."""
    size = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), U, buffer=padded, strides=(1,))  # the 8 bytes from each place on
    if not len(size) or size.max() <= 8:
        chunk = eight[starts] & _MASK[size]
        return [mix(mix(chunk, 2 * kind) + size.astype(U), 2 * kind + 1) for kind in range(kinds)]
    n = (size + 7) >> 3
    heads, place = np.cumsum(n) - n, ragged(np.zeros(len(n), np.int64), n)
    at = np.repeat(starts, n) + 8 * place
    chunk = (eight[at] & _MASK[np.minimum(np.repeat(ends, n) - at, 8)]) ^ (place.astype(U) * _STEP)
    return [mix(np.add.reduceat(mix(chunk, 2 * kind), heads) + size.astype(U), 2 * kind + 1) for kind in range(kinds)]


class Grams:
    """Hashes of spans of consecutive words, of each kind that the words have.

    A span of a power of two of words is hashed from its halves, any other from the two such
    spans that cover it; equal word sequences have equal hashes wherever they stand.
    """

    def __init__(self, words: list[np.ndarray]):
        self.n, self.levels = len(words[0]), [[w] for w in words]

    def _level(self, power: int, kind: int) -> np.ndarray:
        have = self.levels[kind]
        while len(have) <= power:
            last, half = have[-1], 1 << (len(have) - 1)
            n = max(0, self.n - 2 * half + 1)
            have.append(mix(last[:n] * _LEFT + last[half : half + n], kind))
        return have[power]

    def spans(self, starts: np.ndarray, ends: np.ndarray, kind: int = 0) -> np.ndarray:
        size = ends - starts
        out = np.empty(len(size), U)
        if not len(size):
            return out
        power = np.log2(size).astype(np.int64)
        for p in range(int(power.min()), int(power.max()) + 1):
            some = np.flatnonzero(power == p)
            if len(some):
                level = self._level(p, kind)
                out[some] = mix(level[starts[some]] * _LEFT + level[ends[some] - (1 << p)] * _RIGHT + size[some].astype(U), kind)
        return out

    def all(self, k: int, kind: int = 0) -> np.ndarray:
        """Of every k words, also of those across texts."""
        n, p = max(0, self.n - k + 1), k.bit_length() - 1
        level, shift = self._level(p, kind), k - (1 << p)
        return mix(level[:n] * _LEFT + level[shift : shift + n] * _RIGHT + U(k), kind)


def sliding(x: np.ndarray, width: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over each width consecutive values."""
    done = 1
    while done * 2 <= width:
        x = f(x[: len(x) - done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def within(firsts: np.ndarray, n: int, span: int) -> np.ndarray:
    """Of n - span + 1 places, those from which so many words stay in one text; firsts: where texts begin, and the end."""
    ok = np.ones(max(0, n - span + 1), bool)
    for back in range(1, span):
        cut = firsts[1:-1] - back
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    return ok


def winnow(hashes: np.ndarray, firsts: np.ndarray, n: int, k: int, width: int) -> np.ndarray:
    """Places of k-grams that are least among width consecutive ones of their text (all of those that tie).

    Whatever stands around it, a span of k + width - 1 words selects the same places, one at least.
    """
    if n < k + width - 1:
        return np.zeros(0, np.int64)
    least = sliding(hashes, width, np.minimum)
    least = np.where(within(firsts, n, k + width - 1), least, U(0))
    padded = np.concatenate([np.zeros(width - 1, U), least, np.zeros(width - 1, U)])
    return np.flatnonzero((sliding(padded, width, np.maximum) == hashes) & (hashes > 0))


def text_of(firsts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.searchsorted(firsts, places, "right") - 1


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each count, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray, kind=None) -> pa.Array:
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
