"""Byte-pair encoding of whole slices of text at once, equal to the tokenizers library.

Both tokenizer files work on bytes. Texts whose characters all lie in ``SAFE`` (printable
ASCII, tab, line ends, Latin-1 letters and signs, Latin Extended-A) are split into pieces by
array arithmetic; for the few others, whose Unicode classes may differ by library version,
and for texts that may hold a special token, the tokenizers library itself is called.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cached_property

import numpy as np

from repairlens.llm import textops as T

SPACE, LETTER, DIGIT, OTHER, UNSAFE = range(5)
_END = 0x180


def _class(cp: int) -> int:
    if cp in (9, 10, 13, 32):
        return SPACE
    if not (0x21 <= cp <= 0x7E or 0xA1 <= cp < _END) or cp in (0x130, 0x149):
        return UNSAFE
    kind = unicodedata.category(chr(cp))[0]
    return {"L": LETTER, "N": DIGIT}.get(kind, OTHER)


_CLASS = np.array([_class(c) for c in range(_END)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()) if _class(c) == LETTER else c for c in range(_END)], np.int64)
_FIRST = np.full(256, UNSAFE, np.uint8)
_FIRST[:128] = _CLASS[:128]
NONE = np.int32(2**31 - 1)
_LONGEST = 2000  # pieces of more bytes go to the library


def classes(data: np.ndarray, offs: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, class of each byte's character, whether each text is safe)."""
    cls = _FIRST[data]
    lead = np.flatnonzero(data >= 0x80)
    if lower:
        data = T.LOWER[data]
    if len(lead):
        data = data.copy() if not lower else data
        heads = lead[(data[lead] >= 0xC2) & (data[lead] <= 0xC5)]
        cp = ((data[heads] & 0x1F).astype(np.int64) << 6) | (data[np.minimum(heads + 1, len(data) - 1)] & 0x3F)
        cls[heads] = cls[heads + 1] = _CLASS[cp]
        if lower:
            low = _LOWER[cp]
            data[heads], data[heads + 1] = 0xC0 | (low >> 6), 0x80 | (low & 0x3F)
    bad = np.concatenate([[0], np.cumsum(cls == UNSAFE)])
    safe = bad[offs[1:]] == bad[offs[:-1]]
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.zeros(0, np.int64)
    safe[np.unique(np.searchsorted(offs, special, "right") - 1)] = False  # "<|" may begin a special token
    return data, cls, safe


def _contractions(data: np.ndarray, begins: np.ndarray, text_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of apostrophes where a piece begins, those that begin one of 's 't 're 've 'm 'll 'd, and its length."""
    at = begins[data[begins] == 39]
    if not len(at):
        return at, at
    pad = np.concatenate([data, np.zeros(3, np.uint8)])
    room = text_end[at] - at
    a, b = pad[at + 1], pad[at + 2]
    one = np.isin(a, [115, 116, 109, 100]) & (room >= 2)
    two = ((((a == 114) | (a == 118)) & (b == 101)) | ((a == 108) & (b == 108))) & (room >= 3)
    size = np.where(one, 2, np.where(two, 3, 0))
    return at[size > 0], size[size > 0]


def pieces(data: np.ndarray, cls: np.ndarray, offs: np.ndarray, words_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece. words_only: white space is dropped and each digit stands alone; else it is kept, a single space with what follows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cont = (data & 0xC0) == 0x80
    breaks = np.ones(n, bool)
    breaks[1:] = (cls[1:] != cls[:-1]) | ((cls[1:] == DIGIT) if words_only else False)
    breaks &= ~cont
    inner = offs[(offs > 0) & (offs < n)]
    breaks[inner] = True
    text_end = np.repeat(offs[1:], np.diff(offs))
    if words_only:
        begins = np.flatnonzero(breaks & (cls == OTHER))
    else:
        spaced = np.zeros(n, bool)  # a run that the space before it belongs to
        spaced[1:] = (data[:-1] == 32) & breaks[1:] & (cls[1:] != SPACE)
        spaced[offs[:-1][offs[:-1] < n]] = False
        begins = np.flatnonzero(breaks & (cls == OTHER) & ~spaced)
    at, size = _contractions(data, begins, text_end)
    if len(at):
        breaks[at + 1] = False
        after = at + size
        ok = (after < text_end[at]) & (cls[np.minimum(after, n - 1)] == LETTER)
        breaks[after[ok]] = True
    if not words_only:
        runs = np.flatnonzero(spaced)
        breaks[runs], breaks[runs - 1] = False, True  # the last space of the run opens the next piece
        # of other white space before a word, the last character stands alone
        ends = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE)) if n > 1 else np.zeros(0, np.int64)
        ends = ends[(ends + 1 < text_end[ends])]
        breaks[ends] = True
    edge = np.append(np.flatnonzero(breaks), n)
    starts, ends = edge[:-1], edge[1:]
    if words_only:
        keep = cls[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


class Merges:
    """The vocabulary and merges of a tokenizer file, applied to many pieces at once."""

    def __init__(self, path: str):
        file = json.load(open(path))
        model, self.path = file["model"], path
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in file["added_tokens"]}
        self.size = max(names) + 1
        self.names = [names.get(i, "") for i in range(self.size)]
        byte_of = _byte_letters()
        self.base = np.array([vocab[byte_of[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[byte_of[b] + self.suffix] for b in range(256)], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        a, b, self.made = np.array(pairs, np.int64).T
        self.table = _PairTable(a, b, self.size)
        left, right = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
        self.first_ranks = self.table.rank(self.base[left], self.base[right])
        self.last_ranks = self.table.rank(self.base[left], self.last[right])

    @cached_property
    def library(self):
        """The tokenizers library's own object; few texts need it, so it is loaded for the first of them."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, how many of each piece)."""
        size = ends - starts
        counts = np.zeros(len(starts), np.int64)
        parts, owners = [], []
        for lo, hi in ((1, 4), (5, 8), (9, 12), (13, 20), (21, 40), (41, 120), (121, _LONGEST)):
            sel = np.flatnonzero((size >= lo) & (size <= hi))
            for some in np.array_split(sel, max(1, len(sel) * hi // 4_000_000)):
                if len(some):
                    self._merge(data, starts[some], size[some], some, parts, owners)
        for i in np.flatnonzero(size > _LONGEST):
            ids = [t.id for t in self.library.model.tokenize("".join(_byte_letters()[b] for b in data[starts[i] : ends[i]]))]
            parts.append(np.array(ids, np.int64))
            owners.append(np.full(len(ids), i))
        if not parts:
            return np.zeros(0, np.int64), counts
        ids, owner = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(starts))

    def _merge(self, data, starts, size, owner, parts, owners):
        """Per piece and round, the leftmost pair of least rank is merged, until none is left.

        Each row of ``tok`` has a column before and one behind it that pair with nothing; ``back``
        and ``ahead`` lead from each token to its neighbours that still stand.
        """
        n, width = len(starts), int(size.max())
        w = width + 2
        cols = np.arange(width)
        letters = data[np.minimum(starts[:, None] + cols, len(data) - 1)].astype(np.int64)
        rows = np.arange(n)
        tok = np.full((n, w), self.size, np.int64)
        tok[:, 1:-1] = self.base[letters]
        tok[rows, size] = self.last[letters[rows, size - 1]]
        standing = np.zeros((n, w), bool)
        standing[:, 1:-1] = cols[None, :] < size[:, None]
        tok[~standing] = self.size
        rank = np.full((n, w), NONE, np.int32)
        if width > 1:
            pair = letters[:, :-1] * 256 + letters[:, 1:]
            rank[:, 1:-2] = self.first_ranks[pair]
            some = size > 1
            rank[rows[some], size[some] - 1] = self.last_ranks[pair[rows[some], size[some] - 2]]
            rank[:, 1:-1][cols[None, :] >= size[:, None] - 1] = NONE
        back = np.tile(np.arange(-1, w - 1, dtype=np.int64), (n, 1)).ravel()
        ahead = np.tile(np.arange(1, w + 1, dtype=np.int64), (n, 1)).ravel()
        tok, stand, flat = tok.ravel(), standing.ravel(), rank.ravel()
        row = rows
        while len(row):
            mine = rank if len(row) == n else rank[row]
            j = mine.argmin(axis=1)
            at = row * w + j
            best = flat[at]
            go = best != NONE
            if not go.all():
                row, at, best = row[go], at[go], best[go]
            if not len(row):
                break
            home = row * w
            gone = home + ahead[at]
            after = home + ahead[gone]
            before = home + back[at]
            new = self.made[best]
            tok[at] = new
            stand[gone] = False
            ahead[at], back[after] = after - home, at - home
            flat[gone] = NONE
            flat[at] = self.table.rank(new, tok[after])
            flat[before] = self.table.rank(tok[before], new)
        parts.append(tok[stand])
        owners.append(np.repeat(owner, standing.sum(axis=1)))


class _PairTable:
    """Rank of a pair of tokens: hashed, with what collides in smaller tables behind."""

    def __init__(self, a: np.ndarray, b: np.ndarray, size: int):
        self.size, self.levels = size + 1, []
        key, rank, bits = a * self.size + b, np.arange(len(a), dtype=np.int32), 20
        while len(key):
            slot = self._slot(key, bits)
            _, first = np.unique(slot, return_index=True)
            keys, ranks, more = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32), np.zeros(1 << bits, bool)
            keys[slot[first]], ranks[slot[first]] = key[first], rank[first]
            rest = np.ones(len(key), bool)
            rest[first] = False
            more[slot[rest]] = True
            self.levels.append((bits, keys, ranks, more))
            key, rank, bits = key[rest], rank[rest], max(10, bits - 3)

    @staticmethod
    def _slot(key: np.ndarray, bits: int) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * bits)) >> np.uint64(64 - bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        out = np.full(key.shape, NONE, np.int32)
        todo = None
        for bits, keys, ranks, more in self.levels:
            k = key if todo is None else key[todo]
            slot = self._slot(k, bits)
            hit = keys[slot] == k
            if todo is None:
                out = np.where(hit, ranks[slot], NONE)
                todo = np.flatnonzero(~hit & more[slot])
            else:
                out[todo[hit]] = ranks[slot[hit]]
                todo = todo[~hit & more[slot]]
            if not len(todo):
                break
        return out


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {}, 0
    for b in range(256):
        out[b] = chr(b) if b in set(plain) else chr(256 + extra)
        extra += b not in set(plain)
    return [out[b] for b in range(256)]


_LETTERS = _byte_letters()
_byte_letters = lambda: _LETTERS


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """128 bits for each piece, as two independent hashes."""
    return T.word_hashes(data, starts, ends, 2)


def distinct(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a place of each distinct pair of hashes, for each place its distinct one, counts)."""
    order = np.argsort(hashes[0])
    first, second = hashes[0][order], hashes[1][order]
    same = first[1:] == first[:-1]
    if (same & (second[1:] != second[:-1])).any():
        order = np.lexsort((hashes[1], hashes[0]))
        first, second = hashes[0][order], hashes[1][order]
        same = (first[1:] == first[:-1]) & (second[1:] == second[:-1])
    new = np.ones(len(order), bool)
    new[1:] = ~same
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return order[heads], group, np.diff(np.append(heads, len(order)))
