"""A minimal perfect hash over 128-bit keys (levels of bit arrays with ranks, after Limasset et al., 2017)."""

from __future__ import annotations

import json

import numpy as np

from repairlens.llm import textops as T


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (T.mix(h1 ^ T.mix(h2, level), level) % np.uint64(size)).astype(np.int64)


def build(h1: np.ndarray, h2: np.ndarray, gamma: float = 2.0) -> list[np.ndarray]:
    """The levels' bits. Keys must differ; each level keeps the keys that have a place alone, the rest goes on."""
    levels = []
    while len(h1):
        size = max(8, int(gamma * len(h1)))
        at = _places(h1, h2, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rest = ~alone[at]
        h1, h2 = h1[rest], h2[rest]
        if len(levels) > 200:
            raise ValueError("keys repeat")
    return levels


def _count(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words).astype(np.int64)


class Index:
    """An index file: levels of bits with a running count for each 64 of them, and per slot a 32-bit fingerprint and the values.

    ``read(offset, size)`` gives bytes of the file. A key is found by reading a few bytes at
    places that don't depend on how many keys there are; ``load`` reads all for many look-ups.
    """

    def __init__(self, read):
        size = int.from_bytes(read(0, 8), "little")
        self.read, self.head = read, json.loads(read(8, size))
        self.base = 8 + size

    def _take(self, name: str, at: np.ndarray) -> np.ndarray:
        kind, _, begin = self.head["arrays"][name]
        width = np.dtype(kind).itemsize
        return np.array([np.frombuffer(self.read(self.base + begin + int(i) * width, width), kind)[0] for i in at], kind)

    def load(self) -> Index:
        whole = {name: np.frombuffer(self.read(self.base + begin, n * np.dtype(kind).itemsize), kind) for name, (kind, n, begin) in self.head["arrays"].items()}
        self._take = lambda name, at: whole[name][at]
        return self

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of each key, 0 to n - 1; of a key that wasn't there, any slot or -1."""
        out, todo = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        first = 0
        for level, size in enumerate(self.head["sizes"]):
            at = _places(h1[todo], h2[todo], level, size)
            word, bit = first + (at >> 6), (at & 63).astype(np.uint64)
            held = self._take("bits", word)
            hit = (held >> bit) & np.uint64(1) == 1
            below = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self._take("ranks", word[hit]) + _count(below)
            todo, first = todo[~hit], first + -(-size // 64)
            if not len(todo):
                break
        return out

    def find(self, h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
        """The values of each key, and whether it was found."""
        at = self.slots(h1, h2)
        some = np.flatnonzero(at >= 0)
        found = np.zeros(len(at), bool)
        found[some] = self._take("print", at[some]) == _print(h2[some])
        out = {"found": found}
        for name in self.head["values"]:
            values = self._take(name, at[found])
            out[name] = np.zeros(len(at), values.dtype)
            out[name][found] = values
        return out


def dumps(h1: np.ndarray, h2: np.ndarray, values: dict[str, np.ndarray]) -> bytes:
    """An index file of distinct keys."""
    levels = build(h1, h2)
    sizes = [len(x) for x in levels]
    padded = [np.packbits(np.pad(x, (0, -len(x) % 64)), bitorder="little").view("<u8") for x in levels]
    bits = np.concatenate(padded) if levels else np.zeros(0, "<u8")
    counts = _count(bits)
    arrays = {"bits": bits, "ranks": (np.cumsum(counts) - counts).astype("<i8")}

    def pack(more: dict[str, np.ndarray]) -> bytes:
        head, body = {"sizes": sizes, "values": list(values), "arrays": {}}, b""
        for name, x in {**arrays, **more}.items():
            head["arrays"][name] = [x.dtype.str, len(x), len(body)]
            body += x.tobytes()
        text = json.dumps(head).encode()
        return len(text).to_bytes(8, "little") + text + body

    order = np.empty(len(h1), np.int64)
    order[loads(pack({})).slots(h1, h2)] = np.arange(len(h1))
    return pack({"print": _print(h2)[order]} | {k: v[order] for k, v in values.items()})


def _print(h2: np.ndarray) -> np.ndarray:
    return (T.mix(h2, 77) >> np.uint64(32)).astype(np.uint32)


def loads(data: bytes) -> Index:
    """The index in the bytes of a whole file."""
    return Index(lambda at, size: data[at : at + size]).load()
