"""A minimal acyclic transducer of frequent words, stored as memory-mapped arrays.

States that accept the same endings are shared, so the automaton stays small; each edge
carries a number, and the numbers along an accepted word add up to the word's rank in byte
order. Ranks index the id lists stored beside it.
"""

from __future__ import annotations

import json

import numpy as np

from repairlens.llm import textops as T


def _minimal(words: list[bytes]) -> tuple[list[dict], list[bool]]:
    """Edges and finality of the minimal automaton of words in ascending order (Daciuk et al., 2000); state 0 is the start."""
    edges: list[dict] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int, int]] = []  # (from, byte, to) of the states that the last word opened

    def settle(upto: int):
        while len(path) > upto:
            start, byte, state = path.pop()
            key = (final[state], tuple(edges[state].items()))
            same = register.setdefault(key, state)
            if same != state:
                edges[start][byte] = same
                spare.append(state)

    spare: list[int] = []
    last = b""
    for word in words:
        common = 0
        top = min(len(word), len(last))
        while common < top and word[common] == last[common]:
            common += 1
        settle(common)
        state = path[-1][2] if path else 0
        for byte in word[common:]:
            if spare:
                new = spare.pop()
                edges[new], final[new] = {}, False
            else:
                new = len(edges)
                edges.append({})
                final.append(False)
            edges[state][byte] = new
            path.append((state, byte, new))
            state = new
        final[state] = True
        last = word
    settle(0)
    return edges, final


def compile_lexicon(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The automaton of the given distinct words and their ids, as the bytes of one file."""
    order = sorted(range(len(words)), key=words.__getitem__)
    words, ids = [words[i] for i in order], [ids[i] for i in order]
    edges, final = _minimal(words)
    symbols = sorted({b for e in edges for b in e})
    column = np.full(256, len(symbols), np.uint8)
    column[symbols] = np.arange(len(symbols))
    below: dict[int, int] = {}

    def count(root: int) -> None:
        """Words that end at or below each state, without recursion."""
        todo = [root]
        while todo:
            s = todo[-1]
            missing = [t for t in edges[s].values() if t not in below]
            if missing:
                todo.extend(missing)
            else:
                below[s] = final[s] + sum(below[t] for t in edges[s].values())
                todo.pop()

    count(0)
    names = {s: i for i, s in enumerate(sorted(below))}
    width = len(symbols) + 1
    move = np.full((len(names) + 1, width), len(names) << 32, np.int64)  # the last state is the dead end
    for s, i in names.items():
        number = int(final[s])
        for byte, t in sorted(edges[s].items()):
            move[i, column[byte]] = names[t] << 32 | number
            number += below[t]
    counts = np.array([len(x) for x in ids], np.int64)
    arrays = {
        "move": move.ravel(),
        "final": np.array([final[s] for s in sorted(below)] + [False]),
        "column": column,
        "offsets": np.concatenate([[0], np.cumsum(counts)]),
        "ids": np.array([i for x in ids for i in x], np.int32),
    }
    head, body = {"width": width, "words": len(words), "states": len(names), "arrays": {}}, b""
    for name, values in arrays.items():
        body += bytes(-len(body) % 64)
        head["arrays"][name] = [values.dtype.str, len(values), len(body)]
        body += values.tobytes()
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    return len(text).to_bytes(8, "little") + text + body


class Lexicon:
    """The arrays of a compiled file, mapped into memory and shared by all readers of a machine."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            size = int.from_bytes(f.read(8), "little")
            head = json.loads(f.read(size))
        for name, (kind, n, at) in head["arrays"].items():
            setattr(self, name, np.memmap(file, kind, "r", 8 + size + at, (n,)) if n else np.zeros(0, kind))
        self.width = head["width"]

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each piece among the words, -1 for others. All pieces step through the automaton together."""
        size = ends - starts
        state, rank = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        dead = len(self.final) - 1
        symbol = np.asarray(self.column)[data].astype(np.int64)
        move = np.asarray(self.move)
        active, at, now, sums = np.arange(len(starts)), starts, state, rank
        step = 0
        while len(active):
            over = size[active] == step
            if over.any():
                done = active[over]
                state[done], rank[done] = now[over], sums[over]
                keep = ~over
                active, at, now, sums = active[keep], at[keep], now[keep], sums[keep]
            edge = move[now * self.width + symbol[at + step]] if len(active) else np.zeros(0, np.int64)
            now = edge >> 32
            sums = sums + (edge & 0xFFFFFFFF)
            lost = now == dead
            if lost.any():
                state[active[lost]] = dead
                keep = ~lost
                active, at, now, sums = active[keep], at[keep], now[keep], sums[keep]
            step += 1
        return np.where(np.asarray(self.final)[state], rank, -1)

    def spans(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words of these ranks begin, and how many they are."""
        offs = np.asarray(self.offsets)
        return offs[ranks], offs[ranks + 1] - offs[ranks]


def ids_of(lexicon: Lexicon, ranks: np.ndarray, other_ids: np.ndarray, other_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after another, counts) of pieces in order: of known ranks from the lexicon, of the rest (rank -1 - n) from the others' n-th."""
    known = ranks >= 0
    starts, counts = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
    starts[known], counts[known] = lexicon.spans(ranks[known])
    n = -1 - ranks[~known]
    starts[~known], counts[~known] = (np.cumsum(other_counts) - other_counts)[n], other_counts[n]
    at, own = T.ragged(starts, counts), np.repeat(known, counts)
    out = np.empty(len(at), np.int64)
    out[own], out[~own] = lexicon.ids[at[own]], other_ids[at[~own]]
    return out, counts
