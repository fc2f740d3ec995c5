"""A minimal acyclic transducer: words to sequences of ids, in one flat block of bytes that is memory-mapped.

Words are added in order (the incremental construction of Mihov and Maurel): as soon as a suffix can't change
any more, its states are replaced by equal ones that are there already, so words share their ends as well as
their beginnings.  Ids are moved towards the root, so that they stand in the way of sharing as little as
possible.  The block holds the arcs sorted by state and byte, their targets, and the ids that each arc or last
state adds; look-ups walk it where it lies, many words at a time, without building any object for a state.
"""

from __future__ import annotations

import mmap
import struct
from collections.abc import Iterable

import numpy as np

MAGIC = b"mwlex002"


class _State:
    __slots__ = ("arcs", "ends")

    def __init__(self) -> None:
        self.arcs: dict[int, list] = {}  # byte: [ids, state]; a frozen state is its number
        self.ends: tuple[int, ...] | None = None  # ids that a word adds when it ends here


def _common(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def compile_lexicon(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The block for ``words``, which may come in any order; of a word that repeats the last ids count."""
    words = dict(words)
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []

    def freeze(state: _State) -> int:
        key = (state.ends, tuple((b, ids, target) for b, (ids, target) in state.arcs.items()))
        if key not in register:
            register[key] = len(frozen)
            frozen.append(key)
        return register[key]

    path, last = [_State()], b""
    for word, ids in sorted(words.items()):
        shared = _common(word, last)
        for k in range(len(last), shared, -1):
            path[k - 1].arcs[last[k - 1]][1] = freeze(path.pop())
        for k in range(shared):  # keep on each arc what both words begin with, move the rest on
            arc, after = path[k].arcs[word[k]], path[k + 1]
            n = _common(arc[0], ids)
            rest, ids = arc[0][n:], ids[n:]
            if rest:
                arc[0] = arc[0][:n]
                for other in after.arcs.values():
                    other[0] = rest + other[0]
                if after.ends is not None:
                    after.ends = rest + after.ends
        for byte in word[shared:]:
            path[-1].arcs[byte] = [ids, None]
            ids = ()
            path.append(_State())
        path[-1].ends = ids
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1].arcs[last[k - 1]][1] = freeze(path.pop())
    root = freeze(path[0])

    pool: dict[tuple, int] = {(): 0}
    keys, targets, adds, ends = [], [], [], []
    for state, (final, arcs) in enumerate(frozen):
        ends.append(0 if final is None else 1 + pool.setdefault(final, len(pool)))
        for byte, ids, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            adds.append(pool.setdefault(ids, len(pool)))
    at, flat = [0], []
    for ids in pool:
        flat += ids
        at.append(len(flat))
    head = struct.pack("<8s6I", MAGIC, root, len(frozen), len(keys), len(pool), len(flat), max(map(len, words), default=0))
    return head + np.array([*ends, *keys, *targets, *adds, *at, *flat], "<u4").tobytes()


class Lexicon:
    """Looks words up in a block: bytes, or a memory-mapped file."""

    def __init__(self, block: bytes | mmap.mmap):
        magic, self.root, self.states, arcs, pool, flat, self.longest = struct.unpack_from("<8s6I", block)
        if magic != MAGIC:
            raise ValueError("not a compiled lexicon")
        numbers = np.frombuffer(block, "<u4", offset=struct.calcsize("<8s6I"))
        cuts = np.cumsum([self.states, arcs, arcs, arcs, pool + 1])
        self.ends, self.keys, self.targets, self.adds, at, flat = np.split(numbers, cuts)
        flat, at = flat.tobytes(), (4 * at).tolist()
        self.pool = [flat[i:j] for i, j in zip(at, at[1:])]  # what an arc or an end can add

    @classmethod
    def open(cls, path: str) -> Lexicon:
        with open(path, "rb") as file:
            return cls(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))

    def get(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids as 32-bit integers in a row, or None: all words go from state to state together."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes
        row = np.flatnonzero(sizes <= self.longest)
        state = np.full(len(row), self.root, np.uint32)
        found, steps, k = np.zeros(len(words), bool), [], 0
        while len(row):
            over = sizes[row] == k
            if over.any():
                end = self.ends[state[over]]
                ended, end = row[over][end > 0], end[end > 0] - 1
                found[ended] = True
                steps.append((ended, end))
                row, state = row[~over], state[~over]
            key = state << np.uint32(8) | data[starts[row] + k]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else np.zeros(0, np.int64)
            on = self.keys[arc] == key if len(arc) else np.zeros(len(row), bool)
            row, arc = row[on], arc[on] if len(arc) else arc
            steps.append((row, self.adds[arc]))
            state = self.targets[arc]
            k += 1
        out: list[bytes | None] = [b"" if hit else None for hit in found.tolist()]
        for rows, pool in steps:
            some = (pool > 0) & found[rows]
            for r, p in zip(rows[some].tolist(), pool[some].tolist()):
                out[r] += self.pool[p]
        return out
