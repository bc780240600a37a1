"""Members that an ancestor also holds, found in one task for each way up the clone graph.

A way is a series of ancestors; all sets that begin with the same ancestor share it. Members come as packs of arrays, those
of the way's ancestors first, and keys for the comparison are built in memory only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bits of a pack's mask: which facts a member knows, in order, whether it is a disk, whether it may be merged.
FACTS = ["size", "crc", "sha1", "sha256", "md5"]
DISK, ASKS = 1 << len(FACTS), 1 << len(FACTS) + 1
#: Packs that are compared at once.
PACKS = 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(k: np.ndarray) -> np.ndarray:
    k = (k ^ (k >> np.uint64(32))) * _ODD
    return k ^ (k >> np.uint64(29))


def _keys(way: np.ndarray, facts: list[np.ndarray], both: int) -> np.ndarray:
    """One number for a way and the facts that both sides know."""
    k = way
    for i, v in enumerate(facts):
        if both >> i & 1:
            k = _mix(k ^ v)
    return k


class _Held:
    """Members of the ancestors of the ways at hand."""

    def __init__(self):
        self.parts, self.last, self.index = [], {}, {}

    def add(self, way: np.ndarray, mask: np.ndarray, facts: list[np.ndarray]) -> None:
        self.parts.append((way, mask, facts))
        self.last, self.index = {}, {}

    def keep(self, way: np.uint64) -> None:
        """Only the last way goes on in the next packs."""
        if all(w.size and (w == way).all() for w, _, _ in self.parts):
            return
        kept = [(w == way, w, m, f) for w, m, f in self.parts]
        self.parts = [(w[at], m[at], [v[at] for v in f]) for at, w, m, f in kept if at.any()]
        self.last, self.index = {}, {}

    def by_pattern(self) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
        if not self.last and self.parts:
            way, mask = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1))
            facts = [np.concatenate([p[2][i] for p in self.parts]) for i in range(len(FACTS))]
            self.parts = [(way, mask, facts)]
            pattern = mask & (ASKS - 1)
            self.last = {int(p): (way[at], [v[at] for v in facts]) for p in np.unique(pattern) for at in [pattern == p]}
        return self.last

    def keys(self, pattern: int, both: int) -> np.ndarray:
        if (pattern, both) not in self.index:
            self.index[pattern, both] = np.unique(_keys(*self.by_pattern()[pattern], both))
        return self.index[pattern, both]


def _facts(packs: pa.RecordBatch, mask: np.ndarray) -> list[np.ndarray]:
    """The facts of all members, 0 where unknown; packs leave unknown ones out."""
    out = []
    for i, c in enumerate(FACTS):
        v = np.zeros(len(mask), np.uint64)
        v[(mask >> i & 1) == 1] = packs.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        out.append(_mix(v) if c == "size" else v)
    return out


def _found(held: _Held, way: np.ndarray, mask: np.ndarray, facts: list[np.ndarray], asks: np.ndarray) -> np.ndarray:
    """Which of the members that ask agree with a member held on all facts that both know, and on being a disk."""
    hit = np.zeros(len(mask), bool)
    pattern = mask & (ASKS - 1)
    for p in map(int, np.unique(pattern[asks])):
        at = np.flatnonzero(asks & (pattern == p))
        # whoever is found by few facts needs no more
        for q in sorted((q for q in held.by_pattern() if (p ^ q) & DISK == 0), key=lambda q: (p & q).bit_count()):
            there = held.keys(q, both := p & q & (DISK - 1))
            mine = _keys(way[at], [v[at] for v in facts], both)
            found = there[np.minimum(np.searchsorted(there, mine), len(there) - 1)] == mine
            hit[at[found]] = True
            at = at[~found]
            if not len(at):
                break
    return hit


def held_above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(game, pack, bits) of packs with members that the ancestors of their set's way also hold; a bit for each such member's place.

    Packs: way, asks, game, pack, places, mask and the facts, sorted by (way, asks), so that a way's ancestors come before
    the sets that ask. A task holds the members of the ancestors of ``PACKS`` packs, and those of the way that goes on.
    """
    held = _Held()
    for batch in batches:
        for start in range(0, batch.num_rows, PACKS):
            packs = batch.slice(start, PACKS)
            way, asking = packs.column("way").to_numpy().view(np.uint64), packs.column("asks").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(way)), pc.list_value_length(packs.column("mask")).to_numpy())
            mask = packs.column("mask").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            facts, key, mine = _facts(packs, mask), way[row], asking[row]
            if not mine.all():
                held.add(key[~mine], mask[~mine], [v[~mine] for v in facts])
            hit = _found(held, key, mask, facts, mine & (mask & ASKS > 0))
            if hit.any():
                some, starts = np.unique(row[hit], return_index=True)
                bits = np.int64(1) << packs.column("places").flatten().to_numpy(zero_copy_only=False)[hit[mine]].astype(np.int64)
                yield pa.RecordBatch.from_arrays([packs.column("game").take(pa.array(some)), packs.column("pack").take(pa.array(some)), pa.array(np.bitwise_or.reduceat(bits, starts))], names=["game", "pack", "bits"])
            held.keep(way[-1])
