"""Itemsets of one group of baskets, in plain Python: no Spark here.

An itemset belongs to its core: its least frequent item (largest rank), or its several least frequent ones. The rows
of a core are its baskets cut down to the more frequent items, equal ones combined, so a frequent item's rows are
few. Sets are closed among these items only. Each has a mark, the XOR of the hashes of its baskets: of the sets of
one mark, which are in the same baskets, the largest is the closed one (`settle`).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np

Mark = tuple[int, int]


class Rows:
    """Occurrences as bit sets over the rows; weights as one bit set for each binary digit."""

    def __init__(self, flat: np.ndarray, own: np.ndarray, weight: np.ndarray, x: np.ndarray, y: np.ndarray, minsup: int):
        """flat[i] is a rank in row own[i]; ranks in less than minsup baskets are in no set of the group."""
        self.n, self.x, self.y = len(weight), x, y
        self.everything = (1 << self.n) - 1
        ranks, which = np.unique(flat, return_inverse=True)
        total = np.bincount(which, weights=weight[own], minlength=len(ranks)) if len(ranks) else np.empty(0)
        rows = np.split(own[np.argsort(which, kind="stable")], np.cumsum(np.bincount(which, minlength=len(ranks)))[:-1]) if len(ranks) else []
        self.bits = {int(r): self._pack(at) for r, t, at in zip(ranks, total, rows) if t >= minsup}
        top = int(weight.max()).bit_length() if self.n else 0
        self.planes = [(d, self._pack(np.flatnonzero(weight >> d & 1))) for d in range(top)]

    def _pack(self, at: np.ndarray) -> int:
        held = np.zeros(self.n, bool)
        held[at] = True
        return int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")

    def weigh(self, rows: int) -> int:
        return sum((rows & p).bit_count() << d for d, p in self.planes)

    def mark(self, rows: int) -> Mark:
        held = np.unpackbits(np.frombuffer(rows.to_bytes(-(-self.n // 8), "little"), np.uint8), bitorder="little")[: self.n].view(bool)
        return int(np.bitwise_xor.reduce(self.x[held])), int(np.bitwise_xor.reduce(self.y[held]))

    def sets(self, core: tuple[int, ...], occ: int, minsup: int, best: Best | None = None) -> Iterator[tuple[int, Mark, tuple[int, ...]]]:
        """(support, mark, ranks) of the sets of the core, `occ` being its rows, that are closed among ranks below it.

        Prefix-preserving extension: a set is extended by the candidates after its last one, and a closure that
        takes in an earlier candidate was or will be reached elsewhere.
        """
        whole = self.weigh(occ)
        if whole < minsup:
            return
        base, cands = list(core), []
        for r, b in self.bits.items():
            if r < core[-1]:
                x = b & occ
                if x == occ:
                    base.append(r)
                elif x and self.weigh(x) >= minsup:
                    cands.append((r, x))
        cands.sort(key=lambda c: (c[1].bit_count(), c[0]))
        if best and best.useless(whole, base, [c[0] for c in cands]):
            return
        yield whole, self.mark(occ), tuple(sorted(base))
        stack = [(occ, frozenset(), 0)]
        while stack:
            occ, taken, first = stack.pop()
            for i in range(first, len(cands)):
                if i in taken:
                    continue
                x = occ & cands[i][1]
                s = self.weigh(x)
                if s < minsup:
                    continue
                grown = {j for j, (_, c) in enumerate(cands) if x & c == x}
                if any(j < i and j not in taken for j in grown):
                    continue
                members = base + [cands[j][0] for j in grown]
                if best and best.useless(s, members, [cands[j][0] for j in range(i + 1, len(cands))]):
                    continue
                yield s, self.mark(x), tuple(sorted(members))
                stack.append((x, frozenset(grown), i + 1))


class Best:
    """The k best supports of each item seen so far: an item takes nothing below the last of them.

    Sets of one mark have one closure, so a mark counts once.
    """

    def __init__(self, k: int, bounds: dict[int, int] | None = None):
        self.k, self.bounds, self.held = k, bounds or {}, {}

    def bound(self, item: int) -> int:
        heap = self.held.get(item, ())
        return max(self.bounds.get(item, 0), heap[0][0] if len(heap) == self.k else 0)

    def add(self, support: int, mark: Mark, members: tuple[int, ...]) -> None:
        entry = (support, mark)
        for m in members:
            heap = self.held.setdefault(m, [])
            if entry in heap:
                continue
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif support > heap[0][0]:
                heapq.heapreplace(heap, entry)

    def useless(self, support: int, members: list[int], candidates: list[int]) -> bool:
        """True if no item that the set or its extensions hold takes this support. Equal supports are kept."""
        return all(support < self.bound(x) for x in members) and all(support < self.bound(x) for x in candidates)


def explore(rows: Rows, cores: Iterable[tuple[tuple[int, ...], int]], minsup: int, k: int | None = None, bounds: dict[int, int] | None = None) -> Iterator[tuple[int, Mark, tuple[int, ...]]]:
    """Sets of the cores (ranks, rows that hold them); with k, only those that may be among the k best of one of their items."""
    best = Best(k, bounds) if k else None
    for core, occ in cores:
        for support, mark, members in rows.sets(core, occ, minsup, best):
            if best:
                best.add(support, mark, members)
            yield support, mark, members


def settle(found: Iterable[tuple[int, Mark, tuple[int, ...]]]) -> list[tuple[int, tuple[int, ...]]]:
    """(support, ranks) of the largest set of each mark."""
    largest: dict[tuple[int, Mark], tuple[int, ...]] = {}
    for support, mark, members in found:
        if len(members) > len(largest.get((support, mark), ())):
            largest[support, mark] = members
    return [(support, members) for (support, _), members in largest.items()]


def mine(rows: Iterable[tuple[list[int], int]], starters: Iterable[int], minsup: int, k: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Closed sets of weighted baskets without Spark, `starters` being all ranks."""
    rows = list(rows)
    seeds = np.random.default_rng(0).integers(-(1 << 63), 1 << 63, (2, len(rows)))
    flat, own = np.array([r for ranks, _ in rows for r in ranks], np.int64), np.array([i for i, (ranks, _) in enumerate(rows) for _ in ranks], np.int64)
    held = Rows(flat, own, np.array([w for _, w in rows], np.int64), seeds[0], seeds[1], minsup)
    return settle(explore(held, [((s,), held.bits[s]) for s in starters if s in held.bits], minsup, k))
