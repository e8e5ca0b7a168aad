"""A bounded case as two distance tables, from which its cycles, layers, colours, spans and paths are read."""

from __future__ import annotations

import numpy as np


def distances(arcs: np.ndarray) -> np.ndarray:
    """Least number of steps between all accounts, -1 where there is no way: the frontiers of all starts move at once."""
    n = len(arcs)
    out = np.full((n, n), -1, np.int32)
    front, step = np.eye(n, dtype=bool), 0
    weights = arcs.astype(np.float32)
    while front.any():
        out[front] = step
        step += 1
        front = (front.astype(np.float32) @ weights > 0) & (out < 0)
    return out


class Case:
    """Accounts in id order; arcs: distinct pairs without loops; transfers: how many there are of each."""

    def __init__(self, src, dst):
        names = np.unique(np.concatenate((np.asarray(src, dtype=object), np.asarray(dst, dtype=object))).astype(str))
        self.names, n = names, len(names)
        a, b = np.searchsorted(names, np.asarray(src, dtype=str)), np.searchsorted(names, np.asarray(dst, dtype=str))
        self.transfers = np.bincount(a * n + b, minlength=n * n).reshape(n, n)
        np.fill_diagonal(self.transfers, 0)
        self.arcs = self.transfers > 0
        self.ways = distances(self.arcs)
        self.apart = distances(self.arcs | self.arcs.T)

    def n_transfers(self) -> int:
        return int(self.transfers.sum())

    def cycle(self, least: int, most: int) -> int | None:
        """The shortest directed cycle of `least` to `most` accounts: an arc and the shortest way back."""
        back = np.where(self.arcs, self.ways.T, -1)
        found = back[(back + 1 >= least) & (back + 1 <= most)]
        return int(found.min()) + 1 if len(found) else None

    def sides(self) -> np.ndarray:
        """By account: whether its distance from the first account of its component is odd."""
        first = (self.apart >= 0).argmax(axis=0)
        return self.apart[first, np.arange(len(first))] % 2 == 1

    def across(self) -> tuple[int, int, int]:
        """Transfers between the sides, distinct pairs between them, pairs within one."""
        odd = self.sides()
        other = odd[:, None] != odd[None, :]
        return int(self.transfers[other].sum()), int(self.arcs[other].sum()), int(self.arcs[~other].sum())

    def layers(self, width: int) -> list[int]:
        """Sizes of the successive layers, each of `width` accounts or more, from the source that has most of them."""
        sources = np.flatnonzero(~self.arcs.any(axis=0))
        best: list[int] = []
        for row in self.ways[sources if len(sources) else slice(None)]:
            sizes = np.bincount(row[row > 0], minlength=2)[1:]
            own = sizes[: int((np.append(sizes, 0) < width).argmax())].tolist()
            best = own if len(own) > len(best) else best
        return best

    def diameter(self) -> int | None:
        """The largest undirected distance inside a component; null for fewer than two accounts."""
        return int(self.apart.max()) if len(self.names) > 1 else None

    def longest_path(self, budget: int) -> int:
        """Arcs of the longest simple path: exact up to `budget` accounts, beyond that what a greedy walk finds."""
        return self._exact() if len(self.names) <= budget else self._greedy()

    def _exact(self) -> int:
        """Remembers by account and the set of accounts still open to it, so equal remainders are searched once."""
        n = len(self.names)
        after = [[int(w) for w in np.flatnonzero(row)] for row in self.arcs]
        open_to = [sum(1 << int(w) for w in np.flatnonzero(row > 0)) for row in self.ways]
        known: dict[tuple[int, int], int] = {}

        def rest(v: int, free: int) -> int:
            free &= open_to[v]
            if (v, free) not in known:
                most = free.bit_count()
                best = 0
                for w in after[v]:
                    if free >> w & 1:
                        best = max(best, 1 + rest(w, free & ~(1 << w)))
                        if best == most:
                            break
                known[v, free] = best
            return known[v, free]

        return max((rest(v, (1 << n) - 1 & ~(1 << v)) for v in range(n)), default=0)

    def _greedy(self) -> int:
        """From every account to the new neighbour with most neighbours of its own (the last id of equals), until none is new."""
        order = np.lexsort((np.arange(len(self.names)), self.arcs.sum(axis=1)))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        best = 0
        for v in range(len(self.names)):
            new, steps = np.ones(len(order), bool), 0
            new[v] = False
            while (choice := rank * (self.arcs[v] & new)).any():
                v = int(choice.argmax())
                new[v] = False
                steps += 1
            best = max(best, steps)
        return best


class LargeCase:
    """A case of many accounts by lists of neighbours: what `Case` tells of cycles, colours and layers, in memory that grows with its pairs."""

    def __init__(self, src, dst):
        names = np.unique(np.concatenate((np.asarray(src, dtype=object), np.asarray(dst, dtype=object))).astype(str))
        self.names, n = names, len(names)
        a, b = np.searchsorted(names, np.asarray(src, dtype=str)), np.searchsorted(names, np.asarray(dst, dtype=str))
        self.pairs, self.times = np.unique(np.stack((a, b))[:, a != b], axis=1, return_counts=True)
        self.after, self.before = self._lists(*self.pairs), self._lists(*self.pairs[::-1])

    def _lists(self, a, b) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(a, kind="stable")
        return b[order], np.searchsorted(a[order], np.arange(len(self.names) + 1))

    @staticmethod
    def _next(front, lists) -> np.ndarray:
        to, ends = lists
        size = ends[front + 1] - ends[front]
        return to[np.repeat(ends[front] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def _ways(self, start: int, *lists, most: int | None = None) -> np.ndarray:
        """Least number of steps from one account, -1 where there is no way of at most `most`."""
        out = np.full(len(self.names), -1, np.int32)
        front, step = np.array([start]), 0
        while len(front) and (most is None or step <= most):
            out[front] = step
            step += 1
            near = np.concatenate([self._next(front, x) for x in lists])
            front = np.unique(near[out[near] < 0])
        return out

    def n_transfers(self) -> int:
        return int(self.times.sum())

    def cycle(self, least: int, most: int) -> int | None:
        best = most + 1
        for v in range(len(self.names)):
            into = self.before[0][self.before[1][v] : self.before[1][v + 1]]
            if len(into) and self.after[1][v] < self.after[1][v + 1]:
                steps = self._ways(v, self.after, most=best - 2)[into] + 1  # an arc into v, and the shortest way to where it starts
                found = steps[(steps >= least) & (steps < best)]
                best = int(found.min()) if len(found) else best
                if best == least:
                    break
        return best if best <= most else None

    def sides(self) -> np.ndarray:
        odd, seen = np.zeros(len(self.names), bool), np.zeros(len(self.names), bool)
        for v in range(len(self.names)):
            if not seen[v]:
                front, step = np.array([v]), 0
                while len(front):
                    seen[front], odd[front] = True, step % 2 == 1
                    step += 1
                    near = np.concatenate([self._next(front, x) for x in (self.after, self.before)])
                    front = np.unique(near[~seen[near]])
        return odd

    def across(self) -> tuple[int, int, int]:
        odd = self.sides()
        other = odd[self.pairs[0]] != odd[self.pairs[1]]
        return int(self.times[other].sum()), int(other.sum()), int((~other).sum())

    def layers(self, width: int) -> list[int]:
        n = len(self.names)
        sources = np.setdiff1d(np.arange(n), self.pairs[1])
        best: list[int] = []
        for v in sources if len(sources) else range(n):
            row = self._ways(v, self.after)
            sizes = np.bincount(row[row > 0], minlength=2)[1:]
            own = sizes[: int((np.append(sizes, 0) < width).argmax())].tolist()
            best = own if len(own) > len(best) else best
        return best
