"""BK-trees over 64-bit fingerprints, built and searched level by level with numpy.

A node's children are keyed by their integer Hamming distance to it. Many
trees, one per shard, live in one forest, so that small shards cost no Python
loop of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Verify = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Pairs that are screened at once.
SCREENED = 1 << 16
#: (query, node) pairs that are worked on at once.
FRONTIER = 1 << 21


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Labels:
    """Disjoint sets over 0..n-1; a set is named by its least member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if np.array_equal(up, self.of):
                    break
                self.of = up


class Forest:
    """The BK-trees of all shards; `shard` numbers the tree of each fingerprint.

    `verify` confirms pairs within the radius; `screen`, a cheaper condition
    that every confirmed pair meets, goes before it.
    """

    def __init__(self, keys: np.ndarray, shard: np.ndarray, radius: int, verify: Verify | None = None, screen: Verify | None = None):
        self.keys, self.radius, self.verify, self.screen = keys.astype(np.uint64), radius, verify, screen
        self.labels = Labels(len(keys))
        self.root = np.zeros(len(keys), dtype=np.int64)
        self._build(np.asarray(shard))

    def _build(self, shard: np.ndarray) -> None:
        n = len(self.keys)
        parent, edge = np.full(n, -1), np.zeros(n, dtype=np.int64)
        self.levels: list[np.ndarray] = []
        left = np.argsort(shard, kind="stable")
        code, above, by = shard[left], None, None
        while len(left):
            first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            sizes = np.diff(np.r_[first, len(left)])
            node = left[first]
            self.levels.append(node)
            if above is None:
                self.root[left] = np.repeat(node, sizes)
            else:
                parent[node], edge[node] = above[first], by[first]
            keep = np.ones(len(left), dtype=bool)
            keep[first] = False
            rest, over = left[keep], np.repeat(node, sizes)[keep]
            d = distance(self.keys[rest], self.keys[over])
            self._link(rest[d <= self.radius], over[d <= self.radius])
            at = np.lexsort((d, over))
            left, above, by = rest[at], over[at], d[at]
            code = above * 128 + by
        child = np.flatnonzero(parent >= 0)
        slot = parent[child] * 128 + edge[child]
        at = np.argsort(slot, kind="stable")
        self.child, self.slot, self.parent = child[at], slot[at], parent

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of pairs within the radius; one pair of two sets is verified at a time."""
        if self.screen is not None and len(a):
            differ = self.labels.of[a] != self.labels.of[b]
            a, b = a[differ], b[differ]
            parts = [self.screen(a[s : s + SCREENED], b[s : s + SCREENED]) for s in range(0, len(a), SCREENED)]
            passed = np.concatenate(parts) if parts else np.zeros(0, dtype=bool)
            a, b = a[passed], b[passed]
        while len(a):
            x, y = self.labels.of[a], self.labels.of[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            if not len(a):
                return
            if self.verify is None:
                self.labels.join(a, b)
                return
            _, pick = np.unique(np.minimum(x, y) * len(self.keys) + np.maximum(x, y), return_index=True)
            good = self.verify(a[pick], b[pick])
            self.labels.join(a[pick][good], b[pick][good])
            rest = np.ones(len(a), dtype=bool)
            rest[pick] = False
            a, b = a[rest], b[rest]

    def _uniform(self) -> np.ndarray:
        """For each node the set that its whole subtree belongs to, or -1."""
        of, out = self.labels.of, self.labels.of.copy()
        for level in reversed(self.levels[1:]):
            up = self.parent[level]
            odd = out[level] != of[up]
            out[up[odd]] = -1
        return out

    def components(self) -> np.ndarray:
        """The set of each fingerprint once all links within the radius are followed.

        Subtrees that lie wholly in the query's own set are not entered: a
        dense group costs about its size, not its square.
        """
        n, r, start, step = len(self.keys), self.radius, 0, 1024
        alone = np.bincount(self.root, minlength=n)[self.root] == 1
        queries = np.flatnonzero(~alone)
        while start < len(queries):
            chunk, start, step = queries[start : start + step], start + step, min(step * 2, 65536)
            uniform = self._uniform()
            stack = [(chunk, self.root[chunk])]
            while stack:
                q, node = stack.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    stack += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                live = uniform[node] != self.labels.of[q]
                q, node = q[live], node[live]
                if not len(q):
                    continue
                d = distance(self.keys[q], self.keys[node])
                hit = d <= r
                self._link(q[hit], node[hit])
                low = np.searchsorted(self.slot, node * 128 + np.maximum(d - r, 0), "left")
                high = np.searchsorted(self.slot, node * 128 + np.minimum(d + r, 64), "right")
                many = high - low
                total = int(many.sum())
                if total:
                    ends = np.cumsum(many)
                    at = np.arange(total) - np.repeat(ends - many - low, many)
                    stack.append((np.repeat(q, many), self.child[at]))
        return self.labels.of
