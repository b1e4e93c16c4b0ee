"""BK-trees over fingerprints of one or more 64-bit numbers, many at once, as arrays."""

from __future__ import annotations

import numpy as np

#: Pairs of query and node that are looked at together.
FRONTIER = 2_000_000


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the rows of a and b."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """One BK-tree for each run of equal `tree` numbers; the rows of `prints` must differ inside a tree.

    The first fingerprint of a tree is its root. Level by level, the fingerprints below a node part
    by their Hamming distance to it; the first of each part becomes the child at that distance.
    """

    def __init__(self, tree: np.ndarray, prints: np.ndarray):
        self.prints = prints
        #: A node's children are found by node * width + distance.
        self.width = 64 * prints.shape[1] + 1
        first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.zeros(0, np.int64)
        self.root_of_tree = dict(zip(tree[first].tolist(), first.tolist(), strict=True))
        at = np.repeat(first, np.diff(np.r_[first, len(tree)]))
        waiting = np.flatnonzero(at != np.arange(len(tree)))
        at = at[waiting]
        keys, nodes = [], []
        while len(waiting):
            slot = at * self.width + distance(prints[waiting], prints[at])
            order = np.argsort(slot, kind="stable")
            waiting, slot = waiting[order], slot[order]
            starts = np.r_[True, slot[1:] != slot[:-1]]
            child = waiting[starts]
            keys.append(slot[starts])
            nodes.append(child)
            below = child[np.cumsum(starts) - 1]
            waiting, at = waiting[~starts], below[~starts]
        key = np.concatenate([*keys, np.zeros(0, np.int64)])
        order = np.argsort(key)
        self.slots = key[order]
        self.nodes = np.concatenate([*nodes, np.zeros(0, np.int64)])[order]

    def within(self, tree: np.ndarray, queries: np.ndarray, radius: int):
        """Yields (query numbers, node numbers) at most radius apart, in blocks.

        From a node at distance d only the edges d - radius to d + radius are followed.
        """
        sizes = np.ones(len(tree))
        roots = np.array([self.root_of_tree.get(t, -1) for t in tree.tolist()], np.int64)
        known, counts = np.unique(tree, return_counts=True)
        if len(known):
            sizes = counts[np.searchsorted(known, tree)].astype(float)
        block = (np.cumsum(sizes) // FRONTIER).astype(np.int64) if len(tree) else np.zeros(0, np.int64)
        for b in np.unique(block):
            q = np.flatnonzero((block == b) & (roots >= 0))
            v = roots[q]
            while len(q):
                d = distance(queries[q], self.prints[v])
                hit = d <= radius
                if hit.any():
                    yield q[hit], v[hit]
                low = np.searchsorted(self.slots, v * self.width + np.maximum(d - radius, 0))
                high = np.searchsorted(self.slots, v * self.width + np.minimum(d + radius, self.width - 1), "right")
                n = high - low
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, v = np.repeat(q, n), self.nodes[np.repeat(low, n) + step]


def join_groups(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The names (least member's number of each group) after every a is put with its b."""
    a, b = names[a], names[b]
    while True:
        apart = a != b
        if not apart.any():
            return names
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        up = np.arange(len(names))
        np.minimum.at(up, high, low)
        while True:
            further = up[up]
            if (further == up).all():
                break
            up = further
        names = up[names]
        a, b = up[a], up[b]
