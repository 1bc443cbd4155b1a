"""BK-trees over integers under the Hamming distance, many at once, as arrays."""

from __future__ import annotations

import numpy as np


class Forest:
    """One BK-tree for each shard. A node's children are keyed by their integer distance to it.

    All trees are built and searched level by level together: `items` sorted by `shard` are the
    nodes, and the children of a node are found by binary search on (node, edge).
    """

    def __init__(self, items: np.ndarray, shard: np.ndarray, edges: int = 65):
        self.items, self.edges = items, edges
        n = len(items)
        first = np.ones(n, dtype=bool)
        first[1:] = shard[1:] != shard[:-1]
        self.roots = np.flatnonzero(first)
        self.root_of_shard = {}
        self.shards = shard[self.roots]
        rest = np.flatnonzero(~first)
        at = self.roots[np.searchsorted(self.shards, shard[rest])]
        slots, children = [], []
        while len(rest):
            slot = at * edges + np.bitwise_count(items[rest] ^ items[at])
            order = np.argsort(slot, kind="stable")
            slot, rest = slot[order], rest[order]
            new = np.ones(len(rest), dtype=bool)
            new[1:] = slot[1:] != slot[:-1]
            child = rest[new]  # the first to come becomes the child; the others go on below it
            slots.append(slot[new])
            children.append(child)
            at = child[np.cumsum(new) - 1][~new]
            rest = rest[~new]
        slots = np.concatenate(slots) if slots else np.zeros(0, dtype=np.int64)
        children = np.concatenate(children) if children else np.zeros(0, dtype=np.int64)
        order = np.argsort(slots, kind="stable")
        self.slots, self.children = slots[order], children[order]

    def search(self, queries: np.ndarray, shard: np.ndarray, radius: int, block: int = 1 << 18):
        """(query index, node index) of all pairs within the radius, each query in the tree of its shard; in blocks."""
        for start in range(0, len(queries), block):
            yield from self._search(np.arange(start, min(start + block, len(queries))), queries, shard, radius, block)

    def _search(self, q, queries, shard, radius, block):
        where = np.searchsorted(self.shards, shard[q])
        there = (where < len(self.shards)) & (self.shards[np.minimum(where, len(self.shards) - 1)] == shard[q])
        waiting = [(q[there], self.roots[where[there]])]
        while waiting:
            q, node = waiting.pop()
            if len(q) > 4 * block:  # bounds what is held at once
                waiting += [(q[: len(q) // 2], node[: len(q) // 2]), (q[len(q) // 2 :], node[len(q) // 2 :])]
                continue
            d = np.bitwise_count(queries[q] ^ self.items[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.slots, node * self.edges + np.maximum(d - radius, 0))
            high = np.searchsorted(self.slots, node * self.edges + np.minimum(d + radius, self.edges - 1), side="right")
            count = high - low
            if total := int(count.sum()):
                q = np.repeat(q, count)
                at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                waiting.append((q, self.children[at]))
