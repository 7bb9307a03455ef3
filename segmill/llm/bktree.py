"""BK-trees over 64-bit fingerprints, many at a time, as numpy arrays."""

from __future__ import annotations

import numpy as np

BITS = 64


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One BK-tree per group; the children of a node are keyed by their distance to it.

    ``groups`` numbers the group of each fingerprint and is ascending; the first
    fingerprint of a group is its root. Trees grow level by level: all fingerprints
    below a node are keyed by their distance to it, the first of each key becomes the
    child and the others go on below that. Fingerprints are distinct in a group.
    """

    def __init__(self, groups: np.ndarray, prints: np.ndarray):
        self.prints = prints
        first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else groups
        self.root_of_group = first
        node = first[np.cumsum(np.r_[True, groups[1:] != groups[:-1]]) - 1] if len(groups) else groups
        rest = np.setdiff1d(np.arange(len(prints)), first)
        keys, children = [], []
        at = node[rest]
        while len(rest):
            key = at * (BITS + 1) + distance(prints[rest], prints[at])
            unique, where, inverse = np.unique(key, return_index=True, return_inverse=True)
            keys.append(unique)
            children.append(rest[where])
            below = np.ones(len(rest), bool)
            below[where] = False
            at = rest[where][inverse][below]
            rest = rest[below]
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        child = np.concatenate(children) if children else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], child[order]

    def search(self, prints: np.ndarray, roots: np.ndarray, radius: int):
        """(query, node) of all matches within ``radius``; each query starts at its root.

        By the triangle inequality a match below a node lies behind an edge whose
        key differs from the query's distance to the node by at most the radius.
        """
        queries, nodes = np.arange(len(prints)), roots
        found_q, found_n = [], []
        while len(queries):
            d = distance(prints[queries], self.prints[nodes])
            hit = d <= radius
            found_q.append(queries[hit])
            found_n.append(nodes[hit])
            base = nodes * (BITS + 1)
            low = np.searchsorted(self.key, base + np.maximum(d - radius, 0), "left")
            high = np.searchsorted(self.key, base + np.minimum(d + radius, BITS), "right")
            n = high - low
            queries = np.repeat(queries, n)
            inside = np.arange(len(queries)) - np.repeat(np.cumsum(n) - n, n)
            nodes = self.child[np.repeat(low, n) + inside]
        if not found_q:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_n)


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked indices the least label of their component, in place."""
    while True:
        least = np.minimum(labels[a], labels[b])
        before = labels.copy()
        np.minimum.at(labels, labels[a], least)
        np.minimum.at(labels, labels[b], least)
        np.minimum.at(labels, a, least)
        np.minimum.at(labels, b, least)
        while True:
            jumped = labels[labels]
            if np.array_equal(jumped, labels):
                break
            labels[:] = jumped
        if np.array_equal(before, labels):
            return
