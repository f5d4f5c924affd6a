"""Recursive graph bisection of documents by the terms they hold, fitted on a bounded sample.

A level splits every set of documents into two of equal size so that the terms of each half lie close together: the
cost of a half is the sum over its terms of degree * log2(size / (degree + 1)), the bits that gaps between its
postings take. Documents change sides in pairs as long as a pair lowers the cost. What is learned of a set is how much more each
term costs on one side than on the other, so a document that isn't in the sample goes down the tree by a sum over its terms.
"""

from __future__ import annotations

import numpy as np

#: Terms that the tree knows, the most frequent of the sample.
MOST_TERMS = 1 << 14
#: Documents of the sample in a leaf, at least.
LEAST_LEAF = 64
MOST_LEVELS = 7
ROUNDS = 10


def _bits(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    return degree * np.log2(np.maximum(size, 1) / (degree + 1))


class Tree:
    """known: the tree's number of each term, its last one for terms that it doesn't know. prefer: for each level (set, term) how much
    cheaper the left side is; cuts: for each level the sum from which on a document of the set goes left."""

    def __init__(self, known: np.ndarray, prefer: list[np.ndarray], cuts: list[np.ndarray]) -> None:
        self.known, self.prefer, self.cuts = known, prefer, cuts

    @property
    def leaves(self) -> int:
        return 1 << len(self.prefer)

    def leaf(self, document: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """The leaf of each of n documents, from pairs (document, term). Leaves are numbered in the order of the tree."""
        node = np.zeros(n, np.int64)
        term = self.known[term]
        for prefer, cut in zip(self.prefer, self.cuts):
            total = np.bincount(document, weights=prefer[node[document], term], minlength=n)
            node = 2 * node + (total < cut[node])
        return node


def fit(document: np.ndarray, term: np.ndarray, n: int, n_terms: int, seed: int = 7) -> Tree:
    """The tree of n sampled documents, from distinct pairs (document, term), with terms below ``n_terms``."""
    often = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:MOST_TERMS]
    known = np.full(n_terms, len(often), np.int32)
    known[often] = np.arange(len(often))
    width = len(often) + 1
    term = known[term]
    document, term = document[term < len(often)], term[term < len(often)]
    levels = min(MOST_LEVELS, max(0, (n // LEAST_LEAF).bit_length() - 1))
    random = np.random.default_rng(seed)
    node, prefer, cuts = np.zeros(n, np.int64), [], []
    for level in range(levels):
        sets = 1 << level
        order = np.lexsort((random.random(n), node))
        size = np.bincount(node, minlength=sets)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        right = rank >= (size[node] + 1) // 2
        pairs, pair = np.unique(node[document] * width + term, return_inverse=True)
        degree = np.bincount(pair, minlength=len(pairs))
        n_right = np.bincount(node, weights=right, minlength=sets)
        r_size, l_size = n_right[pairs // width], (size - n_right)[pairs // width]
        for _ in range(ROUNDS):
            r = np.bincount(pair, weights=right[document], minlength=len(pairs))
            l = degree - r  # noqa: E741
            now = _bits(l, l_size) + _bits(r, r_size)
            to_right = np.where(l > 0, now - _bits(np.maximum(l - 1, 0), l_size) - _bits(r + 1, r_size), 0.0)
            to_left = np.where(r > 0, now - _bits(l + 1, l_size) - _bits(np.maximum(r - 1, 0), r_size), 0.0)
            gain = np.bincount(document, weights=np.where(right[document], to_left[pair], to_right[pair]), minlength=n)
            by_gain = np.lexsort((-gain, right, node))
            group = 2 * node[by_gain] + right[by_gain]
            starts = np.searchsorted(group, np.arange(2 * sets + 1))
            place = np.arange(n) - starts[group]
            partner = starts[group ^ 1] + place
            paired = partner < starts[(group ^ 1) + 1]
            other = np.where(paired, gain[by_gain][np.minimum(partner, n - 1)], -np.inf)
            swap = by_gain[paired & (gain[by_gain] + other > 1e-9)]
            if not len(swap):
                break
            right[swap] = ~right[swap]
        r = np.bincount(pair, weights=right[document], minlength=len(pairs))
        l = degree - r  # noqa: E741
        more_left, more_right = _bits(l + 1, l_size) - _bits(l, l_size), _bits(r + 1, r_size) - _bits(r, r_size)
        table = np.zeros((sets, width), np.float32)
        table[pairs // width, pairs % width] = more_right - more_left
        total = np.bincount(document, weights=table[node[document], term], minlength=n)
        order = np.lexsort((-total, node))
        first = np.searchsorted(node[order], np.arange(sets))
        middle = np.minimum(first + (size - 1) // 2, n - 1)  # the last of the left half
        cut = np.where(size > 0, total[order][middle], 0.0)
        prefer.append(table)
        cuts.append(cut)
        node = 2 * node + (total < cut[node])
    return Tree(known, prefer, cuts)
