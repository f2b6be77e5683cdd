"""Exact Jaccard self-join of a block of sets with a prefix tree.

Sets are written in one global order, rarest token first, sorted, and merged into a compressed trie. A query
walks it level by level: all sets below a node share the node's partial overlap, so each stretch of tokens
is compared once. A subtree goes when the overlap so far plus what can still come, the shorter of the
query's and the subtree's remaining lengths, cannot reach the threshold for any length below it.
"""

from __future__ import annotations

import numpy as np


class PrefixTree:
    """Sorted sets as a compressed trie in arrays, nodes by depth-first order."""

    def __init__(self, tokens: np.ndarray, offsets: np.ndarray):
        """tokens: dense ids in the global order; set i is tokens[offsets[i]:offsets[i + 1]], ascending."""
        self.tokens, self.offsets = tokens, offsets
        own = [tokens[offsets[i] : offsets[i + 1]] for i in range(len(offsets) - 1)]
        self.order = np.array(sorted(range(len(own)), key=lambda i: own[i].astype(">u4").tobytes()), np.int64)
        size = [len(s) for s in own]
        parent, start, end, leaf = [-1], [0], [0], [-1]  # node 0: the root
        stack = [(0, 0)]  # (node, depth at its end)
        previous: np.ndarray | None = None
        for i in self.order.tolist():
            s = own[i]
            if previous is None:
                shared = 0
            else:
                n = min(len(s), len(previous))
                differ = np.flatnonzero(s[:n] != previous[:n])
                shared = int(differ[0]) if len(differ) else n
            popped = None
            while stack[-1][1] > shared:
                popped = stack.pop()
            if stack[-1][1] < shared:  # split the edge of the node that was popped last
                node = popped[0]
                middle = len(parent)
                parent.append(stack[-1][0])
                start.append(start[node])
                end.append(start[node] + shared - stack[-1][1])
                leaf.append(-1)
                start[node] = end[middle]
                parent[node] = middle
                stack.append((middle, shared))
            parent.append(stack[-1][0])
            start.append(int(offsets[i]) + shared)
            end.append(int(offsets[i]) + size[i])
            leaf.append(i)
            stack.append((len(parent) - 1, size[i]))
            previous = s
        self.parent, self.start, self.end, self.leaf = (np.array(x, np.int64) for x in (parent, start, end, leaf))
        nodes = len(parent)
        self.depth = np.zeros(nodes, np.int64)
        children: list[list[int]] = [[] for _ in range(nodes)]
        for v in range(1, nodes):
            children[parent[v]].append(v)
        walk, k = [0], 0
        while k < len(walk):
            walk += children[walk[k]]
            k += 1
        lengths = self.end - self.start
        for v in walk[1:]:
            self.depth[v] = self.depth[parent[v]] + lengths[v]
        self.shortest, self.longest = np.full(nodes, np.iinfo(np.int64).max), np.zeros(nodes, np.int64)
        self.greatest = np.full(nodes, -1)  # the largest set number below
        for v in reversed(walk):
            if leaf[v] >= 0:
                self.shortest[v] = self.longest[v] = size[leaf[v]]
                self.greatest[v] = leaf[v]
            for c in children[v]:
                self.shortest[v] = min(self.shortest[v], self.shortest[c])
                self.longest[v] = max(self.longest[v], self.longest[c])
                self.greatest[v] = max(self.greatest[v], self.greatest[c])
        counts = np.array([len(c) for c in children])
        self.child_at = np.concatenate([[0], np.cumsum(counts)])
        self.children = np.array([c for own_ in children for c in own_], np.int64)
        self.mask = np.zeros(int(tokens.max(initial=-1)) + 1, np.int64)

    def partners(self, i: int, num: int, den: int) -> np.ndarray:
        """Sets j > i with den * |both| >= num * |either|."""
        q = self.tokens[self.offsets[i] : self.offsets[i + 1]]
        n = len(q)
        self.mask[q] = 1
        found = []
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while len(nodes):
            first, k = self.child_at[nodes], self.child_at[nodes + 1] - self.child_at[nodes]
            overlap = np.repeat(overlap, k)
            ends = np.cumsum(k)
            nodes = self.children[np.arange(int(k.sum())) + np.repeat(first - (ends - k), k)]
            keep = (self.greatest[nodes] > i) & (num * np.maximum(self.shortest[nodes], n) <= den * np.minimum(self.longest[nodes], n))
            nodes, overlap = nodes[keep], overlap[keep]
            if not len(nodes):
                break
            lengths = self.end[nodes] - self.start[nodes]
            ends = np.cumsum(lengths)
            at = np.arange(int(lengths.sum())) + np.repeat(self.start[nodes] - (ends - lengths), lengths)
            seen = np.concatenate([[0], np.cumsum(self.mask[self.tokens[at]])])
            overlap = overlap + seen[ends] - seen[ends - lengths]
            # required overlap grows with the other set's length, so the shortest below decides
            depth = self.depth[nodes]
            best = overlap + np.minimum(n - overlap, self.longest[nodes] - depth)
            need = -(-num * (n + np.maximum(self.shortest[nodes], -(-num * n // den))) // (num + den))
            keep = best >= need
            nodes, overlap = nodes[keep], overlap[keep]
            leaf = self.leaf[nodes]
            done = leaf > i
            if done.any():
                size = self.offsets[leaf[done] + 1] - self.offsets[leaf[done]]
                o = overlap[done]
                found.append(leaf[done][den * o >= num * (n + size - o)])
        self.mask[q] = 0
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def join(hashes: list[np.ndarray], num: int, den: int):
    """Yields (i, partners j > i) over sets of 64-bit tokens."""
    sizes = np.array([len(h) for h in hashes])
    flat = np.concatenate(hashes)
    distinct, back, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(distinct), np.int64)
    rank[np.lexsort((distinct, counts))] = np.arange(len(distinct))
    tokens = rank[back]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    tokens = tokens[np.lexsort((tokens, owner))]
    tree = PrefixTree(tokens, np.concatenate([[0], np.cumsum(sizes)]))
    for i in range(len(sizes)):
        j = tree.partners(i, num, den)
        if len(j):
            yield i, j
