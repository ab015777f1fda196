"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, then blind tries."""

from __future__ import annotations

import numpy as np

#: Bytes that the multikey quicksort looks at, eight at a time as one character, before tied strings go to a blind trie.
SHALLOW = 40


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """A trie of strings that keeps only branching depths and branching bytes.

    A string is inserted by a blind descent (branching bytes alone are compared) to some leaf, one comparison with
    that leaf's string, and a split at the depth where they part; an end of string sorts before every byte.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None  # a node is [depth, {byte: node}, leaf]; a leaf node is [-1, None, [indexes]]

    def _byte(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        leaf = [-1, None, [i]]
        if self.root is None:
            self.root = leaf
            return
        node, path = self.root, []
        while node[0] >= 0:
            path.append(node)
            node = node[1].get(self._byte(i, node[0])) or next(iter(node[1].values()))
        other = node[2][0]
        same = common_prefix(self.strings[i], self.strings[other])
        if same == len(self.strings[i]) == len(self.strings[other]):
            node[2].append(i)
            return
        above = None
        for x in path:
            if x[0] >= same:
                node = x
                break
            above = x
        if node[0] == same:
            node[1][self._byte(i, same)] = leaf
            return
        fork = [same, {self._byte(i, same): leaf, self._byte(other, same): node}, None]
        if above is None:
            self.root = fork
        else:
            above[1][self._byte(other, above[0])] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                out += node[2]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def multikey_quicksort(order: np.ndarray, segment: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the rows `order` inside each segment (sorted numbers) by their words; returns the order and which rows tie.

    Ternary partitioning by one word at a time: every open part is split by a pivot at its depth into less, equal and
    greater; equal goes one word deeper, the others stay at their depth. All open parts take a step at once. Tied rows
    (equal in all words) share a number.
    """
    n, most = len(order), words.shape[1]
    part, depth = np.unique(segment, return_inverse=True)[1].astype(np.int64), np.zeros(n, np.int64)
    while True:
        start = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if n else np.zeros(0, int)
        size = np.diff(np.r_[start, n])
        at = np.flatnonzero(np.repeat(size > 1, size) & (depth < most))
        if not len(at):
            return order, part
        middle = np.repeat(start + size // 2, size)[at]
        key, pivot = words[order[at], depth[at]], words[order[middle], depth[at]]
        side = np.where(key < pivot, 0, np.where(key > pivot, 2, 1))
        by = np.argsort(3 * part[at] + side, kind="stable")
        order[at], side = order[at][by], side[by]
        depth[at] += side == 1
        fresh = np.zeros(n, np.int64)
        fresh[start] = 1
        own = part[at]
        fresh[at[np.flatnonzero(np.r_[False, (side[1:] != side[:-1]) & (own[1:] == own[:-1])])]] = 1
        part = np.cumsum(fresh)


def deep_shallow(group: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Order of the rows by (group, bytes): data holds zero-padded rows, sizes their lengths, group sorted numbers.

    Multikey quicksort over eight bytes at a time down to SHALLOW bytes; rows that tie there are ordered by a blind
    trie per group of ties.
    """
    n = len(group)
    words = np.zeros((n, SHALLOW), np.uint8)
    words[:, : min(SHALLOW, data.shape[1])] = data[:, :SHALLOW]
    order, tie = multikey_quicksort(np.arange(n), np.asarray(group, np.int64), words.view(">u8").astype(np.uint64))
    first = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[first, n])
    for s, m in zip(first[size > 1], size[size > 1], strict=True):
        rows = order[s : s + m]
        trie = BlindTrie([data[r, : sizes[r]].tobytes() for r in rows])
        for i in range(m):
            trie.insert(i)
        order[s : s + m] = rows[trie.order()]
    return order
