"""Deep-shallow sorting of suffixes.

The first bytes of all suffixes are sorted by multikey quicksort: a group of equal beginnings is
parted in three by the character of a pivot; the middle part goes on to the next character, the
others stay at theirs. Characters are words of eight bytes here, and a step parts all groups at
once. Groups that are still together at the shallow depth have long common prefixes; each is
ordered by a blind trie, which finds a suffix's place by a few single bytes and one comparison.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the multikey quicksort looks at.
SHALLOW = 24


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset as one number that orders like the bytes."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[at]
    return np.ascontiguousarray(eight).view(">u8").reshape(-1).astype(np.uint64)


def shallow_sort(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): ``at[order]`` ascends by the first ``depth`` bytes; ``first`` marks where they change.

    Suffixes that are equal so far keep their order.
    """
    order, first = np.arange(len(at)), np.zeros(len(at), bool)
    first[:1] = True
    # The groups to part: their beginnings, sizes, and the bytes in which their members agree.
    start, size, agreed = np.zeros(1, np.int64), np.array([len(at)]), np.zeros(1, np.int64)
    while True:
        several = (size > 1) & (agreed < depth)
        start, size, agreed = start[several], size[several], agreed[several]
        if not len(start):
            return order, first
        group = np.repeat(np.arange(len(start)), size)
        before = np.cumsum(size) - size
        place = np.arange(len(group)) - before[group] + start[group]
        keys = words_at(data, at[order[place]] + agreed[group])
        pivot = keys[before + size // 2][group]
        side = group * 3 + (keys >= pivot) + (keys > pivot)
        parted = np.argsort(side, kind="stable")
        order[place] = order[place[parted]]
        side = side[parted]
        edge = np.flatnonzero(np.diff(side, prepend=-1))
        first[place[edge]] = True
        # The middle parts agree in eight bytes more.
        start, size, agreed = place[edge], np.diff(np.append(edge, len(side))), agreed[group[edge]] + np.where(side[edge] % 3 == 1, 8, 0)


class BlindTrie:
    """A Patricia trie over equally long byte strings; equal strings share a leaf."""

    def __init__(self):
        self.root: list | None = None  # a branch is [depth, {byte: child}], a leaf [-1, string, members]

    def insert(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = [-1, text, [member]]
            return
        node = self.root
        while node[0] >= 0:  # blind: bytes between branches are skipped, a missing branch is replaced by any
            child = node[1].get(text[node[0]])
            node = child if child is not None else next(iter(node[1].values()))
        if node[1] == text:
            node[2].append(member)
            return
        depth = common(node[1], text)
        parent, key, node, other = None, None, self.root, node[1]
        while 0 <= node[0] < depth:
            parent, key, node = node, text[node[0]], node[1][text[node[0]]]
        if node[0] == depth:
            node[1][text[depth]] = [-1, text, [member]]
            return
        branch = [depth, {text[depth]: [-1, text, [member]], other[depth]: node}]
        if parent is None:
            self.root = branch
        else:
            parent[1][key] = branch

    def leaves(self):
        """The members of each leaf in order of the strings."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] < 0:
                yield node[2]
            else:
                stack += [node[1][b] for b in sorted(node[1], reverse=True)]


def common(a: bytes, b: bytes) -> int:
    """Bytes that two different strings of one length share at their beginning."""
    lo, hi = 0, len(a)
    while lo < hi:
        middle = (lo + hi + 1) // 2
        if a[:middle] == b[:middle]:
            lo = middle
        else:
            hi = middle - 1
    return lo


def sorted_classes(buffer: bytes, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): suffixes sorted by ``depth`` bytes; ``first`` marks each new string.

    Equal strings keep the order in which they were given. All offsets must leave ``depth``
    bytes in the buffer.
    """
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    data = np.frombuffer(buffer, np.uint8)
    shallow = min(SHALLOW, depth // 8 * 8)
    order, first = shallow_sort(data, at, max(shallow, 8))
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(order))
    for lo, hi in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        members = np.sort(order[lo:hi])
        trie = BlindTrie()
        for m, offset in zip(members.tolist(), at[members].tolist()):
            trie.insert(buffer[offset + shallow : offset + depth], m)
        k = lo
        for leaf in trie.leaves():
            order[k : k + len(leaf)] = leaf
            first[k : k + len(leaf)] = False
            first[k] = True
            k += len(leaf)
    return order, first
