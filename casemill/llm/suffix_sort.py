"""Deep-shallow sorting of suffixes (after Manzini & Ferragina, 2004).

Shallow: multikey quicksort over characters of eight bytes, down to ``SHALLOW`` bytes. Every round
parts all open groups at once by a pivot character into less, equal and greater; the equal part
goes on with its next character. Deep: a group that shares more than that goes through a blind
trie, whose inner nodes know only where their members first differ; a suffix is placed by one
blind walk, one comparison with the leaf it ends at, and one new node. Groups that turn out to be
equal to their first member need no trie.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 40


class _Node:
    __slots__ = ("skip", "children")

    def __init__(self, skip: int) -> None:
        self.skip, self.children = skip, {}


class BlindTrie:
    """Byte strings of one length in order; equal strings share a leaf."""

    def __init__(self) -> None:
        self.root: _Node | list | None = None

    def insert(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = [text, member]
            return
        node = self.root
        while isinstance(node, _Node):  # the blind walk: only branching bytes are read
            node = node.children.get(text[node.skip]) or next(iter(node.children.values()))
        leaf = node[0]
        if leaf == text:
            node.append(member)
            return
        at = _common(leaf, text)
        parent, node = None, self.root
        while isinstance(node, _Node) and node.skip < at:
            parent, node = node, node.children[text[node.skip]]
        if isinstance(node, _Node) and node.skip == at:
            node.children[text[at]] = [text, member]
            return
        split = _Node(at)
        split.children[leaf[at]] = node
        split.children[text[at]] = [text, member]
        if parent is None:
            self.root = split
        else:
            parent.children[text[parent.skip]] = split

    def leaves(self) -> list[list]:
        """Leaves in the order of their strings: each a string followed by its members."""
        out, todo = [], [self.root] if self.root is not None else []
        while todo:
            node = todo.pop()
            if isinstance(node, _Node):
                todo += [node.children[b] for b in sorted(node.children, reverse=True)]
            else:
                out.append(node)
        return out


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different strings of one length."""
    x = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return (8 * len(a) - x.bit_length()) // 8


def _characters(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number; zeros follow the end."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    out = np.zeros(len(text) + 1, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _character(wide: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The character at each place, of which only ``left`` bytes belong to the string."""
    cut = np.clip(8 - left, 0, 8).astype(np.uint64) << np.uint64(3)
    key = wide[np.minimum(at, len(wide) - 1)]
    return np.where(cut >= 64, np.uint64(0), key >> np.minimum(cut, np.uint64(63)))


def _parted(order: np.ndarray, first: np.ndarray, wide: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth_limit: int) -> None:
    """Multikey quicksort of ``order`` in place; ``first`` marks where its groups begin, before and after."""
    depth = np.zeros(len(order), np.int64)
    at = _open(first, np.arange(len(order)))
    while len(at):
        own = order[at]
        key = _character(wide, starts[own] + depth[at], lengths[own] - depth[at])
        begin = np.flatnonzero(first[at])
        size = np.diff(np.r_[begin, len(at)])
        # the pivot of a group: the median of its first, middle and last character
        a, b, c = key[begin], key[begin + size // 2], key[begin + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        less, more = (key < pivot).astype(np.int64), (key > pivot).astype(np.int64)
        n_less, n_more = np.add.reduceat(less, begin), np.add.reduceat(more, begin)
        n_same = size - n_less - n_more
        low = np.cumsum(less) - np.repeat(np.cumsum(less)[begin] - less[begin], size) - 1
        high = np.cumsum(more) - np.repeat(np.cumsum(more)[begin] - more[begin], size) - 1
        same = 1 - less - more
        mid = np.cumsum(same) - np.repeat(np.cumsum(same)[begin] - same[begin], size) - 1
        to = np.where(less > 0, low, np.where(more > 0, np.repeat(n_less + n_same, size) + high, np.repeat(n_less, size) + mid)) + np.repeat(begin, size)
        moved, grown = np.empty_like(own), np.empty(len(at), np.int64)
        moved[to], grown[to] = own, depth[at] + 8 * same
        order[at], depth[at] = moved, grown
        for n, offset in ((n_same, n_less), (n_more, n_less + n_same)):
            first[at[(begin + offset)[n > 0]]] = True
        at = at[depth[at] < np.minimum(lengths[order[at]], depth_limit)]
        at = _open(first, at)


def _open(first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of the positions ``at`` (whole groups) those whose group has several members."""
    if not len(at):
        return at
    alone = first[at] & np.r_[first[at[1:]], True]
    return at[~alone]


def deep_shallow_sort(text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the strings inside each group, and their runs of equals.

    String i is the ``lengths[i]`` bytes of ``text`` from ``starts[i]``; ``groups`` says which
    strings to sort against each other, and strings of a group have one length. Returns the
    indices, group by group and sorted inside, and beside each the number of its run: members of a
    run are equal byte for byte and of one group.
    """
    order = np.argsort(groups, kind="stable")
    n = len(order)
    if n == 0:
        return order, order
    starts, lengths = starts.astype(np.int64), lengths.astype(np.int64)
    ordered = groups[order]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    wide = _characters(text)
    _parted(order, first, wide, starts, lengths, shallow)
    at = _open(first, np.arange(n))
    at = at[lengths[order[at]] > shallow]
    if not len(at):
        return order, np.cumsum(first) - 1
    begin = np.flatnonzero(first[at])
    size = np.diff(np.r_[begin, len(at)])
    own = order[at]
    head = np.repeat(own[begin], size)
    equal = np.ones(len(at), bool)
    for d in range(shallow, int(lengths[own].max()), 8):
        left = lengths[own] - d
        equal &= (_character(wide, starts[own] + d, left) == _character(wide, starts[head] + d, left)) | (left <= 0)
    mixed = np.flatnonzero(~np.logical_and.reduceat(equal, begin))
    if len(mixed):
        raw = text.tobytes()
        for a, b in zip(begin[mixed].tolist(), (begin + size)[mixed].tolist(), strict=True):
            trie = BlindTrie()
            for i in own[a:b].tolist():
                s = int(starts[i]) + shallow
                trie.insert(raw[s : s + int(lengths[i]) - shallow], i)
            p = int(at[a])
            for leaf in trie.leaves():
                order[p : p + len(leaf) - 1] = leaf[1:]
                first[p] = True
                p += len(leaf) - 1
    return order, np.cumsum(first) - 1
