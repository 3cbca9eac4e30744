"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries for what still agrees there.

Strings come as rows of a zero-padded matrix with their lengths, and in groups; groups are sorted side by side. The shallow
stage takes eight bytes as one character: the runs of strings that agree so far are quicksorted by their next character,
all runs of a depth in one call, and runs of equal characters go on one deeper. Runs that agree beyond SHALLOW bytes go,
each, into a blind trie: it keeps branching depths and branching bytes only, finds a string's place by those, and compares
the string itself once.
"""

from __future__ import annotations

import numpy as np

#: Bytes that the shallow stage sorts by; and of one of its characters.
SHALLOW, CHARACTER = 32, 8


class BlindTrie:
    """Strings of one width, as [depth, {byte: child}] for branches and [None, [numbers]] for leaves."""

    def __init__(self, width: int):
        self.width, self.strings, self.root = width, {}, None

    def add(self, number: int, string: bytes) -> None:
        self.strings[number] = string
        leaf = [None, [number]]
        if self.root is None:
            self.root = leaf
            return
        at = self.root
        while at[0] is not None:
            # blind: a byte without a child only says that the string leaves the trie here or before
            at = at[1].get(string[at[0]]) or next(iter(at[1].values()))
        other = self.strings[at[1][0]]
        if other == string:
            at[1].append(number)
            return
        apart = int.from_bytes(string, "big") ^ int.from_bytes(other, "big")
        common = self.width - (apart.bit_length() + 7) // 8
        above, at = None, self.root
        while at[0] is not None and at[0] < common:
            above, at = at, at[1][string[at[0]]]
        if at[0] == common:
            at[1][string[common]] = leaf
            return
        branch = [common, {other[common]: at, string[common]: leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][string[above[0]]] = branch

    def order(self) -> list[int]:
        out, open_nodes = [], [self.root]
        while open_nodes:
            depth, children = open_nodes.pop()
            if depth is None:
                out += children
            else:
                open_nodes += [children[b] for b in sorted(children, reverse=True)]
        return out


def _shallow(strings: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by group and the first SHALLOW bytes, and the number of each place's run of strings that agree in these."""
    order = np.argsort(group, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = group[order][1:] != group[order][:-1]
    depth = 0
    while depth < min(SHALLOW, strings.shape[1]):
        run = np.cumsum(new) - 1
        size = np.bincount(run)
        left = np.flatnonzero(size[run] > 1)
        if not len(left):
            break
        cut = np.zeros((len(left), CHARACTER), np.uint8)
        piece = strings[order[left], depth : depth + CHARACTER]
        cut[:, : piece.shape[1]] = piece
        character = cut.view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((character, run[left]))
        order[left] = order[left][by]
        character, of = character[by], run[left]
        new[left[1:]] |= (of[1:] == of[:-1]) & (character[1:] != character[:-1])
        depth += CHARACTER
    return order, np.cumsum(new) - 1


def sort(strings: np.ndarray, lengths: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings' order by group, then bytes, then length; and for each place but the first how many bytes its string and
    the one before have in common (-1 where another group begins). Padding is never counted as common."""
    n, width = strings.shape
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    order, run = _shallow(strings, group)
    edges = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True])
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a == 1:
            continue
        deep = BlindTrie(width)
        for number in order[a:b].tolist():
            deep.add(number, strings[number].tobytes())
        order[a:b] = deep.order()
    # strings that are equal but for padding: the shorter first
    before, after = strings[order[:-1]], strings[order[1:]]
    differ = before != after
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common[group[order[1:]] != group[order[:-1]]] = -1
    same = np.cumsum(np.r_[0, common < width])
    order = order[np.lexsort((lengths[order], same))]
    return order, np.where(common < 0, -1, np.minimum(common, np.minimum(lengths[order[1:]], lengths[order[:-1]])))
