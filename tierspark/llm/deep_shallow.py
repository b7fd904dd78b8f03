"""Deep-shallow sorting of byte strings, with the common prefix of neighbours.

Multikey quicksort orders the strings down to a shallow depth; groups that still agree
there have long common prefixes, which a blind trie (one comparison per string, branches
on single bytes) orders without reading them again and again.
"""

from __future__ import annotations

SHALLOW = 16


def lcp(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, at least ``start`` of which is known to agree."""
    lo, hi = start, min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _byte(s: bytes, at: int) -> int:
    return s[at] if at < len(s) else -1


class _Node:
    """A branch at ``depth``: children by byte (-1: the string ends here)."""
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int):
        self.depth, self.kids = depth, {}


def blind_trie(strings: list[bytes], group: list[int], depth: int) -> list[tuple[int, int]]:
    """(string, common prefix with the one before) of a group that agrees up to depth."""
    same: dict[int, list[int]] = {}
    root: _Node | int = group[0]
    for n in group[1:]:
        s, at = strings[n], root
        while isinstance(at, _Node):  # blind: only branching bytes are looked at
            at = at.kids.get(_byte(s, at.depth), next(iter(at.kids.values())))
        other = strings[at]
        d = lcp(s, other, depth)
        if d == len(s) == len(other):
            same.setdefault(at, []).append(n)
            continue
        above, at = None, root
        while isinstance(at, _Node) and at.depth < d:
            above, at = at, at.kids[_byte(s, at.depth)]
        if isinstance(at, _Node) and at.depth == d:
            at.kids[_byte(s, d)] = n
            continue
        new = _Node(d)
        new.kids[_byte(other, d)] = at
        new.kids[_byte(s, d)] = n
        if above is None:
            root = new
        else:
            above.kids[_byte(s, above.depth)] = new
    out: list[tuple[int, int]] = []
    stack: list[tuple] = [(root, depth)]
    while stack:
        node, common = stack.pop()
        if isinstance(node, _Node):
            kids = [node.kids[b] for b in sorted(node.kids)]
            stack += [(k, node.depth) for k in reversed(kids[1:])] + [(kids[0], common)]
        else:
            out.append((node, common))
            out += [(n, len(strings[n])) for n in same.get(node, [])]
    return out


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW):
    """(order, common): ``common[i]`` bytes are shared by the i-th and the one before it
    in the order. All strings agree on their first ``depth`` bytes."""
    order: list[int] = []
    common: list[int] = []
    stack = [(list(range(len(strings))), depth, depth)]  # group, agreed depth, with the one before
    limit = depth + shallow
    while stack:
        group, at, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            common.append(before)
        elif at >= limit:
            first = True
            for n, c in blind_trie(strings, group, at):
                order.append(n)
                common.append(before if first else c)
                first = False
        elif group:
            pivot = _byte(strings[group[len(group) // 2]], at)
            less, same, more = [], [], []
            for n in group:
                b = _byte(strings[n], at)
                (same if b == pivot else less if b < pivot else more).append(n)
            first = before  # the first part that is not empty meets what stands before
            parts = []
            for part, deeper in ((less, at), (same, limit if pivot < 0 else at + 1), (more, at)):
                if part:
                    parts.append((part, deeper, first))
                    first = at
            stack += reversed(parts)
    if common:
        common[0] = 0
    return order, common


def common_matrix(order: list[int], common: list[int]):
    """Common prefix of every two strings, from the order and its neighbours'."""
    import numpy as np
    n = len(order)
    out = np.zeros((n, n), np.int32)
    c = np.array(common, np.int32)
    for i in range(n - 1):
        out[i, i + 1:] = np.minimum.accumulate(c[i + 1:])
    out += out.T
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return out[np.ix_(back, back)]
