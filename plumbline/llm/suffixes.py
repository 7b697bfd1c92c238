"""Deep-shallow sorting of suffixes up to a depth.

Multikey quicksort takes suffixes eight bytes at a time: they are sorted by one such character, and
only those equal in it go on to the next. After ``shallow`` bytes the few groups that are still
together are ordered by *blind tries*: a suffix goes down a trie by branching bytes alone, is
compared once with the leaf that it comes to, and branches off where they differ. Groups that
are too large for that go on with the quicksort.
"""

from __future__ import annotations

import numpy as np

#: Groups of more suffixes than this stay with the quicksort.
BLIND = 256


def _characters(data: np.ndarray, starts: np.ndarray, at: int, width: int) -> np.ndarray:
    """The bytes ``at`` to ``at + width`` of each suffix as a big-endian number, ``width`` at most 8."""
    view = np.lib.stride_tricks.sliding_window_view(data, 8)[starts + at]
    key = np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)
    return key >> np.uint64(64 - 8 * width)


class _Node:
    """``at``: the first byte in which the suffixes below differ; a leaf has ``equal`` suffixes instead of children."""

    __slots__ = ("at", "below", "equal", "tail")

    def __init__(self, at: int, below: dict, equal: list | None, tail: int):
        self.at, self.below, self.equal, self.tail = at, below, equal, tail


def blind_order(tails: list[int], width: int) -> list[list[int]]:
    """Places of ``tails`` (big-endian numbers of ``width`` bytes) in order, equal ones together."""
    root = None
    for k, tail in enumerate(tails):
        if root is None:
            root = _Node(width, {}, [k], tail)
            continue
        node, path = root, []
        while node.equal is None:  # down, by branching bytes alone; a byte that is new there takes any way
            path.append(node)
            node = node.below.get(tail >> 8 * (width - 1 - node.at) & 255) or next(iter(node.below.values()))
        if node.tail == tail:
            node.equal.append(k)
            continue
        differ = width - ((node.tail ^ tail).bit_length() + 7) // 8
        mine, other = tail >> 8 * (width - 1 - differ) & 255, node.tail >> 8 * (width - 1 - differ) & 255
        leaf = _Node(width, {}, [k], tail)
        up = next((i for i, x in enumerate(path) if x.at >= differ), len(path))
        at = path[up] if up < len(path) else node
        if at.equal is None and at.at == differ:
            at.below[mine] = leaf
            continue
        fork = _Node(differ, {mine: leaf, other: at}, None, tail)
        if up:
            above = path[up - 1]
            above.below[tail >> 8 * (width - 1 - above.at) & 255] = fork
        else:
            root = fork
    out, stack = [], [root] if root else []
    while stack:
        node = stack.pop()
        if node.equal is not None:
            out.append(node.equal)
        else:
            stack += [node.below[b] for b in sorted(node.below, reverse=True)]
    return out


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, depth: int, shallow: int = 40, blind: int = BLIND) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of the ``depth`` bytes from them, and for each whether it differs from the one before.

    Every suffix has ``depth`` bytes in ``data``, and ``data`` has eight bytes more. Suffixes
    that are equal in all of them are together, in any order.
    """
    order = np.arange(len(starts))
    new = np.zeros(len(starts), bool)
    new[:1] = True
    at, tries = 0, []
    open_ = order.copy()  # places in ``order`` that aren't alone in their group
    while at < depth and len(open_):
        width = min(8, depth - at)
        group = np.cumsum(new)[open_]
        if at >= shallow:
            # Small groups leave the quicksort for blind tries.
            edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            sizes = np.diff(np.append(edges, len(open_)))
            small = np.repeat(sizes <= blind, sizes)
            tries.append((at, open_[small]))
            open_, group = open_[~small], group[~small]
            shallow = depth
            if not len(open_):
                break
        key = _characters(data, starts[order[open_]], at, width)
        by = np.lexsort((key, group))
        order[open_] = order[open_][by]
        key, group = key[by], group[by]
        new[open_[1:]] |= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        at += width
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone[open_]]
    for start, places in tries:
        _blind(data, starts, order, new, places, start, depth)
    return order, new


def _blind(data: np.ndarray, starts: np.ndarray, order: np.ndarray, new: np.ndarray, places: np.ndarray, at: int, depth: int) -> None:
    """Orders the groups at ``places``, equal in their first ``at`` bytes, by blind tries."""
    if not len(places):
        return
    width = depth - at
    raw = np.lib.stride_tricks.sliding_window_view(data, width)[starts[order[places]] + at].tobytes()
    tails = [int.from_bytes(raw[i : i + width]) for i in range(0, len(raw), width)]
    edges = np.append(np.flatnonzero(new[places]), len(places)).tolist()
    moved, fresh = np.arange(len(places)), []
    for a, b in zip(edges, edges[1:], strict=False):
        if tails[a:b].count(tails[a]) == b - a:
            continue
        at_ = a
        for equal in blind_order(tails[a:b], width):
            fresh.append(at_)
            moved[at_ : at_ + len(equal)] = [a + k for k in equal]
            at_ += len(equal)
    order[places] = order[places][moved]
    new[places[fresh]] = True
