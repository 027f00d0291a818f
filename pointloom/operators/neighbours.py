"""Neighbours inside a task, by cell lists in NumPy: points are put into cubic cells, and only cells side by side are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

PAIRS = 1 << 21  # compared at once
_SIDES = np.array([(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])


def _squeezed(cell: np.ndarray) -> np.ndarray:
    """Cell numbers of an axis with wide gaps made narrow: sides stay sides, and numbers stay below twice the points."""
    values, at = np.unique(cell, return_inverse=True)
    return np.cumsum(np.minimum(np.diff(values, prepend=values[0] - 1), 2))[at]


def _pairs(points: np.ndarray, todo: np.ndarray, width: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, squared distance) of all points j in the 27 cells around each i of todo, for some of todo at a time."""
    cell = np.stack([_squeezed(c) for c in np.floor((points - points.min(axis=0)) / width).astype(np.int64).T], axis=1)
    span = cell.max(axis=0) + 2
    key = (cell[:, 0] * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    filled, start = np.unique(key[order], return_index=True)
    size = np.diff(np.append(start, len(points)))
    around = (_SIDES[:, 0] * span[1] + _SIDES[:, 1]) * span[2] + _SIDES[:, 2]
    wanted = key[todo][:, None] + around[None]
    at = np.minimum(np.searchsorted(filled, wanted), len(filled) - 1)
    count = np.where(filled[at] == wanted, size[at], 0)
    ends = np.cumsum(count.sum(axis=1))
    first = 0
    while first < len(todo):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
        n, s = count[first:last].ravel(), start[at[first:last]].ravel()
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        j = order[np.repeat(s, n) + inside]
        i = np.repeat(np.repeat(todo[first:last], 27), n)
        yield i, j, ((points[i] - points[j]) ** 2).sum(axis=1)
        first = last


def within(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) no farther apart than radius, themselves included, by i."""
    found = [(i[near], j[near]) for i, j, d in _pairs(points, np.arange(len(points)), radius) for near in [np.sqrt(d) <= radius]] if len(points) else []
    i, j = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((j, i))
    return i[order], j[order]


def nearest(points: np.ndarray, k: int, radius: float = np.inf, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, distances), n x k, of each point's k nearest, itself included and ties by index; -1 and infinity where fewer lie within radius.
    Where `of` names some of the points, only these are asked, and have the rows.

    Cells start as wide as k points take on average, and widen for the points whose k-th neighbour lies beyond what a cell's sides cover.
    """
    n = len(points)
    index, far = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
    if not n:
        return index, far
    span = np.maximum(np.ptp(points, axis=0), 1e-9)
    width = min(radius, float((span.prod() * max(1, k) / n) ** (1 / 3)), float(span.max()) + 1e-9)
    todo = np.arange(n) if of is None else np.unique(of)
    while len(todo):
        left = []
        for i, j, d in _pairs(points, todo, width):
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], np.sqrt(d[order])
            begins = np.flatnonzero(np.diff(i, prepend=-1))
            rank = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
            take = (rank < k) & (d <= radius)
            index[i[take], rank[take]], far[i[take], rank[take]] = j[take], d[take]
            asked = i[begins]
            left.append(asked[far[asked, k - 1] > width])
        if width >= min(radius, float(span.max())):
            break
        todo, width = np.concatenate(left), 2 * width
    return (index, far) if of is None else (index[of], far[of])


def components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component, by hooking to least neighbours and halving paths."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while not np.array_equal(root, root[root]):
            root = root[root]
        if np.array_equal(root, before):
            return root
