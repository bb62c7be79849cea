"""Curve skeletons from level sets of the distance along the surface.

Each connected part of a surface is cut into bands of equal distance from one of its ends; the connected pieces of a
band are cross-sections, and the middle of each is a point of the skeleton. Where the solid branches a band falls
into several pieces, so every branch has points of its own.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Vertices up to which meshes of the same faces are taken together, and numbers that one sweep holds.
VERTICES, SWEEP = 256, 1 << 18


def _distances(start: int, at: np.ndarray, to: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Least sums of edge lengths from a vertex; edges of vertex i are ``at[i]`` to ``at[i + 1]``."""
    out, heap = np.full(n, np.inf), [(0.0, start)]
    out[start] = 0
    while heap:
        d, i = heapq.heappop(heap)
        if d > out[i]:
            continue
        for k in range(at[i], at[i + 1]):
            far = d + length[k]
            if far < out[to[k]]:
                out[to[k]] = far
                heapq.heappush(heap, (far, int(to[k])))
    return out


def _pieces(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each vertex's connected piece."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _net(faces: list) -> tuple[np.ndarray, np.ndarray]:
    """Vertices that faces use, and the distinct sides of faces by the numbers of their ends among those."""
    used = np.array(sorted({i for f in faces for i in f}), np.int64)
    if not len(used):
        return used, np.empty((0, 2), np.int64)
    number = np.full(int(used.max()) + 1, -1)
    number[used] = np.arange(len(used))
    return used, np.unique(np.array([sorted((number[f[k]], number[f[(k + 1) % len(f)]])) for f in faces for k in range(len(f))]), axis=0)


def skeleton(vertices: np.ndarray, faces: list, band: float = 3.0) -> np.ndarray:
    """Skeleton points in the order of their coordinates; deterministic. A band is at least ``band`` median edges wide, so a
    finer mesh has more points; a mesh too coarse to cut has one point a connected part. No faces, no points."""
    used, pairs = _net(faces)
    if not len(used):
        return np.empty((0, 3))
    x, n = np.asarray(vertices, np.float64)[used], len(used)
    size = np.linalg.norm(x[pairs[:, 0]] - x[pairs[:, 1]], axis=1)
    a, b, both = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]]), np.concatenate([size, size])
    order = np.lexsort((b, a))
    to, length, at = b[order], both[order], np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))])
    part, level = _pieces(n, pairs[:, 0], pairs[:, 1]), np.zeros(n, np.int64)
    width = band * float(np.median(size))
    for root in np.unique(part):
        own = np.flatnonzero(part == root)
        first = _distances(int(root), at, to, length, n)[own]
        end = own[np.flatnonzero(first == first.max())[0]]
        d = _distances(int(end), at, to, length, n)[own]
        count = max(1, int(d.max() / width)) if width > 0 else 1
        level[own] = np.minimum((d / (d.max() or 1.0) * count).astype(np.int64), count - 1)
    same = level[pairs[:, 0]] == level[pairs[:, 1]]
    piece, members = np.unique(_pieces(n, pairs[same, 0], pairs[same, 1]), return_inverse=True)
    out = np.zeros((len(piece), 3))
    np.add.at(out, members, x)
    out /= np.bincount(members)[:, None]
    return out[np.lexsort(out.T[::-1])]


def skeletons(meshes: list, band: float = 3.0) -> list:
    """``skeleton`` of each (vertices, faces), None for None; small meshes of the same faces are taken together."""
    out, alike = [None] * len(meshes), {}
    for k, mesh in enumerate(meshes):
        if mesh is not None:
            v, faces = mesh
            key = (len(v), faces.shape, faces.tobytes()) if isinstance(faces, np.ndarray) else (len(v), tuple(map(tuple, faces)))
            alike.setdefault(key, []).append(k)
    for rows in alike.values():
        faces = meshes[rows[0]][1]
        faces = faces.tolist() if isinstance(faces, np.ndarray) else faces
        used, pairs = _net(faces) if len(rows) > 1 and min((i for f in faces for i in f), default=-1) >= 0 else ((), ())
        if 0 < len(used) <= VERTICES:
            x = np.stack([np.asarray(meshes[k][0], np.float64)[used] for k in rows])
            sure = np.isfinite(x).all(axis=(1, 2))
            step = max(1, SWEEP // (2 * len(pairs)))
            own = np.flatnonzero(sure)
            for at in range(0, len(own), step):
                for k, points in zip(own[at : at + step].tolist(), _together(x[own[at : at + step]], pairs, band), strict=True):
                    out[rows[k]] = points
            rows = [rows[k] for k in np.flatnonzero(~sure)]
        for k in rows:
            out[k] = skeleton(meshes[k][0], faces, band)
    return out


def _together(x: np.ndarray, pairs: np.ndarray, band: float) -> list:
    """``skeleton`` of meshes (k, n, 3) with the same sides."""
    k, n, _ = x.shape
    size = np.linalg.norm(x[:, pairs[:, 0]] - x[:, pairs[:, 1]], axis=2)
    a, b = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    order = np.argsort(b, kind="stable")
    start, length, at = a[order], np.concatenate([size, size], axis=1)[:, order], np.searchsorted(b[order], np.arange(n))

    def distances(roots):  # as ``_distances``: sums grow along a path, so the least of all paths is the same in any order
        d = np.full((k, n), np.inf)
        d[np.arange(k), roots] = 0
        while True:
            low = np.minimum(d, np.minimum.reduceat(d[:, start] + length, at, axis=1))
            if (low == d).all():
                return d
            d = low

    part, level = _pieces(n, pairs[:, 0], pairs[:, 1]), np.zeros((k, n), np.int64)
    width = band * np.median(size, axis=1)
    for root in np.unique(part):
        own = np.flatnonzero(part == root)
        end = own[distances(root)[:, own].argmax(axis=1)]
        d = distances(end)[:, own]
        most = d.max(axis=1)
        count = np.maximum(1, np.where(width > 0, most / np.where(width > 0, width, 1), 1).astype(np.int64))
        level[:, own] = np.minimum((d / np.where(most == 0, 1.0, most)[:, None] * count[:, None]).astype(np.int64), count[:, None] - 1)
    row, side = np.nonzero(level[:, pairs[:, 0]] == level[:, pairs[:, 1]])
    piece, members = np.unique(_pieces(k * n, row * n + pairs[side, 0], row * n + pairs[side, 1]), return_inverse=True)
    points = np.stack([np.bincount(members, x[:, :, c].ravel()) for c in range(3)], axis=1) / np.bincount(members)[:, None]
    points = points[np.lexsort((*points.T[::-1], piece // n))]
    return np.split(points, np.cumsum(np.bincount(piece // n, minlength=k))[:-1])
