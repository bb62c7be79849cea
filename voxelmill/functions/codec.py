"""Progressive mesh compression with a level-of-detail knob.

Coordinates are quantized to ``bits`` per axis. Vertices are then taken away in passes: a vertex goes when its
neighbours form one ring that can be closed by a fan without making an edge twice or a face degenerate, and no
neighbour has gone in the same pass. A step stores the vertex, as a difference to its ring's mean, and the
faces it brings back. What no step removes is the base mesh. Decoding at a level of ``lod`` percent replays
ceil(lod * steps / 100) of the steps, last removed first. Bytes are a versioned header and zlib over integers.
A mesh without removable vertices is its base at every level.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"VXM1"


def quantize(v: np.ndarray, bits: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """(cells, low corner, step): cell = trunc((p - low) / step), the top one clamped; step = longest axis / 2^bits."""
    low = v.min(axis=0)
    step = float((v.max(axis=0) - low).max()) / (1 << bits) or 1.0
    return np.minimum(np.floor((v - low) / step), (1 << bits) - 1).astype(np.int64), low, step


def dequantize(cells: np.ndarray, low: np.ndarray, step: float) -> np.ndarray:
    return (cells + 0.5) * step + low


def _decimate(n: int, faces: list) -> tuple[list, list]:
    """(base faces, steps); a step: (vertex, ring, faces put in its place, faces it brings back)."""
    live = {i: tuple(f) for i, f in enumerate(faces)}
    around: list[set] = [set() for _ in range(n)]
    edges: dict = {}
    for i, f in live.items():
        for k, a in enumerate(f):
            around[a].add(i)
            e = frozenset((a, f[(k + 1) % len(f)]))
            edges[e] = edges.get(e, 0) + 1
    steps, fresh = [], len(faces)
    while True:
        busy, gone = set(), 0
        for v in range(n):
            own = around[v]
            if v in busy or not 3 <= len(own) <= 16 or len(live) - len(own) + len(own) - 2 < 4 or any(len(live[i]) != 3 for i in own):
                continue
            follow = {}
            for i in own:
                f = live[i]
                k = f.index(v)
                follow[f[(k + 1) % 3]] = f[(k + 2) % 3]
            start = min(follow)
            ring, x = [start], follow[start]
            while x != start and x in follow and len(ring) <= len(own):
                ring.append(x)
                x = follow[x]
            if x != start or len(ring) != len(own):
                continue
            inner = [frozenset((ring[0], ring[k])) for k in range(2, len(ring) - 1)]
            if any(e in edges for e in inner):
                continue
            if len(ring) == 3 and any(set(live[i]) == set(ring) for i in around[ring[0]] - own):
                continue
            put = [(ring[0], ring[k], ring[k + 1]) for k in range(1, len(ring) - 1)]
            steps.append((v, ring, put))
            for i in list(own):
                f = live.pop(i)
                for k, a in enumerate(f):
                    around[a].discard(i)
                    e = frozenset((a, f[(k + 1) % 3]))
                    edges[e] -= 1
                    if not edges[e]:
                        del edges[e]
            for f in put:
                live[fresh] = f
                for k, a in enumerate(f):
                    around[a].add(fresh)
                    e = frozenset((a, f[(k + 1) % 3]))
                    edges[e] = edges.get(e, 0) + 1
                fresh += 1
            busy |= {v, *ring}
            gone += 1
        if not gone:
            return list(live.values()), steps


def encode(vertices: np.ndarray, faces: list, bits: int = 12) -> bytes:
    """Bytes of a mesh; vertices that no face uses are left out."""
    used = sorted({i for f in faces for i in f})
    number = {x: i for i, x in enumerate(used)}
    faces = [[number[i] for i in f] for f in faces]
    cells, low, step = quantize(np.asarray(vertices, np.float64)[used], bits) if used else (np.empty((0, 3), np.int64), np.zeros(3), 1.0)
    base, steps = _decimate(len(used), faces)
    removed = {v for v, _, _ in steps}
    keep = [i for i in range(len(used)) if i not in removed]
    order = keep + [v for v, _, _ in reversed(steps)]
    number = {x: i for i, x in enumerate(order)}
    out: list[int] = [len(keep), len(base), len(steps)]
    out += np.diff(cells[keep], axis=0, prepend=0).ravel().tolist()
    for f in base:
        out += [len(f), *(number[i] for i in f)]
    for v, ring, _ in reversed(steps):
        mean = cells[ring].sum(axis=0) // len(ring)
        out += [len(ring), *(number[i] for i in ring), *(cells[v] - mean).tolist()]
    body = zlib.compress(np.array(out, "<i4").tobytes(), 6)
    return MAGIC + struct.pack("<B4d", bits, *low.tolist(), step) + body


def decode(blob: bytes, lod: float = 100) -> tuple[np.ndarray, list]:
    """(vertices, faces) at a level of detail in 0..100."""
    if blob[:4] != MAGIC:
        raise ValueError("not a mesh of this format")
    bits, *low, step = struct.unpack("<B4d", blob[4:37])
    data = np.frombuffer(zlib.decompress(blob[37:]), "<i4").tolist()
    n, m, steps = data[:3]
    at = 3 + 3 * n
    cells = np.cumsum(np.array(data[3:at], np.int64).reshape(-1, 3), axis=0).tolist()
    faces = set()
    for _ in range(m):
        k = data[at]
        faces.add(_least(tuple(data[at + 1 : at + 1 + k])))
        at += 1 + k
    for _ in range(min(steps, int(-(-min(100, max(0, lod)) * steps // 100)))):
        k = data[at]
        ring = data[at + 1 : at + 1 + k]
        delta = data[at + 1 + k : at + 4 + k]
        at += 4 + k
        mean = np.array([cells[i] for i in ring]).sum(axis=0) // k
        v = len(cells)
        cells.append((mean + delta).tolist())
        faces -= {_least((ring[0], ring[j], ring[j + 1])) for j in range(1, k - 1)}
        faces |= {_least((v, ring[j], ring[(j + 1) % k])) for j in range(k)}
    return dequantize(np.array(cells, np.float64).reshape(-1, 3), np.array(low), step), [list(f) for f in sorted(faces)]


def _least(f: tuple) -> tuple:
    k = f.index(min(f))
    return f[k:] + f[:k]


def steps_of(blob: bytes) -> int:
    return int(np.frombuffer(zlib.decompress(blob[37:]), "<i4")[2])
