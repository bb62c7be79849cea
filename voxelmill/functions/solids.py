"""Many solids at once: packed meshes of equal shape become arrays, and pairs of boxes or of convex solids are decided in
sweeps over all pairs. Any other mesh takes the tests of ``geometry``, pair by pair, with the same results."""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa

from . import geometry as g
from .meshes import unpack

#: Triangles of a convex solid, and distinct directions of its faces or edges, up to which pairs are decided in sweeps.
TRIANGLES, DIRECTIONS = 32, 12
#: Pairs that a sweep takes at once.
PAIRS = 4096
#: Frames in which bricks of two columns are measured; bricks in others are convex solids as any.
FRAMES = 8
RELATIONS = ("surface", "interior", "a_in_b", "b_in_a")


def _shapes(mesh: pa.Array):
    """(rows, vertices (k, v, 3), triangles as corners (k, t, 3)) of the packed meshes of each shape; none without triangles."""
    wide = pa.types.is_large_binary(mesh.type)
    if not len(mesh) or mesh.null_count == len(mesh):
        return
    at = np.frombuffer(mesh.buffers()[1], np.int64 if wide else np.int32)[mesh.offset : mesh.offset + len(mesh) + 1].astype(np.int64)
    data, size = np.frombuffer(mesh.buffers()[2], np.uint8), np.diff(at)
    rows = np.flatnonzero((size > 4) & mesh.is_valid().to_numpy(zero_copy_only=False))
    corners = data[at[rows, None] + np.arange(4)].copy().view(np.int32)[:, 0].astype(np.int64)
    key = size[rows] << 31 | corners
    for k in np.unique(key):
        own, n, total = rows[key == k], int(k & (1 << 31) - 1), int(k >> 31)
        if total <= 4 + 24 * n:
            continue
        raw = data[at[own, None] + np.arange(total)]
        yield own, raw[:, 4 : 4 + 24 * n].copy().view(np.float64).reshape(len(own), n, 3), raw[:, 4 + 24 * n :].copy().view(np.int32).reshape(len(own), -1, 3).astype(np.int64)


def _closed(faces: np.ndarray, n: int) -> np.ndarray:
    """Whether every directed edge has its opposite once, and every vertex a face."""
    k, turn = len(faces), np.roll(faces, -1, axis=2)
    e, r = np.sort((faces * n + turn).reshape(k, -1)), np.sort((turn * n + faces).reshape(k, -1))
    used = (np.diff(np.sort(faces.reshape(k, -1))) > 0).sum(axis=1) + 1
    return (e == r).all(axis=1) & (np.diff(e) > 0).all(axis=1) & (used == n)


def _distinct(d: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit directions (k, m, 3) that are kept, each up to its sign once and the rest zero; how many there are."""
    big = np.take_along_axis(d, np.abs(d).argmax(axis=2)[:, :, None], axis=2)
    d = np.where(big < 0, -d, d)
    same = (np.abs(d[:, :, None] - d[:, None]).max(axis=3) < 1e-10) & keep[:, None]
    keep = keep & ~np.tril(same, -1).any(axis=2)
    order, n = np.argsort(~keep, axis=1, kind="stable"), keep.sum(axis=1)
    d = np.where(keep[:, :, None], d, 0.0)
    return np.take_along_axis(d, order[:, :, None], axis=1)[:, : max(1, n.max(initial=0))], n


def _forms(faces: np.ndarray, sides: np.ndarray, up: np.ndarray, n: int):
    """Of solids with the same faces and the same vectors along their sides, which differ in place alone, once: outward normals,
    distinct directions of faces and of bent edges, ends of those, whether it has areas and few directions; each solid's form."""
    k = len(faces)
    key = np.ascontiguousarray(np.concatenate([faces.reshape(k, -1).astype(np.float64), sides.reshape(k, -1), up[:, None]], axis=1))
    _, one, form = np.unique(key.view(f"V{key.shape[1] * 8}")[:, 0], return_index=True, return_inverse=True)
    faces, sides, up, k = faces[one], sides[one], up[one], len(one)
    normal = np.cross(sides[:, :, 0], -sides[:, :, 2])
    size = np.linalg.norm(normal, axis=2, keepdims=True)
    normal = normal / np.where(size > 0, size, 1) * up[:, None, None]
    turn, row = np.roll(faces, -1, axis=2), np.arange(k)[:, None]
    code = (np.minimum(faces, turn) * n + np.maximum(faces, turn)).reshape(k, -1)
    order = np.argsort(code, axis=1, kind="stable").reshape(k, -1, 2)  # each edge has two triangles
    bend = np.linalg.norm(np.cross(normal[row, order[:, :, 0] // 3], normal[row, order[:, :, 1] // 3]), axis=2) > 1e-9
    first, last = (np.take_along_axis(x.reshape(k, -1), order[:, :, 0], axis=1) for x in (faces, turn))
    edge = sides.reshape(k, -1, 3)[row, order[:, :, 0]]
    long = np.linalg.norm(edge, axis=2, keepdims=True)
    edge = edge / np.where(long > 0, long, 1)
    (faced, nf), (edged, ne) = _distinct(normal, np.ones(normal.shape[:2], bool)), _distinct(edge, bend)
    bent = np.argsort(~bend, axis=1, kind="stable")[:, : bend.sum(axis=1).max()]
    bent = np.where(np.take_along_axis(bend, bent, axis=1), bent, bent[:, :1])
    ok = (size > 0).all(axis=(1, 2)) & (nf <= DIRECTIONS) & (ne <= DIRECTIONS)
    return normal, faced[:, :DIRECTIONS], edged[:, :DIRECTIONS], np.take_along_axis(first, bent, axis=1), np.take_along_axis(last, bent, axis=1), ok, form


class Solids:
    """A column of packed meshes: ``box`` (n, 6), ``usable`` (has triangles), ``is_box`` (a closed solid that is its own box)."""

    def __init__(self, mesh):
        self.mesh = mesh.combine_chunks() if isinstance(mesh, pa.ChunkedArray) else mesh
        n = len(self.mesh)
        self.usable, self.is_box, self.box, self._parts = np.zeros(n, bool), np.zeros(n, bool), np.full((n, 6), np.nan), []
        self._met = None
        for own, v, faces in _shapes(self.mesh):
            tri = v[np.arange(len(own))[:, None, None], faces]
            flat = np.ascontiguousarray(tri.reshape(len(own), -1, 3).transpose(1, 2, 0))  # a row per corner: over short axes, least and largest cost far more
            lo, hi = flat.min(axis=0).T, flat.max(axis=0).T
            self.usable[own], self.box[own] = True, np.concatenate([lo, hi], axis=1)
            if faces.shape[1] > TRIANGLES or v.shape[1] > 3 * TRIANGLES:
                continue
            ok = _closed(faces, v.shape[1])
            rel = tri - tri[:, :1, :1]
            vol = np.einsum("kti,kti->k", rel[:, :, 0], np.cross(rel[:, :, 1], rel[:, :, 2])) / 6
            full = np.prod(hi - lo, axis=1)
            ends = ((v == lo[:, None]) | (v == hi[:, None])).all(axis=(1, 2))
            self.is_box[own] = ok & ends & (full > 0) & (np.abs(np.abs(vol) - full) <= 1e-12 * full)
            self._parts.append((own, v, faces, tri, vol, ok))

    def tri(self, k: int) -> np.ndarray:
        return unpack(self.mesh[int(k)].as_py())

    @cached_property
    def _convex(self):
        """convex (n,), then for convex solids, padded: vertices, directions of faces and of edges, triangles, outward normals, edges."""
        n, parts = len(self.mesh), []
        convex = np.zeros(n, bool)
        for own, v, faces, tri, vol, ok in self._parts:
            ok = ok & np.isfinite(v).all(axis=(1, 2)) & (vol != 0)
            if not ok.any():
                continue
            own, v, faces, tri, up = own[ok], v[ok], faces[ok], tri[ok], np.sign(vol[ok])
            normal, faced, edged, first, last, ok, form = _forms(faces, np.roll(tri, -1, axis=2) - tri, up, v.shape[1])
            normal, ok = normal[form], ok[form]
            rise = np.matmul(normal, v.transpose(0, 2, 1)).max(axis=2) - np.einsum("kti,kti->kt", normal, tri[:, :, 0])
            ok &= (rise <= g.EPS * np.abs(v).max(axis=(1, 2))[:, None]).all(axis=1)
            own, v, form = own[ok], v[ok], form[ok]
            convex[own], row = True, np.arange(len(own))[:, None]
            parts.append((own, v, faced[form], edged[form], tri[ok], normal[ok], np.stack([v[row, x[form]] for x in (first, last)], axis=2)))
        out = [np.zeros((n, max((len(p[c][0]) if len(p[c]) else 1 for p in parts), default=1), *end)) for c, end in enumerate(((3,), (3,), (3,), (3, 3), (3,), (2, 3)), 1)]
        for own, *columns in parts:
            if not len(own):
                continue
            for k, (x, c) in enumerate(zip(out, columns, strict=True)):
                x[own, : c.shape[1]] = c
                if k not in (1, 2):  # directions end in zeros, the others repeat the first
                    x[own, c.shape[1] :] = c[:, :1]
        return convex, *out

    @property
    def convex(self) -> np.ndarray:
        return self._convex[0]

    def bricks(self, other: Solids):
        """``_bricks`` of both, found once."""
        if self._met is None or self._met[0] is not other:
            self._met = other, _bricks(self, other)
        return self._met[1]


# -- pairs of boxes ---------------------------------------------------------------------------------------------


def meeting(a: np.ndarray, b: np.ndarray, most: int = 1 << 20):
    """Pairs (i, j) of boxes (n, 6) that meet, in parts: along x in order, ``most`` comparisons at once."""
    if not len(a) or not len(b):
        return
    oa, ob = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    a, b = np.ascontiguousarray(a[oa].T), np.ascontiguousarray(b[ob].T)  # a row per axis: columns apart in memory cost twice as much
    wide, at = (b[3] - b[0]).max(), 0
    step = max(1, min(256, most // b.shape[1]))
    while at < a.shape[1]:
        part = a[:, at : at + step]
        x = np.searchsorted(b[0], part[0, 0] - wide * (1 + 1e-9) - 1e-9 * abs(part[0, 0]), "left")
        y = np.searchsorted(b[0], part[3].max(), "right")
        near = b[:, x:y]
        hit = part[0, :, None] <= near[3]
        hit &= part[3, :, None] >= near[0]
        for c in (1, 2):
            hit &= part[c, :, None] <= near[3 + c]
            hit &= part[3 + c, :, None] >= near[c]
        found = np.flatnonzero(hit)
        if len(found):
            i, j = np.divmod(found, y - x)
            yield oa[at + i], ob[x + j]
        at += step


def holding(a: np.ndarray, b: np.ndarray, most: int = 1 << 20):
    """As ``meeting``, pairs where box a[i] holds box b[j], borders included."""
    if not len(a) or not len(b):
        return
    oa, ob = np.argsort(a[:, 0], kind="stable"), np.argsort(b[:, 0], kind="stable")
    a, b = np.ascontiguousarray(a[oa].T), np.ascontiguousarray(b[ob].T)
    step = max(1, min(256, most // b.shape[1]))
    for at in range(0, a.shape[1], step):
        part = a[:, at : at + step]
        x, y = np.searchsorted(b[0], part[0, 0], "left"), np.searchsorted(b[0], part[3].max(), "right")
        near = b[:, x:y]
        hit = part[3, :, None] >= near[3]
        for c in (0, 1, 2):
            hit &= part[c, :, None] <= near[c]
            if c:
                hit &= part[3 + c, :, None] >= near[3 + c]
        found = np.flatnonzero(hit)
        if len(found):
            i, j = np.divmod(found, y - x)
            yield oa[at + i], ob[x + j]


def held(a: np.ndarray, b: np.ndarray, most: int = 1 << 20):
    """As ``holding``, pairs where box b[j] holds box a[i]."""
    for j, i in holding(b, a, most):
        yield i, j


def gaps2(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distance of boxes a[i] and b[j], pairwise."""
    a, b, out = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), 0.0
    for c in range(3):
        d = np.maximum(np.maximum(a[c][i] - b[3 + c][j], b[c][j] - a[3 + c][i]), 0)
        out = out + d * d
    return out


def _tolerance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return g.EPS * np.maximum(np.abs(a).max(axis=1), np.abs(b).max(axis=1))


def _box_relations(a: np.ndarray, b: np.ndarray):
    """``geometry.relation`` of solids that are boxes; whether faces share a patch, for those that touch."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)  # a row per axis: sums over three columns cost far more
    la, ha, lb, hb = a[:3], a[3:], b[:3], b[3:]
    tol = g.EPS * np.maximum(np.abs(a).max(axis=0), np.abs(b).max(axis=0))
    d = np.minimum(ha, hb) - np.maximum(la, lb)
    held = ((la > lb + tol) & (ha < hb - tol)).all(axis=0) | ((lb > la + tol) & (hb < ha - tol)).all(axis=0)
    surface = (d >= -tol).all(axis=0) & ~held
    v, va, vb = np.prod(np.maximum(d, 0), axis=0), np.prod(ha - la, axis=0), np.prod(hb - lb, axis=0)
    slack = 1e-7 * np.minimum(va, vb)
    interior = v > slack
    patch = surface & ~interior & ((d > tol).sum(axis=0) == 2)
    return surface, interior, interior & (v >= va - slack), interior & (v >= vb - slack), patch


# -- pairs of bricks --------------------------------------------------------------------------------------------


def _frame(tri: np.ndarray) -> np.ndarray | None:
    """Three directions at right angles, two of them sides of a triangle, if it has a right angle."""
    side = np.roll(tri, -1, axis=0) - tri
    size = np.linalg.norm(side, axis=1, keepdims=True)
    side = side / np.where(size > 0, size, 1)
    flat = np.abs(np.einsum("ki,ki->k", side, np.roll(side, -1, axis=0)))
    k = int(flat.argmin())
    if not (size > 0).all() or flat[k] > 1e-12:
        return None
    u, w = side[k], side[(k + 1) % 3]
    up = np.cross(u, w)
    return np.stack([u, np.cross(up, u), up])


def _bricks(a: Solids, b: Solids):
    """Bricks, that is boxes however turned, in frames that solids of both columns have in common: for a and for b each solid's frame
    (-1: none) and its box there, seen from a point amid them; how far a distance of two such boxes may be off."""
    sides = [(np.full(len(s.mesh), -1), np.zeros((len(s.mesh), 6))) for s in (a, b)]
    rows = [(n, own[some], v[some], faces[some], np.abs(vol[some])) for n, s in enumerate((a, b)) for own, v, faces, _, vol, ok in s._parts
            if v.shape[1] == 8 and faces.shape[1] == 12 and (some := ok & (vol != 0) & np.isfinite(v).all(axis=(1, 2)) & ~s.is_box[own]).any()]
    if {r[0] for r in rows} != {0, 1}:
        return *sides, 0.0
    n, own, v, faces, vol = (np.concatenate([np.full(len(r[1]), r[0]) for r in rows]), *(np.concatenate([r[c] for r in rows]) for c in (1, 2, 3, 4)))
    middle = (v.min(axis=(0, 1)) + v.max(axis=(0, 1))) / 2
    most, v, at, off = 1e-12 * np.abs(v.reshape(len(v), -1).T.copy()).max(axis=0), v - middle, np.arange(len(n)), 0.0
    for frame in range(FRAMES):
        if not len(at):
            break
        axes = _frame(v[at[0], faces[at[0], 0]])
        fits = np.zeros(len(at), bool)
        if axes is not None:
            p = np.ascontiguousarray(np.matmul(v[at], axes.T).transpose(1, 2, 0))
            lo, hi = p.min(axis=0), p.max(axis=0)
            high = p > (lo + hi) / 2
            away, full, lo, hi = np.where(high, hi - p, p - lo).max(axis=(0, 1)), np.prod(hi - lo, axis=0), lo.T, hi.T
            code = (high[:, 0] | high[:, 1] << 1 | high[:, 2] << 2).astype(np.uint8).T  # which corner each vertex is
            x, y, z = code[np.arange(len(at))[:, None, None], faces[at]].transpose(2, 0, 1)
            flat = ((x & y & z | 7 ^ (x | y | z)) > 0).all(axis=1)  # each triangle lies in a side
            fits = ((1 << code.astype(int)).sum(axis=1) == 255) & flat & (away <= most[at]) & (np.abs(vol[at] - full) <= 1e-9 * full)
            for side, (found, box) in enumerate(sides):
                k = fits & (n[at] == side)
                found[own[at[k]]], box[own[at[k]]] = frame, np.concatenate([lo[k], hi[k]], axis=1)
            off = max(off, away[fits].max(initial=0))
        fits[0] = True
        at = at[~fits]
    return *sides, 2 * np.sqrt(3) * off + 16 * np.finfo(float).eps * np.abs(v).max()


# -- pairs of convex solids -------------------------------------------------------------------------------------


def _spans(axes: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.matmul(axes, points.transpose(0, 2, 1))
    return p.min(axis=2), p.max(axis=2)


def _convex_relations(a: Solids, b: Solids, i: np.ndarray, j: np.ndarray, patches: bool = False):
    """As ``_box_relations`` by separating axes, then the largest gap along an axis (below 0: depth) and the pairs that are
    too close to a limit to be decided here."""
    va, fa, ea = (x[i] for x in a._convex[1:4])
    vb, fb, eb = (x[j] for x in b._convex[1:4])
    o = (va[:, :1] + vb[:, :1]) / 2  # near both, so that little is lost to rounding
    tol = _tolerance(a.box[i], b.box[j])
    va, vb = va - o, vb - o
    cross = np.cross(ea[:, :, None], eb[:, None]).reshape(len(i), -1, 3)
    size = np.linalg.norm(cross, axis=2, keepdims=True)
    axes = np.concatenate([fa, fb, np.where(size > 1e-9, cross / np.where(size > 1e-9, size, 1), 0)], axis=1)
    (la, ha), (lb, hb) = _spans(axes, va), _spans(axes, vb)
    real = np.abs(axes).max(axis=2) > 0
    gap = np.where(real, np.maximum(la - hb, lb - ha), -np.inf).max(axis=1)
    na, own_a, own_b = fa.shape[1], slice(0, fa.shape[1]), slice(fa.shape[1], fa.shape[1] + fb.shape[1])
    t = tol[:, None]

    def held(lx, hx, ly, hy, axis, slack):  # x in y, along y's own faces
        return (~real[:, axis] | ((lx >= ly + slack) & (hx <= hy - slack))[:, axis]).all(axis=1)

    strict = held(la, ha, lb, hb, own_b, t) | held(lb, hb, la, ha, own_a, t)
    surface, interior = (gap <= tol) & ~strict, gap < -tol
    a_in_b, b_in_a = interior & held(la, ha, lb, hb, own_b, -t), interior & held(lb, hb, la, ha, own_a, -t)
    unsure = (gap < -tol) & (gap > -1000 * tol)  # thin: the volume decides
    patch = np.zeros(len(i), bool)
    if patches and (todo := np.flatnonzero(surface & ~interior)).size:
        for k in range(na):  # a face of a and an opposite face of b in one plane
            n = fa[todo, k]
            for up in (1, -1):
                pa_, pb = up * np.einsum("mi,mvi->mv", n, va[todo]), up * np.einsum("mi,mvi->mv", n, vb[todo])
                top, low = pa_.max(axis=1), pb.min(axis=1)
                flat = np.abs(np.einsum("mi,mei->me", n, fb[todo])).max(axis=1) > 1 - 1e-12
                at = np.flatnonzero((np.abs(low - top) <= tol[todo]) & flat & (np.abs(n).max(axis=1) > 0))
                if not at.size:
                    continue
                m, on_a, on_b = todo[at], pa_[at] >= (top - tol[todo])[at, None], pb[at] <= (low + tol[todo])[at, None]
                edges = np.concatenate([ea[m], eb[m]], axis=1)
                lying = np.abs(np.einsum("mi,mei->me", n[at], edges)) < 1e-9
                side = np.where(lying[:, :, None], np.cross(n[at, None], edges), 0)
                sa, sb = np.matmul(side, va[m].transpose(0, 2, 1)), np.matmul(side, vb[m].transpose(0, 2, 1))
                lo = np.maximum(np.where(on_a[:, None], sa, np.inf).min(axis=2), np.where(on_b[:, None], sb, np.inf).min(axis=2))
                hi = np.minimum(np.where(on_a[:, None], sa, -np.inf).max(axis=2), np.where(on_b[:, None], sb, -np.inf).max(axis=2))
                broad = ((hi - lo > t[m]) | (np.abs(side).max(axis=2) == 0)).all(axis=1)
                patch[m] |= broad & (on_a.sum(axis=1) >= 3) & (on_b.sum(axis=1) >= 3)
    return surface, interior, a_in_b, b_in_a, patch, gap, unsure


def _convex_gaps2(a: Solids, b: Solids, i: np.ndarray, j: np.ndarray, most: float = np.inf, enough: float = -1.0) -> np.ndarray:
    """Squared distances of convex solids that are apart: vertices, then vertices and faces, then edges. Above ``most`` any value
    above it; no better value than ``enough`` is looked for."""
    va, ta, na, ea = (a._convex[c][i] for c in (1, 4, 5, 6))
    vb, tb, nb, eb = (b._convex[c][j] for c in (1, 4, 5, 6))
    best = np.full(len(i), np.inf)
    for c in range(va.shape[1]):
        best = np.minimum(best, ((va[:, c : c + 1] - vb) ** 2).sum(axis=2).min(axis=1))
    limit = np.where(best > enough, np.minimum(best, most) * (1 + 1e-9), -1.0)
    for p, t, n in ((va, tb, nb), (vb, ta, na)):
        h = np.einsum("mvi,mti->mvt", p, n) - np.einsum("mti,mti->mt", n, t[:, :, 0])[:, None]
        m, v, f = np.nonzero((h >= 0) & (h * h <= limit[:, None, None]))
        foot, up, inside = p[m, v] - n[m, f] * h[m, v, f][:, None], n[m, f], np.ones(len(m), bool)
        tri = t[m, f]
        for k in range(3):
            inside &= np.einsum("ij,ij->i", np.cross(tri[:, (k + 1) % 3] - tri[:, k], foot - tri[:, k]), up) * np.where(_turned(tri, up), -1, 1) >= 0
        np.minimum.at(best, m[inside], h[m, v, f][inside] ** 2)
    limit = np.where(best > enough, np.minimum(best, most) * (1 + 1e-9), -1.0)
    la, ha, lb, hb = ea.min(axis=2), ea.max(axis=2), eb.min(axis=2), eb.max(axis=2)
    far = np.zeros((len(i), ea.shape[1], eb.shape[1]))
    for c in range(3):
        d = np.maximum(np.maximum(la[:, :, None, c] - hb[:, None, :, c], lb[:, None, :, c] - ha[:, :, None, c]), 0)
        far += d * d
    m, x, y = np.nonzero(far <= limit[:, None, None])
    for at in range(0, len(m), 1 << 15):
        k = slice(at, at + (1 << 15))
        p, q = ea[m[k], x[k]], eb[m[k], y[k]]
        np.minimum.at(best, m[k], g.segment_segment(p[:, 0], p[:, 1], q[:, 0], q[:, 1]))
    return best


def _turned(tri: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Whether triangles turn against their outward normals."""
    return np.einsum("ij,ij->i", g.cross_of(tri), up) < 0


def _parted(a: Solids, b: Solids, i: np.ndarray, j: np.ndarray):
    """Numbers of the pairs of two boxes, of two convex solids, and of the rest."""
    box = a.is_box[i] & b.is_box[j]
    if box.all():
        return np.flatnonzero(box), np.empty(0, np.int64), np.empty(0, np.int64)
    convex = a.convex[i] & b.convex[j] & ~box
    return np.flatnonzero(box), np.flatnonzero(convex), np.flatnonzero(~box & ~convex)


def _meshes(a: Solids, b: Solids, i: np.ndarray, j: np.ndarray) -> list:
    x, y = ({k: s.tri(k) for k in set(n.tolist())} for s, n in ((a, i), (b, j)))
    return [(x[p], y[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)]


def _named(name: str, solid: bool, surface, interior, a_in_b, b_in_a, patch):
    return {
        "st_intersects": lambda: surface | interior if solid else surface, "st_disjoint": lambda: ~(surface | interior), "st_touches": lambda: surface & ~interior,
        "st_adjacent": lambda: patch, "st_equals": lambda: a_in_b & b_in_a, "st_contains": lambda: b_in_a, "st_within": lambda: a_in_b,
        "st_overlaps": lambda: interior & ~a_in_b & ~b_in_a, "st_crosses": lambda: interior & ~a_in_b & ~b_in_a,
    }[name]()


def holds(name: str, a: Solids, b: Solids, i: np.ndarray, j: np.ndarray, distance: float = 0.0, solid: bool = False) -> np.ndarray:
    """Whether a named predicate holds between solids a[i] and b[j], pairwise; as ``geometry.holds``."""
    if name == "st_dwithin":
        return _within(a, b, i, j, distance)
    out = np.zeros(len(i), bool)
    box, convex, rest = _parted(a, b, i, j)
    if len(box):
        out[box] = _named(name, solid, *_box_relations(a.box[i[box]], b.box[j[box]]))
    unsure = [rest]
    for at in range(0, len(convex), PAIRS):
        k = convex[at : at + PAIRS]
        *found, _, thin = _convex_relations(a, b, i[k], j[k], name == "st_adjacent")
        out[k] = _named(name, solid, *found)
        if name != "st_intersects":
            unsure.append(k[thin])
    rest = np.concatenate(unsure)
    for at in range(0, len(rest), PAIRS):
        k = rest[at : at + PAIRS]
        pairs = _meshes(a, b, i[k], j[k])
        meets = g.surfaces_meet_many(pairs)
        out[k] = meets if name == "st_intersects" and not solid else [g.holds(name, *p, solid=solid, meets=bool(m)) for p, m in zip(pairs, meets, strict=True)]
    return out


def _within(a: Solids, b: Solids, i: np.ndarray, j: np.ndarray, distance: float) -> np.ndarray:
    reach, out, left = distance * (1 + 1e-12), np.zeros(len(i), bool), np.arange(len(i))
    (fa, pa_), (fb, pb), off = a.bricks(b)
    if (fa >= 0).any():
        own = (fa[i] == fb[j]) & (fa[i] >= 0)
        k = left if own.all() else np.flatnonzero(own)
        gap = np.sqrt(gaps2(pa_, pb, i[k], j[k]))
        out[k] = gap <= reach
        near = k[(gap >= reach - off) & (gap <= max(reach, g.EPS * max(np.nanmax(np.abs(s.box)) for s in (a, b))) + off)]  # left to the tests of convex solids
        left = np.concatenate([np.flatnonzero(~own), near])
        i, j = i[left], j[left]
    box, convex, rest = _parted(a, b, i, j)
    out[left[box]] = np.sqrt(gaps2(a.box, b.box, i[box], j[box])) <= reach
    for at in range(0, len(convex), PAIRS):
        k = convex[at : at + PAIRS]
        out[left[k]] = False
        k = k[np.sqrt(gaps2(a.box, b.box, i[k], j[k])) <= reach]
        if not len(k):
            continue
        *_, gap, _ = _convex_relations(a, b, i[k], j[k])
        tol = _tolerance(a.box[i[k]], b.box[j[k]])
        out[left[k[gap <= tol]]] = True
        k = k[(gap > tol) & (gap <= reach + tol)]  # no distance is below a gap
        out[left[k]] = np.sqrt(_convex_gaps2(a, b, i[k], j[k], reach * reach, reach * abs(reach))) <= reach
    for at in range(0, len(rest), PAIRS):
        k = rest[at : at + PAIRS]
        out[left[k]] = g.within(_meshes(a, b, i[k], j[k]), distance)
    return out


def distances(a: Solids, b: Solids, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``geometry.solid_distance`` of solids a[i] and b[j], pairwise."""
    out = np.zeros(len(i))
    box, convex, rest = _parted(a, b, i, j)
    out[box] = np.sqrt(gaps2(a.box, b.box, i[box], j[box]))
    for at in range(0, len(convex), PAIRS):
        k = convex[at : at + PAIRS]
        *_, gap, _ = _convex_relations(a, b, i[k], j[k])
        k = k[gap > _tolerance(a.box[i[k]], b.box[j[k]])]
        out[k] = np.sqrt(_convex_gaps2(a, b, i[k], j[k]))
    for at in range(0, len(rest), PAIRS):
        k = rest[at : at + PAIRS]
        out[k] = g.solid_distances(_meshes(a, b, i[k], j[k]))
    return out


def point_distances(p: np.ndarray, b: Solids, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distance of points p[i] to the surfaces of solids b[j], pairwise, also from inside."""
    out, box = np.zeros(len(i)), b.is_box[j]
    q, own = p[i[box]], b.box[j[box]]
    low, high = q - own[:, :3], own[:, 3:] - q
    deep = np.minimum(low, high).min(axis=1)
    out[box] = np.where(deep > 0, deep, np.sqrt(gaps2(np.concatenate([p, p], axis=1), b.box, i[box], j[box])))
    rest, at = np.flatnonzero(~box), 0
    mesh = {k: b.tri(k) for k in set(j[rest].tolist())}
    while at < len(rest):  # many small meshes in one sweep
        part, total = [], 0
        while at + len(part) < len(rest) and total < 50_000:
            part.append(mesh[int(j[rest[at + len(part)]])])
            total += len(part[-1])
        k, n = rest[at : at + len(part)], np.array([len(t) for t in part])
        d = g.point_triangle(np.repeat(p[i[k]], n, axis=0), np.concatenate(part))
        out[k] = np.sqrt(np.minimum.reduceat(d, np.cumsum(n) - n))
        at += len(part)
    return out


def volumes(a: Solids, b: Solids, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Volumes of a[i], of b[j] and of what they have in common."""
    own = []
    for s, n in ((a, i), (b, j)):
        vol = np.prod(s.box[:, 3:] - s.box[:, :3], axis=1)
        if not s.is_box.all():
            for k in np.unique(n[~s.is_box[n]]):
                vol[k] = g.volume(s.tri(k))
        own.append(vol[n])
    box, both = a.is_box[i] & b.is_box[j], 1.0
    x, y = np.ascontiguousarray(a.box.T), np.ascontiguousarray(b.box.T)
    for c in range(3):
        both = both * np.maximum(np.minimum(x[3 + c][i], y[3 + c][j]) - np.maximum(x[c][i], y[c][j]), 0)
    rest = np.flatnonzero(~box)
    both[rest] = [g.intersection_volume(p, q) for p, q in _meshes(a, b, i[rest], j[rest])]
    return *own, both
