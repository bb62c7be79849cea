"""Kernels on hand-made solids with known answers."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxelmill.functions import codec, frames, meshes
from voxelmill.functions import geometry as g
from voxelmill.functions import skeleton as sk
from voxelmill.functions.skeleton import skeleton

FACES = [[0, 2, 3], [0, 3, 1], [4, 5, 7], [4, 7, 6], [0, 1, 5], [0, 5, 4], [2, 6, 7], [2, 7, 3], [0, 4, 6], [0, 6, 2], [1, 3, 7], [1, 7, 5]]


def cube(low=(0, 0, 0), size=(1, 1, 1)):
    low, size = np.array(low, float), np.broadcast_to(np.array(size, float), 3)
    v = np.array([low + size * [n & 1, n >> 1 & 1, n >> 2 & 1] for n in range(8)])
    return v[np.array(FACES)]


def turned(tri, angle=0.4):
    c, s = np.cos(angle), np.sin(angle)
    return tri @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]).T @ np.array([[1, 0, 0], [0, c, -s], [0, s, c]]).T


def l_prism():
    """An L of unit squares, one high: volume 3, hull volume 3.5."""
    base = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]
    v = np.array([(*p, z) for z in (0, 1) for p in base], float)
    top = [[0, 1, 2], [0, 2, 3], [0, 3, 4], [0, 4, 5]]
    faces = [f[::-1] for f in top] + [[a + 6 for a in f] for f in top]
    for i in range(6):
        j = (i + 1) % 6
        faces += [[i, j, j + 6], [i, j + 6, i + 6]]
    return v, faces


def sphere(n=8, m=12, r=10.0, centre=(50, 50, 50)):
    pts = [(0, 0, r)] + [(r * np.sin(np.pi * i / n) * np.cos(2 * np.pi * j / m), r * np.sin(np.pi * i / n) * np.sin(2 * np.pi * j / m), r * np.cos(np.pi * i / n)) for i in range(1, n) for j in range(m)] + [(0, 0, -r)]
    at = lambda i, j: 1 + (i - 1) * m + j % m
    faces = [[0, at(1, j), at(1, j + 1)] for j in range(m)]
    for i in range(1, n - 1):
        for j in range(m):
            faces += [[at(i, j), at(i + 1, j), at(i + 1, j + 1)], [at(i, j), at(i + 1, j + 1), at(i, j + 1)]]
    faces += [[len(pts) - 1, at(n - 1, j + 1), at(n - 1, j)] for j in range(m)]
    return np.array(pts) + centre, faces


def test_measures():
    c = cube((1, 2, 3), 2)
    assert g.volume(c) == pytest.approx(8) and g.area(c) == pytest.approx(24)
    assert g.signed_volume(c) == pytest.approx(-g.signed_volume(c[:, ::-1]))
    assert g.mbb(c).tolist() == [1, 2, 3, 3, 4, 5]
    assert g.centroid(c) == pytest.approx([2, 3, 4])
    v, f = l_prism()
    assert g.volume(g.fan(v, f)) == pytest.approx(3) and g.hull_volume(v) == pytest.approx(3.5)
    assert g.hull_volume(turned(cube()).reshape(-1, 3)) == pytest.approx(1)
    assert g.hull_volume(np.zeros((5, 3))) == 0


def test_validity():
    assert g.why_invalid(8, FACES) is None
    assert g.why_invalid(8, FACES[:-1]) == "not closed"
    assert g.why_invalid(8, [[0, 1, 9]]) == "vertex out of range"
    assert g.why_invalid(16, FACES + [[a + 8 for a in f] for f in FACES]) == "several components"
    assert g.why_invalid(8, []) == "no faces"
    quads = [[0, 2, 3, 1], [4, 5, 7, 6], [0, 1, 5, 4], [2, 6, 7, 3], [0, 4, 6, 2], [1, 3, 7, 5]]
    assert g.why_invalid(8, quads) is None and g.why_invalid(8, quads, triangles_only=True) == "not a triangle mesh"


@pytest.mark.parametrize("turn", [lambda t: t, turned])
def test_relations(turn):
    a = turn(cube(size=2))
    at = lambda *low, size=2: turn(cube(low, size))
    face, corner, half, inner, far = at(2, 0, 0), at(2, 2, 2), at(1, 0, 0), at(0.5, 0.5, 0.5, size=1), at(5, 0, 0)
    for b, want in (
        (face, {"st_intersects", "st_touches", "st_adjacent"}), (corner, {"st_intersects", "st_touches"}), (half, {"st_intersects", "st_overlaps", "st_crosses"}),
        (inner, {"st_contains"}), (far, {"st_disjoint"}), (a, {"st_intersects", "st_equals", "st_contains", "st_within"}),
    ):
        names = ("st_intersects", "st_touches", "st_adjacent", "st_overlaps", "st_crosses", "st_contains", "st_within", "st_disjoint", "st_equals")
        assert {n for n in names if g.holds(n, a, b)} == want
    assert g.holds("st_within", inner, a) and g.holds("st_intersects", a, inner, solid=True)
    assert g.holds("st_dwithin", a, far, 3) and not g.holds("st_dwithin", a, far, 2.9)
    with pytest.raises(ValueError):
        g.holds("st_nothing", a, face)


def test_intersection_volumes():
    assert g.intersection_volume(cube(size=2), cube((1, 1, 1), 2)) == pytest.approx(1)
    a, b = turned(cube(size=2)), turned(cube((1, 1, 1), 2))
    assert g.intersection_volume(a, b) == pytest.approx(1, rel=1e-6)
    l_shape = g.fan(*l_prism())
    assert g.intersection_volume(l_shape, cube((0.5, 0.5, 0), (1, 1, 1))) == pytest.approx(0.75, rel=1e-6)
    moved = l_shape + [0.5, 0, 0]
    assert g.intersection_volume(l_shape, moved) == pytest.approx(2.0, rel=1e-6)


def test_distances():
    tri = cube(size=2)
    assert g.point_surface(np.array([1.0, 1, 1]), tri) == pytest.approx(1)
    assert g.point_surface(np.array([5.0, 1, 1]), tri) == pytest.approx(3)
    assert g.point_surface(np.array([5.0, 6, 1]), tri) == pytest.approx(5)
    assert g.surface_distance(turned(tri), turned(cube((4, 5, 0), 2))) == pytest.approx(np.hypot(2, 3))
    assert g.solid_distance(turned(tri), turned(cube((0.5, 0.5, 0.5), 1))) == 0
    assert g.inside(np.array([[1.0, 1, 1], [3, 1, 1]]), tri[:, ::-1]).tolist() == [True, False]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=6, max_size=6), st.integers(1, 4), st.integers(1, 4), st.booleans())
def test_intersects_agrees_with_boxes(low, wa, wb, turn):
    a, b = np.array(low[:3], float), np.array(low[3:], float)
    meet = bool(((a <= b + wb) & (b <= a + wa)).all())
    strict = bool(((a < b) & (b + wb < a + wa)).all() or ((b < a) & (a + wa < b + wb)).all())
    f = turned if turn else (lambda t: t)
    x, y = f(cube(a, wa)), f(cube(b, wb))
    assert g.surfaces_meet(x, y) == (meet and not strict) == g.surfaces_meet(y, x)
    assert g.surfaces_meet_many([(x, y), (y, x)]).tolist() == [meet and not strict] * 2


def test_off_text():
    v, f = l_prism()
    line = meshes.to_off(v, f)
    got = meshes.parse_off(line + "\r")
    assert (got[0] == v).all() and got[1] == f and meshes.to_off(*got) == line
    for bad in (None, "", "OFF", "OFF|3 1 0|0 0 0|1 0 0|0 1 0|3 0 1 7|", "OFF|2 1 0|0 0|", "PLY|1 0 0|", line.replace("12 20", "12 21")):
        assert meshes.parse_off(bad) is None


def test_codec():
    v, f = sphere()
    blob = codec.encode(v, f)
    assert len(blob) < len(meshes.to_off(v, f)) / 2 and codec.steps_of(blob) > 40
    got_v, got_f = codec.decode(blob)
    want = codec.dequantize(*codec.quantize(v))
    key = lambda p, t: sorted(tuple(sorted(map(tuple, p[x].tolist()))) for x in t)
    assert key(got_v, got_f) == key(want, f)
    sizes = []
    for lod in (0, 10, 50, 90, 100):
        dv, df = codec.decode(blob, lod)
        assert g.why_invalid(len(dv), df) is None
        sizes.append(len(dv))
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]
    tetra = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]]), [[0, 2, 1], [0, 1, 3], [0, 3, 2], [1, 2, 3]]
    small = codec.encode(*tetra)
    assert codec.steps_of(small) == 0 and len(codec.decode(small, 0)[1]) == 4
    with pytest.raises(ValueError):
        codec.decode(b"nothing")


def test_skeleton_follows_a_long_box():
    v = np.array([[x, y, z] for x in np.linspace(0, 20, 21) for y, z in ((0, 0), (0, 1), (1, 1), (1, 0))], float)
    faces = [[4 * i + a, 4 * i + (a + 1) % 4, 4 * (i + 1) + (a + 1) % 4, 4 * (i + 1) + a] for i in range(20) for a in range(4)] + [[0, 1, 2, 3], [83, 82, 81, 80]]
    s = skeleton(v, faces)
    assert 4 <= len(s) <= 8 and (np.abs(s[:, 1:] - 0.5) < 0.3).all() and np.ptp(s[:, 0]) > 10


def test_skeleton_follows_branches():
    """A T of unit cells: points near its three ends, all inside or close to it; the same for two parts at once."""
    cells = {(x, 0, 0) for x in range(31)} | {(15, y, 0) for y in range(1, 16)}
    cells |= {(x, 0, 9) for x in range(31)}
    number, faces = {}, []
    for c in sorted(cells):
        for k in range(3):
            for side in (0, 1):
                if tuple(v + (2 * side - 1) * (i == k) for i, v in enumerate(c)) in cells:
                    continue
                ring = [[0, 0, 0] for _ in range(4)]
                for corner, (u, w) in zip(ring, ((0, 0), (1, 0), (1, 1), (0, 1)), strict=True):
                    corner[k], corner[(k + 1) % 3], corner[(k + 2) % 3] = side, u, w
                faces.append([number.setdefault(tuple(np.add(c, p).tolist()), len(number)) for p in ring])
    s = skeleton(np.array(list(number), float), faces)
    gap = lambda points, to: np.sqrt(((points[:, None] - to[None]) ** 2).sum(axis=2)).min(axis=1)
    assert (gap(s, np.array(sorted(cells)) + 0.5) < 1.5).all() and len(s) > 20
    assert (gap(np.array([[0, 0, 0], [30, 0, 0], [15, 15, 0], [0, 0, 9], [30, 0, 9]]) + 0.5, s) < 2.5).all()


def test_frames_of_bent_and_empty_faces():
    v = np.array([[0, 0, 0], [4, 0, 0], [4, 4, 0], [1, 1, 0], [9, 9, 9]], float)  # a dart: non-convex
    normal, middle = frames.polygon_frames(v, [[0, 1, 2, 3], [0, 2, 1], [0, 0, 1]])
    assert normal.tolist() == [[0, 0, 1], [0, 0, -1], [0, 0, 0]] and middle[0].tolist() == [2.25, 1.25, 0]
    assert frames.vertex_normals(v, [[0, 1, 2, 3]])[4].tolist() == [0, 0, 0] and frames.vertex_normals(v, []).shape == (5, 3)
    assert len(frames.polygon_frames(v, [])[0]) == 0


def test_skeletons_together_as_one_by_one(monkeypatch):
    """meshes of the same faces take no path search each (900,000 cubes took 171 s); the points are the same to the last bit."""
    rng, meshes = np.random.default_rng(4), []
    long = [[i + k, i + (k + 1) % 4, i + 4 + (k + 1) % 4, i + 4 + k] for i in range(0, 40, 4) for k in range(4)]
    apart = [[0, 1, 2], [2, 1, 3], [4, 5, 6], [4, 4, 6]]
    for faces, n in ((long, 44), (apart, 8), (np.array([[0, 2, 3], [0, 3, 1], [4, 5, 7]]), 8)):
        for _ in range(7):
            v = rng.random((n, 3)) + (np.arange(n) // 4)[:, None]
            meshes += [(v, faces), (np.zeros((n, 3)), faces)]
    odd = meshes[0][0].copy()
    odd[3] = np.nan
    meshes += [None, (odd, long), (np.empty((0, 3)), []), (np.empty((0, 3)), [])]
    lists = lambda f: f.tolist() if isinstance(f, np.ndarray) else f
    want = [None if x is None else skeleton(x[0], lists(x[1])) for x in meshes]
    seen, own = [], sk._distances
    monkeypatch.setattr(sk, "_distances", lambda *x: seen.append(1) or own(*x))
    for sweep in (sk.SWEEP, 100):
        monkeypatch.setattr(sk, "SWEEP", sweep)
        got = sk.skeletons(meshes)
        assert all((w is None and x is None) or np.array_equal(w, x, equal_nan=True) for w, x in zip(want, got, strict=True))
    assert len(want[0]) > 2 and len(seen) == 4  # of the mesh with a number that is none
