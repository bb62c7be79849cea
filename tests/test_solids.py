"""Sweeps over many pairs against the tests of single pairs; plans that leave large sides out of the driver."""

import numpy as np
import pyarrow as pa
import pytest

from voxelmill import catalog
from voxelmill.functions import geometry as g
from voxelmill.functions import meshes
from voxelmill.functions import solids as S
from voxelmill.operators import cells, nn
from voxelmill.operators import join as J
from voxelmill.schema import MBB

SF = "/root/testdata/sf0.001"
CUBE = np.array(catalog._CUBE, np.int32)
TETRAHEDRON = np.array([[0, 2, 1], [0, 1, 3], [0, 3, 2], [1, 2, 3]], np.int32)


def pack(v, faces):
    return np.int32(len(v)).tobytes() + np.asarray(v, float).tobytes() + faces.astype(np.int32).tobytes()


def solids(kind, n, seed):
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        low, edge = rng.integers(0, 12, 3).astype(float), int(rng.integers(1, 9))
        v = np.array([[low[c] + (edge if m >> c & 1 else 0) for c in range(3)] for m in range(8)])
        if kind == "turned" or kind == "mixed" and k % 4 == 1:
            v = np.stack([3 * v[:, 0] - 4 * v[:, 1], 4 * v[:, 0] + 3 * v[:, 1], 5 * v[:, 2]], axis=1)
        faces = CUBE
        if kind == "mixed" and k % 4 == 2:
            v, faces = rng.integers(0, 14, (4, 3)).astype(float), TETRAHEDRON
        if kind == "mixed" and k % 4 == 3:
            faces = CUBE[:-1]  # open: neither a box nor convex for the sweeps
        out.append(pack(v, faces))
    return S.Solids(pa.array([*out, None], pa.binary()))


@pytest.mark.parametrize("kind", ["box", "turned", "mixed"])
def test_pairs_as_one_by_one(kind):
    a, b = solids(kind, 30, 1), solids(kind, 30, 2)
    assert not a.usable[30] and a.usable[:30].all()
    assert a.is_box[:30].sum() == {"box": 30, "turned": 0, "mixed": 8}[kind]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(30), np.arange(30), indexing="ij"))
    pairs = S._meshes(a, b, i, j)
    meets = g.surfaces_meet_many(pairs)
    for name in ("st_intersects", "st_touches", "st_adjacent", "st_contains", "st_within", "st_equals", "st_overlaps"):
        want = [g.holds(name, *p, meets=bool(m)) for p, m in zip(pairs, meets, strict=True)]
        assert S.holds(name, a, b, i, j).tolist() == want, name
    reach = 2.0 if kind == "box" else 7.5
    assert S.holds("st_dwithin", a, b, i, j, distance=reach).tolist() == g.within(pairs, reach).tolist()
    assert np.allclose(S.distances(a, b, i, j), g.solid_distances(pairs), atol=1e-9)


def test_turned_pairs_take_no_single_tests(monkeypatch):
    """Pairs of convex solids, however they are turned, are all decided in sweeps (one by one, 100,000 take minutes)."""
    a, b = solids("turned", 40, 3), solids("turned", 40, 4)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(40), np.arange(40), indexing="ij"))

    def never(*_, **__):
        raise AssertionError("a pair by itself")

    for name in ("holds", "relation", "within", "solid_distances", "surfaces_meet_many"):
        monkeypatch.setattr(g, name, never)
    assert S.holds("st_adjacent", a, b, i, j).any() and S.holds("st_dwithin", a, b, i, j, distance=50.0).any()


def test_turned_boxes_in_reach_are_measured_in_their_own_frame(monkeypatch):
    """boxes that are turned alike are apart by what their boxes in that frame are; by separating axes, pairs took 50 times as long
    and 60 copies of sf0.1 hours. Distances of exactly the limit among them."""
    a, b = solids("turned", 200, 8), solids("turned", 200, 9)
    i, j = (x.ravel() for x in np.meshgrid(np.arange(200), np.arange(200), indexing="ij"))
    frame = np.array([[3, 4, 0], [-4, 3, 0], [0, 0, 5]]) / 5

    def own(s):
        p = np.stack([s.tri(k).reshape(-1, 3) for k in range(200)]) @ frame.T
        return np.round(np.concatenate([p.min(axis=1), p.max(axis=1)], axis=1), 9)

    gap = np.sqrt(S.gaps2(own(a), own(b), i, j))
    monkeypatch.setattr(S, "_convex_relations", lambda *_: pytest.fail("separating axes"))
    for reach in (5.0, 15.0, 25.0):
        assert (gap == reach).any() and (S.holds("st_dwithin", a, b, i, j, distance=reach) == (gap <= reach)).all()


def test_bricks_among_other_solids():
    """Several frames, boxes, slanted and dented bricks, tetrahedra, meshes turned inside out: as one by one."""
    rng, rows = np.random.default_rng(10), []
    turns = [np.linalg.qr(rng.normal(size=(3, 3)))[0] for _ in range(3)]
    for k in range(120):
        v = np.array([[m >> c & 1 for c in range(3)] for m in range(8)]) * rng.integers(1, 6, 3) + rng.integers(0, 25, 3) + 0.0
        faces = CUBE if k % 2 else CUBE[:, ::-1]
        if k % 8 == 3:
            v = v @ np.array([[1, 0.3, 0], [0, 1, 0], [0, 0, 1]])
        elif k % 8 == 4:  # corners of a brick, but a diagonal is bent inwards
            faces = np.array([[0, 2, 3], [0, 3, 1], [0, 1, 5], [0, 5, 4], [0, 4, 6], [0, 6, 2], [3, 2, 6], [1, 3, 5], [4, 5, 6], [3, 6, 5]], np.int32)
            v = v[:7]
        elif k % 8 == 5:
            v, faces = rng.integers(0, 25, (4, 3)) + 0.0, TETRAHEDRON
        rows.append(pack(v @ turns[k % 3] if k % 8 else v, np.ascontiguousarray(faces)))
    a, b = (S.Solids(pa.array([*part, None], pa.binary())) for part in (rows[:60], rows[60:]))
    (fa, _), (fb, _), off = a.bricks(b)
    assert all((f[:60][np.isin((np.arange(60) + first) % 8, (0, 3, 4, 5))] == -1).all() and len(set(f.tolist())) == 4 for f, first in ((fa, 0), (fb, 60))) and 0 < off < 1e-11
    i, j = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60), indexing="ij"))
    pairs, exact = S._meshes(a, b, i, j), S.distances(a, b, i, j)
    for reach in (1.0, 4.0, float(exact[(fa[i] == fb[j]) & (fa[i] >= 0) & (exact > 3)][0])):
        assert S.holds("st_dwithin", a, b, i, j, distance=reach).tolist() == g.within(pairs, reach).tolist()


def test_meshes_alike_are_packed_at_once(monkeypatch):
    """F1: 10,000 cubes took 0.38 s one by one and take 0.014 s at once. The bytes are those of single meshes; others than whole
    meshes of one shape are packed one by one."""
    rng = np.random.default_rng(11)

    def mesh(n, faces, base=0):
        return {"vertices": [dict(zip("xyz", p, strict=True)) for p in rng.normal(size=(n, 3)).tolist()], "faces": [[base + c for c in f] for f in faces]}

    cubes = [mesh(8, CUBE.tolist()) for _ in range(20)]
    others = ([*cubes, None], [*cubes, mesh(4, TETRAHEDRON.tolist())], [*cubes, mesh(8, CUBE.tolist(), 1)], [mesh(4, [[0, 1, 2, 3]])], [{"vertices": [], "faces": []}], [{"vertices": None, "faces": [[0, 1, 2]]}], [])
    columns = [pa.array(rows, meshes.MESH) for rows in (cubes, *others)]
    packed = [meshes.pack(c) for c in (columns[0][3:], *columns)]
    assert packed[0].equals(packed[1][3:]) and meshes._pack_alike(columns[0].field("vertices"), columns[0].field("faces")) is not None
    monkeypatch.setattr(meshes, "_pack_alike", lambda *_: None)
    assert all(p.equals(meshes.pack(c)) for p, c in zip(packed[1:], columns, strict=True))


def test_meeting_boxes():
    rng = np.random.default_rng(5)
    a, b = (np.concatenate([low := rng.integers(0, 30, (300, 3)).astype(float), low + rng.integers(0, 9, (300, 3))], axis=1) for _ in range(2))
    want = ((a[:, None, :3] <= b[None, :, 3:]) & (b[None, :, :3] <= a[:, None, 3:])).all(axis=2)
    got = np.zeros_like(want)
    for i, j in S.meeting(a, b, most=1000):
        assert not got[i, j].any()
        got[i, j] = True
    assert (got == want).all()


def test_boxes_that_hold_others():
    rng = np.random.default_rng(6)
    a, b = (np.concatenate([low := rng.integers(0, 20, (300, 3)).astype(float), low + rng.integers(0, n, (300, 3))], axis=1) for n in (15, 6))
    want = ((a[:, None, :3] <= b[None, :, :3]) & (b[None, :, 3:] <= a[:, None, 3:])).all(axis=2)
    for sweep, x, y in ((S.holding, a, b), (S.held, b, a)):
        got = np.zeros_like(want)
        for i, j in sweep(x, y, most=1000):
            assert not (got if sweep is S.holding else got.T)[i, j].any()
            (got if sweep is S.holding else got.T)[i, j] = True
        assert (got == want).all() and want.any()


def test_held_solids_go_to_one_cell(spark, monkeypatch):
    """a solid that lies in another has all its pairs in the cell of its low corner; in every cell it touches, 60 copies of
    sf0.1 took more than 196 s."""
    sides, own = {}, cells.cell_by_cell
    monkeypatch.setattr(cells, "cell_by_cell", lambda left, right, f, schema: sides.update(left=left.count(), right=right.count()) or own(left, right, f, schema))
    many = [catalog.boxes(spark, "/root/testdata/sf0.01", n).count() for n in (1, 2)]
    catalog.QUERIES["turned_contains"](spark, "/root/testdata/sf0.01")
    assert sides["right"] == many[1] and sides["left"] > many[0]


def test_solids_of_one_form_share_directions(monkeypatch):
    """directions are found once for solids that differ in place alone."""
    v = np.array([[3.0 * (m & 1) - 4 * (m >> 1 & 1), 4.0 * (m & 1) + 3 * (m >> 1 & 1), 5.0 * (m >> 2)] for m in range(8)])
    rows = [pack(v * (1 + k % 2) + k, CUBE) for k in range(50)]
    seen, own = [], S._distinct
    monkeypatch.setattr(S, "_distinct", lambda d, keep: seen.append(len(d)) or own(d, keep))
    assert S.Solids(pa.array(rows, pa.binary())).convex.all() and seen == [2, 2]


@pytest.mark.parametrize("name", ["turned_adjacent", "tiled_dwithin"])
def test_heavy_cells_are_dealt_out(spark, monkeypatch, name):
    want = sorted(map(tuple, catalog.QUERIES[name](spark, "/root/testdata/sf0.01").collect()))
    monkeypatch.setattr(cells, "ROWS", 50)
    for heavy in (10_000, 0):  # their table broadcast, and not
        monkeypatch.setattr(cells, "HEAVY", heavy)
        assert sorted(map(tuple, catalog.QUERIES[name](spark, "/root/testdata/sf0.01").collect())) == want
    assert want


#: Joins of which no side may go through the driver, as it grows with the input.
JOINS = ["st_intersects", "st_intersects_solid", "st_intersects_volumes", "st_touches", "st_crosses", "st_contains", "st_within", "st_overlaps", "st_adjacent", "st_equals", "st_dwithin", "disjoint_counts", "turned_contains", "turned_adjacent", "turned_dwithin", "mbb_join", "pairs_per_tile"]
NEAREST = ["nn_surface", "nn_tile_candidates", "nn_voronoi", "nn_candidates_k2", "nn_sites", "knn_boxes", "st_nearest", "st_nearest2"]


@pytest.mark.parametrize("name", JOINS + NEAREST)
def test_no_side_is_broadcast(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("rows", [2048, 50])
def test_cells_are_dealt_out_once(spark, monkeypatch, rows):
    """Each side meets in its own exchange by number. Constant blocks took a second one, which adaptive execution merged into few
    large tasks (2,605 MB of an executor over 60 copies of sf0.1)."""
    monkeypatch.setattr(cells, "ROWS", rows)
    plan = catalog.QUERIES["st_within"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cell") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_small_files_are_dealt_out(spark):
    """Rows of one file become meshes in more than one task."""
    assert catalog.boxes(spark, SF, 1).rdd.getNumPartitions() == 1
    assert catalog.solids(spark, SF, 1).rdd.getNumPartitions() > 1


def test_boxes_over_each_other_bound_small_radii(spark):
    """radii come from cells finer than the boxes; over cells of the mean box each query met hundreds of boxes."""
    side = np.arange(12) * 8.0
    low = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    rows = lambda v: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(v)], ["object_id", *MBB])
    boxes, points = rows(np.concatenate([low, low + 40], axis=1)), rows(np.repeat(low[::7] + 20, 2, axis=0).reshape(-1, 6))
    left, _, _ = nn._cut(points, boxes, 2, True, None, None)
    assert left.agg({"radius": "avg"}).first()[0] < 1
    got = {tuple(r) for r in nn.box_neighbours(points, boxes, 2).select("id1", "id2").collect()}
    p, at = low[::7] + 20, np.arange(len(low[::7]))
    gap = (np.maximum(np.maximum(low[None] - p[:, None], p[:, None] - low[None] - 40), 0) ** 2).sum(axis=2)
    assert got == {(int(i), int(j)) for i in at for j in np.flatnonzero(gap[i] <= np.sort(gap[i])[1])}


def test_disjoint_pairs_are_counted_in_cells(spark, monkeypatch):
    """F8: cells give counts of objects; pairs, 359,666,478 over 60 copies of sf0.1, do not leave them. Also in dealt-out cells."""
    want = sorted(map(tuple, catalog.QUERIES["disjoint_counts"](spark, SF).collect()))
    monkeypatch.setattr(cells, "ROWS", 20)
    got = catalog.QUERIES["disjoint_counts"](spark, SF)
    line = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "FlatMapCoGroupsInArrow" in x)
    assert line.rstrip().endswith("L]") and ", n#" in line
    pairs = J.spatial_join(catalog.solids(spark, SF, 1), catalog.solids(spark, SF, 2), solid=True).groupBy("id1").count()
    met, n = {r[0]: r[1] for r in pairs.collect()}, catalog.boxes(spark, SF, 2).count()
    assert sorted(map(tuple, got.collect())) == want and want and all(m == n - met.get(k, 0) for k, m in want)
