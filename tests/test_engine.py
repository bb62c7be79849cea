"""DataFrame operators: against the SQL of the catalog, on small hand-made tables, and the verbs end to end."""

import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxelmill import catalog
from voxelmill.functions import codec, meshes, udfs
from voxelmill.functions import geometry as g
from voxelmill.functions.tokens import tokens
from voxelmill.operators import join as J
from voxelmill.operators import nn as N
from voxelmill.operators import partition as P
from voxelmill.operators import tiling as T
from voxelmill.plans.engine import SpatialEngine
from voxelmill.schema import HIGH, LOW, MBB, PREDICATES
from voxelmill.sources import off
from voxelmill.streaming.assign import assign_stream, join_static

SF = "/root/testdata/sf0.001"
BOXES = "object_id long, " + ", ".join(f"{c} double" for c in MBB)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in ("part", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = sql.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(want.columns) == cols
    key = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    have = got.toPandas()
    for c in cols:
        if have[c].dtype != want[c].dtype and have[c].dtype.kind in "if":
            want[c] = want[c].astype(have[c].dtype)
    assert key(have) == key(want)


def test_every_name_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_predicates_are_symmetric(spark):
    a, b = (catalog.solids(spark, SF, n) for n in (1, 2))
    pairs = lambda df: {(r.id1, r.id2) for r in df.collect()}
    assert pairs(J.spatial_join(a, b, "st_contains")) == {(y, x) for x, y in pairs(J.spatial_join(b, a, "st_within"))}
    for shape in ((1, 1, 1), (3, 5, 2), (16, 16, 16)):
        grid = P.Grid.of(P.space_extent(a.select(*MBB).unionByName(b.select(*MBB))).first(), shape=shape)
        assert J.candidates(a, b, grid).count() == 10
    few, other = a.where("object_id <= 3"), b.where("object_id <= 4")
    meet = J.spatial_join(few, other, "st_intersects", solid=True).count()
    assert J.spatial_join(few, other, "st_disjoint").count() == few.count() * other.count() - meet
    with pytest.raises(ValueError):
        J.spatial_join(a, b, "st_dwithin")


def test_boxes_outside_the_grid_and_nulls(spark):
    rows = spark.createDataFrame([(1, -9.0, 0.0, 0.0, -8.0, 1.0, 1.0), (2, 4.0, 0.0, 0.0, 5.0, 1.0, 1.0), (3, None, 0.0, 0.0, 5.0, 1.0, 1.0)], BOXES)
    grid = P.Grid([0.0] * 3, [10.0] * 3, (2, 1, 1))
    got = {(r.object_id, r.cell) for r in T.assign_grid(rows.where("low_x is not null"), grid).collect()}
    assert got == {(1, 0), (2, 0), (2, 1)}  # 5.0 is the edge of both cells
    assert P.space_extent(rows).first()["n"] == 2
    assert J.candidates(rows, rows).count() == 2
    empty = rows.limit(0)
    assert J.candidates(empty, rows).count() == 0 and N.knn_boxes(rows, empty).count() == 0 and P.octree_tiles(empty, 5).count() == 0


def test_nearest_rejects_k(spark):
    rows = catalog.boxes(spark, SF, 1).limit(5)
    with pytest.raises(ValueError):
        N.knn_boxes(rows, rows, 0).count()
    got = N.knn_boxes(rows, rows, 9)
    assert got.count() == 25  # fewer boxes than k: all of them


def test_partition_arithmetic(spark):
    assert P.bucket_size(16_000_000, 10) == 10 and P.bucket_size(1e12, 10) == 1 and P.bucket_size(0, 0) == 1 and P.bucket_size(32_000_000, 100, 0.5) == 25
    assert P.grid_shape([10, 10, 10], 1000, 10) == (5, 5, 4) and P.grid_shape([1, 1, 1], 5, 10) == (1, 1, 1)
    with pytest.raises(ValueError):
        P.sample(spark.range(3), 0)
    assert P.sample(spark.range(1000), 0.5).count() < 1000
    rows = catalog.boxes(spark, SF, 1)
    ext = P.space_extent(rows).first()
    back = P.normalize(P.normalize(rows, ext), ext, back=True)
    assert back.join(rows.select("object_id", *(rows[c].alias(f"o_{c}") for c in MBB)), "object_id").where(" or ".join(f"abs({c} - o_{c}) > 1e-6" for c in MBB)).count() == 0


def test_large_tile_tables_need_no_broadcast(spark):
    rows, tiles = catalog.boxes(spark, SF, 1), catalog._grid(spark, SF).tiles(spark)
    key = lambda df: sorted((r.object_id, r.tile_id) for r in df.collect())
    assert key(T.assign_tiles(rows, tiles)) == key(T.assign_tiles(rows, tiles, max_broadcast=0))


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.off").write_text("OFF|3 1 0|0 0 0|1 0 0|0 1 0|3 0 1 2|\r\n\nbroken\nOFF|3 1 0|0 0 0|2 0 0|0 1 0|3 0 1 2|")
    lines = off.read_off_lines(spark, str(tmp_path / "a.off"))
    got = off.with_meshes(lines).collect()
    assert len(got) == 3 and [r.high_x for r in sorted(got, key=lambda r: r.object_id)] == [1, None, 2]
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "m.off").write_text("OFF\n3 1 0\n0 0 0\n1 0 0\n0 1 0\n3 0 1 2\n")
    assert off.read_off_files(spark, str(tmp_path / "one")).withColumn("mesh", udfs.parse_off("line")).first().mesh is not None
    out = str(tmp_path / "out")
    off.write_off(off.with_meshes(lines), out)
    assert spark.read.text(out).count() == 2
    off.write_boxes(catalog.boxes(spark, SF, 1), str(tmp_path / "boxes"))
    extra = tmp_path / "boxes" / "part-x.csv"
    extra.write_text("too\tfew\nm\t1\t1\tx\t0\t0\t1\t1\t1\t0\t9\n")
    assert off.read_boxes(spark, str(tmp_path / "boxes")).count() == 200


def test_sql_functions(spark):
    names = udfs.register(spark)
    assert "st3d_volume" in names
    catalog.solids(spark, SF, 1).createOrReplaceTempView("solids")
    row = spark.sql("select max(abs(st3d_volume(mesh) - power(high_x - low_x, 3))) as d, min(st3d_is_valid(mesh).valid) as v from solids").first()
    assert row.d < 1e-6 and row.v


def test_verbs(spark, tmp_path):
    for n, name in ((1, "a"), (2, "b")):
        catalog.off_lines(spark, SF, n).select("line").coalesce(1).write.text(str(tmp_path / name))
    (tmp_path / "a" / "part-broken.txt").write_text("OFF|3 1 0|0 0 0|1 0 0|0 1 0|3 0 1 2|\n")
    e = SpatialEngine(spark, str(tmp_path / "out"))
    paths = str(tmp_path / "a"), str(tmp_path / "b")
    assert e.compress(*paths).count() == 350
    assert [r.reason for r in e.quarantine(*paths).collect()] == ["not closed"]
    assert e.partition("fg_3d", bucket=50).count() == 8 and e.partition("ot_3d", bucket=200).count() >= 8
    assert e.counters["_mbb"] == {"read": 351, "kept": 350, "bad": 1, "rows": 350}
    assert e.tile_statistics().first()["tiles"] >= 8
    e.partition("ot_3d", bucket=20, sampling=0.5)
    assert 0 < e.counters["_partidx"]["sampled"] < 350 == e.counters["_partidx"]["read"]
    # 12-bit cells move corners by less than a hundredth: pairs that barely touch may part
    assert abs(e.join("st_intersects").count() - 10) <= 1
    assert e.join("st_nn_rtree").count() == 200 and e.join("st_nn_voronoi").count() == 200 and e.join("st_nearest2", k=2).count() == 400
    for bad in (lambda: e.join("st_unknown"), lambda: e.partition("other"), lambda: e.compress(paths[0], None), lambda: e.objects(0)):
        with pytest.raises(ValueError):
            bad()
    assert len(PREDICATES) == 14


def test_joins_over_tiles(spark):
    a, b = (catalog.boxes(spark, SF, n) for n in (1, 2))
    pairs = lambda df: sorted((r.id1, r.id2) for r in df.collect())
    want = pairs(J.candidates(a, b, expand=30.0))
    tables = [P.octree_tiles(a.where("low_x < 300"), 5, max_level=3), catalog._grid(spark, SF).tiles(spark), P.Grid([200.0] * 3, [210.0] * 3, (4, 4, 4)).tiles(spark)]
    for tiles in (*tables, tables[0].limit(0)):
        assert pairs(J.tile_candidates(a, b, tiles, expand=30.0)) == want and len(want) > 10


def test_only_objects_in_pairs_are_decoded(spark):
    late = lambda n: catalog.solids(spark, SF, n).withColumn("blob", udfs.encode("mesh")).drop("mesh").withColumn("lod", F.lit(100.0))
    got = J.spatial_join(late(1), late(2), "st_intersects")
    assert abs(got.count() - 10) <= 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("decode(") < plan.index("LeftSemi")


def test_tile_text_and_triangles(spark, tmp_path):
    tiles = catalog._grid(spark, SF).tiles(spark)
    off.write_tiles(tiles, str(tmp_path / "tiles"))
    (tmp_path / "tiles" / "part-x.txt").write_text("few 1 2\n9 a 0 0 1 1 1\n")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(off.read_tiles(spark, str(tmp_path / "tiles"))) == key(tiles)
    udfs.register(spark)
    catalog.solids(spark, SF, 1).createOrReplaceTempView("solids")
    rows = spark.sql("select object_id, count(*) as n, max(number) as last, max(t.high_x) - max(s.high_x) as d from solids s, lateral st3d_each_triangle(s.mesh) t group by object_id")
    assert {(r.n, r.last, r.d) for r in rows.collect()} == {(12, 11, 0.0)} and rows.count() == 200


def test_tokens(spark):
    cases = {"a b": ["a", "b"], "a  b ": ["a", "", "b", ""], "": [], " ": ["", ""], "'x y' z": ["x y", "z"], 'p"q;r"s,\'open "t ': ["pq;rs", 'open "t '], "''": [], "x,''": ["x"], "x,'',": ["x", "", ""], None: None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    for keep in (True, False):
        got = {r.t: r.x for r in rows.select("t", tokens("t", keep_blank=keep).alias("x")).collect()}
        want = {k: v if v is None or keep else [x for x in v if x] for k, v in cases.items()}
        assert got == want
    assert rows.select(tokens("t", "|", quotes="").alias("x")).where("t = 'a b'").first().x == ["a b"]


def test_streams(spark, tmp_path):
    rows = catalog.boxes(spark, SF, 1)
    rows.write.parquet(str(tmp_path / "in"))
    grid = catalog._grid(spark, SF)
    arriving = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, want in (("cells", assign_stream(arriving, grid), T.assign_grid(rows, grid).count()), ("pairs", join_static(arriving, catalog.boxes(spark, SF, 2), grid), 10)):
        q = df.writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(name).count() == want


def ball(rounds: int = 2):
    """A closed irregular mesh: an icosahedron split and pushed in and out by waves."""
    t = (1 + 5**0.5) / 2
    v = [tuple(x) for x in np.array([[-1, t, 0], [1, t, 0], [-1, -t, 0], [1, -t, 0], [0, -1, t], [0, 1, t], [0, -1, -t], [0, 1, -t], [t, 0, -1], [t, 0, 1], [-t, 0, -1], [-t, 0, 1]])]
    f = [(0, 11, 5), (0, 5, 1), (0, 1, 7), (0, 7, 10), (0, 10, 11), (1, 5, 9), (5, 11, 4), (11, 10, 2), (10, 7, 6), (7, 1, 8), (3, 9, 4), (3, 4, 2), (3, 2, 6), (3, 6, 8), (3, 8, 9), (4, 9, 5), (2, 4, 11), (6, 2, 10), (8, 6, 7), (9, 8, 1)]
    for _ in range(rounds):
        mid, split = {}, []
        for tri in f:
            m = []
            for i, j in zip(tri, tri[1:] + tri[:1]):
                key = (min(i, j), max(i, j))
                if key not in mid:
                    mid[key] = len(v)
                    v.append(tuple((np.array(v[i]) + v[j]) / 2))
                m.append(mid[key])
            split += [(tri[0], m[0], m[2]), (tri[1], m[1], m[0]), (tri[2], m[2], m[1]), tuple(m)]
        f = split
    p = np.array(v, float)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    return p * (20 + 2 * np.sin(5 * p[:, :1]) + 3 * np.cos(4 * p[:, 1:2] + p[:, 2:])), [list(x) for x in f]


def test_irregular_mesh_through_the_codec():
    v, f = ball()
    tri = g.fan(v, f)
    assert len(v) == 162 and len(f) == 320 and g.why_invalid(len(v), f) is None and g.volume(tri) > 10_000
    assert meshes.parse_off(meshes.to_off(v, f))[1] == f
    blob = codec.encode(v, f)
    got = {lod: codec.decode(blob, lod) for lod in (0, 25, 50, 75, 100)}
    counts = [len(x[0]) for x in got.values()]
    assert counts == sorted(counts) and counts[-1] == 162 and counts[0] < 110
    step = codec.quantize(v)[2]
    whole = g.fan(*got[100])
    assert abs(g.mbb(whole) - g.mbb(tri)).max() <= step and abs(g.volume(whole) - g.volume(tri)) <= step * g.area(tri)
    for x in got.values():
        assert g.why_invalid(len(x[0]), x[1]) is None


def test_distances_of_irregular_meshes():
    a = g.fan(*ball())
    for shift in ([60, 5, 3], [47, 0, 0], [30, 30, 30]):
        b = a[:, :, [1, 2, 0]] + np.array(shift, float)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij"))
        want = np.sqrt(g.triangle_gaps(a[i], b[j]).min())
        assert g.solid_distances([(a, b)])[0] == pytest.approx(want, rel=1e-12)
        assert g.within([(a, b), (a, a)], want + 1e-9).tolist() == [True, True] and not g.within([(a, b)], want - 1e-6)[0]
    assert g.solid_distances([(a, a / 4), (a, a + 5)]).tolist() == [0, 0]


def test_large_meshes_in_blocks(monkeypatch):
    a = g.fan(*ball())
    b = a[:, :, [2, 0, 1]] + np.array([25.0, 8, 0])
    far = a + np.array([70.0, 0, 0])
    want = set(zip(*(x.tolist() for x in g.box_pairs(a, b)), strict=True)), g.surface_gaps([(a, far)])[0]
    monkeypatch.setattr(g, "BLOCK", 3000)
    assert (set(zip(*(x.tolist() for x in g.box_pairs(a, b)), strict=True)), g.surface_gaps([(a, far)])[0]) == want and len(want[0]) > 50


def test_splits_that_part_nothing_are_undone(spark):
    same = spark.range(20).selectExpr("id as object_id", *(f"0D as {c}" for c in LOW), *(f"8D as {c}" for c in HIGH))
    assert [r.n for r in P.octree_tiles(same, bucket=5).collect()] == [20]
    spread = same.unionByName(spark.range(30).selectExpr("id + 50 as object_id", *(f"cast(id as double) / 4 as {c}" for c in LOW), *(f"id / 4 + 0.1D as {c}" for c in HIGH)))
    tiles = P.octree_tiles(spread, bucket=30, max_level=6).collect()
    assert 1 < len(tiles) < 600 and sum((r.high_x - r.low_x) * (r.high_y - r.low_y) * (r.high_z - r.low_z) for r in tiles) == pytest.approx(512)


def test_no_boxes(spark):
    none = catalog.boxes(spark, SF, 1).limit(0)
    ext = P.space_extent(none).first()
    assert P.Grid.of(ext, bucket=5).shape == (1, 1, 1) and P.normalize(none, ext).count() == 0 and P.octree_tiles(none, 5).count() == 0


def test_disjoint_pairs_are_the_rest(spark):
    a, b = catalog.solids(spark, SF, 1).limit(40), catalog.solids(spark, SF, 2)
    met = J.spatial_join(a, b, "st_intersects", solid=True).count()
    assert J.disjoint_pairs(a, b).distinct().count() == a.count() * b.count() - met


def test_layout():
    """Nothing outside the training-data part knows about it, except the driver entry."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(catalog.__file__)))
    for folder, dirs, files in os.walk(os.path.join(root, "voxelmill")):
        dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"\bllm\b", open(os.path.join(folder, f)).read()), f
