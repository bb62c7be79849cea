"""The queries of the spatial engine by name, and the SQL that must give the same rows.

The objects are axis-aligned cubes with integer corners: dataset 1 from ``part``, dataset 2 from ``customer``. They
are real meshes here (eight vertices, twelve triangles, read from OFF text where a query is about reading), and
closed formulas on boxes in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import udfs
from .functions.tokens import tokens
from .operators import join as J
from .operators import nn as N
from .operators import partition as P
from .operators import tiling as T
from .schema import HIGH, LOW, MBB
from .sources import off

_BOX = {
    1: ("part", "p_partkey", "(p_partkey * 7919) % 997", "(p_partkey * 104729) % 991", "(p_partkey * 1299709) % 983", "4 + p_size"),
    2: ("customer", "c_custkey", "(c_custkey * 6007) % 997", "(c_custkey * 15485863) % 991", "(c_custkey * 3571) % 983", "10 + 2 * c_nationkey"),
}
#: Triangles of a cube whose corner number has bits for high x, y, z; outward.
_CUBE = [[0, 2, 3], [0, 3, 1], [4, 5, 7], [4, 7, 6], [0, 1, 5], [0, 5, 4], [2, 6, 7], [2, 7, 3], [0, 4, 6], [0, 6, 2], [1, 3, 7], [1, 7, 5]]
GRID = (8, 8, 8)


def boxes(spark: SparkSession, sf_dir: str, dataset: int) -> DataFrame:
    table, key, x, y, z, w = _BOX[dataset]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{key} as object_id", f"{dataset} as dataset_id", *(f"cast({e} as double) as {c}" for e, c in zip((x, y, z), LOW, strict=True)), f"{w} as edge")
    return rows.select("object_id", "dataset_id", *LOW, *((F.col(lo) + F.col("edge")).alias(h) for lo, h in zip(LOW, HIGH, strict=True)))


def _dealt_out(rows: DataFrame) -> DataFrame:
    """Rows of few files dealt out by id while they are small: each becomes a mesh and then its copies in cells, some 30 times its
    bytes, which would all be made by the few tasks that read the files."""
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= 2 * least else rows.repartition(4 * least, "object_id")


def solids(spark: SparkSession, sf_dir: str, dataset: int) -> DataFrame:
    """Boxes with their meshes."""
    corner = lambda n: F.struct(*(F.col((HIGH if n >> k & 1 else LOW)[k]).alias("xyz"[k]) for k in range(3)))
    faces = F.array(*(F.array(*map(F.lit, f)) for f in _CUBE))  # a constant
    return _dealt_out(boxes(spark, sf_dir, dataset)).withColumn("mesh", F.struct(F.array(*(corner(n) for n in range(8))).alias("vertices"), faces.alias("faces")))


def turned(spark: SparkSession, sf_dir: str, dataset: int) -> DataFrame:
    """The solids turned about z by the angle of a 3-4-5 triangle and made five times as large: (3x - 4y, 4x + 3y, 5z).
    Corners stay integers and no face is parallel to x or y, so nothing is decided by boxes alone; distances grow
    fivefold, volumes 125-fold, and every relation stays what it was."""
    rows = solids(spark, sf_dir, dataset)
    low = ("3 * low_x - 4 * high_y", "4 * low_x + 3 * low_y", "5 * low_z")
    high = ("3 * high_x - 4 * low_y", "4 * high_x + 3 * high_y", "5 * high_z")
    mesh = "struct(transform(mesh.vertices, p -> struct(3 * p.x - 4 * p.y as x, 4 * p.x + 3 * p.y as y, 5 * p.z as z)) as vertices, mesh.faces as faces)"
    return rows.selectExpr("object_id", "dataset_id", *(f"{e} as {c}" for e, c in zip(low + high, MBB, strict=True)), f"{mesh} as mesh")


def off_lines(spark: SparkSession, sf_dir: str, dataset: int) -> DataFrame:
    """(object_id, dataset_id, line) as OFF text."""
    point = lambda n: F.concat_ws(" ", *(F.col((HIGH if n >> k & 1 else LOW)[k]).cast("long").cast("string") for k in range(3)))
    faces = "".join(f"3 {a} {b} {c}|" for a, b, c in _CUBE)
    return boxes(spark, sf_dir, dataset).select("object_id", "dataset_id", F.concat(F.lit("OFF|8 12 0|"), F.concat_ws("|", *(point(n) for n in range(8))), F.lit("|" + faces)).alias("line"))


def _both(spark, sf_dir, make=boxes) -> DataFrame:
    return make(spark, sf_dir, 1).unionByName(make(spark, sf_dir, 2))


def _grid(spark, sf_dir) -> P.Grid:
    return P.Grid.of(P.space_extent(_both(spark, sf_dir)).first(), shape=GRID)


# -- sources, scalar functions, aggregates ----------------------------------------------------------------------


def mbb_from_off(spark, sf_dir):
    return off.with_meshes(_both(spark, sf_dir, off_lines)).select("object_id", "dataset_id", *MBB)


def off_roundtrip(spark, sf_dir):
    rows = off_lines(spark, sf_dir, 1)
    return rows.select("object_id", (udfs.to_off(udfs.parse_off("line")) == F.col("line")).alias("same"))


def malformed_rows(spark, sf_dir):
    """Every seventh line is broken on purpose: the permissive reader tells good from bad."""
    lines = off_lines(spark, sf_dir, 1).withColumn("line", F.when(F.col("object_id") % 7 == 0, F.expr("replace(line, 'OFF|8', 'OFF|9')")).otherwise(F.col("line")))
    return off.with_meshes(lines).select("object_id", F.col("mesh").isNotNull().alias("readable"))


def mesh_valid(spark, sf_dir):
    """Every fifth mesh lacks its last face."""
    rows = solids(spark, sf_dir, 1).withColumn("mesh", F.when(F.col("object_id") % 5 == 0, F.struct("mesh.vertices", F.slice("mesh.faces", F.lit(1), F.lit(11)).alias("faces"))).otherwise(F.col("mesh")))
    return rows.withColumn("v", udfs.is_valid("mesh")).select("object_id", "v.valid", "v.reason")


def mesh_volume(spark, sf_dir):
    return _both(spark, sf_dir, solids).select("object_id", "dataset_id", F.round(udfs.volume("mesh"), 4).alias("volume"))


def hull_volume(spark, sf_dir):
    return solids(spark, sf_dir, 2).select("object_id", F.round(udfs.hull_volume("mesh"), 4).alias("volume"))


def mesh_area(spark, sf_dir):
    return _both(spark, sf_dir, solids).select("object_id", "dataset_id", F.round(udfs.area("mesh"), 4).alias("area"))


def mesh_perimeter(spark, sf_dir):
    return solids(spark, sf_dir, 1).select("object_id", F.round(udfs.perimeter("mesh"), 4).alias("perimeter"))


def mesh_centroid(spark, sf_dir):
    return solids(spark, sf_dir, 1).withColumn("c", udfs.centroid("mesh")).select("object_id", *(F.round(f"c.{x}", 4).alias(x) for x in "xyz"))


def face_frames(spark, sf_dir):
    """Per object: faces, area and the sum of normal x barycentre x area / 3, which is the volume."""
    rows = solids(spark, sf_dir, 1).withColumn("f", F.explode(udfs.face_frames("mesh")))
    dot = "f.normal.x * f.barycenter.x + f.normal.y * f.barycenter.y + f.normal.z * f.barycenter.z"
    return rows.groupBy("object_id").agg(F.count("*").alias("faces"), F.round(F.sum("f.area"), 4).alias("area"), F.round(F.sum(F.expr(f"({dot}) * f.area")) / 3, 3).alias("volume"))


def mbb_center(spark, sf_dir):
    return T.centers(boxes(spark, sf_dir, 1)).select("object_id", "cx", "cy", "cz")


def mbb_buffer(spark, sf_dir):
    return T.grow(boxes(spark, sf_dir, 2), 20.0).select("object_id", *MBB, F.col("own_low_x"))


def union_tagged(spark, sf_dir):
    return _both(spark, sf_dir).groupBy("dataset_id").agg(F.count("*").alias("n"))


def space_extent(spark, sf_dir):
    return P.space_extent(_both(spark, sf_dir))


def bucket_size(spark, sf_dir):
    return P.bucket_size_frame(_both(spark, sf_dir, off_lines).select(F.length("line").alias("bytes")), "bytes", 0.5, 100_000)


def prefix_offsets(spark, sf_dir):
    rows = off_lines(spark, sf_dir, 1).select("object_id", F.length("line").cast("long").alias("length"))
    return P.prefix_offsets(rows, "length", "object_id", span=512).select("object_id", "length", "offset")


def sample_hash(spark, sf_dir):
    return P.sample(boxes(spark, sf_dir, 1), 0.1, "object_id").select("object_id")


#: The faces of a cube as squares, in the order low z, high z, low y, high y, low x, high x; outward.
_SQUARES = [[0, 2, 3, 1], [4, 5, 7, 6], [0, 1, 5, 4], [2, 6, 7, 3], [0, 4, 6, 2], [1, 3, 7, 5]]


def _squares(spark, sf_dir):
    faces = F.array(*(F.array(*map(F.lit, f)) for f in _SQUARES))
    return solids(spark, sf_dir, 1).withColumn("mesh", F.struct("mesh.vertices", faces.alias("faces")))


def polygon_frames(spark, sf_dir):
    """Normals and barycentres of the square faces of cubes."""
    rows = _squares(spark, sf_dir).select("object_id", F.posexplode(udfs.polygon_frames("mesh")).alias("face", "f"))
    return rows.select("object_id", "face", *((F.round(f"f.{p}.{x}", 6) + F.lit(0.0)).alias(f"{p[0]}{x}") for p in ("normal", "barycenter") for x in "xyz"))


def vertex_normals(spark, sf_dir):
    rows = _squares(spark, sf_dir).select("object_id", F.posexplode(udfs.vertex_normals("mesh")).alias("vertex", "n"))
    return rows.select("object_id", "vertex", *(F.round(f"n.{x}", 6).alias(x) for x in "xyz"))


def mesh_triangles(spark, sf_dir):
    """Triangles of each mesh with their boxes, summed up."""
    rows = solids(spark, sf_dir, 1).select("object_id", F.inline(udfs.triangles("mesh")))
    return rows.groupBy("object_id").agg(F.count("*").alias("triangles"), *(F.min(c).alias(c) for c in LOW), *(F.max(c).alias(c) for c in HIGH), F.sum(F.expr("high_x - low_x")).alias("spans"))


def mbb_diagonal(spark, sf_dir):
    return T.diagonals(_both(spark, sf_dir)).select("object_id", "dataset_id", F.round("diagonal", 6).alias("diagonal"))


def split_quoted(spark, sf_dir):
    """Fields of a text with quotes, blanks and an open quote at its end."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("'"), "p_type", F.lit("' "), F.col("p_partkey").cast("string"), F.lit(";;x\"a, b\"c,\"it's "), "p_brand")
    return rows.select(F.col("p_partkey").alias("object_id"), F.posexplode(tokens(text, keep_blank=True)).alias("pos", "token"))


def split_tokens(spark, sf_dir):
    """Tokens of an OFF line and the sum of those that are numbers."""
    rows = off_lines(spark, sf_dir, 1).select("object_id", F.explode(F.split("line", "[| ]")).alias("t")).where("t <> ''")
    return rows.groupBy("object_id").agg(F.count("*").alias("tokens"), F.sum(F.expr("coalesce(try_cast(t as double), 0D)")).alias("total"))


# -- partitioning -----------------------------------------------------------------------------------------------


def grid_tiles(spark, sf_dir):
    return P.Grid.of(P.space_extent(_both(spark, sf_dir)).first(), bucket=50).tiles(spark)


def tile_assign(spark, sf_dir):
    return T.assign_grid(_both(spark, sf_dir), _grid(spark, sf_dir)).select(F.col("cell").cast("string").alias("tile_id"), "object_id", "dataset_id")


def tile_assign_table(spark, sf_dir):
    return T.assign_tiles(_both(spark, sf_dir), _grid(spark, sf_dir).tiles(spark)).select("tile_id", "object_id", "dataset_id")


def tile_stats(spark, sf_dir):
    grid = _grid(spark, sf_dir)
    assigned = T.assign_grid(_both(spark, sf_dir), grid).select(F.col("cell").cast("string").alias("tile_id"))
    s = P.tile_stats(grid.tiles(spark), assigned)
    return s.select("tiles", F.round("volume", 2).alias("volume"), F.round("mean", 6).alias("mean"), "least", "most", F.round("spread", 6).alias("spread"))


def pairs_per_tile(spark, sf_dir):
    return J.pairs_per_tile(boxes(spark, sf_dir, 1), boxes(spark, sf_dir, 2), _grid(spark, sf_dir))


def octree_tiles(spark, sf_dir):
    return P.octree_tiles(_both(spark, sf_dir), bucket=200, max_level=4)


def octree_assign(spark, sf_dir):
    """Objects in each octree tile, by the tile table; the same counts as the tree's own."""
    rows = _both(spark, sf_dir)
    tiles = P.octree_tiles(rows, bucket=200, max_level=4)
    return T.assign_tiles(rows, tiles).groupBy("tile_id").agg(F.count("*").alias("n"))


def nested_tiles(spark, sf_dir):
    return P.nested_tiles(_grid(spark, sf_dir).tiles(spark))


def normalized_boxes(spark, sf_dir):
    rows = _both(spark, sf_dir)
    return P.normalize(rows, P.space_extent(rows).first()).select("object_id", "dataset_id", *(F.round(c, 9).alias(c) for c in MBB))


# -- joins ------------------------------------------------------------------------------------------------------


def tiled_join(spark, sf_dir):
    """Boxes that meet, over the tiles of an octree of a tenth of them."""
    rows = _both(spark, sf_dir)
    tiles = P.octree_tiles(P.sample(rows, 0.1, "object_id"), bucket=20, max_level=4)
    return J.tile_candidates(boxes(spark, sf_dir, 1), boxes(spark, sf_dir, 2), tiles).select("id1", "id2")


def tiled_dwithin(spark, sf_dir):
    return J.spatial_join(solids(spark, sf_dir, 1), solids(spark, sf_dir, 2), "st_dwithin", distance=10.0, tiles=_grid(spark, sf_dir).tiles(spark))


def _join(name: str, make=None, **options):
    def run(spark, sf_dir):
        own = make or solids
        return J.spatial_join(own(spark, sf_dir, 1), own(spark, sf_dir, 2), name, **options)

    return run


def mbb_join(spark, sf_dir):
    return J.candidates(boxes(spark, sf_dir, 1), boxes(spark, sf_dir, 2)).select("id1", "id2")


def st_intersects_volumes(spark, sf_dir):
    rows = J.spatial_join(solids(spark, sf_dir, 1), solids(spark, sf_dir, 2), "st_intersects", volumes=True)
    return rows.select("id1", "id2", *(F.round(c, 4).alias(c) for c in ("vol1", "vol2", "vol_intersection")))


def disjoint_counts(spark, sf_dir):
    return J.disjoint_counts(solids(spark, sf_dir, 1), solids(spark, sf_dir, 2))


def st_disjoint(spark, sf_dir):
    """Every pair without a common point, between objects of the lowest corner of space: the result is as large as
    the product of both sides, so it is asked of parts of them."""
    near = lambda n: solids(spark, sf_dir, n).where("low_x < 120 and low_y < 240")
    return J.spatial_join(near(1), near(2), "st_disjoint")


def turned_volumes(spark, sf_dir):
    rows = J.spatial_join(turned(spark, sf_dir, 1), turned(spark, sf_dir, 2), "st_intersects", volumes=True)
    return rows.select("id1", "id2", *(F.round(c / 125, 4).alias(n) for c, n in ((F.col(x), x) for x in ("vol1", "vol2", "vol_intersection"))))


def turned_equals(spark, sf_dir):
    """Dataset 1 with itself under shifted ids."""
    a = turned(spark, sf_dir, 1)
    return J.spatial_join(a, a.withColumn("object_id", F.col("object_id") + 1_000_000), "st_equals")


def turned_nearest(spark, sf_dir):
    got = N.st_nearest(turned(spark, sf_dir, 1), turned(spark, sf_dir, 2), 2, max_distance=60.0)
    return got.select("id1", "rank", F.round(F.col("distance") / 5, 6).alias("distance"))


def st_equals(spark, sf_dir):
    """Dataset 1 with itself under shifted ids: each solid equals its copy."""
    a = solids(spark, sf_dir, 1)
    return J.spatial_join(a, a.withColumn("object_id", F.col("object_id") + 1_000_000), "st_equals")


def dedup_pairs(spark, sf_dir):
    """Pairs reported by every tile they share, then made distinct."""
    grid = _grid(spark, sf_dir)
    a, b = (T.assign_grid(boxes(spark, sf_dir, n), grid).select("cell", F.col("object_id").alias(f"id{n}"), *(F.col(c).alias(f"{p}_{c}") for c in MBB)) for n, p in ((1, "a"), (2, "b")))
    return J.distinct_pairs(a.join(b, "cell").where(T.overlap("a_", "b_"))).select("id1", "id2")


# -- nearest neighbours -----------------------------------------------------------------------------------------


def nn_surface(spark, sf_dir):
    return N.nn_surface(solids(spark, sf_dir, 1), solids(spark, sf_dir, 2)).select("id1", "cx", "cy", "cz", "id2", F.round("distance", 6).alias("distance"))


def nn_candidates_k2(spark, sf_dir):
    points = T.centers(boxes(spark, sf_dir, 1)).select("object_id", *(F.col(f"c{c[-1]}").alias(c) for c in MBB))
    return N.box_neighbours(points, boxes(spark, sf_dir, 2), 2).select("id1", "id2", F.round(F.sqrt("gap2"), 6).alias("distance"))


def nn_tile_candidates(spark, sf_dir):
    """Nearest surface among the two nearest boxes alone."""
    return N.nn_surface(solids(spark, sf_dir, 1), solids(spark, sf_dir, 2), mode="candidates").select("id1", "id2", F.round("distance", 6).alias("distance"))


def knn_boxes(spark, sf_dir):
    return N.knn_boxes(boxes(spark, sf_dir, 1), boxes(spark, sf_dir, 2), 3).select("id1", "id2", F.round("distance", 6).alias("distance"), "rank")


def st_nearest(spark, sf_dir):
    return N.st_nearest(solids(spark, sf_dir, 1), solids(spark, sf_dir, 2), 2, max_distance=30.0).select("id1", "id2", "rank", F.round("distance", 6).alias("distance"))


def st_nearest2(spark, sf_dir):
    return N.st_nearest(solids(spark, sf_dir, 1), solids(spark, sf_dir, 2), 2).select("id1", "id2", "rank", F.round("distance", 6).alias("distance"))


def nn_sites(spark, sf_dir):
    point = lambda n: T.centers(boxes(spark, sf_dir, n)).select("object_id", *(F.col(f"c{x}").alias(x) for x in "xyz"))
    return N.nn_sites(point(1), point(2)).select("id1", "id2", F.round("distance", 6).alias("distance"))


def nn_voronoi(spark, sf_dir):
    """By skeleton; that of a cube of twelve triangles is its centre."""
    return N.nn_voronoi(solids(spark, sf_dir, 1), solids(spark, sf_dir, 2)).withColumn("distance", F.round("distance", 6))


# -- codec ------------------------------------------------------------------------------------------------------


def quantize_12bit(spark, sf_dir):
    rows = solids(spark, sf_dir, 1).withColumn("q", udfs.quantize("mesh")).withColumn("m", udfs.mbb("q"))
    return rows.select("object_id", *(F.round(f"m.{c}", 9).alias(c) for c in MBB))


def codec_roundtrip(spark, sf_dir):
    """A decoded mesh keeps box and volume of the quantized one."""
    rows = solids(spark, sf_dir, 1).withColumn("d", udfs.decode(udfs.encode("mesh"), F.lit(100.0)))
    return rows.withColumn("m", udfs.mbb("d")).select("object_id", F.size("d.vertices").cast("long").alias("vertices"), F.size("d.faces").cast("long").alias("faces"), *(F.round(f"m.{c}", 9).alias(c) for c in MBB))


def lod_vertex_counts(spark, sf_dir):
    rows = solids(spark, sf_dir, 1).select("object_id", udfs.encode("mesh").alias("blob"), F.explode(F.array(*(F.lit(float(x)) for x in (10, 50, 100)))).alias("lod"))
    return rows.withColumn("m", udfs.decode("blob", "lod")).select("object_id", "lod", F.size("m.vertices").alias("vertices"), F.size("m.faces").alias("faces"))


QUERIES = {f.__name__: f for f in (
    mbb_from_off, off_roundtrip, malformed_rows, mesh_valid, mesh_volume, hull_volume, mesh_area, mesh_perimeter, mesh_centroid, face_frames, mbb_center, mbb_buffer,
    union_tagged, space_extent, bucket_size, prefix_offsets, sample_hash, split_tokens, grid_tiles, tile_assign, tile_assign_table, tile_stats, pairs_per_tile,
    octree_tiles, octree_assign, nested_tiles, normalized_boxes, mbb_join, st_intersects_volumes, st_disjoint, st_equals, dedup_pairs, nn_surface, nn_candidates_k2,
    disjoint_counts, turned_volumes, turned_equals, turned_nearest, nn_tile_candidates, knn_boxes, st_nearest, st_nearest2, nn_sites, nn_voronoi, quantize_12bit, codec_roundtrip, lod_vertex_counts,
    polygon_frames, vertex_normals, mesh_triangles, mbb_diagonal, split_quoted, tiled_join, tiled_dwithin,
)} | {n: _join(n) for n in ("st_intersects", "st_touches", "st_crosses", "st_contains", "st_within", "st_adjacent", "st_overlaps")} | {
    f"turned_{n[3:]}": _join(n, turned) for n in ("st_intersects", "st_touches", "st_contains", "st_within", "st_adjacent", "st_overlaps")
} | {
    "turned_dwithin": _join("st_dwithin", turned, distance=50.0), "st_intersects_solid": _join("st_intersects", solid=True), "st_dwithin": _join("st_dwithin", distance=10.0),
}

# -- the same in SQL --------------------------------------------------------------------------------------------


def _sql(body: str) -> str:
    """WITH b1, b2 (one row a box) and both, then the query."""
    parts = []
    for n, (table, key, x, y, z, w) in _BOX.items():
        low = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for e, c in zip((x, y, z), LOW, strict=True))
        high = ", ".join(f"CAST({e} AS DOUBLE) + ({w}) AS {c}" for e, c in zip((x, y, z), HIGH, strict=True))
        parts.append(f"b{n} AS (SELECT {key} AS object_id, CAST({n} AS INTEGER) AS dataset_id, {low}, {high}, CAST({w} AS DOUBLE) AS edge FROM {table})")
    corner = lambda n: " || ' ' || ".join(f"CAST({(HIGH if n >> k & 1 else LOW)[k]} AS BIGINT)" for k in range(3))
    faces = "".join(f"3 {a} {b} {c}|" for a, b, c in _CUBE)
    line = "'OFF|8 12 0|' || " + " || '|' || ".join(corner(n) for n in range(8)) + f" || '|{faces}'"
    grid = ", ".join(f"min({lo}) AS l{lo[-1]}, (max({h}) - min({lo})) / 8 AS w{lo[-1]}" for lo, h in zip(LOW, HIGH, strict=True))
    edge = ", ".join(f"{c} * w{a} + l{a} AS low_{a}, ({c} + 1) * w{a} + l{a} AS high_{a}" for c, a in zip("ijk", "xyz", strict=True))
    return (
        f"WITH {parts[0]}, {parts[1]}, bb AS (SELECT * FROM b1 UNION ALL SELECT * FROM b2), lines AS (SELECT object_id, dataset_id, {line} AS line FROM bb), "
        f"g AS (SELECT {grid} FROM bb), t AS (SELECT CAST((i * 8 + j) * 8 + k AS VARCHAR) AS tile_id, i, j, k, {edge} FROM g, range(8) AS r1(i), range(8) AS r2(j), range(8) AS r3(k)) {body}"
    )


_meet = lambda a, b: " AND ".join(f"{a}.{lo} <= {b}.{h} AND {b}.{lo} <= {a}.{h}" for lo, h in zip(LOW, HIGH, strict=True))
_in = lambda a, b, op: " AND ".join(f"{b}.{lo} {op} {a}.{lo} AND {a}.{h} {op} {b}.{h}" for lo, h in zip(LOW, HIGH, strict=True))
_open = " AND ".join(f"a.{lo} < b.{h} AND b.{lo} < a.{h}" for lo, h in zip(LOW, HIGH, strict=True))
_gap = lambda a, b: "sqrt(" + " + ".join(f"pow(greatest({a}.{lo} - {b}.{h}, {b}.{lo} - {a}.{h}, 0), 2)" for lo, h in zip(LOW, HIGH, strict=True)) + ")"
_surface = f"({_meet('a', 'b')}) AND NOT ({_in('a', 'b', '<')}) AND NOT ({_in('b', 'a', '<')})"
_pair = "SELECT a.object_id AS id1, b.object_id AS id2 FROM b1 a, b2 b WHERE "
_mids = ", ".join(f"(low_{x} + high_{x}) / 2 AS c{x}" for x in "xyz")
_pgap = "sqrt(" + " + ".join(f"pow(greatest(b.low_{x} - c{x}, c{x} - b.high_{x}, 0), 2)" for x in "xyz") + ")"
_pin = "least(" + ", ".join(f"c{x} - b.low_{x}, b.high_{x} - c{x}" for x in "xyz") + ")"
_psurf = f"CASE WHEN {' AND '.join(f'c{x} > b.low_{x} AND c{x} < b.high_{x}' for x in 'xyz')} THEN {_pin} ELSE {_pgap} END"
_flat = " + ".join(f"(CASE WHEN a.high_{x} = b.low_{x} OR b.high_{x} = a.low_{x} THEN 1 ELSE 0 END)" for x in "xyz")
_corners = ", ".join(MBB)
_half = "edge / 4096 / 2"
_quant = ", ".join([f"round(low_{x} + {_half}, 9) AS low_{x}" for x in "xyz"] + [f"round(high_{x} - {_half}, 9) AS high_{x}" for x in "xyz"])
_oct_edge = lambda lvl: ", ".join(f"l{a} + s{a} * i{a} / pow(2, {lvl}) AS low_{a}, l{a} + s{a} * (i{a} + 1) / pow(2, {lvl}) AS high_{a}" for a in "xyz")


def _octree_sql() -> str:
    levels, out = ["o0 AS (SELECT '' AS path, 0 AS ix, 0 AS iy, 0 AS iz)"], []
    for n in range(5):
        on = " AND ".join(f"bb.low_{a} <= l{a} + s{a} * (i{a} + 1) / {float(1 << n)} AND bb.high_{a} >= l{a} + s{a} * i{a} / {float(1 << n)}" for a in "xyz")
        if n == 0:
            on = "true"
        edge = ", ".join(f"l{a} + s{a} * i{a} / {float(1 << n)} AS low_{a}" for a in "xyz") + ", " + ", ".join(f"l{a} + s{a} * (i{a} + 1) / {float(1 << n)} AS high_{a}" for a in "xyz")
        levels.append(f"n{n} AS (SELECT path, ix, iy, iz, {edge}, (SELECT count(*) FROM bb WHERE {on}) AS n FROM o{n}, e)")
        out.append(f"SELECT 'OT' || path AS tile_id, {_corners}, n FROM n{n}" + (" WHERE n <= 200" if n < 4 else ""))
        if n < 4:
            levels.append(f"o{n + 1} AS (SELECT path || o AS path, ix * 2 + o // 4 AS ix, iy * 2 + o // 2 % 2 AS iy, iz * 2 + o % 2 AS iz FROM n{n}, range(8) AS r(o) WHERE n > 200)")
    ext = ", ".join(f"min(low_{a}) AS l{a}, max(high_{a}) - min(low_{a}) AS s{a}" for a in "xyz")
    return f", e AS (SELECT {ext} FROM bb), {', '.join(levels)} SELECT * FROM ({' UNION ALL '.join(out)})"


_spans = "(SELECT max(high_x) - min(low_x) AS sx, max(high_y) - min(low_y) AS sy, max(high_z) - min(low_z) AS sz, min(low_x) AS lx, min(low_y) AS ly, min(low_z) AS lz, greatest(count(*) // 50, 1) AS p FROM bb)"
_grid_sql = f""", s AS (SELECT *, least(sx, sy, sz) AS s0, sx <> sy AND sy <> sz AND sx <> sz AS d FROM {_spans}),
c AS (SELECT *, greatest(CAST(ceil(round(cbrt(CASE WHEN d THEN p * sx * sx / (sy * sz) ELSE p END), 9)) AS BIGINT), 1) AS cx, greatest(CAST(ceil(round(cbrt(CASE WHEN d THEN p * sy * sy / (sx * sz) ELSE p END), 9)) AS BIGINT), 1) AS cy,
  greatest(CAST(ceil(round(cbrt(p * sz * sz / (sx * sy)), 9)) AS BIGINT), 1) AS cz FROM s),
n AS (SELECT *, CASE WHEN d AND sx = s0 THEN greatest(CAST(ceil(p / (cy * cz)) AS BIGINT), 1) ELSE cx END AS nx, CASE WHEN d AND sy = s0 THEN greatest(CAST(ceil(p / (cx * cz)) AS BIGINT), 1) ELSE cy END AS ny,
  CASE WHEN d AND sz <> s0 THEN cz ELSE greatest(CAST(ceil(p / (cx * cy)) AS BIGINT), 1) END AS nz FROM c)
SELECT CAST((i * ny + j) * nz + k AS VARCHAR) AS tile_id, i * (sx / nx) + lx AS low_x, j * (sy / ny) + ly AS low_y, k * (sz / nz) + lz AS low_z,
  (i + 1) * (sx / nx) + lx AS high_x, (j + 1) * (sy / ny) + ly AS high_y, (k + 1) * (sz / nz) + lz AS high_z
FROM n, LATERAL (SELECT unnest(range(nx)) AS i), LATERAL (SELECT unnest(range(ny)) AS j), LATERAL (SELECT unnest(range(nz)) AS k)"""

ORACLES = {k: _sql(v) for k, v in {
    "mbb_from_off": f"SELECT object_id, dataset_id, {_corners} FROM bb",
    "off_roundtrip": "SELECT object_id, true AS same FROM b1",
    "malformed_rows": "SELECT object_id, object_id % 7 <> 0 AS readable FROM b1",
    "mesh_valid": "SELECT object_id, object_id % 5 <> 0 AS valid, CASE WHEN object_id % 5 = 0 THEN 'not closed' END AS reason FROM b1",
    "mesh_volume": "SELECT object_id, dataset_id, edge * edge * edge AS volume FROM bb",
    "hull_volume": "SELECT object_id, edge * edge * edge AS volume FROM b2",
    "mesh_area": "SELECT object_id, dataset_id, 6 * edge * edge AS area FROM bb",
    "mesh_perimeter": "SELECT object_id, round(24 * edge + 12 * edge * sqrt(2), 4) AS perimeter FROM b1",
    "mesh_centroid": "SELECT object_id, (low_x + high_x) / 2 AS x, (low_y + high_y) / 2 AS y, (low_z + high_z) / 2 AS z FROM b1",
    "face_frames": "SELECT object_id, CAST(12 AS BIGINT) AS faces, 6 * edge * edge AS area, edge * edge * edge AS volume FROM b1",
    "mbb_center": f"SELECT object_id, {_mids} FROM b1",
    "mbb_buffer": "SELECT object_id, " + ", ".join(f"low_{x} - 20 AS low_{x}, high_{x} + 20 AS high_{x}" for x in "xyz") + ", low_x AS own_low_x FROM b2",
    "union_tagged": "SELECT dataset_id, count(*) AS n FROM bb GROUP BY dataset_id",
    "space_extent": "SELECT count(*) AS n, " + ", ".join(f"min({c}) AS {c}" for c in LOW) + ", " + ", ".join(f"max({c}) AS {c}" for c in HIGH) + " FROM bb",
    "bucket_size": "SELECT count(*) AS objects, CAST(sum(length(line)) AS BIGINT) AS total_bytes, greatest(CAST(floor(greatest(CAST(floor(100000.0 / sum(length(line)) * count(*)) AS BIGINT), 1) * 0.5) AS BIGINT), 1) AS bucket_size FROM lines",
    "prefix_offsets": "SELECT object_id, length(line) AS length, CAST(sum(length(line)) OVER (ORDER BY object_id) - length(line) AS BIGINT) AS \"offset\" FROM lines WHERE dataset_id = 1",
    "sample_hash": "SELECT object_id FROM b1 WHERE object_id * 2654435761 % 1000000 < 100000",
    "split_tokens": "SELECT object_id, count(*) AS tokens, sum(coalesce(TRY_CAST(t AS DOUBLE), 0)) AS total FROM (SELECT object_id, unnest(regexp_split_to_array(line, '[| ]')) AS t FROM lines WHERE dataset_id = 1) WHERE t <> '' GROUP BY object_id",
    "grid_tiles": _grid_sql,
    "tile_assign": f"SELECT t.tile_id, bb.object_id, bb.dataset_id FROM bb JOIN t ON {_meet('bb', 't')}",
    "tile_assign_table": f"SELECT t.tile_id, bb.object_id, bb.dataset_id FROM bb JOIN t ON {_meet('bb', 't')}",
    "tile_stats": f", n AS (SELECT t.tile_id, any_value((t.high_x - t.low_x) * (t.high_y - t.low_y) * (t.high_z - t.low_z)) AS v, count(bb.object_id) AS c FROM t LEFT JOIN bb ON {_meet('bb', 't')} GROUP BY t.tile_id) SELECT count(*) AS tiles, round(sum(v), 2) AS volume, round(avg(c), 6) AS mean, min(c) AS least, max(c) AS most, round(stddev_pop(c), 6) AS spread FROM n",
    "pairs_per_tile": f", x AS (SELECT t.tile_id, a.* FROM b1 a JOIN t ON {_meet('a', 't')}), y AS (SELECT t.tile_id, b.* FROM b2 b JOIN t ON {_meet('b', 't')}), n AS (SELECT * FROM (SELECT tile_id, count(*) AS n1 FROM x GROUP BY tile_id) JOIN (SELECT tile_id, count(*) AS n2 FROM y GROUP BY tile_id) USING (tile_id)), h AS (SELECT a.tile_id, count(*) AS pairs FROM x a JOIN y b ON a.tile_id = b.tile_id AND {_meet('a', 'b')} GROUP BY a.tile_id) SELECT n.tile_id, n1, n2, coalesce(pairs, 0) AS pairs FROM n LEFT JOIN h ON n.tile_id = h.tile_id",
    "octree_tiles": _octree_sql(),
    "octree_assign": _octree_sql().replace(" SELECT * FROM (", " SELECT tile_id, n FROM (") + " WHERE n > 0",
    "nested_tiles": "SELECT tile_id || '.' || ((a * 2 + b) * 2 + c) AS tile_id, " + ", ".join(f"low_{x} + (high_{x} - low_{x}) * {n} / 2 AS low_{x}, low_{x} + (high_{x} - low_{x}) * ({n} + 1) / 2 AS high_{x}" for x, n in zip("xyz", "abc", strict=True)) + " FROM t, range(2) AS r4(a), range(2) AS r5(b), range(2) AS r6(c)",
    "normalized_boxes": "SELECT object_id, dataset_id, " + ", ".join(f"round((low_{x} - l{x}) / (w{x} * 8), 9) AS low_{x}, round((high_{x} - l{x}) / (w{x} * 8), 9) AS high_{x}" for x in "xyz") + " FROM bb, g",
    "mbb_join": _pair + _meet("a", "b"),
    "dedup_pairs": _pair + _meet("a", "b"),
    "st_intersects": _pair + _surface,
    "st_intersects_solid": _pair + _meet("a", "b"),
    "st_intersects_volumes": "SELECT a.object_id AS id1, b.object_id AS id2, a.edge * a.edge * a.edge AS vol1, b.edge * b.edge * b.edge AS vol2, " + " * ".join(f"(least(a.high_{x}, b.high_{x}) - greatest(a.low_{x}, b.low_{x}))" for x in "xyz") + f" AS vol_intersection FROM b1 a, b2 b WHERE {_surface}",
    "st_touches": _pair + f"({_meet('a', 'b')}) AND NOT ({_open})",
    "st_adjacent": _pair + f"({_meet('a', 'b')}) AND {_flat} = 1",
    "st_crosses": _pair + f"({_open}) AND NOT ({_in('a', 'b', '<=')}) AND NOT ({_in('b', 'a', '<=')})",
    "st_overlaps": _pair + f"({_open}) AND NOT ({_in('a', 'b', '<=')}) AND NOT ({_in('b', 'a', '<=')})",
    "st_contains": _pair + _in("b", "a", "<="),
    "st_within": _pair + _in("a", "b", "<="),
    "st_disjoint": _pair + f"NOT ({_meet('a', 'b')}) AND " + " AND ".join(f"{x}.low_x < 120 AND {x}.low_y < 240" for x in "ab"),
    "disjoint_counts": f"SELECT a.object_id AS id1, (SELECT count(*) FROM b2) - count(b.object_id) AS n_disjoint FROM b1 a LEFT JOIN b2 b ON {_meet('a', 'b')} GROUP BY a.object_id",
    "st_equals": "SELECT a.object_id AS id1, b.object_id + 1000000 AS id2 FROM b1 a JOIN b1 b ON a.low_x = b.low_x AND a.low_y = b.low_y AND a.low_z = b.low_z AND a.edge = b.edge",
    "st_dwithin": _pair + _gap("a", "b") + " <= 10",
    "nn_surface": f", c AS (SELECT object_id AS id1, {_mids} FROM b1) SELECT id1, cx, cy, cz, arg_min(id2, (d, id2)) AS id2, round(min(d), 6) AS distance FROM (SELECT c.*, b.object_id AS id2, {_psurf} AS d FROM c, b2 b) GROUP BY id1, cx, cy, cz",
    "nn_candidates_k2": f", c AS (SELECT object_id AS id1, {_mids} FROM b1), d AS (SELECT id1, b.object_id AS id2, {_pgap} AS g FROM c, b2 b), r AS (SELECT *, rank() OVER (PARTITION BY id1 ORDER BY g) AS r FROM d) SELECT id1, id2, round(g, 6) AS distance FROM r WHERE r <= 2",
    "nn_tile_candidates": f", c AS (SELECT object_id AS id1, {_mids} FROM b1), d AS (SELECT id1, b.object_id AS id2, {_pgap} AS g, {_psurf} AS s FROM c, b2 b), r AS (SELECT *, rank() OVER (PARTITION BY id1 ORDER BY g) AS r FROM d) SELECT id1, arg_min(id2, (s, id2)) AS id2, round(min(s), 6) AS distance FROM r WHERE r <= 2 GROUP BY id1",
    "knn_boxes": f", d AS (SELECT a.object_id AS id1, b.object_id AS id2, {_gap('a', 'b')} AS g FROM b1 a, b2 b), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id1 ORDER BY g, id2) AS INTEGER) AS rank FROM d) SELECT id1, id2, round(g, 6) AS distance, rank FROM r WHERE rank <= 3",
    "st_nearest": f", d AS (SELECT a.object_id AS id1, b.object_id AS id2, {_gap('a', 'b')} AS g FROM b1 a, b2 b), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id1 ORDER BY g, id2) AS INTEGER) AS rank FROM d WHERE g <= 30) SELECT id1, id2, rank, round(g, 6) AS distance FROM r WHERE rank <= 2",
    "st_nearest2": f", d AS (SELECT a.object_id AS id1, b.object_id AS id2, {_gap('a', 'b')} AS g FROM b1 a, b2 b), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY id1 ORDER BY g, id2) AS INTEGER) AS rank FROM d) SELECT id1, id2, rank, round(g, 6) AS distance FROM r WHERE rank <= 2",
    "nn_sites": f", p AS (SELECT object_id AS id1, {_mids} FROM b1), q AS (SELECT object_id AS id2, " + ", ".join(f"(low_{x} + high_{x}) / 2 AS s{x}" for x in "xyz") + " FROM b2), r AS (SELECT id1, id2, sqrt(" + " + ".join(f"pow(c{x} - s{x}, 2)" for x in "xyz") + ") AS g FROM p, q) SELECT id1, arg_min(id2, g * 1000000 + id2 / 1000000) AS id2, round(min(g), 6) AS distance FROM r GROUP BY id1",
    "nn_voronoi": f", p AS (SELECT object_id AS id1, {_mids} FROM b1), q AS (SELECT object_id AS id2, " + ", ".join(f"(low_{x} + high_{x}) / 2 AS s{x}" for x in "xyz") + " FROM b2), r AS (SELECT p.*, id2, sqrt(" + " + ".join(f"pow(c{x} - s{x}, 2)" for x in "xyz") + ") AS g FROM p, q) SELECT id1, cx, cy, cz, arg_min(id2, (g, id2)) AS id2, round(min(g), 6) AS distance FROM r GROUP BY id1, cx, cy, cz",
    "polygon_frames": ", f AS (SELECT * FROM (VALUES (0, 0, 0, -1), (1, 0, 0, 1), (2, 0, -1, 0), (3, 0, 1, 0), (4, -1, 0, 0), (5, 1, 0, 0)) AS v(face, i, j, k)) SELECT object_id, face, " + ", ".join(f"CAST({n} AS DOUBLE) AS n{x}, (low_{x} + high_{x} + {n} * edge) / 2 AS b{x}" for x, n in zip("xyz", "ijk", strict=True)) + " FROM b1, f",
    "vertex_normals": "SELECT object_id, CAST(v AS INTEGER) AS vertex, " + ", ".join(f"CASE WHEN (v >> {k}) & 1 = 1 THEN 0.57735 ELSE -0.57735 END::DOUBLE AS {x}" for k, x in enumerate("xyz")) + " FROM b1, range(8) AS r(v)",
    "mesh_triangles": f"SELECT object_id, CAST(12 AS BIGINT) AS triangles, {_corners}, 8 * edge AS spans FROM b1",
    "mbb_diagonal": "SELECT object_id, dataset_id, round(sqrt(3 * edge * edge), 6) AS diagonal FROM bb",
    "split_quoted": ", v AS (SELECT p_partkey AS object_id, [p_type, CAST(p_partkey AS VARCHAR), '', 'xa, bc', 'it''s ' || p_brand] AS f FROM part) SELECT object_id, CAST(i AS INTEGER) AS pos, f[i + 1] AS token FROM v, range(5) AS r(i)",
    "tiled_join": _pair + _meet("a", "b"),
    "tiled_dwithin": _pair + _gap("a", "b") + " <= 10",
    "quantize_12bit": f"SELECT object_id, {_quant} FROM b1",
    "codec_roundtrip": f"SELECT object_id, CAST(8 AS BIGINT) AS vertices, CAST(12 AS BIGINT) AS faces, {_quant} FROM b1",
}.items()}
#: What the turned solids must give is what the boxes give.
ORACLES |= {f"turned_{n}": ORACLES[f"st_{n}"] for n in ("intersects", "touches", "contains", "within", "adjacent", "overlaps", "dwithin", "equals")}
ORACLES["turned_volumes"] = ORACLES["st_intersects_volumes"]
ORACLES["turned_nearest"] = ORACLES["st_nearest"].replace("g <= 30", "g <= 12").replace("SELECT id1, id2, rank, round", "SELECT id1, rank, round")

