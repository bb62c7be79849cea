"""Geometry as Arrow functions on mesh columns; ``register`` names them ``st3d_*`` in SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf

from ..schema import BOX, MBB, MESH, POINT
from . import codec as c
from . import frames as fr
from . import geometry as g
from . import meshes as m
from .skeleton import skeletons

#: The kernels by name: a function that is sent to a worker must not name a function column of this module.
K = {f.__name__: f for f in (g.mbb, g.volume, g.area, g.hull_volume, g.centroid, g.intersection_volume, fr.polygon_frames, fr.vertex_normals, m.parse_off, m.to_off, c.encode, c.decode, c.quantize)}
_REAL, _TEXT, _BOOL, _BYTES = T.DoubleType(), T.StringType(), T.BooleanType(), T.BinaryType()
_VALID = T.StructType([T.StructField("valid", _BOOL), T.StructField("reason", _TEXT)])
_FRAME = T.ArrayType(T.StructType([T.StructField("normal", POINT), T.StructField("barycenter", POINT), T.StructField("area", _REAL)]))


_POLYGON = T.ArrayType(T.StructType([T.StructField("normal", POINT), T.StructField("barycenter", POINT)]))
_TRIANGLE = T.StructType([T.StructField(c, POINT) for c in "abc"] + [T.StructField(c, _REAL) for c in MBB])


def _each(mesh: pa.Array, f, kind) -> pa.Array:
    return pa.array([None if t is None or not len(t) else f(t) for t in m.triangles_of(mesh)], kind)


@arrow_udf(MESH)
def parse_off(line: pa.Array) -> pa.Array:
    return m.to_mesh([K["parse_off"](x) for x in line.to_pylist()])


@arrow_udf(_BYTES)
def pack(mesh: pa.Array) -> pa.Array:
    """The mesh as bytes, which joins carry; functions of solids take either form."""
    return m.pack(mesh)


@arrow_udf(_TEXT)
def to_off(mesh: pa.Array) -> pa.Array:
    return pa.array([None if r is None else K["to_off"](*r) for r in m.raw_of(mesh)], pa.string())


@arrow_udf(BOX)
def mbb(mesh: pa.Array) -> pa.Array:
    return _each(mesh, lambda t: dict(zip(MBB, K["mbb"](t).tolist(), strict=True)), pa.struct([(x, pa.float64()) for x in MBB]))


@arrow_udf(_REAL)
def volume(mesh: pa.Array) -> pa.Array:
    return _each(mesh, K["volume"], pa.float64())


@arrow_udf(_REAL)
def area(mesh: pa.Array) -> pa.Array:
    return _each(mesh, K["area"], pa.float64())


@arrow_udf(_REAL)
def hull_volume(mesh: pa.Array) -> pa.Array:
    return _each(mesh, lambda t: K["hull_volume"](t.reshape(-1, 3)), pa.float64())


@arrow_udf(_REAL)
def perimeter(mesh: pa.Array) -> pa.Array:
    """Sum of the perimeters of all triangles."""
    return _each(mesh, lambda t: float(g.edge_lengths(t).sum()), pa.float64())


@arrow_udf(POINT)
def centroid(mesh: pa.Array) -> pa.Array:
    return _each(mesh, lambda t: dict(zip("xyz", K["centroid"](t).tolist(), strict=True)), m.POINT)


@arrow_udf(_FRAME)
def face_frames(mesh: pa.Array) -> pa.Array:
    """Normal, barycentre and area of every triangle."""

    def one(t):
        point = lambda p: dict(zip("xyz", p, strict=True))
        size = np.linalg.norm(g.cross_of(t), axis=1) / 2
        return [{"normal": point(n), "barycenter": point(b), "area": s} for n, b, s in zip(g.normals(t).tolist(), t.mean(axis=1).tolist(), size.tolist(), strict=True)]

    return _each(mesh, one, pa.list_(pa.struct([("normal", m.POINT), ("barycenter", m.POINT), ("area", pa.float64())])))


@arrow_udf(_POLYGON)
def polygon_frames(mesh: pa.Array) -> pa.Array:
    """Normal and barycentre of every face, of any degree."""
    point = lambda p: dict(zip("xyz", p, strict=True))
    kind = pa.list_(pa.struct([("normal", m.POINT), ("barycenter", m.POINT)]))
    return pa.array([None if r is None else [{"normal": point(n), "barycenter": point(b)} for n, b in zip(*(x.tolist() for x in K["polygon_frames"](*r)), strict=True)] for r in m.raw_of(mesh)], kind)


@arrow_udf(T.ArrayType(POINT))
def vertex_normals(mesh: pa.Array) -> pa.Array:
    """Normal of every vertex, in the order of the vertices."""
    return pa.array([None if r is None else [dict(zip("xyz", p, strict=True)) for p in K["vertex_normals"](*r).tolist()] for r in m.raw_of(mesh)], pa.list_(m.POINT))


@arrow_udf(T.ArrayType(_TRIANGLE))
def triangles(mesh: pa.Array) -> pa.Array:
    """Corners and box of every triangle; ``inline`` makes them rows."""
    kind = pa.list_(pa.struct([(c, m.POINT) for c in "abc"] + [(c, pa.float64()) for c in MBB]))
    point = lambda p: dict(zip("xyz", p, strict=True))

    def one(t):
        low, high = t.min(axis=1).tolist(), t.max(axis=1).tolist()
        return [{**{c: point(p) for c, p in zip("abc", tri, strict=True)}, **dict(zip(MBB, lo + hi, strict=True))} for tri, lo, hi in zip(t.tolist(), low, high, strict=True)]

    return pa.array([None if t is None else one(t) for t in m.triangles_of(mesh)], kind)


@udtf(returnType=T.StructType([T.StructField("number", T.IntegerType()), *_TRIANGLE.fields]))
class EachTriangle:
    """A row a triangle of a mesh, faces fanned; none for a null mesh."""

    def eval(self, mesh):
        if mesh is None or mesh["vertices"] is None or mesh["faces"] is None:
            return
        corner, number = [(p["x"], p["y"], p["z"]) for p in mesh["vertices"]], 0
        for face in mesh["faces"]:
            for k in range(1, len(face) - 1):
                tri = [corner[face[i]] for i in (0, k, k + 1)]
                yield (number, *tri, *map(min, zip(*tri, strict=True)), *map(max, zip(*tri, strict=True)))
                number += 1


@arrow_udf(_VALID)
def is_valid(mesh: pa.Array) -> pa.Array:
    why = ["unreadable" if r is None else g.why_invalid(len(r[0]), r[1]) for r in m.raw_of(mesh)]
    return pa.array([{"valid": w is None, "reason": w} for w in why], pa.struct([("valid", pa.bool_()), ("reason", pa.string())]))


@arrow_udf(_BOOL)
def intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether two surfaces meet; null where a mesh is."""
    x, y = m.triangles_of(a), m.triangles_of(b)
    ok = [p is not None and q is not None for p, q in zip(x, y, strict=True)]
    got = g.surfaces_meet_many([(p if k else np.empty((0, 3, 3)), q if k else np.empty((0, 3, 3))) for p, q, k in zip(x, y, ok, strict=True)])
    return pa.array([bool(v) if k else None for v, k in zip(got, ok, strict=True)], pa.bool_())


def predicate(name: str, distance: float = 0.0, solid: bool = False):
    """Column function of two meshes for a named predicate."""

    @arrow_udf(_BOOL)
    def holds(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = m.triangles_of(a), m.triangles_of(b)
        pairs = [(p, q) if p is not None and q is not None and len(p) and len(q) else None for p, q in zip(x, y, strict=True)]
        if name == "st_dwithin":
            near = iter(g.within([p for p in pairs if p], distance).tolist())
            return pa.array([None if p is None else next(near) for p in pairs], pa.bool_())
        meets = g.surfaces_meet_many([p or (np.empty((0, 3, 3)),) * 2 for p in pairs])
        if name == "st_intersects" and not solid:
            return pa.array([None if p is None else bool(k) for p, k in zip(pairs, meets, strict=True)], pa.bool_())
        return pa.array([None if p is None else bool(g.holds(name, *p, distance=distance, solid=solid, meets=bool(k))) for p, k in zip(pairs, meets, strict=True)], pa.bool_())

    return holds


@arrow_udf(_REAL)
def intersection_volume(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if p is None or q is None else K["intersection_volume"](p, q) for p, q in zip(m.triangles_of(a), m.triangles_of(b), strict=True)], pa.float64())


@arrow_udf(_REAL)
def distance(a: pa.Array, b: pa.Array) -> pa.Array:
    """Least distance of two solids; 0 where they have a point in common."""
    pairs = [(p, q) if p is not None and q is not None and len(p) and len(q) else None for p, q in zip(m.triangles_of(a), m.triangles_of(b), strict=True)]
    got = iter(g.solid_distances([p for p in pairs if p]).tolist())
    return pa.array([None if p is None else next(got) for p in pairs], pa.float64())


@arrow_udf(_REAL)
def point_distance(x: pa.Array, y: pa.Array, z: pa.Array, mesh: pa.Array) -> pa.Array:
    """Distance of a point to a surface, also from inside."""
    tri = m.triangles_of(mesh)
    p = np.stack([v.to_numpy(zero_copy_only=False) for v in (x, y, z)], axis=1)
    out, at = np.full(len(tri), np.nan), 0
    while at < len(tri):  # many small meshes in one sweep
        part, total = [], 0
        while at + len(part) < len(tri) and total < 50_000:
            t = tri[at + len(part)]
            part.append(t if t is not None else np.empty((0, 3, 3)))
            total += len(part[-1])
        n = np.array([len(t) for t in part])
        if total:
            d = g.point_triangle(np.repeat(p[at : at + len(part)], n, axis=0), np.concatenate(part))
            some = n > 0
            out[at : at + len(part)][some] = np.sqrt(np.minimum.reduceat(d, (np.cumsum(n) - n)[some]))
        at += len(part)
    return pa.array(out, from_pandas=True)


@arrow_udf(_BYTES)
def encode(mesh: pa.Array) -> pa.Array:
    return pa.array([None if r is None else K["encode"](*r) for r in m.raw_of(mesh)], pa.binary())


@arrow_udf(MESH)
def decode(blob: pa.Array, lod: pa.Array) -> pa.Array:
    return m.to_mesh([None if b is None else K["decode"](b, 100 if k is None else k) for b, k in zip(blob.to_pylist(), lod.to_pylist(), strict=True)])


@arrow_udf(MESH)
def quantize(mesh: pa.Array) -> pa.Array:
    """Vertices moved to the centres of their 12-bit cells."""
    return m.to_mesh([None if r is None or not len(r[0]) else (c.dequantize(*K["quantize"](r[0])), r[1]) for r in m.raw_of(mesh)])


@arrow_udf(T.ArrayType(POINT))
def skeleton(mesh: pa.Array) -> pa.Array:
    found = skeletons(m.raw_of(mesh, lists=False))
    stop = np.cumsum([0] + [0 if p is None else len(p) for p in found])
    points = np.concatenate([np.empty((0, 3)), *(p for p in found if p is not None)])
    values = pa.StructArray.from_arrays([pa.array(points[:, c]) for c in range(3)], fields=list(m.POINT))
    return pa.ListArray.from_arrays(pa.array(stop, pa.int32()), values, mask=pa.array([p is None for p in found], pa.bool_()))


@arrow_udf(_BOOL)
def dwithin(a: pa.Array, b: pa.Array, distance: pa.Array) -> pa.Array:
    """Whether two solids come within a distance of each other; null where a mesh is."""
    rows = [(p, q, d) if p is not None and q is not None and d is not None and len(p) and len(q) else None for p, q, d in zip(m.triangles_of(a), m.triangles_of(b), distance.to_pylist(), strict=True)]
    return pa.array([None if r is None else bool(g.within([r[:2]], float(r[2]))[0]) for r in rows], pa.bool_())


def register(spark: SparkSession) -> list[str]:
    """Name every function ``st3d_<name>`` in the session's SQL."""
    own = {f"st3d_{n}": f for n, f in (("parse_off", parse_off), ("to_off", to_off), ("mbb", mbb), ("volume", volume), ("area", area), ("hull_volume", hull_volume), ("perimeter", perimeter), ("centroid", centroid), ("face_frames", face_frames), ("is_valid", is_valid), ("intersects", intersects), ("intersection_volume", intersection_volume), ("distance", distance), ("pack", pack), ("point_distance", point_distance), ("encode", encode), ("decode", decode), ("quantize", quantize), ("skeleton", skeleton), ("polygon_frames", polygon_frames), ("vertex_normals", vertex_normals), ("triangles", triangles))}
    own |= {f"st3d_{n}": predicate(f"st_{n}", solid=n == "solid") for n in ("touches", "crosses", "contains", "adjacent", "disjoint", "equals", "within", "overlaps")}
    own["st3d_dwithin"] = dwithin
    for name, f in own.items():
        spark.udf.register(name, f)
    spark.udtf.register("st3d_each_triangle", EachTriangle)
    return sorted([*own, "st3d_each_triangle"])
