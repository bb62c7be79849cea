"""Mesh columns and numpy meshes: conversion of whole Arrow arrays, and OFF text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import geometry as g

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
MESH = pa.struct([("vertices", pa.list_(POINT)), ("faces", pa.list_(pa.list_(pa.int32())))])


def vertices_of(points: pa.Array) -> list:
    """(n, 3) arrays of an array<struct<x,y,z>> column; None for null."""
    flat = points.flatten()
    xyz = np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1) if len(flat) else np.empty((0, 3))
    n = np.array([len(x) if x is not None else 0 for x in _lengths(points)])
    stop = np.cumsum(n)
    return [xyz[e - k : e] if ok else None for e, k, ok in zip(stop, n, points.is_valid().to_pylist(), strict=True)]


class _Len(int):
    def __len__(self):
        return int(self)


def _lengths(col: pa.Array) -> list:
    return [None if x is None else _Len(x) for x in pc.list_value_length(col).to_pylist()]


def _pack_alike(points: pa.Array, faces: pa.Array) -> pa.Array | None:
    """``pack`` of whole meshes of triangles that all have as many vertices and faces, at once; None for any others."""
    flat, corners = points.flatten(), faces.flatten()
    index, axes = corners.flatten(), [] if not len(flat) else [flat.field(c) for c in "xyz"]
    k, lengths = len(points), [pc.min_max(pc.list_value_length(c)).as_py() for c in (points, faces, corners)]
    if not axes or not len(index) or any(c.null_count for c in (points, faces, flat, corners, index, *axes)) or any(n["min"] != n["max"] for n in lengths) or lengths[2]["max"] != 3:
        return None
    n, m = lengths[0]["max"], lengths[1]["max"]
    tri, size = index.to_numpy().astype(np.int32), 4 + 24 * n + 12 * m
    if tri.min() < 0 or tri.max() >= n or k * size >= 1 << 31:
        return None
    data = np.empty((k, size), np.uint8)
    data[:, :4] = np.frombuffer(np.int32(n).tobytes(), np.uint8)
    data[:, 4 : 4 + 24 * n] = np.stack([c.to_numpy() for c in axes], axis=1).reshape(k, -1).view(np.uint8)
    data[:, 4 + 24 * n :] = tri.reshape(k, -1).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(np.arange(k + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(data)])


def pack(mesh: pa.Array) -> pa.Array:
    """Each mesh as bytes: the number of vertices, their coordinates, then the corners of its triangles (faces fanned).
    Null and broken meshes are null."""
    if (alike := _pack_alike(mesh.field("vertices"), mesh.field("faces")) if len(mesh) and not mesh.null_count else None) is not None:
        return alike
    out = []
    for v, faces in zip(vertices_of(mesh.field("vertices")), _faces(mesh.field("faces")), strict=True):
        try:
            tri = faces if faces is None or isinstance(faces, np.ndarray) else g.fan(np.arange(len(v))[:, None], faces)[:, :, 0]
            if v is None or tri is None or tri.min(initial=0) < 0 or tri.max(initial=-1) >= len(v):
                raise IndexError
            out.append(np.int32(len(v)).tobytes() + v.tobytes() + tri.astype(np.int32).tobytes())
        except (IndexError, TypeError):
            out.append(None)
    return pa.array([x if ok else None for x, ok in zip(out, mesh.is_valid().to_pylist(), strict=True)], pa.binary())


def unpack(data: bytes | None) -> np.ndarray | None:
    """Triangles of packed bytes."""
    if data is None:
        return None
    n = int.from_bytes(data[:4], "little")
    return np.frombuffer(data, np.float64, 3 * n, 4).reshape(-1, 3)[np.frombuffer(data, np.int32, offset=4 + 24 * n).reshape(-1, 3)]


def triangles_of(mesh: pa.Array) -> list:
    """Triangles of each mesh of a column, packed or not; faces are fanned; None for null or broken meshes."""
    if pa.types.is_binary(mesh.type):
        return [unpack(x) for x in mesh.to_pylist()]
    out = []
    for v, faces in zip(vertices_of(mesh.field("vertices")), _faces(mesh.field("faces")), strict=True):
        if v is None or faces is None:
            out.append(None)
            continue
        try:
            out.append(v[faces] if isinstance(faces, np.ndarray) else g.fan(v, faces))
        except (IndexError, TypeError):
            out.append(None)
    valid = mesh.is_valid().to_pylist()
    return [t if ok else None for t, ok in zip(out, valid, strict=True)]


def _faces(col: pa.Array) -> list:
    """Face lists; an (n, 3) array where all faces of the mesh are triangles."""
    inner = col.flatten()
    size = pc.list_value_length(inner).to_numpy(zero_copy_only=False) if len(inner) else np.empty(0)
    flat = inner.flatten().to_numpy(zero_copy_only=False) if len(inner) else np.empty(0, np.int32)
    n = np.array([0 if x is None else x for x in pc.list_value_length(col).to_pylist()])
    stop = np.cumsum(n)
    at = np.concatenate([[0], np.cumsum(np.nan_to_num(size)).astype(int)])
    out = []
    for e, k, ok in zip(stop, n, col.is_valid().to_pylist(), strict=True):
        if not ok:
            out.append(None)
        elif k and (size[e - k : e] == 3).all():
            out.append(flat[at[e - k] : at[e]].astype(np.int64).reshape(-1, 3))
        else:
            out.append([flat[at[i] : at[i + 1]].astype(int).tolist() for i in range(e - k, e)])
    return out


def raw_of(mesh: pa.Array, lists: bool = True) -> list:
    """(vertices, face lists) of each mesh; None for null. Without ``lists`` triangles stay arrays."""
    faces = [f.tolist() if lists and isinstance(f, np.ndarray) else f for f in _faces(mesh.field("faces"))]
    return [None if v is None or f is None or not ok else (v, f) for v, f, ok in zip(vertices_of(mesh.field("vertices")), faces, mesh.is_valid().to_pylist(), strict=True)]


def to_mesh(rows: list) -> pa.Array:
    """A mesh column of (vertices, face lists) or None."""
    return pa.array([None if r is None else {"vertices": [dict(zip("xyz", p, strict=True)) for p in np.asarray(r[0]).tolist()], "faces": [list(map(int, f)) for f in r[1]]} for r in rows], MESH)


def parse_off(line: str | None):
    """(vertices, faces) of one OFF line (bars for line ends), or None where it is malformed.

    A trailing bar, a carriage return at the end and an edge count of any value are fine."""
    if not line:
        return None
    part = line.replace("\r", "").replace("|", " ").split()
    try:
        if part[0] != "OFF":
            return None
        nv, nf = int(part[1]), int(part[2])
        v = np.array(part[4 : 4 + 3 * nv], np.float64).reshape(nv, 3)
        at, faces = 4 + 3 * nv, []
        for _ in range(nf):
            k = int(part[at])
            face = [int(x) for x in part[at + 1 : at + 1 + k]]
            if len(face) != k or k < 3 or not all(0 <= i < nv for i in face):
                return None
            faces.append(face)
            at += 1 + k
    except (IndexError, ValueError):
        return None
    return v, faces


def to_off(vertices: np.ndarray, faces: list) -> str:
    number = lambda x: repr(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))
    return "|".join([
        "OFF", f"{len(vertices)} {len(faces)} 0", *(" ".join(map(number, p)) for p in np.asarray(vertices).tolist()),
        *(" ".join(map(str, [len(f), *f])) for f in faces), "",
    ])
