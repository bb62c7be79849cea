"""Normals and barycentres of faces of any degree, and normals of vertices."""

from __future__ import annotations

import numpy as np


def _corners(faces: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every corner of every face: its face, its vertex and the vertex after it."""
    n = np.array([len(f) for f in faces], np.int64)
    face = np.repeat(np.arange(len(faces)), n)
    here = np.array([i for f in faces for i in f], np.int64)
    after = np.array([f[(k + 1) % len(f)] for f in faces for k in range(len(f))], np.int64)
    return face, here, after


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def polygon_frames(vertices: np.ndarray, faces: list) -> tuple[np.ndarray, np.ndarray]:
    """(normals, barycentres), a row a face. A normal sums the cross products along the outline, so it is right for
    bent and non-convex faces too; it is zero for a face without area. A barycentre is the mean of the corners."""
    normal, middle = np.zeros((len(faces), 3)), np.zeros((len(faces), 3))
    if len(faces):
        face, here, after = _corners(faces)
        count = np.bincount(face, minlength=len(faces))[:, None]
        np.add.at(middle, face, vertices[here])
        middle /= np.maximum(count, 1)
        # about the barycentre: less is lost to rounding far from the origin
        np.add.at(normal, face, np.cross(vertices[here] - middle[face], vertices[after] - middle[face]))
    return _unit(normal), middle


def vertex_normals(vertices: np.ndarray, faces: list) -> np.ndarray:
    """A row a vertex: the normals of its faces added up and scaled to length 1; zero where it has none."""
    out = np.zeros((len(vertices), 3))
    if len(faces):
        face, here, _ = _corners(faces)
        np.add.at(out, here, polygon_frames(vertices, faces)[0][face])
    return _unit(out)
