"""Boxes with their meshes, brought together cell by cell: both sides of a cell meet in one Arrow call, so a mesh moves once for
each cell it touches and never once for each pair.

A pair belongs to the cell of its reference point, the larger low corner. Each row knows along which axes its own low corner
lies in the cell (bits of ``_from``); rows whose low corner lies beyond the cell are in none of its pairs and are left out. So
a pair is the cell's own if the bits of both rows are all three."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import solids as S
from ..functions import udfs
from ..schema import HIGH, LOW, MBB
from ..scratch import Scratch
from .partition import Grid
from .tiling import assign_tiles, axis_cells, axis_reference

#: Rows and bytes of meshes of one side that one call takes; cells beyond them are dealt out in blocks.
ROWS, BYTES = 2048, 16 << 20
#: Heavy cells up to which their table is broadcast.
HEAVY = 10_000
KNOWN = " and ".join(f"{c} is not null" for c in MBB)


def packed(side: DataFrame, id_col: str, *more: str) -> DataFrame:
    """Rows of a side with the packed mesh and, natively, about how many bytes it has."""
    size = (F.size("mesh.vertices") * 24 + F.size("mesh.faces") * 12).cast("long")
    return side.where(f"{KNOWN} and mesh is not null").select(F.col("object_id").alias(id_col), *MBB, *more, udfs.pack("mesh").alias("mesh"), size.alias("_bytes"))


def own_part(rows: DataFrame, at: list[Column], beyond: list[Column]) -> DataFrame:
    """rows with the bits ``_from``; ``at``: whether the low corner lies at or above the cell's low edge, ``beyond``: above the cell."""
    for c in beyond:
        rows = rows.where(~c)
    return rows.withColumn("_from", sum((c.cast("int") * (1 << k) for k, c in enumerate(at)), F.lit(0)))


def on_grid(rows: DataFrame, grid: Grid) -> DataFrame:
    """rows over the cells of a grid (``cell``)."""
    names = ("_i", "_j", "_k")
    for k, name in enumerate(names):
        rows = rows.withColumn(name, F.explode(axis_cells(grid, k, F.col(LOW[k]), F.col(HIGH[k]))))
    ref = [axis_reference(grid, k, F.col(LOW[k])) for k in range(3)]
    rows = own_part(rows, [r == F.col(n) for r, n in zip(ref, names, strict=True)], [r > F.col(n) for r, n in zip(ref, names, strict=True)])
    _, ny, nz = grid.shape
    return rows.withColumn("cell", (F.col("_i") * ny + F.col("_j")) * nz + F.col("_k")).drop(*names)


def on_tiles(rows: DataFrame, tiles: DataFrame, ext) -> DataFrame:
    """rows over the tiles of a table (``cell``: the tile's id); boxes beyond their extent belong to the tiles at its border."""
    inner = lambda c: F.least(F.greatest(F.col(c), F.lit(ext[f"low_{c[-1]}"])), F.lit(ext[f"high_{c[-1]}"]))
    rows = assign_tiles(rows.withColumns({f"_{c}": F.col(c) for c in MBB}).withColumns({c: inner(c) for c in MBB}), tiles, corners=True)
    rows = own_part(rows, [F.col(c) >= F.col(f"t_{c}") for c in LOW], [(F.col(lo) >= F.col(f"t_{h}")) & (F.col(f"t_{h}") < ext[h]) for lo, h in zip(LOW, HIGH, strict=True)])
    return rows.withColumns({c: F.col(f"_{c}") for c in MBB}).withColumnRenamed("tile_id", "cell").drop(*(f"_{c}" for c in MBB), *(f"t_{c}" for c in MBB))


def cell_by_cell(left: DataFrame, right: DataFrame, f: Callable, schema) -> DataFrame:
    """Rows of ``f(left, right)`` (Arrow tables) over the cells that both sides have.

    A cell with more than ROWS rows or BYTES of a side is dealt out: blocks of one side meet all blocks of the other, each
    block pair a call of its own, so the memory of a call has a bound and no cell is one task's work."""
    spark = left.sparkSession
    count = None
    for n, side in ((1, left), (2, right)):
        size = F.sum("_bytes") if "_bytes" in side.columns else F.lit(0)
        one = side.groupBy("cell").agg(F.greatest(F.ceil(F.count("*") / ROWS), F.ceil(size / BYTES)).cast("int").alias(f"_n{n}"))
        count = one if count is None else count.hint("merge").join(one, "cell")
    heavy = Scratch(spark).table(count.where("_n1 > 1 or _n2 > 1"), "heavy")
    many = heavy.count()
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # no constant blocks where no cell is heavy: rows dealt out by constants would be dealt out once more, by columns
    keys = ["cell", "_b1", "_b2"] if many else ["cell"]

    def dealt(side, own, other, key):
        side = side.drop("_bytes")
        if not many:
            return side.repartition(parts, *keys)
        side = side.join(F.broadcast(heavy) if many <= HEAVY else heavy.hint("merge"), "cell", "left")
        block = F.pmod(F.xxhash64(key), F.coalesce(f"_n{own}", F.lit(1))).cast("int")
        side = side.withColumns({f"_b{own}": block, f"_b{other}": F.explode(F.sequence(F.lit(0), F.coalesce(f"_n{other}", F.lit(1)) - 1))})
        return side.drop("_n1", "_n2").repartition(parts, *keys)

    # partitions by number: adaptive execution would merge them by their bytes, which say little about the work
    a, b = (dealt(x, own, other, key).groupBy(*keys) for x, own, other, key in ((left, 1, 2, "id1"), (right, 2, 1, "id2")))
    return a.cogroup(b).applyInArrow(f, schema)


def matrix(rows: pa.Table, columns) -> np.ndarray:
    return np.stack([rows[c].to_numpy() for c in columns], axis=1).astype(np.float64) if rows.num_rows else np.empty((0, len(columns)))


def own_pairs(left: pa.Table, right: pa.Table, a: np.ndarray, b: np.ndarray, some: np.ndarray | None = None, other: np.ndarray | None = None, sweep: Callable = S.meeting):
    """Pairs of meeting boxes (or others by ``sweep``) that belong to the cell, in parts; ``some`` and ``other``: the rows that count."""
    x, y = (np.arange(len(m)) if s is None else np.flatnonzero(s) for m, s in ((a, some), (b, other)))
    fa, fb = left["_from"].to_numpy(), right["_from"].to_numpy()
    for i, j in sweep(a[x], b[y]):
        i, j = x[i], y[j]
        own = (fa[i] | fb[j]) == 7
        if own.any():
            yield i[own], j[own]
