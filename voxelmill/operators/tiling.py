"""Assigning boxes to tiles, and the rule that reports a pair in one tile only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import HIGH, LOW, MBB
from .partition import Grid


def overlap(a: str, b: str) -> str:
    """SQL: closed boxes with these column prefixes meet."""
    return " and ".join(f"{a}{lo} <= {b}{h} and {b}{lo} <= {a}{h}" for lo, h in zip(LOW, HIGH, strict=True))


def grow(boxes: DataFrame, by: float) -> DataFrame:
    """Boxes grown on every side; the boxes as they were stay in columns ``own_*``."""
    return boxes.select("*", *(F.col(c).alias(f"own_{c}") for c in MBB)).withColumns({c: F.col(c) - by for c in LOW} | {c: F.col(c) + by for c in HIGH})


def centers(boxes: DataFrame) -> DataFrame:
    return boxes.select("*", *(((F.col(lo) + F.col(h)) / 2).alias(f"c{lo[-1]}") for lo, h in zip(LOW, HIGH, strict=True)))


def axis_cells(grid: Grid, k: int, lo: Column, hi: Column) -> Column:
    """Cells along an axis whose closed interval [i*w+low, (i+1)*w+low] meets [lo, hi]; ends clamp to the grid, so no
    box is lost. The quotient is corrected by the edges themselves, which decide."""
    low, w, n = F.lit(float(grid.low[k])), F.lit(float(grid.width[k])), grid.shape[k]
    last = F.lit(n - 1).cast("long")
    clamp = lambda c: F.greatest(F.lit(0).cast("long"), F.least(last, c.cast("long")))
    first = F.floor((lo - low) / w)
    first = F.when((first - 1 + 1) * w + low >= lo, first - 1).when((first + 1) * w + low < lo, first + 1).otherwise(first)
    final = F.floor((hi - low) / w)
    final = F.when((final + 1) * w + low <= hi, final + 1).when(final * w + low > hi, final - 1).otherwise(final)
    return F.sequence(clamp(first), F.greatest(clamp(first), clamp(final)))


def assign_grid(boxes: DataFrame, grid: Grid) -> DataFrame:
    """A row per box and grid cell it touches, with ``cell`` (the number of Grid.tiles). No join: arithmetic and explode."""
    out = boxes
    for k, name in enumerate(("_i", "_j", "_k")):
        out = out.withColumn(name, F.explode(axis_cells(grid, k, F.col(LOW[k]), F.col(HIGH[k]))))
    _, ny, nz = grid.shape
    return out.withColumn("cell", (F.col("_i") * ny + F.col("_j")) * nz + F.col("_k")).drop("_i", "_j", "_k")


def diagonals(boxes: DataFrame) -> DataFrame:
    """boxes with ``diagonal``, the length from corner to corner."""
    return boxes.withColumn("diagonal", F.sqrt(F.expr(" + ".join(f"({h} - {lo}) * ({h} - {lo})" for lo, h in zip(LOW, HIGH, strict=True)))))


def assign_tiles(boxes: DataFrame, tiles: DataFrame, max_broadcast: int = 1000, corners: bool = False) -> DataFrame:
    """A row per box and tile of any tile table that it touches, with the tile's ``corners`` (``t_*``) on request. A table of
    at most ``max_broadcast`` tiles is broadcast and compared in full; a larger one meets the boxes through a grid with
    about as many cells as tiles."""
    t = tiles.select("tile_id", *(F.col(c).alias(f"t_{c}") for c in MBB))
    n = tiles.count()
    away = () if corners else tuple(f"t_{c}" for c in MBB)
    if n <= max_broadcast:
        return boxes.join(F.broadcast(t), F.expr(overlap("", "t_"))).drop(*away)
    from .partition import space_extent

    grid = Grid.of(space_extent(tiles).first(), bucket=1, objects=n)
    both = assign_grid(boxes, grid).join(assign_grid(tiles, grid).select("cell", "tile_id", *(F.col(c).alias(f"t_{c}") for c in MBB)), "cell")
    ref = reference_cell(grid, [F.greatest(F.col(c), F.col(f"t_{c}")) for c in LOW])
    return both.where(F.expr(overlap("", "t_")) & (F.col("cell") == ref)).drop("cell", *away)


def reference_cell(grid: Grid, point: list[Column]) -> Column:
    """The one cell that a point belongs to: half-open cells, the last closed, outside points clamped."""
    out = F.lit(0).cast("long")
    for k in range(3):
        out = out * grid.shape[k] + axis_reference(grid, k, point[k])
    return out


def axis_reference(grid: Grid, k: int, at: Column) -> Column:
    """The number along an axis of the cell that a coordinate belongs to."""
    low, w = F.lit(float(grid.low[k])), F.lit(float(grid.width[k]))
    i = F.floor((at - low) / w)
    i = F.when((i + 1) * w + low <= at, i + 1).when(i * w + low > at, i - 1).otherwise(i)
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(grid.shape[k] - 1).cast("long"), i.cast("long")))
