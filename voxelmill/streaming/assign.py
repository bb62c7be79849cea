"""Tile assignment and joins with a static side on streams: both are stateless, so they run on readStream as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.partition import Grid
from ..operators.tiling import assign_grid, overlap, reference_cell
from ..schema import LOW, MBB


def assign_stream(boxes: DataFrame, grid: Grid) -> DataFrame:
    """A row per arriving box and grid cell it touches."""
    return assign_grid(boxes, grid)


def join_static(boxes: DataFrame, static: DataFrame, grid: Grid) -> DataFrame:
    """(id1, id2) of arriving boxes that meet boxes of a static table, each pair once."""
    left = assign_grid(boxes, grid).select("cell", F.col("object_id").alias("id1"), *(F.col(c).alias(f"a_{c}") for c in MBB))
    right = assign_grid(static, grid).select("cell", F.col("object_id").alias("id2"), *(F.col(c).alias(f"b_{c}") for c in MBB))
    pairs = left.join(right, "cell").where(overlap("a_", "b_"))
    return pairs.where(F.col("cell") == reference_cell(grid, [F.greatest(f"a_{c}", f"b_{c}") for c in LOW])).select("id1", "id2")
