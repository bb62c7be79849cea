"""Spatial joins: tiles, candidate pairs, then exact geometry on the pairs alone.

Boxes are cut over grid cells by arithmetic and meet in an equi-join on the cell; the reference point of a pair
(the larger low corner) decides the one cell that reports it, so there is nothing to deduplicate. Geometry stays
out of that shuffle. Exact tests run where the meshes of both sides of a cell meet (``cells``); compressed meshes are fetched by
id for surviving pairs. Joins of tables that grow with the input merge: Catalyst takes them for small, as it knows Parquet's
bytes and not the rows that cells and columns make of them, and would broadcast them through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as types

from ..functions import solids as S
from ..functions import udfs
from ..schema import HIGH, LOW, MBB
from ..scratch import Scratch
from . import cells
from .partition import Grid, grid_shape, space_extent
from .tiling import assign_grid, assign_tiles, overlap, reference_cell

#: Condition on the boxes (prefixes a_, b_) that any pair must meet for a predicate.
FILTER = {
    "st_contains": " and ".join(f"a_{lo} <= b_{lo} and b_{h} <= a_{h}" for lo, h in zip(LOW, HIGH, strict=True)),
    "st_within": " and ".join(f"b_{lo} <= a_{lo} and a_{h} <= b_{h}" for lo, h in zip(LOW, HIGH, strict=True)),
    "st_equals": " and ".join(f"abs(a_{c} - b_{c}) <= 1e-9 * (1 + abs(a_{c}))" for c in MBB),
}


def default_grid(a: DataFrame, b: DataFrame, per_cell: int = 64) -> Grid:
    """A grid over both inputs with about ``per_cell`` boxes a cell, but no cell smaller than the mean box."""
    both = a.select(*MBB).unionByName(b.select(*MBB))
    row = both.agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in LOW), *(F.max(c).alias(c) for c in HIGH), *(F.avg(F.col(h) - F.col(lo)).alias(f"mean_{lo[-1]}") for lo, h in zip(LOW, HIGH, strict=True))).first()
    if not row["n"]:
        return Grid([0.0] * 3, [1.0] * 3, (1, 1, 1))
    spans = [row[h] - row[lo] for lo, h in zip(LOW, HIGH, strict=True)]
    shape = grid_shape(spans, row["n"], per_cell)
    fit = [max(1, int(s / m)) if m and m > 0 else n for s, m, n in zip(spans, (row["mean_x"], row["mean_y"], row["mean_z"]), shape, strict=True)]
    return Grid.of(row, shape=tuple(min(n, f) for n, f in zip(shape, fit, strict=True)))


def candidates(a: DataFrame, b: DataFrame, grid: Grid | None = None, expand: float = 0.0) -> DataFrame:
    """(id1, id2, boxes a_*, b_*) of pairs whose boxes meet, a's grown by ``expand``; each pair once."""
    if expand:
        a = a.withColumns({c: F.col(c) - expand for c in LOW} | {c: F.col(c) + expand for c in HIGH})
    a, b = (x.select("object_id", *MBB).where(" and ".join(f"{c} is not null" for c in MBB)) for x in (a, b))
    grid = grid or default_grid(a, b)
    left = assign_grid(a, grid).select("cell", F.col("object_id").alias("id1"), *(F.col(c).alias(f"a_{c}") for c in MBB))
    right = assign_grid(b, grid).select("cell", F.col("object_id").alias("id2"), *(F.col(c).alias(f"b_{c}") for c in MBB))
    pairs = left.hint("merge").join(right, "cell").where(overlap("a_", "b_"))
    return pairs.where(F.col("cell") == reference_cell(grid, [F.greatest(f"a_{c}", f"b_{c}") for c in LOW]))


def tile_candidates(a: DataFrame, b: DataFrame, tiles: DataFrame, expand: float = 0.0) -> DataFrame:
    """As ``candidates``, over the tiles of a partitioner's table instead of a grid of its own.

    The tiles must fill their extent without gaps or overlaps, as those of a grid or an octree do. Boxes beyond the
    extent (of a sample, say) belong to the tiles at its border. A pair is reported by the tile of its reference point:
    low edges belong to a tile, high edges only at the border. A table without tiles leaves it to ``candidates``."""
    ext = space_extent(tiles).first()
    if not ext["n"]:
        return candidates(a, b, expand=expand)
    if expand:
        a = a.withColumns({c: F.col(c) - expand for c in LOW} | {c: F.col(c) + expand for c in HIGH})
    inner = {c: F.least(F.greatest(F.col(c), F.lit(ext[f"low_{c[-1]}"])), F.lit(ext[f"high_{c[-1]}"])) for c in MBB}

    def cut(side, n, p, corners):
        rows = side.where(" and ".join(f"{c} is not null" for c in MBB)).select(F.col("object_id").alias(f"id{n}"), *(F.col(c).alias(f"{p}_{c}") for c in MBB), *(inner[c].alias(c) for c in MBB))
        rows = assign_tiles(rows, tiles, corners=corners)
        return rows.select(*(c for c in rows.columns if c not in HIGH and c not in LOW), *(F.col(c).alias(f"{p}in_{c}") for c in LOW))

    pairs = cut(a, 1, "a", True).hint("merge").join(cut(b, 2, "b", False), "tile_id").where(overlap("a_", "b_"))
    for lo, h in zip(LOW, HIGH, strict=True):
        point = F.greatest(f"ain_{lo}", f"bin_{lo}")
        pairs = pairs.where((point >= F.col(f"t_{lo}")) & ((point < F.col(f"t_{h}")) | (F.col(f"t_{h}") >= ext[h])))
    return pairs.select("id1", "id2", *(f"{p}_{c}" for p in "ab" for c in MBB))


def with_meshes(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs(id1, id2, …) with mesh1 and mesh2 as bytes, fetched by id. The exact tests that follow cost far more than moving
    a pair, so pairs are dealt out once more: by both ids, which spreads objects with many pairs, and in a given number of
    partitions, which adaptive execution does not merge by their bytes.

    A side has meshes in ``mesh``, or compressed ones in ``blob`` with a level of detail ``lod``; of the latter only those
    with a pair are decoded, each once."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if any("mesh" not in side.columns for side in (a, b)):
        pairs = Scratch(pairs.sparkSession).table(pairs, "pairs")
    met = pairs
    for n, side in ((1, a), (2, b)):
        key = F.col("object_id").alias(f"id{n}")
        if "mesh" in side.columns:
            own = side.where("mesh is not null").select(key, udfs.pack("mesh").alias(f"mesh{n}"))
        else:  # no test for null here: Catalyst would move it, and the decoding, before the semi-join
            own = side.select(key, "blob", "lod").hint("merge").join(met.select(f"id{n}"), f"id{n}", "left_semi").select(f"id{n}", udfs.pack(udfs.decode("blob", "lod")).alias(f"mesh{n}"))
        pairs = pairs.hint("merge").join(own, f"id{n}")
    return pairs.repartition(4 * parts, "id1", "id2")


def spatial_join(a: DataFrame, b: DataFrame, predicate: str = "st_intersects", distance: float | None = None, solid: bool = False, grid: Grid | None = None, volumes: bool = False, tiles: DataFrame | None = None) -> DataFrame:
    """(id1, id2 [, vol1, vol2, vol_intersection]) of the pairs for which a predicate of two solids holds.

    ``st_intersects`` is about surfaces; with ``solid`` a solid inside another intersects it too. ``st_disjoint`` gives
    the complement of all pairs (``disjoint_pairs``); ``disjoint_counts`` sums it up without making them. ``tiles``: a
    partitioner's table to join over (``tile_candidates``). Null or unreadable meshes match nothing.
    """
    if predicate == "st_dwithin" and not (distance and distance > 0):
        raise ValueError("st_dwithin takes a distance above 0")
    if predicate == "st_disjoint":
        return disjoint_pairs(a, b, grid)
    if all("mesh" in side.columns for side in (a, b)):
        return solid_pairs(a, b, predicate, distance or 0.0, solid, grid, volumes, tiles)
    pairs = candidates(a, b, grid, distance or 0.0) if tiles is None else tile_candidates(a, b, tiles, distance or 0.0)
    if predicate in FILTER:
        pairs = pairs.where(FILTER[predicate])
    rows = with_meshes(pairs.select("id1", "id2"), a, b)
    # marked as nondeterministic, or Catalyst moves the test below the exchange, into the few tasks of the join
    rows = rows.where(udfs.predicate(predicate, distance or 0.0, solid).asNondeterministic()("mesh1", "mesh2"))
    if volumes:
        return rows.select("id1", "id2", udfs.volume("mesh1").alias("vol1"), udfs.volume("mesh2").alias("vol2"), udfs.intersection_volume("mesh1", "mesh2").alias("vol_intersection"))
    return rows.select("id1", "id2")


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``FILTER`` of equal solids on pairs of boxes."""
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    return (np.abs(a - b) <= 1e-9 * (1 + np.abs(a))).all(axis=0)


def solid_pairs(a: DataFrame, b: DataFrame, predicate: str, distance: float = 0.0, solid: bool = False, grid: Grid | None = None, volumes: bool = False, tiles: DataFrame | None = None, counts: bool = False) -> DataFrame:
    """``spatial_join`` of sides with meshes, cell by cell; with ``counts`` (id1, n) instead: the pairs of an object in a cell, a
    row for each cell that it has some in."""
    ext = None if tiles is None else space_extent(tiles).first()
    left, right = cells.packed(a, "id1"), cells.packed(b, "id2")
    if distance:
        left = left.withColumns({c: F.col(c) - distance for c in LOW} | {c: F.col(c) + distance for c in HIGH})
    if ext is None or not ext["n"]:
        grid = grid or default_grid(left, right, 512)
        left, right = cells.on_grid(left, grid), cells.on_grid(right, grid)
    else:
        left, right = cells.on_tiles(left, tiles, ext), cells.on_tiles(right, tiles, ext)
    # the larger low corner is that of the solid that lies in the other, which therefore has all its pairs in one cell
    if predicate == "st_contains":
        right = right.where("_from = 7")
    elif predicate == "st_within":
        left = left.where("_from = 7")
    fields = [left.schema["id1"], types.StructField("n", types.LongType()) if counts else right.schema["id2"]]
    if volumes:
        fields += [types.StructField(c, types.DoubleType()) for c in ("vol1", "vol2", "vol_intersection")]
    step, sweep = 1 << 18, {"st_contains": S.holding, "st_within": S.held}.get(predicate, S.meeting)

    def fitting(x, y, boxes1, boxes2, one, two):
        """Pairs that a predicate's boxes allow; few of many sweeps are put together, as a call for each costs more than they do."""
        some, n = [], 0
        for i, j in cells.own_pairs(x, y, boxes1, boxes2, one.usable, two.usable, sweep):
            if predicate == "st_equals":
                fit = _fits(boxes1[i], boxes2[j])
                i, j = i[fit], j[fit]
            some.append((i, j))
            n += len(i)
            if n >= step:
                yield tuple(np.concatenate(c) for c in zip(*some, strict=True))
                some, n = [], 0
        if n:
            yield tuple(np.concatenate(c) for c in zip(*some, strict=True))

    def test(x: pa.Table, y: pa.Table) -> pa.Table:
        out, n = [], np.zeros(x.num_rows, np.int64)
        if x.num_rows and y.num_rows:
            boxes1, boxes2 = cells.matrix(x, MBB), cells.matrix(y, MBB)
            one, two = S.Solids(x["mesh"]), S.Solids(y["mesh"])
            for p, q in fitting(x, y, boxes1, boxes2, one, two):
                for at in range(0, len(p), step):
                    i, j = p[at : at + step], q[at : at + step]
                    hit = S.holds(predicate, one, two, i, j, distance, solid)
                    i, j = i[hit], j[hit]
                    if counts:
                        n += np.bincount(i, minlength=len(n))
                    else:
                        out.append((i, j, *(S.volumes(one, two, i, j) if volumes else ())))
        if counts:
            some = np.flatnonzero(n)
            return pa.table({"id1": x["id1"].take(pa.array(some)), "n": pa.array(n[some])})
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 2 + [np.empty(0)] * (len(fields) - 2)
        return pa.table({"id1": x["id1"].take(pa.array(columns[0])), "id2": y["id2"].take(pa.array(columns[1]))} | {f.name: pa.array(c) for f, c in zip(fields[2:], columns[2:], strict=True)})

    return cells.cell_by_cell(left, right, test, types.StructType(fields))


def disjoint_pairs(a: DataFrame, b: DataFrame, grid: Grid | None = None) -> DataFrame:
    """(id1, id2) of all pairs with no point in common. The result is about as large as both counts multiplied: each
    object of a takes the whole id list of b in blocks of 1,024 without those that it meets."""
    parts = max(1, b.count() // 1024)
    block = F.pmod(F.xxhash64("id2"), F.lit(parts))
    met = spatial_join(a, b, "st_intersects", solid=True, grid=grid).withColumn("block", block).groupBy("id1", "block").agg(F.collect_list("id2").alias("met"))
    lists = b.where("mesh is not null").select(F.col("object_id").alias("id2")).withColumn("block", block).groupBy("block").agg(F.collect_list("id2").alias("ids"))
    blocks = a.where("mesh is not null").select(F.col("object_id").alias("id1"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("block"))
    rows = blocks.hint("merge").join(lists, "block").hint("merge").join(met, ["id1", "block"], "left")
    return rows.select("id1", F.explode(F.array_except("ids", F.coalesce("met", F.array().cast("array<long>")))).alias("id2"))


def disjoint_counts(a: DataFrame, b: DataFrame, grid: Grid | None = None) -> DataFrame:
    """(id1, n_disjoint): for each object of a, how many of b it has no point in common with."""
    if all("mesh" in side.columns for side in (a, b)):  # pairs are counted where they are found
        near = solid_pairs(a, b, "st_intersects", solid=True, grid=grid, counts=True).groupBy("id1").agg(F.sum("n").alias("n"))
    else:
        near = spatial_join(a, b, "st_intersects", solid=True, grid=grid).groupBy("id1").agg(F.count("*").alias("n"))
    rows = a.select(F.col("object_id").alias("id1")).hint("merge").join(near, "id1", "left")
    return rows.select("id1", (F.lit(b.count()) - F.coalesce("n", F.lit(0))).cast("long").alias("n_disjoint"))


def pairs_per_tile(a: DataFrame, b: DataFrame, grid: Grid) -> DataFrame:
    """(tile_id, n1, n2, pairs): objects of either side and pairs of meeting boxes in each cell that has both sides."""
    left = assign_grid(a.select("object_id", *MBB), grid)
    right = assign_grid(b.select("object_id", *MBB), grid)
    n = left.groupBy("cell").agg(F.count("*").alias("n1")).hint("merge").join(right.groupBy("cell").agg(F.count("*").alias("n2")), "cell")
    x = left.select("cell", *(F.col(c).alias(f"a_{c}") for c in MBB))
    y = right.select("cell", *(F.col(c).alias(f"b_{c}") for c in MBB))
    hits = x.hint("merge").join(y, "cell").where(overlap("a_", "b_")).groupBy("cell").agg(F.count("*").alias("pairs"))
    return n.hint("merge").join(hits, "cell", "left").select(F.col("cell").cast("string").alias("tile_id"), "n1", "n2", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def distinct_pairs(pairs: DataFrame) -> DataFrame:
    """Duplicate removal for pairs from any tiling."""
    return pairs.dropDuplicates(["id1", "id2"])


__all__ = ["candidates", "default_grid", "disjoint_counts", "distinct_pairs", "pairs_per_tile", "space_extent", "solid_pairs", "spatial_join", "tile_candidates", "with_meshes"]
