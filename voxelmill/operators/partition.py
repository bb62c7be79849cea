"""Space extents, bucket sizes and the partitioners that make tile tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import HIGH, LOW, MBB
from ..scratch import Scratch

#: Compressed bytes that one tile should hold.
TILE_BYTES = 16_000_000
TILE = "tile_id string, " + ", ".join(f"{c} double" for c in MBB)


def space_extent(boxes: DataFrame) -> DataFrame:
    """One row: n and the corners of all boxes; rows with a null corner do not count."""
    return boxes.where(" and ".join(f"{c} is not null" for c in MBB)).agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in LOW), *(F.max(c).alias(c) for c in HIGH))


def bucket_size(total_bytes: float, objects: int, rate: float = 1.0, tile_bytes: int = TILE_BYTES) -> int:
    """Objects a tile should hold: floor(tile_bytes / total_bytes * objects), at least 1; scaled by a sampling rate."""
    own = max(math.floor(tile_bytes / total_bytes * objects), 1) if total_bytes > 0 else 1
    return max(math.floor(own * rate), 1)


def bucket_size_frame(blobs: DataFrame, bytes_col: str, rate: float = 1.0, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """(objects, total_bytes, bucket_size) as one row, without leaving the engine."""
    own = f"greatest(cast(floor({tile_bytes}D / total_bytes * objects) as long), 1L)"
    return blobs.agg(F.count("*").alias("objects"), F.sum(bytes_col).alias("total_bytes")).selectExpr("objects", "total_bytes", f"greatest(cast(floor({own} * {rate}D) as long), 1L) as bucket_size")


def prefix_offsets(rows: DataFrame, length_col: str, order_col: str, span: int = 1 << 16) -> DataFrame:
    """rows with ``offset``: the sum of the lengths before them in the order of an integer column. Sums of ranges of
    ``span`` ids are added up first, so no task sees more than one range or the table of ranges."""
    part = F.floor(F.col(order_col) / span)
    keyed = rows.withColumn("_part", part)
    sums = keyed.groupBy("_part").agg(F.sum(length_col).alias("_sum"))
    bases = sums.selectExpr("_part", "sum(_sum) over (order by _part) - _sum as _base")
    inner = keyed.selectExpr("*", f"sum({length_col}) over (partition by _part order by {order_col}) - {length_col} as _inner")
    return inner.join(bases, "_part").withColumn("offset", F.col("_base") + F.col("_inner")).drop("_part", "_base", "_inner")


def grid_shape(spans: list[float], objects: int, bucket: int) -> tuple[int, int, int]:
    """Cells along x, y, z: about floor(objects / bucket) cells in all, as cubic as the spans allow."""
    p = max(objects // bucket, 1)
    cbrt = lambda v: math.ceil(round(v ** (1 / 3), 9))
    n = [1, 1, 1]
    if len(set(spans)) == 3 and min(spans) > 0:
        order = sorted(range(3), key=lambda k: -spans[k])
        for k in order[:2]:
            others = spans[(k + 1) % 3] * spans[(k + 2) % 3]
            n[k] = max(cbrt(p * spans[k] ** 2 / others), 1)
        n[order[2]] = max(math.ceil(p / (n[order[0]] * n[order[1]])), 1)
    else:
        n[0] = n[1] = max(cbrt(p), 1)
        n[2] = max(math.ceil(p / (n[0] * n[1])), 1)
    return tuple(n)


class Grid:
    """A uniform grid: low corner, cell widths and cell counts."""

    def __init__(self, low, high, shape):
        self.low, self.shape = list(low), tuple(shape)
        self.width = [(h - lo) / n if h > lo else 1.0 for lo, h, n in zip(low, high, shape, strict=True)]

    @classmethod
    def of(cls, extent_row, bucket: int | None = None, shape=None, objects: int | None = None) -> Grid:
        """A grid over an extent; over no boxes, one unit cell."""
        if extent_row[LOW[0]] is None:
            return cls([0.0] * 3, [1.0] * 3, (1, 1, 1))
        low, high = [extent_row[c] for c in LOW], [extent_row[c] for c in HIGH]
        shape = shape or grid_shape([h - lo for lo, h in zip(low, high, strict=True)], objects or extent_row["n"], bucket)
        return cls(low, high, shape)

    def tiles(self, spark: SparkSession) -> DataFrame:
        """(tile_id, six corners), numbered with z fastest; edges are ``i * width + low``."""
        nx, ny, nz = self.shape
        cells = spark.range(nx * ny * nz).selectExpr("id", f"id div {ny * nz} as i", f"id div {nz} % {ny} as j", f"id % {nz} as k")
        edge = lambda c, k, d: (F.col(c) + d) * F.lit(self.width[k]) + F.lit(float(self.low[k]))
        return cells.select(F.col("id").cast("string").alias("tile_id"), *(edge(c, k, 0).alias(LOW[k]) for k, c in enumerate("ijk")), *(edge(c, k, 1).alias(HIGH[k]) for k, c in enumerate("ijk")))


def octree_tiles(boxes: DataFrame, bucket: int, max_level: int = 10) -> DataFrame:
    """(tile_id, six corners, n): cells that more than ``bucket`` boxes touch are split at their middles, down to
    ``max_level``. Level by level, each an aggregate over the boxes in cells that still split; only the count of such
    cells reaches the driver. A box counts in every cell it touches. tile_id is ``OT`` and the path of octants."""
    spark, scratch = boxes.sparkSession, Scratch(boxes.sparkSession)
    ext = space_extent(boxes).first()
    if not ext["n"]:
        return spark.createDataFrame([], TILE + ", n long")
    low, span = [ext[c] for c in LOW], [ext[h] - ext[c] for c, h in zip(LOW, HIGH, strict=True)]
    corner = lambda ax, level, i: F.lit(low[ax]) + F.lit(span[ax]) * i / float(1 << level)
    live = boxes.select(*MBB).withColumns({"path": F.lit(""), "ix": F.lit(0).cast("long"), "iy": F.lit(0).cast("long"), "iz": F.lit(0).cast("long")})
    cells = spark.range(1).select(F.lit("").alias("path"), *(F.lit(0).cast("long").alias(c) for c in ("ix", "iy", "iz")))
    done = None
    for level in range(max_level + 1):
        counts = live.groupBy("path").agg(F.count("*").alias("n"))
        known = scratch.table(cells.join(counts, "path", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), f"cells{level}")
        split = (F.col("n") > bucket) & F.lit(level < max_level)
        named = [F.concat(F.lit("OT"), "path").alias("tile_id"), *(corner(k, level, F.col(c)).alias(LOW[k]) for k, c in enumerate(("ix", "iy", "iz"))), *(corner(k, level, F.col(c) + 1).alias(HIGH[k]) for k, c in enumerate(("ix", "iy", "iz"))), "n"]
        leaf = known.where(~split).select(*named)
        done = leaf if done is None else done.unionByName(leaf)
        parents = known.where(split).select("path", "ix", "iy", "iz")
        if not parents.take(1):
            break
        octant = F.explode(F.sequence(F.lit(0), F.lit(7))).alias("o")
        child = {"ix": "ix * 2 + o div 4", "iy": "iy * 2 + o div 2 % 2", "iz": "iz * 2 + o % 2"}
        cells = parents.select("*", octant).selectExpr("concat(path, o) as path", *(f"{e} as {c}" for c, e in child.items()))
        inside = " and ".join(f"low_{a} <= c_high_{a} and high_{a} >= c_low_{a}" for a in "xyz")
        rows = live.join(parents.select("path"), "path", "left_semi").select(*MBB, "path", "ix", "iy", "iz", octant).selectExpr(*MBB, "concat(path, o) as path", *(f"{e} as {c}" for c, e in child.items()))
        rows = rows.select("*", *(corner(k, level + 1, F.col(c)).alias(f"c_{LOW[k]}") for k, c in enumerate(("ix", "iy", "iz"))), *(corner(k, level + 1, F.col(c) + 1).alias(f"c_{HIGH[k]}") for k, c in enumerate(("ix", "iy", "iz"))))
        live = scratch.table(rows.where(inside).select(*MBB, "path", "ix", "iy", "iz"), f"live{level}")
        held = live.groupBy(F.substring("path", 1, level).alias("path")).agg(F.count("*").alias("held"))
        useless = scratch.table(known.where(split).join(held, "path").where("held >= 8 * n").drop("held"), f"useless{level}")
        if useless.take(1):
            done = done.unionByName(useless.select(*named))
            parent = useless.select(F.col("path").alias("_parent"))
            cells, live = (x.withColumn("_parent", F.substring("path", 1, level)).join(parent, "_parent", "left_anti").drop("_parent") for x in (cells, live))
    return done


def nested_tiles(outer: DataFrame, shape=(2, 2, 2)) -> DataFrame:
    """Each tile cut by a uniform grid of its own: two-step partitioning. Ids are ``outer.cell``."""
    nx, ny, nz = shape
    cells = outer.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(nx * ny * nz - 1)))).selectExpr("*", f"_c div {ny * nz} as _i", f"_c div {nz} % {ny} as _j", f"_c % {nz} as _k")
    edge = lambda k, c, d: F.col(LOW[k]) + (F.col(HIGH[k]) - F.col(LOW[k])) * (F.col(c) + d) / shape[k]
    return cells.select(F.concat_ws(".", "tile_id", "_c").alias("tile_id"), *(edge(k, c, 0).alias(LOW[k]) for k, c in enumerate(("_i", "_j", "_k"))), *(edge(k, c, 1).alias(HIGH[k]) for k, c in enumerate(("_i", "_j", "_k"))))


def normalize(boxes: DataFrame, extent_row, back: bool = False) -> DataFrame:
    """Corners scaled to the unit cube of an extent, or back."""
    if extent_row[LOW[0]] is None:  # an extent of no boxes
        return boxes
    out = {}
    for k in range(3):
        lo, w = extent_row[LOW[k]], (extent_row[HIGH[k]] - extent_row[LOW[k]]) or 1.0
        for c in (LOW[k], HIGH[k]):
            out[c] = F.col(c) * w + lo if back else (F.col(c) - lo) / w
    return boxes.withColumns(out)


def tile_stats(tiles: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row on skew: tiles, their volume in all, and mean, least, most and spread of the objects in a tile."""
    counts = assigned.groupBy("tile_id").agg(F.count("*").alias("objects"))
    rows = tiles.join(counts, "tile_id", "left").withColumn("objects", F.coalesce("objects", F.lit(0)))
    volume = F.expr(" * ".join(f"({h} - {lo})" for lo, h in zip(LOW, HIGH, strict=True)))
    return rows.agg(F.count("*").alias("tiles"), F.sum(volume).alias("volume"), F.avg("objects").alias("mean"), F.min("objects").alias("least"), F.max("objects").alias("most"), F.stddev_pop("objects").alias("spread"))


def sample(rows: DataFrame, rate: float, id_col: str | None = None, seed: int = 1) -> DataFrame:
    """Bernoulli sample; by an id's hash, the same rows every time, where ``id_col`` is given. Rates lie in (0, 1]."""
    if not 0 < rate <= 1:
        raise ValueError("a sampling rate lies in (0, 1]")
    if id_col is None:
        return rows if rate == 1 else rows.sample(rate, seed)
    return rows.where(F.pmod(F.col(id_col) * 2654435761, F.lit(1_000_000)) < int(rate * 1_000_000))
