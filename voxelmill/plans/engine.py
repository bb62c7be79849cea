"""The verbs as one object: compress, partition, join, duplicate removal."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators import join as J
from ..operators import nn as N
from ..operators import partition as P
from ..operators import tiling as T
from ..schema import MBB, PREDICATES
from ..scratch import Scratch
from ..sources import off

PARTITIONERS = ("fg_3d", "ot_3d")


class SpatialEngine:
    """Keeps results as Parquet under ``out`` with the suffixes _mbb, _partidx and _joinout. ``counters`` holds, by suffix, what
    the last run counted on its way: rows written, and objects read, kept and bad or sampled."""

    def __init__(self, spark: SparkSession, out: str, overwrite: bool = True):
        self.spark, self.out, self.mode = spark, out, "overwrite" if overwrite else "errorifexists"
        self.counters: dict[str, dict[str, int]] = {}
        udfs.register(spark)

    def _keep(self, df: DataFrame, suffix: str, seen: Observation | None = None) -> DataFrame:
        own = Observation()
        df.observe(own, F.count(F.lit(1)).alias("rows")).write.mode(self.mode).parquet(self.out + suffix)
        self.counters[suffix] = self.counters.pop("_next", {}) | (seen.get if seen else {}) | own.get
        return self.spark.read.parquet(self.out + suffix)

    def compress(self, input_a: str, input_b: str | None) -> DataFrame:
        """Reads OFF lines of one or two inputs; rows of object_id, dataset_id, box and compressed mesh. Unreadable or
        invalid meshes are left out; ``quarantine`` gives them with their reasons."""
        if not input_a or not input_b:
            raise ValueError("compress takes both inputs")
        rows = off.with_meshes(off.read_off_lines(self.spark, input_a, input_b))
        seen = Observation()
        rows = rows.withColumn("v", udfs.is_valid("mesh")).observe(seen, F.count(F.lit(1)).alias("read"), F.count_if("v.valid").alias("kept"), F.count_if(~F.col("v.valid")).alias("bad"))
        return self._keep(rows.where("v.valid").select("object_id", "dataset_id", *MBB, udfs.encode("mesh").alias("blob")), "_mbb", seen)

    def quarantine(self, *inputs: str) -> DataFrame:
        rows = off.with_meshes(off.read_off_lines(self.spark, *inputs)).withColumn("v", udfs.is_valid("mesh"))
        return rows.where("not v.valid").select("object_id", "dataset_id", "line", F.col("v.reason").alias("reason"))

    def objects(self, lod: float = 100) -> DataFrame:
        """Compressed objects with their meshes at a level of detail in (0, 100]."""
        if not 0 < lod <= 100:
            raise ValueError("a level of detail lies in (0, 100]")
        return self.spark.read.parquet(self.out + "_mbb").withColumn("mesh", udfs.decode("blob", F.lit(float(lod))))

    def partition(self, partitioner: str = "fg_3d", bucket: int = -1, sampling: float = 1.0) -> DataFrame:
        """Tile table; bucket -1: as many objects as make a tile of 16 MB of compressed meshes."""
        if partitioner not in PARTITIONERS:
            raise ValueError(f"unknown partitioner {partitioner}")
        rows = self.spark.read.parquet(self.out + "_mbb")
        size = rows.agg(F.count("*").alias("n"), F.sum(F.length("blob")).alias("bytes")).first()
        own = bucket if bucket > 0 else P.bucket_size(size["bytes"] or 0, size["n"], sampling)
        if partitioner == "ot_3d":
            some = rows.select(*MBB)
            if sampling < 1:  # kept, as every level reads it
                seen = Observation()
                some = Scratch(self.spark).table(P.sample(some, sampling).observe(seen, F.count(F.lit(1)).alias("sampled")), "sample")
                self.counters["_next"] = seen.get | {"read": size["n"]}
            tiles = P.octree_tiles(some, own).drop("n")
        else:
            ext = P.space_extent(rows).first()
            tiles = P.Grid.of(ext, own, objects=int(ext["n"] * sampling)).tiles(self.spark)
        return self._keep(tiles, "_partidx")

    def tiles(self) -> DataFrame | None:
        """The tile table of the last ``partition``, if there is one."""
        try:
            return self.spark.read.parquet(self.out + "_partidx")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def join(self, predicate: str, distance: float | None = None, k: int = 1, lod: float = 100, solid: bool = False, volumes: bool = False) -> DataFrame:
        """Joins dataset 1 with dataset 2 under any predicate of ``PREDICATES``. Predicates of pairs go over the tiles of
        ``partition`` where it has run, and decode only objects whose boxes meet; nearest neighbours, which reach beyond
        tiles, and ``st_disjoint`` use grids of their own."""
        if predicate not in PREDICATES:
            raise ValueError(f"unknown predicate {predicate}")
        rows = self.objects(lod)
        late = rows.drop("mesh").withColumn("lod", F.lit(float(lod)))
        a, b = rows.where("dataset_id = 1"), rows.where("dataset_id = 2")
        if predicate == "st_nn_rtree":
            got = N.nn_surface(a, b)
        elif predicate == "st_nn_voronoi":
            got = N.nn_voronoi(a, b)
        elif predicate in ("st_nearest", "st_nearest2"):
            got = N.st_nearest(a, b, k, distance if predicate == "st_nearest" else None)
        elif predicate == "st_disjoint":
            got = J.spatial_join(a, b, predicate)
        else:
            got = J.spatial_join(late.where("dataset_id = 1"), late.where("dataset_id = 2"), predicate, distance, solid, volumes=volumes, tiles=self.tiles())
        return self._keep(got, "_joinout")

    def duplicate_removal(self, pairs: DataFrame) -> DataFrame:
        return J.distinct_pairs(pairs)

    def tile_statistics(self) -> DataFrame:
        tiles = self.spark.read.parquet(self.out + "_partidx")
        return P.tile_stats(tiles, T.assign_tiles(self.spark.read.parquet(self.out + "_mbb").select("object_id", *MBB), tiles))
