"""Column names and types of the spatial relations."""

from pyspark.sql import types as T

LOW = ["low_x", "low_y", "low_z"]
HIGH = ["high_x", "high_y", "high_z"]
MBB = LOW + HIGH
POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
MESH = T.StructType([T.StructField("vertices", T.ArrayType(POINT)), T.StructField("faces", T.ArrayType(T.ArrayType(T.IntegerType())))])
BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in MBB])
#: Names a join accepts, in the order of their numbers.
PREDICATES = (
    "st_intersects", "st_touches", "st_crosses", "st_contains", "st_adjacent", "st_disjoint", "st_equals",
    "st_dwithin", "st_within", "st_overlaps", "st_nearest", "st_nearest2", "st_nn_voronoi", "st_nn_rtree",
)
