"""Reading and writing meshes as OFF text, one mesh a line, and box rows as TAB-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udfs
from ..schema import MBB

#: TAB-separated columns of a box row.
BOX_SCHEMA = "mapper_id string, object_id long, dataset_id int, " + ", ".join(f"{c} double" for c in MBB) + ", offset long, length long"


def with_meshes(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """lines with ``mesh`` (null where the line is malformed) and its six box columns."""
    out = lines.withColumn("mesh", udfs.parse_off(F.col(line_col)))
    return out.withColumn("_box", udfs.mbb("mesh")).select("*", *(F.col(f"_box.{c}").alias(c) for c in MBB)).drop("_box")


def read_off_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(object_id, dataset_id, line): dataset ids 1, 2, … in the order of the paths. object_id is unique over all of
    them; it depends on how files are split for reading, so keep the rows (``SpatialEngine.compress`` does) before
    ids are used twice. Empty lines are skipped, a carriage return at a line's end is cut, and a last line without line
    end is read like any other."""
    parts = [spark.read.text(p).select(F.lit(n).alias("dataset_id"), F.rtrim(F.regexp_replace("value", r"\r$", "")).alias("line")) for n, p in enumerate(paths, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("line <> ''").select(F.monotonically_increasing_id().alias("object_id"), "dataset_id", "line")


def read_off_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, line) of OFF files, one mesh a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.translate("value", "\n", "|").alias("line"))


def write_off(meshes: DataFrame, path: str, mesh_col: str = "mesh", mode: str = "overwrite") -> None:
    meshes.select(udfs.to_off(mesh_col).alias("value")).where("value is not null").write.mode(mode).text(path)


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Box rows of TAB-separated text; rows with another number of fields, or with a box that is no number, are left out."""
    rows = spark.read.text(path).select(F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("f")).where(F.size("f") == 11)
    names = [c.split() for c in BOX_SCHEMA.split(", ")]
    return rows.select(*(F.expr(f"try_cast(f[{i}] as {kind})").alias(n) for i, (n, kind) in enumerate(names))).where(" and ".join(f"{c} is not null" for c in MBB))


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Tile table of text, a tile a line: id and six corners with white space between. Other lines are left out. The extent of
    a table, also of one line, is ``space_extent`` of it."""
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = spark.read.text(path).select(f.alias("f")).where(F.size("f") == 7)
    return rows.select(F.col("f")[0].alias("tile_id"), *(F.expr(f"try_cast(f[{k}] as double)").alias(c) for k, c in enumerate(MBB, 1))).where(" and ".join(f"{c} is not null" for c in MBB))


def write_tiles(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tile table as text that ``read_tiles`` reads."""
    tiles.select(F.concat_ws("\t", "tile_id", *(F.col(c).cast("string") for c in MBB)).alias("value")).write.mode(mode).text(path)


def write_boxes(boxes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Box rows as TAB-separated text; columns that are missing are written as empty fields."""
    names = [c.split() for c in BOX_SCHEMA.split(", ")]
    boxes.select(*((F.col(c) if c in boxes.columns else F.lit(None)).cast(kind).alias(c) for c, kind in names)).write.mode(mode).option("sep", "\t").csv(path)
