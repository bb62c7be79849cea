"""Dropping rows by a verdict on their texts, in one pass and without a join."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices


def keep_where(docs: DataFrame, make_judge: Callable[[], Callable[[list], list]], text_col: str = "text", max_rows: int = 500, max_bytes: int = 4 << 20) -> DataFrame:
    """The rows of docs whose text is judged true, columns as they are. ``make_judge`` runs once in each task and
    gives a function from texts (or None) to booleans."""
    judged = docs.withColumn("__text", F.col(text_col).cast("string"))

    def run(batches):
        judge = make_judge()
        for batch in batches:
            for part in slices(batch, max_rows, max_bytes):
                kept = part.filter(pa.array(judge(part.column(part.num_columns - 1).to_pylist()), pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], schema=pa.schema(list(part.schema)[:-1]))

    return judged.mapInArrow(run, docs.schema)


def without_ids(docs: DataFrame, ids: DataFrame, id_col: str, bits: int = 1 << 23) -> DataFrame:
    """docs without the rows whose integer id is in ``ids`` (one column of that name); rows without an id stay.

    A bitmap of fixed size (1 MB) over the ids lets most rows pass as they are; only rows whose bit is set are shuffled
    for the exact anti-join, so texts that stay do not travel. ``ids`` is read twice."""
    rest, near = _sides(docs, ids, id_col, bits)
    return rest.unionByName(near.join(ids, id_col, "left_anti").select(docs.columns))


def with_ids(docs: DataFrame, ids: DataFrame, id_col: str, bits: int = 1 << 23) -> DataFrame:
    """The rows of docs whose integer id is in ``ids``; of the others few travel."""
    return _sides(docs, ids, id_col, bits)[1].join(ids, id_col, "left_semi").select(docs.columns)


def _sides(docs: DataFrame, ids: DataFrame, id_col: str, bits: int) -> tuple[DataFrame, DataFrame]:
    from .ngram_join import bitmap

    spark = docs.sparkSession
    wanted = spark.sparkContext.broadcast(bitmap(ids.where(f"{id_col} is not null").select(F.col(id_col).cast("long").bitwiseAND(F.lit(bits - 1)).alias("bit")), bits))
    at = docs.columns.index(id_col)

    def side(hit: bool):
        def run(batches):
            seen = wanted.value
            for batch in batches:
                bit = batch.column(at).cast(pa.int64()).fill_null(0).to_numpy() & (bits - 1)
                on = ((seen[bit >> 3] >> (bit & 7)) & 1).astype(bool) & batch.column(at).is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(on if hit else ~on))

        return docs.mapInArrow(run, docs.schema)

    return side(False), side(True)


def sampled(rows: DataFrame, id_col: str, max_rows: int, max_bytes: int, text_col: str = "text", only: Callable[[DataFrame], DataFrame] | None = None) -> pa.Table:
    """On the driver: the rows that come first by a hash of their id, at most ``max_rows`` and, but for the first, at most
    ``max_bytes`` of text together; whole texts, repeated rows once. Only ids, hashes and sizes are sorted, and only they
    meet what ``only`` joins them with."""
    spark = rows.sparkSession
    slim = rows.select(id_col, F.xxhash64(text_col).alias("__hash"), F.octet_length(text_col).alias("__bytes"))
    each = (only(slim) if only else slim).groupBy(id_col, "__hash").agg(F.max("__bytes").alias("__bytes"))
    first = each.orderBy(F.xxhash64(id_col), id_col, "__hash").limit(max_rows).toArrow()
    size = np.cumsum(first["__bytes"].to_numpy())
    first = first.slice(0, max(1, int(np.searchsorted(size, max_bytes, "right")))).drop_columns(["__bytes"])
    if not first.num_rows:
        return rows.limit(0).toArrow()
    chosen = spark.createDataFrame(first, schema=each.drop("__bytes").schema)  # max_rows rows of 16 bytes
    got = rows.withColumn("__hash", F.xxhash64(text_col)).join(F.broadcast(chosen), [id_col, "__hash"]).dropDuplicates([id_col, "__hash"])
    return got.drop("__hash").toArrow().sort_by([(id_col, "ascending"), (text_col, "ascending")])
