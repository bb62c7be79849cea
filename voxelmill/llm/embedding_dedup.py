"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Every vector is projected on ``projections`` random lines. For a query vector, another collides on a line when it
lies within the query-centred window of half-width w. For a pair at the threshold cosine the difference of its
unit vectors has length d = sqrt(2 - 2 cos), so a collision has probability p = erf(w / (d sqrt 2)), independently
for each Gaussian line: the least count that keeps the wanted recall follows from the binomial tail. Pairs with
that many collisions are verified by their exact cosine in double precision.

Equal vectors of a label are one class: only one representative of each is compared, weighted by its size, and
every row finds its class again at the end. Each group (label, dimension) is cut along the first line into blocks
of at most ``block_rows`` classes, and only blocks whose intervals come within reach (the window that holds a pair
at the threshold with probability ``1 - (1 - recall) / 10``) meet. A task holds two blocks, whatever the size of a
label. It sorts every line of the one block and looks up the windows of the other's vectors there, so only
collisions are touched; the pairs leave it as counts and a spanning set of links, never as pairs.

A window on one line holds a fixed share of spread vectors, so work grows with the square of a label's different
vectors, divided over tasks of bounded memory.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import Scratch


def calibrate(threshold: float, projections: int, recall: float, width: float = 1.0) -> tuple[float, int, float]:
    """(half-width of a window, least number of collisions, reach along the sorted projection)."""
    d = math.sqrt(max(2 - 2 * threshold, 1e-12))
    p = math.erf(width / math.sqrt(2))
    tail, least = 0.0, projections
    for k in range(projections, -1, -1):
        tail += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if tail >= 1 - (1 - recall) * 0.9:
            least = k
            break
    z = 1.0
    while math.erf(z / math.sqrt(2)) < 1 - (1 - recall) / 10:
        z += 0.01
    return width * d, least, z * d


@functools.lru_cache(maxsize=16)
def lines(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, projections))


def _project(seed: int, projections: int):
    def run(batches):
        for batch in batches:
            ids, labels, dims, first, packed, keys = [], [], [], [], [], []
            for vec, emb, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if label is None or vec is None or not emb or any(v is None for v in emb):
                    continue
                v = np.array(emb, np.float64)
                top = np.abs(v).max()
                if not math.isfinite(top) or top == 0:
                    continue
                v = v / top + 0.0  # no square overflows or vanishes; -0.0 becomes 0.0
                v /= math.sqrt(float(v @ v))
                ids.append(vec)
                labels.append(label)
                dims.append(len(v))
                first.append(float(v @ lines(len(v), projections, seed)[:, 0]))
                packed.append(v.tobytes())
                name = label.encode("utf-8", "surrogatepass")
                keys.append(hashlib.blake2b(len(name).to_bytes(8, "little") + name + packed[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()), pa.array(first, pa.float64()), pa.array(packed, pa.binary())],
                names=["vec", "key", "label", "dim", "p", "v"],
            )

    return run


def collisions(a: np.ndarray, order: np.ndarray, line: np.ndarray, half: float) -> np.ndarray:
    """Number of lines on which each of b's rows lies in the windows centred on a's rows: ``line`` holds b's
    projections sorted on every line, ``order`` the rows of b in that order."""
    n, keys = line.shape[0], []
    for j in range(a.shape[1]):
        lo, hi = np.searchsorted(line[:, j], a[:, j] - half), np.searchsorted(line[:, j], a[:, j] + half, "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        keys.append(np.repeat(np.arange(len(a)) * n, size) + order[at, j])
    return np.bincount(np.concatenate(keys), minlength=len(a) * n).reshape(len(a), n)


def _tile(threshold: float, projections: int, half: float, least: int, reach: float, seed: int):
    def run(table: pa.Table) -> pa.Table:
        ids, side, p, weight = (table[c].to_numpy() for c in ("rep", "side", "p", "n"))
        x = np.frombuffer(b"".join(table["v"].to_pylist()), np.float64).reshape(len(ids), -1)
        perm = np.lexsort((ids, p))
        ids, side, p, weight, x = ids[perm], side[perm], p[perm], weight[perm], x[perm]
        proj = x @ lines(x.shape[1], projections, seed)
        rows, cols = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block with itself
        count, label, found = np.zeros(len(ids), np.int64), np.arange(len(ids)), []
        # the other side in runs of neighbours on the first line, each sorted on every line once
        for begin in range(0, len(cols), 2048):
            c = cols[begin : begin + 2048]
            order = np.argsort(proj[c], axis=0, kind="stable")
            line = np.take_along_axis(proj[c], order, axis=0)
            near = rows[np.searchsorted(p[rows], p[c[0]] - reach) : np.searchsorted(p[rows], p[c[-1]] + reach, "right")]
            if side[0] == 2:
                near = near[near < c[-1]]
            for at in range(0, len(near), 256):
                r = near[at : at + 256]
                i, j = np.nonzero(collisions(proj[r], order, line, half) >= least)
                i, j = r[i], c[j]
                if side[0] == 2:  # each pair once
                    i, j = i[i < j], j[i < j]
                ok = np.zeros(len(i), bool)
                for k in range(0, len(i), 1 << 16):
                    ok[k : k + (1 << 16)] = np.einsum("ij,ij->i", x[i[k : k + (1 << 16)]], x[j[k : k + (1 << 16)]]) >= threshold
                i, j = i[ok], j[ok]
                np.add.at(count, i, weight[j])
                np.add.at(count, j, weight[i])
                # links that join something: to the least label a row has met so far
                found.append(np.unique(np.stack([label[i], label[j]]), axis=1).astype(np.int32))
                if sum(f.shape[1] for f in found) > 1 << 20:
                    label, found = _contract(label, found), []
        label, has = _contract(label, found), count > 0
        return pa.table({"rep": pa.array(ids[has]), "links": pa.array(count[has]), "to": pa.array(ids[label[has]])})

    return run


def _contract(label: np.ndarray, found: list) -> np.ndarray:
    """Labels after joining pairs of labels: the least row of each component."""
    pairs = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int32)
    step = np.arange(len(label))
    while pairs.shape[1]:
        before = step.copy()
        np.minimum.at(step, pairs[0], before[pairs[1]])
        np.minimum.at(step, pairs[1], before[pairs[0]])
        step = step[step]
        if (step == before).all():
            break
    return step[label]


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.93, projections: int = 32, recall: float = 0.999, block_rows: int = 8192, seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row per row of ``vectors``.

    Only vectors of equal, non-null labels and equal dimension are compared. A vector that is null, empty, zero or
    holds null or non-finite components, or has a null label or id, links with nothing and forms its own component.
    Rows that repeat an id count as one vector, the one of the least digest. Equal vectors under different ids link
    like any others. Other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    half, least, reach = calibrate(threshold, projections, recall)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec"), F.col(vector_col).cast("array<double>").alias("e"), F.col(label_col).cast("string").alias("label"))
    unit = scratch.table(rows.mapInArrow(_project(seed, projections), "vec long, key binary, label string, dim int, p double, v binary"), "unit")
    members = scratch.table(unit.groupBy("vec").agg(F.min("key").alias("key")), "members")
    sizes = scratch.table(members.groupBy("key").agg(F.min("vec").alias("rep"), F.count("*").alias("n")), "sizes")
    step = reach / 16
    classes = unit.groupBy("key", "label", "dim", "p", "v").agg(F.count("*").alias("rows")).drop("rows").join(sizes, "key")
    classes = scratch.table(classes.select("rep", "n", "label", "dim", "p", "v", F.floor(F.col("p") / step).alias("bin")), "classes")
    # bins along the first line, joined into blocks of about block_rows; a fuller bin is split by id
    bins = classes.groupBy("label", "dim", "bin").agg(F.count("*").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    bins = bins.selectExpr("*", "sum(n) over (partition by label, dim order by bin) - n as before").selectExpr(
        "*", f"case when n > {block_rows} then concat('s', bin) else concat('b', floor(before / {block_rows})) end as run",
        f"cast(ceil(n / {block_rows}) as int) as parts",
    )
    bins = scratch.table(bins, "bins")
    blocks = bins.groupBy("label", "dim", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("parts").alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = blocks.select("label", "dim", F.concat_ws("-", "run", "part").alias("block"), "lo", "hi")
    a, b = (blocks.select("label", "dim", *(F.col(c).alias(c + s) for c in ("block", "lo", "hi"))) for s in "ab")
    tiles = a.join(b, ["label", "dim"]).where(f"blocka <= blockb and loa <= hib + {reach} and lob <= hia + {reach}")
    tiles = scratch.table(tiles.select("label", "dim", "blocka", "blockb", F.monotonically_increasing_id().alias("tile")), "tiles")
    sides = tiles.where("blocka <> blockb")
    places = (
        sides.select("label", "dim", F.col("blocka").alias("block"), "tile", F.lit(0).alias("side"))
        .unionByName(sides.select("label", "dim", F.col("blockb").alias("block"), "tile", F.lit(1).alias("side")))
        .unionByName(tiles.where("blocka = blockb").select("label", "dim", F.col("blocka").alias("block"), "tile", F.lit(2).alias("side")))
    )
    placed = classes.join(bins.select("label", "dim", "bin", "run", "parts"), ["label", "dim", "bin"]).select(
        "label", "dim", F.concat_ws("-", "run", F.expr("pmod(xxhash64(rep), parts)")).alias("block"), "rep", "n", "p", "v"
    )
    dealt = placed.join(places, ["label", "dim", "block"]).select("tile", "side", "rep", "n", "p", "v")
    links = scratch.table(dealt.groupBy("tile").applyInArrow(_tile(threshold, projections, half, least, reach, seed), "rep long, links long, to long"), "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(links.select(F.col("rep").alias("a"), F.col("to").alias("b")), scratch).withColumnRenamed("node", "rep")
    known = sizes.join(counts, "rep", "left").join(parts, "rep", "left").where("n > 1 or links is not null")
    known = scratch.table(known.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "known")
    # fewer than 1,000 classes hold over a thousandth of the rows each: they go by broadcast, the rest by shuffle
    every = members.count() / 1000
    hot = F.broadcast(known.where(F.col("n") > every).drop("n"))
    found = members.join(hot, "key").unionByName(members.join(hot.select("key"), "key", "left_anti").join(known.where(F.col("n") <= every).drop("n"), "key"))
    out = rows.where("vec is not null").select("vec").join(found.drop("key"), "vec", "left")
    out = out.unionByName(rows.where("vec is null").select("vec"), allowMissingColumns=True)
    component = F.coalesce("component", "vec")
    return out.select(F.col("vec").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec")).alias("kept"))
