"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

The product D x D' counts, for every pair of documents, the n-grams they share. A pair with Jaccard t or more shares at
least ``t / (1 + t) * (|x| + |y|)`` of them; the product is taken only over blocks that can hold such pairs, and pairs under
that bound are dropped where they are counted.

1. Blocks. Sets are cut into segments by ranges of the n-gram hash. Their number goes by the size class of the larger set and
   exceeds the n-grams in which a linked pair can differ, so such a pair agrees on whole segments; each set gives the
   ``d + 1`` fullest segments, in an order of contents that both sides know, and at least one of them is common to both.
   Segments hold several n-grams each: texts that only share passages, lines or frequent words do not meet.
   Sets that share segments form families (connected components; no pairs are made).
2. Product. Each family is cut into blocks of bounded size, and each two blocks meet in one task, which multiplies
   their incidence matrices: columns that many rows hold densely, the others by their entries. Only links that join
   what is still apart leave the task, so rows stay linear in the documents.

Documents with equal sets are one row of the matrix; a signature links them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .rows import with_ids, without_ids
from .scratch import Scratch
from .words import ASCII_LOWER, GrowingTable, Vocabulary, hash64, mix, shingle_set, slices

#: Bits of the filter over documents of families; fixed, so it never grows with the data.
CANDIDATE_BITS = 1 << 23
#: A block of a family holds at most about so many sets and so many n-grams.
BLOCK_SETS, BLOCK_GRAMS = 2048, 1 << 20
#: Segment keys that a task holds before it passes them on.
FLUSH = 1 << 20


class _Shingler:
    def __init__(self, k: int):
        self.k, self.words, self.hashes = k, Vocabulary(), GrowingTable(None, np.uint64)

    def sets(self, texts: list):
        """The sorted shingle set of each text; None and '' give the empty set."""
        for text in texts:
            if self.words.renew():
                self.hashes = GrowingTable(None, np.uint64)
            ids = self.words.number((text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split())
            if new := self.words.fresh():
                self.hashes.append(hash64(new))
            yield shingle_set(self.hashes.rows[ids], self.k)


def similar(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both) and both > 0


def size_classes() -> np.ndarray:
    """Least sizes of the classes; each is 1.4 times as wide as the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 7 // 5))
    return np.array(out, np.int64)


_CLASSES = size_classes()


def segment_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): segments of which every linked pair of different sets has at least one in common.

    In class k a pair can differ in d n-grams at most, which spoil d segments at most; of S segments at least S - d agree.
    Each side leaves out its S - d - 1 lowest, by number of n-grams and hash, so the highest that agrees is kept by both.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    most = sizes * 100 // percent
    first, last = (np.searchsorted(_CLASSES, x, "right") - 1 for x in (sizes, most))
    keys, rows = [], []
    for step in range(int((last - first).max(initial=-1)) + 1):
        k = first + step
        top = _CLASSES[k + 1] - 1
        d = (100 - percent) * (sizes + np.minimum(most, top)) // (100 + percent)
        use = np.flatnonzero((sizes > 0) & (k <= last) & (d > 0))  # d = 0: equal sets only
        if not len(use):
            continue
        widest = (100 - percent) * 2 * top[use] // (100 + percent)
        parts = widest + 3 + widest // 8
        n = sizes[use]
        grams = np.concatenate([sets[i] for i in use])
        base = np.cumsum(parts) - parts
        cell = ((grams >> np.uint64(32)) * np.repeat(parts, n).astype(np.uint64) >> np.uint64(32)).astype(np.int64) + np.repeat(base, n)
        start = np.flatnonzero(np.diff(cell, prepend=-1))  # sets are sorted, so segments are runs
        cell = cell[start]
        held = np.diff(start, append=len(grams))
        own = np.searchsorted(base, cell, "right") - 1
        with np.errstate(over="ignore"):
            salt = (k[use][own].astype(np.uint64) << np.uint64(32)) + (cell - base[own]).astype(np.uint64)
            key = mix(np.add.reduceat(mix(grams * _ODD), start) + mix(salt * _ODD))
        order = np.lexsort((key, -held, own))
        own, key = own[order], key[order]
        filled = np.bincount(own, minlength=len(use))
        keep = np.arange(len(own)) - np.repeat(np.cumsum(filled) - filled, filled) < (d[use] + 1)[own]
        keys.append(key[keep])
        rows.append(use[own[keep]])
        for i in np.flatnonzero(filled < d[use] + 1):  # too few segments hold anything: empty ones may be all that agree
            full = set((cell[np.searchsorted(cell, base[i]) : np.searchsorted(cell, base[i] + parts[i])] - base[i]).tolist())
            empty = [j for j in range(int(parts[i])) if j not in full]
            with np.errstate(over="ignore"):
                salt = (np.uint64(k[use][i]) << np.uint64(32)) + np.array(empty, np.uint64)
                own_keys = np.sort(mix(mix(salt * _ODD)))[: int(d[use][i]) + 1 - int(filled[i])]
            keys.append(own_keys)
            rows.append(np.full(len(own_keys), use[i]))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(rows)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def stars(keys: np.ndarray, nodes: np.ndarray):
    """Sorted distinct keys with the least node of each, and a forest (a, b) that joins the nodes of each key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    head = np.repeat(nodes[start], np.diff(start, append=len(keys)))
    other = head != nodes
    return keys[start], nodes[start], forest(head[other], nodes[other])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least node, node) of the same components as the edges (a, b); at most one a node."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(ids))
    x, y = at[: len(a)], at[len(a) :]
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while (np.take(label, label) != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    on = label != np.arange(len(ids))
    return ids[label[on]], ids[on]


_SCAN = "bucket int, keys binary, nodes binary, doc long, n int, sig_a long, sig_b long"


def _scan(k: int, percent: int, buckets: int):
    """Two kinds of rows: size and signature of each document (bucket null), and segment keys with the sets (the first
    half of the signature) that gave them, packed by bucket of keys; a bucket below 0 packs edges between sets of a task."""

    def packed(bucket, keys, nodes):
        n, none = len(bucket), pa.nulls(len(bucket), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(keys, pa.binary()), pa.array(nodes, pa.binary()), none, pa.nulls(n, pa.int32()), none, none], names=["bucket", "keys", "nodes", "doc", "n", "sig_a", "sig_b"])

    def flush(held, part_id):
        keys, nodes, (a, b) = stars(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        start = np.flatnonzero(np.diff(bucket, prepend=-1))
        cuts = [*start.tolist(), len(keys)]
        yield packed(bucket[start], [keys[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], [nodes[i:j].tobytes() for i, j in zip(cuts, cuts[1:])])
        if len(a):
            yield packed([-1 - part_id], [a.tobytes()], [b.tobytes()])

    def run(batches):
        shingler, held, seen, part_id = _Shingler(k), [], set(), TaskContext.get().partitionId()
        for batch in batches:
            for part in slices(batch):
                sets = list(shingler.sets(part.column(1).to_pylist()))
                sig = [xxhash.xxh128_intdigest(s.tobytes()) for s in sets]
                high = np.array([x >> 64 for x in sig], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.nulls(len(sets), x) for x in (pa.int32(), pa.binary(), pa.binary())), part.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                     pa.array(high), pa.array(np.array([x & 0xFFFFFFFFFFFFFFFF for x in sig], np.uint64).view(np.int64))],
                    names=["bucket", "keys", "nodes", "doc", "n", "sig_a", "sig_b"],
                )
                fresh = []
                for i, (x, s) in enumerate(zip(sig, sets, strict=True)):  # an equal set of this task gives the same keys
                    if len(s) and x not in seen:
                        fresh.append(i)
                        if len(seen) < 100_000:
                            seen.add(x)
                keys, rows = segment_keys([sets[i] for i in fresh], percent)
                if len(keys):
                    held.append((keys, high[np.array(fresh)[rows]]))
                if sum(len(x) for x, _ in held) >= FLUSH:
                    yield from flush(held, part_id)
                    held = []
        if held:
            yield from flush(held, part_id)

    return run


def _edges(batches):
    """(a, b): edges between sets that share a key. Rows of a bucket come one after the other."""

    def done(held):
        if held:
            a, b = stars(np.concatenate([np.frombuffer(x, np.uint64) for x, _ in held]), np.concatenate([np.frombuffer(x, np.int64) for _, x in held]))[2]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    at, held = None, []
    for batch in batches:
        for bucket, keys, nodes in zip(*(batch.column(c).to_pylist() for c in ("bucket", "keys", "nodes")), strict=True):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (keys, nodes)], names=["a", "b"])
                continue
            if bucket != at:
                yield from done(held)
                at, held = bucket, []
            held.append((keys, nodes))
    yield from done(held)


def _sets(k: int, wanted: np.ndarray):
    """The whole sets of documents that may be in families."""

    def run(batches):
        shingler = _Shingler(k)
        for batch in batches:
            doc = batch.column(0).cast(pa.int64())
            bit = _bit(doc.fill_null(0).to_numpy())
            for part in slices(batch.filter(pa.array(((wanted[bit >> 3] >> (bit & 7)) & 1) == 1))):
                kept = [(d, s) for d, s in zip(part.column(0).to_pylist(), shingler.sets(part.column(1).to_pylist()), strict=True) if d is not None]
                sig = np.array([xxhash.xxh128_intdigest(s.tobytes()) >> 64 for _, s in kept], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in kept], pa.int64()), pa.array(sig), pa.array([s.tobytes() for _, s in kept], pa.binary())], names=["doc", "sig_a", "grams"])

    return run


def _bit(doc: np.ndarray) -> np.ndarray:
    return doc.astype(np.int64) & (CANDIDATE_BITS - 1)


def links_of(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of linked sets that join what no pair before them joins. With two sides (0 and 1) only pairs across."""
    n = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    entry = np.argsort(column, kind="stable")
    entry = entry[count[column[entry]] > 1]
    x, c = rows[entry], column[entry]
    two = bool(side.any())
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(sets)),) * 2
    place = np.empty(len(sets), np.int64)
    place[left] = np.arange(len(left))
    place[right] = np.arange(len(right))
    both = np.zeros((len(left), len(right)), np.float32)
    dense = count[c] >= max(16, len(sets) // 16)
    # columns that many rows hold: dense products of 1,024 columns at a time
    _, dc = np.unique(c[dense], return_inverse=True)
    dx = x[dense]
    cut = np.searchsorted(dc, np.arange(0, dc.max(initial=-1) + 1, 1024))
    for i, j in zip(cut, [*cut[1:], len(dc)]):
        block = np.zeros((len(sets), 1024), np.float32)
        block[dx[i:j], dc[i:j] & 1023] = 1
        both += block[left] @ block[right].T
    # the others: entries of a column against those after it
    x, c = x[~dense], c[~dense]
    step = 1
    while len(x) > step:
        same = np.flatnonzero(c[step:] == c[:-step])
        if not len(same):
            break
        i, j = x[same], x[same + step]
        if two:
            i, j = np.where(side[i] == 0, i, j), np.where(side[i] == 0, j, i)
            across = side[i] != side[j]
            i, j = i[across], j[across]
        np.add.at(both, (place[i], place[j]), 1)
        step += 1
    if not two:
        both = np.triu(both, 1)  # the light columns were added there only
    i, j = np.nonzero(both)
    near = (100 + percent) * both[i, j].astype(np.int64) >= percent * (n[left[i]] + n[right[j]])
    return forest(left[i[near]], right[j[near]])


def _product(percent: int):
    """Rows of a tile come one after the other, those of its first block with side 0."""

    def done(docs, sides, sets):
        if len(docs) > 1:
            a, b = links_of(sets, np.array(sides), percent)
            doc = np.array(docs, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(doc[a.astype(np.int64)]), pa.array(doc[b.astype(np.int64)])], names=["a", "b"])

    def run(batches):
        at, docs, sides, sets = None, [], [], []
        for batch in batches:
            for *tile, side, doc, grams in zip(*(batch.column(c).to_pylist() for c in ("family", "low", "high", "side", "doc", "grams")), strict=True):
                if tile != at:
                    yield from done(docs, sides, sets)
                    at, docs, sides, sets = tile, [], [], []
                docs.append(doc)
                sides.append(side)
                sets.append(np.frombuffer(grams, np.uint64))
        yield from done(docs, sides, sets)

    return run


def bitmap(df: DataFrame, bits: int) -> np.ndarray:
    """Bits named by column ``bit`` of df as bytes; at most bits / 8 rows reach the driver."""
    out = np.zeros(bits // 8, np.uint8)
    rows = df.select(F.expr("bit div 8").alias("byte"), F.expr("shiftleft(1, cast(bit % 8 as int))").alias("one")).groupBy("byte").agg(F.bit_or("one").alias("ones"))
    packed = rows.select(F.col("byte").cast("int"), F.col("ones").cast("int")).toArrow()
    out[packed.column(0).to_numpy()] = packed.column(1).to_numpy().astype(np.uint8)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row of ``docs``.

    Two documents link when 100 * |x & y| >= percent * |x | y| over their distinct ``words``-word shingles of
    lower-cased (A-Z) words between ASCII white space; component_id is the smallest id reachable, itself included.
    Null or empty text: empty set, linked with nothing. Fewer words than a shingle: the sequence is one shingle.
    A null id gets its n_shingles and a null component. Rows that repeat an id count as one document with
    several texts: they share a component. Other columns of docs are ignored; no rows give no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    # about a key in 20 bytes of text: so many buckets that a task holds some hundred thousand
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, size // (20 << 19))
    scan = scratch.table(docs.mapInArrow(_scan(words, percent, buckets), _SCAN), "scan")
    sizes = scan.where("keys is null").select("doc", "n", "sig_a", "sig_b")
    keys = scan.where("keys is not null").select("bucket", "keys", "nodes")
    edges = scratch.table(keys.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_edges, "a long, b long"), "candidates")
    family = connected_components(edges, scratch)

    # equal sets; salted, as one text may be a third of all rows
    held = sizes.where("n > 0 and doc is not null").withColumn("salt", F.expr("cast(pmod(xxhash64(doc), 64) as int)"))
    by_salt = held.groupBy("sig_a", "sig_b", "n", "salt").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    equal = scratch.table(by_salt.groupBy("sig_a", "sig_b", "n").agg(F.min("least").alias("a"), F.max("most").alias("top"), F.collect_list("salt").alias("salts")), "equal")
    shared = equal.where("a <> top").select("sig_a", "sig_b", "n", "a", F.explode("salts").alias("salt"))
    copies = held.join(shared, ["sig_a", "sig_b", "n", "salt"]).where("doc <> a").select("a", F.col("doc").alias("b"))

    # one document of each set that has a family; both halves of the signature, so no two sets are taken for one
    member = equal.select("sig_a", "n", F.col("a").alias("doc")).join(family.select(F.col("node").alias("sig_a"), F.col("component").alias("family")), "sig_a")
    member = scratch.table(member, "members")
    blocks = member.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum(F.col("n").cast("long")) / BLOCK_GRAMS)).cast("int").alias("blocks"))
    wanted = spark.sparkContext.broadcast(bitmap(member.select(F.col("doc").bitwiseAND(F.lit(CANDIDATE_BITS - 1)).alias("bit")), CANDIDATE_BITS))
    sets = docs.mapInArrow(lambda it, w=wanted: _sets(words, w.value)(it), "doc long, sig_a long, grams binary")
    rows = sets.join(member.join(blocks, "family"), ["doc", "sig_a"]).dropDuplicates(["doc", "sig_a"]).withColumn("block", F.expr("cast(pmod(xxhash64(doc, 7), blocks) as int)"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("family", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.expr("int(block > other)").alias("side"), "doc", "grams")
    tiles = met.repartition("family", "low", "high").sortWithinPartitions("family", "low", "high")
    links = scratch.table(tiles.mapInArrow(_product(percent), "a long, b long"), "links")
    final = connected_components(links.unionByName(copies), scratch)
    return sizes.join(final.withColumnRenamed("node", "doc"), "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose id is the smallest of their component; the columns stay as they are. Of rows that repeat an
    id one stays, that of the least text hash. Rows without an id stay: nothing names them."""
    scratch = Scratch(docs.sparkSession)
    parts = jaccard_components(docs, id_col, text_col, words, percent).where("doc_id is not null")
    ids = parts.groupBy("doc_id").agg(F.max("component_id").alias("c"), F.count("*").alias("times")).where("doc_id <> c or times > 1")
    ids = scratch.table(ids.select(F.col("doc_id").alias(id_col), F.expr("doc_id = c").alias("again")), "others")
    kept = without_ids(docs, ids.where("not again").select(id_col), id_col)
    again = ids.where("again").select(id_col)
    if not again.take(1):
        return kept
    first = F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(text_col), F.col(text_col))).alias("row")
    once = with_ids(docs, again, id_col).groupBy(id_col).agg(first).select("row.*")
    return without_ids(kept, again, id_col).unionByName(once)
