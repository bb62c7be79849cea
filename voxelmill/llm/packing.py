"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of token streams. The scheduler serves one token at a time to the queue that is furthest
behind its target share, and every 2048 tokens close a window: its contents hold the target proportions up to one
token a source, and what a source is owed (its deficit) is carried into the next window, over task and partition
borders alike. The state of the scheduler after any number of tokens is a function of the queues' totals alone,
so every task computes the cuts of just the windows it fills, and no task has to see the others.
With the corpus's own proportions as targets all queues run dry together; with others the rest go on in theirs when
one is dry. Only the last window is not full. Of many sources most share queues, and a scheduler of the same kind
inside each serves its sources, so every source keeps its share.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import os
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import ASCII_LOWER, GrowingTable, Vocabulary, slices


#: Basic and Latin letters whose lower case is one letter.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
_LOWER = np.array([97 <= c <= 122 for c in range(256)])
_TAIL = np.array([0xA0 <= c <= 0xBF and c != 0xB7 for c in range(256)])  # of Latin letters, after 0xC3
_STOP = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;=>?@[\\]^_`{}~"))  # not < and |, which the special tokens hold
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def _parted(texts: list) -> tuple[pa.Array, np.ndarray]:
    """Pieces between white space of all texts, A-Z in lower case, and how many each text has; also parted between a letter and an
    ASCII sign, where every pre-token of letters ends."""
    whole = np.frombuffer(b"\xff".join((t or "").encode("utf-8", "surrogatepass") for t in texts).translate(ASCII_LOWER), np.uint8)
    apart = _SPACE[whole] | (whole == 0xFF)
    letter = _LOWER[whole]
    letter[1:] |= _TAIL[whole[1:]] & (whole[:-1] == 0xC3)
    first = ~apart
    first[1:] &= apart[:-1] | (letter[:-1] & _STOP[whole[1:]])
    ends = np.append(np.flatnonzero(whole == 0xFF), len(whole))
    held, starts = np.cumsum(~apart), np.flatnonzero(first)
    offsets = np.append(held[starts] - 1, held[-1] if len(held) else 0).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole[~apart])])
    return pieces, np.diff(np.searchsorted(starts, ends), prepend=0)


@functools.cache
def _tokenizers(path: str):
    """Of a worker process: the tokenizer, one without its steps before the pairs, and which ids end a pre-token."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; waiting threads would burn others
    from tokenizers import Tokenizer, pre_tokenizers

    whole, plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
    plain.normalizer = None  # for words of plain letters in lower case, where neither step changes anything
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return whole, plain, np.array([whole.id_to_token(i).endswith("</w>") for i in range(whole.get_vocab_size())])


class PieceTokenizer:
    """Ids of whole texts by a ``tokenizers`` file whose pre-tokenizer never joins text across white space.

    Pieces between white space are encoded once and remembered (at most ``cap`` of them), for as long as a task runs.
    """

    def __init__(self, path: str, cap: int = 400_000):
        self._tokenizer, self._plain, self._ends = _tokenizers(path)
        self._vocab = Vocabulary(cap)
        self._flat, self._start, self._len, self._hits = GrowingTable(None, np.uint32), GrowingTable(None, np.int64), GrowingTable(None, np.int64), GrowingTable(None, np.int64)

    def _forget(self) -> None:
        """Above ``cap`` pieces, keeps those seen again since the last time, at most half of ``cap``."""
        if len(self._vocab) <= self._vocab.cap:
            return
        hits, words = self._hits.rows, self._vocab.words()
        keep = np.flatnonzero(hits > 1)
        if len(keep) > self._vocab.cap // 2:
            keep = np.sort(keep[np.argsort(-hits[keep], kind="stable")[: self._vocab.cap // 2]])
        n, start = self._len.rows[keep], self._start.rows[keep]
        flat = self._flat.rows[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        self._vocab = Vocabulary(self._vocab.cap)
        self._vocab.number([words[i] for i in keep])
        self._vocab.fresh()
        self._flat, self._start, self._len, self._hits = GrowingTable(None, np.uint32), GrowingTable(None, np.int64), GrowingTable(None, np.int64), GrowingTable(None, np.int64)
        for table, rows in ((self._flat, flat), (self._start, np.cumsum(n) - n), (self._len, n), (self._hits, np.zeros(len(keep), np.int64))):
            table.append(rows)

    def encode(self, texts: list) -> list[np.ndarray]:
        self._forget()
        if not texts:
            return []
        pieces, many = _parted(texts)
        found = pieces.dictionary_encode()  # a piece is looked up once for all texts
        row, distinct = found.indices.to_numpy(), found.dictionary
        if len(distinct):  # many times faster than to_pylist
            distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), pa.scalar(b" ", pa.binary()))[0].as_py().split(b" ")
        at = self._vocab.number(distinct)
        if new := self._vocab.fresh():
            self._learn([w.decode("utf-8", "replace") for w in new])
            self._hits.append(np.zeros(len(new), np.int64))
        self._hits.rows[at] += np.bincount(row, minlength=len(at))
        at = at[row]
        n, start = self._len.rows[at], self._start.rows[at]
        end = np.cumsum(n)
        ids = self._flat.rows[np.repeat(start - (end - n), n) + np.arange(int(n.sum()))]
        stop = np.concatenate([[0], end])[np.cumsum(many)]
        return np.split(ids, stop[:-1])

    def _learn(self, words: list) -> None:
        """Words of letters are one pre-token each, whose last id marks its end, so they are encoded as one text."""
        plain = np.fromiter((_PLAIN.fullmatch(w) is not None for w in words), bool, len(words))
        text = " ".join(itertools.compress(words, plain)).lower()
        ids = np.array(self._plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        stop = np.flatnonzero(self._ends[ids]) + 1
        if len(stop) != np.count_nonzero(plain):
            plain[:], ids, stop = False, ids[:0], stop[:0]
        rest = [e.ids for e in self._tokenizer.encode_batch_fast([words[i] for i in np.flatnonzero(~plain)], add_special_tokens=False)]
        m = np.fromiter(map(len, rest), np.int64, len(rest))
        n, start, base = np.empty(len(words), np.int64), np.empty(len(words), np.int64), self._flat.n
        n[plain], n[~plain] = np.diff(stop, prepend=0), m
        start[plain] = base + stop - n[plain]
        start[~plain] = base + len(ids) + np.cumsum(m) - m
        self._flat.append(np.concatenate([ids, np.fromiter(itertools.chain.from_iterable(rest), np.uint32, int(m.sum()))]))
        self._start.append(start)
        self._len.append(n)

    def count(self, text) -> int:
        return len(self.encode([text])[0])


def _tokenize(path: str, end_id: int):
    """(doc, ids, n, part, queue, tail, start): a document's ids and its place in its source, within this partition."""

    def run(batches):
        tokenizer, part, at = PieceTokenizer(path), TaskContext.get().partitionId(), {}
        for batch in batches:
            for piece in slices(batch, 1000, 4 << 20):
                ids = [np.append(x, np.uint32(end_id)) for x in tokenizer.encode(piece.column(1).to_pylist())]
                start = []
                for q, x in zip(zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), strict=True), ids, strict=True):
                    start.append(at.get(q, 0))
                    at[q] = start[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array(np.full(len(ids), part, np.int32)), piece.column(2), piece.column(3), pa.array(start, pa.int64())],
                    names=["doc", "ids", "n", "part", "queue", "tail", "start"],
                )

    return run


def served(tokens: np.ndarray, totals: list[int], weights: list[int] | None = None) -> np.ndarray:
    """State of the round-robin after so many tokens: rows by entry of ``tokens``, columns by queue.

    Token k of queue s is due at (k + 1/2) / totals[s]; queues are served in the order of due times, then of s. A
    queue's deficit against its exact share stays within half a token for each other queue, about one in practice.
    With ``weights`` token k is due at (k + 1/2) / weights[s]; a queue of weight 0 waits for all others.
    """
    if weights is not None:
        return _served_by(tokens, totals, weights)
    whole = sum(totals)
    out = np.empty((len(tokens), len(totals)), np.int64)
    for s, t in enumerate(totals):  # what is due for certain; exact in Python's integers
        out[:, s] = [max(0, (t * (2 * int(n) - len(totals)) + whole) // (2 * whole) - 1) for n in tokens]
    size = np.array(totals, np.float64)
    left = tokens - out.sum(axis=1)
    rows = np.flatnonzero(left > 0)
    while len(rows):
        due = np.where(out[rows] < np.array(totals), (out[rows] + 0.5) / np.maximum(size, 1), np.inf)
        out[rows, due.argmin(axis=1)] += 1
        left[rows] -= 1
        rows = rows[left[rows] > 0]
    return out


def _served_by(tokens: np.ndarray, totals: list[int], weights: list[int]) -> np.ndarray:
    if min(weights) <= 0:  # in two parts: those with a weight, then the others by their totals
        first = [t if w > 0 else 0 for t, w in zip(totals, weights, strict=True)]
        rest = [t - f for t, f in zip(totals, first, strict=True)]
        n = np.minimum(tokens, sum(first))
        out = np.zeros((len(tokens), len(totals)), np.int64)
        for part, own, count in ((first, weights, n), (rest, rest, tokens - n)):
            at = [s for s, t in enumerate(part) if t]
            if at:
                out[:, at] = _served_by(count, [part[s] for s in at], [own[s] for s in at])
        return out
    order = sorted(range(len(totals)), key=lambda s: (Fraction(totals[s], weights[s]), s))  # in which they run dry
    ends, gone, left_weight = [], [0], [sum(weights)]  # tokens served by then, of them the dry queues', weight of the others
    for s in order:
        ends.append(gone[-1] + Fraction(totals[s] * left_weight[-1], weights[s]))
        gone.append(gone[-1] + totals[s])
        left_weight.append(left_weight[-1] - weights[s])
    out = np.empty((len(tokens), len(totals)), np.int64)
    for r, n in enumerate(tokens.tolist()):
        sure = max(Fraction(0), Fraction(2 * n - len(totals), 2))
        i = min(bisect.bisect_right(ends, sure), len(order) - 1)
        time = (sure - gone[i]) / left_weight[i]
        up, down = time.numerator, time.denominator
        out[r] = [min(t, max(0, (2 * up * w + down) // (2 * down) - 1)) for t, w in zip(totals, weights, strict=True)]
    left, size, weight = tokens - out.sum(axis=1), np.array(totals), np.array([float(w) for w in weights])
    rows = np.flatnonzero(left > 0)
    while len(rows):
        due = np.where(out[rows] < size, (out[rows] + 0.5) / weight, np.inf)
        out[rows, due.argmin(axis=1)] += 1
        left[rows] -= 1
        rows = rows[left[rows] > 0]
    return out


def _cut(totals: list[int], length: int, weights: list[int] | None):
    whole = sum(totals)

    def _window(queue, tokens):
        """About the window in which these queues have given so many tokens."""
        size, weight = np.array(totals, np.float64), np.array(weights, np.float64) / sum(weights)
        out = np.empty(len(queue))
        for r, (q, x) in enumerate(zip(queue, np.maximum(tokens, 0), strict=True)):
            if weight[q] > 0:
                out[r] = np.minimum(size, x / weight[q] * weight).sum()
            else:
                out[r] = size[weight > 0].sum() + x / max(1.0, size[q]) * size[weight <= 0].sum()
        return out / length

    def run(batches):
        for batch in batches:
            for piece in slices(batch, 500):
                yield from _cut_one(piece)

    def _cut_one(piece):
        base, n, queue = (np.array(piece.column(c).to_pylist(), np.int64) for c in ("base", "n", "queue"))
        place, lists = piece.column("place").to_pylist(), piece.column("members").to_pylist()
        last = -(-whole // length)
        per = np.array([whole / (length * max(t, 1)) for t in totals])[queue]  # windows a token
        # a source that shares its queue: its own rate, and the queue's bound on what it may be ahead or behind
        own = np.array([1.0 if x is None else totals[q] / max(1, x[p]) for q, p, x in zip(queue, place, lists, strict=True)])
        slack = 2 + np.ceil(np.array([0 if x is None else 1 + len(x) / 2 for x in lists]) * per).astype(np.int64)
        per = per * own
        if weights is None:
            lo = np.clip(np.floor(base * per).astype(np.int64) - slack, 0, last)
            hi = np.clip(np.ceil((base + n) * per).astype(np.int64) + slack, 0, last)
        else:
            wide = np.array([0 if x is None else 1 + len(x) / 2 for x in lists])
            off = 2 + 2 * len(totals) // length
            lo = np.clip(np.floor(_window(queue, base * own - wide)).astype(np.int64) - off, 0, last)
            hi = np.clip(np.ceil(_window(queue, (base + n) * own + wide)).astype(np.int64) + off, 0, last)
        edges = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)]))
        need = np.unique(np.concatenate([edges, np.minimum(edges + 1, last)]))
        state = served(np.minimum(need * length, whole), totals, weights)
        docs, blob = piece.column("doc"), piece.column("ids")
        shared: dict = {}
        out = {k: [] for k in ("row", "start", "length", "crc", "window", "offset")}
        for q, at in sorted({(int(q), -1 if p is None else p) for q, p in zip(queue, place, strict=True)}):
            mine = [r for r in np.flatnonzero(queue == q) if (-1 if place[r] is None else place[r]) == at]
            cuts = state[:, q]
            before = state[:, :q].sum(axis=1)
            if at >= 0:
                if q not in shared:  # of each source in the queue: what is served, and what stands before it
                    shared.clear()
                    some, back = np.unique(cuts, return_inverse=True)
                    shared[q] = served(some, lists[mine[0]])[back]
                cuts = shared[q][:, at]
                before = before + shared[q][:, :at].sum(axis=1)
            for r in mine:
                a, b, ids = int(base[r]), int(base[r] + n[r]), blob[int(r)].as_buffer()
                ids = memoryview(ids)
                i = int(np.searchsorted(need, lo[r]))
                i += max(0, int(np.searchsorted(cuts[i:], a, "right")) - 1)
                while a < b:
                    if cuts[i + 1] > a:
                        stop = min(b, int(cuts[i + 1]))
                        x, y = a - int(base[r]), stop - int(base[r])
                        out["row"].append(r)
                        out["start"].append(x)
                        out["length"].append(y - x)
                        out["crc"].append(zlib.crc32(ids[4 * x : 4 * y]))
                        out["window"].append(int(need[i]))
                        out["offset"].append(int(before[i + 1] - before[i]) + a - int(cuts[i]))
                        a = stop
                    i += 1
        rows = pa.array(out["row"], pa.int64())
        return [pa.RecordBatch.from_arrays(
            [docs.take(rows), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc")), piece.column("n").take(rows), *(pa.array(out[k], pa.int64()) for k in ("window", "offset"))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )]

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    length: int = 2048, end_id: int = 1, max_queues: int = 1024, proportions: dict | None = None,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is the ids of its text and then ``end_id``; null or empty text gives that one id. Every id lies in
    exactly one piece. Null sources form a source of their own. Of more sources than ``max_queues`` the largest have
    queues of their own and the others share queues, in which each keeps its share; that bounds the totals that reach
    the driver. ``proportions`` gives sources (None: the null source) their target shares of the tokens, at most 1
    together; sources without one divide the rest by their sizes, or follow last if nothing is left. Repeated rows
    are packed as often as they occur; other columns are ignored; no rows give no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    targets = {"\u0000" if s is None else str(s): Fraction(str(x)) for s, x in (proportions or {}).items()}
    if any(x <= 0 for x in targets.values()) or sum(targets.values()) > 1 or len(targets) > max_queues // 2:
        raise ValueError("proportions must be positive, at most 1 together, for at most half of max_queues sources")
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\u0000"))
    names = sorted(r[0] for r in docs.select(source.alias("s")).distinct().limit(max_queues + 1).collect())
    many = len(names) > max_queues
    if many:
        top = docs.groupBy(source.alias("s")).count().orderBy(F.desc("count"), "s").limit(max_queues // 2)
        names = list(dict.fromkeys([*sorted(targets), *(r[0] for r in top.collect())]))[: max_queues // 2]
    own = F.create_map(*(F.lit(x) for i, s in enumerate(names) for x in (s, i)))[source] if names else F.lit(0)
    queues = max_queues if many else max(1, len(names))
    number = F.coalesce(own, F.pmod(F.xxhash64(source), F.lit(queues - len(names))) + len(names)) if many else own
    tail = F.when(own.isNull(), source).otherwise("") if many else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"), number.cast("int").alias("queue"), tail.alias("tail"))
    kind = rows.schema["doc"].dataType.simpleString()
    tokens = scratch.table(rows.mapInArrow(_tokenize(tokenizer_path, end_id), f"doc {kind}, ids binary, n long, part int, queue int, tail string, start long"), "tokens")
    sums = scratch.table(tokens.groupBy("queue", "tail", "part").agg(F.sum("n").alias("n")), "sums")
    totals = [0] * queues
    for q, n in sums.groupBy("queue").agg(F.sum("n")).collect():  # at most max_queues rows
        totals[q] = n
    weights = _weights(names, totals, targets) if targets else None
    bases = sums.selectExpr("queue", "tail", "part", "sum(n) over (partition by queue, tail order by part) - n as before")
    if many:
        each = scratch.table(sums.where(F.col("queue") >= len(names)).groupBy("queue", "tail").agg(F.sum("n").alias("total")), "sources")
        members = each.groupBy("queue").agg(F.expr("transform(sort_array(collect_list(struct(tail, total))), x -> x.total)").alias("members"))
        places = each.selectExpr("queue", "tail", "row_number() over (partition by queue order by tail) - 1 as place")
        bases = bases.join(places, ["queue", "tail"], "left")
    else:
        bases = bases.withColumn("place", F.lit(None).cast("int"))
    if sums.count() <= 1_000_000:  # 20 MB; beyond it Spark picks a join that shuffles
        bases = F.broadcast(bases)
    placed = tokens.join(bases, ["queue", "tail", "part"])
    placed = placed.join(members, "queue", "left") if many else placed.withColumn("members", F.lit(None).cast("array<long>"))
    placed = placed.select("doc", "ids", "n", "queue", (F.col("before") + F.col("start")).alias("base"), "place", "members")
    return placed.mapInArrow(_cut(totals, length, weights), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _weights(names: list[str], totals: list[int], targets: dict[str, Fraction]) -> list[int]:
    """Integers in the proportion of the targets; queues without one divide the rest by their totals."""
    given = {i: targets[s] for i, s in enumerate(names) if s in targets}
    others = sum(t for i, t in enumerate(totals) if i not in given)
    rest = 1 - sum(given.values())
    shares = [given.get(i, rest * Fraction(t, max(1, others))) for i, t in enumerate(totals)]
    scale = math.lcm(*(x.denominator for x in shares))
    return [int(x * scale) for x in shares]
