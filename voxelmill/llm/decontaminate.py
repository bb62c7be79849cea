"""Benchmark decontamination by a BM25 inverted index of the test items, searched with block-max WAND.

The index is built over the items; the queries are the passages of every training document: windows of words,
each half over the last, long enough that some window holds any whole item. Scores are BM25 over the passage's
distinct words, as a share of the score an item gives itself. Items lie in blocks of ``block``; every term keeps
its largest share in the whole list and in each block it occurs in. A passage is skipped when the list maxima of
its words cannot reach the threshold, a block when the maxima of its words there cannot. In the blocks left, one
cursor a word goes through the items: sorted by their next item, the cursors whose maxima first reach the
threshold together name the pivot; items before it are skipped, it alone is scored. So exactly the items above
the threshold come back. Each is verified by the words of question and answer that lie in common runs.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import keep_where
from .words import ASCII_WORDS, slices


def split(text) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(ASCII_WORDS).split()


def item_words(question, answer, answer_share: float = 0.2) -> tuple[list[bytes], list[bytes]]:
    """An item's question and answer; without an answer the end of the text is it."""
    w, tail = split(question), split(answer)
    if not tail:
        n = max(1, math.ceil(len(w) * answer_share)) if len(w) > 1 else 0
        w, tail = w[: len(w) - n], w[len(w) - n :]
    return w, tail


class Statistics:
    """What BM25 takes from all items together, however many indexes hold them."""

    def __init__(self):
        self.df, self.n, self.words, self.longest = Counter(), 0, 0, 1

    def add(self, items: list[list[bytes]]) -> Statistics:
        for w in items:
            self.df.update(set(w))
            self.n += 1
            self.words += len(w)
            self.longest = max(self.longest, len(w))
        return self


class Bm25Index:
    """Shares by (term, item); term number ``len(terms)`` stands for every word outside the index."""

    def __init__(self, ids: list, questions: list, answers: list, answer_share: float = 0.2, block: int = 4, k1: float = 1.2, b: float = 0.75, statistics: Statistics | None = None):
        self.ids, self.block = ids, block
        words, self.question_words = [], []
        for q, a in zip(questions, answers, strict=True):
            w, tail = item_words(q, a, answer_share)
            self.question_words.append(len(w))
            words.append(w + tail)
        self.terms: dict = {}
        self.items = [np.array([self.terms.setdefault(x, len(self.terms)) for x in w], np.int64) for w in words]
        known = statistics or Statistics().add(words)
        self.longest = known.longest
        n, t = len(words), len(self.terms)
        df, total, mean = [known.df[x] for x in self.terms], known.n, known.words / max(1, known.n)
        self.blocks = max(1, -(-n // block))
        postings: list = [[] for _ in range(t)]
        for i, w in enumerate(self.items):
            part = {x: math.log(1 + (total - df[x] + 0.5) / (df[x] + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(w) / mean)) for x, f in Counter(w.tolist()).items()}
            whole = sum(part.values()) or 1.0
            for x, v in part.items():
                postings[x].append((i, v / whole))
        # posting lists one after the other, each in the order of items and so of blocks
        self.size = np.array([len(x) for x in postings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.item = np.array([i for x in postings for i, _ in x], np.int64)
        self.share = np.array([v for x in postings for _, v in x], np.float64)
        # runs of postings of one term in one block, with their largest share; no entry where a term has none
        term = np.repeat(np.arange(t), self.size)
        self.run_start = np.flatnonzero(np.diff(term * self.blocks + self.item // block, prepend=-1))
        self.run_stop = np.append(self.run_start[1:], len(term))
        self.run_block = self.item[self.run_start] // block
        self.run_max = np.maximum.reduceat(self.share, self.run_start) * (1 + 1e-6) if len(term) else np.empty(0)
        self.runs = np.searchsorted(term[self.run_start], np.arange(t + 1))
        self.list_max = np.zeros(t + 1, np.float32)
        np.maximum.at(self.list_max, term, (self.share * (1 + 1e-6)).astype(np.float32))

    def number(self, words: list[bytes]) -> np.ndarray:
        get, other = self.terms.get, len(self.terms)
        return np.fromiter((get(w, other) for w in words), np.int64, len(words))

    def retrieve(self, passage: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, share) of every item whose share reaches the threshold; passage: term numbers."""
        terms = np.unique(passage[passage < len(self.terms)])
        if self.list_max[terms].sum() < threshold:
            return []
        first = self.runs[terms]
        n = self.runs[terms + 1] - first
        runs = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        blocks = self.run_block[runs]
        bound = np.bincount(blocks, self.run_max[runs], self.blocks)
        return [found for blk in np.flatnonzero(bound >= threshold) for found in self._pivots(runs[blocks == blk], threshold)]

    def _pivots(self, runs: np.ndarray, threshold: float):
        """(item, share) of the items of one block that reach the threshold; runs: those of the passage's words there."""
        order = np.argsort(-self.run_max[runs], kind="stable")
        at, stop, most = self.run_start[runs[order]].tolist(), self.run_stop[runs[order]].tolist(), self.run_max[runs[order]].tolist()
        item, share = self.item, self.share
        cursors = [(int(item[a]), k) for k, a in enumerate(at)]
        heapq.heapify(cursors)
        while cursors:
            passed, reach = [], 0.0
            while cursors and (reach < threshold or cursors[0][0] == passed[-1][0]):
                passed.append(heapq.heappop(cursors))
                reach += most[passed[-1][1]]
            if reach < threshold:
                return
            pivot, score = passed[-1][0], 0.0
            for i, k in passed:
                while i < pivot:
                    at[k] += 1
                    i = int(item[at[k]]) if at[k] < stop[k] else len(self.ids)
                if i == pivot:
                    score += float(share[at[k]])
                    at[k] += 1
                    i = int(item[at[k]]) if at[k] < stop[k] else len(self.ids)
                if i < len(self.ids):
                    heapq.heappush(cursors, (i, k))
            if score >= threshold:
                yield pivot, score

    def overlap(self, item: int, words: np.ndarray, run: int = 5) -> tuple[float, float, float]:
        """Shares of the question's, the answer's and all words that lie in runs common with ``words``."""
        own = self.items[item]
        k = min(run, len(own))
        there = {tuple(words[j : j + k].tolist()) for j in range(len(words) - k + 1)}
        hit = np.zeros(len(own), bool)
        for j in range(len(own) - k + 1):
            if tuple(own[j : j + k].tolist()) in there:
                hit[j : j + k] = True
        q = self.question_words[item]
        return float(hit[:q].mean()) if q else 1.0, float(hit[q:].mean()) if q < len(own) else 1.0, float(hit.mean())


def passages(n: int, step: int) -> np.ndarray:
    """Starts of the windows of 2 * step words over a text of n words."""
    return np.arange(max(1, -(-(n - step) // step))) * step


def _leaks(index: Bm25Index, threshold: float, least: float):
    """A function from texts to the (row, item, share, question overlap, answer overlap) of their leaks."""
    step = max(64, index.longest)

    def leaks(texts: list):
        ids = [index.number(split(t)) for t in texts]
        flat = np.concatenate([*ids, np.empty(0, np.int64)])
        most = np.concatenate([[0.0], np.cumsum(index.list_max[flat], dtype=np.float64)])
        base = 0
        for row, own in enumerate(ids):
            n = len(own)
            start = passages(n, step)
            stop = np.minimum(start + 2 * step, n)
            found: dict = {}
            # a word's repeats only raise this first bound
            for w in np.flatnonzero(most[base + stop] - most[base + start] >= threshold - 1e-6):
                s, e = int(start[w]), int(stop[w])
                for item, share in index.retrieve(own[s:e], threshold):
                    q, a, both = index.overlap(item, own[max(0, s - step) : e + step])
                    if (q >= least and a >= 0.5) or both >= least:
                        found[item] = max(found.get(item, (0.0,)), (share, q, a))
            base += n
            for item, (share, q, a) in found.items():
                yield row, index.ids[item], share, q, a

    return leaks


def _search(index: Bm25Index, threshold: float, least: float):
    leaks = _leaks(index, threshold, least)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 500, 4 << 20):
                got = list(leaks(part.column(1).to_pylist()))
                rows, items, share, q, a = zip(*got, strict=True) if got else ((),) * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), *(pa.array(x, pa.float64()) for x in (share, q, a))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def indexes(benchmark: DataFrame, item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None, max_items: int = 20_000):
    """Indexes of at most about ``max_items`` items each over all items with an id and words; their shares and passages
    are those of one index over all items."""
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(question_col).cast("string").alias("q"), answer.alias("a")).where("q is not null and i is not null")
    shards = max(1, -(-items.count() // max_items))

    def read(shard):
        got = items.where(F.pmod(F.xxhash64("i", "q"), F.lit(shards)) == shard).toArrow().sort_by([("i", "ascending"), ("q", "ascending")])
        return [x for x in zip(*(got[c].to_pylist() for c in "iqa"), strict=True) if split(x[1])]

    statistics = Statistics() if shards > 1 else None
    for shard in range(shards if shards > 1 else 0):
        statistics.add([sum(item_words(q, a), []) for _, q, a in read(shard)])
    for shard in range(shards):
        got = read(shard)
        yield Bm25Index(*([x[c] for x in got] for c in range(3)), statistics=statistics)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, least: float = 0.8, **options) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every leaked item in every document.

    An item counts as leaked when a passage scores at least ``threshold`` of the item's own BM25 score and, in runs
    of five words (fewer in shorter items), at least ``least`` of the question's words and half of the answer's, or
    ``least`` of all its words, recur there. Without an answer column the last fifth of an item's words is its answer.
    Case and ASCII punctuation do not count. Null and empty documents hold nothing; items that are null or empty leak
    nowhere; repeated rows are searched each. Options are those of ``indexes``: one holds at most ``max_items`` items, which bounds what is sent to
    the executors; more items make more indexes, each searched with all documents.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows, out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), None
    for index in indexes(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        found = rows.mapInArrow(lambda it, s=shared: _search(s.value, threshold, least)(it), f"doc_id {kind}, item_id long, score double, question_overlap double, answer_overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = 0.5, least: float = 0.8, **options) -> DataFrame:
    """The rows of docs in which no item leaked, in one pass over docs for each index."""
    for index in indexes(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def judge(shared=shared):
            leaks = _leaks(shared.value, threshold, least)

            def clear(texts):
                hit = {row for row, *_ in leaks(texts)}
                return [i not in hit for i in range(len(texts))]

            return clear

        docs = keep_where(docs, judge, text_col)
    return docs
