"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of three rows of hash tables: two for the whole word, one for its first six bytes. Filters of
several widths run over the words, each keeps its largest response in the whole text (max pooling), a linear
layer gives the logit. Thresholds are calibrated by language on labelled texts kept out of training; the
language is guessed from the text's own function words. The shift is folded into the score, so 0.5 decides.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import sampled
from .words import ASCII_WORDS, GrowingTable, Vocabulary, slices

#: Function words that tell the languages apart; any other text shares the last, common threshold.
FUNCTION_WORDS = (
    ("the", "of", "and", "to", "is", "that", "with", "was", "this", "are"),
    ("der", "die", "das", "und", "nicht", "mit", "von", "ist", "ein", "den", "dem", "sich"),
    ("le", "les", "et", "des", "une", "est", "dans", "pour", "du", "au", "sur", "qui"),
    ("el", "los", "las", "y", "por", "para", "con", "del", "como", "no", "un", "lo"),
)
_LANG = {w.encode(): i for i, ws in enumerate(FUNCTION_WORDS) for w in ws}
LANGS = len(FUNCTION_WORDS) + 1


def split(text) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(ASCII_WORDS).split()


def hashes(words: list[bytes], buckets: int) -> np.ndarray:
    """Three bucket numbers a word."""
    out = np.empty((len(words), 3), np.int64)
    for i, w in enumerate(words):
        h = xxhash.xxh64_intdigest(w)
        out[i] = h % buckets, buckets + (h >> 32) % buckets, 2 * buckets + xxhash.xxh64_intdigest(w[:6], 7) % buckets
    return out


@dataclass
class ToxicityModel:
    widths: tuple = (1, 2, 3)
    filters: int = 8
    dim: int = 8
    buckets: int = 1 << 16
    E: np.ndarray = None  # (3 * buckets, dim)
    W: list = field(default_factory=list)  # by width: (width, dim, filters)
    b: np.ndarray = None
    v: np.ndarray = None
    c: float = 0.0
    shift: np.ndarray = None  # by language

    def tables(self, h: np.ndarray) -> np.ndarray:
        """Responses of every filter offset to words given by bucket numbers: (n, offsets * filters)."""
        e = self.E[h].sum(axis=1)
        return np.concatenate([e @ w[j] for w in self.W for j in range(len(w))], axis=1).astype(np.float32)

    def pooled(self, table: np.ndarray, ids: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text. ids: rows of table, each text followed by max width - 1 pads."""
        out, col = [], 0
        for k in self.widths:
            n = len(ids)
            conv = np.full((n, self.filters), 0, np.float32)
            for j in range(k):
                conv[: n - j] += table[:, col : col + self.filters][ids[j:]]
                col += self.filters
            conv[~inside] = -np.inf
            out.append(np.maximum.reduceat(conv, starts, axis=0))
        return np.concatenate(out, axis=1)

    def logit(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(pooled + self.b) @ self.v + self.c


def layout(ids: list[np.ndarray], pad: int, pads: int):
    """Texts one after the other with pads between them; an empty text is one pad long."""
    own = [x if len(x) else np.array([pad]) for x in ids]
    n = np.array([len(x) for x in own])
    starts = np.cumsum(n + pads) - n - pads
    flat = np.full(int((n + pads).sum()), pad, np.int64)
    inside = np.zeros(len(flat), bool)
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    flat[at] = np.concatenate(own)
    inside[at] = True
    return flat, starts, inside, n


def guess(votes: np.ndarray) -> np.ndarray:
    """Language by the most function words; the last number where there are none."""
    return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1), LANGS - 1)


class Scorer:
    """Scores texts in one task; remembers the responses of at most ``cap`` words."""

    def __init__(self, model: ToxicityModel, cap: int = 150_000):
        self.m, self.vocab = model, Vocabulary(cap)
        self._reset()

    def _reset(self):
        width = sum(self.m.widths) * self.m.filters
        self.table, self.lang = GrowingTable(width, np.float32), GrowingTable(None, np.int8)
        self.table.append(np.zeros((1, width), np.float32))  # row 0 is the pad
        self.lang.append(np.array([-1], np.int8))

    def logits(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.empty(0), np.empty(0, np.int64)
        if self.vocab.renew():
            self._reset()
        words = [split(t) for t in texts]
        ids = self.vocab.number(list(itertools.chain.from_iterable(words))) + 1
        if new := self.vocab.fresh():
            self.table.append(self.m.tables(hashes(new, self.m.buckets)))
            self.lang.append(np.fromiter((_LANG.get(w, -1) for w in new), np.int8, len(new)))
        ids = np.split(ids, np.cumsum([len(w) for w in words])[:-1])
        flat, starts, inside, _ = layout(ids, 0, max(self.m.widths) - 1)
        row = np.cumsum(np.isin(np.arange(len(flat)), starts)) - 1
        spoken = self.lang.rows[flat]
        votes = np.zeros((len(texts), LANGS))
        np.add.at(votes, (row[spoken >= 0], spoken[spoken >= 0]), 1)
        return self.m.logit(self.m.pooled(self.table.rows, flat, starts, inside)), guess(votes)

    def scores(self, texts: list) -> np.ndarray:
        z, lang = self.logits(texts)
        return 1 / (1 + np.exp(-np.clip(z - self.m.shift[lang], -30, 30)))


def train(texts: list, labels: np.ndarray, seed: int = 5, epochs: int = 6, rate: float = 0.05, valid: float = 0.25) -> ToxicityModel:
    """Fits the network on three quarters of the texts and the thresholds on the rest."""
    rng = np.random.default_rng(seed)
    m = ToxicityModel()
    m.E = rng.normal(0, 0.05, (3 * m.buckets, m.dim)).astype(np.float32)
    m.W = [rng.normal(0, 0.2, (k, m.dim, m.filters)).astype(np.float32) for k in m.widths]
    m.b, m.v = np.zeros(len(m.widths) * m.filters, np.float32), rng.normal(0, 0.2, len(m.widths) * m.filters).astype(np.float32)
    m.shift = np.zeros(LANGS)
    labels = np.asarray(labels, np.float32)
    if not len(texts) or labels.min() == labels.max():
        m.v[:] = 0
        m.c = 4.0 if len(texts) and labels[0] else -4.0
        return m
    vocab = Vocabulary(1 << 62)
    ids = [vocab.number(split(t)) + 1 for t in texts]
    h = np.concatenate([np.zeros((1, 3), np.int64), hashes(vocab.fresh(), m.buckets)])
    order = rng.permutation(len(texts))
    held, fit = order[: int(valid * len(order))], order[int(valid * len(order)) :]
    # the first embedding dimension starts as the bucket's evidence for label 1, as documents of either label have it
    prior = labels[fit].mean()
    pos, every = np.zeros(3 * m.buckets), np.zeros(3 * m.buckets)
    for i in fit:
        own = np.unique(h[np.unique(ids[i])].ravel()) if len(ids[i]) else np.empty(0, np.int64)
        every[own] += 1
        pos[own] += labels[i]
    z = (pos - prior * every) / np.sqrt(prior * (1 - prior) * every + 1)
    m.E[:, 0] = np.sign(z) * np.log1p(np.maximum(np.abs(z) - 1.5, 0)) / 3
    for w in m.W:
        w[:, :, 0] = 0
        w[:, 0, 0] = 1
        w[:, 0, 1] = 0.5
    m.v[[i * m.filters for i in range(len(m.widths))]] = 0.7
    m.v[[i * m.filters + 1 for i in range(len(m.widths))]] = 0.3
    m.c = float(np.log(prior / (1 - prior)))
    weight = np.where(labels > 0, 0.5 / prior, 0.5 / (1 - prior))
    pads = max(m.widths) - 1
    gE, gW, gb, gv, gc = np.full(m.E.shape, 1e-3, np.float32), [np.full(w.shape, 1e-3, np.float32) for w in m.W], np.full(m.b.shape, 1e-3), np.full(m.v.shape, 1e-3), 1e-3
    for epoch in range(epochs):
        lr = rate / (1 + epoch)
        for at in range(0, len(fit), 32):
            batch = fit[at : at + 32]
            flat, starts, inside, n = layout([ids[i] for i in batch], 0, pads)
            real = flat > 0
            e = np.zeros((len(flat), m.dim), np.float32)
            e[real] = m.E[h[flat[real]]].sum(axis=1)
            top, best = [], []
            for w in m.W:
                conv = e @ w[0]
                for j in range(1, len(w)):
                    conv[: len(e) - j] += e[j:] @ w[j]
                arg = np.stack([s + conv[s : s + k].argmax(axis=0) for s, k in zip(starts, n, strict=True)])
                best.append(arg)
                top.append(np.take_along_axis(conv, arg, axis=0))
            hid = np.tanh(np.concatenate(top, axis=1) + m.b)
            p = 1 / (1 + np.exp(-np.clip(hid @ m.v + m.c, -30, 30)))
            d = (p - labels[batch]) * weight[batch] / len(batch)
            dv, dc = hid.T @ d + 1e-4 * m.v, d.sum()
            dh = d[:, None] * m.v * (1 - hid**2)
            de = {}
            for x, (w, arg) in enumerate(zip(m.W, best, strict=True)):
                g = dh[:, x * m.filters : (x + 1) * m.filters]
                dw = np.zeros_like(w)
                for j in range(len(w)):
                    at_j = np.minimum(arg + j, len(e) - 1)
                    ej = e[at_j]  # (texts, filters, dim)
                    dw[j] = np.einsum("tf,tfd->df", g, ej)
                    for f in range(m.filters):
                        np.add.at(acc := de.setdefault("g", np.zeros_like(e)), at_j[:, f], g[:, f, None] * w[j][:, f])
                gW[x] += dw**2
                w -= lr * dw / np.sqrt(gW[x])
            acc = de["g"]
            hit = np.flatnonzero(real & np.any(acc != 0, axis=1))
            for t in range(3):
                rows, inv = np.unique(h[flat[hit], t], return_inverse=True)
                g = np.zeros((len(rows), m.dim), np.float32)
                np.add.at(g, inv, acc[hit])
                gE[rows] += g**2
                m.E[rows] -= lr * g / np.sqrt(gE[rows])
            db = dh.sum(axis=0)
            gb += db**2
            gv += dv**2
            gc += dc**2
            m.b -= (lr * db / np.sqrt(gb)).astype(np.float32)
            m.v -= (lr * dv / np.sqrt(gv)).astype(np.float32)
            m.c -= float(lr * dc / np.sqrt(gc))
        fit = rng.permutation(fit)
    scorer = Scorer(m, 1 << 62)
    z, lang = (np.concatenate(x) for x in zip(*(scorer.logits([texts[i] for i in held[k : k + 200]]) for k in range(0, max(1, len(held)), 200)), strict=True)) if len(held) else (np.empty(0), np.empty(0, int))
    common = threshold(z, labels[held])
    for k in range(LANGS):
        own = lang == k
        # too few examples of either label: the common threshold
        enough = min(labels[held][own].sum(), (1 - labels[held][own]).sum()) >= 5
        m.shift[k] = threshold(z[own], labels[held][own]) if enough else common
    return m


def threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that gives the best F1, in the middle of the gap between its neighbours."""
    if not len(z) or y.sum() == 0:
        return 0.0
    order = np.argsort(-z)
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(z) + 1) + y.sum())
    k = int(f1.argmax())
    return float((z[order[k]] + (z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1)) / 2)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row over its whole text. Null and empty texts get the score of no words."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in slices(batch, 400, 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.scores(part.column(1).to_pylist()), pa.float64())], names=[id_col, "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double")


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, max_rows: int = 8000, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Model from at most ``max_rows`` labelled rows and ``max_bytes`` of text, chosen by a hash of the id, none of the held-out fold.

    Rows without id, text or label are left out; without rows of both labels the model gives one constant score.
    """
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    y = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).where("y is not null").where(fold != held_fold)
    y = y.groupBy(id_col).agg(F.max("y").alias("y")).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(max_rows)
    rows = docs.select(id_col, F.col(text_col).cast("string").alias("text")).join(F.broadcast(y), id_col).where("text is not null")  # y: max_rows rows
    got = sampled(rows, id_col, max_rows, max_bytes)
    return train(got["text"].to_pylist(), got["y"].to_numpy())
