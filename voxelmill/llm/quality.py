"""Quality by co-training of two views of a document.

The text view sees words and their shapes (hashed, logistic regression over their mean weights); the metadata view
sees source, language, size and layout figures. Both start from labelled documents. In each round either view labels
the unlabelled documents it is surest of, and those become training rows of the *other* view. In the end both
views are calibrated on labelled documents kept out of training, and a logistic combination of the calibrated
logits scores every document.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import sampled
from .words import GrowingTable, Vocabulary, slices

BUCKETS = 1 << 17
_RUN = re.compile(r"(.)\1+", re.S)
_SHAPE = str.maketrans({**{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})
HASHED = 64


def features(word: str) -> tuple[int, int]:
    """Bucket numbers of the word and of its shape (letter case, digits, symbols; runs count once)."""
    shape = "".join("x" if c.isalpha() and c.islower() else "X" if c.isalpha() else c for c in word.translate(_SHAPE)) if not word.isascii() else word.translate(_SHAPE)
    return xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS, BUCKETS + xxhash.xxh64_intdigest(_RUN.sub(r"\1", shape).encode("utf-8", "surrogatepass"), 1) % BUCKETS


class Words:
    """Bucket numbers of texts; remembers the words of a bounded vocabulary."""

    def __init__(self, cap: int = 300_000):
        self.vocab = Vocabulary(cap)
        self.table = GrowingTable(2, np.int32)

    def __call__(self, texts: list) -> list[np.ndarray]:
        if self.vocab.renew():
            self.table = GrowingTable(2, np.int32)
        words = [(t or "").split() for t in texts]
        ids = self.vocab.number(list(itertools.chain.from_iterable(words)))
        if new := self.vocab.fresh():
            self.table.append(np.array([features(w) for w in new], np.int32))
        return [self.table.rows[x] for x in np.split(ids, np.cumsum([len(w) for w in words])[:-1])] if texts else []


def layout(text, source, lang) -> np.ndarray:
    """The metadata view of one document."""
    t = text or ""
    lines = t.split("\n")
    n, words = max(1, len(t)), max(1, t.count(" ") + len(lines))
    out = np.zeros(8 + HASHED, np.float32)
    out[:8] = 1, np.log1p(len(t)) / 10, np.log1p(len(lines)) / 5, np.log1p(n / len(lines)) / 8, n / words / 10, len(set(lines)) / len(lines), sum(map(len, lines[:1])) / n, t.endswith((".", "!", "?"))
    for i, x in enumerate((source, lang)):
        out[8 + xxhash.xxh64_intdigest(f"{i}{x}".encode("utf-8", "surrogatepass")) % HASHED] += 1
    return out


@dataclass
class QualityModel:
    text: np.ndarray  # weights by bucket, the last is the bias
    meta: np.ndarray
    scale: np.ndarray  # calibration by view: slope, offset
    mix: np.ndarray  # of the calibrated logits: text, metadata, offset

    def logits(self, words: list[np.ndarray], meta: np.ndarray) -> np.ndarray:
        """Calibrated logits, a column a view."""
        raw = np.stack([text_logit(self.text, words), meta @ self.meta], axis=1) if len(words) else np.zeros((0, 2))
        return raw * self.scale[:, 0] + self.scale[:, 1]

    def score(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(z @ self.mix[:2] + self.mix[2])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def text_logit(w: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    return np.array([w[x].sum(axis=1).mean() if len(x) else 0.0 for x in words]) + w[-1]


def _fit_text(words, y, weight, epochs=12, rate=2.0, seed=1):
    w, g2 = np.zeros(2 * BUCKETS + 1, np.float32), np.full(2 * BUCKETS + 1, 1e-4, np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(words)):
            x = words[i].ravel()
            d = (sigmoid((w[x].sum() / max(1, len(words[i]))) + w[-1]) - y[i]) * weight[i]
            at, n = np.unique(np.append(x, 2 * BUCKETS), return_counts=True)
            g = d * n / max(1, len(words[i]))
            g[-1] = d
            g2[at] += g * g
            w[at] -= (rate * 0.1 * g / np.sqrt(g2[at])).astype(np.float32)
    return w


def _fit_meta(x, y, weight, steps=400, rate=0.5, l2=1e-3):
    w, g2 = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-6)
    for _ in range(steps):
        g = x.T @ ((sigmoid(x @ w) - y) * weight) / len(y) + l2 * w
        g2 += g * g
        w -= rate * g / np.sqrt(g2)
    return w


def _balanced(y):
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    return np.where(y > 0, 0.5 / p, 0.5 / (1 - p))


def cotrain(texts: list, meta: np.ndarray, labels: np.ndarray, rounds: int = 3, grow: float = 0.1, sure: float = 0.9, seed: int = 2) -> QualityModel:
    """labels: 0, 1 or -1 for unlabelled. Each round a view gives the other up to ``grow`` of the pool, as many of either
    label as the labelled rows suggest, and only with a probability of at least ``sure``."""
    rng = np.random.default_rng(seed)
    words, labels = Words(1 << 62)(texts), np.asarray(labels)
    known = rng.permutation(np.flatnonzero(labels >= 0))
    held, base = known[: len(known) // 4], known[len(known) // 4 :]
    blank = QualityModel(np.zeros(2 * BUCKETS + 1, np.float32), np.zeros(meta.shape[1] if meta.ndim == 2 else 8 + HASHED), np.array([[1.0, 0], [1, 0]]), np.array([0.5, 0.5, 0]))
    if not len(base) or len(np.unique(labels[base])) < 2:
        blank.mix[2] = 0.0 if not len(base) else (4.0 if labels[base][0] else -4.0)
        return blank
    pool = set(np.flatnonzero(labels < 0).tolist())
    rate = labels[base].mean()
    extra: list[dict] = [{}, {}]  # pseudo-labels by view
    for turn in range(rounds + 1):
        fitted = []
        for view in (0, 1):
            rows = np.concatenate([base, np.fromiter(extra[view], np.int64, len(extra[view]))])
            y = np.concatenate([labels[base], np.fromiter(extra[view].values(), np.float64, len(extra[view]))])
            weight = _balanced(y) * np.concatenate([np.ones(len(base)), np.full(len(extra[view]), 0.5)])
            fitted.append(_fit_text([words[i] for i in rows], y, weight) if view == 0 else _fit_meta(meta[rows], y, weight))
        if turn == rounds:
            break
        for view in (0, 1):
            rest = np.array(sorted(pool), np.int64)
            if not len(rest):
                break
            p = sigmoid(text_logit(fitted[0], [words[i] for i in rest]) if view == 0 else meta[rest] @ fitted[1])
            many = grow * (labels < 0).sum()
            for value, share in ((1, rate), (0, 1 - rate)):
                sureness = p if value else 1 - p
                top = rest[np.argsort(-sureness, kind="stable")[: max(1, int(many * share))]]
                for i in top[np.sort(-sureness, kind="stable")[: len(top)] <= -sure]:
                    extra[1 - view][int(i)] = value
                    pool.discard(int(i))
    m = QualityModel(fitted[0], fitted[1], blank.scale, blank.mix)
    y = labels[held].astype(float)
    if len(held) > 8 and len(np.unique(y)) == 2:
        raw = np.stack([text_logit(m.text, [words[i] for i in held]), meta[held] @ m.meta], axis=1)
        m.scale = np.stack([_fit_meta(np.stack([raw[:, v], np.ones(len(held))], axis=1), y, np.ones(len(held)), steps=800, l2=1e-4) for v in (0, 1)])
        z = np.clip(raw * m.scale[:, 0] + m.scale[:, 1], -8, 8)
        m.mix = _fit_meta(np.column_stack([z, np.ones(len(held))]), y, np.ones(len(held)), steps=800, l2=1e-3)
    return m


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, max_labelled: int = 3000, max_unlabelled: int = 3000, max_bytes: int = 32 << 20, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Model from at most so many labelled and unlabelled documents, and ``max_bytes`` of the texts of each, chosen by a
    hash of the id, none of the held-out fold.
    Rows without id or text are left out; without both labels every score is the same."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    y = labels.select(id_col, F.col(label_col).cast("int").alias("y")).where("y is not null").groupBy(id_col).agg(F.max("y").alias("y"))
    rows = docs.select(id_col, *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang"))).where((fold != held_fold) & F.col(id_col).isNotNull() & F.col("text").isNotNull())
    known = sampled(rows, id_col, max_labelled, max_bytes, only=lambda ids: ids.join(y.select(id_col), id_col, "left_semi"))
    other = sampled(rows, id_col, max_unlabelled, max_bytes, only=lambda ids: ids.join(y.select(id_col), id_col, "left_anti"))
    chosen = docs.sparkSession.createDataFrame(known.select([id_col]), schema=rows.select(id_col).schema).distinct()  # max_labelled ids
    value = dict(zip(*(c.to_pylist() for c in y.join(F.broadcast(chosen), id_col).select(id_col, "y").toArrow().columns), strict=True))
    label = pa.array([value[i] for i in known[id_col].to_pylist()] + [-1] * len(other), pa.int64())
    got = pa.concat_tables([known, other]).append_column("y", label).sort_by([(id_col, "ascending"), ("text", "ascending")])
    texts = got["text"].to_pylist()
    meta = np.array([layout(*x) for x in zip(texts, got["source"].to_pylist(), got["lang"].to_pylist(), strict=True)], np.float32).reshape(len(texts), 8 + HASHED)
    return cotrain(texts, meta, got["y"].to_numpy())


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """(id, text_score, metadata_score, score) of every row over its whole text; null texts, sources and languages count as such."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m, words = shared.value, Words()
        for batch in batches:
            for part in slices(batch, 500, 4 << 20):
                texts, source, lang = (part.column(c).to_pylist() for c in (1, 2, 3))
                z = np.clip(m.logits(words(texts), np.array([layout(*x) for x in zip(texts, source, lang, strict=True)])), -8, 8)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.float64()) for x in (sigmoid(z[:, 0]), sigmoid(z[:, 1]), m.score(z)))], names=[id_col, "text_score", "metadata_score", "score"])

    rows = docs.select(id_col, *(F.col(c).cast("string").alias(c) for c in ("text", "source", "lang")))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, text_score double, metadata_score double, score double")
