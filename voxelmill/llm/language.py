"""Language identification by a byte convolutional network, trained in numpy.

Filters of widths 2, 3 and 4 over one-hot bytes, max pooling over a fixed-length window, softmax. A text is cut
into windows of 256 filter positions; its prediction is the mean of its windows' probabilities, weighted by
their letters, so every byte of the text counts. A filter over one-hot bytes is a table look-up: for
scoring, the filters of two neighbouring bytes are merged into 65,536-row tables of 16-bit integers.

The network knows no "none of these". ``Known`` does: byte trigrams of each learned language give a text's words
a likelihood, and bounds on it, one a language, lie between what held-back texts of that language reach and what
texts reach whose language is left out or whose letters are shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import sampled
from .words import slices

WINDOW = 256
WIDTHS = (2, 3, 4)
_WORD = re.compile(r"[^\W_]+")
_LETTER = re.compile(r"[^\W\d_]")
_IS_LETTER = np.array([c > 127 or chr(c).isalpha() for c in range(256)])


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter; ``½``, ``²`` and ``①`` are none."""
    return bool(text) and any(m[0].isalpha() for m in _LETTER.finditer(text))


def to_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)


def windows(data: np.ndarray) -> np.ndarray:
    """All windows of a text: WINDOW positions each, and the bytes that the filters of the last ones reach."""
    n = max(1, -(-len(data) // WINDOW))
    padded = np.zeros(n * WINDOW + max(WIDTHS) - 1, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW + max(WIDTHS) - 1)[::WINDOW]


@dataclass
class LanguageModel:
    langs: list
    W: list = None  # by width: (width, 256, filters)
    b: np.ndarray = None
    V: np.ndarray = None
    c: np.ndarray = None

    def prepared(self):
        """Merged integer tables: at i (three widths) and at i + 2 (the rest of widths 3 and 4)."""
        scale = 8000 / max(1e-6, max(np.abs(w).sum(axis=0).max() for w in self.W))
        f = self.W[0].shape[2]
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, f)
        near = np.concatenate([pair(w[0], w[1]) for w in self.W], axis=1)
        far = np.concatenate([np.repeat(self.W[1][2], 256, axis=0), pair(self.W[2][2], self.W[2][3])], axis=1)
        return np.round(near * scale).astype(np.int16), np.round(far * scale).astype(np.int16), scale

    def probabilities(self, win: np.ndarray, tables) -> np.ndarray:
        near, far, scale = tables
        f = self.W[0].shape[2]
        two = (win[:, :-1].astype(np.uint16) << 8) | win[:, 1:]
        conv = near[two[:, :WINDOW]]
        conv[:, :, f:] += far[two[:, 2 : WINDOW + 2]]
        half = WINDOW // 2
        while half:
            conv = np.maximum(conv[:, :half], conv[:, half : 2 * half])
            half //= 2
        z = np.maximum(conv[:, 0].astype(np.float32) / scale + self.b, 0) @ self.V + self.c
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(texts: list, langs: list, filters: int = 16, per_text: int = 3, epochs: int = 10, rate: float = 0.004, seed: int = 3) -> LanguageModel:
    """Adam on random windows of the texts."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    m = LanguageModel(names)
    m.W = [rng.normal(0, 0.05, (k, 256, filters)).astype(np.float32) for k in WIDTHS]
    m.b = np.zeros(filters * len(WIDTHS), np.float32)
    m.V = rng.normal(0, 0.2, (filters * len(WIDTHS), max(1, len(names)))).astype(np.float32)
    m.c = np.zeros(max(1, len(names)), np.float32)
    xs, ys = [], []
    for t, y in zip(texts, langs, strict=True):
        data = to_bytes(t)
        for _ in range(per_text):
            at = int(rng.integers(0, max(1, len(data) - WINDOW)))
            xs.append(windows(data[at : at + WINDOW])[0])
            ys.append(names.index(y))
    if len(names) < 2:
        return m
    X, Y = np.stack(xs), np.array(ys)
    weight = (len(Y) / (len(names) * np.bincount(Y)))[Y]
    params = [*m.W, m.b, m.V, m.c]
    one, two, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(Y))
        for at in range(0, len(order), 64):
            rows = order[at : at + 64]
            win = X[rows]
            top, arg = [], []
            for w in m.W:
                conv = w[0][win[:, :WINDOW]]
                for j in range(1, len(w)):
                    conv += w[j][win[:, j : WINDOW + j]]
                a = conv.argmax(axis=1)
                arg.append(a)
                top.append(np.take_along_axis(conv, a[:, None, :], axis=1)[:, 0])
            pre = np.concatenate(top, axis=1) + m.b
            hid = np.maximum(pre, 0)
            z = hid @ m.V + m.c
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), Y[rows]] -= 1
            d = p * weight[rows, None] / len(rows)
            dh = (d @ m.V.T) * (pre > 0)
            grads = []
            for x, (w, a) in enumerate(zip(m.W, arg, strict=True)):
                g = np.zeros_like(w)
                own = dh[:, x * filters : (x + 1) * filters]
                for j in range(len(w)):
                    byte = np.take_along_axis(win, a + j, axis=1)
                    np.add.at(g[j], (byte, np.arange(filters)[None, :]), own)
                grads.append(g)
            grads += [dh.sum(axis=0), hid.T @ d + 1e-4 * m.V, d.sum(axis=0)]
            step += 1
            lr = rate / (1 + 0.3 * epoch) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, g, u, v in zip(params, grads, one, two, strict=True):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                q -= (lr * u / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return m


def predict(texts: list, m: LanguageModel, tables, chunk: int = 64) -> tuple[list, list]:
    """(language or 'und', score) by text."""
    out, score = ["und"] * len(texts), [0.0] * len(texts)
    rows, parts = [], []
    for i, t in enumerate(texts):
        if m.langs and has_letter(t):
            parts.append(windows(to_bytes(t)))
            rows.append(np.full(len(parts[-1]), i))
    if not parts:
        return out, score
    win, row = np.concatenate(parts), np.concatenate(rows)
    total = np.zeros((len(texts), len(m.langs)))
    for at in range(0, len(win), chunk):
        w = win[at : at + chunk]
        letters = _IS_LETTER[w[:, :WINDOW]].sum(axis=1) + 1e-3
        np.add.at(total, row[at : at + chunk], m.probabilities(w, tables) * letters[:, None])
    for i in np.unique(row):
        best = int(total[i].argmax())
        out[i], score[i] = m.langs[best], float(total[i, best] / total[i].sum())
    return out, score


SLOTS = 1 << 18
#: Backing off to two bytes costs as much as a probability of this.
BACK_OFF = 0.05
#: Fewest texts from which a language gets a bound.
LEAST_TEXTS = 8


def _lines(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words without digits, a blank before each and two before a line's first, as bytes; where each line begins; its text."""
    parts, row = [], []
    for i, t in enumerate(texts):
        for line in (t or "").lower().split("\n"):
            words = [w for w in _WORD.findall(line) if w.isalpha()]
            if words:
                parts.append(("  " + " ".join(words) + " ").encode("utf-8", "surrogatepass"))
                row.append(i)
    size = np.array([len(x) for x in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, np.array(row, np.int64)


def _grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the two and the three bytes that begin at each place but the last two."""
    x = data.astype(np.uint32)
    two = (x[:-1] << 8) | x[1:]
    three = ((two[:-1] << 8) | x[2:]) * np.uint32(2654435761) >> np.uint32(14)
    return two, three


class Trigrams:
    """Logarithms of P(byte | two before); of unseen triples, those of P(byte | one before) and the price of backing off."""

    def __init__(self, texts: list):
        data, start, _ = _lines(texts)
        two, three = _grams(data) if len(data) else (np.empty(0, np.uint32),) * 2
        inner = np.ones(len(three), bool)
        for back in (1, 2):
            inner[start[1:] - back] = False
        pairs = np.bincount(two, minlength=65536).astype(np.float64).reshape(256, 256)
        one = (pairs.sum(axis=0) + 1) / (pairs.sum() + 256)
        self.two = np.log(BACK_OFF * (pairs + one) / (pairs.sum(axis=1, keepdims=True) + 1)).reshape(-1).astype(np.float32)
        count = np.bincount(three[inner], minlength=SLOTS)
        before = np.zeros(SLOTS)
        before[three[inner]] = np.bincount(two, minlength=65536)[two[:-1][inner]]
        self.three = np.where(count > 0, np.log(np.maximum(count, 1) / np.maximum(before, count).clip(1)), 1).astype(np.float16)


def _likelihoods(texts: list, tables: list[Trigrams]) -> tuple[np.ndarray, np.ndarray]:
    """By text: the sum of its lines' log likelihoods, each in its best language; the sums in every language; bytes."""
    best, lead, size = np.zeros(len(texts)), np.zeros((len(texts), len(tables))), np.zeros(len(texts), np.int64)
    data, start, row = _lines(texts)
    if not len(start):
        return best, lead, size
    two, three = _grams(data)
    outer = np.zeros(len(three), bool)
    for back in (1, 2):
        outer[start[1:] - back] = True
    by = np.empty((len(start), len(tables)))
    for k, t in enumerate(tables):
        seen = t.three[three].astype(np.float32)
        value = np.where(seen <= 0, seen, t.two[two[1:]])
        value[outer] = 0
        by[:, k] = np.add.reduceat(value, start, dtype=np.float64)
    np.add.at(best, row, by.max(axis=1))
    np.add.at(lead, row, by)
    np.add.at(size, row, np.diff(start, append=len(data)) - 2)
    return best, lead, size


@dataclass
class Known:
    """Which texts are in one of the learned languages. A text is in none when its words' log likelihood, each line
    in its best language, falls short of ``bound`` a byte by more than ``slack``, both of the language the network
    gives it; so a few words never suffice to reject. Where nothing was learned, texts with a letter stay."""

    langs: list
    tables: list
    bound: np.ndarray
    slack: np.ndarray

    def judge(self, texts: list, langs: list) -> list[bool]:
        """``langs``: the network's, by text."""
        if not self.langs:
            return [has_letter(t) for t in texts]
        best, _, size = _likelihoods(texts, self.tables)
        at = np.array([self.langs.index(x) if x != "und" else 0 for x in langs], np.int64)
        near = best >= self.bound[at] * size - self.slack[at]
        return [bool(ok and x != "und") for ok, x in zip(near, langs, strict=True)]


def calibrate(texts: list, langs: list, folds: int = 4, seed: int = 5) -> Known:
    """Bounds from labelled texts, each scored by tables that never saw it. A language with fewer than LEAST_TEXTS
    texts gets none: what is nearest to it stays."""
    rng, names = np.random.default_rng(seed), sorted(set(langs))
    label = np.array([names.index(x) for x in langs], np.int64)
    fold = np.empty(len(label), np.int64)
    for k in range(len(names)):
        mine = np.flatnonzero(label == k)
        fold[mine] = np.arange(len(mine)) % folds
    of = lambda rows: [texts[i] for i in rows]
    own, others = [[] for _ in names], [[] for _ in names]  # (likelihood, bytes) of texts in their own and in no language
    for f in range(folds):
        tables = [Trigrams(of(np.flatnonzero((label == k) & (fold != f)))) for k in range(len(names))]
        for k in range(len(names)):
            rows = np.flatnonzero((label == k) & (fold == f))
            best, _, size = _likelihoods(of(rows), tables)
            for x, n in zip(best, size, strict=True):
                own[k].append((x, n))
            mixed = ["".join(rng.permutation(list(t[:2000]))) for t in of(rows)]
            left = [(mixed, range(len(names)))] + [(of(rows), [j for j in range(len(names)) if j != k])] * (len(names) > 1)
            for false, there in left:
                best, lead, size = _likelihoods(false, [tables[j] for j in there])
                for x, at, n in zip(best, lead.argmax(axis=1), size, strict=True):
                    others[there[at]].append((x, n))
    bound, slack = np.full(len(names), -1e9), np.zeros(len(names))
    for k in range(len(names)):
        if len(own[k]) < LEAST_TEXTS:
            continue
        x, n = np.array(own[k]).T
        long = n >= min(200, np.median(n))
        low = np.quantile((x / np.maximum(n, 1))[long], 0.01)
        y, m = np.array([z for z in others[k] if z[1] >= 200] or [(-1e3, 1.0)]).T
        high = np.quantile(y / m, 0.99)
        bound[k] = (low + high) / 2 if len(y) > 1 and high < low else low - 0.1
        slack[k] = 5 + 1.5 * max(0.0, (bound[k] * n - x).max())
    return Known(names, [Trigrams(of(np.flatnonzero(label == k))) for k in range(len(names))], bound, slack)


def sample(docs: DataFrame, folds: int = 3, held_fold: int = 1, max_rows: int = 4000, max_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list, list]:
    """Whole texts and languages of at most ``max_rows`` rows and ``max_bytes`` of text, chosen by a hash of the id, none of
    the held-out fold. Rows without id, text or language are left out; no rows give no rows."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    rows = docs.where((fold != held_fold) & F.col(lang_col).isNotNull()).select(id_col, F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    got = sampled(rows.where(F.trim("text") != ""), id_col, max_rows, max_bytes)
    return got["text"].to_pylist(), got["lang"].to_pylist()


def fit(docs: DataFrame, **options) -> LanguageModel:
    """Model from ``sample``'s rows."""
    return train(*sample(docs, **options))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row over its whole text; 'und' and 0 for null texts and texts without a letter."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        tables = m.prepared()
        for batch in batches:
            for part in slices(batch, 500, 4 << 20):
                lang, score = predict(part.column(1).to_pylist(), m, tables)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
