"""Every operator against brute force, a round trip or held-out labels, and on awkward tables."""

import hashlib
import html
import random
import time
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelmill.llm import chat, decontaminate, embedding_dedup, html_extract, language, ngram_join, packing, quality, toxicity, url_filter
from voxelmill.llm.components import connected_components
from voxelmill.llm.queries import ORACLES, QUERIES, tokenizer_path
from voxelmill.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n long"
LONG = "alpha beta gamma delta " * 6000


def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, columns that clash with the operators' own."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 58, 0.5, 1),
        (2, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 58, 0.5, 1),
        (2, "The quick brown fox jumps over the lazy dog and runs away.", "en", "a", 58, 0.5, 1),
        (3, None, "de", None, None, None, None), (4, "", None, "b", 0, 0.0, 0), (None, "Der Hund und die Katze sind nicht im Haus.", "de", "b", 1, 0.1, 2),
        (5, LONG, "en", None, len(LONG), None, 3), (6, "one two", None, "c", 7, 0.2, 4), (7, "!!! 123 \u0000 \n\t", "fr", "c", 9, 0.2, 4), (8, "ONE two", "fr", "\u0000", 9, 0.2, 4),
    ]
    return spark.createDataFrame(rows, DOCS)


def read(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet")


# -- components -------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (1, None)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()))
    want = components(e for e in edges if e[1] is not None and e[0] != e[1])
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def components(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


# -- 1, 2, 9: classifiers ----------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).toPandas()
    hit, said, true = ((rows.score >= 0.5) & (rows.toxic == 1)).sum(), (rows.score >= 0.5).sum(), (rows.toxic == 1).sum()
    assert hit / said > 0.9 and hit / true > 0.75


def test_toxicity_pooling_matches_plain_loops():
    rng = np.random.default_rng(0)
    words = ["a", "b", "c", "bad"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 9))) for _ in range(60)]
    labels = np.array(["bad" in t for t in texts], int)
    m = toxicity.train(texts, labels, epochs=3)
    z, _ = toxicity.Scorer(m).logits(texts)
    for t, got in zip(texts, z, strict=True):
        e = m.E[toxicity.hashes(toxicity.split(t), m.buckets)].sum(axis=1) if t else np.zeros((0, m.dim))
        e = np.concatenate([e if len(e) else np.zeros((1, m.dim)), np.zeros((2, m.dim))])
        top = [max(sum(e[i + j] @ w[j][:, f] for j in range(len(w))) for i in range(max(1, len(e) - 2))) for w in m.W for f in range(m.filters)]
        assert np.tanh(np.array(top) + m.b) @ m.v + m.c == pytest.approx(got, abs=1e-4)
    assert len(toxicity.Scorer(m).scores([])) == 0


def test_classifiers_on_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (None, 1, 1), (5, None, 1), (99, 1, 1)], "doc_id long, toxic int, quality int")
    for table in (docs, docs.limit(0)):
        n = table.count()
        for marks in (labels, labels.limit(0)):
            t = toxicity.score(table, toxicity.fit(table, marks)).collect()
            q = quality.score(table, quality.fit(table, marks)).collect()
            assert len(t) == len(q) == n and all(0 <= r.score <= 1 for r in [*t, *q])
        got = language.identify(table, language.fit(table)).collect()
        assert len(got) == n and all((r.lang_pred == "und") == (r.doc_id in (3, 4, 7)) for r in got) and all(0 <= r.score <= 1 for r in got)


def test_language_held_out(spark):
    rows = QUERIES["op9_language"](spark, SF).join(read(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows.lang_pred == rows.lang).mean() > 0.97


def test_language_tables_match_the_network():
    m = language.train(["the cat and the dog of it " * 9, "der hund und die katze im haus " * 9], ["en", "de"], epochs=2)
    win = np.stack([language.windows(language.to_bytes(t))[0] for t in ("der Hund", "the cat", "x" * 400)])
    top = []
    for w in m.W:
        conv = sum(w[j][win[:, j : language.WINDOW + j]] for j in range(len(w)))
        top.append(conv.max(axis=1))
    z = np.maximum(np.concatenate(top, axis=1) + m.b, 0) @ m.V + m.c
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert m.probabilities(win, m.prepared()) == pytest.approx(p / p.sum(axis=1, keepdims=True), abs=5e-3)
    text = "é" * 1000
    assert len(language.windows(language.to_bytes(text))) == 8 and language.predict([None, "", "12 !"], m, m.prepared()) == (["und"] * 3, [0.0] * 3)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op2_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (rows.predicted == rows.quality).mean() > 0.9


def test_cotraining_uses_the_pool():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 400)
    texts = [" ".join(rng.choice(["good", "fine", "nice"] if v else ["junk", "spam", "trash"], 8)) + (" w%d" % i) for i, v in enumerate(y)]
    meta = np.array([quality.layout(t, "s%d" % v, "en") for t, v in zip(texts, y, strict=True)], np.float32)
    known = np.where(np.arange(400) < 16, y, -1)
    m = quality.cotrain(texts, meta, known)
    z = m.logits(quality.Words()(texts), meta)
    assert ((m.score(z) >= 0.5) == y).mean() > 0.95


# -- 3: chat ----------------------------------------------------------------------------------------------------


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int, tokens string")


def test_chat_digests(spark):
    got = {r.conv_id: r for r in QUERIES["op3_chat_windows"](spark, SF).collect()}
    convs = defaultdict(list)
    for r in sorted(read(spark, "conversations").collect(), key=lambda r: (r.conv_id, r.turn, r.role, r.text)):
        convs[r.conv_id].append((r.role, r.text or ""))
    convs[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_windows(spark):
    word = "word " * 20
    rows = [(1, 0, "system", "be brief", 1, "x")] + [(1, i, "user" if i % 2 else "assistant", f"{i} {word}", 1, "x") for i in range(1, 30)]
    rows += [(2, 0, None, None, None, None), (2, 0, "assistant", "\\[INST] <<SYS>> \\", 2, "y"), (2, 0, "assistant", "\\[INST] <<SYS>> \\", 2, "y"), (2, 1, "tool<</ROLE>>", "</s><</TURN>>", 2, "y"), (None, 5, "assistant", word * 200, None, None), (3, None, "user", "", 0, "")]
    got = chat.format_windows(turns_of(spark, rows), tokenizer_path(), budget=120, history=2).orderBy("conv_id", "window").collect()
    one = [r for r in got if r.conv_id == 1]
    assert len(one) > 5 and all(r.tokens <= 120 for r in one) and all(r.text.startswith("<<SYS>>be brief<</SYS>>") for r in one)
    assert all(r.n_repeated in (1, 2, 3) for r in one[1:]) and any(r.n_repeated > 1 for r in one) and one[0].n_repeated == 0
    fresh = [t for r in one for t in chat.parse(r.text)[r.n_repeated :]]
    assert fresh == [(r, t) for _, _, r, t, _, _ in rows[:30]]
    targets = [chat.unescape(r.text[a:b]) for r in one for a, b in zip(r.loss_from, r.loss_to, strict=True)]
    assert targets == [t for _, _, r, t, _, _ in rows[:30] if r == "assistant"]
    tokenizer = packing.PieceTokenizer(tokenizer_path())
    assert all(sum(tokenizer.count("".join(chat.render(*t))) for t in chat.parse(r.text)) == r.tokens for r in got)  # marks count
    wide = [(1, 0, "system", "w " * 90, 1, "x")] + [(1, i, "user", "w " * 50, 1, "x") for i in range(1, 9)]
    wide = chat.format_windows(turns_of(spark, wide), tokenizer_path(), budget=115).collect()
    assert len(wide) > 3 and all(r.tokens <= 115 for r in wide)  # no room for the system turn
    two = [t for r in got if r.conv_id == 2 for t in chat.parse(r.text)[r.n_repeated :]]
    assert two == [("", ""), ("assistant", "\\[INST] <<SYS>> \\"), ("assistant", "\\[INST] <<SYS>> \\"), ("tool<</ROLE>>", "</s><</TURN>>")]
    assert [r.tokens > 120 for r in got if r.conv_id is None] == [True]
    assert chat.read_back(chat.format_windows(turns_of(spark, []), tokenizer_path())).count() == 0
    for t in ("", "\\", "a\\\\[INST]", "<s></s>[/INST]", "<<SYS>", "\\n\n"):
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)


# -- 4: embeddings ----------------------------------------------------------------------------------------------


def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    rows, vec = [], 0
    for label in (1, 2):
        base = rng.standard_normal((60, 32))
        for b in base:
            for k in range(int(rng.integers(1, 5))):
                rows.append((vec, [float(x) for x in b + rng.standard_normal(32) * rng.choice([0.0, 0.2, 0.36, 0.5])], label, 0.5, 7))
                vec += 1
    hot = rng.standard_normal(32)
    rows += [(vec + i, [float(x) for x in hot + rng.standard_normal(32) * 0.05], 3, 0.5, 7) for i in range(300)]
    vec += 300
    rows += [(vec, None, 1, 0.0, 1), (vec + 1, [0.0] * 32, 1, 0.0, 1), (vec + 2, [1.0, float("nan")] + [0.0] * 30, 1, 0.0, 1), (vec + 3, [1.0, None] + [0.0] * 30, 1, 0.0, 1), (vec + 4, rows[0][1], None, 0.0, 1), (vec + 5, [float("inf")] * 32, 1, None, None), (vec + 6, rows[0][1][:8], 1, 0.0, 1), (vec + 7, [], 1, 0.0, 1), (None, rows[0][1], 1, 0.0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, p double, bin long")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, block_rows=64).collect()}
    good = {v: (np.array(e), lab) for v, e, lab, _, _ in rows if v is not None and v < vec}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and good[a][0] @ good[b][0] >= 0.93 * np.linalg.norm(good[a][0]) * np.linalg.norm(good[b][0])]
    count, comp = Counter(x for e in links for x in e), components(links)
    assert len(links) > 40_000 and len(got) == len(rows)
    found = sum(r.n_links for r in got.values()) / 2
    assert 0.985 * len(links) <= found <= len(links)
    wrong = sum(got[v].component_id != comp.get(v, v) for v in good)
    assert wrong <= 2 and all(got[v].n_links <= count[v] for v in good)
    for v in range(vec, vec + 8):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (0, v, True)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_at_the_threshold():
    half, least, reach = embedding_dedup.calibrate(0.93, 32, 0.99)
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal(x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    ln = embedding_dedup.lines(48, 32, 3)
    near = np.abs(x @ ln - y @ ln)
    assert (((near <= half).sum(axis=1) >= least) & (near[:, 0] <= reach)).mean() > 0.98
    far = np.abs(x @ ln - x[::-1] @ ln)
    assert ((far <= half).sum(axis=1) >= least).mean() < 0.01


def test_embedding_classes_of_equal_vectors(spark):
    rng = np.random.default_rng(9)
    hot = rng.standard_normal(16)
    near = hot + rng.standard_normal(16) * 0.02
    far = rng.standard_normal(16)
    vectors = [hot] * 1500 + [near, near, far, far * 1e200, far * 1e-200, -far] + [rng.standard_normal(16) for _ in range(300)]
    rows = [(9000 - i, [float(x) for x in v], "a") for i, v in enumerate(vectors)]
    rows += [(9000, rows[0][1], "a"), (9501, rows[0][1], "b"), (9502, [-0.0, 1.0], "b"), (9503, [0.0, 2.0], "b"), (None, rows[0][1], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = defaultdict(list)
    for r in embedding_dedup.near_duplicates(df, block_rows=100).collect():
        got[r.vec_id].append(tuple(r)[1:])
    assert sum(map(len, got.values())) == len(rows) and len(got[9000]) == 2
    for i in range(1502):
        assert set(got[9000 - i]) == {(1501, 9000 - 1501, i == 1501)}
    for i in (1502, 1503, 1504):
        assert got[9000 - i] == [(2, 9000 - 1504, i == 1504)]
    assert got[9000 - 1505] == [(0, 9000 - 1505, True)] and got[9501] == [(0, 9501, True)]
    assert got[9502] == [(1, 9502, True)] and got[9503] == [(1, 9502, False)] and got[None] == [(0, None, True)]


def test_embedding_collisions_are_counted_in_sorted_lines():
    rng = np.random.default_rng(3)
    a, b = np.round(rng.standard_normal((40, 9)), 1), np.round(rng.standard_normal((70, 9)), 1)
    order = np.argsort(b, axis=0)
    got = embedding_dedup.collisions(a, order, np.take_along_axis(b, order, axis=0), 0.25)
    assert (got == (np.abs(a[:, None] - b[None]) <= 0.25).sum(axis=2)).all() and got.max() > 4


# -- 5: packing -------------------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = awkward(spark).unionByName(read(spark, "documents").withColumns({"doc_id": F.col("doc_id") + 1000, "score": F.lit(0.0), "n": F.lit(0).cast("long")}))
    rows = packing.pack(docs, tokenizer_path()).toPandas()
    tok = Tokenizer.from_file(tokenizer_path())
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
    assert rows.length.sum() == sum(len(x) for v in want.values() for x in v)
    by = {(-1 if k != k else k): g.sort_values("start") for k, g in rows.groupby("doc_id", dropna=False)}
    for d, texts in want.items():
        g = by[-1 if d is None else d]
        if len(texts) > 1:
            continue
        assert (g.doc_tokens == len(texts[0])).all() and g.start.iloc[0] == 0 and (g.start + g.length).tolist() == [*g.start.iloc[1:], len(texts[0])]
        assert [zlib.crc32(texts[0][a : a + n].tobytes()) for a, n in zip(g.start, g.length, strict=True)] == g.ids_crc32.tolist()
    seq = rows.sort_values(["sequence_id", "offset"])
    assert ((seq.groupby("sequence_id").length.cumsum() - seq.length) == seq.offset).all()
    size = seq.groupby("sequence_id").length.sum()
    assert (size.iloc[:-1] == 2048).all() and size.index.tolist() == list(range(len(size))) and size.iloc[-1] <= 2048
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0
    few = packing.pack(docs, tokenizer_path(), max_queues=3).toPandas()
    assert few.length.sum() == rows.length.sum() and (few.groupby("sequence_id").length.sum().iloc[:-1] == 2048).all()


def windows_of(rows, docs):
    """Tokens by window and source; the windows must be full and every id in one piece."""
    rows = rows.merge(docs, on="doc_id")
    seq = rows.sort_values(["sequence_id", "offset"])
    assert ((seq.groupby("sequence_id").length.cumsum() - seq.length) == seq.offset).all()
    for _, g in rows.sort_values("start").groupby("doc_id"):
        assert g.start.tolist() == [0, *(g.start + g.length).tolist()[:-1]] and g.length.sum() == g.doc_tokens.iloc[0]
    return rows.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)


def test_pieces_are_looked_up_once(spark, monkeypatch):
    """op5: ids of whole texts, with a piece looked up once for all texts and letters parted from the signs behind them."""
    from tokenizers import Tokenizer

    rng, marks = random.Random(3), ["", "&&&", "'s", "'t", "&'s", "_", "-", "<|endoftext|>", "<", "|", "\u0338", "\u0301", "=\u0338", "é", "Σ", "1", "(", "'re,", "`", "\xa0", "\u2003", "\x0b", "\x1f", "\x85"]
    texts = [None, "", " \n", *(rng.choice(["", " "]).join(rng.choice(["word", "Été", "ß", "a", "don", "ΑΣ", "ÿ"]) + rng.choice(marks) + rng.choice(["", " ", "\t"]) for _ in range(40)) for _ in range(300)), "", None]
    tokenizer, seen = packing.PieceTokenizer(tokenizer_path()), []
    own = packing.Vocabulary.number
    monkeypatch.setattr(packing.Vocabulary, "number", lambda self, words: seen.extend(words) or own(self, words))
    got = tokenizer.encode(texts)
    whole = Tokenizer.from_file(tokenizer_path())
    assert [x.tolist() for x in got] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(seen) == len(set(seen)) and b"word" in seen and b"word&&&" not in seen
    assert [len(x) for x in tokenizer.encode([None, ""])] == [0, 0] and tokenizer.encode([]) == []


def test_packing_of_more_sources_than_queues(spark):
    docs = read(spark, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 23)))
    got = windows_of(packing.pack(docs, tokenizer_path(), max_queues=6).toPandas(), docs.select("doc_id", "source").toPandas())
    totals = got.sum()
    assert len(totals) == 24 and (got.sum(axis=1).iloc[:-1] == 2048).all()
    share = totals / totals.sum()
    # every source keeps its share over any number of windows, to a few tokens
    assert (got.cumsum().iloc[:-1].sub(np.outer(2048 * (np.arange(len(got) - 1) + 1), share)).abs().max() < 6).all()


def test_packing_at_given_proportions(spark):
    docs = read(spark, "documents").withColumn("source", F.when(F.col("doc_id") % 4 == 0, "a").when(F.col("doc_id") % 4 == 1, "b").otherwise(F.concat(F.lit("s"), F.col("doc_id") % 9)))
    ids = docs.select("doc_id", "source").toPandas()
    for queues in (1024, 6):
        got = windows_of(packing.pack(docs, tokenizer_path(), max_queues=queues, proportions={"a": 0.5, "b": 0.1}).toPandas(), ids)
        assert (got.sum(axis=1).iloc[:-1] == 2048).all()
        full = int(got["a"].sum() // 1024) - 1
        assert full > 5 and (got["a"].iloc[:full] - 1024).abs().max() <= 3 and (got["b"].iloc[:full] - 204.8).abs().max() <= 3
    alone = windows_of(packing.pack(docs, tokenizer_path(), proportions={"a": 0.5, "b": 0.5}).toPandas(), ids)
    assert alone.drop(columns=["a", "b"]).iloc[:3].to_numpy().sum() == 0 and (alone["a"].iloc[:3] - 1024).abs().max() <= 3
    with pytest.raises(ValueError):
        packing.pack(docs, tokenizer_path(), proportions={"a": 0.7, "b": 0.5})


def test_round_robin_state():
    totals = [700, 13, 1, 0, 286]
    state = packing.served(np.arange(0, 1001), totals)
    assert (state.sum(axis=1) == np.arange(1001)).all() and state[-1].tolist() == totals and (np.diff(state, axis=0) >= 0).all()
    assert np.abs(state - np.arange(1001)[:, None] * np.array(totals) / 1000).max() < 2
    order = sorted(((k + 0.5) / t, s) for s, t in enumerate(totals) for k in range(t))
    assert state[400].tolist() == [sum(s == x for _, s in order[:400]) for x in range(5)]
    big = [10**13, 3 * 10**12 + 7, 5]
    cut = packing.served(np.array([0, 10**12, 10**12 + 2048, sum(big)]), big)
    assert (cut.sum(axis=1) == [0, 10**12, 10**12 + 2048, sum(big)]).all() and (np.diff(cut, axis=0) >= 0).all()


# -- 6: urls ----------------------------------------------------------------------------------------------------


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(r), k, r) for k, r in url_filter.RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    if fit:
        return host, path, max(fit)[2], max(fit)[1]
    return host, path, None, "block" if any(host == d or host.endswith("." + d) for d in url_filter.LISTED) else "allow"


def test_url_verdicts(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET/EN/x", "http://example.net/en/", "http://a.example.net/en", "https://net/x?y#z", "https://x.net", "https://x.net?/en/", "http://bexample.com/de/1", "http://example.com/de/1", "ftp://www.org/fr/#", "x://a://net/", "http://m.FREE-BETS.example.com/q", "http://notfree-bets.example.com/q", "http://spam-farm.example.org/fr/1", "http://spam-farm.example.org/1", "http://É.NET/a\nb", "http://..//"]
    df = spark.createDataFrame([(i, u, "h", "p", "r") for i, u in enumerate([*urls, *urls])], "page_id long, url string, host string, path string, rule string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(df).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate([*urls, *urls])}
    assert url_filter.judge(df.limit(0)).count() == 0
    assert url_filter.judge(df, rules=(), listed=()).where("verdict = 'block'").count() == 0
    table = spark.createDataFrame([(x,) for x in [*url_filter.LISTED, None, "unseen.example"]], "d string")
    assert {r.page_id: tuple(r)[1:] for r in url_filter.judge(df, listed=table).collect()} == got
    for many in (url_filter.LISTED, table):  # beyond the filter's bound
        assert {r.page_id: tuple(r)[1:] for r in url_filter.judge(df, listed=many, max_keys=1).collect()} == got


def test_cascade_is_exact(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 3 == 0).alias("listed"))
    levels = url_filter.build(keys, bits_per_key=3, hashes=2)
    assert len(levels) > 3 and keys.where(url_filter.passes(F.col("key"), levels) != F.col("listed")).count() == 0
    assert url_filter.build(keys.where("listed")) and url_filter.build(keys.where("not listed")) == []
    with pytest.raises(ValueError):
        url_filter.build(keys, max_keys=10)


def test_sql_of_urls_and_embeddings(spark):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name in ("op6_url_filter", "op4_embedding_dedup"):
        got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).fetchdf()
        key = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False, name=None)))
        assert key(got) == key(want)


# -- 7: html ----------------------------------------------------------------------------------------------------


def test_html_of_the_table(spark):
    got = {r.page_id: r.text for r in QUERIES["op7_html_text"](spark, SF).collect()}
    for r in read(spark, "pages").collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1)\b[^>]*>", body)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


GOOD = "The fox and the dog were in the house for a while, and it was not clear to any of them what they had come for or how to go on from there."


def test_html_rules(spark):
    page = f"""<html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><header><p>{GOOD}</p></header><nav><a href=x>Home</a></nav>
    <div class="cookie-notice">{GOOD}</div><h2>Short head</h2><p>{GOOD} &amp;&nbsp;&eacute;</p><p>Yes, it was.</p><p>{GOOD}</p><ul><li><a href=1>{GOOD}</a></li></ul>
    <form><p>{GOOD}</p></form><div id=comments><p>{GOOD}</p></div><aside>{GOOD}</aside><p>© 2020</p><footer>{GOOD}</footer></body></html>"""
    lines = html_extract.extract(page).split("\n")
    assert lines == ["Short head", GOOD + " & é", "Yes, it was.", GOOD]
    for odd in (None, "", "<", "<p", "<!-- open", "<script>never closed " + GOOD, "</p></div>", "<p>" * 3000, "&#xD800; &#0;", "plain"):
        assert isinstance(html_extract.extract(odd), str)
    assert html_extract.extract("<main><p>Kort.</p><div class='ad'>" + GOOD + "</div></main><p>" + GOOD + "</p>") == "Kort."
    assert len(html_extract.extract("<article>" + f"<p>{GOOD}</p>" * 3000 + "</article>").split("\n")) == 3000
    df = spark.createDataFrame([(1, None, None, "x", 5), (1, None, None, "x", 5), (None, "u", page, None, None)], "page_id long, url string, html string, text string, n_chars long")
    assert sorted(r.n_chars for r in html_extract.extract_pages(df).collect())[:2] == [0, 0] and html_extract.extract_pages(df.limit(0)).count() == 0


def test_html_articles_that_are_not_the_text():
    body = f"<div><p>{GOOD} One.</p><p>{GOOD} Two.</p><p>{GOOD} Three.</p></div>"
    text = "\n".join(f"{GOOD} {n}." for n in ("One", "Two", "Three"))
    card = f"<article><h3>Teaser</h3><p>{GOOD} Read on.</p></article>"
    assert html_extract.extract(f"<body>{body}<aside>{card * 2}</aside><ul><li class=comment><article><p>{GOOD} Mine.</p></article></li></ul></body>") == text
    assert html_extract.extract(f"<body>{body}<article><h3>Teaser</h3></article></body>").startswith(text)
    assert text in html_extract.extract(f"<body><div>{card * 2}</div>{body}</body>")
    assert html_extract.extract(f"<body><div role='main'>{body}</div><div><p>{GOOD} Out.</p></div></body>") == text
    assert html_extract.extract(f"<article>{body}</article><div><p>{GOOD} Out.</p></div>") == text
    assert html_extract.extract("<article><p>Short.</p></article>") == "Short."


@pytest.mark.parametrize(
    "text",
    [
        "Nel pomeriggio i bambini giocavano davanti alla casa dei nonni, mentre gli adulti parlavano della vendemmia e delle piogge che erano cadute.",
        "Вечером дети играли перед домом, а взрослые говорили об урожае и о дождях, которые шли почти всю прошлую неделю в этих местах.",
        "傍晚孩子们在房子前面玩耍，大人们谈论着收成和上个星期几乎一直在下的雨。村里的老人说，这样的天气已经很多年没有见过了，今年的稻子恐怕要晚一些才能收割，大家都有些担心。",
    ],
)
def test_html_of_languages_without_stop_words(text):
    links = f"<p><a href=x>{text}</a></p>"
    for outer in ("div", "article"):
        got = html_extract.extract(f"<body><nav><a href=x>Menu</a></nav><{outer}><p>{text} 1</p>{links}<p>{text} 2</p></{outer}><footer>{text}</footer></body>")
        assert got == f"{text} 1\n{text} 2"
    assert html_extract.extract(f"<p>{GOOD}</p><p>{text}</p><p>{GOOD} {GOOD}</p><p>{GOOD} {GOOD} {GOOD}</p><footer>{text}</footer>").split("\n")[1] == text


def test_html_wrappers_named_like_parts():
    paragraphs, text = f"<p>{GOOD} One.</p><p>{GOOD} Two.</p>", f"{GOOD} One.\n{GOOD} Two."
    for wrap in ("class=no-sidebar", "class='layout-sidebar-right'", 'class="elementor-widget elementor-widget-text-editor"', "id=sidebar", "class='content-wide menu'", "data-id=ad", "class=navy"):
        assert html_extract.extract(f"<body><div {wrap}><div class=sidebar><p>{GOOD}</p></div>{paragraphs}</div><footer>{GOOD}</footer></body>") == text, wrap
    nav = f"<nav><p>{GOOD}</p></nav>"
    assert html_extract.extract(f"<form id=aspnetForm>{nav}<article><header class=entry-header><h1>Title</h1></header>{paragraphs}</article><div class=footer>{GOOD}</div></form>") == f"Title\n{text}"
    comment = f"<article class='comment even'><p>{GOOD} Mine.</p></article>"
    assert html_extract.extract(f"<article class='post comments-open'>{paragraphs}<div>{comment * 5}</div></article>") == text
    for part in ("class='site-footer'", "id=comments", "class='post-comments'", "class=cookie-notice", "class='side-bar'", "class='ad-1'", "id=main-nav", "role=navigation"):
        assert html_extract.extract(f"<div>{paragraphs}</div><div {part}><p>{GOOD}</p></div>") == text, part
    for part in ("id=comments", "class=cookie-consent", "role=navigation"):
        assert html_extract.extract(f"<div>{paragraphs}</div><div {part}>{paragraphs * 3}</div>") == text, part


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<p class=\"x>" * n, lambda n: "<a " * n, lambda n: "<! " * n, lambda n: "<p title='a" * n + f"<p>{GOOD}</p>",
        lambda n: "<article>" + "<p>Short words</p>" * n + "</article>", lambda n: "<p>Short words</p>" * n + f"<p>{GOOD}</p>" + "<p>Short</p>" * n,
        lambda n: "<div>" * n + "</section>" * n,
    ],
)
def test_html_takes_time_in_proportion(page):
    extract, took = html_extract.extract, []
    for n in (4000, 32000):
        began = time.process_time()
        extract(page(n))
        took.append(time.process_time() - began)
    assert took[1] < 0.2 + 24 * took[0]  # 8 times the length; 64 times the time if it grew with the square


def test_html_quotes_that_hold_markup():
    paragraph = f"<p onclick='if (a<b) {{ x > 1 }}' title=\"1 > 0 <b>\">{GOOD}</p>"
    assert html_extract.extract(f"<body>{paragraph}</body>") == html_extract.extract(f"<body><p>{GOOD}</p></body>") != ""


# -- 8: n-gram join ---------------------------------------------------------------------------------------------


def shingles(text, k):
    w = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def check_join(rows, got, k, percent):
    sets = [(d, shingles(t, k)) for d, t in rows]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if a is not None and b is not None and a != b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    comp = components(links)
    assert sorted((d is None, d or 0, len(x), comp.get(d, d) or 0) for d, x in sets) == sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got)
    return links


def test_ngram_join(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 8)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w) + (" " + shared if g % 3 == 0 else "")))
    base = [rng.choice(words) for _ in range(80)]
    for i in range(150):  # a large group of near copies, with copies among them
        w = list(base)
        w[i % 70] = "X" if i % 2 else "y"
        rows.append((len(rows), " ".join(w)))
    rows += [(9001, None), (9002, ""), (9003, "Two\tWORDS"), (9004, "two words"), (9005, " \n"), (None, "two words"), (9006, LONG), (9006, LONG), (9007, LONG + "x")]
    df = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, doc string, n int, gram int").repartition(5)
    got = ngram_join.jaccard_components(df).collect()
    assert len(check_join(rows, got, 4, 85)) > 500
    check_join(rows, ngram_join.jaccard_components(df, words=5, percent=80).collect(), 5, 80)
    kept = ngram_join.keep_one(df).collect()
    assert {r.doc_id for r in kept} >= {9001, 9002, None} and [r.doc_id for r in kept].count(9006) == 1 and kept[0].asDict().keys() == {"doc_id", "text", "doc", "n", "gram"}
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_segments_of_linked_sets_meet():
    rng = np.random.default_rng(4)
    for percent in (50, 80, 85, 97):
        met = linked = 0
        for _ in range(1500):
            x = np.unique(rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.uint64))
            cut = x[rng.random(len(x)) >= rng.random() * (1 - percent / 100)]
            y = np.unique(np.concatenate([cut, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(x) * (100 - percent) // 100)), dtype=np.uint64)]))
            if np.array_equal(x, y) or not ngram_join.similar(len(x), len(y), len(np.intersect1d(x, y)), percent):
                continue
            linked += 1
            keys, rows = ngram_join.segment_keys([x, y], percent)
            met += bool(set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist()))
        assert linked > 100 and met == linked, percent


@pytest.mark.parametrize("sides", [1, 2])
def test_block_product_matches_plain_counts(sides):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(300) < rng.uniform(0.85, 1)], rng.integers(0, 500, int(rng.integers(0, 30)), dtype=np.uint64)])) for _ in range(120)]
    sets += [np.unique(rng.integers(0, 1 << 40, 50, dtype=np.uint64)) for _ in range(5)]
    side = np.array([i % sides for i in range(len(sets))])
    links = [(i, j) for j in range(len(sets)) for i in range(j) if (sides == 1 or side[i] != side[j]) and ngram_join.similar(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])), 80)]
    a, b = ngram_join.links_of(sets, side, 80)
    assert 0 < len(links) and len(a) < len(sets) and components(links) == components(list(zip(a.tolist(), b.tolist(), strict=True)))


def test_ngram_join_of_families_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "FLUSH", 100)
    rng = random.Random(6)
    base, rows = [f"w{rng.randrange(300)}" for _ in range(90)], []
    for i in range(200):
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(90)] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert len(check_join(rows, ngram_join.jaccard_components(df).collect(), 4, 85)) > 100


def test_ngram_join_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    check_join(rows, QUERIES["op8_ngram_join"](spark, SF).collect(), 4, 85)


# -- 10: decontamination ----------------------------------------------------------------------------------------


def plain_shares(items):
    """BM25 shares {item: {word: share}}, written from the formula alone."""
    words = {i: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()) for i, t in items}
    words = {i: w for i, w in words.items() if w}
    df, mean = Counter(x for w in words.values() for x in set(w)), sum(map(len, words.values())) / len(words)
    out = {}
    for i, w in words.items():
        part = {x: math.log(1 + (len(words) - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, f in Counter(w).items()}
        out[i] = {x: v / sum(part.values()) for x, v in part.items()}
    return words, out


def plain_leaks(docs, items, threshold=0.5, least=0.8):
    """All passages against all items, without index, bounds or code of the operator."""
    words, shares = plain_shares([(i, t) for i, t in items if i is not None and t])
    step, out = max(64, *map(len, words.values())), set()
    known = {x for w in words.values() for x in w}
    for d, text in docs:
        own = re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())
        for s in range(0, max(1, len(own)), step):
            there = known.intersection(own[s : s + 2 * step])
            if not there:
                continue
            wide = own[max(0, s - step) : s + 3 * step]
            for i, share in shares.items():
                if (d, i) in out or sum(v for x, v in share.items() if x in there) < threshold - 1e-9:
                    continue
                w, k = words[i], min(5, len(words[i]))
                runs = {tuple(wide[j : j + k]) for j in range(len(wide) - k + 1)}
                hit = [any(tuple(w[j : j + k]) in runs for j in range(max(0, n - k + 1), min(n, len(w) - k) + 1)) for n in range(len(w))]
                tail = max(1, math.ceil(len(w) * 0.2)) if len(w) > 1 else 0
                q, a = hit[: len(w) - tail], hit[len(w) - tail :]
                if (not q or sum(q) >= least * len(q)) and (not a or sum(a) >= 0.5 * len(a)) or sum(hit) >= least * len(hit):
                    out.add((d, i))
    return out


def test_pivots_find_every_item_above_the_threshold():
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(120)]
    p = 1 / np.arange(1, 121)
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 25), p=p / p.sum()))) for i in range(150)]
    _, shares = plain_shares(items)
    for block in (1, 4, 32):
        index = decontaminate.Bm25Index(*zip(*[(i, t, None) for i, t in items], strict=True), block=block)
        for _ in range(40):
            passage = list(rng.choice([*vocabulary, "unseen"], rng.integers(0, 60)))
            want = {i: v for i, s in shares.items() if (v := sum(x for w, x in s.items() if w in passage)) >= 0.5}
            got = dict(index.retrieve(index.number([w.encode() for w in passage]), 0.5))
            assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_decontamination(spark):
    items = [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    docs = [(r.doc_id, r.text) for r in read(spark, "documents").collect()]
    docs += [(9000 + i, f"some words before {t.upper()} and after" if i % 2 else "x " * (i * 7) + t.replace(" ", "  ") + " y" * 300) for i, (_, t) in enumerate(items)]
    docs += [(8000, None), (8001, ""), (8002, LONG + items[0][1]), (8003, items[0][1]), (8003, items[0][1]), (8004, " ".join(items[0][1].split()[::-1]))]
    df = spark.createDataFrame([(d, t, 1.0, 2) for d, t in docs], "doc_id long, text string, score double, item_id int")
    bench = spark.createDataFrame([(i, t, "z") for i, t in items] + [(777, None, "z"), (778, "", "z"), (None, "a b c", "z")], "item_id long, text string, doc_id string")
    found = decontaminate.find_leaks(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == plain_leaks(docs, items)
    assert {(9000 + i, k) for i, (k, _) in enumerate(items)} <= {(r.doc_id, r.item_id) for r in found}
    assert {r.item_id for r in found if r.doc_id == 8002} >= {items[0][0]} and not [r for r in found if r.doc_id == 8004]
    sharded = decontaminate.find_leaks(df, bench, max_items=15)
    assert {(r.doc_id, r.item_id) for r in sharded.collect()} >= {(9000 + i, k) for i, (k, _) in enumerate(items)}
    rest = decontaminate.clean(df, bench)
    assert rest.columns == df.columns and rest.where("doc_id in (8000, 8001)").count() == 2 and rest.where("doc_id >= 9000").count() == 0
    assert decontaminate.find_leaks(df.limit(0), bench).count() == 0 and decontaminate.find_leaks(df, bench.limit(0)).count() == 0
    answers = spark.createDataFrame([(1, "who wrote the long book about whales and the sea", "herman melville of new york")], "item_id long, text string, answer string")
    asked = spark.createDataFrame([(1, "who wrote the long book about whales and the sea herman melville of new york"), (2, "who wrote the long book about whales and the sea nobody knows that any more today")], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.find_leaks(asked, answers, answer_col="answer").collect()] == [1]


def test_decontamination_in_several_indexes(spark):
    bench = read(spark, "benchmark")
    one, many = list(decontaminate.indexes(bench)), list(decontaminate.indexes(bench, max_items=15))
    assert len(one) == 1 and len(many) > 1 and {x.longest for x in many} == {one[0].longest}

    def shares(index):
        word = {i: w for w, i in index.terms.items()}
        return {(word[t], index.ids[index.item[k]]): index.share[k] for t in word for k in range(int(index.start[t]), int(index.start[t] + index.size[t]))}

    whole, parts = shares(one[0]), {}
    for x in many:
        parts |= shares(x)
    assert parts.keys() == whole.keys() and all(parts[k] == pytest.approx(v) for k, v in whole.items())


# -- the pipeline -----------------------------------------------------------------------------------------------


def test_stages_on_awkward_rows(spark):
    docs = awkward(spark)
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, kept, SF)
            assert out.columns == docs.columns and out.count() <= kept.count(), name
            kept = out
        assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).count() >= (1 if table is docs else 0)


def test_language_stage_rejects_languages_it_did_not_learn(spark):
    stage = dict(corpus_pipeline.STAGES)["language"]
    docs = read(spark, "documents").where(F.col("text").rlike(r"\p{L}"))
    for out in ("fr", "es"):
        some = docs.withColumn("lang", F.when(F.col("lang") != out, F.col("lang")))
        strange = ["Вечером дети играли перед домом, а взрослые говорили об урожае и о дождях. " * 5, "zxq wvkj qqpl xzzt jkqw vvbx " * 20, "傍晚孩子们在房子前面玩耍，大人们谈论着收成。" * 10]
        some = some.unionByName(some.limit(1).select(F.explode(F.array(*map(F.lit, strange))).alias("text"), F.lit(-1).cast("long").alias("doc_id")), allowMissingColumns=True)
        kept = {r.doc_id for r in stage(spark, some, SF).select("doc_id").collect()}
        rows = some.withColumn("long", F.length("text") >= 200).collect()
        assert not [r.doc_id for r in rows if r.lang is None and r.long and r.doc_id in kept], out
        clean = [r.doc_id in kept for r in rows if r.lang is not None]
        assert sum(clean) >= 0.99 * len(clean)
    assert stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), SF).count() == docs.count()


def test_pipeline_stages_match_brute_force(spark, tmp_path):
    docs, bench = read(spark, "documents"), [(r.item_id, r.text) for r in read(spark, "benchmark").collect()]
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, docs, SF)
    assert first.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    second = stages["toxicity"](spark, first, SF)
    assert 0.75 * first.count() <= second.count() < first.count()
    third = stages["near_duplicates"](spark, second, SF)
    rows = [(r.doc_id, r.text) for r in second.collect()]
    sets = [(d, shingles(t, 5)) for d, t in rows]
    comp = components((a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and 100 * len(x & y) >= 80 * len(x | y))
    assert {r.doc_id for r in third.collect()} == {d for d, _ in rows if comp.get(d, d) == d}
    fourth = stages["decontamination"](spark, third, SF)
    left = [(r.doc_id, r.text) for r in third.collect()]
    assert {r.doc_id for r in fourth.collect()} == {d for d, _ in left} - {d for d, _ in plain_leaks(left, bench)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == {r.doc_id for r in fourth.collect()}
