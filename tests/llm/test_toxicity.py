from __future__ import annotations

import numpy as np

from lodestone.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def test_gradients(monkeypatch):
    monkeypatch.setattr(T, "F32", np.float64)
    rng = np.random.default_rng(0)
    data, offsets = T.joined([b"alpha beta gamma delta", b"beta beta x", b"", b"one two three " * 40])
    net = T.Network(np.unique(T.words_of(data)[0])[:4], 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    batch = net.window_batch(data, offsets)
    y = np.array([1.0, 0, 1, 0])
    _, g = net.gradients(batch, y)
    for k, v in net.p.items():
        at = {"word": (1, 2), "gram": (batch["grams"][3], 1)}.get(k) or tuple(rng.integers(0, s) for s in v.shape)
        v[at] += 1e-5
        up, _ = net.gradients(batch, y)
        v[at] -= 2e-5
        down, _ = net.gradients(batch, y)
        v[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-7


def test_windows_cover_every_word():
    sizes = np.array([0, 1, 47, 48, 49, 80, 81, 1000])
    doc, first, length = T.window_places(sizes)
    base = np.cumsum(sizes) - sizes
    for d, size in enumerate(sizes):
        own = [(f - base[d], n) for f, n in zip(first[doc == d], length[doc == d], strict=True)]
        assert {i for f, n in own for i in range(f, f + n)} == set(range(size)) and own
        assert all(f % T.STRIDE == 0 for f, _ in own)


def test_batching_does_not_change_scores():
    data = [b"one two " * n for n in (0, 1, 30, 200)]
    net = T.Network(np.zeros(0, np.uint64), 3)
    together = net.document_logits(*T.joined(data), step=3)
    alone = np.concatenate([net.document_logits(*T.joined([x])) for x in data])
    assert np.allclose(together, alone, atol=1e-5)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = T.toxicity_scores(docs, labels).join(labels, "doc_id").toPandas()
    test = out[out.held_out]
    assert ((test.score >= 0.5) == (test.toxic == 1)).mean() > 0.9
    clean = out[out.toxic == 0]
    assert (clean.predicted == 1).mean() < 0.05


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (2, "", 1), (None, "a b", 1), (3, "x " * 500, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert T.toxicity_scores(docs, labels).count() == 5
    assert {r["score"] for r in T.toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["predicted"] for r in T.toxicity_scores(docs, labels.limit(0)).collect()} == {0}
    assert T.toxicity_scores(docs.limit(0), labels).count() == 0


def test_gradients_in_parts():
    data, offsets = T.joined([b"one two three four " * 90, b"", b"alpha beta " * 60])
    net = T.Network(np.unique(T.words_of(data)[0])[:4], 1)
    batch, y = net.window_batch(data, offsets), np.array([1.0, 0, 0])
    assert len(batch["doc"]) > 4
    loss, whole = net.gradients(batch, y)
    again, parts = net.gradients(batch, y, step=2)
    assert abs(loss - again) < 1e-6
    assert all(np.allclose(whole[k], parts[k], atol=1e-5) for k in whole)


def test_ends_of_long_texts_are_learned(spark):
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(60)]

    def text(toxic):
        end = ["vile", "nasty", "slur"] * 8 if toxic else ["mild", "kind", "calm"] * 8
        return " ".join([*rng.choice(words, 3200), *end])  # the end is beyond 20,000 bytes

    rows = [(i, text(i % 2), i % 2) for i in range(120)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, None, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    assert min(len(t) for _, t, _ in rows) > 20_000
    out = T.toxicity_scores(docs, labels, how=T.Training(batch=8)).collect()
    test = [r for r in out if r["held_out"]]
    assert len(test) > 10 and all(r["predicted"] == r["doc_id"] % 2 for r in test)


def plain_logit(net, text):
    """The logit of a text, word by word and window by window."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    words = []
    data = np.frombuffer(text, np.uint8)
    hashes, start, end = T.words_of(data)
    for h, a, b in zip(hashes, start, end, strict=True):
        row = int(np.searchsorted(net.words, h)) + 1 if h in set(net.words.tolist()) else 0
        grams, _ = T.gram_lists(T.LOWER[data], np.array([a]), np.array([b]))
        words.append(np.concatenate([p["word"][row], p["gram"][grams].mean(axis=0)]))
    logits = []
    for first in range(0, max(1, len(words) - (T.WINDOW - T.STRIDE)), T.STRIDE):
        own = words[first : first + T.WINDOW]
        states = {}
        for way in "fb":
            state, states[way] = np.zeros(T.HIDDEN), [None] * len(own)
            for t in range(len(own)) if way == "f" else reversed(range(len(own))):
                x, u = own[t] @ p[f"{way}x"] + p[f"{way}c"], state @ p[f"{way}h"]
                h = T.HIDDEN
                z, r = T.sigmoid(x[:h] + u[:h]), T.sigmoid(x[h : 2 * h] + u[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * u[2 * h :])
                states[way][t] = state
        both = [np.concatenate(s) for s in zip(states["f"], states["b"], strict=True)]
        look = np.array([np.tanh(s @ p["pool"]) @ p["look"] for s in both])
        share = np.exp(look - look.max()) / np.exp(look - look.max()).sum() if both else []
        pooled = sum((w * s for w, s in zip(share, both, strict=True)), np.zeros(2 * T.HIDDEN))
        logits.append(pooled @ p["out"] + p["bias"][0])
    return max(logits)


def test_scores_equal_a_loop_over_windows():
    texts = [b"", b"one", b"alpha beta gamma " * 40, "Gr\u00fc\u00dfe und 9 W\u00f6rter ".encode() * 11, b"x " * 48]
    net = T.Network(np.unique(T.words_of(np.frombuffer(b"alpha one und", np.uint8))[0]), 5)
    assert np.allclose(net.document_logits(*T.joined(texts)), [plain_logit(net, t) for t in texts], atol=1e-4)


def test_held_out_recall_in_all_languages(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = T.toxicity_scores(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    toxic = out[out.toxic == 1]
    assert toxic.predicted.mean() >= 0.9
    assert (toxic.groupby("lang").predicted.mean() >= 0.75).all()
    assert out[out.toxic == 0].predicted.mean() <= 0.02
