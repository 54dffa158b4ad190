from __future__ import annotations

import numpy as np

from lodestone.llm import quality as Q

SF = "/root/testdata/sf0.01"


def test_statistics_are_whole_numbers_of_them():
    for text in ("", " ", "\n", "a", "x y\nx y", "é" * 10_000):
        row = Q.statistics(text)
        assert len(row) == Q.STATS and np.isfinite(row).all()


def test_isotonic_never_falls():
    rng = np.random.default_rng(0)
    x = np.arange(200) / 200
    y = (rng.random(200) < x).astype(float)
    _, level = Q.isotonic(x, y, np.ones(200))
    assert (np.diff(level) > 0).all() and 0 <= level.min() and level.max() <= 1
    assert Q.isotonic(np.array([0.0, 1]), np.array([1.0, 0]), np.ones(2))[1].tolist() == [0.5]


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = Q.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    test = out[out.held_out]
    pos, neg = test[test.quality == 1].score.to_numpy(), test[test.quality == 0].score.to_numpy()
    auc = ((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean()
    assert auc > 0.85
    assert out.score.between(0, 1).all()


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x " * 500)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    assert Q.quality_scores(docs, labels).count() == 5
    assert {r["score"] for r in Q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.quality_scores(docs.limit(0), labels).count() == 0


def test_scores_equal_plain_ridge_and_pooling(spark, monkeypatch):
    # sums meet in several rounds
    monkeypatch.setattr(Q, "FAN", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).repartition(7)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = {r["doc_id"]: r["score"] for r in Q.quality_scores(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    ids = sorted(texts)
    x = np.array([Q.statistics(texts[d]) for d in ids])
    labelled = Q.label_table(labels, "quality").where(~Q.held_out(Q.F.col("doc_id"))).collect()
    y = {r["doc_id"]: r["y"] for r in labelled if r["doc_id"] in texts}
    z = Q.Fourier(x.mean(axis=0), x.std(axis=0), 256, 4.0, 7)(x)
    rows = [i for i, d in enumerate(ids) if d in y]
    a, t = z[rows], np.array([y[ids[i]] for i in rows])
    penalty = np.diag([1e-3 * len(rows)] * 256 + [1e-9 * len(rows)])
    raw = z @ np.linalg.solve(a.T @ a + penalty, a.T @ t)
    bins: dict[int, list[float]] = {}
    for r, label in zip(raw[rows], t, strict=True):
        bins.setdefault(round(min(2.0, max(-1.0, r)) / 1e-3), []).append(label)
    # pooling by its definition: the level at a place is the least, over ends at or after it, of the
    # greatest mean over starts at or before it
    keys = sorted(bins)
    total, n = np.array([sum(bins[k]) for k in keys]), np.array([len(bins[k]) for k in keys])
    mean = lambda i, j: total[i : j + 1].sum() / n[i : j + 1].sum()
    level = [min(max(mean(i, j) for i in range(k + 1)) for j in range(k, len(keys))) for k in range(len(keys))]
    at, steps = [], []
    for value in sorted(set(np.round(level, 12))):
        own = [k for k in range(len(keys)) if round(level[k], 12) == value]
        at.append(sum(keys[k] * 1e-3 * n[k] for k in own) / sum(n[k] for k in own))
        steps.append(value)
    want = dict(zip(ids, np.clip(np.interp(raw, at, steps), 0, 1), strict=True))
    # a raw score just between two bins may fall to either side
    close = [abs(found[d] - want[d]) < 1e-3 for d in ids]
    assert np.mean(close) > 0.99
