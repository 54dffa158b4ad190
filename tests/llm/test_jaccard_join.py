from __future__ import annotations

import numpy as np
import pytest

from lodestone.llm import jaccard_join as J

from . import brute


def answers(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["n_text_links"], r["copy_of"]) for r in df.collect()}


@pytest.mark.parametrize("seed,how", [(0, J.Join()), (1, J.Join(band_block=3, block=4))])
def test_equals_brute_force(spark, seed, how):
    rows = brute.near_corpus(seed)
    docs = spark.createDataFrame([(d, t, 0, "c") for d, t in rows], "doc_id long, text string, c int, component string")
    assert answers(J.jaccard_join(docs, how=how)) == brute.op8(rows)


def test_pruning_keeps_pairs_at_the_threshold():
    how = J.Join()
    rng = np.random.default_rng(0)
    one = rng.integers(0, 1 << 16, how.size).astype(np.uint16)
    others = np.where(rng.random((2000, how.size)) < 0.8, one, one + 1).astype(np.uint16)
    assert len(J.survivors(one, others, how)) == 2000
    far = np.where(rng.random((2000, how.size)) < 0.4, one, one + 1).astype(np.uint16)
    assert len(J.survivors(one, far, how)) == 0


def test_postings_count_common_shingles():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(20)]
    for most in (1 << 22, 40):
        found = J.Postings(sets, most).common(sets[3])
        assert found.tolist() == [len(np.intersect1d(sets[3], s)) for s in sets]


def test_links_of_every_fiftieth_document_are_all_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in J.jaccard_join(docs).collect()}
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        data = np.frombuffer((r["text"] or "").encode(), np.uint8)
        sets[r["doc_id"]] = np.unique(J.shingles(J.W.WORDS.cut(data)[0], 5))
    ids = [d for d in sets if len(sets[d])]
    postings, size = J.Postings([sets[d] for d in ids]), np.array([len(sets[d]) for d in ids])
    true = seen = 0
    for d in (d for d in ids if d % 50 == 0):
        both = postings.common(sets[d])
        linked = [ids[k] for k in np.flatnonzero(both >= 0.8 * (len(sets[d]) + size - both) - 1e-9) if ids[k] != d]
        assert all(found[e][0] == found[d][0] for e in linked)
        true += len(linked)
        seen += min(len(linked), found[d][1])
        assert found[d][1] <= len(linked)
    assert true > 20 and seen == true


def test_star_centres_are_split(spark):
    from lodestone.llm.common import Scratch
    from lodestone.llm.components import components

    edges = [(0, i) for i in range(1, 6000)] + [(i, i + 1) for i in range(10_000, 10_040)] + [(20_000, 3)]
    df = spark.createDataFrame(edges, "u long, v long")
    out = components(df, Scratch(spark, "star"), "star").groupBy("component").count().collect()
    assert {(r["component"], r["count"]) for r in out} == {(0, 6001), (10_000, 41)}


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(150_000)]
    near = [w if i % 4000 else "changed" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[::-1]))]
    out = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: (r["class_id"], r["n_text_links"]) for r in out.collect()} == {1: (1, 1), 2: (1, 1), 3: (3, 0)}


def test_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, None), (6, "z")], "doc_id long, text string")
    out = [(r["doc_id"], r["class_id"], r["n_links"], r["copy_of"]) for r in J.jaccard_join(docs).collect()]
    assert sorted(out, key=str) == sorted([(5, 5, 2, 5), (5, 5, 2, 5), (6, 6, 0, 6), (None, None, 0, None), (None, 5, 2, 5)], key=str)
    assert J.jaccard_join(docs.limit(0)).count() == 0
