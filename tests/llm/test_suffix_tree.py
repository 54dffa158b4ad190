"""Suffix tree scores against a tree of plain dictionaries."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import suffix_tree as S

WORD = re.compile("[^\x20\x09-\x0d]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def by_dictionary(rows, depth, least, discount):
    """(per row: n_tokens, n_known, base, score), N, and the states."""
    texts = [["<s>", *WORD.findall(lowered(t)), "</s>"] for _, t in rows]
    learned = [t for (d, _), t in zip(rows, texts, strict=True) if not held_out(d)]
    single = Counter(w for t in learned for w in t[1:])
    n, v = sum(single.values()), len(single)
    after = defaultdict(Counter)  # context of any length -> next words
    for t in learned:
        for i in range(1, len(t)):
            for k in range(1, min(depth, i) + 1):
                after[tuple(t[i - k : i])][t[i]] += 1
    states = {}

    def likely(context, word):
        while context and context not in states:
            context = context[1:]
        if not context:
            return (single[word] + 1) / (n + v + 1)
        c, total = after[context], states[context]
        return (max(c[word] - discount, 0) + discount * len(c) * likely(context[1:], word)) / total

    for k in range(1, depth + 1):
        new = {}
        for context, c in after.items():
            total = sum(c.values())
            # a context grows from one that is frequent itself
            if len(context) != k or total < least or any(sum(after[context[:j]].values()) < least for j in range(1, k)):
                continue
            gain = 0.0
            for word, m in c.items():
                if m == 1:
                    gain += math.log(discount * max(len(c) - 1, 0.5) / (total - 1))
                else:
                    gain += m * math.log((m - 1 - discount) / ((total - 1) * likely(context[1:], word)))
            if gain > 0:
                new[context] = total
        states.update(new)
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        p = [likely(tuple(t[max(0, i - depth) : i]), t[i]) for i in range(1, len(t))]
        base = [(single[w] + 1) / (n + v + 1) for w in t[1:]]
        out.append((d, held_out(d), len(t) - 1, sum(single[w] > 0 for w in t[1:]), n, sum(map(math.log10, base)), sum(map(math.log10, p))))
    return out, states, likely, single


def texts(seed, n):
    r = random.Random(seed)
    follows = {w: [r.choice("abcdefgh") for _ in range(3)] for w in "abcdefgh"}
    rows = []
    for i in range(n):
        w, body = r.choice("abcdefgh"), []
        for _ in range(r.randint(0, 60)):
            w = r.choice(follows.get(w, "abcdefgh")) if r.random() < 0.8 else r.choice("abcdefghABCÉ中")
            body.append(w)
        rows.append((i, r.choice([" ", "\n", "\t "]).join(body)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "\x0b \x1c x y"), (None, "a b c"), rows[4], rows[4], (n + 3, "never seen " * 40)]


@pytest.mark.parametrize("depth,least,chunk_bytes", [(2, 4, 500), (3, 6, 1 << 20), (1, 3, 1)])
def test_scores_equal_a_dictionary(spark, depth, least, chunk_bytes):
    rows = texts(depth, 120)
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    tree = S.SuffixTree(depth, least, 0.75, chunk_bytes)
    found = sorted((tuple(r) for r in S.suffix_tree_scores(docs, tree=tree).collect()), key=str)
    expected, states, _, _ = by_dictionary(rows, depth, least, 0.75)
    expected.sort(key=str)
    assert states and [f[:5] for f in found] == [e[:5] for e in expected]
    np.testing.assert_allclose([f[5:] for f in found], [e[5:] for e in expected], rtol=1e-9)


def test_states_are_distributions_and_help():
    rows = texts(9, 200)
    scored, states, likely, single = by_dictionary(rows, 2, 5, 0.75)
    for context in [(), *states]:
        assert math.isclose(sum(likely(context, w) for w in [*single, "\0"]), 1, rel_tol=1e-9)
    held = [r for r in scored if r[1]]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)


def test_hashes_go_and_come_back():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (S.opened(S.close_packed(keys)) == keys).all()
    assert len(S.opened(S.close_packed(keys[:0]))) == 0


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(30)], "doc_id long, text string")
    assert S.suffix_tree_scores(docs.limit(0)).collect() == []
    only = docs.where("crc32(cast(doc_id as string)) % 7 = 2")
    for r in S.suffix_tree_scores(only).collect():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (True, 3, 0, 0, 0.0, 0.0)


def test_a_text_of_a_million_words(spark):
    assert held_out(1) and not held_out(2)
    rows = [(2, "word " * 1_000_000), (1, "word other")]
    found = {r["doc_id"]: r for r in S.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[2]["n_tokens"] == 1_000_001 and found[2]["score"] > -100 and found[1]["n_tokens"] == 3


def test_one_rule_for_rare_contexts_at_all_sizes(spark):
    """Few words have the rule of many: two more than the square root of the learned words by 200."""
    rows = texts(4, 60)
    tree = S.SuffixTree()
    found = sorted((tuple(r) for r in S.suffix_tree_scores(spark.createDataFrame(rows, "doc_id long, text string"), tree=tree).collect()), key=str)
    assert tree.often == 2 + int(found[0][4] ** 0.5 / 200) == 2
    expected = sorted(by_dictionary(rows, 2, 2, 0.75)[0], key=str)
    np.testing.assert_allclose([f[5:] for f in found], [e[5:] for e in expected], rtol=1e-9)


def test_contexts_that_come_twice_count_in_a_large_corpus(spark, tmp_path):
    """The query looks at all contexts of up to three words that come twice, where few words of many are such."""
    from lodestone.llm.queries import QUERIES

    r = random.Random(11)
    rows = [(i, " ".join(f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(150))) for i in range(400)]
    rows += [(1000 + i, rows[i][1][:400] + " x" * (i % 3)) for i in range(60)] + [(2000 + i, rows[7][1]) for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted((tuple(x) for x in QUERIES["op13_suffix_tree"](spark, str(tmp_path)).collect()), key=str)
    expected, states, _, _ = by_dictionary(rows, 3, 2, 0.75)
    expected.sort(key=str)
    assert expected[0][4] > 40_000 and {len(c) for c in states} == {1, 2, 3} and min(states.values()) == 2
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    np.testing.assert_allclose([f[5:] for f in found], [e[5:] for e in expected], rtol=1e-9)


def test_hashes_are_numbered_in_order():
    r = np.random.default_rng(1)
    for keys in (r.integers(0, 2**64, 3000, dtype=np.uint64), r.integers(0, 40, 3000).astype(np.uint64), np.zeros(0, np.uint64)):
        seen, which, order, first = S.numbered(keys)
        different, number = np.unique(keys, return_inverse=True)
        assert (seen == different).all() and (which == number).all() and (keys[order] == np.sort(keys)).all() and (keys[order[first]] == seen).all()
