from __future__ import annotations

import random

import pytest

from lodestone.llm import decontaminate as D
from lodestone.llm.decontaminate import decontaminate

from . import brute


def case(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcDé9") for _ in range(r.randint(1, 3))) for _ in range(12)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(1, 40) if i % 3 else r.randint(2, 6)))) for i in range(12)]
    items += [(50, None), (51, " .. "), (52, items[0][1]), (53, " ".join(items[1][1].split()[:20] * 2))]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(r.randint(0, 4)):
            text += " ".join(r.choice(words) for _ in range(r.randint(0, 60))) + r.choice(["\n", "--", " "])
            source = (items[r.randrange(12)][1] or "").split()
            a = r.randint(0, max(0, len(source) - 1))
            text += " ".join(source[a:] if r.random() < 0.5 else source).upper() + " , "
        rows.append((i, text))
    return [*rows, (100, None), (101, ""), (102, items[2][1]), (None, items[5][1])], items


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    rows, items = case(seed)
    docs = spark.createDataFrame([(d, t, 0, "k") for d, t in rows], "doc_id long, text string, n_words int, kept string")
    tests = spark.createDataFrame(items, "item_id long, text string")
    out = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["item_ids"]), r["contaminated"]) for r in decontaminate(docs, tests).collect()}
    assert out == brute.op6(rows, items)


def test_kept_text_empty_tables_and_bound(spark):
    docs = spark.createDataFrame([(1, "x a b c y"), (1, "x a b c y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A-b c")], "item_id long, text string")
    assert [r["kept"] for r in decontaminate(docs, items, with_kept=True).collect()] == ["x    y"] * 2
    assert decontaminate(docs.limit(0), items).count() == 0
    assert [r["n_hit"] for r in decontaminate(docs, items.limit(0)).collect()] == [0, 0]


@pytest.mark.parametrize("seed,size", [(0, 300), (1, 40)])
def test_shards_give_the_same(spark, seed, size, monkeypatch):
    rows, items = case(seed)
    rows = [*rows, (500, rows[3][1]), (500, rows[3][1])]
    docs = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, x int")
    tests = spark.createDataFrame([*items, (None, "lonely item without an id")], "item_id long, text string")
    whole = sorted(decontaminate(docs, tests, with_kept=True).collect(), key=str)
    monkeypatch.setattr(D, "SHARD_BYTES", size)
    assert len(D.shards_of(tests)) > 2
    parts = sorted(decontaminate(docs, tests, with_kept=True).collect(), key=str)
    assert parts == whole and any(r["n_hit"] for r in parts)


def test_null_item_ids(spark):
    docs = spark.createDataFrame([(1, "a lonely item Without an id b")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "lonely item without an id"), (None, None)], "item_id long, text string")
    assert [(r["n_hit"], r["item_ids"]) for r in decontaminate(docs, items).collect()] == [(5, ["null"])]
