from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

from . import brute

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{i}", len(t or "")) for i, (d, t) in enumerate(rows)], SCHEMA)


def test_stages_and_order():
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]


def test_toxicity_keeps_clean_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = P.toxicity(spark, docs, SF)
    assert out.columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = out.select("doc_id").withColumn("kept", F.lit(1))
    rows = labels.join(kept, "doc_id", "left").toPandas()
    assert rows[rows.toxic == 0].kept.notna().mean() > 0.97
    assert rows[rows.toxic == 1].kept.notna().mean() < 0.25


def test_line_stage_equals_brute_force(spark):
    rows = [(1, "A long enough line\nshort\nsecond long line here"), (2, " a LONG enough line \nshort\nnew"), (3, None), (4, ""), (5, "second long line here"), (5, "second long line here")]
    docs = frame(spark, rows)
    out = P.lines(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect())
    assert got == [(1, rows[0][1], len(rows[0][1])), (2, "short\nnew", 9), (3, "", 0), (4, "", 0), (5, "", 0), (5, "", 0)]


@pytest.mark.parametrize("repeat", [False, True])
def test_near_duplicate_stage_equals_brute_force(spark, repeat):
    rows = brute.near_corpus(4)
    docs = frame(spark, rows + (rows[:20] if repeat else []))
    out = P.near_duplicates(spark, docs, SF)
    assert out.columns == docs.columns
    classes = brute.op8(rows)
    expected = sorted(d for d in classes if classes[d][0] == d)
    assert sorted(r["doc_id"] for r in out.collect()) == expected


def test_decontamination_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    out = P.decontamination(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    bad = {d for d, x in brute.op6(rows, items).items() if x[3]}
    assert bad and sorted(r["doc_id"] for r in out.collect()) == sorted(d for d, _ in rows if d not in bad)


def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert 300 < out.count() < 1000


def test_encoding_stage_equals_the_library(spark):
    from hashlib import sha256

    import numpy as np
    from tokenizers import Tokenizer

    from lodestone.llm.queries import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rows = [(1, "Plain words, a number 42 and caf\u00e9"), (2, None), (3, ""), (4, "\u4e2d\u6587 mixed " * 50), (4, "again")]
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        shown = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(shown.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in P.encoding(spark, frame(spark, rows), SF).collect()]
    assert sorted(got) == sorted(want)


def test_stages_on_empty_tables_and_clashing_columns(spark):
    names = ["__toxicity", "score", "id", "th", "words", "found", "row", "key", "x", "c", "pos"]
    fields = SCHEMA + "".join(f", {n} string" for n in names)
    rows = [(1, "one text of more than five words", "en", "s", 32, *names), (2, None, None, None, None, *names)]
    for docs in (spark.createDataFrame([], fields), spark.createDataFrame(rows, fields)):
        n = docs.count()
        for name, stage in P.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() == n and out.where(" and ".join(f"`{c}` = '{c}'" for c in names)).count() == n, name
        assert P.encoding(spark, docs, SF).count() == n
