from __future__ import annotations

import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from lodestone.llm.bpe import Coder, bpe_round_trip
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from lodestone.llm.token_counts import split_safely, token_counts

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "x y"), (4, "<s> </s> <unk>"), (5, "a b " * 40_000), (6, "é中😀 \x00\x1c　z")]


def odd(spark):
    return spark.createDataFrame([(d, t, 7, "t") for d, t in ODD], "doc_id long, text string, n_tokens int, row string")


def test_token_counts_equal_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    out = token_counts(odd(spark), tokenizer_path("piece_bpe_32k.model"), split_chars=500, batch_bytes=2000).collect()
    expected = sorted((str(d), len((t or "").encode()), len(model.encode(t or ""))) for d, t in ODD)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in out) == expected
    assert {r["over_limit"] for r in out if r["doc_id"] == 5} == {True}
    assert token_counts(odd(spark).limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_pieces_never_cross_a_safe_boundary(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    for text in texts:
        parts = split_safely(text, 80)
        assert sum(len(model.encode(p)) for p in parts) == len(model.encode(text))
    assert max(map(len, split_safely("word " * 10_000, 100))) < 120


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def reference(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(decoded.encode()).hexdigest()


def test_bpe_equals_the_library_on_random_texts(library):
    r = random.Random(3)
    letters = "abcXYZÉéÑñßΣσς İı 'sdtvllRE0123456789½²٣ \t\n\x0b\x1c\x1f\x85\xa0 .,!?<|>_-中文字漢é́äÅÅ😀"
    texts = ["", "<|endoftext|>x<|startoftext|>", "a<|endoftext|", "x" * 3000, "thon'll've'd 's don't", "ab" * 400]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(1500)]
    texts += ["".join(r.choice("abcdefgh") for _ in range(r.randint(30, 120))) for _ in range(100)]
    coder = Coder(tokenizer_path("word_bpe_49k.json"))
    for text, chunks in zip(texts, coder.encode_batch(texts), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(chunks), "<u4").tolist() == ids, repr(text)
        assert coder.decode_chunks(chunks) == library.decode(ids, skip_special_tokens=False)


def test_bpe_rows(spark, library):
    path = tokenizer_path("word_bpe_49k.json")
    out = bpe_round_trip(odd(spark), path, batch_bytes=50, with_ids=True).collect()
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out)
    assert got == sorted((str(d), *reference(library, t)) for d, t in ODD)
    assert bpe_round_trip(odd(spark).limit(0), path).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    by_id = {r["doc_id"]: r for r in bpe_round_trip(docs, path).collect()}
    for r in docs.collect():
        x = by_id[r["doc_id"]]
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == reference(library, r["text"])


def test_memo_is_bounded(monkeypatch):
    from lodestone.llm import bpe

    monkeypatch.setattr(bpe, "MEMO", 50)
    coder = Coder(tokenizer_path("word_bpe_49k.json"))
    for i in range(30):
        coder.encode_batch([" ".join(f"w{i}x{j}" for j in range(20))])
        assert len(coder.memo) <= 50


def test_line_dedup_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    expected = con.execute(ORACLE_SQL["op5_line_dedup"]).fetchall()
    out = QUERIES["op5_line_dedup"](spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, out)) == sorted(expected)


def test_line_dedup_odd_rows(spark):
    rows = [(1, "Same Line Here\n  same line here\t\nshort"), (2, "SAME LINE HERE\nown"), (3, None), (4, ""), (4, "same line here"), (4, "same line here"), (None, "same line here"), (9, "É same line\né same line")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, b string, h1 int")
    got = sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in line_dedup(docs).collect())
    # a row without an id keeps its lines and counts for no other
    assert got == sorted(
        [("1", 3, 0, rows[0][1]), ("2", 2, 1, "own"), ("3", 1, 0, ""), ("4", 1, 0, ""), ("4", 1, 1, ""), ("4", 1, 1, ""), ("None", 1, 0, "same line here"), ("9", 2, 0, rows[7][1])]
    )
    assert line_dedup(docs.limit(0)).count() == 0


def test_a_hot_line_is_dropped_everywhere_but_once(spark):
    rows = [(i, f"the very common line\nown line number {i}") for i in range(3000)]
    out = line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).agg({"n_dropped": "sum"}).first()[0]
    assert out == 2999
