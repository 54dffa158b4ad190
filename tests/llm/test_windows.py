from __future__ import annotations

from hashlib import sha256

import numpy as np
import pytest

from lodestone.llm import windows as W
from lodestone.llm.common import Scratch, keyed
from lodestone.llm.substring_dedup import FingerprintIndex, substring_dedup
from lodestone.llm.suffix_dedup import common_prefixes, suffix_array, suffix_dedup

from . import brute


def frame(spark, rows):
    # further columns whose names clash with the operators' own
    return spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, th int, bucket string, n int")


def got(df, *columns):
    return {r["doc_id"]: (*(r[c] for c in columns), sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()}


@pytest.mark.parametrize("seed,batches,window", [(0, 1, 20), (1, 2, 20), (2, 3, 20), (0, 2, 300), (3, 3, 5)])
def test_substring_dedup_equals_brute_force(spark, seed, batches, window):
    rows = brute.corpus(seed)
    tables = {t.name for t in spark.catalog.listTables()}
    out = substring_dedup(frame(spark, rows), batches=batches, window=window, max_runs=1)
    assert got(out, "n_words", "n_removed") == brute.op1(rows, window)
    # an index made for one call leaves no table behind
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_index_compacts_and_remembers(spark):
    rows = brute.corpus(5, n=40)
    docs = keyed(frame(spark, rows))
    index = FingerprintIndex(spark, max_runs=1)
    scratch = Scratch(spark, "test")
    index.add(docs.where("doc_id is null or doc_id < 60"), scratch, "a")
    index.add(docs.where("doc_id >= 60"), scratch, "b")
    assert index.runs == 1 and index.compactions == 1
    for r in index.history().collect():
        fp = W.open_docs(bytes(r["blob"]))["fp"]
        assert (fp[1:] >= fp[:-1]).all()
    # a batch that is all known already loses every word that a window covers
    again = substring_dedup(docs.select("doc_id", "text"), batches=1, index=index)
    for r in again.collect():
        assert r["n_removed"] == (r["n_words"] if r["n_words"] >= 20 else 0)


def test_history_is_not_shuffled_and_not_among_the_documents(spark, capsys):
    rows = brute.corpus(5, n=40)
    old, new = [r for r in rows if (r[0] or 0) < 60], [r for r in rows if (r[0] or 0) >= 60]
    index = FingerprintIndex(spark, max_runs=3)
    scratch = Scratch(spark, "test")
    for k in range(3):
        index.add(keyed(frame(spark, old[k::3])), scratch, f"old{k}")
    rows_of = W.cut(keyed(frame(spark, new)), W.WORDS, index.n)
    W.match(rows_of, W.WORDS, index.n, index.history(), keep_runs=True).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    want = brute.op1(old + new)
    out = substring_dedup(frame(spark, new), batches=1, index=index)
    # only the new documents are given; what they lose is as if the old ones stood before them
    assert got(out, "n_words", "n_removed") == {d: want[d] for d, _ in new}


def test_pairs_with_other_words_are_not_settled(spark):
    # equal hashes are not trusted: stretches whose words differ drop out
    text = " ".join(f"w{i}" for i in range(40))
    docs = keyed(frame(spark, [(1, text), (2, text.replace("w30", "x30")), (3, text)]))
    th = {r["doc_id"]: r["th"] for r in docs.collect()}
    n, unit = 4, W.WORDS
    x = {"doc": [2, 3], "start": [0, 0], "n": [21, 21], "pdoc": [1, 1], "pstart": [0, 0]}
    x = {k: np.array(v, np.int64 if "doc" in k else np.uint32) for k, v in x.items()}
    x |= {"th": np.array([th[2], th[3]]), "pth": np.array([th[1]] * 2)}
    pairs = spark.createDataFrame([(b, k, bytearray(v)) for b, k, v in W.paired_blobs(x, n)], W.OUT_SQL)
    words = W.together(docs, W.stretches(pairs, n), n, W.fetch_tokens(unit), W.OUT_SQL)
    found = words.groupBy("bucket").applyInArrow(W.equal_stretches(n), W.OUT_SQL).collect()
    assert [W.open_docs(bytes(r["blob"]))["doc"].tolist() for r in found] == [[3]]


@pytest.mark.parametrize("words", [True, False])
def test_very_long_texts(spark, words, monkeypatch):
    rng = np.random.default_rng(0)
    long = [f"w{i}" for i in rng.integers(0, 20_000, 200_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[5_000:150_000])), (3, " ".join(long[::-1])), (4, "x " + " ".join(long[:60]))]
    out = substring_dedup(frame(spark, rows)) if words else suffix_dedup(frame(spark, rows))
    found = {r["doc_id"]: (r["n_words" if words else "n_bytes"], r["n_removed"]) for r in out.collect()}
    if words:
        assert found == {1: (200_000, 0), 2: (145_000, 145_000), 3: (200_000, 0), 4: (61, 60)}
    else:
        assert found[1][1] == 0 and found[2][0] == found[2][1] and found[4][0] - 2 == found[4][1]


@pytest.mark.parametrize("seed,window", [(0, 50), (3, 50), (1, 300), (2, 1000), (4, 9)])
def test_suffix_dedup_equals_brute_force(spark, seed, window):
    rows = brute.corpus(seed)
    out = suffix_dedup(frame(spark, rows), window=window)
    assert got(out, "n_bytes", "n_removed", "n_spans") == brute.op9(rows, window)


def test_all_but_members_of_sorted_passages_comes_from_the_sort(spark):
    # two documents share a passage: nothing is settled before the suffix sort
    rows = [(1, "a" * 7 + " ".join(f"p{i}" for i in range(80))), (2, " ".join(f"p{i}" for i in range(80)) + "zz")]
    docs, n = keyed(frame(spark, rows)), 4
    found = W.match(W.cut(docs, W.BYTES, n), W.BYTES, n)
    assert W.of_kind(found, W.SETTLED).count() == 0 < W.of_kind(found, W.PAIR).count()
    assert got(suffix_dedup(frame(spark, rows)), "n_bytes", "n_removed", "n_spans") == brute.op9(rows)


def test_blocks_are_joined_up_to_a_bound(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 200)
    rows = brute.corpus(8)
    data = {"doc_id": W.pa.array([d for d, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0]))])}
    data["th"] = W.pa.array(np.arange(len(rows)))
    data["text"] = W.pa.array([t or "" for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0]))])
    batch = W.pa.RecordBatch.from_pydict(data)
    whole = [np.concatenate(x) for x in zip(*W.cut_docs(batch, W.WORDS), strict=True)]
    monkeypatch.setattr(W, "EMIT", 100)
    blocks = list(W.blocks_of(batch, W.WORDS))
    assert len(blocks) > 1
    for a, b in zip(whole, (np.concatenate(x) for x in zip(*blocks, strict=True)), strict=True):
        assert (a == b).all()


def test_empty_and_repeated_rows(spark):
    empty = frame(spark, [])
    assert substring_dedup(empty).count() == 0
    assert suffix_dedup(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (1, text), (2, text)]
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup(frame(spark, rows)).collect()) == [(1, 0), (1, 0), (2, 30)]
    assert sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup(frame(spark, rows)).collect()) == [(1, 0), (1, 0), (2, len(text))]


def test_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 64)
    data = np.frombuffer(b"abcabcdd" * 40, np.uint8)
    tokens = W.BYTE_TOKENS[data]
    fp, content, start, n = W.runs_of(tokens, np.array([0, 100, 130, len(tokens)]), W.BYTES)
    covered = sorted(i for s, k in zip(start, n, strict=True) for i in range(s, s + k))
    assert covered == [*range(0, 51), *range(130, len(tokens) - 49)]


def test_suffix_array_by_two_stages():
    rng = np.random.default_rng(0)
    for _ in range(100):
        text = rng.integers(97, 100, rng.integers(1, 120)).astype(np.uint8)
        text[rng.random(len(text)) < 0.05] = 255
        text = np.append(text, np.uint8(255))
        sa = suffix_array(text, 20)
        raw = text.tobytes() + b"\xff" * 20
        cut = [raw[i : i + 20] for i in sa]
        assert cut == sorted(cut)
        for a, b, k in zip(cut[:-1], cut[1:], common_prefixes(text, sa, 20)[1:], strict=True):
            assert a[:k] == b[:k] and (k == 20 or a[k] != b[k])


def test_passages_are_sorted_in_parts(spark, monkeypatch):
    from lodestone.llm import suffix_dedup as S

    rows = brute.corpus(6, n=30)
    unit = W.BYTES
    texts = {d if d is not None else W.NULL_ID: (t or "").encode() for d, t in rows}
    x = {"doc": [], "th": [], "start": [], "n": [], "fp": [], "raw": []}
    for d, b in sorted(texts.items()):
        data = np.frombuffer(b, np.uint8)
        fp, _, start, n = W.runs_of(W.BYTE_TOKENS[data], np.array([0, len(data)]), unit)
        for f, s, k in zip(fp, start, n, strict=True):
            for name, v in (("doc", d), ("th", 0), ("start", s), ("n", k), ("fp", f)):
                x[name].append(v)
            x["raw"].append(b[s : s + k + unit.window - 1])
    types = {"doc": np.int64, "th": np.int64, "start": np.uint32, "n": np.uint32, "fp": np.uint64}
    x["part"] = np.zeros(len(x["n"]), np.uint32)
    blob = W.pack(raw=np.frombuffer(b"".join(x["raw"]), np.uint8), part=x["part"], **{k: np.array(x[k], t) for k, t in types.items()})

    def settled(size):
        monkeypatch.setattr(S, "LOCAL_TEXT", size)
        out = S.settle_bytes(unit, 4)(W.pa.table({"blob": [blob]}))
        found = W.in_doc_order(out.column("blob").to_pylist())
        at = W.expand(found["start"], found["n"])
        return sorted(zip(np.repeat(found["doc"], found["n"]).tolist(), at.tolist(), strict=True))

    assert settled(1 << 20) == settled(300) and settled(300)


@pytest.mark.parametrize("part", [1, 3])
def test_frequent_fingerprints_are_sorted_in_parts(spark, part):
    rows = brute.corpus(7)
    assert got(suffix_dedup(frame(spark, rows), part=part), "n_bytes", "n_removed", "n_spans") == brute.op9(rows)


@pytest.mark.parametrize("words", [True, False])
def test_hot_passage_in_many_contexts_is_dealt(spark, words):
    # one passage just as long as a window with its anchor, between words that no other document has
    hot = " ".join(f"hot{i}" for i in range(22))
    rows = [(i, " ".join(f"{'ab'[k // 30]}{i}x{k}" if k != 30 else hot for k in range(60))) for i in range(400)]
    out = substring_dedup(frame(spark, rows)) if words else suffix_dedup(frame(spark, rows))
    assert got(out, *(("n_words", "n_removed") if words else ("n_bytes", "n_removed", "n_spans"))) == (brute.op1 if words else brute.op9)(rows)
    unit, n = (W.WORDS if words else W.Unit(window=50, gram=24, words=False, within=False, part=20)), 16
    docs = keyed(frame(spark, rows))
    found = W.match(W.cut(docs, unit, n), unit, n)
    fetch = W.fetch_windows(unit, n) if words else W.fetch_tokens(unit)
    blobs = W.together(docs, W.of_kind(found, W.OPEN), n, fetch, W.OUT_SQL).where(f"kind = {W.OPEN}").collect()
    size = np.zeros(n)
    for r in blobs:
        x = W.unpack(bytes(r["blob"]))
        size[r["bucket"]] += x["count"].sum() if words else len(x["n"])
    assert size.sum() > 400 and size.max() < size.sum() / 4
