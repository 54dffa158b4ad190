from __future__ import annotations

import zlib
from hashlib import sha256

from lodestone.llm import media as M
from lodestone.llm.queries import op7_media_columns, page_sequences

PAGE = """<html><head><style>x</style><script>var t="</p>";</script></head><body><p>One &amp; <b>two</b>
<img src="a.png" alt="first">three<figure><img src="sha256:{0}" alt="y"><figcaption>The <i>cap</i></figcaption></figure>
<p>four<img alt="no source"><video src="sha256:zz"></video></body>"""


def test_sequence_order_and_captions():
    items = M.sequence_of(PAGE.format("ab"))
    assert [(i["kind"], i["text"] or i["ref"], i["caption"]) for i in items] == [
        ("text", "One & two", None),
        ("media", "a.png", "first"),
        ("text", "three", None),
        ("media", "sha256:ab", "The cap"),
        ("text", "four", None),
        ("media", "sha256:zz", None),
    ]
    assert [i["pos"] for i in items] == list(range(6))
    assert M.sequence_of(None) == M.sequence_of("") == []


def test_images_hold_every_byte():
    for raw in (b"", b"x", bytes(range(256)) * 9, b"P5\n" * 192):
        payload = M.padded(raw)
        assert len(payload) % 576 == 0 and len(payload) > 0 and payload.startswith(raw)
        assert M.from_image(M.to_image(payload)) == payload
        assert len(M.padded(payload)) == len(payload)


def test_digest_join_keeps_alignment(spark):
    raw = b"picture"
    digest = sha256(M.padded(raw)).hexdigest()
    pages = spark.createDataFrame([(1, PAGE.format(digest), 9), (2, None, 9), (3, PAGE.format(digest), 9)], "page_id long, html string, pos int")
    media = M.measured(M.stored(spark.createDataFrame([(raw,), (raw,), (None,)], "payload binary")))
    assert media.count() == 2
    rows = M.realigned(M.resolved(M.items_of(M.interleaved(pages)), media)).collect()
    assert sorted(r["page"] for r in rows) == [1, 3]
    for r in rows:
        assert [i["pos"] for i in r["items"]] == list(range(6))
        assert [i["payload_sha256"] for i in r["items"]] == [None, None, None, digest, None, None]
        assert r["items"][3]["caption"] == "The cap"


def test_query_equals_brute_force(spark, tmp_path):
    texts = [(1, "é" * 300), (2, None), (3, ""), (4, "x" * 576), (5, "x" * 577), (6, "é" * 300), (6, "é" * 300)]
    spark.createDataFrame([(d, t, "e", "s", 1) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet"
    )
    out = op7_media_columns(spark, str(tmp_path)).collect()
    assert len(out) == len(texts)
    by_id = {r["doc_id"]: r for r in out}
    for d, t in texts:
        raw = (t or "").encode()
        payload = M.padded(raw)
        r = by_id[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (
            len(raw), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]),
        )
        assert (r["media_bytes"], r["media_sha256"]) == (len(M.to_image(payload)), sha256(M.to_image(payload)).hexdigest())
        assert r["feature"] == M.features(payload)
        assert (r["n_items"], r["pos"], r["caption"]) == ((2, 1) if (t or "").strip() else (1, 0)) + (f"{len(raw)} bytes",)


def test_query_on_empty_hot_and_very_long_texts(spark, tmp_path):
    fields = "doc_id long, text string, digest string, page long"
    spark.createDataFrame([], fields).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op7_media_columns(spark, f"{tmp_path}/none").count() == 0
    rows = [(i, "copy <b>&amp; again", "d", 1) for i in range(3000)] + [(5000, "<p>" * 200_000, "d", 1), (None, None, None, None)]
    spark.createDataFrame(rows, fields).write.parquet(f"{tmp_path}/hot/documents.parquet")
    out = op7_media_columns(spark, f"{tmp_path}/hot").groupBy("payload_sha256", "n_bytes", "payload_bytes").count().collect()
    digest = {t: sha256(M.padded((t or "").encode())).hexdigest() for t in ("copy <b>&amp; again", "<p>" * 200_000, None)}
    assert {(r["payload_sha256"], r["n_bytes"], r["count"]) for r in out} == {
        (digest[rows[0][1]], 19, 3000), (digest["<p>" * 200_000], 600_000, 1), (digest[None], 0, 1),
    }


def test_memo_of_stored_digests_is_bounded(spark, monkeypatch):
    rows = [(bytes([i % 7]),) for i in range(50)]
    monkeypatch.setattr(M, "MEMO", 2)
    assert M.measured(M.stored(spark.createDataFrame(rows, "payload binary"))).count() == 7


def test_page_sequences_equal_the_reader(spark):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        items = M.sequence_of(r["html"])
        texts = [i["text"] for i in items if i["kind"] == "text"]
        want[r["page_id"]] = (len(items), len(texts), sha256("\n".join(texts).encode()).hexdigest())
    got = {r["page_id"]: (r["n_items"], r["n_texts"], r["text_sha256"]) for r in page_sequences(spark, sf).collect()}
    assert got == want and all(n >= 1 for n, _, _ in got.values())
