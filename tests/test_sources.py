from __future__ import annotations

import hashlib
import io
import tarfile

import numpy as np
import pytest
from pyspark.errors import PySparkException

from lodestone.operators import formats as Z
from lodestone.operators import segment as E
from lodestone.plans.cleanups import close_seams
from lodestone.sources import files as S
from lodestone.sources.roles import pixels

SF = "/root/testdata/sf0.001"


def test_json_lines_drop_malformed_and_keep_the_last(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"key": "x", "v": 1}\nnot json\n{"key": "y", "v": 2}\n{"v": 9}\n{"key": "x", "v": 3}\n')
    (tmp_path / "b.jsonl").write_text('{"key": "y", "v": 5}\n\n')
    rows = S.json_lines(spark, str(tmp_path), "key string, v long", "key").collect()
    assert sorted((r["key"], r["v"]) for r in rows) == [("x", 3), ("y", 5)]


def test_manifest_is_verified(spark, tmp_path):
    (tmp_path / "one.bin").write_bytes(b"one")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    good = [("one.bin", hashlib.sha256(b"one").hexdigest())]
    assert bytes(S.verified_manifest(spark.createDataFrame(good, "path string, sha256 string"), files).first()["content"]) == b"one"
    for bad in ([("one.bin", "00")], [("two.bin", good[0][1])]):
        with pytest.raises(PySparkException):
            S.verified_manifest(spark.createDataFrame(bad, "path string, sha256 string"), files).collect()


def test_sniff_and_archive(spark, tmp_path):
    png = Z.png_bytes(np.arange(12, dtype=np.uint8).reshape(3, 4))
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.svg").write_text("<?xml version='1.0'?><svg/>")
    (tmp_path / "c.gif").write_bytes(b"GIF89a" + (300).to_bytes(2, "little") + (7).to_bytes(2, "little") + b"\0" * 9)
    out = {r["path"][-5:]: (r["kind"], r["width"], r["height"]) for r in S.sniffed(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert out == {"a.png": ("image/png", 4, 3), "b.svg": ("image/svg+xml", None, None), "c.gif": ("image/gif", 300, 7)}
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w") as t:
        for name, data in (("x/a.png", png), ("x/empty", b"")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    folder = tmp_path / "tar"
    folder.mkdir()
    (folder / "t.tar").write_bytes(packed.getvalue())
    files = spark.read.format("binaryFile").load(str(folder))
    assert sorted((r["member"], bytes(r["content"])) for r in S.archive_members(files).collect()) == [("x/a.png", png), ("x/empty", b"")]


def test_png_filters_and_damage():
    grey = np.random.default_rng(0).integers(0, 256, (6, 9)).astype(np.uint8)
    assert (Z.png_grey(Z.png_bytes(grey)) == grey).all()
    damaged = bytearray(Z.png_bytes(grey))
    damaged[45] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        Z.png_grey(bytes(damaged))
    import struct
    import zlib

    lines = []
    for kind in (1, 3, 4):
        for y in range(2):
            row = []
            for x in range(4):
                row.append((7 * x + 13 * y + kind) & 255)
            lines.append(bytes([kind, *row]))
    head = struct.pack(">IIBBBBB", 4, 6, 8, 0, 0, 0, 0)
    data = Z.SIGNATURE + Z._chunk(b"IHDR", head) + Z._chunk(b"IDAT", zlib.compress(b"".join(lines))) + Z._chunk(b"IEND", b"")
    out = Z.png_grey(data).astype(int)
    for y in range(6):
        for x in range(4):
            kind, raw = lines[y][0], lines[y][1 + x]
            a, b, c = (out[y, x - 1] if x else 0), (out[y - 1, x] if y else 0), (out[y - 1, x - 1] if x and y else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            guess = {1: a, 3: (a + b) // 2, 4: paeth}[kind]
            assert out[y, x] == (raw + guess) & 255


def test_seams_equal_plain_loops(spark):
    images = {}
    for r in pixels(spark, SF).where("img_id < 40").collect():
        images.setdefault(r["img_id"], {})[r["x"], r["y"]] = r["v"]
    expected = {}
    for img, v in images.items():
        hit = set()
        for (x, y), own in v.items():
            for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1)):
                for size in (1, 2, 3):
                    for at in range(size):
                        run = [(x + (k - at) * dx, y + (k - at) * dy) for k in range(size)]
                        a, b = (run[0][0] - dx, run[0][1] - dy), (run[-1][0] + dx, run[-1][1] + dy)
                        if a in v and b in v and all(p in v and v[p] >= 100 for p in run) and v[a] < 100 and v[b] < 100:
                            if abs(own - (v[a] + (v[b] - v[a]) * (at + 1) / (size + 1))) <= 48:
                                hit.add((x, y))
        expected[img] = len(hit)
    got = {r["img_id"]: r["seams"] for r in close_seams(spark, SF).where("img_id < 40").collect()}
    assert got == expected


def test_smoothing_keeps_steps():
    levels = np.zeros((6, 6))
    levels[:, 3:] = 200
    assert (E.smooth_with_steps(levels, 1.0, 48.0, 4) == levels).all()
    noisy = levels + np.random.default_rng(0).normal(0, 4, levels.shape)
    out = E.smooth_with_steps(noisy, 1.0, 48.0, 4)
    assert out[:, :3].std() < noisy[:, :3].std() and abs(out[:, 3:].mean() - 200) < 6
