"""File formats inside tasks: PNG, path text and drawings. One image per row; bytes in, rows out."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_bytes(grey: np.ndarray) -> bytes:
    """An 8-bit greyscale PNG whose rows are coded as differences to the row above."""
    h, w = grey.shape
    rows = np.vstack([np.zeros((1, w), np.uint8), grey.astype(np.uint8)])
    body = np.hstack([np.full((h, 1), 2, np.uint8), np.diff(rows, axis=0)])
    head = struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(body.tobytes())) + _chunk(b"IEND", b"")


def png_grey(data: bytes) -> np.ndarray:
    """The levels of an 8-bit greyscale PNG, any of the five row filters; checksums are verified."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, parts, size = 8, [], (0, 0)
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a PNG chunk is damaged")
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit greyscale")
            size = (w, h)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    w, h = size
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, w + 1)
    out = np.zeros((h + 1, w), np.uint8)
    for y in range(h):
        kind, line, up = raw[y, 0], raw[y, 1:], out[y]
        if kind in (0, 2):
            out[y + 1] = line + (up if kind == 2 else 0)
            continue
        left = corner = 0
        for x in range(w):
            if kind == 1:
                guess = left
            elif kind == 3:
                guess = (left + int(up[x])) // 2
            else:
                p = left + int(up[x]) - corner
                guess = min((abs(p - left), 0, left), (abs(p - int(up[x])), 1, int(up[x])), (abs(p - corner), 2, corner))[2]
            left = (int(line[x]) + guess) & 255
            corner = int(up[x])
            out[y + 1, x] = left
    return out[1:]


def encode_images(px: DataFrame) -> DataFrame:
    """(img_id, content) from pixel rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from .geometry import grid

        return pd.DataFrame({"img_id": [int(pdf["img_id"].iloc[0])], "content": [png_bytes(grid(pdf, "v"))]})

    return px.select("img_id", "x", "y", "v").groupBy("img_id").applyInPandas(run, "img_id long, content binary")


def decode_images(files: DataFrame) -> DataFrame:
    """Pixel rows (img_id, x, y, v) from (img_id, content)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for img, content in zip(pdf["img_id"], pdf["content"], strict=True):
                grey = png_grey(bytes(content))
                y, x = np.indices(grey.shape)
                yield pd.DataFrame({"img_id": img, "x": x.ravel().astype("int32"), "y": y.ravel().astype("int32"), "v": grey.ravel().astype("int32")})

    return files.mapInPandas(run, "img_id long, x int, y int, v int")


def write_drawings(shapes: DataFrame) -> DataFrame:
    """(img_id, svg): each image's paths in the order of their labels, one element each."""
    from pyspark.sql import functions as F

    path = F.format_string('<path id="%d" fill-rule="evenodd" d="%s"/>', F.col("label"), F.col("d"))
    parts = F.array_sort(F.collect_list(F.struct("label", path.alias("p"))))
    body = F.array_join(F.transform(parts, lambda s: s["p"]), "")
    return shapes.groupBy("img_id").agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), body, F.lit("</svg>")).alias("svg"))


NUMBER = re.compile(r"[MLZ]|-?\d+(?:\.\d+)?")
PATH = re.compile(r'<path id="(\d+)"[^>]* d="([^"]*)"')


def subpaths(d: str) -> list[list[tuple[float, float]]]:
    """Point lists of a path of M, L and Z."""
    out: list[list[tuple[float, float]]] = []
    held: list[float] = []
    for token in NUMBER.findall(d):
        if token == "M":
            out.append([])
        elif token not in "LZ":
            held.append(float(token))
            if len(held) == 2:
                out[-1].append((held[0], held[1]))
                held.clear()
    return out


def parse_drawings(files: DataFrame) -> DataFrame:
    """(img_id, label, subpaths, nodes, area) of each path of (img_id, svg)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .geometry import loop_area

        for pdf in it:
            rows = []
            for img, svg in zip(pdf["img_id"], pdf["svg"], strict=True):
                for label, d in PATH.findall(svg):
                    loops = subpaths(d)
                    rows.append((img, int(label), len(loops), sum(map(len, loops)), sum(map(loop_area, loops))))
            yield pd.DataFrame(rows, columns=["img_id", "label", "subpaths", "nodes", "area"])

    return files.mapInPandas(run, "img_id long, label int, subpaths long, nodes long, area double")
