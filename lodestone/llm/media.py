"""Media columns: interleaved document sequences.

HTML parsing yields, in reading order, text and media references. Payloads are stored once by
digest in a media form that keeps every byte; digest joins resolve the references, and each
resolved reference keeps its position and caption.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy, partitions

#: Samples of a stored image's row; a payload is padded to whole images of 24 rows.
WIDTH = 24
BLOCK = 576
PAD = 255
#: Digests that a task remembers at once; one that comes again later is stored again, with equal bytes.
MEMO = 100_000
#: Elements whose text is not read, and those that refer to media.
SILENT = ("script", "style", "template", "noscript")
MEDIA = ("img", "audio", "video", "source", "embed")
ITEM = "struct<pos:int, kind:string, text:string, ref:string, caption:string>"


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.silent = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in MEDIA:
            values = dict(attrs)
            if values.get("src"):
                self.flush()
                if self.figure is not None:
                    self.figure.append(len(self.items))
                self.items.append({"kind": "media", "text": None, "ref": values["src"], "caption": values.get("alt")})
        elif tag in ("p", "br", "div", "li", "h1", "h2", "h3", "h4", "tr", "section", "article"):
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "figcaption" and self.caption is not None:
            words = " ".join("".join(self.caption).split())
            for at in self.figure or ():
                self.items[at]["caption"] = words or self.items[at]["caption"]
            self.caption = None
        elif tag == "figure":
            self.figure = self.caption = None
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "tr", "section", "article"):
            self.held.append(" ")

    def handle_data(self, data):
        if not self.silent:
            (self.held if self.caption is None else self.caption).append(data)


def sequence_of(html: str | None) -> list[dict]:
    """The items of a page in order. A figure's caption goes with each of its media; without one,
    the alternative text does. Null and empty pages have no items."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return [{"pos": i, **item} for i, item in enumerate(reader.items)]


def interleaved(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """(page, items, further columns ``carry``) with items: array of (pos, kind, text, ref, caption);
    one row per row. The columns carried must not be named page or items."""
    kind = pa.list_(
        pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
    )

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            # a few pages at a time: their texts as Python objects take more room than as Arrow
            parts = [pa.array([sequence_of(x.as_py()) for x in column.slice(a, 256)], kind) for a in range(0, len(column), 256)]
            yield pa.concat_arrays(parts) if parts else pa.array([], kind)

    items = F.arrow_udf(run, f"array<{ITEM}>")
    return pages.select(F.col(id_col).cast("long").alias("page"), items(F.col(html_col).cast("string")).alias("items"), *carry)


def padded(raw: bytes) -> bytes:
    """Bytes up to a positive multiple of a block."""
    return raw + bytes([PAD]) * (-len(raw) % BLOCK if raw else BLOCK)


def to_image(payload: bytes) -> bytes:
    """A greyscale image (portable graymap) of 8-bit samples, one sample for each byte."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


HEADER = re.compile(rb"P5\s+(\d+)\s+(\d+)\s+255\s")


def from_image(image: bytes) -> bytes:
    head = HEADER.match(image)
    if head is None:
        raise ValueError("not a stored image")
    width, height = int(head[1]), int(head[2])
    samples = image[head.end() : head.end() + width * height]
    if len(samples) != width * height:
        raise ValueError("a stored image is cut short")
    return samples


def features(payload: bytes) -> str:
    """Mean, spread and entropy of the samples, and the share of each eighth of their range."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n = counts.sum()
    at = np.arange(256)
    mean = (counts * at).sum() / n
    spread = np.sqrt((counts * (at - mean) ** 2).sum() / n)
    p = counts[counts > 0] / n
    shares = counts.reshape(8, 32).sum(axis=1) / n
    return ";".join([f"{x:.6f}" for x in (mean, spread, -(p * np.log2(p)).sum(), *shares)])


def stored(docs: DataFrame, payload_col: str = "payload") -> DataFrame:
    """(digest, image) of the payloads of ``docs``. A task stores equal payloads once, as far as its
    memo goes; what is stored more than once under one digest is the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                digests, images = [], []
                for x in batch.column(0).slice(a, 512):
                    payload = padded(x.as_py() or b"")
                    digest = sha256(payload)
                    if digest.digest() not in known:
                        if len(known) >= MEMO:
                            known.clear()
                        known.add(digest.digest())
                        digests.append(digest.hexdigest())
                        images.append(to_image(payload))
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(images, pa.binary())], names=["digest", "image"])

    return docs.select(F.col(payload_col).cast("binary").alias("payload")).mapInArrow(run, "digest string, image binary")


MEASURED = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def measured(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, one row per digest; payloads themselves are not shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, image in zip(batch.column(0), batch.column(1), strict=True):
                image = image.as_py()
                payload = from_image(image)
                rows.append(
                    (digest.as_py(), len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), sha256(image).hexdigest(), features(payload))
                )
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in MEASURED.split(", ")])

    return media.select("digest", "image").mapInArrow(run, MEASURED).dropDuplicates(["digest"])


def items_of(sequences: DataFrame, *carry: str) -> DataFrame:
    """One row per item of ``sequences``: page, the columns carried, n_items, pos, kind, text, ref, caption."""
    return sequences.select("page", *carry, F.size("items").alias("n_items"), F.explode("items").alias("x")).select(
        "page", *carry, "n_items", "x.*"
    )


def resolved(items: DataFrame, media: DataFrame) -> DataFrame:
    """``items`` with the columns of ``media`` (one row per digest) where the reference is ``sha256:``
    and a digest. References that nothing resolves stay, with nulls.

    Text and other references take no part in the join. A digest that very many items refer to
    would fill one task; such digests are few, so their rows of ``media`` are broadcast."""
    n = partitions(items.sparkSession)
    digest = F.when(F.col("ref").startswith("sha256:"), F.substring("ref", 8, 64))
    items = items.withColumn("digest", digest)
    refs, rest = items.where("digest is not null"), items.where("digest is null")
    hot = heavy(refs.groupBy("digest").agg(F.count("*").alias("c")), n).select("digest")
    few = F.broadcast(media.join(hot, "digest"))
    out = refs.join(few, "digest").unionByName(refs.join(few.select("digest"), "digest", "left_anti").join(media, "digest", "left"))
    return out.unionByName(rest, allowMissingColumns=True)


def realigned(items: DataFrame) -> DataFrame:
    """Resolved items back as one ordered array for each page."""
    columns = [c for c in items.columns if c not in ("page", "pos")]
    return items.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("items"))


def page_of(text) -> Column:
    """A document as a page: its text in a paragraph, then a figure that refers to its payload."""
    escaped = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(sign), F.lit(name))
    raw = text.cast("binary")
    n = F.octet_length(raw)
    blocks = F.greatest(F.lit(1), F.ceil(n / BLOCK)) * BLOCK - n
    digest = F.sha2(F.concat(raw, F.unhex(F.repeat(F.lit("FF"), blocks.cast("int")))), 256)
    return F.concat(
        F.lit("<article><p>"), escaped, F.lit('</p><figure><img src="sha256:'), digest, F.lit('" alt="payload"><figcaption>'),
        n.cast("string"), F.lit(" bytes</figcaption></figure></article>"),
    )
