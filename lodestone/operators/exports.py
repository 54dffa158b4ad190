"""Drawings as files: PDF with a cross-reference table of byte offsets, and DXF.

Files are put together from rows: each part is a text, its place in the file a running sum of the
lengths before it. One document is one file, so its parts meet in one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(c: Column, places: int = 3) -> Column:
    """A number with so many places at most, without zeros at the end."""
    text = F.regexp_replace(F.format_string(f"%.{places}f", c.cast("double")), r"\.?0+$", "")
    return F.when(text == "-0", "0").otherwise(text)


def _strung(rows: DataFrame, key: list[str], order: list[str], text: Column, name: str, between: str = "\n") -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, text.alias("t"))))
    return rows.groupBy(*key).agg(F.array_join(F.transform(parts, lambda p: p["t"]), between).alias(name))


def placed(parts: DataFrame, key: str) -> DataFrame:
    """Parts (key, n, text) with ``at``, the byte at which each begins."""
    before = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("at", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)))


def pdf_files(pages: DataFrame, shapes: DataFrame, points: DataFrame) -> DataFrame:
    """(doc, startxref, file) of one-page PDF files.

    ``pages``: (doc, w, h). ``shapes``: (doc, shape, hex, even_odd, width), painted in the order of
    ``shape``: filled where ``width`` is null, else stroked. ``points``: (doc, shape, ring, i, x, y), y
    down; rings of filled shapes are closed. A page without shapes is blank."""
    channel = lambda k: number(F.conv(F.substring("hex", 2 + 2 * k, 2), 16, 10).cast("double") / 255)
    first = F.col("i") == F.min("i").over(Window.partitionBy("doc", "shape", "ring"))
    step = F.concat_ws(" ", number(F.col("x")), number(F.col("y")), F.when(first, "m").otherwise("l"))
    rings = _strung(points.withColumn("step", step), ["doc", "shape", "ring"], ["i"], F.col("step"), "path").join(shapes.select("doc", "shape", "width"), ["doc", "shape"])
    rings = rings.withColumn("path", F.when(F.col("width").isNull(), F.concat("path", F.lit("\nh"))).otherwise(F.col("path")))
    body = _strung(rings, ["doc", "shape"], ["ring"], F.col("path"), "body")
    colour = F.concat_ws(" ", *[channel(k) for k in range(3)])
    fill = F.concat(colour, F.lit(" rg\n"), "body", F.when(F.col("even_odd"), "\nf*").otherwise("\nf"))
    stroke = F.concat(colour, F.lit(" RG\n"), number(F.col("width")), F.lit(" w\n"), "body", F.lit("\nS"))
    painted = shapes.join(body, ["doc", "shape"]).withColumn("paint", F.when(F.col("width").isNull(), fill).otherwise(stroke))
    content = _strung(painted, ["doc"], ["shape"], F.col("paint"), "content")
    page = pages.join(content, "doc", "left").withColumn("content", F.concat(F.lit("1 0 0 -1 0 "), number(F.col("h")), F.lit(" cm"), F.coalesce(F.concat(F.lit("\n"), "content"), F.lit(""))))
    box = F.concat(F.lit("[0 0 "), number(F.col("w")), F.lit(" "), number(F.col("h")), F.lit("]"))
    objects = [
        F.lit("<< /Type /Catalog /Pages 2 0 R >>"),
        F.lit("<< /Type /Pages /Kids [3 0 R] /Count 1 >>"),
        F.concat(F.lit("<< /Type /Page /Parent 2 0 R /MediaBox "), box, F.lit(" /Contents 4 0 R /Resources << >> >>")),
        F.concat(F.lit("<< /Length "), F.octet_length("content").cast("string"), F.lit(" >>\nstream\n"), "content", F.lit("\nendstream")),
    ]
    part = lambda n, text: F.struct(F.lit(n).alias("n"), text.alias("text"))
    parts = [part(0, F.lit("%PDF-1.4\n")), *[part(k, F.concat(F.lit(f"{k} 0 obj\n"), o, F.lit("\nendobj\n"))) for k, o in enumerate(objects, 1)]]
    p = placed(page.select("doc", F.explode(F.array(*parts)).alias("p")).select("doc", "p.*"), "doc")
    entry = F.when(F.col("n") > 0, F.concat(F.lpad(F.col("at").cast("string"), 10, "0"), F.lit(" 00000 n \n"))).otherwise("0000000000 65535 f \n")
    row = F.array_sort(F.collect_list(F.struct("n", "text", entry.alias("entry"))))
    f = p.groupBy("doc").agg(row.alias("p"), F.sum(F.octet_length("text")).alias("startxref"))
    joined = lambda c: F.array_join(F.transform("p", lambda x: x[c]), "")
    n = F.size("p").cast("string")
    tail = F.concat(F.lit("trailer\n<< /Size "), n, F.lit(" /Root 1 0 R >>\nstartxref\n"), F.col("startxref").cast("string"), F.lit("\n%%EOF\n"))
    return f.select("doc", "startxref", F.concat(joined("text"), F.lit("xref\n0 "), n, F.lit("\n"), joined("entry"), tail).alias("file"))


def dxf_files(pages: DataFrame, shapes: DataFrame, points: DataFrame) -> DataFrame:
    """(doc, entities, file) of R12 DXF files, from the tables that ``pdf_files`` takes: a polyline for
    each ring of two points or more, y up, on a layer for each colour of fills and of strokes."""
    line = lambda *fields: "\r\n".join(map(str, fields)) + "\r\n"
    layer = F.concat(F.when(F.col("width").isNull(), "FILL_").otherwise("STROKE_"), F.upper(F.substring("hex", 2, 6)))
    s = shapes.select("doc", "shape", layer.alias("layer"), F.col("width").isNull().alias("closed"))
    p = points.join(pages.select("doc", "h"), "doc").join(s, ["doc", "shape"])
    vertex = F.concat(F.lit(line(0, "VERTEX", 8)), "layer", F.lit("\r\n" + line(10)), number(F.col("x"), 4), F.lit("\r\n" + line(20)), number(F.col("h") - F.col("y"), 4), F.lit("\r\n" + line(30, 0)))
    parts = F.array_sort(F.collect_list(F.struct("i", vertex.alias("t"))))
    ring = p.groupBy("doc", "shape", "ring", "layer", "closed").agg(parts.alias("v")).where("size(v) > 1")
    head = F.concat(F.lit(line(0, "POLYLINE", 8)), "layer", F.lit("\r\n" + line(66, 1, 10, 0, 20, 0, 30, 0, 70)), F.when(F.col("closed"), "1").otherwise("0"), F.lit("\r\n"))
    entity = F.concat(head, F.array_join(F.transform("v", lambda x: x["t"]), ""), F.lit(line(0, "SEQEND", 8)), "layer", F.lit("\r\n"))
    layers = F.array_sort(F.collect_set("layer"))
    d = ring.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("shape", "ring", entity.alias("t")))).alias("e"), layers.alias("layers"))
    d = pages.join(d, "doc", "left").withColumns({"e": F.coalesce("e", F.expr("array()")), "layers": F.coalesce("layers", F.array().cast("array<string>"))})
    named = F.array_join(F.transform("layers", lambda n: F.concat(F.lit(line(0, "LAYER", 2)), n, F.lit("\r\n" + line(70, 0, 62, 7, 6, "CONTINUOUS")))), "")
    extent = F.concat(F.lit(line(0, "SECTION", 2, "HEADER", 9, "$ACADVER", 1, "AC1009", 9, "$EXTMIN", 10, 0, 20, 0, 30, 0, 9, "$EXTMAX", 10)), number(F.col("w"), 4), F.lit("\r\n" + line(20)), number(F.col("h"), 4), F.lit("\r\n" + line(30, 0, 0, "ENDSEC")))
    table = F.concat(F.lit(line(0, "SECTION", 2, "TABLES", 0, "TABLE", 2, "LAYER", 70)), (F.size("layers") + 1).cast("string"), F.lit("\r\n" + line(0, "LAYER", 2, 0, 70, 0, 62, 7, 6, "CONTINUOUS")), named, F.lit(line(0, "ENDTAB", 0, "ENDSEC")))
    body = F.concat(F.lit(line(0, "SECTION", 2, "ENTITIES")), F.array_join(F.transform("e", lambda x: x["t"]), ""), F.lit(line(0, "ENDSEC", 0, "EOF")))
    return d.select("doc", F.size("e").alias("entities"), F.concat(extent, table, body).alias("file"))
