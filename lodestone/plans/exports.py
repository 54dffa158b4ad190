"""Queries of drawings written as files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exports as X
from ..sources.roles import table
from .registry import query

#: Per vector a page with a filled triangle, a filled pair of rings and a stroked line, on a grid of tenths.
DRAWING = """pt AS (SELECT vec_id AS doc, i // 3 AS k, i % 3 AS i, 50 + floor(1000 * CAST(embedding[2 * i + 1] AS DOUBLE)) / 10 AS x, 50 + floor(1000 * CAST(embedding[2 * i + 2] AS DOUBLE)) / 10 AS y FROM embeddings, range(12) t(i)),
num AS (SELECT doc, k, i, x, y, CASE WHEN fx = '-0' THEN '0' ELSE fx END AS fx, CASE WHEN fy = '-0' THEN '0' ELSE fy END AS fy, CASE WHEN dy = '-0' THEN '0' ELSE dy END AS dy FROM (SELECT *, regexp_replace(printf('%.3f', x), '\\.?0+$', '') AS fx, regexp_replace(printf('%.3f', y), '\\.?0+$', '') AS fy, regexp_replace(printf('%.4f', 100 - y), '\\.?0+$', '') AS dy FROM pt)),
ring AS (SELECT doc, k, string_agg(fx || ' ' || fy || CASE WHEN i = 0 THEN ' m' ELSE ' l' END, chr(10) ORDER BY i) AS path FROM num GROUP BY 1, 2),
content AS (SELECT doc, '1 0 0 -1 0 100 cm' || chr(10) || '1 0.388 0.278 rg' || chr(10) || max(path) FILTER (WHERE k = 0) || chr(10) || 'h' || chr(10) || 'f' || chr(10)
 || '0 0.502 0.502 rg' || chr(10) || max(path) FILTER (WHERE k = 1) || chr(10) || 'h' || chr(10) || max(path) FILTER (WHERE k = 2) || chr(10) || 'h' || chr(10) || 'f*' || chr(10)
 || '0 0 0 RG' || chr(10) || '1.5 w' || chr(10) || max(path) FILTER (WHERE k = 3) || chr(10) || 'S' AS c FROM ring GROUP BY 1),
part AS (SELECT doc, 0 AS n, '%PDF-1.4' || chr(10) AS t FROM content UNION ALL SELECT doc, 1, '1 0 obj' || chr(10) || '<< /Type /Catalog /Pages 2 0 R >>' || chr(10) || 'endobj' || chr(10) FROM content
 UNION ALL SELECT doc, 2, '2 0 obj' || chr(10) || '<< /Type /Pages /Kids [3 0 R] /Count 1 >>' || chr(10) || 'endobj' || chr(10) FROM content
 UNION ALL SELECT doc, 3, '3 0 obj' || chr(10) || '<< /Type /Page /Parent 2 0 R /MediaBox [0 0 100 100] /Contents 4 0 R /Resources << >> >>' || chr(10) || 'endobj' || chr(10) FROM content
 UNION ALL SELECT doc, 4, '4 0 obj' || chr(10) || '<< /Length ' || strlen(c) || ' >>' || chr(10) || 'stream' || chr(10) || c || chr(10) || 'endstream' || chr(10) || 'endobj' || chr(10) FROM content),
at_ AS (SELECT *, coalesce(sum(strlen(t)) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM part)"""


def _drawing(spark, sf):
    e = F.col("embedding")
    p = lambda j, c: (50 + F.floor(1000 * e[2 * j + c].cast("double")) / 10).alias("xy"[c])
    points = F.array(*[F.struct(F.lit((0, 1, 1, 2)[j // 3]).alias("shape"), F.lit(j // 3).alias("ring"), F.lit(j % 3).alias("i"), p(j, 0), p(j, 1)) for j in range(12)])
    t = table(spark, sf, "embeddings")
    doc = F.col("vec_id").alias("doc")
    pages = t.select(doc, F.lit(100).alias("w"), F.lit(100).alias("h"))
    shape = lambda k, colour, even_odd, width: F.struct(F.lit(k).alias("shape"), F.lit(colour).alias("hex"), F.lit(even_odd).alias("even_odd"), F.lit(width).cast("double").alias("width"))
    shapes = F.array(shape(0, "#ff6347", False, None), shape(1, "#008080", True, None), shape(2, "#000000", False, 1.5))
    unpacked = lambda a: t.select(doc, F.explode(a).alias("s")).select("doc", "s.*")
    return pages, unpacked(shapes), unpacked(points)


@query(f"""WITH {DRAWING}, body AS (SELECT doc, sum(strlen(t))::BIGINT AS startxref, string_agg(t, '' ORDER BY n) AS b, string_agg(CASE WHEN n = 0 THEN '0000000000 65535 f ' ELSE lpad(CAST(place AS BIGINT)::VARCHAR, 10, '0') || ' 00000 n ' END || chr(10), '' ORDER BY n) AS x FROM at_ GROUP BY 1),
f AS (SELECT doc, startxref, b || 'xref' || chr(10) || '0 5' || chr(10) || x || 'trailer' || chr(10) || '<< /Size 5 /Root 1 0 R >>' || chr(10) || 'startxref' || chr(10) || startxref || chr(10) || '%%EOF' || chr(10) AS file FROM body)
SELECT doc, startxref, strlen(file) AS n_bytes, sha256(file) AS sha256 FROM f""")
def pdf_documents(spark, sf):
    """Each drawing as a PDF file: where its cross-reference table begins, its size and digest."""
    f = X.pdf_files(*_drawing(spark, sf))
    return f.select("doc", "startxref", F.octet_length("file").cast("long").alias("n_bytes"), F.sha2("file", 256).alias("sha256"))


CRLF = "chr(13) || chr(10)"


def _dxf_sql() -> str:
    line = lambda *fields: " || ".join(f"'{f}' || {CRLF}" for f in fields)
    layer = "CASE k WHEN 0 THEN 'FILL_FF6347' WHEN 3 THEN 'STROKE_000000' ELSE 'FILL_008080' END"
    return f"""WITH {DRAWING}, v AS (SELECT doc, k, {layer} AS layer, string_agg({line(0, 'VERTEX', 8)} || {layer} || {CRLF} || {line(10)} || fx || {CRLF} || {line(20)} || dy || {CRLF} || {line(30, 0)}, '' ORDER BY i) AS t FROM num GROUP BY 1, 2, 3),
e AS (SELECT doc, count(*) AS entities, string_agg({line(0, 'POLYLINE', 8)} || layer || {CRLF} || {line(66, 1, 10, 0, 20, 0, 30, 0, 70)} || CASE WHEN k = 3 THEN '0' ELSE '1' END || {CRLF} || t || {line(0, 'SEQEND', 8)} || layer || {CRLF}, '' ORDER BY k) AS t FROM v GROUP BY 1),
f AS (SELECT doc, entities, {line(0, 'SECTION', 2, 'HEADER', 9, '$ACADVER', 1, 'AC1009', 9, '$EXTMIN', 10, 0, 20, 0, 30, 0, 9, '$EXTMAX', 10, 100, 20, 100, 30, 0, 0, 'ENDSEC', 0, 'SECTION', 2, 'TABLES', 0, 'TABLE', 2, 'LAYER', 70, 4, 0, 'LAYER', 2, 0, 70, 0, 62, 7, 6, 'CONTINUOUS')}
 || {' || '.join(line(0, 'LAYER', 2, n, 70, 0, 62, 7, 6, 'CONTINUOUS') for n in ('FILL_008080', 'FILL_FF6347', 'STROKE_000000'))} || {line(0, 'ENDTAB', 0, 'ENDSEC', 0, 'SECTION', 2, 'ENTITIES')} || t || {line(0, 'ENDSEC', 0, 'EOF')} AS file FROM e)
SELECT doc, entities, strlen(file) AS n_bytes, sha256(file) AS sha256 FROM f"""


@query(_dxf_sql())
def dxf_documents(spark, sf):
    """Each drawing as a DXF file: its polylines, size and digest."""
    f = X.dxf_files(*_drawing(spark, sf))
    return f.select("doc", F.col("entities").cast("long").alias("entities"), F.octet_length("file").cast("long").alias("n_bytes"), F.sha2("file", 256).alias("sha256"))
