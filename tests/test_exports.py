"""Files read back: the cross-reference table of a PDF by its offsets, the groups of a DXF."""

from __future__ import annotations

import re

from lodestone.operators import exports as X

PAGES, SHAPES, POINTS = "doc int, w double, h double", "doc int, shape int, hex string, even_odd boolean, width double", "doc int, shape int, ring int, i int, x double, y double"


def drawing(spark):
    pages = [(1, 40.0, 30.5), (2, 10.0, 10.0)]
    shapes = [(1, 0, "#ff0080", False, None), (1, 1, "#000000", True, None), (1, 2, "#336699", False, 2.25)]
    points = [(1, 0, 0, i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (10, 0.1254), (5, -3)])]
    points += [(1, 1, r, i, r + i * 1.5, 2.0 + i) for r in range(2) for i in range(11)] + [(1, 2, 0, 0, 1.0, 1.0), (1, 2, 0, 1, 30.0, 30.0)]
    return spark.createDataFrame(pages, PAGES), spark.createDataFrame(shapes, SHAPES), spark.createDataFrame(points, POINTS)


def test_pdf_objects_lie_where_the_table_says(spark):
    files = {r["doc"]: (r["startxref"], r["file"].encode()) for r in X.pdf_files(*drawing(spark)).collect()}
    assert files.keys() == {1, 2}
    for start, data in files.values():
        assert data[start:].startswith(b"xref\n0 5\n0000000000 65535 f \n") and data.endswith(f"startxref\n{start}\n%%EOF\n".encode())
        entries = data[start:].split(b"trailer")[0].split(b"\n")[3:-1]
        assert len(entries) == 4 and all(len(e) == 19 for e in entries)
        for k, e in enumerate(entries, 1):
            assert data[int(e[:10]) :].startswith(b"%d 0 obj\n" % k)
        length = int(re.search(rb"/Length (\d+)", data)[1])
        stream = data.split(b"stream\n", 1)[1][:length]
        assert data.split(b"stream\n", 1)[1][length:].startswith(b"\nendstream\nendobj\n") and stream.startswith(b"1 0 0 -1 0 ")
    text = files[1][1].decode()
    assert "/MediaBox [0 0 40 30.5]" in text and "1 0 0.502 rg\n0 0 m\n10 0.125 l\n5 -3 l\nh\nf\n" in text
    assert text.count("\nh\n") == 3 and "\nf*\n" in text and "0.2 0.4 0.6 RG\n2.25 w\n1 1 m\n30 30 l\nS" in text
    # the eleven points of a ring are in order
    assert "0 2 m\n1.5 3 l\n3 4 l" in text and "13.5 11 l\n15 12 l\nh" in text


def test_dxf_groups(spark):
    files = {r["doc"]: (r["entities"], r["file"]) for r in X.dxf_files(*drawing(spark)).collect()}
    assert files[2][0] == 0 and files[2][1].endswith("2\r\nENTITIES\r\n0\r\nENDSEC\r\n0\r\nEOF\r\n")
    fields = files[1][1].split("\r\n")
    assert fields.pop() == "" and len(fields) % 2 == 0
    groups = list(zip(fields[::2], fields[1::2], strict=True))
    assert groups.count(("0", "POLYLINE")) == files[1][0] == 4 and groups.count(("0", "SEQEND")) == 4 and groups.count(("0", "VERTEX")) == 27
    assert [v for c, v in groups if c == "2" and "_" in v] == ["FILL_000000", "FILL_FF0080", "STROKE_336699"]
    assert ("20", "30.3746") in groups and groups[-1] == ("0", "EOF")
