"""Queries of drawings read from their markup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colours as C
from ..operators import geometry as G
from ..operators import scan as R
from ..sources import drawings as D
from ..sources.roles import labels, sheet_labels, table
from ..sources.scratch import written
from .registry import query


def _markup(spark, sf):
    """A drawing for each part: groups with transforms and inherited paints, relative and absolute
    path data, basic shapes, what is not painted, and broken markup for every ninth part."""
    k, s = F.col("p_partkey"), F.col("p_size")
    t = lambda c: c.cast("string")
    text = F.concat(
        F.lit('<svg xmlns="http://www.w3.org/2000/svg"><defs><path d="M0 0h9"/></defs><g transform="translate('), t(s), F.lit(' 2) scale(2)" fill="tomato" stroke-width="3">'),
        F.lit('<path d="M1 1h3v4l-3 0zm5 5L8,9-1-1"/><rect x="1" y="2" width="'), t(k % 7 + 1), F.lit('" height="3" style="fill:none; stroke:red"/>'),
        F.lit('<g display="none"><line x2="4"/></g></g><circle cx="'), t(s), F.lit('" cy="5" r="2" opacity=".5"/><g fill="none" stroke="currentColor" color="#00f"><polyline points="0,0 1,1 2 '), t(k % 5), F.lit('"/>'),
        F.lit('<path id="q" d="M0 0q1 2 2 0t2,0S5 5 6 0 7 1 8 0" fill-rule="evenodd"/></g>'), F.when(k % 9 == 0, "<g>").otherwise(""), F.lit("</svg>"),
    )
    # a small file may come as one task, which a short row's long markup would keep busy
    parts = table(spark, sf, "part").select(k, s).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), k)
    return parts.select(k.alias("doc"), text.alias("svg"))


@query("""WITH p AS (SELECT p_partkey AS doc, p_size AS s, p_partkey AS k FROM part)
SELECT doc, 0 AS item, 'path' AS tag, '#ff6347' AS fill, NULL AS stroke, 6.0 AS width, false AS even_odd, 1.0 AS opacity, 2 AS rings, 6 AS segments, (6 * s + 34)::DOUBLE AS sum_x, 52.0 AS sum_y FROM p
UNION ALL SELECT doc, 1, 'rect', NULL, '#ff0000', 6.0, false, 1.0, 1, 4, 4 * s + 4 * (k % 7 + 2) + 4, 36 FROM p
UNION ALL SELECT doc, 2, 'circle', '#000000', NULL, 1.0, false, 0.5, 1, 5, 5 * s + 2, 25 FROM p
UNION ALL SELECT doc, 3, 'polyline', NULL, '#0000ff', 1.0, false, 1.0, 1, 2, 3, 1 + k % 5 FROM p
UNION ALL SELECT doc, 4, 'path', NULL, '#0000ff', 1.0, true, 1.0, 1, 4, 20, 0 FROM p
UNION ALL SELECT doc, 5, 'broken', NULL, NULL, NULL, NULL, NULL, 0, 0, NULL, NULL FROM p WHERE k % 9 = 0""")
def drawn_items(spark, sf):
    """The painted elements of each drawing: paints in one form, stroke widths on the page, rings and
    segments, and the sums of the segments' ends."""
    d = D.drawn_items(_markup(spark, sf), "doc", "svg")
    ends = lambda at: F.aggregate("segments", F.lit(0.0), lambda a, x: a + F.get(x["p"], F.lit(at)))
    rings = F.size(F.array_distinct(F.transform("segments", lambda x: x["ring"])))
    some = lambda c: F.when(F.col("tag") != "broken", c)
    return d.select(
        "doc", "item", "tag", C.paint(F.col("fill")).alias("fill"), C.paint(F.col("stroke")).alias("stroke"), "width", "even_odd", F.col("fill_opacity").alias("opacity"),
        rings.alias("rings"), F.size("segments").alias("segments"), some(F.round(ends(6), 6)).alias("sum_x"), some(F.round(ends(7), 6)).alias("sum_y"),
    )


def _rendered(traced, truth, size: int):
    """Outlines (img_id, label, d) as markup, read again, filled and held against the pixels that they
    were traced from."""
    svg = F.concat(F.lit('<svg><path fill-rule="evenodd" d="'), "d", F.lit('"/></svg>'))
    items = D.drawn_items(traced.select(F.struct("img_id", "label").alias("k"), svg.alias("svg")), "k", "svg")
    s = D.segment_rows(items, "k").select("k.*", "ring", "seg", "kind", *[f"{n}{i}" for i in range(4) for n in "xy"])
    cover = R.coverage(R.flattened(s, ["img_id", "label"]), ["img_id", "label"], size, size, even_odd=True)
    own = truth.select("img_id", "label", "x", "y", F.lit(1.0).alias("there"))
    both = own.join(cover, ["img_id", "label", "x", "y"], "full").select("img_id", "label", F.coalesce("there", F.lit(0.0)).alias("t"), F.coalesce("coverage", F.lit(0.0)).alias("c"))
    total = lambda c: F.round(F.sum(c), 6)
    both = both.groupBy("img_id", "label").agg(total("t").alias("area"), total(F.least("t", "c")).alias("shared"), total(F.greatest("t", "c")).alias("either"))
    return both.withColumn("overlap", F.round(F.col("shared") / F.col("either"), 6))


@query()
def traced_overlap(spark, sf):
    """Each label's simplified outlines rendered again: how much of the label they cover, and what they
    share of all that either covers."""
    px = labels(spark, sf).where("label >= 0")
    return _rendered(written(G.traced(px), "traced"), px, 8)


@query()
def traced_sheets(spark, sf):
    """The same for whole sheets of 64 by 64 pixels."""
    px = sheet_labels(spark, sf).where("label >= 0")
    return _rendered(written(G.traced(px), "traced-sheets"), px, 64)
