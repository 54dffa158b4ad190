"""Queries of style sheets applied to elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cascade as Y
from ..sources.roles import table
from .registry import query

#: Per part with key k and size s, six elements and the rules that their sheet states.
ELEMENTS = """p AS (SELECT p_partkey AS k, p_size AS s FROM part),
el AS (SELECT k, 0 AS el, 'rect' AS tag, 'i' || k % 3 AS id, ['hot', 'c' || s % 4] AS cls, [] AS own FROM p UNION ALL SELECT k, 1, 'circle', NULL, ['c' || s % 2], [] FROM p
 UNION ALL SELECT k, 2, 'line', NULL, ['p'], [] FROM p UNION ALL SELECT k, 3, 'rect', NULL, ['deep'], [] FROM p
 UNION ALL SELECT k, 4, 'line', 'i9', ['hot'], [] FROM p UNION ALL SELECT k, 5, 'rect', 'i' || s % 3, ['hot'], ['fill', 'stroke-width'] FROM p),
ru AS (SELECT k, * FROM p, (VALUES (0, 'rect', NULL, [], 'fill', 'red', 0), (1, 'rect', NULL, [], 'stroke', 'blue', 0), (2, NULL, NULL, ['c1'], 'fill', 'green', 0), (3, NULL, 'i1', ['hot'], 'fill', 'gold', 2),
 (4, NULL, NULL, [], 'opacity', '.5', 0), (5, 'rect', NULL, ['hot'], 'stroke', 'teal', 0), (6, 'circle', NULL, [], 'stroke', 'teal', 0)) v(ord, rtag, rid, rcls, name, value, rank)),
hit AS (SELECT el.k, el, name, value, rank, ((rid IS NOT NULL)::INT * 100 + len(rcls) * 10 + (rtag IS NOT NULL)::INT) * 100 + ord AS weight FROM el JOIN ru ON ru.k = el.k AND coalesce(rtag = tag, true) AND (rid IS NULL OR coalesce(rid = id, false)) AND list_has_all(cls, rcls)
 UNION ALL SELECT k, el, unnest(own), CASE unnest(own) WHEN 'fill' THEN 'navy' ELSE '2' END, 1, 0 FROM el),
loose AS (SELECT k, el FROM el WHERE list_contains(cls, 'p') OR (tag = 'line') OR list_contains(cls, 'deep'))"""


@query(f"""WITH {ELEMENTS} SELECT k, el, name, max_by(value, rank * 100000 + weight) AS value, CASE max(rank) WHEN 2 THEN 'important' WHEN 1 THEN 'own' ELSE 'rule' END AS origin FROM hit WHERE (k, el) NOT IN (SELECT k, el FROM loose) GROUP BY 1, 2, 3
UNION ALL SELECT k, el, NULL, NULL, 'unresolved' FROM loose""")
def inlined_styles(spark, sf):
    """Each element's winning declarations under its document's sheet, and the elements that a rule
    may reach that names more than the element itself."""
    k, s = F.col("p_partkey"), F.col("p_size")
    css = F.lit(
        "@charset 'x'; /* rect{fill:none} */ rect{fill:red; STROKE : blue;broken} .c1{fill:green}\n#i1.hot{fill:gold ! important} *{opacity:.5}"
        " @font-face{font-family:x; src:y} @media print{ .p{fill:black} @supports (x:y){ line{stroke:pink} } } rect.hot , circle{stroke:teal} g > .deep:hover{fill:none}"
    )
    named = lambda mark, n: F.concat(F.lit(mark), n.cast("string"))
    none = F.lit(None).cast("string")
    one = lambda el, tag, i, classes, style=none: F.struct(F.lit(el).alias("el"), F.lit(tag).alias("tag"), i.alias("id"), F.array(*classes).alias("classes"), style.alias("style"))
    hot = F.lit("hot")
    elements = F.array(
        one(0, "rect", named("i", k % 3), [hot, named("c", s % 4)]),
        one(1, "Circle", none, [named("c", s % 2)]),
        one(2, "line", none, [F.lit("p")]),
        one(3, "rect", none, [F.lit("deep")]),
        one(4, "line", F.lit("i9"), [hot]),
        one(5, "rect", named("i", s % 3), [hot], F.lit("fill: navy; stroke-width:2;")),
    )
    # a sheet takes far longer to read than its row says: few parts of a file are dealt to all tasks
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = table(spark, sf, "part").select("p_partkey", "p_size").repartition(tasks, "p_partkey").select(k.alias("k"), css.alias("css"), elements.alias("e"))
    return Y.inlined(p.select("k", F.explode("e").alias("e")).select("k", "e.*"), Y.selectors(p, "k", "css"), "k")
