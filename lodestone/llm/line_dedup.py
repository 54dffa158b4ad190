"""Line dedup in DataFrame functions only.

Hashes of line keys are range-partitioned and sorted by (hash, document, position) in each
partition; a running first value over that order streams the first document of each key. What goes
back to the documents is a run-length keep bitmap for each, never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, heavy, partitions

#: Fixed values of the key: what is stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, pos, h1, h2) of each line whose key is long enough. 128 bits stand for a key."""
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda line, pos: F.struct(pos.alias("pos"), line_key(line).alias("key")),
    )
    lines = F.filter(lines, lambda x: F.char_length(x["key"]) >= min_chars)
    hashed = F.transform(
        lines,
        lambda x: F.struct(
            x["pos"].alias("pos"), F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit("second"), x["key"]).alias("h2")
        ),
    )
    return docs.where("doc_id is not null").select("doc_id", "th", F.explode(hashed).alias("x")).select("doc_id", "th", "x.pos", "x.h1", "x.h2")


def dropped_positions(lines: DataFrame, n: int) -> DataFrame:
    """(doc_id, th, pos) of each line whose key has a first occurrence in a smaller document.

    A key that holds more than its share of all lines would fill a range partition alone. Such keys
    number fewer than 8 n, whatever the input, so their first documents, found by a map-side
    combined minimum, are broadcast; the others are range-partitioned and streamed.
    """
    per_key = lines.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min("doc_id").alias("first_doc"))
    hot = heavy(per_key, n).select("h1", "h2", "first_doc")
    from_hot = lines.join(hot, ["h1", "h2"]).where(F.col("doc_id") > F.col("first_doc"))
    order = Window.partitionBy("h1", "h2").orderBy("doc_id", "th", "pos")
    streamed = (
        lines.join(hot, ["h1", "h2"], "left_anti")
        .repartitionByRange(n, "h1")
        .withColumn("first_doc", F.first("doc_id").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .where(F.col("doc_id") > F.col("first_doc"))
    )
    columns = ["doc_id", "th", "pos"]
    return streamed.select(columns).unionByName(from_hot.select(columns))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc_id, th, n_dropped, bitmap) for each document that loses lines. The bitmap is
    run-length coded: array of (start, length) of runs of dropped lines; all other lines stay."""
    at = F.col("at")
    first = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) != x - 1))
    last = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) != x + 1))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))
    # the positions of one document's lines, so no more than its text has
    places = dropped.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return places.select("doc_id", "th", F.size("at").alias("n_dropped"), runs.alias("bitmap"))


def apply_bitmap(lines: Column, bitmap: Column) -> Column:
    """The kept lines: the gaps before each run of dropped ones, and what follows the last."""

    def end(run: Column) -> Column:
        return F.coalesce(run["start"] + run["length"], F.lit(0))

    def kept(own: Column) -> Column:
        gaps = F.transform(
            bitmap, lambda run, i: F.slice(own, end(F.get(bitmap, i - 1)) + 1, run["start"] - end(F.get(bitmap, i - 1)))
        )
        return F.concat(F.flatten(gaps), F.slice(own, end(F.element_at(bitmap, -1)) + 1, F.size(own)))

    # an array of one, so that the lines are bound once and not split again for each run
    return F.when(bitmap.isNull(), lines).otherwise(F.transform(F.array(lines), kept)[0])


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, carry: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_text, bitmap; with ``carry``
    also a struct ``row`` of those columns.

    A key of at least ``min_chars`` code points that occurs in several documents loses its lines
    everywhere but in the document with the smallest id. Null and empty texts are one empty line.
    Rows without an id keep all their lines and count for no other. Rows with the same id count as
    one document, and each of them is returned. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    carried = [F.struct(*carry).alias("row")] if carry else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *carried).withColumn(
        "th", F.xxhash64("doc_id", "text")
    )
    lines = Scratch(spark, "line-dedup").write(line_hashes(rows, min_chars), "lines")
    bitmaps = keep_bitmaps(dropped_positions(lines, n))
    joined = rows.alias("d").join(bitmaps.alias("b"), rows["doc_id"].eqNullSafe(bitmaps["doc_id"]) & (rows["th"] == bitmaps["th"]), "left")
    split = F.split("d.text", "\n", -1)
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(apply_bitmap(split, F.col("b.bitmap")), "\n").alias("kept_text"),
        F.col("b.bitmap").alias("bitmap"),
        *([F.col("d.row").alias("row")] if carry else []),
    )
