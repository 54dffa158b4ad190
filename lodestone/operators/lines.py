"""Sets of curves: how well one covers the other, and open ends that are joined."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import ranked
from .sequence import interval_islands, resampled
from .spatial import nearest, within


def _samples(curves: DataFrame, group: list[str], step: float) -> DataFrame:
    """(group, curve, k, id, x, y) at even arc lengths; a curve of one point or no length has none."""
    s = resampled(curves, [*group, "curve"], "i", step)
    return s.withColumn("id", F.col("curve").cast("long") * 4_294_967_296 + F.col("k"))


#: Samples of either side up to which a group is one row.
SMALL = 1024


def _nearest_in_rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distances within groups whose samples ``a`` and ``b`` are lists, both ways, batch by batch."""
    for batch in it:
        start, xy = {}, {}
        for c in "ab":
            rows = batch.column(c)
            start[c] = rows.offsets.to_numpy() - rows.offsets[0].as_py()
            flat = rows.flatten()
            xy[c] = flat, *(flat.field(n).to_numpy(zero_copy_only=False) for n in "xy")
        (fa, ax, ay), (fb, bx, by) = xy["a"], xy["b"]
        out = {c: np.full(len(x), np.nan) for c, x in (("a", ax), ("b", bx))}
        for g in range(batch.num_rows):
            i, j = (slice(start[c][g], start[c][g + 1]) for c in "ab")
            if i.start < i.stop and j.start < j.stop:
                away = (ax[i, None] - bx[j]) ** 2 + (ay[i, None] - by[j]) ** 2
                out["a"][i], out["b"][j] = away.min(axis=1), away.min(axis=0)
        for c, flat, other in (("a", fa, False), ("b", fb, True)):
            of = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(start[c])))
            group = {n: batch.column(n).take(of) for n in batch.schema.names if n not in ("a", "b")}
            d = np.sqrt(np.round(out[c], 12))
            yield pa.RecordBatch.from_pydict(group | {"other": pa.array(np.full(len(of), other)), "curve": flat.field("curve"), "k": flat.field("k"), "distance": pa.array(d, mask=np.isnan(d))})


def mutual_distances(curves: DataFrame, others: DataFrame, group: list[str], step: float, checkpoint) -> DataFrame:
    """(group, other, curve, k, distance): from samples of curves (group, curve, i, x, y) to the nearest
    sample of the others in the group, and from theirs (``other``) to the nearest of the curves; null where the
    group has none. A group with few samples is one row and settled there, so samples of curves that are
    dealt by group are not shuffled; groups with many go through the cells of ``nearest``."""
    a, b = (_samples(c.withColumn("curve", F.col("curve").cast("long")), group, step) for c in (curves, others))
    n = [s.groupBy(*group).agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select(*group) for s in (a, b)]
    large = checkpoint(n[0].union(n[1]).distinct())
    some = not large.isEmpty()
    rows = None
    for name, s in (("a", a), ("b", b)):
        few = s.join(large, group, "left_anti") if some else s
        one = few.groupBy(*group).agg(F.collect_list(F.struct("curve", "k", "x", "y")).alias(name))
        rows = one if rows is None else rows.join(one.hint("merge"), group, "full")
    empty = lambda c: F.coalesce(c, F.array().cast("array<struct<curve:bigint,k:bigint,x:double,y:double>>")).alias(c)
    kinds = ", ".join(f"`{c}` {curves.schema[c].dataType.simpleString()}" for c in group)
    found = rows.select(*group, empty("a"), empty("b")).mapInArrow(_nearest_in_rows, f"{kinds}, other boolean, curve long, k long, distance double")
    if not some:
        return found
    many = [checkpoint(s.join(large, group, "left_semi")) for s in (a, b)]
    for other, (s, to) in enumerate((many, many[::-1])):
        o = to.select(*group, F.col("id").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        near = nearest(s.select(*group, "id", "x", "y"), o, 4 * step, group, checkpoint).select(*group, "id", "distance")
        found = found.unionByName(s.join(near, [*group, "id"], "left").select(*group, F.lit(other == 1).alias("other"), "curve", "k", "distance"))
    return found


def distances(curves: DataFrame, others: DataFrame, group: list[str], step: float, checkpoint) -> DataFrame:
    """(group, curve, k, distance) of ``mutual_distances`` from curves to others alone."""
    return mutual_distances(curves, others, group, step, checkpoint).where("not other").drop("other")


def covered(d: DataFrame, group: list[str], step: float, tolerance: float) -> DataFrame:
    """(group, curve, length, covered, stretches): of each curve's samples how far those within the
    tolerance reach, runs of neighbours merged into stretches."""
    near = d.where(F.col("distance") <= tolerance)
    runs = interval_islands(near, [*group, "curve"], "k", "k", slack=1)
    found = runs.groupBy(*group, "curve").agg(F.sum(F.col("to_") - F.col("from_")).alias("steps"), F.count("*").alias("stretches"))
    whole = d.groupBy(*group, "curve").agg(F.max("k").alias("last"))
    out = whole.join(found, [*group, "curve"], "left")
    return out.select(*group, "curve", (F.col("last") * step).alias("length"), (F.coalesce("steps", F.lit(0)) * step).alias("covered"), F.coalesce("stretches", F.lit(0)).alias("stretches"))


def matched_ends(pairs: DataFrame, checkpoint, most_rounds: int = 1000) -> DataFrame:
    """Pairs (lo, hi, gap) of a one-to-one matching, the smallest gap first, ties by lo and hi. Each round
    takes the pairs that are the best of both their ends, which is what taking one at a time leads to."""
    left, out = checkpoint(pairs.select("lo", "hi", "gap")), None
    order = F.struct("gap", "lo", "hi")
    for _ in range(most_rounds):
        best = left.select(F.explode(F.array("lo", "hi")).alias("end"), order.alias("p")).groupBy("end").agg(F.min("p").alias("p"))
        took = checkpoint(best.groupBy("p").agg(F.count("*").alias("n")).where("n = 2").select("p.lo", "p.hi", "p.gap"))
        out = took if out is None else out.unionByName(took)
        if took.isEmpty():
            return out
        used = took.select(F.explode(F.array("lo", "hi")).alias("end"))
        left = checkpoint(left.join(used.withColumnRenamed("end", "lo"), "lo", "left_anti").join(used.withColumnRenamed("end", "hi"), "hi", "left_anti"))
    raise RuntimeError(f"ends are left after {most_rounds} rounds")


def joined_ends(curves: DataFrame, group: list[str], reach: float, checkpoint) -> DataFrame:
    """(group, path, ord, x, y, closed): open curves (group, curve, i, x, y) joined where free ends lie
    within ``reach``: ends are matched one to one, nearest first, and two that meet become one node
    midway. Curves are turned as needed; a path is named by its least curve, and a path whose ends meet
    is closed. A curve's own two ends may meet. ``curve`` is unique over all groups; curves of one
    point have no ends and are left out."""
    p = curves.select(*group, F.col("curve").cast("long").alias("curve"), "i", "x", "y")
    ends = p.groupBy(*group, "curve").agg(F.min(F.struct("i", "x", "y")).alias("s"), F.max(F.struct("i", "x", "y")).alias("e")).where("s.i < e.i")
    # end 2 c is the start of curve c, 2 c + 1 its end
    side = lambda k, at: F.struct((F.col("curve") * 2 + k).alias("end"), F.col(f"{at}.x").alias("x"), F.col(f"{at}.y").alias("y"))
    e = checkpoint(ends.select(*group, F.explode(F.array(side(0, "s"), side(1, "e"))).alias("p")).select(*group, "p.*"))
    other = e.select(*group, F.col("end").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = within(e.withColumnRenamed("end", "id"), other, reach, group).where("id < oid")
    gap = F.round(F.sqrt((F.col("x") - F.col("ox")) ** 2 + (F.col("y") - F.col("oy")) ** 2), 9)
    pairs = matched_ends(near.select(F.col("id").alias("lo"), F.col("oid").alias("hi"), gap.alias("gap")), checkpoint)
    both = checkpoint(pairs.select("lo", "hi").unionByName(pairs.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).select(F.col("lo").alias("end"), F.col("hi").alias("mate")))
    # a walk that leaves through an end enters at its mate and leaves there through the other end
    flip = lambda c: F.col(c) + 1 - 2 * (F.col(c) % 2)
    links = e.select("end").join(both, "end", "left").select(F.col("end").alias("id"), flip("mate").alias("next"))
    r = checkpoint(ranked(links, checkpoint).withColumn("curve", F.floor(F.col("id") / 2)))
    # a path is walked both ways; the way that starts at the smaller end counts
    walk = r.groupBy("last").agg(F.max("closed").alias("ring"), F.max(F.struct("rest", flip("id").alias("start"))).alias("first"), F.min("curve").alias("path"))
    walk = walk.groupBy("path").agg(F.min(F.struct("first.start", "last", "first.rest")).alias("w")).select("path", "w.last", F.col("w.rest").alias("steps"))
    s = r.join(walk, "last").select("id", "curve", "path", "closed", (F.col("steps") - F.col("rest")).alias("pos"))
    at = e.select(F.col("end").alias("mate"), F.col("x").alias("mx"), F.col("y").alias("my"))
    mates = both.join(at, "mate").select("end", "mx", "my")
    # each curve brings its points but for the one where the next takes over; the first is put midway
    pt = p.join(s, "curve").join(ends.select("curve", F.col("s.i").alias("low"), F.col("e.i").alias("high")), "curve")
    forward = F.col("id") % 2 == 1
    entry = F.when(forward, F.col("i") == F.col("low")).otherwise(F.col("i") == F.col("high"))
    leave = F.when(forward, F.col("i") == F.col("high")).otherwise(F.col("i") == F.col("low"))
    pt = pt.withColumns({"entry": F.when(entry, flip("id")), "leave": F.when(leave, F.col("id"))})
    pt = pt.join(mates.withColumnRenamed("end", "entry"), "entry", "left").join(both.select(F.col("end").alias("leave"), F.lit(True).alias("goes_on")), "leave", "left").where("goes_on is null")
    mid = lambda c: F.coalesce((F.col(c) + F.col(f"m{c}")) / 2, F.col(c)).alias(c)
    return pt.select(*group, "path", F.struct("pos", F.when(forward, F.col("i")).otherwise(-F.col("i")).alias("i")).alias("ord"), mid("x"), mid("y"), "closed")
