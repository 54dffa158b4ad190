"""Lists in order: items that name their followers are ranked by jumping pointers, and boundary steps
and polylines become chains."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _jumped(to: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where lists of positions lead (an end points at itself), after how many steps, and the least of
    what is passed. On a ring the place is any, the least that of the ring."""
    rest = (to != np.arange(len(to))).astype(np.int64)
    for _ in range(len(to).bit_length()):
        rest, least, to = rest + rest[to], np.minimum(least, least[to]), to[to]
    return to, rest, least


def _block_ranked(tab: pa.Table) -> pa.Table:
    """The items of a block with the lists that lie in it: the first item of an item's list here, the
    last one, how many follow, whether the list is a ring, and the item of another block that comes after."""
    ids, following = tab.column("id").to_numpy(), tab.column("next").combine_chunks()
    order = np.argsort(ids)
    n, at, goes = len(ids), np.arange(len(ids)), following.is_valid().to_numpy(zero_copy_only=False)
    aim = following.fill_null(0).to_numpy(zero_copy_only=False)
    found = order[np.minimum(np.searchsorted(ids, aim, sorter=order), n - 1)]
    inside = goes & (ids[found] == aim)
    to = np.where(inside, found, at)
    last, rest, least = _jumped(to, ids)
    ring = inside[last]
    to = np.where(ring & (ids[to] == least), at, to)
    last, rest, _ = _jumped(to, ids)
    back = at.copy()
    back[to[to != at]] = at[to != at]
    first, _, _ = _jumped(back, ids)
    leaves = (goes & ~inside)[last]
    out = {"first": ids[first], "last": ids[last], "rest": rest, "steps": rest[first], "closed": ring, "onto": pa.array(aim[last], pa.int64(), mask=~leaves)}
    for name, values in out.items():
        tab = tab.append_column(name, values if isinstance(values, pa.Array) else pa.array(values))
    return tab


def ranked_in_blocks(links: DataFrame, block: list[str], checkpoint, only: Column | None = None, most_rounds: int = 60) -> DataFrame:
    """The items (id, next, block and further columns) with (first, last, rest, steps, closed): the items
    at both ends of their list, how many follow, how many follow the first, and what ``ranked`` says.

    Items of one ``block`` lie near each other, and a block is of bounded size. Lists that lie in one are
    ranked there at once; those that leave one take part in the rounds of ``ranked``. ``only`` says by
    these columns which lists are wanted."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in links.schema)
    dealt = links.groupBy(*block).applyInArrow(_block_ranked, f"{types}, first long, last long, rest long, steps long, closed boolean, onto long")
    only = F.lit(True) if only is None else only
    here = checkpoint(dealt.where(F.col("onto").isNotNull() | only))
    if here.where("onto is not null").isEmpty():
        return here.drop("onto")
    # what comes in from other blocks is known only with all lists at hand
    here = checkpoint(dealt)
    entered = here.where("onto is not null").select(F.col("onto").alias("first"), F.lit(True).alias("entered")).distinct()
    told = checkpoint(here.join(entered, "first", "left").withColumn("whole", F.col("entered").isNull() & F.col("onto").isNull()))
    far = told.where("not whole").select(links.columns)
    rest = checkpoint(ranked(far.select("id", "next"), checkpoint, most_rounds))
    ends = rest.groupBy("last").agg(F.max(F.struct("rest", "id")).alias("f")).select("last", F.col("f.id").alias("first"), F.col("f.rest").alias("steps"))
    out = [*links.columns, "first", "last", "rest", "steps", "closed"]
    return told.where("whole").select(out).unionByName(far.join(rest.join(ends, "last"), "id").select(out)).where(only)


def ranked(links: DataFrame, checkpoint, most_rounds: int = 60) -> DataFrame:
    """(id, last, rest, closed) of items (id, next): the item at the end of its list, how many follow,
    and whether the list is a ring; a ring is cut before its least id, and ``last`` is the item there.

    Each round an item takes over the pointer of the item it points at, so a list of n takes log2 n
    rounds. An item has one predecessor at most."""
    here = F.col("next").isNull()
    now = checkpoint(links.select("id", F.coalesce("next", "id").alias("to"), F.when(here, 0).otherwise(1).cast("long").alias("rest"), here.alias("ended"), F.least("id", F.coalesce("next", "id")).alias("least")))
    mark = None
    for _ in range(most_rounds):
        on = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("rest").alias("rest2"), F.col("ended").alias("ended2"), F.col("least").alias("least2"))
        now = checkpoint(now.join(on, "to").select("id", F.col("to2").alias("to"), (F.col("rest") + F.col("rest2")).alias("rest"), F.col("ended2").alias("ended"), F.least("least", "least2").alias("least")))
        # on a ring the least id of a stretch and of one twice as long agree everywhere only if all is seen
        found = now.agg(F.bit_xor(F.xxhash64("id", "ended", F.when(F.col("ended"), F.col("to")), F.when(~F.col("ended"), F.col("least"))))).first()[0]
        if found == mark:
            break
        mark = found
    else:
        raise RuntimeError(f"lists are longer than {most_rounds} rounds reach")
    done = now.where("ended").select("id", F.col("to").alias("last"), "rest", F.lit(False).alias("closed"))
    ring = now.where("not ended").select("id", "least")
    if ring.isEmpty():
        return done
    cut = links.join(ring, "id").select("id", F.when(F.col("next") != F.col("least"), F.col("next")).alias("next"))
    return done.unionByName(ranked(cut, checkpoint, most_rounds).select("id", "last", "rest", F.lit(True).alias("closed")))


#: Steps to the east, south, west and north, y down.
DX, DY = (1, 0, -1, 0), (0, 1, 0, -1)
WIDE = 131_072
#: Steps are ranked in tiles of so many pixels first.
TILE = 64


def _number(x: Column, y: Column, way: Column) -> Column:
    """A step's number: image, corner that it leaves (rows first), direction."""
    return ((F.col("img_id") * WIDE + y) * WIDE + x) * 4 + way


def boundary_chains(cracks: DataFrame, checkpoint) -> DataFrame:
    """(img_id, chain, ord, x, y, left, right, closed): the boundary network of a label map as chains.

    ``cracks``: (img_id, x0, y0, x1, y1, a, b), unit steps to the east or south with the labels above
    or left of them (a) and below or right (b). Chains run between corners where three steps or more
    meet, from the end of the smaller corner and direction; the others are closed, start at their
    least corner and go east. A chain has a row for each corner, and the labels to its left and right
    as it runs. ``chain`` is the number of its first step."""
    east = F.col("x1") > F.col("x0")
    step = lambda x, y, way, left, right: F.struct(x.alias("x"), y.alias("y"), way.alias("way"), left.alias("left"), right.alias("right"))
    a, b = F.col("a"), F.col("b")
    there = step(F.col("x0"), F.col("y0"), F.when(east, 0).otherwise(1), F.when(east, a).otherwise(b), F.when(east, b).otherwise(a))
    back = step(F.col("x1"), F.col("y1"), F.when(east, 2).otherwise(3), F.when(east, b).otherwise(a), F.when(east, a).otherwise(b))
    d = cracks.select("img_id", F.explode(F.array(there, back)).alias("s")).select("img_id", "s.*")
    ahead = lambda c, steps: F.col(c) + F.element_at(F.array(*map(F.lit, steps)), F.col("way") + 1)
    d = d.withColumns({"hx": ahead("x", DX), "hy": ahead("y", DY)})
    d = d.withColumns({"id": _number(F.col("x"), F.col("y"), F.col("way")), "twin": _number(F.col("hx"), F.col("hy"), (F.col("way") + 2) % 4)})
    # a step comes in where its twin leaves; where two leave, the one that is not the way back goes on
    corner = Window.partitionBy("img_id", "x", "y")
    follow = F.when(F.count("*").over(corner) == 2, F.sum("id").over(corner) - F.col("id"))
    links = d.select("img_id", F.col("twin").alias("id"), follow.alias("next"), F.col("right").alias("left"), F.col("left").alias("right"))
    place = lambda c: tuple(F.shiftright(c, k).bitwiseAND(m - 1).cast("int") for k, m in ((2, WIDE), (19, WIDE), (0, 4)))

    def twin(c: str) -> Column:
        x, y, way = place(c)
        return _number(x + F.element_at(F.array(*map(F.lit, DX)), way + 1), y + F.element_at(F.array(*map(F.lit, DY)), way + 1), (way + 2) % 4)

    # each chain is found from both sides; the twin of the last step is the first of the same chain run backwards
    runs = F.when(F.col("closed"), F.col("first") % 4 == 0).otherwise(F.col("first") < twin("last"))
    x, y, _ = place("id")
    links = links.withColumns({"tx": F.floor(x / TILE), "ty": F.floor(y / TILE)})
    s = ranked_in_blocks(links, ["img_id", "tx", "ty"], checkpoint, runs).withColumnRenamed("first", "chain")
    s = s.withColumns(dict(zip(("x", "y", "way"), place("id"), strict=True))).withColumns({"hx": ahead("x", DX), "hy": ahead("y", DY)})
    at = F.col("steps") - F.col("rest")
    corner = lambda k, x, y: F.struct(k.alias("ord"), F.col(x).alias("x"), F.col(y).alias("y"))
    corners = F.array_compact(F.array(corner(at, "x", "y"), F.when((F.col("rest") == 0) & ~F.col("closed"), corner(at + 1, "hx", "hy"))))
    return s.select("img_id", "chain", F.explode(corners).alias("c"), "left", "right", "closed").select("img_id", "chain", "c.ord", "c.x", "c.y", "left", "right", "closed")
