"""Graphs of strokes as edge tables: short spurs go, nodes that join two edges are dissolved, and nodes
that short links tie together become one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chains import _jumped, ranked_in_blocks
from .spatial import linked_ids

#: A spur is shorter than so many radii of its node and so much, unless its tip is as wide as that share of the radius.
SPUR_RADII, SPUR_MORE, TIP_SHARE = 1.5, 1.5, 0.75
#: A link is no longer than so many radii and so much.
LINK_RADII, LINK_MORE = 0.6, 1.0

EDGE = ["id", "a", "b", "len", "tip_a", "tip_b", "parts", "closed"]
EDGE_SQL = "id long, a long, b long, len double, tip_a double, tip_b double, parts long, closed boolean"


def _far_ends(n: int, a: np.ndarray, b: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Edges whose component has a node that is not ``inner``; nodes are numbers below n, -1 is none."""
    root = np.arange(n)
    p, q = a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]
    while (root[p] != root[q]).any():
        np.minimum.at(root, np.maximum(root[p], root[q]), np.minimum(root[p], root[q]))
        while (root[root] != root).any():
            root = root[root]
    far = np.zeros(n + 1, bool)
    far[root[~inner]] = True
    far[:n] = far[root]
    return far[a] | far[b]


def _round(e: dict[str, np.ndarray], r: np.ndarray) -> tuple[dict[str, np.ndarray], bool]:
    """A round of ``prune_spurs`` over edges by rising id, with nodes as numbers of their radius in ``r``
    (-1 and nan: none); whether it changed any."""
    node, free = np.maximum(e["a"], e["b"]), (e["a"] < 0) != (e["b"] < 0)
    wide, tip = np.append(r, np.nan)[node], np.nan_to_num(np.where(e["a"] < 0, e["tip_a"], e["tip_b"]))
    short = e["len"] < SPUR_RADII * wide + SPUR_MORE
    stub = (e["len"] > wide + 1) & (tip >= TIP_SHARE * wide)
    drop = free & ~e["closed"] & short & ~stub
    kept = {k: v[~drop] for k, v in e.items()}
    still, go = {k: v[kept["closed"]] for k, v in kept.items()}, {k: v[~kept["closed"]] for k, v in kept.items()}
    # dart 2 i leaves edge i through a, 2 i + 1 through b
    m = len(go["id"])
    at, dart = np.stack([go["a"], go["b"]], axis=1).reshape(-1), np.arange(2 * m)
    there = at >= 0
    degree, both = np.bincount(at[there], minlength=len(r)), np.bincount(at[there], weights=dart[there], minlength=len(r)).astype(np.int64)
    if not (degree == 2).any() and not ((degree == 1) & ~np.isnan(r)).any() and not drop.any():
        return e, False
    goes = there & (np.append(degree, 0)[at] == 2)
    to = np.where(goes, (np.append(both, 0)[at] - dart) ^ 1, dart)
    last, _, least = _jumped(to, dart)
    ring = goes[last]
    last, rest, _ = _jumped(np.where(ring & (to == least), dart, to), dart)
    steps, edge = np.zeros(2 * m, np.int64), np.full(2 * m, m)
    np.maximum.at(steps, last, rest)
    np.minimum.at(edge, last, dart // 2)
    first = np.zeros(2 * m, np.int64)
    begins = rest == steps[last]
    first[last[begins]] = dart[begins]
    ends = np.unique(last)
    # of the two directions of a run the one that starts at the smaller dart
    ends = ends[np.lexsort((first[ends], edge[ends]))]
    ends = ends[np.append(True, np.diff(edge[ends]) > 0)] if m else ends
    tips = np.stack([go["tip_a"], go["tip_b"]], axis=1).reshape(-1)
    total = lambda k: np.bincount(last, weights=go[k][dart // 2], minlength=2 * m)[ends]
    one = {"id": go["id"][edge[ends]], "len": total("len"), "parts": total("parts").astype(np.int64), "closed": ring[ends]}
    for c, d in (("a", first[ends] ^ 1), ("b", ends)):
        place = np.where(one["closed"], -1, at[d])
        gone = (place >= 0) & (np.append(degree, 0)[place] == 1) & ~np.isnan(np.append(r, np.nan)[place])
        one[c], one[f"tip_{c}"] = np.where(gone, -1, place), np.where(gone, np.append(r, np.nan)[place], tips[d])
    out = {k: np.concatenate([one[k], still[k]]) for k in e}
    order = np.argsort(out["id"], kind="stable")
    return {k: v[order] for k, v in out.items()}, True


def _block_pruned(tab: pa.Table) -> pa.Table:
    """The edges of a block (rows without ``node``), pruned to their end where their component meets
    this block's own nodes (rows (node, r)) alone, and as they are where it does not."""
    own = tab.filter(tab.column("node").is_valid())
    rows = tab.filter(tab.column("node").is_null()).sort_by("id")
    named = lambda c: rows.column(c).combine_chunks()
    ends = {c: named(c) for c in ("a", "b")}
    nodes = np.unique(np.concatenate([own.column("node").to_numpy(), *[x.drop_null().to_numpy() for x in ends.values()]]))
    inner, r = np.zeros(len(nodes), bool), np.full(len(nodes), np.nan)
    mine = np.searchsorted(nodes, own.column("node").to_numpy())
    inner[mine], r[mine] = True, own.column("r").to_numpy()
    number = lambda x: np.where(x.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(nodes, x.fill_null(0).to_numpy()), -1)
    e = {c: number(x) for c, x in ends.items()}
    e |= {c: named(c).to_numpy(zero_copy_only=False).astype(t) for c, t in (("id", np.int64), ("len", float), ("tip_a", float), ("tip_b", float), ("parts", np.int64), ("closed", bool))}
    far = _far_ends(len(nodes), e["a"], e["b"], inner)
    away, e = {k: v[far] for k, v in e.items()}, {k: v[~far] for k, v in e.items()}
    rounds, changed = 0, True
    while changed:
        e, changed = _round(e, r)
        rounds += changed
    n = [len(e["id"]), len(away["id"])]
    both = {k: np.concatenate([e[k], away[k]]) for k in EDGE}
    column = lambda k, v: pa.array(np.append(nodes, 0)[v], pa.int64(), mask=v < 0) if k in "ab" else pa.array(v, mask=np.isnan(v)) if k.startswith("tip") else pa.array(v)
    return pa.table({k: column(k, v) for k, v in both.items()} | {"rounds": np.repeat([rounds, -1], n)})


def prune_spurs(nodes: DataFrame, edges: DataFrame, checkpoint, most_rounds: int = 100, block: int = 1 << 20) -> DataFrame:
    """Edges (id, a, b, len, tip_a, tip_b, parts, closed) that are left.

    ``nodes``: (id, r). ``edges``: (id, a, b, len, tip_a, tip_b); a null node is a free end, where the
    tip has the stroke's own radius. A round drops all free-ending edges that are shorter than their
    node's radius allows, but for those that reach past the node and are still wide at the tip. Then
    nodes with one edge become its free end, as wide as they were, and runs of edges through nodes
    with two become one edge, by list ranking: it has the least number, the sum of the lengths and the
    count of its parts. A run that comes back to itself is closed. Rounds go on until nothing changes.

    ``block``: edges whose numbers lie in one stretch of so many are one group, where components that
    meet no other stretch are pruned to their end at once. Only the others go through rounds over all."""
    number = lambda c, kind: F.col(c).cast(kind).alias(c)
    now = edges.select("id", number("a", "long"), number("b", "long"), number("len", "double"), number("tip_a", "double"), number("tip_b", "double"), F.lit(1).cast("long").alias("parts"), F.lit(False).alias("closed"))
    radius = nodes.select(F.col("id").cast("long").alias("node"), F.col("r").cast("double").alias("r"))
    now = now.withColumn("block", F.floor(F.col("id") / block))
    ends = now.select("block", F.explode(F.array("a", "b")).alias("node")).where("node is not null")
    own = ends.groupBy("node").agg(F.min("block").alias("block"), F.max("block").alias("other")).where("block = other").join(radius, "node", "left")
    rows = now.unionByName(own.select("block", "node", "r"), allowMissingColumns=True)
    dealt = checkpoint(rows.groupBy("block").applyInArrow(_block_pruned, EDGE_SQL + ", rounds long"))
    most, left = dealt.agg(F.max("rounds"), F.count_if(F.col("rounds") < 0)).first()
    most, done = max(most or 0, 0), dealt.where("rounds >= 0")
    if not left:
        return _turned(done, F.lit(most) - F.col("rounds"))
    far, rounds = _pruned_in_rounds(radius, dealt.where("rounds < 0").select(EDGE), checkpoint, most_rounds, block)
    most = max(most, rounds)
    return _turned(done, F.lit(most) - F.col("rounds")).unionByName(_turned(far, F.lit(most - rounds)))


def _turned(edges: DataFrame, times) -> DataFrame:
    """A round lets each edge that is not closed run the other way, those that it does not change too:
    edges that took no part in so many rounds are turned as often."""
    odd = (times % 2 == 1) & ~F.col("closed")
    turn = lambda p, q: F.when(odd, F.col(q)).otherwise(F.col(p)).alias(p)
    return edges.select("id", turn("a", "b"), turn("b", "a"), "len", turn("tip_a", "tip_b"), turn("tip_b", "tip_a"), "parts", "closed")


def _pruned_in_rounds(radius: DataFrame, now: DataFrame, checkpoint, most_rounds: int, block: int) -> tuple[DataFrame, int]:
    """``prune_spurs`` of components that lie in several blocks, and the rounds that joined edges."""
    for count in range(most_rounds):
        # the end that is free, and the node at the other
        free = F.col("a").isNull() != F.col("b").isNull()
        e = now.withColumns({"node": F.when(free & ~F.col("closed"), F.coalesce("a", "b")), "tip": F.coalesce(F.when(F.col("a").isNull(), F.col("tip_a")).otherwise(F.col("tip_b")), F.lit(0.0))}).join(radius, "node", "left")
        short = F.col("len") < SPUR_RADII * F.col("r") + SPUR_MORE
        stub = (F.col("len") > F.col("r") + 1) & (F.col("tip") >= TIP_SHARE * F.col("r"))
        kept = checkpoint(e.where(~F.coalesce(short & ~stub, F.lit(False))).select(EDGE))
        side = lambda c: F.struct((F.col("id") * 2 + int(c == "b")).alias("dart"), F.col(c).alias("node"))
        ends = checkpoint(kept.where("not closed").select(F.explode(F.array(side("a"), side("b"))).alias("e")).select("e.*").where("node is not null"))
        degree = ends.groupBy("node").agg(F.count("*").alias("degree"), F.sum("dart").alias("both")).where("degree <= 2")
        few = checkpoint(degree)
        if few.isEmpty() and kept.count() == now.count():
            return kept, count
        # dart 2 id leaves the edge through a, 2 id + 1 through b; through a node of two edges it goes on
        # into the other edge, and so to that edge's far end
        two = ends.join(few.where("degree = 2"), "node")
        into = F.col("both") - F.col("dart")
        follow = two.select(F.col("dart").alias("id"), (into + 1 - 2 * (into % 2)).cast("long").alias("next"))
        darts = kept.where("not closed").select(F.explode(F.array(F.col("id") * 2, F.col("id") * 2 + 1)).alias("id"))
        r = ranked_in_blocks(darts.join(follow, "id", "left").withColumn("block", F.floor(F.col("id") / (2 * block))), ["block"], checkpoint)
        part = r.withColumn("edge", F.floor(F.col("id") / 2)).join(kept.drop("closed").withColumnRenamed("id", "edge"), "edge")
        # a run is found in both directions: from its last dart the far end is known, from its first the near one
        out = lambda c: F.when(F.col("id") % 2 == 0, F.col(f"{c}a")).otherwise(F.col(f"{c}b"))
        back = lambda c: F.when(F.col("id") % 2 == 0, F.col(f"{c}b")).otherwise(F.col(f"{c}a"))
        last, first = F.col("rest") == 0, F.max(F.struct("rest", back("").alias("node"), back("tip_").alias("tip"), F.col("id")))
        runs = part.groupBy("last").agg(
            F.min("edge").alias("id"), F.sum("len").alias("len"), F.sum("parts").alias("parts"), F.max("closed").alias("closed"), first.alias("first"),
            F.max(F.when(last, out(""))).alias("b"), F.max(F.when(last, out("tip_"))).alias("tip_b"),
        )
        whole = F.struct("first.id", *[F.when(~F.col("closed"), c).alias(n) for n, c in (("a", F.col("first.node")), ("b", F.col("b")))], F.col("first.tip").alias("tip_a"), "tip_b", "len", "parts", "closed")
        # of the two directions the one that starts at the smaller dart counts
        one = runs.groupBy("id").agg(F.min(whole).alias("w")).select(F.col("id").alias("edge"), "w.*").drop("id").withColumnRenamed("edge", "id")
        gone = few.where("degree = 1").select("node").join(radius, "node")
        for c in ("a", "b"):
            one = one.join(gone.select(F.col("node").alias(c), F.col("r").alias(f"r_{c}")), c, "left")
        end = lambda c: [F.when(F.col(f"r_{c}").isNull(), F.col(c)).alias(c), F.coalesce(f"r_{c}", f"tip_{c}").alias(f"tip_{c}")]
        joined = one.select("id", *end("a"), *end("b"), "len", "parts", "closed").select(EDGE)
        now = checkpoint(joined.unionByName(kept.where("closed")))
    raise RuntimeError(f"edges still change after {most_rounds} rounds")


def contract_links(nodes: DataFrame, edges: DataFrame, checkpoint, most_rounds: int = 100, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, cluster, r) of nodes (id, r), and the edges (id, a, b, len) that are left between clusters.

    An edge between two nodes is a link if it is no longer than 0.6 of the larger radius and 1; its
    nodes become one, with the largest radius of theirs, which may make links of further edges. All
    links of a round are followed at once: a radius never falls, so the end does not depend on their
    order. The least node names a cluster; links go, other edges within a cluster stay.

    ``block``: nodes whose numbers lie in one stretch of so many are tied together (``spatial.linked_ids``)."""
    held = checkpoint(nodes.select(F.col("id").cast("long").alias("id"), F.col("id").cast("long").alias("cluster"), F.col("r").cast("double").alias("r")))
    count = -1
    for _ in range(most_rounds):
        at = lambda c: held.select(F.col("id").alias(c), F.col("cluster").alias(f"c{c}"), F.col("r").alias(f"r{c}"))  # noqa: E731, B023
        e = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
        link = F.coalesce((F.col("a") != F.col("b")) & (F.col("len") <= LINK_RADII * F.greatest("ra", "rb") + LINK_MORE), F.lit(False))
        e = checkpoint(e.select("id", "a", "b", "ca", "cb", "len", link.alias("link")))
        found = e.agg(F.count_if("link")).first()[0]
        if found == count:
            return held, e.where("not link").select("id", F.col("ca").alias("a"), F.col("cb").alias("b"), "len")
        count = found
        tied = linked_ids(e.where("link").select(F.col("a").alias("id"), F.col("b").alias("oid")), nodes.select(F.col("id").cast("long").alias("id")), checkpoint, block=block)
        both = tied.join(nodes.select(F.col("id").cast("long").alias("id"), F.col("r").cast("double").alias("r")), "id")
        widest = both.groupBy("cluster").agg(F.max("r").alias("r"))
        held = checkpoint(tied.join(widest, "cluster").select("id", "cluster", "r"))
    raise RuntimeError(f"links are still found after {most_rounds} rounds")
