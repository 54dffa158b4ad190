"""Hard-negative mining with bounds along a spanning tree of the anchors.

Anchors are a stated query set; they meet all rows in blocks. Within a block they form a spanning tree
of least total distance. Where a row has the score s at a parent, its score at the child lies within
s plus or minus the edge's length times the row's norm (Cauchy-Schwarz), and such bounds add up along
the tree. A row is scored again at a child only if its bounds overlap the window of scores that the
child still looks for; windows shrink as better rows are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import on_grid, usable

#: Anchors of a block and rows that are scored together: what a task holds at once.
BLOCK, ROWS = 1024, 2048


class Tree:
    """Anchors as integers, in the order in which the tree reaches them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, grid: np.ndarray):
        x = grid.astype(float)
        n = len(x)
        norms = (x * x).sum(axis=1)
        order, parent, edge = np.zeros(n, int), np.zeros(n, int), np.zeros(n)
        # the nearest anchor of those reached joins next
        gap, by, out = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
        at = 0
        for k in range(n):
            order[k], out[at] = at, False
            parent[k], edge[k] = by[at], gap[at] if k else 0.0
            d = np.where(out, norms + norms[at] - 2 * (x @ x[at]), np.inf)
            closer = d < gap
            gap[closer], by[closer] = d[closer], k
            at = int(np.where(out, gap, np.inf).argmin())
        self.ids, self.labels, self.grid, self.parent = ids[order], labels[order], grid[order], parent
        steps = (self.grid - self.grid[parent]).astype(float)
        self.edge = np.sqrt((steps * steps).sum(axis=1))

    def scores(self, rows: np.ndarray, wanted):
        """For each anchor in order the rows that ``wanted(k)`` (mask, low, high) asks for and whose
        bounds overlap that window: (k, their places, their exact scores)."""
        dim = max(rows.shape[1], self.grid.shape[1])
        wide = lambda m: np.pad(m, ((0, 0), (0, dim - m.shape[1])))
        x, a = wide(rows), wide(self.grid)
        # sums of products are exact in doubles below 2 ** 53
        loose = 0.0 if dim * float(np.abs(x).max(initial=0)) * float(np.abs(a).max(initial=0)) < 2.0**53 else 1e-12
        if not loose:
            x, a = x.astype(float), a.astype(float)
        norm = np.sqrt((x.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
        children = np.bincount(self.parent[1:], minlength=len(a))
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in range(len(a)):
            if k == 0:
                middle, reach = (x @ a[0]).astype(float), np.zeros(len(x))
            else:
                p = int(self.parent[k])
                middle, reach = held[p]
                reach = reach + norm * (self.edge[k] * (1 + 1e-9)) + (1e-3 + loose * np.abs(middle))
                children[p] -= 1
                if children[p]:
                    middle = middle.copy()
                else:
                    del held[p]
            mask, low, high = wanted(k)
            at = np.flatnonzero(mask & (middle + reach >= low) & (middle - reach <= high))
            exact = (x[at] @ a[k]).astype(np.int64)
            middle[at], reach[at] = exact, 0.0
            if children[k]:
                held[k] = (middle, reach)
            if len(at):
                yield k, at, exact


def best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n by falling score, then rising id; rows of one id and score count once."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids) != 0) | (np.diff(scores) != 0)
    return ids[new][:n], scores[new][:n]


class Lists:
    """Running lists of the n best rows of each number."""

    def __init__(self, n: int):
        self.n, self.held = n, {}

    def worst(self, k, least: float) -> float:
        """The score that a row must reach to get in."""
        ids, scores = self.held.get(k, ((), ()))
        return max(least, scores[-1]) if len(ids) == self.n else least

    def add(self, k, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            had = self.held.get(k, (ids[:0], scores[:0]))
            self.held[k] = best(np.concatenate([had[0], ids]), np.concatenate([had[1], scores]), self.n)

    def rows(self) -> list[tuple]:
        return [(k, int(i), int(s)) for k, (ids, scores) in self.held.items() for i, s in zip(ids, scores, strict=True)]


def pieces(batches: Iterator[pa.RecordBatch], scale: int):
    for batch in batches:
        grid = on_grid(batch.column("vector"), scale)
        ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
        for a in range(0, len(ids), ROWS):
            yield ids[a : a + ROWS], labels[a : a + ROWS], grid[a : a + ROWS]


def positives(rows: DataFrame, tree: Tree, scale: int, n: int) -> DataFrame:
    """(anchor, id, score, rank): the n best other rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(n)
        for ids, labels, grid in pieces(batches, scale):
            wanted = lambda k: ((labels == tree.labels[k]) & (ids != tree.ids[k]), lists.worst(k, -np.inf), np.inf)  # noqa: B023, E731
            for k, at, scores in tree.scores(grid, wanted):
                lists.add(k, ids[at], scores)
        found = lists.rows()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["anchor", "id", "score"])

    return first_of(rows.mapInArrow(run, "anchor long, id long, score long"), ["anchor"], n)


def negatives(rows: DataFrame, tree: Tree, windows: list[list[tuple[int, int, int, int]]], scale: int, n: int) -> DataFrame:
    """(anchor, place, id, score, rank): the n best rows of other labels in each of an anchor's
    windows; ``windows`` has (place, positive, low, high) of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = Lists(n)
        for ids, labels, grid in pieces(batches, scale):

            def wanted(k: int):
                open_ = [(lists.worst((k, w[0]), w[2]), w[3]) for w in windows[k]]
                if not open_:
                    return np.zeros(len(labels), bool), np.inf, -np.inf  # noqa: B023
                return labels != tree.labels[k], min(w[0] for w in open_), max(w[1] for w in open_)  # noqa: B023

            for k, at, scores in tree.scores(grid, wanted):
                for place, _, low, high in windows[k]:
                    inside = (scores >= lists.worst((k, place), low)) & (scores <= high)
                    lists.add((k, place), ids[at[inside]], scores[inside])
        found = [(*key, i, s) for key, i, s in lists.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.int64()) for i in range(4)], names=["anchor", "place", "id", "score"])

    return first_of(rows.mapInArrow(run, "anchor long, place long, id long, score long"), ["anchor", "place"], n)


def first_of(found: DataFrame, key: list[str], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id"))
    return found.distinct().withColumn("rank", rank).where(F.col("rank") <= n)


def hard_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = 50,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors,
    the rows whose id is divisible by ``every``: for each of an anchor's first positives the first
    rows of other labels whose score is ``low`` to ``high`` hundredths of the positive's.

    Rows without id, label or a whole vector take no part. Shorter vectors count as filled with
    zeros. Anchors that repeat with label and vector count once; candidates of one id and score count
    once for an anchor; rows of the anchor's id are no others. A positive of negative score has no
    window. No anchors give an empty result; further columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    anchors = scratch.write(rows.where(F.col("vec_id") % every == 0).distinct(), "anchors")
    # blocks of three quarters of the size on average, so that none is much larger
    blocks = -(-anchors.count() * 4 // (3 * BLOCK))
    out = None
    for b in range(blocks):
        mine = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks)) == b).orderBy("vec_id", "label", "vector").collect()
        if not mine:
            continue
        grid = on_grid(pa.array([r["vector"] for r in mine], pa.list_(pa.float64())), scale)
        tree = Tree(np.array([r["vec_id"] for r in mine]), np.array([r["label"] for r in mine]), grid)
        windows: list[list[tuple[int, int, int, int]]] = [[] for _ in mine]
        chosen = positives(rows, tree, scale, n_positives).orderBy("anchor", "rank").collect()  # n_positives for each anchor of a block
        for place, r in enumerate(chosen):
            s = r["score"]
            windows[r["anchor"]].append((place, s, -(-low * s // 100), high * s // 100))
        names = pd.DataFrame({"place": range(len(chosen)), "anchor_id": [int(tree.ids[r["anchor"]]) for r in chosen], "positive_id": [r["id"] for r in chosen], "positive_score": [r["score"] for r in chosen]})
        named = spark.createDataFrame(names.astype("int64"), "place long, anchor_id long, positive_id long, positive_score long")
        found = negatives(rows, tree, windows, scale, n_negatives).join(F.broadcast(named), "place")
        made = scratch.write(
            found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), f"block{b}"
        )
        out = made if out is None else out.unionByName(made)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame([], empty) if out is None else out
