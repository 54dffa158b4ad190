"""One-to-one matching of values on a line, stretch by stretch."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left, insort
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spatial import mutual_best, within_gap

#: Rows of a group in one stretch, about, at the start.
TOGETHER = 50_000


def _rounded(d: float, places: int) -> float:
    """Half up on the shortest decimals, as Spark rounds."""
    x = d * 10**places
    if abs(x - math.floor(x) - 0.5) < 1e-4:
        return float(Decimal(repr(d)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))
    return math.floor(x + 0.5) / 10**places


class _Runs:
    """Others in runs of equal value, each run in the order of its keys. What goes is the first of its run;
    runs without any left are stepped over."""

    def __init__(self, value: np.ndarray, key: np.ndarray):
        order = np.lexsort((key, value))
        self.key, sorted_values = key[order].tolist(), value[order]
        first = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(order) else np.zeros(0, int)
        self.values = sorted_values[first]
        self.value = self.values.tolist()
        self.head, self.end = first.tolist(), [*first[1:].tolist(), len(order)][: len(first)]
        # run k stands at place k + 1, between two ends that are never empty
        self.up, self.down = list(range(len(first) + 2)), list(range(len(first) + 2))

    @staticmethod
    def _found(links: list[int], k: int) -> int:
        end = k
        while links[end] != end:
            end = links[end]
        while links[k] != end:
            links[k], k = end, links[k]
        return end

    def above(self, run: int) -> int:
        """The first run from this one on that holds some; their number if none does."""
        return self._found(self.up, run + 1) - 1

    def below(self, run: int) -> int:
        return self._found(self.down, run + 1) - 1

    def drop_head(self, run: int) -> None:
        self.head[run] += 1
        if self.head[run] == self.end[run]:
            self.up[run + 1], self.down[run + 1] = run + 2, run


def matched_stretch(ids: np.ndarray, a: np.ndarray, oids: np.ndarray, b: np.ndarray, low: float, high: float, gap: float, places: int):
    """Of one stretch of a line the pairs that a greedy matching of the whole line has for certain, whatever
    lies outside ``low`` and ``high``: (pairs, left, others left), as places in ``ids`` and ``oids``.

    Pairs come by (rounded gap, id, oid). One is certain if no smaller pair of either side can be among
    those taken: none with a place outside, and none with a row that is itself left undecided, which from
    then on counts as a border like the ends of the stretch."""
    order = np.lexsort((oids, b))
    runs = _Runs(b, oids)
    at = np.searchsorted(runs.values, a).tolist()
    n_runs, slack = len(runs.value), 0.6 * 10.0**-places
    ids_, a_, b_ = ids.tolist(), a.tolist(), b[order].tolist()

    def best(k: int):
        v, found = a_[k], None
        sides = []
        up, down = runs.above(at[k]), runs.below(at[k] - 1)
        for run, step in ((up, 1), (down, -1)):
            if 0 <= run < n_runs and abs(v - runs.value[run]) <= gap:
                sides.append((_rounded(abs(v - runs.value[run]), places), run, step))
        if not sides:
            return None
        least = min(s[0] for s in sides)
        for g, run, step in sides:
            # values apart may come to one rounded gap
            while g == least:
                oid = runs.key[runs.head[run]]
                if found is None or oid < found[0]:
                    found = (oid, run)
                run = runs.above(run + 1) if step == 1 else runs.below(run - 1)
                if not (0 <= run < n_runs and abs(v - runs.value[run]) <= gap):
                    break
                g = _rounded(abs(v - runs.value[run]), places)
        return least, ids_[k], found[0], k, found[1], runs.head[found[1]]

    def away(borders: list[float], v: float) -> float:
        k = bisect_left(borders, v)
        return min(borders[k] - v if k < len(borders) else math.inf, v - borders[k - 1] if k else math.inf)

    own_border, other_border = [low, high], [low, high]
    heap = [h for h in map(best, range(len(a_))) if h is not None]
    heapq.heapify(heap)
    settled, gone, pairs = bytearray(len(a_)), bytearray(len(b_)), []
    while heap:
        g, _, _, k, run, place = heapq.heappop(heap)
        if not gone[place]:
            own_sure = g + slack < away(other_border, a_[k])
            if own_sure and g + slack < away(own_border, b_[place]):
                gone[place] = settled[k] = 1
                runs.drop_head(run)
                pairs.append((k, place))
                continue
            if not own_sure:
                insort(own_border, a_[k])
                continue
            gone[place] = 2
            runs.drop_head(run)
            insort(other_border, b_[place])
        again = best(k)
        if again is not None:
            heapq.heappush(heap, again)
    left = [k for k in range(len(a_)) if not settled[k] and away(other_border, a_[k]) <= gap + slack]
    # others that no row left and none outside can reach are done
    reach = np.sort(np.r_[low, high, a[left]])
    free = np.flatnonzero(np.frombuffer(gone, np.uint8) != 1)
    v = b[order][free]
    k = np.searchsorted(reach, v)
    near = np.minimum(reach[np.minimum(k, len(reach) - 1)] - v, v - reach[np.maximum(k - 1, 0)])
    near = np.where(k == len(reach), v - reach[-1], np.where(k == 0, reach[0] - v, near))
    p = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    return (p[:, 0], order[p[:, 1]]), np.array(left, dtype=np.int64), order[free[near <= gap + slack]]


def _stretches(from_: float, step: float, last: int, gap: float, places: int):
    """``matched_stretch`` for the stretches from ``from_`` on, each ``step`` wide: rows with both sides are pairs."""

    def run(tab: pa.Table) -> pa.Table:
        key, v, own = (tab.column(c).to_numpy() for c in ("key", "v", "own"))
        k = tab.column("stretch")[0].as_py()
        # ends are drawn in by more than their rounding; nothing lies beyond the first and the last
        slack = 1e-9 * max(1.0, abs(from_) + step * (abs(k) + 1))
        ends = (-math.inf if k <= 0 else from_ + k * step + slack, math.inf if k >= last else from_ + (k + 1) * step - slack)
        ids, a, oids, b = key[own], v[own], key[~own], v[~own]
        (p, q), rest, others = matched_stretch(ids, a, oids, b, *ends, gap, places)
        column = lambda t, *parts: pa.chunked_array([pa.nulls(x, t) if isinstance(x, int) else pa.array(x, t) for x in parts], t)
        i, f = pa.int64(), pa.float64()
        return pa.table(
            {
                "g": pa.chunked_array([pa.repeat(tab.column("g")[0], len(p) + len(rest) + len(others))]),
                "id": column(i, ids[p], ids[rest], len(others)),
                "a": column(f, a[p], a[rest], len(others)),
                "oid": column(i, oids[q], len(rest), oids[others]),
                "b": column(f, b[q], len(rest), b[others]),
            }
        )

    return run


def matched_on_line(left: DataFrame, right: DataFrame, group: str, a: str, b: str, gap: float, checkpoint, places: int = 2, together: int = TOGETHER) -> DataFrame:
    """(id, oid, gap): greedy one-to-one matching of left (id, group, a) with right (oid, group, b) by
    ascending rounded gap, ties by ids, of pairs of a group no farther apart than ``gap``. No pairs are
    formed: a group's line is cut into stretches of about ``together`` rows, each settles what is certain
    whatever lies outside, and only rows near its ends or near undecided ones go on to stretches twice as
    wide with other ends. Rows with a null or without a finite value match none."""
    side = lambda df, key, v, own: df.select(F.col(group).alias("g"), F.col(key).cast("long").alias("key"), F.col(v).cast("double").alias("v"), F.lit(own).alias("own"))
    rows = side(left, "id", a, True).unionByName(side(right, "oid", b, False)).where("g is not null and key is not null and abs(v) < double('Infinity')").distinct()
    rows, kind = checkpoint(rows), rows.schema["g"].dataType.simpleString()
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not rows.groupBy("own", "key").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # a key at several places ties them together
        r = rows.withColumnRenamed("g", group)
        pairs = within_gap(r.where("own").select(F.col("key").alias("id"), group, F.col("v").alias(a)), r.where("not own").select(F.col("key").alias("oid"), group, F.col("v").alias(b)), group, a, b, gap)
        return mutual_best(pairs.groupBy("id", "oid").agg(F.min(F.round(F.abs(F.col(a) - F.col(b)), places)).alias("gap")), checkpoint)
    lines = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    low, high, width = lines.agg(F.min("low"), F.max("high"), F.min((F.col("high") - F.col("low")) / F.ceil(F.col("n") / together))).first()
    if low is None:
        return rows.select(F.col("key").alias("id"), F.col("key").alias("oid"), F.col("v").alias("gap"))
    # stretches narrower than what their ends leave undecided would settle nothing
    width, shift, done = max(width, 4 * gap, (high - low) * 1e-9), 0.0, None
    while True:
        last = math.floor((high - low + shift) / width)
        stretch = F.floor((F.col("v") - F.lit(low - shift)) / F.lit(width)).alias("stretch")
        # as many tasks as a shuffle has, however few bytes its rows are
        dealt = rows.select("g", "key", "v", "own", stretch).repartition(parts, "g", "stretch")
        found = checkpoint(dealt.groupBy("g", "stretch").applyInArrow(_stretches(low - shift, width, last, gap, places), f"g {kind}, id long, a double, oid long, b double"))
        pairs = found.where("id is not null and oid is not null").select("id", "oid", F.round(F.abs(F.col("a") - F.col("b")), places).alias("gap"))
        done = pairs if done is None else done.unionByName(pairs)
        if last == 0 or found.where("oid is null").isEmpty():
            return done
        mine = found.where("oid is null").select("g", F.col("id").alias("key"), F.col("a").alias("v"), F.lit(True).alias("own"))
        rows = mine.unionByName(found.where("id is null").select("g", F.col("oid").alias("key"), F.col("b").alias("v"), F.lit(False).alias("own")))
        width *= 2
        shift = 0.0 if width > high - low else 0.382 * width
