"""Vector code compression by memoised grid cells.

Each vector is cut into parts, and each part becomes the number of its nearest codebook entry. Which
entries can be nearest depends on where the part lies: space is cut into coarse cells, and a cell's
list holds the entries whose least distance from its box is no more than the least of all largest
distances. Lists are kept by the cell's hash, so a cell seen again costs a look-up; only the entries
of the list are measured exactly. Lists hold for one codebook; a memo holds a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .vectors import on_grid, usable

PARTS, ENTRIES, MEMO = 8, 16, 200_000
#: Label sums go to every task where they are no more than this; a shuffle joins them otherwise.
MOST_LABELS = 100_000


class Cells:
    """The memo of one part's codebook: cell -> a bit for each entry that may be nearest in it."""

    def __init__(self, entries: np.ndarray, width: int):
        self.entries, self.width = entries, width
        self.whole = np.uint64((1 << len(entries)) - 1)
        self.keys, self.bits = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def lists(self, low: np.ndarray) -> np.ndarray:
        """Bits of the entries that another does not keep from being nearest anywhere in the box that
        starts at ``low``."""
        high = low + (self.width - 1)
        least, most = [], []
        for e in self.entries:
            least.append((np.maximum(np.maximum(low - e, e - high), 0) ** 2).sum(axis=1))
            most.append((np.maximum(np.abs(e - low), np.abs(high - e)) ** 2).sum(axis=1))
        open_ = np.stack(least) <= np.stack(most).min(axis=0)
        return (open_.astype(np.uint64) << np.arange(len(self.entries), dtype=np.uint64)[:, None]).sum(axis=0, dtype=np.uint64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        cell = x // self.width
        inside = (np.abs(cell) < 1 << 20).all(axis=1)
        out = np.full(len(x), self.whole)
        if not inside.any():
            return out
        key = np.zeros(int(inside.sum()), np.uint64)
        for column in cell[inside].T:
            key = (key ^ (column.astype(np.uint64) & np.uint64(0xFFFFFF))) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        seen, first, at = np.unique(key, return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, seen)
        known = np.zeros(len(seen), bool)
        near = place < len(self.keys)
        known[near] = self.keys[place[near]] == seen[near]
        bits = np.empty(len(seen), np.uint64)
        bits[known] = self.bits[place[known]]
        fresh = cell[inside][first[~known]]
        bits[~known] = self.lists(fresh * self.width)
        if len(self.keys) + len(fresh) > MEMO:
            self.keys, self.bits, place, known = self.keys[:0], self.bits[:0], np.zeros_like(place), np.zeros_like(known)
        self.keys = np.insert(self.keys, place[~known], seen[~known])
        self.bits = np.insert(self.bits, place[~known], bits[~known])
        out[inside] = bits[at]
        return out


class Codebooks:
    """``entries``: integers by part, entry and place within the part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        # two cells or so across a codebook: coarse enough to be seen again
        spread = [int(np.ptp(e, axis=0).max(initial=0)) if len(e) else 0 for e in entries]
        self.cells = [Cells(e, 1 << max(0, (s // 2).bit_length())) for e, s in zip(entries, spread, strict=True)]

    def nearest(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the lowest of several, and its squared distance."""
        bits = self.cells[part](x)
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
        for j, entry in enumerate(self.entries[part]):
            rows = np.flatnonzero(bits >> np.uint64(j) & np.uint64(1))
            d = ((x[rows] - entry) ** 2).sum(axis=1)
            closer = d < best[rows]
            best[rows[closer]], at[rows[closer]] = d[closer], j
        return at, best

    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def fitted(vectors: DataFrame, dim: int, start: np.ndarray, scale: int, rounds: int) -> Codebooks:
    """Each round assigns every part and replaces the entries by the floors of the means of theirs."""
    width, books = dim // PARTS, Codebooks(start)
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
            shape = books.entries.shape
            total = np.zeros((shape[0], shape[1], width + 1), np.int64)
            for batch in batches:
                x = on_grid(batch.column("vector"), scale, dim)
                for p in range(PARTS):
                    part = x[:, p * width : (p + 1) * width]
                    at, _ = books.nearest(p, part)
                    for j in np.unique(at):
                        total[p, j, :width] += part[at == j].sum(axis=0)
                        total[p, j, width] += (at == j).sum()
            place = np.flatnonzero(total.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.reshape(-1)[place])], names=["place", "s"])

        # a row for each part, entry and place at most
        found = vectors.select("vector").mapInArrow(sums, "place long, s long").groupBy("place").agg(F.sum("s").alias("s")).collect()
        total = np.zeros((*books.entries.shape[:2], width + 1), np.int64)
        for r in found:
            total.reshape(-1)[r["place"]] = r["s"]
        n = total[:, :, width:]
        books = Codebooks(np.where(n > 0, total[:, :, :width] // np.maximum(n, 1), books.entries))
    return books


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096, rounds: int = 6) -> DataFrame:
    """One row per kept row of ``vectors``: vec_id, code, error, label_error, codebooks_sha256.

    Rows go whose vector is null or has null or non-finite components. Repeated rows stay, null ids
    too, but these start no entry; of one id with several vectors the least starts one. With fewer
    than 16 ids the codebooks have fewer entries; with none all ids are null, and the least vector
    starts the only one. All vectors are filled with zeros up to the longest, and on to a multiple of
    8. An empty table gives an empty result; further columns are not read.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector")))
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    dim = -(-longest // PARTS) * PARTS
    ids = [r[0] for r in kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    first = kept.where(F.col("vec_id").isin(ids) if ids else F.lit(True)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").limit(ENTRIES).collect()
    start = on_grid(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), scale, dim)
    start = np.ascontiguousarray(start.reshape(len(first), PARTS, dim // PARTS).transpose(1, 0, 2))
    books = fitted(kept, dim, start, scale, rounds) if len(first) else Codebooks(start)
    width = dim // PARTS

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = on_grid(batch.column("vector"), scale, dim)
            code, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p in range(PARTS):
                at, d = books.nearest(p, x[:, p * width : (p + 1) * width])
                code[:, p] = at
                error += d
            text = pa.array([c.tobytes().hex() for c in code])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = kept.schema["label"].dataType.simpleString()
    coded = Scratch(spark, "vector-codes").write(kept.mapInArrow(codes, f"vec_id long, label {kind}, code string, error long"), "codes")
    key = F.when(F.col("label").isNull(), "-").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    coded = coded.withColumn("key", key)
    sums = coded.groupBy("key").agg(F.sum("error").alias("label_error"))
    if sums.count() <= MOST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, "key").select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
