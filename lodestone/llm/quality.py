"""Quality classifier: random Fourier features of document statistics, ridge, isotonic calibration.

The statistics are computed over whole texts. Each partition sums its share of the normal equations;
the sums are added in rounds of few at a time before the driver solves one small system. Scores become probabilities
through a step function that never falls.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

CLASSES = np.full(256, 7, np.int64)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 0, 1, 2
CLASSES[[32, 9, 10, 11, 12, 13]] = 3
CLASSES[[ord(c) for c in ".,;:?'\"-()"]] = 4
CLASSES[[ord(c) for c in "!|#$%&*@^~=+_<>/\\[]{}`"]] = 5
CLASSES[128:] = 6
STATS = 22
#: Sums of partitions that are added at once, and that the driver may get: each is half a megabyte.
FAN = 16


def statistics(text: str) -> list[float]:
    """Shares of kinds of bytes, and sizes and repetition of words and lines. Empty texts have zeros."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(len(raw), 1)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(CLASSES, weights=counts, minlength=8) / n
    words = text.split()
    m = max(len(words), 1)
    lines = text.split("\n")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    letters = max(kinds[0] + kinds[1], 1e-9)
    p = counts[counts > 0] / n
    ends = sum(map(str.isalnum, map(str.__getitem__, words, [-1] * len(words)))) if words else 0
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        *kinds,
        kinds[1] / letters,
        sizes.mean(),
        sizes.std(),
        len(set(words)) / m,
        sum(map(eq, words[1:], words)) / m,
        ends / m,
        np.log1p(len(lines)),
        len(set(lines)) / len(lines),
        len(words) / len(lines) / 50,
        float((sizes == 1).sum() / m),
        float(sizes.max() / 20),
        float(-(p * np.log2(p)).sum()),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Fourier:
    """cos(w x + b) over standardised statistics; w is normal, so products of features approximate
    a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -5, 5)
        out = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.concatenate([out, np.ones((len(x), 1))], axis=1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def isotonic(x: np.ndarray, total: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean place, level) of blocks of rising levels."""
    blocks: list[list[float]] = []
    for a, t, w in zip(x, total, weight, strict=True):
        blocks.append([a * w, t, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], top, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def label_table(labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, y, held_out) of labelled documents: rows without id or label tell nothing; of
    several labels of one document the mean counts, one half as 1."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
    y = (F.avg(label_col) >= 0.5).cast("double").alias("y")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(y)


def held_out(doc_id):
    """True for one document in five, which nothing is learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


class QualityModel:
    def __init__(self, features: int = 256, width: float = 4.0, ridge: float = 1e-3, seed: int = 7, bin_width: float = 1e-3):
        self.features, self.width, self.ridge, self.seed, self.bin_width = features, width, ridge, seed, bin_width

    def fit(self, stats: DataFrame, labelled: DataFrame) -> QualityModel:
        """``stats`` as ``document_statistics`` gives it; ``labelled`` (doc_id, y)."""
        place = [F.avg(F.col("x")[i]) for i in range(STATS)] + [F.stddev_pop(F.col("x")[i]) for i in range(STATS)]
        row = [v or 0.0 for v in stats.agg(*place).first()]
        self.map = Fourier(np.array(row[:STATS]), np.array(row[STATS:]), self.features, self.width, self.seed)
        rows = stats.join(labelled, "doc_id").select("x", "y")
        feature_map, size = self.map, self.features + 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, n = np.zeros((size, size + 1)), 0
            for batch in batches:
                if batch.num_rows:
                    z, y = feature_map(matrix(batch.column(0))), batch.column(1).to_numpy()
                    a[:, :size] += z.T @ z
                    a[:, size] += z.T @ y
                    n += len(y)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([a.tobytes()], pa.binary())], names=["n", "a"])

        def add(tab: pa.Table) -> pa.Table:
            total = reduce(np.add, (np.frombuffer(x.as_py()) for x in tab.column("a")))
            part = tab.column("part")[0].as_py() // FAN
            return pa.table({"part": pa.array([part]), "n": pa.array([sum(tab.column("n").to_pylist())]), "a": pa.array([total.tobytes()])})

        parts = rows.mapInArrow(sums, "n long, a binary").select(F.spark_partition_id().cast("long").alias("part"), "n", "a")
        scratch, k = Scratch(stats.sparkSession, "quality-sums"), 0
        parts = scratch.write(parts, "0")
        while parts.count() > FAN:
            k += 1
            by = F.floor(F.col("part") / FAN).alias("by")
            parts = scratch.write(parts.groupBy(by).applyInArrow(add, "part long, n long, a binary"), str(k))
        found = parts.collect()
        n = sum(r["n"] for r in found)
        self.weights, self.steps = np.zeros(size), (np.array([0.0]), np.array([0.5]))
        if not n:
            return self  # nothing to learn from: every score is one half
        a = sum(np.frombuffer(bytes(r["a"])) for r in found).reshape(size, size + 1)
        penalty = np.full(size, self.ridge * n)
        penalty[-1] = 1e-9 * n
        self.weights = np.linalg.solve(a[:, :size] + np.diag(penalty), a[:, size])
        # a bin for each thousandth of the raw score between -1 and 2: at most 3001 rows come back
        binned = F.round(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col("raw"))) / self.bin_width)
        bins = (
            self.raw(stats.join(labelled, "doc_id").select("doc_id", "x", "y"), "y")
            .groupBy(binned.alias("bin"))
            .agg(F.sum("y").alias("total"), F.count("*").alias("weight"))
            .orderBy("bin")
            .collect()
        )
        cols = np.array([(r["bin"] * self.bin_width, r["total"], r["weight"]) for r in bins])
        self.steps = isotonic(cols[:, 0], cols[:, 1], cols[:, 2])
        return self

    def raw(self, stats: DataFrame, *more: str) -> DataFrame:
        feature_map, weights = self.map, self.weights

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(feature_map(np.stack(x.to_numpy())) @ weights) if len(x) else pd.Series([], dtype=float)

        return stats.select("doc_id", *more, score("x").alias("raw"))

    def score(self, stats: DataFrame) -> DataFrame:
        at, level = self.steps

        @F.pandas_udf("double")
        def calibrated(raw: pd.Series) -> pd.Series:
            return pd.Series(np.clip(np.interp(raw.to_numpy(), at, level), 0, 1))

        return self.raw(stats).select("doc_id", calibrated("raw").alias("score"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learned from the labelled documents that are not held out. Null and empty texts have statistics
    of their own (zeros) and a score like any other; repeated rows and null ids stay; with no labels
    every score is one half; an empty table gives an empty result. Further columns are not read.
    """
    stats = Scratch(docs.sparkSession, "quality").write(document_statistics(docs, id_col, text_col), "stats")
    labelled = label_table(labels, "quality").where(~held_out(F.col("doc_id")))
    out = QualityModel().fit(stats, labelled).score(stats)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
