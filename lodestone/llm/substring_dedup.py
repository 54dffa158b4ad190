"""Substring dedup by a log-structured fingerprint index.

The index is a table of immutable runs, all dealt into the same buckets. A run has one blob of window
fingerprints for each bucket, in their order; a batch of documents adds one. A new batch is
merge-joined with all runs bucket by bucket, which leaves the runs where they lie and touches only
what both sides share; each match is verified on the words of both places; runs are merged into one
when there are more than ``max_runs``.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows as W
from .common import Scratch, buckets, keyed, partitions, remove, shared_dir


def merged_runs(tab: pa.Table) -> pa.Table:
    """The blobs of one bucket merged, two at a time, by where the rows of one stand among those of
    the other. Of equal contents the earlier run's place comes first; all stay, as each was verified
    on its own."""

    def merged(a: dict, b: dict) -> dict:
        at = np.searchsorted(a["fp"], b["fp"], side="right") + np.arange(len(b["fp"]))
        own = np.ones(len(a["fp"]) + len(b["fp"]), dtype=bool)
        own[at] = False
        out = {}
        for k in W.RUN:
            out[k] = np.empty(len(own), a[k].dtype)
            out[k][own], out[k][at] = a[k], b[k]
        return out

    order = np.argsort(tab.column("run").to_numpy(), kind="stable")
    blobs = tab.column("blob")
    whole = reduce(merged, (W.open_docs(blobs[int(i)].as_py()) for i in order))
    out = W.as_batch([(tab.column("bucket")[0].as_py(), W.HISTORY, W.with_docs(**whole))])
    return pa.Table.from_batches([out])


class FingerprintIndex:
    """Sorted immutable runs of the fingerprints of all documents that were added, and where their
    texts can be read. The table is bucketed as its joins need it, so history is never shuffled."""

    def __init__(self, spark: SparkSession, path: str | None = None, n: int | None = None, max_runs: int = 4, unit: W.Unit = W.WORDS):
        self.spark, self.unit, self.max_runs = spark, unit, max_runs
        self.path = path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex[:12]}"
        self.n, self.parts = n or 2 * partitions(spark), partitions(spark)
        self.runs, self.compactions = 0, 0
        self.table: str | None = None
        self.texts: list[DataFrame] = []

    def history(self) -> DataFrame | None:
        return self.spark.table(self.table) if self.table else None

    def _write(self, rows: DataFrame, run: int, new: bool) -> None:
        if new:
            self.table = f"fingerprints_{uuid.uuid4().hex}"
        out = rows.select("bucket", "kind", "blob", F.lit(run).alias("run")).write.format("parquet").option("compression", "none")
        out.option("path", f"{self.path}/{self.table}").bucketBy(self.parts, "bucket").mode("append").saveAsTable(self.table)

    def add(self, docs: DataFrame, scratch: Scratch, name: str) -> DataFrame:
        """Merge-joins a batch (as ``keyed`` gives it) with the runs and adds its own. Returns what
        is settled, paired or open, by bucket of the document."""
        found = scratch.write(W.match(W.cut(docs, self.unit, self.n), self.unit, self.n, self.history(), keep_runs=True), name)
        self._write(W.of_kind(found, W.HISTORY), self.runs, self.table is None)
        self.texts.append(docs)
        self.runs += 1
        if self.runs > self.max_runs:
            self.compact()
        return found

    def compact(self) -> None:
        """All runs become one. The old ones go only when the new one is complete."""
        old = self.table
        self._write(self.history().groupBy("bucket").applyInArrow(merged_runs, W.OUT_SQL), 0, True)
        self.runs, self.compactions = 1, self.compactions + 1
        self._drop(old)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{self.path}/{name}")

    def drop(self) -> None:
        """All runs go; what ``add`` returned stands on its own."""
        if self.table:
            self._drop(self.table)
        self.runs, self.table, self.texts = 0, None, []


def verified(found: DataFrame, texts: DataFrame, unit: W.Unit, n: int) -> DataFrame:
    """Settled windows of what is open or paired. The windows of open runs meet by hash; each place
    but the first is then paired with the one before it, and the words of all pairs are compared."""
    windows = W.together(texts, W.of_kind(found, W.OPEN), n, W.fetch_windows(unit, n), W.OUT_SQL)
    more = windows.groupBy("bucket").applyInArrow(W.pair_windows(n), W.OUT_SQL)
    pairs = W.of_kind(found, W.PAIR).unionByName(more)
    words = W.together(texts, W.stretches(pairs, n), n, W.fetch_tokens(unit), W.OUT_SQL)
    return words.groupBy("bucket").applyInArrow(W.equal_stretches(n), W.OUT_SQL)


def batches_of(docs: DataFrame, parts: int) -> list[DataFrame]:
    """Batches of about equal size in the order of doc_id; null ids are in the first."""
    if parts < 2:
        return [docs]
    cuts = docs.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.01)
    cuts = sorted({int(c) for c in cuts})
    low = [None, *cuts]
    high = [*cuts, None]
    out = []
    for a, b in zip(low, high, strict=True):
        keep = F.lit(True) if a is None else F.col("doc_id") > a
        if b is not None:
            keep = keep & ((F.col("doc_id") <= b) | (F.col("doc_id").isNull() if a is None else F.lit(False)))
        out.append(docs.where(keep))
    return out


def substring_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 20,
    batches: int = 4,
    max_runs: int = 2,
    index: FingerprintIndex | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept (UTF-8 bytes).

    Words are runs of characters other than space, tab, line feed, vertical tab, form feed and
    carriage return. A word goes if a window of ``window`` words that covers it also starts earlier:
    in a document with a smaller id, or earlier in the same one; windows are judged on the input.
    Candidates meet by hashes and count only once their words are found equal.

    Null and empty texts have no words. Null ids sort before all others. Rows with the same id and
    text are one document and get the same result each; rows with one id and different texts are
    ordered by a hash of the text. An empty table gives an empty result. Further columns are not
    read. With an ``index`` that has runs, those count as earlier; their texts are read again from
    the tables that were added, and need not be in ``docs``.
    """
    spark = docs.sparkSession
    unit = W.Unit(window=window, gram=min(8, window), words=True, within=True)
    rows = keyed(docs, id_col, text_col)
    passing = index is None
    if passing:
        index = FingerprintIndex(spark, n=buckets(docs), max_runs=max_runs, unit=unit)
    n, texts = index.n, reduce(DataFrame.unionByName, index.texts, rows)
    scratch = Scratch(spark, "substring-dedup")
    found = reduce(DataFrame.unionByName, [index.add(b, scratch, f"batch{i}") for i, b in enumerate(batches_of(rows, batches))])
    if passing:
        index.drop()
    spans = W.of_kind(found, W.SETTLED).unionByName(verified(found, texts, unit, n))
    out = W.together(rows, spans, n, W.apply(unit), W.APPLIED)
    return out.select("doc_id", F.col("size").alias("n_words"), F.col("removed").alias("n_removed"), "kept")
