"""N-gram Jaccard join with Bayesian pruning.

Texts with the same shingles are one class of copies, known by a hash. Classes that share a band of
MinHash values are candidates. Candidates' MinHash values are compared a chunk at a time; a pair is
dropped as soon as the posterior probability that its similarity reaches the threshold falls below
a tolerance; the rest are verified exactly on their shingles.

No step makes a row for each pair. A band's group yields a forest of the pairs that survive; the
groups that these forests tie together are verified whole, in blocks of bounded size, and yield the
number of links of each class and a forest of verified links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import Scratch, giving_back, keyed, partitions
from .components import components


@dataclass(frozen=True)
class Join:
    """bands * rows MinHash values; at similarity s a pair shares a band with probability
    1 - (1 - s**rows)**bands, which is 0.9999 at 0.8 and nearer 1 above it."""

    words: int = 5
    threshold: float = 0.8
    bands: int = 30
    rows: int = 6
    chunk: int = 30
    tolerance: float = 1e-6
    #: Members of a band's group, and of a verified group, that are compared in one block.
    band_block: int = 4096
    block: int = 512

    @property
    def size(self) -> int:
        return self.bands * self.rows


@cache
def least_matches(how: Join) -> tuple[tuple[int, int], ...]:
    """(compared, matches needed): with fewer, the posterior of reaching the threshold, from a
    uniform prior, is below the tolerance. It is the chance of at most so many successes in one
    more trial than were compared."""
    out = []
    for n in range(how.chunk, how.size + 1, how.chunk):
        t, total = how.threshold, 0.0
        for m in range(n + 2):
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= how.tolerance:
                break
        out.append((n, m))
    return tuple(out)


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, all of a shorter text; none without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    start = np.arange(len(words) - n + 1)
    return W.Spans(words, W.BASE).hash(start, start + n)


def signatures(docs: DataFrame, how: Join) -> DataFrame:
    """(doc_id, th, c, sig): c stands for the set of shingles; null for texts without words."""
    a = multipliers(how.size)
    unit = W.WORDS
    fields = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("c", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(2))
            found = []
            classes: list[int | None] = []
            for i in range(batch.num_rows):
                own = np.unique(shingles(unit.cut(data[offsets[i] : offsets[i + 1]])[0], how.words))
                classes.append(int((W.mix(own * W.BASE2).sum(dtype=np.uint64) ^ np.uint64(len(own))).view(np.int64)) if len(own) else None)
                if len(own):
                    found.append(own)
            sigs = np.zeros((len(found), how.size), np.uint32)
            for at in range(0, len(found), 128):
                part = found[at : at + 128]
                h = (np.concatenate(part) >> np.uint64(32)).astype(np.uint32)
                starts = np.cumsum([0, *map(len, part[:-1])])
                for k in range(how.size):
                    sigs[at : at + 128, k] = np.minimum.reduceat(h * a[k], starts)
            rows = iter(sigs)
            packed = [None if c is None else next(rows).tobytes() for c in classes]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(classes, pa.int64()), pa.array(packed, pa.binary())], schema=fields)

    return docs.select("doc_id", "th", "text").mapInArrow(giving_back(run), "doc_id long, th long, c long, sig binary")


def sig_matrix(column: pa.Array, how: Join) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, how.size)


def pack_by(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    return W.as_batch([(int(bucket[part[0]]), 0, W.pack(**{k: v[part] for k, v in columns.items()})) for part in parts])


def bands(sigs: DataFrame, how: Join, n: int) -> DataFrame:
    """Hashes of each class's bands, in packed rows by bucket of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            m = sig_matrix(batch.column(1), how)[first].reshape(len(c), how.bands, how.rows).astype(np.uint64)
            h = np.broadcast_to(np.arange(how.bands, dtype=np.uint64) * W.BASE, m.shape[:2]).copy()
            for k in range(how.rows):
                h = W.mix((h ^ m[:, :, k]) * W.BASE2 + W.BASE)
            h, c = h.reshape(-1), np.repeat(c, how.bands)
            yield pack_by((h >> np.uint64(33)).astype(np.int64) % n, h=h, c=c)

    return sigs.where("c is not null").select("c", "sig").mapInArrow(giving_back(run), W.OUT_SQL)


def memberships(rows: DataFrame, how: Join, n: int) -> DataFrame:
    """Classes that share a band with others, by bucket of the class. A large group is dealt into
    parts; each pair of parts is a group of its own, so no task holds all of it."""

    def run(tab: pa.Table) -> pa.Table:
        parts = [W.unpack(b) for b in tab.column("blob").to_pylist()]
        h, c = (np.concatenate([p[k] for p in parts]) for k in ("h", "c"))
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        new = W.edges_of(h, c)
        h, c = h[new], c[new]
        starts = np.flatnonzero(W.edges_of(h))
        count = np.diff(np.append(starts, len(h)))
        size = np.repeat(count, count)
        keep = size > 1
        rank = (np.arange(len(h)) - np.repeat(starts, count))[keep]
        h, c, size = h[keep], c[keep], size[keep]
        blocks = -(-size // how.band_block)
        own = rank // how.band_block
        index = np.repeat(np.arange(len(h)), blocks)
        other = W.expand(np.zeros(len(h), np.int64), blocks)
        low, high = np.minimum(own[index], other), np.maximum(own[index], other)
        group = W.mix(h[index] + (low * 65_536 + high).astype(np.uint64) * W.BASE)
        side = (own[index] == high).astype(np.uint8) + (low == high).astype(np.uint8)
        c = c[index]
        return pa.Table.from_batches([pack_by(c % n, h=group, c=c, side=side)])

    return rows.groupBy("bucket").applyInArrow(run, W.OUT_SQL)


def with_signatures(classes: DataFrame, members: DataFrame, how: Join, n: int) -> DataFrame:
    """Members of band groups with 16 bits of each MinHash value, by bucket of the group."""

    def run(sigs: pa.Table, blobs: pa.Table) -> pa.Table:
        if not sigs.num_rows or not blobs.num_rows:
            return pa.Table.from_batches([W.as_batch([])])
        sigs = sigs.combine_chunks()
        c = sigs.column("c").to_numpy()
        order = np.argsort(c)
        matrix = sig_matrix(sigs.column("sig").chunk(0), how).astype(np.uint16)[order]
        parts = [W.unpack(b) for b in blobs.column("blob").to_pylist()]
        h, mine, side = (np.concatenate([p[k] for p in parts]) for k in ("h", "c", "side"))
        at = np.searchsorted(c[order], mine)
        bucket = (h >> np.uint64(33)).astype(np.int64) % n
        sig = np.ascontiguousarray(matrix[at]).view(f"V{2 * how.size}").reshape(-1)
        return pa.Table.from_batches([pack_by(bucket, h=h, c=mine, side=side, sig=sig)])

    left = classes.select("c", "sig", F.pmod("c", F.lit(n)).cast("int").alias("bucket"))
    return left.groupBy("bucket").cogroup(members.groupBy("bucket")).applyInArrow(run, W.OUT_SQL)


def survivors(one: np.ndarray, others: np.ndarray, how: Join) -> np.ndarray:
    """Rows of ``others`` whose posterior never falls below the tolerance."""
    left, matches = np.arange(len(others)), np.zeros(len(others), np.int64)
    for n, least in least_matches(how):
        cols = slice(n - how.chunk, n)
        matches += np.count_nonzero(others[left, cols] == one[cols], axis=1)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
        if not len(left):
            break
    return left


def forest(c: np.ndarray, sig: np.ndarray, side: np.ndarray, how: Join) -> list[tuple[int, int]]:
    """Edges of a forest over the pairs of a group that survive. side 2: all pairs of the group;
    0 and 1: pairs of one with the other. Pairs that are tied already need no comparison."""
    label, edges = np.arange(len(c)), []
    for i in range(len(c) - 1):
        rest = np.arange(i + 1, len(c))
        rest = rest[(label[rest] != label[i]) & ((side[i] == 2) | (side[rest] != side[i]))]
        if not len(rest):
            continue
        for j in rest[survivors(sig[i], sig[rest], how)]:
            if label[j] != label[i]:
                edges.append((int(c[i]), int(c[j])))
                label[label == label[j]] = label[i]
    return edges


def candidate_edges(groups: DataFrame, how: Join) -> DataFrame:
    def run(tab: pa.Table) -> pa.Table:
        parts = [W.unpack(b) for b in tab.column("blob").to_pylist()]
        h, c, side, sig = (np.concatenate([p[k] for p in parts]) for k in ("h", "c", "side", "sig"))
        sig = np.ascontiguousarray(sig).view(np.uint16).reshape(-1, how.size)
        order = np.lexsort((c, h))
        starts = np.flatnonzero(W.edges_of(h[order]))
        edges: set[tuple[int, int]] = set()
        for rows in np.split(order, starts[1:]):
            edges.update(forest(c[rows], sig[rows], side[rows], how))
        u, v = zip(*sorted(edges), strict=True) if edges else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return groups.groupBy("bucket").applyInArrow(run, "u long, v long")


class Postings:
    """Which of some sets hold each shingle. Built over parts of bounded size."""

    def __init__(self, sets: list[np.ndarray], most: int = 1 << 22):
        sizes = np.array([len(x) for x in sets], dtype=np.int64)
        part = np.cumsum(sizes) // most
        self.parts = []
        for rows in np.split(np.arange(len(sets)), np.flatnonzero(np.diff(part)) + 1):
            values = np.concatenate([sets[j] for j in rows])
            order = np.argsort(values, kind="stable")
            self.parts.append((values[order], np.repeat(np.arange(len(rows), dtype=np.int32), sizes[rows])[order], len(rows)))

    def common(self, own: np.ndarray) -> np.ndarray:
        """How many shingles each set has in common with ``own``."""
        out = []
        for values, owner, n in self.parts:
            low, high = (np.searchsorted(values, own, side=side) for side in ("left", "right"))
            out.append(np.bincount(owner[W.expand(low, high - low)], minlength=n))
        return np.concatenate(out)


def verify(sets: list[np.ndarray], sig: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray | None, how: Join):
    """Links of the pairs of ``left`` with ``right``, or of all pairs of ``left``: (texts, documents)
    linked to each, and a forest of links. A set's common shingles with all others are counted at
    once, from the lists of its own."""
    texts, rows = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
    label, edges = np.arange(len(sets)), []
    others = left if right is None else right
    if len(left) < 1 + (right is None) or not len(others):
        return texts, rows, edges
    size = np.array([len(x) for x in sets])
    postings = Postings([sets[j] for j in others])
    for k, i in enumerate(left):
        rest = np.arange(k + 1 if right is None else 0, len(others))
        rest = rest[survivors(sig[i], sig[others[rest]], how)]
        if not len(rest):
            continue
        both, to = postings.common(sets[i])[rest], others[rest]
        to = to[both >= how.threshold * (size[i] + size[to] - both) - 1e-9]
        texts[i] += len(to)
        texts[to] += 1
        rows[i] += weight[to].sum()
        rows[to] += weight[i]
        for j in to[label[to] != label[i]]:
            if label[j] != label[i]:
                edges.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return texts, rows, edges


def verified_links(members: DataFrame, how: Join, n: int) -> DataFrame:
    """``members``: (component, parts, c, weight, text) of candidate classes. Rows (c, v, texts, rows):
    links of c, or with v an edge of the forest of links."""
    unit = W.WORDS
    a = multipliers(how.size)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.text_bytes(batch.column(1))
            blobs = []
            for i in range(batch.num_rows):
                own = np.unique(shingles(unit.cut(data[offsets[i] : offsets[i + 1]])[0], how.words))
                blobs.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3, 4, 5)), pa.array(blobs, pa.binary())], names=["component", "c", "weight", "part", "parts", "set"])

    def run(tab: pa.Table) -> pa.Table:
        get = {k: tab.column(k).to_numpy() for k in ("component", "c", "weight", "part", "low", "high")}
        order = np.lexsort((get["c"], get["high"], get["low"], get["component"]))
        raw = tab.column("set")
        out: list[tuple[int, int | None, int, int]] = []
        starts = np.flatnonzero(W.edges_of(*(get[k][order] for k in ("component", "low", "high"))))
        for rows in np.split(order, starts[1:]):
            sets = [np.frombuffer(raw[int(r)].as_py(), np.uint64) for r in rows]
            sig = np.empty((len(sets), how.size), np.uint16)
            h = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
            begin = np.cumsum([0, *map(len, sets[:-1])])
            for k in range(how.size):
                sig[:, k] = np.minimum.reduceat(h * a[k], begin)
            c, weight, part = (get[k][rows] for k in ("c", "weight", "part"))
            low, high = get["low"][rows[0]], get["high"][rows[0]]
            left = np.flatnonzero(part == low)
            right = None if low == high else np.flatnonzero(part == high)
            texts, docs, edges = verify(sets, sig, weight, left, right, how)
            out += [(int(c[i]), None, int(texts[i]), int(docs[i])) for i in np.flatnonzero(texts)]
            out += [(int(c[i]), int(c[j]), 0, 0) for i, j in edges]
        cols = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table({k: pa.array(x, pa.int64()) for k, x in zip(("c", "v", "texts", "rows"), cols, strict=True)})

    part = F.pmod(F.xxhash64("c"), F.col("parts"))
    rows = members.select("component", "text", "c", "weight", part.alias("part"), "parts")
    rows = rows.mapInArrow(giving_back(prepare), "component long, c long, weight long, part long, parts long, set binary")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    bucket = F.pmod(F.xxhash64("component", "low", "high"), F.lit(n)).cast("int")
    rows = rows.select("component", "c", "weight", "part", "low", "high", "set", bucket.alias("bucket"))
    return rows.groupBy("bucket").applyInArrow(run, "c long, v long, texts long, rows long")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Join = Join()) -> DataFrame:  # noqa: B008
    """One row per row of ``docs``: doc_id, th, class_id, n_links, n_text_links, copy_of, leads.

    Two documents are linked if the Jaccard similarity of their sets of shingles of ``how.words``
    words is at least ``how.threshold``; a text of fewer words is one shingle. class_id is the least
    doc_id among all that links tie together, n_links the number of other rows linked to the row,
    copies included, n_text_links the number of different sets of shingles linked, copy_of the least
    doc_id with the same shingles, and leads tells the document of each class that may stay for all.
    th is a hash of id and text, which with the id tells rows apart.

    Words are runs of characters other than ASCII white space, unchanged. Null and empty texts have
    no shingles: each is a class of its own without links. Repeated rows are copies of each other; a
    null id is never a class's name while the class has another. An empty table gives an empty
    result. Further columns are not read.
    """
    spark = docs.sparkSession
    rows, n = keyed(docs, id_col, text_col), 2 * partitions(spark)
    scratch = Scratch(spark, "jaccard-join")
    sigs = scratch.write(signatures(rows, how), "signatures")
    # one row of each class: its least document, and how many rows it has
    lead = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th")))
    any_lead = F.min(F.struct("doc_id", "th"))
    classes = scratch.write(
        sigs.where("c is not null").groupBy("c").agg(F.coalesce(lead, any_lead).alias("lead"), F.count("*").alias("weight")), "classes"
    )
    members = scratch.write(memberships(bands(sigs, how, n), how, n), "members")
    # candidates' signatures: of copies the one that leads
    firsts = classes.select("c", F.col("lead.doc_id").alias("doc_id"), F.col("lead.th").alias("th"))
    same = (sigs["c"] == firsts["c"]) & sigs["doc_id"].eqNullSafe(firsts["doc_id"]) & (sigs["th"] == firsts["th"])
    one_each = sigs.join(firsts, same, "left_semi").dropDuplicates(["c"])
    edges = candidate_edges(with_signatures(one_each, members, how, n), how)
    groups = components(scratch.write(edges, "edges"), scratch, "candidates")
    # members are dealt into parts by their hash; each pair of parts is verified on its own
    parts = groups.groupBy("component").agg(F.ceil(F.count("*") / how.block).cast("long").alias("parts"))
    active = groups.join(parts, "component").withColumnRenamed("node", "c").join(classes, "c")
    active = active.select("component", "c", "parts", "weight", F.col("lead.doc_id").alias("lead_id"), F.col("lead.th").alias("lead_th"))
    texts = rows.join(active, rows["doc_id"].eqNullSafe(active["lead_id"]) & (rows["th"] == active["lead_th"])).dropDuplicates(["c"])
    links = scratch.write(verified_links(texts, how, n), "links")
    tied = components(links.where("v is not null").select(F.col("c").alias("u"), "v"), scratch, "classes-tied")
    counts = links.where("v is null").groupBy("c").agg(F.sum("texts").alias("texts"), F.sum("rows").alias("rows"))
    named = classes.join(tied, classes["c"] == tied["node"], "left").select(
        "c", "weight", "lead", F.coalesce("component", "c").alias("component")
    )
    names = named.groupBy("component").agg(
        F.coalesce(F.min(F.when(F.col("lead.doc_id").isNotNull(), F.col("lead"))), F.min("lead")).alias("first")
    )
    per_class = scratch.write(
        named.join(names, "component")
        .join(counts, "c", "left")
        .select(
            "c",
            F.col("first.doc_id").alias("class_id"),
            F.col("first.th").alias("class_th"),
            F.col("lead.doc_id").alias("copy_of"),
            (F.col("weight") - 1 + F.coalesce("rows", F.lit(0))).alias("n_links"),
            F.coalesce("texts", F.lit(0)).cast("long").alias("n_text_links"),
        ),
        "per-class",
    )
    scratch.keep_only("signatures", "per-class")
    out = sigs.select("doc_id", "th", "c").join(per_class, "c", "left")
    leads = F.col("c").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th")))
    return out.select(
        "doc_id",
        "th",
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"),
        leads.alias("leads"),
    )
