"""Repeated windows over whole texts, exactly, without a row for each window.

A window is W consecutive tokens (words or bytes) of one document. Each window has an anchor: the
k-gram in it with the least hash, the rightmost if several have it. Neighbouring windows mostly
share their anchor, so a text falls apart into runs of windows with one anchor. Equal windows have
equal anchors, so all that can match meets under the anchor's fingerprint:

1. ``cut``: each document becomes runs (fingerprint, hash of the run's content, place). What repeats
   within a block of texts is settled there, which is the map-side combine of a hot passage.
2. ``match``: per bucket of fingerprints, a run whose whole content has an earlier place is paired
   with one. Runs that share a fingerprint with other contents are open: only part of their windows
   may match.
3. ``stretches``: pairs that follow each other in both documents become one; the texts of both sides
   are then brought together and held against each other by the operator.
4. ``apply``: settled windows meet their text.

Runs travel as packed blobs, one for each block and bucket, so Spark shuffles few large rows. An
anchor brings one run for each block and content at most; where many documents share a passage in
different contexts its edges have as many contents, whose runs (some 33 bytes each, without the
windows) still meet in one bucket of ``match``.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
#: Stands for a null id in arrays; it sorts before all others.
NULL_ID = np.iinfo(np.int64).min
BASE, BASE2, MIX = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93), U64(0xBF58476D1CE4E5B9)
#: Tokens that are cut at once: the arrays stay in the processor's cache.
BLOCK = 1 << 18
#: Windows whose runs are settled and handed on at once: bounds what a task holds, whatever the batch.
EMIT = 1 << 21
#: Windows of a stretch that is fetched as one piece.
LONGEST = 1 << 14
PLACE = U64((1 << 24) - 1)


def pack(**arrays: np.ndarray) -> bytes:
    """Columns as byte planes, compressed: the high bytes of small numbers vanish."""
    planes = {
        k: (a.dtype.str, np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b"")
        for k, a in ((k, np.ascontiguousarray(a)) for k, a in arrays.items())
    }
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes, protocol=5))


def unpack(blob: bytes) -> dict[str, np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return {
        k: np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(d).itemsize, -1).T).reshape(-1).view(d)
        for k, (d, raw) in planes.items()
    }


def stack(blobs: list[bytes], names: tuple[str, ...]) -> dict[str, np.ndarray] | None:
    parts = [unpack(b) for b in blobs]
    return {k: np.concatenate([p[k] for p in parts]) for k in names} if parts else None


def powers(base: U64, n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and its inverse modulo 2**64 for i < n."""
    have = cache.get(int(base))
    if have is None or len(have[0]) < n:
        inverse = U64(pow(int(base), -1, 1 << 64))
        size = max(n, BLOCK + 4096)
        have = cache[int(base)] = tuple(
            np.cumprod(np.concatenate([np.ones(1, U64), np.full(size - 1, b, U64)]), dtype=U64) for b in (base, inverse)
        )
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(32))
    x *= MIX
    return x ^ (x >> U64(29))


class Spans:
    """Hashes of spans of a token array from one prefix sum."""

    def __init__(self, tokens: np.ndarray, base: U64):
        self.up, self.down = powers(base, len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, U64)
        np.cumsum(tokens * self.up[: len(tokens)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


@dataclass(frozen=True)
class Unit:
    """What a token is. ``cut`` gives (hashes, starts, ends) of a text's tokens, as bytes places."""

    window: int
    gram: int
    words: bool
    #: True: a window is repeated if an earlier place has it, in the same document too. False: if a
    #: document with a smaller id has it.
    within: bool
    #: Open passages of one fingerprint that are brought together at once; more are dealt in parts.
    part: int = 4096

    def cut(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        if not self.words:
            return BYTE_TOKENS[data], None, None
        start, end = word_places(data)
        if not len(start):
            return np.zeros(0, U64), start, end
        spans = Spans(BYTE_TOKENS[data], BASE2)
        return spans.hash(start, end) + BASE * (end - start).astype(U64), start, end


BYTE_TOKENS = mix(mix(np.arange(1, 257, dtype=U64) * BASE) + BASE2)
#: Fixed value: the white space between words.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

WORDS = Unit(window=20, gram=8, words=True, within=True)
BYTES = Unit(window=50, gram=24, words=False, within=False)


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~BLANK[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the offsets of its rows, without a copy. It has no nulls."""
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def ids_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(NULL_ID).to_numpy(zero_copy_only=False) if column.null_count else column.to_numpy()


def runs_of(tokens: np.ndarray, piece: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(fingerprint, content hash, start, windows) of each run. ``piece``: offsets of documents."""
    w, k = unit.window, unit.gram
    span = w - k + 1
    if len(tokens) < w:
        return (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 2
    gram, width = tokens, 1
    while 2 * width <= k:
        gram = gram[:-width] * BASE2 + gram[width:]
        width *= 2
    if width < k:
        gram = gram[: width - k] * BASE2 + gram[k - width :]
    gram = mix(gram)
    least = (gram & ~PLACE) | (PLACE - np.arange(len(gram), dtype=U64))
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: width - span], least[span - width :])
    anchor = PLACE - (least & PLACE)
    lengths = np.diff(piece)
    long = lengths >= w
    first, after = piece[:-1][long], piece[1:][long] - w + 1
    if not len(first):
        return (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 2
    inside = np.zeros(len(anchor) + 1, dtype=np.int8)
    inside[first] += 1
    inside[after] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[first] = True
    start = np.flatnonzero(new & inside)
    end = np.minimum(np.append(start[1:], len(anchor)), after[np.searchsorted(first, start, side="right") - 1])
    n = end - start
    content = Spans(tokens, BASE).hash(start, end + w - 1)
    return mix(gram[anchor[start].astype(np.int64)] * BASE + BASE2), content, start, n


def cut_docs(batch: pa.RecordBatch, unit: Unit) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of (row, fingerprint, content, start, windows), rows in the order of (doc_id, th)."""
    ids, ths = ids_of(batch.column(0)), batch.column(1).to_numpy()
    data, offsets = text_bytes(batch.column(2))
    order = np.lexsort((ths, ids))
    same = np.zeros(len(order), dtype=bool)
    same[1:] = (ids[order][1:] == ids[order][:-1]) & (ths[order][1:] == ths[order][:-1])
    rows, tokens, shift, held = [], [], [], 0

    def flush():
        piece = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        fp, content, start, n = runs_of(np.concatenate(tokens), piece, unit)
        at = np.searchsorted(piece, start, side="right") - 1
        out = np.array(rows)[at], fp, content, start - piece[at] + np.array(shift)[at], n
        rows.clear(), tokens.clear(), shift.clear()
        return out

    for row in order[~same]:
        part, _, _ = unit.cut(data[offsets[row] : offsets[row + 1]])
        for begin in range(0, max(len(part) - unit.window + 1, 0), BLOCK):
            piece = part[begin : begin + BLOCK + unit.window - 1]
            rows.append(row), tokens.append(piece), shift.append(begin)
            held += len(piece)
            if held >= BLOCK:
                yield flush()
                held = 0
    if tokens:
        yield flush()


RUN = ("fp", "content", "start", "n", "doc", "th")
OUT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
OUT_SQL = "bucket int, kind int, blob binary"
#: Kinds of blobs.
RUNS, SETTLED, OPEN, HISTORY, PAIR = 0, 1, 2, 3, 4


def with_docs(doc: np.ndarray, th: np.ndarray, **more: np.ndarray) -> bytes:
    """Rows in the order of documents: each document is held once with its number of rows."""
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(doc))).astype(np.uint32)
    return pack(doc=doc[at], th=th[at], count=count, **more)


def open_docs(blob: bytes) -> dict[str, np.ndarray]:
    x = unpack(blob)
    count = x.pop("count")
    return x | {"doc": np.repeat(x["doc"], count), "th": np.repeat(x["th"], count)}


def stacked(blobs: list[bytes]) -> dict[str, np.ndarray] | None:
    parts = [open_docs(b) for b in blobs]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else None


def by_bucket(bucket: np.ndarray, kind: int, **columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = {k: v[order] for k, v in columns.items()}
    edges = np.flatnonzero(np.diff(bucket)) + 1
    return [
        (int(bucket[a]), kind, with_docs(**{k: v[a:b] for k, v in columns.items()}))
        for a, b in zip([0, *edges], [*edges, len(bucket)], strict=True)
        if b > a
    ]


#: What ``match`` gives: a row for each bucket that it has something for, with a blob of each kind.
MATCHED = {SETTLED: "settled", OPEN: "opened", PAIR: "paired", HISTORY: "history"}
MATCHED_SQL = "bucket int, " + ", ".join(f"{name} binary" for name in MATCHED.values())


def as_matched(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    by: dict[int, dict[int, bytes]] = {}
    for bucket, kind, blob in rows:
        by.setdefault(bucket, {})[kind] = blob
    columns = {name: pa.array([x.get(kind) for x in by.values()], pa.binary()) for kind, name in MATCHED.items()}
    return pa.table({"bucket": pa.array(by, pa.int32())} | columns)


def of_kind(matched: DataFrame, kind: int) -> DataFrame:
    """The blobs of one kind, as rows of their own."""
    blob = F.col(MATCHED[kind])
    return matched.where(blob.isNotNull()).select("bucket", F.lit(kind).alias("kind"), blob.alias("blob"))


def as_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, k, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], schema=OUT)


def blocks_of(batch: pa.RecordBatch, unit: Unit) -> Iterator[list[np.ndarray]]:
    """Joined blocks of ``cut_docs`` of about ``EMIT`` windows."""
    held, size = [], 0
    for block in cut_docs(batch, unit):
        held.append(block)
        size += int(block[4].sum())
        if size >= EMIT:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def equal_pairs(batch: pa.RecordBatch, unit: Unit, row: np.ndarray, start: np.ndarray, n: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Whether the tokens of the runs ``after`` are those of ``before``, token by token. Runs that
    follow each other in both texts are compared as one."""
    x = {"doc": row[after], "start": start[after], "n": n[after], "pdoc": row[before], "pstart": start[before]}
    order, lead, size = follow(x | {"th": x["doc"], "pth": x["pdoc"]})
    data, offsets = text_bytes(batch.column(2))
    texts: dict[int, tuple] = {}

    def tokens(i: int, a: int, k: int) -> bytes:
        if i not in texts:
            text = data[offsets[i] : offsets[i + 1]]
            texts[i] = (text, *(word_places(text) if unit.words else (None, None)))
        return token_bytes(*texts[i], a, k + unit.window - 1)

    same = [
        tokens(int(x["doc"][i]), int(x["start"][i]), int(k)) == tokens(int(x["pdoc"][i]), int(x["pstart"][i]), int(k))
        for i, k in zip(order[lead], size, strict=True)
    ]
    out = np.zeros(len(order), dtype=bool)
    out[order] = np.repeat(same, np.diff(np.append(lead, len(order))))
    return out


def token_bytes(text: np.ndarray, start: np.ndarray | None, end: np.ndarray | None, a: int, k: int) -> bytes:
    """``k`` tokens from the ``a``-th, words with one space between."""
    if start is None:
        return text[a : a + k].tobytes()
    at = start[a]
    return join_words(text[at : end[a + k - 1]], start[a : a + k] - at, end[a : a + k] - at)


def follow(x: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, leads in it, windows) of pairs of runs, where those that follow each other without a
    gap in both documents are one stretch."""
    shift = x["start"].astype(np.int64) - x["pstart"].astype(np.int64)
    order = np.lexsort((x["n"], x["start"], shift, x["pth"], x["pdoc"], x["th"], x["doc"]))
    start = x["start"][order].astype(np.int64)
    end = start + x["n"][order]
    new = edges_of(*(x[k][order] for k in ("doc", "th", "pdoc", "pth")), shift[order])
    new[1:] |= start[1:] > end[:-1]
    lead = np.flatnonzero(new)
    return order, lead, (np.maximum.reduceat(end, lead) - start[lead]) if len(lead) else end


def cut(docs: DataFrame, unit: Unit, n: int) -> DataFrame:
    """Runs by bucket of the fingerprint; runs settled within a block go by bucket of the document,
    so a hot passage does not fill the bucket of its anchors. Where windows may repeat within a
    document, a run is settled if its tokens are those of an earlier one of the block; else, if two
    documents of the block with smaller ids have its content, which stand for it from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, fp, content, start, windows in blocks_of(batch, unit):
                doc, th = ids_of(batch.column(0))[row], batch.column(1).to_numpy()[row]
                columns = {"doc": doc, "th": th, "start": start.astype(np.uint32), "n": windows.astype(np.uint32)}
                key = fp * BASE ^ content
                order = np.argsort(key, kind="stable")
                new = edges_of(key[order])
                group = np.cumsum(new) - 1
                later = np.zeros(len(order), dtype=bool)
                if unit.within:
                    after = np.flatnonzero(~new)
                    if len(after):
                        good = equal_pairs(batch, unit, row, start, windows, order[after], order[after - 1])
                        later[order[after[good]]] = True
                else:
                    second = second_docs(doc[order], group, np.flatnonzero(new))
                    later[order] = doc[order] > second[group]
                out = by_bucket(
                    (fp[~later] >> U64(32)).astype(np.int64) % n,
                    RUNS,
                    **{k: v[~later] for k, v in columns.items()},
                    fp=fp[~later].astype(np.uint32),
                    content=content[~later],
                )
                if later.any():
                    out += by_bucket(th[later] % n, SETTLED, **{k: v[later] for k, v in columns.items()})
                yield as_batch(out)

    return docs.select("doc_id", "th", "text").mapInArrow(run, OUT_SQL)


def second_docs(doc: np.ndarray, group: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """For each group the least id above the least one; the largest number if there is none. Ids
    stand in order within a group."""
    none = np.iinfo(np.int64).max
    return np.minimum.reduceat(np.where(doc > doc[leads][group], doc, none), leads) if len(doc) else doc


def edges_of(*keys: np.ndarray) -> np.ndarray:
    """Where any of the keys differs from the row before."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def parts_of(key: np.ndarray, most: int) -> np.ndarray:
    """0 where a key has at most so many rows; otherwise the number, from 1, of the row's part."""
    order = np.argsort(key, kind="stable")
    lead = np.flatnonzero(edges_of(key[order]))
    count = np.diff(np.append(lead, len(order)))
    rank = np.arange(len(order)) - np.repeat(lead, count)
    part = np.zeros(len(key), np.uint32)
    part[order] = np.where(np.repeat(count, count) > most, rank // most + 1, 0)
    return part


def match(runs: DataFrame, unit: Unit, n: int, history: DataFrame | None = None, keep_runs: bool = False) -> DataFrame:
    """Settled runs, pairs of runs and open runs, by bucket of the document; with ``keep_runs`` also
    each bucket's new runs in the order of their fingerprints: a run of the index. ``history`` has
    the same form, and is merge-joined: both sides are in order, so only what they share is touched."""

    def run(tab: pa.Table, past: pa.Table | None = None) -> pa.Table:
        if not tab.num_rows:
            return as_matched([])
        kinds, blobs = tab.column("kind").to_pylist(), tab.column("blob").to_pylist()
        bucket = tab.column("bucket")[0].as_py()
        out = []
        settled = [x for x in [stacked([b for k, b in zip(kinds, blobs, strict=True) if k == SETTLED])] if x]
        new = stacked([b for k, b in zip(kinds, blobs, strict=True) if k == RUNS])
        if not new:
            return as_matched(settled_blobs(settled, n))
        new = {k: v[np.argsort(new["fp"], kind="stable")] for k, v in new.items()}
        size = len(new["fp"])
        twice = edges_of(new["fp"])
        twice = np.repeat(np.diff(np.append(np.flatnonzero(twice), size)) > 1, np.diff(np.append(np.flatnonzero(twice), size)))
        old = []
        for blob in past.column("blob").to_pylist() if past is not None else ():
            x = open_docs(blob)
            # both stand in the order of fingerprints: where each new one would go, from both sides
            at, to = (np.searchsorted(x["fp"], new["fp"], side=side) for side in ("left", "right"))
            twice |= to > at
            hit = edges_of(new["fp"]) & (to > at)
            take = expand(at[hit], to[hit] - at[hit])
            old.append({k: x[k][take] for k in RUN})
        rows = {k: np.concatenate([*(o[k] for o in old), new[k][twice]]) for k in RUN}
        fresh = np.arange(len(rows["fp"])) >= len(rows["fp"]) - int(twice.sum())
        order = np.lexsort([rows[k] for k in ("start", "th", "doc")] + [fresh, rows["content"], rows["fp"]])
        x, fresh_x = {k: v[order] for k, v in rows.items()}, fresh[order]
        repeat = np.zeros(size, dtype=bool)
        if len(order):
            fps, contents = edges_of(x["fp"]), edges_of(x["fp"], x["content"])
            leads = np.flatnonzero(contents)
            lead = leads[np.cumsum(contents) - 1]
            group = np.cumsum(fps) - 1
            several = np.bincount(group, contents)[group] > 1

            def same_place(a: np.ndarray) -> np.ndarray:
                return (x["doc"] == x["doc"][a]) & (x["th"] == x["th"][a]) & (x["start"] == x["start"][a])

            if unit.within:
                own = np.flatnonzero(twice)[order[fresh_x] - (len(order) - int(twice.sum()))]
                repeat[own] = (np.arange(len(order)) != lead)[fresh_x]
                paired = fresh_x & ~(same_place(lead) & (fresh_x == fresh_x[lead]))
                # the place before it in the order; a place that history has too is paired with the first
                partner = np.maximum(np.arange(len(order)) - 1, 0)
                partner = np.where(same_place(partner), lead, partner)
                open_ = several & (np.arange(len(order)) == lead)
            else:
                later = x["doc"] > x["doc"][lead]
                second = second_docs(x["doc"], np.cumsum(contents) - 1, leads)[np.cumsum(contents) - 1]
                paired, partner = later & (x["doc"] == second), lead
                member = later & ~paired
                settled.append({k: x[k][member] for k in PLACE_OF})
                low = np.minimum.reduceat(x["doc"], np.flatnonzero(fps))[group]
                high = np.maximum.reduceat(x["doc"], np.flatnonzero(fps))[group]
                open_ = several & ~later & (low < high)
            if paired.any():
                ends = {k: x[k][paired] for k in PLACE_OF} | {f"p{k}": x[k][partner[paired]] for k in ("doc", "th", "start")}
                out += paired_blobs(ends, n)
            if open_.any():
                take = np.flatnonzero(open_)
                take = take[np.lexsort((x["start"][take], x["th"][take], x["doc"][take]))]
                if unit.within:
                    more = {"fresh": fresh_x[take].astype(np.uint8)}
                else:
                    part = parts_of(x["fp"][take], unit.part)
                    to = (bucket + np.maximum(part.astype(np.int64) - 1, 0)) % n
                    more = {"fp": x["fp"][take].astype(U64), "part": part, "to": to.astype(np.int32), "side": np.zeros(len(take), np.uint8)}
                out += by_bucket(x["th"][take] % n, OPEN, **{k: x[k][take] for k in PLACE_OF}, **more)
        if keep_runs:
            out.append((bucket, HISTORY, with_docs(**{k: new[k][~repeat] for k in RUN})))
        return as_matched(out + settled_blobs(settled, n))

    if history is None:
        return runs.groupBy("bucket").applyInArrow(lambda tab: run(tab), MATCHED_SQL)
    return runs.groupBy("bucket").cogroup(history.groupBy("bucket")).applyInArrow(lambda tab, past: run(tab, past), MATCHED_SQL)


def settled_blobs(parts: list[dict[str, np.ndarray]], n: int) -> list[tuple[int, int, bytes]]:
    x = {k: np.concatenate([p[k] for p in parts]) for k in PLACE_OF} if parts else None
    return by_bucket(x["th"] % n, SETTLED, **x) if x and len(x["th"]) else []


#: Where a run lies.
PLACE_OF = ("doc", "th", "start", "n")


def paired_blobs(x: dict[str, np.ndarray], n: int) -> list[tuple[int, int, bytes]]:
    """Pairs (doc, th, start, n, pdoc, pth, pstart) as stretches, by bucket of the later document."""
    order, lead, size = follow(x)
    at = order[lead]
    x = {k: v[at] for k, v in x.items()} | {"n": size.astype(np.uint32)}
    return by_bucket(x["th"] % n, PAIR, **x)


def stretches(pairs: DataFrame, n: int) -> DataFrame:
    """Both sides of each stretch, by bucket of the side's document, under the stretch's number
    ``fp``; long ones in pieces. Side 1 is the earlier place."""

    def f(tab: pa.Table) -> pa.Table:
        x = stacked(tab.column("blob").to_pylist())
        order, lead, size = follow(x)
        x = {k: v[order[lead]] for k, v in x.items()}
        count = -(-size // LONGEST)
        piece = np.repeat(np.arange(len(count)), count)
        shift = expand(np.zeros(len(count), np.int64), count) * LONGEST
        length = np.minimum(size[piece] - shift, LONGEST).astype(np.uint32)
        x = {k: v[piece] for k, v in x.items()}
        start, pstart = (x[k].astype(np.int64) + shift for k in ("start", "pstart"))
        number = mix(mix(mix(x["doc"].view(U64) * BASE ^ x["th"].view(U64)) * BASE2 ^ x["pdoc"].view(U64)) * BASE ^ start.view(U64) * BASE2 ^ pstart.view(U64))
        to = (number >> U64(33)).astype(np.int64) % n
        out = []
        for side, doc, th, at in ((0, x["doc"], x["th"], start), (1, x["pdoc"], x["pth"], pstart)):
            rows = np.lexsort((at, th, doc))
            y = {"doc": doc, "th": th, "start": at.astype(np.uint32), "n": length, "fp": number, "part": np.zeros(len(at), np.uint32)}
            y |= {"to": to.astype(np.int32), "side": np.full(len(at), side, np.uint8)}
            y = {k: v[rows] for k, v in y.items()}
            out += by_bucket(y["th"] % n, OPEN, **y)
        return pa.Table.from_batches([as_batch(out)])

    return pairs.groupBy("bucket").applyInArrow(f, OUT_SQL)


def pieces(docs: pa.Table, spans: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, slice]]:
    """(bytes of a text, its rows of ``spans``) for each document that has some; spans are in the
    order of (doc, th)."""
    docs = docs.combine_chunks()
    if not docs.num_rows:
        return
    column = docs.column("text").chunk(0)
    ids, ths = ids_of(docs.column("doc_id").chunk(0)), docs.column("th").chunk(0).to_numpy()
    data, offsets = text_bytes(column)
    row_of = {(d, t): i for i, (d, t) in enumerate(zip(ids.tolist(), ths.tolist(), strict=True))}
    edges = np.flatnonzero(edges_of(spans["doc"], spans["th"]))
    for a, b in zip(edges, np.append(edges[1:], len(spans["doc"])), strict=True):
        i = row_of[int(spans["doc"][a]), int(spans["th"][a])]
        yield data[offsets[i] : offsets[i + 1]], slice(a, b)


def in_doc_order(blobs: list[bytes]) -> dict[str, np.ndarray] | None:
    x = stacked(blobs)
    if x is None:
        return None
    order = np.lexsort((x["start"], x["th"], x["doc"]))
    return {k: v[order] for k, v in x.items()}


def together(texts: DataFrame, blobs: DataFrame, n: int, f: Callable, schema: str) -> DataFrame:
    """Texts and blobs by bucket of the document."""
    left = texts.select("doc_id", "th", "text", F.pmod("th", F.lit(n)).cast("int").alias("bucket"))
    return left.groupBy("bucket").cogroup(blobs.groupBy("bucket")).applyInArrow(f, schema)


def expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... n[i] of them, for each i."""
    n = n.astype(np.int64)
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(start.astype(np.int64), n)


def fetch_windows(unit: Unit, n: int):
    """Hashes of 96 bits of the windows of open runs, by bucket of the hash. Of the places of one
    window only the first goes on; the others are paired here with the place before them."""

    def f(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        x = in_doc_order(blobs.column("blob").to_pylist()) if blobs.num_rows else None
        out = []
        if x:
            h1, h2 = [], []
            for data, rows in pieces(docs, x):
                tokens, _, _ = unit.cut(data)
                at = expand(x["start"][rows], x["n"][rows])
                h1.append(Spans(tokens, BASE).hash(at, at + unit.window))
                h2.append(Spans(mix(tokens), BASE2).hash(at, at + unit.window).astype(np.uint32))
            rows = np.repeat(np.arange(len(x["n"])), x["n"])
            places = {k: x[k][rows] for k in ("doc", "th", "fresh")}
            places |= {"start": expand(x["start"], x["n"]).astype(np.uint32), "h1": np.concatenate(h1), "h2": np.concatenate(h2)}
            places, later, pairs = after_first(places)
            out = paired_blobs(pairs, n)
            # a place that comes as history and as new goes on as both, but once each
            go = ~later & edges_of(*(places[k] for k in ("h1", "h2", "fresh", "doc", "th", "start")))
            go = np.flatnonzero(go)[np.lexsort([places[k][go] for k in ("start", "th", "doc")])]
            places = {k: v[go] for k, v in places.items()}
            out += by_bucket((places["h1"] >> U64(32)).astype(np.int64) % n, OPEN, **places)
        return pa.Table.from_batches([as_batch(out)])

    return f


def after_first(x: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], np.ndarray, dict[str, np.ndarray]]:
    """Places in the order of their windows, which of them are new and not the first place, and
    those paired with the place before."""
    order = np.lexsort((x["start"], x["th"], x["doc"], x["fresh"], x["h2"], x["h1"]))
    x = {k: v[order] for k, v in x.items()}
    new = edges_of(x["h1"], x["h2"])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]

    def same_place(a: np.ndarray) -> np.ndarray:
        return (x["doc"] == x["doc"][a]) & (x["th"] == x["th"][a]) & (x["start"] == x["start"][a])

    # a place may come as new and, with a later batch, as history
    later = ~same_place(lead) & x["fresh"].astype(bool)
    partner = np.maximum(np.arange(len(lead)) - 1, 0)
    partner = np.where(same_place(partner), lead, partner)[later]
    pairs = {k: x[k][later] for k in ("doc", "th", "start")} | {f"p{k}": x[k][partner] for k in ("doc", "th", "start")}
    return x, later, pairs | {"n": np.ones(len(partner), np.uint32)}


def by_kind(tab: pa.Table, kind: int) -> tuple[list[tuple[int, int, bytes]], list[bytes]]:
    """(rows of the kind as they are, blobs of the open ones)."""
    rows = list(zip(*(tab.column(k).to_pylist() for k in ("bucket", "kind", "blob")), strict=True))
    return [r for r in rows if r[1] == kind], [r[2] for r in rows if r[1] == OPEN]


def pair_windows(n: int):
    """Pairs of all but the first place of each window."""

    def f(tab: pa.Table) -> pa.Table:
        out, blobs = by_kind(tab, PAIR)
        if blobs:
            _, _, pairs = after_first(stacked(blobs))
            out += paired_blobs(pairs, n)
        return pa.Table.from_batches([as_batch(out)])

    return f


def fetch_tokens(unit: Unit):
    """The tokens of open runs and of stretches, by the bucket they name."""

    def f(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        x = in_doc_order(blobs.column("blob").to_pylist()) if blobs.num_rows else None
        if not x:
            return pa.Table.from_batches([as_batch([])])
        count = x["n"].astype(np.int64) + unit.window - 1
        parts, size = [], np.zeros(len(count), np.int64)
        for data, rows in pieces(docs, x):
            if unit.words:
                start, end = word_places(data)
                own = [token_bytes(data, start, end, int(a), int(k)) for a, k in zip(x["start"][rows], count[rows], strict=True)]
                size[rows] = [len(w) for w in own]
                parts.append(np.frombuffer(b"".join(own), np.uint8))
            else:
                size[rows] = count[rows]
                parts.append(data[expand(x["start"][rows], count[rows])])
        data, ends = np.concatenate(parts), np.cumsum(size)
        out = []
        dealt = x["part"] > 0
        order = np.lexsort((dealt, x["to"]))
        edges = np.flatnonzero(edges_of(x["to"][order], dealt[order]))[1:]
        for rows in np.split(order, edges):
            raw = data[expand(ends[rows] - size[rows], size[rows])]
            blob = pack(raw=raw, size=size[rows].astype(np.uint32), **{k: x[k][rows] for k in ("doc", "th", "start", "n", "fp", "part", "side")})
            out.append((int(x["to"][rows[0]]), OPEN, blob))
        return pa.Table.from_batches([as_batch(out)])

    return f


def equal_stretches(n: int):
    """Stretches whose two sides have the same tokens, as settled windows by bucket of the document."""

    def f(tab: pa.Table) -> pa.Table:
        blobs = [unpack(b) for b in tab.column("blob").to_pylist()]
        x = {k: np.concatenate([b[k] for b in blobs]) for k in ("doc", "th", "start", "n", "fp", "side", "size")}
        raw = [b["raw"] for b in blobs]
        first = np.concatenate([np.cumsum(b["size"].astype(np.int64)) - b["size"] for b in blobs])
        blob = np.repeat(np.arange(len(blobs)), [len(b["n"]) for b in blobs])

        def tokens(i: int) -> np.ndarray:
            return raw[blob[i]][first[i] : first[i] + int(x["size"][i])]

        order = np.lexsort((x["side"], x["fp"]))
        keep: list[int] = []
        later: dict[int, list[int]] = {}
        for i in order.tolist():
            number = int(x["fp"][i])
            if not x["side"][i]:
                later.setdefault(number, []).append(i)
            else:
                keep += [j for j in later.pop(number, ()) if np.array_equal(tokens(i), tokens(j))]
        if not keep:
            return pa.Table.from_batches([as_batch([])])
        at = np.array(keep)
        at = at[np.lexsort((x["start"][at], x["th"][at], x["doc"][at]))]
        return pa.Table.from_batches([as_batch(by_bucket(x["th"][at] % n, SETTLED, **{k: x[k][at] for k in PLACE_OF}))])

    return f


def joined(doc: np.ndarray, th: np.ndarray, start: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """Window starts as runs, by bucket of the document."""
    if not len(doc):
        return []
    order = np.lexsort((start, th, doc))
    doc, th, start = doc[order], th[order], start[order].astype(np.int64)
    new = edges_of(doc, th) | np.append(True, np.diff(start) > 1)
    at = np.flatnonzero(new)
    last = start[np.append(at[1:], len(start)) - 1]
    keep = {"doc": doc[at], "th": th[at], "start": start[at].astype(np.uint32), "n": (last - start[at] + 1).astype(np.uint32)}
    return by_bucket(keep["th"] % n, SETTLED, **keep)


def covered(size: int, start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Mask of the tokens that settled windows cover."""
    depth = np.zeros(size + 1, dtype=np.int32)
    np.add.at(depth, start.astype(np.int64), 1)
    np.subtract.at(depth, start.astype(np.int64) + n + (window - 1), 1)
    return np.cumsum(depth[:-1]) > 0


def apply(unit: Unit):
    """(doc_id, size, removed, spans, kept) for each row of the documents."""

    def f(docs: pa.Table, blobs: pa.Table) -> pa.Table:
        x = in_doc_order(blobs.column("blob").to_pylist()) if blobs.num_rows else None
        docs = docs.combine_chunks()
        size, removed, spans, kept = [], [], [], []
        if docs.num_rows:
            ids, ths = ids_of(docs.column("doc_id").chunk(0)), docs.column("th").chunk(0).to_numpy()
            data, offsets = text_bytes(docs.column("text").chunk(0))
            where = {}
            if x:
                edges = np.flatnonzero(edges_of(x["doc"], x["th"]))
                where = {(int(x["doc"][a]), int(x["th"][a])): (a, b) for a, b in zip(edges, np.append(edges[1:], len(x["doc"])), strict=True)}
            for i in range(docs.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                span = where.get((int(ids[i]), int(ths[i])))
                start, end = word_places(text) if unit.words else (None, None)
                total = len(start) if unit.words else len(text)
                size.append(total)
                if span is None:
                    removed.append(0), spans.append(0)
                    kept.append(b" ".join(text.tobytes().split()) if unit.words else text.tobytes())
                    continue
                gone = covered(total, x["start"][slice(*span)], x["n"][slice(*span)], unit.window)
                removed.append(int(gone.sum()))
                spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8)) == 1) + bool(gone[0])))
                kept.append(join_words(text, start[~gone], end[~gone]) if unit.words else text[~gone].tobytes())
        doc_ids = docs.column("doc_id") if docs.num_rows else pa.array([], pa.int64())
        return pa.table(
            {"doc_id": doc_ids, "size": pa.array(size, pa.int64()), "removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())}
        )

    return f


APPLIED = "doc_id long, size long, removed long, spans long, kept binary"


def join_words(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """The words with one space between."""
    if not len(start):
        return b""
    keep = np.zeros(len(text) + 1, dtype=np.int8)
    np.add.at(keep, start, 1)
    np.subtract.at(keep, end, 1)
    inside = np.cumsum(keep[:-1]).astype(bool)
    out = np.where(inside, text, 32)
    gap = np.zeros(len(text), dtype=bool)
    gap[end[:-1]] = True  # at least one blank follows each word but the last
    return out[inside | gap].tobytes()
