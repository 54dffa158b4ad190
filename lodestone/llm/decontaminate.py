"""Benchmark decontamination by a generalised suffix automaton.

The items' words make one automaton. Training texts are streamed through it word by word, which
yields at each word the length of the longest match that ends there; matches of a window's length
or more are hits. All texts of a batch are streamed side by side in numpy: a step advances one word
of each. Two neighbouring words that no item has side by side break every match, so only stretches
without such a pair are streamed at all; that loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import Scratch, give_back

#: Fixed value: bytes of words. All bytes over 127 belong to words, so UTF-8 can be cut as bytes.
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words that are streamed at once.
BATCH_WORDS = 1 << 20


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words of already joined texts."""
    lower = LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = IN_WORD[lower]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    spans = W.Spans(W.BYTE_TOKENS[lower], W.BASE2)
    return spans.hash(start, end) + W.BASE * (end - start).astype(np.uint64), start, end


class Automaton:
    """Suffix automaton of several word sequences. States are numbered from 0, the root; the
    transitions stand in one open-addressed table of (state, word)."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        link, length, nexts = [-1], [0], [{}]
        ends: list[tuple[int, int]] = []
        for k, (_, words) in enumerate(items):
            last = 0
            for word in words:
                last = self._extend(link, length, nexts, last, word)
                ends.append((last, k))
        self.link, self.length = np.array(link), np.array(length)
        self._owners(items, ends)
        state = np.repeat(np.arange(len(nexts)), [len(x) for x in nexts])
        word = np.array([w for x in nexts for w in x], dtype=np.int64)
        to = np.array([t for x in nexts for t in x.values()], dtype=np.int64)
        self._table(state, word, to)

    @staticmethod
    def _extend(link: list[int], length: list[int], nexts: list[dict], last: int, word: int) -> int:
        """The state of ``last`` followed by ``word``; texts start again at the root."""
        known = nexts[last].get(word)
        if known is not None and length[known] == length[last] + 1:
            return known
        if known is None:
            state = len(link)
            link.append(0), length.append(length[last] + 1), nexts.append({})
        else:
            state = -1
        at = last
        while known is None and at >= 0 and word not in nexts[at]:
            nexts[at][word] = state
            at = link[at]
        if known is None and at < 0:
            return state
        to = nexts[at][word]
        if length[to] == length[at] + 1:
            link[state] = to
            return state
        clone = len(link)
        link.append(link[to]), length.append(length[at] + 1), nexts.append(dict(nexts[to]))
        while at >= 0 and nexts[at].get(word) == to:
            nexts[at][word] = clone
            at = link[at]
        link[to] = clone
        if state < 0:
            return clone
        link[state] = clone
        return state

    def _owners(self, items: list[tuple[str, list[int]]], ends: list[tuple[int, int]]) -> None:
        """For each state the state that holds the last ``window`` words of its strings, and the
        items that have them; and the items of fewer words that end there whole."""
        n, window = len(self.link), self.window
        owners: list[set[int]] = [set() for _ in range(n)]
        for state, item in ends:
            owners[state].add(item)
        order = np.argsort(self.length, kind="stable")
        for state in order[::-1]:
            if self.link[state] >= 0:
                owners[self.link[state]] |= owners[state]
        self.full = np.full(n, -1)
        for state in order:
            up = self.link[state]
            if self.length[state] >= window:
                self.full[state] = state if up < 0 or self.length[up] < window else self.full[up]
        short: dict[int, set[int]] = {}
        at_end = {}
        for state, item in ends:
            at_end[item] = state
        for item, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                # of the states along the links from the item's end, the one whose longest string it is
                state = at_end[item]
                while self.length[self.link[state]] >= len(words):
                    state = self.link[state]
                short.setdefault(state, set()).add(item)
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * n
        for state in order:
            up = self.whole[self.link[state]] if self.link[state] >= 0 else ()
            own = tuple((len(items[i][1]), i) for i in sorted(short.get(int(state), ())))
            self.whole[state] = up + own
        self.owners = [tuple(sorted(o)) for o in owners]
        self.shortest = min([window, *(len(w) for _, w in items if w)])
        self.has_whole = np.array([bool(x) for x in self.whole])

    def _table(self, state: np.ndarray, word: np.ndarray, to: np.ndarray) -> None:
        size = 16
        while size < 4 * len(state):
            size *= 2
        self.mask = np.int64(size - 1)
        self.keys, self.to = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        key = state << 32 | word
        slot = self._slot(key)
        left = np.arange(len(key))
        while len(left):  # rows that found their slot free and came first stay
            free = self.keys[slot[left]] < 0
            self.keys[slot[left[free]]] = key[left[free]]
            placed = self.keys[slot[left]] == key[left]
            self.to[slot[left[placed]]] = to[left[placed]]
            left = left[~placed]
            slot[left] = slot[left] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (W.mix(key.astype(np.uint64) * W.BASE) & np.uint64(self.mask)).astype(np.int64)

    def step(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is none."""
        key = state << 32 | word
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.to[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
            slot[left] = slot[left] + 1 & self.mask
        return out

    def stream(self, words: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, longest match) after each word of the stretches ``words[start:start + length]``,
        side by side: longest first, so those that are still going stand in front."""
        states, matched = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state, size = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        for t in range(int(length[0]) if len(length) else 0):
            going = int(np.searchsorted(-length, -t, side="left"))
            word = words[start[:going] + t]
            now, have = state[:going], size[:going]
            to = self.step(now, word)
            have = have + 1
            stuck = np.flatnonzero(to < 0)
            now = now.copy()
            while len(stuck):
                now[stuck] = self.link[now[stuck]]
                root = now[stuck] < 0
                to[stuck[root]] = 0
                have[stuck[root]] = 0
                stuck = stuck[~root]
                have[stuck] = self.length[now[stuck]] + 1
                to[stuck] = self.step(now[stuck], word[stuck])
                stuck = stuck[to[stuck] < 0]
            state[:going], size[:going] = to, have
            states[start[:going] + t], matched[start[:going] + t] = to, have
        return states, matched


class Benchmark:
    """The items' automaton with the table of their words and pairs of neighbouring words."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        hashes = [words_of(np.frombuffer((text or "").encode(), np.uint8))[0] for _, text in items]
        self.words = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
        coded = [np.searchsorted(self.words, h) for h in hashes]
        pairs = [c[:-1] << 32 | c[1:] for c in coded]
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *pairs]))
        self.ids = [str(item) for item, _ in items]
        self.automaton = Automaton([(i, c.tolist()) for (i, _), c in zip(items, coded, strict=True)], window)
        self.size = sum(len(c) for c in coded)
        # 20 bits of a hash tell most other words at one look
        self.seen_word = np.zeros(1 << 20, dtype=bool)
        self.seen_word[(self.words & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for words that no item has."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.seen_word[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.words):
            h = hashes[maybe]
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            same = self.words[at] == h
            out[maybe[same]] = at[same]
        return out

    def hits(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(mask of hit words, document of each found item, found item). ``doc`` numbers each word's
        document, in order."""
        a = self.automaton
        code = self.code(hashes)
        n = len(code)
        hit = np.zeros(n, dtype=bool)
        none = np.zeros(0, np.int64)
        known = code >= 0
        if not known.any():
            return hit, none, none
        linked = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
        at = np.flatnonzero(linked)
        if len(self.pairs):
            pair = code[at] << 32 | code[at + 1]
            slot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            linked[at] = self.pairs[slot] == pair
        else:
            linked[:] = False
        begin = known.copy()
        begin[1:] &= ~linked
        finish = known.copy()
        finish[:-1] &= ~linked
        start, stop = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        long = stop - start >= a.shortest
        start, length = start[long], (stop - start)[long]
        state, matched = a.stream(code, start, length)
        docs, found = [], []
        depth = np.zeros(n + 1, np.int32)
        ends = np.flatnonzero(matched >= a.window)
        np.add.at(depth, ends - a.window + 1, 1)
        np.subtract.at(depth, ends + 1, 1)
        seen = np.unique(np.stack([doc[ends], a.full[state[ends]]]), axis=1) if len(ends) else np.zeros((2, 0), np.int64)
        for d, s in seen.T.tolist():
            docs += [d] * len(a.owners[s])
            found += a.owners[s]
        for p in np.flatnonzero((matched > 0) & a.has_whole[state]).tolist():
            for size, item in a.whole[state[p]]:
                if size <= matched[p]:
                    depth[p - size + 1] += 1
                    depth[p + 1] -= 1
                    docs.append(int(doc[p]))
                    found.append(item)
        return np.cumsum(depth[:-1]) > 0, np.array(docs, dtype=np.int64), np.array(found, dtype=np.int64)


#: Bytes of items in one automaton, which takes about 150 times as much in each task. A larger benchmark
#: is dealt into several; documents are streamed through them one after the other.
SHARD_BYTES = 4 << 20


def shards_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """The items (item, text) in shards that one automaton can hold; an item is whole in one. Items
    without an id are held under the id "null"."""
    rows = items.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    n = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 1) // SHARD_BYTES)
    return [rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


def automaton_of(shard: DataFrame, window: int) -> Benchmark:
    """Only one shard's items are on the driver at a time."""
    return Benchmark(sorted((r["item"], r["text"]) for r in shard.collect()), window)


SPANS = "array<struct<a:int,b:int>>"
FOUND = f"struct<n_words:long,spans:{SPANS},item_ids:array<string>>"
SPAN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def joined_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts joined with a blank between, so that no word crosses two of them, where each begins)."""
    sizes = np.diff(offsets).astype(np.int64)
    begin = np.arange(len(sizes)) + (offsets[:-1] - offsets[0])
    joined = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    joined[W.expand(begin, sizes)] = data[offsets[0] : offsets[-1]]
    return joined, begin


def spans_of(benchmark: Benchmark, data: np.ndarray, offsets: np.ndarray) -> pa.StructArray:
    joined, begin = joined_texts(data, offsets)
    n = len(begin)
    hashes, start, _ = words_of(joined)
    doc = np.searchsorted(begin, start, side="right") - 1
    hit, at, item = benchmark.hits(hashes, doc)
    found: list[set[str]] = [set() for _ in range(n)]
    for d, i in zip(at.tolist(), item.tolist(), strict=True):
        found[d].add(benchmark.ids[i])
    words = np.bincount(doc, minlength=n)
    first = np.cumsum(words) - words
    # maximal runs of hit words, which end with their document
    new, last = hit.copy(), hit.copy()
    new[1:] &= ~(hit[:-1] & (doc[1:] == doc[:-1]))
    last[:-1] &= ~(hit[1:] & (doc[1:] == doc[:-1]))
    a, b = np.flatnonzero(new), np.flatnonzero(last) + 1
    owner = doc[a]
    runs = pa.StructArray.from_arrays(
        [pa.array((a - first[owner]).astype(np.int32)), pa.array((b - first[owner]).astype(np.int32))], names=["a", "b"]
    )
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), runs)
    return pa.StructArray.from_arrays(
        [pa.array(words), lists, pa.array([sorted(x) for x in found], pa.list_(pa.string()))], names=["n_words", "spans", "item_ids"]
    )


def parts_of_column(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Rows of a column whose texts are streamed at once."""
    _, offsets = W.text_bytes(column)
    part = (offsets[1:] - offsets[0]).astype(np.int64) // (4 * BATCH_WORDS)
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(column)]
    yield from ((int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True))


def spans_in(items: DataFrame, window: int):
    """A function of a text column that yields the struct FOUND for one shard of the items."""
    shared = items.sparkSession.sparkContext.broadcast(automaton_of(items, window))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            data, offsets = W.text_bytes(column)
            yield pa.concat_arrays([spans_of(shared.value, data, offsets[a : b + 1]) for a, b in parts_of_column(column)])
        give_back()

    return F.arrow_udf(run, FOUND)


def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without the words in their spans (first word, word after the last)."""
    out = []
    for text, gone in zip(texts, spans, strict=True):
        data = np.frombuffer(text.as_py().encode(), np.uint8)
        _, start, end = words_of(data)
        depth = np.zeros(len(data) + 1, np.int32)
        for run in gone.as_py():
            np.add.at(depth, start[run["a"] : run["b"]], 1)
            np.subtract.at(depth, end[run["a"] : run["b"]], 1)
        out.append(data[np.cumsum(depth[:-1]) == 0].tobytes().decode())
    return pa.array(out, pa.string())


def n_hit_of(spans):
    """Words in the union of spans in order."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    more = F.aggregate(
        spans,
        start,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(x["b"] - F.greatest(x["a"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], x["b"]).alias("to")
        ),
    )
    return more["n"].cast("long")


def with_contamination(docs: DataFrame, items: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """``docs`` with a struct column (n_words, n_hit, spans, item_ids). A benchmark of one shard is
    looked up as the rows pass; with more, each shard's finds are written to the shared folder and
    then joined by document."""
    shards = shards_of(items)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def struct(n_words, spans, item_ids):
        return F.struct(n_words.alias("n_words"), n_hit_of(spans).alias("n_hit"), spans.alias("spans"), item_ids.alias("item_ids")).alias(name)

    if len(shards) == 1:
        found = docs.withColumn(name, spans_in(shards[0], window)(text))
        x = F.col(name)
        return found.withColumn(name, struct(x["n_words"], x["spans"], x["item_ids"]))
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit("second"), text).alias("h2")).alias("key")
    rows = scratch.write(docs.select(F.struct(*docs.columns).alias("row"), key, text.alias("text")), "rows")
    parts = []
    for k, shard in enumerate(shards):
        one = rows.select("key", spans_in(shard, window)(F.col("text")).alias("x")).where(F.size("x.spans") > 0)
        parts.append(scratch.write(one.select("key", "x.spans", "x.item_ids"), f"shard{k}"))
    # copies of a row have the same finds in each shard
    found = reduce(DataFrame.unionByName, parts).distinct().groupBy("key").agg(
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    both = rows.join(found, rows["key"].eqNullSafe(found["key"]), "left")
    spans, ids = F.coalesce(found["spans"], F.array().cast(SPANS)), F.coalesce(found["item_ids"], F.array().cast("array<string>"))
    return both.select("row.*", struct(F.arrow_udf(word_counts, "long")(rows["text"]), spans, ids))


def word_counts(texts: pa.Array) -> pa.Array:
    return pa.array([len(words_of(np.frombuffer(t.as_py().encode(), np.uint8))[1]) for t in texts], pa.int64())


def is_contaminated(found, min_share: int = 20):
    return (found["n_hit"] > 0) & (min_share * found["n_hit"] >= found["n_words"])


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    min_share: int = 20,
    with_kept: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, item_ids, contaminated, and
    with ``with_kept`` the text without its hit words.

    Words are ASCII lower-cased. A window is ``window`` consecutive words of an item, or all words
    of a shorter one; a document word inside an occurrence of a window is hit. A document is
    contaminated if it has hits, and at least one word in ``min_share`` is hit. Null and empty texts
    have no words; repeated rows and null ids stay; empty tables give an empty result, or no hits.
    Repeated items are found together; a null item id counts as "null"; further columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = with_contamination(rows, items, "x", window=window)
    return found.select(
        "doc_id",
        "x.n_words",
        "x.n_hit",
        F.size("x.item_ids").cast("long").alias("n_items"),
        "x.item_ids",
        is_contaminated(F.col("x"), min_share).alias("contaminated"),
        *([F.arrow_udf(without_spans, "string")("text", "x.spans").alias("kept")] if with_kept else []),
    )


def ids_digest(item_ids):
    return F.sha2(F.array_join(item_ids, ","), 256)
