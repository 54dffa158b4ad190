"""Suffix-array dedup of bytes.

The passages that may repeat meet by the fingerprints of ``windows``: the maximal stretches that two
documents seem to share, both sides of each, and the edges of such stretches, where documents share
a fingerprint but not all around it. In each bucket their bytes make local texts, whose suffixes are
sorted in two stages: only those smaller than their successors are sorted directly, the others are
induced from them by scans over the buckets of first bytes. Adjacent common prefixes of the window's
length or more then show the repeated strings; nothing is removed but what they show, or what has
the whole content of a passage that they have shown. The passages of a frequent fingerprint are
sorted in parts in different buckets; the first documents of each part's strings then meet by hashes
of the strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import Scratch, buckets, keyed

BYTE_STEPS = np.left_shift(np.uint64(1), 8 * np.arange(8, dtype=np.uint64))
#: Ends each passage in a local text. UTF-8 never has this byte.
END = 0xFF


def prefix_words(text: np.ndarray, depth: int) -> list[np.ndarray]:
    """text as big-endian numbers: word i at p holds the bytes p + 8 i to p + 8 i + 7, cut to
    ``depth`` bytes in all; numbers compare as the bytes do."""
    padded = np.concatenate([text, np.full(depth + 8, END, np.uint8)]).astype(np.uint64)
    wide = padded[:-1] << np.uint64(8) | padded[1:]
    wide = wide[:-2] << np.uint64(16) | wide[2:]
    wide = wide[:-4] << np.uint64(32) | wide[4:]
    out = []
    for at in range(0, depth, 8):
        word = wide[at : at + len(text)]
        out.append(word >> np.uint64(8 * (at + 8 - depth)) if at + 8 > depth else word)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """True for each suffix that is smaller than its successor. Equal bytes take the type of the
    byte after them; the last suffix is the smaller one."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    ends = np.flatnonzero(differs)
    end = np.repeat(ends, np.diff(ends, prepend=-1))
    nxt = np.append(text[1:], END)
    return (text[end] < nxt[end]) | (end == n - 1)


def sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at`` in the order of the ``depth`` bytes from each. Eight bytes become their rank
    among all of the text, as many ranks as fit become one number, and so on until one is left."""
    padded = np.concatenate([text, np.full(depth, END, np.uint8)])
    word = prefix_words(padded, min(depth, 8))[0]
    rank = np.unique(word, return_inverse=True)[1].astype(np.uint64)
    bits = np.uint64(max(1, int(len(padded)).bit_length()))
    # the last eight bytes may overlap those before them, which does not change the order
    left = [*range(0, depth - 8, 8), max(depth - 8, 0)]
    key, room = np.zeros(len(at), np.uint64), 64 // int(bits)
    while True:
        for offset in left[: room - 1]:
            key = key << bits | rank[at + offset]
        left = left[room - 1 :]
        order = np.argsort(key)
        if not left:
            return at[order]
        key[order] = np.cumsum(W.edges_of(key[order]), dtype=np.uint64)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, by two stages."""
    n = len(text)
    small = smaller_than_next(text)
    direct = sorted_directly(text, np.flatnonzero(small), depth)
    counts = np.bincount(text, minlength=256)
    large = np.bincount(text[~small], minlength=256)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    head = first.copy()
    sa = np.full(n, -1, dtype=np.int64)
    per_byte = np.searchsorted(text[direct], np.arange(257))

    def induce(front: np.ndarray) -> None:
        """Puts the larger predecessors of a scanned stretch at the heads of their buckets."""
        before = front - 1
        before = before[before >= 0]
        before = before[~small[before]]
        if not len(before):
            return
        byte = text[before]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        new = np.flatnonzero(W.edges_of(byte))
        rank = np.arange(len(byte)) - np.repeat(new, np.diff(np.append(new, len(byte))))
        sa[head[byte] + rank] = before
        np.add.at(head, byte[new], np.diff(np.append(new, len(byte))))

    # the text ends with END: its predecessor is larger or smaller like any other
    for c in np.flatnonzero(counts):
        done = first[c]
        while done < head[c]:  # predecessors with the same byte lengthen the stretch being scanned
            stop = head[c]
            induce(sa[done:stop])
            done = stop
        own = direct[per_byte[c] : per_byte[c + 1]]
        at = first[c] + large[c]
        sa[at : at + len(own)] = own
        induce(own)
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each suffix has in common with the one before it in the order, up to ``depth``."""
    out = np.zeros(len(sa), dtype=np.int64)
    going = np.arange(1, len(sa))
    words = prefix_words(text, depth)
    for i, word in enumerate(words):
        width = min(8, depth - 8 * i)
        if 4 * len(going) > len(sa):
            word = word[sa]
            differ = word[going] ^ word[going - 1]
        else:
            differ = word[sa[going]] ^ word[sa[going - 1]]
        equal = differ == 0
        out[going[equal]] += width
        # how many low bytes the difference takes
        out[going[~equal]] += width - np.searchsorted(BYTE_STEPS, differ[~equal], side="right")
        going = going[equal]
    return out


def string_places(text: np.ndarray, doc: np.ndarray, usable: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(usable places, whether each one's next ``window`` bytes also start in a document with a
    smaller id, number of its string). ``doc``: the id at each byte; ``usable``: where such a string
    starts within a passage."""
    sa = suffix_array(text, window)
    lcp = common_prefixes(text, sa, window)
    new = lcp < window
    new[:1] = True
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(np.where(usable[sa], doc[sa], np.iinfo(np.int64).max), np.flatnonzero(new))
    keep = usable[sa]
    at, group = sa[keep], group[keep]
    return at, doc[at] > least[group], group


def string_hashes(text: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the ``window`` bytes from each place."""
    h1, h2 = np.full(len(at), W.BASE2), np.full(len(at), W.BASE)
    for word in prefix_words(text, window):
        h1, h2 = W.mix(h1 * W.BASE + word[at]), W.mix(h2 * W.BASE2 + W.mix(word[at]))
    return h1, h2.astype(np.uint32)


#: Bytes of passages that are sorted at once. The sides of a stretch, and the passages of one
#: fingerprint or of one part of it, stay together; both are bounded.
LOCAL_TEXT = 1 << 19


def settle_bytes(unit: W.Unit, n: int):
    """Strings that a document with a smaller id has, by bucket of the document; of dealt
    fingerprints also the first document of each string of a part, by bucket of the string's hash."""

    def f(tab: pa.Table) -> pa.Table:
        blobs = [W.unpack(b) for b in tab.column("blob").to_pylist()]
        raw = np.concatenate([b.pop("raw") for b in blobs])
        x = {k: np.concatenate([b[k] for b in blobs]) for k in ("doc", "th", "start", "n", "fp", "part")}
        dealt, size = x["part"], x["n"].astype(np.int64) + unit.window - 1
        begin = np.cumsum(size) - size
        order = np.lexsort((dealt, x["fp"]))
        part = np.cumsum(size[order]) // LOCAL_TEXT
        lead = np.flatnonzero(W.edges_of(x["fp"][order], dealt[order]))
        part = part[lead][np.searchsorted(lead, np.arange(len(order)), side="right") - 1]
        docs, ths, starts, first = [], [], [], []
        for rows in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            length = size[rows] + 1
            text = np.full(int(length.sum()), END, np.uint8)
            at = np.cumsum(length) - length
            text[W.expand(at, size[rows])] = raw[W.expand(begin[rows], size[rows])]
            owner = np.repeat(np.arange(len(rows)), length)
            offset = np.arange(len(text)) - at[owner]
            doc = x["doc"][rows][owner]
            place, later, group = string_places(text, doc, offset < x["n"][rows][owner], unit.window)
            found = place[later]
            docs.append(doc[found])
            ths.append(x["th"][rows][owner[found]])
            starts.append(x["start"][rows][owner[found]] + offset[found])
            go = ~later & (dealt[rows][owner[place]] > 0)
            # nothing comes before a null id, so one of them stands for all
            go[go] = (doc[place[go]] != W.NULL_ID) | W.edges_of(group[go])
            if go.any():
                found = place[go]
                h1, h2 = string_hashes(text, found, unit.window)
                start = (x["start"][rows][owner[found]] + offset[found]).astype(np.uint32)
                first.append({"doc": doc[found], "th": x["th"][rows][owner[found]], "start": start, "h1": h1, "h2": h2})
        out = W.joined(np.concatenate(docs), np.concatenate(ths), np.concatenate(starts), n)
        if first:
            y = {k: np.concatenate([p[k] for p in first]) for k in first[0]}
            y = {k: v[np.lexsort((y["start"], y["th"], y["doc"]))] for k, v in y.items()}
            out += W.by_bucket((y["h1"] >> np.uint64(32)).astype(np.int64) % n, W.OPEN, **y)
        return pa.Table.from_batches([W.as_batch(out)])

    return f


def settle_strings(n: int):
    """Of the strings of all parts of a fingerprint those that a document with a smaller id has."""

    def f(tab: pa.Table) -> pa.Table:
        out, blobs = W.by_kind(tab, W.SETTLED)
        if blobs:
            x = W.stacked(blobs)
            order = np.lexsort((x["doc"], x["h2"], x["h1"]))
            x = {k: v[order] for k, v in x.items()}
            new = W.edges_of(x["h1"], x["h2"])
            later = x["doc"] > x["doc"][np.flatnonzero(new)[np.cumsum(new) - 1]]
            out += W.joined(*(x[k][later] for k in ("doc", "th", "start")), n)
        return pa.Table.from_batches([W.as_batch(out)])

    return f


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, part: int = W.Unit.part) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (bytes).

    A byte of the UTF-8 text goes if a string of ``window`` bytes that covers it also starts in a
    document with a smaller id; strings are judged on the input, and do not cross documents.

    Null and empty texts have no bytes. A null id is smaller than all others. Rows with one id
    remove nothing from each other. An empty table gives an empty result. Further columns are not
    read. What is kept of a text need not be valid UTF-8: a span may end inside a character. At most
    ``part`` open passages of one fingerprint are sorted together; this does not change the result.
    """
    spark = docs.sparkSession
    unit = W.Unit(window=window, gram=min(24, window), words=False, within=False, part=part)
    rows = keyed(docs, id_col, text_col)
    n = buckets(docs)
    found = Scratch(spark, "suffix-dedup").write(W.match(W.cut(rows, unit, n), unit, n), "found")
    opened = W.of_kind(found, W.OPEN).unionByName(W.stretches(W.of_kind(found, W.PAIR), n))
    passages = W.together(rows, opened, n, W.fetch_tokens(unit), W.OUT_SQL)
    checked = passages.groupBy("bucket").applyInArrow(settle_bytes(unit, n), W.OUT_SQL)
    checked = checked.groupBy("bucket").applyInArrow(settle_strings(n), W.OUT_SQL)
    spans = W.of_kind(found, W.SETTLED).unionByName(checked)
    out = W.together(rows, spans, n, W.apply(unit), W.APPLIED)
    return out.select(
        "doc_id", F.col("size").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), "kept"
    )
