"""BPE encoding and decoding by a contiguous rank array.

Each short word is one row: the ids of its parts, and beside them the ranks of adjacent parts, both
contiguous. A step scans the ranks for the minimum, deletes that boundary, and refreshes the two
ranks next to it. Rows of one length are stepped together in numpy, so a scan is one ``argmin`` over
the array. Words come from whole texts; a bounded memo holds the words seen lately.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import give_back

NONE = np.int32(2**31 - 1)
#: Words longer than this many bytes are merged through a heap: scanning them again and again would
#: take the square of their length.
SHORT = 48
MEMO = 200_000
MEMO_BYTES = 64 << 20
#: Below this character normal form C changes nothing, and classes of letters and numbers are the same
#: in all versions of Unicode. Chunks with others are normalised and split by the library's tables.
SETTLED = "\u0250"
#: Fixed value: the white space of the vocabulary file's normaliser.
SPACE = "\t-\r\x20\x85\xa0  -     　"
CHUNK = re.compile(f"[^{SPACE}]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for
    itself, the others follow from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([self.ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([self.ids[c + end] for c in letters], dtype=np.int64)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", SPACE)
        self.plain_words = regex.compile(pattern).findall
        self.split = pre_tokenizers.Split(Regex(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.specials = re.compile("|".join(f"({re.escape(t)})" for t in self.special)) if self.special else None
        self.base = np.int64(max(self.tokens) + 1)
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in model["merges"]]
        keys = np.array([self.ids[a] * int(self.base) + self.ids[b] for a, b in pairs], dtype=np.int64)
        made = np.array([self.ids[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of, self.made = keys[order], order.astype(np.int32), made
        self.pairs: dict[int, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge_rows(self, raw: list[bytes]) -> list[bytes]:
        """The packed ids of words of one byte length."""
        n = len(raw[0])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(len(raw), n)
        parts = self.inner[data]
        parts[:, -1] = self.last[data[:, -1]]
        if n == 1:
            return [row.tobytes() for row in parts.astype("<u4")]
        out = [b""] * len(raw)

        def finish(rows: np.ndarray) -> None:
            packed = parts[rows].astype("<u4")
            for k, row in enumerate(rows.tolist()):
                out[index[row]] = packed[k, : size[row]].tobytes()

        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        index = np.arange(len(raw))
        size = np.full(len(raw), n)
        while len(index):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(index))
            best = ranks[rows, at]
            done = best == NONE
            if done.any():
                finish(np.flatnonzero(done))
                live = ~done
                index, size, at, best = index[live], size[live], at[live], best[live]
                parts, ranks, rows = parts[live], ranks[live], np.arange(len(index))
                if not len(index):
                    break
            width = ranks.shape[1]
            # the boundary goes: all behind it moves up by one
            columns = np.arange(width)
            moved = columns[None, :] >= at[:, None]
            wide = np.concatenate([ranks[:, 1:], np.full((len(index), 1), NONE, dtype=ranks.dtype)], axis=1)
            ranks = np.where(moved, wide, ranks)
            parts = np.where(np.arange(width + 1)[None, :] > at[:, None], np.concatenate([parts[:, 1:], parts[:, -1:]], axis=1), parts)
            parts[rows, at] = self.made[best]
            size = size - 1
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self.ranks(parts[before, at[before] - 1], parts[before, at[before]])
            after = np.flatnonzero(at < size - 1)
            ranks[after, at[after]] = self.ranks(parts[after, at[after]], parts[after, at[after] + 1])
            ends = np.flatnonzero(at >= size - 1)
            ranks[ends, np.minimum(at[ends], width - 1)] = NONE
            if width > 1 and width > size.max() - 1:
                ranks, parts = ranks[:, : size.max() - 1], parts[:, : size.max()]
            elif width == 1:
                finish(np.arange(len(index)))
                break
            if ranks.shape[1] == 0:
                finish(np.arange(len(index)))
                break
        return out

    def merge_long(self, raw: bytes) -> bytes:
        """A word of any length: pairs wait in a heap by rank and place."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), self.rank_of.tolist(), strict=True))
        data = np.frombuffer(raw, dtype=np.uint8)
        parts = self.inner[data]
        parts[-1] = self.last[data[-1]]
        n, base, made, pairs = len(parts), int(self.base), self.made, self.pairs
        ids = parts.tolist()
        follows, leads = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.ranks(parts[:-1], parts[1:])
        heap = [(int(first[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(first != NONE).tolist()]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = follows[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(made[rank]), -1
            on = follows[i] = follows[j]
            if on >= 0:
                leads[on] = i
                r = pairs.get(ids[i] * base + ids[on])
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[on]))
            x = leads[i]
            if x >= 0:
                r = pairs.get(ids[x] * base + ids[i])
                if r is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[i]))
        return np.array([i for i in ids if i >= 0], dtype="<u4").tobytes()

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            raw = word.encode()
            by_size.setdefault(len(raw), []).append((word, raw))
        out: dict[str, bytes] = {}
        for size, group in by_size.items():
            if size > SHORT:
                out.update((word, self.merge_long(raw)) for word, raw in group)
            else:
                for k in range(0, len(group), 8192):
                    part = group[k : k + 8192]
                    out.update(zip([w for w, _ in part], self.merge_rows([r for _, r in part]), strict=True))
        return out

    def words(self, chunk: str) -> list[str]:
        """The words of a chunk in its normal form, lower-cased."""
        if chunk.isascii() or max(chunk) < SETTLED:
            return self.plain_words(chunk.lower())
        return [word for word, _ in self.split.pre_tokenize_str(self.normal.normalize_str(chunk))]


class Coder:
    """Encodes and decodes texts. The memo is bounded, so memory does not grow with the input."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.memo: dict[str, bytes] = {}
        self.shown: dict[bytes, str] = {}
        self.held = 0

    def learn(self, chunks: set[str]) -> None:
        size = sum(map(len, chunks))
        if len(self.memo) + len(chunks) > MEMO or self.held + size > MEMO_BYTES:
            self.memo.clear()
            self.shown.clear()
            self.held = 0
        new = [c for c in chunks if c not in self.memo]
        self.held += sum(map(len, new))
        split = [self.v.words(c) for c in new]
        packed = self.v.encode_words(list({w for words in split for w in words}))
        for chunk, words in zip(new, split, strict=True):
            self.memo[chunk] = packed[words[0]] if len(words) == 1 else b"".join([packed[w] for w in words])

    def parts(self, text: str) -> list[str]:
        return [x for x in self.v.specials.split(text) if x] if self.v.specials and "<|" in text else [text]

    def chunks(self, text: str) -> list[str]:
        return text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else CHUNK.findall(text)

    def encode_batch(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the packed ids of its chunks, in order."""
        split = []
        for text in texts:
            row: list[str | bytes] = []
            for part in self.parts(text):
                if part in self.v.special:
                    row.append(self.v.special[part].to_bytes(4, "little"))
                else:
                    row += self.chunks(part)
            split.append(row)
        self.learn({c for row in split for c in row if isinstance(c, str)})
        memo = self.memo
        return [[memo[c] if isinstance(c, str) else c for c in row] for row in split]

    def decode(self, packed: bytes) -> str:
        """The tokens of these ids with one space between: the file names no decoder."""
        tokens = self.v.tokens
        return " ".join([tokens[i] for i, in struct.iter_unpack("<I", packed)])

    def decode_chunks(self, chunks: list[bytes]) -> str:
        shown = self.shown
        for c in {*chunks}:
            if c not in shown:
                shown[c] = self.decode(c)
        return " ".join([shown[c] for c in chunks if c])


def bpe_round_trip(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_bytes: int = 4 << 20,
    with_ids: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, and with
    ``with_ids`` the packed ids and the decoded text themselves.

    Null and empty texts encode to no ids and decode to the empty string. Repeated rows and null ids
    stay as they are; an empty table gives an empty result; further columns are not read.
    """
    fields = [
        pa.field("doc_id", pa.int64()),
        pa.field("n_tokens", pa.int64()),
        pa.field("ids_sha256", pa.string()),
        pa.field("decoded_sha256", pa.string()),
        *([pa.field("ids", pa.binary()), pa.field("decoded", pa.string())] if with_ids else []),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(vocabulary_path)
        for batch in batches:
            keys = batch.column(0)
            texts = batch.column(1)
            start, n = 0, len(keys)
            while start < n:
                held, size, stop = [], 0, start
                while stop < n and size < batch_bytes:
                    held.append(texts[stop].as_py())
                    size += len(held[-1])
                    stop += 1
                encoded = coder.encode_batch(held)
                ids = [b"".join(x) for x in encoded]
                decoded = [coder.decode_chunks(x) for x in encoded]
                columns = [
                    keys.slice(start, stop - start),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([sha256(x).hexdigest() for x in ids]),
                    pa.array([sha256(x.encode()).hexdigest() for x in decoded]),
                    *([pa.array(ids, pa.binary()), pa.array(decoded)] if with_ids else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))
                start = stop
        del coder
        give_back()

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids binary, decoded string" if with_ids else ""
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, schema)
