"""Language-model scores from a probabilistic suffix tree.

The tree's states are contexts of up to ``depth`` words. A context stays only if its next words diverge
from what its suffix predicts: if, leaving each occurrence out in turn, they get likelier. One that comes
once never does, so all that come twice are looked at, however large the corpus is. The next-word
distribution of a state is discounted and smoothed with that of its longest suffix that stays; the root
has the counts of single words. A word is scored at the longest suffix of its past that is a state.

The tree is never in one place. Texts are cut into chunks of words, which stay in a bucketed table.
Level by level a chunk asks for the sums over all chunks of what it has counted itself: its requests,
sorted by hash, go to buckets of hashes, each bucket adds them up, and the sums return to the chunk in
the same order, without their hashes. What is shuffled follows the different n-grams of the chunks.

Nothing is asked that a chunk can tell. A context that comes as often as its suffix comes at the same
places: it has the same next words, as often, and never stays beside its suffix. So n-grams are asked for
only where their context comes less often than its suffix, and copies cost little at further levels. A
context that comes twice, before two different words, never stays either.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, remove, shared_dir

U64 = np.uint64
#: Numbers of the two symbols that are no words: the end of a text, and what is before its start.
END, START = 0, 1
#: Steps of one in the sums, which are kept as integers so that their order does not matter.
STEPS = 1 << 20
#: Different n-grams that a bucket gets from all chunks, about.
BUCKET_ROWS = 400_000
GRAM, CONTEXT = 0, 1
#: Made once: a new one for each small piece takes longer than the piece.
PRESS, QUICK, SPREAD = zstandard.ZstdCompressor(level=3), zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

CHUNK_SQL = "chunk long, tokens long, length long, words long, blob binary"
ASKED = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("sums", pa.binary())])
ASKED_SQL = "chunk long, kind int, bucket int, keys binary, sums binary"
TOLD = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("sums", pa.binary()), ("known", pa.int64()), ("keys", pa.int64())])
TOLD_SQL = "chunk long, kind int, bucket int, sums binary, known long, keys long"
SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORED_SQL = "doc_id long, n_tokens long, n_known long, base_score double, score double"


class Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 2
        return n


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U64(0x9E3779B97F4A7C15) + b
    x ^= x >> U64(31)
    x *= U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def planes(a: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: the high ones are mostly zero."""
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes()


def of_planes(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def pack(*arrays: np.ndarray, press: zstandard.ZstdCompressor | None = None) -> bytes:
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return (press or PRESS).compress(head + b"".join(planes(np.ascontiguousarray(a)) for a in arrays))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = SPREAD.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    starts = 8 * (n + 1) + np.concatenate([[0], np.cumsum(sizes)])
    return [of_planes(raw[a:b], k) for a, b, k in zip(starts[:-1], starts[1:], kinds, strict=True)]


def close_packed(keys: np.ndarray) -> bytes:
    """Rising hashes as the planes of their steps."""
    return planes(np.diff(keys, prepend=U64(0)))


def opened(data: bytes) -> np.ndarray:
    return np.cumsum(of_planes(data, "<u8"), dtype=U64)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different keys in order, the number of each key among them, an order of all keys and where in
    it the different ones begin. Plain
    words are sorted far faster than with what belongs to them, so a key's place stands in its low bits;
    keys that then come in a wrong order, which agree in all others, are sorted as they are."""
    bits = U64(len(keys).bit_length())
    packed = keys >> bits << bits | np.arange(len(keys), dtype=U64)
    packed.sort()
    order = (packed & ((U64(1) << bits) - U64(1))).view(np.int64)
    rising = keys[order]
    if (rising[1:] < rising[:-1]).any():
        order = np.argsort(keys, kind="stable")
        rising = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = rising[1:] != rising[:-1]
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    return rising[first], which, order, first


def chunked(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Rows of some ``chunk_bytes`` of whole texts: the numbers of their words, each text with its
    end, and the hashes of the words by number."""

    def flush(number: int, held: list, words: Numbers) -> pa.RecordBatch:
        lengths = np.array([len(h[2]) for h in held], np.int32)
        keys = [xxhash.xxh3_64_intdigest(w) for w in words]
        # a word is neither empty nor a space
        hashes = np.array([xxhash.xxh3_64_intdigest(b""), xxhash.xxh3_64_intdigest(b" "), *keys], U64)
        ids, known = np.array([h[0] or 0 for h in held], np.int64), np.array([h[0] is not None for h in held])
        blob = pack(np.concatenate([h[2] for h in held]), lengths, ids, known, np.array([h[1] for h in held]), hashes)
        trained = int(sum(n for n, h in zip(lengths.tolist(), held, strict=True) if h[1]))
        return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([trained]), pa.array([int(lengths.sum())]), pa.array([len(hashes)]), pa.array([blob], pa.binary())], names=["chunk", "tokens", "length", "words", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, words = TaskContext.get().partitionId() << 32, [], 0, Numbers()
        for batch in batches:
            for doc_id, learn, text in zip(*(batch.column(k) for k in ("doc_id", "learn", "text")), strict=True):
                found = text.as_py().lower().split()  # bytes: A-Z and ASCII white space alone
                tokens = np.fromiter(map(words.__getitem__, found), np.int32, len(found))
                held.append((doc_id.as_py(), learn.as_py(), np.append(tokens, np.int32(END))))
                size += len(text.as_py()) + 16
                if size >= chunk_bytes:
                    yield flush(number, held, words)
                    number, held, size, words = number + 1, [], 0, Numbers()
        if held:
            yield flush(number, held, words)

    return docs.mapInArrow(run, CHUNK_SQL)


class Chunk:
    """The words of a chunk, and as many levels as it has been told of.

    At level n each position has the n + 1 words that end there: their hash, how often they come in all
    chunks (0 where their first n words are no frequent context), and how often those n words do."""

    def __init__(self, blob: bytes, told: dict[tuple[int, int], np.ndarray], tokens: int, known: int, least: int, discount: float):
        tok, lengths, self.ids, self.has_id, self.learn, words = unpack(blob, "<i4", "<i4", "<i8", "?", "?", "<u8")
        self.told, self.tokens, self.known, self.least, self.discount = told, tokens, known, least, discount
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.lengths = lengths
        self.trained = np.repeat(self.learn, lengths)
        order = np.argsort(words)
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        self.words, self.start = words[order], rank[START]
        self.at = rank[tok]
        self.hash = self.word = words[tok]

    def before(self, values: np.ndarray, start: int) -> np.ndarray:
        """What the position before has, and ``start`` at the first one of a text."""
        out = np.roll(values, 1)
        out[self.starts] = start
        return out

    def begin(self) -> None:
        self.first = self.told[0, GRAM]
        self.count = self.first[self.at]
        self.base = (self.count + 1.0) / (self.tokens + self.known + 1)
        self.likely = self.base.copy()

    def grow(self, n: int) -> None:
        """The n-grams of n words and one more that are to be asked for."""
        total = self.before(self.count, self.first[self.start] if n == 1 else 0)
        context = self.before(self.hash, self.words[self.start])
        often = total >= self.least
        fewer = often if n == 1 else often & (total < self.total)
        self.same, self.here, self.total = often & ~fewer, np.flatnonzero(fewer), total
        self.context = context[self.here] if n > 1 else self.before(self.at, self.start)[self.here]
        self.hash = mixed(context, self.word)
        self.keys, self.which, *_ = numbered(self.hash[self.here])

    def own(self, n: int) -> np.ndarray:
        """How often the n-grams of the level come in the texts that are learned from."""
        if n:
            return np.bincount(self.which[self.trained[self.here]], minlength=len(self.keys))
        own = np.bincount(self.at[self.trained], minlength=len(self.words))
        own[self.start] = self.learn.sum()
        return own

    def tell(self, n: int) -> None:
        """The counts of a level, and its contexts that may stay: positions, and their numbers."""
        self.count = np.where(self.same, self.count, 0)
        self.count[self.here] = self.told[n, GRAM][self.which]
        may = (self.total[self.here] > 2) | (self.count[self.here] != 1)
        self.here, context = self.here[may], self.context[may]
        if n > 1:
            self.keys, self.which, *_ = numbered(context)
        else:  # words have numbers in the order of their hashes already
            used = np.bincount(context, minlength=len(self.words)) > 0
            self.keys, self.which = self.words[used], (np.cumsum(used) - 1)[context]

    def evidence(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """For each context of the level in this chunk: how many different next words it has (each
        counted in parts, one for each time it comes), by how much leaving one out makes those that come
        more than once likelier than the suffix does, how many come once, and how often it comes."""
        trained = self.trained[self.here]
        at, context = self.here[trained], self.which[trained]
        c, total = self.count[at].astype(float), self.total[at].astype(float)
        gain = np.log(np.maximum(c - 1 - self.discount, 1 - self.discount) / (np.maximum(total - 1, 1) * self.likely[at]))
        gain[c < 2] = 0.0
        add = lambda w: np.bincount(context, weights=w, minlength=len(self.keys))
        return self.keys, [np.rint(add(w) * k).astype(np.int64) for w, k in ((1 / c, STEPS), (gain, STEPS), (c == 1, 1), (None, 1))]

    def smooth(self, n: int) -> None:
        """The likelihoods with contexts of n words where these are states."""
        kinds = self.told[n, CONTEXT][self.which]
        at, kinds = self.here[kinds > 0], kinds[kinds > 0]
        c, total = self.count[at], self.total[at].astype(float)
        self.likely[at] = np.maximum(c - self.discount, 0) / total + self.discount * kinds / total * self.likely[at]

    def walk(self, done: int, asks: int) -> dict[int, tuple[np.ndarray, list[np.ndarray]]]:
        """Smooths the levels up to ``done``, grows up to ``asks``; returns what to ask for."""
        out = {}
        for n in range(asks + 1):
            if n:
                self.grow(n)
            if (n, GRAM) not in self.told:
                out[GRAM] = (self.keys if n else self.words), [self.own(n)]
            elif n == 0:
                self.begin()
            else:
                self.tell(n)
                if n <= done:
                    self.smooth(n)
                else:
                    out[CONTEXT] = self.evidence()
        return out

    def scores(self, depth: int) -> pa.RecordBatch:
        self.walk(depth, depth)
        add = lambda v: np.add.reduceat(v, self.starts)
        known = add((self.first[self.at] > 0).astype(np.int64))
        columns = [pa.array(self.ids, pa.int64(), mask=~self.has_id), self.lengths.astype(np.int64), known, add(np.log10(self.base)), add(np.log10(self.likely))]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=SCORED)


#: The types of what is added up, by kind.
SUMS = {GRAM: ("<i4",), CONTEXT: ("<i8", "<i8", "<i4", "<i4")}


def asked(chunk: int, requests: dict[int, tuple[np.ndarray, list[np.ndarray]]], n: int) -> Iterator[pa.RecordBatch]:
    """A row for each kind and bucket; buckets are ranges of hashes, so order is kept."""
    for kind, (keys, sums) in requests.items():
        bucket = ((keys >> U64(32)) * U64(n) >> U64(32)).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else [0]
        pairs = list(zip(edges[:-1], edges[1:], strict=True))
        sums = [s.astype(t) for s, t in zip(sums, SUMS[kind], strict=True)]
        rows = [(chunk, kind, int(bucket[a]), close_packed(keys[a:b]), pack(*(s[a:b] for s in sums), press=QUICK)) for a, b in pairs]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), ASKED, strict=True)] if rows else [pa.array([], f.type) for f in ASKED], schema=ASKED)


def staying(sums: np.ndarray, discount: float) -> np.ndarray:
    """How many different next words a context has if it is a state, else 0."""
    kinds, gain, single, total = np.rint(sums[:, 0] / STEPS), sums[:, 1] / STEPS, sums[:, 2], sums[:, 3]
    rest = discount * np.maximum(kinds - 1, 0.5) / np.maximum(total - 1, 1)
    return np.where((kinds > 0) & (gain + single * np.log(rest) > 0), kinds, 0).astype(np.int64)


def answered(tab: pa.Table, discount: float) -> pa.Table:
    """The requests of one kind and bucket added up; each chunk gets what its keys come to."""
    kind = tab.column("kind")[0].as_py()
    keys = [opened(x.as_py()) for x in tab.column("keys")]
    sums = [np.stack(unpack(x.as_py(), *SUMS[kind]), axis=1).astype(np.int64) for x in tab.column("sums")]
    _, which, order, first = numbered(np.concatenate(keys))
    total = np.add.reduceat(np.concatenate(sums)[order], first, axis=0)
    known = int((total[:, 0] > 0).sum())
    total = total[:, 0] if kind == GRAM else staying(total, discount)
    ends = np.cumsum([len(k) for k in keys])
    back = [pack(total[which[b - len(k) : b]]) for k, b in zip(keys, ends.tolist(), strict=True)]
    n = len(back)
    columns = [tab.column("chunk").combine_chunks(), tab.column("kind").combine_chunks(), tab.column("bucket").combine_chunks(), pa.array(back, pa.binary()), pa.array([known, *[0] * (n - 1)]), pa.array([len(k) for k in keys])]
    return pa.Table.from_arrays(columns, schema=TOLD)


class SuffixTree:
    """Scores the texts of a table by a tree that is learned from some of them.

    ``least``: how often a context must come. By default twice, at all sizes, which leaves out no state."""

    def __init__(self, depth: int = 2, least: int | None = None, discount: float = 0.75, chunk_bytes: int = 4 << 20):
        self.depth, self.least, self.discount, self.chunk_bytes = depth, least, discount, chunk_bytes

    def _keep(self, rows: DataFrame, name: str) -> DataFrame:
        """Writes a table that is dealt by chunk as one bucketed by it: later rounds join it where it
        lies."""
        table = f"suffix_tree_{name}_{uuid.uuid4().hex}"
        out = rows.write.format("parquet").option("compression", "zstd")
        out.option("path", f"{self.path}/{name}").bucketBy(self.n, "chunk").sortBy("chunk").saveAsTable(table)
        return self.spark.table(table)

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs``: (doc_id, learn, text as binary). Returns (doc_id, n_tokens, n_known,
        train_tokens, base_score, score), log10."""
        self.spark = docs.sparkSession
        self.n = partitions(self.spark)
        self.path = f"{shared_dir(self.spark)}/suffix-tree-{uuid.uuid4().hex[:12]}"
        chunks = self._keep(chunked(docs, self.chunk_bytes).repartition(self.n, "chunk"), "chunks")
        self.spark.sparkContext._jvm.System.gc()
        size = chunks.agg(F.sum("tokens"), F.sum("length"), F.sum("words")).first()
        tokens = size[0] or 0
        self.often = self.least or 2
        # all chunks ask for their different words, then for a bigram at each place at most, then for about as much as the time before
        expected = size[2] or 0
        told: DataFrame | None = None
        known = 0
        for asks in range(self.depth + 2):
            done, buckets = max(asks - 2, 0), max(self.n, expected // BUCKET_ROWS)
            names = [f"told{k}" for k in range(asks)]
            rows = self._joined(chunks, told, names).mapInArrow(self._ask(names, tokens, known, done, min(asks, self.depth), buckets), ASKED_SQL)
            answers = rows.groupBy("bucket", "kind").applyInArrow(self._answer(), TOLD_SQL)
            parts = F.collect_list(F.struct("kind", "bucket", "sums")).alias(f"told{asks}")
            grams = F.when(F.col("kind") == GRAM, F.col("keys"))
            grouped = answers.repartition(self.n, "chunk").groupBy("chunk").agg(parts, F.sum("known").alias("known"), F.sum(grams).alias("keys"))
            # one table has what all rounds so far told, so a round joins it alone
            before, told = told, self._keep(grouped if told is None else told.drop("known", "keys").join(grouped.hint("merge"), "chunk", "left"), f"told{asks}")
            totals = told.agg(F.sum("known"), F.sum("keys")).first()
            expected = (size[1] or 0) if asks == 0 else (totals[1] or 0)
            if asks == 0:
                # the symbol before the start of a text is none of the words
                known = (totals[0] or 0) - (tokens > 0)
            if before is not None:
                remove(self.spark, f"{self.path}/told{asks - 1}")
            self.spark.sparkContext._jvm.System.gc()  # shuffle files go with the rounds they belong to
        depth, arguments = self.depth, (tokens, known, self.often, self.discount)
        names = [f"told{k}" for k in range(self.depth + 2)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    answers = answers_of(batch, names, k)
                    yield Chunk(batch.column("blob")[k].as_py(), answers, *arguments).scores(depth)

        scored = self._joined(chunks, told, names).mapInArrow(run, SCORED_SQL)
        return scored.select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")

    def _joined(self, chunks: DataFrame, told: DataFrame | None, names: list[str]) -> DataFrame:
        return chunks if told is None else chunks.join(told.select("chunk", *names).hint("merge"), "chunk", "left")

    def _answer(self):
        discount = self.discount
        return lambda tab: answered(tab, discount)

    def _ask(self, names: list[str], tokens: int, known: int, done: int, asks: int, buckets: int):
        arguments = (tokens, known, self.often, self.discount)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    chunk = Chunk(batch.column("blob")[k].as_py(), answers_of(batch, names, k), *arguments)
                    yield from asked(batch.column("chunk")[k].as_py(), chunk.walk(done, asks), buckets)

        return run


def answers_of(batch: pa.RecordBatch, names: list[str], row: int) -> dict[tuple[int, int], np.ndarray]:
    """What a chunk has been told, by level and kind. The round that asks for counts of level k asks
    for the contexts of level k - 1 too."""
    out = {}
    for k, name in enumerate(names):
        parts = batch.column(name)[row].values
        kinds, buckets, sums = ([], [], []) if parts is None else (parts.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "bucket", "sums"))
        order = np.lexsort((buckets, kinds))
        for kind in (GRAM, CONTEXT):
            mine = [unpack(sums[i], "<i8")[0] for i in order if kinds[i] == kind]
            out[k if kind == GRAM else k - 1, kind] = np.concatenate(mine) if mine else np.zeros(0, np.int64)
    return out


def suffix_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, tree: SuffixTree | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score. Held out are ids whose crc32 leaves ``held`` by ``folds``; all others are learned from.

    Null and empty texts are an end alone. Rows without id are learned from; repeated rows count each
    time. With nothing to learn from every word is unknown. An empty table gives an empty result;
    further columns are not read. Words and n-grams are told apart by hashes of 64 bits.
    """
    doc_id = F.col(id_col).cast("long")
    held_out = lambda c: F.coalesce(F.crc32(c.cast("string")) % folds == held, F.lit(False))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    out = (tree or SuffixTree()).score(docs.select(doc_id.alias("doc_id"), (~held_out(doc_id)).alias("learn"), text.alias("text")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
