"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A word enters as its own vector, if the training sample has it in several documents, beside the mean
of vectors of its runs of three bytes. Two recurrent passes over a window of words, one each way, are
pooled by attention into one logit; all overlapping windows of a text are scored, and the largest
logit counts. Training runs in numpy on the driver over all windows of a bounded sample of labelled
documents; scoring runs in Arrow batches, many windows side by side. The epoch is chosen, and logits
become probabilities, by whole documents that are kept back and scored on executors.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back
from . import windows as W
from .decontaminate import LOWER, words_of
from .quality import held_out, label_table

GRAMS = 16384
WORD_DIM, GRAM_DIM, HIDDEN, POOL = 12, 8, 12, 8
WINDOW, STRIDE = 48, 32
F32 = np.float32


@dataclass(frozen=True)
class Training:
    """Bounds and rates of training. ``sample`` is the most labelled documents of each label that are
    brought to the driver for training, ``clean`` the most of label 0 besides, for calibration alone.
    Training, calibration and scoring cover whole texts."""

    sample: int = 600
    clean: int = 1200
    epochs: int = 8
    batch: int = 32
    rate: float = 0.01
    decay: float = 1e-4
    least_docs: int = 3
    seed: int = 11


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def word_table(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its start, hashes of the different words, number of each word in them)."""
    hashes, start, end = words_of(data)
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return hashes, start, unique, inverse, *gram_lists(LOWER[data], start[first], end[first])


def gram_lists(lower: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs of three bytes of each word, its two ends included, and how many there
    are."""
    size = end - start + 1
    at = W.expand(start, size)
    word = np.repeat(np.arange(len(size)), size)
    if not len(at):
        return np.zeros(0, np.int64), size

    def byte(i: np.ndarray) -> np.ndarray:
        inside = (i >= start[word]) & (i < end[word])
        return np.where(inside, lower[np.clip(i, 0, len(lower) - 1)], 0).astype(np.uint64)

    code = (byte(at - 2) << np.uint64(16)) | (byte(at - 1) << np.uint64(8)) | byte(at)
    return (W.mix(code * W.BASE + W.BASE2) % np.uint64(GRAMS)).astype(np.int64), size


def window_places(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of all overlapping windows of documents of so many words; a
    document without words has one empty window."""
    count = np.maximum(1, -(-(words - (WINDOW - STRIDE)) // STRIDE))
    doc = np.repeat(np.arange(len(words)), count)
    first = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    base = np.cumsum(words) - words
    return doc, base[doc] + first, np.clip(words[doc] - first, 0, WINDOW)


class Network:
    """Weights and both passes. The arrays of a window batch are (time, window, units)."""

    def __init__(self, words: np.ndarray, seed: int):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        self.words = words  # sorted hashes of known words; row 0 of the table is for all others
        self.p = {
            "word": rng.normal(0, 0.1, (len(words) + 1, WORD_DIM)),
            "gram": rng.normal(0, 0.1, (GRAMS, GRAM_DIM)),
            "pool": rng.normal(0, 0.3, (2 * h, POOL)),
            "look": rng.normal(0, 0.3, POOL),
            "out": rng.normal(0, 0.3, 2 * h),
            "bias": np.zeros(1),
        }
        for way in ("f", "b"):
            self.p |= {
                f"{way}x": rng.normal(0, 1 / np.sqrt(d), (d, 3 * h)),
                f"{way}h": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)),
                f"{way}c": np.zeros(3 * h),
            }
        self.p = {k: v.astype(F32) for k, v in self.p.items()}

    def copy(self) -> Network:
        """The same words, with weights that further training leaves alone."""
        out = copy.copy(self)
        out.p = {k: v.copy() for k, v in self.p.items()}
        return out

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, 0)

    def vectors(self, row: np.ndarray, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Inputs of different words: own vector beside the mean of the vectors of byte runs."""
        if not len(row):
            return np.zeros((0, WORD_DIM + GRAM_DIM), F32)
        sums = np.add.reduceat(self.p["gram"][grams], np.cumsum(size) - size, axis=0)
        return np.concatenate([self.p["word"][row], sums / size[:, None].astype(F32)], axis=1)

    def _pass(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        p, h = self.p, HIDDEN
        state = np.zeros((x.shape[1], h), F32)
        out = np.empty((len(x), x.shape[1], h), F32)
        u = p[f"{way}h"]
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            from_state = state @ u
            gates = sigmoid(x[t, :, : 2 * h] + from_state[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(x[t, :, 2 * h :] + r * from_state[:, 2 * h :])
            after = state + (mask[t, :, None] * (1 - z)) * (new - state)
            if keep is not None:
                keep.append((t, state, z, r, new, from_state))
            out[t] = state = after
        return out

    def forward(self, px: dict, token: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. px: inputs of the different words times each way's input weights."""
        p = self.p
        tapes = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        h = np.concatenate([self._pass(px[w][token], mask, w, tapes[w]) for w in ("f", "b")], axis=2)
        pooled_in = np.tanh(h @ p["pool"])
        scores = np.where(mask > 0, pooled_in @ p["look"], F32(-1e9))
        scores -= scores.max(axis=0)
        a = np.exp(scores) * mask
        a /= np.maximum(a.sum(axis=0), F32(1e-9))
        pooled = (a[:, :, None] * h).sum(axis=0)
        logit = pooled @ p["out"] + p["bias"][0]
        if keep is not None:
            keep.update(h=h, pooled_in=pooled_in, a=a, pooled=pooled, tapes=tapes)
        return logit

    def projected(self, x: np.ndarray) -> dict[str, np.ndarray]:
        # one more row of zeros stands behind the last word of short windows
        x = np.concatenate([x, np.zeros((1, x.shape[1]), F32)])
        return {w: x @ self.p[f"{w}x"] + self.p[f"{w}c"] for w in ("f", "b")}

    def gradients(self, batch: dict, y: np.ndarray, step: int = 1024) -> tuple[float, dict[str, np.ndarray]]:
        """Loss of documents whose largest window logit, smoothly taken, should tell the label. Of
        more than ``step`` windows the logits come first, then the gradients of so many at once."""
        p, h = self.p, HIDDEN
        x = self.vectors(batch["row"], batch["grams"], batch["size"])
        px, keep = self.projected(x), {}
        cuts = [slice(i, i + step) for i in range(0, len(batch["doc"]), step)]
        token_of, mask_of = batch["token"], batch["mask"]
        logit = np.concatenate([self.forward(px, token_of[:, c], mask_of[:, c], keep if len(cuts) == 1 else None) for c in cuts])
        starts = np.flatnonzero(W.edges_of(batch["doc"]))
        top = np.maximum.reduceat(logit, starts)
        e = np.exp(logit - top[batch["doc"]])
        total = np.add.reduceat(e, starts)
        doc_logit = top + np.log(total)
        prob = sigmoid(doc_logit)
        loss = float(np.mean(np.logaddexp(0, doc_logit) - y * doc_logit))
        d_logits = ((prob - y) / len(y)).astype(F32)[batch["doc"]] * (e / total[batch["doc"]])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_px = {way: np.zeros((len(x) + 1, 3 * h), F32) for way in ("f", "b")}
        for c in cuts:
            d_logit, token, mask = d_logits[c], token_of[:, c], mask_of[:, c]
            if len(cuts) > 1:
                keep = {}
                self.forward(px, token, mask, keep)
            g["out"] += d_logit @ keep["pooled"]
            g["bias"] += d_logit.sum(keepdims=True)
            a, hh = keep["a"], keep["h"]
            d_pooled = d_logit[:, None] * p["out"]
            d_h = a[:, :, None] * d_pooled
            d_a = (hh * d_pooled).sum(axis=2)
            d_s = a * (d_a - (a * d_a).sum(axis=0))
            flat = keep["pooled_in"].reshape(-1, POOL)
            g["look"] += d_s.reshape(-1) @ flat
            d_in = d_s[:, :, None] * p["look"] * (1 - keep["pooled_in"] ** 2)
            g["pool"] += hh.reshape(-1, 2 * h).T @ d_in.reshape(-1, POOL)
            d_h = d_h + d_in @ p["pool"].T
            for k, way in enumerate(("f", "b")):
                back = np.zeros(hh.shape[1:2] + (h,), F32)
                u = p[f"{way}h"]
                for t, state, z, r, new, from_state in reversed(keep["tapes"][way]):
                    m = mask[t, :, None]
                    d_after = back + d_h[t, :, k * h : (k + 1) * h]
                    open_ = m * (1 - z)
                    d_new = d_after * open_ * (1 - new**2)
                    d_z = -d_after * m * (new - state) * z * (1 - z)
                    d_r = d_new * from_state[:, 2 * h :] * r * (1 - r)
                    d_gate = np.concatenate([d_z, d_r, d_new], axis=1)
                    d_state = np.concatenate([d_z, d_r, d_new * r], axis=1)
                    g[f"{way}h"] += state.T @ d_state
                    np.add.at(d_px[way], token[t], d_gate)
                    back = d_after * (1 - open_) + d_state @ u.T
        d_x = np.zeros_like(x)
        for way in ("f", "b"):
            g[f"{way}c"] = d_px[way].sum(axis=0)
            g[f"{way}x"] = x.T @ d_px[way][:-1]
            d_x += d_px[way][:-1] @ p[f"{way}x"].T
        np.add.at(g["word"], batch["row"], d_x[:, :WORD_DIM])
        share = d_x[:, WORD_DIM:] / batch["size"][:, None].astype(F32)
        np.add.at(g["gram"], batch["grams"], np.repeat(share, batch["size"], axis=0))
        return loss, g

    def window_batch(self, data: np.ndarray, offsets: np.ndarray, places: tuple | None = None) -> dict:
        """Inputs of the windows of joined texts with at least one byte between any two."""
        hashes, start, unique, inverse, grams, size = word_table(data)
        per_doc = np.diff(np.searchsorted(start, offsets))
        doc, first, length = window_places(per_doc) if places is None else places(per_doc)
        at = np.arange(WINDOW)[:, None]
        mask = at < length[None, :]
        index = np.minimum(first[None, :] + at, max(len(hashes) - 1, 0))
        token = np.where(mask, inverse[index], len(unique)) if len(unique) else np.zeros(mask.shape, np.int64)
        return {"doc": doc, "token": token, "mask": mask.astype(F32), "row": self.known(unique), "grams": grams, "size": size}

    def document_logits(self, data: np.ndarray, offsets: np.ndarray, step: int = 1024) -> np.ndarray:
        b = self.window_batch(data, offsets)
        px = self.projected(self.vectors(b["row"], b["grams"], b["size"]))
        parts = [self.forward(px, b["token"][:, i : i + step], b["mask"][:, i : i + step]) for i in range(0, len(b["doc"]), step)]
        return np.maximum.reduceat(np.concatenate(parts), np.flatnonzero(W.edges_of(b["doc"]))) if parts else np.zeros(0, F32)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def train(texts: list[bytes], y: np.ndarray, how: Training) -> list[Network]:
    """The network as it is after each epoch over all windows of the texts."""
    rng = np.random.default_rng(how.seed)
    use = np.arange(len(texts))
    seen: dict[int, list[int]] = {}
    for text, label in zip(texts, y, strict=True):
        for w in np.unique(words_of(np.frombuffer(text, np.uint8))[0]).tolist():
            c = seen.setdefault(w, [0, 0])
            c[int(label)] += 1
    common = sorted(w for w, c in seen.items() if sum(c) >= how.least_docs)
    net = Network(np.array(common, dtype=np.uint64), how.seed)
    # the first unit of a word's vector starts at its log odds of the labels, smoothed
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)
    odds = [np.log((seen[w][1] + 1) / (n1 + 2)) - np.log((seen[w][0] + 1) / (n0 + 2)) for w in common]
    if odds:
        net.p["word"][1:, 0] = np.clip(odds, -2, 2).astype(F32) * F32(0.5)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, after = 0, []
    for _ in range(how.epochs if len(use) else 0):
        rng.shuffle(use)
        for i in range(0, len(use), how.batch):
            pick = use[i : i + how.batch]
            data, offsets = joined([texts[j] for j in pick])
            loss, g = net.gradients(net.window_batch(data, offsets), y[pick])
            step += 1
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            scale = min(1.0, 5.0 / max(size, 1e-9))
            for k, v in net.p.items():
                grad = g[k] * F32(scale) + F32(how.decay) * v
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.99 * square[k] + 0.01 * grad**2
                v -= (how.rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(F32)
        after.append(net.copy())
    return after or [net]


def calibrated(logit: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """The slope and place that turn the logits of whole documents into probabilities under
    ``prior``, the share of label 1 among all labelled documents that may be learned from."""
    # as many of each label as there are: weights bring the prior back
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    at = np.array([1.0, 0.0])

    def cost(p: np.ndarray) -> float:
        z = p[0] * logit + p[1]
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + (p[0] - 1) ** 2 / 2 + p[1] ** 2 / 200)

    for _ in range(100):  # Newton's method with halved steps where a whole one does not help
        p = sigmoid(at[0] * logit + at[1])
        r, v = weight * (p - y), weight * p * (1 - p)
        slope = np.array([np.sum(r * logit) + at[0] - 1, np.sum(r) + at[1] / 100])
        bend = np.array([[np.sum(v * logit**2) + 1, np.sum(v * logit)], [np.sum(v * logit), np.sum(v) + 0.01]])
        move, now = np.linalg.solve(bend, slope), cost(at)
        while cost(at - move) > now and np.abs(move).max() > 1e-9:
            move = move / 2
        at = at - move
        if np.abs(move).max() < 1e-7:
            break
    return float(at[0]), float(at[1])


def column_logits(net: Network, column: pa.Array) -> np.ndarray:
    """The logit of each text of a column without nulls, over all its windows."""
    out = np.zeros(len(column))
    data, offsets = W.text_bytes(column)
    part = (offsets[1:] - offsets[0]).astype(np.int64) >> 21
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1), len(column)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
            out[a:b] = net.document_logits(*joined(texts))
    return out


def epoch_logits(docs: DataFrame, nets: list[Network]) -> tuple[np.ndarray, np.ndarray]:
    """(logits of each document by each network, labels) of ``docs`` (doc_id, text, y), scored on
    executors."""
    shared = docs.sparkSession.sparkContext.broadcast(nets)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(list(np.stack([column_logits(net, column) for net in shared.value], axis=1)), pa.list_(pa.float64()))

    rows = docs.select("doc_id", "y", F.arrow_udf(run, "array<double>")("text").alias("logits")).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["logits"]))
    return np.array([r["logits"] for r in rows]).reshape(len(rows), len(nets)), np.array([r["y"] for r in rows])


class ToxicityModel:
    def __init__(self, how: Training = Training()):  # noqa: B008
        self.how = how
        self.fitted: tuple[Network, float, float] | None = None

    def fit(self, docs: DataFrame, labelled: DataFrame) -> ToxicityModel:
        """``labelled`` (doc_id, y). The sample: of each label the documents with the least hash of
        their id, as many as ``how`` allows."""
        count = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
        total = sum(count.values())
        if not total:
            return self  # nothing to learn from: every score is 0
        # kept back to choose the epoch and for calibration; of label 0 all beyond the training sample
        rng, chosen = np.random.default_rng(self.how.seed), []
        for label, most in ((0.0, self.how.sample + self.how.clean), (1.0, self.how.sample)):
            part = labelled.where(F.col("y") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
            last = (rng.random(len(part)) < 0.15) | (np.arange(len(part)) >= self.how.sample)
            chosen += [(r["doc_id"], label, bool(k)) for r, k in zip(part, last, strict=True)]
        side = docs.sparkSession.createDataFrame(chosen, "doc_id long, y double, last boolean")
        # a bounded number of ids, so this side may be broadcast
        picked = docs.select("doc_id", "text").join(F.broadcast(side), "doc_id")
        rows = picked.where(~F.col("last")).select("doc_id", F.encode("text", "UTF-8").alias("raw"), "y").collect()
        rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["raw"])))
        nets = train([bytes(r["raw"]) for r in rows], np.array([r["y"] for r in rows], dtype=float), self.how)
        logits, y = epoch_logits(picked.where("last"), nets)
        every = (logits, y) if y.sum() >= 5 else epoch_logits(picked, nets)
        if not len(every[1]):
            return self
        if not len(y):
            logits, y = every
        best = int(np.argmin(np.mean(np.logaddexp(0, logits) - y[:, None] * logits, axis=0)))
        self.fitted = nets[best], *calibrated(every[0][:, best], every[1], count.get(1.0, 0) / total)
        return self

    def score(self, docs: DataFrame, text_col: str = "text", name: str = "score") -> DataFrame:
        """``docs`` with a column of scores; of its columns the text is read."""
        if self.fitted is None:
            return docs.withColumn(name, F.lit(0.0))
        net, slope, place = self.fitted
        shared = docs.sparkSession.sparkContext.broadcast(net)

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                yield pa.array(sigmoid(slope * column_logits(shared.value, column) + place))
            give_back()

        score = F.arrow_udf(run, "double")
        return docs.withColumn(name, score(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.5,
    how: Training = Training(),  # noqa: B008
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learned from labelled documents that are not held out. Null and empty texts have one empty
    window and so a score; repeated rows and null ids stay; with no labels nothing is known to be
    toxic and every score is 0; an empty table gives an empty result. Further columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    labelled = label_table(labels, "toxic").where(~held_out(F.col("doc_id")))
    out = ToxicityModel(how).fit(rows, labelled).score(rows)
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
