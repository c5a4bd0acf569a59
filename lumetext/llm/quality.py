"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network.

Words are runs of letters and digits or runs of punctuation, case kept, hashed to ``2 ** BITS`` places. Each place has
a sparse random index vector; a word's vector is the sum of the index vectors of its neighbours (two on either
side) over the whole corpus, gathered per task and summed in Spark, of fixed size however large the corpus. A
document is the mean and the spread of the unit vectors of its words and the mean product of neighbouring ones. The network is trained in numpy on a bounded
sample of labelled rows (``max_rows``, those of least hash); its temperature is set on a fifth of them that it
didn't learn from. Null and empty texts have zero vectors and get the score of these. If the labels hold fewer than
two classes, the score is the mean label, or 0.5 without any. Rows repeat as they do in the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, lean
from .language_id import held_out
from .words import hashes, text_buffer

BITS = 14
SIZE = 32
FEATURES = 3 * SIZE
_NONZERO = 4
_STEP = 1 << 21
_KIND = np.array([0 if chr(b) in " \t\n\x0b\x0c\r" else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.uint8)


def index_vectors(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << BITS, SIZE), dtype=np.float32)
    rows = np.arange(1 << BITS)
    for place in rng.permuted(np.tile(np.arange(SIZE), (1 << BITS, 1)), axis=1)[:, :_NONZERO].T:
        out[rows, place] = rng.choice([-1.0, 1.0], size=1 << BITS)
    return out


def tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, places of the words of some texts, number of words before each of these texts and in all)."""
    data, offsets = text_buffer(column)
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _STEP, side="right")) - 1)
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        kind = _KIND[part]
        first = kind != 0
        first[1:] &= kind[1:] != kind[:-1]
        edges = own[:-1][np.diff(own) > 0]
        first[edges] = kind[edges] != 0
        starts = np.flatnonzero(first)
        stop = kind != 0
        stop[:-1] &= (kind[1:] != kind[:-1]) | first[1:]
        ends = np.flatnonzero(stop) + 1
        yield a, (hashes(part, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(starts, own)
        a = b


def gather(docs: DataFrame) -> np.ndarray:
    """The unit word vectors of the corpus: places x SIZE."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.ascontiguousarray(index_vectors().T)
        total = np.zeros((SIZE, 1 << BITS))
        for batch in batches:
            for _, place, counts in tokens(batch.column(0)):
                near = index[:, place]
                around = np.zeros_like(near)
                text = np.repeat(np.arange(len(counts) - 1), np.diff(counts))
                for step in (1, 2):
                    if len(place) > step:
                        same = text[step:] == text[:-step]
                        around[:, step:] += near[:, :-step] * same
                        around[:, :-step] += near[:, step:] * same
                for d in range(SIZE):
                    total[d] += np.bincount(place, weights=around[d], minlength=1 << BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(SIZE), pa.int32()), pa.array(list(total.astype(np.int32)), pa.list_(pa.int32()))], ["d", "v"])  # whole numbers: sums of -1, 0 and 1

    parts = docs.select("text").mapInArrow(lean("quality", summed), "d int, v array<int>")
    # a row for each dimension and task; summed in blocks of places, each a fixed number of sums
    block = 256
    blocks = parts.select("d", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit((1 << BITS) - block), F.lit(block)), lambda i: F.slice("v", i + 1, block))).alias("b", "v"))
    sums = blocks.groupBy("d", "b").agg(*[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(block)])
    out = np.zeros((1 << BITS, SIZE), dtype=np.float32)
    for r in sums.select("d", "b", F.array(*[f"s{i}" for i in range(block)]).alias("s")).toLocalIterator():
        out[r["b"] * block : (r["b"] + 1) * block, r["d"]] = r["s"]
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-9)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and the mean product of neighbouring ones (which tells repeated words)."""
    out = np.zeros((len(column), FEATURES), dtype=np.float32)
    across = np.ascontiguousarray(vectors.T)
    for first, place, counts in tokens(column):
        n = np.diff(counts)
        full = np.flatnonzero(n)
        if len(full):
            own, start = across[:, place], counts[:-1][full]
            pairs = np.zeros_like(own)
            pairs[:, :-1] = own[:, :-1] * own[:, 1:]
            pairs[:, counts[1:][full] - 1] = 0
            mean, square, product = (np.add.reduceat(x, start, axis=1) / n[full] for x in (own, own * own, pairs))
            out[first + full] = np.concatenate([mean, np.sqrt(np.maximum(square - mean**2, 0)), product]).T
    return out


class Network:
    def __init__(self, seed: int = 3, hidden: int = 32, size: int = FEATURES):
        rng = np.random.default_rng(seed)
        self.w1, self.b1 = rng.normal(0, size**-0.5, (size, hidden)), np.zeros(hidden)
        self.w2, self.b2 = rng.normal(0, hidden**-0.5, hidden), np.zeros(1)
        self.mean, self.scale, self.temperature, self.constant = np.zeros(size), np.ones(size), 1.0, None

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 1500, batch: int = 256, rate: float = 0.005, decay: float = 1e-4) -> Network:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        rng = np.random.default_rng(1)
        order = rng.permutation(len(y))
        check, learn = order[: len(y) // 5], order[len(y) // 5 :]
        self.mean, self.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6
        weights = [self.w1, self.b1, self.w2, self.b2]
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for t in range(1, steps + 1):
            rows = rng.choice(learn, size=min(batch, len(learn)))
            z = (x[rows] - self.mean) / self.scale
            h = np.tanh(z @ self.w1 + self.b1)
            error = (1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -60, 60))) - y[rows]) / len(rows)
            back = np.outer(error, self.w2) * (1 - h**2)
            for w, (m, v), g in zip(weights, moments, (z.T @ back, back.sum(axis=0), h.T @ error, error.sum(keepdims=True)), strict=True):
                g = g + decay * w
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if len(check) and len(set(y[check].tolist())) > 1:
            z = self.logits(x[check])
            loss = lambda t: np.logaddexp(0, np.where(y[check] > 0, -z, z) / t).mean()
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
        return self


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, max_rows: int = 6000) -> Network:
    """docs: doc_id, text of those to learn from; labels: doc_id, label (0 or 1)."""
    known = labels.where("doc_id is not null and label is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = {r["doc_id"]: r["label"] for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()}
    if not sample:
        return Network().train(np.zeros((0, FEATURES)), np.zeros(0))

    def vectorized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(pooled(b.column(1), vectors)), pa.list_(pa.float32()))], ["doc_id", "x"])

    wanted = docs.sparkSession.createDataFrame([(i,) for i in sample], "doc_id long")  # at most ``max_rows`` numbers
    got = docs.join(F.broadcast(wanted), "doc_id", "left_semi").select("doc_id", "text").mapInArrow(lean("quality", vectorized), "doc_id long, x array<float>").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return Network().train(np.array([r["x"] for r in got], dtype=np.float64).reshape(-1, FEATURES), np.array([sample[r["doc_id"]] for r in got]))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, threshold: float = 0.7) -> DataFrame:
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = network.score(pooled(b.column(1), vectors))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(lean("quality", scored), "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learns from labels (doc_id, quality) that aren't held out."""
    docs = id_and_text(docs)
    rest = F.coalesce(held_out(2, 4), F.lit(False))
    vectors = gather(docs)
    network = fit(docs.where(~rest), labels.where(~rest).select("doc_id", F.col("quality").alias("label")), vectors, max_rows)
    return score(docs, vectors, network, threshold).select("doc_id", rest.alias("held_out"), "score", "predicted")
