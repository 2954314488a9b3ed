"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

A term is a run of letters and digits, or a run of other characters that are no white space; terms are hashed
into a fixed number of buckets.  Every bucket has a sparse random index vector, and its word vector is the
sum of the index vectors of the terms within two places of it, over all documents.  A document is the mean of
its terms' vectors and of their squares, with a few ratios; a network with one hidden layer, trained on
labelled rows, gives the score, and a temperature fitted on rows set aside calibrates it.

Word vectors come from one pass in which every task adds up its own bucket table, so what is shuffled is one
table a task.  Edge cases: null and empty texts have no term and get the score of the zero vector; null labels
are no training rows; with no labels of either kind the score is the mean label (0.5 without any).  Repeated
rows and extra columns pass through; texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import FIT_CHARS, FIT_ROWS, Hashed, append_map, arrow_map, bounded_sample, by_bytes, joined, mix64, pieces, segment_sums, texts_of

BITS, DIM, NONZERO, REACH = 13, 24, 2, 2
CHUNK = 500_000

_CLASS = np.full(256, 2, np.int8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1


def terms(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the terms of all texts in order, and the bounds of each text."""
    data, seps = joined(texts)
    kind = _CLASS[data]
    edge = np.flatnonzero(np.diff(kind)) + 1
    starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(data)]))
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    bucket = (Hashed(data).ranges(starts, ends) >> np.uint64(64 - bits)).astype(np.int64)
    return bucket, np.searchsorted(starts, seps)


def chunks(texts: list[bytes]):
    """Groups of texts of bounded size; a very long text comes in pieces, whose owner is the same row."""
    for a, b in by_bytes(texts, CHUNK):
        if b - a == 1 and len(texts[a]) > 4 * CHUNK:
            for part in pieces(texts[a], CHUNK):
                yield [part], np.array([a])
        else:
            yield texts[a:b], np.arange(a, b)


def index_vectors(bits: int, dim: int, nonzero: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of every bucket's index vector."""
    h = mix64(np.arange(1 << bits, dtype=np.uint64)[:, None] * np.uint64(31) + np.arange(nonzero, dtype=np.uint64)[None, :] + np.uint64(77))
    return (h >> np.uint64(33)).astype(np.int64) % dim, np.where(h & np.uint64(1), 1.0, -1.0)


def word_vectors(docs: DataFrame, text: str = "text", *, bits: int = BITS, dim: int = DIM, nonzero: int = NONZERO, reach: int = REACH) -> np.ndarray:
    """Bucket table of word vectors of length one, from all documents."""
    names = [f"v{i}" for i in range(dim)]

    def run(batches):
        place, sign = index_vectors(bits, dim, nonzero)
        total = np.zeros((1 << bits) * dim)
        for batch in batches:
            for part, _ in chunks(texts_of(batch.column(0))):
                bucket, cuts = terms(part, bits)
                owner = np.repeat(np.arange(len(part)), np.diff(cuts))
                for step in range(1, reach + 1):
                    together = owner[step:] == owner[:-step]
                    left, right = bucket[:-step][together], bucket[step:][together]
                    for at, by in ((left, right), (right, left)):
                        for k in range(nonzero):
                            total += np.bincount(at * dim + place[by, k], sign[by, k], len(total))
        table = total.reshape(-1, dim)
        some = np.flatnonzero(table.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(table[some, i]) for i in range(dim)]], names=["bucket", *names])

    parts = docs.select(F.col(text).cast("string")).mapInArrow(run, "bucket bigint, " + ", ".join(f"{n} double" for n in names))
    summed = parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # one row a bucket at most
    table = np.zeros((1 << bits, dim))
    table[summed["bucket"].to_numpy(np.int64)] = summed[names].to_numpy()
    table = np.sign(table) * np.log1p(np.abs(table))
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """One row a text: mean vector, mean squares, and ratios of term counts."""
    bits, dim = int(np.log2(len(table))), table.shape[1]
    sums = np.zeros((len(texts), 2 * dim + 3))
    row, seen = -1, np.zeros(1 << bits, bool)  # buckets that earlier pieces of a very long text have had
    for part, rows in chunks(texts):
        bucket, cuts = terms(part, bits)
        vec = table[bucket]
        owner = np.repeat(np.arange(len(part)), np.diff(cuts))
        near = np.zeros(len(bucket))
        near[1:] = (bucket[1:] == bucket[:-1]) & (owner[1:] == owner[:-1])
        if len(part) == 1:
            if rows[0] != row:
                row, seen[:] = rows[0], False
            before = seen.sum()
            seen[bucket] = True
            distinct = np.array([seen.sum() - before])
        else:
            distinct = np.bincount(np.unique(owner * (1 << bits) + bucket) >> bits, minlength=len(part))
        sums[rows] += np.column_stack((segment_sums(vec, cuts), segment_sums(vec * vec, cuts), segment_sums(near, cuts), distinct, np.diff(cuts)))
    n = np.maximum(sums[:, -1:], 1)
    expected = (1 << bits) * (1 - np.exp(-n / (1 << bits)))
    return np.column_stack((sums[:, :-2] / n, sums[:, -2:-1] / expected, np.log1p(sums[:, -1:])))


@dataclass
class Network:
    table: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # hidden weights, hidden bias, output weights, output bias
    temperature: float
    base: float | None  # constant score where there was nothing to learn

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.base is not None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(_forward(self, (x - self.mean) / self.scale)[1] / self.temperature, -30, 30)))


def _forward(net: Network, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, b, u, c = net.layers
    hidden = np.tanh(z @ w + b)
    return hidden, hidden @ u + c[0]


def fit_quality(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", *, rows: int = FIT_ROWS,
                chars: int = FIT_CHARS * 4, hidden: int = 24, epochs: int = 150, rate: float = 0.01, l2: float = 1e-4, seed: int = 8) -> Network:
    """Word vectors from all ``docs``; the network from a hash sample of ``rows`` labelled rows at most."""
    table = word_vectors(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(table)
    width = 2 * table.shape[1] + 3
    usable = labelled.where(F.col(label).isNotNull())
    taken = bounded_sample(usable, text, key, rows, chars).select(
        F.col(text).cast("string"), F.col(label).cast("int"), F.xxhash64(F.col(key), F.col(text)).alias("k"))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = pooled(texts_of(batch.column(0)), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "k", "x"])

    got = arrow_map(taken, features, "y int, k bigint, x array<double>").collect()
    got.sort(key=lambda r: (r.k, r.y, r.x))
    x, y = np.array([r.x for r in got]).reshape(len(got), width), np.array([r.y for r in got], float)
    none = [np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), np.zeros(1)]
    if len(set(y)) < 2:
        return Network(table, np.zeros(width), np.ones(width), none, 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~aside)
    net = Network(table, x[train].mean(0), x[train].std(0) + 1e-3, [
        rng.normal(0, width ** -0.5, (width, hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.zeros(1)], 1.0, None)
    z = np.clip((x - net.mean) / net.scale, -20, 20)
    first, second = [np.zeros_like(p) for p in net.layers], [np.zeros_like(p) for p in net.layers]
    t = 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            h, logit = _forward(net, z[batch])
            g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[batch]) / len(batch)
            back = g[:, None] * net.layers[2] * (1 - h * h)
            grads = [z[batch].T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]
            t += 1
            for i, grad in enumerate(grads):
                grad = grad + l2 * net.layers[i]
                first[i] = 0.9 * first[i] + 0.1 * grad
                second[i] = 0.999 * second[i] + 0.001 * grad * grad
                step = rate * (1 - epoch / epochs)
                net.layers[i] = net.layers[i] - step * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
    held = np.flatnonzero(aside) if len(set(y[aside])) == 2 else train
    logit = _forward(net, z[held])[1]

    def loss(temperature):
        p = 1 / (1 + np.exp(-np.clip(logit / temperature, -30, 30)))
        return -(y[held] * np.log(p + 1e-12) + (1 - y[held]) * np.log(1 - p + 1e-12)).mean()
    net.temperature = float(min(np.geomspace(0.2, 20, 80), key=loss))
    return net


def score_quality(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Add ``score``, the calibrated probability of label 1, to every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # the bucket table: below 1 MB

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(shared.value.scores(pooled(texts_of(texts), shared.value.table)))]

    return append_map(docs, [F.col(text).cast("string")], {"score": "double"}, run)
