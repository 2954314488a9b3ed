"""Language identification: averaged hashed subword embeddings and a linear softmax.

Subwords are byte trigrams (with word boundaries) and whole words of the lower-cased text, hashed into a
fixed table.  A document is the mean of its subword embeddings; a linear softmax on that mean is trained by
stochastic gradient descent.  A temperature fitted on rows set aside calibrates the probabilities; documents
whose calibrated probability stays below a threshold, learned on the same rows, are rejected.

Edge cases: a text that is null, empty or has no letter is ``und``, score 0, rejected.  With no labelled row
every document is ``und``.  Repeated rows and extra columns pass through unchanged; texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import FIT_CHARS, FIT_ROWS, Hashed, append_map, bounded_sample, by_bytes, joined, segment_sums, texts_of, word_bounds

UNDETERMINED = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # buckets x langs: embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def subwords(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword of ``texts``, and the bounds of each text's run of buckets."""
    data, seps = joined(texts)
    hashed = Hashed(data)
    tri = hashed.windows(3)
    # A window belongs to the text in which it starts; the last two cross into the next text and are dropped.
    owner = np.ones(len(data), bool)
    owner[seps[1:]] = False
    owner[np.maximum(seps[1:] - 1, 0)] = False
    at = np.flatnonzero(owner[: len(tri)])
    starts, ends = word_bounds(data)
    words = hashed.ranges(starts, ends)
    position = np.concatenate((at, starts))
    bucket = np.concatenate((tri[at], words ^ np.uint64(0x5bd1e995))) >> np.uint64(64 - bits)
    order = np.argsort(position, kind="stable")
    return bucket[order].astype(np.int64), np.searchsorted(position[order], seps)


def fit_language(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", *,
                 rows: int = FIT_ROWS, chars: int = FIT_CHARS, bits: int = 16, dim: int = 16, epochs: int = 8, least_steps: int = 400,
                 rate: float = 40.0, accept: float = 0.9995, ceiling: float = 0.5, seed: int = 9) -> LanguageModel:
    """Fit on a hash sample of ``rows`` labelled rows and ``chars`` characters at most.

    A fifth of the sample is set aside for the temperature and the threshold: the share ``accept`` of its
    rows stays above the threshold, which never exceeds ``ceiling``.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    taken = (bounded_sample(usable, text, key, rows, chars)
             .select(F.lower(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(F.col(key), F.col(text)).alias("k"))
             .collect())
    taken.sort(key=lambda r: (r.k, r.l, r.t))
    langs = sorted({r.l for r in taken})
    if not langs:
        return LanguageModel([], np.zeros((1 << bits, 0)), np.zeros(0), 1.0, 0.0)
    y = np.array([langs.index(r.l) for r in taken])
    bags = []
    for r in taken:
        b, _ = subwords([r.t.encode()], bits)
        ids, n = np.unique(b, return_counts=True)
        bags.append((ids, (n / max(n.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    aside = np.arange(len(taken)) % 5 == 4
    train = np.flatnonzero(~aside)
    emb = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    w = rng.normal(0, 0.1, (dim, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    batches = max(1, len(train) // 32)
    epochs = max(epochs, -(-least_steps // batches))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(train), batches):
            ids = np.concatenate([bags[i][0] for i in batch])
            share = np.concatenate([bags[i][1] for i in batch])
            of = np.repeat(np.arange(len(batch)), [len(bags[i][0]) for i in batch])
            cuts = np.searchsorted(of, np.arange(len(batch) + 1))
            mean = segment_sums(emb[ids] * share[:, None], cuts).astype(np.float32)
            z = mean @ w + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            p /= len(batch)
            back = p @ w.T
            w -= step * 0.05 * mean.T @ p
            bias -= step * 0.01 * p.sum(0)
            np.subtract.at(emb, ids, step * share[:, None] * back[of])
    table = emb @ w
    held = np.flatnonzero(aside) if aside.sum() >= 20 else np.arange(len(taken))
    z = np.array([bags[i][1] @ table[bags[i][0]] for i in held]) + bias
    temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: _loss(z / t, y[held]))
    best = _softmax(z / temperature).max(1)
    threshold = float(min(ceiling, np.quantile(best, 1 - accept))) if len(langs) > 1 else 0.0
    return LanguageModel(langs, table.astype(np.float32), bias, float(temperature), threshold)


def _softmax(z):
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def _loss(z, y):
    return -np.log(np.maximum(_softmax(z)[np.arange(len(y)), y], 1e-12)).mean()


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (calibrated probability) and ``lang_rejected`` to every row."""
    bits = int(np.log2(len(model.table)))
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)  # a few hundred kB whatever the input

    def run(lower: pa.Array, lettered: pa.Array) -> list[pa.Array]:
        m = shared.value
        low, letters = texts_of(lower), np.array(lettered.to_pylist(), bool)
        pred, score = [UNDETERMINED] * len(low), np.zeros(len(low))
        if m.langs:
            for a, b in by_bytes(low):
                bucket, cuts = subwords(low[a:b], bits)
                n = np.maximum(np.diff(cuts), 1)[:, None]
                p = _softmax((segment_sums(m.table[bucket], cuts) / n + m.bias) / m.temperature)
                top = p.argmax(1)
                for i in np.flatnonzero(letters[a:b]):
                    pred[a + i], score[a + i] = m.langs[top[i]], float(p[i, top[i]])
        rejected = ~letters | (score < m.threshold) | (not m.langs)
        return [pa.array(pred, pa.string()), pa.array(score), pa.array(rejected)]

    return append_map(docs, [F.lower(F.col(text)), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))],
                      {"lang_pred": "string", "score": "double", "lang_rejected": "boolean"}, run)
