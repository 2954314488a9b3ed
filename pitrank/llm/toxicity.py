"""Toxicity categories by a classifier chain of linear models.

Evidence terms (hashed words and five-byte word pieces that occur mostly in toxic rows) are counted over the
whole text.  The chain predicts one category after the other; every model is a logistic regression on the
evidence counts and on the probabilities of the categories before it.  In training those probabilities come
from models that did not see the row (out-of-fold), in prediction from models fitted on all rows.

The labelled table names at least the final category.  Where it names no other, two finer ones are derived
from the labelled toxic rows: ``severe`` (evidence a word at or above the toxic rows' median) and
``frequent`` (evidence count at or above that median).

Edge cases: null and empty texts have no evidence and get the base rate; null labels are no training rows;
without any toxic row all probabilities are 0.  Repeated rows and extra columns pass through; texts are read
whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Hashed, append_map, bounded_sample, by_bytes, joined, segment_sums, texts_of, word_bounds

BITS = 22
#: A rare outcome needs more rows than the common bound.
TOXIC_FIT_ROWS = 12_000
TOXIC_FIT_CHARS = 32_000_000
PIECE = 5

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)
_GAP = np.zeros(256, bool)
_GAP[32] = True


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word and word piece, the text that holds it, and the number of words of each text."""
    data, seps = joined(texts, b" ")
    data = _PLAIN[data]
    hashed = Hashed(data)
    starts, ends = word_bounds(data, _GAP)
    gaps = np.concatenate(([0], np.cumsum(data == 32)))
    windows = hashed.windows(PIECE)
    n = len(windows)
    whole = np.flatnonzero(gaps[PIECE:PIECE + n] == gaps[1:1 + n])  # no gap but at the first byte
    position = np.concatenate((starts, whole))
    bucket = np.concatenate((hashed.ranges(starts, ends) ^ np.uint64(0xA5A5A5A5), windows[whole])) >> np.uint64(64 - BITS)
    # A piece that starts on the separator belongs to the text after it.
    return (bucket.astype(np.int64), np.searchsorted(seps, position, side="right") - 1,
            np.diff(np.searchsorted(starts, seps)))


@dataclass
class Chain:
    categories: list[str]
    slots: np.ndarray  # bucket -> evidence term, -1 where none
    n_terms: int
    weights: list[np.ndarray] = field(default_factory=list)  # a model: terms, earlier categories, words, bias
    base: list[float] = field(default_factory=list)


@dataclass
class Rows:
    """Sparse evidence counts of some texts."""
    cuts: np.ndarray
    term: np.ndarray
    value: np.ndarray
    words: np.ndarray

    def take(self, keep: np.ndarray) -> Rows:
        picked = [np.arange(self.cuts[i], self.cuts[i + 1]) for i in keep]
        at = np.concatenate(picked) if picked else np.zeros(0, np.int64)
        cuts = np.concatenate(([0], np.cumsum([len(p) for p in picked]))).astype(np.int64)
        return Rows(cuts, self.term[at], self.value[at], self.words[keep])


def evidence(texts: list[bytes], slots: np.ndarray) -> Rows:
    of, slot, words = [], [], []
    base = 0
    for a, b in by_bytes(texts):
        bucket, owner, n = terms(texts[a:b])
        found = slots[bucket]
        hit = found >= 0
        of.append(owner[hit] + base)
        slot.append(found[hit])
        words.append(n)
        base += b - a
    of = np.concatenate(of) if of else np.zeros(0, np.int64)
    slot = np.concatenate(slot) if slot else np.zeros(0, np.int64)
    both, n = np.unique(of * (1 << 20) + slot, return_counts=True)
    owner = both >> 20
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    return Rows(cuts, both & ((1 << 20) - 1), np.log1p(n), np.concatenate(words) if words else np.zeros(0, np.int64))


def _logits(rows: Rows, earlier: np.ndarray, w: np.ndarray, n_terms: int) -> np.ndarray:
    z = segment_sums(rows.value * w[rows.term], rows.cuts) + w[-1] + w[-2] * np.log1p(rows.words)
    return z + earlier @ w[n_terms:n_terms + earlier.shape[1]]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(rows: Rows, earlier: np.ndarray, y: np.ndarray, n_terms: int, steps: int = 400, l2: float = 1e-5) -> np.ndarray:
    w = np.zeros(n_terms + earlier.shape[1] + 2)
    squares = np.full(len(w), 1e-8)
    n = max(len(y), 1)
    owner = np.repeat(np.arange(len(y)), np.diff(rows.cuts))
    for _ in range(steps):
        g = (_sigmoid(_logits(rows, earlier, w, n_terms)) - y) / n
        grad = np.concatenate((np.bincount(rows.term, rows.value * g[owner], n_terms), earlier.T @ g,
                               [g @ np.log1p(rows.words), g.sum()])) + l2 * w
        squares += grad * grad
        w -= 0.5 * grad / np.sqrt(squares)
    return w


def fit_chain(labelled: DataFrame, categories: list[str], text: str = "text", key: str = "doc_id", *,
              rows: int = TOXIC_FIT_ROWS, chars: int = TOXIC_FIT_CHARS, most_terms: int = 4096, least_rows: int = 3,
              lift: float = 8.0, folds: int = 5) -> Chain:
    """Fit on a hash sample of ``rows`` labelled rows and ``chars`` characters at most.

    ``categories`` are 0/1 columns in chain order, the last one says whether the text is toxic at all.
    """
    usable = labelled
    for c in categories:
        usable = usable.where(F.col(c).isNotNull())
    taken = (bounded_sample(usable, text, key, rows, chars)
             .select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"), *[F.col(c).cast("int").alias(c) for c in categories],
                     F.xxhash64(F.col(key), F.col(text)).alias("k")).collect())
    taken.sort(key=lambda r: (r.k, r.t, tuple(r[1:-1])))
    texts = [r.t.encode() for r in taken]
    toxic = np.array([r[categories[-1]] for r in taken], bool)
    present = np.zeros((2, 1 << BITS), np.int32)
    for a, b in by_bytes(texts):
        bucket, owner, _ = terms(texts[a:b])
        pairs = np.unique(owner * (1 << BITS) + bucket)
        kind = toxic[a + (pairs >> BITS)].astype(np.int64)
        np.add.at(present, (kind, pairs & ((1 << BITS) - 1)), 1)
    n_bad, n_good = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    bad, good = present[1] / n_bad, (present[0] + 0.5) / n_good
    chosen = np.flatnonzero((present[1] >= least_rows) & (bad >= lift * good))
    chosen = chosen[np.argsort(-(bad - good)[chosen], kind="stable")[:most_terms]]
    slots = np.full(1 << BITS, -1, np.int16)
    slots[chosen] = np.arange(len(chosen))
    chain = Chain(list(categories), slots, max(len(chosen), 1))
    x = evidence(texts, slots)
    targets = {c: np.array([r[c] for r in taken], float) for c in categories}
    if len(categories) == 1 and toxic.any():
        hits = segment_sums(np.expm1(x.value), x.cuts)
        dense = hits / np.maximum(x.words, 1)
        targets = {"severe": (toxic & (dense >= np.median(dense[toxic]))).astype(float),
                   "frequent": (toxic & (hits >= np.median(hits[toxic]))).astype(float), **targets}
        chain.categories = list(targets)
    fold = np.arange(len(taken)) % folds
    earlier = np.zeros((len(taken), 0))
    for c in chain.categories:
        y = targets[c]
        out = np.zeros(len(y))
        for f in range(folds):
            seen, unseen = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w = _logistic(x.take(seen), earlier[seen], y[seen], chain.n_terms)
            out[unseen] = _sigmoid(_logits(x.take(unseen), earlier[unseen], w, chain.n_terms))
        chain.weights.append(_logistic(x, earlier, y, chain.n_terms))
        chain.base.append(float(y.mean()) if len(y) else 0.0)
        earlier = np.column_stack((earlier, out))
    return chain


def probabilities(texts: list[bytes], chain: Chain) -> np.ndarray:
    """One column a category, in chain order."""
    x = evidence(texts, chain.slots)
    out = np.zeros((len(texts), 0))
    for w, base in zip(chain.weights, chain.base, strict=True):
        p = _sigmoid(_logits(x, out, w, chain.n_terms)) if base > 0 else np.zeros(len(texts))
        out = np.column_stack((out, p))
    return out


def predict_chain(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Add ``p_<category>`` of each category and ``toxic`` (the last one reaches ``threshold``) to every row.

    Toxic rows are rare, so the threshold lies below one half; clean rows of the held-out fold stay far under it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 8 MB whatever the input

    def run(lower: pa.Array) -> list[pa.Array]:
        p = probabilities(texts_of(lower), shared.value)
        return [*[pa.array(p[:, i]) for i in range(p.shape[1])], pa.array(p[:, -1] >= threshold)]

    made = {**{f"p_{c}": "double" for c in chain.categories}, "toxic": "boolean"}
    return append_map(docs, [F.lower(F.col(text))], made, run)
